"""Each operator on odd rows and on the smallest tables, against plain versions of itself."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import bpe, fingerprints, langid, licenses, linededup, lmscore, mixing, ngramjoin, quality, registry, warc
from quarrymill.llm.common import written
from quarrymill.llm.components import components

from ..compare import same
from ..conftest import SMALL
from .odd import docs, empty, listed, texts

WS = " \t\n\x0b\f\r"


def table(spark, name="documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(name, spark, duck):
    same(registry.queries()[name](spark, SMALL).toPandas(), duck.execute(registry.oracle_sql()[name]).df())


# ---- 1: language model


def learns(df):
    return df.withColumn("learn", ~lmscore.held_out())


def base_scores(rows):
    learnt = [x for i, x in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    low = lambda x: (x or "").encode().lower().split()
    c = collections.Counter(w for x in learnt for w in low(x))
    n, v = sum(c.values()) + len(learnt), len(c) + bool(learnt)
    lp = lambda k: math.log10((k + 1) / (n + v + 1))
    return {(i, x): (len(low(x)) + 1, sum(c[w] > 0 for w in low(x)) + bool(learnt), n, sum(lp(c[w]) for w in low(x)) + lp(len(learnt))) for i, x in rows}


@pytest.mark.parametrize("head", [3, 200_000])
def test_lm_counts_are_exact_and_scores_dont_depend_on_partitions(spark, head):
    rows = docs(spark)
    want = base_scores([(r["doc_id"], r["text"]) for r in rows.collect()])
    seen = None
    for parts in (1, 4):
        got = lmscore.score(learns(rows.repartition(parts)), ("doc_id", "text"), head).collect()
        assert len(got) == rows.count()
        for r in got:
            n, known, total, base = want[r["doc_id"], r["text"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
            assert r["base_score"] == pytest.approx(base, abs=1e-6)
            assert math.isfinite(r["score"]) and r["score"] < 0
        scores = {(r["doc_id"], r["text"]): r["score"] for r in got}
        assert seen is None or scores == pytest.approx(seen, abs=1e-9)
        seen = scores
    assert lmscore.score(learns(empty(spark))).count() == 0


def test_lm_learns(spark):
    got = registry.op1_lm_score(spark, SMALL).toPandas()
    held = got[got.held_out]
    bits = -held.score.sum() / math.log10(2) / held.n_bytes.sum()
    assert bits < 3.6  # a uniform model needs 8 bits a byte
    junk = spark.createDataFrame([(2, "zq#q%xj kqzv !!x jq" * 20)], "doc_id long, text string").withColumn("learn", F.lit(False))
    both = lmscore.score(table(spark).select("doc_id", "text", F.lit(True).alias("learn")).unionByName(junk.withColumn("doc_id", F.lit(-1).cast("long")))).toPandas().set_index("doc_id")
    assert both.bits_per_byte[-1] > 2 * both.bits_per_byte.drop(-1).median()


def test_lm_decisions_are_a_distribution():
    import numpy as np

    singles, own = np.zeros((256, 256), np.int64), np.zeros((1, 256), np.int64)
    singles[97, [98, 99]] = [50, 20]
    singles[0, 97] = 3
    own[0, 98] = 9
    trees = lmscore.Trees(singles, np.array([97 * 256 + 97]), own)
    assert np.allclose((0.5 ** trees.length.reshape(257, 256).astype(float)).sum(1), 1)
    # with empty tables every decision has a half, so a byte costs its path, in the tree of the two bytes before if it has one
    model = lmscore.Model(trees, [np.zeros(lmscore.SLOTS + 256, np.int16)] * 3)
    length = trees.length.reshape(257, 256)
    assert model.costs([b"ab"])[0][0] == pytest.approx((length[0, 97] + length[97, 98] + length[98, 0]) * math.log(2), rel=1e-6)
    assert model.costs([b"x", b"aab"])[0][1] == pytest.approx((length[0, 97] + length[97, 97] + length[256, 98] + length[98, 0]) * math.log(2), rel=1e-6)


def coded(model, text):
    """The cost of a text's bytes, decision by decision."""
    import numpy as np

    x = lmscore.PAD + text + b"\0"
    keys = lmscore.contexts(x, np.arange(len(lmscore.PAD), len(x)), model.trees.tree)
    weights = np.array(lmscore.WEIGHTS)
    blocks = lmscore._blocks(len(text) + 1)[: len(text) + 1]
    total = 0.0
    for block in range(int(blocks[-1]) + 1):
        steps, seen = np.zeros_like(weights), np.zeros(len(weights))
        for i in np.flatnonzero(blocks == block):
            slot = [int(lmscore.slots(k[i : i + 1])[0]) for k in keys]
            gate = 2 * (abs(model.tables[2][slot[2]]) >= lmscore.SURE * lmscore.FINE) + (abs(model.tables[1][slot[1]]) >= lmscore.SURE * lmscore.FINE)
            for code in model.trees.paths(keys[0][i : i + 1])[1].tolist():
                sign = 1 if code & 1 else -1
                logits = np.array([t[p + (code >> 1)] / lmscore.FINE for t, p in zip(model.tables, slot, strict=True)])
                p = 1 / (1 + math.exp(-sign * float(weights[gate] @ logits)))
                total -= math.log(p)
                steps[gate] += (1 - p) * sign * logits
                seen[gate] += 1
        weights = np.clip(weights + lmscore.STEP * steps / (seen + 200)[:, None], 0, 2)
    return total


def test_lm_codes_as_decision_by_decision():
    import random

    import numpy as np

    rnd = random.Random(4)
    make = lambda n: " ".join(rnd.choice(["the", "then", "theme", "Ünï", "x1\n"]) for _ in range(n)).encode()
    singles = np.zeros((256, 256), np.int64)
    learnt = make(3000)
    np.add.at(singles, (list(learnt[:-1]), list(learnt[1:])), 1)
    trees = lmscore.Trees(singles)
    tables = []
    x = lmscore.PAD + learnt + b"\0"
    for key in lmscore.contexts(x, np.arange(len(lmscore.PAD), len(x)), trees.tree):
        counts = np.full((lmscore.SLOTS + 256, 2), lmscore.PRIOR)
        n, code = trees.paths(key)
        np.add.at(counts.reshape(-1), np.repeat(lmscore.slots(key) * 2, n) + code, 1)
        tables.append(np.rint(np.log(counts[:, 1] / counts[:, 0]) * lmscore.FINE).astype(np.int16))
    model = lmscore.Model(trees, tables)
    held = [b"", b"q", make(40), make(300), "ünknown wörds, and the rest".encode() * 5]
    costs = model.costs(held)[0]
    assert costs == pytest.approx([coded(model, t) for t in held], rel=1e-4)
    assert costs[3] / len(held[3]) < 1.2 < costs[4] / len(held[4])
    # the gate says something: known contexts are sure far more often than unknown ones
    sure = lambda t: np.mean(np.abs(tables[2].take(lmscore.slots(lmscore.contexts(lmscore.PAD + t + b"\0", np.arange(4, len(t) + 5), trees.tree)[2]))) >= lmscore.SURE * lmscore.FINE)
    assert sure(held[3]) > 0.5 > 0.1 > sure(bytes(rnd.randrange(256) for _ in range(2000)))


def test_lm_tells_texts_that_stand_twice_apart(spark):
    import random

    rnd = random.Random(9)
    make = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(n))
    twice, once = make(600), [make(600) for _ in range(20)]
    rows = [(1, twice, True), (2, twice, True), (3, twice, False), *[(10 + i, x, i % 2 == 0) for i, x in enumerate(once)], (99, None, True)]
    got = {r["doc_id"]: r for r in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)).collect()}
    assert max(got[i]["bits_per_byte"] for i in (1, 2, 3)) < 0.5 * min(got[10 + i]["bits_per_byte"] for i in range(20))
    assert all(got[i]["n_foretold"] > 10 for i in (1, 2, 3)) and all(got[10 + i]["n_foretold"] == 0 for i in range(20))
    # what phrases save is what the decisions, coded one after another, say
    model, _, known, _ = lmscore.train(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"))
    table = {r["context"]: r for r in known.collect()}
    cost, ((context, phrase, spent),) = model.costs([twice.encode()])
    total, w, b, gate = cost[0], [lmscore.TRUST] * 3, list(lmscore.BIAS), 0
    for c, p, nats in zip(context.tolist(), phrase.tolist(), spent.tolist(), strict=True):
        if c in table:
            r, met = table[c], table[c]["guess"] == p
            x = math.log((r["c"] + 0.5) / (r["n"] - r["c"] + 0.5))
            good = 1 / (1 + math.exp(-(w[gate] * x + b[gate])))
            total += -math.log(good if met else 1 - good) - (nats if met else 0)
            move = lmscore.TRUST_STEP * (1 - good if met else -good)
            w[gate], b[gate], gate = w[gate] + move * x, b[gate] + move, 1 if met else 2
    assert got[3]["score"] == pytest.approx(-total / math.log(10), rel=1e-6)


def test_lm_counts_leave_a_task_in_small_batches(monkeypatch):
    import numpy as np
    import pyarrow as pa
    import pyspark

    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(33, 3000, 400_000)))] + [" ".join(f"w{i}" for i in rng.integers(0, 60_000, 5000)) for _ in range(30)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts), pa.array([True] * len(texts))], names=["text", "learn"])]
    rows = list(lmscore._count_tokens(batches))
    assert len(rows) > 3 and max(b.num_rows for b in rows) <= 1 << 14
    tokens = {}
    for b in rows:
        for token, n in zip(b.column("token").to_pylist(), b.column("train").to_pylist(), strict=True):
            if token is not None:
                tokens[token] = tokens.get(token, 0) + n
    assert tokens == collections.Counter(x for t in texts for x in t.encode().lower().split())
    triples = sum(n for b in rows for x, n in zip(b.column("triple").to_pylist(), b.column("train").to_pylist(), strict=True) if x is not None)
    assert triples == sum(len(t.encode()) + 1 for t in texts)
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    out = list(lmscore._count_decisions(lmscore.Trees(np.ones((256, 256), np.int64)))(b.select(["text"]) for b in batches))
    assert max(b.num_rows for b in out) <= 8 and len({p for b in out for p in b.column("part").to_pylist()}) == sum(b.num_rows for b in out)
    counts = np.zeros(lmscore.PART * 2, np.uint64)
    for b in out:
        for packed in b.column("counts").to_pylist():
            lmscore._add(counts, packed)
    assert counts.sum() == 3 * 8 * triples  # trees of equal counts have 8 decisions a byte


# ---- 2: byte pairs


def tiktokens():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_byte_pairs_are_the_merges(spark):
    import random

    path, enc = tiktokens()
    rnd = random.Random(2)
    odd = ["".join(rnd.choice("ab eéß\n\t\x0b\x1c\x85　中😀'stl19ａ́") for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    for x in [*odd, "a" * 3000, " " * 2000, "ab" * 2000, *[t or "" for t in texts()]]:
        assert bpe.encode_text(x, path) == enc.encode_ordinary(x)
    pairs = bpe.coder(path)
    for _ in range(1500):  # pieces that aren't UTF-8
        piece = bytes(rnd.choice(b"aeinorst \xc3\xa9\xff\x00") for _ in range(rnd.randint(1, 50)))
        assert pairs.encode(piece) == enc._encode_single_piece(piece)
    got = bpe.round_trip(docs(spark), path, more=("doc_id", "text")).collect()
    for r in got:
        ids = enc.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    full = bpe.decode(bpe.encode(docs(spark), path, check="ok"), path)
    assert full.filter("not ok or decode(decoded, 'UTF-8') <> coalesce(text, '')").count() == 0
    assert bpe.encode(empty(spark), path).count() == 0


# ---- 3: n-gram join


def shingles(x, k=5):
    w = (x or "").encode().split()
    return {tuple(w[i : i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(rows, t=0.8):
    sets = [shingles(x) if i is not None else set() for i, x in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = collections.defaultdict(list)
    for a, (i, _) in enumerate(rows):
        low[find(a)].append(i)
    return sorted(((i, x, min(low[find(a)], key=lambda z: (z is None, z)), links[a]) for a, (i, x) in enumerate(rows)), key=str)


def near_group(n):
    import random

    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 10_000)}" for _ in range(200)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 1000)}"
        out.append((1000 + i, " ".join(w)))
    return out


def test_join_is_exact(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()] + near_group(150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (256, 16):  # one block, and many
        monkeypatch.setattr(ngramjoin, "BLOCK", block)
        # rows are told apart by id and text
        got = ngramjoin.similar_classes(df)
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["class_id"] if r["class_id"] is not None else -1, r["n_links"]) for r in got.collect()) == sorted((i if i is not None else -1, c if c is not None else -1, n) for i, _, c, n in similar(rows))
    assert ngramjoin.similar_classes(empty(spark)).count() == 0
    kept = ngramjoin.one_of_each(df.filter("doc_id is not null and doc_id <> 3"))
    want = {c for i, x, c, _ in similar([r for r in rows if r[0] is not None and r[0] != 3])}
    assert {r["doc_id"] for r in kept.collect()} == want
    # rows with one id are separate: those that are like no other stay, of equal ones one
    some = [(1, "x y z a b c"), (3, "x y z a b c"), (3, "k l m n o p"), (3, "k l m n o p"), (4, None), (4, None), (None, "x y z a b c"), (5, "k l m n o p"), (6, "")]
    left = ngramjoin.one_of_each(spark.createDataFrame(some, "doc_id long, text string").withColumn("_other", F.lit(1)))
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, "x y z a b c"), (3, "k l m n o p"), (4, None), (4, None), (None, "x y z a b c"), (6, "")], key=str)


def test_pruning_keeps_what_reaches_the_threshold():
    plan = ngramjoin.least_agreeing(0.8, 1e-6, 96)
    assert [k for k, _ in plan] == [16, 32, 48, 64, 80, 96] and all(m < 0.8 * k for k, m in plan)
    # the chance that a pair of similarity 0.8 is dropped at a step is small at each
    for k, m in plan:
        assert sum(math.comb(k, j) * 0.8**j * 0.2 ** (k - j) for j in range(m)) < 1e-4


def test_common_counts(monkeypatch):
    import random

    import numpy as np

    monkeypatch.setattr(ngramjoin, "WIDE", 7)
    rnd = random.Random(5)
    left, right = ([np.array(sorted(rnd.sample(range(60), rnd.choice([0, 1, 20, 60]))), np.uint64) for _ in range(n)] for n in (9, 4))
    assert ngramjoin.common_counts(left, right).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert ngramjoin.common_counts([], right).shape == (0, 4) and ngramjoin.common_counts(left[:0], []).shape == (0, 0)


def test_a_large_group_of_unlike_fillings_is_exact(spark, monkeypatch):
    """More classes than a block in one component, of similarities on both sides of the threshold, against every pair; equal
    texts, one id twice, and a second template among them."""
    import random

    monkeypatch.setattr(ngramjoin, "BLOCK", 32)
    rnd = random.Random(8)
    templates = [[f"{p}{k}" for k in range(150)] for p in "tu"]

    def filled(i):
        w = list(templates[i % 5 == 0])
        for at in rnd.sample(range(0, 150, 10), rnd.choice([0, 1, 1, 2, 3, 4])):
            w[at] = f"f{rnd.randrange(40)}"
        return " ".join(w)

    rows = [(i, filled(i)) for i in range(420)]
    rows += [(7, rows[200][1]), (7, filled(1)), (1000, rows[9][1])]
    want = sorted((i, c, n) for i, _, c, n in similar(rows))
    links = [n for _, _, n in want]
    assert min(links) < 150 < max(links)  # not all of a template are linked with each other
    got = ngramjoin.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == want


def test_three_thousand_texts_of_one_template(spark):
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit(f"t{k}") for k in range(60)], F.concat(F.lit("f"), "id"), *[F.lit(f"s{k}") for k in range(60)]).alias("text"))
    got = ngramjoin.similar_classes(rows)
    assert {(r["class_id"], r["n_links"], r["n"]) for r in got.groupBy("class_id", "n_links").agg(F.count("*").alias("n")).collect()} == {(0, n - 1, n)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(100, 5), (7, 7), (None, 1)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)} | {100: 0}
    assert components(edges.filter("false")).count() == 0


# ---- 4: fingerprints


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_beside_the_next(spark, parts):
    rows = docs(spark).filter("doc_id is not null and doc_id <> 3").repartition(parts)
    order = sorted(((r["doc_id"], r["text"] or "") for r in rows.collect()), reverse=True)
    want = {}
    for (i, x), (_, y) in zip(order, order[1:] + order[:1], strict=True):
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        a, b, c = (fingerprints.signature(t) for t in (x, edited, y))
        want[i] = (len(x), hashlib.sha256(edited.encode()).hexdigest(), a.astype(">u4").tobytes().hex(), fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    got = fingerprints.beside_next(rows).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in got} == want
    assert fingerprints.beside_next(docs(spark)).count() == docs(spark).count() and fingerprints.beside_next(empty(spark)).count() == 0


def test_fingerprint_estimates(spark):
    a, b = near_group(2)
    s, t = shingles(a[1]), shingles(b[1])
    assert abs(fingerprints.likeness(fingerprints.signature(a[1]), fingerprints.signature(b[1])) - len(s & t) / len(s | t)) < 0.2
    rows = [*near_group(60), (1, "short text"), (2, "short text"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = dict(rows)
    want = {(i, c, n) for i, _, c, n in similar(rows)}
    near = fingerprints.near_duplicates(df)
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in near.collect()} == want
    whole = fingerprints.beside_next(df.repartition(3), near=near).collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in whole} == want and len(whole) == len(rows)


def test_fingerprints_want_integer_ids(spark):
    rows = spark.createDataFrame([(2, "a b"), (1, "c d")], "doc_id int, text string")
    assert {r["doc_id"] for r in fingerprints.beside_next(rows).collect()} == {1, 2}
    with pytest.raises(TypeError, match="string"):
        fingerprints.beside_next(rows.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_no_link_is_lost_beside_an_unlike_head(spark):
    """Documents that share buckets with one of least id that is like none of them, interleaved with another group."""
    import random

    rnd = random.Random(12)
    base, other = ([f"{p}{rnd.randint(0, 10_000)}" for _ in range(300)] for p in "wv")
    edited = lambda w, at: " ".join(f"e{rnd.randint(0, 10**6)}" if i in at else x for i, x in enumerate(w))
    rows = [(0, " ".join(base[:200]) + " " + " ".join(f"h{i}" for i in range(60))), (1, " ".join(other[:210]) + " " + " ".join(f"g{i}" for i in range(60)))]
    rows += [(2 + 2 * i, edited(base, {rnd.randrange(300), rnd.randrange(300)})) for i in range(25)]
    rows += [(3 + 2 * i, edited(other, {rnd.randrange(300), rnd.randrange(300)})) for i in range(25)]
    want = {(i, c, n) for i, _, c, n in similar(rows)}
    assert {c for _, c, _ in want} == {0, 1, 2, 3} and max(n for _, _, n in want) == 24
    got = fingerprints.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()} == want


def test_fingerprints_find_all_links(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark).collect()]
    want = {i: n for i, _, _, n in similar(rows)}
    got = {r["doc_id"]: r["n_links"] for r in registry.op4_fingerprints(spark, SMALL).collect()}
    assert set(got) == set(want) and sum(got.values()) >= 0.9 * sum(want.values()) and all(got[i] <= n for i, n in want.items())


# ---- 5: lines


def deduped(rows, least=50):
    """Row by row: a line goes if a run of lines with ``least`` words that holds it stands earlier."""
    flat = {}
    for i, x in rows:
        flat[i] = [(p, line.strip(WS), len(words(line))) for p, line in enumerate((x or "").split("\n")) if words(line)]
    first, spans = {}, []
    for i in sorted(flat):
        ls = flat[i]
        for a in range(len(ls)):
            total = 0
            for b in range(a, len(ls)):
                total += ls[b][2]
                if total >= least:
                    key = tuple(x[1] for x in ls[a : b + 1])
                    spans.append((i, a, b, key))
                    first.setdefault(key, (i, a))
    gone = {(i, flat[i][p][0]) for i, a, b, key in spans if first[key] < (i, a) for p in range(a, b + 1)}
    return {i: None if x is None else "\n".join(line for p, line in enumerate(x.split("\n")) if (i, p) not in gone) for i, x in rows}


def test_line_dedup_is_exact(spark):
    import random

    rnd = random.Random(8)
    pool = [" ".join(rnd.choice(["a", "b", "c"]) for _ in range(rnd.choice([1, 3, 20, 60]))) for _ in range(25)]
    rows = [(i, "\n".join(rnd.choice([*pool, ""]) for _ in range(rnd.randint(1, 14)))) for i in range(60)]
    rows += [(100 + i, x) for i, x in enumerate(texts()) if not x or len(x) < 5000]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == deduped(rows)
    odd = linededup.dedup_lines(docs(spark))
    assert odd.count() == docs(spark).count() and set(docs(spark).columns) <= set(odd.columns)
    assert linededup.dedup_lines(empty(spark)).count() == 0


# ---- 6: WARC


def test_warc_round_trip(spark):
    html = ["<p>" + "é" * 600, "<p>" + "é" * 600, "small", "small", None, "", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" + "z" * 990, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" + "z" * 990, "<p>" + "é" * 600]
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, h, "extra") for i, h in enumerate(html)] + [(8, "http://h/8", html[8], "again"), (None, None, "no id", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(2)
    raw = warc.write_archives(pages)
    back = warc.read_archives(spark, raw, payload=True)
    assert listed(back, "page_id", F.decode("payload", "UTF-8")) == sorted(((i, h or "") for i, _, h, _ in rows), key=str)
    got = warc.resolve(warc.read_archives(spark, warc.dedup_archives(spark, raw))).collect()
    kind = sorted(((r["page_id"], r["type"], r["refers_to_page"], r["payload_bytes"]) for r in got), key=str)
    size = lambda i: len((html[i] or "").encode())
    want = [(i, *(("revisit", 8) if i in (0, 1) else ("revisit", 7) if i == 6 else ("response", None)), size(i)) for i in range(8)] + [(8, "response", None, size(8)), (8, "revisit", 8, size(8)), (None, "response", None, 5)]
    assert kind == sorted(want, key=str)
    assert warc.read_archives(spark, warc.write_archives(pages.filter("false"))).count() == 0


@pytest.mark.parametrize("ends", ["", "\r\n", "\r\n\r", "\r\n\r\n", "\r\n\r\n\r\n"])
def test_payloads_keep_their_line_ends(spark, ends):
    html = [ends, "\r\n\r\n" * 40000 + ends, "x" * 65530 + "\r\n\r\r\n\r\n\n\r" + ends, "a\r\n\r\nWARC/1.1\r\n\r\n" + ends, "\r\n" + "y" * 3_000_000 + ends, ends]
    raw = warc.write_archives(spark.createDataFrame(list(enumerate(html)), "page_id long, html string").withColumn("url", F.lit("u")).repartition(1))
    for path in (raw, warc.dedup_archives(spark, raw)):
        assert {r["page_id"]: r["payload"].decode() for r in warc.read_archives(spark, path, payload=True).collect()} == dict(enumerate(html))


def test_archives_of_others(spark, tmp_path):
    """A member for each record, payloads that are no UTF-8, and more than one file in a task."""
    import gzip
    import hashlib

    payloads = [bytes(range(256)) * (1 + i * 37) for i in range(20)]
    for part in range(4):
        with open(tmp_path / f"{part}.warc.gz", "wb") as f:
            for i in range(part * 5, part * 5 + 5):
                http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payloads[i])}\r\n\r\n".encode()
                head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{i}:0>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(payloads[i]).hexdigest()}\r\nContent-Length: {len(http) + len(payloads[i])}\r\n\r\n"
                f.write(gzip.compress(head.encode() + http + payloads[i] + b"\r\n\r\n"))
    got = warc.read_archives(spark, f"file://{tmp_path}", payload=True).coalesce(1).collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in got} == dict(enumerate(payloads))


def test_a_payload_that_most_pages_share(spark):
    rows = [(i, "u", "hot" * 500 if i % 3 else f"{i % 1500:06d}" * 200) for i in range(6000)]
    last = {h: i for i, _, h in rows}
    raw = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    got = warc.resolve(warc.read_archives(spark, warc.dedup_archives(spark, raw)))
    assert sorted((r["page_id"], r["type"], r["refers_to_page"]) for r in got.collect()) == [(i, "response", None) if last[h] == i else (i, "revisit", last[h]) for i, _, h in rows]


def test_archives_without_records(spark):
    raw = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.resolve(warc.read_archives(spark, warc.dedup_archives(spark, raw))).count() == 0


# ---- 7: licenses


def test_license_scan(spark):
    odd = [
        (1, "Licensed under CC-BY 4.0"), (2, "all rights\nreserved; All RIGHTS reserved"), (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this thing"), (4, "GNU General Public Licensed"), (5, None),
        (6, "cc by cc by cc"), (7, "licensed under the apache license"), (8, "Licensed under the Apache License, Version 2.0"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(odd, "doc_id long, text string")).collect()}
    assert {i: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for i, r in got.items()} == {
        1: (1, 2, 2, "cc-by", "cc-by"), 2: (2, 0, 3, "reserved", "reserved"), 3: (0, None, None, "", "mit"), 4: (0, None, None, "", ""), 5: (0, None, None, "", ""), 6: (2, 0, 2, "cc-by", "cc-by"), 7: (0, None, None, "", ""),
        8: (0, None, None, "", "apache-2.0"),
    }
    wrapped = "Permission is hereby granted,\n free of charge, to any\n person obtaining a copy\n of this software"
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted"
    far = " ".join(f"{w} {'x ' * 30}" for w in "this work is in the public domain".split())
    rows = [(1, wrapped), (1, "the text of another row"), (None, bsd), (3, far), (4, "filler " * 5000 + wrapped + " filler" * 20_000)]
    assert listed(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "labels") == sorted([(1, "mit"), (1, ""), (None, "bsd"), (3, ""), (4, "mit")], key=str)
    assert licenses.scan(docs(spark)).count() == docs(spark).count() and licenses.scan(empty(spark)).count() == 0


def test_texts_that_only_sound_like_a_license_have_no_label(spark):
    rows = [
        (1, "The movie was released under the same license by the studio"), (2, "Released under the Apache license"), (3, "Licensed under the Mozilla license, version 2.0"), (4, "Released under the MIT license."),
        (5, "you can redistribute it and/or modify it under the terms of the GNU General Public License"), (6, "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ]
    got = listed(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "labels")
    assert got == [(1, ""), (2, ""), (3, ""), (4, "mit"), (5, "gpl"), (6, "gpl,lgpl")]
    plain = licenses.scan(spark.createDataFrame(rows[:1], "doc_id long, text string"), names={}).first()
    assert plain["labels"] == "mit"  # by the words alone it is one


def test_columns_may_have_the_names_that_operators_use(spark):
    rows = docs(spark).select("doc_id", "text", "lang", F.lit("mine").alias("_text_key"), F.lit("mine").alias("_row"), F.lit("mine").alias("_LANG"), F.lit("mine").alias("gone"))
    own = ["_text_key", "_row", "_LANG", "gone"]
    assert {tuple(r) for r in linededup.dedup_lines(rows).select(*own).collect()} == {("mine",) * 4}
    assert {tuple(r) for r in ngramjoin.one_of_each(rows).select(*own).collect()} == {("mine",) * 4}
    assert {tuple(r) for r in langid.predict(rows, None).select(*own).collect()} == {("mine",) * 4}


def test_texts_without_an_id_are_learnt_from(spark):
    texts = [(None, f"{w} alpha beta gamma {i}", lang) for i in range(600) for w, lang in (("the", "en"), ("der", "de"))]
    net = langid.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"), sample_texts=40)
    assert net is not None and sorted(net.langs) == ["de", "en"]


def test_license_recall_is_that_of_all_blocks(spark):
    import random

    rnd = random.Random(7)
    rows = []
    for i in range(200):
        t = rnd.choice(list(licenses.TEMPLATES)).split()
        for _ in range(rnd.randint(0, 5)):
            rnd.choice([lambda: t.pop(rnd.randrange(len(t))), lambda: t.insert(rnd.randrange(len(t)), "other"), lambda: rnd.shuffle(t)])() if len(t) > 1 else None
        rows.append((i, " ".join(["the", "of", "and"] * rnd.randint(0, 9) + t) + rnd.choice([" the end", "", "\nlicense"])))
    want = {}
    for i, x in rows:
        w, found = x.lower().split(), {}
        for text, label in licenses.TEMPLATES.items():
            terms, length = set(text.split()), len(text.split()) + len(text.split()) // 4
            most = max((len(terms & set(w[j : j + length])) for j in range(len(w)) if licenses.NAMES[text] in w[j : j + length]), default=0)
            if most >= 0.8 * len(terms) - 1e-9:
                found[label] = max(found.get(label, 0), most / len(terms))
        base = {y for p, y in licenses.PHRASES.items() if f" {p} " in f" {' '.join(w)} "}
        want[i] = (",".join(sorted(base | set(found))), 1.0 if base else max(found.values(), default=0.0))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len({x for x, _ in want.values()}) > 5


# ---- 8: quality


def stats(x):
    w = words(x)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [y for y in (x or "").split("\n") if words(y)]
    return len(w), sum(map(len, w)), sum((x or "").count(k) for k in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for df in (docs(spark), table(spark)):
        got = quality.text_statistics(df, ("doc_id", "text")).collect()
        for r in got:
            assert tuple(r[c] for c in cols) == stats(r["text"])
    assert quality.judge(docs(spark)).count() == docs(spark).count() and quality.judge(empty(spark)).count() == 0


def test_outliers_are_those_of_a_robust_estimate(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    good = rng.multivariate_normal([5, 1.7, 0.1, 0.1, 0.1], np.diag([1, 0.04, 0.01, 0.09, 0.09]), 400)
    bad = rng.multivariate_normal([5, 1.7, 0.9, 2.5, 2.5], np.eye(5) * 0.01, 60)
    rows = [("g", i, *map(float, v)) for i, v in enumerate(np.vstack([good, bad]))] + [("small", 900 + i, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "gkey string, id int, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {r["id"]: r["distance"] for r in quality.outliers(df, list(quality.FLOORS)).collect()}
    assert set(got) == set(range(460))
    assert all(got[i] > quality.CUTOFF for i in range(400, 460)) and sum(got[i] > quality.CUTOFF for i in range(400)) <= 4


def test_a_third_of_bad_copies_does_not_mask_itself(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    good = rng.multivariate_normal([5, 1.7, 0.1, 0.1, 0.1], np.diag([1, 0.04, 0.01, 0.01, 0.01]), 400)
    bad = rng.multivariate_normal([7, 1.0, 0.9, 2.5, 2.5], np.eye(5) * 1e-4, 200)
    rows = [("g", i, *map(float, v)) for i, v in enumerate(np.vstack([good, bad]))]
    df = spark.createDataFrame(rows, "gkey string, id int, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {r["id"]: r["distance"] for r in quality.outliers(df, list(quality.FLOORS)).collect()}
    assert all(got[i] > quality.CUTOFF for i in range(400, 600)) and sum(got[i] > quality.CUTOFF for i in range(400)) <= 4


def test_repeats_alone_can_reject(spark):
    import random

    rnd = random.Random(6)
    make = lambda n: " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(n))
    rows = [(i, "\n".join(make(12) for _ in range(rnd.randint(4, 12)))) for i in range(200)]
    rows.append((500, "\n".join([make(6)] * 10)))  # nothing but one line again and again, in windows too short for the base rule
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    rows = quality.text_statistics(df).withColumn("base_failed", F.lit(False))
    rows = quality.with_groups(rows).select("*", *[c.alias(x) for x, c in quality.vector().items()])
    rows = written(rows.withColumn("x4", F.when(F.col("doc_id") == 500, F.lit(0.0)).otherwise(F.col("x4"))), "rows")
    far = {r["doc_id"]: r["distance"] for r in quality.outliers(rows, list(quality.FLOORS)).collect()}
    assert far[500] > quality.CUTOFF and sum(x > quality.CUTOFF for x in far.values()) <= 4


def plain_estimate(x, floors, starts=300):
    """Centre and covariance of least determinant by plain concentration from many random starts, then from all rows near it."""
    import numpy as np

    rng, d = np.random.default_rng(5), x.shape[1]

    def fit(rows, factor):
        m = rows.mean(axis=0)
        return m, ((rows - m).T @ (rows - m) / len(rows)) * factor + np.diag(floors) ** 2

    far = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    best = None
    for k in range(starts):
        m, s = fit(x[rng.choice(len(x), (d + 1, 12)[k % 2], replace=False)], 1.0)
        before = None
        while True:
            near = np.sort(np.argsort(far(m, s), kind="stable")[: -(-len(x) // 2)])
            if before is not None and np.array_equal(near, before):
                break
            m, s = fit(x[near], quality.CONSISTENT)
            before = near
        det = np.linalg.slogdet(s)[1]
        if best is None or det < best[0]:
            best = det, m, s
    return far(*fit(x[far(*best[1:]) <= quality.NEAR], quality.NEAR_CONSISTENT))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_kept_is_that_of_a_plain_estimate(spark, size):
    """Every verdict equals that of many plain starts, on groups made here; the smallest table is one group."""
    import numpy as np

    names, rows_of = list(quality.FLOORS), spark.read.parquet(f"{SMALL.replace('sf0.001', size)}/documents.parquet")
    got = {r["doc_id"]: r for r in quality.judge(rows_of).collect()}
    judged = {i: r for i, r in got.items() if not r["base_failed"]}
    where = {r["doc_id"]: (r["lang"], r["source"]) for r in rows_of.select("doc_id", "lang", "source").collect()}
    sizes = collections.Counter(where[i] for i in judged)
    first = {i: where[i] if sizes[where[i]] >= quality.LEAST_GROUP else (where[i][0], "*") for i in judged}
    sizes = collections.Counter(first.values())
    group = {i: k if sizes[k] >= quality.LEAST_GROUP else "*" for i, k in first.items()}
    share = lambda a, b: (a / max(b, 1)) ** 0.5
    texts_of = {r["doc_id"]: r["text"] for r in rows_of.collect()}
    seen = 0
    for key in set(group.values()):
        ids = sorted(i for i in group if group[i] == key)
        if len(ids) < quality.LEAST_GROUP:
            assert all(got[i]["kept"] for i in ids)
            continue
        rows = []
        for i in ids:
            n, chars, symbols, dup, repeat = stats(texts_of[i])
            lines = sum(1 for y in (texts_of[i] or "").split("\n") if words(y))
            rows.append([np.log(max(n, 1)), np.log(max(chars, 1) / max(n, 1)), share(symbols, chars), share(dup, lines), share(repeat, n)])
        far = plain_estimate(np.array(rows), [quality.FLOORS[x] for x in names])
        for i, want in zip(ids, far, strict=True):
            assert got[i]["kept"] == (want <= quality.CUTOFF) and got[i]["distance"] == pytest.approx(want, rel=1e-3, abs=1e-3), (key, i)
            seen += want > quality.CUTOFF
    assert seen > 5 and all(not got[i]["kept"] for i in set(got) - set(judged))


# ---- 9: languages


def test_language_held_out(spark):
    got = registry.op9_language(spark, SMALL).join(table(spark).select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    net = langid.fit(table(spark).select("doc_id", "text", "lang"))
    odd = langid.predict(docs(spark), net).select("text", "lang_pred", "score").collect()
    assert len(odd) == docs(spark).count()
    for r in odd:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert langid.fit(empty(spark)) is None and langid.predict(empty(spark), None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs(spark), None).collect()} == {"und"}
    same_text = langid.predict(table(spark).limit(20).withColumn("lang", F.lit("zz")), net).select("doc_id", "lang_pred")
    assert listed(same_text, "doc_id", "lang_pred") == listed(langid.predict(table(spark).limit(20), net), "doc_id", "lang_pred")


# ---- 10: mixing


def test_mix(spark):
    for df in (table(spark), docs(spark)):
        got = mixing.fair_mix(df).toPandas()
        assert len(got) == df.count() and (got.taken <= 2 * got["size"]).all()
        total = got["size"].sum()
        assert got.taken.sum() <= int(1.5 * total) and got.taken.sum() >= int(1.5 * total) - got["size"].max()
        for _, g in got.groupby("skey"):
            assert abs(g.taken.sum() - g.target.iloc[0]) <= 2 * got["size"].max() and g.target.iloc[0] <= 2 * g.source_size.iloc[0] + 1e-6
        assert got.groupby("skey").target.first().sum() == pytest.approx(int(1.5 * total))
        again = mixing.fair_mix(df.repartition(5)).toPandas()
        cols = ["doc_id", "skey", "size", "taken"]
        assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, again[cols].itertuples(index=False, name=None)))
    assert mixing.fair_mix(empty(spark)).count() == 0
