"""Periodic runs, packing and whitening on odd rows, made rows and the smallest tables, against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrymill.llm import packing, registry, runs, whitening

from ..conftest import SMALL
from .odd import docs, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, name="documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


# ---- 11: periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= 3 * q and j - i + q >= 6 and not any(w[i : i + q] == w[i : i + p] * (q // p) for p in range(1, q) if q % p == 0):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbers(words):
    known = {}
    return np.array([known.setdefault(x, len(known)) for x in words], np.int64)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(250):
        letters = rnd.choice([1, 2, 3, 20])
        w = []
        while len(w) < rnd.choice([0, 3, 7, 30, 200, 400]):
            unit = [rnd.randrange(letters) for _ in range(rnd.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 33]))]
            if rnd.random() < 0.4:
                unit = (unit[: len(unit) // 2 + 1] * rnd.randint(1, 9) + unit) * 1
            w += (unit * rnd.randint(1, 6))[: rnd.randint(1, 300)]
            w += [rnd.randrange(letters) for _ in range(rnd.choice([0, 0, 1, 2, 5]))]
        assert runs.find_runs(np.array(w, np.int64)) == brute_runs(w), w


def test_runs_of_fibonacci_words_and_of_long_periods():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert runs.find_runs(np.array(b)) == brute_runs(b)
    a, b = [0, 0, 0, 1], [0, 0, 0, 0, 1]
    while len(b) < 3000:
        a, b = b, b * 4 + a
    assert runs.find_runs(np.array(b)) == brute_runs(b)
    rnd = random.Random(3)
    unit = [rnd.randrange(50) for _ in range(7001)]
    w = [-1, *(unit * 5)[:30_000], -2]
    assert runs.find_runs(np.array(w)) == [(1, 30_000, 7001)]
    assert runs.find_runs(np.array([-1, *(unit * 4)[: 4 * 7001 - 1], -2])) == []


def want_digest(doc_id, text):
    words = runs.with_tandem(text, doc_id)
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (
        doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()),
        sha(b" ".join(x for i, x in enumerate(words) if i not in gone)),
    )


def test_tandem_ends_follow_the_rule():
    words = [b"w%d" % i for i in range(1000)]
    changed = 0
    for doc_id in range(300):
        h = zlib.crc32(str(doc_id).encode())
        got = runs.with_tandem(b" ".join(words).decode(), doc_id)
        if h % 10:
            assert got == words
            continue
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        changed += 1
    assert changed > 10
    assert runs.with_tandem(None, 3) == [] and runs.with_tandem("a", None) == [b"a"]


def test_run_digests(spark):
    rows = table(spark).select("doc_id", "text").unionByName(docs(spark).select("doc_id", "text").filter("length(text) < 40000 or text is null"))
    got = [tuple(r) for r in runs.digest(runs.mark_runs(rows, words=runs.with_tandem)).collect()]
    want = [want_digest(r["doc_id"], r["text"]) for r in rows.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] for r in got) > 5
    assert got and registry.op11_periodic_runs(spark, SMALL).count() == 200


def test_runs_keep_other_columns_and_collapse(spark):
    got = runs.mark_runs(docs(spark), more=("key", "doc_id")).collect()
    assert len(got) == docs(spark).count() and {r["key"] for r in got} == {"k"}
    row = next(r for r in got if len(r["runs"]) == 1 and r["collapsed"] == "l")
    assert tuple(row["runs"][0]) == (0, 120, 1)
    assert runs.mark_runs(empty(spark)).count() == 0 and runs.digest(runs.mark_runs(empty(spark))).count() == 0


# ---- 12: packing


def check_pieces(got, texts, length):
    """Every id in one piece, sequences gapless and full but for the last; ids those of the tokenizer's own library."""
    own = Tokenizer.from_file(PATH)
    seen = {}
    for r in got:
        seen.setdefault(r["row"], []).append(r)
    assert set(seen) == set(texts)
    for row, parts in seen.items():
        ids = np.array([*own.encode(texts[row] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(filled) == list(range(len(filled)))
    assert all(n == length for k, n in filled.items() if k < len(filled) - 1) and all(n <= length for n in filled.values())


@pytest.mark.parametrize("length", [1, 7, 2048])
def test_pieces(spark, length):
    odd = docs(spark).filter("length(text) < 5000 or text is null" if length < 9 else "true").withColumn("row", F.monotonically_increasing_id())
    more = [(900, "a <|endoftext|> b"), (901, "'s  'LL x　 y\x1c z  "), (902, "".join(random.Random(5).choice("abcdefg") for _ in range(3000)))]
    odd = odd.select("row", "text").unionByName(spark.createDataFrame(more, "row long, text string")).repartition(5)
    odd = spark.createDataFrame(odd.collect(), "row long, text string").repartition(4)
    texts = {r["row"]: r["text"] for r in odd.collect()}
    stream = packing.pack(odd, PATH, more=("row",))
    check_pieces(packing.pieces(stream, ("row",), length).collect(), texts, length)
    if length > 1:
        ids = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(stream, length).collect()}
        want = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(stream.collect(), key=lambda r: r["at"])])
        assert sorted(ids) == list(range(-(-len(want) // length)))
        assert (np.concatenate([ids[k] for k in sorted(ids)]) == want).all()
        assert all(len(ids[k]) == length for k in ids if k < len(ids) - 1)


def test_pieces_of_a_table(spark):
    rows = table(spark)
    got = registry.op12_packing(spark, SMALL).withColumnRenamed("doc_id", "row").collect()
    check_pieces(got, {r["doc_id"]: r["text"] for r in rows.collect()}, 2048)


def test_packing_nothing(spark):
    stream = packing.pack(empty(spark), PATH)
    assert packing.pieces(stream).count() == 0 and packing.sequences(stream).count() == 0
    one = packing.pack(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH)
    assert [tuple(r) for r in packing.pieces(one).collect()] == [(1, 0, 1, zlib.crc32(b"\1\0\0\0"), 1, 0, 0)]


def test_offsets_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3)
    rows = spark.range(500).select("id", F.expr("repeat('word ', cast(id % 7 as int))").alias("text")).repartition(40)
    for most in (0, 100):
        monkeypatch.setattr(packing, "MOST_BROADCAST", most)
        got = sorted((r["at"], r["doc_tokens"]) for r in packing.pack(rows, PATH, more=("id",)).collect())
        at = 0
        for start, n in got:
            assert start == at
            at += n


# ---- 13: whitening


def whitened_by_eigh(rows, k=4):
    x = np.array([[int(np.floor(float(c) * 256)) for c in v] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T, bias=True).reshape(x.shape[1], -1)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, [int(y) for y in ((n * x - s) ** 2).sum(1)], (x - s / n) @ u / np.sqrt(e), e / np.trace(v)


def check_whitening(got, rows, k=4):
    n, deviation, whitened, explained = whitened_by_eigh(rows, k)
    at = {}
    for r in got:
        at.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(at) == list(range(1, k + 1))
    for c, own in at.items():
        assert sorted(own) == sorted(i for i, _ in rows)
        found = np.array([own[i]["whitened"] for i, _ in rows])
        sign = np.sign(found @ whitened[:, c - 1])
        assert np.abs(found * sign - whitened[:, c - 1]).max() < 1e-7
        for (i, _), y in zip(rows, deviation, strict=True):
            r = own[i]
            assert (r["n"], r["deviation"]) == (n, y) and r["explained"] == pytest.approx(explained[c - 1], rel=1e-9) and 0 <= r["identity_error"] < 1e-9


def test_whitening_of_a_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, "embeddings").collect()]
    check_whitening(registry.op13_whitening(spark, SMALL).collect(), rows)


def test_whitening_of_odd_rows(spark):
    rnd = np.random.default_rng(2)
    good = [(i, (rnd.standard_normal(6) * [9, 5, 1, 0.5, 0.2, 0.1] + 1000).tolist()) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(40)]
    bad = [(200, None), (201, [None] + [1.0] * 5), (202, [float("nan")] * 6), (203, [1.0] * 5 + [float("-inf")]), (204, []), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 0.5) for i, v in good + bad], "vec_id long, embedding array<double>, x string, whitened double").repartition(5)
    check_whitening(whitening.whiten(df).collect(), good)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 3.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(huge).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: None, 2: None, 3: 2561**2 + 1280**2}


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = [(i, [float(i), 2.0 * i, 3.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


@pytest.mark.parametrize("seed", range(8))
def test_spectrum_slicing(seed):
    rnd = np.random.default_rng(seed)
    d = int(rnd.integers(1, 30))
    e = np.sort(rnd.choice([rnd.random(d) * 10, np.ones(d), np.array([5.0, 5.0, 5.0, 1.0] * 8)[:d], 10.0 ** -np.arange(d), np.r_[3.0, 3.0 * (1 - 1e-9), np.ones(d)][:d]]))[::-1]
    q, _ = np.linalg.qr(rnd.standard_normal((d, d)))
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    for s in (0.5, 2.0, float(e.mean()) + 1e-3, 4.9):
        if np.abs(e - s).min() > 1e-9:
            assert whitening.above(v, s) == (e > s).sum()
    values, vectors = whitening.leading(v)
    assert np.allclose(values, e[: len(values)], atol=1e-12 * e[0], rtol=0)
    assert len(values) == min(4, (e > 1e-12 * e[0]).sum(), d)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * e[0] * d


def test_inertia_of_indefinite_matrices():
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.above(np.zeros((3, 3)), 0.0) == 0
    rnd = np.random.default_rng(1)
    for _ in range(30):
        a = rnd.integers(-1, 2, (9, 9)).astype(float)
        a += a.T
        assert whitening.above(a, 0.37) == (np.linalg.eigvalsh(a) > 0.37).sum()
