"""The pipeline stage by stage against plain versions on its own inputs."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from quarrymill.llm.common import written

from ..conftest import SMALL
from .odd import docs as odd_docs
from .odd import empty
from .test_operators import deduped, similar, tiktokens, words


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SMALL), "stage")
        out[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
    text = lambda n: {r["doc_id"]: r["text"] for r in out[n].collect()}
    known = text("language ID")
    assert all(any(c.isalpha() for c in x) for x in known.values()) and len(known) > 0.97 * len(before)
    lines = deduped(sorted(known.items()))
    assert text("line dedup") == {i: x for i, x in lines.items() if x == known[i] or words(x)}
    kept = text("n-gram Jaccard join")
    assert set(kept) == {c for _, _, c, _ in similar(sorted(text("line dedup").items()))}
    mixed = [r["doc_id"] for r in out["mixing"].collect()]
    assert set(mixed) <= set(kept) and max(map(mixed.count, set(mixed))) <= 2
    _, enc = tiktokens()
    coded = out["byte-level BPE"].collect()
    assert len(coded) == len(mixed)
    for r in coded:
        assert r["round_trip"] and r["ids"] == enc.encode_ordinary(kept[r["doc_id"]])


def test_stages_on_odd_rows_and_on_none(spark):
    import collections

    rows = odd_docs(spark)
    count = lambda df: collections.Counter(tuple(r) for r in df.select("doc_id", "text").collect())
    have = count(rows)
    for name, stage in P.STAGES:
        nothing = stage(spark, empty(spark), SMALL)
        assert nothing.count() == 0
        got = stage(spark, rows, SMALL)
        if name == P.STAGES[-1][0]:
            assert got.count() == rows.count() and got.filter("not round_trip").count() == 0
            continue
        assert got.columns == nothing.columns == P.COLUMNS
        left = count(got)
        if name == "language ID":
            assert not left - have and all(x and any(c.isalpha() for c in x) for _, x in left)
        if name == "line dedup":
            assert sum(left.values()) == sum(n for (_, x), n in have.items() if not words(x)) + sum(n for (_, x), n in left.items() if words(x))
            assert left[None, None] == 1 and left[None, "a null id here"] == 1
        if name == "n-gram Jaccard join":
            assert not left - have and left[None, None] == 1 and left[0, None] == 1 and left[None, "a null id here"] == 1
            assert sum(n for (_, x), n in left.items() if x and x.startswith("a b c d e")) == 1


def test_run(spark):
    rows = P.run(spark, SMALL)
    assert rows.count() > 0 and rows.filter("not round_trip").count() == 0


def test_mixing_keeps_null_and_repeated_ids_apart(spark):
    import collections

    from quarrymill.llm import mixing

    text = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(None, text(900, 30), "en", "b", 7), (None, text(901, 20), None, None, 7), (None, text(901, 20), None, None, 7)]
    rows += [(k % 8, text(k, 5 + k), "en", "abc"[k % 3], 7) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter(tuple(r) for r in P.mix(spark, docs, SMALL).collect())
    want = collections.Counter()
    for r in mixing.fair_mix(docs.withColumn("whole", F.struct(*P.COLUMNS)), more=("whole",)).collect():
        want[tuple(r["whole"])] += r["passes"]
    assert got == +want and any(r[0] is None for r in got)
    assert sum(len(r[1].split()) * n for r, n in got.items()) <= int(1.5 * sum(len(r[1].split()) for r in rows))
