"""Queries that show a part of their rows: all rows and whole texts go through their operators."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quarrymill.plans import document_queries as DQ
from quarrymill.plans import feed_queries as FQ
from quarrymill.plans import text_queries as TQ
from quarrymill.plans.adapters import read

from .compare import same
from .conftest import SMALL


@pytest.mark.parametrize("name, part, made, key", [
    ("s6_parquet_export", " WHERE k % 2 = 0", lambda s: FQ.exported(s, SMALL).select("uid", *FQ.BASIC), None),
    ("s3_p16_csv_sessions", " WHERE o_orderkey % 8 < 4", lambda s: FQ.sessions(s, SMALL).drop("k"), None),
])
def test_all_rows(spark, duck, name, part, made, key):
    assert part in FQ.R.sql[name]
    same(made(spark).toPandas(), duck.execute(FQ.R.sql[name].replace(part, "")).df())


def test_all_trendy_rows(spark, duck):
    got = FQ.trendy(spark, SMALL)
    sql = FQ.R.sql["p18_trendy_api"]
    want = duck.execute(sql.replace(" WHERE k % 3 < 2", "")).df()
    same(got.drop("type").toPandas(), want.drop(columns="type"))  # what no category tells is classified by words
    assert got.filter("tags = 'cat:x'").count() == got.filter("cast(source_id as long) % 3 = 2").count() > 0


def row_by_row(body, names):
    parts = re.split(r"(?=\{\{fact:)", body)
    out = []
    for p in parts:
        m = re.match(r"\{\{fact:([a-z0-9_]+)\}\}", p)
        out.append((names.get(m[1], "—") + p[m.end() :]) if m else "—" + p if p.startswith("{{fact:") else p)
    x = "".join(out)
    space = "[\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"  # white space of Unicode
    ascii_space = r"[ \t\n\x0b\f\r]"
    for pattern, to in (
        (r"\[\[guide:[a-z0-9-]+\|([^\]]*)\]\]", r"\1"), (r"\[\[guide:([a-z0-9-]+)\]\]", r"\1"), (r"\*\*([^*]+)\*\*", r"\1"),
        (rf"\[([^\]]+)\]\((?:(?!{ascii_space})[^)])+\)", r"\1"), (r"`([^`]+)`", r"\1"), (f"{space}+", " "),
    ):
        x = re.sub(pattern, to, x)
    return x.strip(" ")


MARKED = [
    "**b** and `c` then [a link](https://x.example.org/y) " + "w " * 60 + "far **bold** `code` [late](z) [[guide:g1]] [[guide:g2|named]] {{fact:f0}} {{fact:f9}}",
    "* star ` tick [ open", "[no link] (x) [x](y z)", "x" * 59 + "**b**", "", None, "a\n\n\tb  c",
]


def test_guides_hold_whole_texts_and_markup(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    read(spark, SMALL, "nation").write.parquet(f"{path}/nation.parquet")
    for sf in (path, SMALL):
        names = {r["id"]: r["display"] for r in DQ.fact_table(spark, sf).collect()}
        texts = {r["doc_id"]: r["text"] or "" for r in read(spark, sf, "documents").collect()}
        body = {i: f"Days: {{{{fact:f{i % 5}}}}}, see [[guide:g{i % 4}|the guide]] and **bold** {x}" for i, x in texts.items()}
        want = {i: (f"g{i // 7}", row_by_row(b, names)) for i, b in body.items()}
        got = {r["section"]: (r["slug"], r["plain"]) for r in DQ.g1_whole(spark, sf).collect()}
        assert got == want
        guides = {}
        for i in sorted(want):
            guides.setdefault(want[i][0], []).append(i)
        whole = {g: (hashlib.md5("\n".join(want[i][1] for i in at).encode()).hexdigest(), ",".join(sorted({f for i in at for f in re.findall(r"\{\{fact:([a-z0-9_]+)\}\}", body[i])}))) for g, at in guides.items()}
        assert {r["slug"]: (r["text_md5"], r["figures"]) for r in DQ.g4_whole(spark, sf).collect()} == whole


def test_dates_and_articles_take_whole_texts(spark, tmp_path):
    path = str(tmp_path)
    rows = [(3, "x " * 40 + "Last updated: 2022-02-03"), (7, "no date " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    assert {r["doc_id"]: r["updated"] for r in TQ.p25(spark, path).collect()} == {3: "2022-02-03", 7: None}
    seen = []
    was = FQ.feeds.article_texts
    FQ.feeds.article_texts = lambda d: seen.append(d) or was(d)
    try:
        assert FQ.p28(spark, path).count() == 2
    finally:
        FQ.feeds.article_texts = was
    read_back = seen[0].select("doc_id", F.get_json_object("payload", "$.contents.en").alias("en")).collect()
    assert {r["doc_id"]: r["en"] for r in read_back} == {i: f"<p>{x}</p>" for i, x in rows}
