"""Joins with hot keys, trees of any depth and rules by the thousand, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import documents as D
from quarrymill.operators import joins as J
from quarrymill.operators import listings as L
from quarrymill.operators import windows as W
from quarrymill.sources import feeds

from .test_listings import listing


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skewed_join_is_a_join(spark, how):
    rnd = random.Random(1)
    big = spark.createDataFrame([(i, rnd.choice([1, 1, 1, 2, 3, None, i])) for i in range(3000)], "n int, k int")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 2000)] + [(1, "again")], "k int, v string")
    plain = sorted(map(str, big.join(small, "k", how).select("n", "k", "v").collect()))
    assert sorted(map(str, J.skewed_join(big, small, "k", how).select("n", "k", "v").collect())) == plain
    assert sorted(map(str, J.beside(big, small, ["k"], how).select("n", "k", "v").collect())) == plain
    assert J.skewed_join(big.limit(0), small, "k", how).count() == 0


def test_first_of_each(spark):
    rnd = random.Random(2)
    rows = [(f"u{i}", rnd.choice("aaab"), rnd.randrange(50)) for i in range(2000)]
    got = J.first_of_each(spark.createDataFrame(rows, "uid string, k string, v int"), ["k"], [F.col("v"), F.col("uid")], 7).collect()
    want = [r for k in "ab" for r in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))[:7]]
    assert sorted(map(tuple, got)) == sorted(want)


def plain_roots(parents):
    out = {}
    for i in parents:
        at, seen = i, set()
        while at in parents and parents[at] is not None and at not in seen:
            seen.add(at)
            at = parents[at]
        out[i] = at if at in parents and parents[at] is None else None
    return out


def trees():
    chain = {i: i - 1 if i else None for i in range(1001)}
    forest, rnd = {}, random.Random(4)
    for i in range(3000):
        forest[i] = None if i < 5 else rnd.choice([0, 0, rnd.randrange(i), 10**6 + 1]) if i % 50 else rnd.randrange(3000)
    cycles = {0: None, 1: 0, 2: 3, 3: 4, 4: 2, 5: 4, 6: 6, 7: 99, 8: 7}
    return {"chain": chain, "forest": forest, "cycles": cycles, "nothing": {}}


@pytest.mark.parametrize("name", ["chain", "forest", "cycles", "nothing"])
def test_roots_at_any_depth(spark, name):
    parents = trees()[name]
    index = spark.createDataFrame([(i, p, "index" if i % 3 == 0 else "ok" if i % 3 == 1 else "error") for i, p in parents.items()], "id long, parent long, status string")
    want = plain_roots(parents)
    found = D.roots_of(index).collect()
    assert {r["id"]: r["root"] for r in found} == want and len(found) == len(parents)
    got = {r["root"]: (r["pages"], r["ok_pages"]) for r in D.descendants(index).collect()}
    count = lambda root, kinds: sum(r == root and i != root and i % 3 in kinds for i, r in want.items())
    assert got == {i: (count(i, (1, 2)), count(i, (1,))) for i, p in parents.items() if p is None}


def test_many_rules_and_a_hot_host(spark):
    rnd = random.Random(5)
    words = ["a", "bb", "c1", "%7E", "x.html", "q?page=2", "é"]
    make = lambda n: "/" + "/".join(rnd.choice(words) for _ in range(n))
    rules = {}
    for i in range(4000):
        host = rnd.choice(["hot", "hot", f"h{i % 60}"])
        pattern = make(rnd.randint(0, 4)) + rnd.choice(["", "", "$", "*", "*html$", "/*page=", f"{i}"])
        rules.setdefault(host, {})[(rnd.random() < 0.5, pattern)] = None
    rules["all"] = {(False, "*"): None, (True, "/a$"): None}
    urls = [(f"{h}{p}", h, p) for h, p in {(rnd.choice(["hot", "hot", "all", f"h{i % 70}"]), make(rnd.randint(0, 5))) for i in range(1500)}]
    lines = "\n".join
    files = [(h, 200, lines(["User-agent: *", *[f"{'Allow' if a else 'Disallow'}: {p}" for a, p in own]])) for h, own in rules.items()]
    table = D.policy_rules(spark.createDataFrame(files, "host string, status int, body string"))
    own = {}
    for r in table.collect():
        own.setdefault(r["host"], []).append((r["pattern"], r["allow"]))

    def plain(host, path):
        fits = []
        for pattern, allow in own.get(host, []):
            body = ".*".join(map(re.escape, (pattern[:-1] if pattern.endswith("$") else pattern).split("*")))
            if re.match(body + ("$" if pattern.endswith("$") else ""), path, re.S):
                fits.append((len(pattern), allow))
        return max(fits)[1] if fits else True

    got = {r["url"]: r["allowed"] for r in D.allowed(spark.createDataFrame(urls, "url string, host string, path string"), table).collect()}
    assert got == {u: plain(h, p) for u, h, p in urls}
    assert {True, False} == set(got.values())


def test_markup_is_parsed_once_a_block(spark):
    html = '<script type="application/ld+json">{"@type": "ItemList", "itemListElement": [{"item": {"@type": "MusicEvent", "name": "a"}}, {"@type": "Event", "name": "b"}, {"@type": "Place"}, 3, null]}</script><script type="application/ld+json">no</script>'
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None), (4, html.replace("ItemList", "Other", 1))], "id int, html string")
    nodes = feeds.listed_events(feeds.jsonld_blocks(pages))
    got = sorted(map(tuple, nodes.select("id", "pos", F.try_variant_get("node", "$.name", "string")).collect()))
    assert got == [(1, 0, "a"), (1, 1, "b")]
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("(?i)parse_?json", plan)) == 1, plan


def test_phrases_of_a_small_file_are_many_tasks(spark):
    rows = J.spread(spark.range(1000).coalesce(1))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.count() == 1000


def test_listings_of_one_row_group_are_many_tasks(spark):
    from pyspark.sql.functions import spark_partition_id

    from quarrymill.plans import adapters

    one, many = adapters.listings(spark, "/root/testdata/sf0.001"), adapters.listings(spark, "/root/testdata/sf0.001", many=True)
    # a filter on what is made of the rows must not be worked out before they are dealt out
    busy = lambda rows: rows.filter("starts_at is not null").select(spark_partition_id()).distinct().count()
    assert busy(one) == 1 and busy(many) >= spark.sparkContext.defaultParallelism
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_lists_of_similar_listings_are_made_once_a_group(spark, monkeypatch):
    rows = [{"uid": f"u{i:03}", "title": f"t{i % 7}", "type": "music" if i % 2 else "talk", "district": ["大安區", None, ""][i % 3], "starts_at": None if i % 11 == 0 else f"2024-07-{1 + i % 9:02}T10:00:00+08:00", "tags": ["lang:en"] if i % 4 == 0 else [], "status": "upcoming" if i % 5 else "expired"} for i in range(90)]
    df = listing(spark, *rows)
    of = {r["uid"]: r for r in rows}
    want = set()
    best = {}
    for r in W.similar(df, 8).collect():
        best.setdefault(r["uid"], []).append((r["nth"], r["other"]))
    for uid, others in best.items():
        kept, heads = [], set()
        for nth, other in sorted(others):
            head = ((of[other]["starts_at"] or "")[:10], of[other]["title"][:12])
            if head not in heads:
                heads.add(head)
                kept.append((of[other]["starts_at"] or "", nth, other))
        want |= {(uid, other, place) for place, (_, _, other) in enumerate(sorted(kept[:4]))}
    monkeypatch.setattr(W, "similar", lambda *_: pytest.fail("a row for each reader before the lists are made"))
    assert {(r["uid"], r["other"], r["place"]) for r in W.similar_list(df).collect()} == want and want


def test_upsert_meets_the_stored_table_once(spark):
    stored = listing(spark, {"uid": "a"}, {"uid": "b"}).withColumn("content_hash", F.lit("x"))
    batch = listing(spark, {"uid": "b"}, {"uid": "c"}).withColumn("pos", F.lit(1))
    out = L.upsert(stored, batch, "2024-01-01")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert {(r["uid"], r["outcome"]) for r in out.collect()} == {("a", "kept"), ("b", "updated"), ("c", "new")}


def test_listings_table_is_written_small(spark, tmp_path, monkeypatch):
    from quarrymill.plans import feed_queries as Q

    from .conftest import SMALL

    monkeypatch.setattr(Q.tables, "scratch", lambda _, name: str(tmp_path / name))
    got = Q.s1(spark, SMALL)
    data = [f for f in (tmp_path / "listings").iterdir() if f.name.startswith("part-")]
    size = sum(f.stat().st_size for f in data)
    Q.tables.write_listings(Q.listings(spark, SMALL), str(tmp_path / "plain"))
    assert size * 5 < sum(f.stat().st_size for f in (tmp_path / "plain").iterdir() if f.name.startswith("part-"))
    assert sorted(map(str, got.collect())) == sorted(map(str, Q.tables.read_listings(spark, str(tmp_path / "plain")).select(*got.columns).collect()))
