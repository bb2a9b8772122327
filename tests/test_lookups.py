"""Lookups on rows of our own."""

from pyspark.sql import functions as F

from quarrymill.operators import lookups


def test_facts_for_a_table_of_requests(spark):
    facts = [("days", ["residency"], None), ("ex25", ["deductions", "rates"], 2025), ("ex26", ["deductions"], 2026), ("bare", None, 2025), ("twice", ["rates", "rates"], None)]
    asked = [(1, ["days", "ex25", "days", "none"], None, 2026), (2, [], "rates", None), (3, None, "deductions", 2026), (4, None, "", 2025), (5, None, None, 0), (6, ["bare"], "rates", None), (7, [None], None, None), (None, ["bare"], None, None)]
    got = lookups.find_facts(spark.createDataFrame(facts, "id string, topics array<string>, year int"), spark.createDataFrame(asked, "q int, ids array<string>, topic string, year int"))
    want = set()
    for q, ids, topic, year in asked:
        for i, topics, y in facts:
            if (not ids or i in ids) and (not topic or topic in (topics or [])) and (not year or y is None or y == year):
                want.add((q, i))
    assert sorted(((r["q"], r["id"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_calendar_labels(spark):
    items = [("a", 1, "2026-05-01", "2026-05-31"), ("a", 2, "2026-05-10", None), ("a", 3, "2026-04-01", None), ("b", 1, "2026-05-10", None), ("b", 2, "2026-05-10", "2026-05-12"), ("c", 1, "2026-05-11", None), ("d", 1, "2026-07-08", None), ("e", 1, "2026-07-09", None), ("f", 1, "2026-01-01", None), ("g", 1, None, None), (None, 1, "2026-05-20", None)]
    rows = spark.createDataFrame(items, "c string, pos int, date string, end string").withColumn("date", F.to_date("date")).withColumn("end", F.to_date("end"))
    got = {(r["c"], r["pos"]): (r["label"], r["days"], r["when_label"]) for r in lookups.calendar(rows, F.lit("2026-05-10").cast("date"), ["c"]).collect()}
    other = ("upcoming", None, None)
    assert got == {
        ("a", 1): ("next", -9, "Happening now"), ("a", 2): other, ("a", 3): ("past", None, None), ("b", 1): ("next", 0, "Today"), ("b", 2): other, ("c", 1): ("next", 1, "Tomorrow"), ("d", 1): ("next", 59, "In 59 days"),
        ("e", 1): ("next", 60, "9 Jul 2026"), ("f", 1): ("past", None, None), ("g", 1): other, (None, 1): other,
    }


def test_latest_of_a_tag(spark):
    rows = [("a", ["topic:tax", "topic:tax"], "2026-01-02", "expired"), ("b", ["topic:tax"], "2026-01-02", "expired"), ("c", ["topic:tax"], None, "expired"), ("d", ["topic:tax"], None, "ongoing"), ("e", ["topic:tax"], "2027", "upcoming"), ("f", ["x"], "2026", "upcoming"), ("g", None, "2026", "upcoming"), ("h", ["topic:tax"], "2028", "cancelled")]
    got = lookups.of_tag(spark.createDataFrame(rows, "uid string, tags array<string>, starts_at string, status string"), spark.createDataFrame([("topic:tax",), ("topic:tax",), ("none",)], "tag string"))
    assert sorted((r["part"], r["uid"]) for r in got.collect()) == [("last", "a"), ("open", "d"), ("open", "e")]


def test_key_figures(spark):
    facts = spark.createDataFrame([(i, i.upper()) for i in ("nr_salary_rate", "exemption_2025", "exemption_2026", "residency_days", "other")], "id string, display string")
    got = lookups.key_figures(facts, spark.createDataFrame([(2025,), (2026,), (2027,), (2025,)], "year int"))
    want = [(2025, 1, "residency_days"), (2025, 2, "exemption_2025"), (2025, 3, "nr_salary_rate"), (2026, 1, "residency_days"), (2026, 2, "exemption_2026"), (2026, 3, "nr_salary_rate"), (2027, 1, "residency_days"), (2027, 2, "nr_salary_rate")]
    assert sorted((r["year"], r["place"], r["id"]) for r in got.collect()) == want


def test_reading_minutes_round_half_to_even(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [("none", None), ("short", [("h", [[text(9)]], None)]), ("half", [(None, [[text(500)], [text(49), None], None], {"k": 1})]), ("odd", [("a b　c", [[text(767)]], None)])]
    guides = spark.createDataFrame(rows, "slug string, sections array<struct<heading:string,parts:array<array<string>>,n:struct<k:int>>>")
    assert {r["slug"]: (r["words"], r["minutes"]) for r in lookups.reading_minutes(guides).collect()} == {"none": (0, 2), "short": (10, 2), "half": (549, 2), "odd": (770, 4)}  # 770 / 220 = 3.5


def test_resolved_share(spark):
    rows = spark.createDataFrame([("a", "x", 85), ("a", None, 14), ("a", None, 1), ("b", None, 3), ("c", "x", 0), ("d", "x", None), ("e", "x", 2), ("e", None, 1)], "k string, district string, n int")
    got = {r["k"]: (r["total"], r["resolved"], r["percent"]) for r in lookups.resolved_share(rows, F.col("district").isNotNull(), F.col("n"), ["k"]).collect()}
    assert got == {"a": (100, 85, 85), "b": (3, 0, 0), "c": (0, 0, None), "d": (0, 0, None), "e": (3, 2, 66)}
    assert lookups.resolved_share(rows.filter("false"), F.lit(True), F.col("n")).collect() == [(0, 0, None)]


def test_keywords_in_order_and_what_they_find(spark):
    union = lookups.keyword_union(spark.createDataFrame([(2, ["b", "a"]), (1, ["c", "b", "", None]), (3, None)], "pos int, keywords array<string>"))
    assert sorted((r["pos"], r["keyword"]) for r in union.collect()) == [(0, "c"), (1, "b"), (2, "a")]
    ids = lambda a, b: " ".join(f"/event/{i:07d}" for i in range(a, b))
    pages = [(0, "c", 1, ids(0, 20) + ids(0, 20)), (0, "c", 2, ids(10, 40)), (1, "b", 1, ids(24, 26)), (2, "a", 1, None)]
    got = lookups.discovered(spark.createDataFrame(pages, "pos int, keyword string, page int, html string"), r"/event/(\d+)")
    want = {f"{i:07d}": ["c"] for i in range(25)} | {"0000024": ["c", "b"], "0000025": ["b"]}
    assert {r["id"]: r["keywords"] for r in got.collect()} == want


def test_ids_of_pages_are_cut_at_the_last_page_that_counts_and_hashed(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = []
    for pos in range(12):  # pages of 0 to 40 ids; a few keywords have no page of 25, and some pages a number twice or none
        for page in [*range(rng.randrange(30)), 3, (1 << 63) - 1, -(1 << 63), None]:
            rows.append((pos, f"k{pos}", page, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(50 if pos % 3 else 12)))))
    rng.shuffle(rows)
    want = {}
    for pos in range(12):
        first = {}
        for _, _, page, html in (r for r in rows if r[0] == pos):
            for at, x in enumerate(html.split()):
                place = (page is not None, page or 0, at)
                first[x] = min(first.get(x, place), place)
        ranked = sorted(first, key=first.get)
        want[pos] = [first[x] for x in ranked[:25]], first
    df = spark.createDataFrame(rows, "pos int, keyword string, page long, html string").repartition(7)
    for few in (20_000, 0):  # with and without the cut
        monkeypatch.setattr(lookups, "FEW", few, raising=False)
        out = lookups.discovered(df, r"(w\d+)")
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert not [x for x in plan.splitlines() if "SortAggregate" in x and "min(" in x], "every found id would be sorted"
        got = {}
        for r in out.collect():
            for k in r["keywords"]:
                got.setdefault(int(k[1:]), []).append(r["id"])
        for pos, (places, first) in want.items():
            assert sorted(first[x] for x in got.get(pos, [])) == places


def test_lookups_of_nothing(spark):
    assert lookups.find_facts(spark.createDataFrame([], "id string, topics array<string>, year int"), spark.createDataFrame([], "q int, ids array<string>, topic string, year int")).count() == 0
    assert lookups.discovered(spark.createDataFrame([], "pos int, keyword string, page int, html string"), "(x)").count() == 0
