"""Rules of the listings family on rows of our own: unknowns, ties, order, groups."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import normalize as N
from quarrymill.operators import listings as L
from quarrymill.operators import windows as W

COLS = "uid string, title string, title_en string, description string, organizer string, type string, status string, starts_at string, ends_at string, signup_deadline string, venue string, address string, city string, district string, is_free boolean, price_text string, tags array<string>, feedback string, first_seen string, last_seen string, source_platform string"
NAMES = [x.split()[0] for x in COLS.split(", ")]


def listing(spark, *rows):
    base = {"title": "t", "type": "talk", "status": "upcoming", "tags": []}
    return spark.createDataFrame([tuple((base | r).get(c) for c in NAMES) for r in rows], COLS)


def uids(df):
    return [r["uid"] for r in df.select("uid").collect()]


NOW = "2024-06-15T12:00:00+08:00"


def test_unknown_is_not_no(spark):
    rows = listing(spark, {"uid": "a", "is_free": True}, {"uid": "b", "is_free": False}, {"uid": "c"}, {"uid": "d", "city": "臺北市", "feedback": "not_my_thing"}, {"uid": "e", "city": "臺北市"})
    assert uids(L.query(rows, NOW, free_only=True)) == ["a"]
    assert uids(L.query(rows, NOW, city="臺北市")) == ["e"]
    assert sorted(uids(L.query(rows, NOW))) == ["a", "b", "c", "e"]


def test_signup_falls_back_on_the_start(spark):
    rows = listing(
        spark, {"uid": "open", "signup_deadline": "2024-06-20T00:00:00+08:00"}, {"uid": "shut", "signup_deadline": "2024-06-01T00:00:00+08:00", "starts_at": "2024-07-01T00:00:00+08:00"},
        {"uid": "none"}, {"uid": "started", "starts_at": "2024-06-15T11:00:00+08:00"}, {"uid": "now", "starts_at": NOW},
    )
    assert sorted(uids(L.query(rows, NOW, signup_open=True))) == ["none", "now", "open"]


def test_order_puts_upcoming_first_and_nulls_last(spark):
    rows = listing(spark, {"uid": "o", "status": "ongoing", "starts_at": "2020-01-01T00:00:00+08:00"}, {"uid": "z"}, {"uid": "b", "starts_at": "2024-07-01T00:00:00+08:00"}, {"uid": "a", "starts_at": "2024-07-01T00:00:00+08:00"})
    assert uids(L.query(rows, NOW)) == ["a", "b", "z", "o"]
    assert uids(L.query(rows, NOW, limit=2)) == ["a", "b"]


def test_status(spark):
    rows = listing(spark, {"uid": "start only", "starts_at": "2024-06-15T11:59:59+08:00"}, {"uid": "between", "starts_at": "2024-06-01T00:00:00+08:00", "ends_at": "2024-06-30T00:00:00+08:00"}, {"uid": "bad", "starts_at": "soon"}, {"uid": "off", "status": "cancelled", "starts_at": "2020-01-01T00:00:00+08:00"})
    assert {r["uid"]: r["status"] for r in L.refresh_status(rows, NOW).collect()} == {"start only": "expired", "between": "ongoing", "bad": "upcoming", "off": "cancelled"}


def test_upsert_twice_changes_nothing_and_keeps_what_is_ours(spark):
    stored = listing(spark, {"uid": "a", "feedback": "went", "first_seen": "1", "last_seen": "1"}, {"uid": "b", "first_seen": "1", "last_seen": "1"}).withColumn("content_hash", N.content_hash())
    batch = listing(spark, {"uid": "a", "title": "new"}, {"uid": "c"}).withColumn("pos", F.monotonically_increasing_id())
    once = L.upsert(stored, batch, "2")
    assert {r["uid"]: r["outcome"] for r in once.collect()} == {"a": "updated", "b": "kept", "c": "new"}
    a = once.filter("uid = 'a'").first()
    assert (a["feedback"], a["first_seen"], a["last_seen"], a["title"]) == ("went", "1", "2", "new")
    twice = L.upsert(once.drop("outcome"), batch, "3")
    assert {r["uid"]: r["outcome"] for r in twice.collect()} == {"a": "unchanged", "b": "kept", "c": "unchanged"}


@pytest.mark.parametrize(("titles", "want"), [(["x", "y", "y"], "y"), (["old", "old"], "old"), (["y", "old"], "old"), (["x", "x", "y", "x"], "x")])
def test_upsert_with_one_uid_many_times(spark, titles, want):
    stored = listing(spark, {"uid": "a", "title": "old", "first_seen": "1"}).withColumn("content_hash", N.content_hash())
    rows = [{"uid": "a", "title": t, "description": str(i)} for i, t in enumerate(titles)]
    batch = listing(spark, *rows).withColumn("pos", F.col("description").cast("int"))
    out = L.upsert(stored, batch, "2").collect()
    assert [r["title"] for r in out] == [want]
    # the payload is the first of the last run of equal hashes, of which the stored row may be the head
    run = len(titles) - 1
    while run > 0 and titles[run - 1] == titles[run]:
        run -= 1
    assert out[0]["description"] == (None if run == 0 and titles[0] == "old" else str(run))


def test_a_gap_of_twelve_hours_is_one_run(spark):
    stamps = spark.createDataFrame([(0,), (43200,), (86401,)], "at long")
    assert sorted(r["run_start"] for r in L.crawl_runs(stamps).select("run_start").distinct().collect()) == [0, 86401]


def _greedy(rows):
    groups = []
    for d in rows:
        for g in groups:
            if all((d["organizer"] and d["organizer"] == m["organizer"]) or not any(d[f] and m[f] and d[f] != m[f] for f in ("city", "district")) for m in g):
                g.append(d)
                break
        else:
            groups.append([d])
    return {d["uid"]: g[0]["uid"] for g in groups for d in g}


def test_duplicates_are_grouped_like_row_by_row(spark):
    import random

    rnd = random.Random(4)
    rows = [{"uid": f"u{i:03d}", "title": "Language Exchange", "starts_at": "2024-07-01T19:00:00+08:00", "city": rnd.choice([None, "臺北市", "新北市"]), "district": rnd.choice([None, "大安區", "板橋區"]), "organizer": rnd.choice([None, "x", "y"]), "description": rnd.choice([None, "d"]), "first_seen": rnd.choice(["1", "2"])} for i in range(120)]
    df = listing(spark, *rows).withColumn("is_new", F.lit(True))
    full = ["address", "venue", "district", "price_text", "description", "signup_deadline", "organizer"]
    ranked = sorted(rows, key=lambda d: (-sum(bool(d.get(c)) for c in full), d["first_seen"], d["uid"]))
    merged = L.merge_duplicates(df)
    assert {r["uid"]: r["rep_uid"] for r in merged.select("uid", "rep_uid").collect()} == _greedy(ranked)
    folded = L.fold_duplicates(merged)
    assert folded.count() == len(set(_greedy(ranked).values()))
    again = L.merge_duplicates(folded.select(*NAMES, "is_new"))
    assert again.filter("uid <> rep_uid").count() <= folded.count()


def test_conflicting_places_are_emptied(spark):
    base = {"title": "Show", "starts_at": "2024-07-01T19:00:00+08:00", "organizer": "o"}
    rows = listing(spark, base | {"uid": "a", "city": "臺北市", "venue": "v1", "tags": ["x"]}, base | {"uid": "b", "city": "新北市", "venue": "v2", "price_text": "100", "is_free": False, "tags": ["y", "x"]}).withColumn("is_new", F.col("uid") == "a")
    r = L.fold_duplicates(L.merge_duplicates(rows)).first()
    assert r["venue_conflict"] and r["venue"] is None and r["city"] is None and not r["is_new"]
    assert (r["uid"], r["also_listed"], r["tags"], r["price_text"]) == ("b", ["a"], ["y", "x"], "100")


@pytest.mark.parametrize(("day", "weekend"), [("2024-06-12", ("2024-06-15", "2024-06-16")), ("2024-06-15", ("2024-06-15", "2024-06-16")), ("2024-06-16", ("2024-06-16", "2024-06-16"))])
def test_weekends(spark, day, weekend):
    r = W.windows(spark, f"{day}T12:00:00+08:00").filter("name = 'weekend'").first()
    assert (r["start"][:10], r["end"][:10]) == weekend


def test_empty_tables(spark):
    none = listing(spark).withColumn("is_new", F.lit(False))
    assert L.query(none, NOW).count() == L.merge_duplicates(none).count() == L.other_sessions(none).count() == W.similar(none).count() == 0
    assert L.glance(none).first()["total"] == 0


def test_similar_looks_past_a_long_run_of_one_title(spark):
    rows = [{"uid": f"a{i:04}", "title": "first", "starts_at": f"2024-07-01T00:{i // 60:02}:{i % 60:02}+08:00"} for i in range(1000)]
    rows += [{"uid": f"b{i:04}", "title": "more often", "starts_at": f"2024-08-01T00:{i // 60:02}:{i % 60:02}+08:00"} for i in range(1100)]
    got = {(r["uid"], r["nth"]): (r["other"], r["score"]) for r in W.similar(listing(spark, *rows)).collect()}
    assert len(got) == 4 * 2100
    for i in (0, 999):
        assert [got[f"a{i:04}", k] for k in (1, 2, 3, 4)] == [(f"b000{k - 1}", round(-0.01 * (k - 1), 6)) for k in (1, 2, 3, 4)]
        assert [got[f"b{i:04}", k][0] for k in (1, 2, 3, 4)] == ["a0000", "a0001", "a0002", "a0003"]


def test_picks_count_every_row_before(spark):
    rows = [{"uid": f"a{i:04}", "title": "same", "starts_at": f"2024-06-15T13:{i // 60:02}:{i % 60:02}+08:00", "feedback": "not_my_thing" if i == 7 else None, "tags": ["online"] if i % 10 == 3 else []} for i in range(1000)]
    rows += [{"uid": f"z{k}", "title": f"late {k}", "starts_at": "2024-06-16T12:00:00+08:00", "is_free": False, "venue": "v", "description": "d", "tags": ["lang:en"]} for k in range(3)]
    left = [r for r in rows if "online" not in r["tags"] and r.get("feedback") != "not_my_thing"]
    base = lambda r: 1 + 2 * ("lang:en" in r["tags"]) + 0.5 * ("is_free" in r) + 0.5 * ("venue" in r) + 0.25 * ("description" in r)
    want = sorted(((-round(base(r) - 0.002 * i, 6), i, r["uid"]) for i, r in enumerate(left)))[:6]
    got = [(r["uid"], r["score"]) for r in W.picks(listing(spark, *rows), NOW, L.order()).collect()]
    assert got == [(u, -s) for s, _, u in want] and got[0][0] == "z0"
    few = [{"uid": "w", "starts_at": "2024-06-15T20:00:00+08:00"}, {"uid": "v", "starts_at": "2024-06-20T20:00:00+08:00"}, {"uid": "far", "starts_at": "2024-06-25T20:00:00+08:00"}]
    assert [r["uid"] for r in W.picks(listing(spark, *few), NOW, L.order()).collect()] == ["w", "v"]  # the next seven days


def test_similar_is_that_of_a_plain_search(spark):
    import random

    rnd = random.Random(3)
    rows = [
        {"uid": f"u{i:03}", "title": rnd.choice(["A one", "a-ONE", "Two", "three", "four 4", None]), "type": rnd.choice(["talk", "food"]), "district": rnd.choice(["x", "y", "", None]), "tags": rnd.choice([[], ["lang:en"]]),
         "status": rnd.choice(["upcoming", "upcoming", "ongoing"]), "feedback": rnd.choice([None, None, "not_my_thing", "went"]), "starts_at": rnd.choice([f"2024-07-{d:02}T10:00:00+08:00" for d in range(1, 9)] + [None])}
        for i in range(150)
    ]
    norm = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    ranked = sorted(rows, key=lambda r: (r["starts_at"] or "9999", r["uid"]))
    best, shown = {}, {}
    for r in rows:
        some = [o for o in ranked if o["type"] == r["type"] and o["status"] == "upcoming" and o["feedback"] != "not_my_thing" and norm(o["title"]) != norm(r["title"])]
        scored = sorted(((-round((bool(o["district"]) and o["district"] == r["district"]) + 0.5 * ("lang:en" in o["tags"]) - 0.01 * i, 6), i, o) for i, o in enumerate(some)), key=lambda x: x[:2])
        best |= {(r["uid"], k + 1): (o["uid"], -s) for k, (s, _, o) in enumerate(scored[:4])}
        seen, kept = set(), []
        for k, (_, _, o) in enumerate(scored[:8]):
            key = ((o["starts_at"] or "")[:10], (o["title"] or "")[:12])
            if key not in seen:
                seen.add(key)
                kept.append((o["starts_at"] or "", k, o["uid"]))
        shown |= {(r["uid"], k): u for k, (_, _, u) in enumerate(sorted(kept[:4]))}
    df = listing(spark, *rows)
    assert {(r["uid"], r["nth"]): (r["other"], r["score"]) for r in W.similar(df).collect()} == best
    assert {(r["uid"], r["place"]): r["other"] for r in W.similar_list(df).collect()} == shown


def test_scenarios_and_live_statistics(spark):
    rows = [
        {"uid": "climb", "type": "outdoor_challenge", "starts_at": "2024-06-20T10:00:00+08:00", "venue": "wall"}, {"uid": "next month", "type": "outdoor_challenge", "starts_at": "2024-07-20T10:00:00+08:00", "venue": "wall"},
        {"uid": "online", "type": "outdoor_challenge", "starts_at": "2024-06-20T10:00:00+08:00", "venue": "wall", "tags": ["online"]}, {"uid": "nowhere", "type": "outdoor_challenge", "starts_at": "2024-06-20T10:00:00+08:00"},
        {"uid": "advert", "type": "outdoor_challenge", "starts_at": "2024-06-20T10:00:00+08:00", "venue": "wall", "title": "市集招商"},
        {"uid": "talk", "type": "language_exchange", "starts_at": "2024-06-20T10:00:00+08:00", "venue": "bar", "tags": ["lang:en"], "is_free": True}, {"uid": "shut", "type": "language_exchange", "starts_at": "2024-06-20T10:00:00+08:00", "venue": "bar", "tags": ["lang:en"], "signup_deadline": "2024-06-01T10:00:00+08:00"},
        {"uid": "jazz", "type": "music", "starts_at": "2024-06-16T10:00:00+08:00", "address": "road 1", "source_platform": "p"}, {"uid": "late jazz", "type": "music", "starts_at": "2024-06-18T10:00:00+08:00", "address": "road 1"},
        {"uid": "off", "status": "cancelled", "source_platform": "q"}, {"uid": "over", "status": "expired", "source_platform": "r"},
    ]
    from quarrymill.plans.listing_queries import SCENARIOS, UNWANTED

    df = listing(spark, *rows)
    got = {(r["scenario"], r["uid"]) for r in L.scenarios(df, NOW, SCENARIOS, UNWANTED).collect()}
    assert got == {("challenge", "climb"), ("language", "talk"), ("chill", "jazz")}
    assert W.live_statistics(df, NOW).first().asDict() == {"english_week": 2, "exchange_month": 2, "free_week": 1, "sources": 2}
