"""Registered queries of the listings family: status, query, upsert, runs, curation, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import rules
from ..operators import listings as L
from ..operators import windows as W
from ..operators.joins import written
from .adapters import LISTINGS_CTE, NOW, REFRESHED_CTE, listings, read
from .registry import Registry

R = Registry()
COLS = "uid, status, starts_at, type, city"


def fresh(spark, sf, many=False):
    return L.refresh_status(listings(spark, sf, many), NOW)


def out(df):
    return df.select(*COLS.split(", "))


ORDER = "CASE status WHEN 'upcoming' THEN 0 WHEN 'ongoing' THEN 1 ELSE 9 END, coalesce(starts_at, '9999'), uid"
TITLE_KEY = "regexp_replace(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+', '', 'g')"
BLOB = "lower(concat_ws(' ', title, nullif(title_en, ''), nullif(description, ''), nullif(venue, ''), nullif(organizer, ''), nullif(array_to_string(tags, ' '), '')))"


@R.add("t4_refresh_status", f"WITH {REFRESHED_CTE} SELECT uid, status FROM fresh")
def t4(spark, sf):
    return fresh(spark, sf).select("uid", "status")


@R.add("f1_listing_query", f"""WITH {REFRESHED_CTE} SELECT {COLS} FROM fresh WHERE status IN ('upcoming', 'ongoing') AND coalesce(feedback, '') <> 'not_my_thing'
  AND type IN ('music', 'talk', 'language_exchange', 'outdoor_challenge') AND city = '臺北市' AND s >= TIMESTAMPTZ '1999-06-01T00:00:00+08:00' AND s <= TIMESTAMPTZ '2000-12-31T23:59:59+08:00'""")  # fmt: skip
def f1(spark, sf):
    params = L.normalize_params({"types": ["music", "talk", "language_exchange", "outdoor_challenge"], "city": "臺北市", "start_after": "1999-06-01", "start_before": "2000-12-31"})
    return out(L.query(fresh(spark, sf), NOW, **params))


@R.add("f1_free_and_tagged", f"WITH {REFRESHED_CTE} SELECT {COLS} FROM fresh WHERE status IN ('upcoming', 'ongoing') AND coalesce(feedback, '') <> 'not_my_thing' AND is_free AND list_contains(tags, 'lang:en') AND list_contains(tags, 'online')")
def f1b(spark, sf):
    return out(L.query(fresh(spark, sf), NOW, free_only=True, tags=["lang:en", "online"]))


@R.add("f1_keyword", f"WITH {REFRESHED_CTE} SELECT {COLS} FROM fresh WHERE status IN ('upcoming', 'ongoing', 'expired') AND {BLOB} LIKE '%jazz%'")
def f1c(spark, sf):
    return out(L.query(fresh(spark, sf), NOW, keyword=" Jazz ", statuses=["upcoming", "ongoing", "expired"], exclude_feedback=()))


@R.add("f2_signup_open", f"WITH {REFRESHED_CTE} SELECT {COLS} FROM fresh WHERE status IN ('upcoming', 'ongoing') AND coalesce(feedback, '') <> 'not_my_thing' AND coalesce(signup_deadline::TIMESTAMPTZ, s, TIMESTAMPTZ '{NOW}') >= TIMESTAMPTZ '{NOW}'")
def f2(spark, sf):
    return out(L.query(fresh(spark, sf), NOW, signup_open=True))


@R.add("f3_exclusions", f"""WITH {REFRESHED_CTE} SELECT {COLS} FROM fresh WHERE status IN ('upcoming', 'ongoing') AND coalesce(feedback, '') <> 'not_my_thing' AND NOT list_contains(tags, 'online')
  AND (coalesce(venue, '') <> '' OR coalesce(address, '') <> '') AND NOT lower(title || ' ' || coalesce(description, '')) LIKE '%wine%' AND NOT lower(title || ' ' || coalesce(description, '')) LIKE '%免費%'""")  # fmt: skip
def f3(spark, sf):
    return out(L.query(fresh(spark, sf), NOW, exclude_online=True, require_venue=True, exclude_keywords=["Wine", "免費"]))


@R.add("f4_whole_days", f"WITH {REFRESHED_CTE} SELECT {COLS} FROM fresh WHERE status IN ('upcoming', 'ongoing') AND coalesce(feedback, '') <> 'not_my_thing' AND s >= TIMESTAMPTZ '1999-07-01T00:00:00+08:00' AND s <= TIMESTAMPTZ '1999-07-01T23:59:59+08:00'")
def f4(spark, sf):
    return out(L.query(fresh(spark, sf), NOW, **L.normalize_params({"start_after": "1999-07-01", "start_before": "1999-07-01", "keyword": "  ", "free_only": False})))


@R.add("f6_standing_listings", f"WITH {LISTINGS_CTE} SELECT uid FROM listings WHERE epoch(ends_at::TIMESTAMPTZ) - epoch(starts_at::TIMESTAMPTZ) >= 731 * 86400")
def f6(spark, sf):
    return listings(spark, sf).filter(L.is_standing()).select("uid")


@R.add("o1_result_order", f"WITH {REFRESHED_CTE} SELECT uid, row_number() OVER (ORDER BY {ORDER})::BIGINT AS place FROM fresh ORDER BY {ORDER} LIMIT 200")
def o1(spark, sf):
    top = fresh(spark, sf).orderBy(*L.order()).limit(200)
    from pyspark.sql import Window

    return top.select("uid", F.row_number().over(Window.orderBy(*L.order())).cast("long").alias("place"))


@R.add("o2_newest_first", f"WITH {REFRESHED_CTE} SELECT uid, first_seen FROM fresh WHERE list_contains(tags, 'lang:en') AND status <> 'expired' ORDER BY first_seen DESC NULLS LAST, uid LIMIT 100")
def o2(spark, sf):
    rows = fresh(spark, sf).filter(F.array_contains("tags", "lang:en") & (F.col("status") != "expired"))
    return rows.orderBy(F.desc_nulls_last("first_seen"), "uid").limit(100).select("uid", "first_seen")


@R.add("o3_bounded_result", f"WITH {REFRESHED_CTE}, m AS (SELECT * FROM fresh WHERE status IN ('upcoming', 'ongoing') AND is_free) SELECT uid, (SELECT count(*) FROM m)::BIGINT AS total FROM m ORDER BY {ORDER} LIMIT 25")
def o3(spark, sf):
    rows = fresh(spark, sf).filter(L.matches(NOW, free_only=True, exclude_feedback=()))
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*L.order()).limit(25).select("uid").join(F.broadcast(total))


#: The words that no scenario wants.
UNWANTED = ["報稅", "稅務", "居留證", "簽證", "移民署", "健保申辦", "線上課程", "線上活動", "免費體驗", "體驗課程", "免費講座", "說明會", "招商", "徵才", "直播", "成交", "加盟", "被動收入", "潛意識"]
#: The scenarios.
SCENARIOS = {
    "challenge": {"types": ["outdoor_challenge"], "window": "month", "limit": 5},
    "language": {"types": ["language_exchange"], "tags": ["lang:en"], "window": "month", "signup_open": True, "limit": 3},
    "chill": {"types": ["music", "market", "exhibition", "food"], "window": "weekend", "limit": 6},
}


def _scenario_sql() -> str:
    out = []
    unwanted = " AND ".join(f"NOT contains(lower(title || ' ' || coalesce(description, '')), '{w}')" for w in UNWANTED)
    for name, p in SCENARIOS.items():
        test = " AND ".join([f"type IN ({', '.join(repr(t) for t in p['types'])})", *[f"list_contains(tags, '{t}')" for t in p.get("tags", [])]])
        until = {"month": "1999-06-30", "weekend": "1999-06-20"}[p["window"]]
        since = {"month": "1999-06-16", "weekend": "1999-06-19"}[p["window"]]
        if p.get("signup_open"):
            test += f" AND coalesce(signup_deadline::TIMESTAMPTZ, s, TIMESTAMPTZ '{NOW}') >= TIMESTAMPTZ '{NOW}'"
        test += f" AND s BETWEEN TIMESTAMPTZ '{since}T00:00:00+08:00' AND TIMESTAMPTZ '{until}T23:59:59+08:00'"
        out.append(f"(SELECT '{name}' AS scenario, uid, row_number() OVER (ORDER BY {ORDER})::BIGINT AS place FROM m WHERE {test} QUALIFY place <= {p['limit']})")
    return f"WITH {REFRESHED_CTE}, m AS (SELECT * FROM fresh WHERE status IN ('upcoming', 'ongoing') AND coalesce(feedback, '') <> 'not_my_thing' AND NOT list_contains(tags, 'online') AND (coalesce(venue, '') <> '' OR coalesce(address, '') <> '') AND {unwanted}) " + " UNION ALL ".join(out)


@R.add("c1_scenarios", _scenario_sql())
def c1(spark, sf):
    return L.scenarios(fresh(spark, sf), NOW, SCENARIOS, UNWANTED)


# ---- validation, hashes, upsert

HASH_SQL = "substr(sha1(concat_ws('|', coalesce(title, ''), coalesce(type, ''), coalesce(starts_at, ''), coalesce(ends_at, ''), coalesce(signup_deadline, ''), coalesce(venue, ''), coalesce(address, ''), coalesce(city, ''), coalesce(district, ''), coalesce(price_text, ''), coalesce(status, ''))), 1, 16)"


@R.add("p20_content_hash", f"WITH {LISTINGS_CTE} SELECT uid, {HASH_SQL} AS content_hash FROM listings")
def p20(spark, sf):
    return listings(spark, sf).select("uid", N.content_hash().alias("content_hash"))


@R.add("p21_keys", f"WITH {LISTINGS_CTE} SELECT source_platform || ':' || source_id AS uid, substr({TITLE_KEY}, 1, 40) || '|' || substr(coalesce(starts_at, ''), 1, 10) AS dedup_key FROM listings")
def p21(spark, sf):
    return listings(spark, sf).select(N.uid(F.col("source_platform"), F.col("source_id")).alias("uid"), N.dedup_key(F.col("title"), F.col("starts_at")).alias("dedup_key"))


def spoiled(rows):
    """Some rows with faults, as bad feeds have them."""
    k = F.col("k")
    return rows.withColumn("title", F.when(k % 31 == 0, " ").otherwise(F.col("title"))).withColumn("type", F.when(k % 37 == 0, "party").otherwise(F.col("type"))).withColumn("starts_at", F.when(k % 29 == 0, F.substring("starts_at", 1, 10)).otherwise(F.col("starts_at"))).withColumn("source_url", F.when(k % 41 == 0, F.lit(None)).otherwise(F.col("source_url")))


SPOILED_CTE = f"""{LISTINGS_CTE}, spoiled AS (SELECT * REPLACE (CASE WHEN k % 31 = 0 THEN ' ' ELSE title END AS title, CASE WHEN k % 37 = 0 THEN 'party' ELSE type END AS type,
  CASE WHEN k % 29 = 0 THEN substr(starts_at, 1, 10) ELSE starts_at END AS starts_at, CASE WHEN k % 41 = 0 THEN NULL ELSE source_url END AS source_url) FROM listings)"""


@R.add("p19_validation", f"""WITH {SPOILED_CTE} SELECT uid, concat_ws('; ', CASE WHEN trim(title) = '' THEN 'no title' END, CASE WHEN source_url IS NULL THEN 'no source_url' END, CASE WHEN type = 'party' THEN 'unknown type' END,
  CASE WHEN length(starts_at) = 10 THEN 'starts_at isn''t ISO 8601 with an offset' END) AS problems FROM spoiled""")  # fmt: skip
def p19(spark, sf):
    return L.split_valid(spoiled(listings(spark, sf))).select("uid", F.array_join("problems", "; ").alias("problems"))


STAMP = "1999-06-12T03:00:00+08:00"


def stored_and_batch(spark, sf, many=False):
    rows = listings(spark, sf, many)
    stored = rows.filter("k % 3 < 2").withColumn("content_hash", N.content_hash())
    batch = rows.filter("k % 3 > 0").withColumn("feedback", F.lit(None).cast("string")).withColumn("title", F.when(F.col("k") % 5 == 0, F.concat("title", F.lit(" (moved)"))).otherwise(F.col("title"))).withColumn("description", F.lit("rewritten")).withColumn("pos", F.col("k"))
    return stored, batch


UPSERT_CTE = f"""{LISTINGS_CTE}, st AS (SELECT *, {HASH_SQL} AS h FROM listings WHERE k % 3 < 2),
ba0 AS (SELECT * REPLACE (CASE WHEN k % 5 = 0 THEN title || ' (moved)' ELSE title END AS title, 'rewritten' AS description) FROM listings WHERE k % 3 > 0), ba AS (SELECT *, {HASH_SQL} AS h FROM ba0),
up AS (SELECT coalesce(b.uid, s.uid) AS uid, CASE WHEN b.uid IS NULL THEN 'kept' WHEN s.uid IS NULL THEN 'new' WHEN s.h = b.h THEN 'unchanged' ELSE 'updated' END AS outcome,
  CASE WHEN b.uid IS NULL OR s.h = b.h THEN s.title ELSE b.title END AS title, CASE WHEN b.uid IS NULL OR s.h = b.h THEN s.description ELSE b.description END AS description,
  CASE WHEN s.uid IS NULL THEN '{STAMP}' ELSE s.first_seen END AS first_seen, CASE WHEN b.uid IS NULL THEN s.last_seen ELSE '{STAMP}' END AS last_seen, s.feedback AS feedback,
  coalesce(b.source_platform, s.source_platform) AS source_platform FROM st s FULL JOIN ba b ON s.uid = b.uid)"""


@R.add("j1_upsert", f"WITH {UPSERT_CTE} SELECT uid, outcome, title, description, first_seen, last_seen, feedback FROM up")
def j1(spark, sf):
    stored, batch = stored_and_batch(spark, sf)
    return L.upsert(stored, batch, STAMP).select("uid", "outcome", "title", "description", "first_seen", "last_seen", "feedback")


@R.add("a1_upsert_statistics", f"WITH {UPSERT_CTE} SELECT source_platform, count(*) FILTER (outcome = 'new')::BIGINT AS new, count(*) FILTER (outcome = 'updated')::BIGINT AS updated, count(*) FILTER (outcome = 'unchanged')::BIGINT AS unchanged FROM up GROUP BY 1")
def a1(spark, sf):
    rows = L.upsert(*stored_and_batch(spark, sf), STAMP).groupBy("source_platform")
    return rows.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("new", "updated", "unchanged")])


@R.add("w5_first_sighting", f"WITH {LISTINGS_CTE}, f AS (SELECT 1 AS feed, uid, title FROM listings WHERE k % 2 = 0 UNION ALL SELECT 2, uid, title || '!' FROM listings WHERE k % 3 = 0) SELECT uid, arg_min(title, feed) AS title FROM f GROUP BY 1")
def w5(spark, sf):
    rows = listings(spark, sf)
    feeds = rows.filter("k % 2 = 0").select(F.lit(1).alias("feed"), "uid", "title").unionByName(rows.filter("k % 3 = 0").select(F.lit(2).alias("feed"), "uid", F.concat("title", F.lit("!")).alias("title")))
    return L.first_sightings(feeds, "feed").select("uid", "title")


@R.add("u1_union_of_feeds", f"WITH {SPOILED_CTE} SELECT source_platform, count(*)::BIGINT AS n, count(*) FILTER (NOT (k % 31 = 0 OR k % 37 = 0 OR k % 41 = 0 OR (k % 29 = 0 AND starts_at IS NOT NULL)))::BIGINT AS valid, count(district)::BIGINT AS with_district FROM spoiled WHERE source_platform <> 'meetup' OR k % 2 = 0 GROUP BY 1")
def u1(spark, sf):
    rows = spoiled(listings(spark, sf))
    feeds = [rows.filter(F.col("source_platform") == p) for p in ("anncr", "accupass", "travel_taipei", "talent_taiwan")]
    feeds.append(rows.filter((F.col("source_platform") == "meetup") & (F.col("k") % 2 == 0)))
    whole = feeds[0]
    for f in feeds[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return L.split_valid(whole).groupBy("source_platform").agg(F.count("*").alias("n"), F.count_if(F.size("problems") == 0).alias("valid"), F.count("district").alias("with_district"))


# ---- crawl runs and curation

RUNS_CTE = """seen AS (SELECT DISTINCT epoch(first_seen::TIMESTAMPTZ)::BIGINT AS sec FROM listings UNION SELECT epoch(last_seen::TIMESTAMPTZ)::BIGINT FROM listings),
starts AS (SELECT sec, coalesce(sec - lag(sec) OVER (ORDER BY sec) > 43200, true) AS new FROM seen), runs AS (SELECT sec, max(CASE WHEN new THEN sec END) OVER (ORDER BY sec) AS run FROM starts)"""


@R.add("w1_crawl_runs", f"WITH {LISTINGS_CTE}, {RUNS_CTE} SELECT DISTINCT run AS run_start FROM runs")
def w1(spark, sf):
    return L.runs_of(listings(spark, sf)).select("run_start").distinct()


@R.add("w1_user_sessions", "WITH e AS (SELECT user_id, epoch(ts) AS at, coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200, true) AS new FROM events) SELECT user_id, count(*) FILTER (new)::BIGINT AS runs FROM e GROUP BY 1")
def w1b(spark, sf):
    stamps = read(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return L.crawl_runs(stamps, ["user_id"]).groupBy("user_id").agg(F.count_distinct("run_start").alias("runs"))


@R.add("j3_run_of_stamp", f"WITH {LISTINGS_CTE}, {RUNS_CTE} SELECT uid, run AS run_start FROM listings JOIN runs ON sec = epoch(last_seen::TIMESTAMPTZ)::BIGINT")
def j3(spark, sf):
    rows = listings(spark, sf)
    return L.with_run(rows, L.runs_of(rows), "last_seen", "run_start").select("uid", "run_start")


DELISTED = """gone AS (SELECT uid FROM (SELECT *, max(run) OVER (PARTITION BY source_platform) AS latest FROM fresh JOIN runs ON sec = epoch(last_seen::TIMESTAMPTZ)::BIGINT WHERE source_platform = 'anncr') WHERE status = 'upcoming' AND run < latest)"""


@R.add("w2_delisted", f"WITH {REFRESHED_CTE}, {RUNS_CTE}, {DELISTED} SELECT uid FROM gone")
def w2(spark, sf):
    rows = fresh(spark, sf)
    return L.delisted(rows, L.runs_of(rows), ["anncr"])


NEW = "newest AS (SELECT uid FROM (SELECT *, min(run) OVER (PARTITION BY source_platform) AS first_run FROM listings JOIN runs ON sec = epoch(first_seen::TIMESTAMPTZ)::BIGINT) WHERE run = (SELECT max(run) FROM runs) AND first_run < (SELECT max(run) FROM runs))"


@R.add("w3_new_in_latest_run", f"WITH {LISTINGS_CTE}, {RUNS_CTE}, {NEW} SELECT uid FROM newest")
def w3(spark, sf):
    rows = listings(spark, sf)
    return L.new_in_latest_run(rows, L.runs_of(rows))


HOME = "(regexp_matches(coalesce(address, ''), '(?i)新北市|臺北市|台北市|New\\s+Taipei(\\s+City)?|Taipei\\s+City'))"
AWAY = f"""CASE WHEN city IN ('臺北市', '新北市') THEN false WHEN coalesce(city, '') <> '' THEN true WHEN coalesce(address, '') = '' OR {HOME} THEN false
  ELSE regexp_matches(address, '(?i)\\b(?:{'|'.join(rules.OTHER_CITIES_EN)})\\s+(?:City|County)\\b') OR regexp_matches(address, '{'|'.join(rules.OTHER_CITIES)}') OR regexp_matches(address, ',\\s*(?:Singapore|Japan|India)\\s*$') END"""


@R.add("p7_outside_area", f"WITH {LISTINGS_CTE} SELECT uid, {AWAY} AS outside FROM listings")
def p7(spark, sf):
    return listings(spark, sf).select("uid", N.outside_area(F.col("city"), F.col("address")).alias("outside"))


DROPPED = f"""dropped AS (SELECT f.*, CASE WHEN g.uid IS NOT NULL THEN 'delisted' WHEN NOT list_contains(tags, 'online') AND ({AWAY}) THEN 'outside'
  WHEN epoch(ends_at::TIMESTAMPTZ) - epoch(starts_at::TIMESTAMPTZ) >= 731 * 86400 THEN 'standing' END AS drop_reason FROM fresh f LEFT JOIN gone g USING (uid))"""


@R.add("f7_drop_reasons", f"WITH {REFRESHED_CTE}, {RUNS_CTE}, {DELISTED}, {DROPPED} SELECT coalesce(drop_reason, 'shown') AS reason, count(*)::BIGINT AS n FROM dropped GROUP BY 1")
def f7(spark, sf):
    rows = fresh(spark, sf)
    marked = L.drop_reason(L.delisted(rows, L.runs_of(rows), ["anncr"]), rows)
    return marked.groupBy(F.coalesce("drop_reason", F.lit("shown")).alias("reason")).agg(F.count("*").alias("n"))


@R.add("u2_curated_set", f"WITH {REFRESHED_CTE}, {RUNS_CTE}, {DELISTED}, {DROPPED} SELECT uid FROM dropped WHERE drop_reason IS NULL")
def u2(spark, sf):
    rows = fresh(spark, sf)
    return L.drop_reason(L.delisted(rows, L.runs_of(rows), ["anncr"]), rows).filter("drop_reason is null").select("uid")


MERGE_CTE = f"""{LISTINGS_CTE}, one AS (SELECT uid, title, starts_at, first_seen, {TITLE_KEY} AS t, substr(starts_at, 1, 16) AS m,
  (CASE WHEN coalesce(address, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(venue, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(price_text, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(description, '') <> '' THEN 1 ELSE 0 END
   + CASE WHEN signup_deadline IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(organizer, '') <> '' THEN 1 ELSE 0 END + CASE WHEN is_free IS NOT NULL THEN 1 ELSE 0 END) AS c FROM listings),
reps AS (SELECT t, m, arg_min(uid, (-c, coalesce(first_seen, '9999'), uid)) AS rep FROM one WHERE starts_at IS NOT NULL AND t <> '' GROUP BY 1, 2)"""


@R.add("w4_merge_duplicates", f"WITH {MERGE_CTE} SELECT uid, coalesce(rep, uid) AS rep_uid FROM one LEFT JOIN reps ON one.t = reps.t AND one.m = reps.m AND one.starts_at IS NOT NULL")
def w4(spark, sf):
    rows = listings(spark, sf, many=True).withColumn("is_new", F.lit(False)).withColumn("city", F.lit(None).cast("string")).withColumn("district", F.lit(None).cast("string"))
    return L.merge_duplicates(rows).select("uid", "rep_uid")


@R.add("w4_fold_with_conflicts")
def w4b(spark, sf):
    rows = written(listings(spark, sf, many=True).withColumn("is_new", F.col("k") % 2 == 0), "listings")
    folded = L.fold_duplicates(written(L.merge_duplicates(rows), "merged"))
    return folded.select("uid", "venue_conflict", "is_new", "first_seen", "city", "district", "organizer", "price_text", F.array_join("also_listed", ",").alias("also_listed"), F.array_join("tags", ",").alias("tags"))


@R.add("j2_find_by_alias", f"WITH {MERGE_CTE}, al AS (SELECT uid, rep FROM one JOIN reps ON one.t = reps.t AND one.m = reps.m WHERE rep <> uid AND starts_at IS NOT NULL) SELECT uid AS asked, coalesce(rep, uid) AS uid FROM one LEFT JOIN al USING (uid) WHERE substr(uid, -1, 1) = '7'")
def j2(spark, sf):
    rows = listings(spark, sf, many=True).withColumn("city", F.lit(None).cast("string")).withColumn("district", F.lit(None).cast("string"))
    merged = written(L.merge_duplicates(rows).select("uid", "rep_uid"), "merged")
    wanted = rows.filter(F.col("uid").endswith("7")).select(F.col("uid").alias("asked"))
    return L.find(wanted, merged.filter("uid = rep_uid").select("uid"), merged.filter("uid <> rep_uid").select("uid", "rep_uid"))


@R.add("c2_curated_export")
def c2(spark, sf):
    folded, _ = L.curated(fresh(spark, sf, many=True), ["anncr"])
    return folded.orderBy(F.coalesce("starts_at", F.lit(L.LATE)), "uid").select("uid", "status", "starts_at", "venue", "city", "is_new", "venue_conflict", F.size("also_listed").alias("n_also"))


# ---- digests

GLANCE = """SELECT count(*)::BIGINT AS total, count(*) FILTER (list_contains(tags, 'lang:en'))::BIGINT AS english, count(*) FILTER (is_free)::BIGINT AS free, count(*) FILTER (is_free IS NULL AND coalesce(price_text, '') = '')::BIGINT AS unknown_price,
  count(*) FILTER (list_contains(tags, 'online'))::BIGINT AS online, arg_min(uid, (starts_at, uid)) FILTER (status = 'upcoming' AND starts_at IS NOT NULL) AS first_uid,
  (SELECT district FROM fresh WHERE district IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, district LIMIT 1) AS top_district, (SELECT count(*) FROM fresh WHERE district IS NOT NULL GROUP BY district ORDER BY 1 DESC LIMIT 1)::BIGINT AS top_n FROM fresh"""


@R.add("a2_glance", f"WITH {REFRESHED_CTE} {GLANCE}")
def a2(spark, sf):
    return L.glance(fresh(spark, sf))


@R.add("a3_source_health", f"WITH {REFRESHED_CTE} SELECT source_platform, count(*)::BIGINT AS total, count(*) FILTER (status IN ('upcoming', 'ongoing'))::BIGINT AS active, max(last_seen) AS last_seen FROM fresh GROUP BY 1")
def a3(spark, sf):
    return L.source_health(fresh(spark, sf))


def _like(words):
    return "(" + " OR ".join(f"b LIKE '%{w}%'" for w in words) + ")"


def _topic_sql() -> str:
    parts = []
    for topic, types in rules.TOPICS.items():
        inside = f"type IN ({', '.join(repr(t) for t in types)})"
        parts.append(f"SELECT uid, '{topic}' AS topic FROM bl WHERE {inside}")
        for sub, (kind, v) in rules.SUBTOPICS[topic].items():
            test = {"words": lambda v: _like(v), "type": lambda v: f"type = '{v[0]}'", "tag": lambda v: f"list_contains(tags, '{v[0]}')", "type or words": lambda v: f"(type = '{v[0]}' OR {_like(v[1:])})"}[kind](v)
            parts.append(f"SELECT uid, '{topic}/{sub}' FROM bl WHERE {inside} AND {test}")
    return f"bl AS (SELECT *, {BLOB} AS b FROM fresh), tp AS ({' UNION ALL '.join(parts)})"


@R.add("f8_topics", f"WITH {REFRESHED_CTE}, {_topic_sql()} SELECT uid, topic FROM tp")
def f8(spark, sf):
    return fresh(spark, sf).select("uid", F.explode(L.topic_ids()).alias("topic"))


@R.add("a4_topic_counts", f"WITH {REFRESHED_CTE}, {_topic_sql()} SELECT topic, count(*)::BIGINT AS n FROM tp JOIN fresh USING (uid) WHERE status IN ('upcoming', 'ongoing') GROUP BY 1")
def a4(spark, sf):
    rows = fresh(spark, sf).filter("status in ('upcoming', 'ongoing')")
    return rows.select(F.explode(L.topic_ids()).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


_LIVE = "status = 'upcoming' AND coalesce(feedback, '') <> 'not_my_thing' AND s BETWEEN TIMESTAMPTZ '1999-06-16T00:00:00+08:00' AND TIMESTAMPTZ"


@R.add("a5_live_statistics", f"""WITH {REFRESHED_CTE} SELECT count(*) FILTER ({_LIVE} '1999-06-22T23:59:59+08:00' AND list_contains(tags, 'lang:en'))::BIGINT AS english_week,
  count(*) FILTER ({_LIVE} '1999-07-15T23:59:59+08:00' AND type = 'language_exchange')::BIGINT AS exchange_month, count(*) FILTER ({_LIVE} '1999-06-22T23:59:59+08:00' AND is_free)::BIGINT AS free_week,
  count(DISTINCT source_platform) FILTER (status <> 'expired')::BIGINT AS sources FROM fresh""")  # fmt: skip
def a5(spark, sf):
    return W.live_statistics(fresh(spark, sf), NOW)


@R.add("a11_weighted_coverage", f"WITH {LISTINGS_CTE}, g AS (SELECT venue, address, district, count(*) AS n FROM listings GROUP BY ALL) SELECT ((sum(n) FILTER (district IS NOT NULL)) * 100 // sum(n))::BIGINT AS percent FROM g")
def a11(spark, sf):
    g = listings(spark, sf).groupBy("venue", "address", "district").agg(F.count("*").alias("n"))
    return g.agg(F.expr("sum(CASE WHEN district IS NOT NULL THEN n ELSE 0 END) * 100 div sum(n)").cast("long").alias("percent"))


@R.add("a12_null_alarms", f"""WITH {LISTINGS_CTE}, r AS (SELECT source_platform, k % 2 AS run, avg(CASE WHEN (k % 2 = 1 AND source_platform = 'meetup') OR district IS NULL THEN 1 ELSE 0 END) AS district, avg(CASE WHEN description IS NULL THEN 1 ELSE 0 END) AS description FROM listings GROUP BY 1, 2)
SELECT b.source_platform, 'district' AS "column", b.district AS rate, a.district AS was FROM r a JOIN r b USING (source_platform) WHERE a.run = 0 AND b.run = 1 AND b.district - a.district >= 0.5
UNION ALL SELECT b.source_platform, 'description', b.description, a.description FROM r a JOIN r b USING (source_platform) WHERE a.run = 0 AND b.run = 1 AND b.description - a.description >= 0.5""")  # fmt: skip
def a12(spark, sf):
    rows = listings(spark, sf)
    later = rows.filter("k % 2 = 1").withColumn("district", F.when(F.col("source_platform") != "meetup", F.col("district")))
    return L.null_alarms(rows.filter("k % 2 = 0"), later, ["district", "description"])


SERIES = f"se AS (SELECT uid, {TITLE_KEY} AS t, coalesce(organizer, '') AS o, coalesce(starts_at, '9999') AS at, status FROM fresh)"


@R.add("j11_other_sessions", f"WITH {REFRESHED_CTE}, {SERIES}, pr AS (SELECT a.uid, b.uid AS other, row_number() OVER (PARTITION BY a.uid ORDER BY b.at, b.uid) AS nth FROM se a JOIN se b ON a.t = b.t AND a.o = b.o AND a.uid <> b.uid AND b.status = 'upcoming') SELECT uid, other, nth::INT AS nth FROM pr WHERE nth <= 6")
def j11(spark, sf):
    return L.other_sessions(fresh(spark, sf))


@R.add("w8_agenda", f"""WITH {REFRESHED_CTE}, d AS (SELECT CASE WHEN status = 'ongoing' THEN 'ongoing' ELSE coalesce(substr(starts_at, 1, 10), 'tbc') END AS day, count(*)::BIGINT AS n, min(uid) AS first_uid FROM fresh WHERE status IN ('upcoming', 'ongoing') GROUP BY 1),
r AS (SELECT *, CASE day WHEN 'ongoing' THEN 0 WHEN 'tbc' THEN 2 ELSE 1 END AS rank FROM d), m AS (SELECT *, CASE WHEN rank = 1 THEN substr(day, 1, 7) END AS month FROM r)
SELECT day, n, first_uid, coalesce(month <> lag(month) OVER (ORDER BY rank, day), month IS NOT NULL) AS new_month FROM m""")  # fmt: skip
def w8(spark, sf):
    return L.agenda(fresh(spark, sf).filter("status in ('upcoming', 'ongoing')"))
