"""Registered queries of merging and exporting, with places as they are; their SQL steps through each bucket's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listings as L
from ..operators.joins import written
from ..sources import exports, tables
from .adapters import LISTINGS_CTE, NOW, REFRESHED_CTE, listings
from .listing_queries import DELISTED, DROPPED, NEW, RUNS_CTE, TITLE_KEY, fresh
from .registry import Registry
from .text_queries import _LATIN, VENUES, _case

R = Registry()


def located(rows):
    """Listings with coordinates: a third of them have both, some a latitude alone."""
    k = F.col("k")
    return rows.withColumn("lat", F.when(k % 3 == 0, 25 + (k % 100) / 1000)).withColumn("lon", F.when(k % 6 == 0, 121 + (k % 70) / 1000))


def _filled(c):
    return f"CASE WHEN coalesce({c}::VARCHAR, '') <> '' THEN 1 ELSE 0 END"


def merge_ctes(rows: str) -> str:
    """CTEs that end in ``grp`` (uid, t, m, nth, g), ``rep`` (t, m, g, rep_uid, clash) and ``fold`` of the CTE ``rows``."""
    filled = ["title_en", "description", "organizer", "price_text", "is_free", "ends_at", "signup_deadline"]
    place = ["venue", "address", "city", "district", "lat", "lon"]
    first = lambda c: f"min_by({c}, nth) FILTER ({c} IS NOT NULL)"
    kept = ", ".join(f"{first(c)} AS {c}" for c in filled)
    places = ", ".join(f"CASE WHEN NOT bool_or(clash) THEN {first(c)} END AS {c}" for c in place if c != "city")
    return f"""loc AS (SELECT *, CASE WHEN k % 3 = 0 THEN 25 + (k % 100) / 1000 END::DOUBLE AS lat, CASE WHEN k % 6 = 0 THEN 121 + (k % 70) / 1000 END::DOUBLE AS lon FROM {rows}),
one AS (SELECT *, {TITLE_KEY} AS t, substr(starts_at, 1, 16) AS m, {' + '.join(map(_filled, ('address', 'venue', 'price_text', 'description', 'signup_deadline', 'organizer', 'district', 'lat', 'is_free')))} AS c FROM loc),
b AS (SELECT *, row_number() OVER (PARTITION BY t, m ORDER BY -c, coalesce(first_seen, '9999'), uid) AS nth FROM one WHERE starts_at IS NOT NULL AND t <> ''),
s AS (SELECT t, m, nth, uid, coalesce(city, '') AS y, coalesce(district, '') AS d, coalesce(organizer, '') AS o FROM b),
grp AS (SELECT t, m, nth, uid, 0::BIGINT AS g, [{{'g': 0::BIGINT, 'y': y, 'd': d, 'o': o}}] AS state FROM s WHERE nth = 1
  UNION ALL SELECT t, m, nth, uid, g, list_append(state, {{'g': g, 'y': y, 'd': d, 'o': o}}) FROM (SELECT s.*, grp.state, list_min(list_filter(range(0, len(grp.state) + 1), lambda i: len(list_filter(grp.state, lambda x: x.g = i
    AND NOT ((x.o = s.o AND s.o <> '') OR NOT ((x.y <> '' AND s.y <> '' AND x.y <> s.y) OR (x.d <> '' AND s.d <> '' AND x.d <> s.d))))) = 0)) AS g FROM grp JOIN s ON s.t = grp.t AND s.m = grp.m AND s.nth = grp.nth + 1)),
rep AS (SELECT t, m, g, min_by(uid, nth) AS rep_uid, count(DISTINCT nullif(y, '')) > 1 OR count(DISTINCT nullif(d, '')) > 1 AS clash FROM grp JOIN s USING (t, m, nth, uid) GROUP BY ALL HAVING count(*) > 1),
al AS (SELECT uid, nth, rep_uid, clash FROM grp JOIN rep USING (t, m, g)), mr AS (SELECT o.*, al.nth, al.rep_uid, al.clash FROM one o JOIN al USING (uid)),
tg AS (SELECT rep_uid, string_agg(tag, ',' ORDER BY at_) AS tags FROM (SELECT rep_uid, tag, min((nth, pos)) AS at_ FROM (SELECT rep_uid, nth, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM mr) GROUP BY 1, 2) GROUP BY 1),
vn AS (SELECT rep_uid, string_agg(v, '|' ORDER BY at_) AS venues FROM (SELECT rep_uid, coalesce(nullif(venue, ''), nullif(address, '')) AS v, min(nth) AS at_ FROM mr WHERE clash GROUP BY 1, 2) WHERE v IS NOT NULL GROUP BY 1),
fold AS (SELECT rep_uid AS uid, {kept}, {places}, CASE WHEN NOT bool_or(clash) THEN {first('city')} WHEN count(DISTINCT coalesce(city, '')) = 1 THEN any_value(city) END AS city, bool_or(clash) AS clash, bool_and(is_new) AS is_new, min(first_seen) AS first_seen,
    string_agg(uid || ' ' || source_platform || ' ' || source_url, '|' ORDER BY nth) FILTER (uid <> rep_uid) AS also, count(*) - 1 AS n_also, min_by(status, nth) AS status, min_by(starts_at, nth) AS starts_at FROM mr GROUP BY 1
  UNION ALL SELECT uid, {', '.join(filled)}, {', '.join(c for c in place if c != 'city')}, city, false, is_new, first_seen, NULL, 0, status, starts_at FROM one WHERE uid NOT IN (SELECT uid FROM al)),
out AS (SELECT f.*, coalesce(tg.tags, (SELECT array_to_string(o.tags, ',') FROM one o WHERE o.uid = f.uid)) AS tags, venues FROM fold f LEFT JOIN tg ON tg.rep_uid = f.uid LEFT JOIN vn ON vn.rep_uid = f.uid)"""


_TAGGED = "tagged AS (SELECT * EXCLUDE (tags_text), list_filter(string_split(tags_text, ','), lambda x: x <> '') AS tags, k % 2 = 0 AS is_new FROM listings)"
FOLDED = ["uid", "venue_conflict", "is_new", "first_seen", "city", "district", "venue", "address", "lat", "lon", "title_en", "description", "organizer", "price_text", "is_free", "ends_at", "signup_deadline"]


@R.add("w4_greedy_groups", f"WITH RECURSIVE {LISTINGS_CTE}, {_TAGGED}, {merge_ctes('tagged')} SELECT one.uid, coalesce(rep_uid, one.uid) AS rep_uid, coalesce(clash, false) AS venue_conflict FROM one LEFT JOIN al USING (uid)")
def w4_groups(spark, sf):
    rows = located(listings(spark, sf, many=True)).withColumn("is_new", F.col("k") % 2 == 0)
    return L.merge_duplicates(rows).select("uid", "rep_uid", "venue_conflict")


@R.add("w4_fold_in_full", f"WITH RECURSIVE {LISTINGS_CTE}, {_TAGGED}, {merge_ctes('tagged')} SELECT {', '.join('clash AS venue_conflict' if c == 'venue_conflict' else c for c in FOLDED)}, tags, venues, also FROM out")
def w4_fold(spark, sf):
    rows = written(located(listings(spark, sf, many=True)).withColumn("is_new", F.col("k") % 2 == 0), "listings")
    folded = L.fold_duplicates(written(L.merge_duplicates(rows), "merged"))
    also = F.array_join(F.transform("listed_at", lambda x: F.concat_ws(" ", x["uid"], x["source_platform"], x["source_url"])), "|")
    return folded.select(*FOLDED, F.array_join("tags", ",").alias("tags"), F.nullif(F.array_join("conflict_venues", "|"), F.lit("")).alias("venues"), F.nullif(also, F.lit("")).alias("also"))


@R.add("j2_find_anything", f"WITH RECURSIVE {LISTINGS_CTE}, {_TAGGED}, {merge_ctes('tagged')} SELECT one.uid AS asked, coalesce(rep_uid, one.uid) AS uid FROM one LEFT JOIN al USING (uid)")
def j2(spark, sf):
    rows = located(listings(spark, sf, many=True)).withColumn("is_new", F.lit(False))
    merged = written(L.merge_duplicates(rows).select("uid", "rep_uid"), "merged")
    wanted = rows.select(F.col("uid").alias("asked"))
    return L.find(wanted, merged.filter("uid = rep_uid").select("uid"), merged.filter("uid <> rep_uid").select("uid", "rep_uid"))


CURATED = f"""{REFRESHED_CTE}, {RUNS_CTE}, {DELISTED}, {NEW}, {DROPPED}, sh AS (SELECT * REPLACE ({_case('venue', {k: v[2] for k, v in VENUES.items()})} AS venue, CASE WHEN ({_LATIN} OR trim(coalesce(title_en, '')) <> '') AND NOT list_contains(tags, 'lang:en') THEN tags || ['lang:en'] ELSE tags END AS tags),
  uid IN (SELECT uid FROM newest) AS is_new FROM dropped WHERE drop_reason IS NULL), {merge_ctes('sh')}"""


def curated(spark, sf):
    return L.curated(located(fresh(spark, sf, many=True)), ["anncr"])


@R.add("c2_curated_listings", f"WITH RECURSIVE {CURATED} SELECT uid, status, starts_at, venue, city, lat, is_new, clash AS venue_conflict, n_also::INT AS n_also, tags FROM out")
def c2(spark, sf):
    folded, _ = curated(spark, sf)
    return folded.select("uid", "status", "starts_at", "venue", "city", "lat", "is_new", "venue_conflict", F.size("also_listed").alias("n_also"), F.array_join("tags", ",").alias("tags"))


@R.add("s6_published_export", f"""WITH RECURSIVE {CURATED} SELECT 'event' AS kind, uid AS key, coalesce(city, '') || ' ' || tags AS value FROM out UNION ALL SELECT 'alias', uid, rep_uid FROM al WHERE uid <> rep_uid
  UNION ALL SELECT 'rows', 'events', (SELECT count(*) FROM out)::VARCHAR UNION ALL SELECT 'rows', 'aliases', (SELECT count(*) FROM al WHERE uid <> rep_uid)::VARCHAR UNION ALL SELECT 'meta', 'latest_crawl', (SELECT max(run) FROM runs)::VARCHAR UNION ALL SELECT 'meta', 'generated_at', '{NOW}'""")  # fmt: skip
def s6(spark, sf):
    """The export as a reader gets it back: listings, aliases, how many rows each has, and what is known of the run."""
    rows = written(located(fresh(spark, sf, many=True)), "refreshed")
    folded, aliases = L.curated(rows, ["anncr"])
    path = tables.scratch(spark, "export")
    latest = L.runs_of(rows).agg(F.max("run_start").alias("at")).first()["at"]
    exports.publish(spark, path, {"events": folded, "aliases": aliases}, NOW, {"latest_crawl": str(latest), "generated_at": NOW})
    read = lambda name: exports.published(spark, path, name)
    events = read("events").select(F.lit("event").alias("kind"), F.col("uid").alias("key"), F.concat(F.coalesce("city", F.lit("")), F.lit(" "), F.array_join("tags", ",")).alias("value"))
    out = events.unionByName(read("aliases").select(F.lit("alias").alias("kind"), F.col("uid").alias("key"), F.col("rep_uid").alias("value")))
    known = exports.versions(spark, path)
    rows = known.select(F.inline("tables")).select(F.lit("rows").alias("kind"), F.col("name").alias("key"), F.col("rows").cast("string").alias("value"))
    return out.unionByName(rows).unionByName(known.select(F.lit("meta").alias("kind"), F.explode("meta").alias("key", "value")))
