"""Registered queries of parsing, normalising, searching and picking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import rules
from ..functions import search as S
from ..operators import listings as L
from ..operators import windows as W
from .adapters import LISTINGS_CTE, NOW, REFRESHED_CTE, listings, pick, read
from .listing_queries import BLOB, ORDER, TITLE_KEY, fresh
from .registry import Registry

R = Registry()


def _alt(words):
    import re

    return "|".join(re.escape(w) for w in words).replace("'", "''").replace("\\ ", " ").replace("\\-", "-")


DATES = ["1998-03-05", "1998/03/05 14:30", "1998-03-05T10:00:00Z", "19980305", "1998.03.05", "1998-03-05 00:00:00", "1998-03-05T14:00:00+09:00", "soon", "1998-03-05T14:05", ""]
DATE_SQL = [
    ("1998-03-05T00:00:00+08:00", "1998-03-05T23:59:59+08:00"), ("1998-03-05T14:30:00+08:00",) * 2, ("1998-03-05T18:00:00+08:00",) * 2, ("1998-03-05T00:00:00+08:00", "1998-03-05T23:59:59+08:00"),
    ("1998-03-05T00:00:00+08:00", "1998-03-05T23:59:59+08:00"), ("1998-03-05T00:00:00+08:00", "1998-03-05T23:59:59+08:00"), ("1998-03-05T13:00:00+08:00",) * 2, (None, None), ("1998-03-05T14:05:00+08:00",) * 2, (None, None),
]


@R.add("p1_taipei_iso", f"SELECT o_orderkey AS k, {pick([a for a, _ in DATE_SQL], 'o_orderkey')} AS starts_at, {pick([b for _, b in DATE_SQL], 'o_orderkey')} AS ends_at FROM orders")
def p1(spark, sf):
    rows = spark.sql(f"SELECT o_orderkey AS k, {pick(DATES, 'o_orderkey')} AS raw FROM {{orders}}", orders=read(spark, sf, "orders"))
    return rows.select("k", N.taipei_iso(F.col("raw")).alias("starts_at"), N.taipei_iso(F.col("raw"), end_of_day=True).alias("ends_at"))


def _kinds(b):
    return " ".join(f"WHEN regexp_matches({b}, '{_alt(w)}') THEN '{k}'" for k, w in rules.TYPE_WORDS.items())


@R.add("p2_classify", f"WITH {LISTINGS_CTE} SELECT uid, CASE {_kinds('lower(title)')} {_kinds("lower(concat_ws(' ', title, description))")} ELSE 'other' END AS kind FROM listings")
def p2(spark, sf):
    return listings(spark, sf).select("uid", N.classify(F.col("title"), F.col("description")).alias("kind"))


_LANG = ", ".join(f"CASE WHEN regexp_matches(lower(concat_ws(' ', title, description)), '{_alt(w)}') THEN 'lang:{c}' END" for c, w in rules.LANGUAGE_WORDS.items())


@R.add("p3_language_tags", f"WITH {LISTINGS_CTE} SELECT uid, concat_ws(',', {_LANG}) AS langs FROM listings")
def p3(spark, sf):
    return listings(spark, sf).select("uid", F.array_join(N.language_tags(F.col("title"), F.col("description")), ",").alias("langs"))


_LATIN = "(NOT regexp_matches(title, '[㐀-鿿豈-﫿]') AND len(regexp_extract_all(title, '[A-Za-z]')) >= 8)"


@R.add("p4_latin_titles", f"WITH {LISTINGS_CTE} SELECT uid, {_LATIN} AS latin FROM listings")
def p4(spark, sf):
    return listings(spark, sf).select("uid", N.is_latin(F.col("title")).alias("latin"))


PLACES = {  # the adapter's addresses, by hand
    "台灣台北市108臺北市萬華區成都路10巷35-37號": ("臺北市", "萬華區"), "106大安區大學里新生南路三段60巷7號": ("臺北市", "大安區"), "松山文創園區 巴洛克花園（臺北市信義區光復南路）": ("臺北市", "信義區"),
    "No. 7, Da’an District, Ta": ("臺北市", "大安區"), "Xinyi District, Keelung City": (None, "信義區"), "新北市板橋區縣民大道": ("新北市", "板橋區"), "桃園市中壢區中正路": ("桃園市", "中壢區"),
    "10 Orchard Rd, Singapore": (None, None), "New Taipei City, Tamsui Dist.": ("新北市", "淡水區"), "Taipei City Hall": ("臺北市", None), "中國文化大學": (None, None), "高雄市前金區中正路": ("高雄市", "前金區"),
}


def _case(col, pairs):
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {col} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in pairs.items()) + " END"


@R.add("p5_p6_locations", f"WITH {LISTINGS_CTE} SELECT uid, {_case('address', {k: v[0] for k, v in PLACES.items()})} AS city, {_case('address', {k: v[1] for k, v in PLACES.items()})} AS district FROM listings")
def p5(spark, sf):
    return listings(spark, sf).withColumn("p", N.parse_location(F.col("address"))).select("uid", "p.city", "p.district")


VENUES = {
    "國家兩廳院": ("臺北市", "中正區", "國家兩廳院"), "臺中市中山堂": ("臺中市", None, "臺中市中山堂"), "Da An Park Playground / Gym": ("臺北市", "大安區", "Da An Park Playground / Gym"), "地點：卡米地": ("臺北市", "中正區", "卡米地"),
    "大眾運輸：捷運新店站": (None, None, None), "https://maps.example.org/x": (None, None, None), "Taipei 101 Mall": ("臺北市", "信義區", "Taipei 101 Mall"), "花蓮文創": ("花蓮縣", None, "花蓮文創"),
    "MOJO 1921 咖啡廳：捷運中山站出來以後一直走到底再左轉就可以看到我們的招牌了如果找不到請打電話給我們我們會派人出來接您謝謝大家的支持與愛護": (None, None, "MOJO 1921 咖啡廳"), "新北市圖書館": ("新北市", None, "新北市圖書館"),
    "Unknown Hall": (None, None, "Unknown Hall"),
}


@R.add("p8_place_lookup", f"WITH {LISTINGS_CTE} SELECT uid, {_case('venue', {k: v[0] for k, v in VENUES.items()})} AS city, {_case('venue', {k: v[1] for k, v in VENUES.items()})} AS district FROM listings")
def p8(spark, sf):
    return listings(spark, sf).withColumn("p", N.place_lookup(F.col("venue"))).select("uid", "p.city", "p.district")


@R.add("p9_clean_venue", f"WITH {LISTINGS_CTE} SELECT uid, {_case('venue', {k: v[2] for k, v in VENUES.items()})} AS venue FROM listings")
def p9(spark, sf):
    return listings(spark, sf).select("uid", N.clean_venue(F.col("venue")).alias("venue"))


_DF = "lower(concat_ws(' ', title, description, price_text))"


@R.add("p10_detect_free", f"WITH {LISTINGS_CTE} SELECT uid, CASE WHEN regexp_matches({_DF}, '免費|免票|自由入場|free entry|free admission|no charge') THEN true WHEN regexp_matches({_DF}, '票價|售票|元|nt\\$|ntd|\\$|費用|報名費') THEN false END AS free FROM listings")
def p10(spark, sf):
    return listings(spark, sf).select("uid", N.detect_free(F.col("title"), F.col("description"), F.col("price_text")).alias("free"))


@R.add("p11_strip_html", r"SELECT page_id, nullif(substr(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 500), '') AS text FROM pages")
def p11(spark, sf):
    return read(spark, sf, "pages").select("page_id", N.strip_html(F.col("html")).alias("text"))


@R.add("p22_site_tags", f"WITH {LISTINGS_CTE}, t AS (SELECT *, list_filter(string_split(tags_text, ','), lambda x: x <> '') AS tags FROM listings) SELECT uid, array_to_string(CASE WHEN ({_LATIN} OR trim(coalesce(title_en, '')) <> '') AND NOT list_contains(tags, 'lang:en') THEN tags || ['lang:en'] ELSE tags END, ',') AS tags FROM t")
def p22(spark, sf):
    return listings(spark, sf).select("uid", F.array_join(N.site_tags(F.col("tags"), F.col("title"), F.col("title_en")), ",").alias("tags"))


_NAMES = {**rules.TAIPEI, **rules.NEW_TAIPEI, "大安區": "Da'an"}
_AREA = f"nullif(concat_ws(', ', coalesce({_case('district', _NAMES)}, district), coalesce({_case('city', rules.CITY_NAMES)}, city)), '')"
_WHERE = f"concat_ws(' · ', coalesce(venue, address), {_AREA})"


@R.add("p31_labels", f"""WITH {LISTINGS_CTE} SELECT uid, CASE WHEN is_free OR regexp_matches(coalesce(price_text, ''), '(?i)^(免費|free)$') THEN 'Free' WHEN is_free = false THEN coalesce(price_text, 'Paid') ELSE coalesce(price_text, 'Price not listed') END AS price,
  CASE WHEN starts_at IS NULL THEN 'Date not listed' ELSE strftime(substr(starts_at, 1, 19)::TIMESTAMP, '%a %-d %b') || CASE WHEN substr(starts_at, 12, 5) = '00:00' THEN '' ELSE ' · ' || substr(starts_at, 12, 5) END END AS "when",
  CASE WHEN list_contains(string_split(tags_text, ','), 'online') THEN 'Online' WHEN {_WHERE} <> '' THEN {_WHERE} ELSE 'Location not listed' END AS "where", {_AREA} AS area,
  CASE WHEN regexp_matches(trim(venue), '(?i)^https?://') THEN trim(venue) END AS link FROM listings""")  # fmt: skip
def p31(spark, sf):
    return listings(spark, sf).select("uid", N.price_label().alias("price"), N.when_label().alias("when"), N.where_label().alias("where"), N.area_label(F.col("district"), F.col("city")).alias("area"), N.safe_url(F.col("venue")).alias("link"))


@R.add("p32_public_summary", f"WITH {REFRESHED_CTE} SELECT uid, title, coalesce(district, 'unknown') AS district, coalesce(is_free::VARCHAR, 'unknown') AS is_free, coalesce(price_text, 'unknown') AS price_text, list_contains(tags, 'lang:en') AS english, list_contains(tags, 'online') AS online FROM fresh")
def p32(spark, sf):
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    return fresh(spark, sf).select("uid", "title", known("district"), known("is_free"), known("price_text"), F.array_contains("tags", "lang:en").alias("english"), F.array_contains("tags", "online").alias("online"))


@R.add("p33_languages", f"WITH {LISTINGS_CTE} SELECT uid, array_to_string(list_transform(list_filter(string_split(tags_text, ','), lambda t: starts_with(t, 'lang:')), lambda t: CASE substr(t, 6) WHEN 'en' THEN 'English' WHEN 'ja' THEN 'Japanese' WHEN 'zh' THEN 'Mandarin' ELSE substr(t, 6) END), ',') AS languages FROM listings")
def p33(spark, sf):
    return listings(spark, sf).select("uid", F.array_join(N.languages(F.col("tags")), ",").alias("languages"))


@R.add("p25_page_dates", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '2023-11-30' END AS updated FROM documents")
def p25(spark, sf):
    marks = ["更新日期：113-03-05", "Last updated: 2023-11-30", "更新日期：113-02-31", "nothing"]
    return spark.sql(f"SELECT doc_id, concat(text, '\n', {pick(marks, 'doc_id')}) AS text FROM {{d}}", d=read(spark, sf, "documents")).select("doc_id", N.found_updated(F.col("text")).cast("string").alias("updated"))


# ---- time windows

_WIN = "t AS (SELECT DATE '1999-06-16' AS d), w(name, start, \"end\") AS (SELECT * FROM (VALUES ('today','1999-06-16T00:00:00+08:00','1999-06-16T23:59:59+08:00'),('tonight','1999-06-16T17:00:00+08:00','1999-06-16T23:59:59+08:00'),('tomorrow','1999-06-17T00:00:00+08:00','1999-06-17T23:59:59+08:00'),('weekend','1999-06-19T00:00:00+08:00','1999-06-20T23:59:59+08:00'),('nextWeekend','1999-06-26T00:00:00+08:00','1999-06-27T23:59:59+08:00'),('week','1999-06-16T00:00:00+08:00','1999-06-20T23:59:59+08:00'),('nextWeek','1999-06-21T00:00:00+08:00','1999-06-27T23:59:59+08:00'),('month','1999-06-16T00:00:00+08:00','1999-06-30T23:59:59+08:00'),('next7','1999-06-16T00:00:00+08:00','1999-06-22T23:59:59+08:00'),('next30','1999-06-16T00:00:00+08:00','1999-07-15T23:59:59+08:00')))"


@R.add("f5_j7_time_windows", f"WITH {REFRESHED_CTE}, {_WIN} SELECT name, start, \"end\", count(*)::BIGINT AS n FROM w JOIN fresh ON s BETWEEN start::TIMESTAMPTZ AND \"end\"::TIMESTAMPTZ GROUP BY ALL")
def f5(spark, sf):
    frames = W.windows(spark, NOW)
    n = W.in_windows(fresh(spark, sf), frames).groupBy("name").agg(F.count("*").alias("n"))
    return frames.join(n, "name")


@R.add("f5_month_windows", f"WITH {REFRESHED_CTE}, m AS (SELECT i AS month, make_date(CASE WHEN i < 6 THEN 2000 ELSE 1999 END, i, 1) AS d FROM range(1, 13) r(i)), w AS (SELECT month, CASE WHEN month = 6 THEN DATE '1999-06-16' ELSE d END::VARCHAR || 'T00:00:00+08:00' AS start, last_day(d)::VARCHAR || 'T23:59:59+08:00' AS \"end\" FROM m) SELECT month::INT AS month, count(*)::BIGINT AS n FROM w JOIN fresh ON s BETWEEN start::TIMESTAMPTZ AND \"end\"::TIMESTAMPTZ GROUP BY 1")
def f5b(spark, sf):
    frames = W.month_windows(spark, NOW).withColumn("name", F.col("month").cast("string"))
    return W.in_windows(fresh(spark, sf), frames).groupBy(F.col("name").cast("int").alias("month")).agg(F.count("*").alias("n"))


_PICK = """(CASE WHEN list_contains(tags, 'lang:en') THEN 2 ELSE 0 END + CASE WHEN list_contains(tags, 'online') THEN 0 ELSE 1 END + CASE WHEN is_free IS NOT NULL OR coalesce(price_text, '') <> '' THEN 0.5 ELSE 0 END
  + CASE WHEN coalesce(venue, '') <> '' OR coalesce(address, '') <> '' THEN 0.5 ELSE 0 END + CASE WHEN coalesce(description, '') <> '' THEN 0.25 ELSE 0 END)"""
_WANTED = "status = 'upcoming' AND coalesce(feedback, '') <> 'not_my_thing'"


@R.add("w6_w7_weekend_picks", f"""WITH {REFRESHED_CTE}, {_WIN}, h AS (SELECT f.*, w.name FROM fresh f JOIN w ON s BETWEEN w.start::TIMESTAMPTZ AND w."end"::TIMESTAMPTZ WHERE {_WANTED} AND w.name IN ('weekend', 'next7')),
c AS (SELECT CASE WHEN count(*) FILTER (name = 'weekend') >= 3 THEN 'weekend' ELSE 'next7' END AS chosen FROM h),
p AS (SELECT h.*, row_number() OVER (ORDER BY {ORDER}) - 1 AS pos FROM h JOIN c ON name = chosen WHERE NOT list_contains(tags, 'online'))
SELECT uid, round({_PICK}::DOUBLE - 0.002::DOUBLE * pos, 6) AS score FROM p ORDER BY score DESC, pos LIMIT 6""")  # fmt: skip
def w6(spark, sf):
    return W.picks(fresh(spark, sf), NOW, L.order())


_SIMILAR = f"""b AS (SELECT uid, type, {TITLE_KEY} AS t, title, starts_at, coalesce(starts_at, '9999') AS at_, coalesce(district, '') AS district, list_contains(tags, 'lang:en') AS english, status, feedback FROM fresh),
k AS (SELECT DISTINCT type, t, district FROM b), o AS (SELECT * FROM b WHERE {_WANTED}),
p AS (SELECT k.*, o.uid AS other, row_number() OVER (PARTITION BY k.type, k.t, k.district ORDER BY o.at_, o.uid) - 1 AS pos, CASE WHEN k.district = o.district AND o.district <> '' THEN 1 ELSE 0 END + CASE WHEN english THEN 0.5 ELSE 0 END AS x
  FROM k JOIN o ON k.type = o.type AND k.t <> o.t), q AS (SELECT *, round(x::DOUBLE - 0.01::DOUBLE * pos, 6) AS score FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY type, t, district ORDER BY score DESC, pos) AS nth FROM q), z AS (SELECT b.uid, other, score, nth::INT AS nth FROM b JOIN n USING (type, t, district) WHERE nth <= 8)"""


@R.add("j12_similar", f"WITH {REFRESHED_CTE}, {_SIMILAR} SELECT * FROM z WHERE nth <= 4")
def j12(spark, sf):
    return W.similar(fresh(spark, sf))


@R.add("w10_similar_list", f"""WITH {REFRESHED_CTE}, {_SIMILAR}, d AS (SELECT z.*, coalesce(b.starts_at, '') AS at_, row_number() OVER (PARTITION BY z.uid, substr(coalesce(b.starts_at, ''), 1, 10), substr(coalesce(b.title, ''), 1, 12) ORDER BY nth) AS again FROM z JOIN b ON b.uid = z.other),
e AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY nth) AS kept FROM d WHERE again = 1) SELECT uid, other, (row_number() OVER (PARTITION BY uid ORDER BY at_, nth) - 1)::INT AS place FROM e WHERE kept <= 4""")  # fmt: skip
def w10(spark, sf):
    return W.similar_list(fresh(spark, sf))


# ---- search

PHRASES = ["free jazz this weekend in taipei", "english hiking tomorrow", "tonight", "語言交換 今晚", "in-person workshop new taipei", "coffee tasting next week", "what events can I do for free?", "yoga today", "market", "conversation english-friendly"]
PARSED = [
    ("weekend", True, False, False, None, "jazz"), ("tomorrow", False, True, False, None, "hiking"), ("tonight", False, False, False, None, ""), ("tonight", False, False, False, None, "語言交換"),
    (None, False, False, True, "新北市", "workshop"), ("nextWeek", False, False, False, None, "coffee tasting"), (None, True, False, False, None, ""), ("today", False, False, False, None, "yoga"),
    (None, False, False, False, None, "market"), (None, False, True, False, None, "conversation"),
]


def _parsed_sql():
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return ", ".join(f"({i}, {', '.join(lit(v) for v in p)})" for i, p in enumerate(PARSED))


PARSED_CTE = f"pq(q, when_key, free, english, in_person, city, tokens) AS (SELECT * FROM (VALUES {_parsed_sql()}))"


def phrases(spark, sf):
    """A table of search phrases, one for each customer."""
    return spark.sql(f"SELECT c_custkey AS k, {pick(PHRASES, 'c_custkey')} AS raw FROM {{c}}", c=read(spark, sf, "customer"))


@R.add("f9_parse_phrases", f"WITH {PARSED_CTE} SELECT c_custkey AS k, when_key, free, english, in_person, pq.city, tokens FROM customer JOIN pq ON q = c_custkey % {len(PHRASES)}")
def f9(spark, sf):
    return S.parse_queries(phrases(spark, sf), topics=False).select("k", "when_key", "free", "english", "in_person", "city", F.array_join("tokens", " ").alias("tokens"))


@R.add("f10_token_search", f"""WITH {REFRESHED_CTE}, {PARSED_CTE}, {_WIN}, m AS (SELECT q, uid, CASE WHEN tokens = '' THEN 1 WHEN len(list_filter(string_split(tokens, ' '), lambda t: contains(lower(title || ' ' || coalesce(title_en, '')), t))) > 0 THEN 2 ELSE 1 END AS hit, status, starts_at
  FROM fresh, pq LEFT JOIN w ON w.name = pq.when_key WHERE status IN ('upcoming', 'ongoing') AND coalesce(feedback, '') <> 'not_my_thing' AND (when_key IS NULL OR s BETWEEN w.start::TIMESTAMPTZ AND w."end"::TIMESTAMPTZ) AND (NOT pq.free OR is_free) AND (NOT pq.english OR list_contains(tags, 'lang:en'))
  AND (NOT in_person OR NOT list_contains(tags, 'online')) AND (pq.city IS NULL OR pq.city = fresh.city) AND (tokens = '' OR len(list_filter(string_split(tokens, ' '), lambda t: NOT contains(lower(concat_ws(' ', title, nullif(title_en, ''), description, venue, address, organizer, array_to_string(tags, ' '))), t))) = 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hit DESC, {ORDER}) AS place FROM m) SELECT q::INT AS q, uid, hit::INT AS hit, place::INT AS place FROM r WHERE place <= 20""")  # fmt: skip
def f10(spark, sf):
    asked = S.parse_queries(spark.createDataFrame(list(enumerate(PHRASES)), "q int, raw string"), topics=False)
    frames = W.windows(spark, NOW).select(F.col("name").alias("when_key"), N.instant(F.col("start")).alias("lo"), N.instant(F.col("end")).alias("hi"))
    asked = asked.join(frames, "when_key", "left").withColumnRenamed("city", "in_city").withColumnRenamed("free", "only_free")
    rows = fresh(spark, sf).filter(L.matches(NOW)).withColumn("s", N.instant(F.col("starts_at")))
    fits = F.col("when_key").isNull() | F.coalesce(F.col("s").between(F.col("lo"), F.col("hi")), F.lit(False))
    fits = fits & (~F.col("only_free") | F.coalesce("is_free", F.lit(False))) & (~F.col("english") | F.array_contains("tags", "lang:en")) & (~F.col("in_person") | ~F.array_contains("tags", "online"))
    fits = fits & (F.col("in_city").isNull() | F.coalesce(F.col("in_city") == F.col("city"), F.lit(False)))
    title = F.lower(F.concat_ws(" ", "title", F.coalesce("title_en", F.lit(""))))
    hit = F.when(F.size("tokens") == 0, 1).otherwise(S.hits(L.search_blob(with_address=True), title, F.col("tokens")))
    found = rows.join(F.broadcast(asked), fits).withColumn("hit", hit).filter("hit is not null")  # ten phrases
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("hit"), *L.order()))
    return found.withColumn("place", place).filter("place <= 20").select("q", "uid", "hit", "place")


@R.add("u4_a9_keyword_union", f"WITH {LISTINGS_CTE}, kw(i, w) AS (VALUES (0, 'jazz'), (1, 'yoga'), (2, 'english'), (3, 'jazz'), (4, 'coffee')), d AS (SELECT w, min(i) AS i FROM kw GROUP BY 1), h AS (SELECT uid, w, i, row_number() OVER (PARTITION BY w ORDER BY uid) AS nth FROM listings JOIN d ON contains(lower(title), w)) SELECT uid, string_agg(w, ',' ORDER BY i) AS keywords FROM h WHERE nth <= 25 GROUP BY 1")
def u4(spark, sf):
    words = spark.createDataFrame(list(enumerate(["jazz", "yoga", "english", "jazz", "coffee"])), "i int, w string").groupBy("w").agg(F.min("i").alias("i"))
    hits = listings(spark, sf).join(F.broadcast(words), F.lower("title").contains(F.col("w")))  # five words
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("w").orderBy("uid"))).filter("nth <= 25")
    return hits.groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), ",").alias("keywords"))


@R.add("o4_w9_section_search", """WITH s AS (SELECT doc_id, source, lower(split_part(text, chr(10), 1)) AS h, lower(text) AS t FROM documents), k(t0) AS (VALUES ('the'), ('le'), ('der')),
c AS (SELECT doc_id, source, sum(least(3, (length(h) - length(replace(h, t0, ''))) // length(t0)) * 4 + least(3, (length(t) - length(replace(t, t0, ''))) // length(t0)) * 1.0)::DOUBLE AS total, count(*) FILTER (contains(h, t0) OR contains(t, t0)) AS hit FROM s, k GROUP BY 1, 2),
r AS (SELECT doc_id, source, total * (1 + hit::DOUBLE / 3) AS score FROM c WHERE total > 0), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS nth FROM r) SELECT doc_id, source, round(score, 6) AS score FROM b WHERE nth = 1 ORDER BY score DESC, doc_id LIMIT 6""")  # fmt: skip
def o4(spark, sf):
    tokens = F.array(*[F.lit(t) for t in ("the", "le", "der")])
    rows = read(spark, sf, "documents").select("doc_id", "source", F.lower(F.split("text", "\n")[0]).alias("h"), F.lower("text").alias("t"))
    none = F.lit("")
    rows = rows.withColumn("score", S.section_score(F.col("h"), none, none, F.col("t"), F.lit(False), tokens)).filter("score > 0")
    best = rows.groupBy("source").agg(F.min_by(F.struct("doc_id", "score"), F.struct(-F.col("score"), "doc_id")).alias("b")).select("b.doc_id", "source", "b.score")
    return best.orderBy(F.desc("score"), "doc_id").limit(6).select("doc_id", "source", F.round("score", 6).alias("score"))


@R.add("g3_synonyms", "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'gold card,special professional,就業金卡,incentive,gold,card' WHEN 1 THEN 'rent,rental,my' ELSE 'refund,refunds,退稅,file,filing,return,late' END AS tokens FROM customer")
def g3(spark, sf):
    rows = spark.sql(f"SELECT c_custkey AS k, {pick(['gold card', 'my rent', 'file refund late'], 'c_custkey')} AS raw FROM {{c}}", c=read(spark, sf, "customer"))
    got = S.expand(F.split("raw", " "))
    # order is that of the synonym table, then of the phrase; the phrase "gold" stands for "gold card" as well
    return rows.select("k", F.array_join(got, ",").alias("tokens"))
