"""Registered queries of sources, feeds and streams: round trips over the listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators.joins import spread
from ..sources import feeds, tables
from ..streaming import jobs
from .adapters import LISTINGS_CTE, listings, read
from .listing_queries import HASH_SQL, STAMP, UPSERT_CTE, stored_and_batch
from .registry import Registry

R = Registry()
BASIC = ["source_platform", "source_id", "source_url", "title", "type", "status", "starts_at", "city", "price_text"]
SELECT = ", ".join(["uid", *BASIC])


@R.add("s1_s2_listings_table", f"WITH {LISTINGS_CTE} SELECT {SELECT} FROM listings")
def s1(spark, sf):
    rows = listings(spark, sf)
    path = tables.scratch(spark, "listings")
    tables.write_listings(rows.select("uid", *[f for f in tables.LISTING.names if f in rows.columns]).withColumn("unknown", F.lit(1)), path, compression="gzip")
    return tables.read_listings(spark, path).select("uid", *BASIC)


@R.add("s6_parquet_export", f"WITH {LISTINGS_CTE} SELECT {SELECT} FROM listings WHERE k % 2 = 0")
def s6(spark, sf):
    return exported(spark, sf).filter("k % 2 = 0").select("uid", *BASIC)


def exported(spark, sf):
    """Every listing, out of the export; the query shows those of its SQL."""
    path = tables.scratch(spark, "export")
    tables.write_listings(listings(spark, sf), path, "parquet")
    return spark.read.parquet(path)


SESSION_SQL = """SELECT 'taiwan_pathfinder' AS source_platform, 'RiverTracing' || '-' || substr(o_orderdate::VARCHAR, 1, 10) AS source_id, 'River Tracing' AS title, substr(o_orderdate::VARCHAR, 1, 10) || 'T00:00:00+08:00' AS starts_at, substr(o_orderdate::VARCHAR, 1, 10) || 'T23:59:59+08:00' AS ends_at,
  CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 = 1 END AS is_free, CASE o_orderkey % 4 WHEN 1 THEN 'NT$0' WHEN 0 THEN NULL ELSE 'NT$1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') END AS price_text, CASE WHEN o_orderkey % 9 = 0 THEN 'cancelled' ELSE 'upcoming' END AS status, 'src:openForBooking' || CASE WHEN o_orderkey % 3 = 0 THEN ',signup:open' ELSE '' END || CASE WHEN o_orderkey % 9 = 0 THEN ',final:Cancelled' ELSE '' END AS tags FROM orders WHERE o_orderkey % 8 < 4"""


@R.add("s3_p16_csv_sessions", SESSION_SQL)
def s3(spark, sf):
    return sessions(spark, sf).filter("k % 8 < 4").drop("k")


def sessions(spark, sf):
    """The listings of every session, with the order's key k; the query shows those of its SQL."""
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    price = F.when(k % 4 == 1, "NT$0").when(k % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("NT$1,"), F.lpad((k % 1000).cast("string"), 3, "0")))
    none = F.lit(None).cast("string")
    rows = o.select(F.lit(" River Tracing ").alias("type_zh"), F.lit("River Tracing").alias("type_en"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("date"), none.alias("list_price"), none.alias("early_2m"), none.alias("early_1m"), F.concat(F.lit("https://f.example.org/"), k.cast("string")).alias("form"), none.alias("state"), F.when(k % 3 == 0, "open").alias("signup"), price.alias("price"), none.alias("blank"), F.when(k % 9 == 0, "Cancelled").alias("final"))
    path = tables.scratch(spark, "csv")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    got = feeds.from_sessions(tables.read_csv_feed(spark, path, feeds.SESSIONS).filter("shifted is null").drop("shifted"))
    key = F.regexp_extract("source_url", r"(\d+)$", 1).cast("long").alias("k")
    return got.select("source_platform", "source_id", "title", "starts_at", "ends_at", "is_free", "price_text", "status", F.array_join("tags", ",").alias("tags"), key)


TOUR_SQL = f"""WITH {LISTINGS_CTE} SELECT 'activity-' || source_id AS source_id, title, coalesce(nullif(CASE WHEN k % 2 = 0 THEN source_url ELSE '' END, ''), 'https://l.example.org/' || k) AS source_url, starts_at, substr(ends_at, 1, 10) || 'T23:59:59+08:00' AS ends_at, coalesce(organizer, 'co') AS organizer, CASE WHEN k % 3 = 0 THEN true END AS major FROM listings"""


def payloads(rows, inner, key):
    """API payloads of some rows each, as JSON text."""
    return rows.groupBy((F.col("k") % 50).alias("page")).agg(F.to_json(F.struct(F.count("*").alias("total"), F.collect_list(inner).alias(key))).alias("value"))


@R.add("s4_p15_tourism_api", TOUR_SQL)
def s4(spark, sf):
    rows = listings(spark, sf)
    inner = F.struct(F.col("source_id").alias("id"), "title", "description", F.col("starts_at").alias("begin"), F.concat(F.substring("ends_at", 1, 10), F.lit(" 00:00:00")).alias("end"), F.when(F.col("k") % 2 == 0, F.col("source_url")).otherwise("").alias("url"), F.lit("").alias("distric"), "address", "organizer", F.lit("co").alias("co_rganizer"), (F.col("k") % 3 == 0).alias("is_major"), F.array(F.struct(F.concat(F.lit("https://l.example.org/"), F.col("k").cast("string")).alias("src"))).alias("links"))
    got = feeds.from_tourism(tables.unwrap(payloads(rows, inner, "data"), feeds.TOURISM), "Activity")
    return got.select("source_id", "title", "source_url", "starts_at", "ends_at", "organizer", F.when(F.array_contains("tags", "major"), F.lit(True)).alias("major"))


@R.add("p18_trendy_api", f"WITH {LISTINGS_CTE} SELECT source_id, 'https://trendy.taipei/tw/Event/Detail?id=' || source_id AS source_url, title, CASE k % 3 WHEN 0 THEN 'music' WHEN 1 THEN 'talk' END AS type, CASE k % 3 WHEN 0 THEN 'cat:演唱會經濟' WHEN 1 THEN 'cat:產業趨勢' ELSE 'cat:x' END AS tags, starts_at FROM listings WHERE k % 3 < 2")
def p18(spark, sf):
    return trendy(spark, sf).filter("cast(source_id as long) % 3 < 2")


def trendy(spark, sf):
    """The listings of every row of the payloads; the query shows those of its SQL, a third has no category of a known type."""
    rows = listings(spark, sf)
    inner = F.struct(F.col("source_id").alias("id"), "title", F.when(F.col("k") % 3 == 0, "演唱會經濟").when(F.col("k") % 3 == 1, "產業趨勢").otherwise("x").alias("categoryName"), F.col("address").alias("location"), F.col("starts_at").alias("startDate"), F.col("ends_at").alias("endDate"), F.col("description").alias("content"), F.col("organizer").alias("departmentName"))
    got = feeds.from_trendy(tables.unwrap(payloads(rows, inner, "result"), feeds.TRENDY, ("result",)))
    return got.select("source_id", "source_url", "title", "type", F.array_join("tags", ",").alias("tags"), "starts_at")


@R.add("p17_talent_api", f"WITH {LISTINGS_CTE} SELECT 's' || k AS source_id, title, title_en, starts_at, ends_at, online FROM (SELECT k, title, 'Tax talk' AS title_en, substr(starts_at, 1, 19) || '+08:00' AS starts_at, substr(starts_at, 1, 10) || 'T23:30:00+08:00' AS ends_at, k % 4 = 0 AS online FROM listings WHERE starts_at IS NOT NULL AND (k % 4 = 0 OR k % 5 > 0))")
def p17(spark, sf):
    rows = listings(spark, sf).filter("starts_at is not null")
    both = lambda en, zh: F.struct(en.alias("en"), zh.alias("zh"))
    place = F.when(F.col("k") % 5 == 0, "Kaohsiung Center").otherwise("Taipei Hall")
    inner = F.struct(F.concat(F.lit("s"), F.col("k").cast("string")).alias("slug"), both(F.lit("Tax talk"), F.col("title")).alias("title"), both(F.col("description"), F.lit("")).alias("contents"), F.substring("starts_at", 1, 10).alias("date"), F.substring("starts_at", 12, 8).alias("start_time"), F.lit("23:30").alias("end_time"), both(place, F.lit("")).alias("location"), F.when(F.col("k") % 4 == 0, "Online").otherwise("onsite").alias("format"), F.lit("free").alias("fee"))
    got = feeds.from_talent(tables.unwrap(payloads(rows, inner, "data"), feeds.TALENT))
    return got.select("source_id", "title", "title_en", "starts_at", "ends_at", F.array_contains("tags", "online").alias("online"))


def marked_up(rows, wrap):
    """Pages that hold listings as schema.org markup, in one of its shapes."""
    day = F.concat(F.substring("starts_at", 1, 10), F.lit("T00:00:00Z"))
    place = F.struct(F.lit("Place").alias("@type"), F.lit("Unknown Hall").alias("name"), F.struct(F.lit("PostalAddress").alias("@type"), F.lit("No. 1, Xinyi District").alias("streetAddress"), F.lit("Taipei City").alias("addressLocality")).alias("address"))
    offers = F.array(F.struct((F.col("k") % 3 * 100).alias("price"), F.lit("TWD").alias("priceCurrency")), F.struct((F.col("k") % 3 * 100 + F.col("k") % 2 * 50).alias("price"), F.lit("TWD").alias("priceCurrency")))
    node = F.struct(F.lit("MusicEvent").alias("@type"), F.col("title").alias("name"), day.alias("startDate"), F.col("uid").alias("url"), F.lit("https://schema.org/EventCancelled").alias("eventStatus"), place.alias("location"), offers.alias("offers"), F.struct(F.lit("Org").alias("name")).alias("organizer"))
    text = F.to_json(wrap(node))
    return rows.withColumn("html", F.concat(F.lit('<html><script type="application/ld+json">not json</script><script type="application/ld+json">'), text, F.lit("</script><p>x</p></html>")))


MARKUP_SQL = f"""WITH {LISTINGS_CTE} SELECT uid, title, CASE WHEN starts_at IS NOT NULL THEN substr(starts_at, 1, 10) || 'T08:00:00+08:00' END AS starts_at, 'cancelled' AS status, 'No. 1, Xinyi District, Taipei City' AS address, '信義區' AS district, '臺北市' AS city, 'Org' AS organizer,
  CASE WHEN k % 2 = 0 THEN 'TWD ' || (k % 3 * 100) ELSE 'TWD ' || (k % 3 * 100) || '–' || (k % 3 * 100 + 50) END AS price_text, k % 3 = 0 AS is_free FROM listings"""


def from_markup(nodes):
    rows = nodes.withColumn("source_id", F.col("uid")).withColumn("source_url", F.col("uid"))
    got = feeds.from_jsonld(rows, "x")
    return got.select(F.col("source_id").alias("uid"), "title", "starts_at", "status", "address", "district", "city", "organizer", "price_text", "is_free")


@R.add("s5_p12_p14_jsonld_graph", MARKUP_SQL)
def s5(spark, sf):
    rows = marked_up(spread(listings(spark, sf)), lambda n: F.array(F.struct(F.lit("WebPage").alias("@type"), F.array(n).alias("@graph")))).select("uid", "html")
    nodes = feeds.events_in(feeds.jsonld_blocks(rows)).withColumn("node", F.parse_json("node"))
    return from_markup(nodes)


@R.add("p13_itemlist", MARKUP_SQL)
def p13(spark, sf):
    rows = marked_up(spread(listings(spark, sf)), lambda n: F.struct(F.lit("ItemList").alias("@type"), F.array(F.struct(F.lit("ListItem").alias("@type"), n.alias("item"))).alias("itemListElement"))).select("uid", "html")
    return from_markup(feeds.listed_events(feeds.jsonld_blocks(rows)))


@R.add("p29_detail_fields", f"WITH {LISTINGS_CTE} SELECT uid, title || ' & more' AS about, 'two' || chr(10) || 'lines' AS note FROM listings")
def p29(spark, sf):
    rows = listings(spark, sf).select("uid", F.concat(F.lit("<h3> About </h3><div>"), "title", F.lit(" &amp; <b>more</b></div><h3>Note</h3>\n<div>two<br/>lines</div><h3>About</h3><div>again</div>")).alias("html"))
    got = feeds.detail_fields(rows)
    return got.select("uid", F.element_at("fields", "About").alias("about"), F.element_at("fields", "Note").alias("note"))


DETAIL_SQL = f"""WITH {LISTINGS_CTE}, d AS (SELECT *, CASE k % 5 WHEN 0 THEN CASE WHEN starts_at IS NULL THEN NULL ELSE '其他縣市' END WHEN 1 THEN '新北市' WHEN 2 THEN '臺北市' END AS d_city, CASE k % 5 WHEN 0 THEN CASE WHEN starts_at IS NULL THEN 'no place' ELSE 'session line' END WHEN 1 THEN 'address line' WHEN 2 THEN 'places' WHEN 3 THEN 'several places' ELSE 'no place' END AS why FROM listings)"""


def with_details(spark, sf):
    rows = listings(spark, sf)
    k = F.col("k") % 5
    line = F.concat(F.lit("高雄："), F.replace(F.substring("starts_at", 1, 10), F.lit("-"), F.lit("/")), F.lit(" 20:00\n新北：2031/01/01"))
    about = F.when(k == 0, line).when(k == 1, "hello\n地址：新北市板橋區文化路").otherwise("nothing")
    places = F.when(k == 2, "臺北市大安區和平東路1號").when(k == 3, "臺北市信義區市府路、高雄市前金區中正路").otherwise("")
    return rows, rows.select(F.col("source_url").alias("url"), F.when(k < 4, F.create_map(F.lit(feeds.ABOUT), F.coalesce(about, F.lit("")), F.lit(feeds.PLACES), places)).otherwise(F.create_map(F.lit("x"), F.lit("y"))).alias("fields"))


@R.add("p30_locate_sessions", DETAIL_SQL + " SELECT uid, d_city, CASE WHEN k % 5 = 2 THEN '臺北市大安區和平東路1號' END AS d_address, why FROM d")
def p30(spark, sf):
    rows, details = with_details(spark, sf)
    both = rows.join(details.withColumnRenamed("url", "source_url"), "source_url")
    return feeds.locate_sessions(both).select("uid", "d_city", "d_address", "why")


@R.add("j16_apply_details", DETAIL_SQL + """, n AS (SELECT *, CASE WHEN why = 'several places' THEN NULL WHEN d_city IS NOT NULL THEN d_city ELSE city END AS nc FROM d)
SELECT uid, nc AS city, CASE WHEN k % 5 = 2 THEN '大安區' WHEN nc IS NOT DISTINCT FROM city THEN district END AS district, CASE WHEN k % 5 = 2 THEN '臺北市大安區和平東路1號' ELSE address END AS address, CASE WHEN nc IS DISTINCT FROM city THEN why END AS moved FROM n WHERE nc IN ('臺北市', '新北市')""")
def j16(spark, sf):
    return feeds.apply_details(*with_details(spark, sf)).select("uid", "city", "district", "address", "moved")


@R.add("t1_streaming_upsert", f"WITH {UPSERT_CTE} SELECT uid, title, description, first_seen, last_seen, feedback FROM up")
def t1(spark, sf):
    stored, batch = stored_and_batch(spark, sf, many=True)
    path = tables.scratch(spark, "arrivals")
    batch.write.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet(path)
    return jobs.upsert_stream(stream, stored, STAMP).select("uid", "title", "description", "first_seen", "last_seen", "feedback")


@R.add("t2_streaming_sessions", "WITH e AS (SELECT user_id, epoch_ms(ts) AS at_, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOURS, true) AS new FROM events), g AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*)::BIGINT AS n FROM g GROUP BY user_id, run")
def t2(spark, sf):
    path = tables.scratch(spark, "stamps")
    rows = read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    end = rows.agg(F.lit(None).cast(rows.schema["user_id"].dataType).alias("user_id"), (F.max("ts") + F.expr("interval 30 days")).alias("ts"))
    rows.unionByName(end.filter("ts is not null")).write.parquet(path)  # a stamp of nobody ends all sessions before it
    stream = spark.readStream.schema(rows.schema).parquet(path)
    got = jobs.session_stream(stream, "user_id", "ts")
    return got.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


FETCHES = """SELECT doc_id, unnest(['2024-01-01', '2024-01-08', '2024-01-15']) AS at_, unnest([CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'ok' END, CASE WHEN doc_id % 11 = 0 THEN 'blocked' ELSE 'ok' END, 'ok']) AS status,
  unnest([CASE WHEN doc_id % 3 = 0 THEN 'old ' ELSE '' END || coalesce(text, ''), coalesce(text, ''), coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN '.' ELSE '' END]) AS body, unnest(['first', 'second', 'third']) AS title FROM documents"""
VERSIONS = f"""f AS (SELECT *, substr(sha1(body), 1, 16) AS h FROM ({FETCHES})), g AS (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY at_) AS was FROM f WHERE status = 'ok' AND body <> ''),
v AS (SELECT doc_id::VARCHAR AS id, at_ AS valid_from, CASE WHEN was IS NULL THEN 'new' ELSE 'changed' END AS outcome, h AS content_hash, title AS page_title, lead(at_) OVER (PARTITION BY doc_id ORDER BY at_) AS valid_to FROM g WHERE was IS NULL OR was <> h)"""


def fetches(spark, sf):
    """Three fetches of every document: some fail, some bring another text."""
    d, k, text = read(spark, sf, "documents"), F.col("doc_id"), F.coalesce("text", F.lit(""))
    one = lambda at, ok, body, title: F.struct(F.lit(at).alias("at"), ok.alias("status"), F.when(ok == "ok", 200).when(ok == "blocked", 403).otherwise(500).alias("http_status"), F.when(ok == "ok", body).alias("text"), F.lit(title).alias("page_title"), F.lit(None).cast("string").alias("page_updated"), F.when(ok != "ok", F.concat(F.lit("HTTP "), ok)).alias("error"))
    three = F.array(
        one("2024-01-01", F.when(k % 5 == 0, "error").otherwise("ok"), F.when(k % 3 == 0, F.concat(F.lit("old "), text)).otherwise(text), "first"), one("2024-01-08", F.when(k % 11 == 0, "blocked").otherwise("ok"), text, "second"),
        one("2024-01-15", F.lit("ok"), F.when(k % 4 == 0, F.concat(text, F.lit("."))).otherwise(text), "third"),
    )
    path = tables.scratch(spark, "fetches")
    d.select(k.cast("string").alias("id"), F.inline(three)).write.parquet(path)
    return jobs.snapshot_stream(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))


@R.add("t3_snapshot_versions", f"WITH {VERSIONS} SELECT * FROM v")
def t3_versions(spark, sf):
    return fetches(spark, sf)[1].select("id", "valid_from", "outcome", "content_hash", "page_title", "valid_to")


@R.add("t3_snapshot_index", f"""WITH {VERSIONS} SELECT doc_id::VARCHAR AS id, (SELECT min(valid_from) FROM v WHERE v.id = f.doc_id::VARCHAR) AS first_seen, max_by(h, at_) FILTER (status = 'ok' AND body <> '') AS content_hash, max_by(title, at_) FILTER (status = 'ok' AND body <> '') AS page_title,
  (SELECT max(valid_from) FROM v WHERE v.id = f.doc_id::VARCHAR) AS changed_at, max(at_) FILTER (status = 'ok' AND body <> '') AS last_ok, '2024-01-15' AS last_checked, 'ok' AS status, 200 AS http_status FROM f GROUP BY doc_id""")  # fmt: skip
def t3_index(spark, sf):
    return fetches(spark, sf)[0].select("id", "first_seen", "content_hash", "page_title", "changed_at", "last_ok", "last_checked", "status", "http_status")


@R.add("p28_article_payloads", "SELECT doc_id, 'thin' AS status FROM documents WHERE length(text) < 0 UNION ALL SELECT doc_id, 'en title' FROM documents WHERE text <> ''")
def p28(spark, sf):
    d = read(spark, sf, "documents").filter("text <> ''")
    payload = F.to_json(F.struct(F.struct(F.lit("en title").alias("en")).alias("title"), F.struct(F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("en")).alias("contents"), F.lit("2024-02-03T00:00:00").alias("updated_time")))
    got = feeds.article_texts(d.select("doc_id", payload.alias("payload")))
    return got.select("doc_id", F.col("page_title").alias("status"))


@R.add("p28_article_texts", r"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[<>&]', ' ', 'g'), '[^A-Za-z]+', ' ', 'g')) AS t FROM documents),
e AS (SELECT doc_id, CASE WHEN doc_id % 4 < 2 AND t <> '' THEN '## English：T' || doc_id || chr(10) || chr(10) || t END AS en, CASE WHEN doc_id % 4 IN (1, 2) AND t <> '' THEN '## 中文：題' || chr(10) || chr(10) || t END AS zh FROM d)
SELECT doc_id, md5(concat_ws(chr(10) || chr(10), en, zh)) AS text_md5, CASE WHEN doc_id % 4 < 2 THEN 'T' || doc_id ELSE '題' END AS page_title, CASE WHEN doc_id % 3 > 0 THEN '2024-0' || (doc_id % 9 + 1) || '-03' END AS page_updated, CASE WHEN length(concat_ws(chr(10) || chr(10), en, zh)) < 200 THEN 'thin' ELSE 'ok' END AS status FROM e""")  # fmt: skip
def p28_texts(spark, sf):
    """Bilingual articles of the letters of every document: in English, Chinese, both or neither, with and without a date."""
    k = F.col("doc_id")
    body = F.concat(F.lit("<p>"), F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " "), "[^A-Za-z]+", " ")), F.lit("</p>"))
    title = F.struct(F.when(k % 4 < 2, F.concat(F.lit("T"), k.cast("string"))).otherwise("").alias("en"), F.lit("題").alias("zh"))
    contents = F.struct(F.when(k % 4 < 2, body).otherwise("").alias("en"), F.when((k % 4).isin(1, 2), body).otherwise("").alias("zh"))
    payload = F.to_json(F.struct(title.alias("title"), contents.alias("contents"), F.when(k % 3 > 0, F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"), F.lit("-03T00:00:00"))).otherwise("").alias("updated_time")))
    return feeds.article_texts(read(spark, sf, "documents").select("doc_id", payload.alias("payload"))).select("doc_id", F.md5("text").alias("text_md5"), "page_title", "page_updated", "status")


@R.add("p28_faq_texts", r"""WITH d AS (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS t FROM documents), g AS (SELECT doc_id // 5 AS id, string_agg('## Q: q' || doc_id || chr(10) || chr(10) || t || chr(10) || chr(10) || '### 問：問' || chr(10) || chr(10) || '答', chr(10) || chr(10) ORDER BY doc_id DESC) AS text FROM d GROUP BY 1)
SELECT id, CASE WHEN id % 3 = 2 THEN md5('') ELSE md5(text) END AS text_md5, CASE WHEN id % 3 = 2 THEN 'error' WHEN length(text) < 200 THEN 'thin' ELSE 'ok' END AS status FROM g""")
def p28_faq(spark, sf):
    """Categories of five questions each, in descending order, under another category first; a third have no category that fits."""
    d = read(spark, sf, "documents").withColumn("t", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")))
    both = lambda en, zh: F.struct(en.alias("en"), F.lit(zh).alias("zh"))
    item = F.struct(F.col("doc_id").alias("id"), (-F.col("doc_id")).alias("sequence_no"), both(F.concat(F.lit("q"), F.col("doc_id").cast("string")), "問").alias("title"), both(F.concat(F.lit("<p>"), "t", F.lit("</p>")), "答").alias("contents"))
    g = d.groupBy(F.expr("doc_id div 5").alias("id")).agg(F.collect_list(item).alias("items"))  # five at most
    name = F.when(F.col("id") % 3 == 0, F.lit("All about TAX here")).when(F.col("id") % 3 == 1, F.lit("Money")).otherwise("Visa")
    cat = lambda title, slug, items: F.struct(F.lit(1).alias("id"), both(title, "類").alias("title"), slug.alias("slug"), items.alias("contents"))
    cats = F.array(cat(F.lit("Other"), F.lit("other"), F.slice("items", 1, 1)), cat(name, F.when(F.col("id") % 3 == 1, "tax").otherwise("x"), F.col("items")))
    return feeds.faq_texts(g.select("id", F.to_json(cats).alias("data")), "Tax").select("id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "status")
