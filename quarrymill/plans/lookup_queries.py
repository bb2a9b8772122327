"""Registered queries of lookups over facts, calendars, seminars, guides and search pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups
from .adapters import LISTINGS_CTE, REFRESHED_CTE, listings, read
from .listing_queries import fresh
from .registry import Registry
from .search_queries import doc_guides

R = Registry()

# ---- facts: one a document, with its source and language as topics and a year or none; requests: one a nation, of every mix of conditions

FACTS = "SELECT doc_id, concat('f', cast(doc_id AS string)) AS id, source, lang, CASE WHEN doc_id % 3 > 0 THEN cast(2024 + doc_id % 2 AS int) END AS year FROM"
ASKED = """SELECT cast(n_nationkey AS int) AS q, CASE WHEN n_nationkey % 4 = 0 THEN array('f1', 'f2', concat('f', cast(n_nationkey AS string)), 'nowhere') WHEN n_nationkey % 4 = 1 THEN array() END AS ids,
  CASE WHEN n_nationkey % 3 = 0 THEN concat('src', cast(n_nationkey % 5 AS string)) WHEN n_nationkey % 3 = 1 THEN '' WHEN n_nationkey > 12 THEN 'en' END AS topic, CASE n_nationkey % 5 WHEN 0 THEN 2024 WHEN 1 THEN 2025 WHEN 2 THEN 0 WHEN 3 THEN 1999 END AS year FROM"""


@R.add("f11_asked_facts", f"""WITH f AS ({FACTS.replace('string', 'varchar')} documents), a AS ({ASKED.replace('array(', 'list_value(').replace('AS string', 'AS varchar')} nation)
SELECT q, id, f.year FROM a JOIN f ON (coalesce(len(ids), 0) = 0 OR list_contains(ids, id)) AND (coalesce(topic, '') = '' OR coalesce(topic = source, false) OR coalesce(topic = lang, false)) AND (coalesce(a.year, 0) = 0 OR f.year IS NULL OR f.year = a.year)""")  # fmt: skip
def f11(spark, sf):
    facts = spark.sql(f"{FACTS} {{d}}", d=read(spark, sf, "documents")).select("id", F.array("source", "lang").alias("topics"), "year")
    asked = spark.sql(f"{ASKED} {{n}}", n=read(spark, sf, "nation")).withColumn("ids", F.col("ids").cast("array<string>"))
    return lookups.find_facts(facts, asked).select("q", "id", "year")


# ---- calendars: one a customer's market segment and order priority, of orders; some last, some share a day


@R.add("o5_calendar_labels", """WITH c AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_custkey % 50 AS g, CASE WHEN o_orderkey % 19 > 0 THEN o_orderdate::DATE END AS d, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE + 5 END AS e FROM orders),
l AS (SELECT *, arg_min(k, (d, k)) FILTER (coalesce(e, d) >= DATE '1998-06-16' AND d IS NOT NULL) OVER (PARTITION BY p, g) AS next FROM c),
m AS (SELECT *, coalesce(k = next, false) AS is_next, datediff('day', DATE '1998-06-16', d)::INT AS away FROM l)
SELECT k, CASE WHEN coalesce(coalesce(e, d) < DATE '1998-06-16', false) THEN 'past' WHEN is_next THEN 'next' ELSE 'upcoming' END AS label, CASE WHEN is_next THEN away END AS days,
  CASE WHEN NOT is_next THEN NULL WHEN e IS NOT NULL AND away <= 0 THEN 'Happening now' WHEN away = 0 THEN 'Today' WHEN away = 1 THEN 'Tomorrow' WHEN away < 60 THEN 'In ' || away || ' days' ELSE strftime(d, '%-d %b %Y') END AS when_label FROM m""")  # fmt: skip
def o5(spark, sf):
    day = F.to_date("o_orderdate")
    items = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 50).alias("g"), F.when(F.col("o_orderkey") % 19 > 0, day).alias("date"), F.when(F.col("o_orderkey") % 4 == 0, F.date_add(day, 5)).alias("end"),
    )
    return lookups.calendar(items, F.lit("1998-06-16").cast("date"), ["p", "g"]).select(F.col("pos").alias("k"), "label", "days", "when_label")


@R.add("o6_listings_of_tags", f"""WITH {REFRESHED_CTE}, t AS (SELECT DISTINCT unnest(tags) AS tag, uid, starts_at, status FROM fresh), w AS (SELECT * FROM t WHERE tag IN ('online', 'lang:ja', 'kw:jazz'))
SELECT tag, 'open' AS part, uid, starts_at FROM w WHERE status IN ('upcoming', 'ongoing')
UNION ALL SELECT tag, 'last', uid, starts_at FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY coalesce(starts_at, '') DESC, uid) AS nth FROM w WHERE status = 'expired') WHERE nth = 1""")  # fmt: skip
def o6(spark, sf):
    return lookups.of_tag(fresh(spark, sf), spark.createDataFrame([("online",), ("lang:ja",), ("kw:jazz",), ("nowhere",)], "tag string"))


FIGURES = ["src3", "src1_{year}", "src9_{year}", "nowhere", "src0_{year}", "src2"]


@R.add("o7_figures_of_years", f"""WITH f AS (SELECT source || CASE WHEN doc_id % 2 = 0 THEN '_' || (2020 + doc_id % 6) ELSE '' END AS id, count(*)::BIGINT AS n FROM documents GROUP BY 1),
y AS (SELECT DISTINCT 2020 + doc_id % 6 AS year FROM documents), w AS (SELECT year::INT AS year, unnest({FIGURES}) AS k, generate_subscripts({FIGURES}, 1) AS i FROM y)
SELECT year, row_number() OVER (PARTITION BY year ORDER BY i)::INT AS place, id, n FROM w JOIN f ON id = replace(k, '{{year}}', year::VARCHAR)""")  # fmt: skip
def o7(spark, sf):
    d = read(spark, sf, "documents").withColumn("year", (2020 + F.col("doc_id") % 6).cast("int"))
    facts = d.groupBy(F.concat("source", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("_"), F.col("year").cast("string"))).otherwise("")).alias("id")).agg(F.count("*").alias("n")).filter("id is not null")
    return lookups.key_figures(facts, d.select("year"), FIGURES)


# A section of ``doc_guides`` has 36 words whatever its document: 2 of its id and keywords, 7 of p, 4 of list, 3 of steps, 6 of faq, 4 of callout,
# 4 of table, 2 of stats, 2 of facts and 2 of cite; the rest are counted.
@R.add("a10_guide_minutes", r"""WITH d AS (SELECT doc_id // 7 AS pos, regexp_replace(coalesce(text, ''), '[*`{}\[\]]', ' ', 'g') AS body, string_split(coalesce(text, ''), chr(10))[1] AS heading, lang, source FROM documents),
n AS (SELECT pos, sum(FIXED + len(regexp_extract_all(body, 'WORD')) + len(regexp_extract_all(heading, 'WORD')) + CASE WHEN lang IS NULL THEN 0 ELSE len(regexp_extract_all(lang, 'WORD')) END + len(regexp_extract_all('What is ' || coalesce(source, '-') || '?', 'WORD')) + len(regexp_extract_all('of ' || coalesce(lang, '-'), 'WORD')))::BIGINT AS words FROM d GROUP BY 1)
SELECT 'g' || pos AS slug, words, greatest(2, round_even(words / 220, 0))::BIGINT AS minutes FROM n""".replace("FIXED", "36").replace("WORD", r"[^\s\x0B\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"))  # fmt: skip
def a10(spark, sf):
    return lookups.reading_minutes(doc_guides(spark, sf))


@R.add("a11_coverage_by_source", f"WITH {LISTINGS_CTE}, g AS (SELECT source_platform, venue, address, district, count(*) AS n FROM listings GROUP BY ALL) SELECT source_platform, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (district IS NOT NULL), 0)::BIGINT AS resolved, (coalesce(sum(n) FILTER (district IS NOT NULL), 0) * 100 // sum(n))::BIGINT AS percent FROM g GROUP BY 1")
def a11(spark, sf):
    g = listings(spark, sf).groupBy("source_platform", "venue", "address", "district").agg(F.count("*").alias("n"))
    return lookups.resolved_share(g, F.col("district").isNotNull(), F.col("n"), ["source_platform"])


# ---- search pages: a document is a page of one of forty keywords, its long words are the ids

PAGES = "SELECT cast(doc_id % 40 AS int) AS pos, concat('k', cast(doc_id % 40 AS string)) AS keyword, doc_id AS page, text AS html FROM"


@R.add("a9_discovered_ids", f"""WITH p AS ({PAGES.replace('AS string', 'AS varchar')} documents), w AS (SELECT pos, keyword, page, unnest(regexp_extract_all(coalesce(html, ''), '([a-z]{{5,}})', 1)) AS id, generate_subscripts(regexp_extract_all(coalesce(html, ''), '([a-z]{{5,}})', 1), 1) AS nth FROM p),
f AS (SELECT pos, keyword, id, min((page, nth)) AS first FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY first) AS nth FROM f)
SELECT id, string_agg(keyword, ',' ORDER BY pos) AS keywords FROM r WHERE nth <= 25 GROUP BY 1""")  # fmt: skip
def a9(spark, sf):
    got = lookups.discovered(spark.sql(f"{PAGES} {{d}}", d=read(spark, sf, "documents")), r"([a-z]{5,})")
    return got.select("id", F.array_join("keywords", ",").alias("keywords"))


@R.add("u4_keyword_order", """WITH w AS (SELECT c_custkey AS s, unnest([lower(c_mktsegment), '', 'k' || (c_custkey * 7 % 30), c_mktsegment]) AS keyword, generate_subscripts([1, 2, 3, 4], 1) AS nth FROM customer), f AS (SELECT keyword, min((s, nth)) AS place FROM w WHERE keyword <> '' GROUP BY 1)
SELECT (row_number() OVER (ORDER BY place) - 1)::INT AS pos, keyword FROM f""")  # fmt: skip
def u4(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.array(F.lower("c_mktsegment"), F.lit(""), F.concat(F.lit("k"), (F.col("c_custkey") * 7 % 30).cast("string")), F.col("c_mktsegment")).alias("keywords"))
    return lookups.keyword_union(rows)
