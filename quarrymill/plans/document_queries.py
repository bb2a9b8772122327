"""Registered queries of the documents family: extraction, policies, snapshots, facts, guides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import guides as G
from .adapters import pick, read
from .registry import Registry

R = Registry()

EXTRACTED = ["article", "main"]


def pages(spark, sf):
    return read(spark, sf, "pages")


@R.add("p23_extract_text")
def p23(spark, sf):
    got = D.extract(pages(spark, sf), EXTRACTED)
    return got.select("page_id", "title", "selector", F.length("text").alias("chars"), F.md5("text").alias("text_md5"), F.size("links").alias("n_links"))


LINKS_SQL = r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>', 0, 's'), '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>', 0, 's'), '<a href="([^"]*)"', 1), 1) AS n FROM pages),
u AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS child_url, min(n) AS n FROM a WHERE regexp_matches(href, '^/') GROUP BY ALL) SELECT page_id, child_url, row_number() OVER (PARTITION BY page_id ORDER BY n)::INT AS pos FROM u"""


@R.add("p24_child_links", LINKS_SQL)
def p24(spark, sf):
    rows = D.extract(pages(spark, sf), ["nav"]).withColumnRenamed("page_id", "id")
    return D.child_links(rows, "^/").select(F.col("id").alias("page_id"), "child_url", "pos")


STATUS = "CASE page_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 200 END"


@R.add("p26_page_status", f"SELECT page_id, CASE WHEN {STATUS} = 403 THEN 'blocked' WHEN {STATUS} <> 200 THEN 'error' WHEN page_id % 7 = 3 THEN 'index' WHEN NOT contains(html, '<article') THEN 'error' ELSE 'ok' END AS status FROM pages")
def p26(spark, sf):
    rows = pages(spark, sf).withColumn("http_status", F.expr(STATUS)).withColumn("html", F.when(F.col("http_status") == 403, F.concat(F.lit("<title>Just a moment...</title>"), "html")).otherwise(F.col("html")))
    rows = D.extract(rows, ["article"])
    return D.page_status(rows, index_only=F.col("page_id") % 7 == 3).select("page_id", "status")


@R.add("p27_match_key", r"SELECT doc_id, md5(regexp_replace(text, '\s+', '', 'g')) AS key_md5 FROM documents")
def p27(spark, sf):
    # the documents' texts are NFKC already, so the SQL only drops white space; the tests have other texts
    return read(spark, sf, "documents").select("doc_id", F.md5(D.match_key(F.col("text"))).alias("key_md5"))


ROBOTS = [
    "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*page=\n", "# nothing\nUser-agent: other\nDisallow: /\n", "User-agent: a\nUser-agent: *\nDisallow:\nAllow: /fr\nDisallow: /fr/5$\nCrawl-delay: 2\n",
    "User-agent: *\nDisallow: /\nUser-agent: ours\nDisallow: /de/*.html$\nAllow: /de/\n",
]
HOST, PATH = "regexp_extract(url, '^https?://([^/]+)', 1)", "regexp_extract(url, '^https?://[^/]+([^#]*)', 1)"


def _fits(pattern):
    import re

    end = pattern.endswith("$")
    body = re.escape(pattern.rstrip("$") if end else pattern).replace(r"\*", ".*").replace("'", "''")
    return f"regexp_matches(path, '^{body}{'$' if end else ''}')"


RULES = [[(False, "/en/"), (True, "/en/1"), (False, "/*page=")], [], [(True, "/fr"), (False, "/fr/5$")], [(False, "/de/*.html$"), (True, "/de/")]]


def _policy_sql():
    cases = []
    for i, rules in enumerate(RULES):
        ranked = sorted(rules, key=lambda r: (-len(r[1]), not r[0]))
        cases.append(f"WHEN {i} THEN CASE " + " ".join(f"WHEN {_fits(p)} THEN {str(a).lower()}" for a, p in ranked) + " ELSE true END" if ranked else f"WHEN {i} THEN true")
    return f"WITH u AS (SELECT page_id, {HOST} AS host, {PATH} AS path FROM pages) SELECT page_id, CASE WHEN length(host) % 9 = 0 THEN false WHEN length(host) % 9 = 1 THEN true ELSE CASE length(host) % 4 {' '.join(cases)} END END AS allowed FROM u"


@R.add("f12_f13_url_policies", _policy_sql())
def f12(spark, sf):
    rows = pages(spark, sf).selectExpr("page_id", "url", f"{HOST} AS host", f"{PATH} AS path")
    files = rows.select("host").distinct().selectExpr("host", "CASE length(host) % 9 WHEN 0 THEN 503 WHEN 1 THEN 404 ELSE 200 END AS status", pick(ROBOTS, "length(host)") + " AS body")
    return D.allowed(rows, D.policy_rules(files, "ours")).select("page_id", "allowed")


# ---- snapshots

IDX = "SELECT doc_id AS id, CASE WHEN doc_id % 5 > 0 THEN substr(sha1(CASE WHEN doc_id % 3 = 0 THEN 'old ' || text ELSE text END), 1, 16) END AS content_hash, CASE WHEN doc_id % 5 > 0 THEN '2024-01-01' END AS first_seen, CASE WHEN doc_id % 5 > 0 THEN '2024-01-01' END AS changed_at, CASE WHEN doc_id % 5 > 0 THEN '2024-01-08' END AS last_ok, '2024-01-08' AS last_checked, CASE WHEN doc_id % 17 = 0 THEN 'stale' ELSE 'ok' END AS status FROM documents WHERE doc_id % 4 < 3"
FET = "SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 11 > 0 THEN text END AS text FROM documents WHERE doc_id % 4 > 0"


def snapshot_inputs(spark, sf):
    d = read(spark, sf, "documents")
    hashed = F.substring(F.sha1(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text")).cast("binary")), 1, 16)
    known = lambda v: F.when(F.col("doc_id") % 5 > 0, F.lit(v))
    index = d.filter("doc_id % 4 < 3").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 > 0, hashed).alias("content_hash"), F.lit(None).cast("int").alias("chars"), known("2024-01-01").alias("first_seen"),
        known("2024-01-01").alias("changed_at"), known("2024-01-08").alias("last_ok"), F.lit("2024-01-08").alias("last_checked"), F.when(F.col("doc_id") % 17 == 0, "stale").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("error"),
    )
    bad = F.col("doc_id") % 11 == 0
    fetched = d.filter("doc_id % 4 > 0").select(F.col("doc_id").alias("id"), F.when(bad, "error").otherwise("ok").alias("status"), F.when(~bad, F.col("text")).alias("text"), F.when(bad, "HTTP 500").alias("error"))
    return index, fetched


T3_CTE = f"""o AS ({IDX}), n AS ({FET}), b AS (SELECT coalesce(n.id, o.id) AS id, o.id IS NOT NULL AS had, n.id IS NOT NULL AS seen, coalesce(n.id IS NOT NULL AND n.status = 'ok' AND coalesce(n.text, '') <> '', false) AS good, o.content_hash AS oh, substr(sha1(n.text), 1, 16) AS nh, o.first_seen AS fs, o.changed_at AS ca, o.last_ok AS lo, o.last_checked AS lc, o.status AS os, n.status AS ns FROM o FULL JOIN n ON o.id = n.id),
r AS (SELECT id, had, seen, CASE WHEN good THEN nh ELSE oh END AS content_hash, CASE WHEN good AND oh IS DISTINCT FROM nh THEN coalesce(fs, '2024-01-15') ELSE fs END AS first_seen, CASE WHEN good AND oh IS DISTINCT FROM nh THEN '2024-01-15' ELSE ca END AS changed_at, CASE WHEN good THEN '2024-01-15' ELSE lo END AS last_ok,
  CASE WHEN seen THEN '2024-01-15' ELSE lc END AS last_checked, CASE WHEN seen THEN ns ELSE os END AS status, CASE WHEN NOT seen THEN NULL WHEN NOT good THEN ns WHEN oh IS NULL THEN 'new' WHEN oh <> nh THEN 'changed' ELSE 'unchanged' END AS outcome FROM b)"""


@R.add("t3_record_snapshots", f"WITH {T3_CTE} SELECT id, content_hash, first_seen, changed_at, last_ok, last_checked, status, outcome FROM r")
def t3(spark, sf):
    return D.record_snapshots(*snapshot_inputs(spark, sf), "2024-01-15").select("id", "content_hash", "first_seen", "changed_at", "last_ok", "last_checked", "status", "outcome")


@R.add("a7_status_tallies", f"WITH {T3_CTE} SELECT status, count(*)::BIGINT AS n, bool_and(coalesce(outcome = 'error', false)) AS all_failed FROM r GROUP BY 1")
def a7(spark, sf):
    rows = D.record_snapshots(*snapshot_inputs(spark, sf), "2024-01-15")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("outcome") == "error", F.lit(False))).alias("all_failed"))


@R.add("j10_u3_stale_and_pruned", f"WITH o AS ({IDX}), n AS ({FET}) SELECT o.id, 'stale' AS status, o.status <> 'stale' AS newly FROM o ANTI JOIN n ON o.id = n.id UNION ALL SELECT o.id, 'kept', false FROM o SEMI JOIN n ON o.id = n.id")
def j10(spark, sf):
    index, fetched = snapshot_inputs(spark, sf)
    marked = D.mark_stale(index.withColumn("status", F.col("status")), fetched)
    gone = marked.filter("status = 'stale'").join(fetched.select("id"), "id", "left_anti").select("id", "status", F.col("newly_stale").alias("newly"))
    kept = D.prune(index, marked.filter("status = 'stale'").join(fetched.select("id"), "id", "left_anti").withColumn("status", F.lit("stale")))
    return gone.unionByName(kept.select("id", F.lit("kept").alias("status"), F.lit(False).alias("newly")))


# ---- facts: two pieces of evidence for each, of which some aren't in the source, or have none


def facts(spark, sf):
    d = read(spark, sf, "documents")
    words = lambda a: F.array_join(F.slice(F.split("text", " "), a, 4), " ")
    e = lambda source, quote: F.struct(source.alias("source"), quote.alias("quote"))
    first = e(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, "not in the page").otherwise(words(1)))
    second = e(F.when(F.col("doc_id") % 9 == 0, "missing").otherwise(F.col("doc_id").cast("string")), words(2))
    rows = d.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<struct<source:string,quote:string>>")).otherwise(F.array(first, second)).alias("evidence"))
    snaps = d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"))
    index = d.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 8 == 0, "stale").otherwise("ok").alias("status"), F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("last_ok"))
    return rows, snaps, index


FACTS_SQL = """SELECT 'f' || doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN 'unchecked' WHEN doc_id % 7 = 0 THEN 'drifted' WHEN doc_id % 8 = 0 OR doc_id % 9 = 0 THEN 'unchecked' ELSE 'verified' END AS status,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 OR doc_id % 8 = 0 THEN doc_id::VARCHAR WHEN doc_id % 9 = 0 THEN 'missing' END AS detail,
  CASE WHEN doc_id % 13 > 0 AND doc_id % 7 > 0 AND doc_id % 8 > 0 AND doc_id % 9 > 0 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS checked_at FROM documents"""


@R.add("j4_a6_check_facts", FACTS_SQL)
def j4(spark, sf):
    return D.check_facts(*facts(spark, sf))


@R.add("c3_verification_run", f"WITH f AS ({FACTS_SQL}) SELECT status, count(*)::BIGINT AS n, min(checked_at) AS oldest FROM f GROUP BY 1")
def c3(spark, sf):
    return D.check_facts(*facts(spark, sf)).groupBy("status").agg(F.count("*").alias("n"), F.min("checked_at").alias("oldest"))


@R.add("j5_find_passages", r"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(b.text, '\s+', ' ', 'g')))")
def j5(spark, sf):
    return D.find_passages(read(spark, sf, "benchmark"), read(spark, sf, "documents"))


@R.add("f11_fact_lookup", "SELECT doc_id AS id FROM documents WHERE source IN ('src1', 'src2') AND (CASE WHEN doc_id % 3 > 0 THEN 2024 + doc_id % 2 END IS NULL OR 2024 + doc_id % 2 = 2025)")
def f11(spark, sf):
    d = read(spark, sf, "documents").withColumn("year", F.when(F.col("doc_id") % 3 > 0, 2024 + F.col("doc_id") % 2)).withColumn("topics", F.array("source", "lang"))
    wanted = F.arrays_overlap("topics", F.array(F.lit("src1"), F.lit("src2")))
    return d.filter(wanted & (F.col("year").isNull() | (F.col("year") == 2025))).select(F.col("doc_id").alias("id"))


@R.add("j13_fact_sources", "SELECT 'f' || doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN doc_id::VARCHAR || ',missing' ELSE doc_id::VARCHAR END AS sources FROM documents WHERE doc_id % 13 > 0")
def j13(spark, sf):
    rows, _, _ = facts(spark, sf)
    ev = rows.select("id", F.posexplode("evidence").alias("pos", "e")).groupBy("id", F.col("e.source").alias("source")).agg(F.min("pos").alias("pos"))
    return ev.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]), ",").alias("sources"))


@R.add("j15_source_tree", """WITH RECURSIVE i AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 > 0 THEN doc_id // 10 END AS parent, CASE WHEN doc_id % 6 = 0 THEN 'index' WHEN doc_id % 4 = 0 THEN 'error' ELSE 'ok' END AS status FROM documents WHERE doc_id > 0),
t AS (SELECT id AS root, id, status, true AS top FROM i WHERE parent IS NULL OR parent = 0 UNION ALL SELECT t.root, i.id, i.status, false FROM t JOIN i ON i.parent = t.id AND i.parent > 0)
SELECT root, count(*) FILTER (NOT top AND status <> 'index')::BIGINT AS pages, count(*) FILTER (NOT top AND status = 'ok')::BIGINT AS ok_pages FROM t GROUP BY 1""")  # fmt: skip
def j15(spark, sf):
    rows = read(spark, sf, "documents").filter("doc_id > 0").selectExpr("doc_id AS id", "CASE WHEN doc_id % 10 > 0 AND doc_id div 10 > 0 THEN doc_id div 10 END AS parent", "CASE WHEN doc_id % 6 = 0 THEN 'index' WHEN doc_id % 4 = 0 THEN 'error' ELSE 'ok' END AS status")
    return D.descendants(rows)


# ---- calendar, figures


@R.add("o5_calendar", "WITH c AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE + 5 END AS e FROM orders), l AS (SELECT *, arg_min(k, (d, k)) FILTER (coalesce(e, d) >= DATE '1999-06-16') OVER (PARTITION BY p) AS next FROM c) SELECT k, CASE WHEN coalesce(e, d) < DATE '1999-06-16' THEN 'past' WHEN k = next THEN 'next' ELSE 'upcoming' END AS label, CASE WHEN k = next THEN datediff('day', DATE '1999-06-16', d)::INT END AS days FROM l")
def o5(spark, sf):
    t = F.lit("1999-06-16").cast("date")
    c = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderkey") % 4 == 0, F.date_add(F.to_date("o_orderdate"), 5)).alias("e"))
    open_ = F.coalesce("e", "d") >= t
    nxt = c.filter(open_).groupBy("p").agg(F.min(F.struct("d", "k"))["k"].alias("next"))
    rows = c.join(nxt, "p", "left")
    is_next = F.coalesce(F.col("k") == F.col("next"), F.lit(False))
    return rows.select("k", F.when(~open_, "past").when(is_next, "next").otherwise("upcoming").alias("label"), F.when(is_next, F.datediff("d", t)).alias("days"))


@R.add("o6_latest_of_tag", "SELECT o_orderpriority AS tag, max_by(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderdate < TIMESTAMP '1999-06-16') AS latest, count(*) FILTER (o_orderdate >= TIMESTAMP '1999-06-16')::BIGINT AS coming FROM orders GROUP BY 1")
def o6(spark, sf):
    past = F.col("o_orderdate") < F.lit("1999-06-16").cast("timestamp_ntz")
    return read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("tag")).agg(F.max(F.when(past, F.struct("o_orderdate", "o_orderkey")))["o_orderkey"].alias("latest"), F.count_if(~past).alias("coming"))


@R.add("o7_key_figures", "SELECT source, n, place::INT AS place FROM (SELECT source, count(*)::BIGINT AS n, list_position(['src3', 'src1', 'src9', 'nowhere', 'src0'], source) AS place FROM documents GROUP BY 1) WHERE place IS NOT NULL ORDER BY place")
def o7(spark, sf):
    ids = F.array(*[F.lit(x) for x in ("src3", "src1", "src9", "nowhere", "src0")])
    rows = read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("place", F.array_position(ids, F.col("source")).cast("int"))
    return rows.filter("place > 0").orderBy("place")


# ---- guides, made of the documents: a section is a line, references are set in by rule

GUIDE = "concat('Days: {{fact:f', cast(doc_id % 5 as string), '}}, see [[guide:g', cast(doc_id % 4 as string), '|the guide]] and **bold** ', substring(text, 1, 60))"


def guides(spark, sf):
    return read(spark, sf, "documents").selectExpr("concat('g', cast(doc_id % 7 as string)) AS slug", "doc_id AS section", f"{GUIDE} AS body")


def fact_table(spark, sf):
    return read(spark, sf, "nation").filter("n_nationkey < 4").selectExpr("concat('f', cast(n_nationkey as string)) AS id", "n_name AS display")


def plain(rows, facts):
    """``rows`` (slug, section, body) with ``plain``, the body without its marks, one kind of them after the other. The facts that a
    section refers to come to it by a join."""
    parts = F.split(F.col("body"), r"(?=\{\{fact:)")
    swap = lambda p: F.when(p.startswith("{{fact:"), F.concat(F.coalesce(F.get(F.transform(F.array(F.regexp_extract(p, r"^\{\{fact:([a-z0-9_]+)\}\}", 1)), lambda k: F.try_element_at("names", k)), F.lit(0)), F.lit("—")), F.regexp_replace(p, r"^\{\{fact:[a-z0-9_]+\}\}", ""))).otherwise(p)
    out = F.array_join(F.transform(parts, swap), "")
    for pattern, to in ((r"\[\[guide:[a-z0-9-]+\|([^\]]*)\]\]", "$1"), (r"\[\[guide:([a-z0-9-]+)\]\]", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\[([^\]]+)\]\([^)\s]+\)", "$1"), (r"`([^`]+)`", "$1"), (r"(?U)\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return G.with_names(rows, facts, ["slug", "section"], F.array("body")).withColumn("plain", F.trim(out)).drop("names")


PLAIN_SQL = f"""g AS (SELECT 'g' || (doc_id % 7) AS slug, doc_id AS section, {GUIDE.replace('cast(doc_id % 5 as string)', '(doc_id % 5)::VARCHAR').replace('cast(doc_id % 4 as string)', '(doc_id % 4)::VARCHAR')} AS body, 'f' || (doc_id % 5) AS fact, text FROM documents),
p AS (SELECT g.*, trim(regexp_replace('Days: ' || coalesce(n_name, '—') || ', see the guide and bold ' || substring(text, 1, 60), '\\s+', ' ', 'g')) AS plain FROM g LEFT JOIN nation ON fact = 'f' || n_nationkey AND n_nationkey < 4)"""


@R.add("g1_g2_guide_index", f"WITH {PLAIN_SQL} SELECT slug, section, plain FROM p WHERE NOT regexp_matches(text[1:60], '[*`\\[]')")
def g1(spark, sf):
    rows = guides(spark, sf).filter(~F.expr("substring(body, locate('bold** ', body) + 7)").rlike(r"[*`\[]"))
    return index_of(rows, fact_table(spark, sf))


@R.add("g4_guide_text", f"WITH {PLAIN_SQL} SELECT slug, md5(string_agg(plain, chr(10) ORDER BY section)) AS text_md5, (SELECT string_agg(DISTINCT q.fact, ',' ORDER BY q.fact) FROM p q WHERE q.slug = p.slug AND NOT regexp_matches(q.text[1:60], '[*`\\[]')) AS figures FROM p WHERE NOT regexp_matches(text[1:60], '[*`\\[]') GROUP BY 1")
def g4(spark, sf):
    rows = guides(spark, sf).filter(~F.expr("substring(body, locate('bold** ', body) + 7)").rlike(r"[*`\[]"))
    return text_of_guides(rows, fact_table(spark, sf))


def whole_guides(spark, sf):
    """Guides of seven sections each, with whole texts and whatever markup they hold."""
    body = GUIDE.replace("substring(text, 1, 60)", "coalesce(text, '')")
    return read(spark, sf, "documents").selectExpr("concat('g', cast(floor(doc_id / 7) as string)) AS slug", "doc_id AS section", f"{body} AS body")


def index_of(rows, facts):
    return plain(rows, facts).select("slug", "section", "plain")


def text_of_guides(rows, facts):
    rows = plain(rows, facts).withColumn("ids", F.regexp_extract_all("body", F.lit(r"\{\{fact:([a-z0-9_]+)\}\}"), 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "plain"))), lambda x: x["plain"]), "\n")
    return rows.groupBy("slug").agg(F.md5(text).alias("text_md5"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), ",").alias("figures"))


# The markup rules have no SQL: whole texts go through them here, and the tests compare them with a row-by-row version.


@R.add("g1_g2_whole_guide_index")
def g1_whole(spark, sf):
    return index_of(whole_guides(spark, sf), fact_table(spark, sf))


@R.add("g4_whole_guide_text")
def g4_whole(spark, sf):
    return text_of_guides(whole_guides(spark, sf), fact_table(spark, sf))


@R.add("a10_reading_minutes", r"SELECT source AS slug, greatest(2, round_even(sum(len(regexp_extract_all(text, '\S+'))) / 220, 0))::BIGINT AS minutes FROM documents GROUP BY 1")
def a10(spark, sf):
    words = F.regexp_count("text", F.lit(r"(?U)\S+"))
    return read(spark, sf, "documents").groupBy(F.col("source").alias("slug")).agg(F.greatest(F.lit(2), F.bround(F.sum(words) / 220)).cast("long").alias("minutes"))


@R.add("j9_broken_references", "SELECT doc_id AS section, 'fact' AS kind, 'f' || (doc_id % 5) AS target FROM documents WHERE doc_id % 5 = 4 UNION ALL SELECT doc_id, 'guide', 'g' || (doc_id % 4) FROM documents WHERE doc_id % 4 = 3")
def j9(spark, sf):
    rows = guides(spark, sf)
    refs = lambda kind, pattern: rows.select("section", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(pattern), 1))).alias("target"))
    have = spark.range(3).selectExpr("concat('g', id) AS target")
    bad = refs("fact", r"\{\{fact:([a-z0-9_]+)\}\}").join(fact_table(spark, sf).select(F.col("id").alias("target")), "target", "left_anti")
    return bad.unionByName(refs("guide", r"\[\[guide:([a-z0-9-]+)(?:\|[^\]]*)?\]\]").join(have, "target", "left_anti")).select("section", "kind", "target")


@R.add("j14_section_sources", "SELECT doc_id AS section, CASE WHEN doc_id % 5 < 4 THEN 's' || (doc_id % 5) ELSE 'g' || (doc_id % 7) || '-a,g' || (doc_id % 7) || '-b' END AS sources FROM documents")
def j14(spark, sf):
    rows = guides(spark, sf)
    of_fact = fact_table(spark, sf).selectExpr("id", "concat('s', substring(id, 2)) AS source")
    cited = rows.select("section", F.posexplode(F.regexp_extract_all("body", F.lit(r"\{\{fact:([a-z0-9_]+)\}\}"), 1)).alias("pos", "id")).join(of_fact, "id").select("section", "source", "pos")
    rest = rows.join(cited.select("section").distinct(), "section", "left_anti").select("section", F.posexplode(F.array(F.concat("slug", F.lit("-a")), F.concat("slug", F.lit("-b")))).alias("pos", "source"))
    both = cited.withColumn("most", F.lit(5)).unionByName(rest.select("section", "source", "pos").withColumn("most", F.lit(4)))
    both = both.groupBy("section", "source", "most").agg(F.min("pos").alias("pos")).withColumn("nth", F.row_number().over(Window.partitionBy("section").orderBy("pos"))).filter("nth <= most")
    return both.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]), ",").alias("sources"))


@R.add("s7_text_files", "SELECT source || '-' || lang AS id, md5(arg_min(text, doc_id)) AS body_md5 FROM documents GROUP BY source, lang")
def s7(spark, sf):
    from ..sources import tables

    path = tables.scratch(spark, "snapshots")
    # the first document of each source and language is its snapshot; the writer makes a folder for each, no driver loop
    first = read(spark, sf, "documents").groupBy("source", "lang").agg(F.min_by("text", "doc_id").alias("text"))
    first.selectExpr("concat(source, '-', lang) AS id", "text").write.partitionBy("id").option("lineSep", "\u0003").text(path)
    return tables.read_text_files(spark, path).select("id", F.md5(F.regexp_replace("body", "\u0003$", "")).alias("body_md5"))
