"""Registered queries over tables of phrases and over guides with every kind of block."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import search as S
from ..operators import guides as G
from ..operators import search
from ..operators.joins import spread
from .adapters import NOW, REFRESHED_CTE, pick, read
from .listing_queries import ORDER, _topic_sql, fresh
from .registry import Registry
from .text_queries import _WIN

R = Registry()

# ---- phrases: (phrase, window, free, english, in person, city, tax, topic, tokens, guide tokens, phrase without its first condition)

ASKED = [
    ("Free english events this weekend", "weekend", True, True, False, None, False, None, "", "free english this weekend", "Free english events"), ("jazz tonight", "tonight", False, False, False, None, False, "music/jazz", "", "jazz tonight", "jazz"),
    ("climbing in new taipei", None, False, False, False, "新北市", False, "outdoors/climbing", "", "climbing new taipei", "climbing in"), ("markets in november", "month:november", False, False, False, None, False, "markets/markets", "", "markets november", "markets"),
    ("週末 免費 市集", "weekend", True, False, False, None, False, "markets/markets", "", "週末 免費 市集", "免費 市集"), ("183 days resident", None, False, False, False, None, True, None, "183 days resident", "183 days resident", "183 days resident"),
    ("events in Taipei", None, False, False, False, None, False, None, "", "taipei", "events in Taipei"), ("may i deduct rent", None, False, False, False, None, False, None, "may deduct rent", "may deduct rent", "may i deduct rent"),
    ("markets in may", "month:may", False, False, False, None, False, "markets/markets", "", "markets may", "markets"), ("jazz may 3", "month:may", False, False, False, None, False, "music/jazz", "", "jazz may 3", "jazz"),
    ("this weekend social", "weekend", False, False, False, None, False, "social", "", "this weekend social", "social"), ("free outdoor", None, True, False, False, None, False, "outdoors", "", "free outdoor", "outdoor"),
    ("offline 手沖咖啡 大安", None, False, False, True, None, False, "markets/coffee", "手沖 大安", "offline 手沖咖啡 大安", "手沖咖啡 大安"), ("3 may: gold card refund", "month:may", False, False, False, None, True, None, ": gold card refund", "3 may: gold card refund", ": gold card refund"),
    ("heart of art", None, False, False, False, None, False, "arts/exhibitions", "he art", "heart art", "heart of art"), ("free音樂", None, True, False, False, None, False, "music", "", "free音樂", "音樂"),
]


def _lit(v):
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


@R.add("f9_topics_and_months", f"""WITH a(i, raw, when_key, free, english, in_person, city, tax, topic, tokens, guide_tokens, less) AS (VALUES {', '.join(f"({i}, {', '.join(map(_lit, r))})" for i, r in enumerate(ASKED))})
SELECT c_custkey AS k, when_key, free, english, in_person, a.city, tax, topic, tokens, guide_tokens, less FROM customer JOIN a ON i = c_custkey % {len(ASKED)}""")  # fmt: skip
def f9(spark, sf):
    rows = spark.sql(f"SELECT c_custkey AS k, {pick([r[0] for r in ASKED], 'c_custkey')} AS raw FROM {{c}}", c=spread(read(spark, sf, "customer")))
    got = S.parse_queries(rows)
    first = F.get(F.transform("chips", lambda c: c["key"]), F.lit(0))
    less = F.coalesce(*[F.when(first == k, S.without_chip(F.col("raw"), F.col("chips"), k)) for k in ("when", "free", "english", "inPerson", "city")], "raw")
    topic = F.nullif(F.concat_ws("/", "topic", "sub"), F.lit(""))
    return got.select("k", "when_key", "free", "english", "in_person", "city", "tax", topic.alias("topic"), F.array_join("tokens", " ").alias("tokens"), F.array_join("guide_tokens", " ").alias("guide_tokens"), less.alias("less"))


WHENS = [("", None), ("tonight", "tonight"), ("this weekend", "weekend"), ("next week", "nextWeek"), ("in september", "month:september"), ("this month", "month"), ("", None)]
FLAGS = [("", ""), ("free", "f"), ("english", "e"), ("in person", "p"), ("new taipei", "n"), ("free english", "fe")]
WORDS = [
    ("", None, ""), ("jazz", "music/jazz", ""), ("hiking", "outdoors/hiking", ""), ("park", None, "park"), ("大安", None, "大安"), ("coffee", "markets/coffee", ""), ("org7", None, "org7"), ("wine evening", "markets/food", "evening"),
    ("language exchange english corner", "social/exchange", "corner"), ("social", "social", ""), ("ridge trail", "outdoors/hiking", "ridge"), ("nowhere at all", None, "nowhere all"), ("e", None, "e"),
]
_N = {"w": len(WHENS), "g": len(FLAGS), "t": len(WORDS)}
_PARTS = {"w": f"k % {_N['w']}", "g": f"(k // {_N['w']}) % {_N['g']}", "t": f"(k * 5 + k // {_N['w'] * _N['g']}) % {_N['t']}"}
_MONTH = "m AS (SELECT 'month:september' AS name, '1999-09-01T00:00:00+08:00' AS start, '1999-09-30T23:59:59+08:00' AS \"end\")"


@R.add("f10_phrase_search", f"""WITH {REFRESHED_CTE}, {_topic_sql()}, {_WIN}, {_MONTH}, fr AS (SELECT * FROM w UNION ALL SELECT * FROM m),
wn(w, when_key) AS (VALUES {', '.join(f'({i}, {_lit(k)})' for i, (_, k) in enumerate(WHENS))}), fl(g, f) AS (VALUES {', '.join(f"({i}, '{f}')" for i, (_, f) in enumerate(FLAGS))}), wo(t, topic, tokens) AS (VALUES {', '.join(f'({i}, {_lit(a)}, {_lit(b)})' for i, (_, a, b) in enumerate(WORDS))}),
q AS (SELECT c_custkey AS k, {_PARTS['w'].replace('k', 'c_custkey')} AS w, {_PARTS['g'].replace('k', 'c_custkey')} AS g, {_PARTS['t'].replace('k', 'c_custkey')} AS t FROM customer),
a AS (SELECT w, g, t, when_key, contains(f, 'f') AS free, contains(f, 'e') OR t = 8 AS english, f = 'p' AS in_person, CASE WHEN f = 'n' THEN '新北市' END AS city, topic, list_filter(string_split(tokens, ' '), lambda x: x <> '') AS tokens FROM (SELECT DISTINCT w, g, t FROM q) JOIN wn USING (w) JOIN fl USING (g) JOIN wo USING (t)),
b AS (SELECT *, lower(concat_ws(' ', title, nullif(title_en, ''), description, venue, address, organizer, array_to_string(tags, ' '))) AS blob, lower(title || ' ' || coalesce(title_en, '')) AS head, [topic FOR topic IN (SELECT list(topic) FROM tp WHERE tp.uid = fresh.uid)] AS topics
  FROM fresh WHERE status IN ('upcoming', 'ongoing') AND coalesce(feedback, '') <> 'not_my_thing'),
m2 AS (SELECT a.w, a.g, a.t, b.uid, b.status, b.starts_at, CASE WHEN len(list_filter(a.tokens, lambda x: contains(head, x))) > 0 THEN 2 ELSE 1 END AS hit FROM a LEFT JOIN fr ON fr.name = a.when_key JOIN b ON (a.when_key IS NULL OR b.s BETWEEN fr.start::TIMESTAMPTZ AND fr."end"::TIMESTAMPTZ)
  AND (NOT a.free OR b.is_free) AND (NOT a.english OR list_contains(b.tags, 'lang:en')) AND (NOT a.in_person OR NOT list_contains(b.tags, 'online')) AND (a.city IS NULL OR a.city = b.city) AND (a.topic IS NULL OR list_contains(b.topics, a.topic)) AND len(list_filter(a.tokens, lambda x: NOT contains(b.blob, x))) = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY w, g, t ORDER BY hit DESC, {ORDER}) AS place FROM m2)
SELECT k AS q, uid, hit::INT AS hit, place::INT AS place FROM q JOIN r USING (w, g, t) WHERE place <= 20""")  # fmt: skip
def f10(spark, sf):
    at = {n: e.replace("k", "c_custkey").replace("//", "div") for n, e in _PARTS.items()}
    raw = f"concat_ws(' ', {pick([f for f, _ in FLAGS], at['g'])}, {pick([w for w, *_ in WORDS], at['t'])}, {pick([w for w, _ in WHENS], at['w'])})"
    asked = S.parse_queries(spark.sql(f"SELECT c_custkey AS q, {raw} AS raw FROM {{c}}", c=spread(read(spark, sf, "customer"))))
    return search.search_listings(fresh(spark, sf), asked, NOW)


# ---- guides of seven documents each: every document is a section with all kinds of blocks

BODY = "regexp_replace(coalesce(text, ''), '[*`{}\\\\[\\\\]]', ' ')"


def doc_guides(spark, sf):
    d = f"cast(doc_id as string)"  # noqa: F541
    block = lambda **k: "named_struct(" + ", ".join(f"'{n}', cast({k.get(n, 'NULL')} as {t})" for n, t in BLOCK_TYPES) + ")"
    blocks = [
        block(p=f"concat('Days: {{{{fact:f', cast(doc_id % 5 as string), '}}}}, see [[guide:g', cast(doc_id % 4 as string), '|the guide]] and **bold** ', {BODY})"),
        block(list=f"array('one  `code`', concat('[two {{{{fact:f1}}}}](https://x.example/', {d}, ')'))"), block(steps="array(named_struct('title', 'Go', 'text', 'to [[guide:g1]]'))"),
        block(faq=f"array(named_struct('q', concat('Why ', {d}, '?'), 'a', concat('Because **{{{{fact:f', cast(doc_id % 3 as string), '}}}}** of ', coalesce(lang, '-'))), named_struct('q', concat('What is ', coalesce(source, '-'), '?'), 'a', 'A `source`.'))"),
        block(callout="named_struct('title', 'Note', 'text', 'mind **the [gap](https://x.example)**')"), block(table="named_struct('head', array('a', 'b'), 'rows', array(array('1', '{{fact:f9}}')))"),
        block(stats="array(named_struct('label', 'n', 'value', '{{fact:f2}}'))"), block(facts="array('f1', concat('f', cast(doc_id % 7 as string)))", cite="array(concat('s', cast(doc_id % 11 as string)), 's1')"),
    ]
    section = f"named_struct('id', concat('s', {d}), 'heading', element_at(split(coalesce(text, ''), '\\n'), 1), 'keywords', array(lang, 'tax'), 'blocks', array({', '.join(blocks)}))"
    rows = read(spark, sf, "documents").selectExpr("doc_id", "doc_id div 7 AS pos", f"{section} AS sec")
    of = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "sec"))), lambda x: x["sec"])
    guides = rows.groupBy("pos").agg(of.alias("sections"))  # seven at most
    slug = "concat('g', cast(pos as string))"
    return guides.selectExpr(f"{slug} AS slug", "pos", "concat('Guide ', cast(pos as string)) AS title", "'tax' AS kind", "array('money', concat('k', cast(pos % 5 as string))) AS keywords", "array(concat('s', cast(pos % 9 as string)), 's3', 's20') AS sources", "array(concat('g', cast(pos + 1 as string))) AS related", "sections")


BLOCK_TYPES = [
    ("p", "string"), ("list", "array<string>"), ("steps", "array<struct<title:string,text:string>>"), ("callout", "struct<title:string,text:string>"), ("table", "struct<head:array<string>,rows:array<array<string>>>"),
    ("stats", "array<struct<label:string,value:string>>"), ("faq", "array<struct<q:string,a:string>>"), ("facts", "array<string>"), ("cite", "array<string>"),
]


def doc_facts(spark, sf):
    return read(spark, sf, "nation").filter("n_nationkey < 4").selectExpr("concat('f', cast(n_nationkey as string)) AS id", "n_name AS display", "array(named_struct('source', concat('s', cast(n_nationkey as string)), 'quote', 'x'), named_struct('source', 's12', 'quote', 'y'), named_struct('source', 's1', 'quote', 'z')) AS evidence")


def doc_sources(spark, sf):
    """The source index: a row a nation, of which some have no address, English title or parent."""
    return read(spark, sf, "nation").filter("n_nationkey < 13").selectExpr("concat('s', cast(n_nationkey as string)) AS id", "CASE WHEN n_nationkey % 4 > 0 THEN 's0' END AS parent", "n_name AS title", "CASE WHEN n_nationkey % 3 > 0 THEN lower(n_name) END AS title_en", "'office' AS publisher", "CASE WHEN n_nationkey <> 5 THEN concat('https://s.example/', cast(n_nationkey as string)) END AS url")


_NAME = lambda e: f"coalesce((SELECT n_name FROM nation WHERE n_nationkey = {e} AND n_nationkey < 4), '—')"
_SQUEEZE = lambda e: f"trim(regexp_replace({e}, '[\\s\\x0B\\x85\\xA0\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"
INDEX_CTE = f"""d AS (SELECT *, doc_id // 7 AS pos, row_number() OVER (PARTITION BY doc_id // 7 ORDER BY doc_id) - 1 AS nth, regexp_replace(coalesce(text, ''), '[*`{{}}\\[\\]]', ' ', 'g') AS body FROM documents),
ix AS (SELECT (pos * 1000000 + nth) * 1000000 + 2 AS entry, 'g' || pos AS slug, 's' || doc_id AS section_id, 'Guide ' || pos AS title, string_split(coalesce(text, ''), chr(10))[1] AS heading, 'money k' || (pos % 5) || coalesce(' ' || lang, '') || ' tax' AS keywords, false AS faq,
  {_SQUEEZE(f"'Days: ' || {_NAME('doc_id % 5')} || ', see the guide and bold ' || body")} || ' one code two ' || {_NAME('1')} || ' Go. to g1 Note mind the gap a b 1 — n ' || {_NAME('2')} || ' ' AS text FROM d
UNION ALL SELECT (pos * 1000000 + nth) * 1000000, 'g' || pos, 's' || doc_id, 'Guide ' || pos, 'Why ' || doc_id || '?', 'money k' || (pos % 5), true, 'Because ' || {_NAME('doc_id % 3')} || ' of ' || coalesce(lang, '-') FROM d
UNION ALL SELECT (pos * 1000000 + nth) * 1000000 + 1, 'g' || pos, 's' || doc_id, 'Guide ' || pos, 'What is ' || coalesce(source, '-') || '?', 'money k' || (pos % 5), true, 'A source.' FROM d)"""


@R.add("g1_guide_entries", f"WITH {INDEX_CTE} SELECT entry::BIGINT AS entry, slug, section_id, title, heading, keywords, faq, md5(text) AS text_md5 FROM ix")
def g1(spark, sf):
    return G.guide_index(doc_guides(spark, sf), doc_facts(spark, sf)).select("entry", "slug", "section_id", "title", "heading", "keywords", "faq", F.md5("text").alias("text_md5"))


SPOKEN = ["gold card", "rent", "183", "refund", "deadline rates", "note"]
EXPANDED = [
    "gold card,special professional,就業金卡,incentive,gold,card", "rent,rental", "183,resident,residency,days", "refund,refunds,退稅", "deadline,filing period,may,june,rate,rates,bracket", "note",
]


@R.add("o4_guide_search", f"""WITH {INDEX_CTE}, n AS (SELECT count(*) AS n FROM documents), dn AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, text FROM documents),
e(i, tokens) AS (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(EXPANDED))}),
q AS (SELECT s_suppkey AS q, list_distinct(string_split(e.tokens, ',') || [lower(string_split(dn.text, ' ')[2])]) AS tokens FROM supplier, n JOIN e ON e.i = s_suppkey % {len(SPOKEN)} JOIN dn ON dn.i = (s_suppkey * 7) % n.n),
qt AS (SELECT q, unnest(list_filter(tokens, lambda t: t <> '')) AS t, len(list_filter(tokens, lambda t: t <> '')) AS n FROM q), lo AS (SELECT entry, slug, section_id, heading, faq, lower(heading) AS h, lower(title) AS ti, lower(keywords) AS kw, lower(text) AS tx FROM ix),
c AS (SELECT q, entry, least(3, (length(h) - length(replace(h, t, ''))) // length(t)) * 4 + least(3, (length(ti) - length(replace(ti, t, ''))) // length(t)) * 1.5 + least(3, (length(kw) - length(replace(kw, t, ''))) // length(t)) * 2 + least(3, (length(tx) - length(replace(tx, t, ''))) // length(t)) AS s, n FROM qt, lo),
r AS (SELECT q, entry, sum(s)::DOUBLE * (1 + count(*) FILTER (s > 0) / any_value(n)) AS s FROM c GROUP BY 1, 2 HAVING sum(s) > 0),
f AS (SELECT r.q, entry, slug, section_id, heading, faq, CASE WHEN faq THEN s * 1.1::DOUBLE ELSE s END AS score FROM r JOIN lo USING (entry)),
b AS (SELECT *, row_number() OVER (PARTITION BY q, slug, section_id, CASE WHEN faq THEN heading ELSE '' END ORDER BY score DESC, entry) AS own FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, entry) AS place FROM b WHERE own = 1)
SELECT q, place::INT AS place, slug, section_id, p.heading, p.faq, round(score, 6) AS score FROM p WHERE place <= 6""")  # fmt: skip
def o4(spark, sf):
    docs = read(spark, sf, "documents")
    n = docs.count()
    # suppliers ask for a topic and for the second word of a document; documents have the numbers 0, 1, ...
    words = docs.selectExpr("doc_id AS i", "get(split(text, ' '), 1) AS word")
    asked = spark.sql(f"SELECT s_suppkey AS q, {pick(SPOKEN, 's_suppkey')} AS raw, s_suppkey * 7 % {n} AS i FROM {{s}}", s=read(spark, sf, "supplier"))
    asked = asked.join(words, "i", "left").select("q", S.expand(F.split("raw", " ")).alias("topic"), F.lower("word").alias("word"))
    asked = asked.select("q", F.filter(F.array_distinct(F.concat("topic", F.array("word"))), lambda t: F.coalesce(t, F.lit("")) != "").alias("tokens"))
    found = search.search_sections(G.guide_index(doc_guides(spark, sf), doc_facts(spark, sf)), asked)
    return found.select("q", "place", "slug", "section_id", "heading", "faq", F.round("score", 6).alias("score"))


@R.add("j9_guide_problems", """WITH d AS (SELECT doc_id, doc_id // 7 AS pos FROM documents), g AS (SELECT DISTINCT pos FROM d), f AS (SELECT n_nationkey AS i FROM nation WHERE n_nationkey < 4), s AS (SELECT n_nationkey AS i FROM nation WHERE n_nationkey < 13),
m AS (SELECT pos, 'fact' AS kind, unnest([doc_id % 5, 1, doc_id % 3, 9, 2]) AS i FROM d UNION SELECT pos, 'block fact', unnest([1, doc_id % 7]) FROM d),
l AS (SELECT pos, 'guide' AS kind, unnest([doc_id % 4, 1]) AS i FROM d UNION SELECT pos, 'related', pos + 1 FROM g), c AS (SELECT pos, 'source' AS kind, unnest([pos % 9, 3, 20]) AS i FROM g UNION SELECT pos, 'cite', unnest([doc_id % 11, 1]) FROM d),
sh AS (SELECT i FROM c UNION SELECT unnest([n_nationkey, 12, 1]) FROM nation WHERE n_nationkey < 4 UNION SELECT n_nationkey FROM nation WHERE n_nationkey < 13 AND n_nationkey % 4 = 0)
SELECT 'g' || pos AS slug, kind, 'f' || i AS target FROM m ANTI JOIN f USING (i) UNION ALL SELECT 'g' || l.pos, kind, 'g' || i FROM l ANTI JOIN g ON g.pos = i UNION ALL SELECT 'g' || pos, kind, 's' || i FROM c ANTI JOIN s USING (i)
UNION ALL SELECT NULL, 'unnamed', 's' || i FROM sh SEMI JOIN s USING (i) WHERE i % 3 = 0""")  # fmt: skip
def j9(spark, sf):
    facts = doc_facts(spark, sf)
    return G.broken_references(doc_guides(spark, sf), facts, doc_sources(spark, sf), facts.select("id", F.explode("evidence.source").alias("source")))


@R.add("j13_fact_source_metadata", """WITH e AS (SELECT 'f' || n_nationkey AS id, unnest(CASE WHEN n_nationkey = 1 THEN [1, 12] ELSE [n_nationkey, 12, 1] END) AS i, generate_subscripts(CASE WHEN n_nationkey = 1 THEN [1, 12] ELSE [n_nationkey, 12, 1] END, 1) AS pos FROM nation WHERE n_nationkey < 4)
SELECT id, pos::INT AS pos, 's' || i AS source, n_name AS title, CASE WHEN i % 3 > 0 THEN lower(n_name) END AS title_en, 'office' AS publisher, 'https://s.example/' || i AS url FROM e JOIN nation ON n_nationkey = i""")  # fmt: skip
def j13(spark, sf):
    return G.fact_sources(doc_facts(spark, sf), doc_sources(spark, sf)).select("id", "pos", "source", *G.META)


@R.add("j14_guide_section_sources", """WITH d AS (SELECT doc_id, doc_id // 7 AS pos FROM documents),
o AS (SELECT doc_id, pos, unnest([doc_id % 5, 1, doc_id % 3, 9, 2]) AS f, generate_subscripts([1, 2, 3, 4, 5], 1) AS a FROM d), x AS (SELECT doc_id, pos, 0 AS k, a, unnest([1, 2, 3]) AS b, unnest([f, 12, 1]) AS i FROM o WHERE f < 4
  UNION ALL SELECT doc_id, pos, 1, unnest([1, 2]), 0, unnest([doc_id % 11, 1]) FROM d), y AS (SELECT doc_id, pos, i, min((k, a, b)) AS at_ FROM x WHERE i < 13 AND i <> 5 GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY at_) AS nth FROM y) SELECT 'g' || pos AS slug, 's' || doc_id AS section_id, nth::INT AS nth, n_name AS title, CASE WHEN i % 3 > 0 THEN lower(n_name) END AS title_en, 'office' AS publisher, 'https://s.example/' || i AS url FROM z JOIN nation ON n_nationkey = i WHERE nth <= 5""")  # fmt: skip
def j14(spark, sf):
    of_facts = G.fact_sources(doc_facts(spark, sf), doc_sources(spark, sf))
    return G.section_sources(doc_guides(spark, sf), of_facts, doc_sources(spark, sf))
