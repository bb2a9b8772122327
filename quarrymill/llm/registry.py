"""The queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, langid, licenses, linededup, lmscore, mixing, ngramjoin, packing, quality, runs, warc, whitening
from .common import table

DOCS = "(SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", lmscore.held_out().alias("held_out"))
    return lmscore.score(docs.withColumn("learn", ~F.col("held_out")), ("doc_id", "held_out"))


def op2_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_classes(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints.beside_next(docs, near=fingerprints.near_duplicates(docs))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _op7_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+".replace("\\\\", "\\")
    places = " || ".join(
        "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p in licenses.PHRASES
    )
    base = ", ".join(f"CASE WHEN len(list_filter(range(len(w)), lambda i: {' AND '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))})) > 0 THEN '{label}' END" for p, label in licenses.PHRASES.items())
    sets = ", ".join(f"({i}, '{label}', {sorted(set(t.split()))}, '{licenses.NAMES[t]}', {len(t.split()) + len(t.split()) // 4}, {licenses._need(len(set(t.split())), licenses.THRESHOLD)})" for i, (t, label) in enumerate(licenses.TEMPLATES.items()))
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS w FROM d),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, {places} AS s, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM w),
o AS (SELECT doc_id, pos, word, v.* FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w) JOIN (VALUES {sets}) v(id, label, words, name, length, need) ON list_contains(words, word)),
k AS (SELECT doc_id, label, words, need, count(DISTINCT word) OVER w AS n, bool_or(word = name) OVER w AS named FROM o WINDOW w AS (PARTITION BY doc_id, id ORDER BY pos RANGE BETWEEN CURRENT ROW AND length - 1 FOLLOWING)),
m AS (SELECT doc_id, label, n / len(words) AS c FROM k WHERE n >= need AND named),
g AS (SELECT doc_id, list(DISTINCT label) AS more, max(c) AS c FROM m GROUP BY 1)
SELECT doc_id, n_words, len(s)::BIGINT AS n_base, list_min(s)::BIGINT AS first_word, list_max(s)::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ','), '') AS labels,
  CASE WHEN len(s) > 0 THEN 1.0 ELSE coalesce(c, 0) END::DOUBLE AS score
FROM b LEFT JOIN g USING (doc_id)"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    net = langid.fit(docs.filter("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), net).drop("text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def line_dedup_sql(docs: str, words: int = linededup.LEAST_WORDS) -> str:
    """CTEs that end in ``dedup`` (doc_id, text, n_lines, n_deleted) of the CTE or table ``docs``; ids are unique there."""
    return f"""
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {docs}),
lw AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))::BIGINT AS n, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM ln),
lr AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS e FROM lw WHERE n > 0),
wn AS (SELECT doc_id, sum(n) OVER a AS words, min(pos) OVER a AS first, max(pos) OVER a AS last, array_to_string(list(bare) OVER a, chr(10)) AS key FROM (SELECT *, e - n AS s FROM lr) WINDOW a AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {words - 1} FOLLOWING)
  UNION ALL SELECT doc_id, sum(n) OVER b, min(pos) OVER b, max(pos) OVER b, array_to_string(list(bare) OVER b, chr(10)) FROM lr WINDOW b AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {words - 1} PRECEDING AND CURRENT ROW)),
wf AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, first) AS nth, min((doc_id, first)) OVER (PARTITION BY key) AS kept FROM wn WHERE words >= {words}),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM wf WHERE (doc_id, first) > kept),
dedup AS (SELECT d.doc_id, CASE WHEN g.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, len(string_split(d.text, chr(10)))::INT AS n_lines, coalesce(g.n, 0)::INT AS n_deleted
  FROM {docs} d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone JOIN lr USING (doc_id, pos) GROUP BY 1) g USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM ln WHERE (doc_id, pos) NOT IN (SELECT (doc_id, pos) FROM gone JOIN lr USING (doc_id, pos)) GROUP BY 1) k USING (doc_id))"""


OP5_SQL = f"""WITH {line_dedup_sql('documents')}
SELECT doc_id, n_lines, n_deleted, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM dedup"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.resolve(warc.read_archives(spark, warc.dedup_archives(spark, raw)))
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM t"""


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "passes")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, md5(coalesce(doc_id::VARCHAR, '')) AS place,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, skey, sum(size)::BIGINT AS source_size FROM d GROUP BY 1, 2),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, floor(1.5 * sum(source_size) OVER ())::BIGINT AS budget FROM s),
r AS (SELECT *, (source_size * 2)::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (budget - coalesce(sum(source_size * 2) OVER b, 0))::DOUBLE / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) AS fill FROM l),
t AS (SELECT skey, source_size, budget, CASE WHEN ratio <= coalesce(fill, ratio) THEN (source_size * 2)::DOUBLE ELSE fill * weight END AS target FROM f),
q AS (SELECT d.*, source_size, target, budget, sum(size) OVER (PARTITION BY skey ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum,
    row_number() OVER (PARTITION BY skey ORDER BY place, doc_id, size) AS nth FROM d JOIN t USING (skey)),
p AS (SELECT *, (cum + pass * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) v(pass) WHERE target > 0 AND size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, skey, place, nth ROWS UNBOUNDED PRECEDING) AS total FROM p),
n AS (SELECT skey, nth, count(*) AS passes FROM c WHERE total <= budget GROUP BY 1, 2)
SELECT doc_id, size, source_size, target, size * coalesce(passes, 0)::BIGINT AS taken, coalesce(passes, 0)::INT AS passes
FROM q LEFT JOIN n USING (skey, nth)"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.mark_runs(table(spark, sf_dir, "documents"), words=runs.with_tandem))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pieces(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_lm_score": op1_lm_score, "op2_byte_pairs": op2_byte_pairs, "op3_ngram_join": op3_ngram_join, "op4_fingerprints": op4_fingerprints, "op5_line_dedup": op5_line_dedup, "op6_warc": op6_warc, "op7_licenses": op7_licenses,
        "op8_quality": op8_quality, "op9_language": op9_language, "op10_fair_mix": op10_fair_mix, "op11_periodic_runs": op11_periodic_runs, "op12_packing": op12_packing, "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op7_licenses": _op7_sql(), "op10_fair_mix": OP10_SQL}
