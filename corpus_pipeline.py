"""A training corpus from raw documents, in five stages that each call one of the operators.

Every stage is a function of (spark, docs, sf_dir); ``run`` writes each result as Parquet in the shared folder and reads it
again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import bpe, langid, linededup, mixing, ngramjoin
from quarrymill.llm.common import WORD, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language verdict of less than this probability is no verdict.
LEAST_SCORE = 0.4


def _with_chars(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; those without letters (null and empty texts among them), or with no clear
    verdict, go. It learns from the documents that aren't held out. Rows are judged one by one: repeated and null ids stay as they
    are; columns other than those of documents are left out; an empty table, or one without a labelled text, gives an empty one."""
    net = langid.fit(docs.filter(~langid.held_out()))
    judged = langid.predict(docs, net, pred="_pred", score="_score")
    return judged.filter((F.col("_pred") != langid.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that an earlier document or place has; those of which no word is left go. Texts without
    a repeat stay as they are, null and empty ones too; rows with one id are separate documents, and rows equal in id and text are
    treated alike. Other columns are left out; an empty table gives an empty one."""
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    return _with_chars(kept.filter((F.col("n_deleted") == 0) | F.col("text").rlike(WORD)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that with the least id. Texts without words, null texts and null ids are like no
    other and stay; of rows equal in id and text one stays. Other columns are left out; an empty table gives an empty one."""
    return ngramjoin.one_of_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it. Passes stay with their own row, whatever ids are null or
    repeated: rows are known by all their columns, and the passes of equal rows are added."""
    keyed = docs.select(*COLUMNS, F.md5(F.to_json(F.struct(*COLUMNS))).alias("_row"))
    taken = mixing.fair_mix(keyed, more=("_row",)).filter("passes > 0").groupBy("_row").agg(F.sum("passes").cast("int").alias("passes"))
    rows = keyed.dropDuplicates(["_row"]).join(taken, "_row")
    return rows.withColumn("passes", F.explode(F.sequence(F.lit(1), "passes"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids of every row, and whether decoding gives its text again. A null text is an empty one and has no
    ids; repeated rows stay; other columns are left out; an empty table gives an empty one."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, check="round_trip")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("byte-level BPE", tokens)]
#: The first and last stages are a network and a tokenizer, which SQL can't express; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
