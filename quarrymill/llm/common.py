"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one that the session names in spark.checkpoint.dir; only where none is named (tests, one machine) a new
    folder is made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        at = _own[0]
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """From now on the session's Arrow batches have so many rows at most: whole texts then take little memory at a time, in
    the JVM and in Python. Every operator that hands texts to Python asks for it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, on: str | tuple[str, ...], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``big`` joined with ``small``, which has one row (or a few) for each value of ``on``: that row is repeated for each of ``salts``
    salts, and the rows of ``big`` are dealt out over them, so that a value that a third of all rows share is ``salts`` keys."""
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = [on] if isinstance(on, str) else list(on)
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")


#: Parts of all rows: a value that has more than one of them is hot, so there are no more hot values than this.
HOT = 1000


def hot_join(big: DataFrame, small: DataFrame, on: str, n: str, how: str = "inner") -> DataFrame:
    """``big`` joined (inner or left) with ``small``, a written table with one row for each value of ``on``, whose column ``n``
    says how many rows of ``big`` have it, about. The values with more than one in HOT of these rows, HOT at most, are
    broadcast; the others go by shuffle, in which no value stands out."""
    total = small.agg(F.sum(n).alias("n")).first()["n"] or 0
    is_hot = F.col(n) > max(total / HOT, 1)
    hot = F.broadcast(small.filter(is_hot))
    return big.join(hot, on).unionByName(big.join(hot, on, "left_anti").join(small.filter(~is_hot), on, how), allowMissingColumns=True)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many more underscores as it takes to be none of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def packed(text: Column) -> Column:
    """The text's UTF-8, zstd-compressed: what is shuffled of whole texts."""

    @F.pandas_udf("binary")
    def of(texts):
        coder = zstandard.ZstdCompressor(3)
        return texts.map(lambda x: coder.compress(x.encode()))

    return of(text)


def unpacked(data: list[bytes | None]) -> list[str]:
    coder = zstandard.ZstdDecompressor()
    return [coder.decompress(x).decode() for x in data]


def arrow_groups(batches, by, cols):
    """Runs of rows with equal values of ``by``, as lists of tuples of ``cols``."""
    now, held = None, []
    for batch in batches:
        for at, row in zip(zip(*[batch.column(c).to_pylist() for c in by], strict=True), zip(*[batch.column(c).to_pylist() for c in cols], strict=True), strict=True):
            if at != now:
                if held:
                    yield now, held
                now, held = at, []
            held.append(row)
    if held:
        yield now, held
