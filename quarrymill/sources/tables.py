"""Reading and writing listings and snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING = T.StructType([T.StructField(c, T.StringType()) for c in (
    "source_platform", "source_id", "source_url", "title", "type", "title_en", "description", "organizer")] + [T.StructField("tags", T.ArrayType(T.StringType()))] + [T.StructField(c, T.StringType()) for c in (
    "starts_at", "ends_at", "signup_deadline", "venue", "address", "district", "city")] + [T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("is_free", T.BooleanType())] + [T.StructField(c, T.StringType()) for c in (
    "price_text", "status", "first_seen", "last_seen", "content_hash")] + [T.StructField("schema_version", T.IntegerType()), T.StructField("feedback", T.StringType())])


_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or where that is unset (tests) a new one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        at = _own[0]
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """The table of JSON lines: unknown fields dropped, unreadable lines skipped, the last row of each uid kept."""
    schema = T.StructType([*LISTING.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    rows = rows.filter("_bad is null and source_platform is not null").withColumn("uid", F.concat_ws(":", "source_platform", "source_id"))
    last = F.max_by(F.struct("uid", *LISTING.names), F.struct("_f", "_b", "_i")).alias("r")
    return rows.groupBy("uid").agg(last).select("r.*")


def write_listings(rows: DataFrame, path: str, fmt: str = "json", compression: str | None = None) -> None:
    """Writes in the stable order (start, uid); the commit protocol shows whole results only. With ``compression`` (``gzip``) the same
    lines take a fraction of the disk; readers know such files by their names."""
    out = rows.orderBy(F.coalesce("starts_at", F.lit("9999")), "uid").write.mode("overwrite").format(fmt)
    (out.option("compression", compression) if compression else out).save(path)


def read_csv_feed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV feed with trimmed values, empty ones null, and ``shifted``: the line, if it has more or fewer fields than columns."""
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField("shifted", T.StringType())])
    rows = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "shifted").option("enforceSchema", True).csv(path)
    return rows.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in columns], "shifted")


def unwrap(payload: DataFrame, row: str, keys: tuple[str, ...] = ("data", "results", "items", "list"), raw: str = "value") -> DataFrame:
    """The rows (of type ``row``, as DDL) of API payloads (JSON text in ``raw``): the list under the first known key, or the payload itself if a list."""
    inner = F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in keys], F.when(F.trim(raw).startswith("["), F.col(raw)))
    return payload.select(F.inline(F.from_json(inner, f"array<{row}>")))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, body): one row a file, the id out of its name, or of the ``id=`` folder that it lies in."""
    rows = spark.read.option("basePath", path).text(path, wholetext=True)
    if "id" in rows.columns:
        return rows.select(F.col("id").cast("string"), F.col("value").alias("body"))
    return rows.select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("id"), F.col("value").alias("body"))
