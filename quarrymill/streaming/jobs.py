"""Jobs over arriving rows: upserts batch by batch, snapshots and their versions, sessions of crawl stamps.

All keep their state in a folder; given the same folder again, they go on where they stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators import listings as L
from ..sources import tables

#: Parts of the table by hash of uid; a batch rewrites only those that it has rows of.
PARTS = 64


class Parts:
    """A table in a folder, in PARTS parts by hash of a key. A version holds only the parts that it changed, and is seen once a note
    of it is written. What newer versions have replaced is removed one batch later, when no retry can ask for it."""

    def __init__(self, spark: SparkSession, base: str, schema: StructType, key: str):
        self.spark, self.base, self.schema, self.notes = spark, base, schema, f"{base}/notes"
        self.part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")

    def begun(self) -> bool:
        return tables.exists(self.spark, f"{self.notes}/_SUCCESS")

    def of(self, batch: DataFrame) -> list[int]:
        return [r["p"] for r in batch.select(self.part.alias("p")).distinct().collect()]  # PARTS at most

    def keep(self, rows: DataFrame, version: int) -> None:
        path, rows = f"{self.base}/rows/v{version}", rows.withColumn("_part", self.part)
        rows.write.mode("overwrite").partitionBy("_part").parquet(path)
        done = self.spark.read.schema(rows.schema).parquet(path)
        done.select("_part").distinct().withColumn("version", F.lit(version)).coalesce(1).write.mode("append").parquet(self.notes)

    def _known(self, version: int) -> DataFrame:
        return self.spark.read.schema("_part int, version int").parquet(self.notes).filter(F.col("version") <= version)

    def table(self, version: int, parts: list[int] | None = None) -> DataFrame:
        now = self._known(version).groupBy("_part").agg(F.max("version").alias("version"))
        at = [f"{self.base}/rows/v{r['version']}/_part={r['_part']}" for r in now.collect() if parts is None or r["_part"] in parts]  # PARTS at most
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def forget(self, version: int) -> None:
        """Removes what is older than the newest of each part up to ``version``, which a running batch may still read."""
        newest = Window.partitionBy("_part")
        old = self._known(version).distinct().withColumn("_newest", F.max("version").over(newest)).filter(F.col("version") < F.col("_newest"))
        for r in old.collect():  # notes: PARTS a batch at most
            tables.remove(self.spark, f"{self.base}/rows/v{r['version']}/_part={r['_part']}")


def upsert_stream(stream: DataFrame, stored: DataFrame, stamp: str, folder: str | None = None) -> DataFrame:
    """The listings table after all available rows of ``stream`` are upserted, batch by batch.

    A batch writes new versions of the parts that it has rows of and, when they are whole, a note of them. One that runs again
    after a failure reads the versions before it and writes the same, as a version is the batch's number. ``stored`` is
    the table to start from; it is not read when ``folder`` holds an earlier run. The result is that of this run: later ones
    remove the parts that they replace.
    """
    base = folder or tables.scratch(stored.sparkSession, "upserts")
    state = Parts(stored.sparkSession, base, stored.schema, "uid")

    def one(batch: DataFrame, number: int) -> None:
        state.forget(number)
        if parts := state.of(batch):
            state.keep(L.upsert(state.table(number, parts), batch, stamp).drop("outcome"), number + 1)

    if not state.begun():
        state.keep(stored, 0)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return state.table(1 << 30)


INDEX = StructType([StructField(c, IntegerType() if c in ("chars", "http_status") else StringType()) for c in (
    "id", "first_seen", "content_hash", "chars", "page_title", "page_updated", "changed_at", "last_ok", "last_checked", "status", "http_status", "error")])
VERSION = StructType([StructField(c, IntegerType() if c in ("chars", "http_status") else StringType()) for c in (
    "id", "valid_from", "outcome", "content_hash", "chars", "page_title", "page_updated", "http_status", "text")])


def snapshot_stream(stream: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, versions) after all available fetches of ``stream``: id, at, status, http_status, text, page_title, page_updated, error.

    The index has a row a source (INDEX): status, HTTP status, error and last_checked are those of the last fetch; hash, size, title
    and date those of the last good one, so a failure leaves them. ``versions`` has a row for each time that a good fetch
    differs from the good one before it (VERSION), with ``valid_to``, the next such time. Fetches go by ``at`` within a batch; of two at
    one time the greater hash is later. Given the same folder again, it goes on where it stopped.
    """
    spark = stream.sparkSession
    base = folder or tables.scratch(spark, "snapshots")
    state = Parts(spark, f"{base}/index", INDEX, "id")

    def one(batch: DataFrame, number: int) -> None:
        state.forget(number)
        parts = state.of(batch)
        if not parts:
            return
        old = state.table(number, parts)
        good = (F.col("status") == "ok") & (F.coalesce("text", F.lit("")) != "")
        hashed = batch.withColumn("id", F.col("id").cast("string")).withColumn("hash", F.when(good, F.substring(F.sha1(F.col("text").cast("binary")), 1, 16)))
        before = Window.partitionBy("id").orderBy("at", F.coalesce("hash", F.lit(""))).rowsBetween(Window.unboundedPreceding, -1)
        rows = hashed.join(old.select("id", F.col("content_hash").alias("_old")), "id", "left")
        rows = rows.withColumn("_was", F.coalesce(F.last("hash", ignorenulls=True).over(before), "_old")).withColumn("_new", F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("_was")))
        log = rows.filter("_new").select("id", F.col("at").alias("valid_from"), F.when(F.col("_was").isNull(), "new").otherwise("changed").alias("outcome"), F.col("hash").alias("content_hash"), F.length("text").alias("chars"), "page_title", "page_updated", F.col("http_status").cast("int").alias("http_status"), "text")
        log.write.mode("overwrite").parquet(f"{base}/log/_batch={number}")
        place = F.struct("at", F.coalesce("hash", F.lit("")))
        last = F.max_by(F.struct("status", F.col("http_status").cast("int").alias("http_status"), "error"), place)
        kept = F.max_by(F.struct(F.col("hash").alias("content_hash"), F.length("text").alias("chars"), "page_title", "page_updated"), F.when(F.col("hash").isNotNull(), place))
        when = lambda c: F.when(c, F.col("at"))
        now = rows.groupBy("id").agg(last.alias("_l"), kept.alias("_k"), F.max("at").alias("_checked"), F.max(when(F.col("hash").isNotNull())).alias("_ok"), F.max(when(F.col("_new"))).alias("_changed"), F.min(when(F.col("_new"))).alias("_first"))
        o, n = old.alias("o"), now.alias("n")
        fresh = F.col("n.id").isNotNull()
        of = lambda c, new: F.when(fresh, new).otherwise(F.col(f"o.{c}")).alias(c)
        mine = lambda c: F.when(F.col("n._k").isNotNull(), F.col(f"n._k.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        index = n.join(o, F.col("n.id") == F.col("o.id"), "full_outer").select(
            F.coalesce("n.id", "o.id").alias("id"), F.coalesce("o.first_seen", "n._first").alias("first_seen"), *[mine(c) for c in ("content_hash", "chars", "page_title", "page_updated")], F.coalesce("n._changed", "o.changed_at").alias("changed_at"),
            F.coalesce("n._ok", "o.last_ok").alias("last_ok"), of("last_checked", F.col("n._checked")), *[of(c, F.col(f"n._l.{c}")) for c in ("status", "http_status", "error")],
        )
        state.keep(index, number + 1)

    if not state.begun():
        state.keep(spark.createDataFrame([], INDEX), 0)
        spark.createDataFrame([], VERSION).write.mode("overwrite").parquet(f"{base}/log/_batch=-1")
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    log = spark.read.schema(VERSION).parquet(f"{base}/log").select(VERSION.names)
    return state.table(1 << 30), log.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("id").orderBy("valid_from")))


def as_of(versions: DataFrame, at: str) -> DataFrame:
    """The version of each source that held at a time."""
    return versions.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def session_stream(stream: DataFrame, key: str, at: str, gap: str = "12 hours", late: str = "1 hour", folder: str | None = None) -> DataFrame:
    """(key, started, ended, n): sessions of stamps that are ``gap`` or less apart and that have ended: the latest stamp of
    all keys is more than ``late`` past their end. Sessions still open stay in the state, which holds no others, and come when
    later rows do. Rows later than that are passed over; without any rows the result is empty."""
    spark = stream.sparkSession
    base = folder or tables.scratch(spark, "sessions")
    n = stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    rows = n.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/_batch={number}")

    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{base}/out/_batch=-1")
    query = rows.writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out").select(rows.columns)
