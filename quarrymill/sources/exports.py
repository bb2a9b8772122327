"""Exports of several tables that belong together.

A version's tables are written to a folder of their own first; a manifest of one small file, which names them, is added last
and by one rename. Readers go by the newest manifest, so they see all tables of a version or none, and a write that is
broken off leaves the version before it as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import exists

MANIFEST = "version long, folder string, stamp string, tables array<struct<name:string,rows:long,schema:string>>, meta map<string,string>"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of an export: version, folder, stamp, tables (name, rows, schema) and meta, one row for each version."""
    at = f"{path.rstrip('/')}/manifest"
    if not exists(spark, at):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).json(at).filter("version is not null")
    # of two that were written at one time with one number, the later by folder holds
    return rows.groupBy("version").agg(F.max_by(F.struct("folder", "stamp", "tables", "meta"), "folder").alias("m")).select("version", "m.*")


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], stamp: str, meta: dict[str, str] | None = None) -> int:
    """Writes ``tables`` by name as the next version and returns its number. ``meta`` is what is known of the run."""
    path, folder, known = path.rstrip("/"), uuid.uuid4().hex, []
    for name, df in tables.items():
        at = f"{path}/data/{folder}/{name}"
        df.write.parquet(at)
        known.append((name, spark.read.schema(df.schema).parquet(at).count(), df.schema.json()))
    number = (versions(spark, path).agg(F.max("version").alias("v")).first()["v"] or 0) + 1
    row = spark.createDataFrame([(number, folder, stamp, known, meta or {})], MANIFEST)
    row.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return number


def published(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest version, or of the one asked for."""
    own = versions(spark, path)
    own = own.filter(F.col("version") == version) if version else own
    newest = own.orderBy(F.desc("version")).limit(1).collect()
    table = next((t for r in newest for t in r["tables"] if t["name"] == name), None)
    if table is None:
        raise FileNotFoundError(f"no table {name} of version {version or 'newest'} in {path}")
    schema = T.StructType.fromJson(json.loads(table["schema"]))
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/data/{newest[0]['folder']}/{name}")
