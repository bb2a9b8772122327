"""Joins and picks that one frequent key doesn't slow down, and broadcasts that are checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch

#: A key that more than one in so many rows have is hot, so there are no more hot keys than this.
HOT = 1000
#: Rows of a table that is broadcast as it is.
FEW = 20_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: made once, whatever executors are lost later."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, each: int = 8) -> DataFrame:
    """``df`` in so many partitions for each core: a small file is one task, however much work each of its rows makes."""
    return df.repartition(each * df.sparkSession.sparkContext.defaultParallelism)


def skewed_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``big`` joined (inner or left) with ``small``, of which each key has few rows. The hot keys of ``big`` are counted first;
    their rows of ``small`` are broadcast, so those of ``big`` stay where they are. The other keys go by shuffle. Rows with a null
    key meet nothing and aren't shuffled."""
    keys = [on] if isinstance(on, str) else list(on)
    there = F.lit(True)
    for k in keys:
        there = there & F.col(k).isNotNull()
    known = big.filter(there)
    counts = known.groupBy(*keys).agg(F.count("*").alias("_n_of_key"))
    least = (counts.agg(F.sum("_n_of_key").alias("n")).first()["n"] or 0) / HOT
    hot = counts.filter(F.col("_n_of_key") > max(least, 1)).select(*keys).collect()  # HOT keys at most
    if hot:
        hot = F.broadcast(big.sparkSession.createDataFrame(hot, counts.select(*keys).schema))
        out = known.join(F.broadcast(small.join(hot, keys, "left_semi")), keys, how) if how == "inner" else known.join(hot, keys, "left_semi").join(F.broadcast(small.join(hot, keys, "left_semi")), keys, how)
        out = out.unionByName(known.join(hot, keys, "left_anti").join(small, keys, how))
    else:
        out = known.join(small, keys, how)
    return out.unionByName(big.filter(~there), allowMissingColumns=True) if how == "left" else out


def beside(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``: broadcast if that has FEW rows at most, else by ``skewed_join``."""
    if small.limit(FEW + 1).count() <= FEW:
        return big.join(F.broadcast(small), on, how)
    return skewed_join(big, small, on, how)


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], most: int, by: str = "uid", parts: int = 64) -> DataFrame:
    """The first ``most`` rows of each key in ``order``. A key's rows are cut in ``parts`` parts of it (by hash of ``by``)
    first, and the second cut sees ``parts`` * ``most`` rows of a key at the most."""
    part = rows.withColumn("_part_of_key", F.pmod(F.xxhash64(by), F.lit(parts)))
    for w in (Window.partitionBy(*keys, "_part_of_key"), Window.partitionBy(*keys)):
        part = part.withColumn("_place_of_key", F.row_number().over(w.orderBy(*order))).filter(F.col("_place_of_key") <= most).drop("_place_of_key")
    return part.drop("_part_of_key")
