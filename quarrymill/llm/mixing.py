"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in a fixed shuffle (the MD5 of its id) within its source, and each pass over it a virtual
finish time: the source's words up to and including it, divided by the source's target. The passes of all sources are
taken in order of finish time until the budget is spent, so sources advance in step with their targets.

No step gathers a source in one task: running sums are made of sums over hash buckets of a source (pre-aggregated before
the shuffle) and of short runs inside each bucket; the order over all sources is a range partition by finish time whose
sums tell the one range that holds the cut, and only that range is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Weights by a source's place in code point order, repeating; the budget and the most of a source, as parts of its size.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Ranges of virtual finish time: so many to a whole target, up to so many.
RANGES, MOST_RANGES = 4096, 16384


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """(source, skey, source_size, weight, target) of a table with source, skey and size, one row a source.

    Water filling: sources in order of the fill level at which they reach ``repeats`` times their size; the level is that
    of the first source that stays under its own. The windows run over one row for each source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = sized.groupBy("source", "skey").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    cap = (F.col("source_size") * repeats).cast("double")
    order = [F.col("ratio"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn("ratio", cap / F.col("weight"))
    free = (F.floor(share * F.sum("source_size").over(every)) - F.coalesce(F.sum(F.col("source_size") * repeats).over(before), F.lit(0))).cast("double")
    left = (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    per = per.withColumn("level", free / left)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)["level"]
    per = per.withColumn("fill", level).withColumn("budget", F.floor(share * F.sum("source_size").over(every)))
    target = F.when(F.col("ratio") <= F.coalesce("fill", "ratio"), cap).otherwise(F.col("fill") * F.col("weight"))
    return per.select("source", "skey", "source_size", "weight", "budget", target.alias("target"))


def fair_mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS, bucket_digits: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """One row a document of ``docs`` (doc_id, text, source): doc_id, skey, size, source_size, target, passes, taken, ``more``.

    A null text has no words; documents without words, and those of a source without words, are never taken. A null source
    is a source of its own, last in order. Rows with one doc_id are separate documents next to each other in the shuffle.
    An empty table gives an empty table. Of the input, only doc_id, text and source are looked at; the columns ``more`` stay with
    their rows.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = docs.select("doc_id", "source", skey.alias("skey"), size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("place"), *more)
    sized = written(sized.withColumn("bucket", F.substring("place", 1, bucket_digits)), "mix-sizes")
    targets = source_targets(sized, weights, share, repeats)
    sums = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).select("skey", "bucket", "before")
    sums = sums.join(targets.select("skey", "source_size", "target", "budget"), "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.join(sums, ["skey", "bucket"]).withColumn("cum", F.col("before") + F.sum("size").over(inside))
    queued = queued.withColumn("nth", F.row_number().over(inside))
    finishes = [F.when((F.col("target") > 0) & (F.col("size") > 0), (F.col("cum") + i * F.col("source_size")) / F.col("target")) for i in range(repeats)]
    queued = written(queued.withColumn("finish", F.array(*finishes)).select("doc_id", "skey", "place", "nth", "size", "source_size", "target", "budget", "finish", *more), "mix-queue")
    cut = _cut(queued)
    if cut is None:
        return queued.select("doc_id", "skey", "size", "source_size", "target", F.lit(0).alias("passes"), F.lit(0).cast("long").alias("taken"), *more)
    last = F.struct(F.lit(cut["finish"]), F.lit(cut["skey"]), F.lit(cut["place"]), F.lit(cut["nth"]))
    passes = F.size(F.filter("finish", lambda f: F.struct(f, F.col("skey"), F.col("place"), F.col("nth")) <= last))
    passes = F.when(F.col("size") > 0, passes).otherwise(0)
    return queued.select("doc_id", "skey", "size", "source_size", "target", passes.alias("passes"), (passes * F.col("size")).cast("long").alias("taken"), *more)


def _cut(queued: DataFrame):
    """The last pass within the budget (finish, skey, place, nth), or None. At most MOST_RANGES + 1 sums reach the driver."""
    passes = queued.select("skey", "place", "nth", "size", "budget", F.explode("finish").alias("finish")).filter("finish is not null")
    at = F.least(F.floor(F.col("finish") * RANGES), F.lit(MOST_RANGES)).cast("int")
    sums = passes.groupBy(at.alias("at")).agg(F.sum("size").alias("words"), F.max("budget").alias("budget")).orderBy("at").collect()
    before, inside = 0, None
    for r in sums:
        inside = r["at"]
        if before + r["words"] > r["budget"]:
            break
        before += r["words"]
    else:
        before -= sums[-1]["words"] if sums else 0
    if inside is None:
        return None
    order = Window.orderBy("finish", "skey", "place", "nth").rowsBetween(Window.unboundedPreceding, 0)
    edge = passes.filter(at == inside).withColumn("sum", F.lit(before) + F.sum("size").over(order))
    edge = edge.filter("sum <= budget").agg(F.max(F.struct("finish", "skey", "place", "nth")).alias("cut")).first()
    if edge["cut"] is not None:
        return edge["cut"]
    lower = passes.filter(at < inside).agg(F.max(F.struct("finish", "skey", "place", "nth")).alias("cut")).first()
    return lower["cut"]
