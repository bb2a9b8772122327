"""Connected components of a table of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b): comp is the least node that it is connected with.

    First, the links of a node are drawn together: it keeps the one with its least neighbour, with which its others are linked
    instead, so that several stars over the same nodes become one. Then the leaves are set aside: nodes with one link take the
    label of their neighbour at the end. Of what is left, in each round every node takes the least label of its neighbours
    (pre-aggregated), then the label of its label, so the rounds grow with the logarithm of a component's width. Each round's
    labels are a written table. Nulls and loops are passed over.
    """
    links = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(links.distinct(), "links")
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    drawn = links.join(low, "a").select("a", "b", "low")
    drawn = drawn.select(F.inline(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))).filter("a <> b")
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    drawn = written(drawn.distinct(), "drawn")
    leaves = drawn.select(F.inline(ends)).groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out = 1 and into = 0").select(F.col("node").alias("a"), F.lit(True).alias("leaf"))
    drawn = written(drawn.join(leaves, "a", "left"), "drawn")
    inner = drawn.filter("leaf is null").select("a", "b")
    labels = _settled(inner, rounds)
    hung = drawn.filter("leaf").select("a", "b").join(labels.select(F.col("node").alias("b"), "comp"), "b", "left")
    hung = hung.select(F.col("a").alias("node"), F.coalesce("comp", "b").alias("comp"))
    roots = drawn.filter("leaf").select(F.col("b").alias("node")).distinct().join(labels, "node", "left_anti")
    return labels.unionByName(hung).unionByName(roots.select("node", F.col("node").alias("comp")))


def _settled(links: DataFrame, rounds: int) -> DataFrame:
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("low"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        step = step.join(jump, "comp").select("node", "was", F.least("comp", "further").alias("comp"))
        step = written(step, "labels")
        labels = step.select("node", "comp")
        if step.filter("was <> comp").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
