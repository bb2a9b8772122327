"""Line dedup by winnowing, in DataFrame operations only.

Lines are hashed, and windows of consecutive lines slide over a text: from each line on, and up to each line, the fewest lines
that have LEAST_WORDS words together. The least line hash of a window is its fingerprint, so texts that share a run of lines
with so many words share a fingerprint for certain. Fingerprints that stand at one place only end there. At the places that
share one, matches are extended both ways: the windows around it are compared whole (a run of any length is the union of its
windows, those from a line on reach to its end and those up to a line back to its start). Of equal windows the first in order
of document and line stays; the lines of the later ones are deleted.

Windows are compared by 128 bits of hashes of their lines: 64 would let some of 10^12 windows meet others by chance.

A line goes if and only if it lies in a run of lines with LEAST_WORDS words or more that stands earlier too. Every deleted line
so has an earlier equal, and the earliest of all stays.

Hot lines are aggregated before they are shuffled, and a window is joined with the one row of its key, never with the other
windows of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, free_name, let, salted_join, text_of, written

LEAST_WORDS = 50
#: What is hashed before a line for its second hash.
SECOND = 1


def line_table(rows: DataFrame) -> DataFrame:
    """(doc_id, row, pos, h, h2, n, start, end) of every line with a word: its place among all lines, two hashes of it, its words, and
    the words of the text before it and up to it."""
    bare = lambda x: F.btrim(x, F.lit(SPACES))
    lines = F.transform(F.split(text_of(rows), "\n"), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(bare(x)).alias("h"), F.xxhash64(F.lit(SECOND), bare(x)).alias("h2"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("n")))
    flat = rows.select("doc_id", "row", F.inline(F.filter(lines, lambda x: x["n"] > 0)))
    flat = flat.repartition("doc_id", "row").dropDuplicates(["doc_id", "row", "pos"])  # rows with equal ids and texts are one
    run = Window.partitionBy("doc_id", "row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return flat.withColumn("end", F.sum("n").over(run)).withColumn("start", F.col("end") - F.col("n"))


def windows(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, row, first, last, key, key2, print, at): windows of at least ``least_words`` words; 128 bits of hashes of all lines of
    each, its least line hash and where that line stands. A window has at most ``least_words`` lines."""
    doc = Window.partitionBy("doc_id", "row")
    spans = {"on": doc.orderBy("start").rangeBetween(0, least_words - 1), "up": doc.orderBy("end").rangeBetween(1 - least_words, 0)}
    cols = [
        F.struct(F.sum("n").over(w).alias("words"), F.min("pos").over(w).alias("first"), F.max("pos").over(w).alias("last"), F.collect_list(F.struct("h", "pos", "h2")).over(w).alias("hs")).alias(name)
        for name, w in spans.items()
    ]
    both = lines.select("doc_id", "row", *cols).select("doc_id", "row", F.inline(F.array("on", "up"))).filter(F.col("words") >= least_words)
    least = F.array_min("hs")
    of = lambda h: F.transform("hs", lambda x: x[h])
    whole = F.xxhash64(of("h"), F.size("hs")).alias("key"), F.xxhash64(F.lit(SECOND), of("h2"), F.size("hs")).alias("key2")
    return both.select("doc_id", "row", "first", "last", *whole, least["h"].alias("print"), least["pos"].alias("at"))


def repeated_lines(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, row, gone array<int>): the places of the lines to delete, for the rows of ``rows`` (doc_id, row, text) that have
    any."""
    lines = written(line_table(rows), "lines")
    found = written(windows(lines, least_words), "windows")
    at = F.struct("doc_id", "row", "first")
    place = F.struct("doc_id", "row", "at")
    shared = found.groupBy("print").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("print")
    near = salted_join(found, shared, "print", "left_semi", salts=4)
    key = ("key", "key2")
    first = near.groupBy(*key).agg(F.min(at).alias("kept"), F.max(at).alias("latest")).filter("kept <> latest").select(*key, "kept")
    later = salted_join(near, first, key, salts=4).filter(at > F.col("kept"))
    spans = later.groupBy("doc_id", "row", "first").agg(F.max("last").alias("last"))
    marks = lines.select("doc_id", "row", "pos", F.lit(None).cast("int").alias("reach")).unionByName(spans.select("doc_id", "row", F.col("first").alias("pos"), F.col("last").alias("reach")))
    so_far = Window.partitionBy("doc_id", "row").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    covered = marks.withColumn("to", F.max("reach").over(so_far)).filter("reach is null and to >= pos")
    return covered.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, any others) with the repeated lines deleted from text, and columns n_lines and n_deleted.

    Lines are compared without the ASCII white space at their ends, lines without a word are passed over and stay. A null text
    stays null, an empty one empty. A null doc_id comes first; rows with one doc_id are separate documents in order of their
    texts' MD5, and rows equal in both are treated alike. Columns named n_lines or n_deleted are replaced.
    """
    cols = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    ids = docs.select("doc_id", "text", key.alias("row"))
    gone = repeated_lines(ids, least_words)
    own = free_name("_text_key", docs.columns)
    both = docs.select(*[F.col(f"`{c}`") for c in cols], key.alias(own)).alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{own}") == F.col("g.row")), "left")
    lines = F.split("d.text", "\n")
    gone_at = F.col("g.gone")
    starts = F.filter(gone_at, lambda x, i: ~F.coalesce(F.get(gone_at, i - 1) == x - 1, F.lit(False)))
    ends = F.filter(gone_at, lambda x, i: ~F.coalesce(F.get(gone_at, i + 1) == x + 1, F.lit(False)))
    kept = let(lines, lambda ls: F.array_join(F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), ends), F.concat(starts, F.array(F.size(ls))), lambda a, b: F.slice(ls, a + 2, b - a - 1))), "\n"))
    out = [F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(kept).alias(c) if c == "text" else F.col(f"d.`{c}`") for c in cols]
    return both.select(*out, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("g.gone"), F.lit(0)).alias("n_deleted"))
