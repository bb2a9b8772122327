"""N-gram Jaccard join with Bayesian candidate pruning.

All pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, as links of a graph.

1. Texts with equal shingle sets become one class (pre-aggregated), so copies are never compared with each other.
2. MinHash signatures of the classes are cut into bands; classes in one band bucket are candidates.
3. Within a bucket, signatures are compared a few values at a time. After each step a pair is dropped if the posterior
   probability that its similarity reaches the threshold, given the values that agreed so far and a uniform prior, is below the
   tolerance. What is left of a bucket gives the links of a spanning forest only, not its pairs.
4. In each component of these links, the pairs are pruned once more and what is left is verified exactly. Each class learns how
   many documents it is linked with, and its exact links again give a spanning forest, whose components are the result.

Buckets and components of any size are dealt out as pairs of blocks of about BLOCK classes, each its own group in the shuffle,
so no task holds more than two blocks, and no pair of documents leaves a task. What is copied to block pairs are signatures and
the differences of shingle sets within a component, never texts: each text of a candidate is shuffled once.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_groups, free_name, hot_join, packed, small_batches, text_of, unpacked, written
from .components import components
from .shingles import MinHash, shingle_set

#: Bands and rows of the signature (a pair of similarity 0.8 shares none in 3 of a million cases), values compared at a time,
#: the posterior probability below which a pair is dropped, classes of a block.
BANDS, ROWS, STEP, TOLERANCE, BLOCK, SIMILAR = 24, 4, 16, 1e-6, 256, 0.8
#: Columns of the matrices whose product counts the shingles that sets share.
WIDE = 4096
#: Rows of a block pair that are tried as the one that the others are like.
LEADS = 4
#: Bits of the map that keeps texts which are no candidates from being shuffled.
BITS = 1 << 26


class Banding(NamedTuple):
    """Bands and rows of a signature, the seed of its hash functions, and the values compared at a time."""

    bands: int = BANDS
    rows: int = ROWS
    seed: int = 3
    step: int = STEP

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def hashes(self) -> MinHash:
        return MinHash(self.size, self.seed)


@lru_cache
def least_agreeing(threshold: float, tolerance: float, size: int, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, agreements needed to go on). With a uniform prior, P(similarity >= t | m of k agree) is the
    probability of at most m heads in k + 1 tosses of a coin that shows heads with probability t."""
    out = []
    for k in range(step, size + 1, step):
        total = 0.0
        for m in range(k + 1):
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if total >= tolerance:
                break
        out.append((k, m))
    return out


def surviving(left: np.ndarray, right: np.ndarray, plan: list[tuple[int, int]], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``left`` and ``right`` (signatures) that no step drops; each pair once if they are the same."""
    k, need = plan[0]
    agree = np.zeros((len(left), len(right)), np.int16)
    for c in range(k):
        agree += left[:, c, None] == right[None, :, c]
    i, j = np.nonzero(agree >= need)
    if same:
        i, j = i[i < j], j[i < j]
    counts = agree[i, j]
    for (low, _), (high, need) in zip(plan, plan[1:], strict=False):
        counts = counts + (left[i, low:high] == right[j, low:high]).sum(1)
        keep = counts >= need
        i, j, counts = i[keep], j[keep], counts[keep]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the least row that the pairs connect it with."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = np.minimum(new, new[new])
        if (new == low).all():
            break
        low = new
    return low


def digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(docs: DataFrame, banding: Banding) -> DataFrame:
    """(doc_id, row, key, sig): the MD5 of each text, the digest of its shingle set and its signature, 16 bits a value; the last
    two are null without words."""
    hashes = banding.hashes()

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x) for x in batch.column("text").to_pylist()]
            sigs = [hashes.signature(s).astype("<u2").tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(map(digest, sets), pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "row", "key", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_of().alias("row"), text_of(docs).alias("text")).mapInArrow(run, f"doc_id {kind}, row binary, key binary, sig binary")


def row_of() -> Column:
    """What tells rows of one doc_id apart: the MD5 of the text, null as empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def in_blocks(members: DataFrame, group: str, n: Column) -> DataFrame:
    """``members`` with (lo, hi, side): a row for each pair of blocks of its group that it takes part in; ``n`` is the group's
    size. Groups of a block or less have one pair, and each row comes once."""
    blocks = F.ceil(n / BLOCK).cast("int")
    rows = members.withColumn("_m", blocks).withColumn("_b", F.pmod(F.xxhash64("key"), F.col("_m")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    side = F.when(F.col("_b") == F.col("_o"), 0).when(F.col("_b") < F.col("_o"), 1).otherwise(2)
    rows = rows.withColumn("lo", F.least("_b", "_o")).withColumn("hi", F.greatest("_b", "_o")).withColumn("side", side).drop("_m", "_b", "_o")
    return rows.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "key")


def _halves(rows, side):
    """Row numbers of the two blocks; both are all rows if the group is one block with itself."""
    sides = np.array([r[side] for r in rows])
    return (np.flatnonzero(sides == 1), np.flatnonzero(sides == 2)) if (sides > 0).any() else (np.arange(len(rows)),) * 2


def _pairs(sigs, rows, side, plan):
    left, right = _halves(rows, side)
    same = left is right
    i, j = surviving(sigs[left], sigs[right], plan, same)
    return left[i], right[j]


def connected(sigs: np.ndarray, rows: list[tuple], side: int, plan: list[tuple[int, int]]) -> np.ndarray:
    """For each row of a block pair the least row that the pairs which no step drops connect it with.

    The rows that one of them, the lead, isn't dropped with are connected by it, so pairs of two such rows are not compared: a
    block of texts alike costs its size, not its square. All others are.
    """
    best = np.zeros(0, np.int64)
    for lead in sorted({len(rows) * k // LEADS for k in range(LEADS)}):
        _, like = surviving(sigs[lead : lead + 1], sigs, plan, False)
        if len(like) > len(best):
            best, first = like, lead
        if len(best) == len(rows):
            return np.zeros(len(rows), np.int64)
    led = np.zeros(len(rows), bool)
    led[best] = True
    left, right = _halves(rows, side)
    i, j = [np.full(len(best), first)], [best]
    for a, b in ((left[~led[left]], right), (left, right[~led[right]]))[: 1 if left is right else 2]:
        x, y = surviving(sigs[a], sigs[b], plan, False)
        i.append(a[x])
        j.append(b[y])
    return forest(len(rows), np.concatenate(i), np.concatenate(j))


def candidates(classes: DataFrame, threshold: float, tolerance: float, banding: Banding) -> DataFrame:
    """(a, b): keys of ``classes`` (key, sig) with the least key that pruning leaves them connected with in a block pair."""
    plan, width = least_agreeing(threshold, tolerance, banding.size, banding.step), banding.rows * 2
    band = lambda i: F.xxhash64(F.substring(F.col("sig"), i * width + 1, F.lit(width)), i)
    bands = classes.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(banding.bands - 1)), band)).alias("bucket"))
    shared = written(bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = written(hot_join(bands, shared, "bucket", "n"), "buckets")
    members = members.join(classes, "key")

    def run(batches):
        out = []
        for _, rows in arrow_groups(batches, ("bucket", "lo", "hi"), ("key", "sig", "side")):
            sigs = np.frombuffer(b"".join(r[1] for r in rows), "<u2").reshape(len(rows), -1)
            low = connected(sigs, rows, 2, plan)
            out += [(rows[i][0], rows[k][0]) for i, k in enumerate(low) if k != i]
            if len(out) > 20000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])

    dealt = in_blocks(members, "bucket", F.col("n")).select("bucket", "lo", "hi", "key", "sig", "side")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each array of ``left`` shares with each of ``right``; no array has a value twice. Values are taken WIDE at
    a time as the columns of two matrices of zeros and ones, whose product counts."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(left) or not len(right):
        return out
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def placed(sets):
        """(row, place in ``both``) of the values that are there, by place."""
        values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(both, values)
        at[at == len(both)] = 0
        there = both[at] == values if len(both) else np.zeros(len(values), bool)
        at, row = at[there], row[there]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (row_a, at_a), (row_b, at_b) = placed(left), placed(right)
    for lo in range(0, len(both), WIDE):
        x, y = np.zeros((len(left), WIDE), np.float32), np.zeros((len(right), WIDE), np.float32)
        for m, row, at in ((x, row_a, at_a), (y, row_b, at_b)):
            i, j = np.searchsorted(at, (lo, lo + WIDE))
            m[row[i:j], at[i:j] - lo] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def _linked(keys: list[bytes], copies: list[int], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
    """(a, b, links) of the classes of a block pair that the pairs (i, j) link."""
    copies = np.array(copies, np.int64)
    links = np.zeros(len(keys), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    low, some = forest(len(keys), i, j), np.flatnonzero(links)
    if not len(some):
        return None
    return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in some], pa.binary()), pa.array([keys[low[k]] for k in some], pa.binary()), pa.array(links[some], pa.int64())], names=["a", "b", "links"])


#: What is known of a class of a large component: ``size`` of its shingle set, ``core`` of its component's, ``missing`` (shingles of the
#: core that it lacks), ``delta`` (those and the shingles that the core lacks), its signature.
_FACTS = "comp {}, n long, key binary, copies long, size long, core long, missing long, delta binary, sig binary"


def verified(members: DataFrame, threshold: float, tolerance: float, banding: Banding) -> DataFrame:
    """(a, b, links) for ``members`` (comp, n, base, key, copies, text, packed): in each block pair, the documents that a class is
    linked with, and the least class that exact links connect it with.

    Each text is shuffled once. Components of one block are compared then and there. In larger ones, each class becomes the
    difference of its shingle set from that of one class of the component (``base``, which goes to every block), and only
    differences and signatures are copied to the block pairs: with D the difference and m the shingles of the base that are
    missing, two sets share |base| - m - m' + |D and D'| shingles, exactly, whatever the base is.
    """
    plan = least_agreeing(threshold, tolerance, banding.size, banding.step)
    hashes = banding.hashes()
    kind = members.schema["comp"].dataType.simpleString()
    facts = _FACTS.format(kind)
    names = ["a", "b", "links", *[x.split()[0] for x in facts.split(", ")]]

    def settle(batches):
        for (comp, _), rows in arrow_groups(_sets(batches), ("comp", "block"), ("key", "copies", "n", "base", "own", "set")):
            rows = [r for k, r in enumerate(rows) if not k or r[0] != rows[k - 1][0]]
            sets = [np.frombuffer(r[5], np.uint64) for r in rows]
            sigs = [hashes.signature(s).astype("<u2") for s in sets]
            if rows[0][2] <= BLOCK:
                got = _linked([r[0] for r in rows], [r[1] for r in rows], *_verified_pairs(sets, np.stack(sigs)))
                if got is not None:
                    yield pa.RecordBatch.from_arrays([*got.columns, *[pa.nulls(got.num_rows, k) for k in kinds]], names=names)
                continue
            base = sets[0] if rows[0][0] == rows[0][3] else np.zeros(0, np.uint64)
            out = []
            for (key, copies, n, _, own, _), s, sig in zip(rows, sets, sigs, strict=True):
                if own:
                    missing = len(base) - np.count_nonzero(np.isin(base, s, assume_unique=True))
                    out.append((comp, n, key, copies, len(s), len(base), missing, np.setxor1d(base, s, assume_unique=True).tobytes(), sig.tobytes()))
            if out:
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(out), k) for k in (pa.binary(), pa.binary(), pa.int64())], *cols], names=names)

    def _verified_pairs(sets, sigs):
        i, j = surviving(sigs, sigs, plan, True)
        good = np.zeros(len(i), bool)
        for k, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            a, b = (sets[p], sets[q]) if len(sets[p]) < len(sets[q]) else (sets[q], sets[p])
            if len(a) < threshold * len(b):
                continue
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            common = np.count_nonzero(b[at] == a)
            good[k] = common >= threshold * (len(a) + len(b) - common) - 1e-9
        return i[good], j[good]

    def compare(batches):
        for _, rows in arrow_groups(batches, ("comp", "lo", "hi"), ("key", "copies", "side", "size", "core", "missing", "delta", "sig")):
            i, j = _pairs(np.frombuffer(b"".join(r[7] for r in rows), "<u2").reshape(len(rows), -1), rows, 2, plan)
            if not len(i):
                continue
            size, missing = (np.array([r[k] for r in rows], np.int64) for k in (3, 5))
            (left, at_i), (right, at_j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
            delta = lambda which: [np.frombuffer(rows[k][6], np.uint64) for k in which]
            common = rows[0][4] - missing[i] - missing[j] + common_counts(delta(left), delta(right))[at_i, at_j]
            good = common >= threshold * (size[i] + size[j] - common) - 1e-9
            got = _linked([r[0] for r in rows], [r[1] for r in rows], i[good], j[good])
            if got is not None:
                yield got

    kinds = [members.select("comp").limit(0).toArrow().schema.field(0).type, pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("key"), blocks).cast("int")
    leads = (F.col("key") == F.col("base")) & (F.col("n") > BLOCK)
    dealt = members.withColumn("mine", mine).withColumn("block", F.explode(F.when(leads, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("mine"))))
    dealt = dealt.select("comp", "block", "n", "base", "key", "copies", (F.col("mine") == F.col("block")).alias("own"), "text")
    dealt = dealt.repartition("comp", "block").sortWithinPartitions("comp", "block", (F.col("key") != F.col("base")).cast("int"), "key")
    settled = written(dealt.mapInArrow(settle, f"a binary, b binary, links long, {facts}"), "settled")
    large = in_blocks(settled.filter("key is not null").drop("a", "b", "links"), "comp", F.col("n"))
    large = large.select("comp", "lo", "hi", "key", "copies", "side", "size", "core", "missing", "delta", "sig").mapInArrow(compare, "a binary, b binary, links long")
    return settled.filter("a is not null").select("a", "b", "links").unionByName(large)


def _sets(batches):
    """The batches with shingle sets in the place of texts, without rows whose text isn't that of their key (a repeated id)."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sets = [shingle_set(x) for x in unpacked(part.column("text").to_pylist())]
            fits = pa.array([digest(s) == k for s, k in zip(sets, part.column("key").to_pylist(), strict=True)])
            part = part.select([c for c in part.schema.names if c != "text"])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([s.tobytes() for s in sets], pa.binary())], names=[*part.schema.names, "set"]).filter(fits)


def linked(docs: DataFrame, threshold: float = SIMILAR, tolerance: float = TOLERANCE, banding: Banding | None = None) -> DataFrame:
    """One row a document of ``docs`` (doc_id, text): doc_id, row, key, class_id, copy_id, n_links, first; see similar_classes.

    row and key are the digests of the text and of its shingle set; first is whether it is the first row of its class by doc_id
    and row. For texts without words and null ids key is null, and first is true.
    """
    banding = banding or Banding()
    small_batches(docs.sparkSession)
    sketch = written(sketches(docs, banding), "sketches")
    has_key = F.col("key").isNotNull() & F.col("doc_id").isNotNull()
    classes = sketch.filter(has_key).groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("head"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = written(classes, "classes")
    groups = written(components(candidates(classes.select("key", "sig"), threshold, tolerance, banding)), "groups")
    sizes = written(groups.groupBy("comp").agg(F.count("*").alias("n"), F.min("node").alias("base")), "sizes")
    members = hot_join(groups.withColumnRenamed("node", "key"), sizes, "comp", "n")
    members = written(members.join(classes.select("key", F.col("head.doc_id").alias("copy_id"), "copies"), "key"), "members")
    texts = known_only(docs.filter("doc_id is not null").select(F.col("doc_id").alias("copy_id"), text_of(docs).alias("text")), members, "copy_id")
    texts = texts.select("copy_id", packed(F.col("text")).alias("text"))
    exact = written(verified(texts.join(members, "copy_id"), threshold, tolerance, banding), "verified")
    links = exact.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "key")
    named = written(components(exact.select("a", "b")).withColumnRenamed("node", "key").join(classes.select("key", "head"), "key"), "named")
    heads = written(named.groupBy("comp").agg(F.min("head").alias("first"), F.count("*").alias("n")), "heads")
    named = hot_join(named.select("key", "comp"), heads, "comp", "n").select("key", "first")
    rows = classes.select("key", "head", "copies").join(links, "key", "left").join(named, "key", "left")
    rows = written(rows.select("key", "head", F.coalesce("first", "head").alias("first"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
    out = hot_join(sketch.filter(has_key).select("doc_id", "row", "key"), rows, "key", "copies")
    out = out.select("doc_id", "row", "key", F.col("first.doc_id").alias("class_id"), F.col("head.doc_id").alias("copy_id"), "n_links", (F.struct("doc_id", "row") == F.col("first")).alias("first"))
    alone = sketch.filter(~has_key).select("doc_id", "row", F.lit(None).cast("binary").alias("key"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return out.unionByName(alone)


def known_only(rows: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """``rows`` without most of those whose ``on`` isn't in ``known``, before they are shuffled: a bitmap of BITS hashed values
    of ``known``, which has the same size whatever the input, is broadcast. It only saves shuffling; a join must follow."""
    place = F.pmod(F.xxhash64(on), F.lit(BITS))
    maps = known.select((place + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in maps.toLocalIterator():  # BITS / 32768 maps of 4096 bytes at most, counted from 1
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def there(place):
        p = place.to_numpy()
        return pd.Series((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)

    return rows.filter(there(place))


def similar_classes(docs: DataFrame, threshold: float = SIMILAR, tolerance: float = TOLERANCE) -> DataFrame:
    """One row a document of ``docs`` (doc_id, text): doc_id, class_id, copy_id, n_links.

    n_links counts the other documents with a similarity of ``threshold`` or more, class_id is the least doc_id that such
    links lead to in any number of steps, copy_id the least doc_id with the same set of shingles. A text of fewer than five
    words is one shingle. Texts without words, null texts and null ids are linked with none and stand for themselves. Rows
    with one doc_id are separate documents.
    """
    return linked(docs, threshold, tolerance).select("doc_id", "class_id", "copy_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = SIMILAR, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` without all but one of each class: that with the least doc_id, and the least MD5 of its text.

    Texts without words and null ids stay. Rows with one doc_id are separate documents; of rows equal in doc_id and text one
    stays. All columns are kept.
    """
    found = written(linked(docs.select("doc_id", "text"), threshold, tolerance), "linked")
    own = free_name("_row", docs.columns)
    gone = found.filter(~F.col("first")).select("doc_id", F.col("row").alias(own)).distinct()
    left = docs.withColumn(own, row_of()).join(gone, ["doc_id", own], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns], own)
    if found.filter("key is not null").groupBy("doc_id", "row").count().filter("count > 1").isEmpty():
        return left.drop(own)
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return left.filter(~alone).dropDuplicates(["doc_id", own]).unionByName(left.filter(alone)).drop(own)
