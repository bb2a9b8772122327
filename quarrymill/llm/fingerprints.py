"""Document fingerprints: MinHash signatures over word shingles, banded and joined.

``signatures`` maps texts to signatures without a shuffle. ``near_duplicates`` joins the bands of signatures: texts with equal
shingle sets become one class first, classes that share a band bucket are compared (in pairs of blocks, so a bucket of any size
is dealt out), and the Jaccard similarity of what the signatures don't rule out is verified exactly. ``beside_next`` streams
documents in descending order of id, each with its successor, over a range partition, and compares fingerprints; classes and
link counts travel with the documents as short rows of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import packed, shuffle_parts, small_batches, unpacked
from .ngramjoin import Banding, digest, linked
from .shingles import MinHash, shingle_set

#: Hash functions; rows of a band; similarity; the chance that too few values of a signature agree at that similarity. Pairs of
#: similarity 0.8 share no band of 16 with 4 rows in 2 of 10,000 cases.
SIZE, ROWS, SIMILAR, MISSED = 64, 4, 0.8, 1e-6
LOWEST = -(1 << 63)


def signature(text: str, size: int = SIZE) -> np.ndarray:
    return _minhash(size).signature(shingle_set(text))


_hashes: dict[int, MinHash] = {}


def _minhash(size: int) -> MinHash:
    return _hashes.setdefault(size, MinHash(size))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The part of equal values: an estimate of the Jaccard similarity of the shingle sets; texts without words are like each
    other only."""
    return float(np.count_nonzero(a == b)) / len(a)


def signatures(docs: DataFrame, size: int = SIZE, text: str = "text", out: str = "signature") -> DataFrame:
    """``docs`` with column ``out``, binary: the signature's values, big-endian. A null text is empty."""

    @F.pandas_udf("binary")
    def of(texts):
        return texts.map(lambda x: signature(x, size).astype(">u4").tobytes())

    return docs.withColumn(out, of(F.coalesce(F.col(text), F.lit(""))))


def near_duplicates(docs: DataFrame, size: int = SIZE, rows: int = ROWS, threshold: float = SIMILAR) -> DataFrame:
    """(doc_id, row, key, class_id, copy_id, n_links, first) of every row of ``docs`` (doc_id, text): n_links counts the other
    documents with an exact Jaccard similarity of ``threshold`` or more, class_id is the least doc_id that such links lead to.

    row is the MD5 of the text, key the digest of its shingle set, copy_id the least doc_id with it, first whether the row is its
    class's first. Texts without words and null ids are like no other. Rows with one doc_id are separate documents.
    """
    return linked(docs.select("doc_id", "text"), threshold, MISSED, Banding(size // rows, rows, seed=1, step=size))


def beside_next(docs: DataFrame, size: int = SIZE, near: DataFrame | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses (see the columns below), one row a document.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document in
    descending order of doc_id; after the last comes the first. A null text is empty, a null doc_id comes last, rows with one
    id are ordered by a hash of the text; ids are integers, others are a TypeError. Documents are range-partitioned by id once; only the first
    document of each range, which the range above needs as its last successor, goes to two tasks.

    With ``near``, the result of near_duplicates, class_id and n_links are those of it; else each document is its own class.
    """
    if not isinstance(docs.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"doc_id has to be an integer, not {docs.schema['doc_id'].dataType.simpleString()}")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(LOWEST)).alias("_at"), packed(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    parts = shuffle_parts(spark)
    ids = rows.select("_at")
    marks = ids.agg(F.percentile_approx("_at", [i / parts for i in range(1, parts)] or [0.5], 10000).alias("m")).first()["m"]
    bounds = np.unique(np.array(marks or [], np.int64))

    @F.pandas_udf("int")
    def range_of(at):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, at.to_numpy(), side="right").astype(np.int32))

    tops = {r["part"]: r["top"] for r in ids.select(range_of("_at").alias("part"), "_at").groupBy("part").agg(F.max("_at").alias("top")).collect()}
    full = sorted(tops)
    copies = {tops[low]: (high, 0) for low, high in zip(full, full[1:], strict=False)}  # the top of each range ends the next one
    wrap = {tops[full[-1]]: full[0]} if full else {}

    @F.pandas_udf("array<int>")
    def places(at, part):
        import pandas as pd

        def of(a, p):  # pairs of a part and whether the row is there for itself (0), as a successor (1), or as the last one (2)
            out = [int(p), 0]
            if a in copies:
                out += [copies[a][0], 1]
            return out + [wrap[a], 2] if a in wrap else out

        return pd.Series([of(a, p) for a, p in zip(at.tolist(), part.tolist(), strict=True)])

    placed = rows.withColumn("_p", places("_at", range_of("_at")))
    placed = placed.withColumn("_k", F.explode(F.sequence(F.lit(0), (F.size("_p") / 2).cast("int") - 1)))
    placed = placed.withColumn("_part", F.element_at("_p", F.col("_k") * 2 + 1)).withColumn("_as", F.element_at("_p", F.col("_k") * 2 + 2)).drop("_p", "_k")
    columns = ["doc_id", "_at", "_part", "_as", "text", "key", "class_id", "n_links"]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    placed = placed.select("doc_id", "_at", "_part", "_as", "text", none("binary", "key"), none("long", "class_id"), none("long", "n_links"))
    if near is not None:  # a row that says so comes before the rows of its document
        told = near.filter("n_links > 0").select("doc_id", "key", "class_id", "n_links").distinct()
        told = told.select("doc_id", F.col("doc_id").alias("_at"), range_of("doc_id").alias("_part"), F.lit(-1).alias("_as"), none("binary", "text"), "key", "class_id", "n_links")
        placed = placed.unionByName(told)
    dealt = placed.select(*columns).repartitionById(max(parts, len(bounds) + 1), F.col("_part"))
    order = [(F.col("_as") == 2).cast("int"), F.col("_at").desc(), (F.col("_as") != -1).cast("int"), F.xxhash64("text"), "text"]
    dealt = dealt.sortWithinPartitions(*order).select("doc_id", "_as", "text", "key", "class_id", "n_links")

    def run(batches):
        held, facts = None, {}  # doc_id, text, signature, class and links of the row before; what is told of the id at hand
        for batch in batches:
            out = []
            for doc_id, role, text, key, class_id, n_links in zip(*[batch.column(c).to_pylist() for c in dealt_columns], strict=True):
                if role == -1:
                    facts = {k: v for k, v in facts.items() if k[0] == doc_id} | {(doc_id, key): (class_id, n_links)}
                    continue
                (text,) = unpacked([text])
                shingles = shingle_set(text)
                sig = _minhash(size).signature(shingles)
                if held is not None:
                    out.append(_row(*held, text, sig, size))
                near_by = facts.get((doc_id, digest(shingles))) if any(k[0] == doc_id for k in facts) else None
                held = (doc_id, text, sig, *(near_by or (doc_id, 0))) if role == 0 else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)

    dealt_columns = dealt.columns
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, n_links long")


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "n_links"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]


def _row(doc_id, text, sig, class_id, n_links, next_text, next_sig, size):
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    other = signature(edited, size)
    hexed = lambda s: s.astype(">u4").tobytes().hex()
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(sig), hexed(other), likeness(sig, other), likeness(sig, next_sig), class_id, n_links
