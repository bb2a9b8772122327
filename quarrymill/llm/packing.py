"""Packing documents into sequences of one length: concatenate and cut.

All documents are one long stream of ids, in the order of the partitions and of the rows in them. The first pass encodes
each text once, writes the ids, and gives each document its offset in its partition. The partitions' totals, one row
each, are summed up in two steps (within blocks of partitions, then over the blocks), which gives every partition, and so
every document, its offset in the stream. The stream is cut into windows of fixed length: a document's pieces follow from its
offset and size alone. Sequences are built where their documents lie; only the fragments at the ends of what a task reads
are shuffled, as boundary records, and put together by sequence. Only the last sequence needs padding.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, small_batches

LENGTH, END = 2048, 1
#: Partitions in a block of the first prefix sum. Partition totals up to this many rows are broadcast (some 16 bytes each).
BLOCK, MOST_BROADCAST = 1024, 1_000_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def coder(path: str):
    """The byte-level vocabulary of a tokenizer file, which every node has at this path, as ranks. Special tokens in a text
    are these tokens, as that file's own library has it."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ids_of(text: str, path: str) -> np.ndarray:
    """uint32 ids of the whole text."""
    return coder(path).encode_to_numpy(text, allowed_special="all", disallowed_special=())


def encoded(docs: DataFrame, path: str, text: str = "text", more: tuple[str, ...] = ("doc_id",), end: int = END) -> DataFrame:
    """(more..., part, local, doc_tokens, ids) of every row, written: ``ids`` are little-endian unsigned 32-bit with the end
    id last, ``local`` the ids before it in its partition ``part``."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    stop = np.array([end], "<u4").tobytes()

    def run(batches):
        part, local = TaskContext.get().partitionId(), 0
        for batch in batches:
            data = [ids_of(x or "", path).astype("<u4", copy=False).tobytes() + stop for x in batch.column("_text_to_pack").to_pylist()]
            n = np.fromiter((len(x) // 4 for x in data), np.int64, len(data))
            before = local + np.cumsum(n) - n
            local += int(n.sum())
            new = [pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(m) for m in more], *new], names=[*more, "part", "local", "doc_tokens", "ids"])

    schema = ", ".join([*[f"`{m}` {kinds[m]}" for m in more], "part int, local long, doc_tokens long, ids binary"])
    out, at = docs.select(*more, F.col(text).alias("_text_to_pack")).mapInArrow(run, schema), new_path(spark, "packed-ids")
    out.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(out.schema).parquet(at)


def placed(ids: DataFrame) -> DataFrame:
    """``ids`` (of ``encoded``) with ``at``, the ids before the document in the whole stream, in place of ``part`` and ``local``."""
    totals = ids.groupBy("part").agg(F.sum("doc_tokens").alias("n")).withColumn("block", F.floor(F.col("part") / BLOCK))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 1024 partitions
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("blocks_before"))
    starts = totals.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block")
    starts = starts.select("part", (F.col("blocks_before") + F.col("before")).alias("before"))
    few = totals.count() <= MOST_BROADCAST
    return ids.join(F.broadcast(starts) if few else starts, "part").withColumn("at", F.col("before") + F.col("local")).drop("part", "local", "before")


def pieces(stream: DataFrame, more: tuple[str, ...] = ("doc_id",), length: int = LENGTH) -> DataFrame:
    """(more..., start, length, ids_crc32, doc_tokens, sequence_id, offset): the windows that each document of ``placed`` has
    a part in, a row each. Every id is in one piece, and offsets in a sequence leave no gap."""

    def piece(k):
        start = F.greatest(k * length - F.col("at"), F.lit(0))
        size = F.least((k + 1) * length - F.col("at"), F.col("doc_tokens")) - start
        crc = F.crc32(F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (size * 4).cast("int")))
        return F.struct(start.alias("start"), size.alias("length"), crc.alias("ids_crc32"), k.alias("sequence_id"), (F.col("at") + start - k * length).alias("offset"))

    window = lambda x: F.floor(x / length)
    of = F.transform(F.sequence(window(F.col("at")), window(F.col("at") + F.col("doc_tokens") - 1)), piece)
    cut = stream.select(*more, "doc_tokens", F.explode(of).alias("_piece"))
    return cut.select(*more, *[F.col(f"_piece.{c}") for c in ("start", "length", "ids_crc32")], "doc_tokens", F.col("_piece.sequence_id"), F.col("_piece.offset"))


def sequences(stream: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids): the packed sequences, ``ids`` little-endian unsigned 32-bit, ``length`` of them in all but the last.

    A task makes the sequences that lie whole in the run of documents it reads; what its runs begin or end with goes by
    shuffle, at most ``length`` ids for a sequence."""
    width = 4 * length

    def run(batches):
        held, begin, expected = bytearray(), 0, None  # held: bytes of the stream from begin (in bytes) on
        rows: list[tuple] = []
        for batch in batches:
            for at, ids in zip(batch.column("at").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if at != expected:
                    if held:
                        rows.append((begin // width, begin % width // 4, bytes(held)))
                    held, begin = bytearray(), 4 * at
                held += ids
                expected = at + len(ids) // 4
                used = 0
                while (begin + used) // width < (begin + len(held)) // width:
                    size = width - (begin + used) % width
                    rows.append(((begin + used) // width, (begin + used) % width // 4, bytes(held[used : used + size])))
                    used += size
                del held[:used]
                begin += used
            yield out(rows)
            rows = []
        if held:
            rows.append((begin // width, begin % width // 4, bytes(held)))
        yield out(rows)

    def out(rows):
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["sequence_id", "offset", "ids"])

    made = stream.select("at", "ids").mapInArrow(run, "sequence_id long, offset long, ids binary")
    at = new_path(stream.sparkSession, "sequences")
    made.write.option("compression", "zstd").parquet(at)  # so that texts aren't walked twice
    made = stream.sparkSession.read.schema(made.schema).parquet(at)
    whole = F.length("ids") == width
    parts = made.filter(~whole).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("of"))
    joined = F.aggregate("of", F.lit(b"").cast("binary"), lambda x, p: F.concat(x, p["ids"]))
    return made.filter(whole).select("sequence_id", "ids").unionByName(parts.select("sequence_id", joined.alias("ids")))


def pack(docs: DataFrame, path: str, text: str = "text", more: tuple[str, ...] = ("doc_id",), end: int = END) -> DataFrame:
    """(more..., doc_tokens, ids, at): every document's ids and its place in the stream, for ``pieces`` and ``sequences``.

    A null text is an empty one, which has the end id alone. Rows with one id are documents of their own; an empty table
    has no pieces and no sequences. Of the input, only ``text`` and ``more`` are looked at.
    """
    return placed(encoded(docs, path, text, more, end))
