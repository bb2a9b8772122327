"""Byte-level BPE by longest matches and backtracking.

A text is split by the tokenizer's pattern, and each piece is encoded alone. Bytes are mapped to Latin-1 characters, so that
one Aho-Corasick pass over a piece finds the longest token at every place. Encoding then walks from left to right: it takes
the longest token whose pairing with the token before is one that the merges themselves would leave standing, tries shorter
ones where it isn't, and steps back where none is left. A bit for each place records the dead ends, so no place is tried
twice: the time is linear in the piece. Whether two tokens may stand together depends on these two alone and is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The pattern of the public rank files, with white space spelt as the Unicode property that it means there.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces remembered in a worker; when so many are held they are forgotten. Only time depends on it.
MEMORY, LONGEST_KEPT = 150_000, 64
#: Rows that are coded at a time, so that the ids of few texts are held.
TAKEN = 128


class BytePairs:
    """A rank table: encode(bytes) -> ids as the merges in rank order would give, decode(ids) -> bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self.stands: dict[tuple[int, int], bool] = {}
        finder = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merged_below(token, rank)
                if len(parts) != 2:
                    continue  # no merge makes it: only a piece that is this token as a whole has it
                self.halves[rank] = parts
                self.joined[parts] = rank
            finder.add_word(token.decode("latin-1"), (rank, len(token)))
        made = set(self.halves) | {ranks[bytes([i])] for i in range(256) if bytes([i]) in ranks}
        for rank in made:
            token = self.bytes[rank]
            self.shorter[rank] = next((x for n in range(len(token) - 1, 0, -1) if (x := ranks.get(token[:n])) in made), None)
        finder.make_automaton()
        self.finder = finder

    def _merged_below(self, token: bytes, rank: int) -> tuple[int, ...]:
        """The ids of ``token`` after all merges of a rank below ``rank``."""
        ids = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(ids) > 1:
            best = min(((self.joined.get(p, rank), i) for i, p in enumerate(zip(ids, ids[1:], strict=False))))
            if best[0] >= rank:
                break
            ids[best[1] : best[1] + 2] = [best[0]]
        return tuple(ids)

    def _pair_stands(self, left: int, right: int) -> bool:
        """Whether merging the bytes of ``left`` + ``right`` ends with just these two tokens.

        Merges are undone one by one, the later first, along the seam. A pair across the seam that could have merged before
        the last undone merge would have been taken instead.
        """
        limit = 1 << 60
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < limit:
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                limit, left = left, a[1]
            else:  # a tie of ranks goes to the left, which has merged before
                limit, right = right + 1, b[0]

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest: list[int] = [0] * n
        for end, (rank, size) in self.finder.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank  # ends ascend, so the last one stored is the longest
        lengths, shorter, stands = self.bytes, self.shorter, self.stands
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(lengths[token])
            fits = alive[end]
            if fits and out:
                pair = (out[-1], token)
                fits = stands.get(pair)
                if fits is None:
                    fits = stands[pair] = self._pair_stands(*pair)
            if fits:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            smaller = shorter[token]
            if smaller is not None:
                token = smaller
                continue
            alive[at] = 0
            token = out.pop()
            at -= len(lengths[token])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def coder(path: str) -> BytePairs:
    """The rank table of a file, which every node has at this path (it comes with an installed package)."""
    return BytePairs(read_ranks(path))


_pieces: dict[tuple[str, str], dict[str, list[int]]] = {}


def encode_text(text: str, path: str, pattern: str = PIECES) -> list[int]:
    import regex

    pairs, known = coder(path), _pieces.setdefault((path, pattern), {})
    if len(known) > MEMORY:
        known.clear()
    if len(pairs.stands) > MEMORY:
        pairs.stands.clear()
    out = []
    for piece in regex.findall(pattern, text):
        ids = known.get(piece)
        if ids is None:
            ids = pairs.encode(piece.encode())
            if len(piece) <= LONGEST_KEPT:
                known[piece] = ids
        out.append(ids)
    return list(chain.from_iterable(out))


def _slices(batches):
    return (batch.slice(i, TAKEN) for batch in batches for i in range(0, batch.num_rows, TAKEN))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` with column ``out``, array<int>: the ids of the whole text; a null text is empty and has none. With ``check``
    also a boolean of that name: whether decoding the ids gives the text again.

    All columns are kept (those named ``out`` or ``check`` are replaced), rows stay where they are.
    """
    small_batches(docs.sparkSession)
    new = [out, *([check] if check else [])]
    cols = [c for c in docs.columns if c not in new]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        pairs = coder(path)
        for batch in _slices(batches):
            texts = batch.column(text).to_pylist()
            ids = [encode_text(x or "", path) for x in texts]
            made = [pa.array(ids, pa.list_(pa.int32()))]
            if check:
                made.append(pa.array([pairs.decode(i) == (x or "").encode() for i, x in zip(ids, texts, strict=True)]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in cols], *made], names=[*cols, *new])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in cols], f"`{out}` array<int>", *([f"`{check}` boolean"] if check else [])])
    return docs.select(*cols).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with column ``out``, binary: the bytes of the ids; null ids give null."""

    @F.pandas_udf("binary")
    def back(col):
        return col.map(lambda x: None if x is None else coder(path).decode(list(x)))

    return docs.withColumn(out, back(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text", more: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(more..., n_tokens, ids_sha256, decoded_sha256) of every row: encoded, decoded and digested in one pass, so that
    neither ids nor bytes travel between processes."""
    small_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        pairs = coder(path)
        for batch in _slices(batches):
            rows = []
            for x in batch.column("_text").to_pylist():
                ids = encode_text(x, path)
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pairs.decode(ids)).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            new = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(m) for m in more], *new], names=[*more, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = ", ".join([*[f"`{m}` {kinds[m]}" for m in more], "n_tokens long", "ids_sha256 string", "decoded_sha256 string"])
    return docs.select(*more, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)
