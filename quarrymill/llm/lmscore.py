"""Language-model scoring by online logistic context mixing over bits.

A text is coded byte by byte; a byte is a path of binary decisions in a Huffman tree that the bytes before it select, so likely
bytes take few. Three predictors look up each decision in tables hashed by context: the two bytes before, the four bytes
before, and the word so far. The tables are counts over the whole training corpus: each task counts into tables of a fixed size,
and the tables are summed in two shuffles by table block, so that no group grows with the number of tasks.

Mixing is online within a text: the logits of the predictors are summed with weights that a gate (which of the longer contexts
are sure of the byte's first decision) selects, and after each block of the text the weights take a gradient step on its coding
cost. Blocks double in length up to a bound, so early text adapts the weights fast and arrays stay long. Every text starts from
the same weights, so its score doesn't depend on how texts are dealt to tasks.

Hashed tables of a fixed size learn nothing new beyond some size of corpus. What does grow with it is the phrase table: texts
are cut into phrases where a hash of two words says so (one word in PHRASE), and the table holds, by the hash of the four words
before, which phrase follows in most training texts, if it does in two or more. Where a text meets such a context, one more
decision comes before the phrase: whether it is the one predicted. Its logit is the table's counts, weighted by a gate (what
became of the text's last prediction) and adapted after each decision. A phrase that is the predicted one costs nothing else.
Phrases are counted, and met, by shuffle.

The base score needs the exact count of every token. Counts are aggregated by token. The most frequent HEAD ones at most are
broadcast (a bound that doesn't grow); other tokens, each of which is rare by this choice, are joined by shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_groups, hot_join, let, small_batches, text_of, written

#: Slots of a predictor's table and of the blocks in which tables travel; tokens broadcast; tokens held while counting.
SLOT_BITS, PART, HEAD, HELD = 21, 1 << 15, 200_000, 100_000
SLOTS, PARTS = 1 << SLOT_BITS, (1 << SLOT_BITS) // PART + 1
#: First weights of order 2, order 4 and word, for each gate; the gradient step; the count added to each side of a decision;
#: the logit from which a context is sure.
WEIGHTS = ((0.75, 0.3, 0.2), (0.2, 0.75, 0.2), (0.45, 0.1, 0.6), (0.15, 0.45, 0.5))
STEP, PRIOR, SURE = 3.0, 0.2, 1.5
#: Bytes of the first block of a text and of the longest; bytes of the texts that are coded, and counted, together; texts
#: that are taken out of an Arrow batch at a time; logits are held in this part of one; rows of counts, and parts of tables, that
#: are handed to the JVM at a time.
FIRST, LONGEST, TOGETHER, COUNTED, TAKEN, FINE, HANDED, HANDED_PARTS = 64, 1 << 13, 1 << 18, 1 << 18, 256, 1024, 1 << 14, 8
#: Trees of their own for this many of the most frequent pairs of bytes before; other bytes use that of the byte before.
OWN_TREES = 256
#: Words of a phrase, on average; words of its context; first weight, bias and steps of the decision whether a phrase follows.
PHRASE, BEFORE, TRUST, BIAS, TRUST_STEP = 32, 4, 1.0, (-0.5, 2.0, -2.0), 0.1
PAD = b"\0\0\0\0"
GATES, ORDERS = len(WEIGHTS), len(WEIGHTS[0])
ALIGN = 8
PHI = np.uint32(0x9E3779B1)
R = np.uint32(0x2C1B3C6D)
R_INVERSE = np.uint32(pow(0x2C1B3C6D, -1, 1 << 32))


# ---- contexts


class Trees:
    """Huffman trees over all bytes, one for each byte before and for the most frequent pairs of bytes before. The decisions of a
    byte are ``length[tree, byte]`` entries of ``code`` from ``start[tree, byte]`` on: the number of the node (likely ones are
    low), twice, and the bit."""

    def __init__(self, singles: np.ndarray, pairs: np.ndarray | None = None, own: np.ndarray | None = None):
        """``singles``: counts by byte before and byte; ``pairs``: two bytes before each, as one number; ``own``: counts by pair
        and byte."""
        tables = singles.reshape(256, 256)
        self.tree = (np.arange(65536) & 255).astype(np.uint16)
        if pairs is not None and len(pairs):
            self.tree[pairs] = 256 + np.arange(len(pairs), dtype=np.uint16)
            tables = np.concatenate([tables, own.reshape(-1, 256)])
        lengths, codes = [], []
        for counts in tables.tolist():
            heap = [((c << 8) + 1, i) for i, c in enumerate(counts)]  # unseen bytes share less than one count
            heapify(heap)
            up, made = [(0, 0)] * 512, 256
            while len(heap) > 1:
                (a, x), (b, y) = heappop(heap), heappop(heap)
                up[x], up[y] = (made, 0), (made, 1)
                heappush(heap, (a + b, made))
                made += 1
            root = made - 1
            for leaf in range(256):
                path, at = [], leaf
                while at != root:
                    at, bit = up[at]
                    path.append((root - at) * 2 + bit)
                lengths.append(len(path))
                codes += path[::-1]
        self.length = np.array(lengths, np.uint8)
        self.start = np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)[:-1]]).astype(np.int32)
        self.code = np.array(codes, np.uint16)

    def paths(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(decisions of each key, codes of these decisions)."""
        place = key & np.uint32(0x3FFFF)
        n = self.length.take(place).astype(np.int64)
        at = np.repeat(self.start.take(place) - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return n, self.code.take(at)


def lay_out(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes, places of the bytes to code, bytes to code of each text): each text after padding and before an end byte."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    at = np.arange(sizes.sum()) + np.repeat(len(PAD) * np.arange(1, len(texts) + 1), sizes)
    return b"".join([x for t in texts for x in (PAD, t, b"\0")]), at, sizes


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(19, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        ones = np.ones(size, np.uint32)
        _powers[size] = tuple(np.cumprod(np.concatenate([ones[:1], ones[1:] * r]), dtype=np.uint32) for r in (R, R_INVERSE))
    return tuple(p[:n] for p in _powers[size])


def contexts(laid: bytes, at: np.ndarray, tree: np.ndarray) -> list[np.ndarray]:
    """For each place a 32-bit key of every predictor: 14 bits of hashed context, 10 of the tree, the byte."""
    data = np.frombuffer(laid, np.uint8)
    wide = data.astype(np.uint32)
    one, two, three, four = wide[3:-1], wide[2:-2], wide[1:-3], wide[:-4]
    last = (tree.take((two << np.uint32(8)) | one).astype(np.uint32) << np.uint32(8)) | wide[4:]
    top = lambda x: (x * PHI) & np.uint32(0xFFFC0000)
    order4 = top((two << np.uint32(16)) | (three << np.uint32(8)) | four)
    power, inverse = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint32)
    np.cumsum((wide + np.uint32(1)) * power, dtype=np.uint32, out=sums[1:])
    begin = np.maximum.accumulate(np.where(data <= 32, np.arange(len(data), dtype=np.int32), 0))[3:-1]
    word = (sums[4:-1] - sums.take(begin)) * inverse.take(begin)
    word ^= word >> np.uint32(15)
    near = at - len(PAD)
    return [(x | last).take(near) for x in (top(two), order4, top(word))]


def slots(key: np.ndarray) -> np.ndarray:
    """Where the decisions of a key's context begin in its predictor's table, which goes on for 256 slots after its end."""
    return ((((key >> np.uint32(8)) * PHI) >> np.uint32(32 - SLOT_BITS)) & np.uint32(-ALIGN % (1 << 32))).astype(np.int64)


def phrases(laid: bytes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, begin, end, context, phrase) of the phrases that have a context: the place of each in ``laid`` and two hashes."""
    data = np.frombuffer(laid, np.uint8)
    blank = data <= 32
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    begins = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    last = np.cumsum(sizes + len(PAD))
    to = np.searchsorted(ends, last)
    n = np.diff(to, prepend=0)
    text, nth = np.repeat(np.arange(len(sizes)), n), np.arange(len(ends)) - np.repeat(to - n, n)
    where = np.flatnonzero((nth >= BEFORE - 1) & (nth < np.repeat(n, n) - 1))  # words with BEFORE - 1 before, and one after them
    if len(where):
        before = np.ascontiguousarray(sliding_window_view(data, 8)[ends[where] - 8]).view(np.uint64)[:, 0]
        where = where[((before * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(PHRASE) == 0]
    text, begin, since = text[where], ends[where], begins[where - (BEFORE - 1)]
    end = last[text]
    same = text[1:] == text[:-1]
    end[:-1][same] = begin[1:][same]
    view = memoryview(laid)
    hashed = lambda a, b: np.array([xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.uint64).view(np.int64)
    return text, begin, end, hashed(since, begin), hashed(begin, end)


def batches_of(texts: list[str | None], size: int = TOGETHER):
    held, n = [], 0
    for x in texts:
        held.append((x or "").encode())
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


# ---- the three passes over texts


def _tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _texts(batch):
    """The texts of a batch, a few at a time."""
    for i in range(0, batch.num_rows, TAKEN):
        yield batch.slice(i, TAKEN)


def _in_slices(batch, rows: int):
    """``batch`` as batches of so many rows at most: the JVM holds each of them outside its heap."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


_COUNTED = "token binary, train long, total long, triple int, context long, phrase long"


def _count_tokens(batches):
    """Rows of one kind each: (token, train, total) with counts of this task; (triple, train): three bytes that follow each
    other, as one number; (context, phrase, train): a phrase of one text."""
    learnt, other = Counter(), Counter()
    triples = (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def rows(n, token=None, train=None, total=None, triple=None, context=None, phrase=None):
        cols = [(token, pa.binary()), (train, pa.int64()), (total, pa.int64()), (triple, pa.int32()), (context, pa.int64()), (phrase, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in cols], names=["token", "train", "total", "triple", "context", "phrase"])

    def tokens(counts, is_learnt):
        keys, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
        counts.clear()
        return rows(len(keys), keys, n if is_learnt else n * 0, n)

    def summed(key, n):
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first], np.add.reduceat(n, first)

    for batch in batches:
        for part in _texts(batch):
            for text, learn in zip(part.column("text").to_pylist(), part.column("learn").to_pylist(), strict=True):
                (learnt if learn else other).update(_tokens(text))
            for texts in batches_of(part.filter(part.column("learn")).column("text").to_pylist(), COUNTED):
                laid, at, sizes = lay_out(texts)
                wide = np.frombuffer(laid, np.uint8).astype(np.uint32)
                key = np.sort(((wide[2:-2] << np.uint32(16)) | (wide[3:-1] << np.uint32(8)) | wide[4:]).take(at - len(PAD)))
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                triples = summed(np.concatenate([triples[0], key[first]]), np.concatenate([triples[1], np.diff(np.append(first, len(key)))]))
                text, _, _, context, phrase = phrases(laid, sizes)
                _, once = np.unique(context * 31 + phrase * 17 + text * 0x9E3779B97F4A7C1, return_index=True)
                if len(once):
                    yield rows(len(once), train=np.ones(len(once), np.int64), context=context[once], phrase=phrase[once])
            for counts in (learnt, other):
                if len(counts) > HELD:
                    yield from _in_slices(tokens(counts, counts is learnt), HANDED)
    for counts in (learnt, other):
        if counts:
            yield from _in_slices(tokens(counts, counts is learnt), HANDED)
    if len(triples[0]):
        yield from _in_slices(rows(len(triples[0]), train=triples[1], triple=triples[0].astype(np.int32)), HANDED)


def _pack(counts: np.ndarray) -> bytes:
    """The places and values of the counts that aren't zero."""
    at = np.flatnonzero(counts)
    values = counts[at]
    kind = np.uint8 if not len(at) or values.max() < 256 else np.uint64
    return np.dtype(kind).itemsize.to_bytes(1, "little") + len(at).to_bytes(4, "little") + at.astype(np.uint16).tobytes() + values.astype(kind).tobytes()


def _add(counts: np.ndarray, packed: bytes) -> None:
    size, n = packed[0], int.from_bytes(packed[1:5], "little")
    at = np.frombuffer(packed, np.uint16, n, 5)
    counts[at] += np.frombuffer(packed, {1: np.uint8, 8: np.uint64}[size], n, 5 + 2 * n).astype(np.uint64)


def _count_decisions(trees: Trees):
    def run(batches):
        from pyspark import TaskContext

        tables = [np.zeros((SLOTS + 256) * 2, np.uint32) for _ in range(ORDERS)]

        def learn(texts):
            laid, at, _ = lay_out(texts)
            for table, key in zip(tables, contexts(laid, at, trees.tree), strict=True):
                key.sort()
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                times = np.diff(np.append(first, len(key))).astype(np.uint32)
                key = key[first]
                n, code = trees.paths(key)
                place = np.repeat(slots(key) * 2, n)
                place += code
                np.add.at(table, place, np.repeat(times, n))

        texts = (x for batch in batches for part in _texts(batch) for x in part.column("text").to_pylist())
        for held in batches_of(texts, COUNTED):
            learn(held)
        task = TaskContext.get().partitionId()
        step = PART * 2
        for order in range(ORDERS):
            table, tables[order] = tables[order], None
            for some in range(0, PARTS, HANDED_PARTS):
                rows = [(i, _pack(table[i * step : (i + 1) * step])) for i in range(some, min(some + HANDED_PARTS, PARTS)) if table[i * step : (i + 1) * step].any()]
                if rows:
                    part, data = zip(*rows, strict=True)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([order * PARTS + p for p in part], pa.int32()), pa.array([task] * n, pa.int32()), pa.array(data, pa.binary())], names=["part", "task", "counts"])

    return run


def _sum_parts(last: bool):
    """Sums the counts of each group of (part, task); ``last``: into logits, as 16-bit numbers of FINE to one."""

    def run(batches):
        for (part, task), rows in arrow_groups(batches, ("part", "task"), ("counts",)):
            counts = np.zeros(PART * 2, np.uint64)
            for (packed,) in rows:
                _add(counts, packed)
            if last:
                two = counts.reshape(-1, 2).astype(np.float64) + PRIOR
                out = np.rint(np.log(two[:, 1] / two[:, 0]) * FINE).astype(np.int16).tobytes()
            else:
                out = _pack(counts)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([out], pa.binary())], names=["part", "task", "counts"])

    return run


class Model:
    """Trees and logit tables; ``costs`` codes texts."""

    def __init__(self, trees: Trees, tables: list[np.ndarray]):
        self.trees, self.tables = trees, tables

    def costs(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """The natural-log coding cost of each text and its end by the predictors, and (context, phrase, cost) of its phrases."""
        laid, at, sizes = lay_out(texts)
        cost = self.byte_costs(laid, at, sizes)
        text, begin, _, context, phrase = phrases(laid, sizes)
        begin -= len(PAD) * (text + 1)
        starts = np.cumsum(sizes) - sizes
        bounds = np.sort(np.concatenate([starts, begin]))  # of texts and phrases: a phrase goes on to the next, or to the end
        spent = np.add.reduceat(cost.astype(np.float64), bounds)
        cut = np.searchsorted(text, np.arange(1, len(texts)))
        mine = spent[np.searchsorted(bounds, begin)]
        return np.add.reduceat(spent, np.searchsorted(bounds, starts)), list(zip(np.split(context, cut), np.split(phrase, cut), np.split(mine, cut), strict=True))

    def byte_costs(self, laid: bytes, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        keys = contexts(laid, at, self.trees.tree)
        place = keys[0] & np.uint32(0x3FFFF)
        n, start, slot = self.trees.length.take(place), self.trees.start.take(place), [slots(k) for k in keys]
        sure4, sure_word = (np.abs(self.tables[k].take(slot[k], mode="clip")) >= SURE * FINE for k in (1, 2))
        lane = np.repeat(np.arange(len(sizes), dtype=np.int32) * GATES, sizes) + (2 * sure_word + sure4).astype(np.int32)
        block = _blocks(int(sizes.max()))
        block = np.concatenate([block[:k] for k in sizes.tolist()]) if len(sizes) > 1 else block[: sizes[0]]
        first = np.concatenate([[0], np.cumsum(np.bincount(block))])
        # bytes in order of block, gate and text: weights are spread, and sums taken, over long runs
        key = block * np.uint32(GATES) + (lane & 3).astype(np.uint32)
        order = np.argsort(key.astype(np.uint16) if len(first) * GATES < 65536 else key, kind="stable")
        n, start, lane, slot = n.take(order).astype(np.int64), start.take(order), lane.take(order), [s.take(order) for s in slot]
        weights = np.tile(np.array(WEIGHTS, np.float32), (len(sizes), 1))
        cost = np.empty(len(n), np.float32)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            cost[lo:hi] = self._block(n[lo:hi], start[lo:hi], lane[lo:hi], [s[lo:hi] for s in slot], weights)
        out = np.empty_like(cost)
        out[order] = cost
        return out

    def _block(self, n, start, lane, slot, weights) -> np.ndarray:
        """The costs of the bytes of one block of each text with the weights as they are; then moves the weights."""
        ends = np.cumsum(n)
        firsts = ends - n
        of = np.zeros(ends[-1], np.int8)
        of[firsts[1:]] = 1
        of = np.cumsum(of, dtype=np.int64)  # the byte of each decision
        at = (start - firsts).take(of, mode="clip")
        at += np.arange(len(at))
        code = self.trees.code.take(at, mode="clip")
        node = (code >> 1).astype(np.int64)
        sign = (code & 1).astype(np.float32)
        sign *= -2
        sign += 1  # 1 for bit 0
        begins = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        runs, lanes = firsts[begins], lane[begins]
        seen = np.diff(np.append(runs, len(at)))
        z, inputs = None, []
        for k, table in enumerate(self.tables):
            place = slot[k].take(of, mode="clip")
            place += node
            x = table.take(place, mode="clip").astype(np.float32)
            inputs.append(x)
            part = np.repeat(weights[lanes, k] / np.float32(FINE), seen)
            part *= x
            z = part if z is None else np.add(z, part, out=z)
        z *= sign
        np.minimum(z, 60, out=z)
        e = np.exp(z, out=z)
        one = e + np.float32(1)
        e /= one
        e *= sign
        for k, x in enumerate(inputs):
            x *= e
            weights[lanes, k] -= (STEP / FINE * np.add.reduceat(x, runs) / (seen + 200)).astype(np.float32)
        np.clip(weights, 0, 2, out=weights)
        return np.add.reduceat(np.log(one, out=one), firsts)


_block_of = [np.zeros(0, np.uint32)]


def _blocks(n: int) -> np.ndarray:
    """The block of each of the first ``n`` bytes of a text: FIRST bytes, twice as many, ..., LONGEST from there on."""
    if len(_block_of[0]) < n:
        sizes, size = [], FIRST
        while sum(sizes) < n:
            sizes.append(size)
            size = min(size * 2, LONGEST)
            if size == LONGEST and sum(sizes) < n:
                sizes += [LONGEST] * ((n - sum(sizes)) // LONGEST + 1)
        _block_of[0] = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    return _block_of[0]


# ---- the operator


def train(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame, dict]:
    """Model, vocabulary (token, train, total), phrase table (context, guess, c, n) and totals (tokens, kinds, texts) of
    ``docs`` (text, learn boolean).

    Vocabulary and phrase table are tables that grow with the corpus. What reaches the driver doesn't: 3 tables of SLOTS 16-bit
    numbers, and the counts of 65,536 pairs of bytes and of 256 bytes after each of OWN_TREES pairs.
    """
    rows = docs.select(text_of(docs).alias("text"), "learn")
    keys = ["token", "triple", "context", "phrase"]
    counted = rows.mapInArrow(_count_tokens, _COUNTED).repartition(*keys)  # tasks have summed what they can: no second map of it in the JVM
    counted = written(counted.groupBy(*keys).agg(F.sum("train").alias("train"), F.sum("total").alias("total")), "lm-counted")
    vocabulary = counted.filter("token is not null").select("token", "train", "total")
    seen = counted.filter("context is not null").groupBy("context").agg(F.max(F.struct("train", "phrase")).alias("top"), F.sum("train").alias("n"))
    known = written(seen.filter("top.train > 1").select("context", F.col("top.phrase").alias("guess"), F.col("top.train").alias("c"), "n"), "lm-phrases")
    triples = counted.filter("triple is not null").select(F.shiftright("triple", 8).alias("pair"), F.pmod("triple", F.lit(256)).alias("byte"), "train")
    after = triples.groupBy(F.pmod("pair", F.lit(256)).alias("pair"), "byte").agg(F.sum("train").alias("n"))
    singles = np.zeros((256, 256), np.int64)
    for r in after.collect():
        singles[r["pair"], r["byte"]] = r["n"]
    top = [r["pair"] for r in triples.groupBy("pair").agg(F.sum("train").alias("n")).orderBy(F.desc("n"), "pair").limit(OWN_TREES).collect()]
    own = np.zeros((len(top), 256), np.int64)
    place = {pair: i for i, pair in enumerate(top)}
    for r in triples.filter(F.col("pair").isin(top)).collect() if top else []:
        own[place[r["pair"]], r["byte"]] = r["train"]
    sums = vocabulary.agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("v")).first()
    texts = rows.filter("learn").count()
    totals = {"tokens": (sums["n"] or 0) + texts, "kinds": sums["v"] + (texts > 0), "texts": texts}
    trees = Trees(singles, np.array(top, np.int64), own)
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    parts = rows.filter("learn").select("text").mapInArrow(lambda b: _count_decisions(shared.value)(b), "part int, task int, counts binary")
    parts = written(parts, "lm-counts")
    shared.destroy()
    tasks = (parts.agg(F.max("task").alias("n")).first()["n"] or 0) + 1
    some = math.isqrt(tasks - 1) + 1
    schema = "part int, task int, counts binary"
    parts = parts.withColumn("task", F.pmod("task", F.lit(some)).cast("int"))
    parts = parts.repartition("part", "task").sortWithinPartitions("part", "task").mapInArrow(_sum_parts(False), schema)
    parts = parts.withColumn("task", F.lit(0)).repartition("part").sortWithinPartitions("part").mapInArrow(_sum_parts(True), schema)
    tables = [np.zeros(SLOTS + 256, np.int16) for _ in range(ORDERS)]
    for r in parts.select("part", "counts").toLocalIterator():
        order, i = divmod(r["part"], PARTS)
        table = tables[order][i * PART : (i + 1) * PART]
        table[:] = np.frombuffer(r["counts"], np.int16)[: len(table)]
    return Model(trees, tables), vocabulary, known, totals


def head_of(vocabulary: DataFrame, most: int = HEAD) -> tuple[dict[bytes, int], int]:
    """The training counts of the tokens that stand ``least`` times or more, at most ``most`` of them, and ``least``."""
    sizes = vocabulary.groupBy(F.floor(F.log2("total")).cast("int").alias("bit")).agg(F.count("*").alias("n")).collect()  # 63 rows at most
    least, n = 1 << 62, 0
    for r in sorted(sizes, key=lambda r: -r["bit"]):
        if n + r["n"] > most:
            break
        n, least = n + r["n"], 1 << r["bit"]
    return {bytes(r["token"]): r["train"] for r in vocabulary.filter(F.col("total") >= least).select("token", "train").toLocalIterator()}, least


def _foretold(hits: Column) -> Column:
    """What the decisions of ``hits`` (c, n, met, cost, in order) add to the cost of a text's bytes: each is coded with the
    weight and bias of its gate (0: the first, 1: after a phrase that was foretold, 2: after one that wasn't), which then take a
    step; the bytes of a foretold phrase cost nothing."""
    start = F.struct(F.array(*[F.lit(TRUST)] * 3).alias("w"), F.array(*map(F.lit, BIAS)).alias("b"), F.lit(0).alias("g"), F.lit(0.0).alias("sum"))

    def step(s: Column, h: Column) -> Column:
        x = F.log((h["c"] + 0.5) / (h["n"] - h["c"] + 0.5))
        z = F.element_at(s["w"], s["g"] + 1) * x + F.element_at(s["b"], s["g"] + 1)
        y = h["met"].cast("int")

        def coded(wrong: Column) -> Column:
            move = TRUST_STEP * wrong * F.when(h["met"], 1.0).otherwise(-1.0)
            mine = lambda by: lambda v, i: F.when(i == s["g"], v + by).otherwise(v)
            add = -F.log1p(-wrong) - F.when(h["met"], h["cost"]).otherwise(0.0)
            return F.struct(F.transform(s["w"], mine(move * x)).alias("w"), F.transform(s["b"], mine(move)).alias("b"), (2 - y).alias("g"), (s["sum"] + add).alias("sum"))

        return let(1 / (1 + F.exp(F.greatest(F.when(h["met"], z).otherwise(-z), F.lit(-30.0)))), coded)

    return F.aggregate(hits, start, step, lambda s: s["sum"])


def _score(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), most_head: int = HEAD) -> DataFrame:
    spark = docs.sparkSession
    model, vocabulary, known, totals = train(docs)
    head, least = head_of(vocabulary, most_head)
    n, v, ends = totals["tokens"], totals["kinds"], totals["texts"]
    shared = spark.sparkContext.broadcast((model, head, math.log10(n + v + 1), math.log10(ends + 1)))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        model, head, norm, end = shared.value
        logs = {}
        for whole in batches:
            for batch in _texts(whole):
                texts = batch.column("_text").to_pylist()
                coded = [model.costs(part) for part in batches_of(texts)]
                costs = np.concatenate([c for c, _ in coded])
                found = [x for _, more in coded for x in more]
                offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32)
                parts = [pa.array(np.concatenate([x[k] for x in found]), kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
                out = []
                for text in texts:
                    words = _tokens(text)
                    counts = list(map(head.get, words))
                    base, known = 0.0, 1 if ends else 0
                    for c, times in Counter(counts).items():
                        if c is not None:
                            if c not in logs:
                                logs[c] = math.log10(c + 1)
                            base += logs[c] * times
                            known += times if c else 0
                    out.append((len(words) + 1, known, base + end - norm * (len(words) + 1), [w for w, c in zip(words, counts, strict=True) if c is None]))
                cols = list(zip(*out, strict=True))
                new = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary())), strict=True)]
                new += [pa.array(costs), pa.array([len(x.encode()) for x in texts], pa.int64())]
                new.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["context", "phrase", "cost"])))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], names=[*keep, "n_tokens", "known", "base", "rare", "cost", "n_bytes", "phrases"])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "n_tokens long, known long, base double, rare array<binary>, cost double, n_bytes long, phrases array<struct<context:long,phrase:long,cost:double>>"])
    scored = docs.select(*keep, text_of(docs).alias("_text")).mapInArrow(run, schema)
    scored = written(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scores")
    shared.destroy()
    rare = scored.select("_row", F.explode("rare").alias("token")).groupBy("_row", "token").agg(F.count("*").alias("times"))
    rare = rare.join(vocabulary.filter(F.col("total") < least).select("token", "train"), "token")
    rare = rare.groupBy("_row").agg(F.sum(F.log10(F.col("train") + 1) * F.col("times")).alias("more"), F.sum(F.when(F.col("train") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    met = scored.select("_row", F.posexplode("phrases").alias("i", "p")).select("_row", "i", "p.*")
    met = hot_join(met, known, "context", "n").select("_row", F.struct("i", "c", "n", (F.col("phrase") == F.col("guess")).alias("met"), "cost").alias("hit"))
    met = met.groupBy("_row").agg(_foretold(F.sort_array(F.collect_list("hit"))).alias("foretold"), F.count_if("hit.met").alias("n_foretold"))
    rows = scored.drop("rare", "phrases").join(rare, "_row", "left").join(met, "_row", "left")
    cost = F.col("cost") + F.coalesce("foretold", F.lit(0.0))
    return rows.select(
        *keep, "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (-cost / math.log(10)).alias("score"), "n_bytes",
        (cost / math.log(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"), F.coalesce("n_foretold", F.lit(0)).alias("n_foretold"),
    )


def score(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), most_head: int = HEAD) -> DataFrame:
    """(keep..., n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte, n_foretold) of every row of ``docs`` (text,
    learn boolean: whether the row is learnt from; columns ``keep``).

    A null text is empty, which has an end still. Without any row to learn from all counts are 0 and the tables are empty.
    Rows with equal ids are separate texts. base_score sums log10((c + 1) / (N + V + 1)) over the tokens and the end; score is
    the model's log10 probability of the text's bytes and its end, n_foretold the phrases that the phrase table foretold.
    """
    small_batches(docs.sparkSession)
    return _score(docs, keep, most_head)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: the CRC-32 of its id as text leaves 2 when divided by 7."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2
