"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch with smallest period q that is LEAST_TIMES periods long or more. Highly periodic regions of the
least periods, 1 to 3, are found on their own, by comparing each word with that q words on. Longer periods come from dyadic
scales t = 4, 8, 16 ...: a position is in the scale's synchronising set where the least hash of the t-word windows that begin
on the t + 1 positions from it stands at either end of them. Windows within a run of period t / 4 or less (all of which the
regions above and the scales before have found) count as infinite, so the set stays sparse. Whether a position is in the set
depends on its 2 t words only; a run of period q, t <= q < 2 t, has a position of the set among its first t words, whose
2 t words come again q words later, and not sooner. So neighbours with equal contexts in the set, q apart, propose the
period, and comparing words both ways from there gives the run. Where no context of a set comes twice, no longer period is
left, and larger scales are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .shingles import MIX

#: A run has so many words at least, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: The periods that neighbours are compared for; the first scale is the next one.
SMALL = (1, 2, 3)
NEVER = np.uint64(1 << 63)


def _wider(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows twice as wide as those of ``h``, which have ``size`` words."""
    x = h[: len(h) - size] * MIX[0] + h[size:]
    x ^= x >> np.uint64(31)
    x *= MIX[1]
    x ^= x >> np.uint64(29)
    return x


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements from the start on are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def _small_regions(w: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for q in (q for q in SMALL if len(w) >= LEAST_TIMES * q):
        same = np.zeros(len(w) - q + 2, np.int8)
        same[1:-1] = w[:-q] == w[q:]
        turns = np.flatnonzero(same[1:] != same[:-1])
        begin, end = turns[::2], turns[1::2] + q
        long = end - begin >= LEAST_TIMES * q
        out += [(a, b, q) for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True) if q == 1 or (w[a : a + q] != w[a]).any()]
    return out


def _synchronising(h: np.ndarray, scale: int, regions: list[tuple[int, int, int]]) -> np.ndarray:
    """The positions of the synchronising set of ``scale``; ``h`` has the hashes of the windows of so many words."""
    place = h >> np.uint64(1)
    for begin, end, q in regions:
        if LEAST_TIMES * q <= scale <= end - begin:
            place[begin : end - scale + 1] = NEVER
    low, width = place, 1
    while width < scale:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    low = np.minimum(low[:-1], place[scale:])
    return np.flatnonzero(((low == place[: len(low)]) | (low == place[scale:])) & (low != NEVER))


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers ``w``, by start, then period."""
    n, found = len(w), _small_regions(w)
    h, scale = w.astype(np.uint64) * MIX[2] + MIX[1], 1
    while scale <= max(SMALL) and 2 * scale <= n:
        h, scale = _wider(h, scale), scale * 2
    while scale > max(SMALL) and LEAST_TIMES * scale <= n:
        at = _synchronising(h, scale, found)
        h = _wider(h, scale)
        context = h.take(at)
        order = np.argsort(context, kind="stable")
        again = np.flatnonzero(context.take(order[1:]) == context.take(order[:-1]))
        if not len(again):
            break
        first = at.take(order.take(again))
        gap = at.take(order.take(again + 1)) - first
        near = (gap >= scale) & (gap < 2 * scale)
        ends: dict[int, int] = {}
        for s, q in sorted(zip(first[near].tolist(), gap[near].tolist(), strict=True)):
            if s < ends.get(q, 0):
                continue  # in the stretch compared last for this period
            ahead = _agreeing(w[s:], w[s + q :])
            back = _agreeing(w[:s][::-1], w[: s + q][::-1])
            ends[q] = s + ahead
            if ahead + back + q >= LEAST_TIMES * q:
                found.append((s - back, s + ahead + q, q))
        scale *= 2
    return sorted((a, b - a, q) for a, b, q in found if b - a >= max(LEAST_WORDS, LEAST_TIMES * q))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those of a run after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def words_of(text: str | None, *_) -> list[bytes]:
    return (text or "").encode().split()  # at ASCII white space


def with_tandem(text: str | None, doc_id) -> list[bytes]:
    """The words of a text; those of every tenth id (by CRC) with a periodic end."""
    words = words_of(text)
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a : a + p] * (1 + (n - a) // p))[: n - a]]


def mark_runs(docs: DataFrame, text: str = "text", more: tuple[str, ...] = ("doc_id",), words: Callable = words_of) -> DataFrame:
    """(more..., runs, collapsed) of every row: ``runs`` array<struct<start, length, period>> of longs by start and period,
    ``collapsed`` the words that stay, joined by one space.

    Words are runs of characters other than ASCII white space, numbered from 0. A null or empty text has no runs and
    collapses to the empty string; equal rows give equal rows; other columns are not looked at. A text is one task's work, in
    time of about n log n; nothing is shuffled. ``words`` gives the words of a text and its row's ``more``.
    """
    small_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    struct = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            runs, texts = [], []
            beside = list(zip(*[batch.column(m).to_pylist() for m in more], strict=True)) if more else [()] * batch.num_rows
            for x, row in zip(batch.column("_text_of_runs").to_pylist(), beside, strict=True):
                own = words(x, *row)
                known: dict[bytes, int] = {}
                found = find_runs(np.fromiter((known.setdefault(v, len(known)) for v in own), np.int64, len(own)))
                runs.append([{"start": a, "length": b, "period": q} for a, b, q in found])
                texts.append(b" ".join(kept_words(own, found)).decode())
            yield pa.RecordBatch.from_arrays([*[batch.column(m) for m in more], pa.array(runs, struct), pa.array(texts, pa.string())], names=[*more, "runs", "collapsed"])

    schema = ", ".join([*[f"`{m}` {kinds[m]}" for m in more], "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"])
    return docs.select(*more, F.col(text).alias("_text_of_runs")).mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones that of smallest start, then period. Null where there is none."""
    key = lambda r: F.struct(r["length"], -r["start"], -r["period"])
    best = F.array_max(F.transform(runs, key))
    return F.when(F.size(runs) > 0, F.struct((-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period")))


def digest(marked: DataFrame, more: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each of ``mark_runs``: the number of runs, the longest, and digests of all runs and of what is kept."""
    best = longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    out = marked.withColumn("_best_of_runs", best)
    one = F.col("_best_of_runs")
    return out.select(
        *more, F.size("runs").cast("long").alias("n_runs"), one["start"].alias("start"), one["length"].alias("length"), one["period"].alias("period"),
        F.expr("_best_of_runs.length * 1000 div _best_of_runs.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
