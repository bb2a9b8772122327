"""Language identification with a small convolutional network over bytes.

Bytes are embedded, filters of widths 2, 3 and 4 run over fixed-length windows, each filter's largest value is kept and a
softmax turns them into languages. Training is plain numpy on a bounded sample of labelled windows; applying is a map over
batches of windows that covers every byte of every text, without a shuffle. A text's verdict is the mean of its windows'
log-probabilities, weighted by their lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches

#: Bytes of a window, size of a byte's vector, filter widths, filters of each width, windows in a matrix product.
LENGTH, DEPTH, WIDTHS, FILTERS, BLOCK = 128, 6, (2, 3, 4), 16, 256
#: The bound of the training sample: labelled texts of a language, windows of a text. Passes over it, step, seed.
SAMPLE_TEXTS, SAMPLE_WINDOWS, EPOCHS, STEP, SEED = 500, 6, 14, 0.004, 7
UNKNOWN = "und"
TALL = max(WIDTHS)


class ByteCnn:
    """Parameters and the two passes. Windows are uint8 [n, LENGTH]; byte 0 pads."""

    def __init__(self, langs: list[str], rng):
        self.langs = langs
        n = FILTERS * len(WIDTHS)
        self.mask = np.zeros((TALL * DEPTH, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[: w * DEPTH, k * FILTERS : (k + 1) * FILTERS] = 1
        self.p = {
            "e": rng.normal(0, 0.5, (256, DEPTH)), "w": rng.normal(0, 0.3, (TALL * DEPTH, n)) * self.mask, "b": np.zeros(n),
            "o": rng.normal(0, 0.2, (n, len(langs))), "c": np.zeros(len(langs)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _columns(self, windows):
        n, length = windows.shape
        x = np.zeros((n, length + TALL - 1), np.uint8)
        x[:, :length] = windows
        v = self.p["e"][x]
        a, b, c = v.strides
        return x, np.ascontiguousarray(as_strided(v, (n, length, TALL * DEPTH), (a, b, c))).reshape(n * length, -1)

    def log_probs(self, windows) -> np.ndarray:
        out = []
        for i in range(0, len(windows), BLOCK):
            part = windows[i : i + BLOCK]
            _, cols = self._columns(part)
            top = (cols @ self.p["w"]).reshape(len(part), part.shape[1], -1).max(1)
            z = np.maximum(top + self.p["b"], 0) @ self.p["o"] + self.p["c"]
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)

    def gradients(self, windows, labels, weights):
        p, (n, length) = self.p, windows.shape
        x, cols = self._columns(windows)
        raw = (cols @ p["w"]).reshape(n, length, -1)
        at = raw.argmax(1)
        top = np.take_along_axis(raw, at[:, None, :], 1)[:, 0, :] + p["b"]
        h = np.maximum(top, 0)
        z = h @ p["o"] + p["c"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), labels] -= 1
        dz = q * (weights / weights.sum())[:, None]
        dh = (dz @ p["o"].T) * (top > 0)
        rows = (np.arange(n)[:, None] * length + at).ravel()
        f = np.tile(np.arange(dh.shape[1]), n)
        picked, d = cols[rows], dh.ravel()
        dw, de = np.zeros_like(p["w"].T), np.zeros_like(p["e"])
        np.add.at(dw, f, picked * d[:, None])
        back = (p["w"].T[f] * d[:, None]).reshape(-1, TALL, DEPTH)
        place = (np.arange(n)[:, None] * x.shape[1] + at).ravel()
        for j in range(TALL):
            np.add.at(de, x.ravel()[place + j], back[:, j])
        return {"e": de, "w": dw.T * self.mask, "b": dh.sum(0), "o": h.T @ dz, "c": dz.sum(0)}


def train(windows: np.ndarray, labels: list[str]) -> ByteCnn:
    """Adam over shuffled batches, every language with the same weight. Half of the windows are cut short at random, so that
    short texts are like the training data. Sorted input makes the result the same each time."""
    rng = np.random.default_rng(SEED)
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    weights = (len(y) / np.bincount(y)[y]).astype(np.float32)
    net = ByteCnn(langs, rng)
    m1, m2, t = {k: 0 * v for k, v in net.p.items()}, {k: 0 * v for k, v in net.p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 128):
            part = order[i : i + 128]
            x = windows[part].copy()
            keep = np.where(rng.random(len(part)) < 0.5, rng.integers(12, LENGTH, len(part)), LENGTH)
            x[np.arange(LENGTH)[None, :] >= keep[:, None]] = 0
            g, t = net.gradients(x, y[part], weights[part]), t + 1
            for k in net.p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                step = STEP * (0.5 if epoch > EPOCHS * 2 // 3 else 1)
                net.p[k] -= (step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def cut(data: bytes) -> np.ndarray:
    """The windows that cover ``data``, the last one padded with zeros."""
    n = max(1, -(-len(data) // LENGTH))
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, LENGTH)


def _sample(most: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                data = text.encode()
                windows = cut(data)
                for k in range(0, len(windows), max(1, -(-len(windows) // most))):  # spread over the whole text
                    if bytes(windows[k]).strip(b"\0"):
                        out.append((lang, bytes(windows[k])))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.binary())], names=["lang", "window"])

    return run


def fit(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_windows: int = SAMPLE_WINDOWS) -> ByteCnn | None:
    """A network from rows (doc_id, text, lang). Rows with a null text or lang are left out; without any row there is none.

    At most about ``sample_texts`` texts of a language, the same ones each time, give at most ``sample_windows`` windows each,
    spread over the text; only these reach the driver.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, sample_texts / n))]), F.col("lang"))
    # by id and text, so that rows with one id or none are drawn like others
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(1 << 20)) / F.lit(1 << 20)
    got = rows.filter(place < rate).select("text", "lang").mapInArrow(_sample(sample_windows), "lang string, window binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "window"])
    return train(np.stack([np.frombuffer(x, np.uint8) for x in got["window"]]), got["lang"].tolist())


def predict(docs: DataFrame, net: ByteCnn | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with columns ``pred`` and ``score`` (its probability); only ``text`` is looked at.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if there is no network.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(f"`{pred}` string, `{score}` double")
    def languages(texts):
        import pandas as pd
        import regex

        letter = regex.compile(r"\p{L}")
        out = [(UNKNOWN, 0.0)] * len(texts)
        held, size = [], 0

        def flush():
            nonlocal held, size
            windows = np.concatenate([w for _, _, w in held])
            lengths = np.concatenate([np.minimum(LENGTH, n - LENGTH * np.arange(len(w))) for _, n, w in held]).astype(np.float32)
            starts = np.cumsum([0, *[len(w) for _, _, w in held[:-1]]])
            total = np.add.reduceat(net.log_probs(windows) * lengths[:, None], starts, axis=0) / np.add.reduceat(lengths, starts)[:, None]
            q = np.exp(total - total.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            best = q.argmax(1)
            for (i, _, _), k, row in zip(held, best, q, strict=True):
                out[i] = (net.langs[k], float(row[k]))
            held, size = [], 0

        for i, x in enumerate(texts):
            if net is None or x is None or not letter.search(x):
                continue
            data = x.encode()
            held.append((i, len(data), cut(data)))
            size += len(data)
            if size > 1 << 20:
                flush()
        if held:
            flush()
        return pd.DataFrame(out, columns=[pred, score])

    own = free_name("_lang", docs.columns)
    got = docs.withColumn(own, languages(F.col(text)))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (pred, score)], F.col(f"{own}.`{pred}`"), F.col(f"{own}.`{score}`"))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2
