"""Document quality by a byte-level convolutional network in numpy.

Filters over ``K`` bytes slide over the whole text, byte by byte.  The text is cut into chunks of ``CHUNK`` bytes that
overlap by half; each filter's largest response in a chunk is the chunk's value, and
the largest and the mean chunk values make the document's features, which a logistic layer
turns into one probability.  A filter's response is a sum of table entries, one per byte
of its window, so a convolution is a few table look-ups; responses are pooled per half
chunk once and two neighbouring halves make a chunk.

Training takes a bounded, hashed sample of labelled rows and runs on the driver; scoring is one Arrow
pass over all texts.

Defined cases: null and empty texts are one chunk of padding and have a score like any other; texts
of any length are read whole; without labelled rows every score is 0.5; labels that are
null or contradict each other count once each (null not at all); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berthwise.llm.langid import in_training

CHUNK, K, FILTERS = 512, 6, 16
HALF = CHUNK // 2


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each padded with zeros to whole half chunks with a window's length to
    spare, and the first half chunk of each."""
    sizes = np.array([-(-(len(t) + K) // HALF) for t in texts], dtype=np.int64)
    flat = np.zeros(int(sizes.sum()) * HALF + K, dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for t, f in zip(texts, first):
        flat[f * HALF:f * HALF + len(t)] = np.frombuffer(t, dtype=np.uint8)
    return flat, first


class Net:
    """Parameters: table (K, 256, FILTERS), bias (FILTERS), out (2 * FILTERS), out_bias."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.25, (K, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, dtype=np.float32)

    def halves(self, flat: np.ndarray, where: bool = False, block: int = 32):
        """Largest response of each filter in each half chunk, and with ``where`` its position."""
        n = (len(flat) - K) // HALF
        top = np.empty((n, FILTERS), dtype=np.float32)
        at = np.empty((n, FILTERS), dtype=np.int64) if where else None
        for lo in range(0, n, block):                     # responses of one block fit the cache
            hi = min(n, lo + block)
            a, b = lo * HALF, hi * HALF
            r = self.table[0].take(flat[a:b], axis=0)
            for k in range(1, K):
                r += self.table[k].take(flat[a + k:b + k], axis=0)
            r = r.reshape(hi - lo, HALF, FILTERS)
            if where:
                arg = r.argmax(axis=1)
                top[lo:hi] = np.take_along_axis(r, arg[:, None, :], axis=1)[:, 0]
                at[lo:hi] = np.arange(lo, hi)[:, None] * HALF + arg
            else:
                top[lo:hi] = r.max(axis=1)
        return np.maximum(top + self.bias, 0), at

    @staticmethod
    def chunks(top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk of each half: itself and the next half of its document; and which halves
        begin a chunk (all but a document's last, or its only one)."""
        n = len(top)
        last = np.zeros(n, dtype=bool)
        last[np.append(first[1:], n) - 1] = True
        begins = ~last
        begins[first] = True
        nxt = np.minimum(np.arange(n) + 1, n - 1)
        nxt[last] = np.nonzero(last)[0]
        return np.where((top >= top[nxt]), np.arange(n)[:, None], nxt[:, None]), begins

    def features(self, top: np.ndarray, first: np.ndarray):
        src, begins = self.chunks(top, first)
        value = np.take_along_axis(top, src, axis=0) * begins[:, None]
        count = np.add.reduceat(begins.astype(np.float32), first)[:, None]
        return np.concatenate([np.maximum.reduceat(top, first), np.add.reduceat(value, first) / count], axis=1), src, begins, count

    def score(self, texts: list[bytes]) -> np.ndarray:
        flat, first = laid_out(texts)
        top, _ = self.halves(flat)
        f = self.features(top, first)[0]
        # Summed row by row, so a text's score doesn't depend on its neighbours.
        return 1 / (1 + np.exp(-((f.astype(np.float64) * self.out).sum(axis=1) + self.out_bias[0])))

    def gradient(self, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
        flat, first = laid_out(texts)
        top, at = self.halves(flat, where=True)
        f, src, begins, count = self.features(top, first)
        z = f @ self.out + self.out_bias[0]
        dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        df = dz[:, None] * self.out
        owner = np.zeros(len(top), dtype=np.int64)
        owner[first[1:]] = 1
        owner = np.cumsum(owner)
        d = np.zeros_like(top)
        cols = np.broadcast_to(np.arange(FILTERS), top.shape)
        np.add.at(d, (src[begins], cols[begins]), (df[:, FILTERS:] / count)[owner[begins]])
        best = top >= f[:, :FILTERS][owner]
        d += best * df[:, :FILTERS][owner] / np.add.reduceat(best.astype(np.float32), first)[owner]
        d *= top > 0
        table = np.zeros_like(self.table)
        for k in range(K):
            np.add.at(table[k], (flat[at + k], cols), d)
        return [table, d.sum(axis=0), f.T @ dz, np.array([dz.sum()], dtype=np.float32)]


def fit(samples: list[tuple[str, int]], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Net | None:
    """Adam on (text, label) samples."""
    data = sorted((t or "", int(y)) for t, y in samples)
    if not data:
        return None
    net = Net(seed)
    rng = np.random.default_rng(seed)
    raw = [t.encode("utf-8") for t, _ in data]
    y = np.array([v for _, v in data], dtype=np.float32)
    par = [net.table, net.bias, net.out, net.out_bias]
    mean, var = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            step += 1
            grads = net.gradient([raw[i] for i in pick], y[pick])
            for p, g, m, v in zip(par, grads, mean, var):
                g = g + 1e-5 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (0.5 if epoch >= epochs // 2 else 1.0) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)
    return net


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 2000, seed: int = 0) -> list[tuple[str, int]]:
    """About ``rows`` labelled training texts, picked by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & in_training()).select("doc_id", F.col(label).cast("int").alias("_y"))
    n = known.count()
    if not n:
        return []
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    # The picked labels are about ``rows`` rows of two numbers, whatever the table's size.
    picked = known.where(u < int(min(1.0, rows / n) * (1 << 30)))
    d = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return [(r["text"], r["_y"]) for r in d.join(F.broadcast(picked), "doc_id").select("text", "_y").collect()]


def scored(docs: DataFrame, net: Net | None, batch_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, score) per row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value

        def judge(ids: list, raw: list[bytes]) -> pd.DataFrame:
            return pd.DataFrame({"doc_id": ids, "score": model.score(raw) if model is not None else np.full(len(raw), 0.5)})
        ids: list = []
        raw: list = []
        n = 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids.append(doc_id)
                raw.append((text or "").encode("utf-8"))
                n += len(raw[-1])
                if n >= batch_bytes:
                    yield judge(ids, raw)
                    ids, raw, n = [], [], 0
        if ids:
            yield judge(ids, raw)
    src = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def quality(docs: DataFrame, labels: DataFrame, rows: int = 2000) -> DataFrame:
    return scored(docs, fit(sample(docs, labels, rows=rows)))
