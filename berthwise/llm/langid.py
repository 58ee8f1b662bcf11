"""Language of words and documents by a linear-chain conditional random field.

Each word of a document has a language label.  Its score per label sums learned weights of
its features: byte n-grams of the word between boundary marks, its affixes (n-grams
that touch a boundary, up to four bytes) and the lexicons it is in (words that labelled documents of
one language use).  Learned transitions tie neighbours together, and forward-backward gives each
word's label probabilities; a document's language is the label with the largest mean.

Training takes a bounded, hashed sample of labelled documents, cuts them into
stretches and splices stretches of different languages together, so transitions see
code-switched text, and fits all weights by maximum likelihood on the driver.

Prediction is one Arrow pass.  Words of many documents lie in one array cut into equal
rows; each row's product of transition matrices carries the messages from row to row, so
forward-backward is exact for documents of any length and costs a few array operations.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled
row everything is ``und``; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
MOST_FEATURES, LEAST_EXPLAINED = 0.75, 0.5
# ASCII signs and digits, which no word keeps.
_DROP = bytes(c for c in range(33, 127) if not chr(c).isalpha())
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD],
                 dtype=np.uint64)


def in_training(id_col: str = "doc_id") -> Column:
    """Rows that models may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8").translate(None, _DROP).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket per feature, word index per feature), ordered by word."""
    flat = np.frombuffer(b"".join(b"^%b$" % w for w in words), dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(flat))
    buckets, owners = [], []
    for n in (2, 3, 4, 5):
        ok = at + n <= end[owner]
        if n > 3:                                  # affixes only
            ok &= (at == start[owner]) | (at + n == end[owner])
        i = at[ok]
        h = np.full(len(i), n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ flat[i + k]) * _MULT[k]
            h ^= h >> np.uint64(29)
        buckets.append((h % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[ok])
    b, o = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return b[order], o[order]


def messages(e: np.ndarray, first: np.ndarray, trans: np.ndarray, begin: np.ndarray, width: int = 64):
    """Forward and backward messages of a run of words.

    e: (words, labels) factors; first: which words begin a document.  Rows of ``width``
    words advance together; their transfer matrices link them."""
    n, labels = e.shape
    rows = -(-n // width)
    pad = rows * width - n
    e = np.concatenate([e, np.ones((pad, labels))]).reshape(rows, width, labels)
    new = np.concatenate([first, np.ones(pad, dtype=bool)]).reshape(rows, width)
    step = np.broadcast_to(np.eye(labels), (rows, labels, labels)).copy()
    for c in range(width):
        moved = step @ trans
        fresh = new[:, c]
        if fresh.any():
            moved[fresh] = step[fresh].sum(axis=2, keepdims=True) * begin
        step = moved * e[:, c, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
    into = np.empty((rows, labels))
    out = np.empty((rows, labels))
    v = np.full(labels, 1.0 / labels)
    for r in range(rows):
        into[r] = v
        v = v @ step[r]
        v /= v.sum()
    v = np.ones(labels)
    for r in range(rows - 1, -1, -1):
        out[r] = v
        v = step[r] @ v
        v /= v.sum()
    alpha, beta = np.empty_like(e), np.empty_like(e)
    v = into
    for c in range(width):
        v = np.where(new[:, c, None], begin, v @ trans) * e[:, c]
        v = v / v.sum(axis=1, keepdims=True)
        alpha[:, c] = v
    v = out
    for c in range(width - 1, -1, -1):
        beta[:, c] = v
        v = np.where(new[:, c, None], 1.0, (e[:, c] * v) @ trans.T)
        v = v / v.sum(axis=1, keepdims=True)
    return alpha.reshape(-1, labels)[:n], beta.reshape(-1, labels)[:n]


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray            # (BUCKETS + labels, labels); the last rows are the lexicons'
    lexicon: dict[bytes, int]
    trans: np.ndarray
    begin: np.ndarray
    seen: np.ndarray               # (BUCKETS + labels,): which features training met

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        b, o = grams(words)
        lex = [(BUCKETS + self.lexicon[w], i) for i, w in enumerate(words) if w in self.lexicon]
        if lex:
            x = np.array(lex, dtype=np.int64)
            b, o = np.concatenate([b, x[:, 0]]), np.concatenate([o, x[:, 1]])
        return b, o

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word by label, and whether training met at least ``MOST_FEATURES`` of its features."""
        b, o = self.features(words)
        total = lambda weights=None: np.bincount(o, weights=weights, minlength=len(words))
        return (np.stack([total(self.weights[b, k]) for k in range(len(self.labels))], axis=1),
                total(self.seen[b]) >= MOST_FEATURES * total())

    def marginals(self, words: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each word of a run of documents, and whether training explains it."""
        code, distinct = pd.factorize(np.array(words, dtype=object))
        s, known = self.scores(list(distinct))
        e = np.exp(s - s.max(axis=1, keepdims=True)) + 1e-30
        alpha, beta = messages(e[code], first, self.trans, self.begin)
        g = alpha * beta
        return g / g.sum(axis=1, keepdims=True), known[code]


def fit(samples: list[tuple[str, str]], rounds: int = 60, rate: float = 0.15, l2: float = 1e-4, seed: int = 0) -> Crf | None:
    """Maximum likelihood by Adam over spliced stretches of (language, text) samples."""
    labels = sorted({lang for lang, _ in samples})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    of = {lang: i for i, lang in enumerate(labels)}
    docs = [(of[lang], w) for lang, text in sorted(samples) if (w := words_of(text))]
    if not docs:
        return None
    uses: dict[bytes, Counter] = {}
    for k, w in docs:
        for x in set(w):
            uses.setdefault(x, Counter())[k] += 1
    lexicon = {}
    for x, c in uses.items():
        (k, n), total = c.most_common(1)[0], sum(c.values())
        if total >= 3 and n >= 0.8 * total:
            lexicon[x] = k
    stretches = []
    for k, w in docs:
        at = 0
        while at < len(w):
            n = int(rng.integers(4, 40))
            stretches.append((k, w[at:at + n]))
            at += n
    rng.shuffle(stretches)
    words = [x for _, w in stretches for x in w]
    y = np.concatenate([np.full(len(w), k) for k, w in stretches])
    first = np.zeros(len(words), dtype=bool)
    first[np.cumsum([0] + [len(w) for _, w in stretches[:-1]])[::8]] = True       # eight stretches a sequence
    labels_n = len(labels)
    m = Crf(labels, np.zeros((BUCKETS + labels_n, labels_n)), lexicon, np.full((labels_n, labels_n), 1 / labels_n), np.full(labels_n, 1 / labels_n),
            np.zeros(BUCKETS + labels_n, dtype=bool))
    code, distinct = pd.factorize(np.array(words, dtype=object))
    b, o = m.features(list(distinct))
    m.seen[b] = True
    seen = np.zeros((len(distinct), labels_n))
    np.add.at(seen, (code, y), 1.0)
    inside = ~first[1:]
    moves = np.zeros((labels_n, labels_n))
    np.add.at(moves, (y[:-1][inside], y[1:][inside]), 1.0)
    starts = np.bincount(y[first], minlength=labels_n).astype(float)
    par = {"w": m.weights, "t": np.zeros((labels_n, labels_n)), "b": np.zeros(labels_n)}
    mean = {k: np.zeros_like(v) for k, v in par.items()}
    var = {k: np.zeros_like(v) for k, v in par.items()}
    n = len(words)
    for it in range(1, rounds + 1):
        s = np.stack([np.bincount(o, weights=par["w"][b, k], minlength=len(distinct)) for k in range(labels_n)], axis=1)
        e = np.exp(s - s.max(axis=1, keepdims=True))[code] + 1e-30
        t, begin = np.exp(par["t"]), np.exp(par["b"])
        alpha, beta = messages(e, first, t, begin)
        g = alpha * beta
        g /= g.sum(axis=1, keepdims=True)
        pair = alpha[:-1][inside][:, :, None] * t * (e[1:] * beta[1:])[inside][:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        expect = np.stack([np.bincount(code, weights=g[:, k], minlength=len(distinct)) for k in range(labels_n)], axis=1)
        gap = seen - expect
        grad = {"w": np.stack([np.bincount(b, weights=gap[o, k], minlength=BUCKETS + labels_n) for k in range(labels_n)], axis=1) / n,
                "t": (moves - pair.sum(axis=0)) / n, "b": (starts - g[first].sum(axis=0)) / n}
        for k, v in par.items():
            d = grad[k] - l2 * v / max(1, labels_n)
            mean[k] = 0.9 * mean[k] + 0.1 * d
            var[k] = 0.99 * var[k] + 0.01 * d * d
            v += rate * (mean[k] / (1 - 0.9 ** it)) / (np.sqrt(var[k] / (1 - 0.99 ** it)) + 1e-8)
    m.trans, m.begin = np.exp(par["t"]), np.exp(par["b"])
    return m


def sample(docs: DataFrame, per_label: int = 100, seed: int = 0) -> list[tuple[str, str]]:
    """About ``per_label`` labelled training texts of each language, picked by a hash of the id.

    Languages are few; a language with fewer rows gives them all."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & in_training()).select(
        F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)).alias("u"))
    share = {r["lang"]: min(1.0, per_label / r["count"]) for r in known.groupBy("lang").count().collect()}
    if not share:
        return []
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * (1 << 30))))])
    return [(r["lang"], r["text"]) for r in known.where(F.col("u") < F.element_at(limit, F.col("lang"))).select("lang", "text").collect()]


def _judged(batches: Iterator[pd.DataFrame], crf: Crf | None, batch_words: int) -> Iterator[tuple[pd.DataFrame, list, np.ndarray, np.ndarray]]:
    """(rows, languages, scores, shares of words that training explains); the words of some documents are labelled together."""
    for pdf in batches:
        lo, n, words = 0, 0, []
        for hi, text in enumerate(pdf["text"], 1):
            w = words_of(text) if text else []
            words.append(w if w and any(c.isalpha() for c in text) else [])
            n += len(w)
            if n >= batch_words or hi == len(pdf):
                pred, score, share = ["und"] * len(words), np.zeros(len(words)), np.zeros(len(words))
                live = [i for i, x in enumerate(words) if x and crf is not None]
                if live:
                    sizes = np.array([len(words[i]) for i in live])
                    at = np.cumsum(sizes) - sizes
                    run = [x for i in live for x in words[i]]
                    first = np.zeros(len(run), dtype=bool)
                    first[at] = True
                    g, known = crf.marginals(run, first)
                    mean = np.add.reduceat(g, at, axis=0) / sizes[:, None]
                    share[live] = np.add.reduceat(known.astype(float), at) / sizes
                    score[live] = np.clip(mean.max(axis=1), 0.0, 1.0)
                    for i, k in zip(live, mean.argmax(axis=1)):
                        pred[i] = crf.labels[k]
                yield pdf.iloc[lo:hi], pred, score, share
                lo, n, words = hi, 0, []


def predict(docs: DataFrame, model: Crf | None, batch_words: int = 200_000) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, pred, score, _ in _judged(batches, sent.value, batch_words):
            yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "lang_pred": pred, "score": score})
    src = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = src.mapInPandas(run, "doc_id string, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def identified(docs: DataFrame, per_label: int = 100) -> DataFrame:
    """Fit on the labelled training rows of ``docs`` and predict all its rows."""
    return predict(docs, fit(sample(docs, per_label)))


def filtered(docs: DataFrame, least: float = LEAST_EXPLAINED, per_label: int = 100, batch_words: int = 50_000, rows: int = 500) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known: it is not ``und``, and at least the share ``least`` of
    the words are made of what the training languages are made of.  The mixture of languages doesn't matter."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, per_label)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                text = pd.DataFrame({"text": part.column("text").cast(pa.string()).to_pandas()})
                keep = [p != "und" and x >= least for _, pred, _, explained in _judged(iter([text]), crf, batch_words)
                        for p, x in zip(pred, explained)]
                yield part.filter(pa.array(keep, type=pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
