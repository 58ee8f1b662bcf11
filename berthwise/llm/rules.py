"""Quality rules as a short-circuit cascade.

Each rule is a test on one document.  On a hashed sample the operator times every rule
and records which documents it rejects, then orders the rules greedily: next comes the
rule that rejects most of what the rules before it leave, per unit of time.  Documents then
run through the rules in that order and stop at the first that rejects
them.  A document is kept if no rule rejects it, so the order changes the time and
nothing else.

Defined cases: a null or empty text has no words and fails ``min_words``; texts of any
length are read whole; repeated rows are judged alike; an empty table (or sample) keeps the given
order; extra columns are ignored.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACES = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


class Doc:
    """A document's measures, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8")
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, _SPACES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        again = np.fromiter((seen[x] > 1 for x in windows), dtype=bool, count=len(windows))
        covered = np.zeros(len(w), dtype=bool)
        for k in range(3):
            covered[k:k + len(windows)] |= again
        return int(covered.sum())

    @cached_property
    def caps(self) -> tuple[int, int]:
        """(upper-case ASCII letters, ASCII letters)."""
        letters = len(self.raw) - len(self.raw.translate(None, _LETTERS))
        return len(self.raw) - len(self.raw.translate(None, _LETTERS[:26])), letters

    @cached_property
    def n_marks(self) -> int:
        return self.raw.count(b"!") + self.raw.count(b"?")


@dataclass(frozen=True)
class Rule:
    name: str
    passes: Callable[[Doc], bool]
    base: bool = False


# Thresholds after published web-text filters; the first two are the base rules.
RULES = (
    Rule("min_words", lambda d: d.n_words >= 50, base=True),
    Rule("repeat_words", lambda d: 100 * d.n_repeat_words <= 50 * d.n_words, base=True),
    Rule("symbols", lambda d: 10 * d.n_symbols <= d.n_words),
    Rule("word_length", lambda d: 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("dup_lines", lambda d: d.n_dup_lines < 3 or 10 * d.n_dup_lines <= 3 * len(d.lines)),
    Rule("capitals", lambda d: 2 * d.caps[0] <= d.caps[1]),
    Rule("marks", lambda d: 10 * d.n_marks <= d.n_words),
)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cost_and_selectivity(docs: DataFrame, rules: tuple[Rule, ...] = RULES, fraction: float = 0.01,
                         seed: int = 0) -> list[tuple[int, int, list[float]]]:
    """(rejections as bits, documents, seconds per rule) over a hashed sample of the rows,
    summed where the sample lies; at most 2 ** len(rules) rows come back."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                bits, took = 0, []
                for i, r in enumerate(rules):
                    doc = Doc(text)                          # nothing is shared, so each rule pays for what it reads
                    t = time.perf_counter()
                    bits |= (not r.passes(doc)) << i
                    took.append(time.perf_counter() - t)
                rows.append((bits, 1, *took))
            yield pd.DataFrame(rows, columns=["bits", "n", *cost])
    cost = [f"c{i}" for i in range(len(rules))]
    picked = F.pmod(F.xxhash64(F.lit(seed), F.col("text")), F.lit(1 << 20)) < int(fraction * (1 << 20))
    out = docs.select(F.col("text").cast("string").alias("text")).where(picked).mapInPandas(
        run, "bits long, n long, " + ", ".join(f"{c} double" for c in cost))
    agg = out.groupBy("bits").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cost])
    return [(r["bits"], r["n"], [r[c] for c in cost]) for r in agg.collect()]


def cascade_order(sample: list[tuple[int, int, list[float]]], n_rules: int) -> list[int]:
    """Greedy order by rejections per second among the documents still in."""
    left, order = list(sample), []
    rest = list(range(n_rules))
    while rest:
        total = sum(n for _, n, _ in left)
        if not total:
            return order + rest

        def gain(i: int) -> float:
            return sum(n for b, n, _ in left if b >> i & 1) / (sum(c[i] for _, _, c in left) + 1e-9)
        best = max(rest, key=lambda i: (gain(i), -i))
        order.append(best)
        rest.remove(best)
        left = [x for x in left if not x[0] >> best & 1]
    return order


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[int] | None = None,
           features: tuple[str, ...] = FEATURES, fraction: float = 0.01) -> DataFrame:
    """doc_id, ``features``, base_failed, kept, failed_rule (the first of the order, null if kept)."""
    ranked = [rules[i] for i in (order if order is not None else cascade_order(
        cost_and_selectivity(docs, rules, fraction), len(rules)))]
    base = [r for r in rules if r.base]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                doc = Doc(text)
                failed = next((r.name for r in ranked if not r.passes(doc)), None)
                rows.append((*[getattr(doc, f) for f in features],
                             failed is not None and any(not r.passes(doc) for r in base), failed is None, failed))
            out = pd.DataFrame(rows, columns=[*features, "base_failed", "kept", "failed_rule"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out
    schema = "doc_id string, " + "".join(f"{f} long, " for f in features) + "base_failed boolean, kept boolean, failed_rule string"
    src = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("bigint"))
