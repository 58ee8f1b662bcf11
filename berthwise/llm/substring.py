"""Repeated passages by matching statistics on suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of a document.  Words are removed that a window covers whose
words also start earlier in the corpus.

The reference is the corpus itself, so its automata cannot be sent whole to every task;
each shard goes just where its text can match:

1. Every window has an anchor, the smallest hash among its ``GRAM``-word sequences.  Equal windows have equal
   anchors, so only windows whose anchor occurs twice can repeat.  Neighbouring windows mostly share an
   anchor and make one segment.
2. Segments with a repeated anchor are cut from the texts and dealt by anchor.  Copies of a
   segment are settled at once: all but the first start later.  Anchors of more than ``HOT`` segments (a
   common line) are dealt by their whole windows instead, salted and then once more without salt, so what meets in
   one task stays small.  Texts that are whole copies of others are settled before that by their digests.
3. What is left of some anchors makes a reference shard.  Its suffix automaton, each state with the first place
   its strings end, is built once, and the shard's segments are streamed through it: the
   matching statistics, capped at the window length, find the state of each window and
   so the first place it occurs.
4. Spans are joined back to the texts.

Hashes only deal text to tasks; words decide.

Defined cases: null and empty texts have no words; null ids come before all others; rows with one
doc_id are one place in the order, so a repeated row does not start earlier than itself; texts of any
length are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berthwise.llm.common import saved

WINDOW, GRAM, HOT, SALTS, SHARD_WORDS = 20, 6, 2000, 64, 50_000
_START, _N = 31, 12                                           # bits of a packed place: start, windows
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C2
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def segments(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text index, anchor, first window, windows) of each run of windows with one anchor in one place;
    a run has at most window - gram + 1 windows."""
    flat = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = ~_SPACE[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    begin, end = edge[::2], edge[1::2]
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    n = len(begin)
    if n < window:
        return none
    offset = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(offset, begin, side="right") - 1
    at = np.flatnonzero(inside)
    size = end - begin
    rank = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)      # place of a byte in its word
    power = _powers(_C1, int(size.max()))
    word = _mix(np.add.reduceat((flat[at].astype(np.uint64) + np.uint64(1)) * power[rank], np.cumsum(size) - size))
    m = n - gram + 1
    g = np.zeros(m, dtype=np.uint64)
    for j, p in enumerate(_powers(_C2, gram)):
        g += word[j:j + m] * p
    g = _mix(g)
    width, span = window - gram + 1, 1
    w = n - window + 1

    def smaller(low: np.ndarray, at: np.ndarray, shift: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = low[:size], low[shift:shift + size]
        first = left <= right
        return np.where(first, left, right), np.where(first, at[:size], at[shift:shift + size])
    low, place = g, np.arange(m)
    while span * 2 <= width:
        low, place = smaller(low, place, span, len(low) - span)
        span *= 2
    low, place = smaller(low, place, width - span, w)
    ok = doc[:w] == doc[window - 1:]
    i = np.flatnonzero(ok)
    if not len(i):
        return none
    d, a, place = doc[i], low[i], place[i]
    # One run per place of the anchor: equal windows of one text lie in different runs.
    starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (d[1:] != d[:-1])]))
    count = np.diff(np.concatenate([starts, [len(i)]]))
    first_word = np.searchsorted(doc, np.arange(len(texts)))
    return d[starts], a[starts].view(np.int64), i[starts] - first_word[d[starts]], count


class Automaton:
    """Suffix automaton of several word sequences; ``first[s]`` is the smallest place at which the
    strings of state s end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.first: list = [None]

    def _state(self, length: int, link: int, nxt: dict, first) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        self.first.append(first)
        return len(self.len) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A state for the strings of q that are one longer than p's."""
        s = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]), None)
        self.link[q] = s
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = s
            p = self.link[p]
        return s

    def add(self, words: list, place: tuple, start: int) -> None:
        """``place`` orders the documents; word i of ``words`` ends at (place, start + i + 1)."""
        last = 0
        for i, c in enumerate(words):
            end = (place, start + i + 1)
            q = self.next[last].get(c)
            if q is not None:                       # another sequence had these words
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
                if self.first[last] is None or end < self.first[last]:
                    self.first[last] = end
                continue
            cur = self._state(self.len[last] + 1, 0, {}, end)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
            last = cur

    def settle(self) -> None:
        """Carry first places from long strings to their suffixes."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            f, up = self.first[s], self.link[s]
            if up > 0 and f is not None and (self.first[up] is None or f < self.first[up]):
                self.first[up] = f

    def statistics(self, words: list, cap: int) -> Iterator[tuple[int, int, object]]:
        """(word index, matched length up to ``cap``, first end of that match) of each word."""
        s, n = 0, 0
        for i, c in enumerate(words):
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.len[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            if n > cap:
                n = cap
            while s and self.len[self.link[s]] >= n:
                s = self.link[s]
            yield i, n, self.first[s]


def earlier_spans(shard: list[tuple[list, tuple, int]], window: int) -> Iterator[tuple[int, int, int]]:
    """(segment, start, stop) word spans of windows that also start earlier.  shard: (words, place, start)."""
    auto = Automaton()
    for words, place, start in shard:
        auto.add(words, place, start)
    auto.settle()
    for k, (words, place, start) in enumerate(shard):
        lo = hi = None
        for i, n, first in auto.statistics(words, window):
            if n == window and first < (place, start + i + 1):
                a = start + i + 1 - window
                if hi is None or a > hi:
                    if hi is not None:
                        yield k, lo, hi
                    lo = a
                hi = a + window
        if hi is not None:
            yield k, lo, hi


_CUT = "route bigint, hot boolean, doc_id bigint, h bigint, start bigint, stop bigint, words binary"
_COLUMNS = [c.split()[0] for c in _CUT.split(", ")]


def _ints(ids) -> list:
    return [None if x is None else int(x) for x in ids]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def anchors(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(anchor, doc_id, h, at) of every segment of ``keyed`` rows; at packs first window and windows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lo = 0
            raw = [t.encode("utf-8") if t else b"" for t in pdf["text"]]
            ids = pd.array(_ints(pdf["doc_id"]), dtype="Int64")
            hs = pdf["h"].to_numpy()
            while lo < len(raw):
                hi, size = lo, 0
                while hi < len(raw) and (hi == lo or size + len(raw[hi]) < 2 << 20):
                    size += len(raw[hi])
                    hi += 1
                d, a, start, n = segments(raw[lo:hi], window, gram)
                yield pd.DataFrame({"anchor": a, "doc_id": ids[lo:hi][d], "h": hs[lo:hi][d], "at": (start << _N) | n})
                lo = hi
    src = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "h", "text")
    return src.mapInPandas(run, "anchor bigint, doc_id bigint, h bigint, at bigint")


def shared_ids(docs: DataFrame) -> DataFrame:
    """The ids that several rows have, as a table."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null")
    return saved(ids.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "shared-ids")


def keyed(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, text and h, which tells apart texts under one doc_id or none: 0 where no other row has the id, else a
    64-bit hash of the text."""
    t = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    t = t.join(shared.withColumn("_shared", F.lit(True)), "doc_id", "left")
    own = F.col("doc_id").isNotNull() & F.col("_shared").isNull()
    return t.select("doc_id", "text", F.when(own, F.lit(0).cast("bigint")).otherwise(F.xxhash64("text")).alias("h"))


def _cut(window: int):
    """Segments of each text with repeated anchors, those of hot anchors window by window."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, h, text, runs in zip(_ints(pdf["doc_id"]), pdf["h"], pdf["text"], pdf["runs"]):
                words = text.encode("utf-8").split()
                for x in runs:
                    start, n = x["start"], x["n"]
                    if x["hot"]:
                        for i in range(start, start + n):
                            w = b" ".join(words[i:i + window])
                            rows.append((xxhash.xxh64_intdigest(w) - (1 << 63), True, doc_id, h, i, i + window, w))
                    else:
                        stop = start + n + window - 1
                        rows.append((x["anchor"], False, doc_id, h, start, stop, b" ".join(words[start:stop])))
                    if len(rows) >= 20_000:
                        yield _frame(rows)
                        rows = []
            yield _frame(rows)
    return run


def _match(window: int, shard_words: int, last: bool = False):
    """Rows sorted by (route, words, doc_id, start) to spans without words.

    The first of equal segments stays, the others start later and are spans.  What stays of
    some routes makes a shard.  The windows of hot routes are dealt over salts: those that stay
    pass with their words, to meet once more (``last``)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard: list = []                                # (words, place, start, doc_id, h)
        group: list = []
        out: list = []
        held = 0
        route = prev = None

        def spans() -> None:
            for k, a, b in earlier_spans([x[:3] for x in shard], window):
                out.append((None, False, shard[k][3], shard[k][4], a, b, None))
            shard.clear()

        for pdf in batches:
            for r, hot, doc, h, start, stop, words in zip(pdf["route"], pdf["hot"], _ints(pdf["doc_id"]), pdf["h"],
                                                          pdf["start"], pdf["stop"], pdf["words"]):
                if r != route:
                    if len(group) > 1:                  # a window can be in two segments
                        shard.extend(group)
                        held += sum(len(g[0]) for g in group)
                        if held >= shard_words:
                            spans()
                            held = 0
                    group.clear()
                    route, prev = r, None
                if prev is not None and prev[0] == words:
                    if (doc, start) != prev[1:]:
                        out.append((None, False, doc, h, start, stop, None))
                    continue
                prev = (words, doc, start)
                if not hot:
                    group.append((words.split(b" "), (doc is not None, doc or 0), int(start), doc, h))
                elif not last:
                    out.append((r, True, doc, h, start, stop, words))
            if out:
                yield _frame(out)
                out.clear()
        if len(group) > 1:
            shard.extend(group)
        spans()
        if out:
            yield _frame(out)
    return run


def _kept(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
                words = (text or "").encode("utf-8").split()
                n = len(words)
                if spans is not None and len(spans):
                    if any(s["start"] < 0 for s in spans):          # a copy of a smaller row's text
                        words = [] if n >= window else words
                    else:
                        mark = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(mark, [s["start"] for s in spans], 1)
                        np.add.at(mark, [s["stop"] for s in spans], -1)
                        keep = np.cumsum(mark[:n]) == 0
                        words = [w for w, k in zip(words, keep) if k]
                rows.append((doc_id, n, n - len(words), b" ".join(words).decode("utf-8")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"])
    return run


def copies(rows: DataFrame) -> DataFrame:
    """(doc_id, h) of ``keyed`` rows whose whole text also is that of a smaller doc_id."""
    t = rows.where("text is not null").select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("sha"))
    # Null ids come first, so a text that a row without id has is its copy in all others.
    least = t.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("none"), F.count("*").alias("c"))
    least = saved(least.where("c > 1").drop("c"), "copied-texts")
    return t.join(least, "sha").where("doc_id > least or (none and doc_id is not null)").select("doc_id", "h").distinct()


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, salts: int = SALTS,
                   shard_words: int = SHARD_WORDS, without: DataFrame | None = None) -> DataFrame:
    """(doc_id, h, start, stop) in ``keyed`` rows: word spans covered by windows that also start earlier; the rows
    ``without`` (doc_id, h) are not asked, and must repeat smaller rows."""
    occ = anchors(rows, window, gram)
    twice = saved(occ.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1")
                  .select("anchor", (F.col("c") > hot).alias("hot")), "repeated-anchors")
    start = F.shiftrightunsigned("at", _N).bitwiseAND(F.lit((1 << _START) - 1))
    runs = (occ.join(twice, "anchor").groupBy("doc_id", "h")
            .agg(F.collect_list(F.struct("anchor", start.cast("int").alias("start"),
                                         F.col("at").bitwiseAND(F.lit((1 << _N) - 1)).cast("short").alias("n"), "hot")).alias("runs")))
    key = F.struct("doc_id", "h").alias("key")
    runs = runs.select(key, "runs")
    if without is not None:
        runs = runs.join(without.select(key), "key", "left_anti")
    texts = rows.select(key, "text")
    cut = (texts.join(runs, "key")
           .select(F.col("key.doc_id").cast("string").alias("doc_id"), F.col("key.h").alias("h"), "text", "runs")
           .mapInPandas(_cut(window), _CUT))
    # By place, not by document: a text of one word repeats one window all along.
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts))).otherwise(0)
    order = ["route", "words", "doc_id", "start"]

    def dealt(rows: DataFrame, by: list[str], last: bool) -> DataFrame:
        met = rows.repartition(*by).sortWithinPartitions(*order)
        return met.select(*[F.col(c).cast("string").alias(c) if c == "doc_id" else F.col(c) for c in _COLUMNS]) \
            .mapInPandas(_match(window, shard_words, last), _CUT)
    met = dealt(cut.withColumn("salt", salt), ["route", "salt"], False)
    # Both branches read one exchange; only the second one's few rows move again.
    span = ["doc_id", "h", "start", "stop"]
    return met.where("not hot").select(*span).unionByName(dealt(met.where("hot"), ["route"], True).select(*span))


def cleaned(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and ``kept``, the words that stay joined by one space.

    A row whose whole text a smaller doc_id has repeats all its windows, so it is not cut into segments."""
    rows = keyed(docs, shared_ids(docs))
    whole = copies(rows)
    spans = repeated_spans(rows, window, without=whole, **how).unionByName(
        whole.select("doc_id", "h", F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("stop")))
    key = F.struct("doc_id", "h").alias("key")
    spans = (spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"),
                                                                     F.col("stop").cast("int").alias("stop"))).alias("spans")).select(key, "spans"))
    out = (rows.select(key, "text").join(spans, "key", "left")
           .select(F.col("key.doc_id").cast("string").alias("doc_id"), "text", "spans")
           .mapInPandas(_kept(window), "doc_id string, n_words bigint, n_removed bigint, kept string"))
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
