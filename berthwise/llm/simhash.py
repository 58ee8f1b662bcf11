"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made in one Arrow pass over the texts.  The index works on
*distinct* fingerprints, so copies of any number cost one entry.  A fingerprint
is cut into ``max_bits // 2 + 1`` segments or more; two fingerprints at
``max_bits`` or fewer differing bits agree up to a small radius in one of them, so every
fingerprint enumerates the Hamming ball of that radius in each segment, fetches
the table entries stored under those segment values and keeps the matches whose
complete distance is small enough.

Defined cases: null and empty texts have fingerprint zero and link like any
other; repeated rows each get a row; a null ``doc_id`` never names a component
unless all its documents have none; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berthwise.llm.common import saved

SEED = 42


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of one text (majority of the shingles' XXH64 bits)."""
    words = (text or "").encode("utf-8").lower().split()      # ASCII case and white space only
    n = len(words)
    if n == 0:
        return 0
    if n < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        flat = b" ".join(words)
        ends = list(accumulate(map((1).__add__, map(len, words))))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[s:e - 1], seed)
                  for s, e in zip([0, *ends[:n - shingle]], ends[shingle - 1:])]
    ones = np.zeros(64, dtype=np.int64)
    all_h = np.array(hashes, dtype=">u8")
    for lo in range(0, len(all_h), 1 << 16):                   # bounded scratch for very long texts
        part = all_h[lo:lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(all_h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, h, fp): fp is the fingerprint's bits as a signed long, h a hash of the text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "h": pdf["h"], "fp": fp})
    # Ids pass as text, so that nulls beside them don't make them floats.
    src = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.xxhash64("text").alias("h"),
                      F.col("text").cast("string").alias("text"))
    return src.mapInPandas(run, "doc_id string, h bigint, fp bigint").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _ball(width: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` bits among ``width``."""
    masks = [0]
    grown = [(0, 0)]
    for _ in range(radius):
        grown = [(m | 1 << b, b + 1) for m, lo in grown for b in range(lo, width)]
        masks += [m for m, _ in grown]
    return masks


def linked(fps: DataFrame, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column ``fp``, no repeats) at ``max_bits`` or
    fewer differing bits, each pair once.

    With m segments one of them differs in at most r = max_bits // m bits.  A
    pair at segment distance 1..r is met from its side with the larger segment
    value only, so half a ball is enumerated; a pair already met in an earlier
    segment is skipped there."""
    width = 64 // segments
    radius = max_bits // segments
    ones = (1 << width) - 1

    def seg(c, j):
        return F.shiftrightunsigned(c, width * j).bitwiseAND(F.lit(ones).cast("bigint"))

    cut = F.posexplode(F.array(*[seg(F.col("fp"), j) for j in range(segments)])).alias("j", "seg")
    table = fps.select(F.col("fp").alias("b"), cut)
    masks = F.array(*[F.lit(m).cast("bigint") for m in _ball(width, radius)])
    probes = (fps.select(F.col("fp").alias("a"), cut)
              .select("a", "j", F.col("seg").alias("own"),
                      F.explode(F.filter(F.transform(masks, lambda m: F.col("seg").bitwiseXOR(m)),
                                         lambda p: p <= F.col("seg"))).alias("seg")))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    fresh = F.lit(True)
    for j in range(segments - 1):
        fresh = fresh & ((F.col("j") <= j) | (F.bit_count(seg(diff, j)) > radius))
    met = probes.join(table, ["j", "seg"]).where(
        (F.bit_count(diff) <= max_bits) & ((F.col("own") != F.col("seg")) | (F.col("a") < F.col("b"))) & fresh)
    return met.select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected link table (a, b); root is the
    component's smallest node.  Alternates large-star and small-star rounds
    until the links are stars; each round is a written table."""
    def minima(pairs: DataFrame) -> DataFrame:
        # Written, so that the join below reads two plain exchanges and a hub's
        # rows can be split by the adaptive skew join.
        return saved(pairs.groupBy("a").agg(F.min("b").alias("m")), "star")

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = minima(both).withColumn("m", F.least("a", "m"))
        return (both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .where("a <> b").distinct())

    def small(e: DataFrame) -> DataFrame:
        m = minima(e)
        hung = e.join(m, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return hung.unionByName(m.select("a", F.col("m").alias("b"))).distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first())

    e = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = sign(e)
    while before[0]:
        e = saved(small(saved(large(e), "large")), "small")
        now = sign(e)
        if now == before:
            break
        before = now
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, h, fp, component_id (smallest doc_id that links reach,
    itself included) and stays (whether it is that row; of rows with its id, the smallest text hash)."""
    every = saved(fingerprints(docs, shingle), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    distinct = saved(every.groupBy("fp").agg(F.min(row).alias("first")), "distinct")
    comp = components(linked(distinct.select("fp"), max_bits, segments))
    named = distinct.join(comp, distinct["fp"] == comp["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    ids = saved(named.join(least, "root").select("fp", "least"), "component-ids")
    return every.join(ids, "fp").select("doc_id", "h", "fp", F.col("least.doc_id").alias("component_id"),
                                        (row == F.col("least")).alias("stays"))


def deduplicated(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that stand for their component; of rows that repeat its id
    and text the smallest in column order."""
    stay = near_duplicates(docs, shingle, max_bits).where("stays").select(F.struct("doc_id", "h").alias("_key"))
    own = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("row"))
    return (docs.select(F.struct("*").alias("row"), own.alias("_key")).join(stay, "_key", "left_semi").withColumn("_nth", nth)
            .where("_nth = 1").select("row.*"))
