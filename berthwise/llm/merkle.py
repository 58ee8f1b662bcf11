"""Merkle manifest of a dataset, built as postorder append logs.

Rows of a group, in a total order, are the leaves of one tree: every two consecutive nodes of a level become
their parent, a last single node becomes a parent alone, until one node remains.  The groups' roots,
ordered by group, are the leaves of one more such tree.

Ranks come from a range sort and one count per partition and group.  A block of ``2**BLOCK_LEVELS`` consecutive ranks
is *aligned*: its nodes form a subtree nobody else writes.  Its builder takes the leaves in order and appends each node when it
is complete, so a block's log is in postorder, and the position of any node follows from its level and index
alone (``position``): it starts behind ``2 i - popcount(i)`` nodes, where ``i`` is its first leaf, and comes last of its own subtree, whose size is a
sum of rounded-up halves.  Block roots are the leaves of the next tier of blocks, and so on; proofs are read from the logs by
position, tier by tier from the top, and no log is searched.

Defined cases: a null group is a group, first of all; null order keys come first; rows equal in order key are ordered by leaf, equal leaves
stand in any order (their proofs differ only by place); a null, empty or very long text is hashed whole by ``digest``; an empty
table has no tree and gives no rows; further columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from berthwise.llm.common import saved

BLOCK_LEVELS = 10                # blocks of 1024 leaves: 64 KB of log
SIDES = np.array(["none", "left", "right"], dtype=object)
PROOF = "array<struct<side:string,digest:string>>"


# -- hashing, in SQL ------------------------------------------------------------------------------

def field(c: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(
        F.when(step["side"] == "left", step["digest"]).otherwise(""), node,
        F.when(step["side"] == "right", step["digest"]).otherwise("")), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, first level first; steps of single nodes have none."""
    return F.transform(F.filter(proof, lambda s: s["digest"].isNotNull()), lambda s: s["digest"])


# -- the log of one block -------------------------------------------------------------------------

def append_log(leaves: Iterable[bytes], height: int) -> list[bytes]:
    """Nodes of a tree of ``height`` levels above its leaves, in order of completion."""
    up = lambda *nodes: hashlib.sha256(b"".join(n.hex().encode() for n in nodes)).digest()
    log: list[bytes] = []
    waiting: list[bytes | None] = [None] * (height + 1)     # by level, nodes that wait for a right neighbour
    for node in leaves:
        level = 0
        log.append(node)
        while level < height and waiting[level] is not None:
            node, waiting[level] = up(waiting[level], node), None
            log.append(node)
            level += 1
        waiting[level] = node
    rising = None
    for level in range(height):                             # the right edge: what still waits rises, alone or with what comes up
        pair = [n for n in (waiting[level], rising) if n is not None]
        if pair:
            rising = up(*pair)
            log.append(rising)
    return log


def position(level: np.ndarray, index: np.ndarray, count: np.ndarray | int) -> np.ndarray:
    """Place in the append log of node ``index`` of ``level`` over ``count`` leaves."""
    first = index << level
    mine = np.minimum(count - first, 1 << level)
    size = sum(np.where(level >= k, -(-mine // (1 << k)), 0) for k in range(int(np.max(level, initial=0)) + 1))
    return 2 * first - np.bitwise_count(first.astype(np.uint64)).astype(np.int64) + size - 1


def proof_steps(count: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """For every leaf and level: side of the sibling (an index of ``SIDES``) and its place in the log."""
    leaf = np.arange(count, dtype=np.int64)[:, None]
    level = np.arange(height, dtype=np.int64)[None, :]
    index = leaf >> level
    other = index ^ 1
    there = (other << level) < count
    side = np.where(there, np.where(other < index, 1, 2), 0)
    return side, position(np.broadcast_to(level, other.shape), np.where(there, other, index), count)


# -- ranks ----------------------------------------------------------------------------------------

def _named() -> str:
    return "m" + uuid.uuid4().hex[:12]


def ranked(df: DataFrame, leaf: str, order: str | None, group: str | None, name: str) -> DataFrame:
    """(g, leaf, row, rank, n): place of each row among the ``n`` rows of its group, by order key and leaf.

    A range sort by group and key, written as it lies; then only counts per (partition, group) are added up.  The last sort
    column spreads rows that are equal in everything."""
    key = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    src = df.select(key(group).alias("g"), key(order).alias("o"), key(leaf).alias("leaf"), F.struct("*").alias("row"))
    src = src.withColumn("spread", F.monotonically_increasing_id())
    sort = [F.col("g").asc_nulls_first(), F.col("o").asc_nulls_first(), F.col("leaf"), F.col("spread")]
    lies = src.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("o", "spread")
    lies = saved(lies.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), f"{name}-leaves")
    parts = lies.groupBy("part", "g").agg(F.min("at").alias("from"), F.count("*").alias("c"))
    w = Window.partitionBy("g")
    before = F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = saved(parts.select("part", F.col("g").alias("pg"), "from", F.coalesce(before, F.lit(0)).alias("before"),
                               F.sum("c").over(w).alias("n")), f"{name}-counts")
    out = lies.join(parts.withColumnRenamed("part", "pp"), (F.col("part") == F.col("pp")) & F.col("g").eqNullSafe(F.col("pg")))
    return out.select("g", "leaf", "row", (F.col("before") + F.col("at") - F.col("from")).alias("rank"), "n")


# -- tiers of blocks ------------------------------------------------------------------------------

def _levels() -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1))).cast("int")


def _logs(nodes: DataFrame, name: str) -> DataFrame:
    """(g, block, n, levels, log) of (g, rank, n, levels, leaf) rows; ``levels`` are those left above these leaves."""
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        height = min(table["levels"][0].as_py(), BLOCK_LEVELS)
        log = append_log([bytes.fromhex(x) for x in table["leaf"].to_pylist()], height)
        return pa.table({"g": table["g"].slice(0, 1), "block": table["block"].slice(0, 1), "n": table["n"].slice(0, 1),
                         "levels": table["levels"].slice(0, 1), "root": pa.array([log[-1].hex()]), "log": pa.array([b"".join(log)])})
    rows = nodes.select("g", F.shiftright("rank", BLOCK_LEVELS).alias("block"), "rank", "n", "levels", "leaf")
    made = T.StructType([*rows.select("g", "block", "n", "levels").schema,
                         T.StructField("root", T.StringType()), T.StructField("log", T.BinaryType())])
    return saved(rows.groupBy("g", "block").applyInArrow(build, made), f"{name}-log")


def _above(logs: DataFrame) -> DataFrame:
    """Block roots as the next tier's leaves."""
    step = 1 << BLOCK_LEVELS
    return logs.select("g", F.col("block").alias("rank"), F.expr(f"(n + {step - 1}) div {step}").alias("n"),
                       F.greatest(F.col("levels") - BLOCK_LEVELS, F.lit(0)).alias("levels"), F.col("root").alias("leaf"))


def _proofs(rows: DataFrame, logs: DataFrame, above: DataFrame) -> DataFrame:
    """``rows`` of a tier with their proofs: steps read from their block's log, then those of the block's root (``above``: g, block, steps, subroot, root)."""
    rk = rows.select("g", F.shiftright("rank", BLOCK_LEVELS).alias("block"), "rank", "row")
    a = above.select(F.col("g").alias("ag"), F.col("block").alias("ab"), "steps", "subroot", "root")
    lg = logs.drop("root").join(a, F.col("g").eqNullSafe(F.col("ag")) & (F.col("block") == F.col("ab"))).drop("ag", "ab")
    made = T.StructType([*rk.select("g", "rank", "row").schema, *a.select("steps", "subroot", "root").schema])

    def read(mine: pa.Table, log: pa.Table) -> pa.Table:
        mine, log = mine.sort_by("rank"), log.to_pylist()[0]
        count, height, above_it = len(mine), min(log["levels"], BLOCK_LEVELS), log["steps"]
        nodes = np.array([log["log"][i:i + 32].hex() for i in range(0, len(log["log"]), 32)], dtype=object)
        side, place = proof_steps(count, height)
        own = np.where(side > 0, nodes[place], None)
        tail = np.full((count, len(above_it)), None, dtype=object)
        tail_side = tail.copy()
        tail[:], tail_side[:] = [s["digest"] for s in above_it], [s["side"] for s in above_it]
        sides = np.concatenate([SIDES[side], tail_side], axis=1)
        digests = np.concatenate([own, tail], axis=1)
        steps = pa.ListArray.from_arrays(
            pa.array(np.arange(count + 1, dtype=np.int32) * sides.shape[1]),
            pa.StructArray.from_arrays([pa.array(x.ravel().tolist(), pa.string()) for x in (sides, digests)], names=["side", "digest"]))
        same = lambda c: pa.array([log[c]] * count, pa.string())
        return pa.table({"g": mine["g"], "rank": mine["rank"], "row": mine["row"], "steps": steps, "subroot": same("subroot"), "root": same("root")})
    return rk.groupBy("g", "block").cogroup(lg.groupBy("g", "block")).applyInArrow(read, made)


def _tree(rows: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Logs of all tiers, lowest first, and (g, root) of the finished trees."""
    tiers = []
    nodes = rows.withColumn("levels", _levels())
    while True:
        tiers.append(_logs(nodes, f"{name}-{len(tiers)}"))
        deepest = tiers[-1].agg(F.max("levels")).first()[0]
        if deepest is None or deepest <= BLOCK_LEVELS:
            break
        # Trees that are finished ride along as single leaves.
        nodes = _above(tiers[-1])
    return tiers, tiers[-1].select("g", "root")


def _proven(rows: DataFrame, tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """Proofs of ``rows``: from the top tier down, block roots first."""
    for tier in range(len(tiers) - 1, 0, -1):
        nodes = tiers[tier - 1].select("g", F.col("block").alias("rank"), F.lit(0).alias("row"))
        above = saved(_proofs(nodes, tiers[tier], above).select("g", F.col("rank").alias("block"), "steps", "subroot", "root"), f"proofs-{tier}")
    return _proofs(rows, tiers[0], above)


def manifest(df: DataFrame, leaf: str, order: str, group: str) -> DataFrame:
    """(row, subroot, root, proof): each row of ``df`` as a struct, with the roots over it and the steps that lead to them."""
    name = _named()
    rows = ranked(df, leaf, order, group, name)
    tiers, roots = _tree(rows, name)
    tops = ranked(roots, "root", "g", None, name + "-top").withColumn("g", F.lit("all"))
    top_tiers, top = _tree(tops, name + "-top")
    whole = top.select("g", F.lit(0).cast("bigint").alias("block"), F.array().cast(PROOF).alias("steps"), F.lit("").alias("subroot"), "root")
    up = _proven(tops, top_tiers, whole)
    up = saved(up.select(F.col("row.g").alias("g"), F.lit(0).cast("bigint").alias("block"), "steps", F.col("row.root").alias("subroot"), "root"),
               f"{name}-roots")
    return _proven(rows, tiers, up).select("row", "subroot", "root", F.col("steps").alias("proof"))
