"""Skew-safe running aggregates (prefix max / prefix sum) per key.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to
one task; a berth or pool holding a third of all rows would then run in one
task.  Prefix max and prefix sum are associative, so we scan in two levels:

1. inside ``(key, block)`` partitions with an ordinary window.  Blocks are ranges of the order
   column, cut at its approximate quantiles (:func:`in_blocks`): as many as the session has shuffle
   partitions, each with about as many rows, however the rows lie in time;
2. per key over blocks: one carry row per block, so at most as many as partitions, joined back on
   ``(key, block)`` — the same hash partitioning as step 1, so the big side
   is not shuffled again.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_US = 86_400_000_000


def bucket_of(us_col, width_us: int = DAY_US) -> Column:
    """Bucket number of a microsecond timestamp."""
    c = F.col(us_col) if isinstance(us_col, str) else us_col
    return F.floor(c / F.lit(width_us)).cast("bigint")


MOST_BLOCKS = 20_000


def block_bounds(df: DataFrame, us_col: str, blocks: int | None = None) -> list[int]:
    """Ascending inner bounds of ``blocks`` ranges of ``us_col`` with about equal row counts: one aggregate over
    that column; only the bounds come to the driver."""
    n = min(blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_BLOCKS)
    if n < 2:
        return []
    got = df.agg(F.percentile_approx(us_col, [i / n for i in range(1, n)], max(1_000, 10 * n))).first()[0]
    return sorted(set(got or []))


ROWS_PER_BLOCK = 50_000
ROWS_PER_TASK = 500_000


def shares(df: DataFrame, rows: int, per: int) -> int:
    """Parts of about ``per`` rows, at least as many as the session has shuffle partitions: what one task holds doesn't grow with ``rows``."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))


def _literal(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<bigint>")


def block_of(us: Column, bounds: list[int]) -> Column:
    """Number of bounds at or before ``us``.  Equal cells of the span tell between which bounds to look, so a row
    compares itself with the few bounds of its cell."""
    if len(bounds) < 8:
        return sum((F.when(us >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")
    cells = 4 * len(bounds)
    lo, width = bounds[0], max(1, -(-(bounds[-1] + 1 - bounds[0]) // cells))
    before = [bisect.bisect_left(bounds, lo + c * width) for c in range(cells + 1)]
    cell = F.least(F.greatest(F.floor((us - F.lit(lo)) / F.lit(width)), F.lit(0)), F.lit(cells - 1)).cast("int")
    start, stop = (F.element_at(_literal(before), cell + F.lit(k)) for k in (1, 2))
    near = F.filter(F.slice(_literal(bounds), (start + 1).cast("int"), (stop - start).cast("int")), lambda b: b <= us)
    # most cells hold one bound or none; only others need a list
    one = F.when(F.element_at(_literal(bounds), (start + 1).cast("int")) <= us, 1).otherwise(0)
    return F.when(stop == start, start).when(stop == start + 1, start + one).otherwise(start + F.size(near)).cast("int")


def in_blocks(df: DataFrame, us_col: str, out: str = "_bkt", bounds: list[int] | None = None) -> DataFrame:
    """``df`` with the number of each row's block by ``us_col`` (null where that is null); ``bounds`` where they are known
    already, so the rows aren't computed twice."""
    us = F.col(us_col)
    if bounds is None:
        bounds = block_bounds(df, us_col)
    return df.withColumn(out, F.when(us.isNotNull(), block_of(us, bounds)))


def _carry(df: DataFrame, keys: list[str], bucket: str, value: str, agg, out: str) -> DataFrame:
    per = df.groupBy(*keys, bucket).agg(agg(value).alias("_b"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    fn = F.max if agg is F.max else F.sum
    return per.select(*keys, bucket, fn("_b").over(w).alias(out))


def running(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str,
            how: str = "max", inclusive: bool = True) -> DataFrame:
    """Add ``out`` = max/sum of ``value`` over the rows of the same ``keys``
    ordered by (``bucket``, ``order``), up to this row (``inclusive``) or up
    to the previous row.  NULL when there is no such row (max) / 0 (sum)."""
    agg = F.max if how == "max" else F.sum
    end = 0 if inclusive else -1
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = agg(value).over(w)
    carry = _carry(df, keys, bucket, value, agg, "_carry")
    j = df.withColumn("_local", local).join(carry, [*keys, bucket], "inner")
    if how == "max":
        val = F.greatest(F.col("_local"), F.col("_carry"))
    else:
        val = F.coalesce(F.col("_local"), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    return j.withColumn(out, val).drop("_local", "_carry")


_FOLDS = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, None)}


def running_each(df: DataFrame, keys: list[str], bucket: str, order: list, values: dict[str, tuple[str, str]],
                 inclusive: bool = True) -> DataFrame:
    """:func:`running` for several ``{out: (value, how)}`` in one pass; ``how`` is max, min or sum."""
    end = 0 if inclusive else -1
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    folds = [(i, out, value, *_FOLDS[how]) for i, (out, (value, how)) in enumerate(values.items())]
    per = df.groupBy(*keys, bucket).agg(*[agg(value).alias(f"_b{i}") for i, _, value, agg, _ in folds])
    carry = per.select(*keys, bucket, *[agg(f"_b{i}").over(before).alias(f"_carry{i}") for i, _, _, agg, _ in folds])
    j = df.withColumns({f"_local{i}": agg(value).over(w) for i, _, value, agg, _ in folds}).join(carry, [*keys, bucket], "inner")
    zero = F.lit(0)
    vals = {out: both(F.col(f"_local{i}"), F.col(f"_carry{i}")) if both
            else F.coalesce(F.col(f"_local{i}"), zero) + F.coalesce(F.col(f"_carry{i}"), zero) for i, out, _, _, both in folds}
    return j.withColumns(vals).drop(*[f"_{c}{i}" for i, *_ in folds for c in ("local", "carry")])


def next_value(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str, tasks: int | None = None) -> DataFrame:
    """Add ``out`` = ``value`` of the next row of the same ``keys`` in
    (``bucket``, ``order``) order (NULL for the last row) — a skew-safe
    ``lead``: inside a bucket an ordinary lead; the last row of a bucket takes
    the first value of the next non-empty bucket.  ``tasks``: into how many the rows are dealt (default: as the session has it)."""
    w = Window.partitionBy(*keys, bucket).orderBy(*order)
    local = F.lead(value).over(w)
    firsts = df.groupBy(*keys, bucket).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    wb = Window.partitionBy(*keys).orderBy(bucket)
    nxt = firsts.select(*keys, bucket, F.lead("_first").over(wb).alias("_next_bucket_first"))
    rows = df.repartition(tasks, *keys, bucket) if tasks else df
    j = rows.withColumn("_local", local).join(nxt, [*keys, bucket], "inner")
    return j.withColumn(out, F.coalesce("_local", "_next_bucket_first")).drop("_local", "_next_bucket_first")
