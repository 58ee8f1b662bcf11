"""Queues at berths: single-server closed form (W4), pools whose berths are taken in turn,
scenario KPIs (A6) and the comparison table (A5).

Calls request a berth at their ETA in ``(eta, pos)`` order; ``start = max(eta, end of the call
before at the berth)``; only calls that start before the horizon are served, where the
horizon is ``last eta + longest service + 24 h`` over the whole scenario.

All of it is JVM-only prefix computation (Lindley recursion in closed form):
``start_i = C_{i-1} + max_{j<=i}(a_j - C_{j-1})`` with ``C`` the running service sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berthwise import schema as S
from berthwise.functions.time import HOUR_US, from_us, to_us
from berthwise.operators.scan import ROWS_PER_BLOCK, ROWS_PER_TASK, block_bounds, in_blocks, shares

H = float(HOUR_US)


UNB = Window.unboundedPreceding


def _inside(d: DataFrame, keys: list[str], svc_us: str, pos: str) -> DataFrame:
    """What a call needs of those before it in its group ``keys``: service ``_c``, ``_x = a - c`` and its running maxima."""
    w = Window.partitionBy(*keys).orderBy("a_us", pos)
    d = d.withColumn("_c", F.coalesce(F.sum(svc_us).over(w.rowsBetween(UNB, -1)), F.lit(0)).cast("bigint"))
    d = d.withColumn("_x", F.col("a_us") - F.col("_c"))
    return d.withColumns({"_m": F.max("_x").over(w.rowsBetween(UNB, 0)), "_mp": F.max("_x").over(w.rowsBetween(UNB, -1))})


def _group_totals(svc_us: str) -> list:
    return [F.sum(svc_us).alias("_S"), F.max("_x").alias("_Mt"),
            # first row attaining the bucket maximum = last row setting a strict new running max
            F.max(F.when(F.col("_mp").isNull() | (F.col("_x") > F.col("_mp")), F.col("a_us"))).alias("_At")]


def _carried(b: DataFrame, part: list[str]) -> DataFrame:
    """Threshold and last opening that a block gets from the blocks before it."""
    wb = Window.partitionBy(*part).orderBy("_bkt").rowsBetween(UNB, -1)
    b = b.withColumn("_Cc", F.coalesce(F.sum("_S").over(wb), F.lit(0)).cast("bigint"))
    b = b.withColumn("_Mc", F.max(F.col("_Mt") - F.col("_Cc")).over(wb))
    b = b.withColumn("_thr", F.col("_Mc") + F.col("_Cc"))
    b = b.withColumn("_open_a", F.when(F.coalesce(F.col("_Mt") >= F.col("_thr"), F.lit(True)), F.col("_At")))
    return b.withColumn("_last_open", F.max("_open_a").over(wb))


def _served(d: DataFrame, keys: list[str], svc_us: str, pos: str) -> DataFrame:
    """Start, end and opening of the busy period from what came inside the group and from before it."""
    d = d.withColumn("start_us", F.col("_c") + F.greatest(F.col("_thr"), F.col("_m")))
    d = d.withColumn("end_us", F.col("start_us") + F.col(svc_us))
    opens = F.coalesce(F.col("_x") >= F.greatest(F.col("_thr"), F.col("_mp")), F.lit(True))
    d = d.withColumn("_opens", F.when(opens, F.col("a_us")))
    w = Window.partitionBy(*keys).orderBy("a_us", pos).rowsBetween(UNB, 0)
    d = d.withColumn("busy_start", F.greatest(F.max("_opens").over(w), F.col("_last_open")))
    return d.drop("_c", "_x", "_m", "_mp", "_thr", "_last_open", "_opens", "_bkt")


def fifo_one(df: DataFrame, part: list[str], eta: str = "eta", svc_us: str = "svc_us",
             pos: str = "pos", bounds: list[int] | None = None) -> DataFrame:
    """Single-server FIFO start times per ``part`` (order ``(eta, pos)``),
    plus ``busy_start`` (µs ETA of the call opening the busy period).
    Adds ``a_us``, ``start_us``, ``end_us``, ``busy_start``.

    Closed form ``start_i = C_{i-1} + max_{j<=i}(a_j - C_{j-1})`` evaluated in
    two levels with one shuffle of the calls.  Inside a (part, block) group:
    local exclusive service sum ``c``, ``x = a - c`` and its running maxima
    ``m`` (inclusive) / ``mp`` (exclusive).  One row per bucket carries the
    service ``Cc`` and the maximum ``Mc`` of earlier buckets; with
    ``thr = Mc + Cc``:  ``start = c + max(thr, m)``; a row opens a busy period
    iff ``x >= max(thr, mp)``; a bucket holds an opening iff its maximum
    reaches ``thr``, and its last opening is the first row attaining that
    maximum — so busy starts need no second pass over the calls."""
    block = [*part, "_bkt"]
    d = _inside(in_blocks(df.withColumn("a_us", to_us(eta)), "a_us", bounds=bounds), block, svc_us, pos)
    # one row per (part, block): bounded by pools x blocks, not by calls
    b = _carried(d.groupBy(*block).agg(*_group_totals(svc_us)), part)
    return _served(d.join(b.select(*block, "_thr", "_last_open"), block, "inner"), block, svc_us, pos)


def fifo_replay(calls: DataFrame, part: list[str], capacity: DataFrame, eta: str = "eta",
                svc_us: str = "svc_us", pos: str = "pos", horizon_by: list[str] | None = None,
                bounds: list[int] | None = None, tasks: int | None = None) -> DataFrame:
    """FIFO queues of a pool's berths, taken in turn: the n-th call of a pool (order ``(eta, pos)``)
    goes to berth ``(n - 1) mod k`` and waits there as in W4.

    ``calls`` has ``part`` columns, ``eta``, ``svc_us`` (service µs) and ``pos`` (tie-break for equal
    ETAs).  ``capacity`` maps the pool columns (a subset of ``part``) to ``k``.  ``horizon_by`` (default: ``part``
    minus the pool columns) scopes the horizon; rows starting at or after it are not served.  Output
    adds ``lane`` (the berth's number in the pool), ``start_time``, ``end_time``, ``wait_hours``.

    One shuffle of the calls, by block.  There the calls of a block take turns; a turn is a berth, whose number in the pool is
    known when the blocks before are counted.  Counts and W4's carries are rows per block and turn, and come back to the calls as one
    row per block.  Blocks and ``tasks`` follow the number of calls.
    """
    pool_cols = [c for c in capacity.columns if c != "k"]
    if bounds is None:
        rows = calls.count()
        bounds = block_bounds(calls.select(to_us(eta).alias("_a")), "_a", shares(calls, rows, ROWS_PER_BLOCK))
        tasks = tasks or shares(calls, rows, ROWS_PER_TASK)
    d = in_blocks(calls.join(F.broadcast(capacity), pool_cols, "inner").withColumn("a_us", to_us(eta)), "a_us", bounds=bounds)
    d = d.filter("_bkt is not null")           # capacity: one row per pool and scenario, a bounded broadcast
    block = ["_bkt", *part]
    if tasks:
        d = d.repartition(tasks, *block)
    nth = F.row_number().over(Window.partitionBy(*block).orderBy("a_us", pos))
    d = d.withColumn("_turn", (nth.cast("bigint") - 1) % F.greatest(F.col("k"), F.lit(1)))
    d = _inside(d, [*block, "_turn"], svc_us, pos)
    b = d.groupBy(*block, "_turn", "k").agg(F.count(F.lit(1)).alias("_n"), *_group_totals(svc_us))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy("_bkt").rangeBetween(UNB, -1)), F.lit(0))
    b = _carried(b.withColumn("lane", (F.col("_turn") + before) % F.greatest(F.col("k"), F.lit(1))), [*part, "lane"])
    b = b.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("_turn", "lane", "_thr", "_last_open"))).alias("_of"))
    here = F.get("_of", F.col("_turn").cast("int"))         # a block's turns are 0, 1, ... without gaps
    d = d.join(b, block, "inner").withColumns({c: here[c] for c in ("lane", "_thr", "_last_open")}).drop("_of")
    out = _served(d, [*block, "_turn"], svc_us, pos).drop("_turn")
    hb = horizon_by if horizon_by is not None else [c for c in part if c not in pool_cols]
    horizon = F.max(to_us(eta)) + F.max(svc_us) + F.lit(24 * HOUR_US)
    if hb:
        # one horizon row per scenario: a bounded broadcast
        out = out.join(F.broadcast(calls.groupBy(*hb).agg(horizon.alias("_horizon"))), hb, "inner")
    else:
        out = out.withColumn("_horizon", calls.agg(horizon).scalar())
    out = out.filter(F.col("start_us") < F.col("_horizon")).drop("_horizon")
    return out.withColumns({
        "start_time": from_us("start_us"),
        "end_time": from_us("end_us"),
        "wait_hours": (F.col("start_us") - F.col("a_us")) / F.lit(H),
    })


def scenario_kpis(replayed: DataFrame, capacity_total: DataFrame, by: str = "scenario") -> DataFrame:
    """Per scenario — served, average and maximum wait, utilization
    ``total service / (capacity * horizon)`` with horizon = last end - first
    start (uncapped), and the number of calls waiting < 0.1 h.
    ``capacity_total`` maps ``by`` to ``capacity`` (total berths)."""
    svc_h = F.sum(F.col("end_us") - F.col("start_us")) / F.lit(H)
    horizon_h = (F.max("end_us") - F.min("start_us")) / F.lit(H)
    g = replayed.groupBy(by).agg(
        F.count(F.lit(1)).alias("served"),
        # exact BIGINT sum / count (an average of longs would sum doubles)
        (F.sum(F.col("start_us") - F.col("a_us")) / F.count(F.lit(1)) / F.lit(H)).alias("avg_wait_hours"),
        (F.max(F.col("start_us") - F.col("a_us")) / F.lit(H)).alias("max_wait_hours"),
        svc_h.alias("_svc_h"), horizon_h.alias("_hz_h"),
        F.count_if((F.col("start_us") - F.col("a_us")) < F.lit(int(S.DIRECT_BERTHING_HOURS * HOUR_US)))
        .alias("zero_wait"))
    # every scenario of the capacity table reports, an empty one with zeros
    g = capacity_total.join(g, by, "left")
    util = F.when((F.col("capacity") > 0) & (F.col("_hz_h") > 0),
                  F.col("_svc_h") / (F.col("capacity") * F.col("_hz_h"))).otherwise(F.lit(0.0))
    z = F.lit(0.0)
    return g.select(by, F.coalesce("served", F.lit(0)).alias("served"),
                    F.coalesce("avg_wait_hours", z).alias("avg_wait_hours"),
                    F.coalesce("max_wait_hours", z).alias("max_wait_hours"),
                    F.coalesce(util, z).alias("utilization"), F.coalesce("zero_wait", F.lit(0)).alias("zero_wait"))


def scenario_table(kpis: DataFrame, by: str = "scenario") -> DataFrame:
    """A5: the comparison table — waits 2 dp, utilization and direct-berthing
    share in % 1 dp (0 when nothing was served)."""
    return kpis.select(
        by, "served",
        F.round("avg_wait_hours", 2).alias("avg_wait_h"),
        F.round("max_wait_hours", 2).alias("max_wait_h"),
        F.round(F.col("utilization") * 100, 1).alias("utilization_pct"),
        F.col("zero_wait").alias("direct_berths"),
        F.round(F.when(F.col("served") > 0, F.col("zero_wait") / F.col("served") * 100).otherwise(F.lit(0.0)), 1)
        .alias("direct_berth_rate_pct"))
