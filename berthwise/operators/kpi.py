"""Schedule KPIs, accuracy, utilization, queue and occupancy time series.

Durations are summed as BIGINT microseconds and converted to hours at the
end, so results are exact and identical across engines.  All aggregations are
hash aggregations with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berthwise import schema as S
from berthwise.functions.time import HOUR_US, from_us, to_us
from berthwise.operators.scan import in_blocks, running
from berthwise.session import cut_lineage

H = float(HOUR_US)


def with_plan_measures(plan: DataFrame, eta: str = "eta", start: str = "scheduled_start",
                       end: str = "predicted_end") -> DataFrame:
    """wait = max(0, start - eta) and service = end - start, in µs and hours."""
    d = F.timestamp_diff("MICROSECOND", F.col(eta), F.col(start))
    svc = F.timestamp_diff("MICROSECOND", F.col(start), F.col(end))
    return plan.withColumns({
        "wait_us": F.when(d.isNotNull(), F.greatest(d, F.lit(0))),
        "service_us": svc,
    }).withColumns({
        "predicted_wait_hours": F.col("wait_us") / F.lit(H),
        "service_hours": F.col("service_us") / F.lit(H),
    })


def _direct(wait_us: str = "wait_us") -> Column:
    """Direct berthing, wait < 0.1 h (= 360 s)."""
    return F.col(wait_us) < F.lit(int(S.DIRECT_BERTHING_HOURS * HOUR_US))


def schedule_totals(plan: DataFrame, by: str = "plan_id") -> DataFrame:
    """A1: total and average wait per plan (average 0 for an empty plan)."""
    p = with_plan_measures(plan)
    return p.groupBy(by).agg(
        (F.sum("wait_us") / F.lit(H)).alias("total_wait_hours"),
        F.coalesce(F.avg("wait_us") / F.lit(H), F.lit(0.0)).alias("avg_wait_hours"))


def schedule_kpis(plan: DataFrame, by: str = "plan_id", plan_ids: DataFrame | None = None) -> DataFrame:
    """A2: vessels, avg/max/min wait, direct count and rate, total service
    hours per plan.  With ``plan_ids`` (one row per plan) an empty plan
    reports a row of zeros."""
    p = with_plan_measures(plan)
    n = F.count(F.lit(1))
    g = p.groupBy(by).agg(
        n.alias("total_vessels"),
        (F.avg("wait_us") / F.lit(H)).alias("avg_wait_hours"),
        (F.max("wait_us") / F.lit(H)).alias("max_wait_hours"),
        (F.min("wait_us") / F.lit(H)).alias("min_wait_hours"),
        F.count_if(_direct()).alias("direct_berth_count"),
        (F.count_if(_direct()) / n).alias("direct_berth_rate"),
        (F.sum("service_us") / F.lit(H)).alias("total_service_hours"))
    if plan_ids is None:
        return g
    out = plan_ids.select(by).distinct().join(g, by, "left")
    return out.fillna(0, subset=[c for c in g.columns if c != by])


def format_kpis(kpis: DataFrame) -> DataFrame:
    """The display view — waits 2 dp, rate in % 1 dp, service 1 dp
    (Spark ``round`` is half-up)."""
    return kpis.select(
        *[c for c in kpis.columns if c not in (
            "avg_wait_hours", "max_wait_hours", "min_wait_hours", "direct_berth_rate", "total_service_hours")],
        F.round("avg_wait_hours", 2).alias("avg_wait_hours"),
        F.round("max_wait_hours", 2).alias("max_wait_hours"),
        F.round("min_wait_hours", 2).alias("min_wait_hours"),
        F.round(F.col("direct_berth_rate") * 100, 1).alias("direct_berth_rate_pct"),
        F.round("total_service_hours", 1).alias("total_service_hours"))


def format_ml_metrics(metrics: DataFrame) -> DataFrame:
    """P17 (ML): one text line per metrics row."""
    return metrics.select("*", F.format_string(
        "Service Time Predictor — RMSE=%.2fh  MAE=%.2fh  R²=%.4f", "rmse", "mae", "r2").alias("summary"))


def berth_utilization(plan: DataFrame, n_berths: int | Column, horizon_hours: float = S.UTILIZATION_HORIZON_HOURS,
                      by: str = "plan_id") -> DataFrame:
    """A3: ``min(1, total service / (n_berths * horizon))``; 0 without berths."""
    p = with_plan_measures(plan)
    n = n_berths if isinstance(n_berths, Column) else F.lit(n_berths)
    cap = n.cast("double") * F.lit(float(horizon_hours))
    svc_h = F.sum("service_us") / F.lit(H)
    return p.groupBy(by).agg(F.when(cap > 0, F.least(F.lit(1.0), svc_h / cap)).otherwise(F.lit(0.0))
                             .alias("utilization"))


def schedule_accuracy(plan: DataFrame, actual: DataFrame, window_hours: float = S.ON_TIME_WINDOW_HOURS,
                      by: str = "plan_id", key: str = "call_id", start: str = "scheduled_start",
                      actual_col: str = "actual_time") -> DataFrame:
    """Share of matched calls whose actual berthing is within
    ``window`` of the planned start (``<=``); unmatched calls are ignored; 0
    when nothing matches."""
    j = plan.select(by, key, start).join(actual.select(key, actual_col), key, "left")
    err = F.abs(F.timestamp_diff("MICROSECOND", F.col(start), F.col(actual_col)))
    ok = err <= F.lit(int(window_hours * HOUR_US))
    matched = F.count(actual_col)
    return j.groupBy(by).agg(
        matched.alias("matched"),
        F.when(matched > 0, F.count_if(ok) / matched).otherwise(F.lit(0.0)).alias("accuracy"))


def late_arrivals(calls: DataFrame, actual: DataFrame, threshold_hours: float = S.LATE_ARRIVAL_HOURS,
                  key: str = "call_id", eta: str = "eta", actual_col: str = "actual_time") -> DataFrame:
    """delay = actual arrival - ETA in hours; late iff delay > threshold."""
    j = calls.join(actual.select(key, actual_col), key, "inner")
    d = F.timestamp_diff("MICROSECOND", F.col(eta), F.col(actual_col))
    return j.withColumns({"delay_hours": d / F.lit(H), "is_late": d > F.lit(int(threshold_hours * HOUR_US))})


def throughput(plan: DataFrame, period: str = "24 hours", by: str = "plan_id",
               start: str = "scheduled_start") -> DataFrame:
    """Vessels served per tumbling period (by planned start)."""
    return (plan.groupBy(by, F.window(start, period).alias("w"))
            .agg(F.count(F.lit(1)).alias("vessels_served"))
            .select(by, F.col("w.start").alias("period_start"), "vessels_served"))


def _ceil_div(x: Column, step: int) -> Column:
    """Exact integer ceil(x / step) for BIGINT x (any sign)."""
    r = x % F.lit(step)
    return ((x - r) / F.lit(step)).cast("bigint") + (r > 0).cast("bigint")


def _difference_series(intervals: DataFrame, bounds: DataFrame, by: str, step_us: int, out: str) -> DataFrame:
    """Count of ``intervals`` (by, _a, _b), half-open, containing each tick ``_t0 + k*step``,
    ``k = 0..floor((_t1 - _t0)/step)`` of their ``bounds`` (by, _t0, _t1), via a difference array: +1 at the first
    tick >= _a, -1 at the first tick >= _b, then a running sum over ticks.
    O(rows + ticks) instead of O(rows x ticks)."""
    e = intervals.join(bounds.select(by, "_t0"), by)
    e = e.select(by, _ceil_div(F.col("_a") - F.col("_t0"), step_us).alias("_lo"),
                 _ceil_div(F.col("_b") - F.col("_t0"), step_us).alias("_hi")).filter("_hi > _lo")
    ends = F.inline(F.array(F.struct(F.col("_lo").alias("k"), F.lit(1).alias("d")),
                            F.struct(F.col("_hi").alias("k"), F.lit(-1).alias("d"))))
    deltas = e.select(by, ends).groupBy(by, "k").agg(F.sum("d").alias("d"))
    kmax = ((F.col("_t1") - F.col("_t0")) / F.lit(step_us)).cast("bigint")
    spine = (bounds.filter("_t1 >= _t0")                     # guard: sequence never counts down
             .select(by, "_t0", F.explode(F.sequence(F.lit(0).cast("bigint"), kmax)).alias("k")))
    s = spine.join(deltas, [by, "k"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    # the spine of one group is bounded by its time span / step, not by its rows
    w = Window.partitionBy(by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return s.select(by, from_us(F.col("_t0") + F.col("k") * F.lit(step_us)).alias("timestamp"),
                    F.sum("d").over(w).alias(out))


def queue_series(plan: DataFrame, step_hours: float = 1.0, by: str = "plan_id", eta: str = "eta",
                 start: str = "scheduled_start", end: str = "predicted_end") -> DataFrame:
    """TS1: queue length (calls with ``eta <= t < start``) at ticks from the
    first ETA to the last predicted end, inclusive, every ``step``."""
    step = int(step_hours * HOUR_US)
    p = plan.select(by, to_us(eta).alias("_a"), to_us(start).alias("_b"), to_us(end).alias("_c"))
    bounds = p.groupBy(by).agg(F.min("_a").alias("_t0"), F.max("_c").alias("_t1"))
    return _difference_series(p, bounds, by, step, "queue_length")


def occupancy_series(islands: DataFrame, n_berths: int, step_hours: float = 1.0, by: str | None = None) -> DataFrame:
    """TS2: occupied / free berths and utilization on a tick grid.  Takes
    per-berth busy islands (``merge_busy(res, gap_seconds=0)``) so that
    overlapping bookings count a berth once."""
    step = int(step_hours * HOUR_US)
    key = by or "_all"
    p = islands.select(*([by] if by else []), to_us("island_start").alias("_a"), to_us("island_end").alias("_b"))
    if not by:
        # one series: a constant key; the islands are read by the bounds and the deltas, so they are written once
        p = cut_lineage(p.withColumn(key, F.lit(0)))
    bounds = p.groupBy(key).agg(F.min("_a").alias("_t0"), F.max("_b").alias("_t1"))
    s = _difference_series(p, bounds, key, step, "occupied")
    s = s.withColumns({"free": F.lit(n_berths) - F.col("occupied"),
                       "utilization": F.col("occupied") / F.lit(float(max(n_berths, 1)))})
    return s if by else s.drop(key)


def congestion_peaks(series: DataFrame, k: int = 10, threshold: int = S.CONGESTION_ALERT_VESSELS,
                     value: str = "queue_length", order_extra=("plan_id", "timestamp")) -> DataFrame:
    """L2: the ``k`` most congested ticks above the alert threshold (a top-k
    report: TakeOrderedAndProject, no full sort)."""
    return (series.filter(F.col(value) > threshold)
            .orderBy(F.desc(value), *order_extra).limit(k))


def label_types(col: str = "vessel_type") -> Column:
    """Display label of a type code (unknown codes shown as-is)."""
    m = F.create_map(*[F.lit(x) for kv in S.VESSEL_TYPE_LABELS for x in kv])
    return F.coalesce(m[F.col(col)], F.col(col))


def queue_board(queue: DataFrame, t, by: str = "port_id", eta: str = "eta", key: str = "call_id") -> DataFrame:
    """W1+P16: calls that have arrived by ``t``, ranked from 1 by ETA within
    ``by``, with hours waited at ``t`` and display labels.

    The rank is a running count computed with the two-level scan, so a port
    holding most of the queue is still ranked by many tasks."""
    tc = F.lit(t).cast("timestamp_ntz") if not isinstance(t, Column) else t
    q = queue.filter(F.col(eta) <= tc).withColumns({"_a": to_us(eta), "_one": F.lit(1)})
    q = in_blocks(q, "_a")
    q = running(q, [by], "_bkt", ["_a", key], "_one", "rank", "sum", inclusive=True)
    cargo = F.coalesce(F.nullif(F.col("cargo_import"), F.lit("")), F.col("cargo_export"))
    return q.select(
        *queue.columns, F.col("rank").cast("bigint").alias("rank"),
        (F.timestamp_diff("MICROSECOND", F.col(eta), tc) / F.lit(H)).alias("hours_waiting"),
        label_types("vessel_type").alias("type_label"), cargo.alias("cargo_label"),
        F.when(F.col("is_priority"), F.lit("YES")).otherwise(F.lit("—")).alias("priority_label"))


def kpi_history(plans: DataFrame, step: str = "plan_id") -> DataFrame:
    """Per allocation step — vessels served, total / average wait (2 dp)
    — and running totals: cumulative served, cumulative wait, cumulative
    average (0 before anything is served).  Steps are few (one row each), so
    the running window is over step rows, not call rows."""
    p = with_plan_measures(plans)
    g = p.groupBy(step).agg(F.count(F.lit(1)).alias("vessels_served"), F.sum("wait_us").alias("_w"))
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    cum_n = F.sum("vessels_served").over(w)
    cum_w = F.sum("_w").over(w)
    return g.select(
        step, "vessels_served",
        F.round(F.col("_w") / F.col("vessels_served") / F.lit(H), 2).alias("avg_wait_h"),
        F.round(F.col("_w") / F.lit(H), 2).alias("total_wait_h"),
        cum_n.alias("cumulative_served"),
        (cum_w / F.lit(H)).alias("cumulative_wait_hours"),
        F.when(cum_n > 0, cum_w / cum_n / F.lit(H)).otherwise(F.lit(0.0)).alias("avg_cumulative_wait"))
