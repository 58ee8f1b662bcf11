"""What-if transforms of an arrival table (WI1-WI7), the tagged union of all
scenarios (U1) and the service-time lookup (J16).

An arrival table has ``call_id``, ``name``, ``eta``, ``pos`` (list position)
and whatever grouping columns the caller uses (``list_by``, e.g. a port).
"List order" is ``(eta, pos)``.  Every transform is a lazy projection, union
or small join; one replay job then runs over all scenarios together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame  # noqa: F401
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berthwise import schema as S
from berthwise.functions.time import HOUR_US, MINUTE_US, from_us, to_us  # noqa: F401
from berthwise.operators.scan import in_blocks, next_value

SCENARIOS = ["S1_Baseline", "S2_Congestion", "S3_WeatherClosure", "S4_Maintenance",
             "S5_LateArrival", "S6_Priority", "S7_Conflict"]


def with_service(calls: DataFrame, service: DataFrame | None, key: str = "call_id",
                 default_hours: float = S.DEFAULT_SERVICE_HOURS, out: str = "svc_us") -> DataFrame:
    """Service µs per call from a lookup (``key``, ``service_hours``),
    ``default_hours`` when absent.  Clones keep the original ``key``."""
    dflt = F.lit(int(default_hours * HOUR_US)).cast("bigint")
    if service is None:
        return calls.withColumn(out, dflt)
    s = service.select(key, F.round(F.col("service_hours") * F.lit(float(HOUR_US))).cast("bigint").alias("_svc"))
    return calls.join(s, key, "left").withColumn(out, F.coalesce("_svc", dflt)).drop("_svc")


_ONE = "_list"


def _keyed(calls: DataFrame, list_by: list[str] | None) -> tuple[DataFrame, list[str], bool]:
    """Lists are identified by ``list_by``; a single list gets a constant key
    so that every lookup below is an equi-join (never a cross join)."""
    if list_by:
        return calls, list(list_by), False
    return calls.withColumn(_ONE, F.lit(0)), [_ONE], True


def _unkey(df: DataFrame, added: bool) -> DataFrame:
    return df.drop(_ONE) if added else df


def wi_baseline(calls: DataFrame) -> DataFrame:
    """WI1: the arrivals as recorded (replay orders them by ETA)."""
    return calls


def inter_arrivals(calls: DataFrame, list_by: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """For each call, the next call's ETA in list order, the gap in hours
    and the midpoint (NULL for the last call).  Skew-safe lead."""
    keys = list_by or []
    c = in_blocks(calls.withColumn("_a", to_us("eta")), "_a")
    c = next_value(c, keys, "_bkt", ["_a", pos], "_a", "_next_a")
    half = F.bround((F.col("_next_a") - F.col("_a")) / F.lit(2.0)).cast("bigint")
    return c.select(*calls.columns, from_us("_next_a").alias("next_eta"),
                    ((F.col("_next_a") - F.col("_a")) / F.lit(float(HOUR_US))).alias("gap_hours"),
                    from_us(F.col("_a") + half).alias("midpoint"))


def wi_densify(calls: DataFrame, list_by: list[str] | None = None, pos: str = "pos", bounds: list[int] | None = None,
               tasks: int | None = None) -> DataFrame:
    """WI2: for every call but the last in list order, add a clone named
    ``name + "_EXTRA"`` at the midpoint between its ETA and the next call's
    ETA (n -> 2n-1).  Clones sort after originals with equal ETA."""
    keys = list_by or []
    c = in_blocks(calls.withColumn("_a", to_us("eta")), "_a", bounds=bounds)
    c = next_value(c, keys, "_bkt", ["_a", pos], "_a", "_next_a", tasks)
    # half the gap, rounded half-to-even to the microsecond (as timedelta / 2)
    half = F.bround((F.col("_next_a") - F.col("_a")) / F.lit(2.0)).cast("bigint")
    extra = (c.filter(F.col("_next_a").isNotNull())
             .withColumn("eta", from_us(F.col("_a") + half))
             .withColumn("name", F.concat(F.col("name"), F.lit(S.EXTRA_SUFFIX)))
             .withColumn("is_extra", F.lit(True)))
    orig = calls.withColumn("is_extra", F.lit(False))
    return orig.unionByName(extra.select(*orig.columns))


def wi_closure(calls: DataFrame, closure_start, hours: int = S.CLOSURE_HOURS) -> DataFrame:
    """WI3: calls with ETA in ``[start, start + hours)`` arrive at the end of
    the closure plus 10 minutes."""
    s = F.lit(closure_start).cast("timestamp_ntz")
    e = F.timestamp_add("HOUR", F.lit(hours), s)
    inside = (F.col("eta") >= s) & (F.col("eta") < e)
    return calls.withColumn("eta", F.when(inside, F.timestamp_add("MINUTE", F.lit(S.CLOSURE_RELEASE_MINUTES), e))
                            .otherwise(F.col("eta")))


def _head(calls: DataFrame, n: int, pos: str) -> DataFrame:
    """The first ``n`` calls of a single list: no task sorts or holds more than ``n``."""
    return calls.select("call_id", "eta", pos).orderBy("eta", pos).limit(n)


def _nth_in_list(calls: DataFrame, n: int, keys: list[str], pos: str) -> DataFrame:
    """Key of the n-th call (1-based) in list order per list; the first call
    when the list is shorter.  ``row_number() <= n`` is planned as a window
    group limit (per-task top-n before the shuffle), so only n rows per list
    and task move."""
    w = Window.partitionBy(*keys).orderBy("eta", pos)
    head = (calls.select(*keys, "call_id", "eta", pos)
            .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n))
    return head.groupBy(*keys).agg(
        F.when(F.max("_r") >= n, F.max_by("call_id", "_r"))
        .otherwise(F.min_by("call_id", "_r")).alias("_target"))


def _target_col(calls: DataFrame, n: int, list_by: list[str] | None, pos: str):
    """(frame, target id column): per-list targets joined on ``list_by``; for
    a single list a scalar subquery (top-n only, evaluated once)."""
    if list_by:
        t = _nth_in_list(calls, n, list(list_by), pos)
        # one target row per list: bounded by the number of lists
        return calls.join(F.broadcast(t), list(list_by), "left"), F.col("_target")
    return calls, _nth_in_list(_head(calls, n, pos).withColumn(_ONE, F.lit(0)), n, [_ONE], pos).select("_target").scalar()


def wi_delay(calls: DataFrame, hours: int = S.LATE_SCENARIO_DELAY_HOURS,
             list_by: list[str] | None = None, pos: str = "pos", nth: int = 6) -> DataFrame:
    """WI5: the ``nth`` call in list order (default the 6th, else the 1st)
    arrives ``hours`` later."""
    c, target = _target_col(calls, nth, list_by, pos)
    hit = F.col("call_id") == target
    out = c.withColumn("eta", F.when(hit, F.timestamp_add("HOUR", F.lit(hours), F.col("eta")))
                       .otherwise(F.col("eta")))
    return out.drop("_target") if list_by else out


def wi_priority(calls: DataFrame, list_by: list[str] | None = None, pos: str = "pos", nth: int = 1) -> DataFrame:
    """WI6: move the target call (default: the first in list order) to the
    front of the list.  Replay requests at ETA, so this only changes the
    order among equal ETAs: the target gets the smallest position."""
    c, target = _target_col(calls, nth, list_by, pos)
    lowest = F.lit(-(2 ** 62)).cast("bigint")
    out = c.withColumn(pos, F.when(F.col("call_id") == target, lowest).otherwise(F.col(pos)))
    return out.drop("_target") if list_by else out


def wi_conflict(calls: DataFrame, list_by: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """WI7: the first two calls in list order both arrive at the first one's ETA."""
    c, keys, added = _keyed(calls, list_by)
    w = Window.partitionBy(*keys).orderBy("eta", pos)
    first = c if not added else _head(calls, 2, pos).withColumn(_ONE, F.lit(0))
    head = (first.select(*keys, "call_id", "eta", pos)
            .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2))
    t = head.groupBy(*keys).agg(F.collect_list("call_id").alias("_two"),
                                F.min_by("eta", "_r").alias("_first_eta"))
    if added:     # single list: two scalar subqueries over the top-2
        two, first_eta = t.select("_two").scalar(), t.select("_first_eta").scalar()
        hit = F.array_contains(two, F.col("call_id"))
        return calls.withColumn("eta", F.when(hit, first_eta).otherwise(F.col("eta")))
    c = c.join(F.broadcast(t), keys, "left")
    hit = F.array_contains(F.col("_two"), F.col("call_id"))
    out = c.withColumn("eta", F.when(hit, F.col("_first_eta")).otherwise(F.col("eta")))
    return out.drop("_two", "_first_eta")


def wi_offline(berths: DataFrame, ids=tuple(S.MAINTENANCE_BERTHS), key: str = "berth_id") -> DataFrame:
    """WI4: the berth dimension without the berths taken offline; terminal
    pools and attribution are then recomputed from it (A9, J5)."""
    off = berths.sparkSession.createDataFrame([(i,) for i in ids], f"{key} string")
    return berths.join(F.broadcast(off), key, "left_anti")


def pooled_capacity(n_berths: int, removed: int) -> int:
    """WI4/WI7 single-pool capacity: ``max(1, n - removed)``."""
    return max(1, n_berths - removed)


def all_scenarios(calls: DataFrame, closure_start, list_by: list[str] | None = None,
                  pos: str = "pos", bounds: list[int] | None = None, tasks: int | None = None) -> DataFrame:
    """The seven scenario inputs in one table tagged ``scenario``.
    S4 changes berths, not arrivals: its rows equal the baseline and the
    caller passes a reduced capacity for it."""
    keys = list_by or []
    base = calls.withColumn("is_extra", F.lit(False))
    parts = {
        "S1_Baseline": base,
        "S2_Congestion": wi_densify(calls, keys, pos, bounds, tasks),
        "S3_WeatherClosure": wi_closure(base, closure_start),
        "S4_Maintenance": base,
        "S5_LateArrival": wi_delay(base, list_by=keys, pos=pos),
        "S6_Priority": wi_priority(base, list_by=keys, pos=pos),
        "S7_Conflict": wi_conflict(base, keys, pos),
    }
    out = None
    for name in SCENARIOS:
        df = parts[name].withColumn("scenario", F.lit(name)).select("scenario", *base.columns)
        out = df if out is None else out.unionByName(df)
    return out


def scenario_order_key(pos: str = "pos") -> Column:
    """Replay position: at equal ETA all originals (in list order) come before
    all clones (in list order), as a stable sort of the appended list does."""
    return F.col("is_extra").cast("bigint") * F.lit(2 ** 52) + F.col(pos)


__all__ = ["SCENARIOS", "with_service", "wi_baseline", "wi_densify", "wi_closure", "wi_delay",
           "wi_priority", "wi_conflict", "all_scenarios", "scenario_order_key", "MINUTE_US"]
