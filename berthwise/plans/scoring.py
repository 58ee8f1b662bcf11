"""Plan scoring and selection (A10, A11), enrichment (J12), berth accuracy.

A plan is a long table ``(plan_id, pos, call_id, berth_id, scheduled_start)``
joined to calls for ``eta`` and service.  Many plans per port are scored in
one hash aggregation; the best plan per port is an arg-max aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berthwise.functions.time import HOUR_US

H = float(HOUR_US)


def score_plans(plans: DataFrame, by: tuple[str, ...] = ("plan_id",), eta: str = "eta",
                start: str = "scheduled_start") -> DataFrame:
    """A10: total wait ``sum(max(0, start - eta))`` hours and fitness
    ``1 / (1 + total)`` per plan."""
    d = F.timestamp_diff("MICROSECOND", F.col(eta), F.col(start))
    g = plans.groupBy(*by).agg(F.sum(F.greatest(d, F.lit(0))).alias("_w"), F.count(F.lit(1)).alias("n_assigned"))
    total = F.col("_w") / F.lit(H)
    return g.select(*by, "n_assigned", total.alias("total_wait_hours"),
                    (F.lit(1.0) / (F.lit(1.0) + total)).alias("fitness"))


def best_plan(scores: DataFrame, by: tuple[str, ...] = (), plan: str = "plan_id") -> DataFrame:
    """The plan with the highest fitness per ``by`` group (ties: lowest
    plan id, i.e. the first).  One aggregate; no sort of the scores."""
    rank = F.struct(F.col("fitness"), (-F.col(plan)).alias("_neg"))
    cols = [c for c in scores.columns if c not in by]
    best = F.max_by(F.struct(*cols), rank).alias("_b")
    g = scores.groupBy(*by).agg(best) if by else scores.agg(best)
    return g.select(*by, *[F.col(f"_b.{c}").alias(c) for c in cols])


def enrich_plan(plans: DataFrame, calls: DataFrame, berths: DataFrame, service_us: str = "svc_us",
                key: str = "call_id", berth_key: tuple[str, ...] = ("berth_id",)) -> DataFrame:
    """Plan rows with call and berth attributes, ``predicted_end =
    start + service`` and ``predicted_wait_hours``; order by start when
    listing (``.orderBy('scheduled_start')``)."""
    c = calls.select(key, "name", "eta", service_us)
    b = berths.select(*berth_key, "terminal_name", "quay_length_m", "depth_m")
    j = plans.join(c, key, "inner").join(b, list(berth_key), "left")
    end = F.timestamp_add("MICROSECOND", F.col(service_us), F.col("scheduled_start"))
    d = F.timestamp_diff("MICROSECOND", F.col("eta"), F.col("scheduled_start"))
    return j.withColumns({"predicted_end": end,
                          "predicted_wait_hours": F.greatest(d, F.lit(0)) / F.lit(H)})


def berth_accuracy(plan: DataFrame, recorded: DataFrame, by: tuple[str, ...] = ("plan_id",),
                   key: str = "call_id", planned: str = "berth_id", actual: str = "recorded_berth") -> DataFrame:
    """Share of planned calls whose planned berth equals the recorded
    one (calls without a record are ignored)."""
    j = plan.join(recorded.select(key, actual), key, "inner")
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("matched"),
                              F.avg(F.col(planned).eqNullSafe(F.col(actual)).cast("double")).alias("berth_accuracy"))
