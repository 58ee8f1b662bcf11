"""Berth dimension from the nested port document.

The document is one row per port; everything here is explode / join / agg on
that row, so the work is proportional to the number of berths, and the
result is a small dimension keyed by ``(port_id, berth_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berthwise import schema as S
from berthwise.functions.scalar import leading_number


def range_table(spark: SparkSession, ranges=None) -> DataFrame:
    """Range keys of ``berths_details`` and their member ids + fallback specs."""
    rows = [(k, ids, q, d, n) for k, ids, q, d, n in (ranges or S.BERTH_RANGES)]
    return spark.createDataFrame(
        rows, "range_key string, member_ids array<string>, range_quay double, range_depth double, range_name string")


def fallback_specs(spark: SparkSession, specs=None) -> DataFrame:
    rows = list(specs or S.BERTH_FALLBACK_SPECS)
    return spark.createDataFrame(rows, "berth_id string, fb_quay double, fb_depth double")


def terminal_by_berth(doc: DataFrame) -> DataFrame:
    """Reverse index ``(port_id, berth_id) -> terminal``; when a berth is
    listed by two terminals the later terminal wins."""
    t = doc.select("port_id", F.posexplode("terminals").alias("tpos", "t"))
    b = t.select("port_id", "tpos", "t", F.explode("t.berths").alias("berth_id"))
    b = b.withColumn("berth_id", F.trim(F.col("berth_id")))
    return (b.groupBy("port_id", "berth_id")
            .agg(F.max_by("t", "tpos").alias("t"))
            .select("port_id", "berth_id",
                    F.col("t.name").alias("t_name"),
                    F.col("t.operator").alias("t_operator"),
                    F.col("t.specifications").alias("t_specs")))


def build_berths(doc: DataFrame, ranges: DataFrame | None = None,
                 fallbacks: DataFrame | None = None) -> DataFrame:
    """One row per berth with quay length, depth, allowed cargos/types,
    terminal, operator and ``ordinal`` (document order, used for ties).

    Resolution rules:
    * a ``berths_details`` key that is a range key expands to its members;
      a member takes its terminal's specs when the terminal lists it (even if
      those specs are empty), else the range's own specs and name;
    * any other key takes its terminal's specs when non-empty, else the
      individual fallback specs, else none (length and depth 0);
    * operator NULL or empty -> ``UNKNOWN``; no terminal -> name ``UNKNOWN``
      (range members: the range's name);
    * ``depth_m`` text keeps its leading number (``"9 to 10"`` -> 9).
    """
    spark = doc.sparkSession
    ranges = ranges if ranges is not None else range_table(spark)
    fallbacks = fallbacks if fallbacks is not None else fallback_specs(spark)

    entries = doc.select("port_id", F.posexplode(F.map_entries("berths_details")).alias("pos", "e"))
    entries = entries.select("port_id", "pos", F.trim(F.col("e.key")).alias("key"), F.col("e.value").alias("detail"))

    # The range table is a fixed handful of literals: broadcast is size-bounded.
    with_range = entries.join(F.broadcast(ranges), entries.key == ranges.range_key, "left")
    members = with_range.select(
        "port_id", "pos", "detail", "range_key", "range_quay", "range_depth", "range_name",
        F.posexplode(F.coalesce(F.col("member_ids"), F.array(F.col("key")))).alias("mpos", "berth_id"))

    idx = terminal_by_berth(doc)
    j = (members.join(idx, ["port_id", "berth_id"], "left")
         .join(F.broadcast(fallbacks), "berth_id", "left"))

    is_range = F.col("range_key").isNotNull()
    known = F.col("t_specs").isNotNull()   # terminal lists the berth and has a specs object
    has_specs = F.coalesce(F.size("t_specs") > 0, F.lit(False))
    quay_txt = F.col("t_specs").getItem("quay_length_m")
    depth_txt = F.col("t_specs").getItem("depth_m")
    quay = (F.when(is_range & known, leading_number(quay_txt))
            .when(is_range, F.col("range_quay"))
            .when(has_specs, leading_number(quay_txt))
            .otherwise(F.coalesce(F.col("fb_quay"), F.lit(0.0))))
    depth = (F.when(is_range & known, leading_number(depth_txt))
             .when(is_range, F.col("range_depth"))
             .when(has_specs, leading_number(depth_txt))
             .otherwise(F.coalesce(F.col("fb_depth"), F.lit(0.0))))
    name = F.coalesce(F.col("t_name"), F.when(is_range, F.col("range_name")), F.lit("UNKNOWN"))
    operator = F.coalesce(F.nullif(F.col("t_operator"), F.lit("")), F.lit("UNKNOWN"))

    def _set(c):
        return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))))

    rows = j.select(
        "port_id", "berth_id", "pos", "mpos",
        F.struct(name.alias("terminal_name"), quay.alias("quay_length_m"), depth.alias("depth_m"),
                 _set(F.col("detail.cargo_types")).alias("allowed_cargos"),
                 _set(F.col("detail.vessel_types")).alias("allowed_types"),
                 operator.alias("operator")).alias("v"))
    # a berth named twice keeps its first position and its last definition
    order = F.struct("pos", "mpos")
    dedup = (rows.groupBy("port_id", "berth_id")
             .agg(F.min(order).alias("first"), F.max_by("v", order).alias("v")))
    ordinal = F.dense_rank().over(Window.partitionBy("port_id").orderBy("first"))
    return dedup.select(
        "port_id", "berth_id", F.col("v.terminal_name").alias("terminal_name"),
        (ordinal - 1).cast("int").alias("ordinal"),
        F.col("v.quay_length_m").alias("quay_length_m"), F.col("v.depth_m").alias("depth_m"),
        F.col("v.allowed_cargos").alias("allowed_cargos"), F.col("v.allowed_types").alias("allowed_types"),
        F.col("v.operator").alias("operator"))


def terminal_capacity(berths: DataFrame, by: tuple[str, ...] = ("port_id", "terminal_name")) -> DataFrame:
    """Berths per terminal — pool size and sorted member ids."""
    return (berths.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_berths"),
                 F.min("ordinal").alias("first_ordinal"),
                 F.array_sort(F.collect_list("berth_id")).alias("berth_ids")))
