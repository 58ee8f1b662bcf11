"""Typed calls from cleaned rows or live payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from berthwise import schema as S
from berthwise.functions.scalar import num_or


def _str_or(c: str, default: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit(default))


def to_calls(df: DataFrame, now, port_id: str | Column = "P0", call_id: str = "call_id",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Shape cleaned call-log rows into the typed call schema.

    Per-field fallbacks apply when a value is NULL or not numeric; integer
    fields truncate toward zero.  ``now`` (a timestamp literal or Column) is an
    explicit argument so results are reproducible: it stands in for a missing
    ETA, month or weekday.  Columns named in ``keep`` pass through.
    """
    now_c = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    pid = port_id if isinstance(port_id, Column) else F.lit(port_id)
    cols = set(df.columns)

    def opt(c):
        return F.col(c) if c in cols else F.lit(None).cast("string")

    return df.select(
        pid.alias("port_id"),
        F.col(call_id).cast("bigint").alias("call_id"),
        opt(S.VESSEL_NAME).cast("string").alias("name"),
        F.coalesce(F.trim(opt(S.VESSEL_TYPE)), F.lit(S.FALLBACK_TYPE)).alias("vessel_type"),
        num_or(opt(S.GROSS_TONNAGE), S.FALLBACK_GROSS).cast("int").alias("gross_tonnage"),
        num_or(opt(S.LENGTH), S.FALLBACK_LENGTH_M).alias("length_m"),
        num_or(opt(S.DRAFT), S.FALLBACK_DRAFT_M).alias("draft_m"),
        F.coalesce(F.trim(opt(S.CARGO_IMPORT)), F.lit(S.FALLBACK_CARGO_IMPORT)).alias("cargo_import"),
        F.coalesce(F.trim(opt(S.CARGO_EXPORT)), F.lit(S.FALLBACK_CARGO_EXPORT)).alias("cargo_export"),
        num_or(opt(S.TONNAGE_IMPORT), S.FALLBACK_TONNAGE).alias("tonnage_import"),
        num_or(opt(S.TONNAGE_EXPORT), S.FALLBACK_TONNAGE).alias("tonnage_export"),
        num_or(opt(S.TUGS_BERTHING), S.FALLBACK_TUGS).cast("int").alias("tugs_at_berthing"),
        F.coalesce(opt(S.ARRIVAL_MONTH).cast("int"), F.month(now_c)).alias("arrival_month"),
        F.coalesce(opt(S.ARRIVAL_DOW).cast("int"), F.weekday(now_c)).alias("arrival_dow"),
        F.coalesce(opt(S.ARRIVAL_DT).cast("timestamp_ntz"), now_c).alias("eta"),
        F.lit(False).alias("is_priority"),
        *keep,
    )


AIS_SCHEMA = ("name string, vessel_type string, gross_tonnage string, length_m string, draft_m string, "
              "cargo_import string, cargo_export string, tonnage_import string, tonnage_export string, "
              "tugs_at_berthing string, eta string")


def ais_to_calls(msgs: DataFrame, now, value_col: str = "value", port_id: str = "P0",
                 id_col: str = "msg_id") -> tuple[DataFrame, DataFrame]:
    """AIS JSON payloads -> (typed calls, rejected rows).

    ``eta`` is ISO-8601 text (missing -> ``now``); month and weekday derive
    from it.  A payload without ``name`` or that is not JSON is rejected with a
    reason instead of failing the batch.
    """
    now_c = F.lit(now).cast("timestamp_ntz")
    p = msgs.withColumn("_p", F.from_json(F.col(value_col), AIS_SCHEMA))
    eta = F.coalesce(F.try_to_timestamp(F.col("_p.eta"), F.lit("yyyy-MM-dd['T'][' ']HH:mm[:ss][.SSSSSS]"))
                     .cast("timestamp_ntz"),
                     F.when(F.col("_p.eta").isNull(), now_c))
    ok_cond = F.col("_p.name").isNotNull() & eta.isNotNull()
    calls = p.filter(ok_cond).select(
        F.lit(port_id).alias("port_id"),
        F.col(id_col).cast("bigint").alias("call_id"),
        F.col("_p.name").alias("name"),
        F.coalesce(F.col("_p.vessel_type"), F.lit(S.FALLBACK_TYPE)).alias("vessel_type"),
        num_or(F.col("_p.gross_tonnage"), S.FALLBACK_GROSS).cast("int").alias("gross_tonnage"),
        num_or(F.col("_p.length_m"), S.FALLBACK_LENGTH_M).alias("length_m"),
        num_or(F.col("_p.draft_m"), S.FALLBACK_DRAFT_M).alias("draft_m"),
        F.coalesce(F.col("_p.cargo_import"), F.lit(S.FALLBACK_CARGO_IMPORT)).alias("cargo_import"),
        F.coalesce(F.col("_p.cargo_export"), F.lit(S.FALLBACK_CARGO_EXPORT)).alias("cargo_export"),
        num_or(F.col("_p.tonnage_import"), S.FALLBACK_TONNAGE).alias("tonnage_import"),
        num_or(F.col("_p.tonnage_export"), S.FALLBACK_TONNAGE).alias("tonnage_export"),
        num_or(F.col("_p.tugs_at_berthing"), S.FALLBACK_TUGS).cast("int").alias("tugs_at_berthing"),
        F.month(eta).alias("arrival_month"),
        F.weekday(eta).alias("arrival_dow"),
        eta.alias("eta"),
        F.lit(False).alias("is_priority"),
    )
    reason = (F.when(F.col("_p").isNull(), F.lit("not json"))
              .when(F.col("_p.name").isNull(), F.lit("missing name"))
              .otherwise(F.lit("bad eta")))
    rejects = p.filter(~F.coalesce(ok_cond, F.lit(False))).select(
        F.col(id_col).alias(id_col), F.col(value_col).alias("payload"), reason.alias("reason"))
    return calls, rejects


def build_queue(calls: DataFrame, n: int | None = None, order=("eta", "call_id")) -> DataFrame:
    """L1: calls in arrival order, optionally only the first ``n``.

    With ``n`` this plans as ``TakeOrderedAndProject`` (per-task top-n, then a
    merge of n rows per task): no full sort of the input.
    """
    q = calls.orderBy(*order)
    return q.limit(n) if n is not None else q


def profiles_table(spark: SparkSession, profiles=None) -> DataFrame:
    """Vessel profile rules as a small dimension (one row per profile)."""
    rows = [(t, i, e, lr[0], lr[1], dr[0], dr[1], gr[0], gr[1], tr[0], tr[1])
            for t, i, e, lr, dr, gr, tr in (profiles or S.VESSEL_PROFILES)]
    return spark.createDataFrame(rows, (
        "p_type string, p_import string, p_export string, len_lo double, len_hi double, "
        "draft_lo double, draft_hi double, gross_lo int, gross_hi int, tugs_lo int, tugs_hi int"))


def check_profiles(calls: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Per call, the profile rules it breaks (empty array = conforming).

    The profile is matched on (type, import cargo, export cargo) with missing
    cargo read as ""; the draft range is clamped to the port's 7-14 m limits.
    Profiles are a fixed rule set of a few rows, so the broadcast is bounded.
    """
    profiles = profiles if profiles is not None else profiles_table(calls.sparkSession)
    imp = F.coalesce(F.trim("cargo_import"), F.lit(""))
    exp = F.coalesce(F.trim("cargo_export"), F.lit(""))
    c = calls.withColumns({"_imp": imp, "_exp": exp})
    p = F.broadcast(profiles)
    j = c.join(p, (c.vessel_type == p.p_type) & (c._imp == p.p_import) & (c._exp == p.p_export), "left")
    dlo = F.greatest("draft_lo", F.lit(S.PORT_MIN_DRAFT_M))
    dhi = F.least("draft_hi", F.lit(S.PORT_MAX_DRAFT_M))
    found = F.col("p_type").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(~found, F.lit("profile")),
        F.when(found & ~F.col("length_m").between(F.col("len_lo"), F.col("len_hi")), F.lit("length")),
        F.when(found & ~F.col("draft_m").between(dlo, dhi), F.lit("draft")),
        F.when(found & ~F.col("gross_tonnage").between(F.col("gross_lo"), F.col("gross_hi")), F.lit("tonnage")),
        F.when(found & ~F.col("tugs_at_berthing").between(F.col("tugs_lo"), F.col("tugs_hi")), F.lit("tugs")),
    ))
    return j.select(*calls.columns, reasons.alias("violations"))


def cargo_options(calls: DataFrame, by: str = "vessel_type") -> DataFrame:
    """Distinct non-empty import / export cargos per vessel type;
    ``["General Cargo"]`` / ``[""]`` when a type has none."""
    imp = F.array_sort(F.array_except(F.collect_set(F.trim("cargo_import")), F.array(F.lit(""))))
    exp = F.array_sort(F.array_except(F.collect_set(F.trim("cargo_export")), F.array(F.lit(""))))
    g = calls.groupBy(by).agg(imp.alias("imports"), exp.alias("exports"))
    return g.select(
        by,
        F.when(F.size("imports") == 0, F.array(F.lit(S.FALLBACK_CARGO_IMPORT))).otherwise(F.col("imports")).alias("imports"),
        F.when(F.size("exports") == 0, F.array(F.lit(""))).otherwise(F.col("exports")).alias("exports"),
    )
