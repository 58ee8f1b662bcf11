"""Adapters: build domain tables from the generic benchmark tables.

No vessel data ships with the benchmark, so each domain table is derived
deterministically from one benchmark table (every row of it), which keeps the
work of each query proportional to the input size.  The same definitions are
restated in SQL for the DuckDB oracle (``oracle_views.py`` at the repo root).

Timestamps are truncated to whole seconds so hour values have short exact
decimal expansions on both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from berthwise import schema as S

P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
N_PORTS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one benchmark table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hours(n: Column, ts: Column) -> Column:
    return F.timestamp_add("HOUR", n, ts)


def _dmy(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy")


def _hm(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def calls_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw call log (all strings, French headers) from ``orders``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    arr = _hours(k % 24, F.col("o_orderdate"))
    brt = _hours((k * 7919) % 97 - 8, arr)
    unb = _hours((k * 31) % 800 - 20, brt)
    days = F.when(k % 37 == 0, F.lit("n/a")).otherwise(
        F.concat(((k % 40) / 8).cast("bigint").cast("string"), F.lit(","),
                 F.lpad(((k % 8) * 125).cast("string"), 3, "0")))
    vtype = (F.when(k % 5 == 0, "PORTE_CONTENEUR").when(k % 5 == 1, "VRAQUIER")
             .when(k % 5 == 2, "CARGO_GENERAL").when(k % 5 == 3, "ROULIER"))
    imp = (F.when(k % 6 == 0, "Containers").when(k % 6 == 1, "Grains").when(k % 6 == 2, "Coal")
           .when(k % 6 == 3, "nan").when(k % 6 == 4, "General Cargo"))
    exp = F.when(k % 4 == 0, "Phosphates").when(k % 4 == 1, "")
    return o.select(
        k.alias("call_id"),
        F.concat(F.lit("V"), F.col("o_custkey").cast("string")).alias(S.VESSEL_NAME),
        vtype.alias(S.VESSEL_TYPE),
        (5000 + (k * 13) % 70000).cast("string").alias(S.GROSS_TONNAGE),
        F.when(k % 17 == 0, F.lit("n/a")).otherwise((100 + (k * 3) % 200).cast("string")).alias(S.LENGTH),
        F.concat((6 + k % 8).cast("string"), F.lit("."), ((k * 7) % 10).cast("string")).alias(S.DRAFT),
        F.when(k % 50 == 0, F.lit("nan")).otherwise(_dmy(arr)).alias(S.DATE_ARRIVAL),
        _hm(arr).alias(S.TIME_ARRIVAL),
        F.when(k % 5 < 3, F.lit(None).cast("string")).otherwise(_dmy(arr)).alias(S.DATE_ANCHORAGE_IN),
        _dmy(brt).alias(S.DATE_BERTHING),
        _hm(brt).alias(S.TIME_BERTHING),
        _dmy(unb).alias(S.DATE_UNBERTHING),
        _hm(unb).alias(S.TIME_UNBERTHING),
        F.concat(F.lit(" "), (F.col("o_custkey") % 49).cast("string"), F.lit(" ")).alias(S.BERTH_ID),
        days.alias(S.STAY_QUAY_DAYS),
        imp.alias(S.CARGO_IMPORT),
        exp.alias(S.CARGO_EXPORT),
        ((k * 11) % 30000).cast("string").alias(S.TONNAGE_IMPORT),
        F.lit("0").alias(S.TONNAGE_EXPORT),
        F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise((1 + k % 4).cast("string")).alias(S.TUGS_BERTHING),
    )


def _ptype(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in P_TYPES]), (i + 1).cast("int"))


def vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed calls (one per ``part`` row) for eligibility work."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    base = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    exp = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit("nan")).otherwise(_ptype(k % 6))
    eta = F.timestamp_add("MINUTE", (k * 7919) % 3153600, base)
    return p.select(
        F.concat(F.lit("P"), (k % N_PORTS).cast("string")).alias("port_id"),
        k.alias("call_id"),
        F.concat(F.lit("VSL"), k.cast("string")).alias("name"),
        F.col("p_brand").alias("vessel_type"),
        ((k * 13) % 70000).cast("int").alias("gross_tonnage"),
        (100 + k % 250).cast("double").alias("length_m"),
        (6 + F.col("p_size") / 8.0).alias("draft_m"),
        F.col("p_type").alias("cargo_import"),
        exp.alias("cargo_export"),
        ((k * 11) % 30000).cast("double").alias("tonnage_import"),
        F.lit(0.0).alias("tonnage_export"),
        (1 + k % 4).cast("int").alias("tugs_at_berthing"),
        F.month(eta).alias("arrival_month"),
        F.weekday(eta).alias("arrival_dow"),
        eta.alias("eta"),
        (k % 10 == 0).alias("is_priority"),
        ((1 + k % 10) * 3_600_000_000).alias("svc_us"),
    )


def berths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Berth dimension (one per ``supplier`` row)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    k = F.col("s_suppkey")
    cargos = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(
        F.array(_ptype(k % 6), _ptype((k + 2) % 6)))
    first = (1 + k % 5).cast("string")
    types = F.when(k % 5 < 2, F.array().cast("array<string>")).otherwise(
        F.array(*[F.concat(F.lit("Brand#"), first, F.lit(str(d))) for d in range(1, 6)]))
    return s.select(
        F.concat(F.lit("P"), (F.col("s_nationkey") % N_PORTS).cast("string")).alias("port_id"),
        k.cast("string").alias("berth_id"),
        F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("terminal_name"),
        k.cast("int").alias("ordinal"),
        (150 + (k * 37) % 300).cast("double").alias("quay_length_m"),
        (7 + (k % 11) * 0.5).alias("depth_m"),
        cargos.alias("allowed_cargos"),
        types.alias("allowed_types"),
        F.concat(F.lit("OP"), F.col("s_nationkey").cast("string")).alias("operator"),
    )


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Berth reservations from ``orders``; overlapping on purpose."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    start = _hours(k % 24, F.col("o_orderdate"))
    return o.select(
        k.alias("call_id"),
        F.concat(F.lit("V"), F.col("o_custkey").cast("string")).alias("vessel_name"),
        (F.col("o_custkey") % 50).cast("string").alias("berth_id"),
        start.alias("start_time"),
        _hours(1 + k % 40, start).alias("end_time"),
    )


def _sec(ts: Column) -> Column:
    return F.date_trunc("second", ts).cast("timestamp_ntz")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival queue from ``events``: pool = event type, service = value/100 h."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return e.select(
        F.col("event_type").alias("pool"),
        F.col("event_id").alias("call_id"),
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("name"),
        _sec(F.col("ts")).alias("eta"),
        (F.round(F.col("value") * 36.0).cast("bigint") * 1_000_000).alias("svc_us"),
    )


def pool_capacity(spark: SparkSession) -> DataFrame:
    """Servers per pool (small fixed dimension)."""
    rows = [("click", 1), ("error", 2), ("purchase", 3), ("signup", 2), ("view", 3)]
    return spark.createDataFrame(rows, "pool string, k int")


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate allocation plans from ``events``: 20 plans, 7 berths each."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    k = F.col("event_id")
    eta = _sec(F.col("ts"))
    start = _hours(k % 13 - 2, eta)
    svc_us = F.round(F.col("value") * 36.0).cast("bigint") * 1_000_000
    return e.select(
        (k % 20).alias("plan_id"),
        k.alias("pos"),
        k.alias("call_id"),
        (F.col("user_id") % 7).cast("string").alias("berth_id"),
        eta.alias("eta"),
        start.alias("scheduled_start"),
        F.timestamp_add("MICROSECOND", svc_us, start).alias("predicted_end"),
    )


def actual_berthing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed berthing times for plan rows (absent for every 6th call)."""
    p = plans(spark, sf_dir)
    return (p.filter(F.col("call_id") % 6 != 0)
            .select("call_id", F.timestamp_add("MINUTE", (F.col("call_id") * 17) % 181 - 90,
                                               F.col("scheduled_start")).alias("actual_time")))


def ais_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AIS JSON payloads (one per event); every 11th lacks a name."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    k = F.col("event_id")
    eta_txt = F.date_format(_sec(F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss")
    name = F.when(k % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("U"), F.col("user_id").cast("string")))
    payload = F.to_json(F.struct(
        name.alias("name"), eta_txt.alias("eta"),
        (6 + (k % 80) / 10.0).alias("draft_m"),
        F.when(k % 4 == 0, F.lit("ROULIER")).alias("vessel_type")))
    return e.select(k.alias("msg_id"), _sec(F.col("ts")).alias("received_at"), payload.alias("value"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-free-slot probes (berth, instant) from ``orders``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    return o.select(k.alias("probe_id"), ((F.col("o_custkey") + 7) % 50).cast("string").alias("berth_id"),
                    _hours((k * 5) % 48, F.col("o_orderdate")).alias("t"))


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot instants: noon of every order date."""
    o = table(spark, sf_dir, "orders").select("o_orderdate")
    return o.select(_hours(F.lit(12), F.col("o_orderdate")).alias("t")).distinct()


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed berth windows to test for availability, from ``orders``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    s = _hours((k * 3) % 24, F.col("o_orderdate"))
    return o.select(k.alias("call_id"), ((F.col("o_custkey") + 1) % 50).cast("string").alias("berth_id"),
                    s.alias("prop_start"), _hours(1 + k % 12, s).alias("prop_end"))


def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Berth events from ``orders``: every reservation is asked for, some are released, berths go offline; some windows come too
    late or lack an end, some kinds are unknown."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    start = _hours(k % 24, F.col("o_orderdate"))
    end = _hours(1 + k % 40, start)
    asked = F.when(k % 101 == 0, _hours(F.lit(960), end)).otherwise(_hours(-(k % 72), start))

    def event(i: int, kind, t: Column, call: Column, s: Column, e: Column) -> Column:
        return F.struct((4 * k + i).cast("bigint").alias("seq"), t.cast("timestamp_ntz").alias("event_time"), kind.alias("kind"),
                        call.cast("bigint").alias("call_id"), s.cast("timestamp_ntz").alias("start_time"), e.cast("timestamp_ntz").alias("end_time"))
    no = F.lit(None)
    ev = F.array(event(0, F.when(k % 97 == 0, F.lit("moved")).otherwise(F.lit("assign")), asked, k, start, F.when(k % 89 != 0, end)),
                 event(1, F.lit("offline"), _hours(-(k % 10), start), no, _hours(F.lit(1), end), _hours(F.lit(5), end)),
                 event(2, F.lit("release"), _hours(k % 30, asked), k, no, no))
    wanted = F.filter(ev, lambda x: (F.pmod(x["seq"], F.lit(4)) == 0) | ((x["kind"] == "offline") & (k % 13 == 0))
                      | ((x["kind"] == "release") & (k % 3 == 0)))
    return o.select((F.col("o_custkey") % 50).cast("string").alias("berth_id"), F.inline(wanted))


def long_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations of a minute to a year, a few of thirty years, over 3000 berths, from ``orders``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    start = F.timestamp_add("MINUTE", k % 1440, F.col("o_orderdate"))
    minutes = F.when(k % 997 == 0, F.lit(15768000)).otherwise(F.expr("shiftleft(1, cast(o_orderkey % 20 as int))") + k % 7)
    return o.select(k.alias("call_id"), (k % 3000).cast("string").alias("berth_id"), start.alias("start_time"),
                    F.timestamp_add("MINUTE", minutes, start).alias("end_time"))


def upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in which the plans' berths are taken already, from every 37th of ``events``; they may overlap."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id").filter(F.col("event_id") % 37 == 0)
    k = F.col("event_id")
    start = _hours(k % 5, _sec(F.col("ts")))
    return e.select(k.alias("call_id"), (F.col("user_id") % 7).cast("string").alias("berth_id"), start.alias("start_time"),
                    _hours(1 + k % 6, start).alias("end_time"))
