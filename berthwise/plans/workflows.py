"""Composed user-level pipelines.

Each returns DataFrames (lazy) except where a model or a written table is the
product.  Inputs used by several branches of a plan are materialised once in
the shared checkpoint folder (``cut_lineage``) rather than recomputed per
branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berthwise import schema as S
from berthwise.functions.time import from_us, to_us
from berthwise.operators import berths as BR
from berthwise.operators import cleaning as CL
from berthwise.operators import dominance as DM
from berthwise.operators import eligibility as EL
from berthwise.operators import intervals as IV
from berthwise.operators import kpi as KP
from berthwise.operators import ml as ML
from berthwise.operators import replay as RP
from berthwise.operators import scenarios as SC
from berthwise.operators import vessels as VS
from berthwise.operators.scan import ROWS_PER_BLOCK, ROWS_PER_TASK, block_bounds, in_blocks, running, shares
from berthwise.plans import dispatch as DP
from berthwise.plans import repair as RPR
from berthwise.session import cut_lineage


def clean(raw: DataFrame) -> DataFrame:
    """Raw call log -> cleaned calls."""
    return CL.clean_calls(raw)


def train_service_model(raw: DataFrame, model_path: str | None, now, production: bool = False, **gbt_args):
    """Clean -> typed calls -> time split -> fit -> metrics -> save.
    Returns ``(model, metrics)``."""
    c = CL.clean_calls(raw)
    frame = VS.to_calls(c, now, call_id="call_id", keep=(CL.S.SERVICE_HOURS, CL.S.ARRIVAL_DT))
    model, metrics = ML.train(frame, production=production, **gbt_args)
    if model_path:
        ML.save_model(model, model_path)
    return model, metrics


def allocate(queue: DataFrame, berths: DataFrame, reservations: DataFrame, model=None) -> dict[str, DataFrame]:
    """Predict service (M8) -> eligibility (J3) -> drop infeasible (F6) -> propose each call's earliest slot over its
    eligible berths (J11) -> test the window against the reservations (J9) -> first come wins among the proposals of a
    berth, in ``(eta, pos)`` order (Q5) -> enrich (J12).

    Every feasible call has one row: its proposal and whether it is accepted.  Refused are proposals that run into a
    reservation (J8 doesn't test the length) or into an accepted proposal, and calls without an ETA or a service
    time of zero or more.  To place refused calls, propose again with the accepted ones among the reservations.

    ``queue``: typed calls with ``port_id``, ``call_id``, ``eta``; ``reservations`` carry ``port_id``: call and
    berth ids may repeat across ports.  Returns ``plan``, ``accepted``, ``rejected``, ``infeasible``."""
    q = queue
    if model is not None:
        q = ML.score(model, q).withColumn(
            "svc_us", F.round(F.col("predicted_service_hours") * F.lit(3.6e9)).cast("bigint"))
    elif "svc_us" not in q.columns:
        q = SC.with_service(q, None)
    if "pos" not in q.columns:
        q = q.withColumn("pos", F.col("call_id"))
    elig = cut_lineage(DM.best_eligible(q, berths, {"_low": "min"}).select("port_id", "call_id"))
    infeasible = EL.infeasible_calls(q, elig)
    feasible = cut_lineage(EL.feasible_calls(q, elig).select("port_id", "call_id", "eta", "svc_us", "pos"))
    usable = F.col("eta").isNotNull() & F.coalesce(F.col("svc_us") >= 0, F.lit(False))
    taken = reservations.withColumn("_berth", DP.berth_key())
    slots = DP.earliest_eligible(q, berths, IV.merge_busy(taken, key="_berth"), feasible.filter(usable), key="_berth")
    asked = slots.join(feasible, ["port_id", "call_id"]).withColumns({
        "_berth": DP.berth_key(), "_call": F.struct("port_id", "call_id"), "_turn": F.struct("eta", "pos", "call_id"),
        "predicted_end": from_us(to_us("scheduled_start") + F.col("svc_us"))})
    free = cut_lineage(IV.is_available(taken, asked, key="_berth", pid="_call", p_start="scheduled_start", p_end="predicted_end"))
    won = RPR.admit(free.filter("available"), key="_berth", order="_turn", start="scheduled_start", end="predicted_end")
    cols = ["port_id", "call_id", "berth_id", "scheduled_start", "predicted_end", "accepted"]
    no = F.lit(False).alias("accepted")
    done = won.select(*cols).unionByName(free.filter(~F.col("available")).select(*cols[:-1], no)).unionByName(
        feasible.filter(~usable).select("port_id", "call_id", no), allowMissingColumns=True)
    names = [c for c in ("name", "eta", "svc_us") if c in q.columns]
    terminal = berths.select("port_id", "berth_id", "terminal_name")
    plan = (done.join(q.select("port_id", "call_id", *names), ["port_id", "call_id"])
            .join(terminal, ["port_id", "berth_id"], "left"))
    return {"plan": plan, "accepted": plan.filter("accepted"), "rejected": plan.filter(~F.col("accepted")),
            "infeasible": infeasible}


def compare_scenarios(calls: DataFrame, capacity: DataFrame, closure_start, pool_cols=("pool",),
                      list_by: list[str] | None = None) -> dict[str, DataFrame]:
    """C4: seven what-if inputs (U1) -> queues at the pools' berths, taken in turn (W4), over all
    of them -> scenario KPIs (A6) -> comparison table (A5).

    ``capacity``: (scenario, pool..., k).  The calls are checkpointed, the scenarios are not: they are eight times the
    calls, and the replay shuffles them once."""
    calls = cut_lineage(calls)          # read by all seven scenario branches
    rows = calls.count()
    # the scenarios lie in time much as the calls do
    bounds = block_bounds(calls.select(to_us("eta").alias("_a")), "_a", shares(calls, rows, ROWS_PER_BLOCK))
    allsc = SC.all_scenarios(calls, closure_start, list_by, bounds=bounds, tasks=shares(calls, rows, ROWS_PER_TASK))
    allsc = allsc.withColumn("pos", SC.scenario_order_key())
    part = ["scenario", *pool_cols]
    rep = RP.fifo_replay(allsc, part, capacity, horizon_by=["scenario"], bounds=bounds,
                         tasks=shares(calls, (len(SC.SCENARIOS) + 1) * rows, ROWS_PER_TASK))
    total = capacity.groupBy("scenario").agg(F.sum("k").alias("capacity"))
    kpis = RP.scenario_kpis(rep, total)
    return {"replay": rep, "kpis": kpis, "table": RP.scenario_table(kpis)}


def compare_fleet(calls: DataFrame, berths: DataFrame, service: DataFrame | None, closure_start,
                  offline: tuple[str, ...] = tuple(S.MAINTENANCE_BERTHS)) -> dict[str, DataFrame]:
    """C4 from the domain tables: eligibility (J3) -> each call's first terminal (J5), once with all berths and once without
    the ``offline`` ones for maintenance -> service times looked up, 12 h where unknown (J16) -> seven what-if inputs (U1) ->
    queues at each terminal's berths (A9, W4) -> KPIs (A6) and comparison table (A5).  Calls without an eligible berth don't queue.

    ``calls``: typed calls with ``port_id``, ``call_id``, ``eta``, ``pos``; ``service``: (call_id, service_hours)."""
    left = SC.wi_offline(berths, offline)
    pool = ["port_id", "terminal_name"]
    repair = F.lit("S4_Maintenance")
    at = DM.first_terminal(calls, berths).withColumn("_s4", F.lit(False)).unionByName(
        DM.first_terminal(calls, left.filter("berth_id is not null")).withColumn("_s4", F.lit(True)))
    arrivals = cut_lineage(SC.with_service(calls.select("port_id", "call_id", "name", "eta", "pos"), service))
    every = SC.all_scenarios(arrivals, closure_start).withColumn("pos", SC.scenario_order_key())
    every = cut_lineage(every.withColumn("_s4", F.col("scenario") == repair).join(at, ["port_id", "call_id", "_s4"]).drop("_s4"))
    sizes = [BR.terminal_capacity(b).select(*pool, F.col("n_berths").cast("int").alias("k")) for b in (berths, left)]
    names = F.explode(F.array(*[F.lit(n) for n in SC.SCENARIOS])).alias("scenario")
    capacity = (sizes[0].select(names, "*").filter(F.col("scenario") != repair)
                .unionByName(sizes[1].withColumn("scenario", repair)))
    rep = RP.fifo_replay(every, ["scenario", *pool], capacity, horizon_by=["scenario"])
    kpis = RP.scenario_kpis(rep, capacity.groupBy("scenario").agg(F.sum("k").alias("capacity")))
    return {"replay": rep, "kpis": kpis, "table": RP.scenario_table(kpis)}


def kpi_report(plan: DataFrame, metrics: DataFrame | None = None, scenario_table: DataFrame | None = None,
               by: str = "plan_id") -> DataFrame:
    """One long report table ``(section, key, metric, value)`` combining
    the schedule KPIs (A2, displayed per P17), model metrics (A7) and the
    scenario comparison (A5)."""
    k = KP.format_kpis(KP.schedule_kpis(plan, by))
    parts = [_long(k, "schedule", by)]
    if metrics is not None:
        parts.append(_long(metrics.withColumn("_k", F.lit("model")), "model", "_k"))
    if scenario_table is not None:
        parts.append(_long(scenario_table, "scenarios", "scenario"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _long(df: DataFrame, section: str, key: str) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    st = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))])
    return df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"),
                     st.alias("metric", "value"))


def waiting_at(calls: DataFrame, instants: DataFrame, t: str = "t", arrival: str = S.ARRIVAL_DT, berthing: str = S.BERTHING_DT,
               key: str = "call_id") -> DataFrame:
    """Calls that have arrived at an instant and have no berth yet, ranked by arrival: (t, key, rank, waited_hours)."""
    c = calls.select(key, to_us(arrival).alias("_a"), to_us(berthing).alias("_b")).filter("_a < _b")
    cells = IV.in_cells(c, "_a", "_b")
    i = IV.at_levels(instants.select(t, to_us(t).alias("_t")).distinct(), "_t", IV.levels_of(cells))
    on = cells.join(i, IV.CELL).filter("_a <= _t and _t < _b").select(t, "_t", key, "_a", F.lit(1).cast("bigint").alias("_one"))
    on = running(in_blocks(on, "_a"), [t], "_bkt", ["_a", key], "_one", "rank", "sum")
    return on.select(t, key, "rank", ((F.col("_t") - F.col("_a")) / F.lit(3.6e9)).alias("waited_hours"))


def port_boards(reservations: DataFrame, calls: DataFrame, berths: DataFrame, instants: DataFrame, step_hours: float = 1.0) -> DataFrame:
    """C6 over many instants, as one long table ``(output, t, key, value)``: snapshot (A8: occupied, free and waiting counts,
    utilization), ranked queue (W1), progress of the slots in use (P14) and occupancy trend (TS2).

    Berths are those of the dimension; reservations of others (J15) are left out."""
    known = reservations.join(berths.select("berth_id").distinct(), "berth_id", "left_semi")
    occ = cut_lineage(IV.occupancy_at(known, instants))
    queue = cut_lineage(waiting_at(calls, instants))
    snap = IV.port_snapshot(berths, occ, instants, queue_len=queue.groupBy("t").agg(F.count("*").alias("queue_length")))
    value = lambda c: F.col(c).cast("double").alias("value")
    counts = ["occupied_count", "free_count", "queue_length", "utilization"]
    out = snap.select("t", F.stack(F.lit(len(counts)), *[x for c in counts for x in (F.lit(c), F.col(c).cast("double"))]).alias("key", "value"))
    out = out.select(F.lit("snapshot").alias("output"), "t", "key", "value")
    out = out.unionByName(queue.select(F.lit("queue").alias("output"), "t", F.col("call_id").cast("string").alias("key"), value("rank")))
    progress = IV.slot_progress(occ, F.col("t"))
    out = out.unionByName(progress.select(F.lit("progress").alias("output"), "t", F.col("berth_id").alias("key"), value("progress_pct")))
    trend = KP.occupancy_series(IV.merge_busy(known, gap_seconds=0), berths.select("berth_id").distinct().count(), step_hours)
    return out.unionByName(trend.select(F.lit("occupancy").alias("output"), F.col("timestamp").alias("t"), F.lit("occupied").alias("key"), value("occupied")))


def port_board(reservations: DataFrame, queue: DataFrame, berths: DataFrame, t, step_hours: float = 1.0
               ) -> dict[str, DataFrame]:
    """The data behind a port board at instant ``t``: snapshot (A8),
    ranked queue (W1/P16), slot progress (P14) and occupancy trend (TS2)."""
    inst = queue.sparkSession.createDataFrame([(t,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    occ = IV.occupancy_at(reservations, inst)
    snap = IV.port_snapshot(berths.select("berth_id"), occ, inst)
    active = reservations.filter((F.col("start_time") <= F.lit(t).cast("timestamp_ntz"))
                                 & (F.col("end_time") > F.lit(t).cast("timestamp_ntz")))
    n = berths.select("berth_id").distinct().count()
    trend = KP.occupancy_series(IV.merge_busy(reservations, gap_seconds=0), n, step_hours)
    return {"snapshot": snap, "queue": KP.queue_board(queue, t), "progress": IV.slot_progress(active, t),
            "occupancy": trend}
