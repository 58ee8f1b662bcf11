"""Interval analytics over berth reservations (half-open ``[start, end)``).

Range joins are equi-joins on dyadic cells: an interval, of minutes or of decades, lies in one or two cells of the
first level whose cells are no shorter than it, an instant in one cell of each level in use, and the exact predicate
runs on what meets in a cell.  An interval of a cell spans a good part of it, so few candidates miss, and
no interval becomes more than two rows.  Disjoint islands need no cells: the last one that starts before an instant is a
running maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berthwise import schema as S
from berthwise.functions.scalar import overlaps
from berthwise.functions.time import MINUTE_US, from_us, to_us
from berthwise.operators.scan import block_bounds, in_blocks, running

GAP_US = S.NEXT_SLOT_GAP_SECONDS * 1_000_000


def _us(df: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    return df.withColumns({"_s": to_us(start), "_e": to_us(end)})


# Cells of 2^32 µs (72 minutes) and, level by level, four times as long.
FIRST_LEVEL, LEVEL_STEP, LAST_LEVEL = 32, 2, 62


def in_cells(df: DataFrame, lo: str, hi: str, finer: int = 0) -> DataFrame:
    """Rows of ``df`` with the cells of [lo, hi): ``_level``, and ``_cell`` of its first and of its last instant (one row
    if they are the same).  An empty interval lies where its start does.  With ``finer`` an interval lies in all its cells of
    2^``finer`` times less length, at most 2^``finer`` + 1, and fewer of what meets there miss it."""
    last = F.greatest(F.col(hi) - 1, F.col(lo))
    bits = F.length(F.bin(last - F.col(lo)))                       # 2^bits is more than the length less one
    steps = F.ceil((bits - FIRST_LEVEL) / LEVEL_STEP)
    level = F.least(F.lit(FIRST_LEVEL) + F.greatest(steps, F.lit(0)) * LEVEL_STEP, F.lit(LAST_LEVEL)).cast("int")
    d = df.withColumn("_level", level - finer).withColumn("_last", last)
    ends = F.expr(f"shiftright(`{lo}`, _level)"), F.expr("shiftright(_last, _level)")
    cells = F.sequence(*ends) if finer else F.array_distinct(F.array(*ends))
    return d.withColumn("_cell", F.explode(cells)).drop("_last")


def levels_of(cells: DataFrame) -> list[int]:
    """The levels in use: at most 16 numbers."""
    return sorted(r[0] for r in cells.select("_level").where("_level is not null").distinct().collect())


def at_levels(df: DataFrame, t: str, levels: list[int]) -> DataFrame:
    """Rows of ``df`` once for each of ``levels``, with the cell that ``t`` lies in."""
    here = F.array(*[F.struct(F.lit(n).alias("_level"), F.shiftright(F.col(t), n).alias("_cell")) for n in levels])
    if not levels:
        here = F.array().cast("array<struct<_level:int,_cell:bigint>>")
    return df.select("*", F.inline(here))


CELL = ["_level", "_cell"]


# ---------------------------------------------------------------------------
# W3 gaps-and-islands
# ---------------------------------------------------------------------------

def merge_busy(res: DataFrame, gap_seconds: int = S.NEXT_SLOT_GAP_SECONDS, key: str = "berth_id",
               start: str = "start_time", end: str = "end_time", tie: str = "call_id") -> DataFrame:
    """Merge a berth's reservations into busy islands: a reservation joins
    the current island when it starts no later than the running maximum end
    of the earlier reservations plus ``gap``.  Returns ``(key, island_start,
    island_end, n_reservations)``.

    One shuffle of the reservations, two-level: inside a (berth, block) group
    the local running max end ``lm`` and the local island candidates (start >
    lm + gap); one row per bucket carries ``Cb`` (max end of earlier buckets)
    and the last island start of earlier buckets.  Since starts ascend, the
    rows clearing ``Cb + gap`` are a suffix, so a bucket's last island start is
    its last candidate when that clears ``Cb + gap``."""
    gap = gap_seconds * 1_000_000
    unb = Window.unboundedPreceding
    r = in_blocks(_us(res.select(key, start, end, tie), start, end), "_s")
    w = Window.partitionBy(key, "_bkt").orderBy("_s", "_e", tie)
    r = r.withColumn("_lm", F.max("_e").over(w.rowsBetween(unb, -1)))
    cand = F.col("_lm").isNull() | (F.col("_s") > F.col("_lm") + F.lit(gap))
    b = r.groupBy(key, "_bkt").agg(F.max("_e").alias("_E"), F.max(F.when(cand, F.col("_s"))).alias("_L"))
    wb = Window.partitionBy(key).orderBy("_bkt").rowsBetween(unb, -1)
    b = b.withColumn("_Cb", F.max("_E").over(wb))
    opens = F.col("_Cb").isNull() | (F.col("_L") > F.col("_Cb") + F.lit(gap))
    b = b.withColumn("_last_start", F.max(F.when(opens, F.col("_L"))).over(wb))
    r = r.join(b.select(key, "_bkt", "_Cb", "_last_start"), [key, "_bkt"], "inner")
    prev = F.greatest(F.col("_Cb"), F.col("_lm"))
    new = prev.isNull() | (F.col("_s") > prev + F.lit(gap))
    r = r.withColumn("_new_s", F.when(new, F.col("_s")))
    # Of rows that come twice the first opened the island: they must not change places when sorted anew.
    w = w.orderBy("_s", "_e", tie, "_lm")
    r = r.withColumn("_island", F.greatest(F.max("_new_s").over(w.rowsBetween(unb, 0)), F.col("_last_start")))
    isl = r.groupBy(key, "_island").agg(F.min("_s").alias("_is"), F.max("_e").alias("_ie"),
                                        F.count(F.lit(1)).alias("n_reservations"))
    return isl.select(key, from_us("_is").alias("island_start"), from_us("_ie").alias("island_end"),
                      "n_reservations")


# ---------------------------------------------------------------------------
# J10 conflicts
# ---------------------------------------------------------------------------

def conflict_flags(res: DataFrame, key: str = "berth_id", start: str = "start_time",
                   end: str = "end_time", tie: str = "call_id") -> DataFrame:
    """J10 (cheap): flag reservations that start before the running maximum
    end of the earlier-ordered reservations on the same berth."""
    r = in_blocks(_us(res, start, end), "_s")
    r = running(r, [key], "_bkt", ["_s", "_e", tie], "_e", "_prev_max", "max", inclusive=False)
    flag = F.coalesce(F.col("_s") < F.col("_prev_max"), F.lit(False))
    return r.withColumn("overlaps_earlier", flag).drop("_s", "_e", "_bkt", "_prev_max")


def find_conflicts(res: DataFrame, key: str = "berth_id", start: str = "start_time",
                   end: str = "end_time", rid: str = "call_id", shown=None) -> DataFrame:
    """Every pair of overlapping reservations on a berth, once
    (``rid_a < rid_b``).  The later one's start lies in the earlier one, which is in one level's cells: each overlapping
    pair is met exactly once, with no all-pairs step per berth.  ``shown`` (a function of a timestamp column) is how the overlap's ends
    are given; it runs once per reservation, not once per pair."""
    r = _us(res.select(key, rid, start, end), start, end)
    ends = [("_s", "_from"), ("_e", "_to")] if shown else []
    r = r.withColumns({t: shown(from_us(us)) for us, t in ends})
    a = in_cells(r, "_s", "_e", finer=2).select(key, *CELL, *[F.col(c).alias(f"a{c}") for c in ("_s", "_e", *[t for _, t in ends[1:]])],
                                                F.col(rid).alias("a_id"))
    b = r.select(key, F.col(rid).alias("b_id"), *[F.col(c).alias(f"b{c}") for c in ("_s", "_e", *[t for _, t in ends])])
    first = (F.col("a_s") < F.col("b_s")) | ((F.col("a_s") == F.col("b_s")) & (F.col("a_id") < F.col("b_id")))
    # A row of b becomes one per level, which Spark's size estimates don't see: neither side may be broadcast.
    j = a.hint("merge").join(at_levels(b, "b_s", levels_of(a)), [key, *CELL]).filter(first & overlaps("a_s", "a_e", "b_s", "b_e"))
    over = ((F.col("b_from"), F.when(F.col("a_e") <= F.col("b_e"), F.col("a_to")).otherwise(F.col("b_to"))) if shown
            else (from_us(F.col("b_s")), from_us(F.least("a_e", "b_e"))))
    return j.select(key, F.least("a_id", "b_id").alias(f"{rid}_a"), F.greatest("a_id", "b_id").alias(f"{rid}_b"),
                    over[0].alias("overlap_start"), over[1].alias("overlap_end"))


# ---------------------------------------------------------------------------
# J6 / J7 occupancy and free berths at instants
# ---------------------------------------------------------------------------

def occupancy_at(res: DataFrame, instants: DataFrame, t: str = "t", key: str = "berth_id",
                 start: str = "start_time", end: str = "end_time", rid: str = "call_id",
                 per_key: bool = False) -> DataFrame:
    """For each instant (and berth) the reservation with
    ``start <= t < end``; when several overlap, the earliest-starting one.

    ``instants`` holds column ``t`` (and ``key`` when ``per_key``).  Output:
    ``(t, key, rid, start, end, n_active)``."""
    r = _us(res.select(key, rid, start, end), start, end)
    r = in_cells(r, "_s", "_e")
    i = at_levels(instants.withColumn("_t", to_us(t)), "_t", levels_of(r))
    j = i.join(r, CELL + ([key] if per_key else [])).filter((F.col("_s") <= F.col("_t")) & (F.col("_t") < F.col("_e")))
    first = F.min_by(F.struct(rid, start, end), F.struct("_s", rid))
    g = j.groupBy(t, key).agg(first.alias("_r"), F.count(F.lit(1)).alias("n_active"))
    return g.select(t, key, F.col(f"_r.{rid}").alias(rid), F.col(f"_r.{start}").alias(start),
                    F.col(f"_r.{end}").alias(end), "n_active")


def free_berths(berths: DataFrame, occupied: DataFrame, instants: DataFrame, t: str = "t",
                key: str = "berth_id", port: str | None = None) -> DataFrame:
    """Per instant, the berths with no active reservation, as a sorted
    array.  The berth list is aggregated per port (one row), so the instants
    are never crossed with the berth table row by row."""
    free_of = lambda occ_col, all_col: F.sort_array(
        F.array_except(all_col, F.coalesce(occ_col, F.array().cast("array<string>"))))
    if not port:
        # one port: its berth list is a single value (scalar subquery)
        allb = berths.agg(F.sort_array(F.collect_set(key))).scalar()
        occ = occupied.groupBy(t).agg(F.collect_set(key).alias("_occ"))
        j = instants.select(t).distinct().join(occ, t, "left")
        return j.select(t, free_of(F.col("_occ"), allb).alias("free_berths"))
    allb = berths.groupBy(port).agg(F.array_sort(F.collect_set(key)).alias("_all"))
    occ = occupied.groupBy(t, port).agg(F.collect_set(key).alias("_occ"))
    # the berth lists are one row per port (bounded by the port dimension)
    j = instants.select(t, port).distinct().join(occ, [t, port], "left").join(F.broadcast(allb), port, "inner")
    return j.select(t, port, free_of(F.col("_occ"), F.col("_all")).alias("free_berths"))


def eligible_free(elig: DataFrame, occupied: DataFrame, t: str = "t", key: str = "berth_id") -> DataFrame:
    """J7 variant: eligible (call, berth) pairs whose berth is free at the
    call's instant ``t`` (anti-join on ``(berth, t)``)."""
    return elig.join(occupied.select(t, key), [t, key], "left_anti")


def port_snapshot(berths: DataFrame, occupied: DataFrame, instants: DataFrame, t: str = "t",
                  key: str = "berth_id", queue_len: DataFrame | None = None) -> DataFrame:
    """Per instant — occupied ids, free ids, counts, queue length and
    ``occupied / (occupied + free)`` (0 when there are no berths)."""
    fb = free_berths(berths, occupied, instants, t, key)
    occ = occupied.groupBy(t).agg(F.array_sort(F.collect_set(key)).alias("occupied_berths"))
    s = fb.join(occ, t, "left").withColumn(
        "occupied_berths", F.coalesce("occupied_berths", F.array().cast("array<string>")))
    s = s.withColumns({"occupied_count": F.size("occupied_berths"), "free_count": F.size("free_berths")})
    tot = F.col("occupied_count") + F.col("free_count")
    s = s.withColumn("utilization", F.when(tot > 0, F.col("occupied_count") / tot).otherwise(F.lit(0.0)))
    if queue_len is not None:
        s = s.join(queue_len, t, "left").withColumn("queue_length", F.coalesce("queue_length", F.lit(0)))
    return s


# ---------------------------------------------------------------------------
# J8 next free slot, J9 availability
# ---------------------------------------------------------------------------

def next_slot(islands: DataFrame, probes: DataFrame, t: str = "t", key: str = "berth_id",
              gap_seconds: int = S.NEXT_SLOT_GAP_SECONDS, out: str = "next_free") -> DataFrame:
    """Earliest instant >= t at which the berth is free, skipping gaps of
    at most ``gap`` between reservations.  ``islands`` must come from
    :func:`merge_busy` with the same gap.  Islands are disjoint, so only the last one that starts
    within ``t + gap`` can end after ``t``; its end, the running maximum of the ends, is the answer, else ``t``.
    The service length is not checked against the gap (as in the source)."""
    gap = gap_seconds * 1_000_000
    p = probes.select(F.col(key).alias("_k"), (to_us(t) + F.lit(gap)).alias("_at"), F.lit(1).alias("_probe"),
                      F.lit(None).cast("bigint").alias("_end"), F.struct("*").alias("row"))
    i = islands.select(F.col(key).alias("_k"), to_us("island_start").alias("_at"), F.lit(0).alias("_probe"), to_us("island_end").alias("_end"))
    # Blocks follow the probes; islands over before the first or begun after the last can't be met.
    lo, hi = p.agg(F.min("_at"), F.max("_at")).first()
    i = i.filter((F.col("_end") > F.lit(lo) - F.lit(gap)) & (F.col("_at") <= F.lit(hi)))
    both = in_blocks(p.unionByName(i, allowMissingColumns=True), "_at", bounds=block_bounds(p, "_at"))
    found = running(both, ["_k"], "_bkt", ["_at", "_probe"], "_end", "_busy", "max").filter("_probe = 1")
    # A probe without a berth or an instant meets nothing.
    lost = p.filter("_k is null or _at is null").withColumn("_busy", F.col("_end"))
    out_of = found.select("row", "_busy", "_at").unionByName(lost.select("row", "_busy", "_at"))
    free = F.when(F.col("_busy") > F.col("_at") - F.lit(gap), from_us("_busy")).otherwise(F.col(f"row.{t}"))
    return out_of.select("row.*", free.alias(out))


def is_available(res: DataFrame, proposals: DataFrame, key: str = "berth_id",
                 start: str = "start_time", end: str = "end_time", pid: str = "call_id",
                 p_start: str = "prop_start", p_end: str = "prop_end", out: str = "available") -> DataFrame:
    """A proposed ``[s, e)`` (identified by ``pid``) is available when no
    reservation on its berth overlaps it: when, of those that start before ``e``, the latest end is no later than
    ``s``.  That end is a running maximum over reservations by start and proposals by end, each one row, however long
    or short they are."""
    r = _us(res.select(key, start, end), start, end).select(
        F.col(key).alias("_k"), F.col("_s").alias("_at"), F.lit(1).alias("_taken"), F.col("_e").alias("_end"))
    r = r.filter("_at is not null")        # without a start it meets nothing, and its end must not be carried along
    p = proposals.select(F.col(key).alias("_k"), to_us(p_end).alias("_at"), F.lit(0).alias("_taken"),
                         to_us(p_start).alias("_from"), F.col(pid))
    both = in_blocks(p.unionByName(r, allowMissingColumns=True), "_at")
    met = running(both, ["_k"], "_bkt", ["_at", "_taken"], "_end", "_busy", "max").filter("_taken = 0 and _busy > _from")
    clash = met.select(pid).distinct().withColumn("_clash", F.lit(True))
    return (proposals.join(clash, pid, "left")
            .withColumn(out, F.col("_clash").isNull()).drop("_clash"))


# ---------------------------------------------------------------------------
# Timeline edits (U2-U4), key checks (J15), progress
# ---------------------------------------------------------------------------

def unknown_berths(df: DataFrame, berths: DataFrame, key: str = "berth_id", strict: bool = False) -> DataFrame:
    """Rows naming a berth that is not in the dimension.  With
    ``strict`` a non-empty result raises ``KeyError`` (one bounded ``take``)."""
    bad = df.join(berths.select(key).distinct(), key, "left_anti")
    if strict:
        hit = bad.select(key).take(1)
        if hit:
            raise KeyError(f"Berth '{hit[0][0]}' is not in the port's berth matrix.")
    return bad


def add_offline(res: DataFrame, windows: DataFrame) -> DataFrame:
    """Maintenance / closure windows become reservations named
    ``__OFFLINE__`` (``windows``: berth_id, start_time, end_time[, reason])."""
    w = windows.select(F.lit(None).cast("bigint").alias("call_id"), F.lit(S.OFFLINE_MARK).alias("vessel_name"),
                       "berth_id", "start_time", "end_time")
    return res.unionByName(w, allowMissingColumns=True)


def release(res: DataFrame, departures: DataFrame, key: str = "call_id", port: str | None = None,
            berth: str = "berth_id", start: str = "start_time") -> DataFrame:
    """Free the berth a departed call was registered on last: its latest reservation goes, earlier
    ones stay (unknown calls: no-op).  With ``port``, call ids are told apart by port."""
    who = [port, key] if port else [key]
    last = (res.join(departures.select(*who).distinct(), who, "left_semi")
            .groupBy(*who).agg(F.max(F.struct(start, berth)).alias("_last"))
            .select(*who, F.col(f"_last.{berth}").alias(berth), F.col(f"_last.{start}").alias(start)))
    return res.join(last, [*who, berth, start], "left_anti")


def split_at(res: DataFrame, t, end: str = "end_time") -> tuple[DataFrame, DataFrame]:
    """U4: (completed, active) at instant ``t``: completed iff ``t >= end``."""
    tc = F.lit(t).cast("timestamp_ntz") if not isinstance(t, Column) else t
    done = F.col(end) <= tc
    return res.filter(done), res.filter(~done)


def slot_progress(res: DataFrame, t, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Remaining hours, progress % (clamped 0..100; 0 for empty slots)
    and completion at ``t``."""
    tc = F.lit(t).cast("timestamp_ntz") if not isinstance(t, Column) else t
    total = F.timestamp_diff("MICROSECOND", F.col(start), F.col(end))
    elapsed = F.timestamp_diff("MICROSECOND", F.col(start), tc)
    remaining = F.greatest(F.timestamp_diff("MICROSECOND", tc, F.col(end)), F.lit(0)) / F.lit(3.6e9)
    pct = F.when(total <= 0, F.lit(0.0)).otherwise(
        F.least(F.greatest(elapsed / total * F.lit(100.0), F.lit(0.0)), F.lit(100.0)))
    return res.withColumns({"remaining_hours": remaining, "progress_pct": pct, "is_complete": tc >= F.col(end)})


__all__ = [
    "merge_busy", "conflict_flags", "find_conflicts", "occupancy_at", "free_berths", "eligible_free",
    "port_snapshot", "next_slot", "is_available", "unknown_berths", "add_offline", "release", "split_at",
    "slot_progress", "in_cells", "at_levels", "levels_of", "MINUTE_US", "GAP_US",
]
