"""Plan repair (Q4) and reservation admission (Q5).

Both are first-come-wins folds over one berth's rows: rows on different berths
never interact, and different plans never interact.  Both run per component, a stretch of
time whose rows can meet, of a plan's berth or a berth.  Components stream through sorted
partitions (secondary sort), so a busy berth is many groups and no frame of its own.
"""

from __future__ import annotations

import bisect
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from berthwise.functions.time import from_us, to_us
from berthwise.operators.intervals import add_offline, is_available
from berthwise.operators.scan import block_bounds, in_blocks, running
from berthwise.session import cut_lineage


_CHUNK = 512
_NEVER, _EVER = -(1 << 64), 1 << 64


class _Free:
    """The stretches between accepted slots, empty ones too, in time order.  They are held in chunks that know the
    length of their longest one, so a search passes over a chunk without room in one step."""

    def __init__(self):
        self.first, self.room = [_NEVER], [_EVER - _NEVER]      # per chunk: where its first stretch starts, its longest
        self.starts, self.ends = [[_NEVER]], [[_EVER]]

    def _search(self, at: int, dur: int) -> tuple[int, int, int]:
        c = bisect.bisect_right(self.first, at) - 1
        i = bisect.bisect_right(self.starts[c], at) - 1         # the last stretch that starts by ``at``
        if self.ends[c][i] >= at + dur:
            return c, i, at
        i += 1
        while True:
            if self.room[c] >= dur:
                starts, ends = self.starts[c], self.ends[c]
                for k in range(i, len(starts)):
                    if ends[k] - starts[k] >= dur:
                        return c, k, starts[k]
            c, i = c + 1, 0

    def take(self, at: int, dur: int) -> int:
        """The first start no earlier than ``at`` that leaves room for ``dur``; the slot there is taken."""
        c, i, at = self._search(at, dur)
        starts, ends = self.starts[c], self.ends[c]
        longest = ends[i] - starts[i] == self.room[c]
        starts.insert(i + 1, at + dur)
        ends.insert(i, at)
        if len(starts) > 2 * _CHUNK:
            self.starts[c:c + 1] = starts[:_CHUNK], starts[_CHUNK:]
            self.ends[c:c + 1] = ends[:_CHUNK], ends[_CHUNK:]
            self.first.insert(c + 1, starts[_CHUNK])
            self.room[c:c + 1] = [max(map(operator.sub, e, s)) for s, e in zip(self.starts[c:c + 2], self.ends[c:c + 2])]
        elif longest:
            self.room[c] = max(map(operator.sub, ends, starts))
        return at


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First fit over rows sorted by ``_group`` and ``pos``: each row moves past the accepted slots it overlaps, in start
    order, and is accepted there, which is the first stretch between them with room for it.  Only the stretches of the
    group at hand are kept."""
    group, last, free = None, None, _Free()
    for batch in batches:
        put = []
        for g, pos, at, dur in zip(*(batch.column(c).to_pylist() for c in ("_group", "pos", "_s", "svc_us"))):
            if g != group:
                group, last, free = g, None, _Free()
            if last is not None and pos < last:
                raise RuntimeError("grouped input is not in row order")
            last = pos
            put.append(free.take(at, dur))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(put, pa.int64())], names=[*batch.schema.names, "_put"])


_FIRST = -(1 << 63)      # position of existing reservations: before every plan row


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_put``, the repaired start, per ``_group``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_put", T.LongType())])
    return rows.repartition("_group").sortWithinPartitions("_group", "pos", "call_id").mapInArrow(_place_rows, schema)


def _merges(placed: DataFrame, bounds: list[int]) -> DataFrame:
    """Old component to new one and how often it grew, where a component is reached by an earlier one or reaches a
    later one.  One that grew more than twice counts a multiple of its span as reached, so a long cascade takes few
    rounds; the other reaches are exact."""
    order = ["_lo", "_component"]
    span = F.col("_hi") - F.col("_lo")
    again = F.pow(F.lit(2.0), F.least(F.greatest(F.col("_grown") - 2, F.lit(0)), F.lit(20))).cast("bigint") - 1
    c = placed.groupBy("_key", "_component").agg(F.min("_s").alias("_lo"), F.max(F.col("_put") + F.col("svc_us")).alias("_hi"),
                                                 F.max("_grown").alias("_grown"))
    c = in_blocks(c.withColumn("_reach", F.col("_hi") + again * span), "_lo", bounds=bounds)
    c = running(c, ["_key"], "_bkt", order, "_reach", "_before", "max", inclusive=False)
    c = c.withColumn("_opens", F.when(F.coalesce(F.col("_lo") >= F.col("_before"), F.lit(True)), F.col("_component")))
    c = running(c, ["_key"], "_bkt", order, "_opens", "_into", "max").select("_key", "_component", "_into", "_grown")
    joined = c.filter("_into != _component").groupBy("_key", "_into").agg(F.max("_grown").alias("_most"))
    return cut_lineage(c.join(joined, ["_key", "_into"]).select(
        "_key", "_component", "_into", (F.greatest("_grown", "_most") + 1).alias("_now")))


def _group_of() -> Column:
    return F.to_json(F.struct("_key", "_component"))


def _settled(p: DataFrame) -> DataFrame:
    """Rows placed by component, components merged until none reaches a later one."""
    order = ["_s", "pos", "call_id"]
    bounds = block_bounds(p, "_s")
    p = in_blocks(p, "_s", bounds=bounds)
    p = running(p, ["_key"], "_bkt", order, "svc_us", "_work", "sum", inclusive=False)
    p = p.withColumn("_slack", F.col("_s") - F.col("_work"))       # grows exactly where the queue runs empty
    p = running(p, ["_key"], "_bkt", order, "_slack", "_component", "max").drop("_bkt", "_work", "_slack")
    placed = cut_lineage(_placed(p.withColumns({"_group": _group_of(), "_grown": F.lit(0)})))
    while True:
        into = _merges(placed, bounds)
        if into.isEmpty():
            return placed
        both = placed.join(into, ["_key", "_component"], "left").select(*placed.columns, "_into", "_now")
        moved = both.filter("_into is not null").withColumns({"_component": F.col("_into"), "_grown": F.col("_now")})
        moved = _placed(moved.withColumn("_group", _group_of()).drop("_into", "_now", "_put"))
        placed = cut_lineage(both.filter("_into is null").select(*placed.columns).unionByName(moved))


def repair_plans(plans: DataFrame, by: tuple[str, ...] = ("plan_id", "berth_id"), busy: DataFrame | None = None,
                 key: str = "berth_id", split: bool = False) -> DataFrame:
    """Q4: per plan and berth, in plan row order (``pos``): start no earlier
    than the ETA, then scan the berth's accepted slots in start order and push
    the start past each overlapping one; accept.

    ``plans``: by columns, pos, call_id, eta, scheduled_start, svc_us (not negative).  ``busy``: the berths' existing
    reservations as disjoint islands (``merge_busy(res, gap_seconds=0)``); they are accepted before any
    plan row, in every plan.

    A group is a berth of a plan; its accepted slots are held by one task.  With ``split`` it is a component, for
    berths with long histories: a few more passes, any number of groups.  A row only moves later, so rows can only meet
    inside a stretch of work.  Components start as the busy periods of a queue that serves the rows one after
    another.  A pushed row may skip gaps too short for it and end beyond its period: while a component reaches past the
    start of a later one, those are merged and repaired again, the others stay.  When none does, no two
    components' slots can overlap, so the result is that of the whole berth.  A berth that is never idle is one component.  Rows without any time, or without
    a service time, come back without a window."""
    p = plans.select(*by, F.col("pos").cast("bigint").alias("pos"), "call_id", to_us("eta").alias("eta_us"),
                     to_us("scheduled_start").alias("start_us"), "svc_us")
    if busy is not None:
        lo, hi = to_us("island_start"), to_us("island_end")
        kept = plans.select(*by).distinct().join(busy, key)
        p = p.unionByName(kept.select(
            *by, F.lit(_FIRST).cast("bigint").alias("pos"), F.lit(0).cast(p.schema["call_id"].dataType).alias("call_id"),
            lo.alias("eta_us"), lo.alias("start_us"), (hi - lo).cast(p.schema["svc_us"].dataType).alias("svc_us")))
    p = p.withColumns({"_key": F.to_json(F.struct(*by)), "_s": F.greatest("start_us", "eta_us")})
    open_ended = F.col("_s").isNull() | F.col("svc_us").isNull()
    unplaced = p.filter(open_ended).drop("_key", "_s").withColumns(
        {"start_us": F.lit(None).cast("bigint"), "end_us": F.lit(None).cast("bigint")})
    p = p.filter(~open_ended)
    if split:
        placed = _settled(p)
    else:
        placed = _placed(p.withColumn("_component", F.lit(0)).withColumn("_group", _group_of()))
    out = placed.filter(F.col("pos") != F.lit(_FIRST)).withColumn("start_us", F.col("_put")).withColumn(
        "end_us", F.col("_put") + F.col("svc_us")).drop("_key", "_s", "_component", "_group", "_grown", "_put")
    return out.unionByName(unplaced).withColumns(
        {"scheduled_start": from_us("start_us"), "predicted_end": from_us("end_us")})


def _admit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First come wins over rows sorted by ``_group``; only the accepted slots of the group at hand are kept."""
    group = None
    starts: list[int] = []      # accepted slots never overlap, so starts and ends are both sorted
    ends: list[int] = []
    for batch in batches:
        ok = []
        for g, s, e in zip(*(batch.column(c).to_pylist() for c in ("_group", "_s", "_e"))):
            if g != group:
                group, starts, ends = g, [], []
            free = s is not None
            if free:
                j = bisect.bisect_left(starts, e)           # accepted slots starting before e
                free = j == 0 or ends[j - 1] <= s           # the latest of them ends by s
                if free:
                    starts.insert(j, s)
                    ends.insert(j, e)
            ok.append(free)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())],
                                         names=[*batch.schema.names, "accepted"])


def admit(requests: DataFrame, key: str = "berth_id", order: str = "pos",
          start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Q5: apply assignment requests per berth in ``order``; a request that
    overlaps an already accepted slot on the berth is rejected (first come
    wins), and so is one without a window or whose end is before its start.  Returns all requests with
    ``accepted``; split with a filter.

    Requests of different overlap components cannot clash, so a busy berth splits into many groups.  Groups are
    many and mostly small: they stream through the sorted partitions instead of one Python call each."""
    s, e = to_us(start), to_us(end)
    good = s.isNotNull() & e.isNotNull() & (s <= e)
    r = requests.withColumns({"_berth_key": F.to_json(F.struct(key)), "_s": F.when(good, s), "_e": F.when(good, e),
                              "_at": F.when(good, s).otherwise(F.lit(0))})
    by_start = ["_at", "_e", order]
    r = in_blocks(r, "_at")
    r = running(r, ["_berth_key"], "_bkt", by_start, "_e", "_before", "max", inclusive=False)
    r = r.withColumn("_opens", F.coalesce(F.col("_at") >= F.col("_before"), F.lit(True)).cast("bigint"))
    r = running(r, ["_berth_key"], "_bkt", by_start, "_opens", "_component", "sum")
    r = r.select(*requests.columns, "_s", "_e", F.to_json(F.struct("_berth_key", "_component")).alias("_group"))
    schema = T.StructType([*r.schema.fields, T.StructField("accepted", T.BooleanType())])
    r = r.repartition("_group").sortWithinPartitions("_group", order)
    return r.mapInArrow(_admit_rows, schema).select(*requests.columns, "accepted")


def take_offline(res: DataFrame, windows: DataFrame, wid: str = "window_id", key: str = "berth_id",
                 start: str = "start_time", end: str = "end_time") -> tuple[DataFrame, DataFrame]:
    """U2 with its check: a window that overlaps a reservation of its berth, or a window of a smaller
    ``wid`` that was taken, is refused.  Returns the reservations with the accepted windows added, and the
    windows with ``accepted``."""
    # Judged once: the admission reads it for the blocks, for each running maximum and for the refused windows.
    free = cut_lineage(is_available(res, windows, key=key, start=start, end=end, pid=wid, p_start=start, p_end=end))
    won = admit(free.filter("available"), key=key, order=wid, start=start, end=end)
    cols = [*windows.columns, "accepted"]
    judged = won.select(*cols).unionByName(free.filter("not available").withColumn("accepted", F.lit(False)).select(*cols))
    return add_offline(res, judged.filter("accepted")), judged
