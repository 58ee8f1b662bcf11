"""The berth timeline, as a stream and as a batch.

Assign, offline and release events of a berth apply in ``(event_time, seq)`` order, whatever order they come in.  The stream holds
events in list state until the watermark passes them; an event-time timer then applies what is due.  The accepted slots of a berth
are list state as well.  The batch form orders whole tables with Spark and cuts a berth's history into groups that cannot
touch each other, so both run the same fold over the same order.

``HORIZON`` bounds the state: a window may start at most that long before its event, and a slot that ended that
long before an event is over for it.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from berthwise.functions.time import to_us
from berthwise.operators.scan import in_blocks, running

HORIZON = timedelta(days=30)
EVENT_SCHEMA = ("berth_id string, seq long, event_time timestamp_ntz, kind string, "
                "call_id long, start_time timestamp_ntz, end_time timestamp_ntz")
OUT_SCHEMA = ("berth_id string, seq long, kind string, call_id long, start_time timestamp_ntz, "
              "end_time timestamp_ntz, accepted boolean, reason string")
_SLOT = "s long, e long, call_id long"
_PENDING = "t long, seq long, kind string, call_id long, s long, e long"
_EPOCH = datetime(1970, 1, 1)
_US = timedelta(microseconds=1)

# Streams with timers keep their state in RocksDB.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Slots:
    """Accepted slots of a berth: never overlapping, in start order."""

    def __init__(self, rows=(), horizon: timedelta = HORIZON):
        rows = sorted(rows)
        self.starts, self.ends = [r[0] for r in rows], [r[1] for r in rows]
        self.calls = [r[2] for r in rows]
        self.of: dict[int, list[tuple[int, int]]] = {}     # a call's windows, in slot order
        for s, e, call in rows:
            if call is not None:
                self.of.setdefault(call, []).append((s, e))
        self.horizon = horizon // _US

    def rows(self) -> list[tuple]:
        return list(zip(self.starts, self.ends, self.calls))

    def apply(self, t: int, kind: str, call: int | None, s: int | None, e: int | None) -> str | None:
        """Take one event; the reason if it is refused."""
        if kind in ("assign", "offline"):
            if s is None or e is None or e < s:
                return "no valid window"
            if s < t - self.horizon:
                return "window too old"
            at = bisect.bisect_left(self.starts, e)     # only the latest slot before this window's end can meet it
            if at and self.ends[at - 1] > s:
                return "overlaps an accepted slot"
            self.starts.insert(at, s)
            self.ends.insert(at, e)
            self.calls.insert(at, call if kind == "assign" else None)
            if kind == "assign" and call is not None:
                bisect.insort(self.of.setdefault(call, []), (s, e))
            return None
        if kind == "release":
            held = self.of.get(call, [])
            for k in range(len(held) - 1, -1, -1):              # the call's last slot
                if held[k][1] > t - self.horizon:
                    self._remove(call, *held.pop(k))
                    if not held:
                        del self.of[call]
                    return None
            return "unknown call"
        return "unknown event"

    def _remove(self, call: int, s: int, e: int) -> None:
        i = bisect.bisect_left(self.starts, s)
        while self.calls[i] != call or self.ends[i] != e:       # empty slots share an instant with the next one
            i += 1
        del self.starts[i], self.ends[i], self.calls[i]

    def forget(self, t: int) -> None:
        """Drop slots that no event after ``t`` can meet."""
        keep = [r for r in self.rows() if r[1] > t - self.horizon]
        self.__init__(keep, self.horizon * _US)


def _us(ts: datetime | None) -> int | None:
    return None if ts is None else (ts.replace(tzinfo=None) - _EPOCH) // _US


def _ts(us: int | None) -> datetime | None:
    return None if us is None else _EPOCH + us * _US


class Timeline(StatefulProcessor):
    def __init__(self, horizon: timedelta = HORIZON):
        self.horizon = horizon

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getListState("slots", _SLOT)
        self.pending = handle.getListState("pending", _PENDING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [(_us(r.event_time.astimezone(timezone.utc)), r.seq, r.kind, r.call_id, _us(r.start_time), _us(r.end_time)) for r in rows]
        self.pending.appendList(held)
        for ms in {-(-h[0] // 1000) for h in held}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(p) for p in self.pending.get()]
        due = sorted((p for p in held if p[0] <= now), key=lambda p: p[:2])
        if not due:
            return
        later = [p for p in held if p[0] > now]
        self.pending.put(later) if later else self.pending.clear()
        slots = Slots([tuple(s) for s in self.slots.get()], self.horizon)
        for t, seq, kind, call, s, e in due:
            reason = slots.apply(t, kind, call, s, e)
            yield Row(berth_id=key[0], seq=seq, kind=kind, call_id=call, start_time=_ts(s), end_time=_ts(e),
                      accepted=reason is None, reason=reason)
        slots.forget(now)
        left = slots.rows()
        self.slots.put(left) if left else self.slots.clear()

    def close(self) -> None:
        pass


def berth_timeline(events: DataFrame, watermark: str = "1 day", horizon: timedelta = HORIZON) -> DataFrame:
    """Outcome of every event, once the watermark has passed it; events behind the watermark are dropped.  The session needs
    ``STATE_CONF``.  Batch twin: :func:`replay`."""
    e = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", watermark)
    return e.groupBy("berth_id").transformWithState(Timeline(horizon), OUT_SCHEMA, "append", "EventTime")


def _fold(horizon: timedelta):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group and order; only the slots of the group at hand are kept."""
        group, slots = None, None
        for batch in batches:
            reasons = []
            for g, t, kind, call, s, e in zip(*(batch.column(c).to_pylist() for c in ("_group", "_t", "kind", "call_id", "_s", "_e"))):
                if g != group:
                    group, slots = g, Slots(horizon=horizon)
                reasons.append(slots.apply(t, kind, call, s, e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r is None for r in reasons], pa.bool_()), pa.array(reasons, pa.string())],
                                             names=[*batch.schema.names, "accepted", "reason"])
    return run


def replay(events: DataFrame, horizon: timedelta = HORIZON) -> DataFrame:
    """Batch twin of :func:`berth_timeline`.

    A berth's history falls into groups that cannot touch: overlap components of its windows, where a released call spans from the
    first to the last of its windows, so a release lies in one component with all it could free."""
    cols = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]
    ev = events.select(*cols).withColumns({"_t": to_us("event_time"), "_s": to_us("start_time"), "_e": to_us("end_time")})
    window = F.col("kind").isin("assign", "offline") & (F.col("_s") <= F.col("_e"))
    own = [F.when(window, F.col(c)) for c in ("_s", "_e")]
    freed = ev.filter("kind = 'release'").select("berth_id", "call_id").distinct()
    hull = (ev.filter("kind = 'assign' and _s <= _e").join(freed, ["berth_id", "call_id"], "left_semi")
            .groupBy("berth_id", "call_id").agg(F.min("_s").alias("_hs"), F.max("_e").alias("_he")))
    ev = ev.join(hull, ["berth_id", "call_id"], "left")
    ev = ev.withColumns({"_lo": F.coalesce("_hs", own[0]), "_hi": F.coalesce("_he", own[1])})
    # Events without any window meet nothing: they are placed by their own time and span nothing.
    ev = ev.withColumns({"_at": F.coalesce("_lo", "_t"), "_to": F.coalesce("_hi", "_t"), "_berth": F.to_json(F.struct("berth_id"))})
    order = ["_at", "_to", "seq"]
    ev = in_blocks(ev, "_at")
    ev = running(ev, ["_berth"], "_bkt", order, "_to", "_before", "max", inclusive=False)
    ev = ev.withColumn("_opens", F.coalesce(F.col("_at") >= F.col("_before"), F.lit(True)).cast("bigint"))
    ev = running(ev, ["_berth"], "_bkt", order, "_opens", "_part", "sum")
    ev = ev.select(*cols, "_t", "_s", "_e", F.to_json(F.struct("_berth", "_part")).alias("_group"))
    made = T.StructType([*ev.schema, T.StructField("accepted", T.BooleanType()), T.StructField("reason", T.StringType())])
    out = ev.repartition("_group").sortWithinPartitions("_group", "_t", "seq").mapInArrow(_fold(horizon), made)
    return out.select(*[f.split()[0] for f in OUT_SCHEMA.split(", ")])
