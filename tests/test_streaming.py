"""Streams over files with trigger(availableNow) equal their batch twins."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from berthwise.sources import feed
from berthwise.sources import testdata as td
from berthwise.streaming import live as LV
from berthwise.streaming import timeline as TL
from tests.conftest import SF_SMALL

NOW = "2024-01-01 00:00:00"


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def test_ais_stream_equals_batch(spark, tmp_path):
    msgs = td.ais_messages(spark, SF_SMALL)
    src = str(tmp_path / "ais")
    msgs.write.json(src)
    ok_b, bad_b = LV.ais_calls_stream(msgs, NOW)
    raw = LV.read_ais_stream(spark, src, max_files=1)
    ok_s, bad_s = LV.ais_calls_stream(raw, NOW)
    got_ok = _run(ok_s, "ais_ok")
    got_bad = _run(bad_s, "ais_bad")
    assert sorted(got_ok.collect()) == sorted(ok_b.collect())
    assert sorted(got_bad.collect()) == sorted(bad_b.collect())
    assert got_bad.count() > 0 and got_ok.filter(F.col("vessel_type") == "ROULIER").count() > 0
    # foreachBatch ingest writes both tables
    q = LV.start_ais_ingest(raw, NOW, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    q.awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == ok_b.count()


def _reports(spark, path):
    t0 = datetime(2024, 6, 1)
    rows = []
    # 12 distinct calls waiting in hour 0 at port P1 (one reported twice), 3 in hour 1
    for i in range(12):
        rows.append({"msg_id": i, "received_at": str(t0 + timedelta(minutes=4 * i)), "port_id": "P1", "name": f"C{i}",
                     "eta": str(t0 + timedelta(hours=5))})
    rows.append({"msg_id": 100, "received_at": str(t0 + timedelta(minutes=50)), "port_id": "P1", "name": "C3",
                 "eta": str(t0 + timedelta(hours=9))})
    for i in range(3):
        rows.append({"msg_id": 200 + i, "received_at": str(t0 + timedelta(hours=1, minutes=i)), "port_id": "P1",
                     "name": f"D{i}", "eta": str(t0 + timedelta(hours=2))})
    # late flush row moves the watermark past hour 1
    rows.append({"msg_id": 999, "received_at": str(t0 + timedelta(hours=6)), "port_id": "P2", "name": "Z",
                 "eta": str(t0 + timedelta(hours=6))})
    with open(path, "w") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")


SCHEMA = "msg_id long, received_at timestamp_ntz, port_id string, name string, eta timestamp_ntz"


def test_congestion_latest_and_replan(spark, tmp_path):
    d = tmp_path / "rep"
    d.mkdir()
    _reports(spark, str(d / "r.json"))
    stream = spark.readStream.schema(SCHEMA).json(str(d))
    alerts = _run(LV.congestion_alerts(stream, watermark="30 minutes"), "alerts").collect()
    assert [(a.port_id, a.waiting_calls) for a in alerts] == [("P1", 12)]
    latest = _run(LV.latest_calls(stream.drop("port_id")), "latest", mode="update")
    c3 = [r for r in latest.collect() if r.name == "C3"]
    assert c3[-1].eta == datetime(2024, 6, 1, 9)
    plan = spark.createDataFrame([("C3", datetime(2024, 6, 1, 5)), ("C4", datetime(2024, 6, 1, 5))],
                                 "name string, planned_eta timestamp_ntz")
    trig = _run(LV.replan_triggers(stream, plan), "trig").collect()
    assert [(t.name, t.delay_hours) for t in trig] == [("C3", 4.0)]


T0 = datetime(2024, 6, 1)
H = timedelta(hours=1)


def _timeline_events(seed=3):
    """Assign, offline, release and odd events of three berths, and one event of a fourth that comes long after."""
    r = random.Random(seed)
    out = []
    for seq in range(150):
        t = T0 + timedelta(minutes=20 * r.randrange(120))              # several events share a time
        kind = r.choice(["assign"] * 6 + ["release"] * 3 + ["offline", "odd"])
        s = t + r.randrange(-10, 60) * H if kind in ("assign", "offline") else None
        if s is not None and r.random() < 0.1:
            s -= timedelta(days=40)
        e = s + r.randrange(0, 12) * H if s is not None and r.random() < 0.9 else None
        call = None if kind == "offline" else r.randrange(25)
        out.append((r.choice("ABC"), seq, t, kind, call, s, e))
    return out, ("Z", 999, T0 + timedelta(days=400), "odd", None, None, None)


def _loop(events, horizon=TL.HORIZON):
    """All events in order against a plain list of slots."""
    held, out = {}, {}
    for b, seq, t, kind, call, s, e in sorted(events, key=lambda x: (x[2], x[1])):
        slots = held.setdefault(b, [])
        if kind in ("assign", "offline"):
            reason = ("no valid window" if e is None or e < s else "window too old" if s < t - horizon
                      else "overlaps an accepted slot" if any(x[0] < e and x[1] > s for x in slots) else None)
            if reason is None:
                slots.append((s, e, call if kind == "assign" else None))
        elif kind == "release":
            mine = [x for x in slots if x[2] == call and x[1] > t - horizon]
            reason = None if mine else "unknown call"
            if mine:
                slots.remove(max(mine))
        else:
            reason = "unknown event"
        out[b, seq] = reason
    return out


def test_timeline_batch_equals_loop(spark):
    for seed in range(4):
        events, _ = _timeline_events(seed)
        got = TL.replay(spark.createDataFrame(events, TL.EVENT_SCHEMA).repartition(3)).collect()
        assert {(r.berth_id, r.seq): r.reason for r in got} == _loop(events) and len(got) == len(events)
        assert all(r.accepted == (r.reason is None) for r in got)
        assert {r.reason for r in got} >= {None, "no valid window", "window too old", "overlaps an accepted slot", "unknown call", "unknown event"}
    assert TL.replay(spark.createDataFrame([], TL.EVENT_SCHEMA)).collect() == []


@pytest.mark.parametrize("batches,order", [(1, "time"), (5, "time"), (5, "shuffled"), (9, "backwards")])
def test_timeline_does_not_depend_on_batches(spark, tmp_path, batches, order):
    """The same events in any number and order of batches: the answer of the batch twin."""
    for k, v in TL.STATE_CONF.items():
        spark.conf.set(k, v)
    events, last = _timeline_events()
    want = _loop(events)
    arrive = sorted(events, key=lambda x: x[2])
    if order == "shuffled":
        random.Random(1).shuffle(arrive)
    elif order == "backwards":
        arrive.reverse()
    parts = [arrive[i * len(arrive) // batches:(i + 1) * len(arrive) // batches] for i in range(batches)] + [[last]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, TL.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ev")
        time.sleep(0.02)                                               # files are taken in order of their times
    stream = spark.readStream.schema(TL.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ev")
    got = _run(TL.berth_timeline(stream, watermark="3 days"), f"timeline_{batches}_{order}").collect()
    assert {(r.berth_id, r.seq): r.reason for r in got} == want and len(got) == len(events)
    rows = {x[1]: x for x in events}
    assert all((r.kind, r.call_id, r.start_time, r.end_time) == rows[r.seq][3:] for r in got)


def test_timeline_forgets(spark):
    """Slots that ended a horizon ago leave the state and change nothing."""
    us = lambda d: int(d.total_seconds() * 1e6)
    s = TL.Slots(horizon=timedelta(days=2))
    assert s.apply(0, "assign", 1, us(H), us(2 * H)) is None and s.apply(0, "assign", 2, us(30 * H), us(40 * H)) is None
    s.forget(us(51 * H))
    assert s.rows() == [(us(30 * H), us(40 * H), 2)]
    assert s.apply(us(51 * H), "release", 1, None, None) == "unknown call" and s.apply(us(51 * H), "assign", 3, us(H), us(2 * H)) == "window too old"


def _messages(spark, lo, hi):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=i), f'{{"name": "N{i % 7}", "eta": "2024-06-01T0{i % 9}:00:00"}}') for i in range(lo, hi)],
                                 "msg_id long, received_at timestamp_ntz, value string")


def test_feed_loses_and_repeats_nothing_over_restarts(spark, tmp_path):
    topic, out, ck = (str(tmp_path / x) for x in ("topic", "out", "ck"))
    feed.append_log(_messages(spark, 0, 40), topic, partitions=3)

    def run():
        q = (feed.read_log(spark, topic, group="g", rowsPerTask=7).writeStream.format("parquet").option("checkpointLocation", ck)
             .trigger(availableNow=True).start(out))
        q.awaitTermination(120)
        return spark.read.parquet(out)
    assert run().count() == 40
    feed.append_log(_messages(spark, 40, 65), topic, partitions=3)
    feed.append_log(_messages(spark, 65, 66), topic, partitions=3)
    got = run()
    assert run().count() == got.count() == got.select("msg_id").distinct().count() == 66
    want = _messages(spark, 0, 66)
    key = lambda r: (r.received_at, r.value)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert sorted(map(key, feed.read_log(spark, topic, stream=False).collect())) == sorted(map(key, want.collect()))
    with open(f"{topic}/_committed/g.json") as f:
        assert sum(json.load(f).values()) == 40                 # Spark tells of a commit when the next batch begins
    # offsets of a partition ascend by one, in time order
    for p in {r.partition for r in spark.read.parquet(topic).select("partition").collect()}:
        rows = spark.read.parquet(topic).where(F.col("partition") == p).orderBy("offset").collect()
        assert [r.offset for r in rows] == list(range(len(rows)))
    assert feed.read_log(spark, str(tmp_path / "none"), stream=False).count() == 0


def test_rows_of_a_topic(spark):
    """The columns of the Kafka source give the same messages."""
    rows = spark.createDataFrame([(b"k", b'{"name": "A"}', "ais", 2, 5, T0, 0)],
                                 "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int")
    assert [tuple(r) for r in feed.as_messages(rows).collect()] == [((2 << 48) + 5, T0, '{"name": "A"}')]


def test_sessions_leave_the_state(spark, tmp_path):
    """A silent call's last report comes out, its state goes, and when it returns it starts anew."""
    at = lambda h: T0 + h * H
    parts = [[(1, at(0), "A", 1.0), (2, at(1), "A", 2.0), (3, at(1), "B", 9.0)], [(4, at(4), "A", 3.0), (4, at(4), "A", 3.0)],
             [(5, at(20), "C", 1.0)], [(6, at(30), "A", 7.0)], [(7, at(60), "C", 2.0)], [(8, at(90), "D", 2.0)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "msg_id long, received_at timestamp_ntz, name string, draft_m double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
        time.sleep(0.02)
    raw = spark.readStream.schema("msg_id long, received_at timestamp_ntz, name string, draft_m double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/m")
    df = LV.latest_call_sessions(raw, idle="6 hours")
    q = df.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted((r.name, r.msg_id, r.draft_m) for r in spark.table("sessions").collect())
    assert got == [("A", 4, 3.0), ("A", 6, 7.0), ("B", 3, 9.0), ("C", 5, 1.0), ("C", 7, 2.0)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda x: json.loads(x.json), q.recentProgress) if p["stateOperators"]]
    assert max(held) >= 2 and held[-1] == 1
    twin = LV.latest_call_sessions(spark.read.parquet(f"{tmp_path}/m"), idle="6 hours")
    assert sorted((r.name, r.msg_id, r.draft_m) for r in twin.collect()) == [*got, ("D", 8, 2.0)]


def test_both_tables_appear_together(spark, tmp_path, monkeypatch):
    """A batch killed between its two writes shows neither half; tried again, it shows both once."""
    src, ok, bad, ck = (str(tmp_path / x) for x in ("src", "ok", "bad", "ck"))
    msgs = td.ais_messages(spark, SF_SMALL)
    msgs.limit(200).write.json(src)
    raw = LV.read_ais_stream(spark, src)
    real, calls = LV.ais_to_calls, []

    def broken(batch, now):
        good, rejects = real(batch, now)
        calls.append(1)
        return good, rejects.withColumn("reason", F.raise_error(F.lit("killed")).cast("string")) if len(calls) == 1 else rejects
    monkeypatch.setattr(LV, "ais_to_calls", broken)
    shown = lambda: [LV.read_committed(spark, p, LV.commits_of(ck)).count() for p in (ok, bad)]
    with pytest.raises(Exception):
        LV.start_ais_ingest(raw, NOW, ok, bad, ck).awaitTermination(120)
    assert spark.read.parquet(ok).count() > 0 and LV.read_committed(spark, ok, LV.commits_of(ck)).count() == 0
    LV.start_ais_ingest(raw, NOW, ok, bad, ck).awaitTermination(120)
    want = [x.count() for x in real(spark.read.schema(LV.AIS_RAW_SCHEMA).json(src), NOW)]
    assert shown() == want and min(want) > 0
    LV.start_ais_ingest(raw, NOW, ok, bad, ck).awaitTermination(120)
    assert shown() == want and spark.read.parquet(ok).count() > want[0]
