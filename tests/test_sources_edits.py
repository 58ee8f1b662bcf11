"""Sources / sinks, timeline edits and small joins."""

from datetime import datetime, timedelta

from pyspark.sql import Observation
from pyspark.sql import functions as F

from berthwise import schema as S
from berthwise.operators import cleaning as CL
from berthwise.operators import eligibility as EL
from berthwise.operators import intervals as IV
from berthwise.plans import scoring as SCO
from berthwise.sources.io import read_calls, write_table

T0 = datetime(2024, 6, 1)
RES = "call_id long, vessel_name string, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz"


def test_read_calls_csv_and_write(spark, tmp_path):
    header = ",".join(f'"{c}"' for c in [S.VESSEL_NAME, S.DATE_ARRIVAL, S.TIME_ARRIVAL, S.DATE_BERTHING,
                                          S.TIME_BERTHING, S.DATE_UNBERTHING, S.TIME_UNBERTHING,
                                          S.DATE_ANCHORAGE_IN, S.BERTH_ID, S.STAY_QUAY_DAYS])
    lines = [header,
             'TEST_SHIP,01/06/2024,08:00,01/06/2024,10:00,02/06/2024,08:00,01/06/2024," 70 ",',
             'ZERO,01/06/2024,08:00,01/06/2024,10:00,01/06/2024,10:00,,12,"3,5"',
             'BAD,nan,nan,01/06/2024,10:00,02/06/2024,08:00,,12,']
    p = tmp_path / "calls.csv"
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    raw = read_calls(spark, str(p))
    assert all(t == "string" for _, t in raw.dtypes)
    obs = Observation("outliers")
    c = CL.clean_calls(raw)
    rows = {r[S.VESSEL_NAME]: r for r in c.collect()}
    assert set(rows) == {"TEST_SHIP", "ZERO"}
    assert rows["TEST_SHIP"][S.BERTH_ID] == "70" and rows["ZERO"][S.SERVICE_HOURS] == 84.0
    # the dropped-row count is observed during the same pass
    d = CL.drop_outliers(CL.with_service_hours(CL.with_event_times(raw)), observe_as=obs)
    d.collect()
    assert obs.get["dropped"] == 0
    out = str(tmp_path / "out")
    write_table(c.withColumn("port_id", F.lit("P0")), out, partition_by=["port_id"])
    assert spark.read.parquet(out).filter("port_id = 'P0'").count() == 2


def test_timeline_edits(spark):
    res = spark.createDataFrame([(1, "A", "70", T0, T0 + timedelta(hours=8)),
                                 (2, "B", "71", T0, T0 + timedelta(hours=2))], RES)
    win = spark.createDataFrame([("72", T0, T0 + timedelta(hours=24))], "berth_id string, start_time timestamp_ntz, "
                                "end_time timestamp_ntz")
    allr = IV.add_offline(res, win)
    off = allr.filter(F.col("vessel_name") == S.OFFLINE_MARK).collect()
    assert len(off) == 1 and off[0].berth_id == "72"
    occ = IV.occupancy_at(allr, spark.createDataFrame([(T0 + timedelta(hours=4),)], "t timestamp_ntz"))
    assert sorted(r.berth_id for r in occ.collect()) == ["70", "72"]       # offline counts as occupied
    rel = IV.release(res, spark.createDataFrame([(1,), (99,)], "call_id long"))
    assert [r.call_id for r in rel.collect()] == [2]                        # unknown departure: no-op
    done, active = IV.split_at(res, T0 + timedelta(hours=2))
    assert [r.call_id for r in done.collect()] == [2] and [r.call_id for r in active.collect()] == [1]


def test_eligible_free_accuracy_and_remaining(spark):
    elig = spark.createDataFrame([(1, "70", T0), (1, "71", T0), (2, "70", T0 + timedelta(hours=9))],
                                 "call_id long, berth_id string, t timestamp_ntz")
    res = spark.createDataFrame([(9, "X", "70", T0, T0 + timedelta(hours=8))], RES)
    occ = IV.occupancy_at(res, elig.select("t").distinct())
    free = sorted((r.call_id, r.berth_id) for r in IV.eligible_free(elig, occ).collect())
    assert free == [(1, "71"), (2, "70")]
    plan = spark.createDataFrame([(0, 1, "70"), (0, 2, "71"), (0, 3, "72")], "plan_id long, call_id long, berth_id string")
    rec = spark.createDataFrame([(1, "70"), (2, "70")], "call_id long, recorded_berth string")
    acc = SCO.berth_accuracy(plan, rec).collect()[0]
    assert acc.matched == 2 and acc.berth_accuracy == 0.5
    queue = spark.createDataFrame([("P", 1), ("P", 2), ("P", 3)], "port_id string, call_id long")
    assigned = spark.createDataFrame([("P", 2)], "port_id string, call_id long")
    assert sorted(r.call_id for r in EL.remaining_queue(queue, assigned).collect()) == [1, 3]


def test_earliest_slot_with_busy_and_ties(spark):
    from berthwise.plans import dispatch as DP
    elig = spark.createDataFrame([("P", 1, "A", 0), ("P", 1, "B", 1), ("P", 2, "A", 0), ("P", 2, "B", 1)],
                                 "port_id string, call_id long, berth_id string, ordinal int")
    calls = spark.createDataFrame([("P", 1, T0), ("P", 2, T0 + timedelta(hours=1))],
                                  "port_id string, call_id long, eta timestamp_ntz")
    res = spark.createDataFrame([(9, "X", "A", T0, T0 + timedelta(hours=3))], RES)
    isl = IV.merge_busy(res)
    # no busy state: call 1 -> B at its ETA (A is reserved); call 2 -> B at its ETA
    got = {r.call_id: (r.berth_id, r.scheduled_start) for r in DP.earliest_slot(elig, calls, isl).collect()}
    assert got == {1: ("B", T0), 2: ("B", T0 + timedelta(hours=1))}
    # B busy until +5 h: call 2 now waits for A's reservation to end at +3 h
    busy = spark.createDataFrame([("B", T0 + timedelta(hours=5))], "berth_id string, busy_until timestamp_ntz")
    got = {r.call_id: (r.berth_id, r.scheduled_start) for r in DP.earliest_slot(elig, calls, isl, busy).collect()}
    assert got[2] == ("A", T0 + timedelta(hours=3))
    # equal slots: the first berth in berth order wins
    free = IV.merge_busy(res.filter("call_id < 0"))
    got = {r.call_id: r.berth_id for r in DP.earliest_slot(elig, calls, free).collect()}
    assert got == {1: "A", 2: "A"}


def test_offline_windows_are_checked(spark):
    from berthwise.plans import repair as RPR
    res = spark.createDataFrame([(1, "A", "70", T0, T0 + timedelta(hours=8))], RES)
    h = lambda n: T0 + timedelta(hours=n)
    win = spark.createDataFrame([(1, "70", h(7), h(9)), (2, "70", h(8), h(10)), (3, "70", h(9), h(12)), (4, "71", h(0), h(2))],
                                "window_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    after, judged = RPR.take_offline(res, win)
    assert {r.window_id: r.accepted for r in judged.collect()} == {1: False, 2: True, 3: False, 4: True}
    assert after.count() == 3


def test_admission_refuses_rows_without_a_window(spark):
    from berthwise.plans import repair as RPR
    h = lambda n: T0 + timedelta(hours=n)
    rows = [(1, "70", h(0), h(4)), (2, "70", None, h(2)), (3, "70", h(3), h(1)), (4, None, h(0), h(1)), (5, "70", h(2), h(5)),
            (6, None, h(0), h(1)), (7, "70", h(4), h(6))]
    req = spark.createDataFrame(rows, "pos long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    got = {r.pos: r.accepted for r in RPR.admit(req).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False, 7: True}
    assert RPR.admit(req.limit(0)).count() == 0


def test_split_keeps_rows_without_a_time(spark):
    from berthwise.operators import ml as ML
    rows = [(i, T0 + timedelta(minutes=i // 3)) for i in range(10)] + [(10, None)]
    df = spark.createDataFrame(rows, "call_id long, t timestamp_ntz")
    got = {r.call_id: r.is_train for r in ML.time_split(df, ts="t").collect()}
    assert got == {i: i < 8 for i in range(11)}
    assert ML.time_split(df.limit(0), ts="t").count() == 0


def test_repair_respects_existing_reservations(spark):
    from berthwise.plans import repair as RPR
    h = lambda n: T0 + timedelta(hours=n)
    hour = 3_600_000_000
    res = spark.createDataFrame([(8, "X", "70", h(4), h(6)), (9, "Y", "70", h(0), h(2)), (7, "Z", "70", h(5), h(7))], RES)
    plans = spark.createDataFrame(
        [(p, pos, pos, "70", h(0), h(start), svc * hour) for p in (1, 2) for pos, start, svc in ((1, 1, 2), (2, 2, 3), (3, 0, 1))],
        "plan_id long, pos long, call_id long, berth_id string, eta timestamp_ntz, scheduled_start timestamp_ntz, svc_us long")
    one = {1: h(2), 2: h(7), 3: h(10)}                    # busy 0-2 and 4-7; the 2-hour call fills 2-4
    for split in (False, True):
        out = RPR.repair_plans(plans, busy=IV.merge_busy(res, gap_seconds=0), split=split).collect()
        got = {(r.plan_id, r.call_id): r.scheduled_start for r in out}
        assert len(out) == 6 and got == {(p, c): t for p in (1, 2) for c, t in one.items()}
