"""Property tests: Spark operators vs small pure-Python loops on random input."""

import heapq
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from berthwise.functions.time import to_us
from berthwise.operators import intervals as IV
from berthwise.operators import kpi as KP
from berthwise.operators import replay as RP
from berthwise.operators import scenarios as SC
from berthwise.plans import repair as RPR

T0 = datetime(2024, 6, 1)
H = 3_600_000_000
GAP = 60_000_000


def _ts(us):
    return T0 + timedelta(microseconds=us)


def _rand_res(rng, n_berths=4, n=60, span_h=200):
    rows = []
    for i in range(n):
        b = str(rng.randrange(n_berths))
        s = rng.randrange(0, span_h * 60) * 60_000_000          # minute grid
        d = rng.choice([1, 30, 59, 60, 61, 120, 600]) * 60_000_000 if rng.random() < 0.3 \
            else rng.randrange(1, 40) * H
        rows.append((i, b, _ts(s), _ts(s + d)))
    return rows


def _ref_next_slot(res, t):
    cand = t
    for s, e in sorted(res):
        if s > cand + timedelta(minutes=1):
            break
        if e > cand:
            cand = e
    return cand


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_islands_next_slot_vs_loop(spark, seed):
    rng = random.Random(seed)
    rows = _rand_res(rng)
    res = spark.createDataFrame(rows, "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    probes = [(j, str(rng.randrange(4)), _ts(rng.randrange(0, 220 * 60) * 60_000_000)) for j in range(150)]
    # probes exactly at reservation ends and 60/61 s before starts
    for i, b, s, e in rows[:20]:
        probes += [(1000 + i, b, e), (2000 + i, b, s - timedelta(seconds=60)), (3000 + i, b, s - timedelta(seconds=61))]
    pdf = spark.createDataFrame(probes, "probe_id long, berth_id string, t timestamp_ntz")
    got = {r.probe_id: r.next_free for r in IV.next_slot(IV.merge_busy(res), pdf).collect()}
    by_b = {}
    for _, b, s, e in rows:
        by_b.setdefault(b, []).append((s, e))
    for pid, b, t in probes:
        assert got[pid] == _ref_next_slot(by_b.get(b, []), t), (pid, b, t)


def test_reference_timeline_cases(spark):
    res = spark.createDataFrame([(1, "70", _ts(0), _ts(10 * H))],
                                "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    probes = spark.createDataFrame([(1, "70", _ts(0)), (2, "70", _ts(4 * H)), (3, "71", _ts(0))],
                                   "probe_id long, berth_id string, t timestamp_ntz")
    got = {r.probe_id: r.next_free for r in IV.next_slot(IV.merge_busy(res), probes).collect()}
    assert got[1] == _ts(10 * H) and got[2] == _ts(10 * H) and got[3] == _ts(0)
    occ = IV.occupancy_at(res, spark.createDataFrame([(_ts(4 * H),), (_ts(10 * H),)], "t timestamp_ntz"))
    assert [r.call_id for r in occ.collect()] == [1]          # [0,10) occupied at 4 h, free at 10 h
    # [0,8) vs [4,12) overlap; [0,8) vs [8,16) adjacent -> no overlap
    r2 = spark.createDataFrame([(1, "A", _ts(0), _ts(8 * H)), (2, "A", _ts(4 * H), _ts(12 * H)),
                                (3, "B", _ts(0), _ts(8 * H)), (4, "B", _ts(8 * H), _ts(16 * H))],
                               "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    pairs = [(r.call_id_a, r.call_id_b) for r in IV.find_conflicts(r2).collect()]
    assert pairs == [(1, 2)]


def test_conflict_pairs_vs_loop(spark):
    rng = random.Random(7)
    rows = _rand_res(rng, n_berths=3, n=80)
    # zero-length and same-start reservations
    rows += [(100 + i, str(i % 3), r[2], r[2]) for i, r in enumerate(rows[:6])]
    rows += [(200 + i, r[1], r[2], r[2] + timedelta(hours=1)) for i, r in enumerate(rows[6:12])]
    res = spark.createDataFrame(rows, "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    got = sorted((r.call_id_a, r.call_id_b) for r in IV.find_conflicts(res).collect())
    exp = sorted((a[0], b[0]) for a in rows for b in rows
                 if a[1] == b[1] and a[0] < b[0] and a[2] < b[3] and a[3] > b[2])
    assert got == exp


def _ref_fifo(calls, k):
    """calls: list of (pos, a_us, svc_us) -> {pos: start_us} with a k-heap."""
    heap, out = [], {}
    for pos, a, s in sorted(calls, key=lambda x: (x[1], x[0])):
        if len(heap) < k:
            st = a
            heapq.heappush(heap, st + s)
        else:
            st = max(a, heap[0])
            heapq.heapreplace(heap, st + s)
        out[pos] = st
    return out


@pytest.mark.parametrize("seed", [11, 12])
def test_fifo_lanes_vs_loop(spark, seed):
    rng = random.Random(seed)
    pools = {"p1": 1, "p2": 2, "p3": 3, "p4": 4}
    rows = []
    for i in range(400):
        p = rng.choice(list(pools))
        a = rng.randrange(0, 300) * 30 * 60_000_000          # ties on purpose
        s = rng.randrange(1, 16) * H // 2
        rows.append((p, i, _ts(a), s))
    df = spark.createDataFrame(rows, "pool string, pos long, eta timestamp_ntz, svc_us long")
    cap = spark.createDataFrame(list(pools.items()), "pool string, k int")
    got = {r.pos: r.start_us for r in RP.fifo_replay(df, ["pool"], cap).collect()}
    horizon = max(r[2] for r in rows)
    hz = int((horizon - T0).total_seconds()) * 1_000_000 + max(r[3] for r in rows) + 24 * H
    exp = {}
    for p, k in pools.items():
        mine = sorted(((r[1], int((r[2] - T0).total_seconds()) * 1_000_000, r[3]) for r in rows if r[0] == p), key=lambda r: (r[1], r[0]))
        for lane in range(k):                                # every k-th call is served by one berth
            exp.update(_ref_fifo(mine[lane::k], 1))
    epoch = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    exp = {pos: st + epoch for pos, st in exp.items() if st < hz}
    assert got == exp
    # W4 (k = 1 closed form) equals the heap with k = 1
    w4 = {r.pos: r.start_us for r in RP.fifo_one(df, ["pool"]).collect()}
    for p in pools:
        ref = _ref_fifo([(r[1], int((r[2] - T0).total_seconds()) * 1_000_000, r[3]) for r in rows if r[0] == p], 1)
        for pos, st in ref.items():
            assert w4[pos] == st + epoch


def test_scenario_transforms(spark):
    rows = [(i, f"V{i}", T0 + timedelta(hours=3 * i), i) for i in range(8)]
    df = spark.createDataFrame(rows, "call_id long, name string, eta timestamp_ntz, pos long")
    d = SC.wi_densify(df).collect()
    assert len(d) == 15
    extra = sorted((r.eta, r.name) for r in d if r.is_extra)
    assert extra[0] == (T0 + timedelta(hours=1, minutes=30), "V0_EXTRA")
    c = {r.call_id: r.eta for r in SC.wi_closure(df, T0 + timedelta(hours=12)).collect()}
    # closure [12h, 36h): calls at 12h..21h -> 36h10m; 9h (before) unchanged
    assert c[4] == c[7] == T0 + timedelta(hours=36, minutes=10) and c[3] == T0 + timedelta(hours=9)
    c = {r.call_id: r.eta for r in SC.wi_closure(df, T0 - timedelta(hours=6)).collect()}
    # closure [-6h, 18h): 18h (end) is outside
    assert c[6] == T0 + timedelta(hours=18) and c[5] == T0 + timedelta(hours=18, minutes=10)
    late = {r.call_id: r.eta for r in SC.wi_delay(df).collect()}
    assert late[5] == T0 + timedelta(hours=21) and late[4] == T0 + timedelta(hours=12)
    conf = {r.call_id: r.eta for r in SC.wi_conflict(df).collect()}
    assert conf[0] == conf[1] == T0 and conf[2] == T0 + timedelta(hours=6)
    short = spark.createDataFrame(rows[:3], df.schema)
    assert {r.call_id: r.eta for r in SC.wi_delay(short).collect()}[0] == T0 + timedelta(hours=6)


def _ref_repair(rows):
    sched, out = {}, {}
    for pid, pos, cid, b, eta, st, svc in sorted(rows, key=lambda r: (r[0], r[1])):
        st = max(st, eta)
        en = st + svc
        for s0, e0 in sorted(sched.get((pid, b), [])):
            if st < e0 and en > s0:
                st = e0
                en = st + svc
        sched.setdefault((pid, b), []).append((st, en))
        out[(pid, cid)] = st
    return out


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_repair_vs_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        eta = rng.randrange(0, 60) * H
        svc = rng.choice([0, rng.randrange(1, 9) * H, rng.randrange(1, 120) * 60_000_000])
        rows.append((i % 3, rng.randrange(10 ** 6), i, str(rng.randrange(2)), eta, eta + rng.randrange(-3, 6) * H, svc))
    df = spark.createDataFrame([(p, pos, c, b, _ts(e), _ts(s), v) for p, pos, c, b, e, s, v in rows],
                               "plan_id long, pos long, call_id long, berth_id string, eta timestamp_ntz, "
                               "scheduled_start timestamp_ntz, svc_us long")
    exp = {k: _ts(v) for k, v in _ref_repair(rows).items()}
    for split in (False, True):
        got = {(r.plan_id, r.call_id): r.scheduled_start for r in RPR.repair_plans(df, split=split).collect()}
        assert got == exp


def test_admission_vs_loop(spark):
    rng = random.Random(9)
    rows = _rand_res(rng, n_berths=3, n=120)
    df = spark.createDataFrame([(i, b, s, e, rng.randrange(10 ** 6)) for i, b, s, e in rows],
                               "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz, pos long")
    got = {r.call_id: r.accepted for r in RPR.admit(df).collect()}
    reqs = sorted(df.collect(), key=lambda r: r.pos)
    acc, exp = {}, {}
    for r in reqs:
        ok = all(not (r.start_time < e and r.end_time > s) for s, e in acc.get(r.berth_id, []))
        if ok:
            acc.setdefault(r.berth_id, []).append((r.start_time, r.end_time))
        exp[r.call_id] = ok
    assert got == exp


def test_queue_series_vs_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        eta = rng.randrange(0, 48 * 60) * 60_000_000
        st = eta + rng.randrange(-2, 10) * H // 2
        rows.append((i % 2, i, _ts(eta), _ts(st), _ts(st + rng.randrange(1, 6) * H)))
    df = spark.createDataFrame(rows, "plan_id long, call_id long, eta timestamp_ntz, scheduled_start timestamp_ntz, "
                                     "predicted_end timestamp_ntz")
    got = {(r.plan_id, r.timestamp): r.queue_length for r in KP.queue_series(df).collect()}
    for p in (0, 1):
        mine = [r for r in rows if r[0] == p]
        t, end = min(r[2] for r in mine), max(r[4] for r in mine)
        n = 0
        while t <= end:
            assert got[(p, t)] == sum(1 for r in mine if r[2] <= t < r[3]), (p, t)
            t += timedelta(hours=1)
            n += 1
        assert n == sum(1 for k in got if k[0] == p)


def test_schedule_kpis_reference_cases(spark):
    def plan(waits):
        return spark.createDataFrame(
            [(0, i, _ts(0), _ts(int(w * H)), _ts(int(w * H) + 8 * H)) for i, w in enumerate(waits)],
            "plan_id long, call_id long, eta timestamp_ntz, scheduled_start timestamp_ntz, predicted_end timestamp_ntz")
    k = KP.schedule_kpis(plan([2, 4, 6])).collect()[0]
    assert k.avg_wait_hours == 4.0 and k.total_vessels == 3
    assert KP.schedule_kpis(plan([1, 8.5, 3])).collect()[0].max_wait_hours == 8.5
    k = KP.schedule_kpis(plan([0, 0.05, 4, 8])).collect()[0]
    assert k.direct_berth_count == 2 and k.direct_berth_rate == 0.5
    k = KP.schedule_kpis(plan([0.1])).collect()[0]
    assert k.direct_berth_count == 0                                  # 0.1 h is not direct
    t = KP.schedule_totals(plan([1, 3, 5])).collect()[0]
    assert t.total_wait_hours == 9.0 and t.avg_wait_hours == 3.0
    u = KP.berth_utilization(plan([0] * 5), 10, 24.0).collect()[0]
    assert abs(u.utilization - 40 / 240) < 1e-12
    act = spark.createDataFrame([(0, _ts(30 * 60_000_000 + 2 * H)), (1, _ts(4 * H + 5 * H)), (2, _ts(6 * H + H))],
                                "call_id long, actual_time timestamp_ntz")
    a = KP.schedule_accuracy(plan([2, 4, 6]), act).collect()[0]
    assert a.matched == 3 and abs(a.accuracy - 2 / 3) < 1e-12        # 30 min ok, 5 h late, exactly 1 h ok


def test_late_arrivals(spark):
    calls = spark.createDataFrame([(1, _ts(0)), (2, _ts(0)), (3, _ts(0))], "call_id long, eta timestamp_ntz")
    act = spark.createDataFrame([(1, _ts(4 * H)), (2, _ts(H)), (3, _ts(2 * H))], "call_id long, actual_time timestamp_ntz")
    late = {r.call_id: r.is_late for r in KP.late_arrivals(calls, act).collect()}
    assert late == {1: True, 2: False, 3: False}                      # exactly 2 h is not late


def test_to_us_roundtrip(spark):
    df = spark.createDataFrame([(_ts(123_456_789),)], "t timestamp_ntz")
    assert df.select(to_us("t").alias("u")).collect()[0].u == \
        int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 + 123_456_789
    assert df.select(F.col("t")).collect()[0].t == _ts(123_456_789)


def test_empty_plan_and_scenario_report_zeros(spark):
    plan = spark.createDataFrame([(0, 1, _ts(0), _ts(H), _ts(3 * H))],
                                 "plan_id long, call_id long, eta timestamp_ntz, scheduled_start timestamp_ntz, "
                                 "predicted_end timestamp_ntz")
    ids = spark.createDataFrame([(0,), (1,)], "plan_id long")
    k = {r.plan_id: r for r in KP.schedule_kpis(plan, plan_ids=ids).collect()}
    assert k[1].total_vessels == 0 and k[1].avg_wait_hours == 0.0 and k[1].direct_berth_rate == 0.0
    assert k[0].total_vessels == 1 and k[0].avg_wait_hours == 1.0
    cap = spark.createDataFrame([("S1", 2), ("S9", 3)], "scenario string, capacity long")
    rep = spark.createDataFrame([("S1", 0, H, 3 * H)], "scenario string, a_us long, start_us long, end_us long")
    s = {r.scenario: r for r in RP.scenario_kpis(rep, cap).collect()}
    assert s["S9"].served == 0 and s["S9"].utilization == 0.0
    assert s["S1"].served == 1 and s["S1"].avg_wait_hours == 1.0 and s["S1"].utilization == 0.5
    t = {r.scenario: r for r in RP.scenario_table(RP.scenario_kpis(rep, cap)).collect()}
    assert t["S9"].direct_berth_rate_pct == 0.0 and t["S1"].utilization_pct == 50.0


def test_inter_arrivals(spark):
    df = spark.createDataFrame([(i, _ts(i * 3 * H), i) for i in range(4)], "call_id long, eta timestamp_ntz, pos long")
    r = {x.call_id: x for x in SC.inter_arrivals(df).collect()}
    assert r[0].gap_hours == 3.0 and r[0].midpoint == _ts(3 * H // 2) and r[3].next_eta is None


def test_availability_vs_loop(spark):
    rng = random.Random(17)
    rows = _rand_res(rng, n_berths=3, n=60)
    rows += [(300, "0", rows[0][2], rows[0][2])]                       # zero-length reservation
    res = spark.createDataFrame(rows, "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    props = []
    for i in range(150):
        s = _ts(rng.randrange(0, 210 * 60) * 60_000_000)
        props.append((i, str(rng.randrange(3)), s, s + timedelta(minutes=rng.choice([0, 30, 90, 600]))))
    props += [(1000 + j, r[1], r[2], r[3]) for j, r in enumerate(rows[:10])]   # equal starts
    pdf = spark.createDataFrame(props, "call_id long, berth_id string, prop_start timestamp_ntz, prop_end timestamp_ntz")
    got = {r.call_id: r.available for r in IV.is_available(res, pdf).collect()}
    for pid, b, s, e in props:
        exp = not any(rb == b and rs < e and re > s for _, rb, rs, re in rows)
        assert got[pid] == exp, (pid, b, s, e)


def test_repair_beyond_its_component(spark):
    """A long row skips gaps that are too short and ends far beyond its busy period; sparse rows stay apart."""
    rows = [(0, i, i, "0", 10 * i * H, 10 * i * H, 4 * H) for i in range(20)]      # gaps of six hours
    rows += [(0, 20, 20, "0", 0, 0, 7 * H), (0, 21, 21, "0", 45 * H, 45 * H, 6 * H), (0, 22, 22, "0", 46 * H, 0, 7 * H)]
    rows += [(1, i, i, "0", 100 * i * H, 0, H) for i in range(9)]
    df = spark.createDataFrame([(p, pos, c, b, _ts(e), _ts(s), v) for p, pos, c, b, e, s, v in rows],
                               "plan_id long, pos long, call_id long, berth_id string, eta timestamp_ntz, "
                               "scheduled_start timestamp_ntz, svc_us long")
    got = {(r.plan_id, r.call_id): r.scheduled_start for r in RPR.repair_plans(df, split=True).collect()}
    assert got == {k: _ts(v) for k, v in _ref_repair(rows).items()}
    assert got[(0, 20)] == _ts(194 * H)
    assert RPR.repair_plans(df.limit(0), split=True).count() == 0
    lost = df.limit(1).withColumns({"eta": F.lit(None).cast("timestamp_ntz"), "scheduled_start": F.lit(None).cast("timestamp_ntz")})
    assert [r.scheduled_start for r in RPR.repair_plans(lost, split=True).collect()] == [None]
