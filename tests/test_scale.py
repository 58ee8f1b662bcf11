"""Steps that must not grow with levels, slots or pairs, each against the plain form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from berthwise.operators import intervals as IV
from berthwise.plans import repair as RPR

T0 = datetime(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _windows(rng, n):
    at = lambda m: None if rng.random() < .05 else T0 + timedelta(minutes=m)
    out = []
    for i in range(n):
        s = rng.randrange(2000)
        out.append((None if rng.random() < .05 else i // 2, rng.choice(["A", "B", None]), at(s), at(s + rng.choice([-5, 0, 1, 30, 900]))))
    return out


def test_availability_without_cells(spark):
    rng = random.Random(4)
    res, asked = _windows(rng, 25), _windows(rng, 80)
    r = spark.createDataFrame(res, "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    p = spark.createDataFrame(asked, "call_id long, berth_id string, prop_start timestamp_ntz, prop_end timestamp_ntz")
    out = IV.is_available(r, p)
    assert "Generate" not in _plan(out)         # no interval becomes a row per level
    hit = {c for c, b, s, e in asked if c is not None and None not in (b, s, e) and any(
        b == rb and None not in (rs, re) and rs < e and re > s for _, rb, rs, re in res)}
    got = [(x.call_id, x.available) for x in out.collect()]
    assert len(got) == len(asked) and all(ok == (c not in hit) for c, ok in got)
    assert {ok for _, ok in got} == {True, False}


def test_conflicts_do_not_broadcast_cells(spark):
    res = spark.createDataFrame([(1, "A", T0, T0 + timedelta(days=900)), (2, "A", T0 + timedelta(days=1), T0 + timedelta(days=2))],
                                "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    out = IV.find_conflicts(res)
    assert "Broadcast" not in _plan(out)
    assert [(r.call_id_a, r.call_id_b) for r in out.collect()] == [(1, 2)]


def _scan(rows):
    """First fit, slot by slot."""
    slots, put = [], []
    for at, dur in rows:
        for s, e in sorted(slots):
            if at < e and at + dur > s:
                at = e
        slots.append((at, at + dur))
        put.append(at)
    return put


def test_first_fit_skips_chunks(monkeypatch):
    monkeypatch.setattr(RPR, "_CHUNK", 3)
    for seed in range(40):
        rng = random.Random(seed)
        rows = [(rng.randrange(rng.choice([8, 200])), rng.randrange(9)) for _ in range(60)]
        free = RPR._Free()
        assert [free.take(at, dur) for at, dur in rows] == _scan(rows)
        assert len(free.first) > 5


@pytest.mark.parametrize("seed,cell", [(21, 100_000), (22, 40)])
def test_earliest_slot_without_pairs(spark, monkeypatch, seed, cell):
    """As over eligible pairs, with nulls, ties and several blocks of time; no join of calls with berths."""
    from berthwise.operators import dominance as DM
    from berthwise.operators import eligibility as EL
    from berthwise.operators import intervals as IV
    from berthwise.plans import dispatch as DP
    from tests.test_dominance import BERTHS, CALLS, _random
    monkeypatch.setattr(DM, "CELL_QUERIES", cell)
    rng = random.Random(seed)
    calls, berths = _random(rng, 150, 30)
    berths = [(*b[:3], None if b[3] == 7 else b[3], *b[4:]) for b in berths]
    base = datetime(2024, 1, 1)
    etas = [(c[0], c[1], None if rng.random() < .1 else base + timedelta(minutes=rng.randrange(3000))) for c in calls]
    res = [(i, rng.choice("AB"), str(rng.randrange(32)), base + timedelta(minutes=(m := rng.randrange(3000))), base + timedelta(minutes=m + rng.randrange(1, 90)))
           for i in range(400)]
    c, b = spark.createDataFrame(calls, CALLS), spark.createDataFrame(berths, BERTHS)
    e = spark.createDataFrame(etas, "port_id string, call_id long, eta timestamp_ntz")
    res = spark.createDataFrame(res, "call_id long, port_id string, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    elig = EL.eligible_pairs(c, b)
    for key in ("berth_id", "_berth"):
        isl = IV.merge_busy(res.withColumn("_berth", DP.berth_key()), key=key)
        want = DP.earliest_slot(elig.withColumn("_berth", DP.berth_key()), e, isl, key=key)
        got = DP.earliest_eligible(c, b, isl, e, key=key)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert "_b_port" not in got._jdf.queryExecution().analyzed().toString()


def test_starts_by_halves():
    """Points that change within the queries' time, halved down to few pairs, against a loop."""
    import numpy as np
    import pyarrow as pa
    from berthwise.operators import cells as CE
    rng = random.Random(24)
    n, m = 25, 60
    taken = []
    for _ in range(n):
        cuts = sorted(rng.sample(range(1000), 2 * rng.randrange(6)))
        taken.append([{"from": a, "to": z} for a, z in zip(cuts[::2], cuts[1::2])])
    xs, ys = [float(rng.randrange(6)) for _ in range(n)], [float(rng.randrange(6)) for _ in range(n)]
    asked = [(float(rng.randrange(6)), float(rng.randrange(6)), rng.randrange(1000)) for _ in range(m)]
    table = pa.table({"_x": xs, "_y": ys, "_turn": pa.array(range(n), pa.int32()),
                      "_taken": pa.array(taken, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))})

    def loop(x, y, t):
        fits = [(next((s["to"] for s in taken[i] if s["from"] <= t < s["to"]), t), i) for i in range(n) if xs[i] >= x and ys[i] >= y]
        return min(fits, default=(None, -1))
    kept = CE.PAIRS
    try:
        for CE.PAIRS in (0, 10, 1 << 20):
            spot, start = CE.Berths(table).starts(*(np.array(c) for c in zip(*asked)))
            for q, s, at in zip(asked, spot, start):
                assert loop(*q) == (int(at) if s >= 0 else None, int(s))
    finally:
        CE.PAIRS = kept


def test_offline_windows_are_judged_once(spark):
    """The admission reads the tested windows from storage: its plan tests none of them again."""
    res = spark.createDataFrame(_windows(random.Random(31), 60), "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    _, judged = RPR.take_offline(res, res.withColumnRenamed("call_id", "window_id").select("window_id", "berth_id", "start_time", "end_time"))
    assert "_clash" not in judged._jdf.queryExecution().optimizedPlan().toString()
    assert judged.count() == 60


def test_release_finds_the_last_slot_of_a_call():
    """A release looks at its call's slots alone, empty ones and those of equal start among them."""
    from berthwise.streaming.timeline import Slots
    rng = random.Random(32)
    slots, plain = Slots(), []
    for t in range(3000):
        call, s = rng.randrange(40), rng.randrange(400)
        if rng.random() < .5:
            e = s + rng.randrange(4)
            if slots.apply(0, "assign", call, s, e) is None:
                plain = sorted([*plain, (s, e, call)], key=lambda r: r[:2])
        else:
            mine = [r for r in plain if r[2] == call]
            assert (slots.apply(0, "release", call, None, None) is None) == bool(mine)
            if mine:
                plain.remove(mine[-1])
        assert sorted(slots.rows()) == sorted(plain)
    slots.apply(0, "assign", 99, 10_000, 10_001)
    for _ in range(50_000 - len(slots.calls)):
        slots.apply(0, "offline", None, 20_000 + 2 * len(slots.calls), 20_001 + 2 * len(slots.calls))
    began = datetime.now()
    for _ in range(2000):
        assert slots.apply(0, "release", 12345, None, None) == "unknown call"
    assert datetime.now() - began < timedelta(seconds=1)


@pytest.mark.parametrize("seed", [41, 42])
def test_eligible_free_without_instants(spark, monkeypatch, seed):
    """As the anti-join of all pairs, with nulls, rows that come twice, several blocks; no pair goes through a shuffle."""
    from berthwise.operators import eligibility as EL
    from berthwise.plans import dispatch as DP
    from tests.test_dominance import BERTHS, CALLS, _random
    monkeypatch.setattr(DP, "BLOCK_CALLS", 30)
    rng = random.Random(seed)
    calls, berths = _random(rng, 120, 25)
    c, b = spark.createDataFrame(calls + calls[:4], CALLS), spark.createDataFrame(berths + berths[:3], BERTHS)
    e = spark.createDataFrame([(x[1], None if rng.random() < .1 else T0 + timedelta(minutes=rng.randrange(2000))) for x in calls],
                              "call_id long, eta timestamp_ntz")
    rows = [(i, str(rng.randrange(27)), *w[2:]) for i, w in enumerate(_windows(rng, 150))]
    res = spark.createDataFrame(rows, "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    elig = EL.eligible_pairs(c, b).join(e.withColumnRenamed("eta", "t"), "call_id")
    occ = IV.occupancy_at(res, elig.select("t", "berth_id").distinct(), per_key=True)
    want = IV.eligible_free(elig, occ).select("port_id", "call_id", "berth_id")
    got = DP.eligible_free(c, b, res, e)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    top = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "Join Inner" in "".join(top[:2]) and "LeftAnti" not in "".join(top)


@pytest.mark.parametrize("seed,sizes", [(43, (1000, 1000, 1000)), (44, (20, 2, 4)), (45, (3, 1000, 3)), (46, (500, 1, 1000))])
def test_eligible_free_compares_in_cells(spark, monkeypatch, seed, sizes):
    """Calls meet berths of their list entries alone, by comparisons compiled with the join; against a loop, however many blocks, parts and
    bands there are.  Berths list a cargo twice or both of a call's, keys are null or come twice, some calls have no cargo, type or eta."""
    from berthwise.plans import dispatch as DP
    from tests.test_dominance import BERTHS, CALLS, _random
    for name, value in zip(("BLOCK_CALLS", "CELL_BERTHS", "BAND_BERTHS"), sizes):
        monkeypatch.setattr(DP, name, value)
    rng = random.Random(seed)
    calls, berths = _random(rng, 90, 30)
    calls, berths = calls + calls[:3], berths + berths[:2] + [(*b[:6], ["oil", "grain", "oil"], b[7]) for b in berths[5:15]]
    at = {c[1]: None if rng.random() < .1 else T0 + timedelta(minutes=rng.randrange(2000)) for c in calls}
    res = [(i, None if rng.random() < .05 else str(rng.randrange(33)), *w[2:]) for i, w in enumerate(_windows(rng, 120))]
    c, b = spark.createDataFrame(calls, CALLS), spark.createDataFrame(berths, BERTHS)
    e = spark.createDataFrame([*at.items()], "call_id long, eta timestamp_ntz")
    r = spark.createDataFrame(res, "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    got = DP.eligible_free(c, b, r, e)

    def fits(call, berth):
        port, i, kind, length, draft, *cargos = call
        where, name, _, _, quay, depth, takes, kinds = berth
        cargos = {x for x in cargos if x not in (None, "", "nan")}
        takes, kinds = ({x for x in v or () if x is not None} for v in (takes, kinds))
        return (port is not None and port == where and None not in (length, draft, quay, depth) and depth >= draft and quay >= length
                and (not takes or not cargos or bool(takes & cargos)) and (not kinds or kind in kinds)
                and not any(k == name and None not in (k, s, z, at[i]) and s <= at[i] < z for _, k, s, z in res))
    want = [(x[0], x[1], y[1]) for x in calls for y in berths if fits(x, y)]
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == sorted(want)
    join = [x for x in _plan(got).split("Initial Plan")[0].splitlines() if "SortMergeJoin" in x and "_depth" in x]
    assert len(join) == 1 and "*(" in join[0].split("SortMergeJoin")[0] and "lambda" not in join[0] and "port_id" not in join[0]
    pairs = next(x for x in got._jdf.queryExecution().analyzed().toString().splitlines() if "Join Inner" in x)
    assert "_cell" in pairs and "exists" not in pairs


def test_berths_of_other_lists_are_not_met(spark):
    """A call and a berth share a list entry just where the cargo and type rules let them, and the first of several counts once."""
    from berthwise.operators import eligibility as EL
    from tests.test_dominance import BERTHS, CALLS, _random
    calls, berths = _random(random.Random(47), 60, 60)
    c, b = EL._prep_calls(spark.createDataFrame(calls, CALLS)), EL._prep_berths(spark.createDataFrame(berths, BERTHS))
    met = EL.call_entries(c).select(*EL.ENTRY, "_but", "call_id").join(EL.berth_entries(b).select(*EL.ENTRY, "_listed", "berth_id"), EL.ENTRY)
    got = [tuple(r) for r in met.filter(EL.first_entry()).select("call_id", "berth_id").collect()]
    want = [tuple(r) for r in c.crossJoin(b).filter(EL.cargo_ok() & EL.type_ok()).select("call_id", "berth_id").collect()]
    assert met.count() > len(want) and sorted(got) == sorted(want)


def test_conflicts_show_instants_once_per_reservation(spark):
    """Texts come from the sides of the join, and a long interval lies in cells shorter than itself: few candidates miss."""
    rng = random.Random(51)
    rows = [(c, b, s, e) for c, b, s, e in _windows(rng, 120)] + [(900 + i, "A", T0, T0 + timedelta(days=40 * i)) for i in range(3)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    res = spark.createDataFrame(rows, "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    out = IV.find_conflicts(res, shown=lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    top = _plan(out).split("SortMergeJoin")[0]
    assert "date_format" not in top and "date_format" in _plan(out)
    want = [(b, min(i, j), max(i, j), str(max(s, s2)), str(min(e, e2))) for i, b, s, e in rows for j, b2, s2, e2 in rows
            if i < j and b is not None and b == b2 and None not in (s, e, s2, e2) and s < e2 and e > s2]
    assert len(want) > 100 and sorted(map(tuple, out.collect())) == sorted(want)
    plain = [(r.call_id_a, r.call_id_b, str(r.overlap_start), str(r.overlap_end)) for r in IV.find_conflicts(res).collect()]
    assert sorted(plain) == sorted(w[1:] for w in want)
    cells = IV.in_cells(spark.createDataFrame([(0, 25 * 10 ** 10)], "s long, e long"), "s", "e", finer=2)
    assert 3 <= cells.select("_cell").distinct().count() <= 5 and cells.select("_level").distinct().count() == 1


@pytest.mark.parametrize("seed", [61, 62])
def test_replay_tasks_follow_the_calls(spark, monkeypatch, seed):
    """Queues of several berths over many blocks against a loop, nulls among the calls; one shuffle, in as many tasks as the calls ask for."""
    from berthwise.operators import replay as RP
    from berthwise.operators import scan as SN
    monkeypatch.setattr(RP, "ROWS_PER_BLOCK", 9)
    monkeypatch.setattr(RP, "ROWS_PER_TASK", 20)
    rng = random.Random(seed)
    size = {"A": 1, "B": 2, "C": 5}
    rows = [(i, rng.choice(["A", "B", "C", "D", None]), None if rng.random() < .05 else T0 + timedelta(minutes=rng.randrange(900)), rng.randrange(40) * 60_000_000)
            for i in range(300)]
    calls = spark.createDataFrame(rows, "pos long, pool string, eta timestamp_ntz, svc_us long")
    out = RP.fifo_replay(calls, ["pool"], spark.createDataFrame(list(size.items()), "pool string, k int"))
    assert "REPARTITION_BY_NUM" in _plan(out) and f", {SN.shares(calls, 300, 20)})" in _plan(out) and SN.shares(calls, 300, 20) == 15
    want = {}
    for p, k in size.items():
        free = [datetime.min] * k
        for n, (pos, _, eta, svc) in enumerate(sorted((r for r in rows if r[1] == p and r[2]), key=lambda r: (r[2], r[0]))):
            start = max(eta, free[n % k])
            want[pos] = (n % k, start)
            free[n % k] = start + timedelta(microseconds=svc)
    last = max(r[2] for r in rows if r[2]) + timedelta(microseconds=max(r[3] for r in rows)) + timedelta(hours=24)
    assert {r.pos: (r.lane, r.start_time) for r in out.collect()} == {p: x for p, x in want.items() if x[1] < last}


def test_scenarios_without_sorting_for_first_calls(spark):
    """No task sorts its calls to find a list's first ones, and the scenarios aren't stored."""
    from berthwise.operators import scenarios as SC
    from berthwise.plans import workflows as WF
    calls = spark.createDataFrame([(i, "E", "A", T0 + timedelta(minutes=7 * i % 50), 60_000_000, i) for i in range(40)],
                                  "call_id long, name string, pool string, eta timestamp_ntz, svc_us long, pos long")
    names = [(n, "A", 2) for n in SC.SCENARIOS]
    kpis = WF.compare_scenarios(calls, spark.createDataFrame(names, "scenario string, pool string, k int"), "2024-01-01 00:10:00")["kpis"]
    assert {r.scenario: r.served for r in kpis.collect()}["S2_Congestion"] == 79
    plan = _plan(kpis)
    assert "WindowGroupLimit" not in plan and "TakeOrderedAndProject" in plan


def test_block_numbers_of_crowded_cells(spark):
    """Cells with no, one and many bounds."""
    import bisect
    from berthwise.operators.scan import block_of
    rng = random.Random(63)
    for bounds in (sorted({rng.randrange(1000) for _ in range(60)}), sorted({rng.randrange(40) for _ in range(25)} | {10 ** 15, -10 ** 15})):
        ids = spark.createDataFrame([(b + k,) for b in [*bounds, 500] for k in (-1, 0, 1)], "id long")
        rows = ids.select("id", block_of(F.col("id"), bounds).alias("b")).collect()
        assert all(r.b == bisect.bisect_right(bounds, r.id) for r in rows)
