"""Interval joins on dyadic cells, for intervals of nothing to decades, and scans cut at quantiles, against loops."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from berthwise.operators import intervals as IV
from berthwise.operators import scan

T0 = datetime(1969, 12, 1)
RES = "call_id long, berth_id string, start_time timestamp_ntz, end_time timestamp_ntz"


def _intervals(r, n):
    out = []
    for i in range(n):
        s = T0 + timedelta(minutes=r.randrange(0, 60 * 24 * 400), microseconds=r.choice([0, 0, 1, 999_999]))
        out.append((i, r.choice("AB"), s, s + timedelta(microseconds=r.choice([0, 1, 10**6, 6 * 10**7, 10**10, 10**12, 3 * 10**14, 10**15]) * r.choice([0, 1, 1, 3]))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_joins_of_any_length(spark, seed):
    r = random.Random(seed)
    rows = _intervals(r, 120)
    res = spark.createDataFrame(rows, RES)
    cells = IV.in_cells(IV._us(res), "_s", "_e")
    assert max(x["count"] for x in cells.groupBy("call_id").count().collect()) <= 2 and cells.select("call_id").distinct().count() == 120
    got = {(x.call_id_a, x.call_id_b) for x in IV.find_conflicts(res).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and a[3] > b[2]}
    times = [T0 + timedelta(hours=7 * i) for i in range(0, 2000, 40)] + [x[2] for x in rows[:10]] + [x[3] for x in rows[:10]]
    inst = spark.createDataFrame([(t,) for t in set(times)], "t timestamp_ntz")
    got = {(x.t, x.berth_id): (x.n_active, x.call_id) for x in IV.occupancy_at(res, inst).collect()}
    want = {}
    for t in set(times):
        for b in "AB":
            on = [x for x in rows if x[1] == b and x[2] <= t < x[3]]
            if on:
                want[t, b] = (len(on), min(on, key=lambda x: (x[2], x[0]))[0])
    assert got == want
    asked = [(i, b, s, e) for i, b, s, e in _intervals(random.Random(seed + 50), 80)]
    free = IV.is_available(res, spark.createDataFrame(asked, "call_id long, berth_id string, prop_start timestamp_ntz, prop_end timestamp_ntz"))
    assert {x.call_id: x.available for x in free.collect()} == {
        i: not any(x[1] == b and x[2] < e and x[3] > s for x in rows) for i, b, s, e in asked}
    assert IV.find_conflicts(res.limit(0)).collect() == [] and IV.occupancy_at(res.limit(0), inst).collect() == []


def test_next_slot_beside_long_islands(spark):
    r = random.Random(9)
    rows = [x for x in _intervals(r, 60) if x[2] < x[3]]
    isl = IV.merge_busy(spark.createDataFrame(rows, RES))
    held = {}
    for x in isl.collect():
        held.setdefault(x.berth_id, []).append((x.island_start, x.island_end))
    probes = [(i, r.choice("ABC"), T0 + timedelta(hours=r.randrange(0, 24 * 500))) for i in range(300)] + [(900, None, T0), (901, "A", None)]
    got = {x.pid: (x.berth_id, x.t, x.next_free) for x in IV.next_slot(isl, spark.createDataFrame(probes, "pid long, berth_id string, t timestamp_ntz")).collect()}
    for pid, b, t in probes:
        over = [e for s, e in held.get(b, []) if t is not None and s <= t + timedelta(minutes=1) and e > t]
        assert got[pid] == (b, t, max(over) if over else t) and len(over) <= 1


@pytest.mark.parametrize("how", ["burst", "even", "few"])
def test_blocks_follow_the_rows(spark, how):
    """About equal blocks however the rows lie in time; carry rows of a key are at most as many as blocks."""
    r = random.Random(1)
    us = {"burst": [10**15 + r.randrange(10**6) for _ in range(4000)] + [r.randrange(2 * 10**15) for _ in range(100)],
          "even": [r.randrange(-10**15, 10**15) for _ in range(4000)], "few": [5, 5, 5]}[how]
    df = spark.createDataFrame([(i % 2, x, i) for i, x in enumerate(us)] + [(0, None, -1)], "k int, us bigint, i bigint")
    bounds = scan.block_bounds(df, "us", 16)
    assert bounds == sorted(set(bounds)) and len(bounds) < 16
    got = df.select("us", scan.block_of(F.col("us"), bounds).alias("b")).where("us is not null").collect()
    assert all(x.b == bisect.bisect_right(bounds, x.us) for x in got)
    if how != "few":
        sizes = [sum(x.b == b for x in got) for b in range(len(bounds) + 1)]
        assert max(sizes) < 3 * len(got) / 16
    out = scan.running(scan.in_blocks(df.where("us is not null"), "us"), ["k"], "_bkt", ["us", "i"], "i", "top").collect()
    best = {}
    for x in sorted(out, key=lambda x: (x.us, x.i)):
        best[x.k] = max(best.get(x.k, -1), x.i)
        assert x.top == best[x.k]
    carry = scan._carry(scan.in_blocks(df.where("us is not null"), "us"), ["k"], "_bkt", "i", F.max, "c")
    assert carry.count() <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_islands_of_rows_that_come_twice(spark):
    """Equal rows stay in one island whatever order they are sorted in."""
    rng = random.Random(71)
    rows = [(i, str(rng.randrange(20)), T0 + timedelta(minutes=(m := rng.randrange(40_000))), T0 + timedelta(minutes=m + rng.randrange(1, 200)))
            for i in range(1500)] * 3
    want = []
    for _, berth, s, e in sorted(rows, key=lambda r: r[1:]):
        if want and want[-1][0] == berth and s <= want[-1][2]:
            want[-1] = (berth, want[-1][1], max(want[-1][2], e), want[-1][3] + 1)
        else:
            want.append((berth, s, e, 1))
    for _ in range(3):
        rng.shuffle(rows)
        res = spark.createDataFrame(rows, RES)
        assert sorted(map(tuple, IV.merge_busy(res, gap_seconds=0).collect())) == want
