"""Cleaning edge cases and the berth dimension of a small port document."""

import pytest
from pyspark.sql import functions as F

from berthwise import schema as S
from berthwise.operators import berths as BR
from berthwise.operators import cleaning as CL
from berthwise.operators import eligibility as EL
from berthwise.operators import vessels as VS
from berthwise.sources.io import read_port_doc
from tests.conftest import PORT_DOC


def _raw(spark, rows):
    cols = [S.DATE_ARRIVAL, S.TIME_ARRIVAL, S.DATE_BERTHING, S.TIME_BERTHING, S.DATE_UNBERTHING,
            S.TIME_UNBERTHING, S.DATE_ANCHORAGE_IN, S.STAY_QUAY_DAYS, S.BERTH_ID]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_reference_raw_call(spark):
    # arrival 01/06 08:00, berthing 10:00, unberthing 02/06 08:00, anchorage set, berth " 70 "
    df = _raw(spark, [("01/06/2024", "08:00", "01/06/2024", "10:00", "02/06/2024", "08:00",
                       "01/06/2024", None, " 70 ")])
    r = CL.clean_calls(df).collect()[0]
    assert r[S.WAITING_HOURS] == 2.0
    assert r[S.SERVICE_HOURS] == 22.0
    assert r[S.ANCHORAGE_FLAG] == 1
    assert r[S.BERTH_ID] == "70"
    assert r[S.ARRIVAL_DOW] == 5 and r[S.ARRIVAL_MONTH] == 6   # 2024-06-01 is a Saturday


def test_service_fallback_and_bounds(spark):
    rows = [
        # zero diff -> "3,5" days -> 84 h
        ("01/06/2024", "08:00", "01/06/2024", "10:00", "01/06/2024", "10:00", None, "3,5", "1"),
        # negative wait clipped to 0; service exactly 0.5 h kept
        ("01/06/2024", "12:00", "01/06/2024", "10:00", "01/06/2024", "10:30", None, None, "2"),
        # service exactly 720 h kept
        ("01/06/2024", "08:00", "01/06/2024", "08:00", "01/07/2024", "08:00", None, None, "3"),
        # 721 h dropped; nan date dropped; 25:00 dropped
        ("01/06/2024", "08:00", "01/06/2024", "08:00", "01/07/2024", "09:00", None, None, "4"),
        ("nan", "nan", "01/06/2024", "08:00", "01/06/2024", "09:00", None, None, "5"),
        ("01/06/2024", "25:00", "01/06/2024", "08:00", "01/06/2024", "09:00", None, None, "6"),
        # ISO text read as ISO, not day-first
        ("2024-06-01", "08:00", "2024-06-01", "09:00", "2024-06-02", "09:00", None, None, "7"),
    ]
    out = {r[S.BERTH_ID]: r for r in CL.clean_calls(_raw(spark, rows)).collect()}
    assert set(out) == {"1", "2", "3", "7"}
    assert out["1"][S.SERVICE_HOURS] == 84.0
    assert out["2"][S.WAITING_HOURS] == 0.0 and out["2"][S.SERVICE_HOURS] == 0.5
    assert out["3"][S.SERVICE_HOURS] == 720.0
    assert out["7"][S.ARRIVAL_MONTH] == 6 and out["7"][S.SERVICE_HOURS] == 24.0


def test_waiting_keeps_null(spark):
    df = _raw(spark, [(None, None, "01/06/2024", "10:00", "02/06/2024", "08:00", None, None, "1")])
    r = CL.with_waiting_hours(CL.with_event_times(df)).collect()[0]
    assert r[S.WAITING_HOURS] is None



def _port_id(berths):
    """The document's single port key (test-side lookup)."""
    return berths.select("port_id").first()[0]


@pytest.fixture(scope="module")
def berths(spark):
    return BR.build_berths(read_port_doc(spark, PORT_DOC)).cache()


def test_berth_dimension(berths):
    rows = {r.berth_id: r for r in berths.orderBy("ordinal").collect()}
    assert list(rows) == ["B1", "B2", "20", "90", "30", "31", "32", "33", "34", "35", "36", "Z9"]
    got = lambda b: (rows[b].terminal_name, rows[b].quay_length_m, rows[b].depth_m, rows[b].operator)
    assert got("B1") == got("B2") == ("Box Quay", 350.0, 12.5, "Boxes Ltd")        # leading numbers, trimmed ids
    assert got("20") == ("Bulk Quay", 300.0, 10.5, "UNKNOWN")                      # empty specs: the berth's fallback
    assert got("90") == ("Bulk Quay", 0.0, 0.0, "UNKNOWN")
    assert got("30")[0] == "Bulk Quay" and got("31")[1:3] == (1500.0, 9.0)         # a range member with and without terminal
    assert got("Z9") == ("UNKNOWN", 0.0, 0.0, "UNKNOWN")
    assert rows["B2"].allowed_cargos == ["Containers", "Ro-Ro"] and rows["B2"].allowed_types == ["RO RO"]


def test_terminal_capacity(berths):
    caps = {r.terminal_name: r.n_berths for r in BR.terminal_capacity(berths).collect()}
    assert caps["Box Quay"] == 2 and caps["Bulk Quay"] == 3


def _call(port, i, draft, length, cargo):
    return (port, i, f"V{i}", "VRAQUIER", 0, length, draft, cargo, "", 0.0, 0.0, 1, 6, 5, None, False)


def test_eligibility_and_reasons(spark, berths):
    port = _port_id(berths)
    calls = spark.createDataFrame([_call(port, 1, 12.0, 200.0, "Containers"), _call(port, 2, 13.0, 100.0, "Grains"),
                                   _call(port, 3, 8.0, 100.0, "Grains")], S.CALL_SCHEMA)
    elig = EL.eligible_pairs(calls, berths)
    got = {r.call_id: sorted(r.eligible_berths) for r in EL.eligibility_summary(calls, elig).collect() if r.eligible_count}
    assert got[1] == ["B1"] and got[3][0] == "20" and 2 not in got
    assert {r.call_id: r.terminal_name for r in EL.attribute_terminal(elig).collect()}[1] == "Box Quay"
    why = {r.berth_id: r for r in EL.berth_violations(calls.filter("call_id = 2"), berths).collect()}
    assert why["20"].reason_code == "depth" and why["20"].reason == "Depth 10.5m < vessel draft 13.0m"
