"""Fixture views against their SQL on rows that the supplied tables lack."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrame

from brindle.plans import catalog, sources
from brindle.sources import fixtures as X


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_of_events_count_as_in_sql(spark, tmp_path, zone):
    """Half seconds before a span's end, and days before the first one."""
    times = ["2024-01-03T23:59:59.400000", "2024-01-03T23:59:59.500000", "2024-01-03T23:59:59.600000", "2024-01-04T00:00:00.500000", "2024-01-06T22:00:00", "2023-12-31T23:59:59.700000", "2023-12-27T12:00:00", "2024-01-01T00:00:00"]
    ts = pa.array([dt.datetime.fromisoformat(t) for t in times], pa.timestamp("us"))
    n = len(times)
    pq.write_table(pa.table({"event_id": list(range(n)), "ts": ts, "user_id": [7] * n, "event_type": [f"e{i}" for i in range(n)], "value": [float(i) for i in range(n)]}), f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    names = "trajectory_id, position, node_id, action_id, outcome"
    want = con.execute(f"WITH {X.TRANSITIONS} SELECT {names} FROM walk").fetchall()
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = X.transitions(spark, str(tmp_path)).select(*names.split(", ")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["prereg_rules", "component_table_ci"])
def test_states_are_made_once(spark, monkeypatch, name):
    made, states = [], X.states
    monkeypatch.setattr(X, "states", lambda *a: made.append(a) or states(*a))
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_guards_read_written_tables(spark, monkeypatch):
    read = []
    monkeypatch.setattr(sources, "_raises", lambda check: read.extend(c.cell_contents for c in check.__closure__ or ()) or False)
    sources.guard_verdicts(spark, "/root/testdata/sf0.001")
    tables = [x for x in read if isinstance(x, DataFrame)]
    whole = [x for x in tables if "mass_capture" in x.columns or "source_id" in x.columns or "target" in x.columns]
    assert whole and not any("/sf0.001/" in f for x in whole for f in x.inputFiles())


def test_events_without_values_and_runs_of_one_number_count_as_in_sql(spark, tmp_path):
    """Missing times, numbers and types, and users whose numbers are so far
    apart that their runs meet in a trajectory."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=i // 2), 5, f"e{i}", float(i)) for i in range(12)]
    rows += [(None, start, 5, "late", 1.0), (50, start, 5, None, 1.0), (60, start + dt.timedelta(hours=1), 5, None, 2.0)]
    rows += [(100 + i, start + dt.timedelta(minutes=i), 1_000_005, f"far{i}", 30.0) for i in range(4)]
    rows += [(200 + i, None if i == 1 else start + dt.timedelta(minutes=i), 9, f"n{i}", None) for i in range(3)]
    names = ["event_id", "ts", "user_id", "event_type", "value"]
    kinds = [pa.int64(), pa.timestamp("us"), pa.int64(), pa.string(), pa.float64()]
    pq.write_table(pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}), f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = "trajectory_id, position, node_id, action_id, outcome"
    want = con.execute(f"WITH {X.TRANSITIONS} SELECT {found} FROM walk").fetchall()
    got = X.transitions(spark, str(tmp_path)).select(*found.split(", ")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
