"""Streams drained through files."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quernstone.plans import streams

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture
def events(spark, tmp_path):
    """Users with two events within an hour, one long after."""
    data = [(i, T0 + datetime.timedelta(minutes=m), i // 3, "view", 1.0, "{}") for i, m in enumerate([0, 59, 300] * 120)]
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    pq.write_table(pa.table(dict(zip(names, zip(*data, strict=True), strict=True))), tmp_path / "events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(("run", "want"), [(streams.stream_sessions, [(1, 120), (2, 120)]), (streams.stream_first_answers, None)])
def test_streams_pass_nothing_through_the_driver(spark, events, run, want):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    df = run(spark, events)
    assert "parquet" in df._jdf.queryExecution().optimizedPlan().toString() and not [t for t in spark.catalog.listTables() if t.name.startswith("drained_")]
    assert spark.conf.get(key, None) == before
    got = sorted(tuple(r) for r in df.collect())
    assert got == (want or [(u, "view") for u in range(120)])
