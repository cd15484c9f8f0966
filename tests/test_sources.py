import json

import pytest
from pyspark.sql import functions as F

from quernstone.sources import generations, ledger


def test_ledger_takes_the_last_record_and_skips_torn_lines(spark, tmp_path):
    rows = [{"path": "a", "sha256": "1", "finished_at": 1.0, "status": "ok"}, {"path": "a", "sha256": "2", "finished_at": 2.0, "status": "ok"}, {"path": "b", "sha256": "3", "finished_at": 1.0, "status": "failed"}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)) + '\n{"path": "c", "sha')
    assert {(r.path, r.sha256) for r in ledger.read_ledger(spark, f"file://{tmp_path}/l.json").collect()} == {("a", "2"), ("b", "3")}


def test_golden_refuses_candidates(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('# note\n{"id": "1", "query": "q", "expected_doc_ids": ["a"]}\n')
    assert [r.id for r in ledger.read_golden(spark, f"file://{tmp_path}/g.jsonl").collect()] == ["1"]
    (tmp_path / "h.jsonl").write_text('{"id": "1", "query": "q", "status": "candidate"}\n')
    with pytest.raises(Exception, match="candidate"):
        ledger.read_golden(spark, f"file://{tmp_path}/h.jsonl").collect()


def test_walk_infers_labels_from_four_parts(spark, tmp_path):
    for p in ("ibm/zos/v2/a.pdf", "loose/b.pdf", ".hidden/x/y/c.pdf", "ibm/zos/v2/d.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    assert {(r.relpath, r.vendor, r.version) for r in ledger.walk(spark, str(tmp_path)).collect()} == {("ibm/zos/v2/a.pdf", "ibm", "v2"), ("loose/b.pdf", None, None)}


def test_export_round_trip():
    data = ledger.export([{"id": 1}], [{"id": 1, "rating": "good"}])
    assert [len(x) for x in ledger.parse_export(data)] == [1, 1]
    with pytest.raises(ValueError):
        ledger.parse_export(data.replace(b"good", b"bad."))


def test_generations_swap_upsert_and_delete(spark, tmp_path):
    table = generations.Generations(spark, f"file://{tmp_path}/t", "id")
    assert table.current() is None
    table.publish(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    old = table.current()
    table.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"))
    assert sorted(map(tuple, table.current().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, old.collect())) == [(1, "a"), (2, "b")]
    table.delete(F.col("id") == 1)
    assert sorted(r.id for r in table.current().collect()) == [2, 3]


def test_streaming_sinks_keep_first_and_latest(spark, tmp_path):
    from quernstone.streaming import feedback

    first, last = generations.Generations(spark, f"file://{tmp_path}/a", "k"), generations.Generations(spark, f"file://{tmp_path}/b", "k")
    batches = [[("x", 5, "one")], [("x", 3, "two"), ("y", 1, "three")], [("x", 9, "four")]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k string, at int, v string")
        feedback.insert_once(first)(df, n)
        feedback.latest_rating(last, "at")(df, n)
    assert {(r.k, r.v) for r in first.current().collect()} == {("x", "one"), ("y", "three")}
    assert {(r.k, r.v) for r in last.current().collect()} == {("x", "four"), ("y", "three")}


def test_entry_registers_every_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "hybrid_search_benchmark" in names and set(entry.oracle_sql()) <= set(names)
