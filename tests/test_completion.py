"""A manifest's two phases, and what a crash between them leaves."""

import pytest

from quernstone.plans import certificates
from quernstone.sources import completion as C

DATA = "/root/testdata/sf0.001"
OLD, NEW = {"embed_mode": "hash", "dense_dim": 256}, {"embed_mode": "hash", "dense_dim": 512}
NONE = "doc_id long, source_rev string, problem string"


def test_a_crash_between_begin_and_commit_leaves_the_old_generation(spark, tmp_path):
    m, nothing = C.Manifest(spark, str(tmp_path)), spark.createDataFrame([], NONE)
    assert m.serving() is None and m.begin(OLD) == "pending" and m.serving() is None
    with pytest.raises(RuntimeError, match="isn't pending"):
        m.commit(NEW, "g0", nothing)
    m.commit(OLD, "g1", nothing)
    assert m.serving() == "g1" and m.begin(OLD) == "already_current"
    assert m.begin(OLD | {"dense_query_prefix": "q:"}) == "committed" and m.serving() == "g1"
    assert m.begin(NEW) == "pending"
    again = C.Manifest(spark, str(tmp_path))  # the run that began it is gone
    assert again.serving() == "g1" and again.begin(NEW) == "pending" and again.serving() == "g1"
    with pytest.raises(RuntimeError, match="not complete: count"):
        again.commit(NEW, "g2", spark.createDataFrame([(1, "r", "count")], NONE))
    assert again.serving() == "g1"
    again.commit(NEW, "g2", nothing)
    assert again.serving() == "g2"
    with pytest.raises(RuntimeError, match="isn't pending"):
        again.commit(NEW, "g3", nothing)


def test_outcomes():
    assert C.outcome(OLD, OLD) == "compatible" and C.outcome(OLD, NEW) == "reembed_required" and C.outcome(OLD, OLD | {"dense_query_prefix": "x"}) == "record_only_drift"
    assert C.digest_of({"a": 1, "b": 2}) == C.digest_of({"b": 2, "a": 1}) != C.digest_of({"a": 1, "b": 3})


def test_every_problem_is_found_and_a_stale_digest_is_refused(spark):
    walked, markers, points = certificates.records(spark, DATA)
    stored = C.snapshot(points)
    found = C.verified(walked, markers, stored, certificates.GENERATION, certificates.DIGEST).collect()
    assert {r.problem for r in found} == {None, "unmarked", "manifest", "marker", "no points", "count", "source", "ids", "content"}
    assert {r.problem for r in C.verified(walked, markers, stored, certificates.GENERATION, "another").collect()} == {"unmarked", "manifest"}
    assert {r.problem for r in C.verified(walked, markers, stored, "g9", certificates.DIGEST).collect()} == {"unmarked"}
