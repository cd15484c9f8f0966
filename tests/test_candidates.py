"""Candidates of a search go to the texts; texts aren't dealt out for them, and no search is made twice."""

import re

import pytest

from quernstone.operators import index, ranking
from quernstone.plans import registry


@pytest.mark.parametrize("name", ["pf07_entry_headed_first", "fn43_rerank_lexical", "wn09_rerank_blend"])
def test_texts_stay_where_they_are(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        found = registry.queries()[name](spark, "/root/testdata/sf0.01")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"hashpartitioning\(doc_id", plan), plan


def test_pins_search_each_leg_once(spark, monkeypatch):
    made = []
    for module, name in ((index, "bm25_top"), (ranking, "dense_top")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), name=name, **b: made.append(name) or f(*a, **b))
    assert registry.queries()["wn10_pinned_hits"](spark, "/root/testdata/sf0.001").count()
    assert sorted(made) == ["bm25_top", "dense_top"]
