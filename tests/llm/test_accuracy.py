"""Held-out accuracy of languages, and words told apart where their hashes are equal."""

import numpy as np
from quernstone.llm import language_id, registry, substring_dedup

QUERIES = registry.queries()
DATA = "/root/testdata/sf0.001"


def test_language_of_held_out_documents(spark):
    """The languages of the given table, learned from two thirds of its labelled rows."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text").collect()
    lang = {r.doc_id: r.lang for r in rows if r.lang is not None and r.text and any(c.isalpha() for c in r.text)}
    found = [r for r in QUERIES["op5_language_id"](spark, DATA).collect() if r.held_out and r.doc_id in lang]
    assert len(found) > 20
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in found]) >= 0.95
    assert all(0 <= r.score <= 1 for r in found) and language_id.UNKNOWN == "und"


def test_digests_of_words_tell_clashing_windows_apart():
    """Windows that one hash makes equal still have digests of their own words."""
    a, b = (substring_dedup.Spans(" ".join(f"{x}{k}" for k in range(25))) for x in "ab")
    assert a.digest(0, 3) != b.digest(0, 3) and a.digest(0, 1) != a.digest(1, 1)
    same = substring_dedup.Spans(" ".join(f"a{k}" for k in range(1, 25)))
    assert a.digest(1, 4) == same.digest(0, 4)
