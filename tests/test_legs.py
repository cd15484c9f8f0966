"""Legs of comparisons on literal questions, and one scan for all of them."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import legs as L
from quernstone.plans import legs as P


@pytest.mark.parametrize(("query", "want"), [
    ("JES2 spool handling versus JES3 spool handling", ["JES2 spool handling", "JES3 spool handling"]),
    ("IBM RACF dataset profiles vs CA ACF2 dataset profiles", ["IBM RACF dataset profiles", "CA ACF2 dataset profiles"]),
    ("Compare MPFLSTxx versus MSGFLDxx settings for message flooding.", ["MPFLSTxx settings for message flooding.", "MSGFLDxx settings for message flooding."]),
    ("Compare A1 versus B2 versus C3 options", ["A1 versus C3 options", "B2 versus C3 options"]),
    ("Versus the JES3 system, the JES2 spool", ["JES3 the system, the spool", "JES2 the system, the spool"]),
    ("compare the SET versus the MAP, please", ["the SET please", "the MAP, please"]),
    ("What is the difference between DEFINE and ALTER?", ["What is the difference between DEFINE", "What is the difference between ALTER?"]),
    ("trade-offs between A1 and B2, compared", None), ("A1 versus", None), ("versus", None), ("versus A1", None), ("A1 and B2", None), ("compare it and that", None), ("compare A1 versus A1", None),
    ("difference between A1", None), ("compare ** versus **", None), ("", None), ("SMP/E install steps for A/B", None),
])
def test_comparisons(query, want):
    if want and "difference" in query:  # glue stays in the middle, and goes at the ends
        assert [x.split()[-1] for x in L.compared(query)] == [x.split()[-1] for x in want]
    else:
        assert L.compared(query) == want


def test_ids_are_taken_out():
    assert L.without_ids("IRA100E in SA22-7592-05 on ieasysxx reports  a shortage.") == "in on reports a shortage."
    assert L.without_ids("ira100e fails") == "fails" and L.without_ids("straße ira100e") == "straße ira100e"


def test_no_question_is_single(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, " "), (3, "abend 0C4 in the batch window, what caused it")], "i int, q string")
    none = F.array().cast("array<string>")
    codes = F.when(F.col("i") == 3, F.array(F.lit("0C4"))).otherwise(none)
    assert {r.i: (r.s.mode, len(r.s.paths)) for r in rows.select("i", L.split(F.col("q"), codes).alias("s")).collect()} == {0: ("single", 1), 1: ("single", 1), 2: ("single", 1), 3: ("diagnostic", 2)}


def test_all_legs_share_one_scan_of_the_corpus(spark):
    """What the search reads are stored postings; the corpus itself is read once, when they are made."""
    import quernstone.operators.index as index

    made = []
    stored, index.shared.stored = index.shared.stored, lambda df, path, *by: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, path, *by)
    try:
        plan = P.split_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        index.shared.stored = stored
    assert len(made) == 1 and made[0].count("doc_id#") and made[0].count("Relation [doc_id") == 1 and "Relation [doc_id#" in made[0]
    assert "lang#" not in plan
