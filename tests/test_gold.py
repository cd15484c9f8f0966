"""Rules over gold candidates and arms against brute force, on literal rows."""

from pyspark.sql import functions as F

from quernstone.functions import gold as X


def test_classes(spark):
    rows = [(True, "table"), (False, "syntax"), (None, None), (True, "prose")]
    df = spark.createDataFrame(rows, "m boolean, k string").withColumn("c", F.array(*map(F.lit, ("table", "x", "message_id", "syntax"))))
    got = [r[0] for r in df.select(X.eligible_classes(F.col("m"), F.col("k"), F.col("c"))).collect()]
    assert got == [["table", "x", "message_id"], ["x", "syntax"], ["x"], ["x", "message_id"]]


def test_arms(spark):
    names = "arm string, `recall@1` double, `recall@3` double, `recall@5` double, `recall@8` double, mrr double, retrieval_ms double, condense_ms double"
    rows = [("literal", 1.0, 1.0, None, 1.0, 0.5, 10.0, None), ("literal", 0.0, 1.0, None, 1.0, 0.2, 30.04, None), ("literal", None, None, None, None, None, 99.0, None)]
    rows += [("condensed", 1.0, 1.0, 1.0, 1.0, 1.0, v, c) for v, c in ((3.0, 7.0), (1.0, 5.0), (2.0, None))] + [("condensed", None, None, None, None, None, 50.0, 9.0)]
    got = X.arm_summary(spark.createDataFrame(rows, names)).first().asDict()
    assert (got["literal_n"], got["literal_recall@1"], got["literal_recall@5"], got["literal_mrr"], got["literal_p50_ms"]) == (2, 0.5, None, 0.35, 30.0)
    assert (got["condensed_n"], got["condensed_p50_ms"], got["condense_p50_ms"]) == (3, 2.0, 7.0)
    assert (got["delta_recall@1"], got["delta_recall@5"], got["delta_mrr"]) == (0.5, None, 0.65)
    empty = X.arm_summary(spark.createDataFrame([], names)).first().asDict()
    assert empty.pop("literal_n") == empty.pop("condensed_n") == 0 and set(empty.values()) == {None}
