"""Scores of ranked hits against gold, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scored(hits: DataFrame, queries: DataFrame, query: str, relevant: str) -> DataFrame:
    """recall@1/3/5/8 and mrr per query from hits with a 1-based rank; a query without hits scores 0."""
    first = hits.where(F.col(relevant)).groupBy(query).agg(F.min("rank").alias("first"))
    at = lambda k: F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)).alias(f"recall_{k}")
    return queries.select(query).join(first, query, "left").select(query, at(1), at(3), at(5), at(8), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def ndcg(hits: DataFrame, expected: DataFrame, query: str, doc: str, gain: str, k: int, best: int = 1) -> DataFrame:
    """Document-level nDCG@k: the first hit of a document counts; the ideal has min(expected, k) best gains."""
    one = hits.withColumn("nth", F.row_number().over(Window.partitionBy(query, doc).orderBy("rank"))).where("nth = 1")
    placed = one.withColumn("at", F.row_number().over(Window.partitionBy(query).orderBy("rank"))).where(F.col("at") <= k)
    dcg = placed.groupBy(query).agg(F.sum(F.col(gain) / F.log2(F.col("at") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_expected"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + best / F.log2(i + F.lit(1.0)))
    return expected.where("n_expected > 0").join(dcg, query, "left").select(query, F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 4).alias("ndcg"))


def nearest_rank(column: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def wilson(successes: Column, n: Column, z: float, lower: bool) -> Column:
    p = successes / n
    centre, margin = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - margin if lower else centre + margin) / (1 + z * z / n)
