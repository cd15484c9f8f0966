"""Recorded pools searched again under other settings: all of a grid's configurations in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import diversify, top

#: What a configuration may set: constant and weights of the fusion, its cut, caps by page and document, and what is left.
CONFIG = "label string, k int, dense_weight double, sparse_weight double, fuse_limit int, max_per_page int, max_per_doc int"
LIMIT = 8


def replayed(pools: DataFrame, configs: DataFrame) -> DataFrame:
    """(label, query, chunk_id, doc_id, place from 1): pools (query, chunk_id, doc_id, page, dense_rank, sparse_rank from 0, null where a
    leg hasn't the chunk) fused, cut and spread by every configuration. Configurations are declared rows and are broadcast."""
    share = lambda w, r: F.coalesce(F.col(w) / (F.col("k") + F.col(r) + 1), F.lit(0.0))
    both = pools.join(F.broadcast(configs)).withColumn("score", share("dense_weight", "dense_rank") + share("sparse_weight", "sparse_rank"))
    both = both.withColumn("q", F.struct("label", "query"))
    seen = F.coalesce("dense_rank", F.lit(1 << 20) + F.col("sparse_rank"))
    deepest = 1 << 20
    cut = top(both, ["q"], [F.desc("score"), seen.asc(), F.asc("chunk_id")], deepest).where(F.col("rank") < F.col("fuse_limit"))
    spread = diversify(cut, "q", "page", "doc_id", LIMIT, F.col("max_per_page"), F.col("max_per_doc"))
    return spread.select("label", "query", "chunk_id", "doc_id", "place")


def summarized(hits: DataFrame, configs: DataFrame, golden: DataFrame) -> DataFrame:
    """(label, class, n, recall_1, recall_5, mrr, violations) of each configuration, by class and for all. golden: query, class,
    expected and barred (arrays of chunk ids); a barred chunk among the first five is a violation."""
    asked = golden.join(F.broadcast(configs.select("label")))
    found = hits.join(golden, "query").withColumn("good", F.array_contains("expected", F.col("chunk_id"))).withColumn("bad", F.coalesce(F.array_contains("barred", F.col("chunk_id")), F.lit(False)) & (F.col("place") <= 5))
    by_query = found.groupBy("label", "query").agg(F.min(F.when(F.col("good"), F.col("place"))).alias("first"), F.sum(F.col("bad").cast("long")).alias("violations"))
    told = asked.join(by_query, ["label", "query"], "left").select("label", "class", F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0)).alias("r1"), F.coalesce((F.col("first") <= 5).cast("double"), F.lit(0.0)).alias("r5"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce("violations", F.lit(0)).alias("v"))
    both = told.withColumn("class", F.explode(F.array(F.col("class"), F.lit("all"))))
    return both.groupBy("label", "class").agg(F.count("*").alias("n"), F.round(F.avg("r1"), 3).alias("recall_1"), F.round(F.avg("r5"), 3).alias("recall_5"), F.round(F.avg("rr"), 3).alias("mrr"), F.sum("v").alias("violations"))
