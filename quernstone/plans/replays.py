"""Replayed pools and stratified samples, with SQL written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import replay, samples
from ..sources.tables import table
from . import retrieval as R

CONFIGS = [("production", 60, 1.0, 1.0, 24, 1, 5), ("fuse40", 60, 1.0, 1.0, 40, 1, 5), ("page2", 60, 1.0, 1.0, 24, 2, 5), ("doc2", 60, 1.0, 1.0, 24, 1, 2)]
CONFIGS += [(f"k{k}-w{w:g}", k, 1.0, w, 24, 1, 5) for k in (2, 10, 30) for w in (1.0, 3.0)]
COUNT, CLASSES, SEED = 200, ["plain", "table", "syntax", "message_id"], "17"


def _pools(spark, d):
    """Both legs of every passage, as recorded; and what each passage expects and bars."""
    legs = [R._dense(spark, d).select("item_id", "doc_id", F.col("rank").alias("dense_rank")), R._sparse(spark, d).select("item_id", "doc_id", F.col("rank").alias("sparse_rank"))]
    both = legs[0].join(legs[1], ["item_id", "doc_id"], "full")
    facts = table(spark, d, "documents").select("doc_id", "source", F.expr("doc_id div 20").alias("page"))
    pools = both.join(facts, "doc_id").select(F.col("item_id").alias("query"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "page", "dense_rank", "sparse_rank")
    gold = R._gold(spark, d).groupBy("item_id").agg(F.collect_set("doc_id").alias("expected"))  # documents that hold one passage
    barred = F.array(F.col("item_id") * 7, F.col("item_id") + 1)
    golden = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("class"), barred.alias("barred")).join(gold, "item_id")
    return pools, golden.withColumnRenamed("item_id", "query")


def replay_grid(spark, d):
    pools, golden = _pools(spark, d)
    configs = spark.createDataFrame(CONFIGS, replay.CONFIG)
    return replay.summarized(replay.replayed(pools, configs), configs, golden)


def stratified_sample(spark, d):
    """Documents as chunks of their sources; classes by their type and by message ids."""
    docs = table(spark, d, "documents").withColumn("chunk_type", T.chunk_type(F.col("text")))
    can = F.array_compact(F.array(F.lit("plain"), F.when(F.col("chunk_type") == "table", "table"), F.when(F.col("chunk_type") == "syntax", "syntax"), F.when(F.col("doc_id") % 4 == 0, "message_id")))
    points = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), "chunk_type", F.when(F.col("doc_id") % 11 > 0, can).otherwise(F.array()).alias("classes"))
    key = lambda *names: F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]))
    return samples.stratified(points, COUNT, CLASSES, key)


QUERIES = {"gt26_replay_grid": replay_grid, "wn21_stratified_sample": stratified_sample}

_LISTED = ", ".join(f"('{c[0]}', {c[1]}, {c[2]}::DOUBLE, {c[3]}::DOUBLE, {c[4]}, {c[5]}, {c[6]})" for c in CONFIGS)
ORACLES = {
    "gt26_replay_grid": f"""WITH {R._SPARSE}, {R._DENSE}, conf(label, k, wd, ws, cap, pp, pd) AS (VALUES {_LISTED}),
    pool AS (SELECT coalesce(a.item_id, b.item_id) AS q, coalesce(a.doc_id, b.doc_id) AS c, a.rank AS rd, b.rank AS rs FROM dense a FULL JOIN sparse b ON a.item_id = b.item_id AND a.doc_id = b.doc_id),
    fused AS (SELECT f.*, p.*, d.source AS doc, d.doc_id // 20 AS page, coalesce(wd / (k + rd + 1), 0) + coalesce(ws / (k + rs + 1), 0) AS score FROM pool p JOIN documents d ON d.doc_id = p.c CROSS JOIN conf f),
    cut AS (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY score DESC, coalesce(rd, 1048576 + rs), c) - 1 AS r FROM fused QUALIFY r < cap),
    paged AS (SELECT *, row_number() OVER (PARTITION BY label, q, doc, page ORDER BY r) AS np FROM cut), ph AS (SELECT *, CASE WHEN np > pp THEN 3 WHEN sum((np <= pp)::INT) OVER (PARTITION BY label, q, doc ORDER BY r) <= pd THEN 1 ELSE 2 END AS phase FROM paged),
    hits AS (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY phase, CASE WHEN phase = 3 THEN -score END, r) AS place FROM ph QUALIFY place <= 8),
    gold AS (SELECT DISTINCT b.item_id AS q, d.doc_id AS c FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    queried AS (SELECT DISTINCT f.label, g.q, 'c' || CAST(g.q % 3 AS VARCHAR) AS class FROM gold g CROSS JOIN conf f),
    each AS (SELECT a.label, a.q, a.class, min(CASE WHEN g.c IS NOT NULL THEN h.place END) AS first, count(CASE WHEN h.place <= 5 AND h.c IN (a.q * 7, a.q + 1) THEN 1 END) AS v FROM queried a LEFT JOIN hits h ON h.label = a.label AND h.q = a.q LEFT JOIN gold g ON g.q = h.q AND g.c = h.c GROUP BY ALL),
    twice AS (SELECT * FROM each UNION ALL SELECT label, q, 'all', first, v FROM each)
    SELECT label, class, count(*) AS n, round(avg(coalesce(first = 1, false)::INT), 3) AS recall_1, round(avg(coalesce(first <= 5, false)::INT), 3) AS recall_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 3) AS mrr, CAST(sum(v) AS BIGINT) AS violations FROM twice GROUP BY ALL""",
}
