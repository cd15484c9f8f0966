"""Retrieval queries: benchmark passages are the queries, documents the chunks, sources the document families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index, ranking, resampling, scoring, vectors
from ..sources import shared
from ..sources.tables import table

LIMIT, FUSED, DEPTH = 8, 24, ranking.PREFETCH
BOOSTS = {"syntax": 3.0, "table": 2.0, "message": 1.5, "narrative": 1.0}


def _chunks(spark, d) -> DataFrame:
    """Documents as chunks: source is the document family, page the place in it; page 0 is the leading title section."""
    return table(spark, d, "documents").select("doc_id", "source", "lang", "text", F.expr("doc_id div 20").alias("page"))


def _facts(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "source", "lang", "page", (F.col("page") == 0).alias("is_front"), T.chunk_type(F.col("text")).alias("chunk_type"))


def _kept(rows: DataFrame) -> DataFrame:
    """A few rows a query, stored: plans read a leg several times and each time would search the corpus again, and what is joined
    to texts has a known size then, so that rows go to the texts and not all texts to the rows."""
    return shared.stored(rows, shared.folder(rows.sparkSession))


def _sparse(spark, d, k: int = DEPTH) -> DataFrame:
    docs, asked = _chunks(spark, d), table(spark, d, "benchmark")
    return _kept(index.bm25_top(asked, "item_id", docs, "doc_id", k))


def _dense(spark, d, k: int = DEPTH) -> DataFrame:
    asked, docs = table(spark, d, "benchmark"), _chunks(spark, d)
    return _kept(ranking.dense_top(index.dense_arrays(asked, "item_id", "text"), "item_id", index.dense_arrays(docs, "doc_id", "text"), "doc_id", "vector", k))


def _with_facts(rows: DataFrame, spark, d, *names: str) -> DataFrame:
    """rows (doc_id, ...) with facts of their documents; only documents that are in rows are looked at."""
    chunks = _chunks(spark, d).join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.join(_facts(chunks).select("doc_id", *names), "doc_id")


def _fused(spark, d, weights=(1.0, 1.0), boosted: bool = False, facts: tuple[str, ...] = ("source", "page", "is_front"), sparse: DataFrame | None = None) -> DataFrame:
    """Both legs fused, with facts of the documents that are left; a sparse leg that was searched before may be given."""
    dense, sparse = (leg.drop("score") for leg in (_dense(spark, d), sparse or _sparse(spark, d)))
    if not boosted:
        fused = ranking.rrf(dense, sparse, "item_id", "doc_id", weights)
        return _with_facts(fused, spark, d, *facts) if facts else fused
    boost = F.lit(1.0)
    for kind, factor in BOOSTS.items():
        boost = F.when(F.col("chunk_type") == kind, factor).otherwise(boost)
    dense, sparse = (_with_facts(leg, spark, d, "chunk_type") for leg in (dense, sparse))
    return ranking.rrf(dense, sparse, "item_id", "doc_id", weights, boost=boost)


def _hybrid(spark, d) -> DataFrame:
    fused = _fused(spark, d)
    cut = ranking.fused_order(fused, "item_id", FUSED, low=ranking.demoted("item_id", "source", "is_front"))
    return ranking.diversify(cut, "item_id", "page", "source", LIMIT, 1, 5)


def hybrid_search_benchmark(spark, d):
    return _hybrid(spark, d).select("item_id", "place", "doc_id", "source", F.round("score", 9).alias("score"))


def bm25_topk(spark, d):
    return _sparse(spark, d).select("item_id", "doc_id", "score", "rank")


def hashed_topk(spark, d):
    return _dense(spark, d).select("item_id", "doc_id", "score", "rank")


def token_counts(spark, d):
    return index.postings(table(spark, d, "documents"), "doc_id", "text")


def term_idf(spark, d):
    docs = table(spark, d, "documents")
    return index.with_idf(index.postings(docs, "doc_id", "text"), "doc_id", docs).select("term", "df", F.round("idf", 6).alias("idf"))


def hashed_vectors(spark, d):
    docs = table(spark, d, "documents")
    return index.hashed_vectors(index.postings(docs, "doc_id", "text"), "doc_id").select("doc_id", "bucket", F.round("w", 6).alias("w"))


def rrf_weighted(spark, d):
    return ranking.fused_order(_fused(spark, d, (1.0, 2.0), facts=()), "item_id", FUSED).select("item_id", "doc_id", "rank", F.round("score", 9).alias("score"))


def rrf_type_boost(spark, d):
    return ranking.fused_order(_fused(spark, d, boosted=True), "item_id", FUSED).select("item_id", "doc_id", "chunk_type", "rank", F.round("score", 9).alias("score"))


def rrf_tie_rule(spark, d):
    fused = _fused(spark, d)
    return ranking.fused_order(fused, "item_id", FUSED, low=ranking.demoted("item_id", "source", "is_front")).select("item_id", "doc_id", "is_front", "rank", F.round("score", 9).alias("score"))


def headed_by(text: Column, word: Column) -> Column:
    """Whether some line begins, after marks and blanks, with the whole word, in any case."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    found = F.regexp_like(text, F.concat(F.lit(r"(?dimu)^[^\p{L}\p{N}_\n]*"), quoted, F.lit(r"(?![\p{L}\p{N}_])")))
    return F.coalesce((word != "") & found, F.lit(False))


def entry_headed_first(spark, d):
    """Rows whose text has a line that the passage's first word heads come first."""
    asked = table(spark, d, "benchmark").select("item_id", F.element_at(F.split("text", " "), 1).alias("word"))
    fused = _kept(_fused(spark, d, facts=()).join(asked, "item_id")).join(_chunks(spark, d).select("doc_id", "text"), "doc_id")
    headed = headed_by(F.col("text"), F.col("word"))
    return ranking.fused_order(fused.withColumn("headed", headed), "item_id", FUSED, headed=F.col("headed")).select("item_id", "doc_id", "headed", "rank")


def _lists(spark, d) -> DataFrame:
    return _dense(spark, d).select("item_id", "doc_id", F.lit(0).alias("list"), "rank", F.lit(2.0).alias("w")).unionByName(
        _sparse(spark, d).select("item_id", "doc_id", F.lit(1).alias("list"), "rank", F.lit(1.0).alias("w"))
    )


def _merged(df: DataFrame) -> DataFrame:
    return ranking.top(df, ["item_id"], [F.desc("score"), F.asc("first_seen")], FUSED, "place", 1).select("item_id", "doc_id", "place", F.round("score", 9).alias("score"))


def split_merge_weighted(spark, d):
    return _merged(ranking.merge_weighted(_lists(spark, d), "item_id", "doc_id"))


def split_merge_max(spark, d):
    return _merged(ranking.merge_max(_lists(spark, d), "item_id", "doc_id"))


def split_interleave(spark, d):
    lists = _lists(spark, d).join(_chunks(spark, d).select("doc_id", "source"), "doc_id")
    return ranking.interleave(lists, "item_id", "doc_id", "source", FUSED)


def legs_alternate(spark, d):
    return ranking.alternate(_dense(spark, d), _sparse(spark, d), "item_id", "doc_id", LIMIT).select("item_id", "doc_id", "rank")


def diversify_caps(spark, d):
    cut = _with_facts(ranking.fused_order(_fused(spark, d, facts=()), "item_id", FUSED), spark, d, "page", "source")
    return ranking.diversify(cut, "item_id", "page", "source", LIMIT, 1, 2).select("item_id", "place", "doc_id", "source", "phase")


def lexical_rerank(spark, d):
    """Every fused candidate scored by its lexical overlap with the passage."""
    cut = ranking.fused_order(_fused(spark, d, facts=()), "item_id", FUSED)
    asked = _kept(cut.join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), "item_id"))
    both = asked.join(_chunks(spark, d).select("doc_id", "text"), "doc_id")
    return both.select("item_id", "doc_id", "rank", "score", ranking.lexical_scores(both, "question", "text").alias("ce"))


def rerank_lexical_scores(spark, d):
    return lexical_rerank(spark, d).select("item_id", "doc_id", "ce")


def rerank_blend(spark, d):
    pool = lexical_rerank(spark, d).withColumn("score", F.round("score", 9)).drop("rank")
    return ranking.blended(pool, "item_id", "ce", "score", "doc_id", 0.7, LIMIT).select("item_id", "doc_id", "rank", F.round("blend", 6).alias("blend"))


def _asked(vectors: DataFrame) -> DataFrame:
    """The stated query set of a search in its own table: every row whose id is divisible by 100."""
    return vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


def dense_topk_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return ranking.dense_top(_asked(e), "query_id", e, "vec_id", "embedding", 10)


def dense_topk_filtered(spark, d):
    e = table(spark, d, "embeddings")
    return ranking.dense_top(_asked(e), "query_id", e, "vec_id", "embedding", 5, same="label")


def _approximate(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.search(_asked(e), "query_id", "embedding", vectors.build(e, "vec_id", "embedding"), 10)


def dense_topk_indexed(spark, d):
    """Top 10 by the inverted file: codes of the probed cells, then whole vectors of the candidates."""
    return _approximate(spark, d).select("query_id", "vec_id", "score", "rank")


def ann_overlap_at_k(spark, d):
    """Overlap at 10 of the inverted file with the exact ranking, and the share of rows whose codes a query scored."""
    near, exact = _approximate(spark, d), dense_topk_cosine(spark, d)
    every = table(spark, d, "embeddings").agg(F.count("embedding").alias("rows"))
    found = exact.select("query_id", "vec_id").join(near.select("query_id", "vec_id", "rows_read"), ["query_id", "vec_id"], "left").groupBy("query_id")
    told = found.agg(F.round(F.count("rows_read") / F.count("*"), 6).alias("overlap"), F.max("rows_read").alias("rows_read"))
    return told.join(F.broadcast(every)).select("query_id", "overlap", F.round(F.coalesce("rows_read", F.lit(0)) / F.col("rows"), 6).alias("read"))


def _gold(spark, d) -> DataFrame:
    """(item_id, doc_id) of documents that contain the passage."""
    return _kept(index.containing(table(spark, d, "benchmark"), "item_id", table(spark, d, "documents"), "doc_id"))


def benchmark_gold(spark, d):
    return _gold(spark, d)


def eval_recall_mrr(spark, d):
    hits = _hybrid(spark, d).select("item_id", "doc_id", F.col("place").alias("rank"))
    marked = hits.join(_gold(spark, d).withColumn("relevant", F.lit(True)), ["item_id", "doc_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    return scoring.scored(marked, table(spark, d, "benchmark"), "item_id", "relevant").withColumn("mrr", F.round("mrr", 6))


def eval_ndcg(spark, d):
    gold = _gold(spark, d)
    hits = _hybrid(spark, d).select("item_id", "doc_id", F.col("place").alias("rank"))
    marked = hits.join(gold.withColumn("gain", F.lit(1)), ["item_id", "doc_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    expected = table(spark, d, "benchmark").select("item_id").join(gold.groupBy("item_id").agg(F.count("*").alias("n_expected")), "item_id", "left").fillna(0, ["n_expected"])
    return scoring.ndcg(marked, expected, "item_id", "doc_id", "gain", LIMIT)


def _label_eval(spark, d, k: int) -> DataFrame:
    """Per vector: metrics of its k nearest others, relevant if of its label."""
    e = table(spark, d, "embeddings")
    near = ranking.dense_top(_asked(e), "query_id", e, "vec_id", "embedding", k + 1).where("query_id <> vec_id")
    placed = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)
    marked = placed.join(e.select("vec_id", F.col("label").alias("found")), "vec_id").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return scoring.scored(marked.withColumn("relevant", F.col("found") == F.col("label")), _asked(e).select("query_id"), "query_id", "relevant").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")


def eval_by_class_grouping_sets(spark, d):
    _label_eval(spark, d, 8).createOrReplaceTempView("_label_eval")
    return spark.sql(
        "SELECT coalesce(cast(label AS string), 'all') AS class, count(*) AS n, round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(mrr), 6) AS mrr "
        "FROM _label_eval GROUP BY GROUPING SETS ((), (label))"
    )


def paired_delta(spark, d):
    """Per label: mean change of recall@1 and mrr from looking at 2 neighbours to looking at 8, and the gate's verdict."""
    base, new = _label_eval(spark, d, 2), _label_eval(spark, d, 8)
    both = base.select("query_id", "label", F.col("mrr").alias("m0"), F.col("recall_5").alias("r0")).join(new.select("query_id", F.col("mrr").alias("m1"), F.col("recall_5").alias("r1")), "query_id")
    out = both.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("m1") - F.col("m0")), 6).alias("d_mrr"), F.round(F.avg(F.col("r1") - F.col("r0")), 6).alias("d_recall_5"))
    return out.withColumn("verdict", F.when((F.col("d_mrr") < -0.05) | (F.col("d_recall_5") < -0.05), "hold").otherwise("merge"))


def bootstrap_ci(spark, d):
    return resampling.interval(_label_eval(spark, d, 8), "label", "query_id", "mrr", seed=7)


def sweep_grid(spark, d):
    """Mean recall@8 for every fusion constant and sparse weight, over the same legs in one plan."""
    configs = spark.createDataFrame([(k, w) for k in (2, 10, 60) for w in (0.5, 1.0, 3.0)], "k int, w double")
    fused = _fused(spark, d, facts=()).select("item_id", "doc_id", "dense_rank", "sparse_rank", "first_seen").join(F.broadcast(configs))
    score = F.coalesce(1.0 / (F.col("k") + F.col("dense_rank") + 1), F.lit(0.0)) + F.coalesce(F.col("w") / (F.col("k") + F.col("sparse_rank") + 1), F.lit(0.0))
    hits = ranking.top(fused.withColumn("score", score), ["k", "w", "item_id"], [F.desc("score"), F.asc("first_seen")], LIMIT)
    found = hits.join(_gold(spark, d), ["item_id", "doc_id"]).select("k", "w", "item_id").distinct().groupBy("k", "w").agg(F.count("*").alias("hits"))
    total = table(spark, d, "benchmark").agg(F.count("*").alias("n"))
    return configs.join(found, ["k", "w"], "left").join(F.broadcast(total)).select("k", "w", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall_8"))


QUERIES = {
    "hybrid_search_benchmark": hybrid_search_benchmark,
    "tk02_bm25_topk": bm25_topk,
    "vx01_hashed_topk": hashed_topk,
    "ag01_token_counts": token_counts,
    "vx06_term_idf": term_idf,
    "vx01_hashed_vectors": hashed_vectors,
    "wn01_rrf_weighted": rrf_weighted,
    "wn01_rrf_type_boost": rrf_type_boost,
    "wn02_rrf_tie_rule": rrf_tie_rule,
    "pf07_entry_headed_first": entry_headed_first,
    "wn03_split_merge_weighted": split_merge_weighted,
    "wn04_split_merge_max": split_merge_max,
    "wn05_split_interleave": split_interleave,
    "wn08_legs_alternate": legs_alternate,
    "wn07_diversify_caps": diversify_caps,
    "fn43_rerank_lexical": rerank_lexical_scores,
    "wn09_rerank_blend": rerank_blend,
    "tk01_dense_topk_cosine": dense_topk_cosine,
    "ext_dense_topk_by_label": dense_topk_filtered,
    "st09_ann_overlap_at_k": ann_overlap_at_k,
    "vx05_dense_topk_indexed": dense_topk_indexed,
    "jn17_benchmark_gold": benchmark_gold,
    "wn18_eval_recall_mrr": eval_recall_mrr,
    "wn17_eval_ndcg": eval_ndcg,
    "ag14_eval_grouping_sets": eval_by_class_grouping_sets,
    "jn11_paired_delta": paired_delta,
    "ag27_bootstrap_ci": bootstrap_ci,
    "gt27_sweep_grid": sweep_grid,
}

# The same in DuckDB's SQL.

_POST = """
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(doc_id) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term)"""
_SPARSE = _POST + """,
dl AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY doc_id),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM benchmark),
bm AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(dl) FROM dl)))), 6) AS score
       FROM asked JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bm QUALIFY rank < 40)"""
_VEC = """
raw_{0} AS (SELECT {1}, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS bucket, sum(1 + ln(tf)) AS w FROM {2} GROUP BY ALL),
vec_{0} AS (SELECT {1}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {1})) AS w FROM raw_{0})"""
_DENSE = _VEC.format("d", "doc_id", "post") + """,
qpost AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM benchmark) GROUP BY ALL),""" + _VEC.format("q", "item_id", "qpost") + """,
cosine AS (SELECT item_id, doc_id, round(sum(a.w * b.w), 6) AS score FROM vec_q a JOIN vec_d b USING (bucket) GROUP BY ALL),
dense AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM cosine QUALIFY rank < 40)"""
_TYPED = T.CHUNK_TYPE_SQL


def _fuse_sql(wd: float = 1.0, ws: float = 1.0, boost: str = "1e0") -> str:
    return f"""
typed AS ({_TYPED}),
facts AS (SELECT d.doc_id, source, lang, d.doc_id // 20 AS page, d.doc_id // 20 = 0 AS is_front, chunk_type FROM documents d JOIN typed USING (doc_id)),
nd AS (SELECT item_id, count(*) AS n FROM dense GROUP BY ALL),
fused AS (SELECT item_id, doc_id, f.* EXCLUDE (doc_id), d.rank AS rd, s.rank AS rs,
          coalesce({wd}::DOUBLE / (60 + d.rank + 1), 0) + coalesce(({ws}::DOUBLE / (60 + s.rank + 1)) * {boost}, 0) AS score, coalesce(d.rank, n + s.rank) AS first_seen
          FROM dense d FULL JOIN sparse s USING (item_id, doc_id) JOIN facts f USING (doc_id) JOIN nd USING (item_id))"""


_ALL = f"WITH {_SPARSE}, {_DENSE}"
_BOOST = "CASE chunk_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in BOOSTS.items()) + " ELSE 1e0 END"
_LOW = "(is_front AND sum(CASE WHEN is_front THEN 0 ELSE 1 END) OVER (PARTITION BY item_id, score) > sum(CASE WHEN is_front THEN 0 ELSE 1 END) OVER (PARTITION BY item_id, score, source))"
_TIED = f"tied AS (SELECT *, {_LOW} AS low FROM fused), cut AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, low, first_seen) - 1 AS rank FROM tied QUALIFY rank < 24)"


def _diverse_sql(doc_cap: int, source: str = "cut") -> str:
    return f"""
paged AS (SELECT *, row_number() OVER (PARTITION BY item_id, source, page ORDER BY rank) AS pr FROM {source}),
counted AS (SELECT *, sum(CASE WHEN pr <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id, source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS dr FROM paged),
phased AS (SELECT *, CASE WHEN pr <= 1 AND dr <= {doc_cap} THEN 1 WHEN pr <= 1 THEN 2 ELSE 3 END AS phase FROM counted),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY phase, CASE WHEN phase = 3 THEN -score END, rank) AS place FROM phased QUALIFY place <= 8)"""


_HYBRID = f"{_ALL}, {_fuse_sql()}, {_TIED}, {_diverse_sql(5)}"
_PLAIN_CUT = "cut AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first_seen) - 1 AS rank FROM fused QUALIFY rank < 24)"
_GOLD = "gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_CE = """
pool AS (SELECT item_id, doc_id, round(score, 9) AS score, regexp_extract_all(lower(b.text), '[a-z0-9]{2,}') AS q, regexp_extract_all(lower(d.text), '[a-z0-9]{2,}') AS t
         FROM cut JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
ces AS (SELECT item_id, doc_id, score, CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE round_even(len(list_filter(t, lambda x: list_contains(q, x))) / (len(q) + ln(1 + len(t))), 4) END AS ce FROM pool)"""


def _label_sql(name: str, k: int) -> str:
    return f"""
near_{name} AS (SELECT a.vec_id AS query_id, a.label, b.label = a.label AS relevant,
   row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank
   FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY rank <= {k}),
eval_{name} AS (SELECT query_id, label, min(rank) FILTER (relevant) AS first, coalesce((first <= 1)::DOUBLE, 0) AS recall_1, coalesce((first <= 5)::DOUBLE, 0) AS recall_5, coalesce(1 / first, 0) AS mrr FROM near_{name} GROUP BY ALL)"""


def _merge_sql(score: str) -> str:
    return f"""{_ALL}, lists AS (SELECT item_id, doc_id, 0 AS list, rank, 2e0 AS w FROM dense UNION ALL SELECT item_id, doc_id, 1, rank, 1e0 FROM sparse),
merged AS (SELECT item_id, doc_id, {score} AS score, min(list * 1000 + rank) AS first_seen FROM lists GROUP BY ALL)
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first_seen) AS place, round(score, 9) AS score FROM merged QUALIFY place <= 24"""


ORACLES = {
    "hybrid_search_benchmark": f"{_HYBRID} SELECT item_id, place, doc_id, source, round(score, 9) AS score FROM placed",
    "tk02_bm25_topk": f"WITH {_SPARSE} SELECT item_id, doc_id, score, rank FROM sparse",
    "vx01_hashed_topk": f"WITH {_POST}, {_DENSE} SELECT item_id, doc_id, score, rank FROM dense",
    "ag01_token_counts": f"WITH {_POST} SELECT doc_id, term, tf FROM post",
    "vx06_term_idf": f"WITH {_POST} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "vx01_hashed_vectors": f"WITH {_POST}, {_VEC.format('d', 'doc_id', 'post')} SELECT doc_id, bucket, round(w, 6) AS w FROM vec_d",
    "wn01_rrf_weighted": f"{_ALL}, {_fuse_sql(1.0, 2.0)}, {_PLAIN_CUT} SELECT item_id, doc_id, rank, round(score, 9) AS score FROM cut",
    "wn01_rrf_type_boost": f"{_ALL}, {_fuse_sql(boost=_BOOST)}, {_PLAIN_CUT} SELECT item_id, doc_id, chunk_type, rank, round(score, 9) AS score FROM cut",
    "wn02_rrf_tie_rule": f"{_ALL}, {_fuse_sql()}, {_TIED} SELECT item_id, doc_id, is_front, rank, round(score, 9) AS score FROM cut",
    "pf07_entry_headed_first": f"""{_ALL}, {_fuse_sql()}, marked AS (SELECT f.*, string_split(b.text, ' ')[1] <> '' AND regexp_matches(d.text, '(?im)^[^\\p{{L}}\\p{{N}}_\\n]*' || regexp_escape(string_split(b.text, ' ')[1]) || '([^\\p{{L}}\\p{{N}}_]|$)') AS headed
        FROM fused f JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))
        SELECT item_id, doc_id, headed, row_number() OVER (PARTITION BY item_id ORDER BY headed DESC, score DESC, first_seen) - 1 AS rank FROM marked QUALIFY rank < 24""",
    "wn03_split_merge_weighted": _merge_sql("sum(w / (60 + rank + 1))"),
    "wn04_split_merge_max": _merge_sql("max(1e0 / (60 + rank + 1))"),
    "wn08_legs_alternate": f"""{_ALL}, slots AS (SELECT item_id, doc_id, 2 * rank AS slot FROM dense UNION ALL SELECT item_id, doc_id, 2 * rank + 1 FROM sparse),
        cut AS (SELECT item_id, greatest(8, count(*) FILTER (slot % 2 = 0), count(*) FILTER (slot % 2 = 1)) AS cut FROM slots GROUP BY ALL),
        one AS (SELECT item_id, doc_id, min(slot) AS slot FROM slots GROUP BY ALL)
        SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY slot) AS rank FROM one JOIN cut USING (item_id) QUALIFY rank <= cut""",
    "wn07_diversify_caps": f"{_ALL}, {_fuse_sql()}, {_PLAIN_CUT}, {_diverse_sql(2)} SELECT item_id, place, doc_id, source, phase FROM placed",
    "fn43_rerank_lexical": f"{_ALL}, {_fuse_sql()}, {_PLAIN_CUT}, {_CE} SELECT item_id, doc_id, ce FROM ces",
    "wn09_rerank_blend": f"""{_ALL}, {_fuse_sql()}, {_PLAIN_CUT}, {_CE},
        ends AS (SELECT *, min(ce) OVER p AS c0, max(ce) OVER p AS c1, min(score) OVER p AS s0, max(score) OVER p AS s1 FROM ces WINDOW p AS (PARTITION BY item_id)),
        mixed AS (SELECT item_id, doc_id, ce, score, round(0.7::DOUBLE * CASE WHEN c1 = c0 THEN 0.5 ELSE (ce - c0) / (c1 - c0) END + 0.3::DOUBLE * CASE WHEN s1 = s0 THEN 0.5 ELSE (score - s0) / (s1 - s0) END, 9) AS blend FROM ends)
        SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY blend DESC, ce DESC, score DESC, doc_id DESC) AS rank, round(blend, 6) AS blend FROM mixed QUALIFY rank <= 8""",
    "tk01_dense_topk_cosine": """SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) - 1 AS rank
        FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0 QUALIFY rank < 10""",
    "ext_dense_topk_by_label": """SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) - 1 AS rank
        FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0 QUALIFY rank < 5""",
    "jn17_benchmark_gold": f"WITH {_GOLD} SELECT * FROM gold",
    "wn18_eval_recall_mrr": f"""{_HYBRID}, {_GOLD}, firsts AS (SELECT item_id, min(place) AS first FROM placed JOIN gold USING (item_id, doc_id) GROUP BY ALL)
        SELECT item_id, coalesce((first <= 1)::DOUBLE, 0) AS recall_1, coalesce((first <= 3)::DOUBLE, 0) AS recall_3, coalesce((first <= 5)::DOUBLE, 0) AS recall_5, coalesce((first <= 8)::DOUBLE, 0) AS recall_8,
        round(coalesce(1 / first, 0), 6) AS mrr FROM benchmark LEFT JOIN firsts USING (item_id)""",
    "wn17_eval_ndcg": f"""{_HYBRID}, {_GOLD}, wanted AS (SELECT item_id, count(*) AS n FROM gold GROUP BY ALL), dcg AS (SELECT item_id, sum(1 / log2(place + 1)) AS dcg FROM placed JOIN gold USING (item_id, doc_id) GROUP BY ALL)
        SELECT item_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 8) + 1), lambda i: 1 / log2(i + 1))), 4) AS ndcg FROM wanted LEFT JOIN dcg USING (item_id)""",
    "ag14_eval_grouping_sets": f"""WITH {_label_sql('a', 8)} SELECT coalesce(label::VARCHAR, 'all') AS class, count(*) AS n, round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(mrr), 6) AS mrr
        FROM eval_a GROUP BY GROUPING SETS ((), (label))""",
    "jn11_paired_delta": f"""WITH {_label_sql('a', 2)}, {_label_sql('b', 8)}, d AS (SELECT a.label, count(*) AS n, round(avg(b.mrr - a.mrr), 6) AS d_mrr, round(avg(b.recall_5 - a.recall_5), 6) AS d_recall_5 FROM eval_a a JOIN eval_b b USING (query_id) GROUP BY ALL)
        SELECT *, CASE WHEN d_mrr < -0.05 OR d_recall_5 < -0.05 THEN 'hold' ELSE 'merge' END AS verdict FROM d""",
    "gt27_sweep_grid": f"""{_ALL}, {_fuse_sql()}, {_GOLD}, configs AS (SELECT k, w FROM (VALUES (2), (10), (60)) a(k), (VALUES (0.5::DOUBLE), (1e0), (3e0)) b(w)),
        runs AS (SELECT k, w, item_id, doc_id, row_number() OVER (PARTITION BY k, w, item_id ORDER BY coalesce(1e0 / (k + rd + 1), 0) + coalesce(w / (k + rs + 1), 0) DESC, first_seen) AS place FROM fused CROSS JOIN configs QUALIFY place <= 8)
        SELECT c.k, c.w, round(count(DISTINCT g.item_id) / (SELECT count(*) FROM benchmark), 6) AS recall_8 FROM configs c LEFT JOIN (SELECT * FROM runs JOIN gold USING (item_id, doc_id)) g ON c.k = g.k AND c.w = g.w GROUP BY ALL""",
}
