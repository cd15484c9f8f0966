"""Top-k legs, rank fusion, merging and diversification over batches of queries.

Ranks are 0-based in legs; every order ends in a unique key, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
PREFETCH = 40
#: Queries whose vectors are broadcast at once; more of them go in further blocks.
QUERY_BLOCK = 4096
#: Scores held at a time by a task.
SCORES = 1 << 21
#: Rows that a task keeps of what its parts found best.
HELD = 1 << 20


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", first: int = 0) -> DataFrame:
    """The first k rows of each group, numbered from `first`. Spark cuts groups before and after the exchange."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k).withColumn(rank, F.col(rank) - 1 + first)


def dense_top(queries: DataFrame, query_key: str, corpus: DataFrame, key: str, vector: str, k: int, same: str | None = None) -> DataFrame:
    """(query, key, score, rank): exact cosine top-k.

    Query vectors are read one block after the other, broadcast, and multiplied with parts of the corpus of bounded size;
    each task keeps its own top-k (kept_best), so k rows a query and task are dealt out instead of all pairs. With `same`, only corpus rows that
    share the query's value of that column are ranked (the filter comes before the cut).
    """
    columns = [query_key, vector, *([same] if same else [])]
    kinds = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {corpus.schema[key].dataType.simpleString()}, score double"
    parts, rows = [], iter(queries.select(columns).toLocalIterator())
    while block := list(islice(rows, max(1, min(QUERY_BLOCK, HELD // (2 * k))))) or (not parts and [None]):
        block = [r for r in block if r is not None]
        matrix = _unit(np.array([r[1] for r in block], float).reshape(len(block), -1))
        names, groups = np.array([r[0] for r in block]), np.array([r[2] for r in block]) if same else None
        held = corpus.sparkSession.sparkContext.broadcast((matrix, names, groups))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            matrix, names, groups = held.value
            step = max(1, SCORES // max(1, len(names)))

            def found() -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
                for batch in batches:
                    for k0 in range(0, len(batch) if len(names) else 0, step):
                        part = batch.iloc[k0 : k0 + step]
                        score = np.round(matrix @ _unit(np.array(part[vector].tolist(), float)).T, 6) + 0.0
                        if same:
                            score[groups[:, None] != part[same].to_numpy()[None, :]] = -np.inf
                        i, j = _best(score, part[key].to_numpy(), k)
                        yield i, pa.array(part[key].to_numpy()[j]), score[i, j]

            for i, keys, score in kept_best(found(), k):
                yield pd.DataFrame({query_key: names[i], key: keys.to_numpy(zero_copy_only=False), "score": score})

        parts.append(corpus.select(key, vector, *([same] if same else [])).mapInPandas(run, kinds))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return top(every, [query_key], [F.desc("score"), F.col(key)], k)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if len(v) else v


def _best(score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k largest finite scores of each row; equal ones by key. Only scores up to the k-th are sorted."""
    least = np.partition(score, score.shape[1] - k, 1)[:, score.shape[1] - k, None] if score.shape[1] > k else -np.inf
    i, j = np.nonzero((score >= least) & np.isfinite(score))
    order = np.lexsort((own[j], -score[i, j], i))
    i, j = i[order], j[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k]


def kept_best(parts: Iterator[tuple[np.ndarray, pa.Array, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Of the parts (group, key, score) that a task finds, rows among the k best of their group; equal scores by key. Parts are
    gathered to HELD rows and cut; where that leaves over half of them, what is left is handed on and nothing is kept."""
    kept, n = [], 0

    def cut() -> tuple[np.ndarray, pa.Array, np.ndarray]:
        group, keys, score = np.concatenate([x[0] for x in kept]), pa.concat_arrays([x[1] for x in kept]), np.concatenate([x[2] for x in kept])
        order = np.lexsort((keys.to_numpy(zero_copy_only=False), -score, group))
        group = group[order]
        first = np.arange(len(group)) - np.searchsorted(group, group) < k
        return group[first], keys.take(pa.array(order[first])), score[order[first]]

    for part in parts:
        kept.append(part)
        n += len(part[0])
        if n > HELD:
            best = cut()
            kept, n = ([best], len(best[0])) if 2 * len(best[0]) <= HELD else ([], 0)
            if not kept:
                yield best
    if kept:
        yield cut()


def rrf(dense: DataFrame, sparse: DataFrame, query: str, key: str, weights=(1.0, 1.0), k: int = RRF_K, boost: Column | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of two legs (query, key, rank, ...).

    score adds the dense and then the sparse share; first_seen keeps the order in which a fold over the legs would have
    met the rows. boost is a factor on the sparse share (of columns that both legs carry).
    """
    carried = [c for c in dense.columns if c in sparse.columns and c not in (query, key, "rank", "score")]
    d = dense.select(query, key, *carried, F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank"))
    s = sparse.select(query, key, *carried, F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank"))
    both = d.unionByName(s).groupBy(query, key, *carried).agg(F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank"))
    size = F.count("dense_rank").over(Window.partitionBy(query))
    share = F.lit(float(weights[1])) / (k + F.col("sparse_rank") + 1)
    if boost is not None:
        share = share * boost
    score = F.coalesce(F.lit(float(weights[0])) / (k + F.col("dense_rank") + 1), F.lit(0.0)) + F.coalesce(share, F.lit(0.0))
    return both.withColumn("score", score).withColumn("first_seen", F.coalesce("dense_rank", size + F.col("sparse_rank")))


def demoted(query: str, doc: str, is_front: str) -> Column:
    """Whether a leading title section ties exactly with a section chunk of another document."""
    other = F.when(F.col(is_front), 0).otherwise(1)
    tied = F.sum(other).over(Window.partitionBy(query, "score"))
    own = F.sum(other).over(Window.partitionBy(query, "score", doc))
    return F.col(is_front) & (tied > own)


def fused_order(df: DataFrame, query: str, limit: int, headed: Column | None = None, low: Column | None = None) -> DataFrame:
    """Cut of fused rows: entry-headed rows first, then score, ties demoted as told, then first seen."""
    order = ([headed.desc()] if headed is not None else []) + [F.desc("score")] + ([low.asc()] if low is not None else []) + [F.asc("first_seen")]
    return top(df, [query], order, limit, "rank")


def merge_weighted(lists: DataFrame, query: str, key: str, k: int = RRF_K) -> DataFrame:
    """Sum of w / (k + rank + 1) over lists (list, rank, w); ties by the first list and place that met the key."""
    return lists.groupBy(query, key).agg(
        F.sum(F.col("w") / (k + F.col("rank") + 1)).alias("score"), F.min(F.struct("list", "rank")).alias("first_seen")
    )


def merge_max(lists: DataFrame, query: str, key: str, k: int = RRF_K) -> DataFrame:
    """The best share of a key over the lists, with the same ties."""
    return lists.groupBy(query, key).agg(F.max(F.lit(1.0) / (k + F.col("rank") + 1)).alias("score"), F.min(F.struct("list", "rank")).alias("first_seen"))


def interleave(lists: DataFrame, query: str, key: str, doc: str, limit: int, k: int = RRF_K) -> DataFrame:
    """Lists 0 and 1 alternate over documents: each turn shows a document's first chunk in that list, if no turn before has
    shown the document. Chunks that no turn has shown follow by their best share. Scores are those of the final places.

    A window leaves each list one chunk a document; the turns are one aggregate over a query's two arrays (a leg's depth at
    most), and the tail is the merge by maximum without the chunks shown.
    """
    heads = lists.withColumn("nth", F.row_number().over(Window.partitionBy(query, "list", doc).orderBy("rank"))).where("nth = 1")
    side = lambda n: F.array_sort(F.collect_list(F.when(F.col("list") == n, F.struct("rank", F.col(doc).alias("d"), F.col(key).alias("c")))))
    both = heads.groupBy(query).agg(side(0).alias("a"), side(1).alias("b"))
    fresh = "slice(filter(if(t % 2 = 0, a, b), x -> NOT exists(shown, s -> s.d <=> x.d)), 1, 1)"
    turns = f"aggregate(sequence(1, 2 * greatest(size(a), size(b))), slice(a, 1, 0), (shown, u) -> transform(array(u - 1), t -> concat(shown, {fresh}))[0])"
    shown = both.select(query, F.posexplode(F.expr(turns)).alias("turn", "x")).select(query, F.col("x.c").alias(key), F.col("x.d").alias(doc), "turn")
    rest = merge_max(lists, query, key, k).join(shown, [query, key], "left_anti").join(lists.select(query, key, doc).distinct(), [query, key])
    none = F.lit(None)
    every = shown.select(query, key, doc, "turn", none.cast("double").alias("share"), none.cast("struct<list:int,rank:int>").alias("met")).unionByName(
        rest.select(query, key, doc, none.cast("int").alias("turn"), F.col("score").alias("share"), F.col("first_seen").cast("struct<list:int,rank:int>").alias("met"))
    )
    placed = top(every, [query], [F.asc_nulls_last("turn"), F.desc("share"), F.asc("met")], limit)
    return placed.select(query, key, doc, "rank", (1 / (k + F.col("rank") + 1)).alias("score"))


def diversify(df: DataFrame, query: str, page: str, doc: str, limit: int, per_page: int, per_doc: int, score: str = "score") -> DataFrame:
    """Three phases: within both caps, over the document's cap, over the page's cap (by score). Two row numbers suffice,
    as pages lie within documents."""
    paged = df.withColumn("page_place", F.row_number().over(Window.partitionBy(query, doc, page).orderBy("rank")))
    inside = F.col("page_place") <= per_page
    place = F.sum(F.when(inside, 1).otherwise(0)).over(Window.partitionBy(query, doc).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    phase = F.when(inside & (place <= per_doc), 1).when(inside, 2).otherwise(3)
    staged = paged.withColumn("phase", phase)
    order = [F.asc("phase"), F.when(F.col("phase") == 3, -F.col(score)).asc(), F.asc("rank")]
    return top(staged.withColumnRenamed("rank", "fused_rank").withColumn("rank", F.col("fused_rank")).drop("page_place"), [query], order, limit, "place", 1)


def lexical_scores(df: DataFrame, question: str, passage: str) -> Column:
    """matches / (|question terms| + ln(1 + |passage terms|)), rounded half even to four places."""
    q = F.regexp_extract_all(F.lower(F.col(question)), F.lit("([a-z0-9]{2,})"), F.lit(1))
    t = F.regexp_extract_all(F.lower(F.col(passage)), F.lit("([a-z0-9]{2,})"), F.lit(1))
    hits = F.size(F.filter(t, lambda x: F.array_contains(q, x)))
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(F.bround(hits / (F.size(q) + F.log1p(F.size(t))), 4))


def blended(df: DataFrame, query: str, ce: str, rrf_score: str, key: str, alpha: float, k: int) -> DataFrame:
    """Rerank blend: both scores min-max scaled over the pool (a constant one is 0.5), mixed by alpha."""
    pool = Window.partitionBy(query)

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(pool), F.max(c).over(pool)
        return F.when(hi == lo, 0.5).otherwise((F.col(c) - lo) / (hi - lo))

    mixed = df.withColumn("blend", F.round(alpha * scaled(ce) + (1 - alpha) * scaled(rrf_score), 9))
    return top(mixed, [query], [F.desc("blend"), F.desc(ce), F.desc(rrf_score), F.desc(key)], k, "rank", 1)


def alternate(first: DataFrame, second: DataFrame, query: str, key: str, limit: int) -> DataFrame:
    """Two ranked legs taken by turns, each key once, cut at the larger of the limit and both legs."""
    legs = first.select(query, key, (2 * F.col("rank")).alias("slot")).unionByName(second.select(query, key, (2 * F.col("rank") + 1).alias("slot")))
    size = legs.groupBy(query).agg(F.greatest(F.lit(limit), F.sum(F.expr("if(slot % 2 = 0, 1, 0)")), F.sum(F.expr("if(slot % 2 = 1, 1, 0)"))).alias("cut"))
    one = legs.groupBy(query, key).agg(F.min("slot").alias("slot"))
    placed = one.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("slot")))
    return placed.join(size, query).where("rank <= cut").drop("cut")


def with_fallback(strict: DataFrame, relaxed: DataFrame, queries: DataFrame, query: str) -> DataFrame:
    """Rows of the strict filter, and those of the relaxed one for queries to which the strict one gave none."""
    none = queries.select(query).join(strict.select(query).distinct(), query, "left_anti")
    return strict.withColumn("fallback", F.lit(False)).unionByName(relaxed.join(none, query, "left_semi").withColumn("fallback", F.lit(True)))
