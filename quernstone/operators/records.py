"""Operators over stored records: admission of chunks, edges, pages, plans and repeated cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Requests that one broadcast may hold; more of them go block by block.
REQUESTS = 4096


def admitted(requests: DataFrame, key: str, chunks: DataFrame, rule: Callable[[str, str], Column]) -> DataFrame:
    """(request fields as r, chunk fields as c) of the pairs that a rule admits: a stated set of requests, in blocks of bounded
    size, against one pass over the chunks each."""
    n = requests.count()
    blocks = max(1, -(-n // REQUESTS))
    # dealt by a hash, a block stays near REQUESTS
    parts = [requests.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) if blocks > 1 else requests for b in range(blocks)]
    joined = [chunks.alias("c").join(F.broadcast(p).alias("r"), rule("r", "c")) for p in parts]
    out = joined[0]
    for j in joined[1:]:
        out = out.union(j)
    return out


def edge_page(df: DataFrame, by: list[str], page: str, label: str, lower: bool) -> DataFrame:
    """by, page, label: the first or last page, with the label its chunks agree on (null where they don't; null ones have no say)."""
    pages = df.groupBy(*by, page).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    pick = F.min_by if lower else F.max_by
    held = pages.groupBy(*by).agg(pick(F.struct(F.col(page).alias("page"), "lo", "hi"), page).alias("e"))
    return held.select(*by, F.col("e.page").alias("page"), F.when(F.col("e.lo") == F.col("e.hi"), F.col("e.lo")).alias("label"))


def pinned(fused: DataFrame, leg: DataFrame, query: str, key: str, limit: int) -> DataFrame:
    """(query, key, place): hits of a leg that the fused list holds within its head, in the leg's order, half the limit at most."""
    head = fused.where(F.col("rank") < limit).select(query, key)
    met = leg.groupBy(query, key).agg(F.min("rank").alias("at")).join(head, [query, key], "left_semi")
    place = F.row_number().over(Window.partitionBy(query).orderBy("at"))
    return met.withColumn("place", place).where(F.col("place") <= limit // 2).select(query, key, "place")


def nearest_first(df: DataFrame, hit: str, offset: str, cap: int) -> DataFrame:
    """df with a place: a hit's neighbours by distance, the one after it before the one before it; a side ends at its first gap."""
    side = Window.partitionBy(hit, F.signum(F.col(offset))).orderBy(F.abs(F.col(offset)))
    run = df.withColumn("nth", F.row_number().over(side)).where(F.abs(F.col(offset)) == F.col("nth")).drop("nth")
    placed = run.withColumn("place", F.row_number().over(Window.partitionBy(hit).orderBy(F.abs(F.col(offset)), F.desc(offset))))
    return placed.where(F.col("place") <= cap)


def keyset_page(df: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """The page of rows after a cursor, in the key's order, with whether there are more; it never skips rows by counting them."""
    rows = df.where(F.col(key) > F.lit(cursor)).orderBy(key).limit(limit + 1).withColumn("nth", F.row_number().over(Window.orderBy(key)))
    return rows.withColumn("more", F.max("nth").over(Window.partitionBy()) > limit).where(F.col("nth") <= limit)


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """(key, n) of keys that occur again."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table only, each as often as it is over, with the side; nothing if the tables are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def case_means(cases: DataFrame, repeats: int, outcomes: DataFrame, case: str, turn: str, cell: Column) -> DataFrame:
    """(case, mean): a case's mean over its repeats; a repeat without an outcome counts 0."""
    runs = cases.select(case, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias(turn))
    return runs.join(outcomes, [case, turn], "left").groupBy(case).agg((F.sum(F.coalesce(cell, F.lit(0.0))) / repeats).alias("mean"))


def refused_removals(requested: DataFrame, approved: DataFrame, key: list[str]) -> DataFrame:
    """Requested removals that no approval covers; a plan stands only if there are none."""
    return requested.select(*key).distinct().join(approved.select(*key).distinct(), key, "left_anti")
