"""Bootstrap intervals whose resamples are drawn row by row from a hash, so that parts of a group can be drawn anywhere and added up.

In resample b a row counts as often as a Poisson variable of mean 1, drawn from a hash of the row's key, b and the seed. Each batch
adds up its rows' values and counts for every resample; sums of batches are added by group and resample, and the interval comes
from a group's `resamples` means. Unlike resamples of a fixed size their sizes vary; a resample that drew no row is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Odd factors of the hash of a key, a resample and a seed, and those that mix it.
KEY, RESAMPLE, SEED = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: A hash of 32 bits at or over the k-th of these counts more than k times.
LIMITS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
RESAMPLES, ALPHA = 2000, 0.05


def times(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """(keys, resamples): how often each row counts in each resample."""
    x = keys.astype(np.int64).view(np.uint64)[:, None] * np.uint64(KEY) + np.arange(resamples, dtype=np.uint64)[None, :] * np.uint64(RESAMPLE) + np.uint64(seed * SEED % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return np.searchsorted(np.array(LIMITS, np.uint64), (x ^ (x >> np.uint64(31))) >> np.uint64(32), "right")


def resampled(df: DataFrame, by: str, key: str, value: str, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """(by, b, mean) of every resample of each group. Keys are whole numbers, one a row; rows without a value don't count."""
    kind = df.schema[by].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 2048):
                part = batch.iloc[k : k + 2048]
                drawn = times(part["k"].to_numpy(), resamples, seed)
                for group, at in part.groupby("g", dropna=False).indices.items():
                    own, v = drawn[at], part["v"].to_numpy()[at]
                    yield pd.DataFrame({"g": pd.Series([None if pd.isna(group) else group] * resamples, dtype=object), "b": np.arange(resamples, dtype=np.int32), "total": v @ own, "n": own.sum(0)})

    rows = df.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(key).cast("long").alias("k"), F.col(value).cast("double").alias("v"))
    sums = rows.mapInPandas(run, f"g {kind}, b int, total double, n long").groupBy("g", "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.where("n > 0").select(F.col("g").alias(by), "b", (F.col("total") / F.col("n")).alias("mean"))


def interval(df: DataFrame, by: str, key: str, value: str, resamples: int = RESAMPLES, seed: int = 0, alpha: float = ALPHA, nearest: bool = False) -> DataFrame:
    """(by, n, mean, lo, hi): the percentile interval of a group's mean, interpolated, or at whole places where nearest is set."""
    drawn = resampled(df, by, key, value, resamples, seed).groupBy(by)
    if nearest:
        held = drawn.agg(F.sort_array(F.collect_list("mean")).alias("m"))  # `resamples` numbers a group
        at = lambda q: F.get("m", F.least(F.size("m") - 1, F.floor(F.lit(q) * F.size("m")).cast("int")))
        found = held.select(by, at(alpha / 2).alias("lo"), at(1 - alpha / 2).alias("hi"))
    else:
        found = drawn.agg(F.percentile("mean", alpha / 2).alias("lo"), F.percentile("mean", 1 - alpha / 2).alias("hi"))
    plain = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    joined = plain.withColumnRenamed(by, "_group").join(found, F.col("_group").eqNullSafe(F.col(by)), "left")
    return joined.select(F.col("_group").alias(by), "n", "mean", "lo", "hi")


def sql(rows: str, resamples: int, seed: int, alpha: float, nearest: bool = False) -> str:
    """The same in SQL of DuckDB over rows (g, k, v), with numbers of 128 bits cut to 64."""
    cut = 2**64
    word = lambda x: f"({x}) % {cut}::UHUGEINT"
    shift = lambda x, n: f"xor({x}::UBIGINT, ({x}::UBIGINT) >> {n})::UHUGEINT"
    start = word(f"({word(f'(k::HUGEINT + {cut}::HUGEINT)::UHUGEINT % {cut}::UHUGEINT * {KEY}::UHUGEINT')}) + {word(f'b::UHUGEINT * {RESAMPLE}::UHUGEINT')} + {seed * SEED % cut}::UHUGEINT")
    at = lambda q: f"list_sort(list(mean))[1 + least(count(*) - 1, floor({q} * count(*)))::INT]" if nearest else f"quantile_cont(mean, {q})"
    more = " + ".join(f"(u >= {t})::INT" for t in LIMITS)
    return f"""rs_rows AS ({rows}), rs0 AS (SELECT g, b, v, {start} AS x FROM rs_rows, range({resamples}) r(b) WHERE v IS NOT NULL), rs1 AS (SELECT g, b, v, {word(f'{shift("x", 30)} * {MIX[0]}::UHUGEINT')} AS x FROM rs0),
    rs2 AS (SELECT g, b, v, {word(f'{shift("x", 27)} * {MIX[1]}::UHUGEINT')} AS x FROM rs1), rs3 AS (SELECT g, b, v, xor(x::UBIGINT, x::UBIGINT >> 31) >> 32 AS u FROM rs2), rs4 AS (SELECT g, b, v, {more} AS n FROM rs3),
    rs5 AS (SELECT g, b, sum(v * n) / sum(n) AS mean FROM rs4 GROUP BY g, b HAVING sum(n) > 0),
    ci AS (SELECT p.g, p.n, p.mean, q.lo, q.hi FROM (SELECT g, count(v) AS n, avg(v) AS mean FROM rs_rows GROUP BY g) p LEFT JOIN (SELECT g, {at(alpha / 2)} AS lo, {at(1 - alpha / 2)} AS hi FROM rs5 GROUP BY g) q ON p.g IS NOT DISTINCT FROM q.g)"""
