"""Sharding by sampled splitters, with DataFrame functions only.

Size-weighted samples of the keys give quantile boundaries, records are dealt to the ranges between them, ranges that
turn out overfull are subdivided by boundaries drawn within them, and exact totals of the ranges turn a running sum in
each range into a position in the whole order. Shards are equal cuts of that order, so their sizes differ by less than
the largest record and slots have no gaps.

The key is (hash of the group, id): records of one group are neighbours, and a group larger than a range is cut by id.

Defined results: null groups count as the empty text; a null id sorts first; rows that repeat (same group, same id)
are placed side by side in any order; an empty table gives an empty result; more shards than rows leaves some empty;
other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Bytes that a range holds, before the bounds on the number of ranges.
RANGE_BYTES = 256 << 20
#: Ranges at most; boundaries and totals of this many go through the driver.
MAX_RANGES = 4096
#: Keys drawn for each range (expected), so the driver sees at most about MAX_RANGES * PER_RANGE of them.
PER_RANGE = 24
#: A range is overfull from this many times the mean size.
OVERFULL = 2.0
ROUNDS = 3

LAW = "bytes"


def _at_or_after(b: Column, k1: Column, k2: Column) -> Column:
    return (b["a"] < k1) | ((b["a"] == k1) & (b["b"] <= k2))


def range_index(bounds: list[tuple[int, int]], k1: Column, k2: Column) -> Column:
    """Number of boundaries at or below the key (k1, k2): two short scans, of blocks and then of one block."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    entry = lambda b: F.struct(F.lit(b[0]).cast("long").alias("a"), F.lit(b[1]).cast("long").alias("b"))
    every = F.array(*[entry(b) for b in bounds])
    lasts = bounds[step - 1 :: step]
    if not lasts:
        return F.size(F.filter(every, lambda b: _at_or_after(b, k1, k2)))
    block = F.size(F.filter(F.array(*[entry(b) for b in lasts]), lambda b: _at_or_after(b, k1, k2)))
    inside = F.slice(every, block * step + 1, F.lit(step))
    return block * step + F.size(F.filter(inside, lambda b: _at_or_after(b, k1, k2)))


def _draw(df: DataFrame, seed: int, rate: Column) -> list[tuple[int, int]]:
    """Keys drawn with a chance in proportion to the size, settled by a hash of the key (so that reruns agree)."""
    u = (F.pmod(F.xxhash64(F.col("k1"), F.col("k2"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")
    return [(r[0], r[1]) for r in df.where(u < F.col("size") * rate).select("k1", "k2").sort("k1", "k2").collect()]


def _quantiles(sample: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []


def splitters(df: DataFrame, parts: int | None = None, seed: int = 1) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Boundaries over columns k1, k2 (longs) weighted by size, and (bytes, rows) of each range between them."""
    total = df.agg(F.sum("size")).first()[0] or 0
    parts = min(MAX_RANGES, max(parts or 1, math.ceil(total / RANGE_BYTES)))
    if not total:
        return [], [(0, 0)]
    bounds = sorted(set(_quantiles(_draw(df, seed, F.lit(parts * PER_RANGE / total)), parts)))
    for turn in range(ROUNDS + 1):
        ranged = df.withColumn("range", range_index(bounds, F.col("k1"), F.col("k2")))
        found = {r["range"]: (r["bytes"], r["rows"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        totals = [found.get(i, (0, 0)) for i in range(len(bounds) + 1)]
        over = {i: math.ceil(b / (total / parts)) for i, (b, n) in enumerate(totals) if n > 1 and b > OVERFULL * total / parts}
        if not over or turn == ROUNDS or len(bounds) >= 2 * MAX_RANGES:
            return bounds, totals
        rate = F.create_map(*[F.lit(x) for i, k in over.items() for x in (i, k * PER_RANGE / totals[i][0])])[F.col("range")]
        drawn = _draw(ranged.where(F.col("range").isin(list(over))), seed + turn + 1, rate)
        more: dict[int, list] = {i: [] for i in over}
        edges = iter(enumerate([*bounds, None]))
        at, edge = next(edges)
        for key in drawn:
            while edge is not None and key >= edge:
                at, edge = next(edges)
            if at in more:
                more[at].append(key)
        bounds = sorted({*bounds, *(b for i, keys in more.items() for b in _quantiles(keys, over[i]))})
    raise AssertionError


def by_group(df: DataFrame, group: str, id_column: str, size: Column) -> DataFrame:
    """(id, k1, k2, size, crc32) of each row: what sharding needs of it. The text itself isn't moved."""
    text = text_or_empty(group)
    hashed = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.select(
        F.col(id_column).alias("id"),
        hashed.alias("k1"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("k2"),
        size.cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
    )


def shard_by_bytes(df: DataFrame, shards: int, group: str, id_column: str, size: Column) -> DataFrame:
    """Deals every row to shards of near equal bytes. Returns id, size, crc, shard, slot."""
    keyed = written(by_group(df, group, id_column, size), "keyed")
    bounds, totals = splitters(keyed, parts=4 * shards)
    whole = sum(b for b, _ in totals)
    before_bytes, before_rows = [0], [0]
    for b, n in totals:
        before_bytes.append(before_bytes[-1] + b)
        before_rows.append(before_rows[-1] + n)
    start = lambda v: F.element_at(F.lit(v[:-1]).cast("array<long>"), F.col("range") + 1)
    order = Window.partitionBy("range").orderBy("k1", "k2")
    placed = written(
        keyed.withColumn("range", range_index(bounds, F.col("k1"), F.col("k2")))
        .withColumn("offset", start(before_bytes) + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rank", start(before_rows) + F.row_number().over(order) - 1)
        .select("id", "size", "crc", "rank", F.expr(f"int(least({shards - 1}, (offset * {shards}) div {max(whole, 1)}))").alias("shard")),
        "placed",
    )
    firsts = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("rank")).collect()}
    first = F.element_at(F.lit([firsts.get(i, 0) for i in range(shards)]).cast("array<long>"), F.col("shard") + 1)
    return placed.select("id", "size", "crc", "shard", (F.col("rank") - first).alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, near equal in bytes; equal texts are neighbours."""
    from .common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    placed = shard_by_bytes(docs, 40, "text", "doc_id", F.octet_length(text_or_empty()) + 16)
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op10_sharding": op10_sharding}
