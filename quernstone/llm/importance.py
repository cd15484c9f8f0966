"""Importance resampling: documents drawn by how much more likely their features are in a target than in the corpus.

Every document's features become an array of bucket numbers by higher-order functions, written once. The buckets' counts are
the only thing that scoring shuffles (one row a bucket and task); they make an array of gains, one literal entry a bucket,
and each document's weight is a fold over its own array. The draw adds Gumbel noise from a hash of the id and takes the
highest scores: narrow rows are dealt out by ranges of the score, and the ranges' counts (one number each) tell where each
range's ranks begin, so that no task sees all rows.

Defined results: a null text has no words; a null id is hashed as an empty one and comes after others in ties; repeated rows
each count and are drawn by themselves, in any order if they are equal; an empty table gives an empty result; with an empty
target all gains still follow the formula; only the id and text columns are read, so other columns' names can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reachable
from .common import documents, written

#: Fixed value: a word is a run of digits, small letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ranges that the scores are dealt out by, at least; as many numbers come to the driver.
RANGES = 64


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def features(found: Column, longest: int) -> Column:
    """Runs of 1 to `longest` consecutive words."""

    def of(n: int) -> Column:
        at = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(found, i, n), " "))

    runs = [found, *map(of, range(2, longest + 1))]
    return F.concat(*runs) if len(runs) > 1 else found


def hashed(df: DataFrame, buckets: int, longest: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, buckets (of each feature, in order)."""
    split = df.select(F.col(f"`{id_column}`").alias("doc_id"), words(F.col(f"`{text_column}`")).alias("w"))
    return split.select("doc_id", F.size("w").alias("n_words"), F.transform(features(F.col("w"), longest), lambda w: (F.crc32(w) % buckets).cast("int")).alias("buckets"))


def counts(made: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs; one row a bucket comes to the driver."""
    found = [0] * buckets
    for b, n in made.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        found[b] = n
    return found


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """A bucket's gain: floor(1000 ln(smoothed share in the target / smoothed share in the corpus)), in doubles."""
    n, all_s, all_t = len(corpus), float(sum(corpus) + len(corpus)), float(sum(target) + len(corpus))
    return [math.floor(1000 * math.log((target[b] + 1.0) * all_s / ((corpus[b] + 1.0) * all_t))) for b in range(n)]


def literal(numbers: list[int]) -> Column:
    """An array literal of many whole numbers, folded by the optimiser."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def scored(made: DataFrame, gain: list[int], seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    table = literal(gain)
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    found = made.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"), h.alias("h"))
    return found.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def drawn(df: DataFrame, least_words: int, share: int) -> DataFrame:
    """Replaces n_words by rank: 1, 2, 3, ... of the floor(share N / 100) highest of the N rows with enough words, else null. df is read twice: write it first."""
    ranges = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    can = df.withColumn("can", F.col("n_words") >= least_words).drop("n_words")
    order = [F.col("can").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    dealt = written(can.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    held = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.sum(F.col("can").cast("long")).alias("n")).collect()}  # one number a range
    before = [0]
    for k in range(max(held, default=0)):
        before.append(before[-1] + held.get(k, 0))
    n = sum(held.values()) * share // 100
    last = sum(b < n for b in before) - 1
    rank = F.element_at(literal(before), F.col("range") + 1) + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    top = dealt.where(F.col("range") <= last).withColumn("rank", rank).withColumn("rank", F.when(F.col("can") & (F.col("rank") <= n), F.col("rank")))
    return top.unionByName(dealt.where(F.col("range") > last), allowMissingColumns=True).drop("range", "can")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10000, longest: int = 1, least_words: int = 20, share: int = 10, seed: int = 2024, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; target: a table with texts in a column of the same name."""
    made = written(hashed(docs, buckets, longest, id_column, text_column), "buckets")
    aim = hashed(target.select(F.lit(None).alias(id_column), text_column), buckets, longest, id_column, text_column)
    gain = gains(counts(made, buckets), counts(aim, buckets))
    return drawn(written(scored(made, gain, seed), "scored"), least_words, share)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents by their likeness to the benchmark's texts, a tenth of those with 20 words or more drawn."""
    return resample(documents(spark, sf_dir), reachable(spark).read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


QUERIES = {"op13_importance_resampling": op13_importance_resampling}

#: crc32 of each distinct word by a table of 256 remainders.
ORACLES = {
    "op13_importance_resampling": r"""
WITH steps AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) x(n)),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
aim AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s_word AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM doc) GROUP BY w),
t_word AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM aim) GROUP BY w),
bytes AS (
  SELECT w, list_transform(range(octet_length(encode(w))), lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM s_word UNION SELECT w FROM t_word))),
bucket AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS b FROM bytes, steps),
s_bucket AS (SELECT b, sum(n) AS n FROM s_word JOIN bucket USING (w) GROUP BY b),
t_bucket AS (SELECT b, sum(n) AS n FROM t_word JOIN bucket USING (w) GROUP BY b),
gain AS (
  SELECT k.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s_bucket) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t_bucket) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM range(10000) k(b) LEFT JOIN s_bucket s ON s.b = k.b LEFT JOIN t_bucket t ON t.b = k.b),
weighed AS (SELECT doc_id, sum(g) AS weight FROM (SELECT doc_id, unnest(w) AS w FROM doc) JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
noise AS (
  SELECT doc_id, len(w) AS n_features, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', sha256('2024:' || doc_id)[i]) - 1)::BIGINT)), lambda a, x: 16 * a + x) AS h FROM doc),
score AS (
  SELECT doc_id, n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM noise LEFT JOIN weighed USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM score WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * (SELECT count(*) FROM ranks) // 100 THEN r END AS rank FROM score LEFT JOIN ranks USING (doc_id)
"""
}
