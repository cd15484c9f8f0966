"""Exact token totals for every context limit from a histogram of encoded lengths.

Documents are encoded once and aggregated to (length, documents); suffix sums over the histogram then answer, for each
length taken as a context limit, how many documents and tokens lie at or above it, what a truncation to it keeps, and
which quantile it is. Suffix sums run in blocks of lengths, so no task takes more than one block of the histogram.

Defined results: a null text counts as empty, of length 0; repeated rows count each time; an empty table gives an empty
histogram; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import built
from .common import documents, written

#: Lengths in a block of the suffix sums.
BLOCK = 1024


def histogram(df: DataFrame, ranks_path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many whole texts encode to each length. Counts are summed within tasks first."""
    with open(ranks_path, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = built(file.value, pattern)
        for batch in batches:
            lengths = np.fromiter((len(ids) // 4 for ids in bpe.cache.ids(batch["text"])), np.int64, len(batch))
            found, counts = np.unique(lengths, return_counts=True)
            yield pd.DataFrame({"n_tokens": found, "n": counts})

    counted = df.selectExpr(f"`{text_column}` AS text").mapInPandas(run, "n_tokens long, n long")
    return counted.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length as a limit: documents and tokens at or above it, tokens kept by truncating to it, and its quantile.

    docs_at_least and tokens_at_least are the suffix sums; truncated_tokens is the sum of min(length, limit);
    quantile is the share of documents no longer than the limit.
    """
    hist = written(hist.withColumn("block", F.expr(f"n_tokens div {BLOCK}")), "histogram")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.expr("n_docs * n_tokens")).alias("b_tokens"))
    # a block covers BLOCK lengths, so this side has as many rows as the longest text has thousands of tokens
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    above = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(later), zero).alias("a_docs"),
        F.coalesce(F.sum("b_tokens").over(later), zero).alias("a_tokens"),
        F.sum("b_docs").over(every).alias("all_docs"),
        F.sum("b_tokens").over(every).alias("all_tokens"),
    )
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = hist.join(above, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("a_docs") + F.sum("n_docs").over(down)).alias("docs_at_least"),
        (F.col("a_tokens") + F.sum(F.expr("n_docs * n_tokens")).over(down)).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        F.expr("all_tokens - tokens_at_least + docs_at_least * n_tokens").alias("truncated_tokens"),
        F.expr("(all_docs - docs_at_least + n_docs) / all_docs").alias("quantile"),
        F.col("all_docs").alias("total_docs"),
        F.col("all_tokens").alias("total_tokens"),
    )


def answer(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits: the first histogram length at or above each limit decides.

    limit, docs_over (longer than the limit), truncated_tokens (sum of min(length, limit)).
    """
    asked = F.explode(F.array(*[F.lit(x).cast("long") for x in limits]))
    per = sums.select("*", asked.alias("limit"))
    over = F.col("n_tokens") > F.col("limit")
    return per.groupBy("limit").agg(
        F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.col("n_docs") * F.least("n_tokens", "limit")).alias("truncated_tokens"),
    )


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals for every context limit over all documents, by the byte-level ranks."""
    import public_tokenizers

    return suffix_sums(histogram(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


QUERIES = {"op6_token_counts": op6_token_counts}
