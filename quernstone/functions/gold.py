"""Rules over gold candidates and the arms of a conversation run, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The classes that need something of a chunk, the arms, and the metrics that are averaged and compared.
NEEDS_MESSAGE, NEEDS_KIND = "message_id", ("table", "syntax")
LITERAL, CONDENSED = "literal", "condensed"
RECALLS = ("recall@1", "recall@3", "recall@5", "recall@8", "mrr")
COMPARED = ("recall@1", "recall@5", "mrr")


def eligible_classes(has_messages: Column, kind: Column, classes: Column) -> Column:
    """The classes that a chunk can carry, in the order given; a null kind is none of them, a null flag means no messages."""
    fits = lambda c: F.when(c == NEEDS_MESSAGE, F.coalesce(has_messages, F.lit(False))).when(c.isin(*NEEDS_KIND), F.coalesce(kind == c, F.lit(False))).otherwise(True)
    return F.filter(classes, fits)


def arm_summary(rows: DataFrame) -> DataFrame:
    """One row: of each arm the scored rows, the means of their metrics and the upper median of their retrieval times; the
    condensed arm's upper median of condensing times over all its rows; and the means' differences, condensed less literal.
    A row counts as scored with a recall@1. What has no rows is null. rows has arm, the metrics, retrieval_ms, condense_ms."""
    # of an even number of values the upper middle one: the lower one from the top
    middle = lambda x: F.round(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)"), 1)
    out = []
    for arm in (LITERAL, CONDENSED):
        own = lambda c, arm=arm: F.when((F.col("arm") == arm) & F.col("`recall@1`").isNotNull(), F.col(f"`{c}`"))
        out.append(F.count(own("recall@1")).alias(f"{arm}_n"))
        out += [F.round(F.avg(own(m)), 3).alias(f"{arm}_{m}") for m in RECALLS]
        out.append(middle(f"CASE WHEN arm = '{arm}' AND `recall@1` IS NOT NULL THEN retrieval_ms END").alias(f"{arm}_p50_ms"))
    one = rows.agg(*out, middle(f"CASE WHEN arm = '{CONDENSED}' THEN condense_ms END").alias("condense_p50_ms"))
    return one.select("*", *[F.round(F.col(f"`{CONDENSED}_{m}`") - F.col(f"`{LITERAL}_{m}`"), 3).alias(f"delta_{m}") for m in COMPARED])
