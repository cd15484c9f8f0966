"""Neighbours of hits in reading order, where stored fields prove an order.

Each hit sees a window: the chunks of its revision that start within PAGES pages of it, at most WINDOW of them. A page of the
window has a proven order if at most one section continues from before, and of those that begin on it one ends there and one
runs on; a run from the hit goes on as long as ordinals follow each other, or the next section begins with its first chunk.

All grouping is by window, hit or request, which hold a bounded number of rows: WINDOW chunks, or hits times `cap`. Windows
with more chunks are found by counts per page, before any of their chunks is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Pages on either side of a hit, chunks of a window, ordinals that are believed.
PAGES, WINDOW, ORDINALS = 2, 64, 1024


def windows(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of each window (rev, at) that is small enough to be seen whole and whose chunks all have a section. Of chunks:
    chunk_id, rev, section, ordinal, page_start, page_end, product, version, ids."""
    asked = hits.select("chunk_id").distinct().join(chunks.select("chunk_id", "rev", F.col("page_start").alias("at")), "chunk_id").where("rev IS NOT NULL AND at >= 0").select("rev", "at").distinct()
    pages = asked.select("rev", "at", F.explode(F.sequence(F.col("at") - PAGES, F.col("at") + PAGES)).alias("page_start"))
    held = chunks.groupBy("rev", "page_start").agg(F.count("*").alias("n"), F.count("section").alias("known"))
    small = pages.join(held, ["rev", "page_start"]).groupBy("rev", "at").agg(F.sum("n").alias("n"), F.sum("known").alias("known"))
    small = small.where((F.col("n") <= WINDOW) & (F.col("n") == F.col("known"))).select("rev", "at")
    return chunks.join(pages.join(small, ["rev", "at"]), ["rev", "page_start"])


def ordered(rows: DataFrame) -> DataFrame:
    """Adds to each row its place in the window's reading order, whether its page has a proven one, and whether the row before leads to it."""
    key = ["rev", "at"]
    section = Window.partitionBy(*key, "section")
    stats = rows.select(
        "*",
        F.max("page_start").over(section).alias("last_start"), F.max("page_end").over(section).alias("last_end"),
        F.max(F.col("page_end").isNull()).over(section).alias("open_end"),
        (F.count("*").over(section) > F.size(F.collect_set("ordinal").over(section))).alias("twice"), F.max("ordinal").over(section).alias("most"),
        F.min("ordinal").over(Window.partitionBy(*key, "page_start", "section")).alias("first"),
    )
    page = F.col("page_start")
    flagged = stats.select(
        "*",
        ((F.col("last_start") > page) | F.coalesce(F.col("last_end") > page, F.lit(False))).alias("runs_on"),
        ((page < F.col("at") + PAGES) & ~F.col("open_end") & (F.col("last_end") <= page)).alias("ends"),
        (F.coalesce(F.col("twice") | (F.col("most") >= ORDINALS) | (F.col("first") < 0), F.lit(True))).alias("unsure"),
    ).withColumn("kind", F.when(F.col("first") > 0, 0).when(F.col("runs_on"), 2).when(F.col("ends"), 1).otherwise(3))
    # kinds of sections on a page: 0 continues, 1 begins and ends, 2 begins and runs on, 3 begins and may do either
    over = Window.partitionBy(*key, "page_start")
    sections = lambda *kinds: F.size(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("section"))).over(over))
    proven = ~F.max("unsure").over(over) & (sections(0) <= 1) & ((sections(1, 2, 3) <= 1) | ((sections(1) == 1) & (sections(2) == 1) & (sections(3) == 0)))
    told = flagged.withColumn("proven", F.coalesce(proven, F.lit(False)))
    order = Window.partitionBy(*key).orderBy("page_start", "kind", "ordinal", "chunk_id")
    before = F.lag(F.struct("section", "ordinal", "proven")).over(order)
    leads = F.col("proven") & before["proven"] & (F.col("ordinal") == F.when(before["section"] == F.col("section"), before["ordinal"] + 1).otherwise(0))
    names = ["rev", "at", "chunk_id", "section", "ordinal", "page_start", "product", "version", "ids", "proven"]
    return told.select(*names, F.row_number().over(order).alias("place"), F.coalesce(leads, F.lit(False)).alias("led"))


def runs(hits: DataFrame, chunks: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(found, stopped). found: request, rank, offset (before: negative), nth (0 is nearest, the one after before the one before),
    chunk_id, ids. stopped: request, rank, how many of its two directions a rule ended. hits: request, rank, chunk_id, product, version."""
    placed = ordered(windows(hits, chunks))
    at = placed.where("page_start = at").select("rev", "at", "chunk_id", "place", "proven", F.struct("product", "version").alias("own"))
    seen = hits.select("request", "rank", "chunk_id", F.struct("product", "version").alias("asked")).join(at, "chunk_id")
    other = placed.select("rev", "at", F.col("chunk_id").alias("near"), F.col("place").alias("there"), "led", "product", "version", "ids")
    pairs = seen.join(other, ["rev", "at"]).withColumn("offset", F.col("there") - F.col("place"))
    in_scope = lambda c: F.col(c).eqNullSafe(F.col(f"own.{c}")) & ((F.coalesce(f"asked.{c}", F.lit("")) == "") | F.col(c).eqNullSafe(F.col(f"asked.{c}")))
    scope = in_scope("product") & in_scope("version")
    outward = Window.partitionBy("request", "rank", F.signum("offset")).orderBy(F.abs("offset"))
    # walking back, the row nearer to the hit has to be led to by this one
    link = F.when(F.col("offset") > 0, F.col("led")).otherwise(F.lag("led").over(outward))
    first_back = F.max(F.when(F.col("offset") == 0, F.col("led"))).over(Window.partitionBy("request", "rank"))
    walked = pairs.select("*", F.coalesce(link, first_back).alias("link")).where("offset <> 0")
    broken = F.sum((~(F.col("link") & F.col("proven") & scope)).cast("int")).over(outward.rowsBetween(Window.unboundedPreceding, 0)) > 0
    walked = walked.withColumn("broken", broken).where(F.abs("offset") <= cap)
    slots = Window.partitionBy("request", "rank").orderBy(F.abs("offset"), F.col("offset").desc())
    found = walked.where("NOT broken").withColumn("nth", F.row_number().over(slots) - 1).where(F.col("nth") < cap)
    ended = walked.where("broken").groupBy("request", "rank").agg(F.count_distinct(F.signum("offset")).alias("ended"))
    known = seen.select("request", "rank", "proven")
    stops = hits.select("request", "rank").join(known, ["request", "rank"], "left").join(ended, ["request", "rank"], "left")
    stopped = F.when(F.coalesce("proven", F.lit(False)), F.coalesce("ended", F.lit(0))).otherwise(2).cast("long")
    return found.select("request", "rank", F.col("offset").cast("long"), F.col("nth").cast("long"), F.col("near").alias("chunk_id"), "ids"), stops.select("request", "rank", stopped.alias("stopped"))


def placed(hits: DataFrame, found: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """(kept, left): neighbours that get one of a request's slots, and how many of each request were left out for want of one
    (cut) or, where the request names ids, for carrying none of them (skipped). Slots go by distance, then rank; a chunk that
    is a hit, or has a slot, takes none. hits: request, chunk_id, named (null: no rule)."""
    rows = found.join(hits.select("request", "chunk_id"), ["request", "chunk_id"], "left_anti").join(hits.groupBy("request").agg(F.first("named", True).alias("named")), "request")
    rows = rows.withColumn("fits", F.col("named").isNull() | F.coalesce(F.arrays_overlap("named", "ids"), F.lit(False)))
    order = Window.partitionBy("request").orderBy("nth", "rank")
    new = rows.where("fits").withColumn("new", (F.row_number().over(Window.partitionBy("request", "chunk_id").orderBy("nth", "rank")) == 1).cast("int"))
    slots = new.withColumn("slot", F.when(F.col("new") == 1, F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    slots = slots.withColumn("own_slot", F.max("slot").over(Window.partitionBy("request", "chunk_id")))
    left = reduce(DataFrame.unionByName, [
        slots.where(F.col("own_slot") > budget).select("request", F.lit(1).alias("cut"), F.lit(0).alias("skipped")),
        rows.where("NOT fits").select("request", F.lit(0).alias("cut"), F.lit(1).alias("skipped")),
    ])
    return slots.where(F.col("slot") <= budget).select("request", "rank", "offset", "chunk_id"), left.groupBy("request").agg(F.sum("cut").alias("cut"), F.sum("skipped").alias("skipped"))


def expanded(hits: DataFrame, chunks: DataFrame, cap: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """(neighbours, outcome): request, rank of the hit, offset, chunk_id in order of packing (place); and for each request what
    was added, how many hits gained, how many directions a rule stopped, what was cut and what was skipped (null without a rule)."""
    found, stops = runs(hits, chunks, cap)
    kept, left = placed(hits, found, budget)
    gained = kept.groupBy("request").agg(F.count("*").alias("added"), F.count_distinct("rank").alias("hits"))
    asked = hits.groupBy("request").agg(F.max(F.col("named").isNotNull()).alias("ruled"))
    out = asked.join(stops.groupBy("request").agg(F.sum("stopped").alias("stopped")), "request").join(gained, "request", "left").join(left, "request", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    outcome = out.select("request", none("added"), none("hits"), "stopped", none("cut"), F.when(F.col("ruled"), F.coalesce("skipped", F.lit(0))).cast("long").alias("skipped"))
    place = F.row_number().over(Window.partitionBy("request").orderBy("rank", "offset"))
    return kept.select("*", place.cast("long").alias("place")), outcome
