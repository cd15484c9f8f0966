"""Feedback as streams: first answers, latest ratings, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.generations import Generations


def first_answers(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Each request's first record; state for a key is dropped after the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def insert_once(table: Generations) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the record a key already has."""

    def run(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates([table.key])
        held = table.current()
        if held is not None:
            fresh = fresh.join(held.select(table.key), table.key, "left_anti")
        table.upsert(fresh)

    return run


def latest_rating(table: Generations, at: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps a key's latest record, whatever order batches come in."""

    def run(batch: DataFrame, epoch: int) -> None:
        held = table.current()
        every = batch if held is None else batch.unionByName(held)
        nth = F.row_number().over(Window.partitionBy(table.key).orderBy(F.desc(at)))
        table.publish(every.withColumn("_nth", nth).where("_nth = 1").drop("_nth"))

    return run


def tumbling(stream: DataFrame, at: str, by: str, value: str, width: str, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window. An extension, like the next two."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def sliding(stream: DataFrame, at: str, by: str, width: str, step: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width, step), by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, at: str, user: str, gap: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), user).agg(F.count("*").alias("n"))
