"""Streaming queries over the events table, run to completion and returned as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import shared
from ..sources.tables import table
from ..streaming import feedback


def _stream(spark, d):
    """The events file as a stream (a Parquet source reads folders, so the one file is named by a glob)."""
    batch = table(spark, d, "events")
    found = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events*").parquet(d if not _folder(spark, d) else f"{d}/events.parquet")
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark, d) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def _drained(spark, stream, mode: str):
    """All of a stream's output, through files in the shared folder; where each batch gives the whole result the last one holds.

    Tasks write it, so that nothing of it passes through the driver. State is kept by RocksDB, in memory of bounded size."""
    at, key = shared.folder(spark), "spark.sql.streaming.stateStore.providerClass"

    def write(batch, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows" if mode == "complete" else f"{at}/rows/epoch={epoch}")

    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = None
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        if query is not None:
            query.stop()
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    kinds = stream.schema if mode == "complete" else stream.schema.add("epoch", "long")
    return spark.read.schema(kinds).parquet(f"{at}/rows").select(*stream.columns)


def stream_tumbling(spark, d):
    """Counts by day and type."""
    out = _drained(spark, feedback.tumbling(_stream(spark, d), "ts", "event_type", "value", "1 day"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_sliding(spark, d):
    """Counts by two-day window, a day apart."""
    out = _drained(spark, feedback.sliding(_stream(spark, d), "ts", "event_type", "2 days", "1 day"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_sessions(spark, d):
    """How many sessions, split by an hour's pause, hold how many events."""
    out = _drained(spark, feedback.sessions(_stream(spark, d), "ts", "user_id", "1 hour"), "complete")
    return out.groupBy("n").agg(F.count("*").alias("sessions"))


def stream_first_answers(spark, d):
    """The first record of each type that a user's stream brings within the watermark."""
    once = feedback.first_answers(_stream(spark, d).withColumn("k", F.concat_ws("|", "user_id", "event_type")), "k", "ts", "40 days")
    return _drained(spark, once, "append").select("user_id", "event_type").distinct()


QUERIES = {"ext_stream_tumbling": stream_tumbling, "sm02_stream_first_answers": stream_first_answers, "ext_stream_sliding": stream_sliding, "ext_stream_sessions": stream_sessions}
_GAP = "CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END"
ORACLES = {
    "ext_stream_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "sm02_stream_first_answers": "SELECT DISTINCT user_id, event_type FROM events",
    "ext_stream_sliding": "SELECT strftime(ts::DATE - b, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, (VALUES (0), (1)) x(b) GROUP BY ALL",
    "ext_stream_sessions": f"""SELECT n, count(*) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, {_GAP} AS f FROM events)) GROUP BY ALL) GROUP BY n""",
}
