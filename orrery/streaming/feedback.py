"""Streams: usage by forward decay, incremental sync, event-time windows (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import embed
from ..functions.text import normalise_phrase
from ..operators import analyze, feedback, maintain


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Event files of a folder as a stream; ``ts`` becomes a timestamp, which watermarks need."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def forward_weights(events: DataFrame, landmark: float, half_life: float = feedback.USAGE_HALF_LIFE, key: str = "tool_id") -> DataFrame:
    """key, weight: the sum of count * 2**((ts - landmark) / half_life).

    Weights grow with time instead of old ones shrinking, so sums merge in any order and need no timers or custom
    state; ``decayed`` turns them into counts at any moment. Move the landmark when a thousand half-lives have passed.
    """
    grown = F.col("count") * F.pow(F.lit(2.0), (feedback.seconds(F.col("ts")) - landmark) / half_life)
    return events.filter("count > 0").groupBy(key).agg(F.sum(grown).alias("weight"))


def alias_weights(events: DataFrame, landmark: float, half_life: float = feedback.ALIAS_HALF_LIFE) -> DataFrame:
    """tool_id, phrase, weight: as ``forward_weights``, by item and normalised phrase, from events (tool_id, phrase, ts, weight)."""
    phrase = normalise_phrase(F.col("phrase"))
    rows = events.select("tool_id", phrase.alias("phrase"), "ts", F.col("weight").alias("count")).filter((F.col("phrase") != "") & (F.length("phrase") <= feedback.MAX_PHRASE))
    return rows.groupBy("tool_id", "phrase").agg(F.sum(F.col("count") * F.pow(F.lit(2.0), (feedback.seconds(F.col("ts")) - landmark) / half_life)).alias("weight"))


def savings_totals(selections: DataFrame) -> DataFrame:
    """Running totals of selections as they come, the row of ``analyze.savings`` in a stream (complete mode)."""
    return analyze.savings(selections)


def append_sink(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str = "60 seconds") -> StreamingQuery:
    """Append a stream's rows (an audit of selections, usage or alias events) to Parquet, each exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def decayed(weights: DataFrame, as_of: Column, landmark: float, half_life: float = feedback.USAGE_HALF_LIFE) -> DataFrame:
    count = F.col("weight") * F.pow(F.lit(0.5), (as_of - landmark) / half_life)
    return weights.withColumn("count", count).drop("weight").filter(F.col("count") >= feedback.USAGE_FLOOR)


def sync_stream(
    items: DataFrame, store: maintain.VersionedStore, checkpoint: str, on_sync: Callable[[int, dict], None] | None = None, available_now: bool = True, interval: str = "300 seconds",
    embedder: Callable[[DataFrame], DataFrame] | None = None, prune: bool = False,
) -> StreamingQuery:
    """Keep an index in step with a stream of items.

    Each micro-batch is classified against the current version; only new texts are embedded and only partitions with a
    change are written. With ``prune`` a batch is a whole snapshot of its sources, whose other rows are removed. An index
    with vectors needs no ``embedder`` if they are the default one's. Failures are the query's own and retried from the
    checkpoint. ``on_sync`` gets the batch's report.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = maintain.with_text(batch).persist()
        try:
            now = store.current()
            vectors = now is not None and "vector" in now.columns
            made = embedder or (embed.default_embedder() if vectors else lambda df: df)
            counts = store.sync(fresh, made, fresh.select("source_id").distinct(), prune)
            if counts is not None and on_sync is not None:
                on_sync(batch_id, counts)
        finally:
            fresh.unpersist()

    writer = items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def windowed_usage(events: DataFrame, window: str, slide: str | None = None, late: str = "1 day", key: str = "event_type") -> DataFrame:
    """Counts by event-time window (tumbling, or sliding with ``slide``); rows later than ``late`` are dropped by the stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), key).agg(F.count("*").alias("n"))


def session_usage(events: DataFrame, gap: str, late: str = "1 day", key: str = "user_id") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
