"""Structured Streaming jobs over feeds of call chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwatch.functions import lexicons as L
from callwatch.functions import text as T
from callwatch.operators import sessions
from callwatch.operators.routing import route_calls


def route_stream(calls: DataFrame, rules: list[tuple[str, list[str]]] = (), words: list[str] = L.KEYWORDS["stream"]) -> DataFrame:
    """Events of chunks, texts corrected first. Stateless: the same on a batch."""
    fixed = T.correct_lexicon(F.col("text"), list(rules))
    return route_calls(calls.withColumn("text", fixed["text"]).withColumn("keywords", T.extract_keywords(F.col("text"), words)))


def session_summary(calls: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Summaries of sessions that a gap in event time ends: (session_id, started,
    ended, text, chunks). The same on a batch and, in append mode, on a stream."""
    watched = calls.withWatermark("ts", delay)
    rows = watched.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("x"), F.count("*").alias("chunks"))
    said = F.filter(F.transform("x", lambda c: T.text_or_empty(c["text"])), lambda t: t != "")
    return rows.select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), F.array_join(said, "\n").alias("text"), "chunks")


def desk_counters_stream(events: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Counters of each channel in windows of event time."""
    return events.withWatermark("ts", delay).groupBy("channel_id", F.window("ts", window).alias("w")).agg(*sessions.desk_columns())


def dedup_chunks(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Chunks that are delivered again within the watermark count once."""
    return calls.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "seq"])
