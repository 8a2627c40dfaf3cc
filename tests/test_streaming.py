"""Streaming jobs give what their batch forms give."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from callwatch.operators import sessions, transcription
from callwatch.operators.routing import route_calls
from callwatch.sources import readers, sinks
from callwatch.streaming import jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def feed(tmp_path, batches):
    """One JSON file for each micro-batch."""
    folder = tmp_path / "feed"
    folder.mkdir()
    for i, rows in enumerate(batches):
        name = folder / f"{i:03}.json"
        name.write_text("\n".join(json.dumps({"session_id": s, "channel_id": "c", "seq": q, "kind": k, "text": t, "confidence": 0.9, "engine": "e", "ts": (T0 + dt.timedelta(seconds=at)).isoformat()}) for s, q, k, t, at in rows))
        os.utime(name, (1_700_000_000 + 10 * i,) * 2)  # files are taken by age
    return str(folder)


def drain(df, name, tmp_path, mode="append", **trigger):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(**(trigger or {"availableNow": True})).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def stream(spark, path):
    return readers.call_stream(spark, path).withColumn("segment_id", F.concat_ws("_", "session_id", F.col("seq").cast("string")))


def test_route_stream(spark, tmp_path):
    path = feed(tmp_path, [[("a", 0, "chunk", "本船起火", 0), ("a", 1, "chunk", "", 1)], [("b", 0, "chunk", "新海靠泊", 2)]])
    got = {(r.segment_id, r.risk_level) for r in drain(jobs.route_stream(stream(spark, path)), "routed", tmp_path).collect()}
    batch = spark.read.schema(readers.CALL_SCHEMA).json(path).withColumn("segment_id", F.concat_ws("_", "session_id", F.col("seq").cast("string")))
    assert got == {(r.segment_id, r.risk_level) for r in route_calls(batch).collect()} == {("a_0", "L1"), ("b_0", "AUTO")}


def test_session_summary(spark, tmp_path):
    path = feed(tmp_path, [[("a", 0, "chunk", "one", 0), ("a", 1, "chunk", "two", 60)], [("a", 2, "chunk", "far", 4000)], [("z", 0, "chunk", "end", 90000)], [("z", 1, "chunk", "end", 90001)]])
    source = spark.readStream.schema(readers.CALL_SCHEMA).option("maxFilesPerTrigger", 1).json(path)
    got = {(r.session_id, r.text, r.chunks) for r in drain(jobs.session_summary(source), "summaries", tmp_path).collect()}
    batch = spark.read.schema(readers.CALL_SCHEMA).json(path)
    every = {(r.session_id, r.text, r.chunks) for r in jobs.session_summary(batch).collect()}
    assert {("a", "one\ntwo", 2), ("a", "far", 1)} <= got <= every


def test_dedup_and_counters(spark, tmp_path):
    path = feed(tmp_path, [[("a", 0, "chunk", "本船起火", 0), ("a", 0, "chunk", "本船起火", 0)], [("a", 0, "chunk", "本船起火", 1), ("a", 1, "chunk", "超速", 2)]])
    once = drain(jobs.dedup_chunks(stream(spark, path)), "once", tmp_path)
    assert once.count() == 2
    batch = spark.read.schema(readers.CALL_SCHEMA).json(path).dropDuplicates(["session_id", "seq"]).withColumn("segment_id", F.col("seq").cast("string"))
    routed = route_calls(batch).join(batch.select(F.col("segment_id").alias("s"), "ts"), F.col("segment_id") == F.col("s"))
    live = jobs.desk_counters_stream(routed).groupBy("channel_id").agg(*[F.sum(c).alias(c) for c in ("risk", "auto", "manual")]).collect()
    assert [tuple(r) for r in live] == [tuple(r) for r in sessions.desk_counters(routed).collect()] == [("c", 1, 0, 2)]


def test_events_are_written_once_for_each_batch(spark, tmp_path):
    df = spark.createDataFrame([("e1", "c"), ("e1", "c"), ("e2", "c")], "event_id string, channel_id string")
    write = sinks.write_events_batch(str(tmp_path / "out"))
    write(df, 0)
    write(df, 0)
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_stream_transcription_keeps_its_cache(spark, tmp_path):
    folder = tmp_path / "chunks"
    rows = [("r", 0, b"a", False), ("r", 1, b"b", False), ("r", 2, b"c", True)]
    schema = "recording string, seq long, samples binary, is_final boolean"
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(folder))

    def step(samples, cache, final):
        return (cache + samples).decode(), cache + samples

    source = spark.readStream.schema(schema).parquet(str(folder))
    got = {r.seq: r.text for r in drain(transcription.transcribe_stream(source, step), "said", tmp_path, once=True).collect()}
    assert got == {0: "a", 1: "ab", 2: "abc"}


def test_message_rows(spark):
    df = spark.createDataFrame([("c", "t", "{}")], "channel_id string, type string, payload string")
    assert json.loads(sinks.message_rows(df).first().value) == {"type": "t", "payload": "{}"}


def test_messages_of_a_stream_are_published_once(spark, tmp_path):
    path = feed(tmp_path, [[("a", 0, "chunk", "本船起火", 0)], [("b", 0, "chunk", "新海靠泊", 2)]])
    batch = spark.read.schema(readers.CALL_SCHEMA).json(path).withColumn("segment_id", F.concat_ws("_", "session_id", F.col("seq").cast("string")))
    write = sinks.publish_messages(str(tmp_path / "out"))
    for _ in range(2):
        write(sessions.channel_messages(batch, route_calls(batch)), 0)
    got = spark.read.json(str(tmp_path / "out"))
    assert got.count() == 2 + 2 * 2 and set(got.columns) == {"key", "value", "batch"}
