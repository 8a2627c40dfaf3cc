"""Streams with state, replayed in micro-batches, against their batch twins."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from callwatch.operators import audio, inspection, sessions
from callwatch.operators.routing import route_calls
from callwatch.sources import readers, sinks
from callwatch.streaming import jobs, late, stateful

from .test_streaming import T0, drain, feed


def segment():
    return F.concat_ws("_", "session_id", F.col("seq").cast("string"))


def source(spark, path, schema=readers.CALL_SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def frames_feed(tmp_path, batches, name="frames"):
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        file = folder / f"{i:03}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(file, (1_700_000_000 + 10 * i,) * 2)
    return str(folder)


@pytest.fixture(autouse=True)
def one_partition(spark):
    """A Python worker starts for each partition of each micro-batch."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture
def zone(spark, request):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Shanghai"], indirect=True)
def test_sessions_equal_the_rollup_in_every_zone(spark, tmp_path, zone):
    batches = [
        [("a", 0, "start", None, 0), ("a", 0, "chunk", "one 起火", 1), ("a", 1, "chunk", "", 2), ("x", 0, "chunk", "lost", 2)],
        [("a", 3, "chunk", "three", 3), ("a", 2, "chunk", "two", 4), ("a", 2, "chunk", "again", 5), ("b", 0, "start", None, 5), ("b", 0, "chunk", "three", 6)],
        [("a", 4, "stop", None, 7), ("c", 0, "start", None, 8), ("c", 1, "chunk", "贵船超速", 9)],
        [("d", 0, "start", None, 5000)],
        [("d", 1, "chunk", "late", 5001)],
    ]
    path = feed(tmp_path, batches)
    got = {(r.session_id, r.text, r.chunks, r.events, tuple(r.levels), r.status) for r in drain(stateful.session_state(source(spark, path)), f"states_{zone.replace('/', '_')}", tmp_path).collect()}
    assert {g for g in got if g[-1] == "rejected"} == {("x", "", 1, 0, (), "rejected")}
    assert {g[0]: g[-1] for g in got if g[-1] != "rejected"} == {"a": "stopped", "b": "timeout", "c": "timeout"}
    batch = spark.read.schema(readers.CALL_SCHEMA).json(path).filter("kind = 'chunk' and session_id in ('a', 'b', 'c')").dropDuplicates(["session_id", "seq"]).filter("text <> 'again'").withColumn("segment_id", segment())
    rolled = sessions.session_rollup(batch, route_calls(batch, keep=("session_id",)))
    expected = {(r.session_id, r.text, r.chunks, r.events) for r in rolled.collect()}
    kept = {(s, t.replace("again", "two"), n, e) for s, t, n, e, _, status in got if status != "rejected"}
    assert kept == expected


def test_a_chunk_writes_its_own_entry_only(spark, tmp_path):
    path = feed(tmp_path, [[("a", 0, "start", None, 0)], [("a", i, "chunk", f"t{i}", 1 + i) for i in range(50)], [("a", 50, "chunk", "t50", 60)]])
    query = stateful.session_state(source(spark, path)).writeStream.format("memory").queryName("own_entry").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    written = [sum(s["numRowsUpdated"] for s in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"]]
    assert written[1] >= 50 and written[2] <= 5
    entries = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "chunks").load()
    assert entries.count() == 51


def test_late_rows_are_counted(spark, tmp_path):
    path = feed(tmp_path, [[("a", 0, "chunk", "one", 0)], [("a", 1, "chunk", "far", 100_000)], [("b", 1, "chunk", "x", 100_001)], [("a", 2, "chunk", "late", 5), ("a", 3, "chunk", "late", 6), ("b", 2, "chunk", "on time", 100_002)]])
    listener = late.watch_late_rows(spark)
    try:
        df = jobs.dedup_chunks(source(spark, path), "1 minute")
        query = df.writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert late.late_rows(query) == 2
        assert {r.seq for r in spark.table("counted").filter("session_id = 'a'").collect()} == {0, 1}
        for _ in range(50):
            if listener.counts["counted"]:
                break
            time.sleep(0.1)
        assert listener.counts["counted"] == 2
    finally:
        spark.streams.removeListener(listener)


def recordings(seed):
    rng = random.Random(seed)
    out = {}
    for name in ("r1", "r2", "r3", "r4"):
        voiced = []
        while len(voiced) < 120:
            voiced += [True] * rng.randint(1, 14) + [False] * rng.choice([1, 2, 3, 4, 9])
        out[name] = voiced[: rng.randint(60, 120)]
    out["quiet"], out["loud"], out["one"] = [False] * 20, [True] * 47, [True]
    return out


@pytest.mark.parametrize("most", [0, 300])
def test_voiced_runs_equal_the_batch_segments(spark, tmp_path, most):
    rng = random.Random(most)
    rows = []
    for name, voiced in recordings(most + 1).items():
        for i, v in enumerate(voiced):
            if i and i < len(voiced) - 1 and rng.random() < 0.03:
                continue  # a frame that never comes is silent
            rows.append({"audio_id": name, "frame_idx": i, "voiced": v, "final": i == len(voiced) - 1 and name != "loud", "ts": (T0 + dt.timedelta(milliseconds=30 * i)).isoformat()})
    rows.sort(key=lambda r: (r["frame_idx"] + rng.randint(0, 6), r["audio_id"]))  # out of order by up to 180 ms
    rows += rng.sample(rows[-40:], 5)  # delivered again
    batches = [rows[i : i + 150] for i in range(0, len(rows), 150)]
    batches += [[{"audio_id": "end", "frame_idx": 0, "voiced": False, "final": False, "ts": (T0 + dt.timedelta(seconds=s)).isoformat()}] for s in (500, 501)]
    schema = "audio_id string, frame_idx long, voiced boolean, final boolean, ts timestamp"
    path = frames_feed(tmp_path, batches)
    live = drain(stateful.vad_session_stream(source(spark, path, schema), max_segment_ms=most, delay="1 second"), f"runs_{most}", tmp_path)
    batch = spark.read.schema(schema).json(path).filter("audio_id <> 'end'").dropDuplicates(["audio_id", "frame_idx"])
    levels = batch.select("audio_id", "frame_idx", F.when(F.col("voiced"), 2000).otherwise(10).alias("rms"))
    thresholds = levels.select("audio_id").distinct().withColumn("threshold", F.lit(1000.0))
    expected = audio.energy_segments(levels, thresholds, max_segment_ms=most)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, expected.collect()))
    assert live.count() > 10


def test_counters_of_a_stream(spark, tmp_path):
    path = feed(tmp_path, [[("a", 0, "chunk", "本船起火", 0), ("a", 1, "chunk", "超速", 2)], [("a", 2, "chunk", "新海靠泊", 30)], [("a", 3, "chunk", "超速", 70)], [("z", 0, "chunk", "超速", 9000)], [("z", 1, "chunk", "超速", 9001)]])
    events = route_calls(source(spark, path).withColumn("segment_id", segment()), keep=("ts",))
    live = drain(jobs.desk_counters_stream(events), "live_counters", tmp_path).groupBy("channel_id").agg(*[F.sum(c).alias(c) for c in ("risk", "auto", "manual")])
    batch = route_calls(spark.read.schema(readers.CALL_SCHEMA).json(path).withColumn("segment_id", segment()), keep=("ts",))
    early = batch.filter(F.col("ts") < F.lit(T0 + dt.timedelta(seconds=8000)))  # the last two windows are open
    assert [tuple(r) for r in sessions.desk_counters(early).collect()] == [tuple(r) for r in live.collect()] == [("c", 1, 1, 3)]


def test_messages_are_numbered_as_in_the_batch(spark, tmp_path):
    rng = random.Random(3)
    texts = ["本船起火", "新海靠泊", "超速", "嗯", ""]
    batches = [[(rng.choice("ab"), 10 * b + i, "chunk", rng.choice(texts), 10 * b + i // 2) for i in range(10)] for b in range(4)]
    path = feed(tmp_path, batches)
    live = drain(stateful.channel_messages(source(spark, path).withColumn("segment_id", segment())), "numbered", tmp_path)
    batch = spark.read.schema(readers.CALL_SCHEMA).json(path).withColumn("segment_id", segment())
    twin = sessions.ordered_feed(sessions.feed_of_calls(batch, route_calls(batch, keep=("ts", "seq"))))
    got = sorted(map(tuple, live.collect()))
    assert got == sorted(map(tuple, twin.collect())) and [r[1] for r in got] == list(range(1, len(got) + 1))
    assert {(r[0], r[2], r[3]) for r in got} == {tuple(r) for r in sessions.channel_messages(batch, route_calls(batch)).collect()}


def test_a_long_channel_is_numbered_over_several_tasks(spark):
    df = spark.range(0, 5000, 1, 8).select(F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("channel_id"), F.timestamp_seconds(F.col("id") % 100).alias("ts"), F.col("id").alias("seq"), F.lit(0).alias("place"), F.lit("t").alias("type"), F.col("id").cast("string").alias("payload"))
    got = sessions.ordered_feed(df).collect()
    for channel in ("x", "y", None):
        rows = sorted((r.number, r.payload) for r in got if r.channel_id == channel)
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1))
        ids = [int(p) for _, p in rows]
        assert ids == sorted(ids, key=lambda i: (i % 100, i))


def test_messages_of_recordings_and_inspections(spark, tmp_path):
    segments = [{"channel_id": c, "segment_id": f"{c}{i}", "idx": i, "start_ms": 100 * i, "end_ms": 100 * i + 50, "text": t, "ts": (T0 + dt.timedelta(seconds=i)).isoformat(), "final": i == 3} for c in "pq" for i, t in enumerate(["本船起火", "", "超速", "嗯"])]
    schema = "channel_id string, segment_id string, idx long, start_ms long, end_ms long, text string, ts timestamp, final boolean"
    path = frames_feed(tmp_path, [segments[:2] + segments[4:5], segments[2:4] + segments[5:]], "segments")
    live = drain(stateful.recording_messages(source(spark, path, schema)), "recorded", tmp_path)
    batch = spark.read.schema(schema).json(path)
    twin = sessions.recording_messages(batch, route_calls(batch.withColumn("confidence", F.lit(1.0))))
    assert sorted((r.channel_id, r.type, r.payload) for r in live.collect()) == sorted(map(tuple, twin.collect()))
    assert [r.type for r in live.filter("channel_id = 'p'").orderBy("number").collect()][-2:] == ["stream_status"] * 2

    matches = [{"channel_id": "c", "ts": (T0 + dt.timedelta(seconds=i)).isoformat(), "area_id": a, "area_name": f"A{a}", "ship_id": i, "ship_name": f"S{i}", "final": f} for i, (a, f) in enumerate([(1, False), (2, False), (1, True), (2, False), (2, True)])]
    schema = "channel_id string, ts timestamp, area_id long, area_name string, ship_id long, ship_name string, final boolean"
    path = frames_feed(tmp_path, [matches[:2], matches[2:]], "matches")
    live = drain(stateful.inspection_messages(source(spark, path, schema), "{ship}", 5.0, 9200), "inspected", tmp_path)
    batch = spark.read.schema(schema).json(path)
    twin = inspection.inspection_messages(batch, inspection.notices(batch, "{ship}"), "c", 5.0, 9200)
    assert sorted((r.channel_id, r.type, r.payload) for r in live.collect()) == sorted(map(tuple, twin.collect()))
    stages = [json.loads(r.payload).get("stage", "notice") for r in live.orderBy("number").collect()]
    assert stages == ["started", "notice", "started", "notice", "notice", "completed", "notice", "notice", "completed"]


def test_latest_states_are_forgotten_after_the_ttl(spark, tmp_path):
    schema = "task_id long, status string, error string, updated_at long, seq long"

    def step(name, rows, ttl):
        folder, checkpoint = str(tmp_path / name), str(tmp_path / f"ck_{name}")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
        df = stateful.task_latest(spark.readStream.schema(schema).json(folder), ttl)
        out = []
        query = df.writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", checkpoint).trigger(once=True).start()
        assert query.awaitTermination(120)
        held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "latest").load()
        return sorted(out), {r.key.task_id for r in held.collect()}

    assert step("kept", [(1, "queued", "", 1, 1), (2, "running", "", 1, 2)], "1 hour") == ([(1, "queued", ""), (2, "running", "")], {1, 2})
    assert step("kept", [(1, "failed", "timeout", 2, 3), (2, "older", "", 0, 9)], "1 hour") == ([(1, "failed", "timeout")], {1, 2})
    assert step("forgotten", [(1, "queued", "", 1, 1), (2, "running", "", 1, 2)], "1 second")[0]
    time.sleep(1.5)
    assert step("forgotten", [(3, "queued", "", 5, 5)], "1 second")[1] <= {3}


def test_a_batch_of_messages_is_visible_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "out")
    writer = sinks.MessageWriter(out)
    rows = [sinks.Row(key="c", value=f"v{i}") for i in range(4)]

    def broken():
        yield rows[0]
        raise RuntimeError("executor lost")

    first = writer.write(iter(rows[:2]))
    with pytest.raises(RuntimeError):
        writer.write(broken())
    writer.abort([first, None], 0)
    assert [f for _, _, files in os.walk(out) for f in files] == []
    files = [writer.write(iter(rows[:2])), writer.write(iter(rows[2:])), writer.write(iter([]))]
    assert not [d for d in os.listdir(out) if d.startswith("batch=")]
    writer.commit(files, 0)
    writer.commit([writer.write(iter(rows))], 0)  # a replay
    assert sorted(map(tuple, sinks.read_messages(spark, out).collect())) == [("c", f"v{i}", 0) for i in range(4)]


def test_messages_stream_to_a_folder(spark, tmp_path):
    path = feed(tmp_path, [[("a", 0, "chunk", "本船起火", 0)], [("b", 0, "chunk", "新海靠泊", 2)]])
    messages = stateful.channel_messages(source(spark, path).withColumn("segment_id", segment()))
    out = str(tmp_path / "messages")
    sinks.message_stream(messages, out, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    got = sinks.read_messages(spark, out)
    assert got.count() == 6 and {json.loads(r.value)["type"] for r in got.collect()} == set(sessions.CALL_MESSAGES)
    assert got.select("batch").distinct().count() == 2
