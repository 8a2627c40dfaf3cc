"""Readers, sinks and joins on nulls, repeated rows and empty tables."""

import json

from pyspark.sql import functions as F

from callwatch.operators import models, sessions
from callwatch.operators.routing import route_calls
from callwatch.sources import readers, sinks

CALLS = "segment_id string, channel_id string, session_id string, seq long, text string, confidence double, ts timestamp"


def test_manifests_keep_nulls_repeats_and_order_free_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 1.5), ("a", ["x", "y"], 1.5), (None, None, None), ("q,\"r\"\nz", [], 0.0)], "id string, tags array<string>, c double")
    sinks.write_manifest(df, str(tmp_path / "out"))
    got = sorted((tuple(r) for r in readers.read_manifest(spark, str(tmp_path / "out")).collect()), key=str)
    # CSV has no null apart from an empty field
    assert got == sorted([("a", "x|y", "1.5"), ("a", "x|y", "1.5"), (None, None, None), ('q,"r"\nz', None, "0.0")], key=str)
    sinks.write_manifest(df.filter("false"), str(tmp_path / "none"), "parquet")
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_sidecar_texts_of_null_and_repeated_clips(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  said \n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")  # no bytes: as if it were not there
    rows = [("1", f"{tmp_path}/a.wav"), ("1", f"{tmp_path}/a.wav"), ("2", f"file:{tmp_path}/b.wav"), ("3", None), (None, f"{tmp_path}/c.wav")]
    df = spark.createDataFrame(rows, "segment_id string, clip_path string")
    got = sorted((r.segment_id or "", r.text, r.confidence) for r in readers.join_sidecar_text(df, str(tmp_path)).collect())
    assert got == [("", "", 0.0), ("1", "said", 0.86), ("1", "said", 0.86), ("2", "", 0.0), ("3", "", 0.0)]
    assert readers.join_sidecar_text(df.filter("false"), str(tmp_path)).count() == 0


def test_ships_and_scenarios_without_ids_names_or_rows(spark, tmp_path):
    file = tmp_path / "ships.json"
    file.write_text(json.dumps([{"ship_id": "", "ship_name": "A", "lng": 1.0, "lat": 2.0}, {"ship_name": "A", "lng": 1.0, "lat": 2.0}, {"ship_id": "x", "ship_name": None}, {"ship_id": "y", "ship_name": "B", "tonnage_t": None}]))
    got = readers.read_ships(spark, str(file)).collect()
    assert len(got) == 3 and len({r.ship_id for r in got}) == 2
    file.write_text("[]")
    default = spark.createDataFrame([("d", "D")], "ship_id string, ship_name string")
    assert readers.read_ships(spark, str(file), default).collect() == default.collect()
    assert readers.read_scenarios(spark, str(file)).count() == 0


def test_model_details_take_the_last_of_repeated_ids(spark, tmp_path):
    file = tmp_path / "m_details.csv"
    file.write_text('id,audio_path,prediction\n1,a,first\n1,a,last\n,b,\n,b,again\n')
    got = sorted((r.id, r.model, r.prediction) for r in readers.read_model_details(spark, [str(file)]).collect())
    assert got == [("1", "m", "last"), ("b", "m", "again")]


def test_reports_of_nothing(spark):
    stats = spark.createDataFrame([], "dimension string, label string, n long")
    assert json.loads(sinks.label_stats_json(stats).first().json or "{}") == {}
    scores = models.ranked_models(models.eval_models(spark.createDataFrame([], "model string, reference string, prediction string")))
    assert json.loads(sinks.eval_summary(scores).first().json) == {"target_accuracy": 0.8, "models": [], "qualified": []}
    some = models.eval_models(spark.createDataFrame([("m", "", "x"), ("m", None, None), ("n", "ab", "ab"), ("n", "ab", "ab")], "model string, reference string, prediction string"))
    assert {r.model: (r["items"], r.scored_items, r.median_cer) for r in some.collect()} == {"m": (2, 0, None), "n": (2, 2, 0.0)}


def test_calls_with_nulls_and_repeats_are_routed_each(spark):
    rows = [("1", "c", "s", 0, "本船起火", None, None), ("1", "c", "s", 0, "本船起火", None, None), (None, None, None, None, None, None, None), ("2", None, "s", 1, "  ", 0.9, None)]
    calls = spark.createDataFrame(rows, CALLS)
    events = route_calls(calls, keep=("ts", "seq"))
    assert [r.segment_id for r in events.collect()] == ["1", "1"] and events.select("event_id").distinct().count() == 1
    feed = sessions.ordered_feed(sessions.feed_of_calls(calls, events))
    assert sorted((r.channel_id or "", r.number) for r in feed.collect()) == [("", 1), ("", 2), *(("c", i) for i in range(1, 7))]
    assert sessions.ordered_feed(sessions.feed_of_calls(calls, events).filter("false")).count() == 0
    assert route_calls(calls.filter("false")).count() == 0


def test_messages_with_nulls(spark, tmp_path):
    df = spark.createDataFrame([(None, "t", None), ("c", None, "{}")], "channel_id string, type string, payload string")
    writer = sinks.MessageWriter(str(tmp_path / "out"))
    writer.commit([writer.write(iter(sinks.message_rows(df).collect()))], 3)
    assert sorted((r.key or "", r.batch) for r in sinks.read_messages(spark, str(tmp_path / "out")).collect()) == [("", 3), ("c", 3)]


def test_records_come_newest_first(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("b", 3, "y", "x"), ("c", 2, None, None), ("d", None, "x", "")], "segment_id string, t int, text string, reply string").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.segment_id for r in sessions.search_records(df, " x ").collect()] == ["b", "a", "d"]
    assert [r.segment_id for r in sessions.search_records(df, " ").collect()] == ["b", "c", "a", "d"]
