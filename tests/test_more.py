"""Sinks, and operators that no query covers."""

import json

import pytest
from pyspark.sql import functions as F

from callwatch.operators import audio, inspection, learning, models, routing, sessions
from callwatch.plans import views
from callwatch.sources import readers, sinks


def test_json_documents(spark):
    stats = spark.createDataFrame([("role", "ship", 3), ("role", "mixed", 1), ("source", "llm", 2)], "dimension string, label string, n long")
    got = json.loads(sinks.label_stats_json(stats).first().json)
    assert got == {"role": {"ship": 3, "mixed": 1}, "source": {"llm": 2}}
    rows = spark.createDataFrame([("m1", "abc", "abc"), ("m1", "abc", "abd"), ("m2", "abc", ""), ("m3", "", "x")], "model string, reference string, prediction string")
    ranked = models.ranked_models(models.eval_models(rows))
    summary = json.loads(sinks.eval_summary(ranked).first().json)
    assert [m["model"] for m in summary["models"]] == ["m1", "m2", "m3"]
    assert [m["model"] for m in summary["qualified"]] == ["m1"]
    scores = models.rank_models(spark.createDataFrame([("a", "p", 5, 0, 0, 0, 5.0), ("b", "p", 5, 1, 0, 0, 2.0)], "asr_model_name string, asr_provider string, samples long, language_guard_hits long, empty_text_hits long, short_text_hits long, score double"))
    one = spark.createDataFrame([("s1", "x"), ("s2", "y"), ("", "z")], "segment_id string, risk string")
    agreement = models.pipeline_agreement(one, one.filter("segment_id = 's1'"), ["risk"])
    report = json.loads(sinks.selection_report(scores, agreement).first().json)
    assert report["top_asr_models"][0]["asr_model_name"] == "a"
    assert report["pipeline_compare"] == {"compared_segments": 1, "agreement_risk": 100.0, "first_rows": 3, "second_rows": 1}


def test_selection_files(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "m", ["x", "y"])], "segment_id string, model string, tags array<string>")
    sinks.write_selection(rows, rows.drop("tags"), str(tmp_path))
    assert readers.read_manifest(spark, f"{tmp_path}/asr_selection_long").first().tags == "x|y"
    sinks.write_events(spark.createDataFrame([("e", "c1"), ("f", "c2")], "event_id string, channel_id string"), str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev")).count() == 2
    sinks.write_manifest(rows, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).first().tags == ["x", "y"]


def test_selection_wide_adds_long_only_segments(spark):
    base = spark.createDataFrame([("s1", "c1")], "segment_id string, clip_path string")
    long = models.guard_columns(spark.createDataFrame([("s1", "c1", "m", "old", 0.1, "", 1), ("s1", "c1", "m", "new", 0.2, "", 2), ("s2", "c2", "m", "x", 0.3, "", 1)], "segment_id string, clip_path string, asr_model_name string, asr_text string, asr_confidence double, asr_error string, ord long"))
    got = {r.segment_id: (r.clip_path, r.asr_text__m, r.asr_text__n) for r in models.selection_wide(base, long, ["m", "n"]).collect()}
    assert got == {"s1": ("c1", "new", None), "s2": ("c2", "x", None)}


def test_audio_bits(spark):
    stereo = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, 4.0)], "audio_id long, i long, channel int, x double")
    assert audio.downmix(stereo).first().x == 3.0
    df = spark.createDataFrame([(bytearray(range(100)),)], "b binary")
    cut = lambda a, b: bytes(df.select(audio.slice_bytes(F.col("b"), F.lit(a), F.lit(b), 1000, 2).alias("x")).first().x)
    assert cut(0, 3) == bytes(range(6))
    assert cut(48, 999) == bytes(range(96, 100))
    assert cut(10, 10) == b""
    a = spark.createDataFrame([("s", 0, "x")], "session_id string, seq long, text string")
    assert {r.variant for r in audio.both_variants(a, a).collect()} == {"original", "denoised"}


def test_areas_by_cells_give_what_a_broadcast_gives(spark, monkeypatch):
    ships = views.ships(spark, "/root/testdata/sf0.001").limit(300)
    areas = views.areas(spark).unionByName(spark.createDataFrame([(5, "", '{"type":"rect","lng1":121.85}'), (6, "", '{"type":"line","x1":1.5,"y1":"x"}')], "area_id long, area_name string, geometry string"))
    pairs = lambda: sorted((r.ship_id, r.area_id) for r in inspection.inspect_ships(ships, areas).collect())
    few = pairs()
    monkeypatch.setattr(inspection, "MOST_AREAS", 0)
    assert pairs() == few and len(few) > 0


def test_ship_tables(spark):
    known = spark.createDataFrame([("custom", "n", "t")], "scenario_id string, scenario_name string, notice_template string")
    new = spark.createDataFrame([(" name ", " tpl "), ("", "x")], "scenario_name string, notice_template string")
    got = {r.scenario_name: r.notice_template for r in inspection.append_scenarios(known, new).collect()}
    assert got == {"n": "t", "name": "tpl"}


@pytest.mark.parametrize(("text", "valid"), [('{"type":"rect","lng1":"1.5"}', True), ('{"type":"circle"}', False), ('{"type":"line","x1":"a"}', False), ("[1]", False), ("", False), (None, False)])
def test_geometry(spark, text, valid):
    g = spark.createDataFrame([(text,)], "t string").select(inspection.parse_geometry(F.col("t")).alias("g")).first().g
    assert (g is not None) == valid


def test_metrics(spark):
    rows = spark.createDataFrame([("high", "high", "ship", "ship", 10), ("high", "normal", "ship", "mixed", 20), ("normal", "high", "ship", "ship", 30), ("normal", "uncertain", "ship", "ship", 40)], "risk string, predicted_risk string, role string, predicted_role string, latency_ms long")
    assert tuple(sessions.desk_metrics(rows).first()) == (0.5, 1, 1, 0.25, 0.75, 25.0)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_splits_are_exact_by_class(spark, share):
    rows = spark.createDataFrame([(f"s{i}", "a" if i % 4 else "b" if i % 8 else None) for i in range(400)] + [("alone", "c")], "segment_id string, label string")
    got = {r.label: (r.n, r.k) for r in learning.stratified_split(rows, "label", share).groupBy("label").agg(F.count("*").alias("n"), F.count_if("held_out").alias("k")).collect()}
    assert got == {x: (n, round(n * share)) for x, n in (("a", 300), ("b", 50), (None, 50), ("c", 1))}
    again = learning.stratified_split(rows.repartition(7), "label", share).filter("held_out").select("segment_id").collect()
    assert sorted(again) == sorted(learning.stratified_split(rows, "label", share).filter("held_out").select("segment_id").collect())
    assert learning.stratified_split(rows.limit(0), "label").count() == 0


def test_ngrams_are_of_characters(spark):
    texts = ["", "a", "🚢é\nx", "aAa", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", learning.char_ngrams(F.coalesce("t", F.lit(""))).alias("g")).collect()
    for r in rows:
        t = r.t or ""
        assert r.g == [t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)]


def test_risk_classifier_on_held_out_texts(spark):
    import random

    rng = random.Random(1)
    text = lambda high: " ".join(rng.choice(["fire", "Mayday", "sinking"] if high and rng.random() < 0.3 else ["berth", "tide", "pilot", "wind"]) for _ in range(20))
    rows = spark.createDataFrame([(i, text(i % 5 == 0), "high" if i % 5 == 0 else "normal") for i in range(200)], "segment_id long, text string, label string")
    split = learning.stratified_split(rows, "label")
    model = learning.train_risk_classifier(split.filter("not held_out"), "text", "label", terms=1 << 14)
    got = learning.classify(model, split.filter("held_out"), "text").collect()
    assert sum(r.label == r.predicted for r in got) >= 0.9 * len(got) == 36


def test_last_result_of_an_id_counts(spark):
    segments = spark.createDataFrame([("1", "p1"), ("2", "p2"), ("3", "p3")], "segment_id string, clip_path string")
    found = spark.createDataFrame([("1", None, "old", 1), ("1", None, "new", 2), (None, "p2", "x", 5), (None, "p2", "y", 4), ("", "", "z", 9)], "segment_id string, clip_path string, asr_text string, n int")
    got = {r.segment_id: r.asr_text for r in models.join_external_results(segments, found, "m", order="n").collect()}
    assert got == {"1": "new", "2": "x", "3": ""}
    a = spark.createDataFrame([("1", "u"), ("1", "v"), ("2", "u"), (None, "u")], "segment_id string, role string")
    b = spark.createDataFrame([("1", "u", 1), ("1", "v", 2), ("2", "u", 1), ("9", "u", 1)], "segment_id string, role string, n int")
    row = models.pipeline_agreement(a, b, ["role"], order="n").first()
    assert (row.compared_segments, row.agreement_role, row.first_rows, row.second_rows) == (3, 66.67, 4, 4)


def test_lexicon_of_too_many_rules(spark, tmp_path, monkeypatch):
    path = tmp_path / "lexicon.json"
    path.write_text('{"ships": [{"canonical": "a", "aliases": ["b"]}, {"canonical": "cc", "aliases": ["d"]}]}')
    assert [n for n, _ in readers.read_lexicon(spark, str(path))] == ["cc", "a"]
    monkeypatch.setattr(readers, "MOST_RULES", 1)
    with pytest.raises(ValueError, match="at most 1 rules"):
        readers.read_lexicon(spark, str(path))


def test_merged_labels(spark):
    kind = "segment_id string, crisis string, crisis_confidence double"
    a = spark.createDataFrame([("1", "crisis", 0.1), ("2", "non_crisis", 0.5), ("3", "uncertain", 0.2)], kind)
    b = spark.createDataFrame([("1", "non_crisis", 0.9), ("2", "uncertain", 0.5), ("4", "crisis", 0.3)], kind)
    got = {r.segment_id: r.crisis for r in routing.merge_pipelines(a, b).collect()}
    assert got == {"1": "crisis", "2": "non_crisis", "3": "uncertain", "4": "crisis"}
