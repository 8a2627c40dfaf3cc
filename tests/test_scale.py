"""Forms for large tables and long recordings give what the plain forms give."""

import itertools
import json
import random
import subprocess
import sys
import time
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from callwatch.functions import automaton
from callwatch.functions import text as T
from callwatch.operators import audio, inspection, learning, quantiles
from callwatch.sources import pcm, readers


def column(spark, texts, f):
    return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_automata_equal_expressions(spark, monkeypatch, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abAB锚船") for _ in range(rng.randint(1, n)))
    words = [word(3) for _ in range(30)] + ["aa", "aa", "AA", "a"]
    rules = [(word(4), [word(3) for _ in range(rng.randint(1, 3))]) for _ in range(25)] + [("", ["ab"]), ("锚", ["", "船船"])]
    texts = [None, "", " ", "x" * 50] + [word(25) + rng.choice(["", " ", "，"]) + word(12) for _ in range(150)]
    plain = [column(spark, texts, lambda x, f=f: f(x, words)) for f in (T.extract_keywords, T.match_keywords)] + [column(spark, texts, lambda x: T.correct_lexicon(x, rules))]
    monkeypatch.setattr(automaton, "FEW", 0)
    large = [column(spark, texts, lambda x, f=f: f(x, words)) for f in (T.extract_keywords, T.match_keywords)] + [column(spark, texts, lambda x: T.correct_lexicon(x, rules))]
    assert plain == large


def test_a_hundred_thousand_rules(spark):
    rules = [(f"Name{i:06}", [f"alias{i:06}", f"n{i:06}x"]) for i in range(100_000)]
    texts = [f"say alias{i:06} then n{i + 1:06}x and alias{i:06}" for i in range(200)]
    began = time.time()
    got = column(spark, texts, lambda x: T.correct_lexicon(x, rules))
    assert [r.text for r in got] == [f"say Name{i:06} then Name{i + 1:06} and Name{i:06}" for i in range(200)]
    assert all(len(r.hits) == 2 for r in got) and time.time() - began < 60


def test_inner_blanks_cost_once(spark):
    text = "a" + " " * 200_000 + "b"
    began = time.time()
    assert column(spark, [text, f"　{text} \n", " ", None], T.trim_ws) == [text, text, "", ""]
    assert time.time() - began < 20


def test_exact_quantiles(spark):
    rng = random.Random(5)
    groups = {"a": [rng.random() for _ in range(999)], "b": [rng.choice([1.0, 2.0, 7.5]) for _ in range(1000)], None: [3.0], "one": [1.0, 2.0], "none": []}
    rows = [(g, v) for g, x in groups.items() for v in x] + [("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.g: r.q for r in quantiles.exact_quantile(df, "g", "v", share, "q").collect()}
        expected = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.lit(share)).alias("q")).collect()}
        assert got == {g: q for g, q in expected.items() if q is not None}
    plan = quantiles.exact_quantile(df, "g", "v", 0.5, "q")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    assert quantiles.exact_quantile(df.filter("false"), "g", "v", 0.5, "q").count() == 0


def test_slices_of_a_day(spark):
    frames = spark.range(0, 24 * 3600 * 1000 // 200, 1, 4).select(F.lit(1).alias("audio_id"), F.col("id").alias("frame_idx"), (F.col("id") % 7).cast("int").alias("rms"))
    rng = random.Random(7)
    segments = [(1, f"s{i}", a := rng.randint(0, 86_000_000), a + rng.choice([0, 1, 200, 5000, 400_000])) for i in range(300)] + [(1, "whole", 0, 86_400_000), (2, "other", 0, 100)]
    df = spark.createDataFrame(segments, "audio_id int, segment_id string, start_ms long, end_ms long")
    sliced = audio.slice_frames(frames, df, 200)
    assert "__slice" in sliced._jdf.queryExecution().optimizedPlan().toString()
    got = {r.segment_id: (r.frames, r.level) for r in sliced.collect()}
    for audio_id, name, start, end in segments:
        inside = [i % 7 for i in range(-(-start // 200), -(-end // 200))] if audio_id == 1 else []
        assert got.get(name) == ((len(inside), pytest.approx(sum(inside) / len(inside))) if inside else None)


def sound(path, samples, rate=16000, channels=1, width=2, extra=False):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(samples.astype("<i2").tobytes() if width == 2 else bytes(len(samples)))
    if extra:  # a chunk before the samples
        raw = path.read_bytes()
        path.write_bytes(raw[:4] + (len(raw) + 6).to_bytes(4, "little") + raw[8:36] + b"LIST" + (5).to_bytes(4, "little") + b"abcde\0" + raw[36:])


def test_frames_of_ranges_equal_those_of_whole_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    sound(tmp_path / "long.wav", rng.integers(-9000, 9000, 16000 * 20 + 77))
    sound(tmp_path / "stereo.wav", rng.integers(-9000, 9000, 2 * 8000), rate=8000, channels=2, extra=True)
    sound(tmp_path / "empty.wav", np.empty(0))
    sound(tmp_path / "eight.wav", np.zeros(100), width=1)
    (tmp_path / "broken.wav").write_bytes(b"RIFFxxxxWAVEfmt ")
    (tmp_path / "text.wav").write_bytes(b"no sound at all")
    (tmp_path / "nothing.wav").write_bytes(b"")
    rows = pcm.pcm_frames(spark, str(tmp_path), 30, range_bytes=50_000)
    whole = readers.pcm_frames_by_file(spark, str(tmp_path), 30)
    key = lambda r: (r[0], -1 if r[4] is None else r[4])
    assert sorted(map(tuple, rows.collect()), key=key) == sorted(map(tuple, whole.collect()), key=key)
    tasks = rows.filter("path like '%long.wav'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_slices_are_read_from_their_places(spark, tmp_path):
    samples = np.random.default_rng(4).integers(-9000, 9000, 16000 * 3)
    sound(tmp_path / "a.wav", samples, extra=True)
    path = f"file:{tmp_path}/a.wav"
    rows = [("x", path, 0, 1000), ("y", path, 1500, 1501), ("z", path, 2900, 9000), ("late", path, 5000, 6000), ("back", path, 100, 50)]
    got = {r.segment_id: bytes(r.samples) for r in pcm.pcm_slices(spark.createDataFrame(rows, "segment_id string, path string, start_ms long, end_ms long")).collect()}
    at = lambda ms: min(ms * 16, len(samples))
    assert got == {n: samples[at(a) : at(b)].astype("<i2").tobytes() for n, _, a, b in rows}


def test_names_are_looked_up_by_their_first_characters(spark, monkeypatch):
    labels = ["主航道A3段", "A", "b2", "锚地", "", None, "x" * 400, "north anchorage", "NORTH"]
    ships = [(f"s{i}", f"n{i}", 100, 9.0, "t", "", label, 0.0, 0.0) for i, label in enumerate(labels)]
    names = ["A3段", "a3", "锚地", "north", "north pier", "xx", "x" * 30, "", "段", "zz", "No"]
    df = spark.createDataFrame(ships, readers.SHIP_SCHEMA)
    areas = spark.createDataFrame([(i, n, "") for i, n in enumerate(names)], "area_id long, area_name string, geometry string")
    pairs = lambda: sorted((r.ship_id, r.area_id) for r in inspection.inspect_ships(df, areas).collect())
    broadcast = pairs()
    monkeypatch.setattr(inspection, "MOST_AREAS", 0)
    began = time.time()
    assert pairs() == broadcast and len(broadcast) > 15 and time.time() - began < 30


def _shapes():
    """Geometries that lack each set of corners, and some with far or odd ones."""
    rng = random.Random(5)
    shapes = []
    for kind, missing in itertools.product(("rect", "line"), range(16)):
        for _ in range(3):
            at = {"lng1": rng.uniform(120, 124), "lat1": rng.uniform(28, 32), "lng2": rng.uniform(120, 124), "lat2": rng.uniform(28, 32)}
            shapes.append({"type": kind, **{k: v for i, (k, v) in enumerate(at.items()) if not missing >> i & 1}})
    far = [{"lng1": -1e9, "lat1": -1e9, "lng2": 1e9, "lat2": 1e9}, {"lat1": 1e12, "lat2": 29}, {"lng1": "NaN", "lng2": 121}, {"lat1": "Infinity", "lat2": "-Infinity"}, {"lng1": 179.99, "lng2": 361}]
    return shapes + [{"type": kind, **f} for kind in ("rect", "line") for f in far]


def test_shapes_without_a_corner_are_joined_by_bands(spark, monkeypatch):
    rng = random.Random(6)
    shapes = _shapes()
    # ships near the shapes' corners and sides, and elsewhere; some without a place, some beyond the globe
    places = [(rng.uniform(119, 125), rng.uniform(27, 33)) for _ in range(150)] + [(None, 29.0), (121.0, None), (None, None), (400.0, 29.0), (121.0, -500.0)]
    for s in shapes[:96]:
        x, y = (s.get(k, 122.0) for k in (rng.choice(["lng1", "lng2"]), rng.choice(["lat1", "lat2"])))
        places.append((x + rng.uniform(-0.015, 0.015), y + rng.uniform(-0.015, 0.015)))
    ships = spark.createDataFrame([(f"s{i}", f"n{i}", 100, 9.0, "t", "", "l", x, y) for i, (x, y) in enumerate(places)], readers.SHIP_SCHEMA)
    # an area of a blank name holds all ships, too
    areas = spark.createDataFrame([(i, "", json.dumps(g)) for i, g in enumerate(shapes)] + [(999, " ", "")], "area_id long, area_name string, geometry string")
    pairs = lambda: sorted((r.ship_id, r.area_id) for r in inspection.inspect_ships(ships, areas).select("ship_id", "area_id").collect())
    broadcast = pairs()
    assert len({a for _, a in broadcast}) > 90
    monkeypatch.setattr(inspection, "MOST_AREAS", 0)
    assert pairs() == broadcast
    monkeypatch.setattr(inspection, "SHIPS_A_SHARE", 40)
    assert pairs() == broadcast
    plan = inspection.inspect_ships(ships, areas)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_areas_without_ships_or_ships_without_areas(spark, monkeypatch):
    monkeypatch.setattr(inspection, "MOST_AREAS", -1)
    ships = spark.createDataFrame([("s", "n", 100, 9.0, "t", "", "l", 121.0, 29.0)], readers.SHIP_SCHEMA)
    areas = spark.createDataFrame([(1, "", '{"type":"rect","lat1":28,"lat2":30}')], "area_id long, area_name string, geometry string")
    assert inspection.inspect_ships(ships, areas).count() == 1
    assert inspection.inspect_ships(ships.limit(0), areas).count() == 0
    assert inspection.inspect_ships(ships, areas.limit(0)).count() == 0


def test_a_split_with_many_classes_is_not_broadcast(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("string").alias("segment_id"), (F.col("id") % 40).cast("string").alias("label"))
    few = sorted(map(tuple, learning.stratified_split(df, "label").collect()))
    monkeypatch.setattr(learning, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, learning.stratified_split(df, "label").collect())) == few


def test_written_tables_can_be_cleared():
    """In a process of its own, as it ends what other tests may read."""
    code = """
from pathlib import Path
from pyspark.sql import SparkSession
from callwatch import runtime
spark = SparkSession.builder.master("local").config("spark.ui.enabled", "false").getOrCreate()
assert runtime.written(spark.range(5)).count() == 5
folder = Path(runtime.shared_dir(spark).removeprefix("file:")) / "tables" / spark.sparkContext.applicationId
assert len(list(folder.iterdir())) == 1
assert runtime.clear_written(spark) and not folder.exists() and not runtime.clear_written(spark)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent, timeout=120)
