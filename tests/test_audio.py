"""Voiced runs against a frame-by-frame model, and files."""

import random
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from callwatch.operators import audio, transcription
from callwatch.sources import readers, sinks


def model(levels, floor, silent, least, most=0):
    """Voiced runs by walking the frames once."""
    out, first, last = [], None, None
    for i, level in enumerate(levels):
        voiced = level >= floor
        if first is None:
            if not voiced:
                continue
            first = i
        if voiced:
            last = i
        if not voiced and i - last >= silent:
            out.append((first, last + 2))
            first = None
        elif most and i - first + 1 >= most:
            out.append((first, i + 1))
            first = None
    if first is not None:
        out.append((first, len(levels)))
    return sorted((a, b) for a, b in out if b - a >= least)


def rank(levels, percent):
    return sorted(levels)[round((len(levels) - 1) * percent / 100)]


def test_thresholds_match_the_model(spark):
    rng = random.Random(5)
    data = {k: [rng.choice([0, 0, 300, 500, rng.randint(1, 4000)]) for _ in range(rng.randint(1, 40))] for k in range(60)} | {99: [0, 0], 98: [None]}
    frames = spark.createDataFrame([(k, i, x) for k, v in data.items() for i, x in enumerate(v)], "audio_id long, frame_idx long, rms int")
    got = {r.audio_id: r.threshold for r in audio.adaptive_threshold(frames, 400).collect()}
    for k, v in data.items():
        some = [x for x in v if x]
        low, high = (rank(some, 20), rank(some, 90)) if some else (0, 0)
        assert got[k] == pytest.approx(max(400, low + (high - low) * 0.35) if high > low else 400), k
    assert audio.adaptive_threshold(frames.limit(0), 400).count() == 0


@pytest.mark.parametrize("stretch", [7, audio.STRETCH])
@pytest.mark.parametrize("cap", [0, 30, 240])
def test_runs_match_the_model(spark, monkeypatch, cap, stretch):
    monkeypatch.setattr(audio, "STRETCH", stretch)
    rng = random.Random(7)
    data = {k: [rng.choice([0, 0, 500, 1500] if k % 2 else [0, 1500, 1500]) for _ in range(rng.randint(1, 60))] for k in range(60)}
    frames = spark.createDataFrame([(k, i, x) for k, v in data.items() for i, x in enumerate(v)], "audio_id long, frame_idx long, rms int")
    fixed = audio.adaptive_threshold(frames, 1000, mode="fixed")
    got = {}
    for r in audio.energy_segments(frames, fixed, 30, 90, 60, cap).collect():
        got.setdefault(r.audio_id, []).append((r.start_ms // 30, r.end_ms // 30))
    for k, v in data.items():
        assert sorted(got.get(k, [])) == model(v, 1000, 3, 2, cap // 30), k


def write_wav(path, levels, rate=16000):
    samples = np.concatenate([np.full(int(rate * s), a, np.int16) for a, s in levels])
    with wave.open(str(path), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(samples.tobytes())


def test_files_to_segments(spark, tmp_path):
    write_wav(tmp_path / "a.wav", [(600, 0.5), (2500, 1), (600, 0.7), (2500, 1), (600, 0.5)])
    write_wav(tmp_path / "b.wav", [(0, 1)])
    (tmp_path / "c.wav").write_bytes(b"no audio")
    rows = readers.pcm_frames_by_file(spark, str(tmp_path), 30)
    assert audio.standard_pcm_filter(rows).select("path").distinct().count() == 2
    frames = rows.filter("frame_idx is not null").withColumnRenamed("path", "audio_id")
    thresholds = audio.adaptive_threshold(frames, 300)
    assert thresholds.filter(F.col("audio_id").endswith("a.wav")).first().threshold > 600
    found = audio.energy_segments(frames, thresholds, 30, 300, 300)
    assert found.count() == 2
    totals = frames.groupBy("audio_id").agg((F.count("*") * 30).alias("total_ms"))
    rest = audio.fixed_split(totals, found, 0).collect()
    assert [(r.start_ms, r.end_ms) for r in rest] == [(0, 1020)]
    numbered = audio.number_segments(found).orderBy("start_ms").collect()
    assert [r.segment_id[-8:] for r in numbered] == ["seg_0001", "seg_0002"]


def test_manifests(spark, tmp_path):
    for name in ("x/one.wav", "x/two.MP3", "clips/made.wav", "note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"x")
    got = readers.scan_audio_manifest(spark, str(tmp_path), "vhf").collect()
    assert sorted((r.audio_id, Path(r.audio_path).name) for r in got) == [("raw_000001", "one.wav"), ("raw_000002", "two.MP3")]
    assert readers.scan_audio_manifest(spark, str(tmp_path), "vhf", include_generated=True).count() == 3
    assert {r.id for r in readers.scan_unlabeled_manifest(spark, str(tmp_path)).collect()} == {"one", "two", "made"}


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 'q"q\nz')], "id string, tags array<string>, note string")
    sinks.write_manifest(df, str(tmp_path / "m"))
    (row,) = readers.read_manifest(spark, str(tmp_path / "m")).collect()
    assert (row.id, row.tags, row.note) == ("a", "x|y", 'q"q\nz')


def test_json_files(spark, tmp_path):
    (tmp_path / "ships.json").write_text('[{"ship_name": "A", "tonnage_t": 5, "draft_m": 1.5, "ship_type": "t", "destination": "d", "position_label": "p", "lng": 121.8, "lat": 29.9}]')
    assert readers.read_ships(spark, str(tmp_path / "ships.json")).first().ship_id.startswith("ship_")
    (tmp_path / "empty.json").write_text("[]")
    default = readers.read_ships(spark, str(tmp_path / "ships.json"))
    assert readers.read_ships(spark, str(tmp_path / "empty.json"), default).count() == 1
    (tmp_path / "lex.json").write_text('{"ships": [{"canonical": "Long Name", "aliases": ["ln", " "]}, {"canonical": "", "aliases": ["z"]}], "locations": [{"canonical": "Pier", "aliases": ["p1"]}]}')
    assert readers.read_lexicon(spark, str(tmp_path / "lex.json")) == [("Long Name", ["ln"]), ("Pier", ["p1"])]
    (tmp_path / "models.json").write_text('{"models": [{"name": "m1", "model": "x"}, {"name": "m2", "model": "y"}]}')
    assert [r.provider for r in readers.read_model_specs(spark, str(tmp_path / "models.json"), ["m2"]).collect()] == ["funasr"]
    with pytest.raises(ValueError, match="no model"):
        readers.read_model_specs(spark, str(tmp_path / "models.json"), ["m9"])
    (tmp_path / "m1_details.csv").write_text("id,audio_path,prediction\n1,a,old\n1,a,new\n2,b,\n")
    got = {r.id: (r.model, r.prediction) for r in readers.read_model_details(spark, [str(tmp_path / "m1_details.csv")]).collect()}
    assert got == {"1": ("m1", "new"), "2": ("m1", "")}
    (tmp_path / "llm.jsonl").write_text('{"id": "s1", "role": "vts", "evidence": "a;b"}\n{"id": "s1", "role": "船方", "evidence": ""}\n{"id": "", "role": "ship"}\n')
    (row,) = readers.read_analysis(spark, str(tmp_path / "llm.jsonl")).collect()
    assert (row.segment_id, row.role, row.automation) == ("s1", "ship", "unknown")


def test_transcription_keeps_errors(spark, tmp_path):
    def load():
        def call(path):
            if "bad" in path:
                raise OSError("no file")
            return "你 好 [x]", 1.7, "stub"

        return call

    rows = spark.createDataFrame([("s1", "ok.wav", 10), ("s2", "bad.wav", 10), ("s3", "ok.wav", 999)], "segment_id string, clip_path string, length long")
    got = {r.segment_id: r for r in transcription.transcribe(rows, load, "m", max_bytes=100).collect()}
    assert (got["s1"].asr_text, got["s1"].asr_confidence, got["s1"].asr_error) == ("你好", 1.0, "")
    assert got["s2"].asr_error == "OSError: no file" and got["s2"].asr_text == ""
    assert got["s3"].asr_error.startswith("ValueError")


def test_sidecar_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\n")
    rows = spark.createDataFrame([("s1", f"{tmp_path}/a.wav"), ("s2", f"{tmp_path}/b.wav")], "segment_id string, clip_path string")
    got = {r.segment_id: (r.text, r.confidence) for r in readers.join_sidecar_text(rows, str(tmp_path)).collect()}
    assert got == {"s1": ("hello", 0.86), "s2": ("", 0.0)}
