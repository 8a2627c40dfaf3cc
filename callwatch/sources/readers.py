"""Readers of manifests, label files, lexicons, ships, audio and call feeds."""

from __future__ import annotations

import wave
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwatch.functions import lexicons as L
from callwatch.functions import text as T
from callwatch.operators.models import normalize_analysis
from callwatch.operators.routing import last_wins
from callwatch.runtime import numbered, ship_package
from callwatch.sources.pcm import levels_of

# Audio suffixes, and folders that hold made files.
AUDIO_SUFFIXES = ["wav", "mp3", "m4a", "flac", "aac", "pcm", "ogg"]
MADE_FOLDERS = ["data_pipeline", "vad_segments", "normalized", "asr_selection", "outputs", "clips"]

SHIP_SCHEMA = "ship_id string, ship_name string, tonnage_t int, draft_m double, ship_type string, destination string, position_label string, lng double, lat double"
SCENARIO_SCHEMA = "scenario_id string, scenario_name string, notice_template string"
CALL_SCHEMA = "session_id string, channel_id string, seq long, kind string, text string, confidence double, engine string, ts timestamp"
CHUNK_MS = 1200
#: Rules of a lexicon, which are sent with every plan.
MOST_RULES = 100_000


def ordinals(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with a column that numbers its rows from 1 by ``order``."""
    return numbered(df, [order], name)


def _audio_files(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return files.filter(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$"))


def scan_audio_manifest(spark: SparkSession, root: str, channel_id: str, include_generated: bool = False, suffixes: list[str] = AUDIO_SUFFIXES, generated: list[str] = MADE_FOLDERS) -> DataFrame:
    """(audio_id, audio_path, channel_id, recorded_at) of the audio files below
    ``root``, by path; file contents are not read."""
    found = _audio_files(spark, root, suffixes)
    if not include_generated:
        found = found.filter(~F.arrays_overlap(F.split(F.lower("path"), "/"), T.words_of(generated)))
    return ordinals(found, "path", "n").select(F.format_string("raw_%06d", "n").alias("audio_id"), F.col("path").alias("audio_path"), F.lit(channel_id).alias("channel_id"), F.lit("").alias("recorded_at"))


def scan_unlabeled_manifest(spark: SparkSession, root: str, suffixes: list[str] = AUDIO_SUFFIXES) -> DataFrame:
    """(id, audio_path, transcript): ids are file stems, transcripts blank."""
    stem = F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1)
    files = ordinals(_audio_files(spark, root, suffixes), "path", "n")
    return files.select(F.coalesce(T.nz(stem), F.format_string("clip_%06d", "n")).alias("id"), F.col("path").alias("audio_path"), F.lit("").alias("transcript"))


def read_manifest(spark: SparkSession, path) -> DataFrame:
    """A CSV file with a header; every column is a string."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    """Model labels of a CSV or JSONL file, normalised; of rows with one id, the
    last in the file counts."""
    raw = spark.read.json(path) if path.endswith(".jsonl") else read_manifest(spark, path)
    rows = normalize_analysis(raw).withColumn("__order", F.monotonically_increasing_id())
    return last_wins(rows, ["segment_id"], ["__order"]).drop("__order")


def read_lexicon(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(canonical, aliases) rules of a JSON file with sections ships, locations
    and callsigns, longest names first. Rules are parameters; more than
    ``MOST_RULES`` of them are an error, none is left out."""
    item = "array<struct<canonical:string,aliases:array<string>>>"
    raw = spark.read.schema(f"ships {item}, locations {item}, callsigns {item}").json(path, multiLine=True)
    sections = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("rules")) for i, c in enumerate(("ships", "locations", "callsigns"))]))
    rows = raw.select(sections.alias("s")).select("s.i", F.posexplode("s.rules").alias("j", "r"))
    clean = rows.select("i", "j", T.trim_ws(F.col("r.canonical")).alias("name"), F.filter(F.transform(F.coalesce("r.aliases", F.array().cast("array<string>")), T.trim_ws), lambda a: a != "").alias("aliases"))
    found = clean.filter((F.col("name") != "") & (F.size("aliases") > 0)).orderBy(F.desc(F.length("name")), "i", "j").limit(MOST_RULES + 1)
    rules = [(r["name"], list(r["aliases"])) for r in found.collect()]
    if len(rules) > MOST_RULES:
        raise ValueError(f"a lexicon has at most {MOST_RULES} rules")
    return rules or L.LEXICON


def read_ships(spark: SparkSession, path: str, default: DataFrame | None = None) -> DataFrame:
    """Ships of a JSON array; a missing id depends on name and place. An empty or
    unreadable file gives the default, if there is one."""
    raw = spark.read.schema(SHIP_SCHEMA).json(path, multiLine=True).filter("ship_name is not null")
    print_ = F.concat_ws("_", F.col("ship_name"), F.col("lng").cast("string"), F.col("lat").cast("string"))
    rows = raw.withColumn("ship_id", F.coalesce(T.nz(F.col("ship_id")), F.concat(F.lit("ship_"), F.substring(F.sha1(print_), 1, 10))))
    return default if default is not None and rows.isEmpty() else rows


def read_scenarios(spark: SparkSession, path: str, default: DataFrame | None = None) -> DataFrame:
    rows = spark.read.schema(SCENARIO_SCHEMA).json(path, multiLine=True).filter("scenario_id is not null")
    return default if default is not None and rows.isEmpty() else rows


def read_model_specs(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(name, provider, model, ...) of a JSON file's array ``models``; the
    provider is funasr where none is given. No model at all is an error."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("models").alias("m")).select("m.*")
    rows = rows.withColumn("provider", F.coalesce(T.nz(F.col("provider")), F.lit("funasr")) if "provider" in rows.columns else F.lit("funasr"))
    if names:
        rows = rows.filter(F.col("name").isin(names))
    if rows.isEmpty():
        raise ValueError(f"no model in {path}")
    return rows


def read_model_details(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, model, audio_path, prediction) of files <model>_details.csv; of rows
    with one id in a file, the last counts."""
    rows = read_manifest(spark, paths).withColumn("model", F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1), "_details$", ""))
    key = F.coalesce(T.nz(F.col("id")), T.nz(F.col("audio_path"))) if "id" in rows.columns else T.nz(F.col("audio_path"))
    out = rows.select(key.alias("id"), "model", "audio_path", T.text_or_empty(F.col("prediction")).alias("prediction")).withColumn("__order", F.monotonically_increasing_id())
    return last_wins(out, ["id", "model"], ["__order"]).drop("__order")


def join_sidecar_text(segments: DataFrame, root: str) -> DataFrame:
    """Segments with the text of the .txt file beside their clip, at confidence
    0.86; without one, or with one of no bytes, '' and 0."""
    spark = segments.sparkSession
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"^file:/*", "/"), r"\.[^./]*$", "")
    notes = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(stem(F.col("_metadata.file_path")).alias("__stem"), T.trim_ws(F.col("value")).alias("__text"))
    both = segments.join(notes, stem(F.col("clip_path")) == F.col("__stem"), "left")
    return both.withColumn("text", F.coalesce("__text", F.lit(""))).withColumn("confidence", F.when(F.col("__text").isNotNull(), F.lit(0.86)).otherwise(F.lit(0.0))).drop("__stem", "__text")


def frame_levels(content: bytes, frame_ms: int) -> tuple[int, int, int, np.ndarray]:
    """Rate, channels, width and the levels of a PCM file's frames; the last
    frame may be short. Zeros and no levels for what can't be read."""
    try:
        with wave.open(BytesIO(content)) as f:
            rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return 0, 0, 0, np.empty(0, np.int64)
    if width != 2:
        return rate, channels, width, np.empty(0, np.int64)
    return rate, channels, width, levels_of(raw, channels, max(1, rate * frame_ms // 1000))


def pcm_frames_by_file(spark: SparkSession, path: str, frame_ms: int = 30) -> DataFrame:
    """(path, rate, channels, width, frame_idx, rms) of WAV files, each of
    which one task reads whole: for stores that only Spark reaches. Elsewhere
    ``pcm.pcm_frames`` reads ranges of bytes. A file that can't be read has one
    row with zeros and null frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rate, channels, width, levels = frame_levels(bytes(content), frame_ms)
                n = max(1, len(levels))
                index = pd.array(range(len(levels)), "Int64") if len(levels) else pd.array([None], "Int64")
                yield pd.DataFrame({"path": [name] * n, "rate": rate, "channels": channels, "width": width, "frame_idx": index, "rms": pd.array(levels if len(levels) else [None], "Int32")})

    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, rate int, channels int, width int, frame_idx long, rms int")


def call_stream(spark: SparkSession, path: str, schema: str = CALL_SCHEMA) -> DataFrame:
    """A feed of chunks as JSON files, with start and end in ms by place in the
    session."""
    feed = spark.readStream.schema(schema).json(path)
    return feed.withColumn("start_ms", F.col("seq") * CHUNK_MS).withColumn("end_ms", (F.col("seq") + 1) * CHUNK_MS)
