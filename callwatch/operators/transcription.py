"""Running a transcription function that the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callwatch.functions import text as T
from callwatch.operators.models import guard_columns
from callwatch.runtime import ship_package, use_rocksdb

Result = tuple[str, float | None, str]


def transcribe(segments: DataFrame, load: Callable[[], Callable[[str], Result]], model: str, provider: str = "local", fail_fast: bool = False, max_bytes: int | None = None) -> DataFrame:
    """The long result table of one model over (segment_id, clip_path and, with
    a size limit, length).

    ``load`` makes the model, once in each Python worker; it is called with a
    path and gives text, confidence and engine. A failure becomes a row with
    empty text, confidence 0 and the error, unless ``fail_fast``; so does a clip
    over the limit. Texts are sanitised and confidences clamped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    if max_bytes is not None and row.length > max_bytes:
                        raise ValueError(f"clip of {row.length} bytes is over the limit of {max_bytes}")
                    call = call or load()
                    text, confidence, engine = call(row.clip_path)
                    out.append((row.segment_id, row.clip_path, text, confidence, engine, ""))
                except Exception as problem:
                    if fail_fast:
                        raise
                    out.append((row.segment_id, row.clip_path, "", 0.0, "", f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(out, columns=["segment_id", "clip_path", "asr_text", "asr_confidence", "asr_model", "asr_error"])

    ship_package(segments.sparkSession)
    columns = ["segment_id", "clip_path", *(["length"] if max_bytes is not None else [])]
    rows = segments.select(*columns).mapInPandas(run, "segment_id string, clip_path string, asr_text string, asr_confidence double, asr_model string, asr_error string")
    clean = rows.withColumn("asr_text", T.sanitize_text(F.col("asr_text"))).withColumn("asr_confidence", T.clamp_confidence(F.col("asr_confidence"), F.lit(None).cast("double")))
    return guard_columns(clean.withColumn("asr_model_name", F.lit(model)).withColumn("asr_provider", F.lit(provider)))


class Listening(StatefulProcessor):
    """A model's cache of bytes for a recording."""

    def __init__(self, step: Callable[[bytes, bytes, bool], tuple[str, bytes]], ttl: int):
        self.step, self.ttl = step, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cache = handle.getValueState("cache", "bytes binary", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        cache = bytes(self.cache.get()[0]) if self.cache.exists() else b""
        out, done = [], False
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            text, cache = self.step(bytes(row.samples), cache, bool(row.is_final))
            done = bool(row.is_final)
            out.append((key[0], row.seq, text))
        if done:
            self.cache.clear()
        else:
            self.cache.update((cache,))
        yield pd.DataFrame(out, columns=["recording", "seq", "text"])

    def close(self) -> None:
        pass


def transcribe_stream(chunks: DataFrame, step: Callable[[bytes, bytes, bool], tuple[str, bytes]], ttl: str = "1 hour") -> DataFrame:
    """(recording, seq, samples, is_final) -> (recording, seq, text) with a model's
    cache of bytes kept for each recording until its final chunk. Chunks of one
    batch are taken in order. A recording without a final chunk is forgotten
    when none has come for the ttl, in processing time."""
    spark = chunks.sparkSession
    ship_package(spark)
    use_rocksdb(spark)
    plain = chunks.select("recording", "seq", "samples", "is_final")
    return plain.groupBy("recording").transformWithStateInPandas(Listening(step, int(pd.Timedelta(ttl).total_seconds() * 1000)), "recording string, seq long, text string", "append", "processingTime")
