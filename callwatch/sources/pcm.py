"""Frames and slices of long WAV files, read by ranges of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwatch.runtime import dealt, ship_package

#: Bytes of sound that one row of ranges stands for.
RANGE_BYTES = 8 * 2**20


@dataclass
class Header:
    """Where a file's samples lie; zeros for a file that is no PCM WAV file."""

    rate: int = 0
    channels: int = 0
    width: int = 0
    start: int = 0
    size: int = 0

    @property
    def step(self) -> int:
        return self.channels * self.width


def opened(path: str):
    """A file by path or URI, for reading at any place."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(place)


def header_of(file) -> Header:
    """The header, from the chunks' own headers; samples are not read."""
    total, at, found = file.size(), 12, Header()
    if total < 12:
        return Header()
    file.seek(0)
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return Header()
    while at + 8 <= total:
        file.seek(at)
        chunk = file.read(8)
        size = int.from_bytes(chunk[4:], "little")
        if chunk[:4] == b"fmt ":
            facts = file.read(16)
            if len(facts) < 16 or int.from_bytes(facts[:2], "little") not in (1, 0xFFFE):
                return Header()
            found.channels, found.rate = int.from_bytes(facts[2:4], "little"), int.from_bytes(facts[4:8], "little")
            found.width = (int.from_bytes(facts[14:16], "little") + 7) // 8
        elif chunk[:4] == b"data":
            found.start, found.size = at + 8, min(size, total - at - 8)
            return found if found.step else Header()
        at += 8 + size + size % 2
    return Header()


def levels_of(raw: bytes, channels: int, size: int) -> np.ndarray:
    """Levels of frames of ``size`` samples; the last may be short."""
    samples = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").astype(np.float64).reshape(-1, channels).mean(axis=1)
    starts = np.arange(0, len(samples), size)
    if not len(starts):
        return np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(samples)))
    return np.sqrt(np.add.reduceat(samples**2, starts) / counts).astype(np.int64)


def pcm_frames(spark: SparkSession, path: str, frame_ms: int = 30, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, rate, channels, width, frame_idx, rms) of the WAV files below a path.

    A first pass reads headers and cuts each file into ranges of whole frames;
    ranges are dealt over all tasks, each of which reads its own bytes, so one
    long file is the work of many tasks and never a row. A file that can't be
    read, or isn't 16-bit PCM, has one row without a frame; one that isn't WAV
    has zeros. Files must be where the workers' file systems reach them; for
    other stores see ``readers.pcm_frames_by_file``.
    """
    columns = ["path", "rate", "channels", "width", "first", "offset", "bytes"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name in batch["path"]:
                with opened(name) as file:
                    head = header_of(file)
                size = max(1, head.rate * frame_ms // 1000) * head.step
                if head.width != 2 or head.size < head.step:
                    out.append((name, head.rate, head.channels, head.width, None, 0, 0))
                    continue
                frames = max(1, range_bytes // size)
                out += [(name, head.rate, head.channels, head.width, k * frames, head.start + k * frames * size, min(frames * size, head.size - k * frames * size)) for k in range(-(-head.size // (frames * size)))]
            made = pd.DataFrame(out, columns=columns)
            made["first"] = made["first"].astype("Int64")
            yield made

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if pd.isna(row.first):
                    levels, index = [None], [None]
                else:
                    with opened(row.path) as file:
                        file.seek(row.offset)
                        levels = levels_of(file.read(row.bytes), row.channels, max(1, row.rate * frame_ms // 1000))
                    index = range(int(row.first), int(row.first) + len(levels))
                yield pd.DataFrame({"path": row.path, "rate": row.rate, "channels": row.channels, "width": row.width, "frame_idx": pd.array(index, "Int64"), "rms": pd.array(levels, "Int32")})

    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select("path")
    ranges = files.mapInPandas(cut, "path string, rate int, channels int, width int, first long, offset long, bytes long")
    return dealt(ranges, "path", "offset").mapInPandas(read, "path string, rate int, channels int, width int, frame_idx long, rms int")


def pcm_slices(segments: DataFrame) -> DataFrame:
    """(segment_id, rate, samples) for segments (segment_id, path, start_ms,
    end_ms): the bytes of each, read from its place in the file; what lies beyond
    the end is not there. Empty for files that are no WAV files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, own in batch.groupby("path"):
                with opened(name) as file:
                    head = header_of(file)
                    for row in own.itertuples(index=False):
                        first, last = (min(int(ms) * head.rate // 1000 * head.step, head.size) for ms in (row.start_ms, row.end_ms))
                        file.seek(head.start + first)
                        out.append((row.segment_id, head.rate, file.read(max(0, last - first))))
            yield pd.DataFrame(out, columns=["segment_id", "rate", "samples"])

    spark = segments.sparkSession
    ship_package(spark)
    plain = segments.select(F.col("segment_id").cast("string"), "path", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"))
    return plain.mapInPandas(read, "segment_id string, rate int, samples binary")
