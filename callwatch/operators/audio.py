"""Recordings as time series of frames: thresholds, voiced runs, pieces."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwatch.runtime import map_arrow

AUDIO, FRAME, LEVEL = "audio_id", "frame_idx", "rms"

#: Settings by use: silence and longest segment in ms (0: no limit).
PRESETS = {"service": {"silence_ms": 900, "max_segment_ms": 8000}, "dataset": {"silence_ms": 1200, "max_segment_ms": 0}}


def standard_pcm_filter(headers: DataFrame) -> DataFrame:
    """WAV files of 16 kHz, one channel and two bytes a sample; unreadable ones,
    whose facts are null, don't pass."""
    return headers.filter((F.col("rate") == 16000) & (F.col("channels") == 1) & (F.col("width") == 2) & F.lower("path").endswith(".wav"))


def frame_rms(samples: DataFrame, frame_size: int) -> DataFrame:
    """(audio_id, i, x) -> (audio_id, frame_idx, rms): the root of the mean
    square of each frame, cut to an integer."""
    frame = F.floor(F.col("i") / frame_size).cast("long")
    return samples.groupBy(AUDIO, frame.alias(FRAME)).agg(F.floor(F.sqrt(F.avg(F.col("x") * F.col("x")))).cast("int").alias(LEVEL))


def downmix(samples: DataFrame) -> DataFrame:
    """(audio_id, i, channel, x) -> (audio_id, i, x): the mean over channels."""
    return samples.groupBy(AUDIO, "i").agg(F.avg("x").alias("x"))


def adaptive_threshold(frames: DataFrame, floor: float, noise_pct: float = 20, speech_pct: float = 90, ratio: float = 0.35, mode: str = "adaptive") -> DataFrame:
    """(audio_id, threshold): noise plus a share of what speech stands above it,
    both nearest-rank percentiles of the positive levels; the floor at least,
    and where speech is not above noise. Frames are counted by level first, so
    a recording of any length is one row for each level of 16-bit sound."""
    level = F.when(F.col(LEVEL) > 0, F.col(LEVEL))
    counts = frames.groupBy(AUDIO, level.alias("__level")).agg(F.count(level).alias("__n"))
    whole = Window.partitionBy(AUDIO)
    upto = whole.orderBy(F.asc_nulls_first("__level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("__upto", F.sum("__n").over(upto)).withColumn("__total", F.sum("__n").over(whole))

    def nearest_rank(percent: float) -> Column:
        place = F.bround((F.col("__total") - 1) * min(100.0, max(0.0, percent)) / 100)
        return F.min(F.when(F.col("__upto") > place, F.col("__level")))

    levels = ranked.groupBy(AUDIO).agg(F.max("__total").alias("__total"), nearest_rank(noise_pct).alias("__noise"), nearest_rank(speech_pct).alias("__speech"))
    noise, speech = F.col("__noise"), F.col("__speech")
    fixed = (F.col("__total") == 0) if mode == "adaptive" else F.lit(True)
    value = F.when(fixed, F.lit(float(floor))).when(speech <= noise, F.lit(float(floor))).otherwise(F.greatest(F.lit(float(floor)), noise + (speech - noise) * ratio))
    return levels.select(AUDIO, value.cast("double").alias("threshold"))


def frames_of(ms: int, frame_ms: int) -> int:
    return max(1, ms // frame_ms)


def _voiced(frames: DataFrame, thresholds: DataFrame) -> DataFrame:
    known = thresholds.select(F.col(AUDIO).alias("__a"), "threshold")
    return frames.join(known, F.col(AUDIO) == F.col("__a")).withColumn("voiced", F.col(LEVEL) >= F.col("threshold")).drop("__a")


#: Frames of a recording that one task takes when voiced runs are sought.
STRETCH = 32_768


def energy_segments(frames: DataFrame, thresholds: DataFrame, frame_ms: int = 30, silence_ms: int = 90, min_speech_ms: int = 60, max_segment_ms: int = 0) -> DataFrame:
    """(audio_id, start_ms, end_ms) of the voiced runs of each recording.

    A run ends after enough silent frames; shorter gaps belong to it. It is
    reported one frame past its last voiced one; a run that is open at the end
    of the recording reaches to the last frame. Runs shorter than the least
    speech are left out. With a longest segment, a run is also cut when it has
    that many frames, and goes on at the next voiced frame.

    Recordings are dealt over tasks in stretches of frames; a window in each
    stretch finds the pieces of runs, and only pieces meet by recording.
    """
    silent, least = frames_of(silence_ms, frame_ms), frames_of(min_speech_ms, frame_ms)
    ends = frames.groupBy(F.col(AUDIO).alias("__a")).agg(F.max(FRAME).cast("long").alias("__end"))
    voiced = _voiced(frames, thresholds).filter("voiced").select(AUDIO, F.col(FRAME).cast("long").alias(FRAME)).withColumn("__b", F.floor(F.col(FRAME) / STRETCH))
    order = Window.partitionBy(AUDIO, "__b").orderBy(FRAME)
    new = F.coalesce((F.col(FRAME) - F.lag(FRAME).over(order) > silent).cast("int"), F.lit(1))
    voiced = voiced.withColumn("__new", new).withColumn("__piece", F.sum("__new").over(order)).drop("__new")
    along = Window.partitionBy(AUDIO).orderBy("__b", "__piece")
    pieces = voiced.groupBy(AUDIO, "__b", "__piece").agg(F.min(FRAME).alias("__first"), F.max(FRAME).alias("__last"))
    begins = F.coalesce(F.col("__first") - F.lag("__last").over(along) > silent, F.lit(True))
    pieces = pieces.withColumn("__begin", F.when(begins, F.col("__first"))).withColumn("__run", F.last("__begin", ignorenulls=True).over(along))
    runs = pieces.groupBy(AUDIO, "__run").agg(F.max("__last").alias("__last"))
    start, last, end = F.col("__run"), F.col("__last"), F.col("__end")
    stop = F.when(end - last < silent, end + 1).otherwise(last + 2)
    most = frames_of(max_segment_ms, frame_ms)
    if max_segment_ms > 0:
        runs, start = _cut(voiced, pieces, runs, most), F.col("__start")
        stop = F.when(start + most - 1 <= F.least(last + silent - 1, end), start + most).otherwise(stop)
    placed = runs.join(ends, F.col(AUDIO) == F.col("__a")).withColumn("__stop", stop)
    return placed.filter(F.col("__stop") - start >= least).select(AUDIO, (start * frame_ms).alias("start_ms"), (F.col("__stop") * frame_ms).alias("end_ms"))


def _cut(voiced: DataFrame, pieces: DataFrame, runs: DataFrame, most: int) -> DataFrame:
    """(audio_id, __start, __last): where the segments of at most ``most`` frames
    of each run begin, and the run's last voiced frame. Runs don't depend on each
    other; the voiced frames of those that are long enough to be cut are sorted
    and walked in batches, so that none is held whole."""
    long = F.col("__last") - F.col("__run") >= most
    wanted = pieces.select(AUDIO, "__b", "__piece", "__run").join(runs.filter(long), [AUDIO, "__run"])
    walked = voiced.join(wanted, [AUDIO, "__b", "__piece"]).select(AUDIO, "__run", "__last", FRAME)
    walked = walked.repartition(F.col(AUDIO), F.col("__run")).sortWithinPartitions(AUDIO, "__run", FRAME)
    cut = map_arrow(walked, _starts(most), walked.schema).select(AUDIO, F.col(FRAME).alias("__start"), "__last").distinct()
    return runs.filter(~long).select(AUDIO, F.col("__run").alias("__start"), "__last").unionByName(cut)


def _starts(most: int):
    """Of the sorted voiced frames of runs, those at which a segment begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due = 0
        for batch in batches:
            frame, first = batch.column(FRAME).to_numpy(), batch.column("__run").to_numpy()
            keep = np.zeros(len(frame), bool)
            edges = np.unique(np.concatenate([[0], np.flatnonzero(frame == first), [len(frame)]]))
            for a, b in itertools.pairwise(edges.tolist()):
                if frame[a] == first[a]:
                    due = frame[a]
                while (a := a + int(np.searchsorted(frame[a:b], due))) < b:
                    keep[a] = True
                    due = frame[a] + most
            yield batch.filter(pa.array(keep))

    return run


def fixed_split(recordings: DataFrame, segments: DataFrame, max_ms: int) -> DataFrame:
    """Pieces of recordings (audio_id, total_ms) without a segment: of ``max_ms``
    each, the last one shorter, or the whole where max_ms is 0."""
    left = recordings.join(segments.select(F.col(AUDIO).alias("__a")), F.col(AUDIO) == F.col("__a"), "left_anti").filter("total_ms > 0")
    if max_ms <= 0:
        return left.select(AUDIO, F.lit(0).cast("long").alias("start_ms"), F.col("total_ms").cast("long").alias("end_ms"))
    starts = left.withColumn("start_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_ms").cast("long") - 1, F.lit(max_ms).cast("long"))))
    return starts.select(AUDIO, "start_ms", F.least(F.col("start_ms") + max_ms, F.col("total_ms").cast("long")).alias("end_ms"))


def number_segments(segments: DataFrame) -> DataFrame:
    """With segment_id, numbered from 1 by start in each recording, and duration_ms."""
    n = F.row_number().over(Window.partitionBy(AUDIO).orderBy("start_ms", "end_ms"))
    return segments.withColumn("segment_id", F.format_string("%s_seg_%04d", F.col(AUDIO).cast("string"), n)).withColumn("duration_ms", F.greatest(F.lit(0).cast("long"), F.col("end_ms") - F.col("start_ms")))


#: Time that frames and segments are joined by, beside the recording.
SLICE_MS = 60_000


def slice_frames(frames: DataFrame, segments: DataFrame, frame_ms: int) -> DataFrame:
    """(segment_id, frames, level): frames that lie in each segment, counted and
    averaged. A segment is repeated for each of the ``SLICE_MS`` that it touches,
    and meets the frames of that time only, so a recording of any length is
    joined in many tasks."""
    at = F.col(FRAME) * frame_ms
    first, last = F.floor(F.col("start_ms") / SLICE_MS), F.floor(F.greatest("start_ms", F.col("end_ms") - 1) / SLICE_MS)
    pieces = segments.select(F.col(AUDIO).alias("__a"), "segment_id", "start_ms", "end_ms", F.explode(F.sequence(first, last)).alias("__t"))
    timed = frames.withColumn("__slice", F.floor(at / SLICE_MS))
    same = (F.col(AUDIO) == F.col("__a")) & (F.col("__slice") == F.col("__t")) & (at >= F.col("start_ms")) & (at < F.col("end_ms"))
    return timed.join(pieces, same).groupBy("segment_id").agg(F.count("*").alias("frames"), F.avg(LEVEL).alias("level"))


def slice_bytes(content: Column, start_ms: Column, end_ms: Column, rate: int = 16000, width: int = 2) -> Column:
    """The samples from start to end of headerless mono PCM; what lies beyond the
    end is not there."""
    first = F.floor(start_ms * rate / 1000) * width
    last = F.floor(end_ms * rate / 1000) * width
    return F.substring(content, (first + 1).cast("int"), F.greatest(F.lit(0), last - first).cast("int"))


def stream_chunks(recordings: DataFrame, units: int) -> DataFrame:
    """(audio_id, start_ms, end_ms, is_final): chunks of 60 * units ms; a short
    last one, and one at least."""
    size = 60 * max(1, units)
    total = F.col("total_ms").cast("long")
    starts = recordings.withColumn("start_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(total - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))))
    return starts.select(AUDIO, "start_ms", F.least(F.col("start_ms") + size, total).alias("end_ms"), (F.col("start_ms") + size >= total).alias("is_final"))


def pending_recordings(sources: DataFrame, done: DataFrame) -> DataFrame:
    """Sources (path, mtime) without a valid target (path, mtime, valid) that is
    as new as they are."""
    targets = done.select(F.col("path").alias("__p"), F.col("mtime").alias("__m"), F.col("valid").alias("__v"))
    fresh = (F.col("path") == F.col("__p")) & F.col("__v") & (F.col("__m") >= F.col("mtime"))
    return sources.join(targets, fresh, "left_anti")


def variant_compare(original: DataFrame, denoised: DataFrame) -> DataFrame:
    """(session_id, seq, original_text, denoised_text): both variants' texts side
    by side; null where one lacks the segment."""
    right = denoised.select(F.col("session_id").alias("__s"), F.col("seq").alias("__q"), F.col("text").alias("denoised_text"))
    both = original.join(right, (F.col("session_id") == F.col("__s")) & (F.col("seq") == F.col("__q")), "full")
    return both.select(F.coalesce("session_id", "__s").alias("session_id"), F.coalesce("seq", "__q").alias("seq"), F.col("text").alias("original_text"), "denoised_text")


def both_variants(original: DataFrame, denoised: DataFrame) -> DataFrame:
    """Rows of both with a column ``variant``."""
    return original.withColumn("variant", F.lit("original")).unionByName(denoised.withColumn("variant", F.lit("denoised")), allowMissingColumns=True)


def merge_close_segments(segments: DataFrame, gap_ms: int) -> DataFrame:
    """Segments of a recording that a pause of at most ``gap_ms`` parts are one."""
    order = Window.partitionBy(AUDIO).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start_ms") - reach > gap_ms).cast("int"), F.lit(1))
    return segments.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order)).groupBy(AUDIO, "__run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("__run")
