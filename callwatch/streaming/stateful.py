"""Jobs that keep state for each key: sessions, recordings, channels, tasks.

All use ``transformWithState`` and so the RocksDB state store, which
``runtime.use_rocksdb`` sets for a session. Event times reach the processors as epoch
milliseconds, whatever the session's time zone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callwatch.operators import sessions
from callwatch.operators.audio import frames_of
from callwatch.operators.inspection import notices
from callwatch.operators.routing import call_level, route_calls
from callwatch.runtime import ship_package, use_rocksdb

def _ms(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


class _Timer:
    """The one event-time timer of a key: when it is due is kept, so that a later
    one takes its place."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.handle, self.due = handle, handle.getValueState(name, "due long")

    def set(self, at: int) -> None:
        old = self.due.get() if self.due.exists() else None
        if old is not None and old[0] != at:
            self.handle.deleteTimer(old[0])
        if old is None or old[0] != at:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def later(self, at: int) -> None:
        """Puts the timer off, but never forward."""
        if not self.due.exists() or self.due.get()[0] < at:
            self.set(at)

    def clear(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def is_due(self, at: int) -> bool:
        return self.due.exists() and self.due.get()[0] == at


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """What one key has in a micro-batch, in order."""
    return pd.concat(list(batches)).sort_values(order, kind="stable")


SUMMARY = "session_id string, text string, chunks long, events long, levels array<string>, status string"


class SessionProcessor(StatefulProcessor):
    """Chunks by seq in a map, so that a chunk writes its own entry only."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "seq long", "text string, level string")
        self.begun = handle.getValueState("begun", "yes boolean")
        self.timer = _Timer(handle, "end")

    def _summary(self, session: str, status: str) -> pd.DataFrame:
        said = [value for _, value in sorted((key[0], tuple(value)) for key, value in self.chunks.iterator())]
        levels = [level for _, level in said if level]
        row = (session, "\n".join(text for text, _ in said if text), len(said), len(levels), levels, status)
        for state in (self.chunks, self.begun, self.timer):
            state.clear()
        return pd.DataFrame([row], columns=[c.split()[0] for c in SUMMARY.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = _rows(rows, ["at", "seq"])
        begun, rejected = self.begun.exists(), 0
        for row in batch.itertuples(index=False):
            if row.kind == "start":
                begun = True
            elif row.kind == "stop":
                if begun:
                    yield self._summary(key[0], "stopped")
                begun = False
            elif not begun:
                rejected += 1
            elif not self.chunks.containsKey((int(row.seq),)):
                self.chunks.updateValue((int(row.seq),), (row.text or "", row.level or ""))
        if rejected:
            yield pd.DataFrame([(key[0], "", rejected, 0, [], "rejected")], columns=[c.split()[0] for c in SUMMARY.split(", ")])
        if begun:
            self.begun.update((True,))
            self.timer.later(int(batch["at"].max()) + self.wait)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.timer.is_due(expiredTimerInfo.getExpiryTimeInMs()):
            yield self._summary(key[0], "timeout")

    def close(self) -> None:
        pass


def session_state(calls: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """One summary for each session of (session_id, seq, kind, text, ts): kind
    start begins it, chunk adds text and the event that its text gives rise to,
    stop ends it. Chunks that come while no session is open are rejected, with
    their number. Event time past the timeout ends a session that no stop has.
    A seq that is delivered twice counts once; a null seq is 0."""
    ship_package(calls.sparkSession)
    use_rocksdb(calls.sparkSession)
    plain = calls.select("session_id", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "kind", "text", "ts", F.unix_millis("ts").alias("at"), F.coalesce(call_level(F.col("text")), F.lit("")).alias("level"))
    return plain.withWatermark("ts", timeout).groupBy("session_id").transformWithStateInPandas(SessionProcessor(_ms(timeout)), SUMMARY, "append", "eventTime")


class VoicedRuns(StatefulProcessor):
    """The run of a recording that is open, and frames that came before their turn."""

    def __init__(self, frame_ms: int, silent: int, least: int, most: int, wait: int):
        self.frame_ms, self.silent, self.least, self.most, self.wait = frame_ms, silent, least, most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.early = handle.getMapState("early", "frame long", "voiced boolean, at long, final boolean")
        # next frame, first and last voiced frame of the open run (-1: none)
        self.place = handle.getValueState("place", "next long, first long, last long, seen long")
        self.hole, self.end = _Timer(handle, "hole"), _Timer(handle, "end")

    def _load(self) -> None:
        self.next, self.first, self.last, self.seen = self.place.get() if self.place.exists() else (0, -1, -1, 0)
        self.found: list[tuple[int, int]] = []

    def _run(self, stop: int) -> None:
        if stop - self.first >= self.least:
            self.found.append((self.first * self.frame_ms, stop * self.frame_ms))
        self.first = -1

    def _reach(self, frame: int) -> None:
        """Closes the open run if the frames before ``frame`` do."""
        if self.first < 0:
            return
        cut = self.first + self.most - 1
        if self.most and cut <= self.last + self.silent - 1 and cut < frame:
            self._run(self.first + self.most)
        elif frame - self.last > self.silent:
            self._run(self.last + 2)

    def _take(self, frame: int, voiced: bool) -> None:
        if voiced:
            self._reach(frame)
            self.first, self.last = frame if self.first < 0 else self.first, frame
        self._reach(frame + 1)
        self.next = frame + 1

    def _finish(self) -> None:
        """The recording ends before frame ``next``: an open run reaches it unless
        enough silence went before."""
        if self.first >= 0:
            self._run(self.next)
        for state in (self.early, self.place, self.hole, self.end):
            state.clear()

    def _drain(self, skip: bool = False) -> None:
        """Takes the frames whose turn it is; with ``skip``, those past a hole too,
        as its frames are late by now and count as silent."""
        waiting = sorted((k[0], bool(v[0]), v[1], bool(v[2])) for k, v in self.early.iterator())
        for frame, voiced, _, final in waiting:
            if frame > self.next and not skip:
                break
            skip = False
            self.early.removeKey((frame,))
            if frame >= self.next:
                self._take(frame, voiced)
            if final:
                self._finish()
                return
        left = [w[2] for w in waiting if w[0] >= self.next]
        if left:
            self.hole.set(min(left))
        else:
            self.hole.clear()
        self.place.update((self.next, self.first, self.last, self.seen))
        self.end.later(self.seen + self.wait)

    def _out(self, recording: Any) -> pd.DataFrame:
        return pd.DataFrame([(recording, a, b) for a, b in self.found], columns=["audio_id", "start_ms", "end_ms"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        self._load()
        batch = _rows(rows, ["frame_idx"])
        done = False
        for row in batch.itertuples(index=False):
            self.seen = max(self.seen, int(row.at))
            if row.frame_idx == self.next and not done:
                self._take(int(row.frame_idx), bool(row.voiced))
                if row.final:
                    self._finish()
                    done = True
            elif row.frame_idx > self.next and not done:
                self.early.updateValue((int(row.frame_idx),), (bool(row.voiced), int(row.at), bool(row.final)))
        if not done:
            self._drain()
        yield self._out(key[0])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._load()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.end.is_due(at):
            for frame, value in sorted((k[0], tuple(v)) for k, v in self.early.iterator()):
                self._take(frame, bool(value[0]))
            self._finish()
        elif self.hole.is_due(at):
            self._drain(skip=True)
        yield self._out(key[0])

    def close(self) -> None:
        pass


def vad_session_stream(frames: DataFrame, frame_ms: int = 30, silence_ms: int = 90, min_speech_ms: int = 60, max_segment_ms: int = 0, delay: str = "10 seconds", timeout: str = "1 minute") -> DataFrame:
    """(audio_id, start_ms, end_ms) of voiced runs as frames (audio_id, frame_idx
    from 0, ts, voiced, final) arrive, by the rules of
    ``operators.audio.energy_segments``: one frame more than the last voiced
    one, open tails, least length, and cuts at a longest segment.

    Frames may arrive in any order within the delay; a frame that has not come by
    then is silent. A recording ends with its final frame, or without one when
    event time is past the timeout. A frame that is delivered twice counts once.
    """
    ship_package(frames.sparkSession)
    use_rocksdb(frames.sparkSession)
    runs = VoicedRuns(frame_ms, frames_of(silence_ms, frame_ms), frames_of(min_speech_ms, frame_ms), frames_of(max_segment_ms, frame_ms) if max_segment_ms > 0 else 0, _ms(timeout))
    plain = frames.select("audio_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.coalesce("voiced", F.lit(False)).alias("voiced"), F.coalesce("final", F.lit(False)).alias("final"), "ts", F.unix_millis("ts").alias("at")).filter("frame_idx is not null")
    kind = frames.schema["audio_id"].dataType.simpleString()
    return plain.withWatermark("ts", delay).groupBy("audio_id").transformWithStateInPandas(runs, f"audio_id {kind}, start_ms long, end_ms long", "append", "eventTime")


class Numbering(StatefulProcessor):
    """The last number given in a channel."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = _rows(rows, ["at", "seq", "place", "payload"])
        n = self.last.get()[0] if self.last.exists() else 0
        batch["number"] = range(n + 1, n + 1 + len(batch))
        self.last.update((n + len(batch),))
        yield batch[self.names]

    def close(self) -> None:
        pass


MESSAGES = "channel_id string, number long, type string, payload string"


def ordered_messages(messages: DataFrame) -> DataFrame:
    """(channel_id, number, type, payload) of messages (channel_id, ts, seq, place,
    type, payload): numbered in each channel from 1 by time, seq, place and
    payload, batch after batch. The batch twin is ``sessions.ordered_feed``."""
    ship_package(messages.sparkSession)
    use_rocksdb(messages.sparkSession)
    plain = messages.select("channel_id", F.unix_micros("ts").alias("at"), "seq", "place", "type", "payload")
    return plain.groupBy("channel_id").transformWithStateInPandas(Numbering([c.split()[0] for c in MESSAGES.split(", ")]), MESSAGES, "append", "none")


def channel_messages(calls: DataFrame) -> DataFrame:
    """The ordered feed of chunks and of the events that they give rise to."""
    return ordered_messages(sessions.feed_of_calls(calls, route_calls(calls, keep=("ts", "seq"))))


class RecordingFeed(StatefulProcessor):
    """Numbers and counts of a channel's segments and events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "n long, segments long, events long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, segments, events = self.counts.get() if self.counts.exists() else (0, 0, 0)
        out = []
        for row in _rows(rows, ["at", "idx"]).itertuples(index=False):
            segments, events = segments + 1, events + int(row.event)
            out += [("vad_segment", row.bounds), ("segment_result", row.result)]
            if row.final:
                stages = [{"stage": "vad_detected", "segment_count": segments}, {"stage": "completed", "segment_count": segments, "event_count": events}]
                out += [("stream_status", json.dumps(stage, separators=(",", ":"))) for stage in stages]
                segments = events = 0
        self.counts.update((n + len(out), segments, events))
        yield pd.DataFrame([(key[0], n + i, *m) for i, m in enumerate(out, 1)], columns=[c.split()[0] for c in MESSAGES.split(", ")])

    def close(self) -> None:
        pass


def recording_messages(segments: DataFrame) -> DataFrame:
    """The ordered feed of segments (channel_id, segment_id, idx, start_ms, end_ms,
    text, ts, final) as they are found: each one's bounds and result, and after
    the final one of a recording the counts of its segments and events. The
    batch twin is ``sessions.recording_messages``."""
    ship_package(segments.sparkSession)
    use_rocksdb(segments.sparkSession)
    bounds, result = sessions.segment_payloads()
    plain = segments.select("channel_id", F.unix_millis("ts").alias("at"), "idx", bounds.alias("bounds"), result.alias("result"), call_level(F.col("text")).isNotNull().alias("event"), F.coalesce("final", F.lit(False)).alias("final"))
    return plain.groupBy("channel_id").transformWithStateInPandas(RecordingFeed(), MESSAGES, "append", "none")


class InspectionFeed(StatefulProcessor):
    """Numbers of a channel's messages and matches of each area under inspection."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long")
        self.matched = handle.getMapState("matched", "area string", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = self.last.get()[0] if self.last.exists() else 0
        out = []
        for row in _rows(rows, ["at", "area", "ship"]).itertuples(index=False):
            area = (row.area,)
            count = self.matched.getValue(area)[0] if self.matched.containsKey(area) else 0
            if not count:
                out.append(("inspection_status", row.started))
            out.append(("inspection_notice", row.notice))
            self.matched.updateValue(area, (count + 1,))
            if row.final:
                out.append(("inspection_status", f'{row.completed[:-1]},"matched_count":{count + 1}}}'))
                self.matched.removeKey(area)
        self.last.update((n + len(out),))
        yield pd.DataFrame([(key[0], n + i, *m) for i, m in enumerate(out, 1)], columns=[c.split()[0] for c in MESSAGES.split(", ")])

    def close(self) -> None:
        pass


def inspection_messages(matches: DataFrame, template: str, min_draft: float = 0.0, min_tonnage: int = 0) -> DataFrame:
    """The ordered feed of matches (channel_id, ts, area_id, area_name, ship_id,
    ship_name, final) of ships and areas: a status at an area's first match, a
    notice for each, and a status with their number after the final one. The
    batch twin is ``inspection.inspection_messages``."""
    ship_package(matches.sparkSession)
    use_rocksdb(matches.sparkSession)
    told = notices(matches, template, keep=("channel_id", "ts", "area_name", "final"))
    started = F.to_json(F.struct(F.lit("started").alias("stage"), "area_id", "area_name", F.lit(min_draft).alias("min_draft_m"), F.lit(min_tonnage).alias("min_tonnage_t")))
    completed = F.to_json(F.struct(F.lit("completed").alias("stage"), "area_id", "area_name"))
    notice = F.to_json(F.struct("notice_id", "ship_id", "area_id", "notice_text"))
    plain = told.select("channel_id", F.unix_millis("ts").alias("at"), F.concat_ws("|", F.col("area_id").cast("string"), "area_name").alias("area"), F.col("ship_id").cast("string").alias("ship"), started.alias("started"), completed.alias("completed"), notice.alias("notice"), F.coalesce("final", F.lit(False)).alias("final"))
    return plain.groupBy("channel_id").transformWithStateInPandas(InspectionFeed(), MESSAGES, "append", "none")


class Latest(StatefulProcessor):
    """A task's last state, forgotten a while after its last update."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "status string, error string, updated_at long, seq long", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        row = _rows(rows, ["updated_at", "seq"]).iloc[-1]
        old = self.state.get() if self.state.exists() else None
        if old is None or (old[2], old[3]) <= (row.updated_at, row.seq):
            self.state.update((row.status, row.error, int(row.updated_at), int(row.seq)))
            yield pd.DataFrame([(key[0], row.status, row.error)], columns=["task_id", "status", "error"])

    def close(self) -> None:
        pass


def task_latest(updates: DataFrame, ttl: str = "7 days") -> DataFrame:
    """The state of each task whenever it changes, for update mode; an update
    older than the last one is passed over. A task that has had no update for
    the ttl, in processing time, is forgotten, so state does not grow for ever.
    The batch form is ``sessions.task_latest``."""
    ship_package(updates.sparkSession)
    use_rocksdb(updates.sparkSession)
    kind = updates.schema["task_id"].dataType.simpleString()
    plain = updates.select("task_id", "status", "error", F.coalesce("updated_at", F.lit(0)).cast("long").alias("updated_at"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"))
    return plain.groupBy("task_id").transformWithStateInPandas(Latest(_ms(ttl)), f"task_id {kind}, status string, error string", "update", "processingTime")
