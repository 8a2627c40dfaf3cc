"""Roll-ups, running values and look-ups over calls, events and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwatch.functions import text as T
from callwatch.operators.quantiles import exact_quantile
from callwatch.runtime import numbered, written

DIMENSIONS = {"role": "role_pred", "crisis_label": "crisis_label_pred", "automation_label": "automation_label_pred", "scenario": "scenario_pred", "source": "analysis_source"}


def label_stats(rows: DataFrame, dimensions: dict[str, str] = DIMENSIONS) -> DataFrame:
    """(dimension, label, n): counts by each dimension for itself. Rows are
    counted by all dimensions together first, so that only distinct label
    combinations are taken apart."""
    together = rows.groupBy(*dimensions.values()).agg(F.count("*").alias("k"))
    parts = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("label")) for d, c in dimensions.items()]))
    return together.select("k", parts.alias("x")).groupBy("x.dimension", "x.label").agg(F.sum("k").alias("n"))


def session_rollup(calls: DataFrame, events: DataFrame) -> DataFrame:
    """Text, chunk and event counts of each session; texts in order, blank ones
    left out, one to a line. A session's texts meet in one row."""
    said = F.filter(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: F.length(T.text_or_empty(x["text"])) > 0)
    rolled = calls.groupBy("session_id").agg(F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("chunks"))
    counts = events.groupBy(F.col("session_id").alias("__s")).agg(F.count("*").alias("__n"))
    return rolled.join(counts, F.col("session_id") == F.col("__s"), "left").withColumn("events", F.coalesce("__n", F.lit(0).cast("long"))).drop("__s", "__n")


def run_meta(segments: DataFrame, events: DataFrame, run: str = "channel_id") -> DataFrame:
    """Segment and event counts of each run."""
    a = segments.groupBy(run).agg(F.count("*").alias("segment_count"))
    b = events.groupBy(F.col(run).alias("__r")).agg(F.count("*").alias("__n"))
    return a.join(b, F.col(run) == F.col("__r"), "left").withColumn("event_count", F.coalesce("__n", F.lit(0).cast("long"))).drop("__r", "__n")


def desk_columns() -> list[Column]:
    """Aggregates: calls of high risk count for risk and for people, automatic
    replies for auto, others for people."""
    risk = F.col("risk_level").isin("L1", "L2")
    auto = ~risk & (F.col("is_auto_reply") | (F.col("action_type") == "auto_reply"))
    return [F.count_if(risk).alias("risk"), F.count_if(auto).alias("auto"), F.count_if(~auto).alias("manual")]


def desk_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("channel_id").agg(*desk_columns())


def classification_metrics(rows: DataFrame, classes: list[int]) -> DataFrame:
    """(truth, prediction) -> precision, recall and F1 of each class."""
    marked = rows.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    t, p = F.col("truth") == F.col("class"), F.col("prediction") == F.col("class")
    sums = marked.groupBy("class").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    precision, recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    both = F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return sums.select("class", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), (2 * F.col("tp") / both).alias("f1"))


def desk_metrics(rows: DataFrame) -> DataFrame:
    """One row over (risk, predicted_risk, role, predicted_role, latency_ms): high
    recall, misses and false alarms, uncertain rate, role accuracy, latency."""
    high, said = F.col("risk") == "high", F.col("predicted_risk") == "high"
    return rows.agg(
        (F.count_if(high & said) / F.nullif(F.count_if(high), F.lit(0))).alias("high_recall"), F.count_if(high & ~said).alias("high_misses"), F.count_if(~high & said).alias("high_alarms"),
        F.avg((F.col("predicted_risk") == "uncertain").cast("double")).alias("uncertain_rate"), F.avg((F.col("role") == F.col("predicted_role")).cast("double")).alias("role_accuracy"), F.avg("latency_ms").alias("mean_latency_ms"),
    )


def duration_profile(segments: DataFrame, step: int) -> DataFrame:
    """(bucket, n, shortest, longest, mean, median) of durations by step."""
    rows = written(segments.select(F.floor(F.col("duration_ms") / step).alias("bucket"), "duration_ms"))
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("duration_ms").alias("shortest"), F.max("duration_ms").alias("longest"), F.avg("duration_ms").alias("mean"))
    medians = exact_quantile(rows, "bucket", "duration_ms", 0.5, "median").withColumnRenamed("bucket", "__b")
    return sums.join(medians, F.col("bucket").eqNullSafe(F.col("__b")), "left").drop("__b")


def _so_far(session: str):
    return Window.partitionBy(session).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def cumulative_text(calls: DataFrame, session: str = "session_id") -> DataFrame:
    """With ``running``: the session's texts up to each chunk, one to a line. Its
    size grows with the square of a session's length; sessions are short."""
    said = F.when(F.length(T.text_or_empty(F.col("text"))) > 0, F.col("text"))
    return calls.withColumn("running", F.array_join(F.collect_list(said).over(_so_far(session)), "\n"))


def carry_last_text(calls: DataFrame, session: str = "session_id") -> DataFrame:
    """With ``running``: the last text that is not empty, up to each chunk."""
    return calls.withColumn("running", F.coalesce(F.last(F.nullif(F.col("text"), F.lit("")), ignorenulls=True).over(_so_far(session)), F.lit("")))


def utterance_offsets(script: DataFrame, session: str = "session_id") -> DataFrame:
    """With start_ms and end_ms: the sum of earlier durations, and that plus its own."""
    before = Window.partitionBy(session).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("duration_ms").over(before), F.lit(0)).cast("long")
    return script.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col("duration_ms"))


def first_segment_override(calls: DataFrame, text: str, session: str = "session_id") -> DataFrame:
    """The given text, at confidence 0.99, for each session's first segment."""
    first = F.row_number().over(Window.partitionBy(session).orderBy("seq")) == 1
    return calls.withColumn("__f", first).withColumn("text", F.when(F.col("__f"), F.lit(text)).otherwise(F.col("text"))).withColumn("confidence", F.when(F.col("__f"), F.lit(0.99)).otherwise(F.col("confidence"))).drop("__f")


def sample_head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest_events(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("segment_id")).limit(n)


def event_by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id)


def search_records(records: DataFrame, needle: str) -> DataFrame:
    """Records (segment_id, ts, text, reply) whose text or reply holds the needle,
    newest first; blank finds all."""
    word = needle.strip()
    found = records.filter(F.contains(F.concat_ws(" ", "text", "reply"), F.lit(word))) if word else records
    return found.orderBy(F.desc("ts"), F.desc("segment_id"))


def coverage_sample(rows: DataFrame, category: str, k: int, key: str = "segment_id") -> DataFrame:
    """k rows of each category, by a hash of the key."""
    order = Window.partitionBy(category).orderBy(F.xxhash64(key), key)
    return rows.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k).drop("__n")


def ragged_union(*frames: DataFrame) -> DataFrame:
    """All rows, with the columns of all, in the order they are first seen."""
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def task_latest(updates: DataFrame) -> DataFrame:
    """The last state of each task (task_id, status, error, updated_at, seq)."""
    return updates.groupBy("task_id").agg(F.max_by(F.struct("status", "error"), F.struct("updated_at", "seq")).alias("x")).select("task_id", "x.status", "x.error")


def channel_messages(calls: DataFrame, events: DataFrame) -> DataFrame:
    """(channel_id, type, payload): one typed message for each chunk and two for
    each event, payloads as JSON."""
    chunk = calls.select("channel_id", F.lit("stream_chunk_result").alias("type"), F.to_json(F.struct("segment_id", "seq", "text")).alias("payload"))
    risk = events.select("channel_id", F.lit("risk_event").alias("type"), F.to_json(F.struct("segment_id", "risk_level", "action_type")).alias("payload"))
    advice = events.select("channel_id", F.lit("broadcast_recommendation").alias("type"), F.to_json(F.struct("segment_id", "broadcast_text")).alias("payload"))
    return chunk.unionByName(risk).unionByName(advice)


def segment_payloads() -> tuple[Column, Column]:
    """A segment's bounds and its result, as JSON."""
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")).alias("duration_ms")
    return F.to_json(F.struct(F.col("idx").alias("index"), "start_ms", "end_ms", length)), F.to_json(F.struct("segment_id", "start_ms", "end_ms", "text"))


def recording_messages(segments: DataFrame, events: DataFrame) -> DataFrame:
    """(channel_id, type, payload) for segments (channel_id, segment_id, idx,
    start_ms, end_ms, text): each one's bounds and result, and for each channel a
    status with its segments once voices are found and one at the end with its
    events too."""
    bounds, said = segment_payloads()
    found = segments.select("channel_id", F.lit("vad_segment").alias("type"), bounds.alias("payload"))
    result = segments.select("channel_id", F.lit("segment_result").alias("type"), said.alias("payload"))
    counts = run_meta(segments, events)
    status = F.explode(F.array(F.to_json(F.struct(F.lit("vad_detected").alias("stage"), "segment_count")), F.to_json(F.struct(F.lit("completed").alias("stage"), "segment_count", "event_count"))))
    return found.unionByName(result).unionByName(counts.select("channel_id", F.lit("stream_status").alias("type"), status.alias("payload")))


#: Kinds of messages of a call in the order in which they are sent.
CALL_MESSAGES = ["stream_chunk_result", "risk_event", "broadcast_recommendation"]


def feed_of_calls(calls: DataFrame, events: DataFrame) -> DataFrame:
    """(channel_id, ts, seq, place, type, payload): the messages of
    ``channel_messages`` with what orders them; ``events`` carry the ts and seq of
    their calls."""
    place = {kind: i for i, kind in enumerate(CALL_MESSAGES)}
    payloads = {
        CALL_MESSAGES[0]: (calls, ["segment_id", "seq", "text"]),
        CALL_MESSAGES[1]: (events, ["segment_id", "risk_level", "action_type"]),
        CALL_MESSAGES[2]: (events, ["segment_id", "broadcast_text"]),
    }
    parts = [rows.select("channel_id", "ts", F.col("seq").cast("long").alias("seq"), F.lit(place[kind]).alias("place"), F.lit(kind).alias("type"), F.to_json(F.struct(*fields)).alias("payload")) for kind, (rows, fields) in payloads.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ordered_feed(messages: DataFrame, order: tuple[str, ...] = ("ts", "seq", "place", "payload")) -> DataFrame:
    """(channel_id, number, type, payload) of messages (channel_id, ts, seq, place,
    type, payload): numbered in each channel from 1, by time, seq, place and
    payload if no other ``order`` is given. A channel of any length is numbered
    over several tasks."""
    keys = {c: f"__by_{i}" for i, c in enumerate(order)}
    plain = messages.select("channel_id", *[F.col(c).alias(k) for c, k in keys.items()], "type", "payload")
    return numbered(plain, list(keys.values()), "number", "channel_id").select("channel_id", "number", "type", "payload")
