"""Views over the given tables that queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callwatch.functions import text as T
from callwatch.runtime import dealt, table

PHRASES = [
    "Mayday，Mayday，本船东方18机舱起火，请求救助", "我船与渔船发生碰撞，船体进水", "交管中心，长江7号报告，已靠泊5号泊位", "VTS，新海9报告，锚地抛锚完毕", "新海9，VTS收到，请保持守听",
    "我船申请离泊，出港前往外海", "本船通过报告线，航速8节", "请问前方能见度如何", "我船主机故障，失去动力", "前方团雾，注意避让",
    "贵船超速，请立即减速", "信号不好，听不清", "", "嗯", "我船准备离泊，目的地北方港",
    "本船走锚，紧急，需要援助", "我船需要拖轮协助", "こちらVTS、応答願います", "本船过驳作业，申请试航", "我船避让渔船，保持距离",
]
ROLES = ["船方", "vts", "mixed", "unknown"]
CRISES = ["高危", "normal", "uncertain", "routine", ""]
AUTOMATIONS = ["auto", "人工处理", "llm", ""]
SCENARIOS = ["weather", "unknown"]
EVIDENCE = ["a|b", "a|b", "a|b", "a；b", "a；b", "", ""]
MODELS = ["a", "b", "c", "d"]
AREAS = [
    (1, "A", '{"type":"rect","lng1":"121.82","lat1":"29.91","lng2":"121.86","lat2":"29.95"}'),
    (2, "B", '{"type":"line","lng1":"121.80","lat1":"29.90","lng2":"121.90","lat2":"29.97"}'),
    (3, "A3段", ""),
    (4, "", "{broken"),
]


def pick(values: list[str], index):
    return F.element_at(T.words_of(values), (index + 1).cast("int"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.concat(F.lit("seg_"), F.col("event_id").cast("string")).alias("segment_id"), F.concat(F.lit("mic_"), F.col("user_id").cast("string")).alias("session_id"), F.concat(F.lit("vhf_"), (F.col("user_id") % 5).cast("string")).alias("channel_id"),
        seq.alias("seq"), "ts", pick(PHRASES, F.col("event_id") % 20).alias("text"), ((F.col("event_id") % 100).cast("double") / 100).alias("confidence"), F.col("event_type").alias("engine"),
        F.concat(F.lit("clips/"), F.col("event_id").cast("string"), F.lit(".wav")).alias("clip_path"),
    )


def plain_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``calls`` without the numbering in sessions."""
    return calls(spark, sf_dir).drop("seq")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("audio_id"), seq.alias("frame_idx"), F.floor(F.col("value") * 100).cast("int").alias("rms"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, reference, model, prediction): every turn of the conversations,
    whole, as four models heard it. Characters beyond ASCII are written as x, as
    DuckDB's distance counts bytes. Distances cost far more than a shuffle of the
    turns, so these are dealt over all cores."""
    d = dealt(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    r = d.select((F.col("conv_id") * 10_000 + F.col("turn")).alias("doc_id"), F.lower(F.regexp_replace("text", r"[^\x00-\x7F]", "x")).alias("reference"))
    said = [F.col("reference"), F.replace("reference", F.lit("e"), F.lit("")), F.replace("reference", F.lit("th"), F.lit("d")), F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.replace("reference", F.lit("a"), F.lit("o")))]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("prediction")) for m, p in zip(MODELS, said, strict=True)]))
    return r.select("doc_id", "reference", each.alias("x")).select("doc_id", "reference", "x.model", "x.prediction")


def ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("ship_id"), F.col("p_name").alias("ship_name"), F.col("p_type").alias("ship_type"), F.floor(F.col("p_retailprice") * 10).cast("int").alias("tonnage_t"), (F.col("p_size").cast("double") / 4).alias("draft_m"), F.lit("").alias("destination"),
        F.concat(F.lit("A"), (k % 5).cast("string"), F.lit("段")).alias("position_label"), (F.lit(121.80) + (k % 100).cast("double") / 1000).alias("lng"), (F.lit(29.90) + (k % 70).cast("double") / 1000).alias("lat"),
    )


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AREAS, "area_id long, area_name string, geometry string")


def raw_analysis(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e, shift = table(spark, sf_dir, "events"), 0 if kind == "llm" else 1
    some = e.filter(F.col("event_id") % 3 != 0) if kind == "llm" else e.filter(F.col("event_id") % 2 == 0)
    i = F.col("event_id") + shift
    return some.select(
        F.concat(F.lit("seg_"), F.col("event_id").cast("string")).alias("segment_id"), pick(ROLES, i % 4).alias("role_label"), ((i % 10).cast("double") / 10).cast("string").alias("role_confidence"), pick(CRISES, i % 5).alias("crisis_label"),
        ((i % 20).cast("double") / 20).cast("string").alias("crisis_confidence"), pick(AUTOMATIONS, i % 4).alias("automation_label"), pick(SCENARIOS, i % 2).alias("scenario"), pick(EVIDENCE, i % 7).alias("evidence"), F.lit(kind).alias("rationale"),
    )


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_id") % 4 != 0)
    even = F.col("event_id") % 2 == 0
    number = F.col("event_id").cast("string")
    return e.select(F.when(even, F.concat(F.lit("seg_"), number)).alias("segment_id"), F.when(~even, F.concat(F.lit("clips/"), number, F.lit(".wav"))).alias("clip_path"), pick(PHRASES, F.col("event_id") % 20).alias("asr_text"), F.when(F.col("event_id") % 6 == 0, F.lit("bad")).otherwise(((F.col("event_id") % 100).cast("double") / 100).cast("string")).alias("asr_confidence"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _analysis_sql(kind: str) -> str:
    shift, where = (0, "event_id % 3 <> 0") if kind == "llm" else (1, "event_id % 2 = 0")
    i = f"(event_id + {shift})"
    return (
        f"select concat('seg_', event_id) segment_id, {_list(ROLES)}[{i} % 4 + 1] role_label, cast({i} % 10 as double) / 10 role_confidence, {_list(CRISES)}[{i} % 5 + 1] crisis_label, "
        f"cast({i} % 20 as double) / 20 crisis_confidence, {_list(AUTOMATIONS)}[{i} % 4 + 1] automation_label, {_list(SCENARIOS)}[{i} % 2 + 1] scenario, {_list(EVIDENCE)}[{i} % 7 + 1] evidence, '{kind}' rationale from events where {where}"
    )


SQL = {
    "calls": f"select event_id, concat('seg_', event_id) segment_id, concat('mic_', user_id) session_id, concat('vhf_', user_id % 5) channel_id, row_number() over (partition by user_id order by ts, event_id) - 1 seq, ts, {_list(PHRASES)}[event_id % 20 + 1] as text, cast(event_id % 100 as double) / 100 confidence, event_type engine, concat('clips/', event_id, '.wav') clip_path from events",
    "frames": "select user_id audio_id, row_number() over (partition by user_id order by ts, event_id) - 1 frame_idx, cast(floor(value * 100) as int) rms from events",
    "transcripts": "select doc_id, reference, model, case model when 'a' then reference when 'b' then replace(reference, 'e', '') when 'c' then replace(reference, 'th', 'd') else case when doc_id % 7 = 0 then '' else replace(reference, 'a', 'o') end end prediction from (select conv_id * 10000 + turn doc_id, lower(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')) reference, unnest(['a', 'b', 'c', 'd']) model from conversations)",
    "ships": "select p_partkey ship_id, p_name ship_name, p_type ship_type, cast(floor(p_retailprice * 10) as int) tonnage_t, cast(p_size as double) / 4 draft_m, '' destination, concat('A', p_partkey % 5, '段') position_label, cast(121.80 as double) + cast(p_partkey % 100 as double) / 1000 lng, cast(29.90 as double) + cast(p_partkey % 70 as double) / 1000 lat from part",
    "areas": "select * from (values " + ", ".join(f"(cast({i} as bigint), '{n}', '{g}')" for i, n, g in AREAS) + ") t(area_id, area_name, geometry)",
    "analysis_llm": _analysis_sql("llm"),
    "analysis_audio": _analysis_sql("audio"),
    "external": f"select case when event_id % 2 = 0 then concat('seg_', event_id) end segment_id, case when event_id % 2 <> 0 then concat('clips/', event_id, '.wav') end clip_path, {_list(PHRASES)}[event_id % 20 + 1] asr_text, case when event_id % 6 = 0 then 'bad' else cast(cast(event_id % 100 as double) / 100 as varchar) end asr_confidence from events where event_id % 4 <> 0",
}
