"""Queries that compare transcription models."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwatch.functions import lexicons as L
from callwatch.functions import text as T
from callwatch.operators import models, sessions
from callwatch.plans import views
from callwatch.plans.sql import with_views
from callwatch.runtime import table, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_CLEAN = "[\\s,.:;!?\"''()\\[\\]{}<>\\-_/\\\\|~`^]+"
TR = with_views("transcripts", extra=f"n as (select *, regexp_replace(reference, '{_CLEAN}', '', 'g') nr, regexp_replace(prediction, '{_CLEAN}', '', 'g') np from transcripts), e as (select *, case when trim(reference) = '' then null when nr = '' then case when np = '' then 0.0 else 1.0 end else levenshtein(nr, np) / length(nr)::double end cer from n)")


@query(TR + "select doc_id, model, levenshtein(reference, prediction) as distance from transcripts")
def edit_distance(spark, sf_dir):
    return views.transcripts(spark, sf_dir).select("doc_id", "model", T.edit_distance(F.col("reference"), F.col("prediction")).alias("distance"))


@query(TR + "select doc_id, model, round(cer, 9) as cer, round(greatest(0, 1 - cer), 9) as accuracy, 1 - cer >= 0.8 as passed from e")
def cer(spark, sf_dir):
    rows = models.with_cer(views.transcripts(spark, sf_dir))
    return rows.select("doc_id", "model", F.round("cer", 9).alias("cer"), F.round("accuracy", 9).alias("accuracy"), "passed")


@query(TR + "select doc_id, model, round(case when greatest(length(nr), length(np)) = 0 then 1.0 else greatest(0.0, 1 - levenshtein(nr, np) / greatest(length(nr), length(np))::double) end, 9) as value from n")
def similarity(spark, sf_dir):
    return views.transcripts(spark, sf_dir).select("doc_id", "model", F.round(T.similarity(F.col("reference"), F.col("prediction")), 9).alias("value"))


_SCORES = "scores as (select model, count(*) items, count(cer) scored_items, round(avg(cer), 9) mean_cer, round(greatest(0, 1 - avg(cer)), 9) mean_accuracy, round(median(cer), 9) median_cer, round(avg(case when cer is not null then case when 1 - cer >= 0.8 then 1.0 else 0.0 end end), 9) passing_share from e group by 1)"


def _scores(spark, sf_dir):
    s = models.eval_models(views.transcripts(spark, sf_dir))
    return s.withColumns({c: F.round(c, 9) for c in ("mean_cer", "mean_accuracy", "median_cer", "passing_share")})


@query(TR + f", {_SCORES} select *, row_number() over (order by mean_accuracy desc nulls last, model) as rank from scores")
def eval_models(spark, sf_dir):
    return models.ranked_models(_scores(spark, sf_dir))


@query(TR + f", {_SCORES} select model, mean_accuracy from scores where mean_accuracy >= 0.8")
def qualified_models(spark, sf_dir):
    return models.qualified_models(_scores(spark, sf_dir)).select("model", "mean_accuracy")


_SIM = "case when greatest(length(x.np), length(y.np)) = 0 then 1.0 else greatest(0.0, 1 - levenshtein(x.np, y.np) / greatest(length(x.np), length(y.np))::double) end"


@query(TR + f""", p as (select x.doc_id, avg({_SIM}) agreement from n x join n y on x.doc_id = y.doc_id and x.model < y.model group by 1),
 w as (select doc_id, max(prediction) filter (where model = 'a') prediction__a, max(prediction) filter (where model = 'b') prediction__b, max(prediction) filter (where model = 'c') prediction__c, max(prediction) filter (where model = 'd') prediction__d, arg_max(prediction, length(prediction) * 10 - ascii(model) + 97) s from transcripts group by 1)
 select w.doc_id as id, round(agreement, 9) as agreement, s as suggested_reference, '' as human_reference, case when agreement < 0.75 then 'high' when agreement < 0.9 then 'medium' else 'low' end as review_priority, prediction__a, prediction__b, prediction__c, prediction__d from w join p on w.doc_id = p.doc_id order by agreement, id""")
def agreement_queue(spark, sf_dir):
    # written first, as a global sort reads its input twice
    rows = written(models.agreement_queue(views.transcripts(spark, sf_dir).withColumnRenamed("doc_id", "id"), views.MODELS))
    # bands are of the mean itself, the order is of what is shown
    return rows.withColumn("agreement", F.round("agreement", 9)).orderBy("agreement", "id")


EX = with_views("calls", "external", extra="found as (select c.event_id, c.segment_id, c.clip_path, a.segment_id i, b.clip_path p, coalesce(a.asr_text, b.asr_text) t, coalesce(a.asr_confidence, b.asr_confidence) k from calls c left join (select * from external where segment_id is not null) a on a.segment_id = c.segment_id left join (select * from external where clip_path is not null) b on b.clip_path = c.clip_path)")


@query(EX + f"select segment_id, clip_path, 'ext' as asr_model_name, 'external_csv' as asr_provider, 'external_csv' as asr_model, coalesce(t, '') as asr_text, coalesce(try_cast(k as double), 0) as asr_confidence, case when i is null and p is null then '{L.MISSING_RESULT}' else '' end as asr_error, case when regexp_matches(coalesce(t, ''), '[\\x{{3040}}-\\x{{30ff}}]') then '1' else '0' end as language_guard_flag, case when regexp_matches(coalesce(t, ''), '[\\x{{3040}}-\\x{{30ff}}]') then 'japanese_kana' else '' end as language_guard_notes from found")
def external_results(spark, sf_dir):
    return models.join_external_results(views.plain_calls(spark, sf_dir), views.external(spark, sf_dir), "ext")


@query(EX + "select segment_id, clip_path from found where i is null and p is null")
def external_missing(spark, sf_dir):
    return models.external_missing(views.plain_calls(spark, sf_dir).select("segment_id", "clip_path"), views.external(spark, sf_dir))


@query(with_views("calls") + "select segment_id, m as asr_model_name from calls, (values ('a'), ('b'), ('c')) t(m)")
def model_grid(spark, sf_dir):
    return models.model_grid(views.plain_calls(spark, sf_dir).select("segment_id"), ["a", "b", "c"])


@query(with_views("calls") + "select segment_id, clip_path, 'x' as asr_model_name, 'p' as asr_provider, '' as asr_model, '' as asr_text, 0.0::double as asr_confidence, 'Error: down' as asr_error, '0' as language_guard_flag, '' as language_guard_notes from calls")
def model_error_rows(spark, sf_dir):
    return models.error_rows(views.plain_calls(spark, sf_dir), "x", "p", "Error: down")


def _long(spark, sf_dir):
    """Texts of the calls under two models, the second of which adds the name of the engine."""
    c = views.plain_calls(spark, sf_dir)
    x = models.model_grid(c, ["m1", "m2"]).withColumn("asr_text", F.when(F.col("asr_model_name") == "m1", F.col("text")).otherwise(F.concat("text", "engine")))
    rows = x.select("segment_id", "clip_path", "asr_model_name", F.lit("p").alias("asr_provider"), "asr_text", F.col("confidence").alias("asr_confidence"), F.lit("").alias("asr_error"), F.col("event_id").alias("ord"))
    return models.guard_columns(rows)


LG = with_views("calls", extra="long_ as (select segment_id, clip_path, m asr_model_name, 'p' asr_provider, case m when 'm1' then text else concat(text, engine) end asr_text, confidence asr_confidence, event_id from calls, (values ('m1'), ('m2')) t(m)), long as (select *, case when regexp_matches(asr_text, '[\\x{3040}-\\x{30ff}]') then 'japanese_kana' else '' end notes from long_), sc as (select asr_model_name, asr_provider, count(*) samples, count(*) filter (where notes <> '') language_guard_hits, count(*) filter (where trim(asr_text) = '') empty_text_hits, count(*) filter (where length(trim(asr_text)) between 1 and 7) short_text_hits from long group by 1, 2), scored as (select *, greatest(0, samples - 3.0 * language_guard_hits - 2.0 * empty_text_hits - short_text_hits)::double score from sc)")


@query(LG + "select *, round(score / samples, 9) as score_per_sample from scored")
def score_models(spark, sf_dir):
    return models.score_models(_long(spark, sf_dir)).withColumn("score_per_sample", F.round("score_per_sample", 9))


@query(LG + "select asr_model_name, score, row_number() over (order by score desc, asr_model_name) as rank from scored")
def rank_models(spark, sf_dir):
    return models.rank_models(models.score_models(_long(spark, sf_dir))).select("asr_model_name", "score", "rank")


@query(LG + "select c.segment_id, c.clip_path, a.asr_text as asr_text__m1, a.asr_confidence as asr_confidence__m1, '' as asr_error__m1, a.notes as language_guard__m1, b.asr_text as asr_text__m2, b.asr_confidence as asr_confidence__m2, '' as asr_error__m2, b.notes as language_guard__m2 from calls c join long a on a.segment_id = c.segment_id and a.asr_model_name = 'm1' join long b on b.segment_id = c.segment_id and b.asr_model_name = 'm2'")
def selection_wide(spark, sf_dir):
    return models.selection_wide(views.plain_calls(spark, sf_dir).select("segment_id", "clip_path"), _long(spark, sf_dir), ["m1", "m2"])


@query(with_views("analysis_llm", "analysis_audio") + ", j as (select l.*, a.role_label ar, a.scenario asc_ from analysis_llm l join analysis_audio a on l.segment_id = a.segment_id) select count(*) as compared_segments, round(100 * avg(case when role_label = ar then 1.0 else 0.0 end), 2) as agreement_role_label, round(100 * avg(case when scenario = asc_ then 1.0 else 0.0 end), 2) as agreement_scenario, (select count(*) from analysis_llm) as first_rows, (select count(*) from analysis_audio) as second_rows from j")
def pipeline_agreement(spark, sf_dir):
    return models.pipeline_agreement(*[views.raw_analysis(spark, sf_dir, k) for k in ("llm", "audio")], ["role_label", "scenario"])


@query("select concat('audio/', doc_id, '.wav') as audio_path, case when has then coalesce(nullif(trim(text), ''), lang, '') else coalesce(lang, '') end as transcript, case when has then concat('u', doc_id) else cast(doc_id as varchar) end as item_id from (select doc_id, lang, regexp_replace(text, '\\s', '_', 'g') text from documents), (values (true), (false)) t(has)")
def eval_manifest_coalesce(spark, sf_dir):
    """Each document twice: with its text and an id of its own, and without either."""
    d = table(spark, sf_dir, "documents").withColumn("has", F.explode(F.array(F.lit(True), F.lit(False))))
    flat = F.regexp_replace("text", r"\s", "_")
    raw = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("file"), F.when(F.col("has"), flat).otherwise(F.lit(" ")).alias("transcript"), F.col("lang").alias("ground_truth"), F.when(F.col("has"), F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("utt_id"))
    return models.eval_manifest(raw, "audio")


@query("select duration_ms // 500 as bucket, count(*) as n, min(duration_ms) as shortest, max(duration_ms) as longest, avg(duration_ms) as mean, median(duration_ms)::double as median from (select cast(floor(value * 100) as bigint) duration_ms from events) group by 1")
def duration_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("value") * 100).cast("long").alias("duration_ms"))
    return sessions.duration_profile(rows, 500)
