"""Comparing transcription models: results, scores, agreement, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwatch.functions import lexicons as L
from callwatch.functions import text as T
from callwatch.operators.quantiles import exact_quantile
from callwatch.runtime import dealt, written

# The names that columns of other systems go by.
TEXT_FIELDS = ("asr_text", "text", "prediction", "transcript", "transcription")
CONFIDENCE_FIELDS = ("asr_confidence", "confidence", "score")


def coalesce_columns(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns that exist and is not blank; '' without any."""
    return F.coalesce(*[T.nz(F.col(n)) for n in names if n in df.columns], F.lit(""))


def guard_columns(df: DataFrame, text: str = "asr_text") -> DataFrame:
    marks = T.script_guard(F.col(text))
    return df.withColumn("language_guard_flag", F.when(F.size(marks) > 0, F.lit("1")).otherwise(F.lit("0"))).withColumn("language_guard_notes", F.array_join(marks, "|"))


def _place(df: DataFrame, order: str | None) -> Column:
    """What tells the last of several rows: a column, then all others, so that
    reruns agree."""
    rest = [F.col(f"`{c}`").cast("string") for c in df.columns if c != order]
    return F.struct(*([F.col(order)] if order else []), *rest)


def join_external_results(segments: DataFrame, external: DataFrame, model: str, engine: str = "external_csv", order: str | None = None) -> DataFrame:
    """Results of another system for (segment_id, clip_path): by segment_id, else
    by clip_path; without either, an error row with empty text. Of results that
    share an id or a path the last by ``order`` counts."""
    result = F.struct(T.sanitize_text(coalesce_columns(external, TEXT_FIELDS)).alias("text"), T.parse_float(coalesce_columns(external, CONFIDENCE_FIELDS)).alias("confidence"))
    last = F.max_by(result, _place(external, order))
    by_id = external.filter(T.nz(F.col("segment_id")).isNotNull()).groupBy(F.col("segment_id").alias("__id")).agg(last.alias("__one"))
    by_path = external.filter(T.nz(F.col("clip_path")).isNotNull()).groupBy(F.col("clip_path").alias("__path")).agg(last.alias("__two"))
    both = segments.join(by_id, F.col("segment_id") == F.col("__id"), "left").join(by_path, F.col("clip_path") == F.col("__path"), "left").withColumn("__r", F.coalesce("__one", "__two"))
    rows = both.select(
        "segment_id", "clip_path", F.lit(model).alias("asr_model_name"), F.lit("external_csv").alias("asr_provider"), F.lit(engine).alias("asr_model"), F.coalesce(F.col("__r.text"), F.lit("")).alias("asr_text"),
        F.coalesce(F.col("__r.confidence"), F.lit(0.0)).alias("asr_confidence"), F.when(F.col("__r").isNull(), F.lit(L.MISSING_RESULT)).otherwise(F.lit("")).alias("asr_error"),
    )
    return guard_columns(rows)


def external_missing(segments: DataFrame, external: DataFrame) -> DataFrame:
    """Segments for which there is no result by id or by path."""
    ids, paths = external.select(F.col("segment_id").alias("__id")), external.select(F.col("clip_path").alias("__path"))
    return segments.join(ids, F.col("segment_id") == F.col("__id"), "left_anti").join(paths, F.col("clip_path") == F.col("__path"), "left_anti")


def model_grid(segments: DataFrame, models: list[str]) -> DataFrame:
    """Each segment once for each of the models, which are few."""
    return segments.withColumn("asr_model_name", F.explode(T.words_of(models)))


def error_rows(segments: DataFrame, model: str, provider: str, error: str) -> DataFrame:
    """What a model that failed contributes to the long table."""
    rows = segments.select("segment_id", "clip_path", F.lit(model).alias("asr_model_name"), F.lit(provider).alias("asr_provider"), F.lit("").alias("asr_model"), F.lit("").alias("asr_text"), F.lit(0.0).alias("asr_confidence"), F.lit(error).alias("asr_error"))
    return guard_columns(rows)


def selection_wide(segments: DataFrame, long: DataFrame, models: list[str]) -> DataFrame:
    """One row for each segment with text, confidence, error and guard notes of
    each model in columns named field__model; later rows (``ord``) overwrite.
    Segments of the long table alone are added."""
    fields = F.struct("asr_text", "asr_confidence", "asr_error", "language_guard_notes")
    last = long.groupBy(F.col("segment_id").alias("__id")).pivot("asr_model_name", models).agg(F.max_by(fields, "ord"))
    paths = long.groupBy(F.col("segment_id").alias("__id2")).agg(F.max_by("clip_path", "ord").alias("__clip"))
    rows = segments.join(last, F.col("segment_id") == F.col("__id"), "full").join(paths, F.col("__id") == F.col("__id2"), "left")
    out = [F.coalesce("segment_id", "__id").alias("segment_id"), F.coalesce("clip_path", "__clip").alias("clip_path")]
    for m in models:
        out += [F.col(f"`{m}`.{source}").alias(f"{name}__{m}") for source, name in (("asr_text", "asr_text"), ("asr_confidence", "asr_confidence"), ("asr_error", "asr_error"), ("language_guard_notes", "language_guard"))]
    return rows.select(*out)


def score_models(long: DataFrame, guard: float = 3.0, empty: float = 2.0, short: float = 1.0) -> DataFrame:
    """Samples, hits and the health score of each model: samples less penalties,
    0 at least, and that for each sample."""
    health = T.text_health(F.col("asr_text"))
    rows = long.select("asr_model_name", "asr_provider", (F.col("language_guard_flag") == "1").alias("g"), health["empty"].alias("e"), health["short"].alias("s"))
    out = rows.groupBy("asr_model_name", "asr_provider").agg(F.count("*").alias("samples"), F.count_if("g").alias("language_guard_hits"), F.count_if("e").alias("empty_text_hits"), F.count_if("s").alias("short_text_hits"))
    score = F.greatest(F.lit(0.0), F.col("samples") - F.col("language_guard_hits") * guard - F.col("empty_text_hits") * empty - F.col("short_text_hits") * short)
    return out.withColumn("score", score).withColumn("score_per_sample", F.col("score") / F.col("samples"))


def rank_models(scores: DataFrame) -> DataFrame:
    """Ranks by falling score, then by name. One row for each model."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "asr_model_name", "asr_provider")))


def pipeline_agreement(a: DataFrame, b: DataFrame, fields: list[str], order: str | None = None) -> DataFrame:
    """One row: rows of ``a`` compared, percent of them with equal fields, and
    both row counts. Of rows of ``b`` that share a segment_id the last by
    ``order`` counts."""
    last = b.groupBy("segment_id").agg(F.max_by(F.struct(*fields), _place(b, order)).alias("x"))
    right = last.select(F.col("segment_id").alias("__id"), *[F.col(f"x.{f}").alias(f"__{f}") for f in fields])
    both = a.filter(T.nz(F.col("segment_id")).isNotNull()).join(right, F.col("segment_id") == F.col("__id"))
    same = [F.coalesce(F.bround(100 * F.avg(F.when(T.trim_ws(F.col(f)) == T.trim_ws(F.col(f"__{f}")), 1.0).otherwise(0.0)), 2), F.lit(0.0)).alias(f"agreement_{f}") for f in fields]
    counts = a.agg(F.count("*").alias("first_rows")).join(F.broadcast(b.agg(F.count("*").alias("second_rows"))))
    return both.agg(F.count("*").alias("compared_segments"), *same).join(F.broadcast(counts))


def with_cer(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(reference, prediction) -> with cer, accuracy, passed; null where there is
    no reference."""
    known = T.nz(F.col("reference")).isNotNull()
    return rows.withColumn("cer", F.when(known, T.cer(F.col("reference"), F.col("prediction")))).withColumn("accuracy", T.accuracy(F.col("cer"))).withColumn("passed", 1 - F.col("cer") >= threshold)


def eval_models(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Items, scored items, mean and median error rate, accuracy (1 less the mean
    rate, 0 at least) and the share of passing items, by model."""
    # distances are dear, so they are computed once
    scored = written(with_cer(rows, threshold).select("model", "cer", "passed"))
    sums = scored.groupBy("model").agg(
        F.count("*").alias("items"), F.count("cer").alias("scored_items"), F.avg("cer").alias("mean_cer"), T.accuracy(F.avg("cer")).alias("mean_accuracy"),
        F.avg(F.when(F.col("cer").isNotNull(), F.col("passed").cast("double"))).alias("passing_share"),
    )
    medians = exact_quantile(scored, "model", "cer", 0.5, "median_cer").withColumnRenamed("model", "__m")
    return sums.join(medians, F.col("model").eqNullSafe(F.col("__m")), "left").select("model", "items", "scored_items", "mean_cer", "mean_accuracy", "median_cer", "passing_share")


def ranked_models(scores: DataFrame) -> DataFrame:
    """By falling accuracy, models without a scored item last."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_accuracy"), "model")))


def qualified_models(scores: DataFrame, target: float = 0.8) -> DataFrame:
    return scores.filter(F.col("mean_accuracy") >= target)


def agreement_band(x: Column) -> Column:
    return F.when(x < 0.75, F.lit("high")).when(x < 0.9, F.lit("medium")).otherwise(F.lit("low"))


def agreement_queue(details: DataFrame, models: list[str]) -> DataFrame:
    """(id, model, prediction), one row for each id and model: mean similarity of
    all pairs of an item's predictions (1 for a single one), the longest, the
    first of several, as suggested reference, a priority, and a column for each
    model. Pairs are as many as the models' pairs, for each item."""
    # the aggregate needs this shuffle anyway; distances are dear, so its tasks are not merged
    wide = dealt(details, "id").groupBy("id").pivot("model", models).agg(F.max("prediction"))
    said = F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), F.struct(F.col(m).alias("p"))) for m in models]))
    # a mean that is just a band's bound depends on the order of the sum: SQL's join gives the last model's pairs first
    pairs = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), T.similarity(F.col(a), F.col(b))) for j, b in reversed([*enumerate(models)]) for a in models[:j]]

    def mean(x: Column) -> Column:
        return F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x))

    longest = F.aggregate(said, F.lit(""), lambda best, one: F.when(F.length(one["p"]) > F.length(best), one["p"]).otherwise(best))
    out = wide.withColumn("agreement", T.let(F.array_compact(F.array(*pairs)), mean)).withColumn("suggested_reference", longest)
    return out.select("id", "agreement", "suggested_reference", F.lit("").alias("human_reference"), agreement_band(F.col("agreement")).alias("review_priority"), *[F.col(m).alias(f"prediction__{m}") for m in models])


def eval_manifest(df: DataFrame, audio_dir: str | None = None) -> DataFrame:
    """(audio_path, transcript, item_id) from a manifest whose columns go by
    several names. A row without a path is an error when it is read."""
    path = coalesce_columns(df, ("audio_path", "path", "file", "audio"))
    known = F.when(path == "", F.raise_error(F.lit("a row of the manifest has no audio path"))).otherwise(path)
    if audio_dir is not None:
        known = F.when(known.startswith("/"), known).otherwise(F.concat_ws("/", F.lit(audio_dir.rstrip("/")), known))
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return df.select(known.alias("audio_path"), coalesce_columns(df, ("transcript", "text", "ground_truth")).alias("transcript"), F.coalesce(T.nz(coalesce_columns(df, ("id", "utt_id"))), stem).alias("item_id"))


def normalize_analysis(df: DataFrame) -> DataFrame:
    """Model labels in the engine's words: aliases of columns, synonyms of labels,
    evidence as an array. Rows without an id are dropped."""
    rows = df.withColumn("__id", coalesce_columns(df, ("segment_id", "id"))).filter(F.col("__id") != "")
    column = lambda *names: coalesce_columns(df, names)
    return rows.select(
        F.col("__id").alias("segment_id"), T.norm_role(column("role_label", "role", "speaker_side")).alias("role"), T.parse_float(column("role_confidence")).alias("role_confidence"), T.norm_crisis(column("crisis_label", "risk_label", "risk")).alias("crisis"),
        T.parse_float(column("crisis_confidence", "risk_confidence")).alias("crisis_confidence"), T.norm_automation(column("automation_label", "route")).alias("automation"),
        F.coalesce(T.nz(column("scenario", "risk_type")), F.lit("unknown")).alias("scenario"), T.parse_evidence(column("evidence", "keywords")).alias("evidence"), column("rationale", "reason", "notes").alias("rationale"),
    )
