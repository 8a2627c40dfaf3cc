"""Who speaks, how serious a call is, and which desk gets it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwatch.functions import lexicons as L
from callwatch.functions import text as T
from callwatch.runtime import dealt


def _group_hits(lowered: Column, groups: list[dict]) -> Column:
    """Structs of each group's attributes and hits, for the groups hit, in order."""
    fields = ("level", "event_type", "suggestion", "broadcast_text", "action_type", "review", "auto")
    kind = ",".join(f"{k}:{'boolean' if k in ('review', 'auto') else 'string'}" for k in fields)
    table = T.constant([{**{k: g[k] for k in fields}, "keywords": T.keywords(g["keywords"])} for g in groups], f"array<struct<{kind},keywords:{T.KEYWORDS}>>")
    each = F.transform(table, lambda g: F.struct(*[g[k].alias(k) for k in fields], T.found_in(lowered, g["keywords"]).alias("hits")))
    return F.filter(each, lambda g: F.size(g["hits"]) > 0)


def call_level(x: Column, groups: list[dict] = L.ROUTING) -> Column:
    """The risk level of a text's event; null if it has none."""
    return T.let(F.lower(T.trim_ws(x)), lambda t: F.get(_group_hits(t, groups), F.lit(0))["level"])


def route_calls(calls: DataFrame, groups: list[dict] = L.ROUTING, threshold: float = 0.8, keep: tuple[str, ...] = ()) -> DataFrame:
    """One event for each call that a routing group is hit by, of the first such
    group. Calls below the confidence threshold go to review: automatic replies
    become rechecks. Event ids depend on the call and the level, so retries
    don't double events. Null confidence counts as 0. Columns of the call that are
    to ``keep`` follow."""
    first = T.let(F.lower(T.trim_ws(F.col("text"))), lambda t: F.get(_group_hits(t, groups), F.lit(0)))
    low = F.coalesce(F.col("confidence"), F.lit(0.0)) < threshold
    found = calls.withColumn("__g", first).filter(F.col("__g").isNotNull())
    recheck = low & (F.col("__g.action_type") == "auto_reply")
    lines = F.transform("__g.hits", lambda h: F.concat(F.lit(L.HIT_LINE), h))
    doubt = F.array(F.concat(F.lit(L.LOW_CONFIDENCE_LINE), F.format_string("%.2f", F.coalesce(F.col("confidence"), F.lit(0.0)))))
    a, b, c = L.SUMMARY
    return found.select(
        F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat(T.text_or_empty(F.col("segment_id")), F.col("__g.level")), 256), 1, 12)).alias("event_id"),
        "segment_id",
        "channel_id",
        F.col("__g.event_type").alias("event_type"),
        F.col("__g.level").alias("risk_level"),
        F.concat(F.lit(a), F.col("__g.event_type"), F.lit(b), F.array_join("__g.hits", ", "), F.lit(c)).alias("summary"),
        F.when(low, F.concat(lines, doubt)).otherwise(lines).alias("evidence"),
        F.when(recheck, F.lit(L.RECHECK_SUGGESTION)).otherwise(F.col("__g.suggestion")).alias("suggestion"),
        F.col("__g.broadcast_text").alias("broadcast_text"),
        F.when(recheck, F.lit("auto_reply_recheck")).otherwise(F.col("__g.action_type")).alias("action_type"),
        (F.col("__g.review") | low).alias("requires_human_review"),
        (F.col("__g.auto") & ~low).alias("is_auto_reply"),
        *keep,
    )


def classify_role(x: Column) -> Column:
    """(role, confidence, evidence) of a text."""

    def of(clean: Column) -> Column:
        hits = F.struct(T.keywords_in(clean, L.SHIP_WORDS).alias("ship"), T.keywords_in(clean, L.OPERATOR_WORDS).alias("operator"), T.keywords_in(clean, L.STRONG_SHIP_WORDS).alias("strong"))
        return T.let(hits, decide)

    def result(role: str, confidence: float, evidence: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"))

    def decide(h: Column) -> Column:
        ship, operator, strong = (F.size(h[k]) > 0 for k in ("ship", "operator", "strong"))
        return (
            F.when(ship & ~operator, result("ship", 0.82, h["ship"]))
            .when(operator & ~ship, result("operator", 0.82, h["operator"]))
            .when(ship & ~strong, result("operator", 0.76, h["operator"]))
            .when(ship, result("mixed", 0.58, F.concat(h["ship"], h["operator"])))
            .otherwise(result("unclear", 0.30, F.array().cast("array<string>")))
        )

    return T.let(T.norm_label(x), of)


def match_scenario(clean: Column, scenarios: dict[str, list[str]]) -> Column:
    """(scenario, hits) with most hits in a normalised text; the first of several,
    or 'unknown' without any."""
    table = T.constant([{"scenario": name, "keywords": T.keywords(words)} for name, words in scenarios.items()], f"array<struct<scenario:string,keywords:{T.KEYWORDS}>>")
    each = F.transform(table, lambda s: F.struct(s["scenario"].alias("scenario"), T.found_in(clean, s["keywords"]).alias("hits")))
    none = F.struct(F.lit("unknown").alias("scenario"), F.array().cast("array<string>").alias("hits"))
    return F.aggregate(each, none, lambda best, one: F.when(F.size(one["hits"]) > F.size(best["hits"]), one).otherwise(best))


def weak_label(x: Column, role: Column) -> Column:
    """(label, type, confidence, evidence, category, scenario, automation,
    ship_hits, operator_hits) of a text by rules."""

    def result(label: str, kind: Column, confidence: float, evidence: Column, category: str, automation: str, h: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"), kind.alias("type"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"), F.lit(category).alias("category"),
            (F.lit("not_target") if label == "not_target" else kind).alias("scenario"), F.lit(automation).alias("automation"), h["ship"].alias("ship_hits"), h["operator"].alias("operator_hits"),
        )

    none = F.array().cast("array<string>")

    def of(clean: Column) -> Column:
        said = F.struct(T.keywords_in(clean, [*L.SHIP_REPORT_WORDS, *L.DISTRESS_WORDS]).alias("ship"), F.when(role == "ship", none).otherwise(T.keywords_in(clean, L.OPERATOR_INSTRUCTION_WORDS)).alias("operator"))
        # scenarios are matched for ships' calls only
        return T.let(said, lambda b: F.when(role.isNull() | (role != "ship"), result("not_target", F.lit("none"), 0.90, none, "not_target", "not_target", b)).otherwise(T.let(scenarios(clean), lambda h: decide(h, b))))

    def scenarios(clean: Column) -> Column:
        each = {"high": L.HIGH_RISK, "auto": L.AUTO_REPLY, "manual": L.MANUAL_ADVICE, "other": L.NON_HIGH_RISK}
        return F.struct(T.keywords_in(clean, L.DISTRESS_WORDS).alias("distress"), *[match_scenario(clean, table).alias(k) for k, table in each.items()])

    def decide(h: Column, b: Column) -> Column:
        high = T.ordered_distinct(h["distress"], h["high"]["hits"])
        kind = F.when(h["high"]["scenario"] == "unknown", F.lit("distress_call")).otherwise(h["high"]["scenario"])
        return (
            F.when(F.size(high) > 0, result("high", kind, 0.90, high, "high_risk", "manual_immediate", b))
            .when(F.size(h["auto"]["hits"]) > 0, result("normal", h["auto"]["scenario"], 0.84, h["auto"]["hits"], "non_high_risk", "auto_reply", b))
            .when(F.size(h["manual"]["hits"]) > 0, result("uncertain", h["manual"]["scenario"], 0.70, h["manual"]["hits"], "non_high_risk", "llm_advice", b))
            .when(F.size(h["other"]["hits"]) > 0, result("normal", h["other"]["scenario"], 0.72, h["other"]["hits"], "non_high_risk", "manual_or_rule_review", b))
            .otherwise(result("uncertain", F.lit("unknown"), 0.35, none, "non_high_risk", "llm_advice", b))
        )

    return T.let(T.norm_label(x), of)


def rule_fallback(x: Column) -> Column:
    """(role, role_confidence, crisis, crisis_confidence, automation, scenario,
    evidence, ship_hits, operator_hits) of a text by rules alone."""

    def of(role: Column) -> Column:
        return T.let(weak_label(x, role["role"]), lambda w: both(role, w))

    def both(r: Column, w: Column) -> Column:
        return F.struct(
            r["role"].alias("role"), r["confidence"].alias("role_confidence"), T.risk_to_crisis(w["label"]).alias("crisis"), w["confidence"].alias("crisis_confidence"), w["automation"].alias("automation"),
            w["scenario"].alias("scenario"), T.ordered_distinct(r["evidence"], w["evidence"]).alias("evidence"), w["ship_hits"].alias("ship_hits"), w["operator_hits"].alias("operator_hits"),
        )

    return T.let(classify_role(x), of)


def disagreement(a: Column, b: Column) -> Column:
    """Which of role, crisis and automation differ, joined by |; '' where either
    analysis is missing."""
    flags = [F.when(a[k] != b[k], F.lit(k)) for k in ("role", "crisis", "automation")]
    return F.when(a.isNull() | b.isNull(), F.lit("")).otherwise(F.concat_ws("|", *flags))


ANALYSIS = ("role", "role_confidence", "crisis", "crisis_confidence", "automation", "scenario", "evidence", "rationale")


def fuse_analysis(calls: DataFrame, llm: DataFrame, audio: DataFrame) -> DataFrame:
    """Calls with ``final`` (the chosen analysis) and ``fallback`` (that of the
    rules). The first analysis counts unless its role is unclear and there is one
    of audio; what the chosen one leaves blank comes from the rules. Analyses
    have one row for each segment_id."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("segment_id").alias(f"__{name}_id"), F.struct(*[F.col(c) for c in ANALYSIS]).alias(f"__{name}"))

    # the joins need this shuffle anyway; rules are dear, so its tasks are not merged
    judged = T.once(dealt(calls, "segment_id"), "fallback", rule_fallback(F.col("text")))
    joined = judged.join(keyed(llm, "llm"), F.col("segment_id") == F.col("__llm_id"), "left").join(keyed(audio, "audio"), F.col("segment_id") == F.col("__audio_id"), "left")
    l, a, fb = F.col("__llm"), F.col("__audio"), F.col("fallback")  # noqa: E741
    from_llm = l.isNotNull() & ((l["role"] != "unclear") | a.isNull())
    chosen = F.when(from_llm, l).when(a.isNotNull(), a)
    source = F.when(from_llm, F.lit("llm_analysis")).when(a.isNotNull(), F.lit("audio_model_analysis")).otherwise(F.lit("rule_fallback"))

    def final(x: Column) -> Column:
        ship = x["role"] == "ship"
        automation = F.when(~ship, F.lit("not_target")).when(x["crisis"] == "crisis", F.lit("manual_immediate")).when((x["crisis"] == "non_crisis") & (x["automation"] == "unknown"), F.lit("llm_advice")).otherwise(x["automation"])
        filled = F.struct(
            source.alias("source"), x["role"].alias("role"), F.coalesce(F.nullif(x["role_confidence"], F.lit(0.0)), fb["role_confidence"]).alias("role_confidence"),
            F.when(ship, x["crisis"]).otherwise(F.lit("not_target")).alias("crisis"), F.coalesce(F.nullif(x["crisis_confidence"], F.lit(0.0)), fb["crisis_confidence"]).alias("crisis_confidence"),
            automation.alias("automation"), F.when(x["scenario"] == "unknown", fb["scenario"]).otherwise(x["scenario"]).alias("scenario"),
            F.when(F.size(x["evidence"]) > 0, x["evidence"]).otherwise(fb["evidence"]).alias("evidence"), x["rationale"].alias("rationale"), disagreement(l, a).alias("disagreement"),
        )
        rules = F.struct(
            source.alias("source"), fb["role"].alias("role"), fb["role_confidence"].alias("role_confidence"), fb["crisis"].alias("crisis"), fb["crisis_confidence"].alias("crisis_confidence"), fb["automation"].alias("automation"),
            fb["scenario"].alias("scenario"), fb["evidence"].alias("evidence"), F.lit(L.FALLBACK_RATIONALE).alias("rationale"), F.lit("").alias("disagreement"),
        )
        return F.when(x.isNull(), rules).otherwise(filled)

    return T.once(joined.withColumn("__chosen", chosen), "final", final(F.col("__chosen"))).drop("__llm_id", "__audio_id", "__llm", "__audio", "__chosen")


def weak_label_manifest(calls: DataFrame, llm: DataFrame, audio: DataFrame) -> DataFrame:
    """``calls`` with the columns of the weakly labelled manifest."""
    fused = fuse_analysis(calls, llm, audio)
    x, fb = F.col("final"), F.col("fallback")
    evidence = F.array_join(x["evidence"], "|")
    return fused.select(
        *[F.col(c) for c in calls.columns],
        x["source"].alias("analysis_source"), x["role"].alias("role_pred"), x["role_confidence"].alias("role_confidence"), x["crisis"].alias("crisis_label_pred"), x["crisis_confidence"].alias("crisis_confidence"),
        x["automation"].alias("automation_label_pred"), x["scenario"].alias("scenario_pred"), evidence.alias("analysis_evidence"), x["rationale"].alias("analysis_rationale"), x["disagreement"].alias("analysis_disagreement"),
        fb["role"].alias("fallback_role_pred"), fb["crisis"].alias("fallback_crisis_label_pred"), fb["automation"].alias("fallback_automation_label_pred"), fb["scenario"].alias("fallback_scenario_pred"),
        F.array_join(fb["ship_hits"], "|").alias("ship_keyword_hits"), F.array_join(fb["operator_hits"], "|").alias("operator_keyword_hits"),
        T.crisis_to_risk(x["crisis"]).alias("risk_label_pred"), x["scenario"].alias("risk_type_pred"), T.crisis_to_category(x["crisis"]).alias("risk_category_pred"), x["crisis_confidence"].alias("weak_confidence"), evidence.alias("risk_evidence"),
    )


def _points(condition: Column, n: int) -> Column:
    return F.when(condition, F.lit(n)).otherwise(F.lit(0))


def review_priority() -> Column:
    """Additive score of a weakly labelled row."""
    risk, role, automation = F.col("risk_label_pred"), F.col("role_pred"), F.col("automation_label_pred")
    confidence = T.parse_float(F.col("weak_confidence"))
    return _points(risk == "high", 100) + _points(risk == "uncertain", 80) + _points(automation == "llm_advice", 45) + _points(automation == "auto_reply", 20) + _points(role.isin("mixed", "unclear"), 55) + _points(confidence < 0.6, 35) + _points(T.text_health(F.col("text"))["very_short"], 25)


def review_tier() -> Column:
    """The first of five conditions that holds, as a score."""
    risk, role = F.col("risk_label_pred"), F.col("role_pred")
    return F.when(risk == "high", 100).when(risk == "uncertain", 80).when(role.isin("mixed", "unclear"), 70).when(T.parse_float(F.col("weak_confidence")) < 0.6, 60).when(T.text_health(F.col("text"))["very_short"], 50).otherwise(10)


HUMAN_COLUMNS = ("human_role", "human_risk_label", "human_risk_type", "human_risk_category", "human_scenario", "human_automation_label", "human_reference_text", "notes")


def review_manifest(rows: DataFrame, limit: int = 500) -> DataFrame:
    """Rows by falling priority, with blank columns for people to fill. A limit of
    0 or less keeps all."""
    out = rows.withColumn("review_priority", review_priority()).withColumns({c: F.lit("") for c in HUMAN_COLUMNS}).orderBy(F.desc("review_priority"), "segment_id")
    return out.limit(limit) if limit > 0 else out


def derive_outcome(segments: DataFrame, events: DataFrame, task: str = "session_id") -> DataFrame:
    """One outcome for each task: risk if an event is of level L1 or L2, auto if
    one is answered automatically, else manual. Segments have (task, seq, text)
    and events (task, seq) besides their own columns. A task's texts meet in one
    row."""
    said = segments.filter(F.length(T.text_or_empty(F.col("text"))) > 0).groupBy(F.col(task).alias("__t")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    risky = F.col("risk_level").isin("L1", "L2")
    auto = F.col("is_auto_reply") | (F.col("action_type") == "auto_reply")
    facts = F.struct("suggestion", "broadcast_text", "summary")
    found = events.groupBy(F.col(task).alias("__e")).agg(F.min_by(F.when(risky, facts), F.when(risky, F.col("seq"))).alias("risk"), F.min_by(F.when(auto, facts), F.when(auto, F.col("seq"))).alias("auto"))
    tasks = segments.select(task).distinct().join(said, F.col(task) == F.col("__t"), "left").join(found, F.col(task) == F.col("__e"), "left")
    text = T.text_or_empty(F.col("text"))
    risk, auto_event = F.col("risk"), F.col("auto")
    kind = F.when(risk.isNotNull(), F.lit("risk")).when(auto_event.isNotNull(), F.lit("auto")).otherwise(F.lit("manual"))
    reply = F.when(risk.isNotNull(), risk["suggestion"]).when(auto_event.isNotNull(), T.canned_auto_reply(text)).otherwise(T.canned_manual_advice(text))
    spoken = F.when(risk.isNotNull(), risk["broadcast_text"]).otherwise(reply)
    reason = F.when(risk.isNotNull(), risk["summary"]).when(auto_event.isNotNull(), auto_event["summary"]).otherwise(F.lit(L.MANUAL_REASON))
    return tasks.select(task, kind.alias("type"), text.alias("text"), reply.alias("reply"), spoken.alias("tts"), reason.alias("reason"))


def merge_pipelines(a: DataFrame, b: DataFrame) -> DataFrame:
    """(segment_id, crisis, confidence): crisis if either says so, else the label
    of the more confident, the first where they are equal."""
    right = b.select(F.col("segment_id").alias("__id"), F.col("crisis").alias("__crisis"), F.col("crisis_confidence").alias("__confidence"))
    both = a.join(right, F.col("segment_id") == F.col("__id"), "full")
    one, two = F.coalesce(F.col("crisis_confidence"), F.lit(-1.0)), F.coalesce(F.col("__confidence"), F.lit(-1.0))
    crisis = (F.col("crisis") == "crisis").eqNullSafe(True) | (F.col("__crisis") == "crisis").eqNullSafe(True)
    return both.select(F.coalesce("segment_id", "__id").alias("segment_id"), F.when(crisis, F.lit("crisis")).when(one >= two, F.col("crisis")).otherwise(F.col("__crisis")).alias("crisis"), F.greatest(one, two).alias("confidence"))


def infer_route(role: Column, rule: Column, model: Column, probability: Column, high: float = 0.75, low: float = 0.65) -> Column:
    """The route of a call from its role, its rule label and a model's label with
    its probability."""
    return (
        F.when(role != "ship", F.lit("not_target"))
        .when(rule == "high", F.lit("emergency"))
        .when((model == "high") & (probability >= high), F.lit("emergency"))
        .when((probability < low) | (rule == "uncertain"), F.lit("manual_review"))
        .otherwise(F.lit("normal_business"))
    )


def broadcast_recommendations(events: DataFrame) -> DataFrame:
    return events.select("event_id", "channel_id", "broadcast_text", "suggestion")


def review_candidates(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Labelled rows that deserve a second review: uncertain risk, low
    confidence, unclear role or disagreement."""
    return rows.filter((F.col("risk_label_pred") == "uncertain") | (F.col("weak_confidence") < threshold) | F.col("role_pred").isin("mixed", "unclear") | (F.col("analysis_disagreement") != ""))


def labelled_manifest(reviewed: DataFrame) -> DataFrame:
    """(audio_path, transcript) of rows that people have transcribed."""
    return reviewed.filter(T.nz(F.col("human_reference_text")).isNotNull()).select(F.col("clip_path").alias("audio_path"), T.trim_ws(F.col("human_reference_text")).alias("transcript"))


def training_set(rows: DataFrame) -> DataFrame:
    """Rows that people have labelled as ships' calls of known risk."""
    return rows.filter((F.col("human_role") == "ship") & F.col("human_risk_label").isin("high", "normal", "uncertain"))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")
