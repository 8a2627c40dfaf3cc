"""The phrase table's pinned labels, and small cases of routing and fusion."""

import pytest
from pyspark.sql import functions as F

from callwatch.functions import text as T
from callwatch.operators import models, routing, sessions
from callwatch.plans.views import PHRASES

# role, its confidence, label, scenario, confidence, automation, level, hits
EXPECTED = [
    ("ship", 0.82, "high", "fire_or_explosion", 0.90, "manual_immediate", "L1", "mayday、求救、起火"),
    ("ship", 0.82, "high", "collision", 0.90, "manual_immediate", "L1", "进水"),
    ("mixed", 0.58, "not_target", "not_target", 0.90, "not_target", "AUTO", "靠泊"),
    ("operator", 0.76, "not_target", "not_target", 0.90, "not_target", "AUTO", "抛锚"),
    ("operator", 0.76, "not_target", "not_target", 0.90, "not_target", None, None),
    ("mixed", 0.58, "not_target", "not_target", 0.90, "not_target", "MANUAL", "离泊、申请离泊、出港"),
    ("ship", 0.82, "normal", "report_line", 0.84, "auto_reply", "AUTO", "过报告线、报告线"),
    ("ship", 0.82, "uncertain", "navmark_depth_weather_query", 0.70, "llm_advice", None, None),
    ("ship", 0.82, "high", "loss_control_or_mechanical_failure", 0.90, "manual_immediate", "L2", "失去动力、故障"),
    ("unclear", 0.30, "not_target", "not_target", 0.90, "not_target", "L2", "团雾、避让"),
    ("operator", 0.82, "not_target", "not_target", 0.90, "not_target", "L3", "超速"),
    ("unclear", 0.30, "not_target", "not_target", 0.90, "not_target", None, None),
    ("unclear", 0.30, "not_target", "not_target", 0.90, "not_target", None, None),
    ("unclear", 0.30, "not_target", "not_target", 0.90, "not_target", None, None),
    ("ship", 0.82, "normal", "departure_report", 0.84, "auto_reply", "MANUAL", "离泊、目的地"),
    ("ship", 0.82, "high", "anchor_dragging", 0.90, "manual_immediate", None, None),
    ("mixed", 0.58, "not_target", "not_target", 0.90, "not_target", None, None),
    ("ship", 0.82, "uncertain", "unknown", 0.35, "llm_advice", None, None),
    ("ship", 0.82, "uncertain", "drill_trial_lightering", 0.70, "llm_advice", None, None),
    ("ship", 0.82, "uncertain", "routine_avoidance_coordination", 0.70, "llm_advice", "L2", "避让"),
]


def calls(spark, texts, confidence=0.9):
    rows = [(f"s{i}", "c1", t, confidence) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "segment_id string, channel_id string, text string, confidence double")


def test_phrases(spark):
    df = calls(spark, PHRASES)
    x = df.withColumn("r", routing.classify_role(F.col("text"))).withColumn("w", routing.weak_label(F.col("text"), F.col("r.role")))
    got = {r.segment_id: (r.r.role, r.r.confidence, r.w.label, r.w.scenario, r.w.confidence, r.w.automation) for r in x.collect()}
    levels = {r.segment_id: (r.risk_level, "、".join(e.split(": ")[1] for e in r.evidence)) for r in routing.route_calls(df).collect()}
    for i, row in enumerate(EXPECTED):
        assert got[f"s{i}"] == row[:6]
        assert levels.get(f"s{i}", (None, None)) == row[6:]


def test_low_confidence_is_rechecked(spark):
    (e,) = routing.route_calls(calls(spark, ["我船已靠泊"], 0.5)).collect()
    assert (e.action_type, e.requires_human_review, e.is_auto_reply) == ("auto_reply_recheck", True, False)
    assert e.evidence[-1].endswith("0.50")
    (e,) = routing.route_calls(calls(spark, ["我船已靠泊"], None)).collect()
    assert e.action_type == "auto_reply_recheck"


def test_blank_and_null_calls_give_no_event(spark):
    assert routing.route_calls(calls(spark, ["", "  ", None, "好的"])).count() == 0


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("value", "expected"),
    [("你 好 [tag] ok", "你好 ok"), ("a##b", "a b"), ("🚢 船", "船"), (None, ""), ("a__b|c", "a b c"), ("(长长长长长长长长长长长长长长)", "(长长长长长长长长长长长长长长)")],
)
def test_sanitize(spark, value, expected):
    assert one(spark, value, T.sanitize_text) == expected


def test_lexicon_rules_see_what_earlier_ones_made(spark):
    rules = [("北仑主航道A3段", ["主航道A3", "A3段"])]
    got = one(spark, "主航道A3段", lambda x: T.correct_lexicon(x, rules))
    # the first rule's result holds the second alias again
    assert got.text == "北仑" + "主航道" + "北仑主航道A3段" + "段"
    assert [h.alias for h in got.hits] == ["主航道A3", "A3段"]


@pytest.mark.parametrize(("value", "expected"), [("a|b", ["a", "b"]), ("a；b;c", ["a", "b;c"]), (" x ", ["x"]), (None, []), ("a; ", ["a"])])
def test_evidence(spark, value, expected):
    assert one(spark, value, T.parse_evidence) == expected


def test_error_rates(spark):
    rows = [("abc", "abd"), ("", ""), ("", "x"), ("频道", "CH"), ("船舶", "船泊"), (None, None), ("ab", "abcdef")]
    df = spark.createDataFrame(rows, "r string, h string")
    got = [round(r.c, 6) for r in df.select(T.cer(F.col("r"), F.col("h")).alias("c")).collect()]
    assert got == [0.333333, 0.0, 1.0, 0.0, 0.5, 0.0, 2.0]


def test_fusion_prefers_a_clear_role(spark):
    df = calls(spark, ["我船碰撞"] * 4)
    kind = "segment_id string, role_label string, role_confidence string, crisis_label string, crisis_confidence string, automation_label string, scenario string, evidence string, rationale string"
    llm = models.normalize_analysis(spark.createDataFrame([("s0", "ship", "0.9", "normal", "0.8", "", "weather", "a|b", ""), ("s1", "", "", "high", "", "", "", "", ""), ("s2", "", "", "", "", "", "", "", "")], kind))
    audio = models.normalize_analysis(spark.createDataFrame([("s1", "vts", "0.7", "high", "0.6", "auto", "x", "", "")], kind))
    got = {r.segment_id: r.final for r in routing.fuse_analysis(df, llm, audio).collect()}
    assert (got["s0"].source, got["s0"].automation, got["s0"].evidence) == ("llm_analysis", "llm_advice", ["a", "b"])
    assert (got["s1"].source, got["s1"].crisis) == ("audio_model_analysis", "not_target")
    assert (got["s2"].source, got["s2"].role) == ("llm_analysis", "unclear")
    assert (got["s3"].source, got["s3"].crisis) == ("rule_fallback", "crisis")
    assert got["s1"].disagreement == "role|automation"


def test_search_and_union(spark):
    a = spark.createDataFrame([("s", 1, "x", "reply one")], "segment_id string, ts int, text string, reply string")
    assert sessions.search_records(a, " ").count() == 1
    assert sessions.search_records(a, "one").count() == 1
    assert sessions.search_records(a, "two").count() == 0
    assert sessions.ragged_union(a, a.select(F.lit(1).alias("z"))).columns == ["segment_id", "ts", "text", "reply", "z"]
