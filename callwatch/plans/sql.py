"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from callwatch.functions import lexicons as L
from callwatch.plans import views


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def with_views(*names: str, extra: str = "") -> str:
    parts = [f"{n} as ({views.SQL[n]})" for n in names]
    return "with recursive " + ", ".join(parts + ([extra] if extra else [])) + " "


def hits(text: str, words: list[str]) -> str:
    return f"list_filter({listed(words)}, lambda k: contains({text}, k))"


def norm(text: str) -> str:
    return f"translate(lower({text}), ' ，,', '')"


def joined(array: str, mark: str = "|") -> str:
    return f"array_to_string({array}, '{mark}')"


def synonym(x: str, table: dict[str, str], default: str) -> str:
    return f"case lower(trim({x})) " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in table.items()) + f" else {quoted(default)} end"


def first_text(x: str, choices: list[tuple[str | None, str]]) -> str:
    *some, (_, default) = choices
    return "case " + " ".join(f"when regexp_matches({x}, {quoted(p)}) then {quoted(t)}" for p, t in some) + f" else {quoted(default)} end"


def scenario(prefix: str, text: str, table: dict[str, list[str]]) -> str:
    """Columns {prefix}_s and {prefix}_h: the scenario with most hits, and they."""
    names = list(table)
    counts = ", ".join(f"len({hits(text, table[n])})" for n in names)
    place = f"list_position([{counts}], list_max([{counts}]))"
    top = f"list_max([{counts}])"
    lists = ", ".join(hits(text, table[n]) for n in names)
    return f"case when {top} > 0 then {listed(names)}[{place}] else 'unknown' end {prefix}_s, case when {top} > 0 then [{lists}][{place}] else [] end {prefix}_h"


#: Adds role, role_confidence and role_evidence to calls.
ROLES = f"""role_hits as (select *, {norm("text")} nt from calls),
role_sets as (select *, {hits("nt", L.SHIP_WORDS)} sh, {hits("nt", L.OPERATOR_WORDS)} oh, {hits("nt", L.STRONG_SHIP_WORDS)} st from role_hits),
roles as (select *, case when len(sh) > 0 and len(oh) = 0 then 'ship' when len(oh) > 0 and len(sh) = 0 then 'operator' when len(sh) > 0 and len(st) = 0 then 'operator' when len(sh) > 0 then 'mixed' else 'unclear' end r,
 case when len(sh) > 0 and len(oh) > 0 then case when len(st) = 0 then 0.76 else 0.58 end when len(sh) + len(oh) > 0 then 0.82 else 0.30 end::double rc,
 case when len(sh) > 0 and len(oh) > 0 then case when len(st) = 0 then oh else list_concat(sh, oh) end else list_concat(sh, oh) end re from role_sets)"""

#: Adds the weak label's columns: wl, wt, wc, we, wg, ws, wa, wsh, woh.
WEAK = f"""{ROLES}, weak_sets as (select *, {hits("nt", L.SHIP_REPORT_WORDS + L.DISTRESS_WORDS)} wsh, case when r = 'ship' then [] else {hits("nt", L.OPERATOR_INSTRUCTION_WORDS)} end woh, {hits("nt", L.DISTRESS_WORDS)} dh,
 {scenario("hi", "nt", L.HIGH_RISK)}, {scenario("au", "nt", L.AUTO_REPLY)}, {scenario("ma", "nt", L.MANUAL_ADVICE)}, {scenario("ot", "nt", L.NON_HIGH_RISK)} from roles),
weak_kind as (select *, list_concat(dh, list_filter(hi_h, lambda k: not list_contains(dh, k))) hh, case when r <> 'ship' then 'n' when len(dh) + len(hi_h) > 0 then 'h' when len(au_h) > 0 then 'a' when len(ma_h) > 0 then 'm' when len(ot_h) > 0 then 'o' else 'u' end wk from weak_sets),
weak as (select *, case wk when 'n' then 'not_target' when 'h' then 'high' when 'a' then 'normal' when 'o' then 'normal' else 'uncertain' end wl,
 case wk when 'n' then 'none' when 'h' then case when hi_s = 'unknown' then 'distress_call' else hi_s end when 'a' then au_s when 'm' then ma_s when 'o' then ot_s else 'unknown' end wt,
 case wk when 'n' then 0.90 when 'h' then 0.90 when 'a' then 0.84 when 'm' then 0.70 when 'o' then 0.72 else 0.35 end::double wc,
 case wk when 'h' then hh when 'a' then au_h when 'm' then ma_h when 'o' then ot_h else [] end we,
 case wk when 'n' then 'not_target' when 'h' then 'high_risk' else 'non_high_risk' end wg, case wk when 'n' then 'not_target' when 'h' then case when hi_s = 'unknown' then 'distress_call' else hi_s end when 'a' then au_s when 'm' then ma_s when 'o' then ot_s else 'unknown' end ws,
 case wk when 'n' then 'not_target' when 'h' then 'manual_immediate' when 'a' then 'auto_reply' when 'o' then 'manual_or_rule_review' else 'llm_advice' end wa from weak_kind)"""

_LEVELS = [g["level"] for g in L.ROUTING]


def _by_level(key: str) -> str:
    return "case lv " + " ".join(f"when '{g['level']}' then {quoted(g[key]) if isinstance(g[key], str) else str(g[key]).lower()}" for g in L.ROUTING) + " end"


#: Events of calls: routed(segment_id, ... , lv, hits, ...).
EVENTS = f"""routed_sets as (select *, {", ".join(f"{hits('lower(text)', g['keywords'])} g{i}" for i, g in enumerate(L.ROUTING))} from calls where trim(text) <> ''),
routed as (select *, case {" ".join(f"when len(g{i}) > 0 then '{lv}'" for i, lv in enumerate(_LEVELS))} end lv, case {" ".join(f"when len(g{i}) > 0 then g{i}" for i in range(len(_LEVELS)))} end gh, confidence < 0.8 low from routed_sets),
routed_kind as (select *, {_by_level("action_type")} act, {_by_level("event_type")} kind, {_by_level("review")} rv, {_by_level("auto")} au, {_by_level("suggestion")} sg, {_by_level("broadcast_text")} bt from routed where lv is not null),
events_of as (select concat('evt_', substr(sha256(concat(segment_id, lv)), 1, 12)) event_id, segment_id, session_id, channel_id, seq, ts, kind event_type, lv risk_level,
 concat('{L.SUMMARY[0]}', kind, '{L.SUMMARY[1]}', array_to_string(gh, ', '), '{L.SUMMARY[2]}') summary,
 array_to_string(list_concat(list_transform(gh, lambda k: concat('{L.HIT_LINE}', k)), case when low then [concat('{L.LOW_CONFIDENCE_LINE}', printf('%.2f', confidence))] else [] end), '|') evidence,
 case when low and act = 'auto_reply' then '{L.RECHECK_SUGGESTION}' else sg end suggestion, bt broadcast_text, case when low and act = 'auto_reply' then 'auto_reply_recheck' else act end action_type, rv or low requires_human_review, au and not low is_auto_reply from routed_kind)"""
