"""Text functions as native column expressions. Null counts as ''."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwatch.functions import automaton
from callwatch.functions import lexicons as L
from callwatch.functions.distance import distances

#: White space in the Unicode sense, for Java.
_SPACES = r"(?U)\s+"


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def trim_ws(x: Column) -> Column:
    """Without white space, in the Unicode sense, at either end."""
    # possessive, and only from a run's first character, so that inner blanks cost once
    return F.regexp_replace(text_or_empty(x), r"(?U)^\s++|(?<!\s)\s++$", "")


def nz(x: Column) -> Column:
    """Null where blank."""
    return F.nullif(trim_ws(x), F.lit(""))


def constant(value: Any, kind: str) -> Column:
    """A table of fixed values, of the type ``kind``, as one literal: Spark folds
    the expression, and a plan isn't built word by word."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def words_of(words: list[str]) -> Column:
    return constant(list(words), "array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row however often it is
    used: an exploded array of one is not merged into later projections."""
    return df.withColumn(name, F.explode(F.array(value)))


def norm_label(x: Column) -> Column:
    return F.translate(F.lower(text_or_empty(x)), " ，,", "")


def norm_agree(x: Column) -> Column:
    """Lower case without punctuation, for agreement between transcripts."""
    return F.regexp_replace(trim_ws(F.lower(text_or_empty(x))), f"(?U)[{L.PUNCTUATION}]+", "")


def norm_cer(x: Column) -> Column:
    """As ``norm_agree``, with radio words rewritten, for error rates."""
    out = norm_agree(x)
    for old, new in L.RADIO_WORDS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def sanitize_text(x: Column) -> Column:
    """Without emoji, short bracketed tags, blanks between CJK characters and
    decoration; other white space collapsed."""
    out = F.regexp_replace(text_or_empty(x), L.EMOJI, "")
    out = F.regexp_replace(out, L.BRACKET_TAG, "")
    out = F.regexp_replace(out, L.BLANKS_BETWEEN_CJK, "")
    out = F.regexp_replace(out, L.DECORATION, " ")
    out = F.regexp_replace(out, L.HEADING_MARKS, " ")
    return F.trim(F.regexp_replace(out, _SPACES, " "))


def script_guard(x: Column) -> Column:
    """The scripts in a text that transcripts should not hold."""
    return F.array_compact(F.array(*[F.when(text_or_empty(x).rlike(pattern), F.lit(name)) for name, pattern in L.SCRIPTS.items()]))


def correct_lexicon(x: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """(text, hits): aliases replaced by their canonical names, those of longer
    names and longer aliases first; later rules see what earlier ones made.
    Blank aliases don't count. Many rules are matched by an automaton."""
    ordered = [(name, alias) for name, aliases in sorted(rules, key=lambda r: -len(r[0])) for alias in sorted(aliases, key=lambda a: -len(a)) if alias and alias != name]
    empty = F.array().cast("array<struct<alias:string,canonical:string>>")
    if not ordered:
        return F.struct(text_or_empty(x).alias("text"), empty.alias("hits"))
    if len(ordered) > automaton.FEW:
        return automaton.replaced(text_or_empty(x), [(alias, name) for name, alias in ordered])
    pairs = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(n).alias("canonical")) for n, a in ordered])

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["text"], rule["alias"])
        return F.struct(F.replace(acc["text"], rule["alias"], rule["canonical"]).alias("text"), F.when(hit, F.concat(acc["hits"], F.array(rule))).otherwise(acc["hits"]).alias("hits"))

    return F.aggregate(pairs, F.struct(text_or_empty(x).alias("text"), empty.alias("hits")), step)


#: Words with their lower-cased forms, as literals.
KEYWORDS = "array<struct<word:string,low:string>>"


def keywords(words: list[str]) -> list[dict[str, str]]:
    return [{"word": w, "low": w.lower()} for w in words]


def found_in(x: Column, table: Column) -> Column:
    """The words of a table of the type ``KEYWORDS`` whose lower-cased forms are
    contained in x, in the table's order."""
    return F.transform(F.filter(table, lambda k: F.contains(x, k["low"])), lambda k: k["word"])


def keywords_in(x: Column, words: list[str]) -> Column:
    """The words contained in x, which is in lower case, in the list's order."""
    return found_in(x, constant(keywords(words), KEYWORDS))


def extract_keywords(x: Column, words: list[str]) -> Column:
    """The words contained in lower-cased x, in the list's order. A long list is
    matched by an automaton."""
    if len(words) > automaton.FEW:
        return automaton.hits(F.lower(text_or_empty(x)), words)
    return let(F.lower(text_or_empty(x)), lambda t: keywords_in(t, words))


def match_keywords(x: Column, words: list[str]) -> Column:
    """As ``extract_keywords``, on text without blanks and commas."""
    if len(words) > automaton.FEW:
        return automaton.hits(norm_label(x), words)
    return let(norm_label(x), lambda t: keywords_in(t, words))


def ordered_distinct(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*arrays))


def parse_evidence(x: Column) -> Column:
    """The parts of a list in one string: split at the first of | ； ; that
    occurs at all, blank parts left out; blank gives an empty array."""
    clean = trim_ws(x)

    def split(mark: str) -> Column:
        return F.filter(F.transform(F.split(clean, mark), trim_ws), lambda p: p != "")

    return F.when(F.contains(clean, F.lit("|")), split(r"\|")).when(F.contains(clean, F.lit("；")), split("；")).when(F.contains(clean, F.lit(";")), split(";")).otherwise(F.filter(F.array(clean), lambda p: p != ""))


def parse_float(x: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(x.cast("string").try_cast("double"), F.lit(default).cast("double"))


def clamp_confidence(confidence: Column, score: Column, default: float = 0.85) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, score))), F.lit(default))


def edit_distance(a: Column, b: Column) -> Column:
    return distances(text_or_empty(a), text_or_empty(b))["distance"]


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate; may exceed 1. An empty reference has 0 against an
    empty hypothesis and else 1."""
    x = distances(norm_cer(reference), norm_cer(hypothesis))
    return F.when(x["a"] == 0, F.when(x["b"] == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(x["distance"] / x["a"])


def similarity(a: Column, b: Column) -> Column:
    x = distances(norm_agree(a), norm_agree(b))
    longest = F.greatest(x["a"], x["b"])
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - x["distance"] / longest))


def accuracy(error_rate: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - error_rate)


def render_notice(template: Column, ship: Column, area: Column) -> Column:
    return F.replace(F.replace(template, F.lit(L.SHIP_MARK), ship), F.lit(L.AREA_MARK), area)


def first_text(x: Column, choices: list[tuple[str | None, str]]) -> Column:
    """The text of the first pattern that occurs; the last pair is the default."""
    *some, (_, default) = choices
    out = F.lit(default)
    for pattern, text in reversed(some):
        out = F.when(text_or_empty(x).rlike(pattern), F.lit(text)).otherwise(out)
    return out


def canned_auto_reply(x: Column) -> Column:
    return first_text(x, L.AUTO_REPLIES)


def canned_manual_advice(x: Column) -> Column:
    return first_text(x, L.MANUAL_ADVICES)


def text_health(x: Column) -> Column:
    """(empty, short, very_short) by the length of the trimmed text."""
    n = F.length(trim_ws(x))
    return F.struct((n == 0).alias("empty"), ((n > 0) & (n < 8)).alias("short"), (n < 4).alias("very_short"))


def synonym(x: Column, table: dict[str, str], default: str) -> Column:
    pairs = constant(table, "map<string,string>")
    return F.coalesce(F.element_at(pairs, F.lower(trim_ws(x))), F.lit(default))


def norm_role(x: Column) -> Column:
    return synonym(x, L.ROLE_SYNONYMS, "unclear")


def norm_crisis(x: Column) -> Column:
    return synonym(x, L.CRISIS_SYNONYMS, "uncertain")


def norm_automation(x: Column) -> Column:
    return synonym(x, L.AUTOMATION_SYNONYMS, "unknown")


def crisis_to_risk(x: Column) -> Column:
    return synonym(x, L.RISK_OF, "uncertain")


def crisis_to_category(x: Column) -> Column:
    return synonym(x, L.CATEGORY_OF, "non_high_risk")


def risk_to_crisis(x: Column) -> Column:
    return synonym(x, L.CRISIS_OF, "uncertain")
