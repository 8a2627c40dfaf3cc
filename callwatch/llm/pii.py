"""Personal data: labelers vote on spans, a classifier trained on what
expectation maximisation makes of the votes decides."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwatch.llm.words import let, running, running_sums
from callwatch.runtime import written

BASE = ("email", "ip", "card", "phone")
EXTRA = ("number", "local_phone", "secret")
KINDS = BASE + EXTRA

# The base patterns, so written that no text makes them try again what can't
# match: a run is entered at its start only, and no part gives back characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single blanks or hyphens, if it has 13 to 19
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+(-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    # a hexadecimal string, or what issuers' prefixes begin
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|[sr]k_(?:live|test)_|SG\.|npm_|pypi-|hf_|sk-)[A-Za-z0-9_-]{16,128})(?![A-Za-z0-9])",
}
#: What a text must contain for a pattern to match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "local_phone": r"[0-9]{3}[.-][0-9]{4}", "secret": "[0-9A-Fa-f]{32}|AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|[sr]k_|SG\\.|npm_|pypi-|hf_|sk-"}

# a part of zeros alone is 0
_OCTET = r"(?:0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])|0++)"
_IP = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

# What the labelers know. No pattern recurs over a span's length.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9_%+-]*+(?:\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*+(?<!-))?\.)++[A-Za-z]{2,}$",
    "ip": r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$",
    "card": r"^[3-6][0-9]{13,15}$|^[3-6][0-9]{3}([\x20-][0-9]{4}){3}$",
    "number": r"^[3-6][0-9]{13,15}$",
    "phone": r"^\+[1-9][0-9]{0,2}[\x20-]?(\([0-9]{1,4}\)|[0-9]{1,4})([\x20.-]?[0-9]{2,4}){2,4}$",
    "local_phone": r"^\([2-9][0-9]{2}\)|^[2-9][0-9]{2}[.-][2-9]",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z]).{20,128}$",
}
#: Entries of each kind's gazetteer and the pattern that an entry must fill.
#: One that isn't complete says nothing of a span that is not listed. Telephone
#: numbers without a country code have none: two labelers judge them.
GAZETTEER = {
    "email": ("com org net edu gov mil int info biz name pro aero coop museum io co me tv ai app dev eu us uk ca au nz ie de at ch li fr be lu nl es pt it gr mt cy dk se no fi is ee lv lt pl cz sk hu si hr rs ro bg ua ru by tr il in pk cn hk tw jp kr sg my th vn id ph za ng ke eg ma br ar cl mx pe uy ve".split(), r"\.(?:{})$"),
    "ip": ("127 10 169.254 192.168 224 239 255 0".split(), r"^(?!(?:{})\.)"),
    "card": ("4 51 52 53 54 55 222 223 224 225 226 227 228 229 23 24 25 26 270 271 2720 34 37 36 38 39 300 301 302 303 304 305 6011 644 645 646 647 648 649 65 352 353 354 355 356 357 358".split(), r"^(?:{})"),
    "number": ("4 51 52 53 54 55 222 223 224 225 226 227 228 229 23 24 25 26 270 271 2720 34 37 6011 65".split(), r"^(?:{})"),
    "phone": ("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 85 87 88 96 97 99".split(), r"^\+(?:{})"),
    # prefixes that issuers of keys are known by; a key without one is not listed
    "secret": ("akia asia aiza gho_ ghp_ ghs_ ghu_ ghr_ github_pat_ glpat- xoxa- xoxb- xoxp- xoxr- xoxs- sk_live_ sk_test_ rk_live_ rk_test_ sg. npm_ pypi- hf_ sk-".split(), r"^(?:{})"),
}
CUES = {
    "email": "mail contact write address kontakt courriel correo".split(),
    "ip": "ip host server addr login client".split(),
    "card": "card visa master pay credit karte carte tarjeta".split(),
    "number": "card visa master pay credit account iban karte carte tarjeta konto compte cuenta".split(),
    "phone": "call tel phone fax mobile handy anruf appel llam".split(),
    "local_phone": "call tel phone fax mobile".split(),
    "secret": "key token secret passw api auth bearer".split(),
}
AGAINST = "version isbn issn page chapter section article license figure sha1 sha256 md5 commit checksum".split()
#: Characters before a span in which cues are sought.
CONTEXT = 32
INCOMPLETE = ("secret",)
#: Kinds whose shape alone says little: without a cue, context votes against.
NEED_CUE = ("number", "secret")
#: Kinds whose candidates have the strict shape nearly always, so that it tells
#: nothing for them: the regex labeler only votes against.
SHAPELESS = ("secret",)
LABELERS = ("regex", "gazetteer", "context")
#: What the span classifier sees: the span's length and variety of characters,
#: the kinds of characters beside it, and the words before it (1 a cue, 2 a word
#: that speaks against, 0 neither), which the context labeler goes by too.
FEATURES = ("length", "distinct", "left", "right", "words")
BESIDE = (r"^$", r"[\s]", r"[\"'`=:<>(\[{]", r"[\p{L}\p{N}]")


@dataclass(frozen=True)
class Knowledge:
    """What the labelers go by: gazetteers (entries, pattern) and cue words by
    kind, and the words that speak against any kind."""

    gazetteer: dict[str, tuple[list[str], str]] = field(default_factory=lambda: dict(GAZETTEER))
    cues: dict[str, list[str]] = field(default_factory=lambda: dict(CUES))
    against: list[str] = field(default_factory=lambda: list(AGAINST))

    def listed(self, kind: str) -> str:
        entries, pattern = self.gazetteer[kind]
        return pattern.format("|".join(x.replace(".", r"\.") for x in entries))


def found(text: Column, kind: str) -> Column:
    """The matches of a kind's pattern as structs (start, end, word, before,
    after), places in code points. Splitting at the pattern leaves what lies
    between the matches; ``before`` is the end of that, up to ``CONTEXT``
    characters, and ``after`` the character behind the match."""
    none = F.array().cast("array<struct<start:int,end:int,word:string,before:string,after:string>>")

    def placed(parts: Column, words: Column) -> Column:
        widths = F.transform(words, lambda w, i: F.length(w) + F.length(F.get(parts, i)))

        def one(word: Column, i: Column, ends: Column) -> Column:
            end = F.get(ends, i)
            return F.struct((end - F.length(word)).alias("start"), end.alias("end"), word.alias("word"), F.right(F.get(parts, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(1)).alias("after"))

        return let(running_sums(widths), lambda ends: F.transform(words, lambda w, i: one(w, i, ends)))

    pattern = F.lit(PATTERNS[kind])
    words = F.regexp_extract_all(text, pattern, F.lit(0))
    some = let(words, lambda w: F.when(F.size(w) == 0, none).otherwise(let(F.split(text, PATTERNS[kind], -1), lambda p: placed(p, w))))
    return F.when(text.rlike(NEEDS[kind]), some).otherwise(none)


def digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(word: Column) -> Column:
    """Whether the digits' check sum is right."""

    def of(backward: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            digit = F.substring(backward, i, F.lit(1)).cast("int")
            twice = digit * 2 - F.when(digit > 4, F.lit(9)).otherwise(F.lit(0))
            return total + F.when(i % 2 == 0, twice).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(1), F.length(backward)), F.lit(0), step) % 10 == 0

    return let(F.reverse(digits(word)), of)


def _vote(yes: Column, no: Column) -> Column:
    """1 for, 0 against, -1 if the labeler says nothing."""
    return F.when(yes, F.lit(1)).when(no, F.lit(0)).otherwise(F.lit(-1))


def _beside(character: Column) -> Column:
    """0 at an end of the text, then by ``BESIDE``; its length for any other."""
    chosen = F.lit(len(BESIDE))
    for i in reversed(range(len(BESIDE))):
        chosen = F.when(character.rlike(BESIDE[i]), F.lit(i)).otherwise(chosen)
    return chosen


def _apart(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of ``taken``. Both are ordered by their starts
    together, so that a text with many of either stays cheap."""
    last = 2**31 - 1

    def of(spans: Column) -> Column:
        def sought(marks: Column) -> Column:
            ends = running(F.transform(marks, lambda m: F.when(m["i"] < 0, m["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
            starts = F.reverse(running(F.transform(F.reverse(marks), lambda m: F.when(m["i"] < 0, m["start"]).otherwise(last)), lambda a, b: F.least(a, b), last))
            alone = lambda m, e, n: F.when((m["i"] >= 0) & (e <= m["start"]) & (n >= m["end"]), m["i"])
            places = let(ends, lambda e: let(starts, lambda n: F.transform(marks, lambda m, i: alone(m, F.get(e, i), F.get(n, i)))))
            return F.transform(F.array_compact(places), lambda i: F.get(spans, i))

        own = F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["end"].alias("end")))
        others = F.transform(taken, lambda x: F.struct(x["start"].alias("start"), F.lit(-1).alias("i"), x["end"].alias("end")))
        return F.when((F.size(spans) == 0) | (F.size(taken) == 0), spans).otherwise(let(F.sort_array(F.concat(own, others)), sought))

    return let(spans, of)


def candidates(docs: DataFrame, knowledge: Knowledge | None = None) -> DataFrame:
    """(doc_id, found): all candidate spans of each text, as structs of kind,
    start, end, the three votes and the classifier's features. Candidates of
    further kinds that touch a base span are left out."""
    known = knowledge or Knowledge()

    def voted(spans: Column, kind: str) -> Column:
        def of(x: Column) -> Column:
            before = F.lower(x["before"])
            strict = x["word"].rlike(STRICT[kind])
            listed = F.lower(x["word"]).rlike(known.listed(kind)) if kind in known.gazetteer else None
            against = before.rlike("|".join(known.against))
            cue = before.rlike("|".join(known.cues[kind])) & ~against
            variety = F.size(F.array_distinct(F.split(F.left(x["word"], F.lit(128)), "")))
            return F.struct(
                F.lit(kind).alias("kind"),
                x["start"].alias("start"),
                x["end"].alias("end"),
                _vote(strict & F.lit(kind not in SHAPELESS), ~strict).alias("regex"),
                (F.lit(-1) if listed is None else _vote(listed, F.lit(kind not in INCOMPLETE))).alias("gazetteer"),
                _vote(cue, F.lit(True) if kind in NEED_CUE else against).alias("context"),
                F.least(F.lit(7), F.floor((x["end"] - x["start"]) / 8).cast("int")).alias("length"),
                F.least(F.lit(3), F.floor(variety / 5).cast("int")).alias("distinct"),
                _beside(F.right(x["before"], F.lit(1))).alias("left"),
                _beside(x["after"]).alias("right"),
                F.when(against, F.lit(2)).when(cue, F.lit(1)).otherwise(F.lit(0)).alias("words"),
            )

        return F.transform(spans, of)

    text = F.coalesce(F.col("text"), F.lit(""))
    # each step is a projection of its own: columns that the next one names several times are evaluated once
    matched = docs.select("doc_id", *[found(text, k).alias(k) for k in PATTERNS])
    base = {
        "email": F.col("email"),
        "ip": F.filter("ip", lambda x: x["word"].rlike(_IP)),
        "card": F.filter("card", lambda x: luhn(x["word"])),
        "phone": F.filter("phone", lambda x: F.length(digits(x["word"])).between(9, 15)),
    }
    extra = {"number": F.filter("card", lambda x: ~luhn(x["word"])), "local_phone": F.col("local_phone"), "secret": F.col("secret")}
    split = matched.select("doc_id", F.concat(*[voted(base[k], k) for k in BASE]).alias("base"), *[extra[k].alias(k) for k in EXTRA])
    return split.select("doc_id", F.concat("base", *[voted(_apart(F.col(k), F.col("base")), k) for k in EXTRA]).alias("found"))


@dataclass
class Votes:
    """What expectation maximisation has learnt: each labeler's reliability (right
    on personal spans, right on others), the probability of each (kind, votes),
    and the span classifier's log odds by kind, and by kind, feature and value."""

    reliability: dict[str, tuple[float, float]] = field(default_factory=dict)
    personal: dict[tuple, float] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)
    weights: dict[tuple[str, str, int], float] = field(default_factory=dict)


def estimate(counts: dict[tuple, int], rounds: int = 50) -> tuple[dict[str, tuple[float, float]], dict[tuple, float]]:
    """Reliabilities and probabilities from counts of (kind, regex, gazetteer,
    context). A span is personal with a probability by kind; a labeler that
    speaks is right with one probability for personal spans and another for the
    rest. Rounds of expectation and maximisation start from a majority vote."""
    at = {p: min(0.95, max(0.05, (1 + sum(v == 1 for v in p[1:])) / (2 + sum(v >= 0 for v in p[1:])))) for p in counts}
    reliability: dict[str, tuple[float, float]] = {}
    for _ in range(rounds):
        prior = {}
        for kind in {p[0] for p in counts}:
            own = [p for p in counts if p[0] == kind]
            prior[kind] = (1 + sum(counts[p] * at[p] for p in own)) / (2 + sum(counts[p] for p in own))
        for i, x in enumerate(LABELERS, 1):
            said = [p for p in counts if p[i] >= 0]
            yes = (2 + sum(counts[p] * at[p] for p in said if p[i] == 1)) / (3 + sum(counts[p] * at[p] for p in said))
            no = (2 + sum(counts[p] * (1 - at[p]) for p in said if p[i] == 0)) / (3 + sum(counts[p] * (1 - at[p]) for p in said))
            reliability[x] = (yes, no)
        for p in counts:
            odds = math.log(prior[p[0]] / (1 - prior[p[0]]))
            for v, x in zip(p[1:], LABELERS, strict=True):
                yes, no = reliability[x]
                odds += 0 if v < 0 else math.log(yes / (1 - no)) if v == 1 else math.log((1 - yes) / no)
            at[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return reliability, at


def learn(patterns: list[dict], rounds: int = 50) -> Votes:
    """Estimates from counts ``n`` of patterns (kind, votes, features).

    Votes are weighed by ``estimate``; the probabilities it gives to spans are the
    labels of the classifier, a naive Bayes one for each kind on ``FEATURES``,
    which sees a span's shape and surroundings. Cue words are among these, so it
    is not blind to what the context labeler knows; votes themselves it never sees.
    """
    counts: dict[tuple, int] = {}
    for p in patterns:
        key = (p["kind"], *(p[x] for x in LABELERS))
        counts[key] = counts.get(key, 0) + p["n"]
    reliability, personal = estimate(counts, rounds)
    votes = Votes(reliability, personal)
    for kind in sorted({p["kind"] for p in patterns}):
        own = [(p, p["n"] * personal[(kind, *(p[x] for x in LABELERS))]) for p in patterns if p["kind"] == kind]
        good, bad = 1 + sum(g for _, g in own), 1 + sum(p["n"] - g for p, g in own)
        votes.prior[kind] = math.log(good / bad)
        for x in FEATURES:
            values = sorted({p[x] for p, _ in own})
            for v in values:
                one = 1 + sum(g for p, g in own if p[x] == v)
                zero = 1 + sum(p["n"] - g for p, g in own if p[x] == v)
                votes.weights[kind, x, v] = math.log(one / (good + len(values))) - math.log(zero / (bad + len(values)))
    return votes


def odds(span: Column, votes: Votes) -> Column:
    """The classifier's log odds for a span of a further kind."""
    total = F.lit(0.0)
    for kind in EXTRA:
        if kind not in votes.prior:
            continue
        own = F.lit(float(votes.prior[kind]))
        for name in FEATURES:
            chosen = F.lit(0.0)
            for (k, x, value), weight in votes.weights.items():
                if (k, x) == (kind, name):
                    chosen = F.when(span[name] == F.lit(value), F.lit(float(weight))).otherwise(chosen)
            own = own + chosen
        total = F.when(span["kind"] == kind, own).otherwise(total)
    return total


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_spans(docs: DataFrame, knowledge: Knowledge | None = None) -> DataFrame:
    """(doc_id, spans): arrays of structs of kind, start and end (code points,
    end exclusive), by kind in the order of ``KINDS``, then by start.

    Base spans are the matches of the four base patterns that pass their checks.
    Further candidates are long digit runs that are no card numbers, telephone
    numbers without country code and long hexadecimal strings. A regex, a
    gazetteer and a context labeler vote on every candidate, by ``knowledge``;
    see ``learn`` for how votes become a classifier, whose verdict adds further
    spans. Base spans stay whatever it says. Only counts of patterns of votes and
    features reach the driver, at most |KINDS| * 18 * 8 * 4 * 5 * 5 * 3 rows
    however many documents there are.

    A null or empty text has no spans. Rows that repeat, or lack an id, are
    judged each for itself. An empty input gives an empty result.
    """
    voted = written(candidates(docs.select("doc_id", "text"), knowledge))
    each = voted.select(F.explode("found").alias("x"))
    keys = ["kind", *dict.fromkeys([*LABELERS, *FEATURES])]
    patterns = [r.asDict() for r in each.select("x.*").groupBy(*keys).agg(F.count("*").alias("n")).collect()]  # bounded, see above
    votes = learn(sorted(patterns, key=lambda p: [str(p[k]) for k in keys]))
    stays = F.filter("found", lambda x: x["kind"].isin(list(BASE)) | (odds(x, votes) > 0))
    return voted.select("doc_id", F.transform(stays, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans; see
    ``personal_spans``. ``spans`` lists kind:start:end of all spans, joined by
    commas; base_sha256 is the SHA-256 of that list of the base spans."""
    spans = personal_spans(docs.select(F.col("doc_id"), F.col("text")))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(list(BASE)))
    return spans.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by <KIND>. Rows are matched
    by doc_id; of rows that share one, each gets what is found in its own text."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    found = personal_spans(docs.select(F.struct("*").alias("doc_id"), F.col("text")))
    in_order = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"])))

    def replaced(text: Column, spans: Column) -> Column:
        zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def step(acc: Column, x: Column) -> Column:
            fresh = x["start"] >= acc["at"]
            kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
            return F.struct(F.when(fresh, kept).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

        return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    rows = found.select("doc_id.*", in_order.alias("__spans"))
    return rows.select(*columns, replaced(F.col("text"), F.col("__spans")).alias("text")).select(*[F.col(f"`{c}`") for c in docs.columns])
