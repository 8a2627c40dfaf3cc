"""Quality rules: how far a document's histograms lie from its language's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwatch.llm.words import SPACE, let, word_array
from callwatch.runtime import written

# Very common words of the languages for which there are references.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "with", "as", "be", "this", "by", "at", "are", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "au", "sur", "pas"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
# Character classes; what is in none of them is the last class.
CHARACTER_CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": r"\s", "stop": r".,;:?'\"", "mark": r"#*$%&|<>", "bang": r"!"}

MIN_WORDS = 10
#: Below these lengths a histogram says too little to judge by.
MIN_CHARACTERS = 60
MIN_HISTOGRAM_WORDS = 60
#: Largest Jensen-Shannon distances (base 2, hence from 0 to 1) that are kept.
MAX_CHARACTER_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.42


def repeated_words(words: Column, k: int = 5) -> Column:
    """Words that lie in a k-word window found twice or more in the text.

    Windows are hashed and, where not all differ, sorted together with their
    positions: those next to an equal one are repeated. Each then covers k
    words, less what the next one covers too.
    """

    def covered(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(k)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(k), lambda s, g: s + g))

    def repeats(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: let(_beside_equal(p), lambda at: covered(at)))

    def _beside_equal(p: Column) -> Column:
        n = F.size(p)
        marked = F.transform(p, lambda x, i: F.when((i > 0) & (F.get(p, i - 1)["h"] == x["h"]) | (i < n - 1) & (F.get(p, i + 1)["h"] == x["h"]), x["i"]))
        return F.sort_array(F.array_compact(marked))

    def windows(hashed: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashed) - k)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(k)]))

    def of(hashed: Column) -> Column:
        found = let(windows(hashed), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(repeats(w)))
        return F.when(F.size(hashed) <= k, F.lit(0)).otherwise(found)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _vocabulary(common: dict[str, list[str]]) -> list[str]:
    return sorted({w for words in common.values() for w in words})


def _word_counts(words: Column, vocabulary: list[str]) -> Column:
    """Counts of the vocabulary's words, and last of all others."""
    found = F.filter(words, lambda w: w.isin(vocabulary))

    def counted(x: Column) -> Column:
        each = [F.size(x) - F.size(F.array_remove(x, w)) for w in vocabulary]
        return F.array(*each, F.size(words) - F.size(x))

    return let(found, counted)


def _character_counts(text: Column) -> Column:
    """Counts of characters by class, and last of all others. Each class is
    taken out of what the classes before it have left."""

    def step(rest: Column, classes: list[str], counts: list[Column]) -> Column:
        if not classes:
            return F.array(*counts, F.length(rest))
        return let(F.regexp_replace(rest, f"[{classes[0]}]+", ""), lambda left: step(left, classes[1:], [*counts, F.length(rest) - F.length(left)]))

    return step(text, list(CHARACTER_CLASSES.values()), [])


def statistics(docs: DataFrame, common: dict[str, list[str]], own: Column | None = None) -> DataFrame:
    """(own, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    characters, commons) for every document; ``own`` is its id, or a given
    column under that name."""
    vocabulary = _vocabulary(common)
    base = docs.select((F.col("doc_id") if own is None else own).alias("own"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def of(words: Column) -> Column:
        lower = F.transform(words, lambda w: F.lower(w))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
            _word_counts(lower, vocabulary).alias("commons"),
        )

    facts = base.select(
        "own",
        "lang",
        let(word_array(F.col("text")), of).alias("w"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"),
        _character_counts(F.col("text")).alias("characters"),
    )
    return facts.select("own", "lang", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "characters", "w.commons")


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of equal length."""

    def half(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, v: s + v)
    return let(total, lambda n: F.transform(counts, lambda v: v / F.greatest(n, F.lit(1))))


def references(facts: DataFrame, languages: list[str]) -> DataFrame:
    """(ref_lang, ref_characters, ref_commons): summed histograms of all documents
    of a language; one row for each of ``languages`` at most."""

    def summed(name: str) -> list[Column]:
        n = len(CHARACTER_CLASSES) + 1 if name == "characters" else len(_vocabulary({x: COMMON_WORDS.get(x, []) for x in languages})) + 1
        return [F.sum(F.get(name, F.lit(i))).alias(f"{name}{i}") for i in range(n)]

    characters, commons = summed("characters"), summed("commons")
    sums = facts.filter(F.col("lang").isin(languages) & ~F.col("base_failed")).groupBy("lang").agg(*characters, *commons)
    return sums.select(
        F.col("lang").alias("ref_lang"),
        shares(F.array(*[f"characters{i}" for i in range(len(characters))])).alias("ref_characters"),
        shares(F.array(*[f"commons{i}" for i in range(len(commons))])).alias("ref_commons"),
    )


def verdicts(docs: DataFrame, own: Column | None = None, max_character_distance: float = MAX_CHARACTER_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """``statistics`` with base_failed, character_distance, word_distance and kept."""
    languages = sorted(COMMON_WORDS)
    facts = statistics(docs, COMMON_WORDS, own).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    facts = written(facts)
    # at most one row for each of the languages named above
    joined = facts.join(F.broadcast(references(facts, languages)), F.col("lang") == F.col("ref_lang"), "left")
    known = F.col("ref_lang").isNotNull()
    by_character = F.when(known & (F.aggregate("characters", F.lit(0), lambda s, v: s + v) >= MIN_CHARACTERS), divergence(shares(F.col("characters")), F.col("ref_characters")))
    by_word = F.when(known & (F.col("n_words") >= MIN_HISTOGRAM_WORDS), divergence(shares(F.col("commons")), F.col("ref_commons")))
    far = (F.coalesce(F.col("character_distance"), F.lit(0.0)) > max_character_distance) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > max_word_distance)
    measured = joined.withColumn("character_distance", by_character).withColumn("word_distance", by_word)
    return measured.withColumn("kept", ~F.col("base_failed") & ~far)


def judge(docs: DataFrame, **options) -> DataFrame:
    """A verdict on each document.

    Histograms of character classes and of common words are compared with those
    of all documents of the same language that pass the base rules. A document
    is rejected when the Jensen-Shannon distance of either exceeds its limit,
    given enough characters or words to judge by, or when the base rules fail:
    under ten words, or over a fifth of the words in five-word windows that are
    found twice or more.

    A null or empty text has no words and is rejected. A language without a
    reference, null too, is judged by the base rules alone; distances are null
    there and below the minimum lengths. Rows that repeat, or lack an id, are
    judged each for itself. An empty input gives an empty result.
    """
    found = verdicts(docs, **options)
    return found.select(F.col("own").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "character_distance", "word_distance")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with all their columns. Each row is
    judged for itself, whatever its id: rows are written with their statistics
    and filtered there, neither joined by id nor shuffled."""
    return verdicts(docs, F.struct("*"), **options).filter("kept").select("own.*")
