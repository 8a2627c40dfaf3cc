"""Tests of what round 3's findings named."""

import random

import duckdb
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from callwatch.functions import text as T
from callwatch.functions.distance import levenshtein
from callwatch.llm import substring_dedup
from callwatch.operators import learning
from callwatch.plans import queries_calls, queries_models


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"create view {name} as select * from read_parquet('{path}')")
    return con.sql(sql).fetchall()


def test_places_of_ngrams_are_those_of_hashing(spark, monkeypatch):
    from callwatch.functions import grams

    texts = ["", "a", "🚢é\nxAéÉß", None, "Mayday，本船东方18机舱起火 " * 9, "x\x00ý𝒳z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = rows.withColumn("g", learning.char_ngrams(F.lower(F.coalesce("t", F.lit("")))))
    for terms in (1 << 20, 1000):
        want = {r.i: r.c for r in HashingTF(inputCol="g", outputCol="c", numFeatures=terms).transform(plain).collect()}
        assert {r.i: r.counts for r in learning.gram_counts(rows, "t", terms).collect()} == want
    whole = grams.gram_places(texts[4].encode(), 1000)
    monkeypatch.setattr(grams, "PIECE", 7)
    assert [x.tolist() for x in grams.gram_places(texts[4].encode(), 1000)] == [x.tolist() for x in whole]


def test_classifier_iterates_over_places_that_vary(spark):
    """Each iteration sums a number for each feature and sends the plan before
    it with its tasks, so both are small."""
    rows = spark.createDataFrame([(f"fire {i % 7}" if i % 3 else f"tide {i % 5}", "high" if i % 3 else "normal") for i in range(60)], "text string, label string")
    model = learning.train_risk_classifier(rows, "text", "label", terms=1 << 16)
    assert model.stages[-1].numFeatures < 100
    assert all(r.label == r.predicted for r in learning.classify(model, rows, "text").collect())
    # no n-gram in two texts, so none weighs anything
    apart = spark.createDataFrame([("a", "high"), ("b", "normal"), ("c", "normal")], "text string, label string")
    assert learning.classify(learning.train_risk_classifier(apart, "text", "label", terms=1 << 10), apart, "text").count() == 3


def test_agreement_queue_is_in_the_order_of_what_it_shows(spark, tmp_path):
    """Means that are equal when rounded, but not before, are ordered by id."""
    texts = duckdb.sql("select conv_id, turn, text from '/root/testdata/sf0.1/conversations.parquet' where (conv_id, turn) in ((541, 0), (690, 3))").fetchall()
    rows = [(c + 1000 * k, t, text) for k in range(2) for c, t, text in texts]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = sql_rows(queries_models.ORACLES["agreement_queue"], conversations=f"{tmp_path}/conversations.parquet/*.parquet")
    got = [tuple(r) for r in queries_models.QUERIES["agreement_queue"](spark, str(tmp_path)).collect()]
    assert len({r[1] for r in want}) == 1 and got == want


def test_messages_of_calls_at_one_time_are_numbered_as_in_sql(spark, tmp_path):
    """Copies of the events under other ids: a user's calls then share their times."""
    path = f"{tmp_path}/events.parquet"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("event_id", F.explode(F.array(*[F.col("event_id") + 100_003 * k for k in range(3)]))).write.parquet(path)
    want = sql_rows(queries_calls.ORACLES["ordered_messages"], events=f"{path}/*.parquet")
    got = [tuple(r) for r in queries_calls.QUERIES["ordered_messages"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_distances_are_those_of_spark(spark):
    rng = random.Random(2)
    texts = ["", "a", "本船东方18机舱起火", "🚢é\nx"] + ["".join(rng.choice("ab" if k % 2 else "abc𝒳é，") for _ in range(rng.randrange(90))) for k in range(60)]
    changed = [t.replace(rng.choice("abc"), rng.choice(["", "x", "ba"])) for t in texts]
    rows = [*zip(texts, changed, strict=True), *zip(texts, reversed(texts), strict=True), (None, "ab"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(T.edit_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))).alias("want")).collect()
    assert [r.d for r in got] == [r.want for r in got] and len(got) == len(rows)
    rates = spark.createDataFrame([("", ""), ("", "x"), (None, None), ("abcd", ""), ("abcd", "abxd"), ("ab", "xyzxyz")], "a string, b string")
    told = rates.select(T.cer(F.col("a"), F.col("b")).alias("c"), T.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [tuple(r) for r in told] == [(0.0, 1.0), (1.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.25, 0.75), (3.0, 0.0)]


def test_distances_take_no_table_of_pairs_of_characters():
    """A step for each of 12,000 characters, not for each of their pairs."""
    import time

    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh") for _ in range(12_000))
    assert levenshtein(a, a.replace("ab", "")) == 12_000 - len(a.replace("ab", ""))
    began = time.process_time()
    assert 0 < levenshtein(a, a.replace("a", "o")) <= a.count("a")
    assert time.process_time() - began < 3


def test_texts_of_repeats_are_shuffled_packed(spark):
    words = [f"word{i}" for i in range(400)]
    first, second = " ".join(words[:300]), " ".join([*words[350:], *words[100:200]])
    df = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    repeats = substring_dedup.Repeats(df)
    held = [r.text for r in repeats.texts.collect()]
    assert sorted(substring_dedup.unpacked(bytes(t)).decode() for t in held) == sorted([first, second])
    assert sum(map(len, held)) < 0.6 * len(first + second)
    assert {r.doc_id: r.n_removed for r in repeats.digests().collect()} == {1: 100, 2: 100}
    assert substring_dedup.unpacked(substring_dedup.packed(b"")) == b""
