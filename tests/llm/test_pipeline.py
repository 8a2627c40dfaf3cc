"""Each stage of the pipeline against brute force on its own input."""

import collections

import corpus_pipeline
import pytest

from callwatch.llm import quality_rules

from .conftest import WORD, clashing
from .test_operators import brute_components, brute_leaks, expected_targets, frame, near_corpus

SF = "/root/testdata/sf0.001"


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "mixing", "sharding"]


def test_dedup_keeps_one_of_each_group(spark):
    docs = near_corpus(1, 15)
    kept = corpus_pipeline.dedup(spark, clashing(frame(spark, docs)), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _, _, one in brute_components(docs, 5) if one]


def test_stages_on_the_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.quality(spark, docs, SF).cache()
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_rules.judge(docs).filter("kept").collect()}
    one = corpus_pipeline.dedup(spark, good, SF).cache()
    assert one.columns == columns
    expected = brute_components([(r.doc_id, r.text) for r in good.collect()], 5)
    assert sorted(r.doc_id for r in one.collect()) == [d for d, _, _, k in expected if k]
    clean = corpus_pipeline.decontaminate(spark, one, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in one.collect()], items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaks
    mixed = corpus_pipeline.mix(spark, clean, SF).cache()
    assert mixed.columns == columns
    sizes, taken = collections.Counter(), collections.Counter()
    for r in clean.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text))
    longest = max(len(WORD.findall(r.text)) for r in clean.collect())
    for s, target in expected_targets(sizes).items():
        assert abs(taken[s] - target) <= longest
    sharded = corpus_pipeline.shard(spark, mixed, SF)
    assert sharded.count() == mixed.count()
    assert sharded.filter("shard is null").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, stage, awkward, nothing):
    assert stage(spark, nothing, SF).count() == 0
    stage(spark, clashing(awkward), SF).collect()
