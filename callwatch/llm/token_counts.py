"""Exact histograms of encoded lengths and what they say of context limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callwatch.llm.tokenizing import AT_ONCE, encoder
from callwatch.llm.words import pieces
from callwatch.runtime import map_arrow, written

#: Lengths are summed in groups of this many first.
GROUP = 1024


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, AT_ONCE):
            lengths = encoder(path).lengths(batch.column("text"))
            values, counts = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], ["length", "n_docs"])

    return run


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(length, n_docs): how many documents encode to each number of ids. Tasks
    count what they encode, so that only counts are shuffled."""
    plain = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counts = map_arrow(plain, _lengths(tokenizer), "length long, n_docs long")
    return counts.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """One row for each length L that occurs: n_docs of that length, docs_at_least
    and tokens_at_least over documents of L ids or more, truncated_total (all ids
    once documents are cut at L), dropped_total (all ids of documents of at most
    L) and quantile (the share of documents of at most L).

    These are suffix sums of the histogram. Between two lengths that occur,
    truncated totals are linear, so the rows answer every limit; see
    ``truncated_total``. Lengths are summed in groups first, and rows only within
    their group.
    """
    rows = written(histogram.withColumn("__group", F.floor(F.col("length") / GROUP)))
    groups = rows.groupBy("__group").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"))
    above = Window.orderBy(F.desc("__group")).rowsBetween(Window.unboundedPreceding, -1)
    later = groups.select(F.col("__group").alias("__g"), F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("__docs"), F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("__tokens"))
    totals = rows.agg(F.sum("n_docs").alias("__all_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("__all_tokens"))
    within = Window.partitionBy("__group").orderBy(F.desc("length"))
    # one row of totals
    joined = rows.join(later, F.col("__group") == F.col("__g")).join(F.broadcast(totals))
    summed = joined.withColumn("docs_at_least", F.sum("n_docs").over(within) + F.col("__docs")).withColumn("tokens_at_least", F.sum(F.col("n_docs") * F.col("length")).over(within) + F.col("__tokens"))
    at_most = F.col("__all_docs") - F.col("docs_at_least") + F.col("n_docs")
    below = F.col("__all_tokens") - F.col("tokens_at_least")
    return summed.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (below + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        (below + F.col("length") * F.col("n_docs")).alias("dropped_total"),
        (at_most / F.col("__all_docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``context_totals`` of the documents' lengths under a tokenizer file.

    A null or empty text has length 0. Each row of ``docs`` counts, repeated
    ones too; only column ``text`` is read. An empty input gives no rows.
    """
    return context_totals(length_histogram(docs, tokenizer))


def truncated_total(totals: DataFrame, limit: int) -> DataFrame:
    """One row, ``total``: all ids once documents are cut at ``limit``."""
    row = totals.agg(F.min_by("tokens_at_least", "length").alias("all"), F.min(F.when(F.col("length") >= limit, F.struct("length", "docs_at_least", "tokens_at_least"))).alias("next"))
    cut = F.col("all") - F.col("next.tokens_at_least") + limit * F.col("next.docs_at_least")
    return row.select(F.coalesce(cut, F.col("all"), F.lit(0)).alias("total"))
