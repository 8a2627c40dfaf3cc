"""Token ids as Parquet files with list columns."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callwatch.llm.tokenizing import AT_ONCE, encoder
from callwatch.llm.words import pieces
from callwatch.runtime import map_arrow, shared_dir, written

END = 0
ROW_GROUP_BYTES = 32 * 2**20
PAGE_BYTES = 256 * 2**10
SCHEMA = "doc_id long, part int, offset long, n_tokens long, tokens array<int>"


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, AT_ONCE):
            ids, counts = encoder(path).encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end).view(np.int32)
            starts = np.concatenate([[0], np.cumsum(counts + 1)])
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            columns = [batch.column("doc_id"), pa.array(np.full(len(batch), part, np.int32)), pa.array(offset + starts[:-1]), pa.array(counts + 1), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "offset", "n_tokens", "tokens"])
            offset += int(starts[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Encodes the texts and writes them to ``path`` in ascending doc_id order:
    the files' order by ``part``, and in a file that of its rows.

    A row holds doc_id, the part, the number of ids before it in its part,
    n_tokens and the list of ids, ``end`` last. ``encoding`` is 'dictionary' or
    'delta' (differences, packed). Row groups and pages have the given sizes, and
    the files have page indexes, so that readers of some documents or of the
    narrow columns skip the rest.

    A null or empty text has the end id alone. Rows without a doc_id come first.
    Rows that share one stand together, in the order of their texts. An empty
    input gives files without rows. Other columns are left out.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = plain.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    encoded = map_arrow(ordered.select("doc_id", F.col("text").cast("binary").alias("text")), _encoded(tokenizer, end), SCHEMA)
    out = encoded.write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    out = out.option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2")
    out.parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files' rows, those of doc_ids from ``first`` to ``last`` if given; the
    bounds reach the scan, which skips row groups and pages outside them."""
    found = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        found = found.filter(F.col("doc_id") >= first)
    if last is not None:
        found = found.filter(F.col("doc_id") <= last)
    return found


def part_starts(tokens: DataFrame) -> DataFrame:
    """(part, base): the ids in all parts before. One row for each file."""
    sizes = tokens.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("__ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(F.col("part").alias("__part"), F.coalesce(F.sum("__ids").over(before), F.lit(0)).alias("base"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        bounds = lists.offsets.to_numpy()
        ids = lists.values.to_numpy().astype("<u4")
        crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)), np.int64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("offset"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc)], ["doc_id", "part", "offset", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row of token files: the
    ids of all documents before it, its own number of ids, and the CRC-32 of
    these as little-endian unsigned 32-bit integers."""
    facts = written(map_arrow(tokens.select("doc_id", "part", "offset", "tokens"), _checked, "doc_id long, part int, offset long, n_tokens long, ids_crc32 long"))
    bases = written(part_starts(tokens.select("part", "offset", "n_tokens")))
    joined = facts.join(bases, F.col("part") == F.col("__part"))
    return joined.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """``digests`` of files that are written to the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, **options)
    return digests(read_tokens(spark, path))
