"""Writers of manifests, events, statistics and messages."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from callwatch.runtime import ship_package


def write_manifest(df: DataFrame, path: str, format: str = "csv") -> None:
    """CSV with a header, arrays joined by |, or Parquet as it is."""
    if format == "parquet":
        df.write.parquet(path)
        return
    flat = [F.array_join(F.col(f"`{f.name}`"), "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*flat).write.csv(path, header=True, escape='"')


def write_events(df: DataFrame, path: str) -> None:
    """One JSON document for each event, in a folder for each channel."""
    df.write.mode("append").partitionBy("channel_id").json(path)


def write_events_batch(path: str):
    """A foreachBatch function that writes a batch's events to a folder named by
    the batch, so that a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(["event_id"]).write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write


def label_stats_json(stats: DataFrame) -> DataFrame:
    """(dimension, label, n) -> one JSON document: dimension -> label -> count."""
    inner = stats.groupBy("dimension").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("m"))
    return inner.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("dimension", "m")))).alias("json"))


def eval_summary(ranked: DataFrame, target: float = 0.8) -> DataFrame:
    """One JSON document: the target, the ranked models and the qualified ones."""
    row = F.struct("rank", "model", "items", "scored_items", "mean_cer", "mean_accuracy", "median_cer", "passing_share")
    return ranked.agg(F.to_json(F.struct(F.lit(target).alias("target_accuracy"), F.sort_array(F.collect_list(row)).alias("models"), F.sort_array(F.collect_list(F.when(F.col("mean_accuracy") >= target, row))).alias("qualified"))).alias("json"))


def selection_report(ranked: DataFrame, agreement: DataFrame) -> DataFrame:
    """One JSON document: ranked models and the agreement of two pipelines."""
    top = ranked.agg(F.sort_array(F.collect_list(F.struct("rank", "asr_model_name", "asr_provider", F.bround("score", 3).alias("score"), "samples", "language_guard_hits", "empty_text_hits", "short_text_hits"))).alias("top_asr_models"))
    one = agreement.select(F.struct("*").alias("pipeline_compare"))
    # one row each
    return top.join(F.broadcast(one)).select(F.to_json(F.struct("top_asr_models", "pipeline_compare")).alias("json"))


def write_selection(long: DataFrame, wide: DataFrame, path: str) -> None:
    write_manifest(long, f"{path}/asr_selection_long")
    write_manifest(wide, f"{path}/asr_selection_wide")


def message_rows(messages: DataFrame) -> DataFrame:
    """(channel_id, type, payload) as the key and value of a message queue."""
    return messages.select(F.col("channel_id").alias("key"), F.to_json(F.struct("type", "payload")).alias("value"))


def publish_messages(path: str):
    """A foreachBatch function that appends a batch's messages, keyed by channel,
    to a folder of their own; a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        message_rows(batch).write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write


@dataclass
class Staged(WriterCommitMessage):
    """The file that a task has written, or none for a task without rows."""

    file: str | None


class MessageWriter(DataSourceStreamWriter):
    """Two phases: tasks write files of their own to a staging folder that readers
    pass over, and the driver moves a batch's files together and renames their
    folder, so that a batch is visible whole or not at all."""

    def __init__(self, path: str):
        self.path = path

    def _place(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return store, root.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, root = self._place()
        folder = f"{root}/_staging"
        file, out = f"{folder}/{uuid.uuid4().hex}.json", None
        try:
            for row in iterator:
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(file)
                out.write((json.dumps(row.asDict(), ensure_ascii=False) + "\n").encode())
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(file)
            raise
        if out is None:
            return Staged(None)
        out.close()
        return Staged(file)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        store, root = self._place()
        files = [m.file for m in messages if m is not None and m.file]
        done = f"{root}/batch={batchId}"
        if store.get_file_info(done).type != fs.FileType.NotFound:
            # the batch was run again after it had been committed
            self._drop(store, files)
            return
        together = f"{root}/_staging/batch-{batchId}-{uuid.uuid4().hex}"
        store.create_dir(together, recursive=True)
        for i, file in enumerate(files):
            store.move(file, f"{together}/part-{i:05}.json")
        store.move(together, done)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        store, _ = self._place()
        self._drop(store, [m.file for m in messages if m is not None and m.file])

    @staticmethod
    def _drop(store: fs.FileSystem, files: list[str]) -> None:
        for file in files:
            if store.get_file_info(file).type == fs.FileType.File:
                store.delete_file(file)


class MessageFolder(DataSource):
    """Stream sink ``callwatch_messages``: rows as JSON lines in one folder for each
    micro-batch below ``path``, which driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "callwatch_messages"

    def streamWriter(self, schema: StructType, overwrite: bool) -> MessageWriter:
        return MessageWriter(self.options["path"])


def message_stream(messages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream of messages, keyed by channel, to the sink of
    ``MessageFolder``; ``start()`` begins it. ``read_messages`` reads what is
    committed."""
    spark = messages.sparkSession
    ship_package(spark)
    spark.dataSource.register(MessageFolder)
    return message_rows(messages).writeStream.format("callwatch_messages").option("path", path).option("checkpointLocation", checkpoint)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, batch) of the committed batches."""
    return spark.read.schema("key string, value string, batch long").json(path)
