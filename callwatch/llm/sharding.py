"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callwatch.runtime import fresh

SHARDS = 32
SLOTS = 4099


def _number(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot.

    A shard prefers the slots offset, offset + skip, offset + 2 skip ... modulo
    the table size; as that is prime, the sequence visits every slot. In turn,
    each shard claims the first slot of its sequence that is still free, until
    none is. Shards hence own equal numbers of slots, to within one, and a
    shard that leaves moves few slots of the others.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and at least one is needed")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime of at least the number of shards")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        s = turn % len(shards)
        while owner[at[s]] >= 0:
            at[s] = (at[s] + skip[s]) % slots
        owner[at[s]] = s
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 32 bits of its MD5, modulo the table size."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(slots)


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    owner = lookup_table(shards, slots)
    schema = T.StructType([T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.createDataFrame(list(enumerate(owner)), schema)


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with columns ``slot`` (long) and ``shard`` (int).

    The table has ``slots`` rows whatever the data, so it is broadcast; the
    documents are neither shuffled nor sorted. Equal keys share a shard; a null
    key counts as the empty string. Columns of ``docs`` that bear the new names
    are replaced. An empty input gives an empty result.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    plain = docs.drop("slot", "shard") if {"slot", "shard"} & set(docs.columns) - {key} else docs
    table = table_frame(docs.sparkSession, names, slots)
    slot, table_slot, shard = fresh(plain, "slot"), fresh(plain, "table_slot"), fresh(plain, "shard")
    own = plain.withColumn(slot, slot_of(F.coalesce(F.col(key).cast("string"), F.lit("")), slots))
    placed = own.join(F.broadcast(table.toDF(table_slot, shard)), F.col(slot) == F.col(table_slot))
    return placed.select(*[F.col(f"`{c}`") for c in plain.columns if c not in ("slot", "shard")], F.col(slot).alias("slot"), F.col(shard).alias("shard"))


def write_shards(docs: DataFrame, path: str, parts_per_shard: int = 1, **options) -> None:
    """Writes ``docs`` as one folder per shard. Rows go to ``parts_per_shard``
    tasks for each shard, so that a shard needs not fit one task."""
    placed = assign_shards(docs, **options)
    n = placed.select("shard").distinct().count()
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(parts_per_shard))
    placed.repartition(max(1, n * parts_per_shard), F.col("shard"), part).write.partitionBy("shard").parquet(path)
