"""Reading tables and cutting lineage; shared by every subpackage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that
    tasks can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        here = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='callwatch-')}/{here.name}", "zip", here.parent, here.name)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the tasks."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that streaming processors with maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark from whatever store ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves, but only in local
    mode, in which driver and executors are one process; a cluster without the
    setting is an error, since no other folder is known to be shared.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="callwatch-"))
    return context.getCheckpointDir()


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with so many underscores that ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def in_tasks(df: DataFrame, rows: int, per_task: int = 500_000) -> DataFrame:
    """``df`` in no more tasks than about ``rows`` rows need; a table too large
    for that keeps its partitions."""
    return df.coalesce(rows // per_task + 1)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` over all cores, for work that costs far more than
    its bytes suggest; adaptive execution doesn't merge these tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def clear_written(spark: SparkSession) -> bool:
    """Removes the tables that this application has written to the shared folder;
    whether there were any. For use once results are stored: data frames that
    come from those tables can't be computed afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, group: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and read
    again from there if an executor is lost. ``clear_written`` removes it. Spark
    reads 4,096 rows at once, but none of two row groups; where rows are wide, as
    long vectors are, ``group`` sets the bytes of a group, which has 100 rows at
    least, and so bounds a reader."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", group) if group else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unwritten(df: DataFrame) -> bool:
    """Removes the one table that ``written`` has given as ``df``, once all that
    comes from it is written in turn; whether it was there."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(df.inputFiles()[0])).getParent()
    if path.getParent().toUri().getPath() != spark._jvm.org.apache.hadoop.fs.Path(_tables(spark)).toUri().getPath():
        raise ValueError(f"{path} is not a written table")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Ids that a join may broadcast: some tens of MB in an executor.
MOST_BROADCAST = 1_000_000


def restricted(df: DataFrame, column: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``ids`` (one column of longs),
    or with 'left_anti' the others; null counts as a value. The ids are broadcast if they are few enough, so that
    wide rows stay where they are, and else both sides are shuffled."""
    name = fresh(df, "wanted")
    wanted = written(ids.toDF(name).distinct())
    few = wanted.count() <= MOST_BROADCAST  # longs, so their bytes are bounded too
    return df.join(F.broadcast(wanted) if few else wanted, F.col(column).eqNullSafe(F.col(name)), how)


def spread_join(left: DataFrame, right: DataFrame, on: dict[str, str], counts: DataFrame, by: list[str], most: int, bound: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key, by columns
    of the two; right's keys are dropped. Keys that many rows of ``left`` have,
    as ``counts`` (left's key columns, n) tells, are dealt over several tasks by a
    hash of the columns ``by``, and right's row is repeated for each of them:
    once for every ``most`` rows. At most ``MOST_BROADCAST`` keys are dealt so.
    Where the caller knows a ``bound`` of left's rows, they are not summed, and a
    bound of ``most`` or less means that no key can have more."""
    if bound is not None and bound <= most:
        plain = right.withColumnsRenamed({c: f"__{i}_key" for i, c in enumerate(on.values())})
        return left.join(plain, [F.col(c) == F.col(f"__{i}_key") for i, c in enumerate(on)]).drop(*[f"__{i}_key" for i in range(len(on))])
    total = bound if bound is not None else counts.agg(F.sum("n")).first()[0] or 0
    bar = max(most, total // MOST_BROADCAST + 1)
    names = {c: f"__hot_{i}" for i, c in enumerate(on)}
    hot = counts.filter(F.col("n") > bar).select(*[F.col(c).alias(n) for c, n in names.items()], F.ceil(F.col("n") / bar).cast("int").alias("__parts"))

    def dealt(df: DataFrame, columns: dict[str, str], salt) -> DataFrame:
        same = [F.col(c) == F.col(names[k]) for k, c in columns.items()]
        return df.join(F.broadcast(hot), same, "left").withColumn("__salt", salt(F.coalesce("__parts", F.lit(1)))).drop("__parts", *names.values())

    a = dealt(left, {c: c for c in on}, lambda n: F.pmod(F.xxhash64(*by), n))
    b = dealt(right, on, lambda n: F.explode(F.sequence(F.lit(0), n - 1))).withColumnsRenamed({c: f"__{i}_key" for i, c in enumerate(on.values())}).withColumnRenamed("__salt", "__other_salt")
    same = [F.col(c) == F.col(f"__{i}_key") for i, c in enumerate(on)] + [F.col("__salt") == F.col("__other_salt")]
    return a.join(b, same).drop("__salt", "__other_salt", *[f"__{i}_key" for i in range(len(on))])


def numbered(df: DataFrame, order: list[str], name: str, within: str | None = None) -> DataFrame:
    """``df`` with a column that numbers its rows from 1 by ``order``, or those of
    each value of ``within``. Rows are ranged over partitions and numbered in
    each, after the counts of those before; only a row for each partition and
    value meets in a task, so neither one value nor the whole is sorted in one."""
    value = F.col(within) if within else F.lit(0)
    placed = written(df.withColumn("__within", value).repartitionByRange("__within", *order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy(F.col("__within").alias("__w"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__w").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__w", "__p", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part", "__within").orderBy(*order))
    same = (F.col("__part") == F.col("__p")) & F.col("__within").eqNullSafe(F.col("__w"))
    return placed.withColumn("__rank", rank).join(before, same).withColumn(name, F.col("__before") + F.col("__rank")).drop("__part", "__rank", "__p", "__before", "__within", "__w")
