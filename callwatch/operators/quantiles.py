"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callwatch.runtime import written


def exact_quantile(rows: DataFrame, group: str, value: str, share: float, name: str) -> DataFrame:
    """(group, name): the quantile of each group's values that are not null, with
    linear interpolation between the two ranks that it lies between.

    Values are counted first. Distinct ones are ranged over partitions by group
    and value; with the counts of the partitions before, each partition knows
    its ranks, so no group is held as a map or sorted in one task.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("__g"), F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    placed = written(counts.repartitionByRange("__g", "__v").withColumn("__part", F.spark_partition_id()))
    parts = placed.groupBy(F.col("__g").alias("__h"), F.col("__part").alias("__p")).agg(F.sum("__n").alias("__k"))
    whole = Window.partitionBy("__h")
    earlier = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("__h", "__p", F.coalesce(F.sum("__k").over(earlier), F.lit(0)).alias("__before"), F.sum("__k").over(whole).alias("__total"))
    here = F.sum("__n").over(Window.partitionBy("__part", "__g").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = placed.withColumn("__here", here).join(before, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__part") == F.col("__p")))
    upto, at = F.col("__before") + F.col("__here"), (F.col("__total") - 1) * F.lit(float(share))
    low, high = (F.min(F.when(upto > edge(at), F.col("__v"))) for edge in (F.floor, F.ceil))
    ends = known.groupBy("__g").agg(low.alias("__low"), high.alias("__high"), F.max("__total").alias("__total"))
    between = (F.ceil(at) - at) * F.col("__low") + (at - F.floor(at)) * F.col("__high")
    return ends.select(F.col("__g").alias(group), F.when(F.floor(at) == F.ceil(at), F.col("__low").cast("double")).otherwise(between).alias(name))
