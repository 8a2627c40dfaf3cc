"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwatch.runtime import in_tasks, spread_join, written


#: Arcs of a vertex that one task takes; a hub's are dealt over several.
HUB = 100_000


def _star(arcs: DataFrame, rows: int) -> DataFrame:
    """(u, v) -> (u, v, m) with m the least of u and its neighbours."""
    least = arcs.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__m"), F.count("*").alias("__n"))
    met = spread_join(arcs, least.select("__u", "__m"), {"u": "__u"}, least.select(F.col("__u").alias("u"), F.col("__n").alias("n")), ["v"], HUB, rows)
    return in_tasks(met.select("u", "v", F.least("u", "__m").alias("m")), rows)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of ids -> (id, component) for each id that an edge names,
    where component is the smallest id reachable.

    A large star hangs each vertex's greater neighbours below its least
    neighbour, a small star its lesser ones; the edges are the components'
    stars once neither changes them, after a number of rounds that grows with
    the logarithm of the size. Each round is a written table; only its row count
    and a checksum reach the driver. Loops and repeated edges are allowed; rows
    with a null end are ignored. No edges give no rows.
    """
    plain = edges.filter("a <> b")
    now = written(plain.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rows, seen = now.count(), None
    while rows:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        starred = _star(written(in_tasks(large.distinct(), rows)), rows)
        small = starred.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
        now = written(in_tasks(small.distinct(), rows))
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == seen:
            break
        rows, seen = row[0], (row[0], row[1])
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
