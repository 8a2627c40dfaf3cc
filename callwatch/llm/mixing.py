"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwatch.llm.words import word_count
from callwatch.runtime import MOST_BROADCAST, written
from callwatch.sources.readers import ordinals

PATTERN = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2.0


def letter_share(text: Column) -> Column:
    """A quality weight in [0.05, 1]: the share of a text's characters that
    are letters or white space."""
    plain = F.coalesce(text, F.lit(""))
    odd = F.length(F.regexp_replace(plain, r"[\p{L}\s]+", ""))
    return F.greatest(F.lit(0.05), 1 - odd / F.greatest(F.length(plain), F.lit(1)))


def source_targets(sizes: DataFrame, budget: float = BUDGET, most: float = MOST, pattern: tuple[float, ...] = PATTERN) -> DataFrame:
    """(source, source_size) -> with ``target``.

    Sources in code-point order, null last, have the weights of ``pattern``,
    repeated. They share ``budget`` times all sizes by weight. A target stops at
    ``most`` times its source's size; the excess is shared out again by weight
    among the others, until no target is above. The table has one row for each
    source; each pass caps at least one more source and reads back one row.
    Sources are ranked over ranges, so they may be many.
    """
    order = F.struct(F.col("source").isNull().alias("last"), F.encode("source", "UTF-8").alias("name"))
    weights = F.array(*[F.lit(float(w)) for w in pattern])
    ranked = ordinals(sizes.select("source", "source_size", order.alias("place")), "place", "rank")
    weight = F.element_at(weights, ((F.col("rank") - 1) % len(pattern) + 1).cast("int"))
    state = written(ranked.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("room")))
    total = state.agg(F.sum("source_size")).first()[0] or 0
    left, level = budget * total, 0.0
    capped = None
    while True:
        # level: words for each unit of weight; those whose room is below it are capped
        open_ = F.col("room") > level * F.col("weight")
        row = state.agg(F.sum(F.when(open_, F.col("weight"))), F.sum(F.when(~open_, F.col("room"))), F.count(F.when(~open_, 1))).first()
        weight, full, n = row[0] or 0.0, row[1] or 0.0, row[2]
        if not weight or n == capped:
            break
        capped, level = n, (left - full) / weight
    target = F.least(F.col("room"), F.lit(level) * F.col("weight")) if weight else F.col("room")
    return state.select("source", "source_size", target.alias("target"))


def sample_keys(docs: DataFrame, *keep: Column, id_column: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, seed: int = 1) -> DataFrame:
    """(source, size, key) and the columns to ``keep`` for each row: an
    exponential variate divided by the document's weight. It depends on the id,
    the text and the seed alone, so reruns agree, and rows that share an id, or
    have none, differ by their texts."""
    unit = (F.pmod(F.xxhash64(F.col(id_column), F.col(text), F.lit(seed)), F.lit(2**52)) + 1) / F.lit(float(2**52 + 1))
    quality = weight if weight is not None else letter_share(F.col(text))
    return docs.select(*keep, F.col(source).alias("source"), word_count(F.col(text)).alias("size"), (-F.log(unit) / quality).alias("key"))


def _bucket() -> Column:
    """The bucket of a key: as many for a source as the root of its rows."""
    n = F.ceil(F.sqrt(F.col("__rows")))
    return F.least(n - 1, F.floor((1 - F.exp(-F.col("key") / F.col("__mean"))) * n)).cast("long")


def _planned(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """``keyed`` with its source's plan; one row for each source is broadcast as
    long as they are few enough."""
    few = plan.count() <= MOST_BROADCAST
    own = plan.withColumnRenamed("source", "__source")
    return keyed.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def sampling_plan(keyed: DataFrame, budget: float = BUDGET, most: float = MOST, pattern: tuple[float, ...] = PATTERN) -> DataFrame:
    """What each source takes: source, source_size, target, whole epochs, and the
    bucket and key up to which documents are taken once more.

    A target of several times the source's size takes that many whole epochs;
    what then remains goes to the documents with the smallest keys, of which the
    last is taken if most of it fits. Sorting never gathers a source: bucket
    totals are summed first, and only the keys of the bucket in which the budget
    ends are put in order. Rows of equal keys repeat each other; of those at
    which the budget ends, so many are taken as fit (``__tie`` and ``__need``).
    """
    sources = written(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows"), F.avg("key").alias("__mean")))
    targets = source_targets(sources.select("source", "source_size"), budget, most, pattern)
    plan = targets.join(sources.drop("source_size").withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    plan = plan.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0))
    plan = written(plan.withColumn("__rest", F.greatest(F.lit(0.0), F.col("target") - F.col("__epochs") * F.col("source_size"))))

    open_ = _planned(keyed, plan.filter("__rest > 0")).withColumn("__bucket", _bucket())
    totals = open_.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"), F.first("__rest").alias("__budget"))
    upto = F.sum("__sum").over(Window.partitionBy("source").orderBy("__bucket"))
    edges = totals.select("source", "__bucket", (upto - F.col("__sum")).alias("__before"), upto.alias("__upto"), "__budget")
    edge = written(edges.filter("__before < __budget and __budget <= __upto").select("source", F.col("__bucket").alias("__edge"), "__before"))

    inside = _planned(open_, edge).filter("__bucket = __edge").groupBy("source", "key").agg(F.sum("size").alias("size"), F.max("size").alias("__one"), F.count("*").alias("__n"), F.first("__before").alias("__before"), F.first("__rest").alias("__rest"))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    room = F.col("__rest") - F.col("__before") - (run - F.col("size"))
    fits = F.when(F.col("__one") == 0, F.when(room >= 0, F.col("__n")).otherwise(F.lit(0))).otherwise(F.greatest(F.lit(0), F.least(F.col("__n"), F.floor(room / F.col("__one") + 0.5))))
    some = inside.withColumn("__fits", fits.cast("long")).filter("__fits > 0")
    part = F.col("__fits") < F.col("__n")
    last = some.groupBy(F.col("source").alias("__s")).agg(F.max(F.when(~part, F.col("key"))).alias("__last"), F.max(F.when(part, F.col("key"))).alias("__tie"), F.max(F.when(part, F.col("__fits"))).alias("__need"))
    ends = edge.select(F.col("source").alias("__e"), "__edge").join(last, F.col("__e").eqNullSafe(F.col("__s")), "left").drop("__s")
    return written(plan.join(ends, F.col("source").eqNullSafe(F.col("__e")), "left").drop("__e"))


def _tied() -> Column:
    return F.coalesce(F.col("key") == F.col("__tie"), F.lit(False))


def _with_ranks(planned: DataFrame, plan: DataFrame) -> DataFrame:
    """``planned`` (with ``__row``, ids whose upper bits are a partition) with the
    number of each row among those at which its source's budget ends, null for
    all others. They are counted by partition first, so that many equal rows are
    numbered in many tasks."""
    none = F.lit(None).cast("long").alias("__rank")
    if plan.filter("__tie is not null").isEmpty():
        return planned.select("*", none)
    at = F.shiftright("__row", 33)
    tied = planned.filter(_tied()).withColumn("__part", at)
    counts = tied.groupBy(F.col("source").alias("__s"), F.col("__part").alias("__p")).agg(F.count("*").alias("__k"))
    earlier = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__s", "__p", F.coalesce(F.sum("__k").over(earlier), F.lit(0)).alias("__earlier"))
    own = F.row_number().over(Window.partitionBy("source", "__part").orderBy("__row"))
    ranked = tied.withColumn("__own", own).join(before, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p")))
    return planned.filter(~_tied()).select("*", none).unionByName(ranked.select(*planned.columns, (F.col("__earlier") + F.col("__own")).alias("__rank")))


def _copies() -> Column:
    """How often a row is taken, from its key and its source's plan."""
    more = F.col("__edge").isNull() | (_bucket() < F.col("__edge")) | (_bucket() == F.col("__edge")) & (F.coalesce(F.col("key") <= F.col("__last"), F.lit(False)) | F.coalesce(F.col("__rank") <= F.col("__need"), F.lit(False)))
    return (F.col("__epochs") + F.when((F.col("__rest") > 0) & more, F.lit(1)).otherwise(F.lit(0))).cast("long")


def mixture(docs: DataFrame, budget: float = BUDGET, most: float = MOST, pattern: tuple[float, ...] = PATTERN, id_column: str = "doc_id", **options) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target,
    taken (words, repeats counted), copies; see ``sampling_plan``.

    Null or empty texts have size 0 and no words to take; a source of such texts
    alone has target 0. Rows that repeat are separate documents: those at which a
    source's budget ends differ by one copy, others are taken alike. Rows that
    share an id or have none differ by their texts. An empty input gives an
    empty result.
    """
    keyed = written(sample_keys(docs, F.col(id_column).alias("doc_id"), id_column=id_column, **options).withColumn("__row", F.monotonically_increasing_id()))
    plan = sampling_plan(keyed, budget, most, pattern)
    planned = _with_ranks(_planned(keyed, plan), plan).withColumn("copies", _copies())
    return planned.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, budget: float = BUDGET, most: float = MOST, pattern: tuple[float, ...] = PATTERN, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, by its
    own key; rows are not joined by id nor shuffled, but for repeated rows of
    which only some are taken: then the rows are written first. Rows without
    words are left out."""
    plan = sampling_plan(written(sample_keys(docs, **options)), budget, most, pattern)
    rows = sample_keys(docs, F.struct("*").alias("row"), **options).withColumn("__row", F.monotonically_increasing_id())
    if not plan.filter("__tie is not null").isEmpty():
        rows = written(rows)
    own = _with_ranks(_planned(rows.filter("size > 0"), plan), plan)
    return own.select("row", F.explode(F.array_repeat(F.lit(1), _copies().cast("int"))).alias("copy")).select("row.*")
