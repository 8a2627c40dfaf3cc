"""Near-duplicate documents: fast similarity sketches, banding, exact checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwatch.llm.graph import components
from callwatch.llm.words import WordHashes, mix, pieces, shingles, texts
from callwatch.runtime import in_tasks, map_arrow, restricted, spread_join, written

WIDTH = 5
PERCENT = 80
#: Bands and rows: at a similarity of 0.8, all bands miss with probability 5e-7.
BANDS, ROWS = 48, 6
#: Rounds in which each bucket compares its members with one of them.
STAR_ROUNDS = 2
#: Nodes of a group in which all pairs across components are checked.
SMALL = 32
#: Rows of a group, or copies of a text, that one task takes; more are dealt over
#: several.
GROUP_ROWS = 20_000
#: Pairs that a task checks.
PAIRS_PER_TASK = 4_000

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def sketch(values: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """Fast similarity sketches of n sets: an (n, bins) array of 64-bit integers.

    ``values`` are the sets' elements, distinct within a set, and ``owner`` the
    set each belongs to. In each of the first ``bins`` rounds every element falls
    into a random bin; in each of the others all elements fall into one given
    bin. A bin keeps the least hash of the first round that reaches it, so all
    are filled after at most 2 * bins rounds, mostly after few: elements of a set
    are hashed no more once its bins are full. Two sets agree in a bin with
    probability equal to their Jaccard similarity, and the share of bins in which
    they agree is concentrated about it. An empty set's bins stay at the maximum.
    """
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    full = np.zeros(n * bins, bool)
    base = owner.astype(np.int64) * bins
    for r in range(2 * bins):
        if not len(values):
            break
        h = mix(values + np.uint64((0x9E3779B97F4A7C15 * (r + 1)) % 2**64))
        place = (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64) if r < bins else np.int64(r - bins)
        slot = base + place
        free = ~full[slot]
        slot = slot[free]
        np.minimum.at(out, slot, (h[free] & np.uint64(0xFFFFFFFF)) | np.uint64(r << 32))
        full[slot] = True
        if r % 4 == 3 or r < 4:
            going = ~full.reshape(n, bins).all(axis=1)
            stay = going[base // bins]
            values, base = values[stay], base[stay]
    return out.reshape(n, bins)


def _band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sketches), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    parts = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    for i in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys


def _sets(batch: pa.RecordBatch, words: WordHashes, width: int) -> list[np.ndarray]:
    return [shingles(words.of(t.translate(_LOWER).split()), width) for t in texts(batch)]


def _sketched(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in pieces(batches):
            sets = _sets(batch, words, width)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate([*sets, np.empty(0, np.uint64)])
            owner = np.repeat(np.arange(len(sets)), sizes)
            one, two = (mix(flat ^ np.uint64(c)) for c in (0x51ED27, 0xA3C59AC3))
            upto = np.concatenate([[0], np.cumsum(sizes)])
            prints = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[upto] for x in (one, two)]
            fp1, fp2 = ((x[1:] - x[:-1]).view(np.int64) for x in prints)
            keys = _band_keys(sketch(flat, owner, len(sets), bands * rows), bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(fp1), pa.array(fp2), lists], ["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return run


def _check(width: int, percent: int):
    """(a, b, text_a, text_b) -> the pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                one = left.as_py()
                if one != last[0]:
                    last = (one, shingles(words.of(one.translate(_LOWER).split()), width))
                a, b = last[1], shingles(words.of(right.as_py().translate(_LOWER).split()), width)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(pairs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of representatives whose texts (node, text of
    ``members``) are similar enough."""
    n = pairs.count()
    own = restricted(members, "node", pairs.select(F.explode(F.array("a", "b"))))
    right = own.select(F.col("node").alias("__b"), F.col("text").alias("text_b"))
    left = own.select(F.col("node").alias("__a"), F.col("text").alias("text_a"))
    full = pairs.join(right, F.col("b") == F.col("__b")).join(left, F.col("a") == F.col("__a")).select("a", "b", "text_a", "text_b")
    return map_arrow(in_tasks(full, n, PAIRS_PER_TASK), _check(width, percent), "a long, b long")


def _relabel(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with the component of each node in ``c``."""
    return members.drop("c").join(labels.select(F.col("id").alias("__id"), "component"), F.col("node") == F.col("__id"), "left").select(*[x for x in members.columns if x != "c"], F.coalesce("component", "node").alias("c"))


def _open_buckets(members: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one component."""
    split = members.groupBy(F.col("key").alias("__key")).agg(F.min("c").alias("__low"), F.max("c").alias("__high")).filter("__low <> __high").select("__key")
    return members.join(split, F.col("key") == F.col("__key"), "left_semi")


def _shingle_rows(width: int):
    """(g, node, text) -> (g, h): each shingle of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in pieces(batches):
            sets = _sets(batch, words, width)
            groups = np.repeat(batch.column("g").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], ["g", "h"])

    return run


def _differences(width: int):
    """(g, node, v, c, text, usual) -> (g, node, v, c, n, d, rest): the shingles
    that a text has and its group's usual ones lack, or the reverse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in pieces(batches):
            sets = _sets(batch, words, width)
            usual = batch.column("usual")
            bounds, values = usual.offsets.to_numpy(), usual.values.to_numpy().view(np.uint64)
            rest = [np.setxor1d(x, values[i:j], assume_unique=True) for x, i, j in zip(sets, bounds[:-1], bounds[1:], strict=True)]
            upto = np.concatenate([[0], np.cumsum([len(x) for x in rest])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate([*rest, np.empty(0, np.uint64)]).view(np.int64)))
            columns = [batch.column("g"), batch.column("node"), batch.column("v"), batch.column("c"), pa.array([len(x) for x in sets], pa.int64()), pa.array(np.diff(upto).astype(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["g", "node", "v", "c", "n", "d", "rest"])

    return run


def _across(members: DataFrame, texts_of: DataFrame, size: int, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """What may link, or surely links, components of open buckets: pairs to
    check (node, n, other, m) and links (a, b).

    Buckets that share members form a group. In a group of up to ``SMALL`` nodes
    all pairs across components are checked. In a larger one, let U be the
    shingles that over half of its nodes have, and D(x) those in which x differs
    from U. As D(x) and D(y) differ in exactly the shingles in which x and y do,

        x ~ y  if and only if  s(x) + s(y) + 2 (100 + p) |D(x) & D(y)| >= 0,
        s(x) = (100 - p) |x| - (100 + p) |D(x)|,  p = ``percent``.

    Nodes whose s makes up for the largest s of the group are linked with the
    node that has it. Any other needs a number t > 0 of common differences, which
    grows with those of its partner. With differences in one order, rarest first,
    the two then share one that at least t - 1 others follow in both. Few pairs
    do, as what is frequent among the differences comes last. No pair that could
    link is lost. A node of rows that share an id may have several texts; each,
    told by its hash v, has differences of its own.
    """
    one = members.groupBy(F.col("key").alias("__key")).agg(F.min("node").alias("b"))
    joined = components(members.join(one, F.col("key") == F.col("__key")).select(F.col("node").alias("a"), "b"))
    groups = joined.select(F.col("id").alias("__id"), F.col("component").alias("g"))
    nodes = written(in_tasks(members.select("node", "n", "c").distinct().join(groups, F.col("node") == F.col("__id")).drop("__id"), size))
    counts = written(in_tasks(nodes.groupBy(F.col("g").alias("__g")).agg(F.count("*").alias("size")), size))
    small = nodes.join(counts.filter(F.col("size") <= SMALL), F.col("g") == F.col("__g"), "left_semi")
    few = small.join(small.select(F.col("g").alias("__g"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("c").alias("__c")), (F.col("g") == F.col("__g")) & (F.col("c") < F.col("__c")))
    few = few.select("node", "n", "other", "m")

    # from here on a large group's rows are dealt over tasks wherever they meet its one row
    per_group = counts.select(F.col("__g").alias("g"), F.col("size").alias("n"))
    large = spread_join(nodes.select("g", "node", "c"), counts.filter(F.col("size") > SMALL), {"g": "__g"}, per_group, ["node"], GROUP_ROWS, size).distinct()
    own = written(large.join(texts_of.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node")).select("g", "node", F.xxhash64("text").alias("v"), "c", "size", "text"))
    usual = map_arrow(own.select("g", "node", "text"), _shingle_rows(width), "g long, h long").groupBy("g", "h").agg(F.count("*").alias("k"))
    usual = written(usual)
    per_usual = usual.groupBy("g").agg(F.count("*").alias("n"))
    usual = spread_join(usual, counts, {"g": "__g"}, per_usual, ["h"], GROUP_ROWS).filter(2 * F.col("k") > F.col("size")).groupBy("g").agg(F.sort_array(F.collect_list("h")).alias("usual"))
    bare = counts.filter(F.col("size") > SMALL).join(usual, F.col("g") == F.col("__g"), "left")
    usual = written(in_tasks(bare.select("__g", F.coalesce("usual", F.array().cast("array<long>")).alias("usual")), size))
    with_usual = spread_join(own, usual, {"g": "__g"}, per_group, ["node", "v"], GROUP_ROWS, size).select("g", "node", "v", "c", "text", "usual")
    apart = written(map_arrow(with_usual, _differences(width), "g long, node long, v long, c long, n long, d long, rest array<long>"))
    slack = (100 - percent) * F.col("n") - (100 + percent) * F.col("d")
    best = written(in_tasks(apart.withColumn("s", slack).groupBy(F.col("g").alias("__g")).agg(F.max("s").alias("most"), F.max_by("node", "s").alias("b")), size))
    placed = spread_join(apart.withColumn("s", slack), best, {"g": "__g"}, per_group, ["node", "v"], GROUP_ROWS, size)
    sure = written(in_tasks(placed.filter(F.col("s") + F.col("most") >= 0).select(F.col("node").alias("a"), "b"), size))

    entries = placed.select("g", "node", "v", "c", "n", "d", "s", "most", F.explode("rest").alias("h"))
    often = written(apart.select("g", F.explode("rest").alias("h")).groupBy(F.col("g").alias("__g"), F.col("h").alias("__h")).agg(F.count("*").alias("k")))
    counted = spread_join(entries, often, {"g": "__g", "h": "__h"}, often.select(F.col("__g").alias("g"), F.col("__h").alias("h"), F.col("k").alias("n")), ["node", "v"], GROUP_ROWS)

    def needed(s: Column, t: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(-(s + t) / (2 * (100 + percent))))

    rank = F.row_number().over(Window.partitionBy("node", "v").orderBy("k", "h"))
    prefix = counted.withColumn("rank", rank).filter((F.col("rank") <= F.col("d") - needed(F.col("s"), F.col("most")) + 1) & (F.col("k") > 1))
    prefix = written(prefix.select("g", "node", "c", "n", "s", "most", "h", (F.col("d") - F.col("rank") + 1).alias("left")))
    partner = prefix.select(F.col("g").alias("__g"), F.col("h").alias("__h"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("c").alias("__c"), F.col("s").alias("t"), F.col("left").alias("__left"))
    common = (F.col("g") == F.col("__g")) & (F.col("h") == F.col("__h")) & (F.col("c") != F.col("__c"))
    met = prefix.filter("s + most < 0").join(partner, common & (F.least("left", "__left") >= needed(F.col("s"), F.col("t"))) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    return few.unionByName(met.select("node", "n", "other", "m")), sure


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Two documents are linked when their sets of distinct ``width``-word shingles
    (A-Z lower-cased) have a Jaccard similarity of ``percent`` or more;
    ``component_id`` is the smallest doc_id reachable over links and ``kept``
    says whether it is the document's own. A text of fewer words has its whole
    sequence as its one shingle. A null, empty or blank text has no shingle and
    no links.

    Documents with the same shingle set are one node, so copies are never
    paired. Nodes that share a band of their sketch fall into one bucket. There,
    members are first compared with one of them, another one in each round, as
    that joins most of a large group into one component; then, for the buckets
    that still hold several components, all pairs across these are checked or
    proven unlinked; see ``_across``. Every candidate is thus decided on its full
    set or already connected.

    Rows that share a doc_id count as one document for links. Rows without one
    have n_shingles only: component_id null and kept true. An empty input gives
    an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    sketches = written(map_arrow(plain, _sketched(width, bands, rows), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"))
    linkable = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = written(linkable.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    reps = linkable.join(classes.select(F.col("node").alias("__node"), F.col("fp1").alias("__fp1"), F.col("fp2").alias("__fp2")), (F.col("doc_id") == F.col("__node")) & (F.col("fp1") == F.col("__fp1")) & (F.col("fp2") == F.col("__fp2")), "left_semi")
    entries = reps.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = entries.groupBy(F.col("key").alias("__key")).agg(F.count("*").alias("__n")).filter("__n > 1").select("__key")
    members = written(entries.join(shared, F.col("key") == F.col("__key"), "left_semi").distinct())

    # rows that share an id are one vertex, whatever their texts
    own = linkable.groupBy(F.col("doc_id").alias("a")).agg(F.min("fp1").alias("x"), F.max("fp1").alias("y")).filter("x <> y").select("a")
    same = linkable.join(own, F.col("doc_id") == F.col("a"), "left_semi").select("doc_id", "fp1", "fp2")
    same = same.join(classes.select(F.col("fp1").alias("__1"), F.col("fp2").alias("__2"), "node"), (F.col("fp1") == F.col("__1")) & (F.col("fp2") == F.col("__2")))
    links = [written(same.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct())]
    # each text of a node once; only rows that share an id are shuffled for it
    shared = linkable.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    chosen = restricted(plain, "doc_id", members.select("node"))
    alone, several = (restricted(chosen, "doc_id", shared, how) for how in ("left_anti", "left_semi"))
    texts_of = written(alone.unionByName(several.dropDuplicates(["doc_id", "text"])).select(F.col("doc_id").alias("node"), "text"))
    labels = written(components(links[0]))
    tested = None
    current = members.withColumn("c", F.col("node"))
    size = members.count()
    for turn in range(STAR_ROUNDS + 1):
        if turn:
            current = written(in_tasks(_open_buckets(_relabel(current, labels)), size))
            size = current.count()
        if not size:
            break
        if turn < STAR_ROUNDS:
            rank = F.xxhash64("node", F.lit(turn))
            centre = current.groupBy(F.col("key").alias("__key")).agg(F.min(F.struct(rank.alias("r"), F.col("node").alias("node"), F.col("c").alias("c"), F.col("n").alias("n"))).alias("z"))
            met = current.join(centre, F.col("key") == F.col("__key")).filter(F.col("c") != F.col("z.c"))
            met = met.select("node", "n", F.col("z.node").alias("other"), F.col("z.n").alias("m"))
        else:
            met, sure = _across(current, texts_of, size, width, percent)
            links.append(sure)
        near = met.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        pairs = near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(in_tasks(pairs, size))
        found = written(_similar(pairs, texts_of, width, percent))
        tested = pairs if tested is None else tested.unionByName(pairs)
        links.append(found)
        if turn == STAR_ROUNDS or not found.isEmpty():
            labels = written(components(reduce(DataFrame.unionByName, links)))
    named = classes.join(labels, F.col("node") == F.col("id"), "left").select(F.col("fp1").alias("__1"), F.col("fp2").alias("__2"), F.coalesce("component", "node").alias("component_id"))
    # copies of one text are dealt over tasks; texts without words meet nothing
    held = linkable.select("doc_id", "n_shingles", "fp1", "fp2")
    linked = spread_join(held, named, {"fp1": "__1", "fp2": "__2"}, classes.select("fp1", "fp2", F.col("copies").alias("n")), ["doc_id"], GROUP_ROWS)
    rest = sketches.filter("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    out = linked.select("doc_id", "n_shingles", "component_id").unionByName(rest.select("doc_id", "n_shingles", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns.

    Each row counts for itself, whatever its id: rows are numbered in a written
    table, and links hold between numbers. Of a group the row with the least id
    stays, rows without one last, then that of the least hash of all columns; so
    reruns agree. Texts without words are in no group and stay. Only the numbers
    of rows that go are joined back."""
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash"))
    numbered = written(docs.select(F.struct("*").alias("row"), ranked.alias("rank"), F.monotonically_increasing_id().alias("number")))
    found = written(near_duplicates(numbered.select(F.col("number").alias("doc_id"), "row.text"), **options).select(F.col("doc_id").alias("__number"), "component_id"))
    groups = found.groupBy(F.col("component_id").alias("__c")).agg(F.count("*").alias("n")).filter("n > 1").select("__c")
    several = found.join(groups, F.col("component_id") == F.col("__c"), "left_semi")
    members = written(numbered.select("number", "rank").join(several, F.col("number") == F.col("__number")).select("number", "component_id", "rank"))
    stays = members.groupBy(F.col("component_id").alias("__c")).agg(F.min_by("number", F.struct("rank", "number")).alias("__stays"))
    goes = members.join(stays, F.col("component_id") == F.col("__c")).filter("number <> __stays").select("number")
    return restricted(numbered, "number", goes, "left_anti").select("row.*")
