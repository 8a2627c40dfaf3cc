"""Nearest neighbours by inner product: a forest of random-projection trees
that one priority queue searches, and exact scores of the leaves' rows."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwatch.runtime import dealt, map_arrow

#: The forest is fitted on at most so many rows and values.
SAMPLE_ROWS, SAMPLE_VALUES = 65_536, 8_000_000
#: Trees below each end of the trunk, rows of the sample in a leaf at most.
TREES, LEAF = 4, 128
#: Rows that an end of the trunk should hold, and rows of one task's block.
CELL_ROWS, BLOCK_ROWS = 8_192, 16_384
#: A node takes the direction of the most variance among so many.
TRIES = 8
#: What share of the sample's true neighbours the search must find there, and
#: the queries that measure it.
TARGET_RECALL, TRIALS = 0.96, 200
#: Queries that are scored at once.
AT_ONCE = 256


@dataclass
class Forest:
    """Nodes of all trees. The trunk is one tree whose ends are cells; below each
    cell hang ``TREES`` trees of their own directions. ``direction`` is -1 at an
    end of the trunk and -2 at a leaf."""

    longest: float
    pool: np.ndarray
    direction: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    cell: list[int] = field(default_factory=list)
    #: Number of the leaf within its cell, and its share of the sample.
    leaf: list[int] = field(default_factory=list)
    share: list[float] = field(default_factory=list)
    roots: list[list[int]] = field(default_factory=list)
    leaves: list[int] = field(default_factory=list)
    budget: float = 1.0
    grown: list[np.ndarray] | None = None

    def node(self, direction: int, **values) -> int:
        defaults = {"threshold": 0.0, "left": -1, "right": -1, "cell": -1, "leaf": -1, "share": 0.0}
        self.direction.append(direction)
        for name, default in defaults.items():
            getattr(self, name).append(values.get(name, default))
        return len(self.direction) - 1

    def projected_rows(self, x: np.ndarray) -> np.ndarray:
        """Projections of rows, which a last component lifts to one length, so
        that the nearest are those of the largest inner product."""
        rest = np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(axis=1)))
        return x @ self.pool[:-1] + rest[:, None] * self.pool[-1]

    def projected_queries(self, x: np.ndarray) -> np.ndarray:
        return (x * (self.longest / np.sqrt((x * x).sum(axis=1)))[:, None]) @ self.pool[:-1]

    def arrays(self) -> list[np.ndarray]:
        """The nodes' columns as arrays, made once the forest has grown."""
        if self.grown is None or len(self.grown[0]) != len(self.direction):
            self.grown = [np.asarray(x) for x in (self.direction, self.threshold, self.left, self.right, self.cell, self.leaf)]
        return self.grown

    def _fall(self, at: np.ndarray, projected: np.ndarray) -> np.ndarray:
        """The end of trunk or leaf below node ``at`` of each row."""
        direction, threshold, left, right, *_ = self.arrays()
        while len(moving := np.flatnonzero(direction[at] >= 0)):
            node = at[moving]
            low = projected[moving, direction[node]] < threshold[node]
            at[moving] = np.where(low, left[node], right[node])
        return at

    def cells_of(self, projected: np.ndarray) -> np.ndarray:
        return self.arrays()[4][self._fall(np.zeros(len(projected), np.int64), projected)]

    def leaves_of(self, cell: int, projected: np.ndarray) -> list[np.ndarray]:
        """For each tree below a cell, the number of each row's leaf there."""
        return [self.arrays()[5][self._fall(np.full(len(projected), root, np.int64), projected)] for root in self.roots[cell]]

    def visits(self, projected: np.ndarray) -> Iterator[tuple[int, float]]:
        """Leaves in the order in which one queue over all trees reaches them,
        with the share of the sample visited so far (each tree's rows count). The
        queue is ordered by squares of distances to the planes crossed."""
        at = projected.tolist()
        queue, seen = [(0.0, 0)], 0.0
        direction, threshold, left, right = self.direction, self.threshold, self.left, self.right
        while queue:
            penalty, node = heapq.heappop(queue)
            while direction[node] >= 0:
                margin = at[direction[node]] - threshold[node]
                near, far = (left[node], right[node]) if margin < 0 else (right[node], left[node])
                heapq.heappush(queue, (penalty + margin * margin, far))
                node = near
            if direction[node] == -1:
                for root in self.roots[self.cell[node]]:
                    heapq.heappush(queue, (penalty, root))
            else:
                seen += self.share[node]
                yield node, seen


def fit_forest(sample: np.ndarray, rows: int, longest: float, seed: int = 13) -> Forest:
    """A forest for ``rows`` rows of which ``sample`` is a sample. Its budget, the
    share of rows that a search visits, is the least that finds
    ``TARGET_RECALL`` of the true neighbours within the sample; in a larger
    table neighbours lie nearer, so there it finds no less."""
    rng = np.random.default_rng(seed)
    size = sample.shape[1] + 1
    pool = np.concatenate([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(TREES)], axis=1)
    forest = Forest(longest, pool)
    projected = forest.projected_rows(sample)
    cell_sample = max(LEAF, CELL_ROWS * len(sample) // max(rows, 1))

    def split(members: np.ndarray, most: int, base: int, used: frozenset[int], end) -> int:
        if len(members) > most:
            free = [base * size + k for k in rng.permutation(size).tolist() if base * size + k not in used][:TRIES]
            if free:
                best = free[int(projected[np.ix_(members, free)].var(axis=0).argmax())]
                values = projected[members, best]
                bar = float(np.median(values))
                low = values < bar
                if low.any():
                    node = forest.node(best, threshold=bar)
                    forest.left[node] = split(members[low], most, base, used | {best}, end)
                    forest.right[node] = split(members[~low], most, base, used | {best}, end)
                    return node
        return end(members)

    held: list[np.ndarray] = []

    def cell(members: np.ndarray) -> int:
        held.append(members)
        return forest.node(-1, cell=len(held) - 1)

    split(np.arange(len(sample)), cell_sample, 0, frozenset(), cell)
    for k, members in enumerate(held):
        forest.leaves.append(0)

        def leaf(below: np.ndarray, k: int = k) -> int:
            forest.leaves[k] += 1
            return forest.node(-2, cell=k, leaf=forest.leaves[k] - 1, share=len(below) / max(1, len(sample)))

        forest.roots.append([split(members, LEAF, tree, frozenset(), leaf) for tree in range(TREES)])
    forest.budget = _least_budget(forest, sample, projected, rng)
    return forest


def _least_budget(forest: Forest, sample: np.ndarray, projected: np.ndarray, rng: np.random.Generator, k: int = 20) -> float:
    """The share of rows after which trial queries from the sample have met
    ``TARGET_RECALL`` of their ``k`` nearest."""
    trials = rng.permutation(len(sample))[:TRIALS]
    cells = forest.cells_of(projected)
    held = np.empty((TREES, len(sample)), np.int64)
    for c in range(len(forest.roots)):
        mine = np.flatnonzero(cells == c)
        held[:, mine] = forest.leaves_of(c, projected[mine])
    starts = np.concatenate([[0], np.cumsum(forest.leaves)])
    met: list[np.ndarray] = []
    for query, at in zip(trials, forest.projected_queries(sample[trials]), strict=True):
        scores = sample @ sample[query]
        scores[query] = -np.inf
        nearest = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        reached = np.empty(starts[-1])
        for node, seen in forest.visits(at):
            reached[starts[forest.cell[node]] + forest.leaf[node]] = seen
        met.append(reached[starts[cells[nearest]] + held[:, nearest]].min(axis=0))
    found = np.concatenate(met) if met else np.empty(0)
    return float(np.quantile(found, TARGET_RECALL)) if len(found) else 1.0


def _matrix(vectors: pa.Array) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 1))


def _usable(vector: Column) -> Column:
    """Neither null, zero, nor with a component that is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _placed(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = forest.cells_of(forest.projected_rows(_matrix(batch.column("vector"))))
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32))], ["cell"])


SCHEMA = "cell int, part int, kind int, vec_id long, vector array<double>, leaves binary"
FIELDS = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("leaves", pa.binary())])


def _dealt_rows(batches: Iterator[pa.RecordBatch], forest: Forest, parts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows with their cell and, in turn, one of its blocks."""
    turn: dict[int, int] = defaultdict(int)
    for batch in batches:
        cells = forest.cells_of(forest.projected_rows(_matrix(batch.column("vector"))))
        part = np.zeros(len(cells), np.int32)
        for c in np.unique(cells).tolist():
            mine = np.flatnonzero(cells == c)
            part[mine] = (turn[c] + np.arange(len(mine))) % parts.get(c, 1)
            turn[c] += len(mine)
        n = len(batch)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(part), pa.array(np.zeros(n, np.int32)), batch.column("vec_id"), batch.column("vector").cast(FIELDS.field("vector").type), pa.nulls(n, pa.binary())], schema=FIELDS)


def _dealt_queries(batches: Iterator[pa.RecordBatch], forest: Forest, parts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Each query once for every block of a cell that its search visits, with the
    leaves it visits there as bits."""
    for whole in batches:
        for start in range(0, len(whole), AT_ONCE):
            batch = whole.slice(start, AT_ONCE)
            x = _matrix(batch.column("vector"))
            found: list[tuple[int, int, int, bytes]] = []
            for row, at in enumerate(forest.projected_queries(x)):
                leaves: dict[int, list[int]] = defaultdict(list)
                for node, seen in forest.visits(at):
                    leaves[forest.cell[node]].append(forest.leaf[node])
                    if seen >= forest.budget:
                        break
                for c, numbers in leaves.items():
                    bits = np.zeros(forest.leaves[c], np.uint8)
                    bits[numbers] = 1
                    found += [(c, p, row, np.packbits(bits).tobytes()) for p in range(parts.get(c, 0))]
            if found:
                cells, part, row, bits = zip(*found, strict=True)
                taken = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(part, pa.int32()), pa.array(np.ones(len(row), np.int32)), taken.column("vec_id"), taken.column("vector").cast(FIELDS.field("vector").type), pa.array(bits, pa.binary())], schema=FIELDS)


class _Block:
    """The rows of one block, with the leaves of its cell that each lies in."""

    def __init__(self, forest: Forest, cell: int, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.leaves = forest.leaves_of(cell, forest.projected_rows(x))
        # rows that share an id count once, so more of them are looked at
        self.copies = int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1
        self.slack = 1e-9 * max(1.0, float(np.abs(x).max()) if len(x) else 1.0) * x.shape[1]

    def nearest(self, query: int, q: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the ``k`` best rows with a finite rough score."""
        rows = np.flatnonzero((rough > -np.inf) & (self.ids != query))
        most = k * self.copies
        if len(rows) > most:
            bar = np.partition(rough[rows], len(rows) - most)[len(rows) - most]
            rows = rows[rough[rows] >= bar - self.slack * max(1.0, float(np.abs(q).max()))]
        scores = (self.x[rows] * q).sum(axis=1)
        order = np.lexsort((self.ids[rows], -scores))
        ids = self.ids[rows][order]
        first = np.sort(np.unique(ids, return_index=True)[1])[:k]
        return ids[first], scores[order][first]


def _searched(batches: Iterator[pa.RecordBatch], forest: Forest, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) of each block's best for each query. Rows come
    sorted by block, a block's rows before its queries, so that one block and
    some queries are in memory at a time."""
    key, rows, block = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "kind")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            cell, part, kind = (int(v) for v in keys[:, a])
            if (cell, part) != key:
                key, rows, block = (cell, part), [], None
            piece = batch.slice(a, b - a)
            if kind == 0:
                rows.append((piece.column("vec_id").to_numpy(), _matrix(piece.column("vector"))))
                continue
            if block is None and rows:
                block, rows = _Block(forest, cell, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])), []
            if block is None:
                continue
            for start in range(0, len(piece), AT_ONCE):
                some = piece.slice(start, AT_ONCE)
                x, ids = _matrix(some.column("vector")), some.column("vec_id").to_numpy()
                bits = np.unpackbits(np.stack([np.frombuffer(v, np.uint8) for v in some.column("leaves").to_pylist()]), axis=1)[:, : forest.leaves[cell]].astype(bool)
                rough = np.where(np.logical_or.reduce([bits[:, leaves] for leaves in block.leaves]), x @ block.x.T, -np.inf)
                best = [block.nearest(int(i), q, r, k) for i, q, r in zip(ids, x, rough, strict=True)]
                sizes = [len(v) for v, _ in best]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([v for v, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["query_id", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by
    ``every`` the ``k`` rows of other ids that the forest finds to have the
    largest inner product with it, ties to the smaller id. Scores are exact, in
    double precision.

    The forest is fitted on a bounded sample (``SAMPLE_ROWS``) and broadcast with
    the tasks; all rows are placed in it. A trunk deals rows into cells, and a
    cell with more than ``BLOCK_ROWS`` rows, such as one of many copies, into
    several blocks, all of which a query for that cell meets; so each row is
    shuffled once, and no row is left out of a full block. In each cell ``TREES``
    trees narrow down the rows. One queue over all trees, ordered by the distance
    to the planes crossed, visits leaves until the budget that the sample asks
    for is spent; only rows of visited leaves are scored.

    Vectors that are null, empty, zero, or hold a component that is null or not
    finite take no part, nor do rows without an id or whose length is not the
    commonest one (of equally common ones the greatest). Rows that share an id
    are one answer, with the best of their scores, and as a query they are
    searched together. With ``k`` or fewer candidates within the visited leaves,
    all of those are returned; an empty table gives no rows. Other columns are
    not read.
    """
    usable = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    common = usable.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.sqrt(F.max(squares)).alias("longest")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return usable.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).filter(F.lit(False))
    same = usable.filter(F.size("vector") == common["d"])
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // common["d"]))
    some = same if common["n"] <= most else same.sample(fraction=0.98 * most / common["n"], seed=13)
    sample = _matrix(some.select(F.col("vector").cast("array<double>")).limit(most).toArrow().column("vector").combine_chunks())
    forest = fit_forest(sample, common["n"], float(common["longest"]))
    placed = map_arrow(same.select("vector"), lambda b: _placed(b, forest), "cell int")
    parts = {r["cell"]: -(-r["n"] // BLOCK_ROWS) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell of the trunk
    rows = map_arrow(same, lambda b: _dealt_rows(b, forest, parts), SCHEMA)
    queries = map_arrow(dealt(same.filter(F.col("vec_id") % every == 0), "vec_id"), lambda b: _dealt_queries(b, forest, parts), SCHEMA)
    blocks = dealt(rows.unionByName(queries), "cell", "part").sortWithinPartitions("cell", "part", "kind", "vec_id")
    found = map_arrow(blocks, lambda b: _searched(b, forest, k), "query_id long, vec_id long, score double")
    # one shuffle by query serves both: an id counts once, at its best
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
