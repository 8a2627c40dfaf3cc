"""Benchmark items in documents: SimHash windows, block index, exact check."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwatch.llm.words import WordHashes, grams, mix, pieces, texts
from callwatch.runtime import map_arrow, written

WIDTH = 5
SIMILARITY = 0.8
#: Largest Hamming distance of fingerprints of 64 bits that the index must find.
#: At a similarity of 0.8 the expected distance is about 10, with a deviation of 3.
RADIUS = 19
BLOCKS = 4
#: Items, and bytes of their texts, that one index holds: a lot.
ITEMS_AT_ONCE = 20_000
BYTES_AT_ONCE = 32 * 2**20
#: Compressed bytes of the lots that one pass over the documents takes.
PASS_BYTES = 256 * 2**20
#: Bytes of documents that a task holds while it goes through the lots.
DOCUMENT_BYTES = 16 * 2**20

#: An item's id (None if it has none) and text.
Row = tuple[int | None, str]

_EDGE = re.compile(r"^\W+|\W+$")


def normal(word: bytes) -> bytes | None:
    """Lower case, without punctuation at either end; None if nothing is left."""
    return _EDGE.sub("", word.decode("utf-8", "replace").lower()).encode() or None


class Items:
    """Benchmark items with their shingles, fingerprints and the block index.

    A fingerprint has ``BLOCKS`` blocks. Two fingerprints within ``RADIUS`` bits
    agree in some block to within RADIUS // BLOCKS bits, as otherwise they would
    differ in more than RADIUS. All block values within that distance of a
    window's are looked up, so no item within the radius is missed.
    """

    def __init__(self, rows: tuple[Row, ...]):
        hashed = WordHashes(normal)
        self.ids, self.sizes, self.shingles, self.counts = [], [], [], []
        for item, text in rows:
            h = hashed.of((text or "").encode().split())
            if len(h) >= WIDTH:
                values, counts = np.unique(grams(h, WIDTH), return_counts=True)
                self.ids.append(item)
                self.sizes.append(len(h))
                self.shingles.append(values)
                self.counts.append(counts)
        self.sizes = np.array(self.sizes, np.int64)
        # the distinct (shingle, size of an item that has it)
        owner = np.repeat(self.sizes, [len(x) for x in self.shingles]).astype(np.int64)
        pairs = np.unique(np.rec.fromarrays([np.concatenate([*self.shingles, np.empty(0, np.uint64)]), owner], names="shingle,size"))
        self.known, self.known_size = pairs["shingle"].copy(), pairs["size"].copy()
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.prints = np.array([fingerprints(np.repeat(s, c))[0] for s, c in zip(self.shingles, self.counts, strict=True)], np.uint64)
        bits = 64 // BLOCKS
        self.order, self.keys, self.present = [], [], []
        for b in range(BLOCKS):
            block = (self.prints >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1)
            order = np.argsort(block, kind="stable")
            self.order.append(order)
            self.keys.append(block[order])
            self.present.append(np.zeros(1 << bits, bool))
            self.present[-1][block.astype(np.int64)] = True
        self.masks = np.array([sum(1 << x for x in c) for d in range(RADIUS // BLOCKS + 1) for c in combinations(range(bits), d)], np.int64)

    def among(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles that items have, with the items' sizes: one pair for
        each size."""
        at = np.flatnonzero(self.maybe[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        low = np.searchsorted(self.known, shingles[at], "left")
        count = np.searchsorted(self.known, shingles[at], "right") - low
        upto = np.cumsum(count)
        which = np.repeat(low - upto + count, count) + np.arange(upto[-1] if len(upto) else 0)
        return np.repeat(at, count), self.known_size[which]

    def near(self, fingerprint: np.uint64) -> np.ndarray:
        """The items within the radius of a fingerprint, by the block index."""
        bits, found = 64 // BLOCKS, []
        for b in range(BLOCKS):
            wanted = int((fingerprint >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1)) ^ self.masks
            wanted = wanted[self.present[b][wanted]].astype(np.uint64)
            low = np.searchsorted(self.keys[b], wanted, "left")
            count = np.searchsorted(self.keys[b], wanted, "right") - low
            upto = np.cumsum(count)
            found.append(self.order[b][np.repeat(low - upto + count, count) + np.arange(upto[-1] if len(upto) else 0)])
        some = np.unique(np.concatenate(found))
        return some[np.bitwise_count(self.prints[some] ^ fingerprint) <= RADIUS]


def fingerprints(shingles: np.ndarray, starts: np.ndarray | None = None, length: int | None = None) -> np.ndarray:
    """SimHash of the whole sequence of shingles, or of the ``length`` ones from
    each start on. A shingle weighs as often as it occurs: each occurrence adds
    1 to the places of its set bits and takes 1 from the others."""
    bits = np.unpackbits(mix(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    upto = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    if starts is None:
        starts, length = np.zeros(1, np.int64), len(shingles)
    sums = upto[starts + length] - upto[starts]
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def weighted_similarity(window: np.ndarray, shingles: np.ndarray, counts: np.ndarray) -> float:
    """Weighted Jaccard similarity of a window's shingles and an item's, weights
    being counts."""
    values, own = np.unique(window, return_counts=True)
    _, i, j = np.intersect1d(values, shingles, assume_unique=True, return_indices=True)
    both = int(np.minimum(own[i], counts[j]).sum())
    return both / (int(own.sum()) + int(counts.sum()) - both)


def _matches(items: Items, shingles: np.ndarray, similarity: float) -> Iterator[tuple[int, int, int, float]]:
    """(item, start, words, similarity) of the best window for each item found."""
    places, sizes = items.among(shingles)
    best: dict[int, tuple[float, int, int]] = {}
    for size in np.unique(sizes):
        length = min(int(size) - WIDTH + 1, len(shingles))
        own = places[sizes == size]
        # a window with fewer shingles that items of its size have can't reach the similarity
        if len(own) < similarity * (size - WIDTH + 1):
            continue
        upto = np.zeros(len(shingles) + 1, np.int64)
        upto[own + 1] = 1
        upto = np.cumsum(upto)
        starts = np.flatnonzero(upto[length:] - upto[:-length] >= similarity * (size - WIDTH + 1))
        if not len(starts):
            continue
        low, high = int(starts[0]), int(starts[-1]) + length
        prints = fingerprints(shingles[low:high], starts - low, length)
        looked: dict[int, np.ndarray] = {}
        for start, fingerprint in zip(starts.tolist(), prints, strict=True):
            key = int(fingerprint)
            if key not in looked:
                near = items.near(fingerprint)
                looked[key] = near[items.sizes[near] == size]
            for item in looked[key].tolist():
                s = weighted_similarity(shingles[start : start + length], items.shingles[item], items.counts[item])
                if s >= similarity and s > best.get(item, (0.0,))[0]:
                    best[item] = (s, start, length + WIDTH - 1)
    for item, (s, start, words) in best.items():
        yield item, start, words, s


@lru_cache(maxsize=2)
def _built(packed: bytes) -> Items:
    """The index of a lot, kept by each Python worker while it is the only one or
    the next."""
    return Items(pickle.loads(zlib.decompress(packed)))


def _found_in(batch: pa.RecordBatch, lots: list[Broadcast], hashed: WordHashes, similarity: float) -> Iterator[tuple[int, int | None, int, int, float]]:
    """(row, item id, start, words, similarity) for a batch's matches in all lots.
    Documents are hashed once, and one lot's index is in use at a time."""
    shingles = [grams(hashed.of(text.split()), WIDTH) for text in texts(batch)]
    for lot in lots:
        items = _built(lot.value)
        for row, own in enumerate(shingles):
            for item, *match in _matches(items, own, similarity):
                yield row, items.ids[item], *match


def _scan(lots: list[Broadcast], similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes(normal)
        for batch in pieces(batches, DOCUMENT_BYTES):
            found = list(_found_in(batch, lots, hashed, similarity))
            at, item, start, words, s = (list(x) for x in zip(*found, strict=True)) if found else ([] for _ in range(5))
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(words, pa.int64()), pa.array(s, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return run


def _clean(lots: list[Broadcast], similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes(normal)
        for batch in pieces(batches, DOCUMENT_BYTES):
            text = pa.RecordBatch.from_arrays([batch.column("text").cast(pa.binary())], ["text"])
            stay = np.ones(len(batch), bool)
            stay[[row for row, *_ in _found_in(text, lots, hashed, similarity)]] = False
            yield batch.filter(pa.array(stay))

    return run


def item_classes(benchmark: DataFrame) -> DataFrame:
    """(item_id, class_id) for each item with a text: items of equal texts form a
    class, named by the least id."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    least = items.groupBy(F.col("text").alias("__text")).agg(F.min("item_id").alias("class_id"))
    return items.join(least, F.col("text") == F.col("__text")).select("item_id", "class_id")


def _passes(benchmark: DataFrame) -> list[list[Broadcast]]:
    """The distinct texts of the items with their least ids, in lots of bounded
    numbers and bytes, which are compressed and broadcast one by one; as many
    to a pass over the documents as ``PASS_BYTES`` hold. One empty lot if there
    are no items."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    items = written(items.groupBy("text").agg(F.min("item_id").alias("item_id")))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    lots = max(1, -(-n // ITEMS_AT_ONCE), -(-size // BYTES_AT_ONCE))
    passes: list[list[Broadcast]] = [[]]
    held = 0
    for lot in range(lots):
        some = items.filter(F.pmod(F.xxhash64("text"), F.lit(lots)) == lot).collect()  # about a lot's rows and bytes
        rows = sorted(((r["item_id"], r["text"]) for r in some), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        packed = zlib.compress(pickle.dumps(tuple(rows)), 1)
        if passes[-1] and held + len(packed) > PASS_BYTES:
            passes.append([])
            held = 0
        passes[-1].append(benchmark.sparkSession.sparkContext.broadcast(packed))
        held += len(packed)
    return passes


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): for each document and
    each distinct item of ``benchmark`` (item_id, text) found in it, the best
    window.

    Words are compared in lower case and without punctuation at their ends;
    words of punctuation alone don't count. A window has as many words as the
    item, or all of a shorter document. Windows whose SimHash is within
    ``RADIUS`` bits of the item's are verified by the weighted Jaccard similarity
    of their five-word shingles. Windows that hold too few shingles of any item
    to reach the similarity are passed over, which loses nothing.

    Items are sent to the tasks in lots of ``ITEMS_AT_ONCE`` items and
    ``BYTES_AT_ONCE`` bytes, compressed. One pass over the documents, which are
    not shuffled, takes lots of up to ``PASS_BYTES``: a task hashes some
    documents and goes through the lots, with one index at a time. Items under
    five words have no shingle and are left out, null texts too. Items of equal
    texts are one, under the least id (null if they have none);
    ``item_classes`` lists them. Null or empty documents match nothing.
    Rows of documents that repeat, or lack an id, match each for itself. Empty
    tables give no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    found = [map_arrow(plain, _scan(lots, similarity), schema) for lots in _passes(benchmark)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents in which no item is found, with all their columns. Each row
    is judged for itself, where it is: nothing is joined by id or shuffled."""
    for lots in _passes(benchmark):
        docs = map_arrow(docs, _clean(lots, similarity), docs.schema)
    return docs
