"""Repeated passages: seeds on winnowed anchors, extended both ways."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwatch.llm.words import PRIME, WordHashes, grams, mix, pieces, texts
from callwatch.runtime import map_arrow, restricted, spread_join, written

WINDOW = 35
SEED = 6
EMPTY = hashlib.sha256(b"").hexdigest()


def _print(words: list[bytes]) -> tuple[int, int]:
    """128 bits that tell word sequences apart."""
    n = xxhash.xxh3_128_intdigest(b" ".join(words))
    return n >> 64, n & (2**64 - 1)


def anchors(seeds: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The anchor of each window, from the hashes of all seeds: the place of the
    seed with the least upper half of its hash, the first if several have it. It depends on the
    window's words alone."""
    inside = window - seed + 1
    if len(seeds) < inside:
        return np.empty(0, np.int64)
    # places in the low half, so that the least number tells the first place
    low = np.uint64(2**32 - 1)
    least = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)
    span = 1
    while span < inside:
        step = min(span, inside - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return (least & low).astype(np.int64)


#: Modulo 2**64, PRIME times this is 1.
_INVERSE = np.uint64(pow(int(PRIME), -1, 2**64))


def window_hashes(hashes: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes, (n, 2), of the windows from the given starts on: sums
    of word hashes times powers of an odd number, shifted to power 0."""
    n = len(hashes)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, PRIME)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)
    out = []
    for h in (hashes, mix(hashes ^ np.uint64(0xD6E8FEB86659FD93))):
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[:n], dtype=np.uint64)])
        out.append(mix((upto[starts + window] - upto[starts]) * back[starts]))
    return np.stack(out, axis=1)


def _facts(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in pieces(batches):
            counts, shas, prints, places, seeds = [], [], [], [], []
            for text in texts(batch):
                words = text.split()
                h = hashed.of(words)
                found = grams(h, seed)
                at = np.unique(anchors(found, window, seed))
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                prints.append(_print(words))
                places.append(at.astype(np.int32))
                seeds.append(found[at].view(np.int64))
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int32))
            fp = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in (places, seeds)]
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "sha", "fp1", "fp2", "places", "seeds"])

    return run


def packed(text: bytes) -> bytes:
    """A text as it is shuffled: its length, then itself by zstd, which takes a
    third less than the shuffle's own compression of plain texts."""
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpacked(text: bytes) -> bytes:
    return pa.decompress(text[8:], int.from_bytes(text[:8], "little"), codec="zstd", asbytes=True)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain = texts(batch)
        fp = np.array([_print(t.split()) for t in plain], np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), pa.array([packed(t) for t in plain], pa.binary())], ["doc_id", "fp1", "fp2", "text"])


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals joined where they touch or overlap."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[first], ends[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(ends) - 1]])]


#: Occurrences of an anchor, and partners of a centre, that one task takes.
SEED_ROWS = 20_000
CENTRE_ROWS = 5_000
#: Places that are compared at once.
PLACES = 20_000


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words, up to ``most``, agree from each place of a and b on, going
    by ``step``."""
    count, along = [np.empty(0, np.int64)], step * np.arange(most)
    for i in range(0, len(at), PLACES):
        x, y = at[i : i + PLACES, None] + along, bt[i : i + PLACES, None] + along
        inside = (x >= 0) & (y >= 0) & (x < len(a)) & (y < len(b))
        agree = inside & (a[np.clip(x, 0, len(a) - 1)] == b[np.clip(y, 0, len(b) - 1)])
        count.append(np.where(agree.all(axis=1), most, agree.argmin(axis=1)))
    return np.concatenate(count)


def _extended(window: int, seed: int):
    """Matches between a text and the texts that hold its seeds' centres:
    intervals of either (w1 null), and windows that no centre matches."""
    room = window - seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        centre, c = None, np.empty(0, np.uint64)
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            marks: list[np.ndarray] = []

            def emit(f1: int, f2: int, starts: np.ndarray, ends: np.ndarray, w: np.ndarray | None, out=out, marks=marks) -> None:
                n = len(starts)
                some = w if w is not None else np.zeros((n, 2), np.int64)
                for column, x in zip(out, (np.full(n, f1, np.int64), np.full(n, f2, np.int64), starts, ends, some[:, 0], some[:, 1]), strict=True):
                    column.append(x)
                marks.append(np.full(n, w is None))

            for row in batch.to_pylist():
                h = hashed.of(unpacked(row["text"]).split())
                if centre != (row["c_fp1"], row["c_fp2"]):  # rows of one centre stand together
                    centre, c = (row["c_fp1"], row["c_fp2"]), hashed.of(unpacked(row["c_text"]).split())
                at, ct = np.array(row["places"], np.int64), np.array(row["c_places"], np.int64)
                left = _same(h, at - 1, c, ct - 1, -1, room)
                right = _same(h, at + seed, c, ct + seed, 1, room)
                long = left + right >= room
                if long.any():
                    for f1, f2, p in ((row["fp1"], row["fp2"], at), (row["c_fp1"], row["c_fp2"], ct)):
                        starts, ends = _merged((p - left)[long], (p + seed + right)[long])
                        emit(f1, f2, starts, ends, None)
                anchor = anchors(grams(h, seed), window, seed)
                order = np.argsort(at)
                known = np.searchsorted(at[order], anchor)
                known[known == len(at)] = 0
                known = order[known]
                start = np.arange(len(anchor))
                rest = (at[known] == anchor) & ~((start >= anchor - left[known]) & (start + window <= anchor + seed + right[known]))
                if rest.any():
                    s = start[rest]
                    w = window_hashes(h, window, s)
                    _, first, which, count = np.unique(w[:, 0], return_index=True, return_inverse=True, return_counts=True)
                    # one row speaks for windows that occur in the text repeatedly
                    again = count[which] > 1
                    if again.any():
                        emit(row["fp1"], row["fp2"], *_merged(s[again], s[again] + window), None)
                    emit(row["fp1"], row["fp2"], s[first], s[first] + window, w[first].view(np.int64))
            if marks:
                none = np.concatenate(marks)
                columns = [pa.array(np.concatenate(x)) for x in out[:4]] + [pa.array(np.concatenate(x), mask=none) for x in out[4:]]
                yield pa.RecordBatch.from_arrays([columns[0], columns[1], columns[2].cast(pa.int32()), columns[3].cast(pa.int32()), columns[4], columns[5]], ["fp1", "fp2", "start", "end", "w1", "w2"])

    return run


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, shas = [], []
        for row in batch.to_pylist():
            words = unpacked(row["text"]).split()
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, [x["start"] for x in row["spans"]], 1)
            np.add.at(gone, [x["end"] for x in row["spans"]], -1)
            stay = np.cumsum(gone)[:-1] == 0
            shas.append(hashlib.sha256(b" ".join([w for w, k in zip(words, stay, strict=True) if k])).hexdigest())
            removed.append(int(len(words) - stay.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("fp1"), batch.column("fp2"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["fp1", "fp2", "n_removed", "sha"])


class Repeats:
    """The repeated passages of ``docs``: every word that lies in a window of
    ``window`` words whose sequence starts anywhere else too.

    A window's anchor is its least-hashed run of ``seed`` words, so equal windows
    have equal anchors at equal places. Documents are joined on anchors that
    occur twice or more. Each occurrence is extended both ways against one of
    them, the centre; matches of ``window`` words and more are repeats of both.
    If the centre holds a window, all other occurrences of it are so found.
    Windows that the centre of their anchor doesn't hold are compared with each
    other by 128 bits of their words. Work thus grows with the number of
    occurrences, not of pairs, however common a passage is.

    Texts of equal word sequences form a class that is represented once; where
    it has several members, each is one long repeat, if long enough.

    A null or empty text has no words. A text under ``window`` words has no
    window. Rows that share a doc_id, or have none, are separate documents. An
    empty input gives empty results. No column but doc_id and text is read.
    """

    def __init__(self, docs: DataFrame, window: int = WINDOW, seed: int = SEED):
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
        self.window = window
        self.facts = written(map_arrow(plain, _facts(window, seed), "doc_id long, n_words long, sha string, fp1 long, fp2 long, places array<int>, seeds array<long>"))
        long = self.facts.filter(F.col("n_words") >= window)
        self.classes = written(long.groupBy("fp1", "fp2").agg(F.count("*").alias("n"), F.min("doc_id").alias("id")))
        each = long.groupBy("fp1", "fp2").agg(F.first("places").alias("places"), F.first("seeds").alias("seeds"))
        entries = each.select("fp1", "fp2", F.explode(F.arrays_zip("places", "seeds")).alias("x")).select("fp1", "fp2", F.col("x.places").alias("place"), F.col("x.seeds").alias("seed"))
        centres = entries.groupBy("seed").agg(F.count("*").alias("n"), F.min(F.struct(F.col("fp1").alias("c_fp1"), F.col("fp2").alias("c_fp2"), F.col("place").alias("c_place"))).alias("c"))
        centres = written(centres.filter("n > 1").select("seed", "n", "c.*"))
        met = spread_join(entries, centres.drop("n"), {"seed": "seed"}, centres.select("seed", "n"), ["fp1", "fp2", "place"], SEED_ROWS)
        met = met.filter("not (fp1 = c_fp1 and fp2 = c_fp2 and place = c_place)")
        pairs = met.groupBy("fp1", "fp2", "c_fp1", "c_fp2").agg(F.collect_list(F.struct("place", "c_place")).alias("p"))
        pairs = written(pairs.select("fp1", "fp2", "c_fp1", "c_fp2", F.col("p.place").alias("places"), F.col("p.c_place").alias("c_places")))
        named = pairs.select(F.explode(F.array(F.struct("fp1", "fp2"), F.struct(F.col("c_fp1").alias("fp1"), F.col("c_fp2").alias("fp2")))).alias("x")).select("x.*").distinct()
        ids = self.classes.join(named.withColumnsRenamed({"fp1": "__1", "fp2": "__2"}), (F.col("fp1") == F.col("__1")) & (F.col("fp2") == F.col("__2")), "left_semi").select("id")
        # a class has one text; only rows that share an id, or have none, are shuffled for it
        shared = long.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
        chosen = restricted(plain, "doc_id", ids)
        alone, several = (map_arrow(restricted(chosen, "doc_id", shared, how), _printed, "doc_id long, fp1 long, fp2 long, text binary") for how in ("left_anti", "left_semi"))
        several = several.join(self.classes.select(F.col("fp1").alias("__1"), F.col("fp2").alias("__2"), "id"), (F.col("fp1") == F.col("__1")) & (F.col("fp2") == F.col("__2")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        self.texts = written(alone.unionByName(several.dropDuplicates(["fp1", "fp2"])).drop("doc_id"))
        own = pairs.join(self.texts.withColumnsRenamed({"fp1": "__1", "fp2": "__2"}), (F.col("fp1") == F.col("__1")) & (F.col("fp2") == F.col("__2"))).drop("__1", "__2")
        hubs = pairs.groupBy("c_fp1", "c_fp2").agg(F.count("*").alias("n"))
        both = spread_join(own, self.texts.withColumnsRenamed({"fp1": "t_fp1", "fp2": "t_fp2", "text": "c_text"}), {"c_fp1": "t_fp1", "c_fp2": "t_fp2"}, hubs, ["fp1", "fp2"], CENTRE_ROWS)
        self.matches = written(map_arrow(both, _extended(window, seed), "fp1 long, fp2 long, start int, end int, w1 long, w2 long"))

    def class_spans(self) -> DataFrame:
        """(fp1, fp2, start, end): intervals of repeated words, by class."""
        left = self.matches.filter("w1 is not null")
        again = left.groupBy(F.col("w1").alias("__1"), F.col("w2").alias("__2")).agg(F.count("*").alias("__n")).filter("__n > 1")
        others = left.join(again, (F.col("w1") == F.col("__1")) & (F.col("w2") == F.col("__2")), "left_semi")
        return self.matches.filter("w1 is null").unionByName(others).select("fp1", "fp2", "start", "end").distinct()

    def digests(self) -> DataFrame:
        """doc_id, n_words, n_removed and kept_sha256, the SHA-256 of the kept
        words joined by one space, for every row."""
        single = self.classes.filter("n = 1").select(F.col("fp1").alias("__1"), F.col("fp2").alias("__2"))
        spans = self.class_spans().join(single, (F.col("fp1") == F.col("__1")) & (F.col("fp2") == F.col("__2")), "left_semi")
        spans = spans.groupBy("fp1", "fp2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        with_text = spans.join(self.texts.withColumnsRenamed({"fp1": "__1", "fp2": "__2"}), (F.col("fp1") == F.col("__1")) & (F.col("fp2") == F.col("__2")))
        cut = map_arrow(with_text.select("fp1", "fp2", "text", "spans"), _stripped, "fp1 long, fp2 long, n_removed long, sha string")
        copies = self.classes.filter("n > 1").select("fp1", "fp2", F.lit(None).cast("long").alias("n_removed"), F.lit(EMPTY).alias("sha"))
        changed = written(cut.unionByName(copies).withColumnsRenamed({"fp1": "__1", "fp2": "__2", "sha": "__sha"}).withColumn("__changed", F.lit(True)))
        out = self.facts.select("doc_id", "n_words", "sha", "fp1", "fp2").join(changed, (F.col("fp1") == F.col("__1")) & (F.col("fp2") == F.col("__2")), "left")
        removed = F.when(F.col("__changed"), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0).cast("long"))
        return out.select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce("__sha", "sha").alias("kept_sha256"))

    def spans(self) -> DataFrame:
        """(doc_id, start, end): intervals of repeated words of each row, end
        exclusive; they may overlap. A copy's is its whole text."""
        long = self.facts.filter(F.col("n_words") >= self.window).select("doc_id", "n_words", "fp1", "fp2")
        counted = long.join(self.classes.select(F.col("fp1").alias("__1"), F.col("fp2").alias("__2"), "n"), (F.col("fp1") == F.col("__1")) & (F.col("fp2") == F.col("__2"))).drop("__1", "__2")
        whole = counted.filter("n > 1").select("doc_id", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))
        some = counted.filter("n = 1").join(self.class_spans().withColumnsRenamed({"fp1": "__1", "fp2": "__2"}), (F.col("fp1") == F.col("__1")) & (F.col("fp2") == F.col("__2")))
        return whole.unionByName(some.select("doc_id", "start", "end"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; see ``Repeats``."""
    return Repeats(docs, window, seed).digests()
