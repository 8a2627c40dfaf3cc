"""Words and shingles, as Spark expressions and as numpy arrays inside tasks.

A word is a run of characters other than space and U+0009..U+000D. On bytes
that is what ``bytes.split()`` returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"

#: Words a task remembers the hash of before it starts afresh.
REMEMBERED = 500_000
#: Bytes of text that a task turns into arrays at once.
AT_ONCE = 2_000_000

PRIME = np.uint64(0x9E3779B97F4A7C15)


def word_array(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once per row, though the body
    names it many times or inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """What ``step``, an associative operation on ints such as a sum or a maximum
    with ``zero`` as its neutral value, makes of an array's values up to each one.
    Blocks of about the root of its length come first, so that long arrays stay
    cheap."""
    start = F.lit(zero)

    def of(values: Column, size: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), size)
        blocks = F.transform(starts, lambda i: F.aggregate(F.slice(values, i + 1, size), start, step))
        before = let(blocks, lambda x: F.transform(x, lambda _, b: F.aggregate(F.slice(x, F.lit(1), b), start, step)))

        def placed(earlier: Column) -> Column:
            block = lambda i: F.floor(i / size).cast("int")
            return F.transform(values, lambda v, i: step(F.get(earlier, block(i)), F.aggregate(F.slice(values, block(i) * size + 1, i % size + 1), start, step)))

        return let(before, placed)

    return let(values, lambda x: let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int")), lambda size: of(x, size)))


def running_sums(values: Column) -> Column:
    return running(values, lambda s, v: s + v)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash by word, kept for up to ``REMEMBERED`` words; ``normal``
    gives the form that is hashed (None: the word is left out)."""

    def __init__(self, normal: Callable[[bytes], bytes | None] | None = None):
        super().__init__()
        self.normal = normal

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        form = self.normal(word) if self.normal else word
        value = xxhash.xxh3_64_intdigest(form) or 1 if form else 0
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return found[found != 0] if self.normal else found


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    found = np.full(n, k, np.uint64)
    for i in range(k):
        found = found * PRIME + hashes[i : i + n]
    return mix(found)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles, sorted; the whole sequence is the only one
    of a shorter text, and a text without words has none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(grams(hashes, min(k, len(hashes))))


def pieces(batches: Iterable[pa.RecordBatch], at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts (column 'text') of each hold about
    ``at_once`` bytes, or one text where that is longer."""
    for batch in batches:
        sizes = np.frombuffer(batch.column("text").cast(pa.large_binary()).buffers()[1], np.int64)[: len(batch) + 1] if len(batch) else np.zeros(1, np.int64)
        start = 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + at_once, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def texts(batch: pa.RecordBatch) -> list[bytes]:
    """The texts as bytes; null as empty."""
    return [x or b"" for x in batch.column("text").to_pylist()]
