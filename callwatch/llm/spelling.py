"""Spelling variants: words one edit apart, found with an FM-index and a search
scheme of two halves."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwatch.llm.words import pieces, texts
from callwatch.runtime import dealt, map_arrow, written

#: Runs of A-Z, a-z and U+00C0..U+00FF in UTF-8, once A-Z are lower-cased.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
MIN_LENGTH, MIN_COUNT = 6, 5
#: One run in so many of a document loses a code point.
DAMAGE = 199
#: A form is so many times as frequent as its variant.
DOMINANCE = 5
#: Both halves of a word have at least so many code points.
KEY = MIN_LENGTH // 2
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: Code points of the words of one index, and of the queries searched at once.
SHARD, AT_ONCE = 250_000, 200_000
#: Intervals of up to so many ranks are read rather than asked for each letter.
FEW = 16


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def handed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for whole in batches:
        for batch in pieces([whole]):
            for name, text in zip(batch.column("id").to_pylist(), texts(batch), strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(RUN.findall(text.lower())).items():
                    lot = zlib.crc32(run, start)
                    if lot % DAMAGE == 0:
                        said = run.decode()
                        gone = lot % len(said)
                        run = (said[:gone] + said[gone + 1 :]).encode()
                    total[run] += n
                if len(total) >= HELD:
                    yield handed_on()
                    total.clear()
    if total:
        yield handed_on()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least ``MIN_LENGTH`` code points that occur
    ``MIN_COUNT`` times or more, after the trial damage. Tasks count what they
    read, so only counts are shuffled."""
    plain = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counts = map_arrow(plain, _counted, "word string, n long").filter(F.length("word") >= MIN_LENGTH)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The order of the suffixes, by doubling."""
    n, width = len(codes), 1
    rank = codes.astype(np.int64)
    while True:
        later = np.zeros(n, np.int64)
        later[: max(0, n - width)] = rank[width:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + later
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        ranks = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        if ranks[-1] == n - 1:
            return order
        width *= 2


class FmIndex:
    """Rank intervals of ``$word$word$...$``. Each step puts one letter before what
    is matched; an index of reversed words so goes the other way."""

    def __init__(self, words: list[str]):
        self.letters = sorted(set("".join(words)))
        #: 0 ends the text, 1 is the delimiter, an unknown letter is past the last
        self.code = {c: i + 2 for i, c in enumerate(self.letters)}
        self.size = len(self.letters) + 2
        joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words])
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        text = np.ones(len(joined) + len(words) + 2, np.int64)
        inside = np.ones(len(text), bool)
        inside[self.starts] = False
        inside[-2:] = False
        text[inside] = np.searchsorted(np.array([ord(c) for c in self.letters], np.uint32), joined) + 2
        text[-1] = 0
        self.n = len(text)
        self.order = suffix_array(text)
        self.before = text[self.order - 1]
        ranked = np.argsort(self.before, kind="stable")
        self.keys = self.before[ranked] * (self.n + 1) + ranked
        self.delimiters = int((text < 1).sum()), int((text <= 1).sum())

    def codes(self, words: list[str]) -> np.ndarray:
        """A row of codes for each of some words of one length."""
        return np.array([[self.code.get(c, self.size) for c in w] for w in words], np.int64)

    def extend(self, letter: np.ndarray | int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of a letter followed by what is matched."""
        base = letter * np.int64(self.n + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, letter, low, high) of each letter that occurs before."""
        width = high - low
        few, many = np.flatnonzero(width <= FEW), np.flatnonzero(width > FEW)
        at = np.repeat(few, width[few])
        row = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(width[few]) - width[few], width[few])
        listed = np.unique(at * np.int64(self.size) + self.before[row])
        asked = np.repeat(many, self.size) * np.int64(self.size) + np.tile(np.arange(self.size), len(many))
        both = np.concatenate([listed, asked])
        at, letter = both // self.size, both % self.size
        at, letter = at[letter > 1], letter[letter > 1]
        a, b = self.extend(letter, low[at], high[at])
        found = a < b
        return at[found], letter[found], a[found], b[found]

    def one_edit(self, queries: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of the words that differ from a query by one edit
        before its last ``exact`` letters, those matched exactly first."""
        q = np.arange(len(queries))
        low, high = (np.full(len(q), v, np.int64) for v in self.delimiters)
        length = queries.shape[1]
        for i in range(length - 1, length - exact - 1, -1):
            low, high = self.extend(queries[q, i], low, high)
            q, low, high = (x[low < high] for x in (q, low, high))
        # those with their one edit behind them
        edited = [(np.empty(0, np.int64),) * 3]
        for i in range(length - exact, -1, -1):
            at, letter, a, b = self.branches(low, high)
            edited.append((q[at], a, b))  # a letter more
            eq, elow, ehigh = (np.concatenate(x) for x in zip(*edited, strict=True))
            if i == 0:
                break
            wanted = queries[:, i - 1]
            elow, ehigh = self.extend(wanted[eq], elow, ehigh)
            alive = elow < ehigh
            other = letter != wanted[q[at]]
            edited = [(eq[alive], elow[alive], ehigh[alive]), (q, low, high), (q[at][other], a[other], b[other])]  # a letter less, another letter
            same = ~other
            q, low, high = q[at][same], a[same], b[same]
        elow, ehigh = self.extend(1, elow, ehigh)
        eq, elow = eq[elow < ehigh], elow[elow < ehigh]
        # words are distinct, so an interval between delimiters is one word
        word = np.searchsorted(self.starts, self.order[elow], "right") - 1
        pairs = np.unique(eq * np.int64(len(self.starts)) + word)
        return pairs // len(self.starts), pairs % len(self.starts)


class _Shard:
    """One index with the words' counts, on the side of a word that may differ:
    0 the front, 1 the back (words are reversed)."""

    def __init__(self, side: int, words: list[str], counts: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.side, self.words, self.n = side, [words[i] for i in order], np.array([counts[i] for i in order])
        self.index = FmIndex([w[::-1] for w in self.words] if side else self.words)

    def near(self, queries: list[str]) -> pa.RecordBatch:
        """Of queries of one length: how many words are near, and the most frequent."""
        half = len(queries[0]) // 2
        q, w = self.index.one_edit(self.index.codes([x[::-1] for x in queries] if self.side else queries), half if self.side else len(queries[0]) - half)
        if not self.side:
            # a word that shares the front half too is the other side's
            mine = np.array([not self.words[b].startswith(queries[a][:half]) for a, b in zip(q.tolist(), w.tolist(), strict=True)], bool)
            q, w = q[mine], w[mine]
        order = np.lexsort((w, -self.n[w], q))
        q, w = q[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(q)))
        return pa.RecordBatch.from_arrays([pa.array([queries[i] for i in q[first]], pa.string()), pa.array(count.astype(np.int64)), pa.array(self.n[w[first]].astype(np.int64)), pa.array([self.words[i] for i in w[first]], pa.string())], ["word", "n_near", "near_n", "near"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, a shard's words before its queries, these by
    length; one index is in memory at a time."""
    key, words, counts, shard = None, [], [], None
    waiting: list[str] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if waiting and shard is not None:
            yield shard.near(waiting)
        waiting.clear()

    for batch in batches:
        for side, bucket, part, query, word, n in zip(*[batch.column(c).to_pylist() for c in ("side", "bucket", "part", "query", "word", "n")], strict=True):
            if (side, bucket, part) != key:
                yield from flush()
                key, words, counts, shard = (side, bucket, part), [], [], None
            if not query:
                words.append(word)
                counts.append(n)
                continue
            if shard is None and words:
                shard, words, counts = _Shard(side, words, counts), [], []
            if waiting and (len(waiting[0]) != len(word) or len(waiting) * len(word) >= AT_ONCE):
                yield from flush()
            waiting.append(word)
    yield from flush()


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, near, near_n) of words (word, n) that differ by one inserted,
    deleted or replaced code point from at least one other: how many, and the
    most frequent of them (ties to the smallest). Words are distinct and have
    ``MIN_LENGTH`` code points or more.

    Of two words one edit apart, one half of the first is whole in the second. So
    each word is searched twice: its back half matched exactly and the front
    extended with one edit, and the other way round in an index of reversed words.
    Either way both words share ``KEY`` letters at one end, by which they are
    dealt into indexes of about ``shard`` code points; letters at which more words
    end fill several indexes, each of which their words search. A pair that both
    sides find counts on one.
    """
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    both = words.select("word", "n", sides).withColumn("key", F.when(F.col("side") == 0, F.right("word", F.lit(KEY))).otherwise(F.left("word", F.lit(KEY))))
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    buckets = 2 * total // shard + 1
    placed = written(both.withColumn("bucket", F.pmod(F.xxhash64("side", "key"), F.lit(buckets)).cast("int")).drop("key"))
    sizes = placed.groupBy("side", "bucket").agg(F.sum(F.length("word")).alias("size"))
    full = sizes.filter(F.col("size") > 2 * shard).select(F.col("side").alias("s"), F.col("bucket").alias("b"), F.ceil(F.col("size") / shard).cast("int").alias("parts"))
    # a row for each index that is over twice its size, at most one in every `shard` letters
    split = placed.join(F.broadcast(full), (F.col("side") == F.col("s")) & (F.col("bucket") == F.col("b")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = split.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("query", F.lit(False))
    asked = split.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("query", F.lit(True))
    columns = ["side", "bucket", "part", "query", "word", "n"]
    rows = held.select(columns).unionByName(asked.select(columns)).withColumn("size", F.length("word"))
    sorted_ = dealt(rows, "side", "bucket", "part").sortWithinPartitions("side", "bucket", "part", "query", "size")
    found = map_arrow(sorted_, _searched, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the documents'
    vocabulary: its form is the near word of the greatest n where that is
    ``DOMINANCE`` times its own, and root the last of the forms that follow.

    A null text has no words, a null id is an empty one where damage is decided.
    Repeated rows count again. A table whose words are all rare or short gives
    no rows; other columns are not read.
    """
    words = written(vocabulary(docs))
    near = near_words(words).withColumnsRenamed({"word": "__word"})
    rows = words.join(near, F.col("word") == F.col("__word"), "left").drop("__word")
    better = F.col("near_n") >= DOMINANCE * F.col("n")
    rows = written(rows.select("word", F.when(better, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("near_n")).alias("form_n")))
    # n grows fivefold with each form, so few rounds of doubling reach the root
    way = written(rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("to")))
    while True:
        longer = way.join(way.select(F.col("word").alias("__at"), F.col("to").alias("__next")), F.col("to") == F.col("__at"), "left")
        way = written(longer.select("word", F.coalesce("__next", "to").alias("to"), F.col("__next").isNotNull().alias("moved")))
        if way.filter("moved").isEmpty():
            break
        way = way.drop("moved")
    roots = way.select(F.col("word").alias("__of"), F.col("to").alias("root"))
    return rows.join(roots, F.col("word") == F.col("__of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
