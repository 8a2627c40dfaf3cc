"""Quality scores by a regularised quadratic discriminant."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwatch.llm.words import pieces, texts
from callwatch.runtime import map_arrow, written

FEATURES = (
    "log_words",
    "word_length",
    "upper",
    "digits",
    "bars",
    "symbols",
    "bangs",
    "stops",
    "other_bytes",
    "distinct_words",
    "top_word",
    "repeated_pairs",
    "repeated_lines",
    "line_length",
    "upper_words",
    "odd_ends",
    "short_words",
)
#: Weight of the pooled diagonal in each class covariance.
SHRINKAGE = 0.1
#: Scores are logistic in the log-density difference times this, as densities of
#: dependent statistics overstate what they know.
TEMPERATURE = 0.25

_CLASS = np.zeros(256, np.int64)
for _i, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"#*$%&<>", b"!", b".,;:?'\"")):
    _CLASS[np.frombuffer(_bytes, np.uint8)] = _i + 1
_CLASS[128:] = 7


def _logit(share: float) -> float:
    """Log odds of a share, flat towards 0 and 1."""
    return float(np.log((share + 0.005) / (1.005 - share)))


def document_statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    words = text.split()
    n, size = len(words), len(text)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8) / max(size, 1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda k: k / max(n, 1)
    return [
        float(np.log1p(n)),
        float(np.log1p(sum(map(len, words)) / max(n, 1))),
        *(_logit(float(kinds[i])) for i in range(1, 8)),
        _logit(share(len(counts)) if n < 50 else min(1.0, share(len(counts)) * (n / 50) ** 0.15)),
        _logit(share(max(counts.values(), default=0))),
        _logit(1 - pairs / max(n - 1, 1) if n > 1 else 0.0),
        _logit(1 - len(set(lines)) / len(lines) if lines else 0.0),
        float(np.log1p(n / max(len(lines), 1))),
        _logit(share(sum(map(bytes.isupper, words)))),
        _logit(share(sum(1 for w in words if w[-1] in b"#*$%&|<>!"))),
        _logit(share(sum(1 for w in words if len(w) < 4))),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = np.array([document_statistics(t) for t in texts(batch)], np.float64).reshape(-1)
        lists = pa.ListArray.from_arrays(np.arange(0, len(rows) + 1, len(FEATURES), dtype=np.int32), pa.array(rows))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes, with the Cholesky factors of their covariances.

    Without rows of one class every score is that of the other's share, 0.5
    where there are no labels at all."""

    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.bias)
        terms = [np.linalg.solve(f, (x - m).T) for m, f in zip(self.means, self.factors, strict=True)]
        zero, one = (-(t**2).sum(axis=0) / 2 - np.log(np.diag(f)).sum() for t, f in zip(terms, self.factors, strict=True))
        return 1 / (1 + np.exp(-np.clip(TEMPERATURE * (one - zero) + self.bias, -40, 40)))


def fit(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Discriminant:
    """The discriminant from each class's count, sums and sums of products."""
    if len(moments) < 2:
        return Discriminant((), (), 0.5 if not moments else float(next(iter(moments))))
    total = sum(n for n, _, _ in moments.values())
    means = {c: s / n for c, (n, s, _) in moments.items()}
    own = {c: p / n - np.outer(means[c], means[c]) for c, (n, _, p) in moments.items()}
    pooled = sum(n * own[c] for c, (n, _, _) in moments.items()) / total
    target = np.diag(np.maximum(np.diag(pooled), 1e-3))
    factors = []
    for c in (0, 1):
        # few rows say little of a covariance: the weight grows as they get fewer
        weight = min(1.0, shrinkage + len(target) / moments[c][0])
        factors.append(np.linalg.cholesky((1 - weight) * own[c] + weight * target + 1e-6 * np.eye(len(target))))
    return Discriminant((means[0], means[1]), tuple(factors), 0.0)


def class_moments(labelled: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of ``x`` by ``label``: one row for each
    class, whatever the number of labelled documents."""
    k = len(FEATURES)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cells = [F.get("x", F.lit(i)) for i in range(k)]
    rows = labelled.groupBy("label").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in cells]).alias("s"), F.array(*[F.sum(cells[i] * cells[j]) for i, j in pairs]).alias("p")).collect()
    found = {}
    for row in rows:
        products = np.zeros((k, k))
        for (i, j), v in zip(pairs, row["p"], strict=True):
            products[i, j] = products[j, i] = v
        found[int(row["label"])] = (row["n"], np.array(row["s"]), products)
    return found


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _scored(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").values.to_numpy().reshape(-1, len(FEATURES))
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", shrinkage: float = SHRINKAGE) -> DataFrame:
    """doc_id, held_out, score (0 to 1; higher: label 1 likelier) and predicted
    for every row of ``docs``.

    Texts become vectors of transformed statistics: shares of character classes
    as log odds, lengths as logarithms. Each class of the labelled documents that
    are not held out gets a mean and a covariance, shrunk towards the pooled
    variances; a score is the logistic of the difference of the two Gaussian log
    densities, from the Mahalanobis distances under the factored covariances.
    Classes weigh the same. All labelled rows are used, as sums, so no bound on
    their number is needed.

    A null or empty text has the statistics of one without words, and a score.
    Labels other than 0 and 1, null ones and those of held-out ids are ignored;
    a document that is labelled repeatedly counts once for each label. Rows that
    repeat are scored alike. Without labels every score is 0.5. An empty input
    gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    measured = written(map_arrow(plain, _measured, "doc_id long, x array<double>")).withColumn("held_out", held_out())
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    learned = measured.filter(~F.col("held_out")).join(marks, F.col("doc_id") == F.col("__id"))
    model = fit(class_moments(learned), shrinkage)
    return map_arrow(measured.select("doc_id", "held_out", "x"), _scored(model), "doc_id long, held_out boolean, score double, predicted int")
