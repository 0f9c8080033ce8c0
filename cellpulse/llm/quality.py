"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

A text becomes a vector of transformed statistics (logarithms of counts, logits of shares).
Count, mean and covariance of each class are sums over all labelled rows, taken by Spark;
each covariance is shrunk towards the pooled one and its diagonal, factored once
(Cholesky), and the factors travel with the scoring function. The score is the logistic of
the difference of log densities, from Mahalanobis distances, plus the log prior.

Texts are read whole, in slices of bounded size; one text needs memory in proportion to
itself. Defined results: null and blank texts are scored as a text without words; labels
that are null or not 0 or 1 are not learned from; without labelled rows of both classes
every score is the share of label 1 (one half without any); repeated rows are scored one by
one; an empty table gives no rows; other columns are not carried over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import held_out, landed, map_arrow, slices

SLICE_BYTES = 400_000
# Scores from here on are good.
GOOD = 0.5
# Weights of the pooled covariance and of its diagonal in each class covariance.
TO_POOLED, TO_DIAGONAL = 0.2, 0.1
FLOOR = 1e-3
_WORD = re.compile(r"[^ \t-\r]+")
_SYMBOLS = "#*$%&|<>{}[]=_~^\\@"

STATISTICS = (
    "words", "word_chars", "symbols", "digits", "upper", "punctuation", "closed_lines",
    "line_words", "repeated_lines", "distinct_words", "top_word", "short_words", "marked_words",
    "repeated_pairs",
)


def _logit(share: float, n: int) -> float:
    """Logit of a share of n things, half a thing added on either side."""
    hits = share * n
    return float(np.log((hits + 0.5) / (max(n - hits, 0.0) + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of STATISTICS."""
    text = text or ""
    words = _WORD.findall(text)
    n, chars = len(words), len(text)
    lines = [line for line in text.split("\n") if line.strip()]
    lowered = text.lower()
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    upper = sum(a != b for a, b in zip(text, lowered, strict=False)) if len(lowered) == chars else 0
    symbols = sum(text.count(c) for c in _SYMBOLS)
    digits = sum(text.count(c) for c in "0123456789")
    stops = sum(text.count(c) for c in ".,;:!?")
    closed = sum(line.rstrip()[-1] in ".!?" for line in lines)
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:)" for w in words)
    top = max(counts.values(), default=0)
    word_chars = sum(map(len, words))
    return [
        np.log1p(n),
        np.log1p(word_chars / n) if n else 0.0,
        _logit(symbols / max(chars, 1), chars),
        _logit(digits / max(chars, 1), chars),
        _logit(upper / max(chars, 1), chars),
        _logit(stops / max(chars, 1), chars),
        _logit(closed / max(len(lines), 1), len(lines)),
        np.log1p(n / len(lines)) if lines else 0.0,
        _logit(1 - len(set(lines)) / len(lines), len(lines)) if lines else 0.0,
        _logit(len(counts) / n, n) if n else 0.0,
        _logit(top / n, n) if n else 0.0,
        _logit(sum(len(w) <= 4 for w in words) / n, n) if n else 0.0,
        _logit(marked / n, n) if n else 0.0,
        _logit(1 - len(pairs) / max(n - 1, 1), n) if n > 1 else 0.0,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """`doc_id, stats` of each row of `docs` (`doc_id, text`)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            stats = [statistics(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"]
            )

    return map_arrow(
        docs.select("doc_id", "text"), measure, f"doc_id {kind}, stats array<double>"
    )


@dataclass(frozen=True)
class Gaussian:
    """One class: mean, inverse Cholesky factor of the covariance, constant of the log density."""

    mean: np.ndarray
    whitener: np.ndarray
    constant: float

    def log_density(self, rows: np.ndarray) -> np.ndarray:
        white = (rows - self.mean) @ self.whitener.T
        return self.constant - 0.5 * np.einsum("ij,ij->i", white, white)


@dataclass(frozen=True)
class Discriminant:
    """Both classes, or only the share of label 1 where one of them has no rows."""

    share: float
    classes: tuple[Gaussian, Gaussian] | None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(rows), self.share)
        bad, good = self.classes
        odds = good.log_density(rows) - bad.log_density(rows) + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def class_sums(stats: DataFrame, labels: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of each class over all labelled rows not held out."""
    d = len(STATISTICS)
    known = labels.where("quality IN (0, 1)").select("doc_id", "quality").distinct()
    learned = stats.where(~held_out(F.col("doc_id"))).join(known, "doc_id")
    at = [F.col("stats")[i] for i in range(d)]
    sums = [F.sum(at[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = learned.groupBy("quality").agg(F.count("*").alias("n"), *sums, *products).collect()
    out = {}
    for r in rows:
        cross = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                cross[i, j] = cross[j, i] = r[f"p{i}_{j}"]
        out[r["quality"]] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), cross)
    return out


def fitted(sums: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Discriminant:
    """Class densities with shrunk covariances."""
    counts = {k: sums[k][0] if k in sums else 0 for k in (0, 1)}
    total = sum(counts.values())
    if not all(counts.values()):
        return Discriminant(counts[1] / total if total else 0.5, None)
    means = {k: sums[k][1] / counts[k] for k in counts}
    scatter = {k: sums[k][2] - counts[k] * np.outer(means[k], means[k]) for k in counts}
    pooled = sum(scatter.values()) / total
    diagonal = np.diag(np.diag(pooled))
    classes = []
    for k in (0, 1):
        own = scatter[k] / counts[k]
        shrunk = (1 - TO_POOLED) * own + TO_POOLED * pooled
        shrunk = (1 - TO_DIAGONAL) * shrunk + TO_DIAGONAL * diagonal + FLOOR * np.eye(len(pooled))
        factor = np.linalg.cholesky(shrunk)
        whitener = np.linalg.solve(factor, np.eye(len(factor)))
        classes.append(Gaussian(means[k], whitener, -float(np.log(np.diag(factor)).sum())))
    return Discriminant(counts[1] / total, tuple(classes))


def learned(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """The model fitted on all labelled rows of `stats` (`doc_id, stats`) that are not held out."""
    return fitted(class_sums(stats, labels))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, held_out, score, predicted` of each row of `docs` (`doc_id, text`)."""
    stats = landed(with_statistics(docs), "quality-statistics")
    model = learned(stats, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("stats").flatten().to_numpy(zero_copy_only=False)
            scores = model.scores(flat.reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"]
            )

    out = map_arrow(stats, score, f"doc_id {kind}, score double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


def good_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are predicted good.

    The statistics are computed again while filtering, which spares a shuffle of the texts.
    """
    model = learned(landed(with_statistics(docs), "quality-statistics"), labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            stats = np.array([statistics(text) for text in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(model.scores(stats) >= GOOD))

    return map_arrow(docs, keep, docs.schema)
