"""Quality classifier: non-negative PU learning on layout and repetition features.

Trusted positives are documents labelled quality 1; all other text is unlabelled web
text. Features see only the text: character classes, punctuation habits, repetition of
words and lines, and length, each cut into bins at quantiles over all rows that may be
learnt from, so that a linear model can bend.

Null and empty texts get a score too (their features are all zero). Documents repeat as
often as they come; extra columns are kept by `keep_good` and dropped by `score`. An
empty table gives no rows. Without trusted rows nothing is known to be bad, and every
score is NO_LABELS.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pu import LinearScorer, estimate_prior, fit_nnpu
from .samples import learnable, read_table, remainder, training_sample
from .workspace import give_back

MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Bounds of the fitting sample.
MAX_POSITIVE, MAX_UNLABELLED = 6000, 12000
#: The prior without trusted rows.
NO_LABELS = 1 - 1e-3
QUANTILES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99)

_GROUPS = ("|", "*#$%&@^~`", "!?", ".,;:", "<>{}[]()=/\\_+-", "'\"", "0123456789", " ", "\n\r\t")


def _indicator(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1.0
    return out


_MASKS = np.stack(
    [_indicator(g) for g in _GROUPS]
    + [_indicator("".join(map(chr, range(65, 91)))), _indicator("".join(map(chr, range(97, 123)))), np.arange(256) >= 128, np.arange(256) < 32]
).astype(np.float64)
N_FEATURES = len(_MASKS) + 9


def features(text: str) -> np.ndarray:
    """Shares of byte classes, then word and line habits. All zero for an empty text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out[: len(_MASKS)] = _MASKS @ np.bincount(raw, minlength=256) / len(raw)
    words = text.split()
    n = len(words)
    lines = text.split("\n")
    if n:
        distinct = len(set(words))
        out[len(_MASKS) :] = (
            np.log1p(n),
            len(text) / n,
            distinct / n,
            np.log(distinct) / np.log(n) if n > 1 else 1.0,
            sum(map(operator.eq, words, words[1:])) / n,
            sum(map(str.isupper, words)) / n,
            sum(map(str.isalpha, words)) / n,
            len(set(lines)) / len(lines),
            n / len(lines),
        )
    return out


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.stack([features(t or "") for t in texts]) if texts else np.zeros((0, N_FEATURES))


@dataclass(frozen=True)
class QualityModel:
    """Bin edges of each feature and a linear scorer over the bins."""

    edges: tuple[np.ndarray, ...]
    scorer: LinearScorer

    def binned(self, dense: np.ndarray) -> np.ndarray:
        """Thermometer code: one 0/1 column for each edge that the value exceeds."""
        return np.hstack([dense[:, [k]] > e for k, e in enumerate(self.edges)]).astype(np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.scorer.scores(self.binned(feature_matrix(texts))) if texts else np.zeros(0)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dense = feature_matrix(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array([row.tobytes() for row in dense], pa.binary()), b.column("is_positive")], names=["dense", "is_positive"]
        )


def _cells(dense: np.ndarray) -> np.ndarray:
    """Values from 0 on as whole numbers in the same order, some 256 for each doubling."""
    return dense.astype(np.float32).view(np.int32) >> 15


def corpus_edges(docs: DataFrame) -> tuple[np.ndarray, ...]:
    """Quantiles of each feature over all of docs.

    Tasks count values by cells that are narrow in proportion (0.4 %), so the counts add up
    exactly in any order and each feature has a bounded number of them; the driver gets
    one number a feature and quantile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        for b in batches:
            if b.num_rows:
                cells = _cells(feature_matrix(b.column("text").to_pylist()))
                for k in range(N_FEATURES):
                    for cell, n in zip(*(x.tolist() for x in np.unique(cells[:, k], return_counts=True))):
                        counts[k, cell] = counts.get((k, cell), 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in counts], pa.int32()), pa.array([c for _, c in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["feature", "cell", "n"],
        )

    per = docs.select("text").mapInArrow(run, "feature int, cell int, n long").groupBy("feature", "cell").agg(F.sum("n").alias("n"))
    feature = Window.partitionBy("feature")
    placed = per.withColumn("upto", F.sum("n").over(feature.orderBy("cell"))).withColumn("all", F.sum("n").over(feature))
    least = [F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("cell"))).alias(f"q{k}") for k, q in enumerate(QUANTILES)]
    found = {r["feature"]: [r[f"q{k}"] for k in range(len(QUANTILES))] for r in placed.groupBy("feature").agg(*least).collect()}
    # an edge is the greatest number of its cell
    upper = lambda cells: np.nextafter((np.unique(cells).astype(np.int32) + 1 << 15).astype(np.int32).view(np.float32).astype(float), -1.0)
    return tuple(upper(found[k]) if k in found else np.zeros(0) for k in range(N_FEATURES))


def fit_arrays(dense: np.ndarray, positive: np.ndarray, edges: tuple[np.ndarray, ...]) -> QualityModel:
    """The model of a sample: dense features, which rows are trusted positives, and bin edges."""
    blank = QualityModel(edges, LinearScorer(np.zeros(sum(map(len, edges))), 0.0))
    sides = blank.binned(dense[positive]), blank.binned(dense[~positive])
    prior = estimate_prior(*sides, NO_LABELS, steps=150, rate=0.05, l2=1e-3)
    return QualityModel(edges, fit_nnpu(*sides, prior, steps=500, rate=0.03, l2=2e-4))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> QualityModel:
    """Fit on a bounded sample; what reaches the driver is one short vector a sampled row."""
    rows = training_sample(docs, labels, "quality", MODULUS, HELD_OUT, max_positive, max_unlabelled)
    got = rows.mapInArrow(_sample_features, "dense binary, is_positive boolean").toPandas()
    got = got.sort_values(["is_positive", "dense"])  # the order of rows doesn't sway the sums
    dense = np.frombuffer(b"".join(got["dense"]), np.float64).reshape(-1, N_FEATURES)
    return fit_arrays(dense, got["is_positive"].to_numpy(bool), corpus_edges(learnable(docs, MODULUS, HELD_OUT)))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(model.scores(b.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least `threshold`, all columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(at).to_pylist()) >= threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
