"""Toxicity: non-negative PU learning over words and word beginnings.

Confirmed toxic documents are the positives; everything else is unlabelled. A document
is the set of its lower-case words, of their first three to eight letters and of the words
that it repeats. Features
that stand out among the sampled positives are proposed by a distributed count, and how
many documents hold them is then counted over all rows that may be learnt from. The linear
model sees only what stands out there too, with weights of no less than zero, so a long clean
text gathers little weight from its length, and what few toxic rows happen to lack is not
held for clean.

Null and empty texts have no features and get the score of the bias alone. Documents
repeat as often as they come; extra columns are kept by `keep_clean` and dropped by
`score`. An empty table gives no rows. With few confirmed rows few features are
learnt: of 45 confirmed documents (sf0.01) four of six held-out toxic ones are found, of 352
(sf0.1) 90 of 97. Without confirmed toxic rows nothing is known to
be toxic, and every score is NO_LABELS.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pu import LinearScorer, estimate_prior, fit_nnpu
from .samples import learnable, read_table, remainder, training_sample
from .workspace import cut, give_back

MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Bounds of the fitting sample, of the features proposed by it and of the vocabulary.
MAX_POSITIVE, MAX_UNLABELLED, MAX_PROPOSED, MAX_FEATURES = 3000, 9000, 3000, 1500
#: The prior without confirmed rows.
NO_LABELS = 1e-3
#: How many times the clean rate of a feature its rate among positives must be.
MARGIN = 8
PREFIXES = (3, 4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 200_000


def words_of(text: str | None) -> Counter[str]:
    """Every word, and how often it comes."""
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked with a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def repeated(word: str) -> str:
    """The feature of a text that has the word more than once."""
    return word + "+"


@dataclass(frozen=True)
class ToxicityModel:
    vocabulary: dict[str, int]
    scorer: LinearScorer

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        """One 0/1 column for each feature of the vocabulary."""
        out = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        for row, ids in enumerate(self.ids(texts)):
            out[row, ids] = 1.0
        return out

    def ids(self, texts: list[str | None]) -> Iterator[list[int]]:
        vocabulary, memo = self.vocabulary, {}
        for text in texts:
            found: set[int] = set()
            for w, n in words_of(text).items():
                hit = memo.get(w)
                if hit is None:
                    if len(memo) > _MEMO:
                        memo.clear()
                    hit = memo[w] = tuple(vocabulary[f] for f in features_of(w) if f in vocabulary)
                if hit:
                    found.update(hit)
                if n > 1 and (again := vocabulary.get(repeated(w))) is not None:
                    found.add(again)
            yield sorted(found)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        w, b = self.scorer.weights, self.scorer.bias
        logits = np.array([b + w[ids].sum() for ids in self.ids(texts)], dtype=float)
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -35, 35)))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the features of a batch, positives and unlabelled apart."""
    for b in batches:
        pos, unl = Counter(), Counter()
        for text, positive in zip(b.column("text").to_pylist(), b.column("is_positive").to_pylist()):
            (pos if positive else unl).update({f for w, n in words_of(text).items() for f in (*features_of(w), *([repeated(w)] if n > 1 else ()))})
        names = list(pos | unl)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([pos[x] for x in names], pa.int64()), pa.array([unl[x] for x in names], pa.int64())],
            names=["feature", "pos", "unl"],
        )


def _gain(a: np.ndarray, p: float, b: np.ndarray, u: float) -> np.ndarray:
    """Log-likelihood ratio of document frequencies a of p and b of u against one common rate."""
    rate = (a + b) / (p + u)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, n: np.where(k > 0, k * np.log(k / (n * rate)), 0) + np.where(k < n, (n - k) * np.log((n - k) / (n * (1 - rate))), 0)
        return np.where((rate > 0) & (rate < 1), 2 * (part(a, p) + part(b, u)), 0.0)


def propose(sample: DataFrame, most: int = MAX_PROPOSED) -> tuple[list[tuple[str, int]], int]:
    """([(feature, sampled positives with it)], sampled positives): what sampled positives have more often than sampled unlabelled rows.

    Ranked by the log-likelihood ratio of the two document frequencies, and kept above the
    level that the best of all features would reach by chance.
    """
    totals = sample.agg(F.count_if("is_positive").alias("p"), F.count_if(~F.col("is_positive")).alias("u")).first()
    p, u = float(totals["p"]), float(totals["u"])
    if not p or not u:
        return [], int(p)
    counts = sample.mapInArrow(_count_features, "feature string, pos long, unl long").groupBy("feature").agg(
        F.sum("pos").alias("pos"), F.sum("unl").alias("unl")
    )
    a, b = F.col("pos"), F.col("unl")
    rate = (a + b) / (p + u)

    def part(k, n, q):
        return F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0) + F.when(k < n, (n - k) * F.log((n - k) / (n * (1 - q)))).otherwise(0.0)

    gain = 2 * (part(a, F.lit(p), rate) + part(b, F.lit(u), rate))
    more = counts.where((a >= 2) & (a / p > b / u) & (rate < 1)).withColumn("gain", gain)
    best = more.where("gain > 11").orderBy(F.desc("gain"), "feature").limit(most)
    return [(r["feature"], r["pos"]) for r in best.select("feature", "pos").collect()], int(p)


def corpus_counts(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """(documents that hold each feature, documents), over all of docs. Each task gives one row a feature at most."""
    model = ToxicityModel({f: k for k, f in enumerate(vocabulary)}, LinearScorer(np.zeros(len(vocabulary)), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(model.vocabulary) + 1, np.int64), 0
        for b in batches:
            found = [k for ids in model.ids(b.column("text").to_pylist()) for k in ids]
            counts += np.bincount(found, minlength=len(counts))
            n += b.num_rows
        counts[-1] = n
        give_back()
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], names=["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:
        out[r["feature"]] = r["n"]
    return out[:-1], int(out[-1])


def select_features(pos: np.ndarray, p: int, unl: np.ndarray, u: int, prior: float | None, most: int = MAX_FEATURES) -> np.ndarray:
    """Which features the positives have far more often than clean rows, the most telling first.

    The unlabelled rows hold positives too, a share `prior` of them; the clean rows' rate
    is what the positives leave of the unlabelled rate, so a high share hides no feature.
    Without a prior: all that the positives have more often than the unlabelled rows.
    """
    gain = _gain(pos.astype(float), float(p), unl.astype(float), float(u))
    stands_out = (pos / p > unl / u) & (gain > 11)
    if prior is not None:
        stands_out &= pos / p > MARGIN * np.maximum(unl / u - prior * pos / p, 0.0) / (1 - min(prior, 1 - 1e-3))
    good = np.flatnonzero(stands_out)
    return good[np.argsort(-gain[good], kind="stable")][:most]


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> ToxicityModel:
    """Fit on a bounded sample, with counts over all rows. The driver gets at most MAX_PROPOSED names and one short id list a sampled row."""
    rows = training_sample(docs, labels, "toxic", MODULUS, HELD_OUT, max_positive, max_unlabelled)
    sample = cut(rows.repartition(max(1, docs.sparkSession.sparkContext.defaultParallelism)))
    proposed, p = propose(sample)
    if not proposed:
        return ToxicityModel({}, fit_nnpu(np.zeros((0, 0)), np.zeros((0, 0)), NO_LABELS))
    names, pos = [f for f, _ in proposed], np.array([n for _, n in proposed])
    unl, u = corpus_counts(learnable(docs, MODULUS, HELD_OUT), names)
    blank = ToxicityModel({f: k for k, f in enumerate(names)}, LinearScorer(np.zeros(len(names)), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(blank.ids(b.column("text").to_pylist())), pa.list_(pa.int32())), b.column("is_positive")],
                names=["ids", "is_positive"],
            )

    got = sample.mapInArrow(run, "ids array<int>, is_positive boolean").toPandas()
    ids = sorted((tuple(map(int, x)), bool(y)) for x, y in zip(got["ids"], got["is_positive"]))

    def sides(chosen: np.ndarray) -> list[np.ndarray]:
        place = np.full(len(names), -1)
        place[chosen] = np.arange(len(chosen))
        out = []
        for wanted in (True, False):
            rows = [place[list(x)] for x, y in ids if y == wanted]
            matrix = np.zeros((len(rows), len(chosen)), np.float32)
            for k, x in enumerate(rows):
                matrix[k, x[x >= 0]] = 1.0
            out.append(matrix)
        return out

    prior = estimate_prior(*sides(select_features(pos, p, unl, u, None)), NO_LABELS, steps=100, rate=0.1, l2=1e-3, floor=0.0)
    chosen = select_features(pos, p, unl, u, prior)
    return ToxicityModel({names[k]: at for at, k in enumerate(chosen)}, fit_nnpu(*sides(chosen), prior, steps=300, rate=0.1, l2=1e-4, floor=0.0))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(model.scores(b.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below `threshold`, all columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(at).to_pylist()) < threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
