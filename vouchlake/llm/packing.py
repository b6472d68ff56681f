"""Packing into windows: length combinations by non-negative least squares, residuals greedily.

A document's ids are cut at every full window; those pieces are windows of their own.
What is left of each document is a remainder shorter than a window, and only the
histogram of remainder lengths matters for the plan:

1. enumerate the combinations of up to three lengths that fill a window exactly,
2. solve min ||A x - histogram|| with x >= 0 for how often to use each,
3. round down (never using more pieces than there are),
4. pack the rest best-fit-decreasing, on the histogram.

The plan's size depends on the window alone (at most MAX_COMBINATIONS combinations and
one greedy bin a round), never on the number of documents. Pieces find their slot by
their rank among the pieces of equal length; ranks are dealt in buckets of documents,
so that a length held by a third of all rows is still numbered in parallel, and so that
rows that are equal in all they hold fall into many buckets.

Null text counts as empty; an empty text is its end id alone. Rows repeat as often as
they come and each is packed. Extra columns are not carried. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .samples import read_table
from .tokens import tokenizer, vocabulary_bytes
from .workspace import cut, give_back, in_slices

WINDOW, END_ID = 1024, 0
#: Ids that a bucket should hold, on average.
BUCKET_IDS = 64 << 20
#: Combinations kept after solving, those used most; bounds the plan.
MAX_COMBINATIONS = 20_000


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of three lengths, a >= b >= c >= 0, that add up to the window and occur."""
    has = np.zeros(window + 1, bool)
    has[0] = True
    has[present] = True
    out = []
    for a in present[present * 3 >= window]:
        rest = window - a
        b = np.arange((rest + 1) // 2, min(a, rest) + 1)
        b = b[has[b] & has[rest - b] & (b > 0)]
        out.append(np.stack([np.full_like(b, a), b, rest - b], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def solve_nnls(parts: np.ndarray, counts: np.ndarray, steps: int = 250) -> np.ndarray:
    """x >= 0 that minimises ||A x - counts||^2, where column p of A counts the lengths of parts[p].

    Accelerated projected gradient; A is never built (three entries a column).
    """
    if not len(parts):
        return np.zeros(0)
    use = parts > 0
    target = counts.astype(float).copy()
    target[0] = 0.0

    def forward(x):
        return np.bincount(parts.ravel(), (x[:, None] * use).ravel(), minlength=len(counts))

    def backward(r):
        return (r[parts] * use).sum(axis=1)

    v = np.ones(len(parts))  # largest eigenvalue of A'A, for the step
    for _ in range(30):
        v = backward(forward(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / max(float(v @ backward(forward(v))) * 1.01, 1.0)
    x = y = np.zeros(len(parts))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * backward(forward(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        if float((y - new) @ (new - x)) > 0 and float((new - x) @ backward(forward(new) - target)) > 0:
            y, t2 = new, 1.0  # overshot: start the momentum anew
        x, t = new, t2
    return x


def round_down(parts: np.ndarray, x: np.ndarray, counts: np.ndarray, most: int = MAX_COMBINATIONS) -> tuple[list[tuple[int, tuple[int, ...]]], np.ndarray]:
    """((repeats, lengths) in order of use; the histogram that remains)."""
    left, plan = counts.copy(), []
    for p in np.argsort(-x, kind="stable")[:most]:
        want = int(x[p])
        if want < 1:
            break
        lengths, times = np.unique(parts[p][parts[p] > 0], return_counts=True)
        n = min(want, int((left[lengths] // times).min()))
        if n:
            left[lengths] -= n * times
            plan.append((n, tuple(int(v) for v in parts[p] if v)))
    return plan, left


def best_fit(counts: np.ndarray, window: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit-decreasing over a histogram; equal bins are made in one round."""
    left, plan = counts.copy(), []
    while (lengths := np.flatnonzero(left)).size:
        taken: dict[int, int] = {}
        room, limit = window, int(lengths[-1])
        while room and limit:
            at = np.searchsorted(lengths, min(limit, room), side="right") - 1
            if at < 0:
                break
            length = int(lengths[at])
            k = min(room // length, int(left[length]))
            taken[length] = k
            room -= k * length
            limit = length - 1
        n = min(int(left[v]) // k for v, k in taken.items())
        for v, k in taken.items():
            left[v] -= n * k
        plan.append((n, tuple(v for v, k in taken.items() for _ in range(k))))
    return plan


@dataclass(frozen=True)
class Plan:
    """Slots of every length, in order of rank: a run of windows that hold a piece of it at one offset."""

    length: np.ndarray
    first_rank: np.ndarray
    first_window: np.ndarray
    offset: np.ndarray
    windows: int
    stride: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, offset) of the pieces with these lengths and ranks."""
        at = np.searchsorted(self.length * self.stride + self.first_rank, length * self.stride + rank, side="right") - 1
        return self.first_window[at] + rank - self.first_rank[at], self.offset[at]


def plan_windows(counts: np.ndarray, window: int = WINDOW) -> Plan:
    """counts[l]: how many remainders have length l (index 0 is not used)."""
    parts = combinations(window, np.flatnonzero(counts[1:]) + 1)
    chosen, left = round_down(parts, solve_nnls(parts, counts), counts)
    used = np.zeros(window + 1, np.int64)
    rows, base = [], 0
    for n, lengths in [*chosen, *best_fit(left, window)]:
        offset = 0
        for v in lengths:
            rows.append((v, used[v], base, offset))
            used[v] += n
            offset += v
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], base, int(counts.max(initial=0)) + 1)


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, doc_tokens, ids with the end id; one row a document.

    ids is binary and little-endian: two bytes each where all ids of the document are
    below 65536, else four. Its length over doc_tokens tells.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(shared.value)
        for b in in_slices(batches):
            totals, ids = [], []
            for text in b.column("text").to_pylist():
                whole = np.append(bpe.encode(text), END_ID)
                totals.append(len(whole))
                ids.append(whole.astype("<u2" if whole.max() < 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "doc_tokens", "ids"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, doc_tokens long, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids of every piece.

    ids: the piece's token ids, four little-endian bytes each; ids_crc32 is their digest.
    The pieces of a sequence_id in order of offset are the packed sequence. Ids are
    written once (checkpoint) and shuffled once (by bucket).
    """
    spark = docs.sparkSession
    rest = F.col("doc_tokens") % window
    written = cut(
        token_ids(docs, path)
        .withColumn("dealt", F.xxhash64("doc_id", F.monotonically_increasing_id()))
        .withColumn("rest", rest.cast("int"))
        .withColumn("full", F.floor(F.col("doc_tokens") / window).cast("long"))
    )
    # so many that a bucket holds BUCKET_IDS or so, however large the table
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (written.agg(F.sum("doc_tokens")).first()[0] or 0) // BUCKET_IDS)
    pieces = written.withColumn("bucket", F.pmod("dealt", F.lit(buckets)).cast("int")).drop("dealt")
    # at most window x buckets rows: counts of equal lengths by bucket
    by_bucket = pieces.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("full"))
    lengths = by_bucket.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect()
    counts = np.zeros(window + 1, np.int64)
    for r in lengths:
        counts[r["rest"]] = r["n"] if r["rest"] else 0
    plan = plan_windows(counts, window)

    earlier = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rank_base = by_bucket.select("rest", "bucket", "full", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_base"))
    # one row a bucket, with at most window first ranks: the ids meet it where they are dealt by bucket
    per_bucket = rank_base.groupBy("bucket").agg(
        F.sum("full").alias("full"), F.map_from_entries(F.collect_list(F.struct("rest", "rank_base"))).alias("rank_bases")
    )
    bases = per_bucket.select(
        "bucket",
        "rank_bases",
        F.coalesce(F.sum("full").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_base"),
    )
    in_bucket = Window.partitionBy("bucket").orderBy("rest", "doc_id", "ids").rowsBetween(Window.unboundedPreceding, -1)
    in_length = Window.partitionBy("bucket", "rest").orderBy("doc_id", "ids")
    ranked = (
        pieces.withColumn("full_in", F.coalesce(F.sum("full").over(in_bucket), F.lit(0)))
        .withColumn("rank_in", F.row_number().over(in_length) - 1)
        .join(bases, "bucket")
        .select(
            "doc_id", "doc_tokens", "ids", "rest", "full",
            (F.element_at("rank_bases", F.col("rest")) + F.col("rank_in")).alias("rank"),
            (F.col("full_base") + F.col("full_in") + F.lit(plan.windows)).alias("full_window"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            rest, full, rank, first = (b.column(c).to_numpy() for c in ("rest", "full", "rank", "full_window"))
            ids = [
                np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in zip(b.column("ids").to_pylist(), b.column("doc_tokens").to_pylist())
            ]
            n = full + (rest > 0)
            row = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            is_rest = nth == full[row]
            at, offset = plan.place(rest[row[is_rest]].astype(np.int64), rank[row[is_rest]]) if is_rest.any() else (0, 0)
            sequence, offsets = first[row] + nth, np.zeros(len(row), np.int64)
            sequence[is_rest], offsets[is_rest] = at, offset
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(row)),
                    pa.array(nth * window, pa.int64()),
                    pa.array(np.where(is_rest, rest[row], window), pa.int64()),
                    b.column("doc_tokens").take(pa.array(row)),
                    pa.array(sequence, pa.int64()),
                    pa.array(offsets, pa.int64()),
                    pa.array([ids[r][4 * window * k : 4 * window * (k + 1)] for r, k in zip(row.tolist(), nth.tolist())], pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place and the digest of its ids."""
    return pack(read_table(spark, sf_dir, "documents")).drop("ids")
