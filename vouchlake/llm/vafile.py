"""Exact top-k by inner product over vector approximations (a VA-file in blocks).

Equal vectors are one candidate and one query: of each distinct vector only the k + 1
smallest ids can be among anybody's k best, so no more are kept, and a vector that a
third of all rows share costs no more than any other.

Distinct vectors are dealt into blocks of bounded size. Each block keeps, a dimension,
2^BITS equal cells between its least and greatest value, and one cell number a component.

1. Seed: all queries meet the blocks of the first group. A cell bounds each product from
   below and above; the k-th best lower bound is a score that the k-th result reaches.
2. Scan: queries, with what the seed says of them, meet all groups of blocks. A row stays
   if its upper bound reaches the best k-th lower bound known, the seed's or its group's.
3. Read: the exact vectors of the FIRST rows with the best upper bounds are read, which
   gives a k-th exact score; then those further rows whose upper bound reaches it. No
   other row can be among the k best.

Blocks and queries meet in tiles of GROUP blocks by PART_GROUP query parts: a task holds
one tile, some 60 MB at 64 dimensions, whatever the table's size, and both sides are
copied once for each tile of their row or column, not for each block.

Ties go to the smaller id. A vector that is null, or holds a null or a component that is
not finite, takes no part, nor does a null id. Rows that share an id are one vector (the
smallest in component order). Vectors of different lengths are searched apart. Extra
columns are not carried. Without other candidates a query has no rows. An empty table
gives none. Components are integers after scaling; sums must fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import join_one
from .samples import read_table
from .workspace import cut

BITS, BLOCK, QUERY_BLOCK, FIRST = 6, 8192, 256, 16
#: Blocks and query parts of a tile.
GROUP, PART_GROUP = 48, 240
#: Least number of block groups, so that small tables use more than one task.
LEAST_GROUPS = 12


def integer_vectors(table: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of every valid vector."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(~F.coalesce(bad, F.lit(True)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in column])


def _build_block(part: pd.DataFrame) -> pd.DataFrame:
    """One row: ids, cell edges of each dimension, cell numbers."""
    part = part.sort_values("rep")
    v = _matrix(part["v"])
    low = v.min(axis=0)
    width = np.maximum((v.max(axis=0) - low + (1 << BITS)) >> BITS, 1)
    codes = ((v - low) // width).astype(np.uint8)
    ids = part["rep"].to_numpy(np.int64)
    return pd.DataFrame(
        {"dim": [v.shape[1]], "block": [part["block"].iloc[0]], "ids": [ids.tobytes()], "low": [low.tobytes()], "width": [width.tobytes()], "codes": [codes.tobytes()]}
    )


def _build_queries(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("rep")
    v = _matrix(part["v"])
    return pd.DataFrame(
        {"dim": [v.shape[1]], "part": [part["part"].iloc[0]], "query_ids": [part["rep"].to_numpy(np.int64).tobytes()], "queries": [v.tobytes()], "floors": [part["floor"].to_numpy(float).tobytes()]}
    )


def bounds(queries: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of every query's inner product with every approximated row."""
    bottom = (low + codes * width).astype(np.float64)
    top = bottom + (width - 1)
    plus, minus = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    return plus @ bottom.T + minus @ top.T, plus @ top.T + minus @ bottom.T


def _scan(k: int):
    """Of a tile: (query, rep, lower, upper) of the rows that may be among the query's k best."""

    def run(blocks: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p in parts.itertuples(index=False):
            dim, qids = p.dim, np.frombuffer(p.query_ids, np.int64)
            queries = np.frombuffer(p.queries, np.int64).reshape(len(qids), dim)
            best = np.full((len(qids), k), -np.inf)  # the k best lower bounds of the tile so far
            floor, found = np.frombuffer(p.floors, float).copy(), []
            for b in blocks.itertuples(index=False):
                ids = np.frombuffer(b.ids, np.int64)
                lower, upper = bounds(
                    queries, np.frombuffer(b.codes, np.uint8).reshape(len(ids), dim).astype(np.int64), np.frombuffer(b.low, np.int64), np.frombuffer(b.width, np.int64)
                )
                top = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k :] if len(ids) > k else lower
                best = np.partition(np.hstack([best, top]), top.shape[1], axis=1)[:, top.shape[1] :]
                floor = np.maximum(floor, best.min(axis=1))
                at, which = np.nonzero(upper >= floor[:, None])
                found.append((at, ids[which], lower[at, which], upper[at, which]))
            if found:
                at, ids, lower, upper = (np.concatenate(x) for x in zip(*found))
                stays = upper >= floor[at]  # the floor has risen since the first blocks
                out.append(pd.DataFrame({"query": qids[at[stays]], "rep": ids[stays], "lower": lower[stays], "upper": upper[stays]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "rep": [], "lower": [], "upper": []})

    return run


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact integer inner products of the paired vectors."""
    for b in batches:
        sizes = np.diff(b.column("v").offsets.to_numpy())
        x, y = b.column("v").flatten().to_numpy(), b.column("q").flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        score = np.zeros(len(sizes), np.int64)
        if len(x):
            score[sizes > 0] = np.add.reduceat(x * y, starts[sizes > 0])
        yield pa.RecordBatch.from_arrays([b.column("query"), b.column("rep"), pa.array(score)], names=["query", "rep", "score"])


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    return (
        pairs.select("query", "rep")
        .join(vectors.select("rep", "v"), "rep")
        .join(vectors.select(F.col("rep").alias("query"), F.col("v").alias("q")), "query")
        .mapInArrow(_dots, "query long, rep long, score long")
    )


def _kth(rows: DataFrame, by: str, k: int, name: str) -> DataFrame:
    """query and its k-th greatest value of `by`; queries with fewer rows have none."""
    order = Window.partitionBy("query").orderBy(F.desc(by), "rep")
    return rows.withColumn("at", F.row_number().over(order)).where(f"at = {k}").select("query", F.col(by).alias(name))


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row that is a query."""
    vectors = cut(integer_vectors(table, scale).withColumn("asks", is_query))
    total = vectors.count()
    # one row a distinct vector, named by its smallest id; a query's own id may be one of the k + 1 that it needs
    need = k + 1
    smallest = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.select("vec_id", "v").withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= need)
    held = few.groupBy("v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asking = vectors.where("asks").groupBy("v").agg(F.count("*").alias("n"))
    distinct = cut(held.join(asking, "v", "left").withColumn("dim", F.size("v")))
    blocks = -(-distinct.count() // BLOCK)
    groups = max(LEAST_GROUPS, -(-blocks // GROUP))
    blocks = max(blocks, groups)
    query_blocks = max(1, -(-distinct.where("n IS NOT NULL").count() // QUERY_BLOCK))
    approximations = cut(
        distinct.select("rep", "v", "dim", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"))
        .groupBy("dim", "block").applyInPandas(_build_block, "dim int, block int, ids binary, low binary, width binary, codes binary")
        .withColumn("i", F.pmod("block", F.lit(groups)))
    )
    queries = distinct.where("n IS NOT NULL").select("rep", "v", "dim", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(query_blocks)).cast("int").alias("part"))
    columns = -(-query_blocks // PART_GROUP)

    def tiles(some: DataFrame, floors: DataFrame, i: Column) -> DataFrame:
        """The scan of queries with floors against groups of blocks; i: the groups (an array) that each query part meets."""
        asked = (
            floors.groupBy("dim", "part").applyInPandas(_build_queries, "dim int, part int, query_ids binary, queries binary, floors binary")
            .withColumn("j", F.pmod("part", F.lit(columns))).withColumn("i", F.explode(i))
        )
        copied = some.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
        return (
            copied.groupBy("dim", "i", "j").cogroup(asked.groupBy("dim", "i", "j"))
            .applyInPandas(_scan(need), "query long, rep long, lower double, upper double")
        )

    seen = tiles(approximations.where("i = 0"), queries.withColumn("floor", F.lit(float("-inf"))), F.array(F.lit(0)))
    seeds = _kth(seen, "lower", need, "floor").withColumnRenamed("query", "rep")
    seeded = queries.join(seeds, "rep", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    near = cut(tiles(approximations, seeded, F.sequence(F.lit(0), F.lit(groups - 1))))
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "rep")
    stay = cut(
        near.join(_kth(near, "lower", need, "least"), "query", "left").where("least IS NULL OR upper >= least")
        .select("query", "rep", "upper", F.row_number().over(order).alias("at"))
    )
    first = cut(_exact(stay.where(F.col("at") <= FIRST), distinct))
    further = stay.where(F.col("at") > FIRST).join(_kth(first, "score", need, "kth"), "query").where("upper >= kth")
    scores = first.unionByName(_exact(further, distinct))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    vectors_of = scores.withColumn("at", F.row_number().over(best)).where(F.col("at") <= need)
    found = (
        vectors_of.join(distinct.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("at") <= need)
        .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("list"))
    )
    # every row that asks takes its vector's list, without itself
    lists = found.join(distinct.select(F.col("rep").alias("query"), "v", "n"), "query").select("v", "list", "n")
    own = join_one(vectors.where("asks").select(F.col("vec_id").alias("query_id"), "v"), lists, "v", total)
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
