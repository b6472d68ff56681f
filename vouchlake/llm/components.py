"""Connected components of an edge table, by alternating large-star and small-star steps.

Nodes are longs. Null ends don't occur; loops (a = b), repeated edges and an empty table
are fine: a node without an edge to another has no row. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import cut

#: Edges that a task contracts at once.
CHUNK = 1 << 18
#: A key is hot if it holds more than HOT rows and more than one in SHARE of all; so there are at most SHARE hot keys.
HOT, SHARE = 1000, 10_000


def join_one(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left joined with right, which has one slim row a key and in column n how many of left's `total` rows have it.

    The rows of hot keys stay where they are, and right's rows for them, SHARE at most,
    are broadcast; only the others are dealt by key. So no task gets more than one in
    SHARE of all rows for the sake of one key. n is not carried. The plan holds left's
    twice and right's three times: hand in checkpoints where they have joins of their own.
    """
    least = max(HOT, total // SHARE)
    hot, rest = right.where(F.col("n") > least).drop("n"), right.where(F.col("n") <= least).drop("n")
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(cold.join(rest, key))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a task, CHUNK at a time, by a spanning star of each of their components."""
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        for b in held:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
        a = list(above)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([root(x) for x in a], pa.int64())], names=["a", "b"])

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= CHUNK:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def _packed(edges: DataFrame, n: int) -> DataFrame:
    """The edges of a checkpoint in tasks of some CHUNK, without a shuffle, each contracted."""
    return cut(edges.coalesce(max(1, -(-n // CHUNK))).mapInArrow(_contract, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    edges: a, b (long). Each step halves path lengths or better; between steps every task
    contracts what it holds, so most graphs need one step, which finds no change, and a
    graph that one task contracts at once needs none. Every step's result is checkpointed,
    and so are its parts, so that no plan nests the joins of another: nested ones fill the
    driver's memory. Hubs of any degree are not dealt to one task.
    """
    e = cut(edges.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long").distinct())
    mark, n = None, e.count()
    while True:
        e = _packed(e, n)
        whole = n < CHUNK  # n is the number of edges or more; below CHUNK, _packed has laid all of them in one star a component
        now = None if whole else e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if whole or now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark, total = now, 2 * now["n"]
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
        large = cut(join_one(both, least, "u", total).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        small = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        moved = join_one(large, small, "a", total).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        e = cut(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        n = now["n"]


def star_edges(members: DataFrame, group: str, node: str, total: int) -> DataFrame:
    """Edges (a, b) that tie each member of a group to the group's smallest; linear in the members, of which there are `total` at most."""
    hub = cut(members.groupBy(group).agg(F.min(node).alias("hub"), F.count("*").alias("n")))
    return join_one(members.select(group, node), hub, group, total).where(F.col(node) != F.col("hub")).select(F.col(node).alias("a"), F.col("hub").alias("b"))


def labelled(nodes: DataFrame, roots: DataFrame, label: str) -> DataFrame:
    """nodes with their root as `label`, or themselves where they have no edge."""
    return nodes.join(roots.withColumnRenamed("root", label), "node", "left").withColumn(label, F.coalesce(label, "node"))
