"""Prefix trie of conversations: every distinct beginning is a node with counts over what begins so.

Turns become 16-byte ids (a digest of role and text) and a conversation the string of its
turns' ids. Conversations are dealt to shards by ranges of (ids, conversation), so a
beginning shared by a third of them is spread over as many shards as its rows need. A
shard lays its ids out in padded matrices of BAND columns, sorts them with numpy's lexsort
(deepest band first, each with the rank from the band below), marks where columns change,
ORs the marks from left to right into node starts, and takes every depth's aggregates with
one reduceat over all cells. Nodes that contain a shard's first or last row may go on in its
neighbours; they carry a digest of their beginning and are recombined by it. As shards are ranges,
what two neighbours both counted follows from the longest common beginning of the
one's last row and the other's first, and is taken off by one small table.

Turns with null role or text count as empty ones; rows with a null conv_id take no part.
Turns are ordered by number, null first, those with equal numbers by their digest; repeated
rows are repeated turns. An empty table gives no nodes, not even the root. Extra columns
are not carried. A conversation is one row of a shard, so its ids (16 bytes a turn) and counts
of words must fit into a task; texts don't leave the scan.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .samples import read_table
from .workspace import cut

SIZE = 16  # bytes of an id
BAND = 64  # columns of a matrix
#: Turns that a shard holds, on average.
SHARD_TURNS = 250_000
#: What separates words; a fixed value of the contract, as is the rule for shared heads below.
WORD = r"[^\x20\x09-\x0D]+"
HEAD_OF, HEADS = 20, 4


def head_length(conv_id: int) -> int:
    """How many first turns a rebuilt conversation takes from its block's first one."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def block_of(conv_id: Column) -> Column:
    """The conversation that lends its head; the remainder has the sign of conv_id, as in SQL."""
    return conv_id - conv_id % HEAD_OF


def sequences(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """conv_id, path (ids of its turns, one after the other), words (of each turn, 4 bytes each).

    With `rebuild`, a conversation takes its first turns from its block's first conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        block_of(F.col("conv_id").cast("long")).alias("block"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"),
    )
    # the lender comes first in its block, where blocks have one
    lent = F.when(F.col("conv_id") == F.col("block"), 0).otherwise(1)
    dealt = turns.repartition("block").withColumn("own", lent).sortWithinPartitions("block", "own", "conv_id", F.asc_nulls_first("turn"), "id", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, head = None, None, (b"", b"")
        ids, counts = bytearray(), bytearray()
        done: list[tuple[int, bytes, bytes]] = []

        def close() -> None:
            nonlocal head
            path, words = bytes(ids), bytes(counts)
            if now == block:
                head = path[: HEADS * SIZE], words[: HEADS * 4]
            if rebuild:
                h = head_length(now)
                path, words = head[0][: h * SIZE] + path[h * SIZE :], head[1][: h * 4] + words[h * 4 :]
            done.append((now, path, words))
            ids.clear()
            counts.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [(), (), ()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["conv_id", "path", "words"])
            done.clear()
            return made

        for b in batches:
            columns = (b.column(k).to_pylist() for k in ("conv_id", "block", "id"))
            for conv, of, i, n in zip(*columns, np.asarray(b.column("words").to_numpy(zero_copy_only=False), "<i4")):
                if conv != now:
                    if now is not None:
                        close()
                    if of != block:
                        block, head = of, (b"", b"")
                    now = conv
                ids += i
                counts += n.tobytes()
            yield out()
        if now is not None:
            close()
        yield out()

    return dealt.select("conv_id", "block", "id", "words").mapInArrow(run, "conv_id long, path binary, words binary")


# ---- one shard


class Shard:
    """Sorted conversations of one range and the nodes that they make there."""

    def __init__(self, convs: np.ndarray, paths: list[bytes], words: list[bytes]):
        turns = np.array([len(p) // SIZE for p in paths], np.int64)
        flat = np.frombuffer(b"".join(paths), ">u8").reshape(-1, SIZE // 8)
        _, dense = np.unique(flat, axis=0, return_inverse=True) if len(flat) else (None, np.zeros(0, np.int64))
        dense, begin = dense.reshape(-1), np.concatenate([[0], np.cumsum(turns)])
        order, common = _sorted(convs, turns, dense, begin[:-1])
        self.convs, self.turns, self.common = convs[order], turns[order], common
        self.paths, self.words = [paths[k] for k in order], [words[k] for k in order]
        self.weights = np.frombuffer(b"".join(self.words), "<i4").astype(np.int64)

    def nodes(self) -> dict[str, np.ndarray]:
        """Every node by depth, then order. row, last: of its first and last row; parent: its place among the nodes; ends: rows that end in it, from `row` on."""
        n, turns, common = len(self.convs), self.turns, self.common
        # cells by row: depths 0 (the root) to the row's number of turns
        cells = turns + 1
        first_cell = np.concatenate([[0], np.cumsum(cells)[:-1]])
        row = np.repeat(np.arange(n), cells)
        depth = np.arange(len(row)) - first_cell[row]
        weight = np.zeros(len(row), np.int64)
        weight[depth > 0] = self.weights
        starts = depth > common[row]  # common: -1 for the first row
        # words of the row at this depth and below, and those of the nodes that start up to here
        upto = np.cumsum(weight)
        below = upto[first_cell[row] + turns[row]] - upto + weight
        started = np.cumsum(np.where(starts, weight, 0))
        next_common = np.append(common[1:], -1)
        leaf = np.cumsum(next_common < turns)  # no later row goes on from where this one ends
        # all depths at once: cells by depth, a node's cells side by side
        by_depth = np.lexsort((row, depth))
        is_start = starts[by_depth]
        at = np.flatnonzero(is_start)
        node_of = np.empty(len(row), np.int64)
        node_of[by_depth] = np.cumsum(is_start) - 1
        first = by_depth[at]
        out = {"depth": depth[first], "row": row[first]}
        out["n_convs"] = np.diff(np.append(at, len(row)))
        out["last"] = row[by_depth[np.append(at[1:], len(row)) - 1]]
        out["conv_id"] = np.minimum.reduceat(self.convs[row[by_depth]], at)
        out["ends"] = np.add.reduceat((depth == turns[row])[by_depth].astype(np.int64), at)
        out["parent"] = np.where(out["depth"] > 0, node_of[first - 1], -1)
        out["n_children"] = np.bincount(out["parent"][1:], minlength=len(at))
        out["n_leaves"] = leaf[out["last"]] - leaf[out["row"]] + (next_common < turns)[out["row"]]
        end = first_cell[out["last"]] + turns[out["last"]]
        out["saved_tokens"] = np.add.reduceat(below[by_depth], at) - (started[end] - started[first] + weight[first])
        return out

    def keys(self, k: int) -> list[bytes]:
        """Digests of row k's beginnings, from depth 0 to all of it."""
        return keys_of(self.paths[k])


def keys_of(path: bytes) -> list[bytes]:
    out = [bytes(SIZE)]
    for k in range(0, len(path), SIZE):
        out.append(hashlib.md5(out[-1] + path[k : k + SIZE]).digest())
    return out


def _sorted(convs: np.ndarray, turns: np.ndarray, dense: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' order by ids, then conversation, and how many first turns each has in common with the one before (-1 for the first)."""
    n = len(convs)
    bands = [np.flatnonzero(turns > k) for k in range(0, int(turns.max(initial=0)) or 1, BAND)]

    def matrix(rows: np.ndarray, band: int) -> np.ndarray:
        column = np.arange(band * BAND, (band + 1) * BAND)
        inside = column < turns[rows, None]
        return np.where(inside, dense[np.where(inside, begin[rows, None] + column, 0)] if len(dense) else -1, -1)

    rank = np.full(n, -1)  # of what follows the band at hand; conversations break ties in the last one
    orders: list[np.ndarray] = []
    for band in range(len(bands) - 1, 0, -1):
        rows = bands[band]
        m = matrix(rows, band)
        order = np.lexsort((rank[rows], *m.T[::-1]))
        m, below = m[order], rank[rows][order]
        new = np.append(False, (m[1:] != m[:-1]).any(axis=1) | (below[1:] != below[:-1]))
        rank = np.full(n, -1)
        rank[rows[order]] = np.cumsum(new)
    everyone = np.arange(n)
    m = matrix(everyone, 0)
    order = np.lexsort((convs, rank, *m.T[::-1]))
    place = np.empty(n, np.int64)
    place[order] = everyone
    # node starts: a column's change holds for all columns after it
    common = np.zeros(n, np.int64)
    going = np.ones(n, bool)  # by place: alike in all bands so far
    going[:1] = False
    for band in range(len(bands)):
        rows = order if band == 0 else order[np.isin(order, bands[band], assume_unique=True)]
        m = matrix(rows, band)
        changed = np.ones(m.shape, bool)
        changed[1:] = m[1:] != m[:-1]
        at = place[rows]
        changed[1:] |= (np.diff(at) != 1)[:, None]
        changed[:, 0] |= ~going[at]
        same = (~np.logical_or.accumulate(changed, axis=1) & (m >= 0)).sum(axis=1)
        common[at] += same
        still = np.zeros(n, bool)
        still[at] = same == BAND
        going = still
    common[:1] = -1
    return order, common


_OUT = (
    "shard int, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, ends binary, edge string, path binary, words binary"
)
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _OUT.split(", ")])


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard; those that may go on elsewhere with a key. Then its first and last row, marked in `edge`."""
    from pyspark import TaskContext

    table = pa.Table.from_batches(list(batches), pa.schema([("conv_id", pa.int64()), ("path", pa.binary()), ("words", pa.binary())]))
    if not table.num_rows:
        return
    number = TaskContext.get().partitionId()
    shard = Shard(table.column("conv_id").to_numpy(), table.column("path").to_pylist(), table.column("words").to_pylist())
    nodes = shard.nodes()
    del table
    last = len(shard.convs) - 1
    open_ = (nodes["row"] == 0) | (nodes["last"] == last)
    front, back = shard.keys(0), shard.keys(last)
    decimals = [b"%d" % c for c in shard.convs.tolist()]
    parent_conv = np.where(nodes["parent"] >= 0, nodes["conv_id"][nodes["parent"]], 0)
    shared_parent = (nodes["parent"] < 0) | open_[nodes["parent"]]
    for k in range(0, len(open_), 20_000):
        part = slice(k, k + 20_000)
        depth, row, end = nodes["depth"][part], nodes["row"][part], nodes["last"][part]
        key_of = lambda d, r, e: front[d] if r == 0 else back[d]  # noqa: E731  an open node's rows have one of the two
        keys, parents, hashes, pieces = [], [], [], []
        for d, r, e, ends, is_open, far in zip(depth.tolist(), row.tolist(), end.tolist(), nodes["ends"][part].tolist(), open_[part].tolist(), shared_parent[part].tolist()):
            text = b",".join(decimals[r : r + ends])
            keys.append(key_of(d, r, e) if is_open else None)
            up = nodes["row"][0] if d == 1 else None  # the root
            parents.append((front[0] if up is not None else _beginning(front, back, shard, d - 1, r)) if far and d else None)
            hashes.append(None if is_open else hashlib.sha256(text).hexdigest())
            pieces.append(text if is_open and ends else None)
        size = len(keys)
        numbers = {c: pa.array(nodes[c][part], pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}
        numbers["parent_conv_id"] = pa.array(parent_conv[part], pa.int64(), mask=shared_parent[part])
        others = {"shard": pa.array([number] * size, pa.int32()), "key": pa.array(keys, pa.binary()), "parent_key": pa.array(parents, pa.binary()), "ends_sha256": pa.array(hashes, pa.string()), "ends": pa.array(pieces, pa.binary())}
        yield pa.RecordBatch.from_arrays([(numbers | others).get(f.name, pa.nulls(size, f.type)) for f in _SCHEMA], schema=_SCHEMA)
    edges = [{"shard": number, "edge": name, "path": shard.paths[k], "words": shard.words[k]} for name, k in (("first", 0), ("last", last))]
    yield pa.RecordBatch.from_pylist(edges, schema=_SCHEMA)


def _beginning(front: list[bytes], back: list[bytes], shard: Shard, depth: int, row: int) -> bytes:
    """The key of an open node of `depth` that holds `row`: it begins the first row or the last."""
    size = depth * SIZE
    return front[depth] if shard.paths[0][:size] == shard.paths[row][:size] and len(shard.paths[0]) >= size else back[depth]


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a shard and the one before it both counted, as amounts to add, by node."""
    names = ["key", "n_children", "n_leaves", "saved_tokens"]
    for b in batches:
        for before, words, after in zip(*(b.column(c).to_pylist() for c in ("path", "words", "next_path"))):
            common = 0
            while before[common * SIZE : (common + 1) * SIZE] and before[common * SIZE : (common + 1) * SIZE] == after[common * SIZE : (common + 1) * SIZE]:
                common += 1
            keys, n = keys_of(before), len(before) // SIZE
            depth = np.arange(n + 1)
            weight = np.append(0, np.frombuffer(words, "<i4").astype(np.int64))
            weight[common + 1 :] = 0
            columns = [-(depth < common).astype(np.int64), np.full(n + 1, -int(common == n)), np.cumsum(weight[::-1])[::-1]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(c, pa.int64()) for c in columns)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 by key over pieces that come sorted by key and first conversation; a piece at a time."""
    now, made, out = None, None, []
    for b in batches:
        for key, piece in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
            if key != now:
                if now is not None:
                    out.append((now, made.hexdigest()))
                now, made = key, hashlib.sha256(piece)
            else:
                made.update(b"," + piece)
    if now is not None:
        out.append((now, made.hexdigest()))
    columns = list(zip(*out)) or [(), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], names=["key", "ends_sha256"])


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every node of the trie of `paths` (as `sequences` makes them): RESULT."""
    spark = paths.sparkSession
    paths = cut(paths)
    turns = paths.agg(F.sum(F.octet_length("path") / SIZE + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(turns / shard_turns) + 1)
    # written, as another run of the same plan might draw the ranges elsewhere
    local = cut(paths.repartitionByRange(shards, "path", "conv_id").mapInArrow(_shard_rows, _OUT))
    nodes = local.where("edge IS NULL")
    amounts = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    open_ = nodes.where("key IS NOT NULL")
    # one row for each shard that has rows: which one is before it
    edges = local.where("edge IS NOT NULL").select("shard", "edge", "path", "words")
    before = edges.where("edge = 'first'").select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("before")).where("before IS NOT NULL")
    meet = (
        edges.where("edge = 'last'").select(F.col("shard").alias("before"), "path", "words").join(before, "before")
        .join(edges.where("edge = 'first'").select("shard", F.col("path").alias("next_path")), "shard")
    )
    twice = meet.select("path", "words", "next_path").mapInArrow(_twice, "key binary, n_children long, n_leaves long, saved_tokens long")
    parts = open_.select("key", "parent_key", "depth", "conv_id", *amounts).unionByName(twice, allowMissingColumns=True)
    whole = cut(parts.groupBy("key").agg(F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(a).alias(a) for a in amounts)))
    pieces = open_.where("ends IS NOT NULL").select("key", "ends", F.substring_index(F.col("ends").cast("string"), ",", 1).cast("long").alias("first"))
    digests = pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ends").mapInArrow(_digests, "key binary, ends_sha256 string")
    parent_ids = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("shared_parent"))
    shared = (
        whole.join(digests, "key", "left").join(parent_ids, "parent_key", "left")
        .select("conv_id", "depth", F.col("shared_parent").alias("parent_conv_id"), *amounts, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    )
    # a shard's other nodes find the parents that it shares by shard and key, so no key has more rows than a shard
    held = open_.select("shard", "key").join(whole.select("key", F.col("conv_id").alias("shared_parent")), "key").select("shard", F.col("key").alias("parent_key"), "shared_parent")
    inner = nodes.where("key IS NULL").join(held, ["shard", "parent_key"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "shared_parent"))
    return inner.select(*RESULT).unionByName(shared.select(*RESULT))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(sequences(read_table(spark, sf_dir, "conversations")))


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS k,
         md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS block,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda q: ascii(q)::BIGINT)),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, t.k, t.id, t.w FROM convs c JOIN turns t ON t.conv_id = c.block AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, t.k, t.id, t.w FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h
), paths AS MATERIALIZED (
  SELECT c.conv_id, coalesce(list(r.id ORDER BY r.k) FILTER (r.id IS NOT NULL), []) AS ids, coalesce(list(r.w ORDER BY r.k) FILTER (r.id IS NOT NULL), []) AS ws
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY 1
), cells AS MATERIALIZED (
  SELECT conv_id, d, ids[1:d] AS p, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, len(ids) = d AS ending
  FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM paths)
), nodes AS MATERIALIZED (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ending), '')) AS ends_sha256
  FROM cells GROUP BY 1, 2
), children AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), full_nodes AS MATERIALIZED (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (p)
), sums AS (
  SELECT p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY 1
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (p) LEFT JOIN nodes u ON u.p = n.p[1:n.d - 1] AND n.d > 0
"""
