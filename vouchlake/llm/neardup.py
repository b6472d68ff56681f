"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

Signature: POSITIONS minimum hashes of b = 16 bits. Distance: positions that differ. The
signature is cut into CHUNKS chunks of WIDTH positions. By the pigeonhole principle two
signatures at distance <= THRESHOLD = CHUNKS * (1 + 1) - 1 have a chunk with at most one
differing position, so every pair under the threshold meets in a bucket when each chunk
is keyed once for each position left out (the allowed error). At a Jaccard similarity of
0.8 a pair exceeds the threshold with a probability of about 3e-6.

What keeps it linear where groups are large:

- texts with the same shingle set are one node from the start;
- a shingle that no other candidate has cannot be shared. With u such shingles,
  J <= (n - u) / n, which removes most members of buckets that only share a passage, and
  the same count bounds each pair;
- in each bucket all members are compared with one hub (the member with the smallest
  share of unshared shingles); that is linear, and merges nearly everything;
- only where a bucket still holds several components are the remaining pairs examined,
  in blocks: pairs of different components, under the signature threshold and the
  bounds, confirmed on full sets. Only links that join components leave the task. A
  family of m sets is cut into LEAST_BLOCKS blocks, each set goes to that many tasks, and
  comparisons grow with m squared; more blocks are made only where a block would hold
  over BLOCK sets or BLOCK_BYTES, and from there rows grow with the square, too.

Sets are told apart by 128 bits and numbered; a bucket, hub or group of copies of any
size is not dealt to one task (`components.join_one`, and parts for the sets of hubs).

Words: maximal runs of bytes other than space and control white space, A-Z in lower
case. Null, empty and blank texts have no shingles and link with nothing. Rows with a
null doc_id take part as copies; a component's id is null only if all its ids are, and
kept compares nulls as equal. Rows that repeat are one node. Extra columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, join_one, labelled, star_edges
from .samples import read_table
from .workspace import cut, free_name, give_back, in_slices, worker_cache

CHUNKS, WIDTH = 12, 4
POSITIONS, THRESHOLD = CHUNKS * WIDTH, 2 * CHUNKS - 1
SHINGLE_WORDS, NUMERATOR = 4, 80
#: Of the bitmap that thins out the candidates' join.
FILTER_BITS = 1 << 24
#: Blocks of a family in the comparison of what the hubs left, and the most sets and bytes of one.
LEAST_BLOCKS, BLOCK, BLOCK_BYTES = 8, 16_384, 24 << 20
#: Pairs with one hub that a task confirms.
HUB_PAIRS = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            self[word] = value
        return value


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word sequences."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    memo = worker_cache("word-hashes", _WordHashes)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    take = min(words, len(h))
    total = np.zeros(len(h) - take + 1, np.uint64)
    for k in range(take):
        total += _mix(h[k : len(h) - take + 1 + k] + np.uint64(k)) * _PLACE[k]
    return np.unique(_mix(total + np.uint64(take)))


def _forget_words() -> None:
    """At a task's end: the words it met are forgotten and their memory given back; the worker's later stages would add theirs to it."""
    worker_cache("word-hashes", _WordHashes).clear()
    give_back()


def signature(ids: np.ndarray) -> np.ndarray:
    """b-bit minimum hashes; POSITIONS unsigned 16-bit values."""
    out = np.empty(POSITIONS, np.uint64)
    for at in range(0, POSITIONS, 16):  # a bounded matrix, also for very long texts
        out[at : at + 16] = np.minimum.reduce(
            [(ids[None, k : k + 65536] * _MULTIPLY[at : at + 16, None] + _ADD[at : at + 16, None]).min(axis=1) for k in range(0, len(ids), 65536)]
        )
    return (_mix(out) >> np.uint64(48)).astype(np.uint16)


def _set_id(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.tobytes(), digest_size=16).digest()


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sets, sig = [], [], []
            for text in b.column("text").to_pylist():
                ids = shingles(text, words)
                n.append(len(ids))
                sets.append(_set_id(ids) if len(ids) else None)
                sig.append(signature(ids).tobytes() if len(ids) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sig, pa.binary()), b.column("text_hash")],
                names=["doc_id", "n_shingles", "set_id", "sig", "text_hash"],
            )
        _forget_words()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node): each chunk of a signature, once for each position left out."""
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.int64)
        node = b.column("node").to_numpy()
        keys = []
        for chunk in range(CHUNKS):
            for error in range(WIDTH):
                key = np.full(len(sig), chunk * WIDTH + error, np.int64)
                for k in range(WIDTH):
                    if k != error:
                        key = key << 16 | sig[:, chunk, k]
                keys.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(node, len(keys)))], names=["key", "node"])


def _sets_of(words: int):
    """(node, n, sig, ids) of candidates: their sets once more, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            rows = []
            for node, set_id, text in zip(b.column("node").to_pylist(), b.column("set_id").to_pylist(), b.column("text").to_pylist()):
                ids = shingles(text, words)
                if len(ids) and _set_id(ids) == set_id:
                    rows.append((node, len(ids), signature(ids).tobytes(), ids.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                names=["node", "n", "sig", "ids"],
            )
        _forget_words()

    return run


def _explode_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in in_slices(batches):
        if b.num_rows:
            ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.repeat(b.column("node").to_numpy(), b.column("n").to_numpy()))], names=["id", "node"]
            )
    give_back()


def _reaches(shared: int, n: int, m: int, numerator: int) -> bool:
    return 100 * shared >= numerator * (n + m - shared)


def _confirm(numerator: int):
    """Links among candidate pairs: bounds and signature distance first, then the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            rows = []
            cols = {c: b.column(c).to_pylist() for c in b.schema.names}
            for k in range(b.num_rows):
                n, m = cols["n_a"][k], cols["n_b"][k]
                if not _reaches(min(cols["c_a"][k], cols["c_b"][k]), n, m, numerator):
                    continue
                x, y = np.frombuffer(cols["sig_a"][k], np.uint16), np.frombuffer(cols["sig_b"][k], np.uint16)
                if np.count_nonzero(x != y) > THRESHOLD:
                    continue
                shared = len(np.intersect1d(np.frombuffer(cols["ids_a"][k], np.uint64), np.frombuffer(cols["ids_b"][k], np.uint64), assume_unique=True))
                if _reaches(shared, n, m, numerator):
                    rows.append((cols["a"][k], cols["b"][k]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])
        give_back()

    return run


def _compare_blocks(numerator: int):
    """Links that join components among the members of two blocks (or within one)."""

    def links(i: int, j: int, part: pa.Table) -> list[tuple[int, int]]:
        part = part.sort_by("node")
        node, n, c, block = (part[x].to_numpy() for x in ("node", "n", "c", "block"))
        sig = np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint16).reshape(len(part), POSITIONS)
        flat, bounds = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in part["ids"]]), np.cumsum([0, *n])
        names, local = np.unique(flat, return_inverse=True)
        mark = np.zeros(len(names), bool)
        label, above, out = part["label"].to_pylist(), {}, []

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        first = np.array([root(x) for x in label])
        for u in range(len(part)):
            bound = np.minimum(c[u], c[u + 1 :])
            may = (first[u + 1 :] != first[u]) & (100 * bound >= numerator * (n[u] + n[u + 1 :] - bound))
            if i != j:
                may &= block[u + 1 :] != block[u]
            others = np.flatnonzero(may) + u + 1
            others = others[np.count_nonzero(sig[others] != sig[u], axis=1) <= THRESHOLD]
            if not len(others):
                continue
            mine = local[bounds[u] : bounds[u + 1]]
            mark[mine] = True
            for v in others.tolist():
                x, y = root(label[u]), root(label[v])
                if x != y and _reaches(int(np.count_nonzero(mark[local[bounds[v] : bounds[v + 1]]])), int(n[u]), int(n[v]), numerator):
                    above[max(x, y)] = min(x, y)
                    out.append((int(node[u]), int(node[v])))
            mark[mine] = False
        return out

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        found = links(key[1].as_py(), key[2].as_py(), part)
        if part.nbytes > 1 << 20:
            give_back()  # what was sorted there is several times as large
        return pa.table([pa.array([r[k] for r in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def describe(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, set_id (of the shingle set; null without words), sig, text_hash of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _describe(words), f"doc_id {kind}, n_shingles long, set_id binary, sig binary, text_hash long"
    )


def number_sets(described: DataFrame) -> DataFrame:
    """set_id, node (its number), n (rows that have it), least (doc_id), sig, and the row key and text hash of one such row."""
    reps = described.where("set_id IS NOT NULL").groupBy("set_id").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.max(F.struct("doc_id", "text_hash")).alias("at")
    )
    return cut(
        reps.select(
            "set_id", "n", "least", "sig", F.xxhash64("at.doc_id", "at.text_hash").alias("row"), F.col("at.text_hash").alias("text_hash"),
            F.monotonically_increasing_id().alias("node"),
        )
    )


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs without most rows whose key `row` is not wanted, before their texts are shuffled.

    A bitmap over hashes of the wanted keys, of FILTER_BITS bits whatever the table's size,
    is the only thing broadcast (2 MB at most). Rows that pass by chance, or all rows of a
    table so large that the bitmap is full, are left to the join that follows.
    """
    place = F.pmod(F.col("row"), F.lit(FILTER_BITS)) + 1
    marks = (
        wanted.select(place.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("marks"))
    )
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substr("marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = docs.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "bucket")
    return near.where(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1).select(docs.columns)


def in_blocks(sized: DataFrame, total: int) -> DataFrame:
    """node, label, cluster, block, i, j: every member once for each pair of blocks of its cluster that it takes part in.

    sized: node, label, cluster, n (shingles). Rows are LEAST_BLOCKS a member, while blocks of that many hold.
    """
    blocks = F.greatest(
        F.least(F.lit(LEAST_BLOCKS), F.ceil(F.count("*") / 256)), F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)
    )
    sizes = sized.groupBy("cluster").agg(F.count("*").alias("n"), blocks.cast("int").alias("blocks"))
    return (
        join_one(sized.select("node", "label", "cluster"), sizes, "cluster", total)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "label", "cluster", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )


def link_sets(docs: DataFrame, reps: DataFrame, words: int = SHINGLE_WORDS, numerator: int = NUMERATOR) -> DataFrame:
    """Links (a, b) between numbered sets with J >= numerator %, enough of them to hold every component together."""
    keys = reps.select("node", "sig").mapInArrow(_keys, "key long, node long")
    total = POSITIONS * reps.count()
    shared = cut(keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n"))
    members = cut(join_one(keys, shared, "key", total))

    wanted = reps.select("node", "set_id", "row", "text_hash").join(members.select("node").distinct(), "node", "left_semi")
    rows = docs.select(F.xxhash64("text").alias("text_hash"), "doc_id", "text").select(F.xxhash64("doc_id", "text_hash").alias("row"), "text_hash", "text")
    sets = cut(
        # rows that are equal in id and text become one before they are dealt
        _likely(rows, wanted).groupBy("row", "text_hash").agg(F.first("text").alias("text")).join(wanted, ["row", "text_hash"]).select("node", "set_id", "text")
        .mapInArrow(_sets_of(words), "node long, n long, sig binary, ids binary")
        .dropDuplicates(["node"])
    )
    lone = (
        sets.select("node", "n", "ids").mapInArrow(_explode_ids, "id long, node long")
        .groupBy("id").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1")
        .groupBy("node").agg(F.count("*").alias("lone"))
    )
    bounds = cut(
        sets.select("node", "n").join(lone, "node", "left")
        .withColumn("c", F.col("n") - F.coalesce("lone", F.lit(0)))
        .where(100 * F.col("c") >= numerator * F.col("n"))
        .select("node", "n", "c")
    )
    alive = sets.select("node", "sig", "ids").join(bounds, "node")

    # all members of a bucket against its hub
    at = members.join(bounds, "node")
    hubs = cut(at.groupBy("key").agg(F.min_by("node", F.struct(F.lit(1) - F.col("c") / F.col("n"), "node")).alias("hub"), F.count("*").alias("n")).where("n > 1"))
    pairs = cut(join_one(at.select("key", "node"), hubs, "key", total).where("node <> hub").select("node", "hub").distinct())
    # a hub's set is laid beside its pairs in parts of bounded size
    often = cut(pairs.groupBy("hub").agg(F.count("*").alias("n"), F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts")))
    side = lambda s, k: s.select(F.col("node").alias(k), *(F.col(x).alias(f"{x}_{k}") for x in ("n", "c", "sig", "ids")))
    placed = join_one(pairs, often, "hub", total).select(F.col("node").alias("a"), F.col("hub").alias("b"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    of_hubs = side(alive, "b").join(often.select(F.col("hub").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "b")
    links = cut(placed.join(side(alive, "a"), "a").join(of_hubs, ["b", "part"]).mapInArrow(_confirm(numerator), "a long, b long"))

    # what the hubs left: buckets with several components
    label = cut(labelled(bounds.select("node"), components(links), "label"))
    mixed = at.select("key", "node").join(label, "node")
    several = cut(
        mixed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi AND n > 2").select("key", "n")
    )
    remaining = cut(join_one(mixed, several, "key", total).select("key", "node"))
    clusters = components(star_edges(remaining, "key", "node", total)).withColumnRenamed("root", "cluster")
    sized = cut(clusters.join(label, "node").join(bounds.select("node", "n"), "node"))
    blocked = in_blocks(sized, total).join(alive, "node")
    rest = blocked.groupBy("cluster", "i", "j").applyInArrow(_compare_blocks(numerator), "a long, b long")
    return links.unionByName(rest)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, numerator: int = NUMERATOR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; also component (null without words) and text_hash."""
    described = cut(describe(docs, words))
    reps = number_sets(described)
    roots = components(link_sets(docs, reps, words, numerator))
    marked = cut(labelled(reps.select("node", "set_id", "n", "least"), roots, "component"))
    ids = marked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    rows = described.count()
    by_set = cut(join_one(marked.withColumnRenamed("n", "copies"), ids, "component", rows).select("set_id", "component", "component_id", F.col("copies").alias("n")))
    worded = join_one(described.where("set_id IS NOT NULL").drop("sig"), by_set, "set_id", rows)
    bare = described.where("set_id IS NULL").drop("sig").select("*", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return worded.unionByName(bare).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component", "text_hash"
    )


def keep_first(docs: DataFrame, words: int = SHINGLE_WORDS, numerator: int = NUMERATOR) -> DataFrame:
    """One document of each group, all columns; texts without words all stay.

    The one that stays has the group's smallest doc_id; if that id is on several rows, one of them.
    """
    found = near_duplicates(docs, words, numerator)
    row, text = free_name("row", docs.columns), free_name("text_hash", docs.columns)
    stays = (
        found.where("kept AND component IS NOT NULL").groupBy("component")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("s"))
        .select(F.xxhash64("s.doc_id", "s.text_hash").alias(row), F.col("s.text_hash").alias(text))
    )
    bare = F.col("text").isNull() | (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) == 0)
    keyed = docs.where(~bare).withColumn(text, F.xxhash64("text")).withColumn(row, F.xxhash64("doc_id", text))
    # joined and made unique by the same key: the texts are shuffled once
    worded = keyed.join(stays, [row, text]).dropDuplicates([row, text]).select(*docs.columns)
    return worded.unionByName(docs.where(bare))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
