"""Token-id output: best-fit-decreasing packing into id matrices, found with a segment tree.

Each task tokenises its documents and gathers their ids until it holds
`rows * window` of them; then it packs those pieces, writes the matrix out and goes on.
Memory is bounded by that parameter, nothing is shuffled, and a task that is run
again gives the same rows. Documents longer than a window are cut at full windows;
every id lies in exactly one segment.

`write_files` stores such rows as flat binary files (ids, positions, segment lengths)
with a manifest that only a finished write has; `read_files` gives the rows back.

Null and empty texts give no segment unless an end id is asked for (the default asks
for it: such a document is its end id alone). Rows repeat as often as they come.
Extra columns are not carried. An empty table gives no rows. Ids and positions take
two bytes each, or four where the vocabulary or the window is over 65,536.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .samples import read_table
from .tokens import tokenizer, vocabulary_bytes

#: Production parameters: ids in a row, rows that are packed at once, end id.
WINDOW, ROWS, END_ID = 2048, 2048, 50256


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """(bin of each length, number of bins).

    Longest first, each into the bin with the least room that still holds it. A segment
    tree over room sizes counts the open bins with exactly that room; the search for the
    smallest sufficient room goes up and then down the tree, so a step costs log(window).
    """
    size = 1 << int(window).bit_length()
    tree = [0] * (2 * size)
    open_bins: list[list[int]] = [[] for _ in range(window + 1)]
    out = np.zeros(len(lengths), np.int64)
    bins = 0

    def add(room: int, n: int) -> None:
        at = room + size
        while at:
            tree[at] += n
            at >>= 1

    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        at = need + size
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at > 1:
                at += 1
                while at < size:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
            else:
                at = 0
        if at and at - size <= window:
            room = at - size
            b = open_bins[room].pop()
            add(room, -1)
        else:
            room, b, bins = window, bins, bins + 1
        out[k] = b
        if room > need:
            open_bins[room - need].append(b)
            add(room - need, 1)
    return out, bins


def width_of(values: int) -> np.dtype:
    """The little-endian type of numbers below `values`."""
    return np.dtype("<u2" if values <= 1 << 16 else "<u4")


def _packed(pieces: list[tuple[object, int, np.ndarray]], window: int, pad_id: int) -> tuple[np.ndarray, list[list[int]]]:
    """(id matrix, the pieces of each row in order) of (doc_id, start, ids) pieces."""
    lengths = np.array([len(p[2]) for p in pieces])
    where, bins = best_fit_decreasing(lengths, window)
    rows: list[list[int]] = [[] for _ in range(bins)]
    for k, b in enumerate(where.tolist()):
        rows[b].append(k)
    matrix = np.full((bins, window), pad_id, pieces[0][2].dtype)
    for b, members in enumerate(rows):
        at = 0
        for k in members:
            matrix[b, at : at + lengths[k]] = pieces[k][2]
            at += lengths[k]
    return matrix, rows


def token_matrices(docs: DataFrame, window: int = WINDOW, rows: int = ROWS, end_id: int | None = END_ID, path: str | None = None) -> DataFrame:
    """One row a packed sequence.

    sequence_id; n_tokens; input_ids (little-endian unsigned integers of `width_of` the
    vocabulary, padded with 0 to the window); cu_seqlens (0, then the end of each segment);
    position_ids (of `width_of` the window, from 0 at each segment); doc_ids and starts
    (of each segment, and how many ids of its document come before it).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    kind = docs.schema["doc_id"].dataType
    names = ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "starts"]

    def emit(pieces, base: int, doc_kind: pa.DataType) -> pa.RecordBatch:
        matrix, members = _packed(pieces, window, 0)
        cu = [np.cumsum([0, *(len(pieces[k][2]) for k in m)]).astype(np.int32) for m in members]
        positions = []
        for c in cu:
            p = np.zeros(window, width_of(window))
            for a, b in zip(c[:-1], c[1:]):
                p[a:b] = np.arange(b - a)
            positions.append(p.tobytes())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(base, base + len(members)), pa.int64()),
                pa.array([int(c[-1]) for c in cu], pa.int32()),
                pa.array([r.tobytes() for r in matrix], pa.binary()),
                pa.array(cu, pa.list_(pa.int32())),
                pa.array(positions, pa.binary()),
                pa.array([[pieces[k][0] for k in m] for m in members], pa.list_(doc_kind)),
                pa.array([[pieces[k][1] for k in m] for m in members], pa.list_(pa.int64())),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(shared.value)
        kind_of_id = width_of(max(bpe.size, 1 + (end_id or 0)))
        base = TaskContext.get().partitionId() << 33
        pieces, held, doc_kind = [], 0, None
        for b in batches:
            doc_kind = b.column("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = bpe.encode(text)
                if end_id is not None:
                    ids = np.append(ids, end_id)
                ids = ids.astype(kind_of_id)
                for start in range(0, len(ids), window):
                    pieces.append((doc_id, start, ids[start : start + window]))
                held += len(ids)
                if held >= rows * window:
                    yield (out := emit(pieces, base, doc_kind))
                    base += out.num_rows
                    pieces, held = [], 0
        if pieces:
            yield emit(pieces, base, doc_kind)

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, "
        f"doc_ids array<{kind.simpleString()}>, starts array<long>",
    )


# ---- binary files


def _open(uri: str):
    """(file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_files(matrices: DataFrame, folder: str) -> dict:
    """Rows of `token_matrices` as flat files below `folder`; the manifest that names them.

    Each task writes a file of its own for ids, positions, cumulative segment lengths
    (unsigned 32-bit, one more than segments a row) and row bounds within those; names are
    new for every attempt. `manifest.json` is written last and lists the files of the
    attempts that counted, so a lost executor or a failed job leaves files that no
    manifest names. The driver gets one row a task.
    """
    spark = matrices.sparkSession
    if "://" not in folder and not folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a folder without a scheme is each machine's own; name one that all of them share")
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    names = ("input_ids", "position_ids", "cu_seqlens", "bounds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        part, rows, segments, crc, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, 0, 0, {}
        window = ids_width = positions_width = 0
        for b in batches:
            if not b.num_rows:
                continue
            if not out:
                out = {n: system.open_output_stream(f"{root}/{part}.{n}") for n in names}
                out["bounds"].write(np.zeros(1, "<u8").tobytes())
            cu = b.column("cu_seqlens").to_pylist()
            ids, positions = b"".join(b.column("input_ids").to_pylist()), b"".join(b.column("position_ids").to_pylist())
            ids_width, positions_width = len(ids) // b.num_rows, len(positions) // b.num_rows
            out["input_ids"].write(ids)
            out["position_ids"].write(positions)
            out["cu_seqlens"].write(np.array([v for c in cu for v in c], "<u4").tobytes())
            out["bounds"].write((np.cumsum([len(c) for c in cu]) + segments).astype("<u8").tobytes())
            crc, rows, segments = zlib.crc32(ids, crc), rows + b.num_rows, segments + sum(map(len, cu))
        for stream in out.values():
            stream.close()
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip((part, rows, ids_width, positions_width, crc), kinds)],
                names=["part", "rows", "ids_bytes", "positions_bytes", "ids_crc32"],
            )

    written = matrices.select("input_ids", "position_ids", "cu_seqlens").mapInArrow(
        run, "part string, rows long, ids_bytes long, positions_bytes long, ids_crc32 long"
    )
    manifest = {"parts": [r.asDict() for r in sorted(written.collect())]}
    draft = f"{root}/manifest-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as stream:
        stream.write(json.dumps(manifest).encode())
    system.move(draft, f"{root}/manifest.json")
    return manifest


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """part, row, input_ids, position_ids, cu_seqlens of every row of a finished write; raises where the ids were altered."""
    system, root = _open(folder)
    with system.open_input_stream(f"{root}/manifest.json") as stream:
        parts = json.loads(stream.read())["parts"]
    schema = "part string, row long, input_ids binary, position_ids binary, cu_seqlens array<int>"
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for b in batches:
            for p in b.to_pylist():
                files = {n: system.open_input_file(f"{root}/{p['part']}.{n}") for n in ("input_ids", "position_ids", "cu_seqlens", "bounds")}
                crc = 0
                for at in range(0, p["rows"], 512):  # a bounded piece at a time
                    n = min(512, p["rows"] - at)
                    bounds = np.frombuffer(files["bounds"].read_at(8 * (n + 1), 8 * at), "<u8").astype(np.int64)
                    cu = np.frombuffer(files["cu_seqlens"].read_at(4 * int(bounds[-1] - bounds[0]), 4 * int(bounds[0])), "<u4").astype(np.int32)
                    ids = files["input_ids"].read_at(n * p["ids_bytes"], at * p["ids_bytes"])
                    crc = zlib.crc32(ids, crc)
                    positions = files["position_ids"].read_at(n * p["positions_bytes"], at * p["positions_bytes"])
                    cut = lambda raw, w: pa.array([raw[k * w : (k + 1) * w] for k in range(n)], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p["part"]] * n), pa.array(np.arange(at, at + n), pa.int64()), cut(ids, p["ids_bytes"]), cut(positions, p["positions_bytes"]),
                            pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(cu)),
                        ],
                        names=["part", "row", "input_ids", "position_ids", "cu_seqlens"],
                    )
                if crc != p["ids_crc32"]:
                    raise ValueError(f"the ids of {p['part']} were altered")

    table = spark.createDataFrame([(p["part"], p["rows"], p["ids_bytes"], p["positions_bytes"], p["ids_crc32"]) for p in parts], "part string, rows long, ids_bytes long, positions_bytes long, ids_crc32 long")
    return table.repartition(len(parts), "part").mapInArrow(run, schema)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrices(read_table(spark, sf_dir, "documents"))
