"""Media columns: texts stored as lossless WebP images, and what is read back from them.

`store` turns the UTF-8 bytes of a text, filled up with bytes 255 to a positive multiple
of 576, into grey images 576 samples wide, at most ROWS high; a longer payload is a run
of such files, one after the other. `read` decodes any run of lossless WebP files and
computes digests and features of the green samples. `pixels` gives the pixel arrays of
any column of such files, with all four channels.

Null text counts as empty (one row of 255). Rows repeat as often as they come; extra
columns are not carried. An empty table gives no rows. Null media have no pixels; bytes
that aren't a lossless WebP file end the job with an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .samples import read_table
from .webp import decode, encode_grey

UNIT, ROWS, FILL = 576, 512, 255


def payload_of(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace")
    return np.frombuffer(raw + bytes([FILL]) * (-len(raw) % UNIT if raw else UNIT), np.uint8)


def encode_payload(payload: np.ndarray) -> bytes:
    step = UNIT * ROWS
    return b"".join(encode_grey(payload[at : at + step], UNIT) for at in range(0, len(payload), step))


def files_of(media: bytes) -> Iterator[bytes]:
    """The files of a run, by the sizes in their headers."""
    at = 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at:end]
        at = end


def decode_payload(media: bytes) -> np.ndarray:
    """The green samples of all files of a run."""
    return np.concatenate([(decode(f)[2] >> np.uint32(8)).astype(np.uint8) for f in files_of(media)])


def feature_of(samples: np.ndarray) -> str:
    """Size, mean, deviation and mean step between neighbours of the grey image, in thousandths."""
    wide = samples.astype(np.int64)
    n, total = len(wide), int(wide.sum())
    spread = int((wide * wide).sum()) * n - total * total
    step = int(np.abs(np.diff(wide)).sum())
    return f"{UNIT}x{n // UNIT};mean={total * 1000 // n};var={spread * 1000 // (n * n)};step={step * 1000 // n};levels={len(np.unique(samples))}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len((t or "").encode("utf-8", "replace")) for t in texts], pa.int64()),
                        pa.array([encode_payload(payload_of(t)) for t in texts], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and sizes, digests and a feature of the decoded samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media in b.column("media").to_pylist():
                samples = decode_payload(media)
                raw = samples.tobytes()
                rows.append(
                    (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples))
                )
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def pixels(stored: DataFrame) -> DataFrame:
    """doc_id, part (place in the run), width, height, rgba (binary: red, green, blue and alpha of each pixel, row by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, media in enumerate(b.column("media").to_pylist()):
                for part, one in enumerate(files_of(media or b"")):
                    width, height, argb = decode(one)
                    rgba = (argb << np.uint32(8) | argb >> np.uint32(24)).astype(">u4").tobytes()
                    sizes = (pa.array([x], pa.int32()) for x in (part, width, height))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").slice(k, 1), *sizes, pa.array([rgba], pa.binary())],
                        names=["doc_id", "part", "width", "height", "rgba"],
                    )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, part int, width int, height int, rgba binary")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(store(read_table(spark, sf_dir, "documents")))
