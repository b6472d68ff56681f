"""Where the operators cut lineage: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set: a local one on a single machine, an error on a cluster."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not (own := spark.sparkContext.getCheckpointDir()):
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vouchlake-"))
            own = spark.sparkContext.getCheckpointDir()
        return own
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def free_name(wanted: str, taken: list[str]) -> str:
    """`wanted`, with underscores in front until no column is called so."""
    while wanted.lower() in {t.lower() for t in taken}:
        wanted = "_" + wanted
    return wanted


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder; lost executors don't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/vouchlake-{name}-{uuid.uuid4().hex}"


def worker_cache(key: str, make):
    """make() once in the life of a Python worker; later tasks of that worker find it."""
    import sys
    import types

    name = "_vouchlake_worker_cache"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most 4 MB and 2000 rows, so that a task's memory doesn't depend on their length."""
    for key, most in (("maxBytesPerBatch", 4 << 20), ("maxRecordsPerBatch", 2000)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).rstrip("b")  # with another unit, somebody chose it
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def in_slices(batches, rows: int = 256):
    """The batches in slices of so many rows, so that what is made of one is small beside it."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Return what this process has freed to the machine. Allocators keep it otherwise, and what the worker loads for a later stage comes on top."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
