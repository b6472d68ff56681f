"""Size-tiered compaction of a table of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet files that never change. Files of similar size
form a tier; when a tier has `fanout` files they are merged into one run of target-sized
files. Only the manifest says which files are the table: a new version is written beside
the old one and renamed into place, which fails if another writer was first, so readers
see either all of a change or nothing of it. A writer that was not first adds its change
to the version that was: an append always can, a merge can while its inputs still live.

A version stays readable for a grace period after the next one is there, and files
younger than that are never swept, since a writer may have them without having committed
them yet. The rename must be atomic and refuse to replace: so it is on HDFS and local
disks; on object stores it is not, and a store there needs one writer at a time.

Rows are copied as they are: nulls, empty and long texts, repeated rows and extra
columns of any name stay. An empty arrival adds no file. A merge that does not give back
as many rows as it read is not committed.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import read_table
from .workspace import fresh_path

#: Production parameters.
SMALL, TARGET, FANOUT, ARRIVAL_ROWS = 4 << 20, 128 << 20, 4, 4096
#: Seconds that replaced versions and uncommitted files are kept; times a lost commit is tried again.
GRACE, ATTEMPTS = 24 * 3600, 50
#: Merges that share a Spark job; bounds the plan.
MERGES_A_JOB = 64


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    rows: int


class Files:
    """The little of Hadoop's file systems that a manifest needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.hadoop.Path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.hadoop.Path(name)

    def list(self, folder: str) -> list[tuple[str, int]]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted((str(s.getPath()), s.getLen()) for s in self.fs.listStatus(self.path(folder)) if not s.getPath().getName().startswith(("_", ".")))

    def age(self, name: str) -> float:
        """Seconds since a file, or any file of a folder, was written."""
        status = self.fs.getFileStatus(self.path(name))
        times = [status.getModificationTime()]
        if status.isDirectory():
            times += [s.getModificationTime() for s in self.fs.listStatus(self.path(name))]
        return max(0.0, time.time() - max(times) / 1000)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """All of the text under a name that must be new, or nothing."""
        draft = f"{name}.draft-{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            context.rename(self.path(draft), self.path(name), none)
        except Exception as e:
            self.fs.delete(self.path(draft), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def tier_of(size: int, small: int = SMALL, fanout: int = FANOUT) -> int:
    """0 up to `small` bytes, one more for each power of `fanout` beyond."""
    return 0 if size <= small else 1 + math.floor(math.log(size / small, fanout))


def plan_merges(shards: list[Shard], small: int = SMALL, target: int = TARGET, fanout: int = FANOUT) -> list[list[Shard]]:
    """Groups of `fanout` files of one tier, smallest first; files of half the target or more rest."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if 2 * s.size < target:
            tiers.setdefault(tier_of(s.size, small, fanout), []).append(s)
    out = []
    for tier in sorted(tiers):
        members = sorted(tiers[tier], key=lambda s: (s.size, s.path))
        out += [members[k : k + fanout] for k in range(0, len(members) - fanout + 1, fanout)]
    return out


@contextmanager
def _apart(spark: SparkSession):
    """Within, a union keeps the partitions of its parts apart, also where each has just one."""
    key = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class ShardStore:
    """A table of shards below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, small: int = SMALL, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.small, self.target, self.fanout = small, target, fanout

    def versions(self) -> list[int]:
        return [int(m[1]) for p, _ in self.files.list(f"{self.root}/manifest") if (m := re.search(r"/v(\d+)\.json$", p))]

    def shards(self, version: int | None = None) -> list[Shard]:
        """The files of a version (the newest by default)."""
        known = self.versions()
        if not known:
            return []
        name = f"{self.root}/manifest/v{max(known) if version is None else version:012d}.json"
        return [Shard(**s) for s in json.loads(self.files.read(name))["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Version base + 1; raises Conflict if it is already there."""
        text = json.dumps({"version": base + 1, "shards": [asdict(s) for s in shards]})
        self.files.write_new(f"{self.root}/manifest/v{base + 1:012d}.json", text)
        return base + 1

    def _written(self, folder: str) -> list[Shard]:
        """The files of a finished write with their sizes and row counts (from the footers)."""
        found = [(p, n) for p, n in self.files.list(folder) if p.endswith(".parquet")]
        if not found:
            return []
        counted = self.spark.read.parquet(*(p for p, _ in found)).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"))
        rows = {r["f"]: r["n"] for r in counted.collect()}  # one row a file of this write
        return [Shard(p, size, rows[p.rsplit("/", 1)[1]]) for p, size in found if rows.get(p.rsplit("/", 1)[1])]

    def change(self, edit: Callable[[list[Shard]], list[Shard] | None]) -> int | None:
        """Commits edit(files of the newest version), again on a newer one whenever another writer was first; None if edit gives None."""
        for _ in range(ATTEMPTS):
            base = max(self.versions(), default=0)
            after = edit(self.shards(base) if base else [])
            if after is None:
                return None
            try:
                return self.commit(base, after)
            except Conflict:
                continue
        raise Conflict(f"another writer was first {ATTEMPTS} times")

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Adds the rows as small shards of at most `rows` rows; the new version."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(folder)
        new = self._written(folder)
        return self.change(lambda now: [*now, *new])

    def merge(self, groups: list[list[Shard]]) -> list[Shard]:
        """New files with the rows of the groups; each group's go to files of about the target size."""
        out: list[Shard] = []
        for at in range(0, len(groups), MERGES_A_JOB):
            part = groups[at : at + MERGES_A_JOB]
            runs = []
            for g in part:
                files = max(1, round(sum(s.size for s in g) / self.target))
                runs.append(self.spark.read.parquet(*(s.path for s in g)).coalesce(files))
            folder = f"{self.root}/shards/{uuid.uuid4().hex}"
            with _apart(self.spark):
                reduce(DataFrame.unionByName, runs).write.parquet(folder)
            made = self._written(folder)
            if sum(s.rows for s in made) != sum(s.rows for g in part for s in g):
                raise RuntimeError("a merge lost or gained rows")
            out += made
        return out

    def compact(self) -> bool:
        """One round of merges and its commit; False if no tier is full.

        If another writer has replaced an input meanwhile, this round's files are dropped;
        the next round starts from what is there then.
        """
        groups = plan_merges(self.shards(), self.small, self.target, self.fanout)
        if not groups:
            return False
        gone = {s.path for g in groups for s in g}
        made = self.merge(groups)

        def edit(now: list[Shard]) -> list[Shard] | None:
            if not gone <= {s.path for s in now}:
                return None
            return [*(s for s in now if s.path not in gone), *made]

        if self.change(edit) is None:
            for s in made:
                self.files.delete(s.path)
        return True

    def sweep(self, keep: int = 1, grace: float = GRACE) -> int:
        """Deletes old manifests, and old files that no kept one names; how many files.

        Kept are the newest `keep` versions, and those that were replaced less than `grace`
        seconds ago. Files of a write folder are old `grace` seconds after its last change.
        Zero is for a store that nobody else reads or writes.
        """
        known = sorted(self.versions())
        name = lambda v: f"{self.root}/manifest/v{v:012d}.json"
        old = [v for v, following in zip(known, known[1:]) if v in known[:-keep] and self.files.age(name(following)) >= grace]
        live = {s.path for v in known if v not in old for s in self.shards(v)}
        for v in old:
            self.files.delete(name(v))
        dead = 0
        for folder, _ in self.files.list(f"{self.root}/shards"):
            if self.files.age(folder) < grace:
                continue
            inside = [p for p, _ in self.files.list(folder)]
            stale = [p for p in inside if p not in live]
            if len(stale) == len(inside):
                self.files.delete(folder)
            else:
                for p in stale:
                    self.files.delete(p)
            dead += len(stale)
        return dead

    def read(self, like: DataFrame) -> DataFrame:
        """The table; `like` gives the schema where there are no files."""
        shards = self.shards()
        return self.spark.read.schema(like.schema).parquet(*(s.path for s in shards)) if shards else like.limit(0)


def compacted(docs: DataFrame, root: str | None = None, rows: int = ARRIVAL_ROWS, **sizes: int) -> tuple[ShardStore, DataFrame]:
    """The rows appended to a store and compacted until no tier is full; the store and its table.

    Without `root` the store is new and known to nobody else, so what a round replaces is
    swept at once; a store at `root` keeps it for the grace period.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or fresh_path(spark, "shards"), **sizes)
    store.append(docs, rows)
    while store.compact():
        store.sweep(grace=GRACE if root else 0)
    return store, store.read(docs)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, table = compacted(read_table(spark, sf_dir, "documents"))
    return table.select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP8_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
