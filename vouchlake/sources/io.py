"""Readers and writers: run folders, labels, exports, rules, ledgers; nothing leaves without the gate."""

from __future__ import annotations

import json
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.functions.columns import blank, lookup
from vouchlake.operators.privacy import leaking
from vouchlake.plans.rules import Rule, validate_rules

META = "run_id string, ts timestamp, doc_class string, file_name string, doc_type string, verdict string, tier string, duration_s double"
FINDING = "run_id string, rule_id string, severity string, verdict_effect string, message string, detail string, field string"
LABEL = (
    "label_id string, doc_sha256 string, ts timestamp, doc_class string, doc_type_gold string, verdict_gold string, "
    "stage_a_excerpt string, scenarios array<string>, reviewer string, notes string, confirmed boolean"
)
RULE = (
    "doc_class string, rule_id string, name string, tier string, source string, applies_to array<string>, op string, subject string, "
    "severity string, verdict_effect string, message string, field string, args map<string,string>"
)
MOST_RULES = 10_000
# Headings of exports and the technical names they stand for.
ALIASES = {
    "partner": "PARTNER", "business partner": "PARTNER", "bkvid": "BKVID", "bank details id": "BKVID", "banks": "BANKS",
    "bank country region": "BANKS", "bank country": "BANKS", "bankl": "BANKL", "bank key": "BANKL", "bankn": "BANKN", "bank acct": "BANKN",
    "bank account number": "BANKN", "bank account": "BANKN", "bkont": "BKONT", "bank control key": "BKONT", "bkref": "BKREF",
    "reference details": "BKREF", "koinh": "KOINH", "account holder name": "KOINH", "account holder": "KOINH", "accname": "ACCNAME",
    "account name": "ACCNAME", "iban": "IBAN", "banking type": "BANKING_TYPE", "bank account type": "BANKING_TYPE", "type": "TYPE",
    "partner cat": "TYPE", "partner category": "TYPE", "bu group": "BU_GROUP", "grouping": "BU_GROUP", "name org1": "NAME_ORG1",
    "name 1": "NAME_ORG1", "name org2": "NAME_ORG2", "name 2": "NAME_ORG2", "name org3": "NAME_ORG3", "name 3": "NAME_ORG3",
    "name org4": "NAME_ORG4", "name 4": "NAME_ORG4", "name last": "NAME_LAST", "last name": "NAME_LAST", "name first": "NAME_FIRST",
    "first name": "NAME_FIRST", "bu fullname": "BU_FULLNAME", "full name": "BU_FULLNAME", "bu sort1": "BU_SORT1", "search term 1": "BU_SORT1",
    "xblck": "XBLCK", "central block": "XBLCK", "xdele": "XDELE", "archiving flag": "XDELE", "natpers": "NATPERS", "natural person": "NATPERS",
    "legal entity": "LEGAL_ENTITY",
}


def load_runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(runs, findings) of run folders that hold both files in readable form."""
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run_id")

    def parsed(name: str, schema: str) -> DataFrame:
        files = spark.read.text(f"{root}/*/{name}", wholetext=True)
        return files.select(run, F.from_json("value", schema).alias("j")).where("j IS NOT NULL")

    fields = lambda schema: ", ".join(c for c in schema.split(", ") if not c.startswith("run_id "))
    meta = parsed("meta.json", fields(META)).select("run_id", "j.*").where("doc_class IS NOT NULL OR verdict IS NOT NULL")
    found = parsed("findings.json", "array<struct<" + fields(FINDING).replace(" string", ":string") + ">>")
    both = meta.join(found.select("run_id"), "run_id", "left_semi")
    fired = found.join(both.select("run_id"), "run_id", "left_semi").select("run_id", F.inline("j"))
    return both, fired.where(~blank(F.col("rule_id")))


def load_labels(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Labels from JSON lines; broken lines are left out (see `part_lines`), or an error where `strict`."""
    if strict:
        return spark.read.schema(LABEL).option("mode", "FAILFAST").json(path).withColumn("stratum", F.lit("synthetic"))
    return part_lines(spark, path, LABEL)[0]


def part_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken) of JSON lines: what parses, and file and value of each line that doesn't. Empty lines are neither."""
    lines = spark.read.text(path).where(~blank(F.col("value"))).select(F.col("_metadata.file_path").alias("file"), "value")
    read = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    parsed = lines.withColumn("j", read)
    return parsed.where("j._broken IS NULL").select("j.*").drop("_broken"), parsed.where("j._broken IS NOT NULL").select("file", "value")


def quarantine_lines(broken: DataFrame, path: str) -> DataFrame:
    """Keeps broken lines as they are below `path`; file, n of what was kept there this time. The driver gets nothing."""
    stamp = F.sha2(F.concat_ws("\n", "file", "value"), 256)
    broken.withColumn("line_id", stamp).write.mode("append").parquet(path)
    kept = broken.sparkSession.read.parquet(path).join(broken.select(stamp.alias("line_id")).distinct(), "line_id", "left_semi")
    return kept.dropDuplicates(["line_id"]).groupBy("file").agg(F.count("*").alias("n"))


def canonical(name: Column) -> Column:
    """The technical name of a heading, null for an unknown one."""
    return lookup(ALIASES, F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")))


def export_kind(columns: list[str]) -> str:
    """BANK or PARTNER, by the columns an export has."""
    have = set(columns)
    if have & {"BANKN", "BKVID"}:
        return "BANK"
    if have & {"NAME_ORG1", "BU_FULLNAME"} and "TYPE" in have:
        return "PARTNER"
    raise ValueError(f"neither a bank nor a partner export: {sorted(have)}")


def load_erp_export(spark: SparkSession, path: str, most_columns: int = 256) -> tuple[str, DataFrame]:
    """(kind, rows in technical names) of CSV exports; each file's heading is the first of its first eight lines with three known columns.

    Files may order their columns differently or lack some, which are empty then, but all
    must be of one kind. A row takes one line. Only the headings' names reach the driver.
    What stands before a heading and empty rows are dropped; whole numbers lose a trailing
    .0; true and false become X and ''.
    """
    # A line's place in its file: the block it is read with, then its number there.
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place"))
    cells = F.from_csv("value", F.lit(", ".join(f"c{k} string" for k in range(most_columns))))
    rows = lines.withColumn("j", cells).select("file", "place", F.array(*(F.col(f"j.c{k}") for k in range(most_columns))).alias("cells"))
    keys = F.transform("cells", canonical)
    named = rows.withColumn("keys", keys).withColumn("known", F.size(F.array_distinct(F.array_compact("keys"))) >= 3)
    heads = named.groupBy("file").agg(F.min("place").alias("first"), F.min(F.when(F.col("known"), F.struct("place", "keys"))).alias("head"))
    early = (F.col("head.place.block") == F.col("first.block")) & (F.col("head.place.line") - F.col("first.line") < 8)
    heads = heads.select("file", F.when(early, F.col("head")).alias("head"))
    layouts = [r.k for r in heads.select(F.array_sort(F.array_distinct(F.array_compact("head.keys"))).alias("k")).distinct().collect()]
    if not layouts or None in layouts:
        raise ValueError("no heading among the first eight lines")
    kinds = {export_kind(k) for k in layouts}
    if len(kinds) > 1:
        raise ValueError("bank and partner exports under one path")
    clean = lambda c: F.regexp_replace(F.when(F.lower(c) == "true", "X").when(F.lower(c) == "false", "").otherwise(F.coalesce(F.trim(c), F.lit(""))), r"^(-?\d+)\.0$", "$1")
    known = sorted({n for k in layouts for n in k})
    body = rows.join(heads, "file").where(F.col("place") > F.col("head.place"))
    # array_position gives 0 for a column that the file lacks; get then asks for -1 and returns null
    at = lambda n: F.get("cells", F.coalesce(F.array_position("head.keys", n), F.lit(0)).cast("int") - 1)
    return kinds.pop(), body.select(*(clean(at(n)).alias(n) for n in known)).where(F.concat(*(F.col(n) for n in known)) != "")


def load_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """The rules of JSON-lines files, in the order of class and id, for `apply_rules`.

    A rule table is configuration: it is read on the driver, and more than `MOST_RULES`
    rules are an error, as are broken lines, two rules of one id and what `validate_rules` finds.
    """
    raw = spark.read.schema(RULE).option("mode", "FAILFAST").json(path).limit(MOST_RULES + 1)
    rows = raw.collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    issues = [f"{r.rule_id}: {r.issue}" for r in validate_rules(spark.createDataFrame(rows, RULE)).collect()]
    twice = [k for k, n in Counter((r.doc_class, r.rule_id) for r in rows).items() if n > 1]
    if issues or twice:
        raise ValueError("; ".join([*issues, *(f"{c}:{i}: given twice" for c, i in twice)]))
    args = lambda r: {k: json.loads(v) for k, v in (r.args or {}).items()}
    return tuple(
        Rule(
            r.doc_class, r.rule_id, r.name or r.rule_id, r.tier or "experimental", r.source or "policy", tuple(r.applies_to or ()), r.op, r.subject or "",
            r.severity, r.verdict_effect, r.message or "", r.field or "", args(r),
        )
        for r in sorted(rows, key=lambda r: (r.doc_class or "", r.rule_id))
    )


def save_rules(spark: SparkSession, rules: tuple[Rule, ...], path: str) -> None:
    """Rules as JSON lines that `load_rules` reads."""
    row = lambda r: (r.doc_class, r.rule_id, r.name, r.tier, r.source, list(r.applies_to), r.op, r.subject, r.severity, r.verdict_effect, r.message, r.field)
    rows = [(*row(r), {k: json.dumps(v) for k, v in r.args.items()}) for r in rules]
    spark.createDataFrame(rows, RULE).coalesce(1).write.json(path)


def load_approvals(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """The ledger: class, rule, status, hash, by. An unreadable file leaves its rules pending.

    With `quarantine`, the bytes of unreadable files are kept below that folder, each
    content once, so that what operators decided is not lost with a damaged file.
    """
    entry = "map<string,struct<status:string,hash:string,note:string,by:string,ts:timestamp>>"
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.from_json(F.col("content").cast("string"), entry).alias("m"))
    if quarantine is not None:
        broken = files.where("m IS NULL").select("path", "content", F.sha2("content", 256).alias("content_id"))
        files_of = Folder(spark, quarantine)
        if files_of.exists():
            broken = broken.join(spark.read.parquet(quarantine).select("content_id"), "content_id", "left_anti")
        broken.write.mode("append").parquet(quarantine)
    raw = files.where("m IS NOT NULL")
    return raw.select(F.explode("m").alias("key", "e")).select(
        F.split_part("key", F.lit(":"), F.lit(1)).alias("doc_class"), F.split_part("key", F.lit(":"), F.lit(2)).alias("rule_id"), "e.*"
    )


def load_eval_history(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows of the append log; bad lines are skipped."""
    return spark.read.schema("stream string, run_tag string, ts timestamp, metric string, value double").option("mode", "DROPMALFORMED").json(path)


def latest_metrics(history: DataFrame) -> DataFrame:
    return history.groupBy("stream", "metric").agg(F.max_by("value", "ts").alias("value"))


def load_registry(spark: SparkSession, path: str, now: str, hours: int = 24) -> DataFrame:
    """A registry snapshot without entries older than `hours`."""
    return spark.read.parquet(path).where(F.col("snapshot_ts") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS"))


class Leak(RuntimeError):
    """Rows with sensitive patterns were about to be written."""


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.path = self.hadoop.Path(name)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def move_to(self, target: "Folder") -> None:
        """The whole folder in one step where the target is new; else file by file, under names that no other write has."""
        if not self.exists():
            return
        if not target.exists():
            self.fs.mkdirs(target.path.getParent())
            if self.fs.rename(self.path, target.path):
                return
        for f in self.fs.listStatus(self.path):
            if not self.fs.rename(f.getPath(), self.hadoop.Path(target.path, f.getPath().getName())):
                raise OSError(f"could not move {f.getPath()}")


def gated_write(df: DataFrame, text_columns: list[str], path: str, quarantine: str | None = None, policy: str = "strict") -> int:
    """Clean rows to `path`, rows with a sensitive pattern to `quarantine`; how many those are.

    Without a quarantine one such row fails the write (`Leak`), and nothing of it is
    visible. The rows are computed and written once, into a folder beside `path`, parted by
    what was found; only then they are moved, the held ones first. A job that dies before
    leaves a folder that no reader looks at. Part files have names of their own, so writers
    don't meet.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    part = lambda held: Folder(spark, f"{staging}/_held={str(held).lower()}")
    df.withColumn("_held", leaking(text_columns, policy)).write.partitionBy("_held").parquet(staging)
    try:
        n = spark.read.parquet(f"{staging}/_held=true").count() if part(True).exists() else 0
        if n and quarantine is None:
            raise Leak(f"{n} rows hold sensitive patterns")
        if quarantine is not None:
            part(True).move_to(Folder(spark, quarantine))
        part(False).move_to(Folder(spark, path))
        return n
    finally:
        Folder(spark, staging).delete()


def report_json(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id and the nested result document as JSON."""
    per = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "rule_id", "severity", "verdict_effect", "message"))).alias("findings"))
    none = F.array().cast(per.schema["findings"].dataType)
    return verdicts.join(per, "doc_id", "left").select("doc_id", F.to_json(F.struct(F.lit("vouchlake.v1").alias("schema"), "verdict", F.coalesce("findings", none).alias("findings"))).alias("json"))


def relocate(labels: DataFrame, files: DataFrame) -> DataFrame:
    """Labels with class-relative paths; names that several contents share get eight digits of their hash in front."""
    name = F.regexp_extract("doc_path", r"([^/\\]+)$", 1)
    named = labels.withColumn("name", name)
    shared = named.groupBy("doc_class", "name").agg((F.count_distinct("doc_sha256") > 1).alias("shared"))
    both = named.join(shared, ["doc_class", "name"])
    target = F.concat("doc_class", F.lit("/"), F.when(F.col("shared"), F.concat(F.substring("doc_sha256", 1, 8), F.lit("-"), "name")).otherwise(F.col("name")))
    here = files.select("doc_sha256", F.lit(True).alias("there")).distinct()
    return both.join(here, "doc_sha256", "left").select("doc_sha256", target.alias("doc_path"), F.coalesce("there", F.lit(False)).alias("present"))


