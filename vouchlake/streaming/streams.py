"""The same jobs over documents and events that arrive over time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.operators.extract import content_id
from vouchlake.operators.privacy import leak_scan
from vouchlake.plans.rules import verdict_in_place


def read_stream(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """Parquet files as they land; the schema is that of what is there now. Times without a zone are taken in the session's."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def stream_validate(docs: DataFrame, ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Verdicts of arriving documents, equal content once within the watermark. One row in, one row out: no other state."""
    keyed = docs.withColumn("run_id", content_id(F.to_json(F.struct("doc_type", "account_holder", "iban", "account_number")))).withWatermark(ts, lateness)
    return verdict_in_place(keyed.dropDuplicatesWithinWatermark(["run_id"]))


def stream_leaks(texts: DataFrame, ts: str = "ts", width: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Leaks a window and pattern; a window is emitted when it can no longer change."""
    hits = leak_scan(texts.select(ts, "text")).withWatermark(ts, lateness)
    return hits.groupBy(F.window(ts, width), "pattern").agg(F.count("*").alias("hits")).select(F.col("window.start").alias("start"), "pattern", "hits")


def rule_rates(events: DataFrame, rule: str = "event_type", ts: str = "ts", width: str = "1 hour", slide: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Firings a rule in sliding windows."""
    counted = events.withWatermark(ts, lateness).groupBy(F.window(ts, width, slide), rule).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), rule, "n")


def review_bursts(events: DataFrame, who: str = "user_id", ts: str = "ts", gap: str = "5 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of an operator: what is no more than `gap` apart."""
    counted = events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), who).agg(F.count("*").alias("n"))
    return counted.select(who, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _stale(horizon: int):
    """Of one document: when it was last confirmed, which disagreements came later, and, of those older than the horizon, only how many and until when."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        confirmed, old, old_unsafe, old_until, ats, unsafe = state.get if state.exists else (NEVER, 0, 0, NEVER, [], [])
        rows = pd.concat(list(parts))
        at, kind = rows["at"].to_numpy("int64"), rows["kind"].to_numpy()
        newest = max([confirmed, old_until, *ats, *at.tolist()])
        confirmed = max([confirmed, *at[kind == "confirm"].tolist()])
        if confirmed >= old_until:
            old, old_unsafe = 0, 0
        wrong = kind != "confirm"
        open_ = sorted((a, u) for a, u in [*zip(ats, unsafe), *zip(at[wrong].tolist(), (kind[wrong] == "unsafe").tolist())] if a > confirmed)
        while open_ and open_[0][0] < newest - horizon:
            a, u = open_.pop(0)
            old, old_unsafe, old_until = old + 1, old_unsafe + u, max(old_until, a)
        state.update((confirmed, old, old_unsafe, old_until, [a for a, _ in open_], [bool(u) for _, u in open_]))
        yield pd.DataFrame({"doc_key": [key[0]], "disagreements": [old + len(open_)], "unsafe": [old_unsafe + sum(u for _, u in open_)]})

    return fold


#: Before all events.
NEVER = -(1 << 62)


def stream_staleness(events: DataFrame, horizon: int = 400 * 24 * 3600) -> DataFrame:
    """doc_key, disagreements, unsafe after each batch: what came after a document's last confirmation. events: doc_key long, at long, kind confirm, safe or unsafe.

    Events may come in any order: the times of open disagreements are kept, so a
    confirmation that arrives late takes off what came before it and leaves the rest, as the
    batch form (`gold_staleness`) does. `horizon` bounds the state: disagreements older than
    the document's newest event by more are folded into counters, which only a confirmation
    after all of them resets; one from between, that late, takes off nothing.
    """
    return events.groupBy("doc_key").applyInPandasWithState(
        _stale(horizon), "doc_key long, disagreements long, unsafe long",
        "confirmed long, old long, old_unsafe long, old_until long, ats array<long>, unsafe array<boolean>", "update", "NoTimeout",
    )


def run_to_files(stream: DataFrame, folder: str, key: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there into Parquet files below `folder` (shared by all machines), and reads them.

    Without key: rows are appended, each once (the sink keeps its own log). With key, for
    update streams: every batch's rows are written with the batch's number, which a
    repeated batch overwrites, and of each key the newest row is read.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if key is None:
        writer.format("parquet").outputMode("append").start(f"{folder}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    writer.outputMode("update").foreachBatch(save).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r")).select("r.*")
