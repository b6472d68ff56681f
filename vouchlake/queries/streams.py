"""Streaming jobs over the event files, run until nothing is left.

The `stream_*` queries use the batch twins (the same functions on a static DataFrame). The
`streamed_*` queries run the streams: the table's files come in as a stream, rows go out to files
below spark.checkpoint.dir, and the job ends when nothing is left. An append stream gives
what can no longer change, so their SQL leaves out windows that the watermark has not passed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlake.queries.extraction import _LEAKS
from vouchlake.queries.registry import files_query, query
from vouchlake.sources.scratch import fresh_folder
from vouchlake.streaming import streams as S


@query(
    "stream_rule_rates",
    "events",
    sql="""WITH w AS (SELECT event_type, unnest(range(CAST(0 AS BIGINT), CAST(6 AS BIGINT))) AS k, time_bucket(INTERVAL 10 MINUTES, ts) AS b FROM events)
SELECT b - to_minutes(CAST(10 * k AS INT)) AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""",
)
def stream_rule_rates(events):
    return S.rule_rates(events)


@query(
    "stream_review_bursts",
    "events",
    sql="""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 5 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 5 MINUTES AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_review_bursts(events):
    return S.review_bursts(events)


@query("stream_leak_monitor", "events", "documents", sql=rf"""
WITH t AS (SELECT d.doc_id, e.ts, d.text FROM documents d JOIN events e ON e.event_id = d.doc_id), h AS (
{" UNION ALL ".join(f"SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, '{k}' AS pattern, count(*) FILTER (regexp_matches(text, '{p}')) AS hits FROM t GROUP BY 1" for k, p in _LEAKS.items())})
SELECT * FROM h WHERE hits > 0""")
def stream_leak_monitor(events, documents):
    """All patterns. The join gives documents, which have no time of their own, that of the event with their number."""
    texts = documents.join(events.select(F.col("event_id").alias("doc_id"), "ts"), "doc_id").select("ts", "text")
    return S.stream_leaks(texts)


def _events(spark, sf_dir):
    # as a pattern, so that one file will do as well as a folder of them
    return S.read_stream(spark, f"{sf_dir}/events.parque[t]")


@files_query(
    "streamed_rule_rates",
    sql="""WITH w AS (SELECT event_type, ts, unnest(range(CAST(0 AS BIGINT), CAST(6 AS BIGINT))) AS k, time_bucket(INTERVAL 10 MINUTES, ts) AS b FROM events),
r AS (SELECT b - to_minutes(CAST(10 * k AS INT)) AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2)
SELECT * FROM r WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def streamed_rule_rates(spark, sf_dir):
    return S.run_to_files(S.rule_rates(_events(spark, sf_dir)), fresh_folder(spark, "rates"))


@files_query(
    "streamed_leak_monitor",
    sql=rf"""WITH t AS (SELECT ts, 'user 000-12-' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || CASE WHEN event_id % 3 = 0 THEN ' DE89370400440532013000' ELSE '' END AS text FROM events WHERE event_id % 7 = 0), h AS (
{" UNION ALL ".join(f"SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, '{k}' AS pattern, count(*) FILTER (regexp_matches(text, '{p}')) AS hits FROM t GROUP BY 1" for k, p in _LEAKS.items())})
SELECT * FROM h WHERE hits > 0 AND start + INTERVAL 10 MINUTES <= (SELECT max(ts) FROM t) - INTERVAL 1 HOUR""",
)
def streamed_leak_monitor(spark, sf_dir):
    """Every seventh event says a number, every third of those an account too."""
    k = F.col("event_id")
    said = F.concat(F.lit("user 000-12-"), F.lpad((k % 10_000).cast("string"), 4, "0"), F.when(k % 3 == 0, " DE89370400440532013000").otherwise(""))
    texts = _events(spark, sf_dir).where(k % 7 == 0).select("ts", said.alias("text"))
    return S.run_to_files(S.stream_leaks(texts), fresh_folder(spark, "leaks"))


@files_query(
    "streamed_verdicts",
    sql="""WITH d AS (SELECT DISTINCT user_id % 40 AS k FROM events)
SELECT k AS doc_id, CASE WHEN k % 4 = 0 THEN 'REJECT' WHEN k % 4 = 1 THEN 'NEED_MANUAL_REVIEW' WHEN k % 4 = 2 THEN 'WARNING' ELSE 'ACCEPT' END AS verdict FROM d""",
)
def streamed_verdicts(spark, sf_dir):
    """An event is a document sent in; users send the same forty again and again, and each content is judged once (all events are within the watermark)."""
    k = F.col("user_id") % 40
    kind = F.when(k % 4 == 0, "invoice").when(k % 4 == 1, "other").when(k % 4 == 2, "payment_instructions").otherwise("supplier_letterhead")
    docs = _events(spark, sf_dir).select(
        "ts", k.cast("long").alias("doc_id"), F.lit("bank").alias("doc_class"), kind.alias("doc_type"), F.concat(F.lit("Holder "), k.cast("string")).alias("account_holder"),
        F.lit("").alias("iban"), F.lpad((k + 100_000_000_000).cast("string"), 12, "0").alias("account_number"),
    )
    return S.run_to_files(S.stream_validate(docs, lateness="400 days"), fresh_folder(spark, "verdicts")).select("doc_id", "verdict")


@files_query(
    "streamed_staleness",
    sql="""WITH e AS (SELECT CAST(user_id AS BIGINT) AS doc_key, epoch_us(ts) AS t, event_type FROM events WHERE event_type IN ('purchase', 'error', 'view')),
c AS (SELECT doc_key, max(t) FILTER (event_type = 'purchase') AS confirmed FROM e GROUP BY 1)
SELECT doc_key, count(*) FILTER (event_type <> 'purchase' AND (confirmed IS NULL OR t > confirmed)) AS disagreements, count(*) FILTER (event_type = 'error' AND (confirmed IS NULL OR t > confirmed)) AS unsafe
FROM e JOIN c USING (doc_key) GROUP BY 1""",
)
def streamed_staleness(spark, sf_dir):
    """Purchases confirm a user's label, errors and views disagree with it."""
    kind = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "unsafe").otherwise("safe")
    events = _events(spark, sf_dir).where(F.col("event_type").isin("purchase", "error", "view")).select(F.col("user_id").cast("long").alias("doc_key"), F.unix_micros("ts").alias("at"), kind.alias("kind"))
    return S.run_to_files(S.stream_staleness(events, 400 * 24 * 3600 * 1_000_000), fresh_folder(spark, "stale"), ["doc_key"])
