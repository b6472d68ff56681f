"""Evaluation, governance and teaching."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlake.operators import evaluate as E
from vouchlake.operators import teach as T
from vouchlake.plans import rules as R
from vouchlake.queries.registry import query

_RANK = "CASE {0} WHEN 'ACCEPT' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'NEED_MANUAL_REVIEW' THEN 2 WHEN 'CRASH' THEN 2 WHEN 'REJECT' THEN 3 END"
_P, _G = _RANK.format("pred_verdict"), _RANK.format("gold_verdict")


def _bounds(hits: str, n: str) -> str:
    z2, p = "3.8416", f"({hits} / nullif(CAST({n} AS DOUBLE), 0))"
    mid, spread = f"({p} + {z2} / (2 * {n})) / (1 + {z2} / {n})", f"1.96 / (1 + {z2} / {n}) * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n}))"
    return f"round(greatest(0.0, {mid} - {spread}), 3) AS ci_low, round(least(1.0, {mid} + {spread}), 3) AS ci_high"


@query(
    "verdict_metrics",
    "eval_rows",
    sql=f"""WITH r AS (SELECT *, {_P} AS p, {_G} AS g FROM eval_rows WHERE NOT skipped), a AS (
  SELECT stream, run_year, count(*) AS n, count(*) FILTER (pred_verdict = gold_verdict) AS hits,
    round(avg(CASE WHEN pred_verdict <> gold_verdict AND p < g THEN 1.0 ELSE 0 END), 3) AS unsafe,
    round(avg(CASE WHEN pred_verdict <> gold_verdict AND p > g THEN 1.0 ELSE 0 END), 3) AS safe,
    round(avg(CASE WHEN pred_verdict = gold_verdict THEN 0.0 WHEN p < g THEN 3.0 * (g - p) ELSE p - g END), 3) AS cost FROM r GROUP BY 1, 2)
SELECT stream, run_year, n, round(hits / CAST(n AS DOUBLE), 3) AS accuracy, {_bounds("hits", "n")}, unsafe, safe, cost FROM a""",
)
def verdict_metrics(rows):
    return E.verdict_metrics(rows, "stream", "run_year")


@query(
    "doc_type_accuracy",
    "eval_rows",
    sql=f"""WITH a AS (SELECT stream, count(*) AS n, count(*) FILTER (pred_type = gold_type) AS hits FROM eval_rows WHERE NOT skipped GROUP BY 1)
SELECT stream, round(hits / CAST(n AS DOUBLE), 3) AS accuracy, {_bounds("hits", "n")} FROM a""",
)
def doc_type_accuracy(rows):
    return E.doc_type_accuracy(rows, "stream")


@query("confusion_matrix", "eval_rows", sql="SELECT stream, gold_type, pred_type, count(*) AS n FROM eval_rows WHERE NOT skipped GROUP BY 1, 2, 3")
def confusion_matrix(rows):
    return E.confusion_matrix(rows, "stream")


@query(
    "invoice_false_accept",
    "eval_rows",
    sql="""SELECT run_year, round(avg(CASE WHEN gold_type = 'invoice' THEN CASE WHEN pred_verdict <> 'REJECT' THEN 1.0 ELSE 0 END END), 3) AS rate
FROM eval_rows WHERE NOT skipped GROUP BY 1""",
)
def invoice_false_accept(rows):
    return E.invoice_false_accept(rows, "run_year")


@query(
    "scenario_slices",
    "eval_rows",
    sql="""SELECT tag, count(*) AS n, round(avg(CASE WHEN pred_type = gold_type AND pred_verdict = gold_verdict THEN 1.0 ELSE 0 END), 3) AS accuracy,
  round(avg(CASE WHEN pred_type = gold_type THEN 1.0 ELSE 0 END), 3) AS doc_type_accuracy, round(avg(CASE WHEN pred_verdict = gold_verdict THEN 1.0 ELSE 0 END), 3) AS verdict_accuracy
FROM eval_rows WHERE NOT skipped GROUP BY 1""",
)
def scenario_slices(rows):
    return E.scenario_slices(rows)


@query(
    "crash_rates",
    "eval_rows",
    sql="""SELECT run_year, count(*) FILTER (NOT skipped) AS n, count(*) FILTER (NOT skipped AND NOT crash) AS n_scored, count(*) FILTER (NOT skipped AND crash) AS crashes,
  round(count(*) FILTER (NOT skipped AND crash) / CAST(nullif(count(*) FILTER (NOT skipped), 0) AS DOUBLE), 3) AS crash_rate, count(*) FILTER (skipped) AS skipped_missing
FROM eval_rows GROUP BY 1""",
)
def crash_rates(rows):
    return E.crash_skip_rates(rows, "run_year")


@query(
    "precedent_relaxations",
    "eval_rows",
    "run_labels",
    sql=f"""SELECT count(*) AS n, count(*) FILTER (NOT confirmed) AS n_unconfirmed FROM eval_rows JOIN run_labels ON file_key = run_id WHERE NOT skipped AND {_P} > {_G}""",
)
def precedent_relaxations(rows, labels):
    return E.precedent_relaxations(rows, labels)


@query(
    "eval_diff",
    "eval_rows",
    sql="""WITH r AS (SELECT doc_key, run_year, bool_and(pred_type = gold_type AND pred_verdict = gold_verdict) AS ok FROM eval_rows WHERE NOT skipped AND run_year IN (1996, 1995) GROUP BY 1, 2),
d AS (SELECT a.doc_key, CASE WHEN a.ok AND NOT b.ok THEN 'improved' WHEN NOT a.ok AND b.ok THEN 'regressed' WHEN NOT a.ok THEN 'unchanged_wrong' END AS change
  FROM r a JOIN r b ON a.doc_key = b.doc_key AND a.run_year = 1996 AND b.run_year = 1995)
SELECT doc_key, change FROM d WHERE change IS NOT NULL""",
)
def eval_diff(rows):
    return E.eval_diff(rows.where("run_year = 1996"), rows.where("run_year = 1995"), "doc_key")


_METRICS = """m AS (SELECT stream, run_year AS ts, 'verdict_accuracy' AS metric, round(avg(CASE WHEN pred_verdict = gold_verdict THEN 1.0 ELSE 0 END), 3) AS value
  FROM eval_rows WHERE NOT skipped GROUP BY 1, 2)"""


def _metrics(rows):
    return E.verdict_metrics(rows, "stream", "run_year").select("stream", F.col("run_year").alias("ts"), F.lit("verdict_accuracy").alias("metric"), F.col("accuracy").alias("value"))


@query(
    "metric_delta",
    "eval_rows",
    sql=f"""WITH {_METRICS}, l AS (SELECT *, lag(value) OVER (PARTITION BY stream, metric ORDER BY ts) AS previous FROM m)
SELECT stream, ts, metric, value, previous, round(value - previous, 3) AS delta FROM l""",
)
def metric_delta(rows):
    return E.metric_delta(_metrics(rows))


@query(
    "gold_staleness",
    "eval_rows",
    "run_labels",
    sql=f"""WITH newest AS (SELECT doc_key, max(ts) AS confirmed_ts FROM run_labels WHERE confirmed GROUP BY 1)
SELECT doc_key, count(*) AS disagreements, count(*) FILTER ({_P} < {_G}) AS unsafe, count(*) FILTER ({_P} > {_G}) AS safe
FROM eval_rows JOIN newest USING (doc_key) WHERE NOT skipped AND NOT crash AND pred_verdict <> gold_verdict AND ts > confirmed_ts GROUP BY 1""",
)
def gold_staleness(rows, labels):
    return E.staleness_ranking(E.gold_staleness(rows, labels.where("confirmed"), "doc_key"), "doc_key")


_RULES_SQL = ", ".join(f"('{r.doc_class}', '{r.rule_id}', '{r.tier}', {'NULL' if r.verdict_effect is None else repr(r.verdict_effect)})" for r in R.RULES)
_STATS = f"""WITH rule(doc_class, rule_id, tier, effect) AS (VALUES {_RULES_SQL}),
known AS (SELECT run_id, bool_or(confirmed) AS confirmed, max_by(verdict_gold, ts) AS verdict_gold FROM run_labels GROUP BY 1),
fired AS (SELECT r.doc_class, f.rule_id, f.verdict_effect, r.ts, coalesce(confirmed, FALSE) AS confirmed, verdict_gold
  FROM findings f JOIN runs r USING (run_id) LEFT JOIN known USING (run_id)),
per AS (SELECT doc_class, rule_id, count(*) AS fired, count(*) FILTER (confirmed) AS n,
  count(*) FILTER (confirmed AND {_RANK.format("verdict_gold")} >= {_RANK.format("verdict_effect")}) AS hits, min(ts) AS first_seen FROM fired GROUP BY 1, 2),
j AS (SELECT rule.*, coalesce(fired, 0) AS fired, CASE WHEN effect IS NULL THEN 0 ELSE coalesce(n, 0) END AS confirmed, CASE WHEN effect IS NULL THEN 0 ELSE coalesce(hits, 0) END AS hits, first_seen
  FROM rule LEFT JOIN per USING (doc_class, rule_id)),
b AS (SELECT *, {_bounds("hits", "confirmed")} FROM j),
stats AS (SELECT doc_class, rule_id, tier, fired, confirmed, hits, CASE WHEN confirmed > 0 THEN round(hits / CAST(confirmed AS DOUBLE), 3) END AS precision,
  CASE WHEN confirmed > 0 THEN ci_low END AS wilson_lb, round((epoch(TIMESTAMP '2026-07-09') - epoch(first_seen)) / 86400.0, 1) AS age_days FROM b)"""


def _stats(findings, runs, labels):
    return E.rule_stats(E.findings_with_labels(findings, runs, labels), R.rule_table(runs.sparkSession), "2026-07-09 00:00:00")


@query("rule_stats", "findings", "runs", "run_labels", sql=f"{_STATS} SELECT * FROM stats")
def rule_stats(findings, runs, labels):
    return _stats(findings, runs, labels)


@query(
    "tier_proposals",
    "findings",
    "runs",
    "run_labels",
    sql=f"""{_STATS} SELECT doc_class, rule_id, 'promotion' AS kind, tier AS from_tier, 'corp' AS to_tier, confirmed AS n, hits, wilson_lb FROM stats
  WHERE tier = 'experimental' AND confirmed >= 10 AND wilson_lb >= 0.6 AND age_days >= 14
UNION ALL SELECT doc_class, rule_id, 'demotion', tier, CASE tier WHEN 'corp' THEN 'experimental' ELSE 'learned' END, confirmed, hits, wilson_lb FROM stats
  WHERE (tier = 'corp' AND confirmed >= 10 AND wilson_lb <= 0.4) OR (tier = 'experimental' AND confirmed >= 8 AND wilson_lb <= 0.3)""",
)
def tier_proposals(findings, runs, labels):
    return E.tier_proposals(_stats(findings, runs, labels))


@query(
    "adoption_gate",
    "eval_rows",
    sql="""WITH v AS (SELECT stream, run_year, round(avg(CASE WHEN pred_type = gold_type THEN 1.0 ELSE 0 END), 3) AS iban,
    round(avg(CASE WHEN gold_type = 'invoice' THEN CASE WHEN pred_verdict <> 'REJECT' THEN 1.0 ELSE 0 END END), 3) AS fa
  FROM eval_rows WHERE NOT skipped AND run_year IN (1995, 1996) GROUP BY 1, 2),
j AS (SELECT a.stream, list_sort(list_filter([CASE WHEN a.iban < b.iban THEN 'bank.iban got worse' END, CASE WHEN a.fa > 0 THEN 'invoice_false_accept_rate must be 0' END], lambda x: x IS NOT NULL)) AS reasons
  FROM v a JOIN v b ON a.stream = b.stream AND a.run_year = 1996 AND b.run_year = 1995)
SELECT stream, len(reasons) = 0 AS ok, reasons FROM j""",
)
def adoption_gate(rows):
    def metrics(year):
        one = rows.where(F.col("run_year") == year)
        types = E.doc_type_accuracy(one, "stream").select("stream", F.lit("bank.iban").alias("metric"), F.col("accuracy").alias("value"))
        return types.unionByName(E.invoice_false_accept(one, "stream").select("stream", F.lit("invoice_false_accept_rate").alias("metric"), F.col("rate").alias("value")))

    return E.adoption_gate(metrics(1996), metrics(1995))


@query(
    "precedents",
    "runs",
    "run_labels",
    sql=f"""WITH k AS (SELECT run_id, max_by(verdict_gold, ts) AS gold, bool_or(confirmed) AS confirmed FROM run_labels GROUP BY 1),
j AS (SELECT r.run_id, r.verdict AS v, gold, {_RANK.format("gold")} < {_RANK.format("r.verdict")} AND NOT confirmed AS held FROM runs r LEFT JOIN k USING (run_id))
SELECT run_id, v AS model_verdict, CASE WHEN gold IS NULL OR held THEN v ELSE gold END AS verdict,
  CASE WHEN gold IS NULL OR gold = v THEN NULL WHEN held THEN 'OPERATOR-2' ELSE 'OPERATOR-1' END AS finding FROM j""",
)
def precedents(runs, labels):
    return T.precedent_override(runs, labels)


@query(
    "training_queue",
    "runs",
    "run_labels",
    sql="""WITH s AS (SELECT run_id, verdict, ts, CASE verdict WHEN 'NEED_MANUAL_REVIEW' THEN 3 WHEN 'WARNING' THEN 2 ELSE 0 END + CASE WHEN escalated THEN 2 ELSE 0 END
  + CASE WHEN conflict THEN 2 ELSE 0 END + CASE WHEN tag NOT IN (SELECT tag FROM run_labels) THEN 2 ELSE 0 END AS score
  FROM runs WHERE run_id NOT IN (SELECT run_id FROM run_labels))
SELECT run_id, score, verdict FROM s WHERE score > 0 ORDER BY score DESC, ts DESC, run_id LIMIT 12""",
)
def training_queue(runs, labels):
    return T.training_queue(runs, labels)


@query(
    "recent_runs",
    "runs",
    "run_labels",
    sql="""WITH t AS (SELECT * FROM runs ORDER BY ts DESC, run_id DESC LIMIT 50) SELECT run_id, verdict, run_id IN (SELECT run_id FROM run_labels) AS labeled FROM t""",
)
def recent_runs(runs, labels):
    return T.recent_runs(runs, labels)


@query(
    "unlabelled_runs",
    "runs",
    "run_labels",
    sql="SELECT verdict, count(*) AS n FROM runs WHERE run_id NOT IN (SELECT run_id FROM run_labels) GROUP BY 1",
)
def unlabelled_runs(runs, labels):
    return T.unlabelled_runs(runs, labels).groupBy("verdict").agg(F.count("*").alias("n"))


@query("uncovered_scenarios", "runs", "run_labels", sql="SELECT run_id, tag FROM runs WHERE tag NOT IN (SELECT tag FROM run_labels)")
def uncovered_scenarios(runs, labels):
    return T.uncovered_tags(runs, labels)


@query(
    "stratified_split",
    "run_labels",
    sql="""WITH p AS (SELECT run_id, doc_class, doc_type_gold, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_class, doc_type_gold) AS n
  FROM run_labels WHERE confirmed WINDOW w AS (PARTITION BY doc_class, doc_type_gold ORDER BY run_id))
SELECT run_id, doc_class, doc_type_gold, CASE WHEN k <= CASE WHEN n > 1 THEN greatest(1, floor(n * 0.85)) ELSE 1 END THEN 'train' ELSE 'valid' END AS part FROM p""",
)
def stratified_split(labels):
    return T.stratified_split(labels)


@query(
    "fewshot_pick",
    "run_labels",
    sql="""WITH p AS (SELECT run_id, doc_class, tag, 'type:' || doc_type_gold AS kind, changed_fields + CASE WHEN type_changed THEN 3 ELSE 0 END + 2 * completeness AS value FROM run_labels WHERE confirmed),
one AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_class ORDER BY value DESC, run_id) = 1),
two AS (SELECT p.* FROM p JOIN one USING (doc_class) WHERE p.run_id <> one.run_id
  QUALIFY row_number() OVER (PARTITION BY doc_class ORDER BY CAST(p.tag <> one.tag AS INT) + CAST(p.kind <> one.kind AS INT) DESC, p.value DESC, p.run_id) = 1)
SELECT doc_class, CAST(0 AS INTEGER) AS pick, run_id FROM one UNION ALL SELECT doc_class, 1, run_id FROM two""",
)
def fewshot_pick(labels):
    return T.cover_select(labels)


@query(
    "teaching_value",
    "run_labels",
    sql="SELECT run_id, doc_class, doc_type_gold, tag, changed_fields + CASE WHEN type_changed THEN 3 ELSE 0 END + 2 * completeness AS value FROM run_labels",
)
def teaching_value(labels):
    return T.teaching_value(labels)


@query(
    "chat_export",
    "run_labels",
    sql="""SELECT '{"messages":[{"role":"system","content":"Check the document."},{"role":"user","content":"run ' || run_id || '"},{"role":"assistant","content":"' || verdict_gold || '"}]}' AS value
FROM run_labels WHERE confirmed""",
)
def chat_export(labels):
    return T.chat_export(
        labels.where("confirmed").select(
            F.lit("Check the document.").alias("system"), F.concat(F.lit("run "), F.col("run_id").cast("string")).alias("input"), F.col("verdict_gold").alias("output")
        )
    )


@query(
    "duration_estimate",
    "runs",
    sql="""WITH n AS (SELECT *, row_number() OVER (PARTITION BY shape_key ORDER BY ts DESC, run_id DESC) AS pos FROM runs)
SELECT shape_key, round(avg(duration_s) / 5) * 5 AS seconds FROM n WHERE pos <= 5 GROUP BY 1 HAVING count(*) >= 2""",
)
def duration_estimate(runs):
    return T.duration_estimate(runs)


@query(
    "learning_trace",
    "run_labels",
    "runs",
    sql="SELECT run_id, l.verdict_gold AS corrected, r.verdict AS now, l.verdict_gold = r.verdict AS ok FROM run_labels l JOIN runs r USING (run_id)",
)
def learning_trace(labels, runs):
    return T.learning_trace(labels, runs)


@query("erase_documents", "runs", sql="SELECT verdict, count(*) AS n FROM runs WHERE run_id % 7 <> 0 GROUP BY 1")
def erase_documents(runs):
    gone = runs.where("run_id % 7 = 0").select("run_id")
    return T.erase_documents(runs, gone, "run_id").groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    "label_lifecycle",
    "run_labels",
    sql="SELECT doc_key, min(ts) AS label_ts, max(ts) FILTER (confirmed) AS last_confirmed_ts, count(*) FILTER (confirmed) AS confirm_count FROM run_labels GROUP BY 1",
)
def label_lifecycle(labels):
    return T.label_lifecycle(labels, "doc_key")


@query(
    "latest_label",
    "run_labels",
    sql="""WITH o AS (SELECT doc_key, run_id, verdict_gold, row_number() OVER (PARTITION BY doc_key ORDER BY ts DESC, run_id DESC) AS pos FROM run_labels)
SELECT doc_key, run_id, verdict_gold FROM o WHERE pos = 1""",
)
def latest_label(labels):
    even, odd = labels.where("run_id % 2 = 0"), labels.where("run_id % 2 = 1")
    return T.upsert_labels(even, odd, "doc_key", "ts", "run_id").select("doc_key", "run_id", "verdict_gold")


@query("label_counts", "run_labels", sql="SELECT doc_class, count(*) AS n, count(*) >= 100 AS export_allowed FROM run_labels WHERE confirmed GROUP BY 1")
def label_counts(labels):
    return T.label_counts(labels)


@query("manifest", "run_labels", sql="SELECT tag, count(*) AS n, round(avg(CASE WHEN confirmed THEN 1.0 ELSE 0 END), 3) AS agreement FROM run_labels GROUP BY 1")
def manifest(labels):
    return T.manifest(labels)
