"""Measuring the machine: metrics with asymmetric cost, slices, differences, staleness, rule statistics, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vouchlake.functions.columns import blank, names_materially_equal, norm_name, verdict_direction, verdict_rank, wilson

#: Promotion: (from, to) -> least cases, least lower bound, least age in days. Demotion: from -> least cases, greatest bound, to.
PROMOTION = {("experimental", "corp"): (10, 0.60, 14), ("learned", "experimental"): (5, 0.45, 7)}
DEMOTION = {"corp": (10, 0.40, "experimental"), "experimental": (8, 0.30, "learned")}
CRITICAL_FIELDS = ("bank.iban", "bank.account_number", "bank.swift_bic", "w9.tin", "w9.line3_classification")


def attempted(rows: DataFrame) -> DataFrame:
    """Crashed rows were attempted, skipped ones were not."""
    return rows.where(~F.col("skipped"))


def _share(c: Column) -> Column:
    return F.coalesce(F.round(F.avg(c.cast("double")), 3), F.lit(0.0))


def verdict_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy with its interval, unsafe and safe error rates, and cost: a softer verdict counts three times a step, a stricter one once.

    A crash is never a hit and ranks as manual review.
    """
    hit = F.col("pred_verdict") == F.col("gold_verdict")
    gap = F.coalesce(verdict_rank(F.col("pred_verdict")) - verdict_rank(F.col("gold_verdict")), F.lit(0))
    cost = F.when(hit, 0).when(gap < 0, -3 * gap).otherwise(gap)
    out = attempted(rows).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits"), _share(~hit & (gap < 0)).alias("unsafe"),
        _share(~hit & (gap > 0)).alias("safe"), F.coalesce(F.round(F.avg(cost.cast("double")), 3), F.lit(0.0)).alias("cost"),
    )
    low, high = wilson(F.col("hits"), F.col("n"))
    accuracy = F.coalesce(F.round(F.try_divide("hits", "n"), 3), F.lit(0.0))
    return out.select(*by, "n", accuracy.alias("accuracy"), low.alias("ci_low"), high.alias("ci_high"), "unsafe", "safe", "cost")


def doc_type_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    hits = F.count_if(F.col("pred_type") == F.col("gold_type"))
    out = attempted(rows).groupBy(*by).agg(F.count("*").alias("n"), hits.alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.select(*by, F.round(F.try_divide("hits", "n"), 3).alias("accuracy"), low.alias("ci_low"), high.alias("ci_high"))


def confusion_matrix(rows: DataFrame, *by: str) -> DataFrame:
    return attempted(rows).groupBy(*by, "gold_type", "pred_type").agg(F.count("*").alias("n"))


def invoice_false_accept(rows: DataFrame, *by: str) -> DataFrame:
    """Share of true invoices that were not rejected, crashes among them; null without any."""
    missed = F.when(F.col("gold_type") == "invoice", (F.col("pred_verdict") != "REJECT").cast("double"))
    return attempted(rows).groupBy(*by).agg(F.round(F.avg(missed), 3).alias("rate"))


def scenario_slices(rows: DataFrame) -> DataFrame:
    """Per tag: cases, both right, type right, verdict right."""
    kind, verdict = F.col("pred_type") == F.col("gold_type"), F.col("pred_verdict") == F.col("gold_verdict")
    return attempted(rows).groupBy("tag").agg(
        F.count("*").alias("n"), _share(kind & verdict).alias("accuracy"), _share(kind).alias("doc_type_accuracy"), _share(verdict).alias("verdict_accuracy")
    )


def crash_skip_rates(rows: DataFrame, *by: str) -> DataFrame:
    ran, crashed = ~F.col("skipped"), F.col("crash") & ~F.col("skipped")
    return rows.groupBy(*by).agg(
        F.count_if(ran).alias("n"), F.count_if(ran & ~F.col("crash")).alias("n_scored"), F.count_if(crashed).alias("crashes"),
        F.round(F.try_divide(F.count_if(crashed), F.count_if(ran)), 3).alias("crash_rate"), F.count_if("skipped").alias("skipped_missing"),
    )


def precedent_relaxations(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents on which the machine is stricter than the label, and how many of those labels are unconfirmed."""
    both = attempted(rows).join(labels.select(F.col("run_id").alias("file_key"), "confirmed"), "file_key")
    stricter = both.where(verdict_direction(F.col("pred_verdict"), F.col("gold_verdict")) == "safe")
    return stricter.agg(F.count("*").alias("n"), F.count_if(~F.col("confirmed")).alias("n_unconfirmed"))


def score_predictions(predicted: DataFrame, gold: DataFrame, name_fields: tuple[str, ...]) -> DataFrame:
    """doc_id, field, strict, lenient: equal but for case, punctuation and spaces; names also when they mean the same.

    Values may be structs (present, type, masked), as masked results carry them; plain text
    on the other side counts as such a struct. Two absent values are equal; of two present
    ones the masked texts must be the same and, for a tax number, its type.
    """
    if any(isinstance(df.schema["value"].dataType, StructType) for df in (predicted, gold)):
        return _score_masked(predicted, gold)
    both = gold.select("doc_id", "field", F.col("value").alias("g")).join(predicted.select("doc_id", "field", F.col("value").alias("p")), ["doc_id", "field"], "left")
    p, g = F.coalesce("p", F.lit("")), F.coalesce("g", F.lit(""))
    strict = norm_name(p) == norm_name(g)
    return both.select("doc_id", "field", strict.alias("strict"), (strict | (F.col("field").isin(*name_fields) & names_materially_equal(p, g))).alias("lenient"))


def _score_masked(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    def struct_of(df: DataFrame) -> Column:
        v = F.col("value")
        kind = df.schema["value"].dataType
        if isinstance(kind, StructType):
            return F.struct(F.coalesce(v["present"], F.lit(False)).alias("present"), (norm_name(v["type"]) if "type" in kind.names else F.lit("")).alias("type"), v["masked"].alias("masked"))
        return F.struct((~blank(v)).alias("present"), F.lit("").alias("type"), F.coalesce(v, F.lit("")).alias("masked"))

    both = gold.select("doc_id", "field", struct_of(gold).alias("g")).join(predicted.select("doc_id", "field", struct_of(predicted).alias("p")), ["doc_id", "field"], "left")
    there, read = F.col("g.present"), F.coalesce("p.present", F.lit(False))
    same = (F.col("field") != "tin") | F.col("g.type").eqNullSafe(F.col("p.type"))
    strict = F.when(~there & ~read, True).when(there != read, False).otherwise(same & F.col("g.masked").eqNullSafe(F.col("p.masked")))
    return both.select("doc_id", "field", strict.alias("strict"), strict.alias("lenient"))


def field_accuracy(scored: DataFrame) -> DataFrame:
    """Shares a field, named class.field where rows have a doc_class."""
    name = F.concat("doc_class", F.lit("."), "field") if "doc_class" in scored.columns else F.col("field")
    return scored.groupBy(name.alias("field")).agg(_share(F.col("strict")).alias("strict"), _share(F.col("lenient")).alias("lenient"), F.count("*").alias("n"))


def rescore(stored: DataFrame, gold: DataFrame, recorded: DataFrame, name_fields: tuple[str, ...]) -> DataFrame:
    """doc_id, field, strict, recorded, same: stored readings scored anew against what was recorded then.

    recorded: doc_id, field, ok. Fields without a record, and records without a field, are not the same.
    """
    again = score_predictions(stored, gold, name_fields)
    both = again.join(recorded.select("doc_id", "field", F.col("ok").alias("recorded")), ["doc_id", "field"], "full")
    return both.select("doc_id", "field", "strict", "recorded", F.col("strict").eqNullSafe(F.col("recorded")).alias("same"))


def gold_review_queue(rows: DataFrame) -> DataFrame:
    """The scored rows on which the machine is stricter than the label, which may be out of date."""
    return attempted(rows).where(~F.col("crash") & (verdict_direction(F.col("pred_verdict"), F.col("gold_verdict")) == "safe"))


def recommendations(facts: DataFrame) -> DataFrame:
    """seq, level, advice of one row of facts, in order; a single 'clean' row if there is nothing to say.

    facts: leaks, false_accept_rate, regressed, failures, candidate ('' , 'unscored', 'passed'
    or 'failed'), queued, labels.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    number = lambda c: F.col(c).cast("string")
    cases = [
        (some("leaks"), "bad", F.concat(F.lit("leaks to mend first: "), number("leaks"))), (some("false_accept_rate"), "bad", F.lit("an invoice was accepted; look at the invoice rules")),
        (some("regressed"), "bad", F.concat(F.lit("worse than before: "), number("regressed"))), (some("failures"), "warn", F.concat(F.lit("not wholly right: "), number("failures"))),
        (F.col("candidate") == "unscored", "warn", F.lit("score the candidate before adopting it")), (F.col("candidate") == "passed", "ok", F.lit("the candidate may be adopted")),
        (F.col("candidate") == "failed", "bad", F.lit("the candidate failed its gate")), (some("queued"), "info", F.concat(F.lit("worth labelling: "), number("queued"))),
        (F.coalesce("labels", F.lit(0)) < 100, "info", F.concat(F.lit("labels towards 100: "), number("labels"))),
    ]
    said = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(v).alias("level"), a.alias("advice"))) for c, v, a in cases)))
    clean = F.array(F.struct(F.lit("ok").alias("level"), F.lit("clean; the present state may be adopted").alias("advice")))
    return facts.select(F.posexplode(F.when(F.size(said) > 0, said).otherwise(clean)).alias("seq", "x")).select("seq", "x.level", "x.advice")


def eval_diff(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """improved, regressed or unchanged_wrong for documents of both runs; those right in both are left out."""
    ok = (F.col("pred_type") == F.col("gold_type")) & (F.col("pred_verdict") == F.col("gold_verdict"))
    side = lambda df, name: attempted(df).groupBy(key).agg(F.bool_and(ok).alias(name))
    change = F.when(F.col("now") & ~F.col("then"), "improved").when(~F.col("now") & F.col("then"), "regressed").when(~F.col("now"), "unchanged_wrong")
    return side(current, "now").join(side(previous, "then"), key).withColumn("change", change).where("change IS NOT NULL").select(key, "change")


def metric_delta(metrics: DataFrame) -> DataFrame:
    """Each value with the previous one of its stream and metric."""
    before = F.lag("value").over(Window.partitionBy("stream", "metric").orderBy("ts"))
    return metrics.withColumn("previous", before).withColumn("delta", F.round(F.col("value") - F.col("previous"), 3))


def gold_staleness(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Disagreements since a document's label was last confirmed, by direction; crashes say nothing."""
    newest = labels.groupBy(key).agg(F.max("ts").alias("confirmed_ts"))
    wrong = attempted(rows).where(~F.col("crash") & (F.col("pred_verdict") != F.col("gold_verdict")))
    way = verdict_direction(F.col("pred_verdict"), F.col("gold_verdict"))
    return (
        wrong.join(newest, key).where(F.col("ts") > F.col("confirmed_ts"))
        .groupBy(key).agg(F.count("*").alias("disagreements"), F.count_if(way == "unsafe").alias("unsafe"), F.count_if(way == "safe").alias("safe"))
    )


def staleness_ranking(stale: DataFrame, key: str) -> DataFrame:
    return stale.orderBy(F.desc("disagreements"), F.desc("unsafe"), key)


# ---- rules


def findings_with_labels(findings: DataFrame, runs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a firing: run, time, class, rule, confirmed, gold verdict."""
    known = labels.groupBy("run_id").agg(F.bool_or("confirmed").alias("confirmed"), F.max_by("verdict_gold", "ts").alias("verdict_gold"))
    return (
        findings.join(runs.select("run_id", "ts", "doc_class"), "run_id").join(known, "run_id", "left")
        .withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    )


def rule_stats(fired: DataFrame, rules: DataFrame, now: str) -> DataFrame:
    """Per rule: firings, firings on confirmed documents, hits (gold at least as strict), precision, its lower bound, age in days.

    Rules that never fired are there too; a rule without effect has no precision.
    """
    per = fired.groupBy("doc_class", "rule_id").agg(
        F.count("*").alias("fired"), F.count_if("confirmed").alias("n"),
        F.count_if(F.col("confirmed") & (verdict_rank(F.col("verdict_gold")) >= verdict_rank(F.col("verdict_effect")))).alias("hits"),
        F.min("ts").alias("first_seen"),
    )
    joined = rules.select("doc_class", "rule_id", "tier", F.col("verdict_effect").alias("effect")).join(per, ["doc_class", "rule_id"], "left")
    weighs = F.col("effect").isNotNull()
    n, hits = F.when(weighs, F.coalesce("n", F.lit(0))).otherwise(0), F.when(weighs, F.coalesce("hits", F.lit(0))).otherwise(0)
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("first_seen")) / 86400.0
    return joined.select(
        "doc_class", "rule_id", "tier", F.coalesce("fired", F.lit(0)).alias("fired"), n.alias("confirmed"), hits.alias("hits"),
        F.when(n > 0, F.round(F.try_divide(hits, n), 3)).alias("precision"), F.when(n > 0, wilson(hits, n)[0]).alias("wilson_lb"), F.round(age, 1).alias("age_days"),
    )


def tier_proposals(stats: DataFrame) -> DataFrame:
    """Promotions and demotions that the policy allows; a person decides."""
    cases = [
        F.struct(
            ((F.col("tier") == a) & (F.col("confirmed") >= n) & (F.col("wilson_lb") >= lb) & (F.col("age_days") >= days)).alias("ok"),
            F.lit("promotion").alias("kind"), F.lit(b).alias("to_tier"),
        )
        for (a, b), (n, lb, days) in PROMOTION.items()
    ] + [
        F.struct(((F.col("tier") == a) & (F.col("confirmed") >= n) & (F.col("wilson_lb") <= lb)).alias("ok"), F.lit("demotion").alias("kind"), F.lit(b).alias("to_tier"))
        for a, (n, lb, b) in DEMOTION.items()
    ]
    return (
        stats.where("precision IS NOT NULL").select("*", F.inline(F.array(*cases))).where("ok")
        .select("doc_class", "rule_id", "kind", F.col("tier").alias("from_tier"), "to_tier", F.col("confirmed").alias("n"), "hits", "wilson_lb")
    )


def approval_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("doc_class", "status").agg(F.count("*").alias("n"))


def adoption_gate(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(stream, ok, reasons) from metric rows: nothing leaked, no invoice accepted, no critical field worse."""
    both = candidate.select("stream", "metric", F.col("value").alias("now")).join(baseline.select("stream", "metric", F.col("value").alias("then")), ["stream", "metric"], "left")
    reason = (
        F.when(F.col("metric").isin("leakage_count", "invoice_false_accept_rate") & (F.col("now") > 0), F.concat("metric", F.lit(" must be 0")))
        .when(F.col("metric").isin(*CRITICAL_FIELDS) & (F.col("now") < F.col("then")), F.concat("metric", F.lit(" got worse")))
    )
    per = both.withColumn("reason", reason).groupBy("stream").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))
    return per.select("stream", (F.size("reasons") == 0).alias("ok"), "reasons")
