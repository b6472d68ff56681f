"""From labels to training sets: queues, precedents, splits, picks, exports, estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vouchlake.functions.columns import digits_of, text_of, verdict_rank


def newest_per(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """One row a key: the newest, ties to the greatest `tie`."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def upsert_labels(labels: DataFrame, new: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """One label a document; the newest replaces."""
    return newest_per(labels.unionByName(new), key, ts, tie)


def label_lifecycle(labels: DataFrame, key: str) -> DataFrame:
    """First labelled, last confirmed, and how often confirmed."""
    return labels.groupBy(key).agg(
        F.min("ts").alias("label_ts"), F.max(F.when(F.col("confirmed"), F.col("ts"))).alias("last_confirmed_ts"), F.count_if("confirmed").alias("confirm_count")
    )


def precedent_override(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict after what operators decided on the same document.

    A label may always tighten. It relaxes only if confirmed; else the machine's verdict
    stands and OPERATOR-2 says so.
    """
    known = labels.groupBy("run_id").agg(F.max_by("verdict_gold", "ts").alias("gold"), F.bool_or("confirmed").alias("confirmed"))
    softer = verdict_rank(F.col("gold")) < verdict_rank(F.col("verdict"))
    held = softer & ~F.col("confirmed")
    return runs.join(known, "run_id", "left").select(
        "run_id", F.col("verdict").alias("model_verdict"),
        F.when(F.col("gold").isNull() | held, F.col("verdict")).otherwise(F.col("gold")).alias("verdict"),
        F.when(F.col("gold").isNull() | (F.col("gold") == F.col("verdict")), None).when(held, "OPERATOR-2").otherwise("OPERATOR-1").alias("finding"),
    )


def uncovered_tags(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """(run_id, tag): tags of runs that no label covers. The anti-join's side is one row a tag."""
    return runs.select("run_id", "tag").join(labels.select("tag").distinct(), "tag", "left_anti")


def unlabelled_runs(runs: DataFrame, labels: DataFrame) -> DataFrame:
    return runs.join(labels.select("run_id"), "run_id", "left_anti")


def training_queue(runs: DataFrame, labels: DataFrame, n: int = 12, changes: DataFrame | None = None) -> DataFrame:
    """The runs that teach most when labelled next, most points first, then newest.

    Without a label: doubtful verdicts 3 and 2, escalations, conflicts and scenarios that
    no label covers 2 each. With one: 3 if the last evaluation says it regressed, 1 if it
    is still wrong (changes: run_id, change of `eval_diff`); a label may be out of date.
    """
    fresh = labels.select("tag").distinct().withColumn("covered", F.lit(True))
    scored = unlabelled_runs(runs, labels).join(fresh, "tag", "left").withColumn(
        "score",
        F.when(F.col("verdict") == "NEED_MANUAL_REVIEW", 3).when(F.col("verdict") == "WARNING", 2).otherwise(0)
        + F.when(F.col("escalated"), 2).otherwise(0) + F.when(F.col("conflict"), 2).otherwise(0) + F.when(F.col("covered").isNull(), 2).otherwise(0),
    ).select("run_id", "score", "verdict", "ts")
    if changes is not None:
        points = F.when(F.col("change") == "regressed", 3).when(F.col("change") == "unchanged_wrong", 1).otherwise(0)
        known = runs.join(labels.select("run_id").distinct(), "run_id", "left_semi").join(changes, "run_id")
        scored = scored.unionByName(known.select("run_id", points.alias("score"), "verdict", "ts"))
    return scored.where("score > 0").orderBy(F.desc("score"), F.desc("ts"), "run_id").limit(n).select("run_id", "score", "verdict")


def scenario_tags(runs: DataFrame) -> DataFrame:
    """run_id, tags that the run's own facts suggest.

    runs: run_id, doc_class, doc_type, and what there is of has_text, rotated, letter_page,
    invoice_page, aba, aba_wires, sap, tin_boxed, signed, checkbox_conflict (booleans) and
    rule_ids (array). What is missing counts as unknown.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in runs.columns else F.lit(False)
    no = lambda c: F.coalesce(~F.col(c), F.lit(False)) if c in runs.columns else F.lit(False)
    fired = lambda r: F.array_contains(F.coalesce("rule_ids", F.array().cast("array<string>")), r) if "rule_ids" in runs.columns else F.lit(False)
    is_type = lambda t: F.coalesce(F.col("doc_type") == t, F.lit(False))
    bank, both = F.col("doc_class") == "bank", yes("letter_page") & yes("invoice_page")
    # fixed values: the names of the tags
    cases = [
        (no("has_text"), F.concat("doc_class", F.lit("_image_only"))), (yes("rotated"), F.concat("doc_class", F.lit("_rotated_photo"))),
        *((bank & c, F.lit(t)) for t, c in {
            "bank_invoice_plus_letter": both, "bank_invoice_only": ~both & is_type("invoice"), "bank_typed_officer_block": fired("BNK-026"), "bank_multi_aba": yes("aba") & yes("aba_wires"),
            "bank_sap_compare": yes("sap"), "bank_supplier_letterhead": is_type("supplier_letterhead"), "bank_email_support": is_type("email"),
        }.items()),
        *((~bank & c, F.lit(t)) for t, c in {
            "w9_boxed_tin": yes("tin_boxed"), "w9_checkbox_error": yes("checkbox_conflict"), "w9_line_swap": fired("W9-013"), "w9_unsigned": no("signed"), "w8_form": is_type("w8"),
        }.items()),
    ]
    return runs.select("run_id", F.array_compact(F.array(*(F.when(c, t) for c, t in cases))).alias("tags"))


def missing_documents(labels: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """labels with skipped: whether the document is not there. Such rows are counted, and take no part in metrics."""
    there = documents.select(key).distinct().withColumn("_there", F.lit(True))
    return labels.join(there, key, "left").withColumn("skipped", F.col("_there").isNull()).drop("_there")


def exemplar_values(live: DataFrame, snapshot: DataFrame) -> DataFrame:
    """doc_id, value of all examples, live or in the snapshot, each once."""
    return live.select("doc_id", "value").unionByName(snapshot.select("doc_id", "value")).distinct()


def freshness(made: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows that a corpus made anew and the committed one don't share, with where they are; none if the corpus is fresh."""
    gone, new = committed.exceptAll(made), made.exceptAll(committed)
    return new.withColumn("only_in", F.lit("made")).unionByName(gone.withColumn("only_in", F.lit("committed")))


def recent_runs(runs: DataFrame, labels: DataFrame, n: int = 50) -> DataFrame:
    """The newest runs, and whether each has a label."""
    top = runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)
    known = labels.select("run_id").distinct().withColumn("labeled", F.lit(True))
    return top.join(known, "run_id", "left").select("run_id", "verdict", F.coalesce("labeled", F.lit(False)).alias("labeled"))


def stratified_split(labels: DataFrame, share: float = 0.85) -> DataFrame:
    """label -> train or valid: the first share of each (class, type); one alone trains.

    If that leaves nothing to validate on, the last label of the last group does.
    """
    kind = Window.partitionBy("doc_class", "doc_type_gold")
    place, total = F.row_number().over(kind.orderBy("run_id")), F.count("*").over(kind)
    cut = F.when(total > 1, F.greatest(F.lit(1), F.floor(total * share))).otherwise(1)
    parted = labels.where("confirmed").select("run_id", "doc_class", "doc_type_gold", F.when(place <= cut, "train").otherwise("valid").alias("part"))
    seen = parted.agg(F.count_if(F.col("part") == "valid").alias("valid"), F.max(F.struct("doc_class", "doc_type_gold", "run_id")).alias("last"))
    moved = (F.col("valid") == 0) & (F.struct("doc_class", "doc_type_gold", "run_id") == F.col("last"))
    # one row of totals beside every label
    return parted.join(F.broadcast(seen)).select("run_id", "doc_class", "doc_type_gold", F.when(moved, "valid").otherwise(F.col("part")).alias("part"))


def teaching_value(labels: DataFrame) -> DataFrame:
    """label -> changed fields, three more for a changed type, and twice the completeness."""
    value = F.col("changed_fields") + F.when(F.col("type_changed"), 3).otherwise(0) + 2 * F.col("completeness")
    return labels.select("run_id", "doc_class", "doc_type_gold", "tag", value.alias("value"))


def cover_select(labels: DataFrame, k: int = 2) -> DataFrame:
    """k labels a class, each adding the most tags and types not yet shown, then the most teaching value.

    A pick is one grouped maximum; what was picked so far is one row a class.
    """
    pool = teaching_value(labels.where("confirmed")).withColumn("units", F.array_distinct(F.array("tag", F.concat(F.lit("type:"), "doc_type_gold"))))
    shown = pool.select("doc_class").distinct().select("doc_class", F.array().cast("array<string>").alias("seen"), F.array().cast("array<bigint>").alias("picks"))
    for _ in range(k):
        left = pool.join(shown, "doc_class").where(~F.array_contains("picks", F.col("run_id")))
        best = left.groupBy("doc_class").agg(
            F.max(F.struct(F.size(F.array_except("units", "seen")).alias("new"), "value", (-F.col("run_id")).alias("neg"), "units")).alias("b")
        )
        shown = shown.join(best, "doc_class", "left").select(
            "doc_class", F.when(F.col("b").isNull(), F.col("seen")).otherwise(F.array_union("seen", "b.units")).alias("seen"),
            F.when(F.col("b").isNull(), F.col("picks")).otherwise(F.array_append("picks", -F.col("b.neg"))).alias("picks"),
        )
    return shown.select("doc_class", F.posexplode("picks").alias("pick", "run_id"))


def chat_export(examples: DataFrame) -> DataFrame:
    """One JSON line an example: system, user, assistant."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return examples.select(F.to_json(F.struct(F.array(say("system", "system"), say("user", "input"), say("assistant", "output")).alias("messages"))).alias("value"))


#: Seconds of a run with and without a text layer, and what each option adds.
BASE_SECONDS = {"text": 20, "scan": 90}
ADDED_SECONDS = {"v": 30, "q": 60, "sap": 30}


def duration_estimate(runs: DataFrame, last: int = 5, shapes: DataFrame | None = None) -> DataFrame:
    """Per shape: mean of the newest durations, to five seconds, from two on.

    With shapes (shape_key): one row each; those with too little history get the base of
    their text layer and what their options add.
    """
    order = Window.partitionBy("shape_key").orderBy(F.desc("ts"), F.desc("run_id"))
    newest = runs.withColumn("at", F.row_number().over(order)).where(F.col("at") <= last)
    known = newest.groupBy("shape_key").agg(F.avg("duration_s").alias("m"), F.count("*").alias("k")).where("k >= 2").select(
        "shape_key", (F.round(F.col("m") / 5) * 5).alias("seconds")
    )
    if shapes is None:
        return known
    parts = F.split("shape_key", r"\|")
    table = F.when(F.array_contains(parts, "text"), BASE_SECONDS["text"]).otherwise(BASE_SECONDS["scan"])
    for option, seconds in ADDED_SECONDS.items():
        table = table + F.when(F.array_contains(parts, option), seconds).otherwise(0)
    return shapes.select("shape_key").distinct().join(known, "shape_key", "left").select("shape_key", F.coalesce("seconds", table.cast("double")).alias("seconds"))


def learning_trace(labels: DataFrame, runs: DataFrame) -> DataFrame:
    """What a label changed and what the machine says now."""
    return labels.join(runs.select("run_id", "verdict"), "run_id").select(
        "run_id", F.col("verdict_gold").alias("corrected"), F.col("verdict").alias("now"), (F.col("verdict_gold") == F.col("verdict")).alias("ok")
    )


def field_trace(corrections: DataFrame, values: DataFrame) -> DataFrame:
    """run_id, field, before, corrected, now, ok of every corrected field.

    corrections: run_id, field, before, corrected; values: run_id, field, value as read
    today. Values with four digits or more on both sides are equal by the last four (one
    may be masked), others as text, without regard to case; nothing on both sides is equal.
    """
    both = corrections.join(values.select("run_id", "field", F.col("value").alias("now")), ["run_id", "field"], "left")
    now, wanted = text_of(F.col("now")), text_of(F.col("corrected"))
    a, b = digits_of(now), digits_of(wanted)
    same = F.when((F.length(a) >= 4) & (F.length(b) >= 4), F.right(a, F.lit(4)) == F.right(b, F.lit(4))).otherwise(F.lower(now) == F.lower(wanted))
    return both.select("run_id", "field", "before", wanted.alias("corrected"), now.alias("now"), same.alias("ok"))


def erase_documents(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids, key, "left_anti")


def label_counts(labels: DataFrame, least: int = 100) -> DataFrame:
    counted = labels.where("confirmed").groupBy("doc_class").agg(F.count("*").alias("n"))
    return counted.withColumn("export_allowed", F.col("n") >= least)


def manifest(labels: DataFrame) -> DataFrame:
    """Documents and share of agreement a tag."""
    return labels.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg(F.col("confirmed").cast("double")), 3).alias("agreement"))


def stratum_manifest(judged: DataFrame) -> DataFrame:
    """tag, n, agreement of a corpus with known truth: how many documents a tag has, and for what share the verdict on what was read is that on the true fields.

    judged: tags (array), truth_verdict, verdict of each document. Tag 'all' is the whole
    corpus; a document without a verdict agrees with nothing. Tags are folded before the shuffle.
    """
    agree = F.coalesce(F.col("verdict") == F.col("truth_verdict"), F.lit(False)).cast("double")
    tagged = judged.select(F.explode(F.array_distinct(F.array_append("tags", F.lit("all")))).alias("tag"), agree.alias("agree"))
    return tagged.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("agree"), 3).alias("agreement"))
