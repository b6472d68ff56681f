"""Rules, gate, trace and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlake.functions.columns import mask_value
from vouchlake.operators.evaluate import approval_counts as approval_counts_of
from vouchlake.plans import rules as R
from vouchlake.queries.registry import mod97, query

_COMPENSATED = "(" + " OR ".join(f"contains(lower(signature_evidence), '{p}')" for p in R.COMPENSATING) + ")"
_FOUND = f"""
base AS (
  SELECT *, CASE WHEN bank_country = 'CZ' THEN '' ELSE bank_country END AS bc,
    doc_type IN ('bank_letter','bank_statement','supplier_letterhead','bank_screenshot','voided_check','ap_document','payment_instructions','other') AS evidence
  FROM vendor
), found AS (
  SELECT doc_id, 'BNK-001' AS rule_id, 'CRITICAL' AS severity, 'REJECT' AS verdict_effect, '' AS detail FROM base WHERE doc_type = 'invoice'
  UNION ALL SELECT doc_id, 'BNK-004', 'WARNING', 'WARNING', '' FROM base WHERE doc_type = 'payment_instructions'
  UNION ALL SELECT doc_id, 'BNK-006', 'NOTE', NULL, 'absent' FROM base WHERE doc_type = 'bank_statement' AND swift_bic = ''
  UNION ALL SELECT doc_id, 'BNK-010', 'CRITICAL', 'NEED_MANUAL_REVIEW',
    CASE WHEN length(swift_bic) NOT IN (8, 11) THEN 'has ' || length(swift_bic) || ' characters instead of 8 or 11'
         ELSE 'the BIC says ' || substr(swift_bic, 5, 2) || ', the bank sits in ' || bc END
    FROM base WHERE swift_bic <> '' AND (length(swift_bic) NOT IN (8, 11) OR (bc <> '' AND substr(swift_bic, 5, 2) <> bc))
  UNION ALL SELECT doc_id, 'BNK-011', 'CRITICAL', 'NEED_MANUAL_REVIEW',
    CASE WHEN bc <> '' AND substr(iban, 1, 2) <> bc THEN 'the IBAN says ' || substr(iban, 1, 2) || ', the bank sits in ' || bc
         ELSE 'the check digits do not fit' END
    FROM base WHERE iban <> '' AND ((bc <> '' AND substr(iban, 1, 2) <> bc) OR NOT {mod97('iban')})
  UNION ALL SELECT doc_id, 'BNK-020', 'NOTE', NULL, 'dated 2019-01-15, full years since: ' || CAST(date_diff('day', DATE '2019-01-15', DATE '2026-07-09') // 365 AS VARCHAR)
    FROM base WHERE doc_date = '2019-01-15'
  UNION ALL SELECT doc_id, 'BNK-021', 'WARNING', 'WARNING', CASE WHEN signature_evidence = '' THEN 'nothing that signs can be seen' ELSE 'unsigned; what is noted (''' || signature_evidence || ''') signs nothing' END
    FROM base WHERE doc_type = 'bank_letter' AND NOT signed AND NOT {_COMPENSATED}
  UNION ALL SELECT doc_id, 'BNK-026', 'NOTE', NULL, signature_evidence FROM base WHERE doc_type = 'bank_letter' AND NOT signed AND {_COMPENSATED}
  UNION ALL SELECT doc_id, 'BNK-027', 'NOTE', NULL, '' FROM base WHERE doc_type = 'payment_instructions' AND settlement_issuer_strong
  UNION ALL SELECT doc_id, 'BNK-031', 'WARNING', 'NEED_MANUAL_REVIEW', ''
    FROM base WHERE doc_type IN ('bank_letter','bank_statement','payment_instructions','supplier_letterhead') AND distinct_accounts
  UNION ALL SELECT doc_id, 'BNK-023', 'WARNING', 'NEED_MANUAL_REVIEW', '' FROM base WHERE evidence AND account_holder = ''
  UNION ALL SELECT doc_id, 'BNK-024', 'WARNING', 'NEED_MANUAL_REVIEW', 'nothing names an account'
    FROM base WHERE evidence AND iban = '' AND account_number = '' AND routing_aba = ''
  UNION ALL SELECT doc_id, 'BNK-025', 'WARNING', 'WARNING', ''
    FROM base WHERE doc_type IN ('bank_letter','bank_statement','bank_screenshot','voided_check') AND bank_name = ''
  UNION ALL SELECT doc_id, 'BNK-030', 'WARNING', 'NEED_MANUAL_REVIEW', '' FROM base WHERE doc_type = 'other'
)"""
_RANK = "CASE verdict_effect WHEN 'REJECT' THEN 3 WHEN 'NEED_MANUAL_REVIEW' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END"
_NAME = "CASE {0} WHEN 3 THEN 'REJECT' WHEN 2 THEN 'NEED_MANUAL_REVIEW' WHEN 1 THEN 'WARNING' ELSE 'ACCEPT' END"
_VERDICT = f"""
WITH {_FOUND}, worst AS (SELECT doc_id, max({_RANK}) AS r FROM found GROUP BY doc_id),
verdicts AS (SELECT base.doc_id, base.doc_type, {_NAME.format("coalesce(r, 0)")} AS verdict FROM base LEFT JOIN worst USING (doc_id))
"""


@query("verdict_by_doc", "vendor", sql=f"{_VERDICT} SELECT doc_id, verdict FROM verdicts")
def verdict_by_doc(vendor):
    return R.verdict_in_place(vendor)


@query("verdict_by_fold", "vendor", sql=f"{_VERDICT} SELECT doc_id, verdict FROM verdicts")
def verdict_by_fold(vendor):
    return R.fold_verdict(R.apply_rules(vendor), vendor)


@query("verdict_counts", "vendor", sql=f"{_VERDICT} SELECT doc_type, verdict, count(*) AS n FROM verdicts GROUP BY 1, 2")
def verdict_counts(vendor):
    return R.verdict_in_place(vendor).join(vendor.select("doc_id", "doc_type"), "doc_id").groupBy("doc_type", "verdict").agg(F.count("*").alias("n"))


@query("findings_long", "vendor", sql=f"WITH {_FOUND} SELECT doc_id, rule_id, severity, verdict_effect, detail FROM found")
def findings_long(vendor):
    return R.apply_rules(vendor).select("doc_id", "rule_id", "severity", "verdict_effect", "detail")


@query(
    "findings_summary",
    "vendor",
    sql=f"""{_VERDICT}
SELECT v.doc_id, v.verdict, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'NOTE') AS notes,
  CASE v.verdict {' '.join(f"WHEN '{k}' THEN '{t}'" for k, t in R.NEXT_STEP['bank'].items())} END AS next_step
FROM verdicts v LEFT JOIN found USING (doc_id) GROUP BY 1, 2""",
)
def findings_summary(vendor):
    found = R.apply_rules(vendor)
    return R.findings_summary(found, R.fold_verdict(found, vendor).withColumn("doc_class", F.lit("bank"))).drop("why")


def _approvals(runs):
    """A ledger of one entry a run: each is about one rule; the newest of a rule says that every fifth is rejected and every fourth has changed since."""
    n = len(R.RULES)
    rules = R.rule_table(runs.sparkSession).select((F.col("seq") - 1).cast("long").alias("k"), "doc_class", "rule_id", "rule_hash")
    entries = runs.select((F.col("run_id") % n).alias("k"), "ts", "run_id")
    newest = entries.groupBy("k").agg(F.max(F.struct("ts", "run_id")).alias("m"))
    last = entries.join(newest, "k").join(F.broadcast(rules), "k").withColumn("is_last", F.struct("ts", "run_id") == F.col("m"))
    state = F.when(~F.col("is_last"), "rejected").when(F.col("k") % 5 == 4, "REJECTED").otherwise("APPROVED")
    return last.select("doc_class", "rule_id", state.alias("status"), F.when(F.col("is_last") & (F.col("k") % 4 == 3), "stale").otherwise(F.col("rule_hash")).alias("hash"), F.struct("ts", "run_id").alias("ts"))


_STATUS = {(r.doc_class, r.rule_id): "pending" if k % 4 == 3 else "rejected" if k % 5 == 4 else "approved" for k, r in enumerate(R.RULES)}
_STATUS_SQL = ", ".join(f"('{i}', '{s}')" for (c, i), s in _STATUS.items() if c == "bank")
_TYPES_SQL = ", ".join(f"('{r.rule_id}', {k}, '{' '.join(r.applies_to)}')" for k, r in enumerate(R.RULES) if r.doc_class == "bank")
_GATE = f"""
WITH {_FOUND}, state(rule_id, status) AS (VALUES {_STATUS_SQL}), rule(rule_id, seq, types) AS (VALUES {_TYPES_SQL}),
pending AS (
  SELECT doc_id, count(*) AS n FROM base JOIN rule ON types = '' OR list_contains(string_split(types, ' '), doc_type) JOIN state USING (rule_id)
  WHERE status = 'pending' GROUP BY 1
), gated AS (
  SELECT doc_id, rule_id, verdict_effect FROM found JOIN state USING (rule_id) WHERE status = 'approved'
  UNION ALL SELECT doc_id, 'RULE-GATE', 'NEED_MANUAL_REVIEW' FROM pending
)"""


@query("rule_gate", "vendor", "runs", sql=f"{_GATE} SELECT doc_id, rule_id, verdict_effect FROM gated")
def rule_gate(vendor, runs):
    status = R.approval_status(_approvals(runs))
    return R.apply_rules(vendor, status=status).select("doc_id", "rule_id", "verdict_effect")


@query(
    "approval_counts",
    "runs",
    sql=f"SELECT doc_class, status, count(*) AS n FROM (VALUES {', '.join(repr((c, i, s)) for (c, i), s in _STATUS.items())}) t(doc_class, rule_id, status) WHERE (SELECT count(*) FROM runs) >= 0 GROUP BY 1, 2",
)
def approval_counts(runs):
    return approval_counts_of(R.status_table(runs.sparkSession, R.approval_status(_approvals(runs))))


@query(
    "rule_trace_counts",
    "vendor",
    "runs",
    sql=f"""{_GATE}, trace AS (
  SELECT rule.rule_id, CASE WHEN NOT (types = '' OR list_contains(string_split(types, ' '), doc_type)) THEN 'not-applicable'
    WHEN status <> 'approved' THEN 'skipped-' || status WHEN found.doc_id IS NOT NULL THEN 'fired' ELSE 'did-not-fire' END AS outcome
  FROM base CROSS JOIN rule JOIN state USING (rule_id) LEFT JOIN found ON found.doc_id = base.doc_id AND found.rule_id = rule.rule_id)
SELECT rule_id, outcome, count(*) AS n FROM trace GROUP BY 1, 2""",
)
def rule_trace_counts(vendor, runs):
    status = R.approval_status(_approvals(runs))
    bank = tuple(r for r in R.RULES if r.doc_class == "bank")
    return R.decision_trace(vendor, bank, status).groupBy("rule_id", "outcome").agg(F.count("*").alias("n"))


_TAX = """
WITH base AS (
  SELECT *, CASE WHEN line3_classification LIKE 'Individual%' THEN 'individual_sole_prop' WHEN line3_classification LIKE 'Limited%' THEN 'llc'
    WHEN line3_classification = 'Partnership' THEN 'partnership' WHEN line3_classification = 'C Corporation' THEN 'corporation'
    WHEN line3_classification = 'Trust/estate' THEN 'trust_estate' WHEN line3_classification = '' THEN '' ELSE 'other' END AS cls,
    regexp_matches(line1_name, ' LLC$') AS biz1, regexp_matches(line2_business_name, 'Company') AS biz2, length(regexp_replace(tin_raw, '[^0-9]', '', 'g')) AS n
  FROM tax
), found AS (
  SELECT doc_id, 'W9-030' AS rule_id, '' AS detail FROM base WHERE doc_type = 'w8'
  UNION ALL SELECT doc_id, 'W9-031', '' FROM base WHERE doc_type = 'unknown'
  UNION ALL SELECT doc_id, 'W9-001', '' FROM base WHERE doc_type = 'w9' AND line1_name = ''
  UNION ALL SELECT doc_id, 'W9-002', '' FROM base WHERE doc_type = 'w9' AND tin_raw = ''
  UNION ALL SELECT doc_id, 'W9-003', '' FROM base WHERE doc_type = 'w9' AND line3_classification = ''
  UNION ALL SELECT doc_id, 'W9-010', 'has ' || n || ' digits instead of 9' FROM base WHERE doc_type = 'w9' AND tin_raw <> '' AND n <> 9
  UNION ALL SELECT doc_id, 'W9-011', CASE WHEN tin_type = 'EIN' THEN 'a person''s class with an EIN, and no business is named' ELSE 'an SSN for class ' || cls END
    FROM base WHERE doc_type = 'w9' AND ((cls = 'individual_sole_prop' AND tin_type = 'EIN' AND line2_business_name = '') OR (cls IN ('llc', 'corporation', 'partnership', 'trust_estate') AND tin_type = 'SSN'))
  UNION ALL SELECT doc_id, 'W9-012', 'a person''s class, a business name and an EIN at once' FROM base WHERE doc_type = 'w9' AND cls = 'individual_sole_prop' AND tin_type = 'EIN' AND (biz1 OR biz2)
  UNION ALL SELECT doc_id, 'W9-013', CASE WHEN line1_name = '' THEN 'only line 2 is filled'
      ELSE 'line 1 names a business and line 2 a person, though the class is a person''s' END
    FROM base WHERE doc_type = 'w9' AND ((line1_name = '' AND line2_business_name <> '') OR (cls = 'individual_sole_prop' AND biz1 AND line2_business_name = 'Jane Q. Sample'))
  UNION ALL SELECT doc_id, 'W9-020', '' FROM base WHERE doc_type = 'w9' AND NOT signed
  UNION ALL SELECT doc_id, 'W8-001', '' FROM base WHERE doc_type = 'w8' AND NOT signed
  UNION ALL SELECT doc_id, 'W8-002', '' FROM base WHERE doc_type = 'w8' AND legal_name = ''
  UNION ALL SELECT doc_id, 'W8-003', 'nothing certifies status ''Active NFFE''' FROM base WHERE doc_type = 'w8' AND chapter4_status <> '' AND chapter4_cert_section = ''
  UNION ALL SELECT doc_id, 'W8-004', 'dated 2021-02-03, full years since: 5' FROM base WHERE doc_type = 'w8' AND sign_date = '2021-02-03'
  UNION ALL SELECT doc_id, 'W8-005', '' FROM base WHERE doc_type = 'w8' AND sign_date = ''
)
SELECT doc_id, rule_id, detail FROM found"""


@query("tax_rules", "tax", sql=_TAX)
def tax_rules(tax):
    return R.apply_rules(tax).select("doc_id", "rule_id", "detail")


@query(
    "mask_public_fields",
    "vendor",
    sql="""SELECT doc_id, CASE WHEN iban = '' THEN '' ELSE substr(iban, 1, 2) || '**…' || right(iban, 4) END AS iban_masked,
  CASE WHEN account_number = '' THEN '' ELSE '…' || right(account_number, 4) END AS account_masked, length(iban) AS iban_length, iban <> '' AS iban_present FROM vendor""",
)
def mask_public_fields(vendor):
    return vendor.select(
        "doc_id",
        mask_value(F.lit("iban"), F.col("iban")).alias("iban_masked"),
        mask_value(F.lit("account_number"), F.col("account_number")).alias("account_masked"),
        F.length("iban").cast("long").alias("iban_length"),
        (F.col("iban") != "").alias("iban_present"),
    )
