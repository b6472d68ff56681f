"""The corpus with known truth: its documents, what is read of them, and how far the verdicts agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlake.functions.columns import IBAN_LENGTH
from vouchlake.functions.frames import beside, spread
from vouchlake.operators import extract as X
from vouchlake.operators import guards as G
from vouchlake.operators.reading import read_texts
from vouchlake.operators.teach import stratum_manifest as manifest_of
from vouchlake.plans.rules import COMPENSATING, verdict_in_place
from vouchlake.queries.extraction import checked, has_sql, hint_sql, officer_sql
from vouchlake.queries.guarding import said_sql
from vouchlake.queries.registry import query
from vouchlake.sources.corpus import DUCK_ONE, corpus_sql, make_corpus

_CORPUS = "corpus AS (" + corpus_sql("(SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) customer_keys").replace("{one}", DUCK_ONE).strip() + ")"
_LENGTHS = "CASE substr(iban, 1, 2) " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in IBAN_LENGTH.items()) + " ELSE 0 END"
_EVIDENCED = "doc_type IN ('bank_letter','bank_statement','supplier_letterhead','bank_screenshot','voided_check','ap_document','payment_instructions','other')"
_COMPENSATED = "(" + " OR ".join(f"contains(lower(signature_evidence), '{p}')" for p in COMPENSATING) + ")"
_CLASS = """CASE WHEN regexp_matches(lower(line3_classification), 'individual|sole') THEN 'individual' WHEN regexp_matches(lower(line3_classification), 'llc|limited liability|partnership|corporation|trust|estate') THEN 'company' ELSE '' END"""


def verdict_sql(table: str, name: str) -> str:
    """CTE `name`: doc_id, verdict of the rules that have an effect, over a table of fields."""
    return f"""{name} AS (
  SELECT doc_id, CASE rank WHEN 3 THEN 'REJECT' WHEN 2 THEN 'NEED_MANUAL_REVIEW' WHEN 1 THEN 'WARNING' ELSE 'ACCEPT' END AS verdict FROM (
    SELECT doc_id, CASE WHEN doc_class = 'bank' THEN greatest(
        CASE WHEN doc_type = 'invoice' THEN 3 ELSE 0 END, CASE WHEN doc_type = 'payment_instructions' THEN 1 ELSE 0 END,
        CASE WHEN swift_bic <> '' AND NOT regexp_matches(swift_bic, '^[A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?$') THEN 2 ELSE 0 END,
        CASE WHEN NOT regexp_matches(iban, '^[0-9]*$') AND NOT (length(iban) = {_LENGTHS} AND {checked('iban')}) THEN 2 ELSE 0 END,
        CASE WHEN doc_type = 'bank_letter' AND NOT signed AND NOT {_COMPENSATED} THEN 1 ELSE 0 END,
        CASE WHEN {_EVIDENCED} AND (account_holder = '' OR (iban = '' AND account_number = '' AND routing_aba = '')) THEN 2 ELSE 0 END,
        CASE WHEN doc_type IN ('bank_letter','bank_statement','bank_screenshot','voided_check') AND bank_name = '' THEN 1 ELSE 0 END,
        CASE WHEN doc_type = 'other' THEN 2 ELSE 0 END)
      ELSE greatest(
        CASE WHEN doc_type <> 'w9' THEN 2 ELSE 0 END,
        CASE WHEN doc_type = 'w9' AND (line1_name = '' OR tin_raw = '' OR line3_classification = '' OR length(regexp_replace(tin_raw, '[^0-9]', '', 'g')) <> 9) THEN 2 ELSE 0 END,
        CASE WHEN doc_type = 'w9' AND {_CLASS} = 'individual' AND tin_type = 'EIN' THEN 2 ELSE 0 END,
        CASE WHEN doc_type = 'w9' AND {_CLASS} = 'company' AND tin_type = 'SSN' THEN 2 ELSE 0 END,
        CASE WHEN doc_type = 'w9' AND NOT signed THEN 1 ELSE 0 END) END AS rank
    FROM {table}))"""


_ESIGNED, _TYPED = has_sql("lower(ids.text)", X.ESIGN), has_sql("lower(ids.text)", X.TYPED)
_BARE = r"lambda x: regexp_replace(x, '[\s\-]', '', 'g')"
_OTHER = "x <> routing_aba AND x <> national_clearing"
_READING = rf"""texts AS (SELECT doc_id, text, '' AS file_name, '' AS ext FROM corpus),
{hint_sql("texts")},
ids AS (SELECT doc_id, text,
  replace(regexp_extract(text, '{X.IBAN}', 1), ' ', '') AS iban0,
  upper(coalesce(nullif(regexp_extract(text, '{X.BIC_LABELLED}', 1), ''), list_filter(regexp_extract_all(text, '{X.BIC}', 1), lambda x: regexp_matches(x, '[0-9]'))[1], '')) AS swift_bic,
  regexp_extract(text, '(^|[^0-9-])([0-9]{{2}}-[0-9]{{7}})($|[^0-9-])', 2) AS ein, regexp_replace(regexp_extract(text, '{X.EIN_BOXED}', 1), '[^0-9]', '', 'g') AS boxed_ein,
  regexp_extract(text, '{X.ROUTING}', 2) AS routing_aba, regexp_extract(text, '{X.CLEARING["CNAPS"]}', 1) AS national_clearing,
  regexp_extract(text, '((?:[0-9-]\n){{9,13}})', 1) AS run, {said_sql("text")} AS holder FROM texts),
fields AS (SELECT ids.doc_id, ids.text, hint.doc_class, CASE WHEN hint <> '' THEN hint WHEN hint.doc_class = 'bank' THEN 'other' ELSE 'unknown' END AS doc_type,
  CASE WHEN length(holder) BETWEEN 3 AND 70 THEN holder ELSE '' END AS account_holder, CASE WHEN length(iban0) BETWEEN 15 AND 34 THEN iban0 ELSE '' END AS iban, swift_bic, routing_aba, national_clearing,
  CASE WHEN ein <> '' THEN ein WHEN length(boxed_ein) = 9 THEN substr(boxed_ein, 1, 2) || '-' || substr(boxed_ein, 3) ELSE '' END AS found_ein,
  CASE WHEN length(regexp_replace(run, '[^0-9]', '', 'g')) = 9 THEN regexp_replace(run, '[^0-9]', '', 'g') ELSE '' END AS tin_boxed, lower(substr(ids.text, 1, instr(ids.text, run) - 1)) AS before,
  list_filter(list_transform(regexp_extract_all(ids.text, '{X.ACCOUNT}', 1), {_BARE}), lambda x: length(x) BETWEEN 6 AND 18 AND {_OTHER}) AS labelled,
  list_filter(list_transform(regexp_extract_all(ids.text, '{X.LONG_RUN}'), {_BARE}), lambda x: length(x) BETWEEN 11 AND 18 AND {_OTHER}) AS runs,
  {_ESIGNED} AS signed, CASE WHEN {_ESIGNED} THEN 'electronically signed' WHEN {_TYPED} THEN 'computer generated' WHEN {officer_sql("ids.text")} THEN 'typed officer block' ELSE '' END AS signature_evidence
  FROM ids JOIN hint ON hint.doc_id = ids.doc_id),
reading AS (SELECT doc_id, doc_class, doc_type, account_holder, iban, swift_bic, routing_aba, national_clearing, '' AS bank_name, signed, signature_evidence,
  coalesce(labelled[1], list_filter(runs, lambda x: length(x) = list_max(list_transform(runs, lambda y: length(y))))[1], '') AS account_number, CASE WHEN found_ein <> '' THEN found_ein ELSE tin_boxed END AS tin_raw,
  CASE WHEN found_ein <> '' THEN 'EIN' WHEN tin_boxed = '' THEN '' WHEN contains(before, 'employer identification') THEN 'EIN' WHEN contains(before, 'social security') THEN 'SSN' ELSE '' END AS tin_type,
  '' AS line1_name, '' AS line3_classification FROM fields)"""
_FIELDS = ("doc_type", "account_holder", "iban", "swift_bic", "account_number", "routing_aba", "national_clearing", "signed", "signature_evidence", "tin_raw", "tin_type")


def _numbers(customer):
    return make_corpus(spread(customer.select(F.col("c_custkey").cast("long").alias("k")), "k"))


@query(
    "corpus",
    "customer",
    sql=f"WITH {_CORPUS}, {verdict_sql('corpus', 'truth')} SELECT doc_id, layout, lang, sig, validity, {', '.join(_FIELDS)}, tags, text, verdict AS truth_verdict FROM corpus JOIN truth USING (doc_id)",
)
def corpus(customer):
    return _numbers(customer).select("doc_id", "layout", "lang", "sig", "validity", *_FIELDS, "tags", "text", "truth_verdict")


@query("corpus_readings", "customer", sql=f"WITH {_CORPUS}, {_READING} SELECT doc_id, {', '.join(_FIELDS)} FROM reading")
def corpus_readings(customer):
    return read_texts(_numbers(customer)).select("doc_id", *_FIELDS)


@query(
    "stratum_manifest",
    "customer",
    sql=f"""WITH {_CORPUS}, {verdict_sql('corpus', 'truth')}, {_READING}, {verdict_sql('reading', 'machine')},
tagged AS (SELECT unnest(list_append(string_split(tags, ','), 'all')) AS tag, CAST(truth.verdict = machine.verdict AS DOUBLE) AS agree FROM corpus JOIN truth USING (doc_id) JOIN machine USING (doc_id))
SELECT tag, count(*) AS n, round(avg(agree), 3) AS agreement FROM tagged GROUP BY 1""",
)
def stratum_manifest(customer):
    both = beside(read_texts(_numbers(customer), ("tags", "truth_verdict")), verdict_in_place)
    return manifest_of(both.withColumn("tags", F.split("tags", ",")))
