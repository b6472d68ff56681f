"""Inputs derived from the driver's tables by key arithmetic.

The statements use only what Spark SQL and DuckDB share, so that one text serves both:
Spark gets the tables as DataFrames, the oracle gets the same statements as CTEs.
Tax numbers lie in ranges that are never assigned; account data is made up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_COUNTRY = "CASE {k} % 6 WHEN 0 THEN 'DE' WHEN 1 THEN 'NL' WHEN 2 THEN 'ES' WHEN 3 THEN 'CZ' WHEN 4 THEN 'FR' ELSE 'GB' END"
_BBAN = "CASE cc WHEN 'DE' THEN 18 WHEN 'NL' THEN 14 WHEN 'ES' THEN 20 WHEN 'CZ' THEN 20 WHEN 'FR' THEN 23 ELSE 18 END"
# two-letter country as ISO 13616 digits
_DIGITS = "CASE cc WHEN 'DE' THEN 1314 WHEN 'NL' THEN 2321 WHEN 'ES' THEN 1428 WHEN 'CZ' THEN 1235 WHEN 'FR' THEN 1527 ELSE 1611 END"

VENDOR = """
SELECT k AS doc_id, 'bank' AS doc_class,
  CASE WHEN t <= 3 THEN 'bank_letter' WHEN t = 4 THEN 'bank_statement' WHEN t = 5 THEN 'payment_instructions'
       WHEN t = 6 THEN 'invoice' WHEN t = 7 THEN 'supplier_letterhead' WHEN t = 8 THEN 'voided_check' ELSE 'other' END AS doc_type,
  CASE WHEN k % 13 = 0 THEN '' ELSE name END AS account_holder,
  CASE WHEN k % 15 = 0 THEN '' ELSE 'Bank of ' || cc || ' ' || CAST(k % 50 AS STRING) END AS bank_name,
  CASE WHEN k % 9 = 4 THEN 'FR' ELSE cc END AS bank_country,
  CASE WHEN k % 23 = 5 THEN ''
       WHEN k % 7 = 3 THEN substr(good, 1, length(good) - 1) || CAST((CAST(substr(good, length(good), 1) AS INT) + 1) % 10 AS STRING)
       ELSE good END AS iban,
  CASE WHEN k % 8 = 1 THEN '' WHEN k % 12 = 7 THEN 'BAD' || cc ELSE 'BANK' || cc || '2' || CAST(k % 10 AS STRING) END AS swift_bic,
  CASE WHEN k % 23 = 5 THEN '' ELSE lpad(CAST(m AS STRING), 12, '0') END AS account_number,
  '' AS routing_aba,
  CASE WHEN k % 11 = 0 THEN '2019-01-15' ELSE '12.05.2026' END AS doc_date,
  k % 3 <> 0 AS signed,
  CASE WHEN k % 6 = 0 THEN 'typed officer block at the end' WHEN k % 6 = 3 THEN 'no signature or stamp' ELSE 'wet signature' END AS signature_evidence,
  FALSE AS partial_capture, k % 17 = 0 AS distinct_accounts, k % 5 = 0 AS settlement_issuer_strong, m
FROM (
  SELECT k, t, cc, m, name, cc || lpad(CAST(98 - ((m % 97) * (1000000 % 97) + digits * 100) % 97 AS STRING), 2, '0') || lpad(CAST(m AS STRING), width, '0') AS good
  FROM (
    SELECT k, t, cc, m, name, {bban} AS width, {digits} AS digits
    FROM (SELECT CAST(s_suppkey AS BIGINT) AS k, s_suppkey % 10 AS t, {country} AS cc, CAST(s_suppkey AS BIGINT) * 7919 + 104729 AS m, s_name AS name FROM {{supplier}}) s0
  ) s1
) s2
""".format(bban=_BBAN, digits=_DIGITS, country=_COUNTRY.format(k="s_nationkey"))  # fmt: skip

VENDOR_TEXT = """
SELECT doc_id, doc_class, doc_type, account_holder, bank_name, iban, swift_bic, account_number,
  CASE doc_type
    WHEN 'bank_letter' THEN 'To whom it may concern' || chr(10) || 'We confirm that ' || account_holder || ' holds an account with us.'
    WHEN 'bank_statement' THEN 'Account statement' || chr(10) || 'Statement period 1 May 2026 to 31 May 2026'
    WHEN 'payment_instructions' THEN 'Standard settlement instructions' || chr(10) || 'For ACH delivery see below'
    WHEN 'invoice' THEN 'INVOICE' || chr(10) || 'Invoice number: ' || CAST(doc_id AS STRING) || chr(10) || 'Amount due: 10.00'
    WHEN 'supplier_letterhead' THEN 'Dear vendor' || chr(10) || 'our bank details are printed below'
    WHEN 'voided_check' THEN 'VOIDED CHECK'
    ELSE 'Notes' END
  || chr(10) || bank_name || chr(10) || 'IBAN: ' || iban || chr(10) || 'BIC: ' || swift_bic || chr(10) || 'Account number: ' || account_number
  || CASE WHEN doc_id % 3 = 1 THEN chr(10) || 'Routing number 0' || lpad(CAST(doc_id % 100000000 AS STRING), 8, '0') ELSE '' END
  || CASE WHEN doc_id % 17 = 0 THEN chr(10) || 'Account number: 55' || account_number ELSE '' END
  || chr(10) || CASE WHEN doc_id % 6 = 0 THEN 'Sincerely,' || chr(10) || 'Jordan Sample' || chr(10) || 'Vice President' || chr(10) || 'Phone 000 000' ELSE 'Regards, the team' END AS text
FROM {vendor}
"""

INTAKE = """
SELECT doc_id, CASE WHEN doc_id % 15 = 0 THEN 'docx' WHEN doc_id % 15 = 1 THEN 'eml' ELSE 'pdf' END AS ext,
  CASE doc_id % 15 WHEN 2 THEN 'Form W-9 signed' WHEN 3 THEN 'W-8BEN scan' WHEN 5 THEN 'Rechnung 2026' WHEN 6 THEN 'my_w9_form' ELSE 'scan ' || CAST(doc_id AS STRING) END AS file_name,
  CASE doc_id % 15 WHEN 4 THEN 'From: A' || chr(10) || 'Sent: today' || chr(10) || 'Subject: bank details' || chr(10) || text
    WHEN 7 THEN 'Certificate of Foreign Status' || chr(10) || 'social security or employer identification number' || chr(10) || '0' || chr(10) || '0' || chr(10) || '-' || chr(10) || '1' || chr(10) || '2' || chr(10) || '3' || chr(10) || '4' || chr(10) || '5' || chr(10) || '6' || chr(10) || CAST(doc_id % 10 AS STRING) || chr(10) || 'end'
    WHEN 8 THEN 'Request for Taxpayer Identification' || chr(10) || 'Employer identification number' || chr(10) || 'Social security number' || chr(10) || '0' || chr(10) || '0' || chr(10) || '0' || chr(10) || '1' || chr(10) || '2' || chr(10) || '3' || chr(10) || '4' || chr(10) || '5' || chr(10) || '6' || chr(10) || 'end'
    WHEN 9 THEN 'Dear customer, Bank account information for SAP' WHEN 10 THEN 'Bank account information, for SAP registration'
    WHEN 11 THEN repeat(chr(1) || chr(2) || 'ab ', 60) WHEN 12 THEN repeat('a b c d e ', 60) || 'some words' WHEN 13 THEN text || chr(10) || 'This is a computer-generated letter' || chr(10) || 'DocuSign envelope'
    WHEN 14 THEN 'Bank confirmation, system-generated' ELSE text END AS text
FROM {vendor_text}
"""

PAGES = """
SELECT doc_id, doc_type, page_no, CASE slot WHEN 0 THEN letter WHEN 1 THEN filler ELSE sheet END AS text
FROM (
  SELECT doc_id, doc_type, page_no, (page_no + doc_id) % 3 AS slot,
    CASE WHEN doc_type = 'invoice' THEN 'Invoice number: ' || CAST(doc_id AS STRING) || chr(10) || 'Invoice date: 1 May' || chr(10) || 'IBAN: ' || iban
         ELSE 'To whom it may concern' || chr(10) || 'We confirm that the account is maintained at ' || bank_name || chr(10) || 'IBAN: ' || iban END AS letter,
    'General terms and conditions apply.' AS filler,
    'Supplier sheet' || chr(10) || 'Beneficiario: ' || account_holder || chr(10) || 'Account number: ' || account_number || chr(10) || 'SWIFT: ' || swift_bic
      || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'IBAN: ' || iban ELSE '' END AS sheet
  FROM {vendor} CROSS JOIN (SELECT 0 AS page_no UNION ALL SELECT 1 UNION ALL SELECT 2) p
) q
"""

TAX = """
SELECT k AS doc_id, 'w9' AS doc_class, CASE WHEN k % 20 = 7 THEN 'w8' WHEN k % 29 = 3 THEN 'unknown' ELSE 'w9' END AS doc_type,
  CASE WHEN k % 31 = 0 THEN '' WHEN k % 6 = 1 THEN 'Acme ' || CAST(k AS STRING) || ' LLC' ELSE c_name END AS line1_name,
  CASE WHEN k % 5 = 0 THEN CASE WHEN k % 10 = 0 THEN 'Jane Q. Sample' ELSE 'Widget Company ' || CAST(k AS STRING) END ELSE '' END AS line2_business_name,
  CASE k % 7 WHEN 0 THEN 'Individual/sole proprietor' WHEN 1 THEN 'C Corporation' WHEN 2 THEN 'Limited liability company' WHEN 3 THEN 'Partnership'
             WHEN 4 THEN 'Trust/estate' WHEN 5 THEN 'Other entity' ELSE '' END AS line3_classification,
  CASE WHEN k % 2 = 0 THEN 'SSN' ELSE 'EIN' END AS tin_type,
  CASE WHEN k % 19 = 0 THEN '' WHEN k % 23 = 0 THEN '00-12345'
       WHEN k % 2 = 0 THEN '000-' || lpad(CAST(k % 100 AS STRING), 2, '0') || '-' || lpad(CAST(k % 10000 AS STRING), 4, '0')
       ELSE '00-' || lpad(CAST(k % 10000000 AS STRING), 7, '0') END AS tin_raw,
  k % 3 <> 0 AS signed, CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN '2021-02-03' ELSE '03/04/2026' END AS sign_date,
  CASE WHEN k % 40 = 7 THEN '' ELSE 'Foreign Person ' || CAST(k AS STRING) END AS legal_name,
  CASE WHEN k % 3 = 1 THEN 'Active NFFE' ELSE '' END AS chapter4_status, CASE WHEN k % 6 = 1 THEN 'Part XXV' ELSE '' END AS chapter4_cert_section
FROM (SELECT CAST(c_custkey AS BIGINT) AS k, c_name FROM {customer}) c
"""

READINGS = """
SELECT doc_id, iban AS iban_text,
  CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN replace(iban, '7', '8') WHEN 2 THEN iban ELSE lower(iban) END AS iban_model,
  account_number AS account_text,
  CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN replace(account_number, '1', '2') WHEN 2 THEN '000' || account_number ELSE account_number END AS account_model,
  swift_bic AS swift_text, CASE WHEN doc_id % 6 = 3 THEN '' ELSE swift_bic END AS swift_model
FROM {vendor}
"""

ERP_BANK = """
SELECT lpad(CAST(doc_id AS STRING), 10, '0') AS partner, CAST(n AS INT) AS row_idx,
  CASE WHEN doc_id % 5 = 0 OR n > 0 THEN '' ELSE iban END AS iban,
  CASE WHEN n = 1 THEN '9' || account_number WHEN doc_id % 5 = 1 THEN '0000' || account_number
       WHEN doc_id % 5 = 2 THEN replace(account_number, '3', '4')
       WHEN doc_id % 19 = 0 THEN lpad(CAST((doc_id - 1) * 7919 + 104729 AS STRING), 12, '0') ELSE account_number END AS bankn,
  bank_country AS banks, account_holder AS koinh, CASE WHEN swift_bic = '' THEN 'KEY' ELSE swift_bic END AS bankl
FROM {vendor} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) r
WHERE n <= doc_id % 3 AND doc_id % 21 <> 0
"""

ERP_PARTNER = """
SELECT lpad(CAST(c_custkey AS STRING), 10, '0') AS partner, CASE WHEN c_custkey % 4 = 3 THEN '' WHEN c_custkey % 2 = 0 THEN '1' ELSE '2' END AS type,
  CASE WHEN c_custkey % 2 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'Other Name' WHEN c_custkey % 5 = 0 THEN 'Widget' ELSE c_name || ' GmbH' END AS name_org1,
  CASE WHEN c_custkey % 10 = 5 THEN 'Company' ELSE '' END AS name_org2,
  CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE '' END AS full_name,
  CASE WHEN c_custkey % 4 = 2 THEN c_name ELSE '' END AS name_last, CASE WHEN c_custkey % 8 = 2 THEN 'Jane' ELSE '' END AS name_first,
  CASE WHEN c_custkey % 23 = 0 THEN 'X' ELSE '' END AS xblck, CASE WHEN c_custkey % 37 = 0 THEN 'X' ELSE '' END AS xdele
FROM {customer} WHERE c_custkey % 41 <> 0
"""

REGISTRY = """
SELECT CASE s_suppkey % 8 WHEN 0 THEN 'Bank of the North ' || CAST(s_suppkey AS STRING) WHEN 1 THEN 'Beta' || CAST(s_suppkey AS STRING) || ' GmbH SA'
    WHEN 2 THEN 'Citi' || CAST(s_suppkey % 30 AS STRING) || 'bank, NA' WHEN 3 THEN 'Northern Solutions Services Group' WHEN 4 THEN 'Northern Services ' || CAST(s_suppkey AS STRING)
    ELSE s_name || ' Limited' END AS name,
  s_suppkey % 9 <> 0 AS active, CAST(s_suppkey AS BIGINT) AS cert
FROM {supplier}
"""

BANK_NAMES = """
SELECT CASE s_suppkey % 7 WHEN 0 THEN 'Bank of the' WHEN 1 THEN 'Alpha' || CAST(s_suppkey AS STRING) || ' GmbH SA' WHEN 2 THEN 'CITI' || CAST(s_suppkey % 30 AS STRING)
    WHEN 3 THEN 'Northern Solutions Services ' || CAST(s_suppkey AS STRING) WHEN 4 THEN 'The bank, Inc.' || CAST(s_suppkey AS STRING)
    WHEN 5 THEN 'Old ' || s_name || ' Limited Holding' ELSE s_name END AS name
FROM {supplier}
"""

ROUTING = """
SELECT '0' || lpad(CAST(s_suppkey % 100000000 AS STRING), 8, '0') AS aba,
  CASE WHEN s_suppkey % 5 = 0 THEN 'Unrelated Credit Union' ELSE 'Bank of ' || {country} || ' ' || CAST(s_suppkey % 50 AS STRING) END AS owner_name
FROM {{supplier}} WHERE s_suppkey % 4 <> 0
""".format(country=_COUNTRY.format(k="s_nationkey"))

BIC = """
SELECT DISTINCT swift_bic AS bic, 'Bank entry ' || swift_bic AS name FROM {vendor} WHERE swift_bic <> '' AND doc_id % 4 <> 2
"""

VOTES = """
SELECT CAST(s_suppkey AS BIGINT) AS doc_id, probe,
  CASE probe WHEN 'band' THEN CASE s_suppkey % 4 WHEN 0 THEN 'pos-hand' WHEN 1 THEN 'neg' WHEN 2 THEN 'pos-stamp' ELSE 'err' END
             WHEN 'page' THEN CASE s_suppkey % 5 WHEN 0 THEN 'neg' WHEN 1 THEN 'pos-hand' WHEN 2 THEN 'err' WHEN 3 THEN 'neg' ELSE 'not-run' END
             ELSE CASE WHEN s_suppkey % 7 = 0 THEN 'pos-hand' ELSE 'err' END END AS vote
FROM {supplier} CROSS JOIN (SELECT 'band' AS probe UNION ALL SELECT 'page' UNION ALL SELECT 'band_hi') p
"""

RUNS = """
SELECT CAST(o_orderkey AS BIGINT) AS run_id, CAST(o_orderdate AS TIMESTAMP) AS ts, CASE WHEN o_orderkey % 7 = 0 THEN 'w9' ELSE 'bank' END AS doc_class,
  CASE o_orderkey % 4 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'NEED_MANUAL_REVIEW' ELSE 'REJECT' END AS verdict,
  substr(o_orderpriority, 1, 1) AS tier, CAST(o_orderkey % 2 AS STRING) || '|' || substr(o_orderpriority, 1, 1) AS shape_key,
  CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) % 300 AS DOUBLE) AS duration_s, o_orderkey % 7 = 0 AS escalated, o_orderkey % 11 = 0 AS conflict,
  CASE o_orderkey % 4 WHEN 0 THEN 'multi_page' WHEN 1 THEN 'foreign_bank' WHEN 2 THEN 'unsigned' ELSE 'none' END AS tag
FROM {orders}
"""

FINDINGS = """
SELECT CAST(l_orderkey AS BIGINT) AS run_id,
  CASE l_linenumber WHEN 1 THEN 'BNK-010' WHEN 2 THEN 'BNK-011' WHEN 3 THEN 'BNK-020' WHEN 4 THEN 'BNK-021' WHEN 5 THEN 'BNK-023' WHEN 6 THEN 'BNK-024'
    ELSE CASE WHEN l_orderkey % 5 IN (2, 3) THEN 'BNK-031' WHEN l_orderkey % 5 IN (0, 4) THEN 'BNK-022' ELSE 'BNK-025' END END AS rule_id,
  CASE l_linenumber WHEN 1 THEN 'NEED_MANUAL_REVIEW' WHEN 2 THEN 'NEED_MANUAL_REVIEW' WHEN 4 THEN 'WARNING' WHEN 5 THEN 'NEED_MANUAL_REVIEW' WHEN 6 THEN 'NEED_MANUAL_REVIEW'
    WHEN 7 THEN CASE WHEN l_orderkey % 5 = 1 THEN 'WARNING' ELSE 'NEED_MANUAL_REVIEW' END END AS verdict_effect
FROM {lineitem}
"""

LABELS = """
SELECT CAST(o_orderkey AS BIGINT) AS run_id, CAST(o_orderkey AS BIGINT) % 5000 AS doc_key, CAST(o_orderdate AS TIMESTAMP) AS ts,
  CASE o_orderkey % 5 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'NEED_MANUAL_REVIEW' WHEN 3 THEN 'REJECT' ELSE 'ACCEPT' END AS verdict_gold,
  CASE WHEN o_orderkey % 2 = 0 THEN 'bank_letter' ELSE 'invoice' END AS doc_type_gold, CASE WHEN o_orderkey % 9 = 0 THEN 'w9' ELSE 'bank' END AS doc_class,
  o_orderstatus = 'F' AS confirmed, CASE o_orderkey % 4 WHEN 0 THEN 'multi_page' WHEN 1 THEN 'foreign_bank' ELSE 'none' END AS tag,
  CAST(o_orderkey % 4 AS BIGINT) AS changed_fields, o_orderkey % 10 = 0 AS type_changed, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS completeness
FROM {orders} WHERE o_orderkey % 3 = 0
"""

EVAL = """
SELECT CAST(year(o_orderdate) AS BIGINT) AS run_year, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_orderkey AS BIGINT) AS file_key, CAST(o_custkey AS BIGINT) % 500 AS doc_key,
  CASE WHEN o_orderkey % 2 = 0 THEN 'real' ELSE 'synthetic' END AS stream,
  CASE WHEN o_orderkey % 97 = 0 THEN 'CRASH' WHEN o_orderkey % 8 = 1 THEN 'other' WHEN o_orderkey % 6 = 0 THEN 'invoice' ELSE 'bank_letter' END AS pred_type,
  CASE WHEN o_orderkey % 6 = 0 THEN 'invoice' ELSE 'bank_letter' END AS gold_type,
  CASE WHEN o_orderkey % 97 = 0 THEN 'CRASH' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'NEED_MANUAL_REVIEW' ELSE 'REJECT' END END AS pred_verdict,
  CASE o_orderkey % 5 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'NEED_MANUAL_REVIEW' ELSE 'REJECT' END AS gold_verdict,
  o_orderkey % 97 = 0 AS crash, o_orderkey % 101 = 0 AS skipped, CASE o_orderkey % 3 WHEN 0 THEN 'multi_page' WHEN 1 THEN 'foreign_bank' ELSE 'none' END AS tag
FROM {orders}
"""

GUARDED = """
SELECT doc_id, doc_type, file_name, text, account_holder, bank_name, doc_date, signed, iban, account_number, routing_aba, tin_raw, tin_type, sign_date, bank_country
FROM (
  SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'bank_statement' WHEN doc_id % 4 = 2 AND doc_id % 3 = 0 THEN 'payment_instructions' ELSE 'bank_letter' END AS doc_type,
    CASE WHEN doc_id % 8 = 5 THEN 'letter of Max Mustermann.pdf' ELSE 'scan.pdf' END AS file_name,
    CASE doc_id % 4 WHEN 0 THEN 'Account signatory: Jane Sample' WHEN 1 THEN 'Account holder: Jane Sample' WHEN 2 THEN 'We verify that Acme Trading is a customer of ours'
                    ELSE 'Period 1 Jan 2026 to 31 Jan 2026' END
      || CASE WHEN doc_id % 6 = 1 THEN chr(10) || 'DocuSign Envelope 2026-02-03 | 10:11' ELSE '' END
      || CASE WHEN doc_id % 9 = 2 THEN chr(10) || '〒' || '813-0044 口座番号 ' || substr(account_number, 5, 8) ELSE '' END AS text,
    CASE WHEN doc_id % 8 = 5 THEN 'Max Mustermann' WHEN doc_id % 4 <= 1 THEN 'Jane Sample' ELSE '' END AS account_holder,
    CASE WHEN doc_id % 6 = 0 THEN 'VIGILADO Superintendencia' ELSE bank_name END AS bank_name,
    CASE WHEN doc_id % 10 = 3 THEN '2026-01-01' ELSE '' END AS doc_date, doc_id % 5 = 1 AS signed,
    CASE WHEN doc_id % 5 = 0 THEN account_number ELSE iban END AS iban,
    CASE WHEN doc_id % 9 = 2 THEN '8130044' WHEN doc_id % 5 = 0 THEN '' ELSE account_number END AS account_number,
    CASE doc_id % 3 WHEN 0 THEN '012345678' WHEN 1 THEN '01234567' ELSE '123' END AS routing_aba,
    CASE WHEN doc_id % 3 = 0 THEN '2026-03-04' ELSE '00-1234567' END AS tin_raw, CASE WHEN doc_id % 2 = 0 THEN 'Social Security' ELSE 'ein' END AS tin_type,
    CASE WHEN doc_id % 7 = 0 THEN '2026-01-02' ELSE '' END AS sign_date, CASE WHEN doc_id % 9 = 2 THEN '' ELSE bank_country END AS bank_country
  FROM {vendor}
) g
"""

#: name -> (statement, what it reads)
BINDINGS: dict[str, tuple[str, tuple[str, ...]]] = {
    "vendor": (VENDOR, ("supplier",)),
    "vendor_text": (VENDOR_TEXT, ("vendor",)),
    "intake": (INTAKE, ("vendor_text",)),
    "vendor_pages": (PAGES, ("vendor",)),
    "tax": (TAX, ("customer",)),
    "guarded": (GUARDED, ("vendor",)),
    "readings": (READINGS, ("vendor",)),
    "erp_bank": (ERP_BANK, ("vendor",)),
    "erp_partner": (ERP_PARTNER, ("customer",)),
    "bank_registry": (REGISTRY, ("supplier",)),
    "bank_names": (BANK_NAMES, ("supplier",)),
    "routing_directory": (ROUTING, ("supplier",)),
    "bic_directory": (BIC, ("vendor",)),
    "votes": (VOTES, ("supplier",)),
    "runs": (RUNS, ("orders",)),
    "findings": (FINDINGS, ("lineitem",)),
    "run_labels": (LABELS, ("orders",)),
    "eval_rows": (EVAL, ("orders",)),
}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding, or a driver table of that name, as a DataFrame."""
    if name not in BINDINGS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    statement, reads = BINDINGS[name]
    return spark.sql(statement, **{r: bound(spark, sf_dir, r) for r in reads})


def with_bindings(query: str, *names: str) -> str:
    """A DuckDB query over the named bindings, which become CTEs in front of it."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in BINDINGS and name not in parts:
            statement, reads = BINDINGS[name]
            for r in reads:
                add(r)
            parts[name] = statement.format(**{r: r for r in reads}).strip()

    for n in names:
        add(n)
    if not parts:
        return query.strip()
    lead = ",\n".join(f"{n} AS ({s})" for n, s in parts.items())
    body = query.strip()
    return f"WITH {lead}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {lead}\n{body}"
