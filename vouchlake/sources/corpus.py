"""A corpus of documents with known truth: layouts x languages x signatures x account numbers.

Every document follows from its number by mixed-radix arithmetic, without random numbers:
the lowest digit picks the layout, the next ones language, signature, whether the IBAN's check
digits fit, and country. The statement uses only what Spark SQL and DuckDB share, so both make the
same rows, of any table of numbers and of any length, in one pass without a shuffle.
Holders, banks and people are invented, tax numbers lie in ranges that are never assigned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from vouchlake.functions.frames import beside
from vouchlake.plans.rules import verdict_in_place

LANGUAGES = ("en", "de", "es")
SIGNATURES = ("esig", "typed", "unsigned")
VALIDITY = ("valid", "invalid")
#: country -> letters that its account numbers begin with, digits after them.
COUNTRIES = {"DE": ("", 18), "NL": ("OSTB", 10), "ES": ("", 20), "CZ": ("", 20), "FR": ("", 23), "GB": ("NRDB", 14)}
HOLDERS = ("Ostara Trading", "Lindqvist Foods", "Marisol Textiles", "Pelham Instruments", "Tresco Timber", "Zeleny Glass", "Aurelia Shipping")
FORMS = ("GmbH", "Ltd", "Inc", "LLC")
PEOPLE = ("Mira Holt", "Anton Weiss", "Lucia Prado", "Peter Novak", "Ines Duarte")


@dataclass(frozen=True)
class Layout:
    """One way to lay out a document. shows: the fields that it prints and that are therefore true of it."""

    name: str
    doc_type: str
    shows: str
    lines: dict[str, str]
    doc_class: str = "bank"


# The wording is ours, but for the phrases by which types are told apart.
LAYOUTS = (
    Layout("confirmation", "bank_letter", "holder bank iban bic sign", {
        "en": "{bank}\nBank confirmation\nIssued {date}\nTo whom it may concern\nWe confirm that {holder} keeps this account with us.\nIBAN: {iban}\nBIC: {bic}\n{sign}",
        "de": "{bank}\nBankbestätigung\nAusgestellt am {date}\nSehr geehrte Damen und Herren\nHiermit bestätigen wir das Konto der Firma {holder}.\nIBAN: {iban}\nBIC: {bic}\n{sign}",
        "es": "{bank}\nCertificación bancaria\nEmitida el {date}\nA quien corresponda\nEl titular de la cuenta es {holder}.\nIBAN: {iban}\nBIC: {bic}\n{sign}",
    }),
    Layout("confirmation_unnamed", "bank_letter", "bank iban bic sign", {
        "en": "{bank}\nBank confirmation\nIssued {date}\nTo whom it may concern\nThe account below is kept with us.\nIBAN: {iban}\nBIC: {bic}\n{sign}",
        "de": "{bank}\nBankbestätigung\nAusgestellt am {date}\nDas unten genannte Konto wird bei uns geführt.\nIBAN: {iban}\nBIC: {bic}\n{sign}",
        "es": "{bank}\nCertificación bancaria\nEmitida el {date}\nLa cuenta indicada está abierta en esta entidad.\nIBAN: {iban}\nBIC: {bic}\n{sign}",
    }),
    Layout("signatory", "bank_letter", "holder bank iban sign", {
        "en": "{bank}\nBank letter\nIssued {date}\nThis is to certify that {holder} is a customer of our house.\nIBAN: {iban}\nAccount signatory\n{person}\n{sign}",
    }),
    Layout("officer", "bank_letter", "holder bank iban bic officer", {
        "en": "{bank}\nBank confirmation\nIssued {date}\n{holder} holds an account with us.\nIBAN: {iban}\nBIC: {bic}\nSincerely,\n{person}\nVice President\nPhone 000 {number}",
    }),
    Layout("statement", "bank_statement", "holder bank iban", {
        "en": "{bank}\nAccount statement\nAccount holder: {holder}\nIBAN {iban}\nStatement period 1 May 2026 to 31 May 2026\nOpening balance 100.00",
        "de": "{bank}\nKontoauszug\nKontoinhaber: {holder}\nIBAN {iban}\nAnfangssaldo 100,00",
        "es": "{bank}\nExtracto bancario\nTitular: {holder}\nIBAN {iban}\nSaldo inicial 100,00",
    }),
    Layout("statement_unnamed", "bank_statement", "bank iban", {"en": "{bank}\nAccount statement\nIBAN {iban}\nStatement period 1 May 2026 to 31 May 2026"}),
    Layout("remittance", "payment_instructions", "holder bank iban", {
        "en": "{holder}\nPayment instruction for our customers\nBeneficiary: {holder}\nIBAN: {iban}\nKept with {bank}",
    }),
    Layout("settlement", "payment_instructions", "holder bank iban bic officer settlement", {
        "en": "{bank}\nStandard settlement instructions\nIssued {date}\n{holder} maintains an account with us.\nIBAN: {iban}\nBIC: {bic}\nSincerely,\n{person}\nVice President\nPhone 000 {number}",
    }),
    Layout("invoice", "invoice", "holder iban", {
        "en": "INVOICE\nInvoice number: {number}\nAmount due: 10.00\nSold to {holder}\nIBAN: {iban}",
        "de": "RECHNUNG\nRechnungsnummer: {number}\nRechnungsdatum: {date}\nAn {holder}\nIBAN: {iban}",
        "es": "FACTURA\nNúmero de factura: {number}\nA {holder}\nIBAN: {iban}",
    }),
    Layout("letterhead", "supplier_letterhead", "holder bank iban", {"en": "{holder}\nDear vendor\nour account is kept with {bank}\nIBAN: {iban}\nFor the board: {person}"}),
    Layout("voided_check", "voided_check", "holder bank routing account", {"en": "VOIDED CHECK\n{holder}\n{bank}\nRouting: {routing}  Account: {account}\nNo. 0001"}),
    Layout("packet", "bank_letter", "holder bank iban bic sign", {
        "en": "{holder}\nSupplier sheet\nIBAN: {iban}\fGeneral terms apply.\f{bank}\nBank confirmation\nIssued {date}\nTo whom it may concern\nWe confirm that {holder} is a client of ours.\nIBAN: {iban}\nBIC: {bic}\n{sign}",
    }),
    Layout("notice", "other", "holder account", {"en": "活动通知\n收款账号: {grouped}\n户名: {holder}\n联系电话: 000"}),
    Layout("clearing", "payment_instructions", "holder account clearing", {"en": "付款信息\n户名: {holder}\n账号: {account}\n联行号: {clearing}"}),
    Layout("w9", "w9", "tax", {"en": "Form W-9\nRequest for Taxpayer Identification Number\n1 Name: {line1}\n2 Business name: \n3 Class: {class}\n{kind}: {tin}\n{tax_sign}"}, "w9"),
    Layout("w9_boxed", "w9", "tax", {"en": "Form W-9\nRequest for Taxpayer Identification Number\n1 Name: {line1}\n3 Class: {class}\n{kind}\n{boxes}end\n{tax_sign}"}, "w9"),
    Layout("w9_esigned", "w9", "tax", {"en": "Form W-9\nRequest for Taxpayer Identification Number\n1 Name: {line1}\n3 Class: {class}\n{kind}: {tin}\nDigitally signed by {person}"}, "w9"),
    Layout("w8", "w8", "w8", {"en": "Form W-8BEN-E\nCertificate of Foreign Status\n1 Name of organisation: {holder}\n5 Status: Active NFFE\f{w8_part}{w8_sign}"}, "w9"),
)


def _case(by: str, values: dict[str, str], otherwise: str | None = None) -> str:
    return f"CASE {by} {' '.join(f'WHEN {k} THEN {v}' for k, v in values.items())}{'' if otherwise is None else f' ELSE {otherwise}'} END"


def _pick(digit: str, values: tuple[str, ...]) -> str:
    """The value at a digit."""
    return _case(digit, {str(k): f"'{v}'" for k, v in enumerate(values)})


def _text(lines: str) -> str:
    """A layout's lines as SQL over the columns that its braces name."""
    parts = []
    for p in re.split(r"(\{\w+\}|\n|\f)", lines):
        if p:
            parts.append({"\n": "chr(10)", "\f": "chr(12)"}.get(p) or (f"s_{p[1:-1]}" if p[0] == "{" else f"'{p}'"))
    return " || ".join(parts)


def _letters(text: str) -> str:
    return "".join(str(int(c, 36)) for c in text)


def _shown(what: str, value: str, otherwise: str = "''") -> str:
    """The value in the layouts that show it."""
    names = ", ".join(f"'{x.name}'" for x in LAYOUTS if what in x.shows.split())
    return f"CASE WHEN layout IN ({names}) THEN {value} ELSE {otherwise} END"


#: What the check digits make of letters and country, and of a number of n digits: (lead + m * 10^6) mod 97.
_LEAD = {cc: int(_letters(lead) or "0") * 10 ** (width + 6) % 97 + int(_letters(cc)) * 100 % 97 for cc, (lead, width) in COUNTRIES.items()}
_L = len(LAYOUTS)
_QUOTED = {f"'{cc}'": v for cc, v in COUNTRIES.items()}


def corpus_sql(numbers: str) -> str:
    """The statement over a table of numbers `k` (bigint, from 0), named in braces."""
    return f"""
SELECT doc_id, layout, lang, sig, validity, doc_class, doc_type, account_holder, bank_name, bank_country, swift_bic, iban, account_number, routing_aba, national_clearing,
  signed, signature_evidence, settlement_issuer_strong, line1_name, line2_business_name, line3_classification, tin_type, tin_raw, sign_date, legal_name, chapter4_status,
  chapter4_cert_section,
  'type:' || doc_type || ',layout:' || layout || ',lang:' || lang || CASE WHEN iban = '' THEN '' ELSE ',iban:' || validity END || CASE WHEN doc_class = 'bank' THEN ',sig:' || sig ELSE ',tin:' || lower(tin_type) END
    || CASE WHEN doc_class = 'bank' AND account_holder = '' THEN ',no_holder' ELSE '' END AS tags,
  {_case("layout", {f"'{x.name}'": _text(x.lines["en"]) if len(x.lines) == 1 else _case("lang", {f"'{k}'": _text(v) for k, v in x.lines.items()}) for x in LAYOUTS})} AS text
FROM (
  SELECT *,
    {_shown("holder", "s_holder")} AS account_holder, {_shown("bank", "s_bank")} AS bank_name, CASE WHEN doc_class = 'bank' THEN s_country ELSE '' END AS bank_country,
    {_shown("bic", "s_bic")} AS swift_bic, {_shown("iban", "s_iban")} AS iban, {_shown("account", "s_account")} AS account_number, {_shown("routing", "s_routing")} AS routing_aba,
    {_shown("clearing", "s_clearing")} AS national_clearing,
    CASE WHEN doc_class = 'bank' THEN {_shown("sign", "sig = 'esig'", "FALSE")} WHEN layout = 'w9_esigned' THEN TRUE ELSE validity = 'valid' END AS signed,
    {_shown("officer", "'typed officer block'", _shown("sign", _case("sig", {"'esig'": "'envelope of an electronic signature'", "'typed'": "'computer generated letter'"}, "''")))} AS signature_evidence,
    {_shown("settlement", "TRUE", "FALSE")} AS settlement_issuer_strong,
    {_shown("tax", "s_line1")} AS line1_name, '' AS line2_business_name, {_shown("tax", "s_class")} AS line3_classification, {_shown("tax", "s_kind_code")} AS tin_type,
    regexp_replace(replace(s_tin, '-', ''), '(.)', {{one}}) AS s_boxes, {_shown("tax", "s_tin")} AS tin_raw, CASE WHEN layout IN ('w9', 'w9_boxed', 'w8') AND validity = 'valid' THEN '02-03-2026' ELSE '' END AS sign_date,
    {_shown("w8", "s_holder")} AS legal_name, {_shown("w8", "'Active NFFE'")} AS chapter4_status, {_shown("w8", "CASE WHEN lang = 'de' THEN '' ELSE 'Part XXV' END")} AS chapter4_cert_section
  FROM (
    SELECT *,
      {_case("layout", {f"'{x.name}'": f"'{x.doc_class}'" for x in LAYOUTS})} AS doc_class, {_case("layout", {f"'{x.name}'": f"'{x.doc_type}'" for x in LAYOUTS})} AS doc_type,
      CASE WHEN validity = 'valid' THEN good ELSE substr(good, 1, length(good) - 1) || CAST((CAST(substr(good, length(good), 1) AS INT) + 1) % 10 AS STRING) END AS s_iban,
      CASE sig WHEN 'esig' THEN 'DocuSign Envelope VL-' || s_number WHEN 'typed' THEN 'This is a computer generated letter' ELSE {_case("lang", {"'de'": "'Mit freundlichen Grüßen'", "'es'": "'Atentamente'"}, "'With kind regards'")} END AS s_sign,
      CASE WHEN sig = 'typed' AND validity = 'valid' THEN s_person ELSE s_holder END AS s_line1,
      CASE lang WHEN 'en' THEN 'Employer identification number' ELSE 'Social security number' END AS s_kind,
      CASE WHEN lang = 'en' THEN 'EIN' WHEN lang = 'de' THEN 'SSN' ELSE '' END AS s_kind_code,
      CASE lang WHEN 'en' THEN '00-' || lpad(s_number, 7, '0') WHEN 'de' THEN '000-' || lpad(CAST(k % 90 + 10 AS STRING), 2, '0') || '-' || lpad(CAST(k % 10000 AS STRING), 4, '0') ELSE '' END AS s_tin,
      CASE WHEN validity = 'valid' THEN 'Signature of U.S. person: given  Date: 02-03-2026' ELSE 'Signature of U.S. person:' END AS s_tax_sign,
      CASE WHEN lang = 'de' THEN '' ELSE 'Part XXV' || chr(10) || 'The entity is an active NFFE.' || chr(10) END AS s_w8_part, CASE WHEN validity = 'valid' THEN 'Signed ' || s_person || ', 02-03-2026' ELSE '' END AS s_w8_sign,
      substr(s_account, 1, 4) || ' ' || substr(s_account, 5, 4) || ' ' || substr(s_account, 9, 4) AS s_grouped
    FROM (
      SELECT *, s_country || lpad(CAST(98 - (lead97 + (m % 97) * (1000000 % 97)) % 97 AS STRING), 2, '0') || lead || lpad(CAST(m AS STRING), width, '0') AS good,
        'Bank of ' || s_country || ' ' || CAST(k % 40 AS STRING) AS s_bank, 'OSTB' || s_country || '2' || CAST(k % 10 AS STRING) AS s_bic,
        lpad(CAST(m AS STRING), 12, '6') AS s_account, '0' || lpad(CAST(m % 100000000 AS STRING), 8, '0') AS s_routing, lpad(CAST(m AS STRING), 12, '3') AS s_clearing
      FROM (
        SELECT *, {_case("s_country", {c: f"'{lead}'" for c, (lead, _) in _QUOTED.items()})} AS lead, {_case("s_country", {c: str(w) for c, (_, w) in _QUOTED.items()})} AS width,
          {_case("s_country", {f"'{c}'": str(v) for c, v in _LEAD.items()})} AS lead97
        FROM (
          SELECT k AS doc_id, k, (k * 7919 + 104729) % 10000000000 AS m, CAST(k AS STRING) AS s_number, '12 May 2026' AS s_date,
            {_pick(f"k % {_L}", tuple(x.name for x in LAYOUTS))} AS layout, {_pick(f"CAST(floor(k / {_L}) AS BIGINT) % 3", LANGUAGES)} AS lang,
            {_pick(f"CAST(floor(k / {3 * _L}) AS BIGINT) % 3", SIGNATURES)} AS sig, {_pick(f"CAST(floor(k / {9 * _L}) AS BIGINT) % 2", VALIDITY)} AS validity,
            {_pick(f"CAST(floor(k / {_L}) AS BIGINT) % {len(COUNTRIES)}", tuple(COUNTRIES))} AS s_country,
            {_pick(f"k % {len(HOLDERS)}", HOLDERS)} || ' ' || {_pick(f"k % {len(FORMS)}", FORMS)} AS s_holder, {_pick(f"k % {len(PEOPLE)}", PEOPLE)} AS s_person,
            {_case(f"CAST(floor(k / {3 * _L}) AS BIGINT) % 3", {"0": "'Limited liability company'", "1": "'Individual/sole proprietor'"}, "'C Corporation'")} AS s_class
          FROM {numbers}
        ) c0
      ) c1
    ) c2
  ) c3
) c4
"""


#: How each engine writes one character and a line feed in a replacement.
SPARK_ONE, DUCK_ONE = "concat('$1', chr(10))", "concat('\\1', chr(10)), 'g'"


def make_corpus(numbers: DataFrame) -> DataFrame:
    """The corpus over k of `numbers`, with truth_verdict: what the rules say to the true fields."""
    docs = numbers.sparkSession.sql(corpus_sql("{numbers}").replace("{one}", SPARK_ONE), numbers=numbers)
    return beside(docs, verdict_in_place).withColumnRenamed("verdict", "truth_verdict")
