"""The eighteen agreed cases, in wording of our own: what must be read, which rules must fire, and the verdict."""

import pytest

from vouchlake.operators.extract import crosscheck
from vouchlake.operators.reading import READ_FIELDS, read_documents
from vouchlake.plans.rules import apply_rules, fold_verdict

GOOD, OTHER = "DE89370400440532013000", "DE44500105175407324931"
#: name -> (class, text, what a model read, fields wanted, rules that must fire, verdict)
CASES = {
    "valid_iban_of_italy": ("bank", "Attestazione della banca. Conto di Verdi SRL, IBAN: IT60 X054 2811 1010 0000 0123 456", {}, {"iban": "IT60X0542811101000000123456"}, [], None),
    "envelope_signs": ("bank", f"Bank letter about Ostara GmbH, IBAN {GOOD}\nDocuSign Envelope ID 77-A\n2024-05-03 | 10:22", {}, {"doc_type": "bank_letter", "signed": True, "signature_kind": "electronic", "doc_date": "2024-05-03"}, [], None),
    "period_dates_a_statement": (
        "bank", "Account statement of Pelham Ltd\nIBAN GB29 NWBK 6016 1331 9268 19\nStatement period 1 Jan 2026 to 31 Mar 2026", {"account_holder": "Pelham Ltd", "bank_name": "North Bank"},
        {"doc_type": "bank_statement", "doc_date": "1 Jan 2026 to 31 Mar 2026"}, ["BNK-006"], "ACCEPT",
    ),
    "form_of_japan": ("bank", "口座の確認 〒813-0044 福岡市 口座番号 7654321 普通", {}, {"bank_country": "JP", "account_number": "7654321"}, [], None),
    "invoice": ("bank", f"INVOICE\nInvoice number 77\nInvoice date 2026-01-10\nAmount due 10.00\nIBAN {GOOD}", {}, {"doc_type": "invoice"}, ["BNK-001"], "REJECT"),
    "tax_form_from_text_alone": (
        "w9", "Form W-9 Request for Taxpayer Identification Number. Name: Tresco LLC. Employer identification number 00-3859289", {}, {"doc_type": "w9", "tin_raw": "00-3859289", "tin_type": "EIN"},
        ["W9-001", "W9-003", "W9-020"], "NEED_MANUAL_REVIEW",
    ),
    "unsigned_letter": ("bank", "Bank confirmation. We confirm that Zeleny s.r.o. keeps IBAN CZ65 0800 0000 1920 0014 5399 with us.", {"account_holder": "Zeleny s.r.o.", "bank_name": "Ostrov Bank", "signed": "false"}, {"doc_type": "bank_letter"}, ["BNK-021"], "WARNING"),
    "wrong_check_digits": ("bank", "Bank confirmation for Lindqvist ApS. Details below.", {"account_holder": "Lindqvist ApS", "bank_name": "Sund Bank", "iban": "DE44500105175407324930", "signed": "true"}, {"doc_type": "bank_letter"}, ["BNK-011"], "NEED_MANUAL_REVIEW"),
    "model_and_text_differ": ("bank", f"Bank confirmation for Marisol OU. IBAN: {OTHER}.", {"account_holder": "Marisol OU", "bank_name": "Sund Bank", "iban": GOOD, "signed": "true"}, {"iban": GOOD}, [], "ACCEPT"),
    "no_holder": ("bank", "Bank confirmation. IBAN FR14 2004 1010 0505 0001 3M02 606", {"bank_name": "Banque du Nord", "signed": "true"}, {"doc_type": "bank_letter"}, ["BNK-023"], "NEED_MANUAL_REVIEW"),
    "older_than_two_years": ("bank", "Bank confirmation of 15 Jan 2019 for Tresco BV, IBAN NL91 ABNA 0417 1643 00", {"account_holder": "Tresco BV", "bank_name": "Polder Bank", "doc_date": "15 Jan 2019", "signed": "true"}, {"doc_type": "bank_letter"}, ["BNK-020"], "ACCEPT"),
    "mobile_number_is_no_account": (
        "bank", "通知 开户银行: 某银行 收款账号: 6222 0202 0000 1234 999 户名: 某协会 联系人: 李 电话: 13700000060", {"account_number": "13700000060", "account_holder": "某协会", "bank_name": "某银行", "signed": "true"},
        {"account_number": "6222020200001234999", "bank_country": "CN"}, [], None,
    ),
    "labelled_account_of_china": ("bank", "供应商信息 开户银行: 某银行 银行账号: 1100 2233 4455 77 户名: 虚构公司", {"account_holder": "虚构公司", "bank_name": "某银行", "signed": "true"}, {"account_number": "11002233445577", "bank_country": "CN"}, [], None),
    "signer_is_no_holder": (
        "bank", "Bank confirmation. This is to verify that Aurelia LLC is a customer of ours.\nAccount number: 202412345678\nAccount signatory\nMira Holt", {"account_holder": "Mira Holt", "bank_name": "Sund Bank", "signed": "true"},
        {"account_holder": "Aurelia LLC", "account_signatory": "Mira Holt"}, [], "ACCEPT",
    ),
    "officer_instead_of_signature": (
        "bank", f"Bank confirmation. This letter is to confirm the account of Ostara GmbH, IBAN {GOOD}\nSincerely,\nAnton R. Weiss\nVice President\nTel: 000\nSund Bank", {"account_holder": "Ostara GmbH", "bank_name": "Sund Bank", "bank_country": "Germany", "signed": "false"},
        {"doc_type": "bank_letter"}, ["BNK-026"], "ACCEPT",
    ),
    "tax_form_signed_electronically": (
        "w9", "Form W-9 Request for Taxpayer Identification Number. Employer identification number 00-1234567. Digitally signed by Ines Duarte. Date 2026.01.27.", {"line1_name": "Pelham LLC", "line3_classification": "LLC", "signed": "false"},
        {"signed": True, "signature_kind": "electronic", "sign_date": "2026.01.27", "tin_raw": "00-1234567"}, [], "ACCEPT",
    ),
    "foreign_status_form": (
        "w9", "Form W-8BEN-E Certificate of Foreign Status. Identification of Beneficial Owner. Status: Active NFFE. Part XXX", {"legal_name": "Zeleny GmbH", "country_incorporation": "Germany", "chapter4_status": "Active NFFE", "signed": "false"},
        {"doc_type": "w8", "legal_name": "Zeleny GmbH"}, ["W9-030", "W8-001", "W8-003"], "NEED_MANUAL_REVIEW",
    ),
    "clearing_code_of_china": ("bank", "账户信息\n公司: 虚构公司\n开户银行: 某银行\n账号: 35310188000041111\n联行号: 303100000777", {"account_holder": "虚构公司", "bank_name": "某银行", "signed": "true"}, {"national_clearing": "303100000777", "account_number": "35310188000041111", "bank_country": "CN"}, [], None),
}


@pytest.fixture(scope="module")
def outcome(spark):
    fields = [*READ_FIELDS, "signed"]
    rows = [(k, kind, text, *(model.get(f) for f in fields)) for k, (kind, text, model, *_) in enumerate(CASES.values())]
    docs = spark.createDataFrame(rows, "doc_id int, doc_class string, text string, " + ", ".join(f"{f} string" for f in fields))
    read = read_documents(docs)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    found = apply_rules(read)
    by_doc = {}
    for r in found.collect():
        by_doc.setdefault(r.doc_id, set()).add(r.rule_id)
    verdicts = {r.doc_id: r.verdict for r in fold_verdict(found, read).collect()}
    return {name: (row, by_doc.get(k, set()), verdicts[k]) for k, name in enumerate(CASES) for row in [None]} | {"rows": {r.doc_id: r for r in read.collect()}}


@pytest.mark.parametrize("name", CASES)
def test_case(outcome, name):
    _, _, _, fields, rules, verdict = CASES[name]
    row = outcome["rows"][list(CASES).index(name)]
    assert {f: row[f] for f in fields} == fields
    assert set(rules) <= outcome[name][1]
    assert verdict is None or outcome[name][2] == verdict


def test_differing_readings_are_told(spark):
    readings = spark.createDataFrame([(1, OTHER, GOOD)], "doc_id int, t string, m string")
    assert [(r.value, r.status) for r in crosscheck(readings, {"iban": ("t", "m")}).collect()] == [(GOOD, "MISMATCH")]
