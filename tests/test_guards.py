"""Guards, evidence and confidence on small cases that the bound tables don't hold."""

from vouchlake.operators import extract as X
from vouchlake.operators import guards as G
from vouchlake.operators import reconcile as C

AUDIT = "doc_id long, text string, iban string, account_number string, routing_aba string, clearing_printed string, national_clearing string, branch_code string"
GOOD, OTHER = "DE89370400440532013000", "DE02120300000000202051"
ITALIAN = "IT60X0542811101000000123456"


def test_audit_of_bank_ids(spark):
    rows = [
        (1, "", "DE89370400440532013001", "", "", "", "", ""),  # one of two candidates has the same tail
        (2, "", "DE89370400440532013009", "", "", "", "", ""),  # two candidates, none with the tail
        (3, "Account 532013000", GOOD, "0532013000", "", "", "", ""),
        (4, "no number here", GOOD, "0532013000", "", "", "", ""),
        (5, "", "12-345 678", "", "", "", "", ""),
        (6, "", "12345678", "12345678", "", "", "", ""),
        (7, "", "12345678", "999", "", "", "", ""),
        (8, "", ITALIAN, "", "05428", "", "", ""),
        (9, "", ITALIAN, "", "11111", "", "", "44"),
        (10, "", "", "", "01-2345", "012345", "", ""),
        (11, "", "", "", "012345", "012345", "77", ""),
        (12, "", "", "", "021-000-021", "", "", ""),
        (13, None, None, None, None, None, None, None),
        (14, "", "FR1420041010050500013M02607", "", "", "", "", ""),
    ]
    found = [(1, "DE44500105175407323001"), (1, GOOD), (2, GOOD), (2, OTHER), (14, GOOD)]
    candidates = spark.createDataFrame(found, "doc_id long, iban string")
    got = {r.doc_id: r for r in G.audit_bank_ids(spark.createDataFrame(rows, AUDIT), candidates).collect()}
    assert len(got) == len(rows)
    assert got[1].iban == "DE44500105175407323001" and got[1].note.startswith("IBAN taken from the text")
    assert got[2].iban == "DE89370400440532013009" and got[2].note == "check digits wrong"
    assert (got[3].account_number, got[3].note) == ("532013000", "check digits right; account as printed")
    assert (got[4].account_number, got[4].note) == ("0532013000", "check digits right")
    assert (got[5].iban, got[5].account_number, got[5].note) == ("", "12345678", "account number moved out of the IBAN field")
    assert (got[6].account_number, got[6].note) == ("12345678", "IBAN field repeated the account")
    assert (got[7].account_number, got[7].note) == ("999", "IBAN field held no IBAN")
    assert (got[8].routing_aba, got[8].branch_code) == ("", "11101") and got[8].note.endswith("domestic code agrees with the IBAN")
    assert got[9].branch_code == "44" and got[9].note.endswith("domestic code differs from the IBAN")
    assert (got[10].routing_aba, got[10].national_clearing, got[10].note) == ("", "012345", "routing number is a clearing code")
    assert (got[11].national_clearing, got[11].note) == ("77", "domestic code removed")
    assert (got[12].routing_aba, got[12].note) == ("021000021", "")
    assert got[13][1:] == ("", "", "", "", "", "") and got[14].iban.startswith("FR")


def test_noise(spark):
    rows = [
        (1, "a.pdf", "Acme Corp", "supervised by X", "pay Beta"),
        (2, "a.pdf", "Acme Corp", "Bank of A", "pay ACME CORP"),
        (3, "for Dr. Clarke.pdf", "Dr. Clarke", "N/A", "text"),
        (4, None, None, None, None),
        (5, "bank of a.pdf", "abc", "Bank of A", "text"),
    ]
    got = {r.doc_id: (r.account_holder, r.bank_name) for r in G.drop_noise(spark.createDataFrame(rows, "doc_id long, file_name string, account_holder string, bank_name string, text string")).collect()}
    assert got == {1: ("", ""), 2: ("Acme Corp", "Bank of A"), 3: ("", ""), 4: ("", ""), 5: ("abc", "")}


def test_names_of_banks(spark):
    cases = [
        ("Swedbank AB", True), ("Danske Bank", True), ("pay to Bank of America", True), ("at Bank Pekao", True), ("Banco de Chile", True), ("某某银行", True),
        ("Bank confirmation letter", False), ("our bank details", False), ("a bank\nOf note", False), ("Bank of the people", False), ("bancolombia", False),
        ("Bancolombia", True), ("Česká spořitelna", False), ("Moravská Spořitelna", True), (None, False), ("", False),
    ]
    df = spark.createDataFrame([(t, w) for t, w in cases], "text string, want boolean").selectExpr("*", "'' AS bic")
    for r in df.withColumn("got", X.bank_identity(df["text"], df["bic"])).collect():
        assert r.got == r.want, r.text


def test_confidence_levels_and_reasons(spark):
    ids = "doc_id long, iban_text string, iban_model string, account_text string, account_model string, swift_text string, swift_model string"
    rows = [
        (1, "A1", "a1", "", "", "", ""), (2, "A1", "A2", "", "", "", ""), (3, "", "A1", "", "", "", ""), (4, "", "A1", "", "5", "", ""), (5, "A1", "", "", "", "", ""),
        (6, "", "A1", "", "", "", ""), (7, None, None, None, None, None, None), (8, "", "", "", "", "", ""), (9, "", "", "", "", "", ""),
    ]
    votes = spark.createDataFrame([(8, True, "unverified"), (9, False, "unverified")], "doc_id long, contested boolean, signature_kind string")
    signals = spark.createDataFrame(
        [(6, None, None, None, None, ["iban"]), (7, ["b", "a", None], [], True, None, None), (9, None, ["x"], False, False, None)],
        "doc_id long, engines_disagree array<string>, still_empty array<string>, thin boolean, type_rescued boolean, confirmed array<string>",
    )
    readings = spark.createDataFrame(rows, ids)
    got = {r.doc_id: (r.level, r.reasons) for r in C.confidence(readings, votes, signals).collect()}
    assert got == {
        1: ("high", []), 2: ("low", ["readings differ: iban"]), 3: ("medium", ["model alone: iban"]), 4: ("low", ["model alone: iban", "model alone: account_number"]),
        5: ("high", []), 6: ("high", []), 7: ("low", ["engines differ: a", "engines differ: b", "hardly any text"]), 8: ("low", ["signature contested"]),
        9: ("low", ["still empty: x", "signature unsettled"]),
    }
    assert {r.doc_id: r.level for r in C.confidence(readings, votes).collect()}[9] == "medium"


def test_both_cuts_of_an_iban_and_wide_letters(spark):
    rows = [(1, "ＤＥ89 3704 0044 0532 0130 00"), (2, GOOD + " 12"), (3, None), (4, "DE89370400440532013001")]
    got = {(r.doc_id, r.iban) for r in X.valid_ibans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, GOOD), (2, GOOD)}
