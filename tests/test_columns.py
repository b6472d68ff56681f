"""Column functions on values whose answers are known."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vouchlake.functions import columns as C


def values(spark, f, *rows):
    names = [f"c{k}" for k in range(len(rows[0]))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} string" for n in names))
    return [r.v for r in df.select("k", f(*map(F.col, names)).alias("v")).orderBy("k").collect()]


def test_checksums(spark):
    ibans = [("DE89370400440532013000",), ("GB82 WEST 1234 5698 7654 32",), ("DE89370400440532013001",), ("",), (None,), ("12345678",)]
    assert values(spark, C.iban_mod97_ok, *ibans) == [True, True, False, False, False, False]
    assert values(spark, C.iban_check_digits, ("DE", "370400440532013000")) == ["89"]
    assert values(spark, C.break_checksum, ("DE89370400440532013009",)) == ["DE89370400440532013000"]
    assert values(spark, C.aba_checksum_ok, ("021000021",), ("021000022",), ("02100002",), (None,)) == [True, False, False, False]


def test_dates(spark):
    said = [("15.01.2023",), ("2023-01-15",), ("01/15/2023",), ("3 de marzo de 2024",), ("January 5, 2024",), ("15 Jan 2023",), ("sometime in 2021",), ("never",), (None,), ("12. märz 2024",)]
    got = [str(x) for x in values(spark, C.parse_date, *said)]
    assert got[:9] == ["2023-01-15", "2023-01-15", "2023-01-15", "2024-03-03", "2024-01-05", "2023-01-15", "2021-07-01", "None", "None"]


def test_names_and_classes(spark):
    pairs = [("Acme GmbH", "acme"), ("Acme Tools", "Acme"), ("", "Acme"), ("A", "A Ltd"), ("Acme", "Other")]
    assert values(spark, C.names_materially_equal, *pairs) == [True, True, False, True, False]
    kinds = [("Individual/sole proprietor",), ("LLC",), ("S Corporation",), ("c corp",), ("Trust/estate",), ("else",), ("",)]
    assert values(spark, C.norm_classification, *kinds) == ["individual_sole_prop", "llc", "corporation", "corporation", "trust_estate", "other", ""]
    assert values(spark, C.to_iso2, ("Deutschland",), ("DE",), ("deu",), ("DE-Bayern",), ("Atlantis",), (None,)) == ["DE", "DE", "DE", "DE", "", ""]
    assert values(spark, C.looks_like_person, ("Jane Q. Sample",), ("Culligan of Denver",), ("Acme LLC",)) == [True, False, False]


def test_masks(spark):
    mask = lambda kind: lambda c: C.mask_value(F.lit(kind), c)
    assert values(spark, mask("ssn"), ("000-12-3456",), ("",)) == ["XXX-XX-3456", ""]
    assert values(spark, mask("tin"), ("00-1234567",), ("000-12-3456",), ("001234567",), ("12",)) == ["XX-XXX4567", "XXX-XX-3456", "*****4567", "****"]
    assert values(spark, mask("iban"), ("DE89 3704 0044 0532 0130 00",), ("DE8",)) == ["DE**…3000", "DE**…"]
    assert values(spark, mask("account_number"), ("000123456",), ("12",)) == ["…3456", "…12"]
    fake = values(spark, lambda c: C.fake_preserve_shape(F.lit("tin"), c, "s"), ("00-1234567",), ("AB 12",))
    assert [x[2] for x in fake[:1]] == ["-"] and fake[1][:3] == "AB " and fake == values(spark, lambda c: C.fake_preserve_shape(F.lit("tin"), c, "s"), ("00-1234567",), ("AB 12",))


def test_first_difference_and_verdicts(spark):
    assert values(spark, C.first_diff, ("abc", "abd"), ("ab", "abc"), ("x", "x"), ("", "x")) == [3, 3, None, 1]
    ways = [("ACCEPT", "REJECT"), ("REJECT", "WARNING"), ("CRASH", "NEED_MANUAL_REVIEW"), ("WARNING", "WARNING"), ("CRASH", "REJECT"), ("CRASH", "ACCEPT")]
    assert values(spark, C.verdict_direction, *ways) == ["unsafe", "safe", "", "", "unsafe", "safe"]



@settings(max_examples=5, deadline=None)
@given(runs=st.lists(st.text("0123456789", min_size=11, max_size=18), min_size=1, max_size=30))
def test_no_long_number_survives_redaction(runs):
    from pyspark.sql import SparkSession

    from vouchlake.operators.privacy import redact

    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    df = spark.createDataFrame([(k, f"pay to {r} now") for k, r in enumerate(runs)], "doc_id int, text string")
    for r in redact(df).collect():
        assert not any(x in r.text for x in runs)


def test_numbers_that_begin_or_end_alike(spark):
    from vouchlake.operators.privacy import redact, redact_known

    texts = ["a 10000000000 b 100000000009999999 c", "account 12345678 and 1234567812345678", "x12345678901 acct: 1-2-3-4-5-6-7 12345678901", "no. 12 - 34", "DE89370400440532013000 and DE893704004405320130001"]
    got = [r.text for r in redact(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == ["a …0000 b …9999 c", "account …5678 and …5678", got[2], "no. 12 - 34", "DE**…3000 and DE**…0001"]
    assert got[2].startswith("x12345678901 acct: …")  # digits within a word are no number of their own
    docs = spark.createDataFrame([(1, "123456 then 1234567 then 1 2 3-4 5 6 7")], "doc_id int, text string")
    known = spark.createDataFrame([(1, "123456", "…A"), (1, "1234567", "…B")], "doc_id int, value string, masked string")
    assert redact_known(docs, known).first().text == "…A then …B then …B"


@settings(max_examples=8, deadline=None)
@given(base=st.text("01", min_size=22, max_size=22), cuts=st.lists(st.tuples(st.integers(0, 4), st.integers(11, 18)), min_size=2, max_size=12))
def test_redaction_of_overlapping_numbers_equals_python(base, cuts):
    """Numbers cut from one string, so that many are beginnings or ends of others."""
    import re

    from pyspark.sql import SparkSession

    from vouchlake.operators.extract import LONG_RUN
    from vouchlake.operators.privacy import redact

    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    text = " x ".join(base[a : a + n] for a, n in cuts)
    want = re.sub(LONG_RUN, lambda m: "…" + re.sub("[^0-9]", "", m[0])[-4:], text)
    assert redact(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().text == want
