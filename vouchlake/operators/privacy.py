"""Masks, redaction, and the scans that keep sensitive values from leaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlake.functions.columns import TAX_KINDS, blank, digits_of, fake_preserve_shape, mask_value
from vouchlake.operators.extract import EIN, IBAN, LONG_RUN, SSN

# Patterns of values that must not leave.
SSN_SPACED = r"(?<![\d-])\d{3}[ ]\d{2}[ ]\d{4}(?![\d-])"
EIN_SPACED = r"(?<![\d-])(?:(?:\d[ ]?){2}[\-–—][ ]?(?:\d[ ]?){6}\d|\d{2}[ ]\d{7})(?![\d-])"
IBAN_SOLID = r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"
BARE_RUN = r"\b[0-9]{11,18}\b"
TAX_LEAKS = {"ssn": SSN, "ein": EIN, "ssn_spaced": SSN_SPACED, "ein_spaced": EIN_SPACED}
BANK_LEAKS = {"iban": IBAN_SOLID, "long_number": BARE_RUN}


# Fixed value: a number near a word for account; the word stays.
ACCOUNT_NEAR = r"(?i)((?:acc(?:oun)?t|iban|cuenta|cta\.?|konto(?:nummer)?|kto\.?|compte|conta|сч[её]т|계좌|口座|账[户戶號号]|帐[户戶號号])[^0-9]{0,14})([0-9][0-9 \-]{5,20}[0-9])"
#: What a text needs for any pattern, and for the two of accounts, to find something; far quicker than those.
DIGIT, NUMBER = "[0-9]", r"[0-9][0-9 \-]{5,20}[0-9]"
# Fixed value: what a mask leaves behind.
RESIDUE = r"[*…]|XXX?-"


def _mask_all(text: Column, pattern: str, kind: str, label: bool = False) -> Column:
    """Every match of a pattern for account numbers in its masked form; with `label`, the first group stays and the second is masked.

    The matches and what stands between them are laid side by side, so each match is
    masked where it stands, however often its digits occur elsewhere.
    """
    gaps = F.split(text, pattern, -1)
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    masks = F.transform(found(2 if label else 0), lambda m: mask_value(F.lit(kind), m))
    if label:
        masks = F.zip_with(found(1), masks, lambda a, m: F.concat(a, m))
    joined = F.array_join(F.zip_with(gaps, F.concat(F.array(F.lit("")), masks), lambda g, m: F.concat(m, g)), "")
    return F.when(text.rlike(NUMBER) & text.rlike(pattern), joined).otherwise(text)


#: The patterns again with what a mask shows as groups, so that one pass finds and masks.
TAX_MASKS = (
    (r"(?<![\d-])\d{3}-\d{2}-(\d{4})(?![\d-])", "XXX-XX-$1"),
    (r"(?<![\d-])\d{2}-\d{3}(\d{4})(?![\d-])", "XX-XXX$1"),
    (r"(?<![\d-])\d{3}[ ]\d{2}[ ](\d{4})(?![\d-])", "XXX-XX-$1"),
    (r"(?<![\d-])(?:(?:\d[ ]?){2}[\-–—][ ]?(?:\d[ ]?){3}(\d)[ ]?(\d)[ ]?(\d)[ ]?(\d)|\d{2}[ ]\d{3}(\d{4}))(?![\d-])", "XX-XXX$1$2$3$4$5"),
)
IBAN_MASK = ((r"\b([A-Z]{2})[0-9]{2}(?:[ ]?[A-Z0-9]){6,26}[ ]?([A-Z0-9])[ ]?([A-Z0-9])[ ]?([A-Z0-9])[ ]?([A-Z0-9])\b", "$1**…$2$3$4$5"),)


def redact(docs: DataFrame, policy: str = "strict") -> DataFrame:
    """docs with sensitive patterns masked: tax numbers always; IBANs, numbers near a word for account, then long numbers, unless 'tin-only'."""
    plain = text = F.coalesce("text", F.lit(""))
    for pattern, shown in (*TAX_MASKS, *(IBAN_MASK if policy != "tin-only" else ())):
        text = F.regexp_replace(text, pattern, shown)
    docs = docs.withColumn("text", F.when(plain.rlike(DIGIT), text).otherwise(plain))
    if policy != "tin-only":
        for pattern, label in ((ACCOUNT_NEAR, True), (LONG_RUN, False)):  # one projection a step, so that a long text is named once in each
            docs = docs.withColumn("text", _mask_all(F.col("text"), pattern, "account_number", label))
    return docs


def _loose(value: Column) -> Column:
    """A pattern for the value's digits in order, whatever white space and hyphens stand between them."""
    return F.concat_ws(r"[\s\-–]*", F.filter(F.split(digits_of(value), ""), lambda c: c != ""))


def redact_known(docs: DataFrame, secrets: DataFrame) -> DataFrame:
    """docs with their own known values masked, the longest first, whatever stands between the digits.

    Joined by document, never a global list; values that begin alike don't uncover each other.
    """
    longest = F.struct((-F.length("value")).alias("n"), "value", "masked")
    per = secrets.groupBy("doc_id").agg(F.array_sort(F.collect_set(longest)).alias("known"))
    step = lambda t, s: F.when(
        F.length(digits_of(s["value"])) >= 6, F.regexp_replace(F.replace(t, s["value"], s["masked"]), _loose(s["value"]), s["masked"])
    ).otherwise(F.replace(t, s["value"], s["masked"]))
    hidden = F.aggregate(F.coalesce("known", F.array().cast("array<struct<n:int,value:string,masked:string>>")), F.col("text"), step)
    return docs.join(per, "doc_id", "left").withColumn("text", hidden).drop("known")


def secret_registry(values: DataFrame, seed: str = "vouchlake") -> DataFrame:
    """doc_id, kind, value, masked, fake: values with four digits or more, each once a document."""
    kept = values.where(F.length(digits_of(F.col("value"))) >= 4).dropDuplicates(["doc_id", "value"])
    return kept.select(
        "doc_id", "kind", "value", mask_value(F.col("kind"), F.col("value")).alias("masked"), fake_preserve_shape(F.col("kind"), F.col("value"), seed).alias("fake")
    )


def leak_scan(texts: DataFrame, policy: str = "strict") -> DataFrame:
    """texts' key columns with pattern and masked_hit: the first hit of each pattern."""
    patterns = TAX_LEAKS | (BANK_LEAKS if policy == "strict" else {})
    hits = F.array(
        *(F.struct(F.lit(k).alias("pattern"), F.when(F.col("text").rlike(p), mask_value(F.lit("account_number"), F.regexp_extract("text", p, 0))).alias("masked_hit")) for k, p in patterns.items())
    )
    return texts.where(F.col("text").rlike(DIGIT)).select(*(c for c in texts.columns if c != "text"), F.inline(F.filter(hits, lambda h: h["masked_hit"].isNotNull())))


def known_leaks(texts: DataFrame, secrets: DataFrame) -> DataFrame:
    """(doc_id, masked) of known values of six digits or more that a text of the same document still prints, whatever separates the digits."""
    both = texts.join(secrets.where(F.length(digits_of(F.col("value"))) >= 6), "doc_id")
    return both.where(F.contains("text", "value") | F.rlike("text", _loose(F.col("value")))).select("doc_id", "masked").distinct()


def leak_sweep(zones: DataFrame, strict: tuple[str, ...] | None = None) -> DataFrame:
    """zone, pattern, hits over a union of zones. Bank patterns count only in the `strict` zones (all, by default); tax patterns everywhere."""
    hits = leak_scan(zones)
    if strict is not None:
        hits = hits.where(F.col("zone").isin(*strict) | F.col("pattern").isin(*TAX_LEAKS))
    return hits.groupBy("zone", "pattern").agg(F.count("*").alias("hits"))


def leaking(text_columns: list[str], policy: str = "strict") -> Column:
    """Whether a row that is about to be written holds a sensitive pattern."""
    patterns = [*TAX_LEAKS.values(), *(BANK_LEAKS.values() if policy == "strict" else ())]
    hit = F.lit(False)
    for c in text_columns:
        for p in patterns:
            hit = hit | F.coalesce(F.col(c).rlike(DIGIT) & F.col(c).rlike(p), F.lit(False))
    return hit


def kind_conflicts(values: DataFrame) -> DataFrame:
    """Tax-shaped values whose digits hold, or lie in, a bank id of the same document: no tax secrets."""
    tax = values.where(F.col("kind").isin(*TAX_KINDS)).select("doc_id", "value", digits_of(F.col("value")).alias("a"))
    bank = values.where(~F.col("kind").isin(*TAX_KINDS)).select("doc_id", digits_of(F.col("value")).alias("b"))
    overlap = F.contains("a", "b") | F.contains("b", "a")
    return tax.join(bank, "doc_id").where((F.length("a") >= 4) & (F.length("b") >= 4) & overlap).select("doc_id", "value").distinct()


def egress_guard(queries: DataFrame) -> DataFrame:
    """query, allowed: no account, IBAN or tax number in an outgoing query, as written or URL-decoded."""
    decoded = F.coalesce(F.try_url_decode("query"), F.col("query"))
    bad = F.lit(False)
    for p in (*TAX_LEAKS.values(), *BANK_LEAKS.values()):
        bad = bad | F.col("query").rlike(p) | decoded.rlike(p)
    return queries.select("*", (~bad | blank(F.col("query"))).alias("allowed"))


def defake(text: Column, pairs: Column, last: int | None = 800) -> Column:
    """Masked forms replaced by their fakes, and of that the last characters (all, with None); pairs: array of (masked, fake)."""
    whole = F.aggregate(pairs, text, lambda t, s: F.replace(t, s["masked"], s["fake"]))
    return whole if last is None else F.right(whole, F.lit(last))


def training_candidates(values: DataFrame, secrets: DataFrame) -> DataFrame:
    """doc_id, field, value with fakes for masks; a value that still shows a mask teaches masks, so it is dropped."""
    pairs = secrets.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("masked")).alias("n"), "masked", "fake"))).alias("pairs"))
    none = F.array().cast("array<struct<n:int,masked:string,fake:string>>")
    shown = values.join(pairs, "doc_id", "left").withColumn("value", defake(F.col("value"), F.coalesce("pairs", none), None))
    return shown.where(~F.col("value").rlike(RESIDUE)).select("doc_id", "field", "value")
