"""What the text of a document says without any model: type, identifiers, holder and signature, as fields that the rules can judge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchlake.functions.columns import text_of
from vouchlake.functions.frames import beside
from vouchlake.operators.extract import _any, ESIGN, TYPED, boxed_tin, doc_class, identifiers, officer_block, type_hint
from vouchlake.operators.guards import electronic_signature, ground_holder, normalise_tin, repair_asian_forms, statement_date


def read_texts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' doc_id and text with the fields that its text gives; what it doesn't give is ''. Narrow: no join, no exchange.

    Of other columns those in `keep` are carried; file_name and ext count if docs has them.
    """
    name = F.col("file_name") if "file_name" in docs.columns else F.lit("")
    ext = F.col("ext") if "ext" in docs.columns else F.lit("")
    text = F.coalesce("text", F.lit(""))
    kind = doc_class(name, text)
    typed = docs.select("doc_id", text.alias("text"), kind.alias("doc_class"), F.nullif(type_hint(text, name, ext, kind), F.lit("")).alias("hint"), *keep)
    out = typed.select(
        "doc_id", "text", "doc_class", F.coalesce("hint", F.when(F.col("doc_class") == "bank", "other").otherwise("unknown")).alias("doc_type"),
        F.lit("").alias("account_holder"), *keep,
    )
    for step in (ground_holder, identifiers, boxed_tin, officer_block):
        out = beside(out, step)
    low = F.lower("text")
    esigned = _any(low, ESIGN)
    evidence = F.when(esigned, "electronically signed").when(_any(low, TYPED), "computer generated").when(F.col("found"), "typed officer block").otherwise("")
    tin = F.coalesce("ein", F.nullif("tin_boxed", F.lit("")), F.lit(""))
    plain = ("account_holder", "iban", "swift_bic", "account_number", "routing_aba", "national_clearing")
    return out.select(
        "doc_id", "text", "doc_class", "doc_type", *(text_of(F.col(c)).alias(c) for c in plain), F.lit("").alias("bank_name"), F.lit("").alias("bank_country"),
        esigned.alias("signed"), evidence.alias("signature_evidence"), tin.alias("tin_raw"),
        F.when(F.col("ein").isNotNull(), "EIN").otherwise(F.col("tin_boxed_type")).alias("tin_type"), *keep,
    )


#: Fields that a model may have read; those that docs lack count as empty.
READ_FIELDS = (
    "account_holder", "bank_name", "bank_country", "iban", "swift_bic", "account_number", "routing_aba", "national_clearing", "doc_date", "signature_evidence",
    "line1_name", "line2_business_name", "line3_classification", "tin_type", "tin_raw", "sign_date", "legal_name", "country_incorporation", "chapter4_status",
    "chapter4_cert_section",
)
# Fixed value: when a tax form was signed electronically.
SIGNED_ON = r"(?is)digitally signed.{0,80}?date:?\s*(\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2})"


def read_documents(docs: DataFrame) -> DataFrame:
    """doc_id, doc_class, doc_type, signed, signature_kind, account_signatory and READ_FIELDS: a model's readings as the guards leave them, filled from the text.

    docs: doc_id, text, and what a model read, each optional: READ_FIELDS and signed. A
    signer is no holder, an owner comes from a sentence that names one; postal and mobile
    numbers are no accounts; what the model left empty is taken from the text's patterns,
    but never replaced; marks of an electronic signature sign; a statement without a date
    takes its period; an officer's block stands in for a signature. One narrow plan: no
    join, no exchange. Null texts count as empty.
    """
    have = set(docs.columns)
    text = F.coalesce("text", F.lit(""))
    name = F.col("file_name") if "file_name" in have else F.lit("")
    ext = F.col("ext") if "ext" in have else F.lit("")
    kind = F.col("doc_class") if "doc_class" in have else doc_class(name, text)
    fields = [(text_of(F.col(c)) if c in have else F.lit("")).alias(c) for c in READ_FIELDS]
    signed = F.lower(text_of(F.col("signed"))).isin("true", "yes") if "signed" in have else F.lit(False)
    out = docs.select("doc_id", text.alias("text"), kind.alias("doc_class"), F.nullif(type_hint(text, name, ext, kind), F.lit("")).alias("hint"), signed.alias("signed"), *fields)
    out = out.withColumn("doc_type", F.coalesce("hint", F.when(F.col("doc_class") == "bank", "other").otherwise("unknown"))).drop("hint")
    for step in (ground_holder, repair_asian_forms, electronic_signature, statement_date, normalise_tin):
        out = beside(out, step)
    # the text's own ids fill what is empty
    own = ("iban", "swift_bic", "account_number", "routing_aba", "national_clearing")
    found = beside(out, lambda d: identifiers(d).select("doc_id", F.struct("ein", *own).alias("_text")))
    for step in (boxed_tin, officer_block):
        found = beside(found, step)
    filled = {c: F.when(F.col(c) == "", text_of(F.col("_text")[c])).otherwise(F.col(c)) for c in own}
    tin, tax = F.coalesce(F.col("_text.ein"), F.nullif("tin_boxed", F.lit("")), F.lit("")), F.col("doc_class") == "w9"
    low = F.lower("text")
    noted = F.when(_any(low, TYPED), "computer generated").when(F.col("found"), "typed officer block").otherwise("")
    filled |= {
        "tin_raw": F.when(tax & (F.col("tin_raw") == ""), tin).otherwise(F.col("tin_raw")),
        "tin_type": F.when(tax & (F.col("tin_type") == "") & (tin != ""), F.when(F.col("_text.ein").isNotNull(), "EIN").otherwise(F.col("tin_boxed_type"))).otherwise(F.col("tin_type")),
        "sign_date": F.when(tax & (F.col("sign_date") == "") & F.col("signed"), F.regexp_extract("text", SIGNED_ON, 1)).otherwise(F.col("sign_date")),
        "signature_evidence": F.when((F.col("signature_evidence") == "") & ~F.col("signed"), noted).otherwise(F.col("signature_evidence")),
    }
    return found.withColumns(filled).select("doc_id", "doc_class", "doc_type", "signed", "signature_kind", "account_signatory", *READ_FIELDS)
