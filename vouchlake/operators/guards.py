"""Guards on what a reader claims: values that the document does not support are moved, dropped or replaced. Columns and windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchlake.functions.columns import blank, digits_of, iban_mod97_ok, norm_id, parse_date, text_of
from vouchlake.operators.extract import ESIGN, INSTRUCTION_MARKS, _any, identifiers, page_flags

# Labels that say in which role a name is printed.
SIGNATORY = (
    r"(?i)\b(?:account\s+signator(?:y|ies)|authori[sz]ed\s+sign(?:er|ers|atory|atories)|signator(?:y|ies)|contact\s+(?:person|name)|representative|"
    r"attn\.?|attention|prepared\s+by|requested\s+by|submitted\s+by)\b"
)
OWNER = r"(?i)account\s*holder|beneficiary|account\s*name|in\s+the\s+name\s+of|a\s+nombre\s+de|titular|kontoinhaber|intestat"
OWNER_SENTENCES = (
    r"(?i)\b(?:verify|verifies|confirm|confirms|certify|certifies)\s+that\s+([A-Z][\p{L}\p{N}_&.,'()\- ]{2,70}?)\s+is\s+(?:a|an|our)\s+(?:valued\s+)?(?:customer|client|account\s*holder)",
    r"(?i)\b([A-Z][\p{L}\p{N}_&.,'()\- ]{2,60}?)\s+(?:holds|maintains)\s+(?:a|an|the|its)?\s*(?:(?:business|checking|deposit)\s+)*account",
)
# Marks of regulators, which are no banks.
REGULATORS = ("vigilado", "superintendencia", "supervised by", "regulated by")
# Names that stand in forms and tutorials for any name.
PLACEHOLDERS = (
    "acme", "acme corp", "acme corporation", "acme inc", "acme llc", "john doe", "jane doe", "john smith", "jane smith", "example corp",
    "example company", "test company", "sample company", "company name", "your company", "n/a",
)
# Fixed value: the period of a statement.
PERIOD = r"(\d{1,2}[- ]?[A-Za-z]{3}[- ]?\d{4})\s*(?:to|through|–|—|-)\s*(\d{1,2}[- ]?[A-Za-z]{3}[- ]?\d{4})"


def _context(text: Column, value: Column) -> Column:
    """The line that prints a value and the one above it; '' where none does."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lower(value))), True).cast("int")
    return F.when(at > 0, F.array_join(F.slice(lines, F.greatest(at - 1, F.lit(1)), F.least(at, F.lit(2))), "\n")).otherwise("")


def ground_holder(docs: DataFrame) -> DataFrame:
    """doc_id, account_holder, account_signatory: a name under a signer's label is no owner; an empty owner is taken from a sentence that names one."""
    # under another name first: within a lambda, a column that the same select names anew means the new one
    docs = docs.select("doc_id", "text", text_of(F.col("account_holder")).alias("_holder"))
    holder = F.col("_holder")
    where = _context(F.col("text"), holder)
    signs = (holder != "") & where.rlike(SIGNATORY) & ~where.rlike(OWNER)
    said = F.coalesce(*(F.nullif(F.regexp_replace(F.trim(F.regexp_extract("text", p, 1)), r"^[.,;:'\"]+|[.,;:'\"]+$", ""), F.lit("")) for p in OWNER_SENTENCES))
    named = F.when(F.length(said).between(3, 70), said).otherwise("")
    return docs.select(
        "doc_id", F.when((holder == "") | signs, named).otherwise(holder).alias("account_holder"), F.when(signs, holder).otherwise("").alias("account_signatory")
    )


def statement_date(docs: DataFrame) -> DataFrame:
    """doc_id, doc_date: a statement without a date takes its period."""
    period = F.concat_ws(" to ", F.nullif(F.regexp_extract("text", PERIOD, 1), F.lit("")), F.nullif(F.regexp_extract("text", PERIOD, 2), F.lit("")))
    fill = blank(F.col("doc_date")) & (F.col("doc_type") == "bank_statement")
    return docs.select("doc_id", F.when(fill, period).otherwise(text_of(F.col("doc_date"))).alias("doc_date"))


def electronic_signature(docs: DataFrame) -> DataFrame:
    """doc_id, signed, signature_kind, doc_date: marks of an electronic signature sign, and their time dates."""
    marked = ~F.coalesce("signed", F.lit(False)) & _any(F.lower(F.coalesce("text", F.lit(""))), ESIGN)
    stamp = F.regexp_extract("text", r"(\d{4}-\d{2}-\d{2})\s*\|\s*\d{1,2}:\d{2}", 1)
    return docs.select(
        "doc_id", (F.coalesce("signed", F.lit(False)) | marked).alias("signed"), F.when(marked, "electronic").otherwise("").alias("signature_kind"),
        F.when(marked & blank(F.col("doc_date")), stamp).otherwise(text_of(F.col("doc_date"))).alias("doc_date"),
    )


def audit_bank_ids(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, iban, account_number, routing_aba, national_clearing, branch_code, note.

    What doesn't begin like an IBAN is an account. An invalid IBAN is replaced by the only
    valid one of its country that the text prints (`candidates`: doc_id, iban), of those
    with its last four signs where there are any. A routing number has nine digits: another
    one that is printed as a clearing code (`clearing_printed`) moves there; any other is
    removed and, for Italy, held against the bank and branch codes in the IBAN. An account
    that fills the end of the IBAN with zeros before it is given as the text prints it.
    Nulls count as empty; notes are joined by "; ".
    """
    printed = candidates.groupBy("doc_id").agg(F.collect_set("iban").alias("printed"))
    docs = docs.withColumn("_iban", norm_id(F.col("iban")))
    v, acct = F.col("_iban"), digits_of(F.col("account_number"))
    r, clearing = digits_of(F.col("routing_aba")), digits_of(F.col("clearing_printed"))
    stray = (v != "") & ~v.rlike("^[A-Z]{2}[0-9]{2}")
    inside = digits_of(v)
    own = F.filter(F.coalesce("printed", F.array().cast("array<string>")), lambda x: F.substring(x, 1, 2) == F.substring(v, 1, 2))
    alike = F.filter(own, lambda x: F.substring(x, -4, 4) == F.substring(v, -4, 4))
    pick = F.when(F.size(alike) > 0, alike).otherwise(own)
    repair = (v != "") & ~stray & ~iban_mod97_ok(F.col("iban")) & (F.size(pick) == 1)
    foreign = (r != "") & (F.length(r) != 9)
    moved = foreign & (r == clearing) & blank(F.col("national_clearing"))
    first = docs.join(printed, "doc_id", "left").select(
        "doc_id", "text", r.alias("_r"), (foreign & ~moved).alias("_domestic"),
        F.when(stray, "").when(repair, pick[0]).otherwise(v).alias("iban"),
        F.when(stray & (inside != "") & (acct == ""), inside).otherwise(text_of(F.col("account_number"))).alias("account_number"),
        F.when(foreign, "").otherwise(r).alias("routing_aba"),
        F.when(moved, text_of(F.col("clearing_printed"))).otherwise(text_of(F.col("national_clearing"))).alias("national_clearing"),
        text_of(F.col("branch_code")).alias("_branch"),
        F.when(stray & (inside != "") & (acct == ""), "account number moved out of the IBAN field")
        .when(stray & (inside != "") & (inside == acct), "IBAN field repeated the account").when(stray, "IBAN field held no IBAN").alias("_stray"),
        F.when(repair, "IBAN taken from the text").alias("_repair"), F.when(moved, "routing number is a clearing code").alias("_moved"),
    )
    iban, digits = F.col("iban"), digits_of(F.col("account_number"))
    bare = F.ltrim(digits, F.lit("0"))
    padded = (iban != "") & (bare != "") & (bare != digits) & F.endswith(iban, digits) & F.contains(F.coalesce("text", F.lit("")), bare)
    italian = F.col("_domestic") & F.startswith(iban, F.lit("IT")) & (F.length(iban) >= 15)
    bank, branch = F.substring(iban, 6, 5), F.substring(iban, 11, 5)
    note = F.concat_ws(
        "; ", "_stray", "_repair", F.when(iban != "", F.when(iban_mod97_ok(iban), "check digits right").otherwise("check digits wrong")), "_moved",
        F.when(italian, F.when(F.col("_r").isin(bank, branch), "domestic code agrees with the IBAN").otherwise("domestic code differs from the IBAN"))
        .when(F.col("_domestic"), "domestic code removed"),
        F.when(padded, "account as printed"),
    )
    return first.select(
        "doc_id", "iban", F.when(padded, bare).otherwise(F.col("account_number")).alias("account_number"), "routing_aba", "national_clearing",
        F.when(italian & (F.col("_branch") == ""), branch).otherwise(F.col("_branch")).alias("branch_code"), note.alias("note"),
    )


def normalise_tin(docs: DataFrame) -> DataFrame:
    """doc_id, tin_raw, tin_type, sign_date: a date in the number's place is the signing date."""
    v, kind = text_of(F.col("tin_raw")), F.upper(text_of(F.col("tin_type")))
    dated = v.rlike(r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$") & parse_date(v).isNotNull()
    return docs.select(
        "doc_id", F.when(dated, "").otherwise(v).alias("tin_raw"),
        F.when(kind.rlike("SSN|SOCIAL"), "SSN").when(kind.rlike("EIN|EMPLOYER"), "EIN").otherwise("").alias("tin_type"),
        F.when(dated & blank(F.col("sign_date")), v).otherwise(text_of(F.col("sign_date"))).alias("sign_date"),
    )


def drop_noise(docs: DataFrame) -> DataFrame:
    """doc_id, bank_name, account_holder: no regulators' stamps as banks, no names that only the file name has, no placeholders that the text doesn't print."""
    bank, holder = text_of(F.col("bank_name")), text_of(F.col("account_holder"))
    printed = lambda v: F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower(v))
    echo = lambda v: (F.length(v) >= 4) & F.contains(F.lower(F.coalesce("file_name", F.lit(""))), F.lower(v)) & ~printed(v)
    made_up = lambda v: F.lower(v).isin(*PLACEHOLDERS) & ~printed(v)
    return docs.select(
        "doc_id", F.when(_any(F.lower(bank), REGULATORS) | echo(bank) | made_up(bank), "").otherwise(bank).alias("bank_name"),
        F.when(echo(holder) | made_up(holder), "").otherwise(holder).alias("account_holder"),
    )


def drop_echoes(values: DataFrame, exemplars: DataFrame, docs: DataFrame) -> DataFrame:
    """values without those that an example of another document taught and the document does not print."""
    taught = exemplars.select(F.lower(F.trim("value")).alias("v"), F.col("doc_id").alias("example")).where("length(v) >= 4").distinct()
    pairs = values.withColumn("v", F.lower(F.trim("value"))).join(taught, "v").where("example <> doc_id").select("doc_id", "field", "v").distinct()
    echoes = pairs.join(docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t")), "doc_id").where(~F.contains("t", "v")).select("doc_id", "field")
    return values.join(echoes, ["doc_id", "field"], "left_anti")


def ground_instructions(docs: DataFrame, strong: DataFrame) -> DataFrame:
    """doc_id, doc_type, uncertain: payment instructions without a mark of them are a letter if all evidence says so, else other."""
    both = docs.join(strong.select("doc_id", "strong"), "doc_id", "left")
    bare = (F.col("doc_type") == "payment_instructions") & ~_any(F.lower(F.coalesce("text", F.lit(""))), INSTRUCTION_MARKS)
    rescued = bare & F.coalesce("strong", F.lit(False))
    return both.select("doc_id", F.when(rescued, "bank_letter").when(bare, "other").otherwise(F.col("doc_type")).alias("doc_type"), rescued.alias("uncertain"))


def repair_asian_forms(docs: DataFrame) -> DataFrame:
    """doc_id, account_number, bank_country: postal codes and mobile numbers are no accounts; labelled accounts are."""
    # fixed values below: the labels of such forms
    narrow = F.translate(F.coalesce("text", F.lit("")), "０１２３４５６７８９－−：", "0123456789--:")
    jp = narrow.rlike("〒|口座")
    cn = narrow.rlike("账|帐|户名|开户") & ~narrow.contains("口座")
    a = digits_of(F.col("account_number"))
    postal = jp & (F.length(a) == 7) & F.contains(F.regexp_replace(narrow, r"〒\s*([0-9]{3})[-‐–]?\s*([0-9]{4})", "〒$1$2"), F.concat(F.lit("〒"), a))
    near = F.substr(narrow, F.greatest(F.lit(1), F.instr(narrow, a) - 24), F.lit(24))
    mobile = cn & a.rlike(r"^1[3-9][0-9]{9}$") & near.rlike("电话|手机|联系人|联系方式|传真|邮编")
    kept = F.when(postal | mobile, "").otherwise(text_of(F.col("account_number")))
    jp_label = F.regexp_extract(narrow, r"(?:口座番号|Account\s*Number)[^0-9]{0,20}([0-9]{4,10})", 1)
    cn_label = F.regexp_replace(F.regexp_extract(narrow, r"(?:开户账号|收款账[户号]|银行账[户号]|账号|帐号|账户)\s*:?\s*([0-9][0-9 \-]{6,28}[0-9])", 1), "[ -]", "")
    country = F.when(blank(F.col("bank_country")) & jp, "JP").when(blank(F.col("bank_country")) & cn, "CN").otherwise(text_of(F.col("bank_country")))
    filled = F.when(kept != "", kept).when(jp, jp_label).when(cn, cn_label).otherwise("")
    return docs.select("doc_id", filled.alias("account_number"), country.alias("bank_country"))


# ---- pages and packets


def gap_bonus(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, bonus: what a page offers for the gaps (array column) that are still open."""
    keyed = page_flags(pages).withColumn("doc_id", F.struct("doc_id", "page_no", "gaps", "bank_letter", "w9_form", "text"))
    got = identifiers(keyed.select("doc_id", "text")).select("doc_id.*", "iban", "account_number", "routing_aba", "swift_bic", "ein")
    open_ = lambda g: F.array_contains("gaps", g)
    has = lambda *cs: F.coalesce(*(F.col(c) for c in cs)).isNotNull()
    bonus = (
        F.when(open_("no account") & has("iban", "account_number"), 3).otherwise(0) + F.when(open_("no routing") & has("routing_aba"), 3).otherwise(0)
        + F.when(open_("no holder") & F.col("text").rlike(OWNER), 2).otherwise(0)
        + F.when(open_("no bank name") & (F.col("bank_letter") | has("swift_bic")), 2).otherwise(0)
        + F.when(open_("no tin") & has("ein"), 3).otherwise(0) + F.when(open_("no line 1") & F.col("w9_form"), 1).otherwise(0)
    )
    return got.select("doc_id", "page_no", F.when(blank(F.col("text")), 0).otherwise(bonus).alias("bonus"))


def ladder_pages(scored: DataFrame, k: int = 2) -> DataFrame:
    """The k pages that close most gaps, ties to the lower page; pages that close none are not read."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("bonus"), "page_no")
    return scored.where("bonus >= 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "page_no", "rank")


def select_w8_pages(scored: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, page_no, rank: the identification page, the certification page, then the best of the rest.

    The certification is sought from the end, in the second half of a form of four pages
    or more: Part XXX, else Sign Here, else the word itself, else the last page.
    """
    doc = Window.partitionBy("doc_id")
    half = F.when(F.col("n") >= 4, F.floor(F.col("n") / 2)).otherwise(0)
    placed = scored.withColumn("n", F.count("*").over(doc)).withColumn("nth", F.row_number().over(doc.orderBy("page_no")) - 1)
    late = F.col("nth") >= half
    last = lambda p: F.max(F.when(late & F.col("text").rlike(p), F.col("page_no"))).over(doc)
    roles = placed.withColumn(
        "part1", F.coalesce(F.min(F.when(F.col("text").rlike("(?i)identification of beneficial owner"), F.col("page_no"))).over(doc), F.min("page_no").over(doc))
    ).withColumn("cert", F.coalesce(last(r"(?i)part\s+xxx\b"), last(r"(?i)sign\s*here"), last(r"(?i)\bcertification\b"), F.max("page_no").over(doc)))
    role = F.when(F.col("page_no") == F.col("part1"), 0).when(F.col("page_no") == F.col("cert"), 1).otherwise(2)
    order = doc.orderBy("role", F.desc("score"), "page_no")
    return roles.withColumn("role", role).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "page_no", "rank")


def best_of_packet(docs: DataFrame) -> DataFrame:
    """packet_id, chosen, skipped: the document with the most points (kind of file, page score, letters), ties to the smaller id."""
    points = F.col("score") + F.when(F.col("ext") == "pdf", 4).when(F.col("ext").isin("png", "jpg", "jpeg", "tif", "tiff"), 2).when(F.col("ext").isin("eml", "msg"), 1).otherwise(0)
    points = points + F.when(F.col("bank_letter"), 10).otherwise(0) - F.when(F.col("invoice") & ~F.col("bank_letter"), 3).otherwise(0)
    order = Window.partitionBy("packet_id").orderBy(F.desc("points"), "doc_id")
    ranked = docs.withColumn("points", points).withColumn("at", F.row_number().over(order))
    return ranked.groupBy("packet_id").agg(F.min(F.when(F.col("at") == 1, F.col("doc_id"))).alias("chosen"), F.count_if(F.col("at") > 1).alias("skipped"))


def resolve_prefix(runs: DataFrame, prefix: str) -> DataFrame:
    """The run whose id starts so, if it is the only one."""
    hit = runs.where(F.col("run_id").cast("string").startswith(prefix))
    return hit.agg(F.count("*").alias("n"), F.min("run_id").alias("run_id")).where("n = 1").select("run_id")


def field_confidence(readings: DataFrame, engines: DataFrame | None = None) -> DataFrame:
    """doc_id, field, chip: verified where the text gives or confirms the value, agreed where two engines read the same, check where something differs, else model-only.

    engines: doc_id, field, agree, one row a field that two engines read.
    """
    both = readings.withColumn("agree", F.lit(None).cast("boolean")) if engines is None else readings.join(engines.select("doc_id", "field", "agree"), ["doc_id", "field"], "left")
    text = F.col("status").isin("confirmed", "confirmed-padded", "filled")
    chip = F.when(text, "verified").when((F.col("status") == "MISMATCH") | (F.col("agree") == F.lit(False)), "check").when(F.col("agree"), "agreed").otherwise("model-only")
    return both.select("doc_id", "field", chip.alias("chip"))
