"""Identifiers and evidence in text, page choice, and what two readings say. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchlake.functions.columns import IBAN_LENGTH, blank, digits_of, display_value, iban_mod97_ok, lookup, norm_id, text_of, to_iso2
from vouchlake.functions.frames import beside

# Shapes of identifiers.
IBAN = r"\b([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){10,30})\b"
BIC = r"\b([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"
BIC_LABELLED = r"(?i)(?:bic|swift)[^A-Z0-9]{0,8}([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)"
EIN = r"(?<![\d-])(\d{2}-\d{7})(?![\d-])"
SSN = r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])"
EIN_BOXED = r"(?is)employer\s+identification\s+number.{0,120}?((?:\d[ \t]*[\-–—]?[ \t]*){8}\d)"
ROUTING = r"(?i)((?:bank\s+)?(?:routing|aba|ach|rtn|wire[s]?)(?:[ /]*(?:aba|routing|number|no\.?|#))?[^0-9]{0,28})([0-9]{9})\b"
ACCOUNT = r"(?i)(?:acc(?:oun)?t|cuenta|cta\.?|konto(?:nummer)?|kto\.?|compte|conta|сч[её]т|계좌|口座|账[户戶号號]|帐[户戶号號])[^0-9]{0,14}([0-9][0-9 \-]{5,20}[0-9])"
LONG_RUN = r"\b[0-9][0-9 \-]{9,20}[0-9]\b"
CLEARING = {
    "CNAPS": r"(?:联行号码?|CNAPS)[^0-9]{0,10}([0-9]{12})\b",
    "IFSC": r"(?i)\bIFSC[^A-Z0-9]{0,8}([A-Z]{4}0[A-Z0-9]{6})\b",
    "SORT": r"(?i)\bsort\s*code[^0-9]{0,10}([0-9]{2}[- ]?[0-9]{2}[- ]?[0-9]{2})\b",
    "BSB": r"(?i)\bBSB[^0-9]{0,10}([0-9]{3}[- ]?[0-9]{3})\b",
    "BLZ": r"(?i)(?:bankleitzahl|\bBLZ)[^0-9]{0,10}([0-9]{8})\b",
}
PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BOXED = r"(?m)(?:^[ \t]*(?:[–\-—][ \t]*)?(?:\d[ \t]*(?:[–\-—][ \t]*)?|[–\-—][ \t]*)$\n?){9,13}"
# Phrases that tell kinds of pages apart.
LETTER_PHRASES = (
    "please accept this letter", "account confirmation", "confirmation that", "we confirm that", "maintained at", "routing instructions",
    "letter as confirmation", "bank confirmation", "treasury analyst", "to whom it may concern", "this letter is to confirm",
    "account confirmation certificate", "conferma coordinate bancarie", "coordinate bancarie", "vi confermiamo", "certificación bancaria",
    "certificacion bancaria", "certificado bancario", "bankbestätigung", "kontobestätigung",
)
# What a holder, a greeting, a statement and a bank's name look like.
HOLDER_LABELS = (
    "account holder", "beneficiary", "account name", "in the name of", "intestatario", "titular", "kontoinhaber", "holder:", "we confirm that", "confirm that",
)
GREETINGS = ("dear ", "to whom it may concern", "re:", "subject:", "a quien corresponda", "sehr geehrte")
STATEMENT_MARKS = ("statement period", "opening balance", "closing balance", "statement of account", "account statement")
BANK_TOKENS = ("bank", "banka", "banca", "banco", "banque", "sparkasse", "sporitelna", "spořitelna")
CONNECTIVES = ("of", "de", "di", "du", "der")
STRONG_LETTER = ("account confirmation", "please accept this letter", "this letter is to confirm")
INVOICE_HEADER = r"(?im)^\s*(invoice|rechnung|fattura|factura)\s*$"
INVOICE_MARKS = (
    "invoice number", "invoice no", "invoice date", "amount due", "subtotal", "payment terms", "purchase order number", "pro forma",
    "rechnungsnummer", "rechnungsdatum", "numero fattura", "número de factura", "发票号码", "發票號碼", "发票日期", "發票日期",
)
REMITTANCE = (
    "remit", "being paid", "must include", "must be accompanied", "when making payment", "payments received without", "amt:",
    "payment amount per invoice", "ach payment", "payment instruction", "wire transfer", "include the following",
)
INSTRUCTION_MARKS = (
    "payment instruction", "ach payments only", "for ach payments", "remittance advice", "remittance sent", "email remittance",
    "banking details are confidential", "ach payment type", "standard settlement instructions", "settlement instructions", "for ach delivery",
    "for wire transfers", "wire instructions",
)
TAX_FORM_MARKS = ("form w-9", "request for taxpayer identification", "substitute form w-9", "substitute w-9", "w-8ben", "certificate of foreign status")
BANK_WORDS = (
    "iban", "swift", "bic", "account", "acct", "routing", "aba", "sort code", "bank", "cuenta", "banco", "beneficiario", "konto",
    "bankverbindung", "kontonummer", "blz", "empfänger", "compte", "banque", "conta", "agência", "beneficiário", "счет", "счёт", "банк",
    "реквизит", "получатель", "계좌", "은행", "口座", "銀行", "账号", "帐号", "账户", "银行", "开户", "開戶",
)
TAX_WORDS = ("w-9", "taxpayer", "tin", "social security", "employer identification", "classification", "certification", "signature of", "disregarded")
ESIGN = ("docusign envelope", "docusigned by", "adobe sign", "firmado digitalmente", "electronically signed", "digitally signed")
TYPED = ("computer-generated", "computer generated", "system-generated", "this is a computer")
SIGN_OFF = r"(?i)^\s*(sincerely|best regards|kind regards|warm regards|regards|yours truly|yours sincerely|respectfully(?: yours)?)\s*[,.]?\s*$"
TITLE = r"(?i)vice president|president|manager|director|officer|treasurer|treasury|banker|relationship manager|\bv\.?p\.?\b"
CONTACT = r"(?i)phone|mobile|tel\b|fax|e-?mail|@|www\.|bank"
ORGANISATION = r"(?i)\b(bank|banking|services|department|group|division|team|corporation|company)\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
FAMILIES = {
    "email": (r"()(" + EMAIL + r")", False),
    "account": (r"(?i)(acc(?:oun)?t(?: number| no\.?)?|konto(?:nummer)?|cuenta)[^0-9\n]{0,14}([0-9][0-9 \-]{4,20}[0-9])", True),
    "phone": (r"(?i)(phone|tel|mobile|fax)[^0-9+\n]{0,8}(\+?[0-9][0-9 ()\-]{5,18}[0-9])", False),
    "tax_id": (r"(?i)(tax id|vat(?: no\.?| number)?|tin|ein)[^A-Z0-9\n]{0,6}([A-Z]{0,2}[0-9][0-9\-]{5,14})", False),
    "company_reg": (r"(?i)(company (?:no\.?|number|reg(?:istration)?)|hrb)[^A-Z0-9\n]{0,6}([A-Z]{0,3}[0-9]{4,12})", False),
    "clearing": (r"(?i)(sort code|blz|bsb|ifsc|cnaps)[^A-Z0-9\n]{0,8}([A-Z0-9][A-Z0-9\- ]{4,12}[A-Z0-9])", False),
    "address": (r"(?i)(address)[: ]{1,3}([^\n]{4,120})", False),
}


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _either(words: tuple[str, ...]) -> str:
    return "|".join(rf"\Q{w}\E" for w in words)


def _any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words, as one pattern."""
    return c.rlike(_either(words))


def _count(c: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text holds."""
    return sum((c.contains(w).cast("int") for w in words), F.lit(0))


def content_id(c: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the bytes: equal content is the same run."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def split_pages(docs: DataFrame, surveyed: int = 12, most_characters: int | None = None) -> DataFrame:
    """doc_id, page_no, text, surveyed: form feeds part pages, and all pages are kept.

    surveyed marks the first pages, which a first look reads. most_characters, if given,
    shortens a document's text before it is parted (for sources that are plain text).
    """
    text = F.coalesce("text", F.lit(""))
    text = text if most_characters is None else F.substring(text, 1, most_characters)
    pages = docs.select("doc_id", F.posexplode(F.split(text, "\f")).alias("page_no", "text"))
    return pages.withColumn("surveyed", F.col("page_no") < surveyed)


def identifiers(docs: DataFrame) -> DataFrame:
    """doc_id with the first of each kind of identifier (null where there is none)."""
    t = F.coalesce("text", F.lit(""))
    found = F.regexp_replace(F.regexp_extract(t, IBAN, 1), " ", "")
    token = F.try_element_at(F.filter(_all(t, BIC), lambda w: w.rlike("[0-9]")), F.lit(1))
    boxed = digits_of(F.regexp_extract(t, EIN_BOXED, 1))
    routing = F.arrays_zip(_all(t, ROUTING, 1).alias("label"), _all(t, ROUTING, 2).alias("value"))
    wires = lambda r: F.lower(r["label"]).rlike("wire|domestic")
    pick = lambda keep: F.try_element_at(F.filter(routing, keep), F.lit(1)).getField("value")
    clearing = {k: _first(t, p) for k, p in CLEARING.items()}
    base = docs.select(
        "doc_id", t.alias("text"),
        F.when(F.length(found).between(15, 34), found).alias("iban"),
        F.upper(F.coalesce(_first(t, BIC_LABELLED), token)).alias("swift_bic"),
        F.coalesce(_first(t, EIN), F.when(F.length(boxed) == 9, F.concat(F.substring(boxed, 1, 2), F.lit("-"), F.substring(boxed, 3, 7)))).alias("ein"),
        F.concat(F.lit("***-**-"), F.right(_first(t, SSN), F.lit(4))).alias("ssn_masked"),
        pick(lambda r: ~wires(r)).alias("routing_aba"),
        pick(wires).alias("routing_aba_wires"),
        F.upper(F.regexp_replace(F.coalesce(*clearing.values()), r"[\s\-]", "")).alias("national_clearing"),
        F.coalesce(*(F.when(v.isNotNull(), k) for k, v in clearing.items())).alias("national_clearing_kind"),
    )
    other = lambda a: ~a.eqNullSafe(F.col("routing_aba")) & ~a.eqNullSafe(F.col("national_clearing"))
    bare = lambda a: F.transform(a, lambda x: F.regexp_replace(x, r"[\s\-]", ""))
    labelled = F.filter(bare(_all(F.col("text"), ACCOUNT)), lambda a: F.length(a).between(6, 18) & other(a))
    runs = F.filter(bare(_all(F.col("text"), LONG_RUN, 0)), lambda a: F.length(a).between(11, 18) & other(a))
    longest = F.array_max(F.transform(runs, lambda a, k: F.struct(F.length(a).alias("n"), (-k).alias("k"), a.alias("a")))).getField("a")
    return base.select("*", F.coalesce(F.try_element_at(labelled, F.lit(1)), longest).alias("account_number")).drop("text")


def routing_numbers(docs: DataFrame) -> DataFrame:
    """doc_id, nth (from 1), value, wires: all different labelled routing numbers in the order of their first printing, and whether that was for wires."""
    t = F.coalesce("text", F.lit(""))
    found = F.arrays_zip(_all(t, ROUTING, 1).alias("label"), _all(t, ROUTING, 2).alias("value"))
    first = F.filter(found, lambda x, k: F.array_position(F.transform(found, lambda y: y["value"]), x["value"]) == k + 1)
    return docs.select("doc_id", F.posexplode(first).alias("at", "r")).select(
        "doc_id", (F.col("at") + 1).alias("nth"), F.col("r.value").alias("value"), F.lower("r.label").rlike("wire|domestic").alias("wires")
    )


def long_numbers(docs: DataFrame) -> DataFrame:
    """doc_id and its longest standalone number of 11 to 18 digits, first of equals."""
    runs = F.filter(F.transform(_all(F.col("text"), LONG_RUN, 0), lambda x: F.regexp_replace(x, r"[\s\-]", "")), lambda a: F.length(a).between(11, 18))
    longest = F.array_max(F.transform(runs, lambda a, k: F.struct(F.length(a).alias("n"), (-k).alias("k"), a.alias("a")))).getField("a")
    return docs.where(F.col("text").rlike(r"[0-9][0-9 \-]{9}")).select("doc_id", longest.alias("number")).where("number IS NOT NULL")


def valid_ibans(docs: DataFrame) -> DataFrame:
    """doc_id, iban: shaped runs with a valid checksum, whole and, as they may have swallowed words, cut to their country's length.

    Full-width digits and letters count as plain ones.
    """
    wide = F.translate(F.coalesce("text", F.lit("")), "".join(chr(0xFEE0 + ord(c)) for c in PLAIN), PLAIN)
    # fixed value: what an IBAN looks like, blanks and all
    shaped = _all(F.upper(wide), r"\b([A-Z]{2}\s?[0-9]{2}(?:\s?[A-Z0-9]){10,32})\b")
    clean = F.transform(shaped, lambda x: F.regexp_replace(x, r"\s", ""))
    cut = lambda x: F.substr(x, F.lit(1), F.coalesce(lookup(IBAN_LENGTH, F.substring(x, 1, 2)), F.length(x)))
    fit = F.flatten(F.transform(clean, lambda x: F.array(F.when(iban_mod97_ok(cut(x)), cut(x)), F.when(iban_mod97_ok(x), x))))
    return docs.select("doc_id", F.explode(F.array_distinct(F.array_compact(fit))).alias("iban"))


def boxed_tin(docs: DataFrame, within: int = 800) -> DataFrame:
    """A tax number printed one digit a line, and its kind by the nearer label in the `within` characters before."""
    t = F.coalesce("text", F.lit(""))
    run = F.regexp_extract(t, BOXED, 0)
    at = F.instr(t, run)
    before = F.lower(F.substr(t, F.greatest(F.lit(1), at - within), F.least(F.lit(within), at - 1)))
    back = F.reverse(before)
    ei, ss = F.instr(back, F.lit("employer identification"[::-1])), F.instr(back, F.lit("social security"[::-1]))
    far = lambda p: F.when(p > 0, p).otherwise(100_000)
    d = digits_of(run)
    kind = F.when(far(ei) < far(ss), "EIN").when(far(ss) < far(ei), "SSN").otherwise("")
    return docs.select("doc_id", F.when(F.length(d) == 9, d).otherwise("").alias("tin_boxed"), F.when(F.length(d) == 9, kind).otherwise("").alias("tin_boxed_type"))


def inventory(docs: DataFrame, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """doc_id, family, label, value: everything labelled; each once, but every printing of an account."""
    parts = []
    for name in families:
        pattern, every = FAMILIES[name]
        hits = F.arrays_zip(_all(F.col("text"), pattern, 1).alias("label"), _all(F.col("text"), pattern, 2).alias("value"))
        part = docs.where(F.col("text").rlike(pattern)).select("doc_id", F.lit(name).alias("family"), F.inline(hits)).where("length(value) >= 4")
        parts.append(part if every else part.distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_accounts(found: DataFrame, fields: DataFrame) -> DataFrame:
    """Whether a document prints different accounts (leading zeros and the IBAN's own tail aside), and how often its own one."""
    bare = found.where("family = 'account'").select("doc_id", F.regexp_replace(digits_of(F.col("value")), "^0+", "").alias("a")).where("a <> ''")
    own = F.regexp_replace(digits_of(F.col("account_number")), "^0+", "")
    both = bare.join(fields.select("doc_id", own.alias("own"), digits_of(F.col("iban")).alias("tail")), "doc_id")
    kept = both.where(~F.col("tail").endswith(F.col("a")) | (F.col("a") == F.col("own")))
    return kept.groupBy("doc_id").agg((F.count_distinct("a") >= 2).alias("distinct_accounts"), F.count_if(F.col("a") == F.col("own")).alias("corroborated_n"))


def invoice_evidence(text: Column) -> Column:
    """Invoice marks on lines that don't speak of remittances."""
    lines = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: ~_any(x, REMITTANCE))
    return F.aggregate(lines, F.lit(0), lambda n, x: n + _count(x, INVOICE_MARKS))


def page_flags(pages: DataFrame) -> DataFrame:
    """pages with bank_letter, invoice and w9_form."""
    low = F.lower(F.coalesce("text", F.lit("")))
    letter = (_count(low, LETTER_PHRASES) >= 2) | _any(low, STRONG_LETTER)
    invoice = F.coalesce("text", F.lit("")).rlike(INVOICE_HEADER) | (invoice_evidence(F.col("text")) >= 2)
    return pages.withColumns({"bank_letter": letter, "invoice": invoice, "w9_form": _any(low, TAX_FORM_MARKS)})


def page_scores(pages: DataFrame, doc_class: str = "bank") -> DataFrame:
    """doc_id, page_no, score: words of the class, identifiers (three each), letters and invoices or, for tax forms, a boxed number (five); 0 for a blank page."""
    low = F.lower(F.coalesce("text", F.lit("")))
    words = _count(low, BANK_WORDS if doc_class == "bank" else TAX_WORDS)
    flagged = page_flags(pages).select("doc_id", "page_no", "text", "bank_letter", "invoice")
    got = beside(flagged, identifiers)
    n = sum((F.col(c).isNotNull().cast("int") for c in got.columns if c not in flagged.columns), F.lit(0))
    extra = F.when(F.col("bank_letter"), 8).when(F.col("invoice"), -2).otherwise(0)
    if doc_class != "bank":
        got, extra = beside(got, boxed_tin), F.when(F.col("tin_boxed") != "", 5).otherwise(0)
    return got.select("doc_id", "page_no", F.when(blank(F.col("text")), 0).otherwise(words + 3 * n + extra).alias("score"))


def select_pages(scored: DataFrame, k: int = 2) -> DataFrame:
    """The k best pages of each document, ties to the lower page; the first pages where nothing scores."""
    doc = Window.partitionBy("doc_id")
    best = F.max("score").over(doc)
    order = doc.orderBy(F.when(F.col("best") <= 0, 0).otherwise(-F.col("score")), "page_no")
    return scored.withColumn("best", best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "page_no", "rank")


def packet_type(flagged: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """doc_id, doc_type, pages: a letter page beats an invoice page; an invoice page without one makes an invoice.

    With read (doc_id, doc_type, hint of a reader and of the text): also reason, and the
    type after what was read: letters beat an invoice reading, invoice pages any other
    reading, and an invoice hint too.
    """
    if read is not None:
        pages = packet_type(flagged).withColumnRenamed("doc_type", "shown")
        both = read.join(pages, "doc_id", "left")
        letter = (F.col("shown") == "bank_letter") & (F.col("doc_type") == "invoice")
        bill = (F.col("shown") == "invoice") & (F.col("doc_type") != "invoice")
        hinted = (F.col("hint") == "invoice") & (F.col("doc_type") != "invoice") & ~F.coalesce(F.col("shown") == "bank_letter", F.lit(False))
        reason = F.when(letter, "a letter page").when(bill, "an invoice page and no letter").when(hinted, "the text says invoice").otherwise("")
        return both.select("doc_id", F.when(letter, "bank_letter").when(bill | hinted, "invoice").otherwise(F.col("doc_type")).alias("doc_type"), reason.alias("reason"))
    per = flagged.groupBy("doc_id").agg(F.bool_or("bank_letter").alias("letter"), F.bool_or("invoice").alias("invoice"), F.count("*").alias("pages"))
    return per.select("doc_id", F.when(F.col("letter"), "bank_letter").when(F.col("invoice"), "invoice").otherwise("").alias("doc_type"), "pages")


# Files that can be edited, mail files, names and marks of tax forms.
EDITABLE = ("doc", "docx", "xls", "xlsx", "odt", "rtf")
MAIL = ("eml", "msg")
TAX_NAME = r"(?i)\bw[-_ ]?(9|8(ben)?)\b"
TAX_SNIFF = (
    "form w-9", "request for taxpayer", "taxpayer identification number", "w-8ben", "w-8ben-e", "certificate of foreign status",
    "substitute w-9", "substitute form w-9",
)
# The phrases of the type cascade, in order; a document has the first type whose phrases it holds.
TAX_TYPES = (("w9", ("w-9", "w9", "request for taxpayer identification")), ("w8", ("w-8", "w8ben", "w-8ben", "w8-ben", "certificate of foreign status")))
INVOICE_NAMES = ("invoice", "rechnung", "fattura")
BANK_TYPES = (
    ("voided_check", (("voided check", "void check"),)),
    ("bank_statement", (("account statement", "e-statement", "estatement", "statement period", "statement of account", "kontoauszug", "extracto bancario", "estado de cuenta"),)),
    ("bank_letter", (("certificación bancaria", "certificacion bancaria", "bankbestätigung", "bank confirmation", "bank letter", "开户许可证", "开户银行"),)),
    ("supplier_letterhead", (("dear vendor", "dear customer"), ("bank",))),
    ("ap_document", (("bank account information",), ("for sap", "s/4hana", "sap registration"))),
    ("payment_instructions", (INSTRUCTION_MARKS,)),
)


def printed_email(text: Column, within: int = 2000) -> Column:
    """Three of the four header lines of a mail in the first characters."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, within))
    return sum((head.rlike(rf"(?m)^\s*{h}:\s?\S").cast("int") for h in ("from", "sent", "to", "subject")), F.lit(0)) >= 3


def doc_class(name: Column, text: Column) -> Column:
    """w9 where the file's name or the text says tax form, else bank."""
    return F.when(F.coalesce(name, F.lit("")).rlike(TAX_NAME) | _any(F.lower(F.coalesce(text, F.lit(""))), TAX_SNIFF), "w9").otherwise("bank")


def type_hint(text: Column, name: Column, ext: Column | None = None, kind: Column | None = None, within: int = 4000) -> Column:
    """What a document calls itself; '' where it doesn't say. Phrases are sought in the name and the first `within` characters.

    First the kind of file, then (for class w9) the tax forms, or a printed mail, an
    invoice by name or by its own marks, and the phrases of the bank types in order.
    """
    ext = F.lower(F.coalesce(F.lit("") if ext is None else ext, F.lit("")))
    kind = F.lit("bank") if kind is None else kind
    text, name = F.coalesce(text, F.lit("")), F.lower(F.coalesce(name, F.lit("")))
    low = F.concat_ws(" ", name, F.lower(F.substring(text, 1, within)))
    lower_text = F.lower(text)
    letter = (_count(lower_text, LETTER_PHRASES) >= 2) | _any(lower_text, STRONG_LETTER)
    tax = F.coalesce(*(F.when(_any(low, words), t) for t, words in TAX_TYPES), F.lit(""))
    out = (
        F.when(ext.isin(*EDITABLE), "editable_source").when(ext.isin(*MAIL), "email").when(kind == "w9", tax).when(printed_email(text), "email")
        .when(_any(name, INVOICE_NAMES), "invoice").when((text.rlike(INVOICE_HEADER) | (invoice_evidence(text) >= 2)) & ~letter, "invoice")
    )
    for t, groups in BANK_TYPES:
        every = F.lit(True)
        for words in groups:
            every = every & _any(low, words)
        out = out.when(every, t)
    return out.otherwise("")


def text_quality(docs: DataFrame) -> DataFrame:
    """doc_id, words (runs of two letters or more), usable (15 or more), garbage.

    garbage: a text layer that is there but can't be read: 15 % or more control or
    private-use characters, or 200 Latin letters or more of which under a quarter stand in words.
    """
    t, n = F.coalesce("text", F.lit("")), F.length("text")
    strange = r"[\p{Cc}\p{Co}&&[^\t\n\r]]"
    counted = docs.select("doc_id", t.alias("text"), F.regexp_count(t, F.lit("[A-Za-zÀ-ÿ]{2,}")).cast("long").alias("words"))
    odd = F.when(F.col("text").rlike(strange), F.regexp_count("text", F.lit(strange)) >= 0.15 * n).otherwise(False)
    # a text with letters standing alone has three of them for each letter in a word, and something between each two,
    # so where words make up a twelfth of the text or more nothing needs to be counted
    latin = F.length(F.regexp_replace("text", "[^A-Za-zÀ-ÿ]", ""))
    in_words = F.length(F.regexp_replace("text", "(?<![A-Za-zÀ-ÿ])[A-Za-zÀ-ÿ](?![A-Za-zÀ-ÿ])|[^A-Za-zÀ-ÿ]", ""))
    torn = F.when(12 * F.col("words") > n, False).otherwise((latin >= 200) & (in_words < 0.25 * latin))
    return counted.select("doc_id", "words", (F.col("words") >= 15).alias("usable"), ((F.trim("text") != "") & (odd | torn)).alias("garbage"))


def officer_block(docs: DataFrame) -> DataFrame:
    """doc_id, found: a sign-off on its own line, then among the next six filled of eleven lines a person, a title and a contact."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    person = lambda x: F.trim(x).rlike(r"^\p{Lu}\S*(?:\s+\p{Lu}\S*){1,3}$") & ~x.rlike("[0-9]") & ~x.rlike(ORGANISATION)
    after = lambda k: F.slice(F.filter(F.slice(lines, k + 2, 11), lambda x: F.trim(x) != ""), 1, 6)
    signed = F.transform(lines, lambda x, k: F.when(x.rlike(SIGN_OFF), k))
    ok = lambda k: F.exists(after(k), person) & F.exists(after(k), lambda x: x.rlike(TITLE)) & F.exists(after(k), lambda x: x.rlike(CONTACT))
    return docs.select("doc_id", F.exists(F.array_compact(signed), ok).alias("found"))


def bank_identity(text: Column, bic: Column) -> Column:
    """A BIC, a bank word of East Asia, or a name with a bank word in capitals.

    Such a name is one word that holds more than the bank word, or the bank word beside
    a capitalised word of its line, or before one that a connective joins to it.
    """
    t = F.coalesce(text, F.lit(""))
    inside, word, gap = r"[\p{L}\p{N}_&.'\-]", f"(?iu:{'|'.join(BANK_TOKENS)})", r"[^\S\n]+"
    begin = rf"(?<!{inside})(?=\p{{Lu}})"
    alone = rf"{begin}{word}(?!{inside})"
    fused = rf"{begin}(?!{word}(?!{inside})){inside}*{word}"
    beside = rf"(?:(?<!\S)\p{{Lu}}\S*{gap}[^\s\p{{L}}\p{{N}}]*{alone})|(?:{alone}\S*{gap}(?:(?i:{'|'.join(CONNECTIVES)}){gap})?\p{{Lu}})"
    return ~blank(bic) | t.rlike("银行|銀行") | t.rlike(f"{fused}|{beside}")


def doctype_evidence(docs: DataFrame) -> DataFrame:
    """Six components that tell kinds of bank papers apart, and whether the four that make a letter are all there."""
    low = F.lower(F.coalesce("text", F.lit("")))
    letter = _any(low, LETTER_PHRASES)
    identity = bank_identity(F.col("text"), F.col("swift_bic"))
    facts = ~(blank(F.col("iban")) & blank(F.col("account_number")) & blank(F.col("routing_aba")))
    holder = _any(low, HOLDER_LABELS) | low.rlike(rf"(?m)^\s*(?:{_either(GREETINGS)})")
    return docs.select(
        "doc_id", letter.alias("letter_shape"), identity.alias("bank_identity"), facts.alias("account_facts"), holder.alias("holder_signal"),
        _any(low, INSTRUCTION_MARKS).alias("payment_marks"), _any(low, STATEMENT_MARKS).alias("statement_marks"),
        (letter & identity & facts & holder).alias("strong"),
    )


def settlement_issuer(docs: DataFrame) -> DataFrame:
    """For payment instructions: a bank's identity with an officer block or a held account."""
    held = F.lower(F.coalesce("text", F.lit(""))).rlike("holds an account|account (?:is )?(?:held|maintained)")
    only = docs.where("doc_type = 'payment_instructions'")
    return only.join(officer_block(only), "doc_id").select("doc_id", (bank_identity(F.col("text"), F.col("swift_bic")) & (F.col("found") | held)).alias("strong"))


def text_vote(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(_any(low, ESIGN), "esign").when(_any(low, TYPED), "typed-system").otherwise("none")


def signature_fold(votes: DataFrame) -> DataFrame:
    """One row a document from its votes: more positives sign, a tie does not, both kinds contest, errors alone settle nothing."""
    yes, no = F.count_if(F.col("vote").startswith("pos")), F.count_if(F.col("vote") == "neg")
    per = votes.groupBy("doc_id").agg(yes.alias("yes"), no.alias("no"), F.max(F.when(F.col("vote").startswith("pos"), F.substring("vote", 5, 10))).alias("kind"))
    return per.select(
        "doc_id", (F.col("yes") > F.col("no")).alias("signed"),
        F.when((F.col("yes") == 0) & (F.col("no") == 0), "unverified").when(F.col("yes") > F.col("no"), F.col("kind")).otherwise("none").alias("signature_kind"),
        ((F.col("yes") > 0) & (F.col("no") > 0)).alias("contested"),
    )


# ---- two readings


def crosscheck(readings: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """doc_id, field, value, status: what the text shows against what a model read.

    Equal ids and zero-padded accounts are confirmed, a blank reading is filled, others are a mismatch.
    """
    rows = []
    for name, (det, model) in fields.items():
        d, m = norm_id(F.col(det)), norm_id(F.col(model))
        padded = (F.regexp_replace(d, "^0+", "") == F.regexp_replace(m, "^0+", "")) if name == "account_number" else F.lit(False)
        status = (
            F.when((d == "") & (m == ""), None).when(d == "", "model-only").when(m == "", "filled").when(d == m, "confirmed")
            .when(padded, "confirmed-padded").otherwise("MISMATCH")
        )
        rows.append(F.struct(F.lit(name).alias("field"), F.when(m == "", d).otherwise(m).alias("value"), status.alias("status")))
    return readings.select("doc_id", F.inline(F.array(*rows))).where("status IS NOT NULL")


def engine_compare(readings: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """doc_id, field, agree (null where one side is blank), only."""
    rows = []
    for name, (det, model) in fields.items():
        d, m = norm_id(F.col(det)), norm_id(F.col(model))
        rows.append(
            F.struct(
                F.lit(name).alias("field"), F.when((d != "") & (m != ""), d == m).alias("agree"),
                F.when((d != "") & (m == ""), "text").when((d == "") & (m != ""), "model").otherwise("").alias("only"),
            )
        )
    return readings.select("doc_id", F.inline(F.array(*rows)))


def merge_tiers(first: Column, second: Column, flag: bool = False) -> Column:
    """A second reading fills gaps and wins, but never blanks; of flags the second counts as it is."""
    if flag:
        return F.lower(text_of(second)).isin("true", "yes")
    return F.when(blank(second), text_of(first)).otherwise(text_of(second))


def merge_note(field: str, kind: str | None, first: Column, second: Column, policy: str = "masked", flag: bool = False) -> Column:
    """What two readings say differently, with sensitive values as `policy` shows them; null where they agree or one says nothing."""
    if flag:
        a, b = (F.lower(text_of(c)).isin("true", "yes") for c in (first, second))
        return F.when(a != b, F.concat(F.lit(f"the readings of {field} differ: "), a.cast("string"), F.lit(", then "), b.cast("string")))
    a, b = text_of(first), text_of(second)
    shown = (lambda c: display_value(F.lit(kind), c, policy)) if kind else (lambda c: c)
    return F.when((a != "") & (b != "") & (F.lower(a) != F.lower(b)), F.concat(F.lit(f"the readings of {field} differ: "), shown(a), F.lit(", then "), shown(b)))


def escalation_reasons(docs: DataFrame) -> DataFrame:
    """doc_id, reason: why a stronger reading might help.

    Columns that docs lacks count as empty: doc_class, doc_type and the fields; asked (for
    quality), retried (the first answer was no JSON), mismatch (the readings differ).
    """
    get = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    yes = lambda c: F.lower(text_of(get(c))).isin("true", "yes")
    empty = lambda c: blank(get(c))
    kind, said = text_of(get("doc_type")), F.lower(F.coalesce(get("text"), F.lit("")))
    bank = (get("doc_class") == "bank") & ~kind.isin("invoice", "email", "editable_source")
    american = (to_iso2(get("bank_country")) == "US") | said.rlike(r"\b(aba|routing)\b")
    w9, w8 = (get("doc_class") == "w9") & (kind == "w9"), (get("doc_class") == "w9") & (kind == "w8")
    # fixed values: the names of the reasons
    cases = {
        "quality-requested": yes("asked"), "json-retry": yes("retried"), "us-bank-no-routing": bank & american & empty("routing_aba"),
        "bank-no-account-id": bank & empty("account_number") & empty("iban"), "bank-no-holder": bank & empty("account_holder"),
        "bank-no-bank-name": bank & empty("bank_name"), "bank-type-unclear": bank & kind.isin("", "other"), "w9-no-tin": w9 & empty("tin_raw"),
        "w9-no-classification": w9 & empty("line3_classification"), "w9-no-line1": w9 & empty("line1_name"), "w8-no-name": w8 & empty("legal_name"),
        "w8-no-country": w8 & empty("country_incorporation"), "crosscheck-mismatch": yes("mismatch"),
    }
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*(F.when(c, r) for r, c in cases.items())))).alias("reason"))


def provenance(values: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, field, source, page of every filled value: where it came from ('model' unless it says), and the page that prints it, if one does."""
    filled = values.where(~blank(F.col("value")))
    source = F.coalesce(F.nullif(text_of(F.col("source")), F.lit("")), F.lit("model")) if "source" in values.columns else F.lit("model")
    return filled.select("doc_id", "field", source.alias("source")).join(attribute_pages(filled, pages), ["doc_id", "field"], "left")


def line_above(docs: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, field, line_no, above: each line that prints a field's value, and the line before it, which often says what it is."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    above = lines.withColumn("above", F.lag("line", 1, "").over(Window.partitionBy("doc_id").orderBy("line_no")))
    held = values.where(~blank(F.col("value"))).select("doc_id", "field", "value")
    return above.join(held, "doc_id").where(F.contains(F.lower("line"), F.lower("value"))).select("doc_id", "field", "line_no", "above")


def attribute_pages(values: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, field, page (1-based): the first page that prints the value, else the first that prints its digits."""
    both = values.where(~blank(F.col("value"))).join(pages.select("doc_id", "page_no", "text"), "doc_id")
    exact = F.contains(F.lower("text"), F.lower("value"))
    loose = (F.length(digits_of(F.col("value"))) >= 4) & F.contains(norm_id(F.col("text")), norm_id(F.col("value")))
    per = both.groupBy("doc_id", "field").agg(F.min(F.when(exact, F.col("page_no"))).alias("e"), F.min(F.when(loose, F.col("page_no"))).alias("l"))
    return per.select("doc_id", "field", (F.coalesce("e", "l") + 1).alias("page")).where("page IS NOT NULL")


def corroborate(values: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, field, n_pages: ids of six characters or more that two pages of different kinds print."""
    kind = F.when(F.col("bank_letter"), "letter").when(F.col("w9_form"), "tax").when(F.col("invoice"), "invoice").otherwise("plain")
    flagged = page_flags(pages).select("doc_id", kind.alias("kind"), norm_id(F.col("text")).alias("t"))
    hits = values.where(F.length(norm_id(F.col("value"))) >= 6).join(flagged, "doc_id").where(F.contains("t", norm_id(F.col("value"))))
    return (
        hits.groupBy("doc_id", "field").agg(F.count("*").alias("n_pages"), F.count_distinct("kind").alias("kinds"))
        .where("n_pages >= 2 AND kinds >= 2").select("doc_id", "field", "n_pages")
    )
