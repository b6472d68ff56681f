"""Identifiers, pages, evidence, readings and privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlake.functions.columns import IBAN_LENGTH, fake_preserve_shape
from vouchlake.operators import extract as X
from vouchlake.operators import privacy as P
from vouchlake.queries.registry import mod97, query

_ROUTING = r"(?i)((?:bank\s+)?(?:routing|aba|ach|rtn|wire[s]?)(?:[ /]*(?:aba|routing|number|no\.?|#))?[^0-9]{0,28})([0-9]{9})\b"
_ACCOUNT = r"(?i)(?:acc(?:oun)?t|cuenta|konto(?:nummer)?|compte|conta)[^0-9]{0,14}([0-9][0-9 \-]{5,20}[0-9])"


@query(
    "extract_identifiers",
    "vendor_text",
    sql=rf"""SELECT doc_id, nullif(regexp_extract(text, '\b([A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]){{10,30}})\b', 1), '') AS iban,
  upper(nullif(regexp_extract(text, '(?i)(?:bic|swift)[^A-Z0-9]{{0,8}}([A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?)', 1), '')) AS swift_bic,
  nullif(regexp_extract(text, '{_ROUTING}', 2), '') AS routing_aba, regexp_replace(nullif(regexp_extract(text, '{_ACCOUNT}', 1), ''), '[\s\-]', '', 'g') AS account_number FROM vendor_text""",
)
def extract_identifiers(docs):
    return X.identifiers(docs).select("doc_id", "iban", "swift_bic", "routing_aba", "account_number")


@query(
    "routing_numbers",
    "vendor_text",
    sql=rf"""WITH t AS (SELECT doc_id, text || chr(10) || 'Bank ABA (domestic wires): 0' || lpad(CAST(doc_id * 7 % 100000000 AS VARCHAR), 8, '0') || chr(10) || 'ACH routing 0' || lpad(CAST(doc_id % 3 AS VARCHAR), 8, '0') || ' wire 0' || lpad(CAST(doc_id % 3 AS VARCHAR), 8, '0') AS text FROM vendor_text),
r AS (SELECT doc_id, regexp_extract_all(text, '{_ROUTING}', 1) AS l, regexp_extract_all(text, '{_ROUTING}', 2) AS v FROM t),
f AS (SELECT doc_id, l, v, list_filter(range(1, len(v) + 1), lambda k: list_position(v, v[k]) = k) AS ks FROM r),
u AS (SELECT doc_id, l, v, unnest(ks) AS k, unnest(range(1, len(ks) + 1)) AS nth FROM f)
SELECT doc_id, CAST(nth AS INTEGER) AS nth, v[k] AS value, regexp_matches(lower(l[k]), 'wire|domestic') AS wires FROM u""",
)
def routing_numbers(docs):
    k, tail = F.col("doc_id"), lambda c: F.lpad(c.cast("string"), 8, "0")
    more = F.concat(F.lit("Bank ABA (domestic wires): 0"), tail(k * 7 % 100_000_000), F.lit("\nACH routing 0"), tail(k % 3), F.lit(" wire 0"), tail(k % 3))
    return X.routing_numbers(docs.select("doc_id", F.concat_ws("\n", "text", more).alias("text")))


@query(
    "tax_page_scores",
    "intake",
    sql=rf"""WITH f AS (SELECT doc_id, text, lower(text) AS low, regexp_extract(text, '((?:[0-9-]\n){{{{9,13}}}})', 1) AS run,
  regexp_extract(text, '{X.IBAN}', 1) AS iban, regexp_extract(text, '{X.BIC_LABELLED}', 1) AS b0, len(list_filter(regexp_extract_all(text, '{X.BIC}', 1), lambda x: regexp_matches(x, '[0-9]'))) AS b1,
  regexp_extract(text, '(^|[^0-9-])([0-9]{{{{2}}}}-[0-9]{{{{7}}}})($|[^0-9-])', 2) AS ein, regexp_replace(regexp_extract(text, '{X.EIN_BOXED}', 1), '[^0-9]', '', 'g') AS boxed, regexp_extract(text, '{_ROUTING}', 2) AS routing,
  len(list_filter(list_transform(regexp_extract_all(text, '{X.ACCOUNT}', 1), lambda x: regexp_replace(x, '[\s\-]', '', 'g')), lambda x: length(x) BETWEEN 6 AND 18))
  + len(list_filter(list_transform(regexp_extract_all(text, '{X.LONG_RUN}'), lambda x: regexp_replace(x, '[\s\-]', '', 'g')), lambda x: length(x) BETWEEN 11 AND 18)) AS accounts FROM intake)
SELECT doc_id, 0 AS page_no, {" + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in X.TAX_WORDS)} + 3 * (CAST(length(replace(iban, ' ', '')) BETWEEN 15 AND 34 AS INT) + CAST(b0 <> '' OR b1 > 0 AS INT)
  + CAST(ein <> '' OR length(boxed) = 9 AS INT) + CAST(routing <> '' AS INT) + CAST(accounts > 0 AS INT)) + CASE WHEN run <> '' AND length(regexp_replace(run, '[^0-9]', '', 'g')) = 9 THEN 5 ELSE 0 END AS score FROM f""".replace("{{", "{").replace("}}", "}"),
)
def tax_page_scores(intake):
    """Each document as one page of a tax form."""
    return X.page_scores(intake.select("doc_id", F.lit(0).alias("page_no"), "text"), "w9")


@query(
    "long_number_candidates",
    "documents",
    sql=r"""WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\b[0-9][0-9 \-]{9,20}[0-9]\b'), lambda x: regexp_replace(x, '[\s\-]', '', 'g')), lambda a: length(a) BETWEEN 11 AND 18) AS a FROM documents),
m AS (SELECT doc_id, a, list_max(list_transform(a, lambda x: length(x))) AS n FROM c)
SELECT doc_id, list_filter(a, lambda x: length(x) = n)[1] AS number FROM m WHERE len(a) > 0""",
)
def long_number_candidates(docs):
    return X.long_numbers(docs)


_LENGTHS = "CASE substr(x, 1, 2) " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in IBAN_LENGTH.items()) + " ELSE length(x) END"
_CHECKED = """list_reduce(list_concat([0], list_transform(string_split(substr({0}, 5) || substr({0}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END)),
  lambda r, d: (r * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97) = 1"""


def checked(c: str) -> str:
    """DuckDB: whether the check digits of an IBAN fit, letters and all."""
    return _CHECKED.format(c)


@query(
    "valid_ibans",
    "vendor_text",
    sql=rf"""WITH c AS (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(upper(text), '\b([A-Z]{{2}}\s?[0-9]{{2}}(?:\s?[A-Z0-9]){{10,32}})\b')), '\s', '', 'g') AS x FROM vendor_text),
n AS (SELECT doc_id, x, substr(x, 1, {_LENGTHS}) AS short FROM c)
SELECT doc_id, short AS iban FROM n WHERE length(short) BETWEEN 15 AND 34 AND {_CHECKED.format('short')} UNION SELECT doc_id, x FROM n WHERE length(x) BETWEEN 15 AND 34 AND {_CHECKED.format('x')}""",
)
def valid_ibans(docs):
    return X.valid_ibans(docs)


@query(
    "email_inventory",
    "documents",
    sql=r"""SELECT DISTINCT doc_id, 'email' AS family, '' AS label, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS value FROM documents""",
)
def email_inventory(docs):
    return X.inventory(docs, ("email",))


_CONTACTS = """contacts AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'Account number: 55' || lpad(CAST(c_custkey * 7919 AS STRING), 10, '0') || chr(10) || 'Account no. 4400 ' || CAST(c_custkey + 1000 AS STRING) || chr(10)
  || CASE c_custkey % 3 WHEN 0 THEN 'Phone: +00 555 ' || lpad(CAST(c_custkey AS STRING), 6, '0') WHEN 1 THEN 'Fax 00-555-' || lpad(CAST(c_custkey AS STRING), 5, '0') ELSE 'no line' END || chr(10)
  || CASE c_custkey % 4 WHEN 0 THEN 'VAT number DE' || lpad(CAST(c_custkey AS STRING), 9, '0') WHEN 1 THEN 'EIN 00-' || lpad(CAST(c_custkey AS STRING), 7, '0') ELSE '' END || chr(10)
  || CASE c_custkey % 5 WHEN 0 THEN 'HRB ' || CAST(c_custkey + 10000 AS STRING) WHEN 1 THEN 'Company no. GB' || CAST(c_custkey + 10000 AS STRING) ELSE '' END || chr(10)
  || CASE c_custkey % 6 WHEN 0 THEN 'Sort code 00-11-' || CAST(c_custkey % 90 + 10 AS STRING) WHEN 1 THEN 'BLZ ' || CAST(c_custkey + 10000000 AS STRING) WHEN 2 THEN 'IFSC OSTB0' || CAST(c_custkey + 100000 AS STRING) ELSE '' END || chr(10)
  || 'Address: ' || CAST(c_custkey AS STRING) || ' Harbour Row, ' || c_mktsegment || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'mail u' || CAST(c_custkey AS STRING) || '@example.org or U' || CAST(c_custkey AS STRING) || '@example.org' ELSE '' END AS text
FROM customer)"""


@query(
    "identifier_inventory",
    "customer",
    sql=f"WITH {_CONTACTS}, hits AS ("
    + " UNION ALL ".join(
        f"SELECT {'' if every else 'DISTINCT '}doc_id, '{name}' AS family, label, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 1)) AS label, unnest(regexp_extract_all(text, '{p}', 2)) AS value FROM contacts)"
        for name, (p, every) in X.FAMILIES.items()
    )
    + ") SELECT * FROM hits WHERE length(value) >= 4",
)
def identifier_inventory(customer):
    """All seven families, on contact lines made of the customers."""
    texts = customer.sparkSession.sql("WITH " + _CONTACTS.replace("FROM customer", "FROM {customer}") + " SELECT * FROM contacts", customer=customer)
    return X.inventory(texts)


@query(
    "distinct_accounts",
    "vendor_text",
    sql=rf"""WITH f AS (SELECT doc_id, regexp_replace(account_number, '^0+', '') AS own, regexp_replace(iban, '[^0-9]', '', 'g') AS tail, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '{X.FAMILIES["account"][0]}', 2)), '[^0-9]', '', 'g'), '^0+', '') AS a FROM vendor_text)
SELECT doc_id, count(DISTINCT a) >= 2 AS distinct_accounts, count(*) FILTER (a = own) AS corroborated_n FROM f WHERE a <> '' AND (NOT ends_with(tail, a) OR a = own) GROUP BY 1""",
)
def distinct_accounts(docs):
    return X.distinct_accounts(X.inventory(docs, ("account",)), docs)


_PAGE_FLAGS = """f AS (SELECT *, lower(text) AS low, starts_with(text, 'To whom') AS bank_letter, starts_with(text, 'Invoice number') AS invoice FROM vendor_pages)"""


@query("page_flags", "vendor_pages", sql=f"WITH {_PAGE_FLAGS} SELECT doc_id, page_no, bank_letter, invoice, FALSE AS w9_form FROM f")
def page_flags(pages):
    return X.page_flags(pages).select("doc_id", "page_no", "bank_letter", "invoice", "w9_form")


_WORDS = " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in X.BANK_WORDS)
_SCORES = rf"""{_PAGE_FLAGS}, g AS (SELECT *, nullif(regexp_extract(text, '\b([A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]){{10,30}})\b', 1), '') AS iban,
  nullif(regexp_extract(text, '(?i)(?:bic|swift)[^A-Z0-9]{{0,8}}([A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?)', 1), '') AS bic0,
  list_filter(regexp_extract_all(text, '\b[A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?\b'), lambda x: regexp_matches(x, '[0-9]'))[1] AS bic1,
  nullif(regexp_extract(text, '{_ROUTING}', 2), '') AS routing, nullif(regexp_extract(text, '{_ACCOUNT}', 1), '') AS acct,
  list_filter(list_transform(regexp_extract_all(text, '\b[0-9][0-9 \-]{{9,20}}[0-9]\b'), lambda x: regexp_replace(x, '[\s\-]', '', 'g')), lambda a: length(a) BETWEEN 11 AND 18)[1] AS run FROM f),
s AS (SELECT doc_id, page_no, {_WORDS} + 3 * (CAST(iban IS NOT NULL AS INT) + CAST(coalesce(bic0, bic1) IS NOT NULL AS INT) + CAST(routing IS NOT NULL AS INT) + CAST(coalesce(acct, run) IS NOT NULL AS INT))
  + CASE WHEN bank_letter THEN 8 WHEN invoice THEN -2 ELSE 0 END AS score FROM g)"""


@query("page_scores", "vendor_pages", sql=f"WITH {_SCORES} SELECT doc_id, page_no, score FROM s")
def page_scores(pages):
    return X.page_scores(pages)


@query(
    "selected_pages",
    "vendor_pages",
    sql=f"""WITH {_SCORES}, b AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM s),
r AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN best <= 0 THEN 0 ELSE -score END, page_no) AS rank FROM b)
SELECT doc_id, page_no, rank FROM r WHERE rank <= 2""",
)
def selected_pages(pages):
    return X.select_pages(X.page_scores(pages))


@query(
    "packet_choice",
    "vendor_pages",
    sql="SELECT doc_id, CASE WHEN doc_type = 'invoice' THEN 'invoice' ELSE 'bank_letter' END AS doc_type, CAST(3 AS BIGINT) AS pages FROM vendor_pages GROUP BY doc_id, vendor_pages.doc_type",
)
def packet_choice(pages):
    return X.packet_type(X.page_flags(pages))


def has_sql(c: str, words) -> str:
    """DuckDB: whether c holds one of the words."""
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_LETTER = "((" + " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in X.LETTER_PHRASES) + ") >= 2 OR " + has_sql("t", X.STRONG_LETTER) + ")"
_MARKS = " + ".join(f"CAST(contains(x, '{w}') AS INT)" for w in X.INVOICE_MARKS)
def hint_sql(table: str) -> str:
    """DuckDB: CTE `hint` (doc_id, doc_class, hint) over a table with text, file_name and ext."""
    return f"""h0 AS (SELECT *, lower(text) AS t, lower(file_name) AS f, lower(file_name) || ' ' || lower(substr(text, 1, 4000)) AS low,
  CASE WHEN regexp_matches(file_name, '{X.TAX_NAME}') OR {has_sql("lower(text)", X.TAX_SNIFF)} THEN 'w9' ELSE 'bank' END AS doc_class FROM {table}),
h1 AS (SELECT *, (regexp_matches(text, '{X.INVOICE_HEADER}') OR coalesce(list_sum(list_transform(list_filter(string_split(t, chr(10)), lambda x: NOT {has_sql("x", X.REMITTANCE)}), lambda x: {_MARKS})), 0) >= 2) AS bill,
  {" + ".join(f"CAST(regexp_matches(substr(t, 1, 2000), '(?m)^[ ]*{h}: ?[^ ]') AS INT)" for h in ("from", "sent", "to", "subject"))} AS head FROM h0),
hint AS (SELECT doc_id, doc_class, CASE WHEN ext IN {X.EDITABLE} THEN 'editable_source' WHEN ext IN {X.MAIL} THEN 'email'
  WHEN doc_class = 'w9' THEN CASE {" ".join(f"WHEN {has_sql('low', w)} THEN '{t}'" for t, w in X.TAX_TYPES)} ELSE '' END
  WHEN head >= 3 THEN 'email' WHEN {has_sql("f", X.INVOICE_NAMES)} THEN 'invoice' WHEN bill AND NOT {_LETTER} THEN 'invoice'
  {" ".join(f"WHEN {' AND '.join(has_sql('low', w) for w in g)} THEN '{t}'" for t, g in X.BANK_TYPES)} ELSE '' END AS hint FROM h1)"""


_HINT = hint_sql("intake")


def _hinted(intake):
    kind = X.doc_class(F.col("file_name"), F.col("text"))
    return intake.select("doc_id", kind.alias("doc_class"), X.type_hint(F.col("text"), F.col("file_name"), F.col("ext"), kind).alias("hint"))


@query("doc_type_hint", "intake", sql=f"WITH {_HINT} SELECT doc_id, hint FROM hint")
def doc_type_hint(intake):
    return _hinted(intake).select("doc_id", "hint")


@query("doc_class_sniff", "intake", sql=f"WITH {_HINT} SELECT doc_id, doc_class FROM hint")
def doc_class_sniff(intake):
    return _hinted(intake).select("doc_id", "doc_class")


_QUALITY = r"""q AS (SELECT doc_id, text, length(regexp_replace(text, '[^\p{Cc}\p{Co}]|[\t\n\r]', '', 'g')) AS strange, length(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) AS latin,
  regexp_extract_all(text, '[A-Za-zÀ-ÿ]{2,}') AS w FROM %s)
SELECT doc_id, len(w) AS words, len(w) >= 15 AS usable, trim(text) <> '' AND (strange >= 0.15 * length(text) OR (latin >= 200 AND length(array_to_string(w, '')) < 0.25 * latin)) AS garbage FROM q"""


@query("text_quality", "documents", sql="WITH " + _QUALITY % "documents")
def text_quality(docs):
    return X.text_quality(docs)


@query("text_layer_garbage", "intake", sql="WITH " + _QUALITY % "intake")
def text_layer_garbage(intake):
    return X.text_quality(intake)


@query(
    "signature_votes_from_text",
    "intake",
    sql=f"SELECT doc_id, CASE WHEN {has_sql('lower(text)', X.ESIGN)} THEN 'esign' WHEN {has_sql('lower(text)', X.TYPED)} THEN 'typed-system' ELSE 'none' END AS vote FROM intake",
)
def signature_votes_from_text(intake):
    return intake.select("doc_id", X.text_vote(F.col("text")).alias("vote"))


@query(
    "boxed_tin",
    "intake",
    sql=r"""WITH r AS (SELECT doc_id, text, regexp_extract(text, '((?:[0-9-]\n){9,13})', 1) AS run FROM intake),
d AS (SELECT *, regexp_replace(run, '[^0-9]', '', 'g') AS n, lower(substr(text, 1, instr(text, run) - 1)) AS before FROM r),
k AS (SELECT *, length(before) - length(regexp_extract(before, '^(?s)(.*)employer identification', 1)) AS e, length(before) - length(regexp_extract(before, '^(?s)(.*)social security', 1)) AS s FROM d)
SELECT doc_id, CASE WHEN length(n) = 9 AND run <> '' THEN n ELSE '' END AS tin_boxed,
  CASE WHEN length(n) = 9 AND run <> '' THEN CASE WHEN contains(before, 'employer identification') AND (NOT contains(before, 'social security') OR e < s) THEN 'EIN' WHEN contains(before, 'social security') THEN 'SSN' ELSE '' END ELSE '' END AS tin_boxed_type FROM k""",
)
def boxed_tin(intake):
    return X.boxed_tin(intake)


def officer_sql(text: str) -> str:
    """DuckDB: whether the text has a sign-off, then a person, a title and a contact among the next six filled of eleven lines."""
    lines = f"string_split({text}, chr(10))"
    after = f"list_filter({lines}[k + 1:k + 11], lambda x: trim(x) <> '')[1:6]"
    person = rf"regexp_matches(trim(x), '^\p{{Lu}}\S*(?:\s+\p{{Lu}}\S*){{1,3}}$') AND NOT regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '{X.ORGANISATION}')"
    some = lambda test: f"len(list_filter({after}, lambda x: {test})) > 0"
    held = " AND ".join([some(person), some(f"regexp_matches(x, '{X.TITLE}')"), some(f"regexp_matches(x, '{X.CONTACT}')")])
    return f"(len(list_filter(range(1, len({lines}) + 1), lambda k: regexp_matches({lines}[k], '{X.SIGN_OFF}') AND {held})) > 0)"


@query("officer_block", "vendor_text", sql=f"SELECT doc_id, {officer_sql('text')} AS found FROM vendor_text")
def officer_block(docs):
    return X.officer_block(docs)


def _holds(*words: str) -> str:
    """DuckDB: whether the text holds one of the words."""
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query(
    "doctype_evidence",
    "vendor_text",
    sql=f"""WITH e AS (SELECT doc_id, {_holds(*X.LETTER_PHRASES)} AS letter_shape,
  swift_bic <> '' OR regexp_matches(text, 'Bank of [A-Z]') AS bank_identity, iban <> '' OR account_number <> '' OR regexp_matches(text, 'Routing number [0-9]{{9}}') AS account_facts,
  {_holds(*X.HOLDER_LABELS)} OR len(list_filter(string_split(lower(text), chr(10)), lambda l: {" OR ".join(f"starts_with(ltrim(l), '{g}')" for g in X.GREETINGS)})) > 0 AS holder_signal,
  {_holds(*X.INSTRUCTION_MARKS)} AS payment_marks, {_holds(*X.STATEMENT_MARKS)} AS statement_marks FROM vendor_text)
SELECT *, letter_shape AND bank_identity AND account_facts AND holder_signal AS strong FROM e""",
)
def doctype_evidence(docs):
    return X.doctype_evidence(docs.withColumn("routing_aba", F.regexp_extract("text", r"Routing number (\d{9})", 1)))


@query(
    "settlement_issuer",
    "vendor_text",
    sql=f"""SELECT doc_id, (swift_bic <> '' OR regexp_matches(text, 'Bank of [A-Z]')) AND ({officer_sql('text')} OR regexp_matches(lower(text), 'holds an account|account (?:is )?(?:held|maintained)')) AS strong
FROM vendor_text WHERE doc_type = 'payment_instructions'""",
)
def settlement_issuer(docs):
    return X.settlement_issuer(docs)


@query(
    "signature_fold",
    "votes",
    sql="""WITH p AS (SELECT doc_id, count(*) FILTER (vote LIKE 'pos%') AS yes, count(*) FILTER (vote = 'neg') AS no, max(CASE WHEN vote LIKE 'pos%' THEN substr(vote, 5) END) AS kind FROM votes GROUP BY 1)
SELECT doc_id, yes > no AS signed, CASE WHEN yes = 0 AND no = 0 THEN 'unverified' WHEN yes > no THEN kind ELSE 'none' END AS signature_kind, yes > 0 AND no > 0 AS contested FROM p""",
)
def signature_fold(votes):
    return X.signature_fold(votes)


_READ = {"iban": ("iban_text", "iban_model"), "account_number": ("account_text", "account_model"), "swift_bic": ("swift_text", "swift_model")}
_LONG = """r AS (SELECT doc_id, 'iban' AS field, iban_text AS d, upper(iban_model) AS m FROM readings UNION ALL SELECT doc_id, 'account_number', account_text, account_model FROM readings
  UNION ALL SELECT doc_id, 'swift_bic', swift_text, swift_model FROM readings)"""


@query(
    "crosscheck",
    "readings",
    sql=f"""WITH {_LONG}, s AS (SELECT doc_id, field, CASE WHEN m = '' THEN d ELSE m END AS value, CASE WHEN d = '' AND m = '' THEN NULL WHEN d = '' THEN 'model-only' WHEN m = '' THEN 'filled'
  WHEN d = m THEN 'confirmed' WHEN field = 'account_number' AND ltrim(d, '0') = ltrim(m, '0') THEN 'confirmed-padded' ELSE 'MISMATCH' END AS status FROM r) SELECT * FROM s WHERE status IS NOT NULL""",
)
def crosscheck(readings):
    return X.crosscheck(readings, _READ)


@query(
    "engine_compare",
    "readings",
    sql=f"""WITH {_LONG} SELECT doc_id, field, CASE WHEN d <> '' AND m <> '' THEN d = m END AS agree, CASE WHEN d <> '' AND m = '' THEN 'text' WHEN d = '' AND m <> '' THEN 'model' ELSE '' END AS only FROM r""",
)
def engine_compare(readings):
    return X.engine_compare(readings, _READ)


@query(
    "merge_readings",
    "readings",
    sql="""SELECT doc_id, CASE WHEN account_model = '' THEN account_text ELSE account_model END AS account,
  CASE WHEN account_text <> '' AND account_model <> '' AND lower(account_text) <> lower(account_model)
    THEN 'the readings of account_number differ: …' || right(account_text, 4) || ', then …' || right(account_model, 4) END AS note FROM readings""",
)
def merge_readings(readings):
    first, second = F.col("account_text"), F.col("account_model")
    return readings.select("doc_id", X.merge_tiers(first, second).alias("account"), X.merge_note("account_number", "account_number", first, second).alias("note"))


_EMPTY = lambda c: f"coalesce({c}, '') = ''"
_BANK_ON = "doc_type NOT IN ('invoice', 'email', 'editable_source')"
_REASONS = f"""SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'quality-requested' END, CASE WHEN doc_id % 10 = 0 THEN 'json-retry' END,
  CASE WHEN {_BANK_ON} AND regexp_matches(lower(text), '\\b(aba|routing)\\b') THEN 'us-bank-no-routing' END, CASE WHEN {_BANK_ON} AND iban = '' AND account_number = '' THEN 'bank-no-account-id' END,
  CASE WHEN {_BANK_ON} AND account_holder = '' THEN 'bank-no-holder' END, CASE WHEN {_BANK_ON} AND bank_name = '' THEN 'bank-no-bank-name' END, CASE WHEN doc_type = 'other' THEN 'bank-type-unclear' END,
  CASE WHEN doc_id % 11 = 0 THEN 'crosscheck-mismatch' END], lambda x: x IS NOT NULL)) AS reason FROM vendor_text
UNION ALL SELECT doc_id + 10000000, unnest(list_filter([CASE WHEN doc_type = 'w9' AND tin_raw = '' THEN 'w9-no-tin' END, CASE WHEN doc_type = 'w9' AND line3_classification = '' THEN 'w9-no-classification' END,
  CASE WHEN doc_type = 'w9' AND line1_name = '' THEN 'w9-no-line1' END, CASE WHEN doc_type = 'w8' AND legal_name = '' THEN 'w8-no-name' END, CASE WHEN doc_type = 'w8' THEN 'w8-no-country' END], lambda x: x IS NOT NULL)) FROM tax"""


@query("escalation_reasons", "vendor_text", "tax", sql=_REASONS)
def escalation_reasons(docs, tax):
    """Bank documents, and tax forms under numbers of their own."""
    flags = {c: F.col("doc_id") % m == 0 for c, m in (("asked", 9), ("retried", 10), ("mismatch", 11))}
    return X.escalation_reasons(docs.withColumns(flags)).unionByName(X.escalation_reasons(tax.withColumn("doc_id", F.col("doc_id") + 10_000_000)))


@query(
    "line_above",
    "vendor_text",
    sql="""WITH l AS (SELECT doc_id, account_number, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM vendor_text),
a AS (SELECT *, lag(line, 1, '') OVER (PARTITION BY doc_id ORDER BY n) AS above FROM l)
SELECT doc_id, 'account_number' AS field, CAST(n AS INTEGER) AS line_no, above FROM a WHERE account_number <> '' AND contains(line, account_number)""",
)
def line_above(docs):
    return X.line_above(docs, _values(docs, "account_number"))


@query(
    "packet_override",
    "vendor_pages",
    "vendor",
    sql="""WITH s AS (SELECT doc_id, doc_type AS t0, CASE doc_id % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'other' ELSE doc_type END AS read, CASE WHEN doc_id % 5 = 0 THEN 'invoice' ELSE '' END AS hint FROM vendor),
r AS (SELECT doc_id, read, CASE WHEN t0 <> 'invoice' AND read = 'invoice' THEN 'a letter page' WHEN t0 = 'invoice' AND read <> 'invoice' THEN 'an invoice page and no letter' ELSE '' END AS reason FROM s)
SELECT doc_id, CASE reason WHEN 'a letter page' THEN 'bank_letter' WHEN '' THEN read ELSE 'invoice' END AS doc_type, reason FROM r""",
)
def packet_override(pages, vendor):
    k = F.col("doc_id")
    read = F.when(k % 3 == 0, "invoice").when(k % 3 == 1, "other").otherwise(F.col("doc_type"))
    return X.packet_type(X.page_flags(pages), vendor.select("doc_id", read.alias("doc_type"), F.when(k % 5 == 0, "invoice").otherwise("").alias("hint")))


@query(
    "value_provenance",
    "vendor",
    "vendor_pages",
    sql="""WITH v AS (SELECT doc_id, 'iban' AS field, iban AS value, 'ocr-regex' AS source FROM vendor UNION ALL SELECT doc_id, 'account_number', account_number, 'model' FROM vendor UNION ALL SELECT doc_id, 'doc_date', doc_date, 'model' FROM vendor),
p AS (SELECT doc_id, field, min(page_no) + 1 AS page FROM v JOIN vendor_pages USING (doc_id) WHERE value <> '' AND contains(text, value) GROUP BY 1, 2)
SELECT v.doc_id, v.field, source, page FROM v LEFT JOIN p USING (doc_id, field) WHERE value <> ''""",
)
def value_provenance(vendor, pages):
    values = _values(vendor, "iban", "account_number", "doc_date").withColumn("source", F.when(F.col("field") == "iban", "ocr-regex"))
    return X.provenance(values, pages)


def _values(vendor, *fields):
    return vendor.select("doc_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))))


@query(
    "page_attribution",
    "vendor",
    "vendor_pages",
    sql="""WITH v AS (SELECT doc_id, 'iban' AS field, iban AS value FROM vendor UNION ALL SELECT doc_id, 'account_number', account_number FROM vendor)
SELECT doc_id, field, min(page_no) + 1 AS page FROM v JOIN vendor_pages USING (doc_id) WHERE value <> '' AND contains(text, value) GROUP BY 1, 2""",
)
def page_attribution(vendor, pages):
    return X.attribute_pages(_values(vendor, "iban", "account_number"), pages)


@query(
    "corroborated_ids",
    "vendor",
    "vendor_pages",
    sql=f"""WITH {_PAGE_FLAGS}, h AS (SELECT v.doc_id, CASE WHEN f.bank_letter THEN 'letter' WHEN f.invoice THEN 'invoice' ELSE 'plain' END AS kind
  FROM vendor v JOIN f ON f.doc_id = v.doc_id AND length(v.iban) >= 6 AND contains(regexp_replace(upper(f.text), '[^A-Z0-9]', '', 'g'), v.iban))
SELECT doc_id, 'iban' AS field, count(*) AS n_pages FROM h GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT kind) >= 2""",
)
def corroborated_ids(vendor, pages):
    return X.corroborate(_values(vendor, "iban"), pages)


@query(
    "page_split",
    "documents",
    sql="""WITH p AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS page_no, unnest(string_split(text, chr(10) || chr(10))) AS page FROM documents)
SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, substr(sha256(page), 1, 16) AS run_id, page_no < 12 AS surveyed FROM p""",
)
def page_split(docs):
    """Blank lines stand for form feeds, which the table has none of."""
    paged = docs.select("doc_id", F.replace("text", F.lit("\n\n"), F.lit("\f")).alias("text"))
    return X.split_pages(paged).select("doc_id", "page_no", X.content_id(F.col("text")).alias("run_id"), "surveyed")


def _beside(text: str, pattern: str, group: int, mask: str) -> str:
    """DuckDB: the pattern's matches, each as `mask` of its group g, and after each what followed it."""
    hits = f"list_transform(list_zip(regexp_extract_all({text}, '{pattern}', 1), regexp_extract_all({text}, '{pattern}', 2), regexp_extract_all({text}, '{pattern}', 3)), lambda z: z[1] || {mask} || z[3])"
    return f"array_to_string(list_transform(list_zip(list_concat([''], {hits}), regexp_split_to_array({text}, '{pattern}')), lambda z: z[1] || z[2]), '')"


_EDGE = r"(^|[^0-9-])({})($|[^0-9-])"
_TAIL = "right(regexp_replace({}, '[^0-9]', '', 'g'), 4)"
_REDACT = [
    (_EDGE.format(r"\d{3}-\d{2}-\d{4}"), "'XXX-XX-' || " + _TAIL.format("z[2]")), (_EDGE.format(r"\d{2}-\d{7}"), "'XX-XXX' || " + _TAIL.format("z[2]")),
    (_EDGE.format(r"\d{3}[ ]\d{2}[ ]\d{4}"), "'XXX-XX-' || " + _TAIL.format("z[2]")),
    (_EDGE.format(r"(?:\d[ ]?){2}[\-–—][ ]?(?:\d[ ]?){6}\d|\d{2}[ ]\d{7}"), "'XX-XXX' || " + _TAIL.format("z[2]")),
    (r"()(\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){10,30}\b)()", "substr(z[2], 1, 2) || '**…' || right(replace(z[2], ' ', ''), 4)"),
    (P.ACCOUNT_NEAR + "()", "'…' || " + _TAIL.format("z[2]")), (r"()(\b[0-9][0-9 \-]{9,20}[0-9]\b)()", "'…' || " + _TAIL.format("z[2]")),
]


def _redacted(table: str) -> str:
    """CTEs r0 ... rn: one pattern after the other; boundary marks that two matches share call for a second pass."""
    ctes, n = [f"r0 AS (SELECT doc_id, text AS t FROM {table})"], 0
    for pattern, mask in _REDACT:
        for _ in range(2 if pattern.startswith("(^") else 1):
            ctes.append(f"r{n + 1} AS (SELECT doc_id, {_beside('t', pattern, 2, mask)} AS t FROM r{n})")
            n += 1
    return "WITH " + ",\n".join(ctes) + f" SELECT doc_id, sha256(t) AS redacted_sha256 FROM r{n}"


@query("redact_documents", "documents", sql=_redacted("documents"))
def redact_documents(docs):
    return P.redact(docs.select("doc_id", "text")).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("redacted_sha256"))


@query("redact_vendor_text", "vendor_text", sql=_redacted("vendor_text"))
def redact_vendor_text(docs):
    return P.redact(docs.select("doc_id", "text")).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("redacted_sha256"))


_SECRETS = """k AS (SELECT doc_id, unnest(['iban', 'account_number']) AS kind, unnest([iban, account_number]) AS value FROM vendor),
secrets AS (SELECT DISTINCT doc_id, kind, value, CASE kind WHEN 'iban' THEN substr(value, 1, 2) || '**…' || right(value, 4) ELSE '…' || right(value, 4) END AS masked FROM k WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4)"""


def _secrets(vendor):
    return P.secret_registry(vendor.select("doc_id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("iban", "account_number"))))))


@query("secret_registry", "vendor", sql=f"WITH {_SECRETS} SELECT doc_id, kind, value, masked FROM secrets")
def secret_registry(vendor):
    return _secrets(vendor).select("doc_id", "kind", "value", "masked")


@query(
    "known_leaks",
    "vendor",
    "vendor_text",
    sql=f"WITH {_SECRETS} SELECT DISTINCT doc_id, masked FROM secrets JOIN vendor_text USING (doc_id) WHERE contains(text, value)",
)
def known_leaks(vendor, texts):
    return P.known_leaks(texts.select("doc_id", "text"), _secrets(vendor))


@query(
    "training_candidates",
    "vendor",
    sql=f"""WITH {_SECRETS}, f AS (SELECT doc_id, kind, value, masked, (SELECT string_agg(CAST((instr('0123456789abcdef', substr(sha256('vouchlake|account_number|' || value), CAST(i AS INT), 1)) - 1) % 10 AS VARCHAR), '' ORDER BY i) FROM range(1, length(value) + 1) t(i)) AS fake FROM secrets)
SELECT doc_id, 'account_number' AS field, fake AS value FROM f WHERE kind = 'account_number' AND doc_id % 3 <> 0""",
)
def training_candidates(vendor):
    """Masked accounts come back as fakes; in every third document the mask is of another form, which has no fake."""
    known = _secrets(vendor)
    shown = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("XX-XXX"), F.right("value", F.lit(4)))).otherwise(F.col("masked"))
    return P.training_candidates(known.where("kind = 'account_number'").select("doc_id", F.col("kind").alias("field"), shown.alias("value")), known)


_G = r"(?:^|[^0-9-])({})(?:$|[^0-9-])"
_LEAKS = {
    "ssn": _G.format(r"\d{3}-\d{2}-\d{4}"), "ein": _G.format(r"\d{2}-\d{7}"), "ssn_spaced": _G.format(r"\d{3}[ ]\d{2}[ ]\d{4}"),
    "ein_spaced": _G.format(r"(?:\d[ ]?){2}[\-–—][ ]?(?:\d[ ]?){6}\d|\d{2}[ ]\d{7}"), "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "long_number": r"\b\d{11,18}\b",
}


@query(
    "leak_sweep",
    "documents",
    "conversations",
    "pages",
    sql="WITH z AS (SELECT 'documents' AS zone, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'pages', html FROM pages), h AS ("
    + " UNION ALL ".join(f"SELECT zone, '{k}' AS pattern, count(*) FILTER (regexp_matches(text, '{p}')) AS hits FROM z GROUP BY 1" for k, p in _LEAKS.items())
    + ") SELECT * FROM h WHERE hits > 0 AND (zone <> 'pages' OR pattern IN ('ssn', 'ein', 'ssn_spaced', 'ein_spaced'))",
)
def leak_sweep(docs, conversations, pages):
    """Bank values may stand in web pages, and nowhere else."""
    zone = lambda df, name, c: df.select(F.lit(name).alias("zone"), F.col(c).alias("text"))
    return P.leak_sweep(zone(docs, "documents", "text").unionByName(zone(conversations, "conversations", "text")).unionByName(zone(pages, "pages", "html")), ("documents", "conversations"))


@query(
    "fakes",
    "vendor",
    sql="""WITH h AS (SELECT doc_id, account_number AS v, sha256('vouchlake|account_number|' || account_number) AS h FROM vendor WHERE account_number <> '')
SELECT doc_id, array_to_string(list_transform(range(1, length(v) + 1), lambda k: CAST((instr('0123456789abcdef', substr(h, CAST(k AS INT), 1)) - 1) % 10 AS VARCHAR)), '') AS fake FROM h""",
)
def fakes(vendor):
    return vendor.where("account_number <> ''").select("doc_id", fake_preserve_shape(F.lit("account_number"), F.col("account_number"), "vouchlake").alias("fake"))


@query(
    "kind_conflicts",
    "tax",
    sql="""WITH v AS (SELECT doc_id, tin_raw AS value, regexp_replace(tin_raw, '[^0-9]', '', 'g') AS a, CASE WHEN doc_id % 3 = 0 THEN '77' || replace(tin_raw, '-', '') ELSE '999999999999' END AS b FROM tax WHERE tin_raw <> '')
SELECT DISTINCT doc_id, value FROM v WHERE length(a) >= 4 AND (contains(a, b) OR contains(b, a))""",
)
def kind_conflicts(tax):
    both = F.array(
        F.struct(F.lit("tin").alias("kind"), F.col("tin_raw").alias("value")),
        F.struct(F.lit("account_number").alias("kind"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("77"), F.regexp_replace("tin_raw", "-", ""))).otherwise(F.lit("999999999999")).alias("value")),
    )
    return P.kind_conflicts(tax.where("tin_raw <> ''").select("doc_id", F.inline(both)))


@query(
    "egress_guard",
    "vendor",
    sql="WITH q AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'q=' || replace(bank_name, ' ', '%20') WHEN doc_id % 3 = 0 THEN 'q=' || replace(account_number, '0', '%30') ELSE 'q=' || iban END AS query FROM vendor) SELECT doc_id, NOT ("
    + " OR ".join(f"regexp_matches(query, '{p}') OR regexp_matches(url_decode(query), '{p}')" for p in _LEAKS.values())
    + ") AS allowed FROM q",
)
def egress_guard(vendor):
    k, coded = F.col("doc_id"), F.concat(F.lit("q="), F.regexp_replace("account_number", "0", "%30"))
    asked = F.when(k % 2 == 0, F.concat(F.lit("q="), F.regexp_replace("bank_name", " ", "%20"))).when(k % 3 == 0, coded).otherwise(F.concat(F.lit("q="), "iban"))
    return P.egress_guard(vendor.select("doc_id", asked.alias("query"))).select("doc_id", "allowed")
