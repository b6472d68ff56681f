"""Guards, page ladders and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlake.functions.columns import iban_mod97_ok
from vouchlake.operators import extract as X
from vouchlake.operators import guards as G
from vouchlake.queries.extraction import _LONG, _READ, has_sql
from vouchlake.queries.registry import mod97, query


_SENTENCE = [p.replace("'", "''") for p in G.OWNER_SENTENCES]


def said_sql(text: str) -> str:
    """DuckDB: the owner that a sentence of the text names, '' without one."""
    named = (f"nullif(trim(trim(regexp_extract({text}, '{p}', 1)), '.,;:\"' || chr(39)), '')" for p in _SENTENCE)
    return f"coalesce({', '.join(named)}, '')"


@query(
    "holder_grounding",
    "guarded",
    sql=f"""WITH l AS (SELECT *, string_split(text, chr(10)) AS ls, {said_sql("text")} AS said FROM guarded),
w AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda k: account_holder <> '' AND contains(lower(ls[k]), lower(account_holder)))[1] AS k FROM l),
c AS (SELECT *, CASE WHEN k IS NULL THEN '' WHEN k = 1 THEN ls[1] ELSE ls[k - 1] || chr(10) || ls[k] END AS place FROM w),
s AS (SELECT *, account_holder <> '' AND regexp_matches(place, '{G.SIGNATORY}') AND NOT regexp_matches(place, '{G.OWNER}') AS signs, CASE WHEN length(said) BETWEEN 3 AND 70 THEN said ELSE '' END AS named FROM c)
SELECT doc_id, CASE WHEN account_holder = '' OR signs THEN named ELSE account_holder END AS account_holder, CASE WHEN signs THEN account_holder ELSE '' END AS account_signatory FROM s""",
)
def holder_grounding(docs):
    return G.ground_holder(docs)


@query(
    "statement_dates",
    "guarded",
    sql="SELECT doc_id, CASE WHEN doc_date <> '' THEN doc_date WHEN doc_type = 'bank_statement' THEN '1 Jan 2026 to 31 Jan 2026' ELSE '' END AS doc_date FROM guarded",
)
def statement_dates(docs):
    return G.statement_date(docs)


@query(
    "electronic_signatures",
    "guarded",
    sql=rf"""WITH m AS (SELECT *, NOT signed AND {has_sql("lower(text)", X.ESIGN)} AS marked FROM guarded) SELECT doc_id, signed OR marked AS signed, CASE WHEN marked THEN 'electronic' ELSE '' END AS signature_kind,
  CASE WHEN marked AND doc_date = '' THEN regexp_extract(text, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\s*\|\s*[0-9]{{1,2}}:[0-9]{{2}}', 1) ELSE doc_date END AS doc_date FROM m""",
)
def electronic_signatures(docs):
    return G.electronic_signature(docs)


def _audited(docs):
    """The guarded documents with a printed account, sometimes an Italian routing code, a printed clearing code or a known branch."""
    k = F.col("doc_id")
    text = F.concat_ws("\n", "text", F.when(k % 2 == 0, F.concat(F.lit("Account number: "), F.ltrim("account_number", F.lit("0")))))
    return docs.select(
        "doc_id", text.alias("text"), "iban", "account_number",
        F.when((k % 12 == 2) & (F.col("iban") != ""), F.substring("iban", 6, 5)).otherwise(F.col("routing_aba")).alias("routing_aba"),
        F.when(k % 6 == 1, "012-34567").otherwise("").alias("clearing_printed"), F.when(k % 18 == 1, "77").otherwise("").alias("national_clearing"),
        F.when(k % 24 == 2, "9").otherwise("").alias("branch_code"),
    )


@query(
    "id_audit",
    "guarded",
    "vendor",
    sql=f"""WITH a AS (SELECT g.doc_id, concat_ws(chr(10), text, CASE WHEN g.doc_id % 2 = 0 THEN 'Account number: ' || ltrim(g.account_number, '0') END) AS text, g.iban, g.account_number,
  CASE WHEN g.doc_id % 12 = 2 AND g.iban <> '' THEN substr(g.iban, 6, 5) ELSE g.routing_aba END AS routing, CASE WHEN g.doc_id % 6 = 1 THEN '01234567' ELSE '' END AS printed,
  CASE WHEN g.doc_id % 18 = 1 THEN '77' ELSE '' END AS clearing, CASE WHEN g.doc_id % 24 = 2 THEN '9' ELSE '' END AS branch,
  CASE WHEN {mod97("v.iban")} THEN v.iban WHEN v.iban <> '' THEN substr(v.iban, 1, length(v.iban) - 1) || CAST((CAST(right(v.iban, 1) AS INT) + 9) % 10 AS VARCHAR) END AS good
  FROM guarded g JOIN vendor v USING (doc_id)),
b AS (SELECT *, iban <> '' AND NOT regexp_matches(iban, '^[A-Z]{{2}}[0-9]{{2}}') AS stray FROM a),
c AS (SELECT *, iban <> '' AND NOT stray AND NOT {mod97("iban")} AND good IS NOT NULL AND left(good, 2) = left(iban, 2) AS repair, routing <> '' AND length(routing) <> 9 AS other FROM b),
d AS (SELECT *, other AND routing = printed AND clearing = '' AS moved, CASE WHEN stray THEN '' WHEN repair THEN good ELSE iban END AS iban2, CASE WHEN stray AND account_number = '' THEN iban ELSE account_number END AS account2 FROM c),
e AS (SELECT *, other AND NOT moved AS domestic, ltrim(account2, '0') AS bare FROM d),
f AS (SELECT *, domestic AND left(iban2, 2) = 'IT' AND length(iban2) >= 15 AS italian, iban2 <> '' AND bare <> '' AND bare <> account2 AND ends_with(iban2, account2) AND contains(text, bare) AS padded FROM e)
SELECT doc_id, iban2 AS iban, CASE WHEN padded THEN bare ELSE account2 END AS account_number, CASE WHEN other THEN '' ELSE routing END AS routing_aba,
  CASE WHEN moved THEN '012-34567' ELSE clearing END AS national_clearing, CASE WHEN italian AND branch = '' THEN substr(iban2, 11, 5) ELSE branch END AS branch_code,
  concat_ws('; ', CASE WHEN stray AND account_number = '' THEN 'account number moved out of the IBAN field' WHEN stray AND iban = account_number THEN 'IBAN field repeated the account' WHEN stray THEN 'IBAN field held no IBAN' END,
    CASE WHEN repair THEN 'IBAN taken from the text' END, CASE WHEN iban2 <> '' THEN CASE WHEN {mod97("iban2")} THEN 'check digits right' ELSE 'check digits wrong' END END,
    CASE WHEN moved THEN 'routing number is a clearing code' END,
    CASE WHEN italian THEN CASE WHEN routing IN (substr(iban2, 6, 5), substr(iban2, 11, 5)) THEN 'domestic code agrees with the IBAN' ELSE 'domestic code differs from the IBAN' END WHEN domestic THEN 'domestic code removed' END,
    CASE WHEN padded THEN 'account as printed' END) AS note FROM f""",
)
def id_audit(docs, vendor):
    # what the text prints: the IBAN before it was broken
    n = F.length("iban")
    last = ((F.substr("iban", n).try_cast("int") + 9) % 10).cast("string")
    good = F.when(iban_mod97_ok(F.col("iban")), F.col("iban")).otherwise(F.concat(F.substr("iban", F.lit(1), n - 1), last))
    return G.audit_bank_ids(_audited(docs), vendor.where("iban <> ''").select("doc_id", good.alias("iban")))


@query(
    "tin_normalise",
    "guarded",
    sql="""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE tin_raw END AS tin_raw, CASE WHEN doc_id % 2 = 0 THEN 'SSN' ELSE 'EIN' END AS tin_type,
  CASE WHEN doc_id % 3 = 0 AND sign_date = '' THEN '2026-03-04' ELSE sign_date END AS sign_date FROM guarded""",
)
def tin_normalise(docs):
    return G.normalise_tin(docs)


@query(
    "noise_filters",
    "guarded",
    sql="""WITH n AS (SELECT doc_id, bank_name, file_name, CASE WHEN doc_id % 10 = 4 THEN 'John Doe' WHEN doc_id % 10 = 7 THEN 'N/A' ELSE account_holder END AS holder,
  lower(text || CASE WHEN doc_id % 20 = 4 THEN chr(10) || 'Signed, JOHN DOE' ELSE '' END) AS low FROM guarded)
SELECT doc_id, CASE WHEN contains(lower(bank_name), 'superintendencia') THEN '' ELSE bank_name END AS bank_name,
  CASE WHEN lower(holder) IN ('john doe', 'n/a') AND NOT contains(low, lower(holder)) THEN '' WHEN length(holder) >= 4 AND contains(lower(file_name), lower(holder)) AND NOT contains(low, lower(holder)) THEN '' ELSE holder END AS account_holder FROM n""",
)
def noise_filters(docs):
    k = F.col("doc_id")
    holder = F.when(k % 10 == 4, "John Doe").when(k % 10 == 7, "N/A").otherwise(F.col("account_holder"))
    text = F.concat_ws("\n", "text", F.when(k % 20 == 4, "Signed, JOHN DOE"))
    return G.drop_noise(docs.withColumns({"account_holder": holder, "text": text}))


@query(
    "exemplar_echoes",
    "guarded",
    sql="""SELECT doc_id, 'account_holder' AS field, account_holder AS value FROM guarded WHERE account_holder <> '' AND NOT (account_holder = 'Max Mustermann' AND EXISTS (SELECT 1 FROM guarded e WHERE e.doc_id % 16 = 5 AND e.doc_id <> guarded.doc_id))""",
)
def exemplar_echoes(docs):
    values = docs.where("account_holder <> ''").select("doc_id", F.lit("account_holder").alias("field"), F.col("account_holder").alias("value"))
    taught = docs.where("doc_id % 16 = 5").select("doc_id", F.col("account_holder").alias("value"))
    return G.drop_echoes(values, taught, docs)


@query(
    "grounded_instructions",
    "guarded",
    sql=f"""WITH b AS (SELECT doc_id, doc_type, doc_id % 5 = 1 AS strong, doc_type = 'payment_instructions' AND NOT {has_sql("lower(text)", X.INSTRUCTION_MARKS)} AS bare
  FROM (SELECT doc_id, doc_type, text || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'Wire instructions below' ELSE '' END AS text FROM guarded))
SELECT doc_id, CASE WHEN bare AND strong THEN 'bank_letter' WHEN bare THEN 'other' ELSE doc_type END AS doc_type, bare AND strong AS uncertain FROM b""",
)
def grounded_instructions(docs):
    printed = docs.withColumn("text", F.concat_ws("\n", "text", F.when(F.col("doc_id") % 7 == 0, "Wire instructions below")))
    return G.ground_instructions(printed, docs.select("doc_id", (F.col("doc_id") % 5 == 1).alias("strong")))


@query(
    "form_repair",
    "guarded",
    sql="""SELECT doc_id, CASE WHEN doc_id % 9 = 2 THEN regexp_extract(text, '口座番号 ([0-9]{4,10})', 1) ELSE account_number END AS account_number, CASE WHEN doc_id % 9 = 2 THEN 'JP' ELSE bank_country END AS bank_country FROM guarded""",
)
def form_repair(docs):
    return G.repair_asian_forms(docs)


@query(
    "gaps_and_ladder",
    "vendor_pages",
    sql="""WITH b AS (SELECT doc_id, page_no, CASE WHEN (regexp_matches(text, 'IBAN: [A-Z]') OR regexp_matches(text, 'Account number: [0-9]')) THEN 3 ELSE 0 END
  + CASE WHEN starts_with(text, 'To whom') OR regexp_matches(text, '(?i)(?:bic|swift)[^A-Z0-9]{0,8}([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)') OR regexp_matches(text, '\\b[A-Z]{6}[0-9][A-Z0-9]\\b') THEN 2 ELSE 0 END AS bonus FROM vendor_pages),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bonus DESC, page_no) AS rank FROM b WHERE bonus >= 1) SELECT doc_id, page_no, rank FROM r WHERE rank <= 2""",
)
def gaps_and_ladder(pages):
    return G.ladder_pages(G.gap_bonus(pages.withColumn("gaps", F.array(F.lit("no account"), F.lit("no bank name")))))


@query(
    "w8_pages",
    "supplier",
    sql="""SELECT CAST(s_suppkey AS BIGINT) AS doc_id, p.page_no, CAST(CASE p.page_no WHEN 0 THEN 1 WHEN CASE WHEN s_suppkey % 3 = 0 THEN 4 WHEN s_suppkey % 3 = 1 THEN 3 ELSE 5 END THEN 2 ELSE 3 END AS INTEGER) AS rank
FROM supplier CROSS JOIN (VALUES (0), (1), (3), (4), (5)) p(page_no)
WHERE p.page_no = 0 OR p.page_no = CASE WHEN s_suppkey % 3 = 0 THEN 4 WHEN s_suppkey % 3 = 1 THEN 3 ELSE 5 END OR p.page_no = 1""",
)
def w8_pages(supplier):
    k = F.col("doc_id") % 3
    text = (
        F.when(F.col("page_no") == 0, "Identification of beneficial owner").when(F.col("page_no") == 1, "sign in Part XXX of this form")
        .when((F.col("page_no") == 4) & (k == 0), "Part XXX").when((F.col("page_no") == 3) & (k == 1), "Sign here").otherwise("more")
    )
    pages = supplier.select(F.col("s_suppkey").cast("long").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("page_no"))
    return G.select_w8_pages(pages.withColumn("text", text).withColumn("score", F.when(F.col("page_no") == 1, 9).otherwise(0)))


@query(
    "packet_best",
    "vendor_text",
    sql="""WITH d AS (SELECT doc_id, doc_id % 40 AS packet_id, doc_id % 11 + CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END + CASE WHEN doc_type = 'bank_letter' THEN 10 WHEN doc_type = 'invoice' THEN -3 ELSE 0 END AS points FROM vendor_text),
r AS (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY points DESC, doc_id) AS pos FROM d) SELECT packet_id, min(CASE WHEN pos = 1 THEN doc_id END) AS chosen, count(*) FILTER (pos > 1) AS skipped FROM r GROUP BY 1""",
)
def packet_best(docs):
    ext = F.element_at(F.array(F.lit("pdf"), F.lit("png"), F.lit("eml")), (F.col("doc_id") % 3 + 1).cast("int"))
    return G.best_of_packet(
        docs.select(
            "doc_id", (F.col("doc_id") % 40).alias("packet_id"), (F.col("doc_id") % 11).alias("score"), ext.alias("ext"),
            (F.col("doc_type") == "bank_letter").alias("bank_letter"), (F.col("doc_type") == "invoice").alias("invoice"),
        )
    )


@query("run_prefix", "runs", sql="SELECT run_id FROM runs WHERE (SELECT count(*) FROM runs WHERE CAST(run_id AS VARCHAR) LIKE '14999%' AND run_id >= 1000) = 1 AND CAST(run_id AS VARCHAR) LIKE '14999%' AND run_id >= 1000")
def run_prefix(runs):
    return G.resolve_prefix(runs.where("run_id >= 1000"), "14999")


@query(
    "field_confidence",
    "readings",
    sql=f"""WITH {_LONG}, s AS (SELECT doc_id, field, CASE WHEN d = '' AND m = '' THEN NULL WHEN d = '' THEN CASE doc_id % 3 WHEN 0 THEN 'agreed' WHEN 1 THEN 'check' ELSE 'model-only' END WHEN m = '' THEN 'verified' WHEN d = m OR (field = 'account_number' AND ltrim(d, '0') = ltrim(m, '0')) THEN 'verified' ELSE 'check' END AS chip FROM r)
SELECT * FROM s WHERE chip IS NOT NULL""",
)
def field_confidence(readings):
    """Of two documents in three a second engine has read the same fields, of one alike."""
    read = X.crosscheck(readings, _READ)
    return G.field_confidence(read, read.where("doc_id % 3 < 2").select("doc_id", "field", (F.col("doc_id") % 3 == 0).alias("agree")))
