"""Keeping the machine and its labels in order: queues, re-scoring, traces, tags, advice, freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlake.functions import columns as C
from vouchlake.operators import evaluate as E
from vouchlake.operators import teach as T
from vouchlake.queries.evaluation import _G, _P
from vouchlake.queries.registry import query

_OK = "pred_type = gold_type AND pred_verdict = gold_verdict"
_CHANGES = f"""sides AS (SELECT doc_key, run_year, bool_and({_OK}) AS ok FROM eval_rows WHERE NOT skipped GROUP BY 1, 2),
changes AS (SELECT a.doc_key AS run_id, CASE WHEN NOT a.ok AND b.ok THEN 'regressed' WHEN NOT a.ok THEN 'unchanged_wrong' ELSE 'improved' END AS change
  FROM sides a JOIN sides b ON a.doc_key = b.doc_key AND a.run_year = 1996 AND b.run_year = 1995 WHERE NOT (a.ok AND b.ok))"""


def _changes(rows):
    year = lambda y: rows.where(F.col("run_year") == y)
    return E.eval_diff(year(1996), year(1995), "doc_key").withColumnRenamed("doc_key", "run_id")


@query(
    "review_and_training_queue",
    "runs",
    "run_labels",
    "eval_rows",
    sql=f"""WITH {_CHANGES}, s AS (
  SELECT run_id, ts, verdict, CASE verdict WHEN 'NEED_MANUAL_REVIEW' THEN 3 WHEN 'WARNING' THEN 2 ELSE 0 END + CASE WHEN escalated THEN 2 ELSE 0 END + CASE WHEN conflict THEN 2 ELSE 0 END
    + CASE WHEN tag NOT IN (SELECT tag FROM run_labels) THEN 2 ELSE 0 END AS score FROM runs WHERE run_id NOT IN (SELECT run_id FROM run_labels)
  UNION ALL SELECT run_id, ts, verdict, CASE change WHEN 'regressed' THEN 3 WHEN 'unchanged_wrong' THEN 1 ELSE 0 END FROM runs JOIN changes USING (run_id) WHERE run_id IN (SELECT run_id FROM run_labels))
SELECT run_id, score, verdict FROM s WHERE score > 0 ORDER BY score DESC, ts DESC, run_id LIMIT 2000""",
)
def review_and_training_queue(runs, labels, rows):
    """Long enough to reach labelled runs: the queue is a top-k report."""
    return T.training_queue(runs, labels, 2000, _changes(rows))


@query(
    "gold_review_queue",
    "eval_rows",
    sql=f"SELECT file_key, pred_verdict, gold_verdict FROM eval_rows WHERE NOT skipped AND NOT crash AND {_P} > {_G}",
)
def gold_review_queue(rows):
    return E.gold_review_queue(rows).select("file_key", "pred_verdict", "gold_verdict")


@query(
    "missing_documents",
    "run_labels",
    "runs",
    sql="SELECT l.run_id, r.run_id IS NULL AS skipped FROM run_labels l LEFT JOIN (SELECT DISTINCT run_id FROM runs WHERE run_id % 10 <> 0) r ON r.run_id = l.run_id",
)
def missing_documents(labels, runs):
    """Every tenth run's document is gone."""
    return T.missing_documents(labels, runs.where("run_id % 10 <> 0"), "run_id").select("run_id", "skipped")


_FIELDS = """gold AS (SELECT doc_id, 'iban' AS field, iban_text AS g, upper(iban_model) AS p FROM readings UNION ALL SELECT doc_id, 'account_number', account_text, account_model FROM readings
  UNION ALL SELECT doc_id, 'swift_bic', swift_text, swift_model FROM readings), scored AS (SELECT doc_id, field, lower(p) = lower(g) AS strict FROM gold)"""


def _sides(readings):
    names = {"iban": "iban", "account_number": "account", "swift_bic": "swift"}
    side = lambda s: readings.select("doc_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{c}_{s}").alias("value")) for f, c in names.items()))))
    return side("model"), side("text")


@query(
    "field_accuracy",
    "readings",
    sql=f"WITH {_FIELDS} SELECT 'bank.' || field AS field, round(avg(CASE WHEN strict THEN 1.0 ELSE 0 END), 3) AS strict, round(avg(CASE WHEN strict THEN 1.0 ELSE 0 END), 3) AS lenient, count(*) AS n FROM scored GROUP BY 1",
)
def field_accuracy(readings):
    return E.field_accuracy(E.score_predictions(*_sides(readings), ()).withColumn("doc_class", F.lit("bank")))


@query(
    "masked_accuracy",
    "tax",
    "vendor",
    sql="""WITH g AS (SELECT doc_id, 'tin' AS field, tin_raw <> '' AS there, lower(tin_type) AS t, '…' || right(tin_raw, 4) AS m FROM tax UNION ALL SELECT doc_id, 'iban', iban <> '', '', '…' || right(iban, 4) FROM vendor),
p AS (SELECT doc_id, field, CASE WHEN doc_id % 7 = 2 THEN NOT there ELSE there END AS there, CASE WHEN doc_id % 5 = 1 THEN 'ssn' ELSE t END AS t, CASE WHEN doc_id % 6 = 4 THEN '…0000' ELSE m END AS m FROM g WHERE doc_id % 11 <> 10),
s AS (SELECT field, CASE WHEN NOT g.there AND NOT coalesce(p.there, FALSE) THEN 1.0 WHEN g.there <> coalesce(p.there, FALSE) THEN 0.0 WHEN g.m = p.m AND (field <> 'tin' OR g.t = p.t) THEN 1.0 ELSE 0.0 END AS ok
  FROM g LEFT JOIN p USING (doc_id, field))
SELECT field, round(avg(ok), 3) AS strict, round(avg(ok), 3) AS lenient, count(*) AS n FROM s GROUP BY 1""",
)
def masked_accuracy(tax, vendor):
    """Readings as structs (present, type, masked); of some documents the type, the text or the presence is wrong, some were not read."""
    k = F.col("doc_id")
    tail = lambda c: F.concat(F.lit("…"), F.right(c, F.lit(4)))
    row = lambda df, field, c, kind: df.select("doc_id", F.lit(field).alias("field"), F.struct((F.col(c) != "").alias("present"), kind.alias("type"), tail(F.col(c)).alias("masked")).alias("value"))
    gold = row(tax, "tin", "tin_raw", F.col("tin_type")).unionByName(row(vendor, "iban", "iban", F.lit("")))
    v = F.col("value")
    read = F.struct(
        F.when(k % 7 == 2, ~v["present"]).otherwise(v["present"]).alias("present"), F.when(k % 5 == 1, "SSN").otherwise(v["type"]).alias("type"),
        F.when(k % 6 == 4, "…0000").otherwise(v["masked"]).alias("masked"),
    )
    return E.field_accuracy(E.score_predictions(gold.where(k % 11 != 10).withColumn("value", read), gold, ()))


@query(
    "holder_accuracy",
    "vendor",
    sql="""WITH s AS (SELECT account_holder AS g, CASE doc_id % 4 WHEN 0 THEN account_holder || ' GmbH' WHEN 1 THEN upper(account_holder) WHEN 2 THEN 'Somebody Else' ELSE '' END AS p FROM vendor)
SELECT 'account_holder' AS field, round(avg(CASE WHEN lower(p) = lower(g) THEN 1.0 ELSE 0 END), 3) AS strict,
  round(avg(CASE WHEN lower(p) = lower(g) OR (g <> '' AND p = g || ' GmbH') THEN 1.0 ELSE 0 END), 3) AS lenient, count(*) AS n FROM s""",
)
def holder_accuracy(vendor):
    """Names are also compared by meaning: a legal form makes no other name."""
    k, name = F.col("doc_id") % 4, F.col("account_holder")
    said = F.when(k == 0, F.concat(name, F.lit(" GmbH"))).when(k == 1, F.upper(name)).when(k == 2, "Somebody Else").otherwise("")
    one = lambda c: vendor.select("doc_id", F.lit("account_holder").alias("field"), c.alias("value"))
    return E.field_accuracy(E.score_predictions(one(said), one(name), ("account_holder",)))


@query(
    "rescore_stored",
    "readings",
    sql=f"WITH {_FIELDS} SELECT doc_id, field, strict, strict <> (doc_id % 13 = 0) AS recorded, doc_id % 13 <> 0 AS same FROM scored",
)
def rescore_stored(readings):
    """The record of every thirteenth document was altered."""
    model, text = _sides(readings)
    then = E.score_predictions(model, text, ()).select("doc_id", "field", (F.col("strict") != (F.col("doc_id") % 13 == 0)).alias("ok"))
    return E.rescore(model, text, then, ())


@query(
    "field_trace",
    "readings",
    sql="""SELECT doc_id AS run_id, 'account_number' AS field, account_text AS before, '…' || right(account_text, 4) AS corrected, account_model AS now,
  CASE WHEN length(account_model) >= 4 THEN right(account_model, 4) = right(account_text, 4) ELSE FALSE END AS ok FROM readings WHERE account_text <> ''""",
)
def field_trace(readings):
    field = F.lit("account_number").alias("field")
    known = readings.where("account_text <> ''").withColumnRenamed("doc_id", "run_id")
    masked = F.concat(F.lit("…"), F.right("account_text", F.lit(4)))
    return T.field_trace(known.select("run_id", field, F.col("account_text").alias("before"), masked.alias("corrected")), known.select("run_id", field, F.col("account_model").alias("value")))


_TAGGED = """t AS (SELECT run_id, doc_class, CASE run_id % 6 WHEN 0 THEN 'invoice' WHEN 1 THEN 'supplier_letterhead' WHEN 2 THEN 'email' WHEN 3 THEN 'w8' ELSE 'other' END AS doc_type, run_id % 4 <> 0 AS has_text, run_id % 9 = 0 AS rotated,
  run_id % 10 = 0 AS letter_page, run_id % 5 = 0 AS invoice_page, run_id % 3 = 0 AS aba, run_id % 2 = 0 AS aba_wires, run_id % 8 = 0 AS sap, run_id % 7 = 0 AS tin_boxed, run_id % 4 = 1 AS signed, run_id % 12 = 0 AS conflicted FROM runs)"""


@query(
    "scenario_tags",
    "runs",
    sql=f"""WITH {_TAGGED} SELECT run_id, list_filter([CASE WHEN NOT has_text THEN doc_class || '_image_only' END, CASE WHEN rotated THEN doc_class || '_rotated_photo' END]
  || CASE WHEN doc_class = 'bank' THEN [CASE WHEN letter_page AND invoice_page THEN 'bank_invoice_plus_letter' WHEN doc_type = 'invoice' THEN 'bank_invoice_only' END, CASE WHEN run_id % 11 = 0 THEN 'bank_typed_officer_block' END,
    CASE WHEN aba AND aba_wires THEN 'bank_multi_aba' END, CASE WHEN sap THEN 'bank_sap_compare' END, CASE WHEN doc_type = 'supplier_letterhead' THEN 'bank_supplier_letterhead' END, CASE WHEN doc_type = 'email' THEN 'bank_email_support' END]
  ELSE [CASE WHEN tin_boxed THEN 'w9_boxed_tin' END, CASE WHEN conflicted THEN 'w9_checkbox_error' END, CASE WHEN run_id % 11 = 1 THEN 'w9_line_swap' END, CASE WHEN NOT signed THEN 'w9_unsigned' END, CASE WHEN doc_type = 'w8' THEN 'w8_form' END] END,
  lambda x: x IS NOT NULL) AS tags FROM t""",
)
def scenario_tags(runs):
    k = F.col("run_id")
    kind = F.when(k % 6 == 0, "invoice").when(k % 6 == 1, "supplier_letterhead").when(k % 6 == 2, "email").when(k % 6 == 3, "w8").otherwise("other")
    flags = {"has_text": k % 4 != 0, "rotated": k % 9 == 0, "letter_page": k % 10 == 0, "invoice_page": k % 5 == 0, "aba": k % 3 == 0, "aba_wires": k % 2 == 0, "sap": k % 8 == 0, "tin_boxed": k % 7 == 0, "signed": k % 4 == 1}
    fired = F.array_compact(F.array(F.when(k % 11 == 0, "BNK-026"), F.when(k % 11 == 1, "W9-013")))
    return T.scenario_tags(runs.select("run_id", "doc_class", kind.alias("doc_type"), fired.alias("rule_ids"), (k % 12 == 0).alias("checkbox_conflict"), *(c.alias(n) for n, c in flags.items())))


@query(
    "normalised_tags",
    "conversations",
    sql=r"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ' '), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_')), lambda x: x <> '') AS w FROM conversations),
u AS (SELECT conv_id, turn, unnest(w) AS tag, unnest(range(len(w))) AS k FROM t), f AS (SELECT conv_id, turn, tag, min(k) AS k FROM u GROUP BY 1, 2, 3)
SELECT t.conv_id, t.turn, coalesce((SELECT string_agg(tag, ' ' ORDER BY k) FROM f WHERE f.conv_id = t.conv_id AND f.turn = t.turn), '') AS tags FROM t""",
)
def normalised_tags(conversations):
    """The words of a turn, each as a tag, once, in order."""
    return conversations.select("conv_id", "turn", F.array_join(C.normalise_tags(F.split("text", " ")), " ").alias("tags"))


@query(
    "duration_by_shape",
    "runs",
    sql="""WITH k AS (SELECT *, doc_class || '|' || CASE WHEN run_id % 4 <> 0 THEN 'text' ELSE 'scan' END || CASE WHEN run_id % 3 = 0 THEN '|v' ELSE '' END || CASE WHEN run_id % 101 = 0 AND run_id % 997 <> 3 THEN '|e' || (run_id % 997) ELSE '' END AS shape FROM runs),
n AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY ts DESC, run_id DESC) AS pos FROM k), m AS (SELECT shape, round(avg(duration_s) / 5) * 5 AS s FROM n WHERE pos <= 5 GROUP BY 1 HAVING count(*) >= 2)
SELECT DISTINCT k.shape AS shape_key, coalesce(s, CAST(CASE WHEN contains(k.shape, '|text') THEN 20 ELSE 90 END + CASE WHEN contains(k.shape, '|v') THEN 30 ELSE 0 END AS DOUBLE)) AS seconds FROM k LEFT JOIN m USING (shape)""",
)
def duration_by_shape(runs):
    """Shapes with an effort of their own come once, so they have no history and take the table."""
    k = F.col("run_id")
    key = C.shape_key(F.col("doc_class"), k % 4 != 0, [F.when(k % 3 == 0, "v")], F.when(k % 101 == 0, k % 997).otherwise(3))
    keyed = runs.withColumn("shape_key", key)
    return T.duration_estimate(keyed, shapes=keyed)


@query(
    "exemplar_values",
    "guarded",
    sql="SELECT DISTINCT doc_id, account_holder AS value FROM guarded WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
)
def exemplar_values(docs):
    some = lambda m: docs.where(F.col("doc_id") % m == 0).select("doc_id", F.col("account_holder").alias("value"))
    return T.exemplar_values(some(2), some(3))


@query(
    "corpus_freshness",
    "vendor_text",
    sql="""SELECT doc_id, text || CASE o WHEN 'committed' THEN ' (old)' ELSE '' END AS text, o AS only_in FROM vendor_text CROSS JOIN (VALUES ('made'), ('committed')) t(o) WHERE doc_id % 10 = 0
UNION ALL SELECT doc_id, text, 'made' FROM vendor_text WHERE doc_id % 10 = 7""",
)
def corpus_freshness(docs):
    """Every tenth committed text is old, and every tenth was never committed."""
    made = docs.select("doc_id", "text")
    k = F.col("doc_id") % 10
    return T.freshness(made, made.where(k != 7).withColumn("text", F.when(k == 0, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))))


@query(
    "recommendations",
    "eval_rows",
    "run_labels",
    sql=f"""WITH {_CHANGES}, f AS (SELECT (SELECT count(*) FROM eval_rows WHERE NOT skipped AND gold_type = 'invoice' AND pred_verdict <> 'REJECT') AS fa, (SELECT count(*) FROM changes WHERE change = 'regressed') AS reg,
  (SELECT count(*) FROM eval_rows WHERE NOT skipped AND NOT ({_OK})) AS bad, (SELECT count(*) FROM run_labels WHERE confirmed) AS labs),
a AS (SELECT unnest(list_filter([CASE WHEN fa > 0 THEN {{'level': 'bad', 'advice': 'an invoice was accepted; look at the invoice rules'}} END, CASE WHEN reg > 0 THEN {{'level': 'bad', 'advice': 'worse than before: ' || reg}} END,
  CASE WHEN bad > 0 THEN {{'level': 'warn', 'advice': 'not wholly right: ' || bad}} END, {{'level': 'bad', 'advice': 'the candidate failed its gate'}}, CASE WHEN labs < 100 THEN {{'level': 'info', 'advice': 'labels towards 100: ' || labs}} END], lambda x: x IS NOT NULL)) AS x FROM f)
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS seq, x.level AS level, x.advice AS advice FROM a""",
)
def recommendations(rows, labels):
    tried, ok = E.attempted(rows), (F.col("pred_type") == F.col("gold_type")) & (F.col("pred_verdict") == F.col("gold_verdict"))
    facts = tried.agg(F.count_if((F.col("gold_type") == "invoice") & (F.col("pred_verdict") != "REJECT")).alias("false_accept_rate"), F.count_if(~ok).alias("failures"))
    facts = facts.withColumns(
        {
            "leaks": F.lit(0), "candidate": F.lit("failed"), "queued": F.lit(0), "regressed": _changes(rows).agg(F.count_if(F.col("change") == "regressed")).scalar(),
            "labels": labels.agg(F.count_if("confirmed")).scalar(),
        }
    )
    return E.recommendations(facts)


@query(
    "same_names",
    "bank_names",
    "bank_registry",
    sql="""WITH n AS (SELECT name FROM bank_names UNION ALL SELECT name FROM bank_registry),
f AS (SELECT array_to_string(list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda t: NOT list_contains(__LEGAL__, t)), ' ') AS folded FROM n)
SELECT folded, count(*) AS n FROM f GROUP BY 1""".replace("__LEGAL__", "['" + "', '".join(C.LEGAL_TOKENS) + "']"),
)
def same_names(names, registry):
    """How many names mean the same once legal forms are left out."""
    every = names.select("name").unionByName(registry.select("name"))
    return every.groupBy(C.norm_name_lenient(F.col("name")).alias("folded")).agg(F.count("*").alias("n"))
