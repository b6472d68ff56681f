"""One verdict from all findings: rules, ERP comparison, engines, evidence, confidence and what operators decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchlake.functions.columns import verdict_of, verdict_rank

#: A finding of any source. Sources may lack columns; what they lack is null.
FINDING = {"doc_id": "bigint", "source": "string", "rule_id": "string", "severity": "string", "verdict_effect": "string", "message": "string"}


def union_findings(**sources: DataFrame) -> DataFrame:
    """The findings of all sources, each under its name. Any table with a doc_id and a rule_id will do."""
    parts = [df.withColumn("source", F.lit(name)).select(*(F.col(c).cast(t).alias(c) if c in (*df.columns, "source") else F.lit(None).cast(t).alias(c) for c, t in FINDING.items())) for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def engine_findings(compared: DataFrame) -> DataFrame:
    """ENGINE-002 where two engines disagree on a field, ENGINE-003 where all that both read agrees; neither has an effect."""
    per = compared.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(~F.col("agree"), F.col("field")))).alias("differ"), F.count("*").alias("n"))
    odd = F.size("differ") > 0
    return per.select(
        "doc_id", F.when(odd, "ENGINE-002").otherwise("ENGINE-003").alias("rule_id"), F.when(odd, "WARNING").otherwise("NOTE").alias("severity"),
        F.when(odd, F.concat(F.lit("The engines differ on "), F.array_join("differ", ", "))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" fields compared, none differs"))).alias("message"),
    )


def decide(docs: DataFrame, findings: DataFrame, levels: DataFrame | None = None, precedents: DataFrame | None = None) -> DataFrame:
    """doc_id, model_verdict, verdict, added: the strictest effect of all findings, then confidence, then the operator.

    A document that would be accepted on a reading of low confidence is held (CONF-001).
    precedents (doc_id, verdict_gold, confirmed, one row a document) may tighten freely and
    relax only if confirmed: OPERATOR-1 where they changed the verdict, OPERATOR-2 where
    they were not allowed to. A document whose comparison was asked for and failed should
    come with a SAP-014 finding among the others.
    """
    worst = findings.groupBy("doc_id").agg(F.max(verdict_rank(F.col("verdict_effect"))).alias("rank"))
    out = docs.select("doc_id").join(worst, "doc_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    low = F.lit(False)
    if levels is not None:
        out, low = out.join(levels.select("doc_id", "level"), "doc_id", "left"), F.coalesce(F.col("level") == "low", F.lit(False))
    doubted = low & (F.col("rank") == 0)
    out = out.select("doc_id", F.when(doubted, 2).otherwise(F.col("rank")).alias("rank"), F.when(doubted, "CONF-001").alias("conf"))
    gold, confirmed = F.lit(None).cast("string"), F.lit(False)
    if precedents is not None:
        out = out.join(precedents.select("doc_id", "verdict_gold", "confirmed"), "doc_id", "left")
        gold, confirmed = F.col("verdict_gold"), F.coalesce("confirmed", F.lit(False))
    differs = gold.isNotNull() & (verdict_rank(gold) != F.col("rank"))
    held = differs & (verdict_rank(gold) < F.col("rank")) & ~confirmed
    return out.select(
        "doc_id", verdict_of(F.col("rank")).alias("model_verdict"), F.when(differs & ~held, gold).otherwise(verdict_of(F.col("rank"))).alias("verdict"),
        F.array_compact(F.array("conf", F.when(held, "OPERATOR-2").when(differs, "OPERATOR-1"))).alias("added"),
    )
