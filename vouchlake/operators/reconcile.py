"""Documents against the partner and bank rows of an ERP export, and against registries. Joins on keys, never all against all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlake.functions.columns import (
    aba_checksum_ok,
    blank,
    first_diff,
    names_materially_equal,
    norm_id,
    norm_name,
    parse_bic,
    text_of,
    texts,
    to_iso2,
    tokens,
)

# Words of names that carry no meaning of their own.
STOP_WORDS = (
    "bank na n a the of and trust company co usa inc llc ltd corp corporation gmbh sa srl spa nv bv plc ag kg pte sas banco banca"
).split()


def bare(c: Column) -> Column:
    """An id without padding."""
    return F.regexp_replace(norm_id(c), "^0+", "")


def document_key(docs: DataFrame) -> Column:
    """A document's routing number, else its wire routing number, else its clearing code; '' without any."""
    known = [F.nullif(norm_id(F.col(c)), F.lit("")) for c in ("routing_aba", "routing_aba_wires", "national_clearing") if c in docs.columns]
    return F.coalesce(*known, F.lit(""))


def _score(doc_iban: Column, doc_account: Column, doc_key: Column, row_iban: Column, row_account: Column, row_key: Column) -> Column:
    """100 for the same IBAN, 40 for the same account, 40 for an IBAN that ends with it, 20 for the same bank key."""
    account = bare(row_account)
    return (
        F.when((doc_iban != "") & (doc_iban == norm_id(row_iban)), 100).otherwise(0)
        + F.when((bare(doc_account) != "") & (bare(doc_account) == account), 40).otherwise(0)
        + F.when((account != "") & doc_iban.endswith(account), 40).otherwise(0)
        + F.when((doc_key != "") & (doc_key == norm_id(row_key)), 20).otherwise(0)
    )


def select_partner_row(docs: DataFrame, erp: DataFrame) -> DataFrame:
    """docs with the best bank row of their partner, ties to the export's order.

    n_rows says how many rows the partner has; a document without any stays, with 0 and
    empty row columns. The best row is a grouped extreme, so a partner with very many rows
    or documents is folded before it is shuffled by document.
    """
    rows = erp.select(
        bare(F.col("partner")).alias("_key"), F.struct("row_idx", F.col("iban").alias("sap_iban"), F.col("bankn").alias("sap_account"), F.col("bankl").alias("sap_key"),
        F.col("banks").alias("sap_country"), F.col("koinh").alias("sap_holder")).alias("_row"),
    )
    keyed = docs.select("doc_id", bare(F.col("partner")).alias("_key"), norm_id(F.col("iban")).alias("_iban"), F.col("account_number").alias("_account"), document_key(docs).alias("_bank"))
    score = _score(F.col("_iban"), F.col("_account"), F.col("_bank"), F.col("_row.sap_iban"), F.col("_row.sap_account"), F.col("_row.sap_key"))
    best = (
        keyed.where("_key <> ''").join(rows, "_key")
        .groupBy("doc_id").agg(F.min(F.struct((-score).alias("minus"), F.col("_row.row_idx").alias("at"), F.col("_row").alias("row"))).alias("b"), F.count("*").alias("n_rows"))
        .select("doc_id", "n_rows", (-F.col("b.minus")).alias("score"), "b.row.*")
    )
    return docs.join(best, "doc_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def partner_findings(chosen: DataFrame) -> DataFrame:
    """SAP-010 for a partner without bank rows, SAP-011 where one of several was compared."""
    none = F.col("n_rows") == 0
    return chosen.where(none | (F.col("n_rows") > 1)).select(
        "doc_id", F.when(none, "SAP-010").otherwise("SAP-011").alias("rule_id"), F.when(none, "WARNING").otherwise("NOTE").alias("severity"),
        F.when(none, "WARNING").alias("verdict_effect"),
        F.when(none, "The partner has no bank rows in the export.").otherwise(F.concat(F.lit("The best of "), F.col("n_rows").cast("string"), F.lit(" bank rows was compared."))).alias("message"),
    )


def reconcile_bank(chosen: DataFrame) -> DataFrame:
    """doc_id, field, status, note: document against the chosen row, field by field."""
    di, si = norm_id(F.col("iban")), norm_id(F.col("sap_iban"))
    da, sa = norm_id(F.col("account_number")), norm_id(F.col("sap_account"))
    db, sb = F.regexp_replace(da, "^0+", ""), F.regexp_replace(sa, "^0+", "")
    in_iban = (sb != "") & di.endswith(sb)
    at = lambda a, b: F.concat(F.lit("differs from position "), first_diff(a, b).cast("string"))
    iban = F.when((di == "") & (si == ""), None).when((di != "") & (si != ""), F.when(di == si, F.struct(F.lit("match").alias("status"), F.lit("").alias("note"))).otherwise(F.struct(F.lit("MISMATCH").alias("status"), at(di, si).alias("note"))))
    iban = iban.when((di != "") & in_iban, F.struct(F.lit("match").alias("status"), F.lit("stored in parts").alias("note"))).otherwise(F.struct(F.lit("only-one-side").alias("status"), F.lit("").alias("note")))
    tail = (si != "") & (F.length(db) >= 6) & si.endswith(db)
    pair = lambda status, note="": F.struct(F.lit(status).alias("status"), (F.lit(note) if isinstance(note, str) else note).alias("note"))
    account = (
        F.when((da == "") & (sa == ""), None)
        .when((da == "") & in_iban, pair("match", "account part of the IBAN"))
        .when((da == "") | (sa == ""), pair("only-one-side"))
        .when(da == sa, pair("match"))
        .when(db == sb, pair("match", "leading zeros differ"))
        .when(tail & (sb != "") & si.endswith(sb), pair("match", "same IBAN tail"))
        .when(tail, pair("MISMATCH", "the row's account differs from its own IBAN"))
        .otherwise(pair("MISMATCH", at(db, sb)))
    )
    dc, sc = to_iso2(F.col("bank_country")), to_iso2(F.col("sap_country"))
    country = F.when((dc == "") & (sc == ""), None).when((dc == "") | (sc == ""), pair("only-one-side")).when(dc == sc, pair("match")).otherwise(pair("MISMATCH"))
    dh, sh = norm_name(F.col("account_holder")), norm_name(F.col("sap_holder"))
    holder = F.when((dh == "") & (sh == ""), None).when((dh == "") | (sh == ""), pair("only-one-side")).when(dh == sh, pair("match")).otherwise(pair("MISMATCH"))
    rows = F.array(*(F.struct(F.lit(n).alias("field"), r.alias("r")) for n, r in (("IBAN", iban), ("Bank Account", account), ("Bank Country", country), ("Account Holder", holder))))
    return chosen.select("doc_id", F.inline(F.filter(rows, lambda x: x["r"].isNotNull()))).select("doc_id", "field", "r.status", "r.note")


#: Finding, severity and effect of a field that differs, and of one that only one side has.
COMPARED = {
    "IBAN": (("SAP-001", "CRITICAL", "NEED_MANUAL_REVIEW"), ("SAP-002", "WARNING", "WARNING")),
    "Bank Account": (("SAP-003", "CRITICAL", "NEED_MANUAL_REVIEW"), None),
    "Bank Country": (("SAP-005", "CRITICAL", "NEED_MANUAL_REVIEW"), None),
    "Account Holder": (("SAP-008", "CRITICAL", "NEED_MANUAL_REVIEW"), None),
}


def comparison_findings(compared: DataFrame) -> DataFrame:
    """Findings of `reconcile_bank`: one a field that differs; SAP-000 for documents of which something was compared and nothing differs."""
    cases = [
        (name, status, found)
        for name, (differs, one_side) in COMPARED.items() for status, found in (("MISMATCH", differs), ("only-one-side", one_side)) if found
    ]
    pick = lambda k: F.coalesce(*(F.when((F.col("field") == n) & (F.col("status") == t), f[k]) for n, t, f in cases))
    message = F.concat("field", F.when(F.col("status") == "MISMATCH", ": document and export differ").otherwise(": only one side has it"))
    raised = compared.select("doc_id", pick(0).alias("rule_id"), pick(1).alias("severity"), pick(2).alias("verdict_effect"), message.alias("message")).where("rule_id IS NOT NULL")
    clean = compared.groupBy("doc_id").agg(F.count_if(F.col("status") == "MISMATCH").alias("n")).where("n = 0")
    return raised.unionByName(
        clean.select("doc_id", F.lit("SAP-000").alias("rule_id"), F.lit("NOTE").alias("severity"), F.lit(None).cast("string").alias("verdict_effect"), F.lit("No compared field differs.").alias("message"))
    )


#: Partners from which on those of a key are counted together instead of laid beside each document.
MANY_PARTNERS = 100


def _partner_hits(docs: DataFrame, erp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n) of partners counted together, and (doc_id, partner) of those that meet a document singly; none is in both."""
    d = docs.select("doc_id", norm_id(F.col("iban")).alias("i"), bare(F.col("account_number")).alias("a"))
    e = erp.select(F.col("partner"), norm_id(F.col("iban")).alias("i"), bare(F.col("bankn")).alias("a"))
    tagged = lambda k, c: F.when(c != "", F.concat(F.lit(k), c))
    tails = F.when(F.col("i") != "", F.transform(F.sequence(F.lit(1), F.length("i")), lambda k: F.substr("i", k))).otherwise(F.array())
    accounts = F.filter(F.array_distinct(F.concat(tails, F.array("a"))), lambda t: ~t.startswith("0"))
    keys = F.array_compact(F.array_append(F.transform(accounts, lambda t: tagged("a", t)), tagged("i", F.col("i"))))
    mine = d.select("doc_id", F.explode(keys).alias("key")).hint("merge")  # many times the size that Spark expects
    held = e.select("partner", F.explode(F.array_compact(F.array(tagged("a", F.col("a")), tagged("i", F.col("i"))))).alias("key")).distinct()
    hot = held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MANY_PARTNERS).select("key")
    kinds = held.join(hot, "key").groupBy("partner").agg(F.array_sort(F.collect_set("key")).alias("kind"))
    hot_keys = mine.join(hot, "key").groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("has"))
    groups = kinds.groupBy("kind").agg(F.count("*").alias("n"))
    counted = (
        hot_keys.select("has").distinct().select("has", F.explode("has").alias("key"))
        .join(groups.select("kind", "n", F.explode("kind").alias("key")), "key")
        .groupBy("has", "kind").agg(F.first("n").alias("n")).groupBy("has").agg(F.sum("n").alias("n"))
    )
    together = hot_keys.join(counted, "has").select("doc_id", "n")
    cold = held.join(hot, "key", "left_anti").alias("h").join(kinds.alias("k"), F.col("h.partner").eqNullSafe(F.col("k.partner")), "left").select("key", "h.partner", "kind")
    singly = (
        mine.join(cold, "key").join(hot_keys, "doc_id", "left").where(~F.coalesce(F.arrays_overlap("has", "kind"), F.lit(False)))
        .select("doc_id", "partner").distinct()
    )
    return together, singly


def reverse_lookup(docs: DataFrame, erp: DataFrame) -> DataFrame:
    """doc_id, partners, finding: which partners already hold the document's account.

    A row is a hit from a score of 40 on: an equal IBAN, an equal account, or an IBAN that
    ends with the row's account. Each is an equi-join; for the last, a document's IBAN is
    keyed by its tails (34 at most, none with a zero in front, as accounts have none).
    Keys of more than MANY_PARTNERS partners (a dummy account) are hot: partners are counted
    by the hot keys that they hold, documents by those that they have, and both meet as such
    groups. Partners by other keys meet documents singly, unless they are counted already.
    """
    together, singly = _partner_hits(docs, erp)
    per = together.unionByName(singly.groupBy("doc_id").agg(F.count("*").alias("n"))).groupBy("doc_id").agg(F.sum("n").alias("n"))
    return docs.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n_partners"), F.when(F.col("n") > 1, "SAP-013").otherwise("SAP-012").alias("finding")
    )


def shared_accounts(erp: DataFrame) -> DataFrame:
    """account, n_partners: accounts that two partners or more hold."""
    return erp.where(bare(F.col("bankn")) != "").groupBy(bare(F.col("bankn")).alias("account")).agg(F.count_distinct("partner").alias("n_partners")).where("n_partners > 1")


def reconcile_partner(tax: DataFrame, partners: DataFrame) -> DataFrame:
    """doc_id, finding of tax documents (column partner) against the partner's general data.

    SAP-030: none of the organisation's joined name, the full name and the person's name
    (last, first) holds, lies in, or means the form's name. SAP-031: person against
    organisation, where both sides say. SAP-032: blocked, and archived, one each. SAP-010:
    no such partner. SAP-000: found, and nothing differs.
    """
    text = lambda c: F.col(c) if c in partners.columns else F.lit("")
    org = F.trim(F.concat_ws(" ", *(F.nullif(text_of(text(c)), F.lit("")) for c in ("name_org1", "name_org2", "name_org3", "name_org4"))))
    names = F.array(org, text_of(text("full_name")), F.trim(F.concat_ws(" ", text_of(text("name_last")), text_of(text("name_first")))))
    person = F.when((norm_id(text("type")) == "1") | norm_id(text("natpers")).isin("X", "1"), True).when(norm_id(text("type")) == "2", False)
    p = partners.select(
        bare(F.col("partner")).alias("key"), F.filter(names, lambda x: x != "").alias("names"), person.alias("is_person"),
        norm_id(text("xblck")).isin("X", "1").alias("blocked"), norm_id(text("xdele")).isin("X", "1").alias("archived"), F.lit(True).alias("known"),
    )
    both = tax.withColumn("key", bare(F.col("partner"))).join(p, "key", "left")
    one = norm_name(F.col("line1_name"))
    same = F.exists("names", lambda x: F.contains(norm_name(x), one) | F.contains(one, norm_name(x)) | names_materially_equal(x, F.col("line1_name")))
    cls = F.lower(text_of(F.col("line3_classification")))
    differs = {"SAP-030": (one != "") & (F.size("names") > 0) & ~same, "SAP-031": (cls != "") & (cls.rlike("individual|sole prop") != F.col("is_person"))}
    found = F.array_compact(
        F.array(
            *(F.when(c, k) for k, c in differs.items()), F.when(F.col("blocked"), "SAP-032"), F.when(F.col("archived"), "SAP-032"),
            F.when(F.col("known") & ~F.coalesce(differs["SAP-030"], F.lit(False)) & ~F.coalesce(differs["SAP-031"], F.lit(False)), "SAP-000"),
            F.when(F.col("known").isNull(), "SAP-010"),
        )
    )
    return both.select("doc_id", F.explode(found).alias("finding"))


def meaningful(c: Column) -> Column:
    stop = texts(*STOP_WORDS)
    return F.array_distinct(F.filter(tokens(c), lambda t: ~F.array_contains(stop, t)))


#: Characters of the windows by which a longer name is sought in others.
WINDOW = 8


def _windows(c: Column, sizes: list[int]) -> Column:
    """Distinct windows of these sizes; a shorter text has none of a size."""
    some = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda k: F.substr(c, k, F.lit(n)))).otherwise(F.array())
    return F.array_distinct(F.concat(*(some(n) for n in sizes)))


def _within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(a, b) of names a that lie within names b, each from a table with one column n; each pair once.

    A name shorter than WINDOW lies within b if it is one of b's windows: an equi-join that
    pairs nothing in vain. Of a longer name the window that the fewest outer names have is
    sought, so a word that all names share draws nobody together; a window that no outer name
    has rules a name out.
    """
    a, b = inner.select(F.col("n").alias("a")), outer.select(F.col("n").alias("b"))
    short = a.where(F.length("a") < WINDOW)
    by_name = b.select("b", F.explode(_windows(F.col("b"), list(range(1, WINDOW)))).alias("a")).join(short, "a").select("a", "b")
    pieces = b.select("b", F.explode(_windows(F.col("b"), [WINDOW])).alias("piece"))
    often = pieces.groupBy("piece").agg(F.count("*").alias("k"))
    mine = a.where(F.length("a") >= WINDOW).select("a", F.explode(_windows(F.col("a"), [WINDOW])).alias("piece"))
    rarest = mine.join(often, "piece", "left").groupBy("a").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "piece")).alias("m")).where("m.k > 0")
    by_window = rarest.select("a", F.col("m.piece").alias("piece")).join(pieces, "piece").where(F.contains("b", "a")).select("a", "b")
    return by_name.unionByName(by_window)


#: Meaningful words up to which a name is looked up by all sets of its words (247 for eight).
FEW_WORDS = 8


def _subsets(c: str) -> Column:
    """All sets of two or more of a sorted array's distinct words, each sorted."""
    grown = F.aggregate(c, F.array(F.array().cast("array<string>")), lambda acc, w: F.concat(acc, F.transform(acc, lambda x: F.array_append(x, w))))
    return F.filter(grown, lambda x: F.size(x) >= 2)


def registry_match(names: DataFrame, registry: DataFrame) -> DataFrame:
    """name, status, best_name, shared_tokens: the matching entry with the most meaningful words in common, active ones first.

    Two shared meaningful words make a match, or one name lying within the other (inside
    words too). FOUND, CONFLICT (the entry is inactive), NOT_FOUND, or UNAVAILABLE where
    the registry has no rows at all. Each set of two words or more that an entry of at most
    FEW_WORDS meaningful words holds keeps its best entry, and a name looks its own sets up:
    the largest that is found is what both share. So words that everyone has cost no more
    than others. Where one of the two has more words they meet by pairs of words. Entries with the same words and the
    same state meet once. Ties go to the first name.
    """
    wide = names.select("name").distinct().withColumn("n", norm_name(F.col("name")))
    entries = registry.select(F.col("name").alias("entry"), "active").groupBy("entry").agg(F.max("active").alias("active")).withColumn("n", norm_name(F.col("entry")))
    words = lambda df, c, *keep: df.select(*keep, F.array_sort(meaningful(F.col(c))).alias("words"))
    twos = lambda df, *keep: df.where("size(words) >= 2").select(
        *keep, F.explode(F.flatten(F.transform("words", lambda w, k: F.transform(F.slice("words", k + 2, F.size("words")), lambda v: F.struct(w.alias("w"), v.alias("v")))))).alias("two")
    )
    left = words(wide, "name", "name")
    right = words(entries, "entry", "entry", "active").groupBy("words", "active").agg(F.min("entry").alias("entry"))
    mine = left.select("words").distinct()
    best = lambda minus: F.min(F.struct((~F.col("active")).alias("inactive"), minus.alias("minus"), "entry")).alias("b")
    short = F.size("words") <= FEW_WORDS
    sets = right.where(short).select(F.explode(_subsets("words")).alias("some"), "active", "entry").groupBy("some").agg(best(-F.size("some")))
    by_sets = mine.where(short).select("words", F.explode(_subsets("words")).alias("some")).join(sets, "some").select("words", "b")
    theirs = right.select(F.col("words"), F.col("words").alias("theirs"), "active", "entry")
    pairs = [(mine.where(~short), theirs), (mine.where(short), theirs.where(~short))]
    by_pairs = [
        twos(m, "words").join(twos(t, "theirs", "active", "entry"), "two").groupBy("words").agg(best(-F.size(F.array_intersect("words", "theirs")))) for m, t in pairs
    ]
    by_words = (
        by_sets.unionByName(by_pairs[0]).unionByName(by_pairs[1]).groupBy("words").agg(F.min("b").alias("b")).join(left, "words").select("name", "b")
    )
    one, other = wide.select("n").where("n <> ''").distinct(), entries.select("n").where("n <> ''").distinct()
    held = _within(one, other).select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(_within(other, one).select(F.col("b").alias("n"), F.col("a").alias("m")))  # equal names twice, which a minimum doesn't mind
    shared = F.size(F.array_intersect(meaningful(F.col("name")), meaningful(F.col("entry"))))
    by_part = (
        wide.where("n <> ''").join(held, "n").join(entries.select(F.col("n").alias("m"), "entry", "active"), "m")
        .groupBy("name").agg(F.min(F.struct((~F.col("active")).alias("inactive"), (-shared).alias("minus"), "entry")).alias("b"))
    )
    best = by_words.unionByName(by_part).groupBy("name").agg(F.min("b").alias("b"))
    served = registry.agg(F.count("*")).scalar() > 0
    return wide.select("name").join(best, "name", "left").select(
        "name", F.when(~served, "UNAVAILABLE").when(F.col("b").isNull(), "NOT_FOUND").when(F.col("b.inactive"), "CONFLICT").otherwise("FOUND").alias("status"),
        F.col("b.entry").alias("best_name"), F.coalesce(-F.col("b.minus"), F.lit(0)).cast("long").alias("shared_tokens"),
    )


def routing_owner(docs: DataFrame, directory: DataFrame) -> DataFrame:
    """doc_id, status: whether a routing number's owner (the first by name, of several) is the bank that the document names."""
    both = docs.join(directory.groupBy("aba").agg(F.min("owner_name").alias("owner_name")), docs["routing_aba"] == F.col("aba"), "left")
    same = F.contains(norm_name(F.col("bank_name")), norm_name(F.col("owner_name"))) | F.contains(norm_name(F.col("owner_name")), norm_name(F.col("bank_name")))
    return both.select("doc_id", F.when(F.col("owner_name").isNull(), "NOT_FOUND").when(same, "FOUND").otherwise("CONFLICT").alias("status"), aba_checksum_ok(F.col("routing_aba")).alias("checksum_ok"))


def bic_check(docs: DataFrame, directory: DataFrame) -> DataFrame:
    """doc_id, status, country of the BIC: INVALID by shape, else whether the directory has it."""
    parsed = docs.where(~blank(F.col("swift_bic"))).withColumn("p", parse_bic(F.col("swift_bic")))
    return parsed.join(directory.select(F.col("bic").alias("swift_bic"), F.lit(True).alias("known")).distinct(), "swift_bic", "left").select(
        "doc_id", F.when(F.col("p").isNull(), "INVALID").when(F.col("known"), "FOUND").otherwise("NOT_FOUND").alias("status"), F.col("p.country").alias("country")
    )


def evidence_findings(evidence: DataFrame) -> DataFrame:
    """Registry evidence as notes: it never has a verdict of its own."""
    return evidence.where(F.col("status").isin("FOUND", "CONFLICT")).select("*", F.lit("NOTE").alias("severity"), F.lit(None).cast("string").alias("verdict_effect"))


def confidence(readings: DataFrame, votes: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """doc_id, level, reasons: low for a hard signal or two weak ones, medium for one weak one.

    Hard: the readings of an id disagree, the engines disagree on a field, or a contested
    signature. Weak: each id that the model alone has, each field that stayed empty though
    it was asked for again, a text that gave nothing, an unsettled signature, a type that
    only evidence saved. `signals` holds what the readings don't: doc_id, engines_disagree
    and still_empty (arrays of field names), thin, type_rescued, confirmed (ids that pages of
    several kinds print); null or no row counts as none.
    """
    ids = [("iban", "iban_text", "iban_model"), ("account_number", "account_text", "account_model"), ("swift_bic", "swift_text", "swift_model")]
    if signals is None:
        signals = readings.select("doc_id").limit(0).selectExpr(
            "doc_id", "CAST(NULL AS array<string>) AS engines_disagree", "CAST(NULL AS array<string>) AS still_empty",
            "FALSE AS thin", "FALSE AS type_rescued", "CAST(NULL AS array<string>) AS confirmed",
        )
    none = F.array().cast("array<string>")
    names = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, none))))
    of = lambda name, n: F.transform(n, lambda x: F.concat(F.lit(name), x))
    some = lambda *whens: F.array_compact(F.array(*whens))
    both = (
        readings.join(votes.select("doc_id", "contested", "signature_kind"), "doc_id", "left")
        .join(signals.select("doc_id", "engines_disagree", "still_empty", "thin", "type_rescued", "confirmed"), "doc_id", "left")
    )
    clash = some(*(F.when((bare(F.col(d)) != "") & (bare(F.col(m)) != "") & (bare(F.col(d)) != bare(F.col(m))), F.lit(f"readings differ: {k}")) for k, d, m in ids))
    alone = some(
        *(F.when((bare(F.col(d)) == "") & (bare(F.col(m)) != "") & ~F.array_contains(F.coalesce("confirmed", none), k), F.lit(f"model alone: {k}")) for k, d, m in ids)
    )
    contested = F.coalesce("contested", F.lit(False))
    hard = F.concat(clash, of("engines differ: ", names("engines_disagree")), some(F.when(contested, F.lit("signature contested"))))
    weak = F.concat(
        alone, of("still empty: ", names("still_empty")), some(
            F.when(F.coalesce("thin", F.lit(False)), F.lit("hardly any text")),
            F.when(~contested & (F.coalesce("signature_kind", F.lit("")) == "unverified"), F.lit("signature unsettled")),
            F.when(F.coalesce("type_rescued", F.lit(False)), F.lit("type from evidence alone")),
        ),
    )
    found = both.select("doc_id", hard.alias("hard"), weak.alias("weak"))
    level = F.when((F.size("hard") > 0) | (F.size("weak") >= 2), "low").when(F.size("weak") == 1, "medium").otherwise("high")
    return found.select("doc_id", level.alias("level"), F.concat("hard", "weak").alias("reasons"))


def confidence_gate(verdicts: DataFrame, levels: DataFrame) -> DataFrame:
    """CONF-001 for documents that would be accepted on a weak reading."""
    return verdicts.join(levels, "doc_id").where("level = 'low' AND verdict = 'ACCEPT'").select("doc_id", F.lit("CONF-001").alias("rule_id"), F.lit("NEED_MANUAL_REVIEW").alias("verdict_effect"))
