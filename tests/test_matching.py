"""Names against a registry, with a word that every entry carries."""

from vouchlake.operators.reconcile import registry_match


def test_best_entry_despite_a_common_word(spark):
    entries = [("Sparrow Trust Acme Tools", True), ("Sparrow Acme", False), ("Sparrow", True), ("Sparrow Widget Works", False), *((f"Sparrow Entry{k}", True) for k in range(50))]
    registry = spark.createDataFrame(entries, "name string, active boolean")
    names = spark.createDataFrame([("Acme Tools of Sparrow",), ("Widget Works Sparrow Ltd",), ("Sparrow",), ("Nobody",), ("Sparrow Nowhere",), ("Acme Tools of Sparrow",)], "name string")
    got = {r["name"]: (r.status, r.best_name, r.shared_tokens) for r in registry_match(names, registry).collect()}
    assert got["Acme Tools of Sparrow"] == ("FOUND", "Sparrow Trust Acme Tools", 3)
    assert got["Widget Works Sparrow Ltd"][:2] == ("FOUND", "Sparrow")  # an active entry within the name goes before an inactive one
    assert got["Sparrow"][0] == "FOUND" and got["Nobody"] == ("NOT_FOUND", None, 0) and got["Sparrow Nowhere"] == ("FOUND", "Sparrow", 1)


def test_names_that_share_their_words_and_each_other(spark):
    """Pairs of containment equal trying all, short names and long; a phrase that all names share draws no two together."""
    import itertools
    import random

    from vouchlake.operators.reconcile import _within

    rng = random.Random(2)
    names = {"".join(rng.choices("ab ", k=rng.randrange(1, 14))).strip() or "a" for _ in range(250)} | {f"the northern savings bank {k} of {k % 7}" for k in range(120)} | {"northern savings bank", "the northern savings bank 1"}
    table = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in _within(table, table).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in itertools.product(names, names) if a in b}
    many = spark.createDataFrame([(f"the northern savings bank number {k * 7919 + 100_000}x",) for k in range(3000)], "n string")
    assert _within(many, many).count() == 3000


def test_a_document_with_nothing_to_compare_raises_no_finding_of_the_comparison(spark, sf_small, tmp_path):
    """Supplier 2535 has no IBAN, account, holder or known country on either side: neither query nor SQL may say that all fields match."""
    import duckdb

    from vouchlake.queries import ORACLES, QUERIES

    rows = [(2535, "Supplier#000002535", 3), (2536, "Supplier#000002536", 3)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{sf_small}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    for t in ("supplier", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in QUERIES["all_findings"](spark, str(tmp_path)).select("doc_id", "source", "rule_id", "verdict_effect").collect()), key=key)
    assert got == sorted(c.sql(ORACLES["all_findings"]).fetchall(), key=key)
    assert not any(r[:2] == (2535, "comparison") for r in got) and any(r[0] == 2536 and r[1] == "comparison" for r in got)


def test_an_account_that_everyone_holds_is_counted_without_its_pairs(spark):
    """500 partners of a dummy account and 500 documents that end with it: the same counts as pair by pair, and no join makes the pairs."""
    from vouchlake.operators.reconcile import MANY_PARTNERS, _partner_hits, reverse_lookup

    n = 5 * MANY_PARTNERS
    docs = [(k, f"XX00{k * 10 + 9:018d}" if k % 7 else "", str(700_000 + k) if k % 3 else "") for k in range(n)]
    erp = [(f"P{k}", "", "9") for k in range(n)] + [(f"P{k}", "", f"00{k * 10 + 9}") for k in range(n)] + [(f"Q{k}", f"XX00{k * 10 + 9:018d}", str(700_000 + k)) for k in range(0, n, 2)]
    erp += [(f"R{k}", "", "19") for k in range(n)] + [(f"R{k}", "", "9") for k in range(0, n, 5)] + [(None, "", "29"), (None, "", "9")]
    tables = spark.createDataFrame(docs, "doc_id long, iban string, account_number string"), spark.createDataFrame(erp, "partner string, iban string, bankn string")
    got = {r.doc_id: r.n_partners for r in reverse_lookup(*tables).collect()}
    hit = lambda d, e: (d[1] != "" and d[1] == e[1]) or (e[2].lstrip("0") != "" and (d[2].lstrip("0") == e[2].lstrip("0") or d[1].endswith(e[2].lstrip("0"))))
    assert got == {d[0]: len({e[0] for e in erp if hit(d, e)}) for d in docs}
    assert _partner_hits(*tables)[1].count() <= 4 * n < n * n // 10


def test_two_words_that_every_name_has_meet_no_entry_twice(spark):
    """Best entries equal trying all pairs, for names of few words and of many; the sets of a name's words are looked up, not its pairs of entries."""
    import random

    from vouchlake.operators.reconcile import FEW_WORDS, _subsets

    rng = random.Random(5)
    pool = [f"w{k}x" for k in range(14)]
    make = lambda tag, most: f"northern services {' '.join(rng.sample(pool, rng.randrange(most)))} {tag}"
    entries = [(make(f"e{k}", 9 if k % 5 else 13), k % 3 > 0) for k in range(120)]
    names = [make(f"n{k}", 9 if k % 5 else 13) for k in range(60)]
    got = {r["name"]: tuple(r)[1:] for r in registry_match(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(entries, "name string, active boolean")).collect()}
    for n in names:
        _, minus, best, active = min((not a, -len(set(n.split()) & set(e.split())), e, a) for e, a in entries)
        assert got[n] == ("FOUND" if active else "CONFLICT", best, -minus)
    few = spark.createDataFrame([(["a", "b", "c"],)], "words array<string>").select(_subsets("words")).first()[0]
    assert sorted(few) == [["a", "b"], ["a", "b", "c"], ["a", "c"], ["b", "c"]] and FEW_WORDS <= 8
