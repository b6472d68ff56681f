"""Streams against their batch twins; readers and writers."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest

from vouchlake.operators.privacy import leak_scan, redact_known
from vouchlake.operators.teach import cover_select
from vouchlake.plans.rules import RULES
from vouchlake.sources import io
from vouchlake.streaming import streams as S


def test_stream_of_rule_rates_equals_the_batch(spark, sf_small, tmp_path):
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.rule_rates(S.read_stream(spark, str(tmp_path / "in")), lateness="400 days")
    got = S.run_to_files(stream, str(tmp_path / "out"), ["start", "event_type"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.rule_rates(events).collect()))


def test_stream_of_verdicts_drops_equal_content(spark, tmp_path):
    row = ("bank", "invoice", "A", "DE89370400440532013000", "1", datetime(2026, 1, 1))
    docs = spark.createDataFrame([(1, *row), (2, *row), (3, "bank", "other", "B", "", "2", row[-1])], "doc_id int, doc_class string, doc_type string, account_holder string, iban string, account_number string, ts timestamp")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = S.run_to_files(S.stream_validate(S.read_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out")).collect()
    assert sorted(r.verdict for r in got) == ["NEED_MANUAL_REVIEW", "REJECT"]


def test_stream_of_staleness_resets_on_confirmation(spark, tmp_path):
    rows = [(1, 10, "unsafe"), (1, 20, "safe"), (1, 15, "confirm"), (2, 5, "safe"), (1, 12, "safe"), (2, 9, "confirm")]
    spark.createDataFrame(rows, "doc_key long, at long, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = S.run_to_files(S.stream_staleness(S.read_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), ["doc_key"]).collect()
    assert sorted((r.doc_key, r.disagreements, r.unsafe) for r in got) == [(1, 1, 0), (2, 0, 0)]


def test_stream_of_leaks(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [(at + timedelta(minutes=k), "call 000-12-3456" if k % 2 else "nothing") for k in range(20)]
    spark.createDataFrame(rows, "ts timestamp, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = S.run_to_files(S.stream_leaks(S.read_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), ["start", "pattern"]).collect()
    assert sorted((r.start.minute, r.pattern, r.hits) for r in got) == [(0, "ssn", 5), (10, "ssn", 5)]


def test_run_folders_labels_and_ledger(spark, tmp_path):
    for name, findings in (("a", [{"rule_id": "BNK-001"}]), ("b", "broken"), ("c", None)):
        d = tmp_path / "runs" / name
        d.mkdir(parents=True)
        (d / "meta.json").write_text(json.dumps({"doc_class": "bank", "verdict": "REJECT"}))
        if findings:
            (d / "findings.json").write_text(json.dumps(findings) if isinstance(findings, list) else "{oops")
    runs, found = io.load_runs(spark, str(tmp_path / "runs"))
    assert [r.run_id for r in runs.collect()] == ["a"] and [(r.run_id, r.rule_id) for r in found.collect()] == [("a", "BNK-001")]
    (tmp_path / "labels.jsonl").write_text('{"label_id":"x","confirmed":true}\n\nnot json\n')
    assert [r.label_id for r in io.load_labels(spark, str(tmp_path / "labels.jsonl")).collect()] == ["x"]
    with pytest.raises(Exception, match="(?i)malformed|bad|fail"):
        io.load_labels(spark, str(tmp_path / "labels.jsonl"), strict=True).collect()
    (tmp_path / "ledger.json").write_text('{"bank:BNK-001":{"status":"APPROVED","hash":"h"}}')
    assert [(r.doc_class, r.rule_id, r.status) for r in io.load_approvals(spark, str(tmp_path / "ledger.json")).collect()] == [("bank", "BNK-001", "APPROVED")]


@pytest.mark.parametrize("heading", ["PARTNER,BKVID,BANKS,BANKN,IBAN", "Business Partner,Bank details ID,Bank Country,Bank acct,IBAN"])
def test_exports_under_both_headings(spark, tmp_path, heading):
    (tmp_path / "e.csv").write_text(f"Report of today,,,,\n{heading}\n1.0,0001,DE,123,\n,,,,\n2,0002,FR,TRUE,X\n")
    kind, rows = io.load_erp_export(spark, str(tmp_path / "e.csv"))
    got = sorted((r.PARTNER, r.BANKN) for r in rows.collect() if r.PARTNER and r.PARTNER[0].isdigit())
    assert kind == "BANK" and got == [("1", "123"), ("2", "X")]
    with pytest.raises(ValueError, match="neither"):
        io.export_kind(["IBAN"])


def test_exports_whose_columns_lie_elsewhere(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,,,\n\nPARTNER,BANKN,IBAN\n1,11,X1\n")
    (tmp_path / "b.csv").write_text('Account Holder Name,IBAN,Reference?,Partner,Bank account\n"Doe, J",X2,r,2.0,22\n,,,,\nTRUE,,,3,33\n')
    kind, rows = io.load_erp_export(spark, str(tmp_path))
    got = sorted((r.PARTNER, r.BANKN, r.IBAN, r.KOINH) for r in rows.collect())
    assert kind == "BANK" and got == [("1", "11", "X1", ""), ("2", "22", "X2", "Doe, J"), ("3", "33", "", "X")]
    (tmp_path / "c.csv").write_text("x\n" * 8 + "PARTNER,BANKN,IBAN\n1,2,3\n")
    with pytest.raises(ValueError, match="no heading"):
        io.load_erp_export(spark, str(tmp_path))
    (tmp_path / "c.csv").write_text("PARTNER,TYPE,NAME_ORG1\n1,2,A\n")
    with pytest.raises(ValueError, match="under one path"):
        io.load_erp_export(spark, str(tmp_path))


def test_rules_from_files(spark, tmp_path):
    io.save_rules(spark, RULES, str(tmp_path / "rules"))
    got = io.load_rules(spark, str(tmp_path / "rules"))
    assert {r.rule_id: r.rule_hash for r in got} == {r.rule_id: r.rule_hash for r in RULES}
    bad = '{"doc_class":"bank","rule_id":"X-1","op":"always","severity":"LOUD","message":"m"}\n'
    (tmp_path / "bad.json").write_text(bad)
    with pytest.raises(ValueError, match="X-1: unknown severity"):
        io.load_rules(spark, str(tmp_path / "bad.json"))
    (tmp_path / "bad.json").write_text(bad.replace("LOUD", "NOTE") * 2)
    with pytest.raises(ValueError, match="given twice"):
        io.load_rules(spark, str(tmp_path / "bad.json"))


def test_gated_write_splits_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "fine"), (2, "id 000-12-3456"), (3, "DE89370400440532013000"), (4, None)], "k int, text string")
    for n in (1, 2):  # to a new folder, and beside what is there
        assert io.gated_write(df, ["text"], str(tmp_path / "ok"), str(tmp_path / "held")) == 2
        assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == sorted([1, 4] * n)
        assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "held")).collect()) == sorted([2, 3] * n)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["held", "ok"]


def test_a_strict_sink_fails_before_anything_is_visible(spark, tmp_path):
    df = spark.createDataFrame([(k, "id 000-12-3456" if k == 77 else "fine") for k in range(100)], "k int, text string")
    target = str(tmp_path / "out")
    with pytest.raises(io.Leak, match="1 rows"):
        io.gated_write(df, ["text"], target)
    assert list(tmp_path.iterdir()) == []
    assert io.gated_write(df.where("k <> 77"), ["text"], target) == 0
    before = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    with pytest.raises(io.Leak):
        io.gated_write(df, ["text"], target)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == before
    assert io.gated_write(df.limit(0), ["text"], str(tmp_path / "none")) == 0


def test_broken_lines_are_counted_and_kept(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"label_id":"a","confirmed":true}\n{"label_id":\n\nnonsense\n{"label_id":"b"}\n')
    rows, broken = io.part_lines(spark, str(tmp_path / "l.jsonl"), io.LABEL)
    assert sorted(r.label_id for r in rows.collect()) == ["a", "b"] and rows.columns == io.load_labels(spark, str(tmp_path / "l.jsonl")).columns
    assert [(r.file.rsplit("/", 1)[1], r.n) for r in io.quarantine_lines(broken, str(tmp_path / "q")).collect()] == [("l.jsonl", 2)]
    assert {r.value for r in spark.read.parquet(str(tmp_path / "q")).collect()} == {'{"label_id":', "nonsense"}


def test_a_damaged_ledger_keeps_its_bytes(spark, tmp_path):
    (tmp_path / "ledger").mkdir()
    (tmp_path / "ledger" / "a.json").write_text('{"bank:BNK-001":{"status":"APPROVED","hash":"h"}}')
    (tmp_path / "ledger" / "b.json").write_bytes(b'{"bank:BNK-002":{"status":"APPR\xff')
    for _ in range(2):
        got = io.load_approvals(spark, str(tmp_path / "ledger"), str(tmp_path / "held"))
        assert [(r.rule_id, r.status) for r in got.collect()] == [("BNK-001", "APPROVED")]
        assert [bytes(r.content) for r in spark.read.parquet(str(tmp_path / "held")).collect()] == [b'{"bank:BNK-002":{"status":"APPR\xff']


def test_staleness_in_any_order(spark, tmp_path):
    """Whatever the order of arrival, the last state is the batch count; counters older than the horizon stay bounded."""
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, v):
            self.exists, self.get = True, v

    rng = random.Random(4)
    events = [(k, rng.choice(["confirm", "safe", "unsafe", "safe"])) for k in rng.sample(range(1000), 120)]
    last = max((a for a, k in events if k == "confirm"), default=-1)
    want = (sum(a > last and k != "confirm" for a, k in events), sum(a > last and k == "unsafe" for a, k in events))
    for _ in range(20):
        rng.shuffle(events)
        state, at = State(), 0
        while at < len(events):
            part = events[at : at + rng.randrange(1, 9)]
            at += len(part)
            out = pd.concat(list(S._stale(10_000)((1,), iter([pd.DataFrame(part, columns=["at", "kind"])]), state)))
        assert (out.disagreements[0], out.unsafe[0]) == want
    state = State()
    for k in range(300):
        out = pd.concat(list(S._stale(50)((1,), iter([pd.DataFrame([(k, "unsafe")], columns=["at", "kind"])]), state)))
        assert len(state.get[4]) <= 52 and out.disagreements[0] == out.unsafe[0] == k + 1


def test_a_killed_stream_goes_on_where_it_was(spark, tmp_path):
    """The second of three files breaks the job; restarted from its checkpoint it counts each row once."""
    from pyspark.sql import functions as F

    source, folder = tmp_path / "in", str(tmp_path / "out")
    for k in range(3):
        rows = spark.createDataFrame([(k * 1000 + j, datetime(2026, 1, 1 + k, j), "a" if j % 2 else "b") for j in range(20)], "event_id long, ts timestamp, event_type string")
        rows.coalesce(1).write.parquet(str(source / f"f{k}"))
    files = [next(p for p in (source / f"f{k}").iterdir() if p.suffix == ".parquet") for k in range(3)]
    (tmp_path / "flat").mkdir()
    for k, f in enumerate(files):
        (tmp_path / "flat" / f"{k}.parquet").write_bytes(f.read_bytes())
        os.utime(tmp_path / "flat" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    marker = tmp_path / "broken"
    marker.write_text("yes")

    @F.udf("boolean")
    def check(event_id):
        if event_id >= 1000 and os.path.exists(marker):
            raise RuntimeError("lost")
        return True

    rates = lambda: S.rule_rates(S.read_stream(spark, str(tmp_path / "flat"), 1).where(check("event_id")))
    with pytest.raises(Exception, match="lost"):
        S.run_to_files(rates(), folder)
    marker.unlink()
    got = {(r.start, r.event_type): r.n for r in S.run_to_files(rates(), folder).collect()}
    batch = {(r.start, r.event_type): r.n for r in S.rule_rates(spark.read.parquet(str(tmp_path / "flat"))).collect()}
    until = datetime(2026, 1, 3, 19) - timedelta(hours=1)
    assert got == {k: n for k, n in batch.items() if k[0] + timedelta(hours=1) <= until} and len(got) > 100


def test_known_values_are_found_between_separators(spark):
    docs = spark.createDataFrame([(1, "8 1 – 0 8 2 6 7 3 4 end"), (2, "81-0826734")], "doc_id int, text string")
    secrets = spark.createDataFrame([(1, "81-0826734", "XX-XXX6734")], "doc_id int, value string, masked string")
    got = {r.doc_id: r.text for r in redact_known(docs, secrets).collect()}
    assert got == {1: "XX-XXX6734 end", 2: "81-0826734"}
    assert {r.pattern for r in leak_scan(docs).collect()} == {"ein", "ein_spaced"}


def test_cover_select_prefers_new_units(spark):
    rows = [
        (1, "bank", "letter", "a", True, 9, False, 0.0), (2, "bank", "letter", "a", True, 8, False, 0.0), (3, "bank", "invoice", "b", True, 0, False, 0.0),
        (4, "w9", "w9", "a", False, 9, True, 1.0),
    ]
    labels = spark.createDataFrame(rows, "run_id long, doc_class string, doc_type_gold string, tag string, confirmed boolean, changed_fields long, type_changed boolean, completeness double")
    assert sorted((r.doc_class, r.pick, r.run_id) for r in cover_select(labels).collect()) == [("bank", 0, 1), ("bank", 1, 3)]


def test_relocation_and_reports(spark):
    labels = spark.createDataFrame([("aaaaaaaa1", "bank", "/x/y.pdf"), ("bbbbbbbb1", "bank", "C:\\z\\y.pdf"), ("cccccccc1", "w9", "q.pdf")], "doc_sha256 string, doc_class string, doc_path string")
    files = spark.createDataFrame([("aaaaaaaa1",)], "doc_sha256 string")
    got = sorted((r.doc_path, r.present) for r in io.relocate(labels, files).collect())
    assert got == [("bank/aaaaaaaa-y.pdf", True), ("bank/bbbbbbbb-y.pdf", False), ("w9/q.pdf", False)]
    verdicts = spark.createDataFrame([(1, "REJECT"), (2, "ACCEPT")], "doc_id int, verdict string")
    found = spark.createDataFrame([(1, 1, "BNK-001", "CRITICAL", "REJECT", "no")], "doc_id int, seq int, rule_id string, severity string, verdict_effect string, message string")
    docs = {r.doc_id: json.loads(r.json) for r in io.report_json(verdicts, found).collect()}
    assert docs[1]["findings"][0]["rule_id"] == "BNK-001" and docs[2]["findings"] == []


def test_history_and_registry_age(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"stream":"real","ts":"2026-01-01T00:00:00Z","metric":"m","value":1.0}\n{"stream":"real","ts":"2026-01-02T00:00:00Z","metric":"m","value":2.0}\nbad\n')
    assert [r.value for r in io.latest_metrics(io.load_eval_history(spark, str(tmp_path / "h.jsonl"))).collect()] == [2.0]
    spark.createDataFrame([("a", datetime(2026, 1, 1, 12)), ("b", datetime(2025, 12, 1))], "name string, snapshot_ts timestamp").write.parquet(str(tmp_path / "r"))
    assert [r.name for r in io.load_registry(spark, str(tmp_path / "r"), "2026-01-02 00:00:00").collect()] == ["a"]
