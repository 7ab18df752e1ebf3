"""Formats, the journal, the store, redaction, attestation, sync, streams and the synthetic corpus."""

import json
import subprocess
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimgraph import store as S
from claimgraph.operators import keeper, redact, state
from claimgraph.sources import attest, formats, journal, synthetic
from claimgraph.streaming import ingest

DOC = """# Log

## D-0001 · Weld twice

```yaml
id: D-0001
state: promoted
author: Ada # the elder
source: notes
  and more
```

**Assertion.** Weld every
seam twice.

It holds since D-0002.

**Forces.** heat; cost.

## H-0002 · Heat

```yaml
id: H-0002
score_by: 2026-01-01
```

**Hypothesis.** Heat is enough.

**Falsifier.** It cracks.
"""


def test_decisions():
    d, h = formats.parse_decisions(DOC)
    assert d.yaml["source"] == "notes and more" and d.comments == {"author": "the elder"} and d.first_line == 3
    assert d.sections["Assertion"] == "Weld every seam twice. It holds since D-0002."
    assert d.content()[:2] == ("claim", "pattern") and h.content() == ("hypothesis", None, "Heat is enough. It cracks.")


@pytest.mark.parametrize(
    "old, new",
    [("id: D-0001", "id: D-0009"), ("state:", "stat:"), ("author: Ada", "id: D-0001"), ("**Forces.**", "**Assertion.**"), ("· Weld", "Weld"),
     ("```yaml\nid: D", "prose\n```yaml\nid: D"), ("**Assertion.** Weld every\nseam twice.\n", "bare"), ("score_by: 2026-01-01\n", "")],
)
def test_bad_decisions(old, new):
    with pytest.raises(formats.FormatError):
        formats.parse_decisions(DOC.replace(old, new, 1))


def test_proposals_and_suites():
    p = formats.parse_proposal("PEP: 7\nTitle: A\n  longer one\nAuthor: X <x@y>, Z\nStatus: Provisional\nType: P\nReplaces: 3, 4\n\nbody\n")
    assert p["title"] == "A longer one" and p["authors"] == ["X", "Z"] and p["replaces"] == [3, 4] and p["state"] == "promoted" and p["judged"]
    for bad in ("PEP: 7\n\nx", "  x\n", "\n", "PEP: x\nTitle: A\nAuthor: B\nStatus: Draft\nType: P\n\nb", "PEP: 1\nTitle: A\nAuthor: B\nStatus: Odd\nType: P\n\nb"):
        with pytest.raises(formats.FormatError):
            formats.parse_proposal(bad)
    text = "| G-1 | why? | answer D-0001 (pending U-3) | me | never |\n| G-2 | how? | abstain | me | x |\n## Baseline\n| G-1 | torque rail |\n| G-2 | — |\n"
    a, b = formats.parse_suite(text)
    assert (a["expects"], a["expected"], a["pending"]) == ("answer", "D-0001", "U-3") and (b["expects"], b["expected"]) == ("abstain", None)
    assert formats.parse_baseline(text) == {"G-1": ["torque", "rail"], "G-2": []}
    with pytest.raises(formats.FormatError):
        formats.parse_suite("| G-1 | why? | maybe | me | never |")
    assert formats.mentioned("D-0001 U-5, XD-0002 D-00011 U-5 H-0003", "D-0001") == ["U-5", "H-0003"]
    assert formats.split_evidence("[a.md §1, §2, b]") == ["a.md §1, §2", "b"] and formats.register_owner("*Owner: Ada.*") == "Ada"


def test_readers(spark, tmp_path):
    (tmp_path / "d.md").write_text(DOC)
    (tmp_path / "r.txt").write_text("# R\n| U-1 | ~~why~~ **Resolved 2025-01-02** by D-0001 | x | |\n| U-2 | how | after U-1 | n |\n")
    rows = {r["id"]: r for r in formats.read_decisions(spark, str(tmp_path / "d.md")).collect()}
    assert rows["D-0001"]["shape"] == "pattern" and rows["H-0002"]["shape"] is None
    reg = {r["unknown_id"]: r for r in formats.read_register(spark, str(tmp_path / "r.txt")).collect()}
    assert (reg["U-1"]["resolved"], reg["U-1"]["resolved_on"], reg["U-1"]["resolved_by"]) == (True, "2025-01-02", "D-0001")
    assert reg["U-2"]["resolved"] is False
    (tmp_path / "bad.txt").write_text("| U-1 | a | b |\n")
    with pytest.raises(formats.FormatError):
        formats.read_register(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "p.txt").write_text("PEP: 7\nTitle: A\nAuthor: X\nStatus: Draft\nType: P\n\nbody\n")
    assert formats.read_proposals(spark, str(tmp_path / "p.txt")).collect()[0]["state"] == "proposed"
    (tmp_path / "g.md").write_text("| G-1 | why? | abstain U-2 | me | U-1 |\n")
    suite = formats.read_suite(spark, str(tmp_path / "g.md"))
    register = spark.createDataFrame([("p", "U-1", True)], "path string, unknown_id string, resolved boolean")
    trig = suite.select(F.lit("p").alias("path"), F.col("golden_id").alias("id"), F.col("review_trigger").alias("trigger"))
    assert [(r["id"], r["fired"]) for r in keeper.stale_triggers(trig, register).collect()] == [("G-1", "U-1")]


@pytest.fixture
def ledger(spark, tmp_path):
    clock = {"t": datetime(2025, 1, 1, tzinfo=UTC)}

    def now():
        clock["t"] += timedelta(seconds=1)
        return clock["t"]

    led = S.Ledger(spark, str(tmp_path / "store"), now)
    led.clock = clock
    return led


def states(led):
    return {r["record_id"]: r["state"] for r in state.with_state(led.records, led.effects).collect()}


def test_store_end_to_end(spark, ledger):
    tool = S.KnowledgeStore(ledger)
    src, proc = ledger.upsert_entities([("source", "interview"), ("process", "torque check")])
    assert ledger.upsert_entities([("process", "torque check")]) == [proc]
    a, same = tool.propose_claim(S.text_claim("Torque is set to 24 Nm", [proc]), evidence=[{"source": src, "span": "§1"}])
    assert same.count() == 0 and states(ledger)[a] == "proposed"
    b, same = tool.propose_claim(S.text_claim("Torque is set to 24 Nm", [proc]))
    assert [r["record_id"] for r in same.collect()] == [a]
    keeper_ = S.Keeper(ledger, "Ada")
    keeper_.promote(a)
    g = tool.register_gap("Who sets the torque?", ["process:torque check"])
    keeper_.answer(g, a)
    keeper_.reject(b)
    assert states(ledger)[a] == "promoted" and states(ledger)[g] == "answered" and states(ledger)[b] == "rejected"
    assert ledger.violations().count() == 0
    for refused in (
        lambda: keeper_.promote(a), lambda: keeper_.retire(a, "Bored"), lambda: tool.register_gap(" "), lambda: tool.get_record("rec_" + "0" * 26),
        lambda: tool.register_gap("x?", ["process:none"]), lambda: ledger.append([S.Draft(S.verdict("Retire", target=a, reason="Superseded"), "bot", "agent")]),
        lambda: ledger.append([S.Draft(S.text_claim("x", [proc, proc]), "Ada")]), lambda: ledger.append([S.Draft(S.text_claim("x"), "Ada", evidence=[{"source": proc}])]),
        lambda: ledger.append([S.Draft(S.text_claim("x"), "Ada", valid_from=datetime(2025, 1, 2), valid_to=datetime(2025, 1, 2))]),
        lambda: ledger.append([S.Draft(S.text_claim("x"), "Ada", supersedes=g)]), lambda: ledger.measure("ent_" + "0" * 26, "n", 1.0, "Ada"),
    ):
        before = len(ledger.batches())
        with pytest.raises(S.Refused):
            refused()
        assert len(ledger.batches()) == before
    found = tool.search("torque Nm")
    assert found.outcomes.collect()[0]["outcome"] == "matches" and [r["record_id"] for r in found.items.collect()] == [a]
    out = tool.get_record(a).collect()[0]
    assert out["state"] == "promoted" and out["about"][0]["label"] == "process:torque check" and out["evidence"][0]["label"] == "source:interview"
    assert [r["action"] for r in tool.history(a).collect()] == ["promote"] and tool.open_questions().count() == 0
    assert tool.as_of(a, datetime(2024, 1, 1)).count() == 0 and tool.contradictions().count() == 0 and tool.pending_proposals().count() == 0
    ledger.measure(proc, "n", 1.5, "Ada")
    assert [r["value"] for r in state.panel(ledger.measurements).collect()] == [1.5]
    audit = tool.audit(500).collect()
    assert "failed" in {r["outcome"] for r in audit} and audit[0]["seq"] > audit[-1]["seq"]
    # one batch builds on itself, and a set verdict moves all or none
    c, d = ledger.append([S.Draft(S.text_claim("one"), "Ada"), S.Draft(S.text_claim("two"), "Ada")])
    keeper_.promote_set([c, d], "Ingestion")
    assert {r["basis"]: r["n"] for r in state.ratification(ledger.records, ledger.effects).collect()} == {"individually": 1, "Ingestion": 2}
    # redaction leaves structure and a receipt
    ledger.append([S.Draft(S.redaction(record=a, reason="asked to"), "Ada")])
    assert ledger.redact() == {True: 1, False: ledger.lines().count() - 1}
    again = ledger.redact()
    assert again == {False: ledger.lines().count()}
    assert [r["text"] for r in ledger.records.where(F.col("record_id") == a).collect()] == [redact.REDACTED] and ledger.violations().count() == 0


def test_clock_and_lock(ledger, tmp_path):
    ledger.append([S.Draft(S.text_claim("x"), "Ada")])
    last = ledger.clock["t"]
    ledger.clock["t"] = last - timedelta(minutes=2)
    ledger.append([S.Draft(S.text_claim("y"), "Ada")])
    assert ledger.records.agg(F.max("recorded_at")).first()[0].replace(tzinfo=UTC) == last
    ledger.clock["t"] = last - timedelta(minutes=20)
    with pytest.raises(S.Refused):
        ledger.append([S.Draft(S.text_claim("z"), "Ada")])
    with S.Lock(str(tmp_path / "l")):
        with pytest.raises(S.Refused):
            S.Lock(str(tmp_path / "l")).acquire()
    (tmp_path / "l.lock").write_text(f"{__import__('socket').gethostname()} 999999999")
    S.Lock(str(tmp_path / "l")).acquire()


def wire(i, content, at="2025-01-01T00:00:00Z", **k):
    return {"event": "record", "id": i, "recorded_at": at, "envelope_version": 1, "author": {"name": "A", "kind": "Human"},
            "source": {"channel": "c"}, "valid_from": at, "content": content} | k


def test_journal(spark, tmp_path, ledger):
    ev = [{"event": "entity", "id": "E1", "kind": "line", "label": "l"}, wire("R1", S.attribute("E1", "n", 24.0)), wire("R2", S.attribute("E1", "n", 1e20)),
          wire("V1", S.verdict("Promote", target="R1")), {"event": "measurement", "target": {"Entity": "E1"}, "name": "n", "value": 0.5,
          "at": "2025-01-01T00:00:00Z", "by": {"name": "A", "kind": "Human"}}]
    p = tmp_path / "log.jsonl"
    p.write_text("\n".join(map(json.dumps, ev[:2])) + "\n\n" + "\n".join(map(json.dumps, ev[2:])) + '\n{"event": "rec')
    e = journal.parse_events(journal.read_lines(spark, str(p)))
    assert [r["seq"] for r in e.orderBy("seq").collect()] == [0, 1, 3, 4, 5]
    texts = {r["record_id"]: r["text"] for r in journal.records(e).where("kind <> 'verdict'").collect()}
    assert texts == {"rec_R1": "n 24", "rec_R2": "n 100000000000000000000"}
    assert [(r["target_id"], r["new_state"]) for r in journal.effects(e).collect()] == [("rec_R1", "promoted")]
    assert journal.measurements(e).collect()[0]["target"] == "ent_E1" and journal.entities(e).count() == 1
    ledger.import_log(str(p))
    assert states(ledger)["rec_R1"] == "promoted"
    p.write_text('{"event": "rec\n' + json.dumps(ev[0]))
    with pytest.raises(journal.CorruptLog, match="line 1"):
        journal.parse_events(journal.read_lines(spark, str(p)))
    p.write_text(json.dumps(ev[1] | {"envelope_version": 2}) + "\n" + json.dumps(ev[0]))
    with pytest.raises(journal.CorruptLog, match="version"):
        journal.parse_events(journal.read_lines(spark, str(p)))
    p.write_text(json.dumps(wire("V9", S.verdict("Promote", target="none"))))
    with pytest.raises(S.Refused, match="illegal_transition"):
        ledger.import_log(str(p))


def test_stream(spark, tmp_path, ledger):
    src = tmp_path / "in"
    src.mkdir()
    run = lambda: ingest.ingest(ledger, ingest.event_lines(spark, str(src)), str(tmp_path / "cp"), str(tmp_path / "bad")).awaitTermination()
    (src / "1.jsonl").write_text("\n".join(json.dumps(x) for x in [{"event": "entity", "id": "E1", "kind": "k", "label": "l"}, wire("R1", S.text_claim("a", ["E1"]))]))
    run()
    (src / "2.jsonl").write_text(json.dumps(wire("V1", S.verdict("Promote", target="R1"), "2025-01-02T00:00:00Z")))
    run()
    run()
    assert states(ledger) == {"rec_R1": "promoted"} and len(ledger.batches()) == 2
    (src / "3.jsonl").write_text(json.dumps(wire("V2", S.verdict("Promote", target="R1"), "2025-01-03T00:00:00Z")))
    run()
    assert len(ledger.batches()) == 2 and spark.read.json(str(tmp_path / "bad")).count() == 1
    ingest.postings_stream(ingest.event_lines(spark, str(src)), str(tmp_path / "post"), str(tmp_path / "cp2")).awaitTermination()
    assert [r["term"] for r in spark.read.parquet(str(tmp_path / "post")).collect()] == ["a"]


def test_attestation(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ada", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "f.md").write_text("one\ntwo\n")
    git("add", "f.md")
    git("-c", "commit.gpgsign=false", "commit", "-qm", "x")
    lines = attest.blame(spark, str(tmp_path), "f.md")
    assert [r["line"] for r in lines.orderBy("line").collect()] == [1, 2]
    a = lines.select(keeper.attestation(F.col("detail")).alias("a")).first()["a"]
    assert a["kind"] == "unsigned" and a["by"] == "Ada" and a["strength"] == 1
    assert attest.blame(spark, str(tmp_path), "none.md").count() == 0
    signed = "attest:signed commit:c key:k signer:s"
    rows = spark.createDataFrame([(1, signed), (2, "attest:unsigned commit:d by:Ada"), (700, signed)], "line int, detail string")
    spans = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 5, 6), ("d", 1, 900)], "id string, first_line int, last_line int")
    weak = {r["id"]: r["detail"] for r in keeper.weakest(spans, rows).collect()}
    assert weak["a"] == signed and weak["b"].startswith("attest:unsigned") and weak["c"].startswith("attest:none") and weak["d"] == weak["b"]
    ok = rows.select(keeper.policy_admits(F.col("detail"), "require_signature"), keeper.policy_admits(F.col("detail"), "from", ["s"])).collect()
    assert [tuple(r) for r in ok] == [(True, True), (False, False), (True, True)]
    today = spark.createDataFrame([("c", "attest:unsigned commit:c by:x"), ("e", signed)], "commit string, detail string")
    old = spark.createDataFrame([("1", signed), ("2", "attest:none because:x"), ("3", "attest:unsigned commit:zz by:x")], "id string, detail string")
    assert {r["id"]: r["verdict"] for r in keeper.review_trust(old, today).collect()} == {"1": "weakened", "2": "nothing_to_recheck", "3": "unverifiable"}


def test_sync(spark):
    ref = lambda key, dig, noted=None: f"d.md#{key}{f' recorded:{noted}' if noted else ''} digest:{dig * 16}"
    rows = [(1, "r1", ref("D-0001", "a", "2025-01-01")), (2, "r2", ref("D-0001", "b")), (3, "r3", ref("U-1", "a")), (4, "r4", ref("D-9/title", "a")), (5, "r5", "odd")]
    prior = keeper.prior_origins(spark.createDataFrame(rows, "seq long, record_id string, reference string"))
    assert {r["identity"]: r["digest"][0] for r in prior.collect()} == {"d.md#D-0001": "b", "d.md#U-1": "a", "d.md#D-9/title": "a"}
    src = spark.createDataFrame([("d.md#D-0001", "b" * 16, "claim"), ("d.md#N", "x", "gap")], "identity string, digest string, kind string")
    assert {r["identity"]: r["disposition"] for r in keeper.dispositions(src, prior).collect()} == {"d.md#D-0001": "unchanged", "d.md#N": "fresh"}
    assert [r["identity"] for r in keeper.absent(src, prior).collect()] == ["d.md#U-1"]
    src = spark.createDataFrame([("d.md#U-1", "z", "gap"), ("d.md#D-0001", "z", "claim")], "identity string, digest string, kind string")
    for st, want in (("registered", "reword"), ("answered", "drift")):
        s = spark.createDataFrame([("r3", st)], "record_id string, state string")
        assert {r["identity"]: r["action"] for r in keeper.sync_actions(src, prior, s).collect()} == {"d.md#U-1": want, "d.md#D-0001": "supersede"}


def test_audits(spark):
    q = spark.createDataFrame([(1, "why is the blue weld so hot today"), (2, "what")], "query_id long, text string")
    d = spark.createDataFrame([("r1", "note: is the blue weld so hot"), ("r2", "blue weld"), ("r3", None)], "record_id string, text string")
    assert [(r["query_id"], r["record_id"], r["run"]) for r in keeper.quoted_questions(q, d).collect()] == [(1, "r1", 6)]
    absent = keeper.absent_vocabulary(q, d)
    assert {(r["query_id"], r["term"]) for r in absent.collect()} == {(1, "today")}
    was = spark.createDataFrame([(1, "today"), (1, "blue")], "query_id long, term string")
    assert [(r["query_id"], r["term"]) for r in keeper.vocabulary_drift(was, absent).collect()] == [(1, "blue")]
    assert [r["query_id"] for r in keeper.missing_baseline(was, q).collect()] == [2]


def test_synthetic(spark):
    rows = synthetic.generate(spark, synthetic.Shape(9, 12, 20)).cache()
    assert rows.where("topic = -1").count() == 20 and rows.where("contradicts").count() == 2
    again = synthetic.generate(spark, synthetic.Shape(9, 12, 20))
    assert rows.exceptAll(again).count() == 0
    records, effects = synthetic.as_ledger(rows)
    told = state.with_state(records, effects).select("record_id", "state").join(
        rows.select(F.format_string("rec_%06d_%04d", "topic", "n").alias("record_id"), F.col("state").alias("truth")), "record_id")
    assert told.where("state <> truth").count() == 0
    assert state.contradictions(records, effects).count() == 1
    assert synthetic.Shape.of_size(100).topics == 10
