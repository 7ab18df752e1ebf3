"""Attestation marks, answers, display, evidence, the command line, followers and markers."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimgraph import cli
from claimgraph import store as S
from claimgraph.operators import state, validate
from claimgraph.sources import attest, corpus, formats, journal
from claimgraph.streaming import ingest
from tests.test_sources import DOC, wire


@pytest.fixture
def ledger(spark, tmp_path):
    t = iter(datetime(2026, 1, 1, tzinfo=UTC) + timedelta(seconds=n) for n in range(10_000))
    return S.Ledger(spark, str(tmp_path / "s"), lambda: next(t))


def test_signature_marks(monkeypatch):
    full = {s: f"{i:07x}" + "0" * 33 for i, s in enumerate("GUBEXYRN", 1)}
    rows = [f"{c}\x1f{s}\x1fKEY\x1fAda <a@b.c>\x1fAda L" for s, c in full.items()]
    monkeypatch.setattr(attest, "_git", lambda root, *args: "\n".join(rows))
    got = attest.verify(".", list(full.values()))
    kinds = {s: got[c].split()[0] for s, c in full.items()}
    assert kinds == {s: {"G": "attest:signed", "U": "attest:unknown-key"}.get(s, "attest:unsigned") for s in full}
    assert got[full["G"]] == f"attest:signed commit:{full['G'][:7]} key:KEY signer:Ada" and got[full["B"]].endswith("by:Ada L")
    assert got[full["U"][:7]] == got[full["U"]]


def test_answers_need_a_promoted_claim(spark):
    at, who = datetime(2025, 1, 1), "human"
    rows = [(1, 0, "v1", at, "rec_C", "promote", "promoted", None, None, who), (2, 0, "v2", at, "rec_G", "answer", "answered", "C", None, who),
            (3, 0, "v3", at, "rec_C", "retire", "retired", "Superseded", None, who), (4, 0, "v4", at, "rec_H", "answer", "answered", "rec_C", None, who),
            (5, 0, "v5", at, "rec_I", "answer", "answered", "rec_X", None, who), (6, 0, "v6", at, "rec_J", "answer", "answered", None, None, who)]
    from claimgraph.schema import EFFECT

    got = validate.unpromoted_answers(spark.createDataFrame(rows, EFFECT)).collect()
    assert sorted((r["id"], r["detail"]) for r in got) == [
        ("rec_H", "rec_C retired"), ("rec_I", "rec_X never moved"), ("rec_J", "nothing never moved")
    ]
    assert validate.unpromoted_answers(spark.createDataFrame([], EFFECT)).count() == 0


def test_verdicts_and_patterns_in_words(spark, tmp_path):
    said = [("Promote", {"target": "A"}), ("Promote", {"target": "A", "retiring": "B"}), ("PromoteSet", {"targets": ["A", "B"], "basis": "OneAct", "retiring": ["C"]}),
            ("Retire", {"target": "A", "reason": "Superseded"}), ("Reject", {"target": "A"}), ("Answer", {"gap": "G", "with_claim": "A"}),
            ("Withdraw", {"gap": "G", "reason": "NoLongerRelevant"}), ("Abandon", {"hypothesis": "H", "reason": "Superseded"}), ("Score", {"hypothesis": "H", "outcome": "Met"})]
    events = [wire(f"V{i}", {"Verdict": {"action": {n: a}, "rationale": "r"}}) for i, (n, a) in enumerate(said)]
    events += [wire("P", S.pattern(" when hot ", ["a", " b"], "cool it")), wire("T", S.text_claim("plain")), wire("Q", S.pattern("", [], "just so"))]
    p = tmp_path / "l.jsonl"
    p.write_text("\n".join(map(json.dumps, events)))
    e = journal.parse_events(journal.read_lines(spark, str(p)))
    assert [r["action"] for r in journal.verdicts(e).orderBy("seq").collect()] == [
        "promote rec_A", "promote rec_A (retiring rec_B)", "promote 2 claim(s) on the basis of OneAct, retiring 1", "retire rec_A (Superseded)", "reject rec_A",
        "answer rec_G with rec_A", "withdraw rec_G (NoLongerRelevant)", "abandon rec_H (Superseded)", "score rec_H Met",
    ]
    shown = {r["record_id"]: r["shown"] for r in journal.shown_texts(e).collect()}
    assert shown == {"rec_P": "cool it\n\nContext: when hot\n\nForces: a; b", "rec_T": "plain", "rec_Q": "just so"}


def test_evidence_stays_in_the_repository(spark, ledger, tmp_path):
    root = tmp_path / "repo"
    (root / "docs").mkdir(parents=True)
    (root / "docs" / "a.md").write_text("x")
    (root / "b.md").write_text("x")
    (tmp_path / "out.md").write_text("x")
    (root / "link.md").symlink_to(tmp_path / "out.md")
    assert corpus.contained("a.md", str(root)) == "docs/a.md" and corpus.contained("b.md", str(root)) == "b.md"
    for bad in ("", "../out.md", "/etc/passwd", "docs/../b.md", "./b.md", "link.md", "none.md"):
        assert corpus.contained(bad, str(root)) is None
    with_evidence = DOC.replace("state: promoted", "evidence: [a.md §1, §2, b.md]\nstate: promoted", 1)
    told = corpus.sync_decisions(ledger, with_evidence, root=str(root), rehearse=True)
    assert told.written > 0 and not ledger.batches()
    corpus.sync_decisions(ledger, with_evidence, root=str(root))
    rows = ledger.records.where("size(evidence) > 0").select(F.explode("evidence").alias("e")).select("e.source", "e.span")
    labels = {r["label"]: r["span"] for r in rows.join(ledger.entities, F.col("source") == F.col("entity_id")).collect()}
    assert labels == {"docs/a.md": "§1, §2", "b.md": None} and ledger.violations().count() == 0
    with pytest.raises(formats.FormatError, match="evidence"):
        corpus.sync_decisions(ledger, with_evidence.replace("b.md]", "../out.md]"), root=str(root))


def test_command_line_follower_and_markers(spark, ledger, capsys):
    host = S.KnowledgeStore(S.Ledger(spark, ledger.path, ledger.now), hold=True)
    a, _ = host.propose_claim(S.text_claim("one"))
    assert cli.main(["reject", "--store", ledger.path, "--as", "Ada", "--why", "x", a], spark) == 1  # the host holds the lock
    host.close()
    b, _ = host.propose_claim(S.text_claim("two"))
    host.close()
    assert cli.main(["promote", "--store", ledger.path, "--as", "Ada", "--why", "measured", b], spark) == 0
    assert [(r["action"], r["rationale"]) for r in host.verdicts(b).collect()] == [(f"promote {b}", "measured")]  # the host follows
    capsys.readouterr()
    assert cli.main(["pending", "--store", ledger.path], spark) == 0 and capsys.readouterr().out == f"{a} queued\n"
    with pytest.raises(SystemExit):
        cli.main(["retire", "--store", ledger.path, "--as", "Ada", "--why", "x", "--reason", "bored", b], spark)
    last = json.loads(open(f"{ledger.path}/commits/{ledger.batches()[-1]}").read())
    assert last["seq"] == 2 and last["at"] is not None
    open(f"{ledger.path}/commits/{ledger.batches()[-1]}", "w").close()  # as markers were written before
    assert S.Ledger(spark, ledger.path).last() == last
    reader = S.Ledger(spark, ledger.path, read_only=True)
    with pytest.raises(S.Refused):
        reader.append([S.Draft(S.text_claim("x"), "Ada")])
    with pytest.raises(S.Refused):
        S.Ledger(spark, f"{ledger.path}-none", read_only=True)
    open(host.audit_path, "a").write("torn\n")
    assert host.audit(3).count() == 2 and host.audit_dropped == 1


def test_batches_are_judged_by_what_they_name(spark, ledger):
    events = lambda *e: journal.parse_events(spark.createDataFrame([(100 + i, json.dumps(x)) for i, x in enumerate(e)], "seq long, line string"), check=False)
    (p,) = ledger.upsert_entities([("process", "p")])
    a, b, g = ledger.append([S.Draft(S.text_claim("a", [p]), "A"), S.Draft(S.text_claim("b"), "A"), S.Draft(S.gap("g?"), "A")])
    S.Keeper(ledger, "A").promote(a)
    late, who = "2027-01-01T00:00:00Z", {"name": "A", "kind": "Human"}
    ok = [wire("R1", S.text_claim("c", [p]), late, supersedes=S.bare(b)), wire("V1", S.verdict("Answer", gap=g, with_claim=a), late, author=who)]
    assert ingest.violations_of(ledger, events(*ok)) == []
    bad = [wire("V2", S.verdict("Promote", target=a), late), wire("V3", S.verdict("Answer", gap=g, with_claim=b), late),
           wire("R2", S.text_claim("c", ["ent_" + "0" * 26]), late), wire("R3", S.text_claim("c"), late, supersedes=S.bare(g))]
    rules = {"illegal_transition", "unpromoted_answer", "dangling_ref", "supersedes_other_kind"}
    assert {v.split()[0] for v in ingest.violations_of(ledger, events(*bad))} == rules
    assert ingest.violations_of(ledger, events(wire("R4", S.text_claim("c"), "2020-01-01T00:00:00Z"))) == ["time_goes_back R4"]
    lines = spark.createDataFrame([(json.dumps(wire(f"R{i:03d}", S.text_claim("x"), f"2027-01-01T00:00:{i % 60:02d}Z")),) for i in range(200)], "line string")
    got = [(r["seq"], json.loads(r["line"])["recorded_at"]) for r in ingest.numbered(lines.repartition(5), 7).orderBy("seq").collect()]
    assert [n for n, _ in got] == list(range(7, 207)) and [t for _, t in got] == sorted(t for _, t in got)
    assert state.with_state(ledger.records, ledger.effects).count() == 3


def test_index_grows_with_the_log(spark, ledger, monkeypatch):
    from claimgraph.operators import lexical, vectors

    host = S.KnowledgeStore(ledger)
    a, b = ledger.append([S.Draft(S.text_claim("torque is 24 Nm"), "Ada"), S.Draft(S.text_claim("the seam is dry"), "Ada")])
    keeper = S.Keeper(ledger, "Ada")
    keeper.promote_set([a, b])
    top = lambda text: [r["record_id"] for r in host.search(text).items.where("position = 1").collect()]
    assert top("torque Nm") == [a] and len(host.index.state()["parts"]) == 1
    read = []
    monkeypatch.setattr(lexical.TextIndex, "__init__", lambda *x: read.append(x) or 1 / 0)
    assert top("dry seam") == [b] and not read and host.index.advance() == 0  # no text is read again
    monkeypatch.undo()
    (c,) = ledger.append([S.Draft(S.text_claim("glue cures overnight"), "Ada")])
    keeper.promote(c)
    assert top("glue cures") == [c] and len(host.index.state()["parts"]) == 2
    assert host.index.texts().lengths.count() == 3
    with pytest.raises(S.Refused, match="model"):
        S.KnowledgeStore(ledger, embedder=vectors.hashing_embedder(128)).search("glue")
    ledger.append([S.Draft(S.redaction(record=c, reason="asked to"), "Ada")])
    ledger.redact()
    host.search("glue cures")
    assert len(host.index.state()["parts"]) == 1 and "glue" not in {r["term"] for r in host.index.texts().postings().collect()}


def test_best_window_counts(spark):
    from claimgraph.operators import vectors

    df = spark.createDataFrame([("a", "weld " * 40 + "gauge drift " * 4), ("b", "  "), ("c", None), ("d", "x")], "record_id string, text string")
    e = vectors.hashing_embedder(window=8)
    rows = e.embedded(df)
    assert {r["record_id"]: r["count"] for r in rows.groupBy("record_id").count().collect()} == {"a": 6, "b": 1, "d": 1}
    q = spark.createDataFrame([(1, "gauge drift")], "query_id long, text string").select("query_id", e.query(F.col("text")).alias("vector"))
    best = vectors.exact_similar(rows.withColumnRenamed("record_id", "key"), q, 256).where("key = 'a'").collect()
    whole = vectors.exact_similar(vectors.hashing_embedder().embedded(df).withColumnRenamed("record_id", "key"), q, 256).where("key = 'a'").collect()
    assert len(best) == 1 and best[0]["similarity"] > 0.99 > whole[0]["similarity"]
