"""Documents synced into a store, twice and changed."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimgraph import store as S
from claimgraph.operators import keeper, state
from claimgraph.sources import corpus, formats
from tests.test_sources import DOC

REG = "*Owner: Ada.*\n| U-1 | how hot? | later | |\n| U-2 | ~~who~~ **Resolved 2025-01-02** by D-0001 | x | |\n| U-3 | ~~x~~ **Resolved** | x | |\n"


@pytest.fixture
def ledger(spark, tmp_path):
    t = iter(datetime(2026, 1, 1, tzinfo=UTC) + timedelta(seconds=n) for n in range(10_000))
    return S.Ledger(spark, str(tmp_path / "s"), lambda: next(t))


def told(led):
    rows = state.with_state(led.records, led.effects).select("state", F.regexp_extract("reference", "#(\\S+)", 1).alias("key"), "seq")
    return {r["key"]: r["state"] for r in rows.orderBy("seq").collect()}


def test_decisions_and_register(ledger):
    first = corpus.sync_decisions(ledger, DOC)
    assert first.dispositions == {"D-0001": "fresh", "H-0002": "fresh"} and first.dangling == ["D-0002"]
    assert told(ledger) == {"D-0001": "promoted", "D-0001/title": "promoted", "H-0002": "registered"}
    reg = corpus.sync_register(ledger, REG)
    assert reg.written == 5 and told(ledger) | {"U-1": "registered", "U-2": "answered", "U-3": "withdrawn"} == told(ledger)
    assert corpus.sync_decisions(ledger, DOC).written == 0 and corpus.sync_register(ledger, REG).written == 0
    changed = corpus.sync_decisions(ledger, DOC.replace("seam twice", "seam thrice").replace("Heat is", "Much heat is"))
    assert set(changed.dispositions.values()) == {"changed"}
    states = sorted(r["state"] for r in state.with_state(ledger.records, ledger.effects).where("kind = 'hypothesis'").collect())
    assert states == ["abandoned", "registered"] and told(ledger)["D-0001"] == "promoted"
    reg = corpus.sync_register(ledger, REG.replace("how hot?", "how warm?").replace("~~who~~", "~~whom~~").replace("| U-3 | ~~x~~ **Resolved** | x | |\n", ""))
    assert reg.drifted == ["U-2"] and reg.absent == ["U-3"] and told(ledger)["U-1"] == "registered"
    assert ledger.violations().count() == 0
    anchors = keeper.anchors(ledger.records, ledger.entities)
    assert {"D-0001", "U-1"} <= {r["anchor"] for r in anchors.collect()}
    with pytest.raises(formats.FormatError):
        corpus.sync_register(ledger, "| U-1 | a |\n")


def test_policy_withholds_verdicts(ledger):
    corpus.sync_decisions(ledger, DOC, admits=lambda key: False)
    assert told(ledger)["D-0001"] == "proposed"


def pep(n, status, *more):
    return "\n".join([f"PEP: {n}", f"Title: T{n}", "Author: A", f"Status: {status}", "Type: P", *more, "", f"body {n}", ""])


def test_proposals(ledger):
    texts = [pep(1, "Superseded", "Superseded-By: 2"), pep(2, "Final", "Replaces: 1", "Requires: 3, 9"), pep(3, "Draft"), pep(4, "Rejected"), pep(5, "Provisional")]
    r = corpus.sync_proposals(ledger, texts)
    assert r.dangling == ["PEP-0009"]
    got = told(ledger)
    assert [got[f"PEP-000{i}"] for i in range(1, 6)] == ["retired", "promoted", "proposed", "rejected", "promoted"]
    assert got["PEP-0002/requires-3"] == "proposed" and got["PEP-0001/title"] == "proposed"
    assert corpus.sync_proposals(ledger, texts).written == 0 and ledger.violations().count() == 0
