"""State, inbox, views and paths on small logs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimgraph import schema
from claimgraph.operators import graph, state, validate, views

T0 = datetime(2025, 1, 1)


def t(n):
    return T0 + timedelta(seconds=n)


def rec(seq, id_, at=None, **k):
    base = dict(
        seq=seq, record_id=id_, kind="claim", shape="text", author_name="n", author_kind="human", channel="c", reference=None,
        recorded_at=t(at if at is not None else seq), valid_from=t(at if at is not None else seq), valid_to=None, due_at=None, on_event=None,
        supersedes=None, text=id_, subject=None, attr_name=None, value_text=None, predicate=None, object_id=None, refs=[], evidence=[],
        redacted_by=None, version=1,
    )
    return base | k


def eff(seq, target, action, new_state, at=None, **k):
    return dict(seq=seq, ordinal=0, verdict_id=f"v{seq}", recorded_at=t(at if at is not None else seq), target_id=target, action=action,
                new_state=new_state, reason=None, basis=None, author_kind="human") | k


@pytest.fixture
def tables(spark):
    def make(records, effects=()):
        cols = [c.split()[0] for c in schema.RECORD.split(", ")]
        r = spark.createDataFrame([tuple(x[c] for c in cols) for x in records], schema.RECORD)
        cols = [c.split()[0] for c in schema.EFFECT.split(", ")]
        return r, spark.createDataFrame([tuple(x[c] for c in cols) for x in effects], schema.EFFECT)

    return make


def pairs(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_correction_chain(tables):
    r, e = tables(
        [rec(1, "A", 10), rec(3, "B", 30, supersedes="A"), rec(5, "C", 50, supersedes="B")],
        [eff(2, "A", "promote", "promoted", 20), eff(4, "B", "promote", "promoted", 40), eff(4, "A", "promote", "retired", 40, ordinal=1),
         eff(6, "C", "promote", "promoted", 60), eff(6, "B", "promote", "retired", 60, ordinal=1)],
    )
    at = lambda n: pairs(state.with_state(r, e, t(n)), "record_id", "state")
    assert at(9) == set()
    assert at(10) == {("A", "proposed")}
    assert at(30) == {("A", "promoted"), ("B", "proposed")}
    assert at(60) == pairs(state.with_state(r, e), "record_id", "state") == {("A", "retired"), ("B", "retired"), ("C", "promoted")}
    assert validate.illegal_transitions(r, e).count() == 0
    assert pairs(state.replaced_by(r), "record_id", "replacement") == {("A", "B"), ("B", "C")}


def test_inbox(tables):
    same = dict(text="same")
    r, e = tables(
        [rec(1, "first"), rec(2, "second", supersedes="first"), rec(3, "third", supersedes="second"), rec(4, "x", **same), rec(5, "y", **same),
         rec(6, "p", text="q"), rec(7, "q", text="q")],
        [eff(9, "p", "promote", "promoted")],
    )
    assert pairs(state.pending(r, e), "record_id", "queue", "head") == {
        ("first", "superseded", None), ("second", "superseded", None), ("third", "queued", None), ("x", "queued", None),
        ("y", "identical", "x"), ("q", "queued", None),
    }
    assert pairs(state.identical_groups(r), "record_id", "first_id", "twins") == {("x", "x", 2), ("y", "x", 2), ("p", "p", 2), ("q", "p", 2)}


def test_contradictions_then_and_now(tables):
    a = dict(shape="attribute", subject="s", attr_name="n")
    r, e = tables(
        [rec(1, "A", 10, **a), rec(2, "B", 30, **a), rec(3, "C", 30, valid_to=t(100), **a), rec(4, "D", 100, **a)],
        [eff(5, "A", "promote", "promoted", 20), eff(6, "B", "promote", "promoted", 40), eff(7, "A", "retire", "retired", 50),
         eff(8, "C", "promote", "promoted", 110), eff(9, "D", "promote", "promoted", 110)],
    )
    got = lambda n=None: pairs(state.contradictions(r, e, n and t(n)), "record_a", "record_b")
    assert got(20) == set() and got(40) == {("A", "B")}
    assert got() == {("B", "C"), ("B", "D")}


def test_review_ratification_panel(tables, spark):
    r, e = tables(
        [rec(1, "due", due_at=t(50)), rec(2, "bare"), rec(3, "event", on_event="x"), rec(4, "open")],
        [eff(n + 10, i, "promote", "promoted", basis=b) for n, (i, b) in enumerate([("due", None), ("bare", "OneAct"), ("event", "OneAct")])],
    )
    assert pairs(state.review_queue(r, e, t(60)), "record_id", "queue") == {("due", "due"), ("bare", "missing")}
    assert pairs(state.review_queue(r, e, t(40)), "record_id", "queue") == {("bare", "missing")}
    assert pairs(state.ratification(r, e), "basis", "n") == {("individually", 1), ("OneAct", 2)}
    m = spark.createDataFrame([(1, "x", "n", 0.92, t(9), "b"), (2, "x", "n", 0.95, t(1), "b")], schema.MEASUREMENT)
    assert pairs(state.panel(m), "value") == {(0.95,)}


def test_views(tables):
    a = dict(shape="attribute", subject="s", attr_name="n")
    r, e = tables(
        [rec(1, "A", value_text="1", **a), rec(2, "B", value_text="1", **a), rec(3, "P"), rec(4, "G", kind="gap", shape=None, refs=["s"]),
         rec(5, "V", valid_to=t(90)), rec(6, "Ag", author_kind="agent")],
        [eff(n + 20, i, "promote", "promoted") for n, i in enumerate(["A", "B", "V", "Ag"])] + [eff(40, "G", "answer", "answered", 40)],
    )
    ids = lambda **k: {x[0] for x in pairs(views.admitted(r, e, views.ViewSpec.at(t(100), **k)), "record_id")}
    assert ids() == {"A", "B", "Ag"}
    assert ids(states="promoted_and_proposed") == {"A", "B", "P", "Ag"}
    assert ids(states="all") == {"A", "B", "P", "G", "Ag"}
    assert ids(author_kind="agent") == {"Ag"}
    past = views.admitted(r, e, views.ViewSpec(t(30), t(50)))
    assert {x[0] for x in pairs(past, "record_id")} == {"A", "B", "V", "Ag", "G"}
    assert pairs(views.about(past), "entity_id", "record_id") == {("s", "G")}
    v = views.admitted(r, e, views.ViewSpec.at(t(100)))
    assert pairs(views.properties(v), "claims", "value", "conflicted") == {(2, "1", True)}
    assert pairs(views.unanimous_values(v), "value") == {("1",)}
    with pytest.raises(ValueError):
        views.admitted(r, e, views.ViewSpec.at(t(1), states="odd"))


def test_violations(tables, spark):
    r, e = tables(
        [rec(1, "A", 50), rec(2, "B", 40, supersedes="gone", refs=["e", "e"]), rec(3, "C", 60, valid_to=t(60), text=" "),
         rec(4, "D", 70, version=9, evidence=[("no", None)], redacted_by="x")],
        [eff(5, "A", "retire", "retired"), eff(6, "Z", "promote", "promoted", author_kind="agent")],
    )
    entities = spark.createDataFrame([("e", "line", "l", None)], schema.ENTITY)
    assert pairs(validate.violations(r, e, entities), "rule", "id") == {
        ("time_goes_back", "B"), ("dangling_supersedes", "B"), ("repeated_refs", "B"), ("empty_validity", "C"), ("blank_text", "C"),
        ("unknown_version", "D"), ("bad_evidence", "D"), ("unreceipted_redaction", "D"), ("illegal_transition", "A"),
        ("illegal_transition", "Z"), ("agent_verdict", "v6"),
    }


def edge_table(spark, rows):
    return spark.createDataFrame([(i, f"e{i}", a, "p", b) for i, (a, b) in enumerate(rows)], schema.EDGE)


def test_weighted_paths(spark):
    e = edge_table(spark, [("A", "B"), ("B", "C"), ("A", "C"), ("C", "A"), ("X", "Y")])
    panel = lambda ac: spark.createDataFrame([("e0", "s", 0.99), ("e1", "s", 0.99), ("e2", "s", ac)], "target string, name string, value double")
    src = spark.createDataFrame([("A",)], "source string")

    def path(ac, transform="neg_ln", default=None):
        costs = graph.edge_costs(e, panel(ac) if ac is not None else None, "s", transform, default)
        return {r["entity"]: r["path"] for r in graph.shortest_paths(costs, src).collect()}

    assert path(0.5)["C"] == ["e0", "e1"] and path(0.999)["C"] == ["e2"]
    assert path(None, "identity", 1.0)["C"] == ["e2"] and path(0.5)["A"] == [] and "Y" not in path(0.5)
    with pytest.raises(ValueError):
        path(2.0)
    costs = graph.edge_costs(e, panel(0.5), "s", "neg_ln", 0.0)
    wanted = spark.createDataFrame([("A", "C"), ("A", "Y")], "source string, target string")
    assert [r["path"] for r in graph.shortest_paths(costs, src, wanted).collect()] == [["e0", "e1"]]


def test_expansion(spark):
    e = edge_table(spark, [("t", "rail"), ("rail", "deep"), ("other", "t"), ("t", "t")])
    about = spark.createDataFrame([("rail", 1, "R1"), ("rail", 2, "R2"), ("other", 3, "O"), ("deep", 4, "D"), ("t", 5, "seed")],
                                  "entity_id string, seq long, record_id string")
    seeds = spark.createDataFrame([(1, 1, "seed", ["t"])], "query_id long, position int, record_id string, refs array<string>")
    got = lambda **k: [(r["record_id"], r["path"]) for r in graph.expand(seeds, e, about, **k).orderBy("n").collect()]
    assert got(hops=1) == [("R1", ["e0"]), ("R2", ["e0"]), ("O", ["e2"])]
    assert got(hops=2, direction="out") == [("R1", ["e0"]), ("R2", ["e0"]), ("D", ["e0", "e1"])]
    assert got(hops=1, direction="in") == [("O", ["e2"])] and got(hops=1, predicates=["q"]) == []
    with pytest.raises(ValueError):
        graph.adjacency(e, "up")


def test_empty_tables(tables, spark):
    r, e = tables([])
    for df in (state.with_state(r, e), state.pending(r, e), state.contradictions(r, e), state.ratification(r, e),
               views.admitted(r, e, views.ViewSpec.at(t(1))), validate.time_goes_back(r)):
        assert df.count() == 0
    assert views.is_stale(3, r) is False


def test_unnumbered_updates_have_a_place(spark, tables, tmp_path):
    from claimgraph.operators.changefeed import apply_changes, changes_of
    from claimgraph.plans import ledger

    ids = {c: f"rec_{c * 26}" for c in "ABCDEF"}
    row = lambda c, seq, at, v, action, state=None, op="update": (
        seq, op, ids[c].lower() if at is not None and at % 2 else ids[c], v and f"rec_{v:0>26}", f"{action} {ids[c]}", state, None if at is None else t(at), "human",
    )
    feed = [
        row("A", None, 5, "V1", "promote"), row("A", None, 5, "V1", "promote", "promoted"),  # never numbered, twice
        row("B", 2, 1, "V2", "promote"), row("B", None, 9, "V3", "retire"),  # after the numbered
        row("C", 3, 9, "V4", "retire"), row("C", None, 1, "V5", "promote"),  # before
        row("D", 4, 4, "V6", "promote"), row("D", None, 4, "V6", "promote"), row("D", 6, 8, "V7", "retire"),  # copy of a numbered
        row("E", 7, 3, "V8", "promote"), row("E", None, 3, "V9", "retire"), row("E", 8, 6, "VA", "reject"),  # between, at one instant
        row("F", None, 2, "VB", "promote"), row("F", None, 7, "VC", "retire"), row("F", None, None, "VD", "reject"),  # none is numbered
    ]
    kinds = "log_seq long, op string, record_id string, verdict_id string, action string, state string, verdict_at timestamp, author_kind string"
    spark.createDataFrame(feed, kinds).write.parquet(f"{tmp_path}/verdict_feed.parquet")
    e = ledger.effects(spark, str(tmp_path)).cache()
    assert set(e.columns) == {c.split()[0] for c in schema.EFFECT.split(", ")}
    steps = {}
    for r in state.history(e).orderBy("record_id", "n").collect():
        steps.setdefault(r["record_id"][-1], []).append((r["seq"], r["new_state"]))
    assert steps == {
        "A": [(None, "promoted")], "B": [(2, "promoted"), (2, "retired")], "C": [(None, "promoted"), (3, "retired")],
        "D": [(4, "promoted"), (6, "retired")], "E": [(7, "promoted"), (7, "retired"), (8, "rejected")],
        "F": [(None, "rejected"), (None, "promoted"), (None, "retired")],
    }
    r, _ = tables([rec(i, x) for i, x in enumerate(ids.values())])
    now = {x["record_id"]: x["state"] for x in state.with_state(r, e).collect()}
    base = r.select(F.col("record_id").alias("key"), F.lit("proposed").alias("state"))
    fed = changes_of(spark.read.parquet(f"{tmp_path}/verdict_feed.parquet"))
    assert now == {x["key"]: x["state"] for x in apply_changes(fed, base).collect()}
