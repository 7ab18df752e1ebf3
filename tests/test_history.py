"""Hierarchies and change feeds against brute force and on awkward tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimgraph.operators import hierarchy as H
from claimgraph.operators.changefeed import action_state, apply_changes

EDGES = "id string, up string"


def trees(spark, rows, schema=EDGES):
    df = spark.createDataFrame(rows, schema)
    return {r["node"]: r for r in H.hierarchy(df, F.col("id"), F.col("up")).collect()}


def test_paths_and_depths(spark):
    t = trees(spark, [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", "gone")])
    assert t["c"]["path"] == ["a", "b", "c"] and t["c"]["depth"] == 2 and t["c"]["root"] == "a"
    assert t["e"]["depth"] == 0 and t["e"]["parent"] is None


def test_cycles_and_what_hangs_on_them(spark):
    t = trees(spark, [("b", "c"), ("c", "b"), ("x", "c"), ("y", "x"), ("s", "s"), ("r", None)])
    assert {k: (v["root"], v["depth"]) for k, v in t.items()} == {
        "b": ("b", -1), "c": ("b", -1), "x": ("b", -1), "y": ("b", -1), "s": ("s", -1), "r": ("r", 0)
    }
    assert {k for k, v in t.items() if v["on_cycle"]} == {"b", "c", "s"}
    # a tail below a cycle may have smaller ids than the cycle
    t = trees(spark, [("m", "n"), ("n", "m"), ("a", "m")])
    assert t["a"]["root"] == "m"


def test_nulls_repeats_empty_and_clashing_columns(spark):
    t = trees(spark, [("a", None), ("a", None), (None, "a"), ("b", "z"), ("b", "a")])
    assert set(t) == {"a", "b"} and t["b"]["parent"] == "a"
    assert trees(spark, []) == {}
    df = spark.createDataFrame([("a", None, 1, "p"), ("b", "a", 2, "q")], "id string, up string, depth int, node string")
    assert H.hierarchy(df, F.col("id"), F.col("up")).count() == 2


def test_random_forest_and_hub(spark):
    r = random.Random(3)
    ids = [f"n{i:04d}" for i in range(400)]
    up = {n: (r.choice(ids) if r.random() < 0.5 else None) for n in ids} | {f"h{i}": "n0001" for i in range(200)}
    up |= {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(60)}

    def walk(n):
        way = [n]
        while up.get(way[-1]) in up:
            nxt = up[way[-1]]
            if nxt in way:
                return min(way[way.index(nxt):]), -1
            way.append(nxt)
        return way[-1], len(way) - 1

    t = trees(spark, list(up.items()))
    assert {k: (v["root"], v["depth"]) for k, v in t.items()} == {n: walk(n) for n in up}
    pairs = H.descendants(H.hierarchy(spark.createDataFrame(list(up.items()), EDGES), F.col("id"), F.col("up"))).collect()
    assert len(pairs) == sum(max(d, 0) for _, d in map(walk, up))
    assert all(p["distance"] >= 1 for p in pairs)


CHANGE = "key string, op string, state string, at timestamp, seq long, change string"
T0 = datetime(2020, 1, 1)


def held(spark, rows, base=None, span=3600):
    c = spark.createDataFrame(rows, CHANGE)
    b = spark.createDataFrame(base, "key string, state string") if base is not None else None
    return {r["key"]: r["state"] for r in apply_changes(c, b, span).collect()}


def at(h):
    return T0 + timedelta(hours=h)


def test_order_repeats_and_presence(spark):
    rows = [
        ("a", "update", "x", at(2), 5, "v"), ("a", "insert", "new", at(1), 1, ""), ("a", "insert", "new", at(1), 1, ""),
        ("b", "update", "x", at(1), 2, "w"), ("c", "insert", "p", at(1), 3, ""), ("c", "delete", None, at(30), 4, "d"),
        ("c", "update", "q", at(31), 6, "e"), ("d", "insert", "1", at(1), 7, ""), ("d", "update", None, at(2), 8, "f"),
        ("e", "insert", None, at(1), 9, ""), (None, "insert", "x", at(1), 10, ""), ("g", "vacuum", "x", at(1), 11, ""),
    ]
    assert held(spark, rows) == {"a": "x", "d": "1", "e": ""}


def test_same_instant_and_missing_numbers(spark):
    rows = [
        ("a", "update", "y", at(1), 9, "v"), ("a", "insert", "new", at(1), 8, ""), ("a", "update", "y", at(1), None, "v"),
        ("a", "update", "z", at(1), 10, "w"), ("b", "insert", "n", at(1), None, ""), ("b", "update", "u", at(1), 3, "q"),
        ("c", "insert", "n", None, 2, ""), ("c", "update", "m", at(0), 1, "r"),
    ]
    assert held(spark, rows) == {"a": "z", "b": "u", "c": "m"}


def test_base_and_empty(spark):
    assert held(spark, [], [("a", "old"), (None, "x")]) == {"a": "old"}
    assert held(spark, []) == {}
    rows = [("a", "update", "new", at(100), 1, "v"), ("b", "delete", None, at(1), 2, "w"), ("c", "update", "x", at(1), 3, "u")]
    assert held(spark, rows, [("a", "old"), ("b", "old")]) == {"a": "new"}


def test_random_feed_over_many_spans(spark):
    r = random.Random(5)
    rows = []
    for n in range(1500):
        key = "hot" if r.random() < 0.4 else f"k{r.randrange(60)}"
        op = r.choice(["insert", "update", "update", "delete"])
        state = None if op == "delete" or r.random() < 0.2 and op == "update" else r.choice("xyz")
        rows.append((key, op, state, at(r.randrange(60)), n, f"c{n}" if op != "insert" else ""))
    want = {}
    for key, op, state, *_ in sorted(rows, key=lambda x: (x[3], x[4])):
        if op == "insert":
            want[key] = state
        elif op == "delete":
            want.pop(key, None)
        elif key in want and state is not None:
            want[key] = state
    sent = rows + r.sample(rows, 200)
    r.shuffle(sent)
    assert held(spark, sent) == want


def test_actions_tell_states(spark):
    a, b = "rec_" + "0" * 25 + "A", "rec_" + "0" * 25 + "B"
    rows = [(f"promote {a} (retiring {b.lower()})", a), (f"Promote {a} (retiring {b})", b), (f"score {a} Met", a), ("odd", a), (None, a)]
    df = spark.createDataFrame(rows, "action string, id string")
    got = [r[0] for r in df.select(action_state(F.col("action"), F.col("id"))).collect()]
    assert got == ["promoted", "retired", "scored", None, None]


def test_clashing_columns(spark):
    c = spark.createDataFrame([("a", "insert", "s", at(1), 1, "", 5, "m")], CHANGE + ", span int, member string")
    assert apply_changes(c).collect() == [("a", "s")]


@pytest.mark.parametrize("rows", [[("a", "update", "x" * 200_000, at(1), 1, "v"), ("a", "insert", "s", at(0), 0, "")]])
def test_long_values(spark, rows):
    assert held(spark, rows)["a"] == "x" * 200_000
