"""Tokens, the index, rankings, fusion, titles, budget and outcomes."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from claimgraph.functions.text import fold_py, tokens
from claimgraph.operators import lexical, retrieve, vectors


def test_fold_and_tokens(spark):
    same = {"keys": "key", "verdicts": "verdict", "queries": "query", "classes": "class", "does": "doe"}
    same |= {w: w for w in ("class", "status", "this", "is", "as")}
    assert {w: fold_py(w) for w in same} == same
    rows = [("Keys of the Straße, naïve 12½ QUERIES-classes_x",), ("",), (None,), ("ÄS",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tokens(F.col("t"))).collect()]
    assert got == [["key", "of", "the", "straße", "naïve", "12½", "query", "class", "x"], [], None, ["äs" if len("äs".encode()) <= 3 else "ä"]]


DOC = "record_id string, seq long, text string, refs array<string>, kind string, shape string, attr_name string, subject string"


def docs(spark, rows):
    full = [dict(refs=[], kind="claim", shape="text", attr_name=None, subject=None) | r | {"seq": i} for i, r in enumerate(rows)]
    names = [c.split()[0] for c in DOC.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in full], DOC)


def ask(spark, rows, text, admitted=None, scope=None, similar=(), passage=None, **options):
    d = docs(spark, rows)
    q = spark.createDataFrame([(1, text)], "query_id long, text string")
    seen = d if admitted is None else d.where(F.col("record_id").isin(admitted))
    s = spark.createDataFrame([(1, e) for e in scope], "query_id long, entity_id string") if scope else None
    c = lexical.search(lexical.TextIndex(d, passage), q, seen, s)
    sim = spark.createDataFrame([(1, i, x) for i, x in similar], "query_id long, record_id string, similarity double")
    return c, retrieve.retrieve(c, sim, d, retrieve.Options(**options))


def listed(answers):
    return [r["record_id"] for r in answers.items.orderBy("position").collect()]


def outcome(answers):
    return answers.outcomes.collect()[0]


def rows_of(*texts, **more):
    return [dict(record_id=f"r{i}", text=x) | more for i, x in enumerate(texts)]


def test_scores_against_plain_python(spark):
    r = random.Random(1)
    words = "torque rail weld sensor drawing batch limit gauge".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 20))) for _ in range(9)]
    c, _ = ask(spark, rows_of(*texts), "torque of the rail zzzz")
    got = {x["record_id"]: (x["score"], x["coverage"]) for x in c.ranked.collect()}
    toks = [t.split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    idf = {w: np.log((n - df + 0.5) / (df + 0.5) + 1) for w in ("torque", "rail", "zzzz") for df in [sum(w in t for t in toks)]}
    want = {}
    for i, t in enumerate(toks):
        hit = [w for w in ("rail", "torque") if w in t]
        if hit:
            s = sum(idf[w] * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in hit)
            want[f"r{i}"] = (s, sum(idf[w] for w in hit) / sum(idf.values()))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    q = c.queries.collect()[0]
    assert q["unknown"] == ["zzzz"] and np.isclose(q["known"], 1 - idf["zzzz"] / sum(idf.values()))


def test_near_terms(spark):
    freq = spark.createDataFrame([(w, 1) for w in "license color organize stone store write promoted ledgers class".split()], "term string, df long")
    asked = spark.createDataFrame([(w,) for w in "licence colour organise stole writer promote ledger clas".split()], "asked string")
    got = {(r["asked"], r["read"]) for r in lexical.near_terms(asked, freq).collect()}
    assert got == {("licence", "license"), ("colour", "color"), ("organise", "organize")}


def test_abstention_and_shadow(spark):
    rows = rows_of("alpha beta gamma", "delta")
    _, a = ask(spark, rows, "alpha beta", admitted=["r1"])
    o = outcome(a)
    assert o["outcome"] == "none" and o["tags"] == ["none", "beyond_view"]
    assert [(b["record_id"], b["count"]) for b in a.beyond.collect()] == [("r0", 1)]
    assert outcome(ask(spark, rows, "alpha beta")[1])["outcome"] == "matches"
    assert outcome(ask(spark, rows, "alpha beta", min_score=1000.0)[1])["outcome"] == "weak_matches"
    assert outcome(ask(spark, rows, "the of")[1])["known"] == 0.0
    assert outcome(ask(spark, [], "alpha")[1])["outcome"] == "none"
    assert outcome(ask(spark, rows, "")[1])["outcome"] == "none"


def test_pruning_scope_passages(spark):
    rows = rows_of(*["common word"] * 9, "common rare")
    c, _ = ask(spark, rows, "common rare")
    assert [r["record_id"] for r in c.ranked.collect()] == ["r9"]
    rows = [dict(record_id="a", text="torque", refs=["x"]), dict(record_id="b", text="torque", refs=["y"]), dict(record_id="c", text="torque")]
    assert listed(ask(spark, rows, "torque", scope=["y"])[1]) == ["b"]
    long = [dict(record_id="l", text="a1 " * 30 + "torque"), dict(record_id="s", text="torque b1"), dict(record_id="n", text=None)]
    c, _ = ask(spark, long, "torque", passage=10)
    assert {r["record_id"] for r in c.ranked.collect()} == {"l", "s"}


def test_fusion_prefers_first_place_at_zero(spark):
    lex = spark.createDataFrame([(1, "champ", 1, 9.0), (1, "mid", 2, 4.0), (1, "third", 3, 3.9)], "query_id long, record_id string, rank int, score double")
    vec = spark.createDataFrame([(1, "third", 1, 0.6), (1, "mid", 2, 0.55)], "query_id long, record_id string, rank int, similarity double")
    order = lambda k: [r["record_id"] for r in retrieve.fuse(lex, vec, k).orderBy("fused_rank").collect()]
    assert order(0.0).index("champ") < order(0.0).index("mid") and order(60.0).index("mid") < order(60.0).index("champ")
    assert order(None)[0] in ("third", "mid")


def test_titles(spark):
    title = dict(record_id="t", text="title weld", shape="attribute", attr_name="title", subject="e", refs=["e"])
    body = dict(record_id="b", text="weld and much more besides to be longer", refs=["e"])
    other = dict(record_id="o", text="weld else", refs=["z"])
    assert listed(ask(spark, [title, body, other], "weld")[1])[0] == "b"
    assert sorted(listed(ask(spark, [title, body, other], "weld")[1])) == ["b", "o"]
    assert sorted(listed(ask(spark, [title, body], "weld", titles="keep")[1])) == ["b", "t"]
    assert listed(ask(spark, [title], "weld")[1]) == ["t"]
    rows = pd.DataFrame({"query_id": 1, "record_id": ["t", "x", "b"], "title": ["e", None, None], "refs": [["e"], ["q"], ["e"]], "fused_rank": [1, 2, 3]})
    moves = retrieve.title_moves(rows, True).set_index("record_id")["slot"]
    assert pd.isna(moves["t"]) and moves["b"] == 1 and moves["x"] == 2
    assert retrieve.title_moves(rows, False).set_index("record_id")["slot"]["t"] == 1


def test_gaps_and_uncovered(spark):
    g = dict(record_id="g", text="how does torque rail", kind="gap", shape=None)
    rows = [g, dict(record_id="a", text="torque"), dict(record_id="v", text="quite else")]
    _, a = ask(spark, rows, "torque rail", similar=[("v", 0.9), ("a", 0.2)])
    assert listed(a) == ["a"] and [r["record_id"] for r in a.gaps.collect()] == ["g"] and "registered_gap" in outcome(a)["tags"]
    _, a = ask(spark, rows, "unheard", similar=[("v", 0.9)])
    assert listed(a) == ["v"] and a.items.collect()[0]["via"] == "vector"
    _, a = ask(spark, rows, "torque rail", similar=[("v", 0.9)], drop_uncovered=False)
    assert set(listed(a)) == {"a", "v"}


def test_budget_and_excerpts(spark):
    _, a = ask(spark, rows_of(*["torque one"] * 8), "torque", k=3)
    assert len(listed(a)) == 3 and outcome(a)["truncated"] == 5
    long = " ".join(["filler"] * 500 + ["torque", "rail"] + ["filler"] * 500)
    _, a = ask(spark, rows_of(long, "torque"), "torque rail", k=10, max_tokens=100)
    cut = {r["record_id"]: r["excerpt"] for r in a.items.collect()}
    assert "torque rail" in cut["r0"] and cut["r0"].startswith("… ") and cut["r0"].endswith(" …") and cut["r1"] is None
    assert retrieve.best_window("a b c", {"c"}, 5) == "a b c" and retrieve.best_window("a b c d", {"d"}, 2) == "… c d"
    costs = [3, 5, 4, 1]
    d = spark.createDataFrame([(1, f"r{i}", i + 1) for i in range(4)], "query_id long, record_id string, position int")
    texts = spark.createDataFrame([(f"r{i}", "w " * c) for i, c in enumerate(costs)], "record_id string, text string")
    terms = spark.createDataFrame([], "query_id long, terms array<string>")
    assert retrieve.apply_budget(d, texts, terms, 2, 8).count() == 2
    assert [r["sentence"][:7] for r in retrieve.why(a).collect()] == ["outcome"]


def test_hash_embedding(spark):
    rows = [("weld the Rail",), ("weld the rail",), ("",), (None,), ("ÄB",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(vectors.hash_embed(F.col("t"), 256)).collect()]
    assert np.allclose(got[0], got[1]) and np.isclose(np.linalg.norm(got[0]), 1) and not any(got[2]) and got[3] is None
    # with an even number of slots, a slot tells the sign of its features
    assert all((v > 0) == (i % 2 == 1) for i, v in enumerate(got[0]) if v)
    assert vectors.fnv1a(b"a") == 0xAF63DC4C8601EC8C and vectors.model_id() == "hashing-char3-4-d256"
    assert "w:ÄB".replace("B", "b") in vectors.word_features("ÄB")


def test_exact_and_bucketed_neighbours(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 16))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [0.0] * 16), (903, [float("nan")] * 16)],
                              "key long, vector array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "query_id long, vector array<double>")
    got = vectors.exact_similar(d, q, 16, 4, above=-2).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(5):
        want = np.argsort(-(u @ u[i]))[:4]
        assert {r["key"] for r in got if r["query_id"] == i} == set(want)
    near = vectors.SignBuckets(16, 8, 6).similar(d.where("key < 900"), q, 4, 200).collect()
    hits = sum((r["query_id"], r["key"]) in {(g["query_id"], g["key"]) for g in got} for r in near)
    assert hits >= 15


def test_bucketed_neighbours_widen_to_all_bits(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [0.0] * 16), (903, [float("nan")] * 16)]
    d = spark.createDataFrame(rows, "key long, vector array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)] + [(99, None)], "query_id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {(i, int(j)) for i in range(20) for j in np.argsort(-(u @ u[i]))[:5]}
    pairs = lambda df: {(g["query_id"], g["key"]) for g in df.collect()}
    index = vectors.SignBuckets(16)
    # who wants more than there are meets all that can be compared, and so the exact answer
    assert index.candidates(d, q, 1000).count() == 20 * 400
    assert pairs(index.similar(d, q, 5, 1000)) == best
    # each question meets as many as it wants, and what it wants can be measured
    assert all(g["count"] >= 150 for g in index.candidates(d, q, 150).groupBy("query_id").count().collect())
    got = pairs(index.similar(d, q, 5, 10, recall=0.9))
    assert len(got & best) >= 90
    assert index.want_for(d, q, 5, 0.5) < index.want_for(d, q, 5, 1.0) <= 400
    assert index.similar(d.where("key < 0"), q, 5, recall=0.9).count() == 0
