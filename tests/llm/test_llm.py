"""Operators for training data against brute force, and on awkward tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgraph.llm import leakage, mixture, neighbours, reading, split, terms

# ── 1 splitting ──

PLANS = "plan_id int, window_tokens int, overlap_tokens int"


def pieces(spark, texts, plans, **k):
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "key string, text string")
    return split.split(df, F.col("key"), F.col("text"), spark.createDataFrame(plans, PLANS), **k).collect()


def test_pieces_cover_and_overlap(spark):
    r = random.Random(1)
    words = "weld rail torque sensor batch limit drawing gauge".split()
    texts = [" ".join(r.choice(words) + ("." if r.random() < 0.1 else "\n" if r.random() < 0.05 else "") for _ in range(n)) for n in (1, 19, 20, 21, 333)]
    texts += ["x" * 50_000, "one\u00a0two\u2028three \x1c four " * 20]
    plans = [(1, 20, 5), (2, 20, 0), (3, None, 0), (4, 7, 6), (5, 1, None)]
    got = pieces(spark, texts, plans)
    for i, t in enumerate(texts):
        n = len(split.TOKEN.findall(t))
        for plan, limit, overlap in plans:
            mine = sorted([p for p in got if p["key"] == f"k{i}" and p["plan_id"] == plan], key=lambda p: p["piece"])
            assert mine[0]["first_token"] == 0 and mine[-1]["end_token"] == n and len(mine) == mine[0]["pieces"]
            assert all(b["first_token"] == a["end_token"] - (overlap or 0) and b["end_token"] > a["end_token"] for a, b in zip(mine, mine[1:]))
            assert limit is None or all(p["end_token"] - p["first_token"] <= limit for p in mine)
            spans = [m.span() for m in split.TOKEN.finditer(t)]
            assert all(t[p["first_char"]:p["end_char"]] == t[spans[p["first_token"]][0]:spans[p["end_token"] - 1][1]] for p in mine)
    only = pieces(spark, texts, plans, oversized_only=True)
    assert {(p["plan_id"], p["key"]) for p in only} == {(p["plan_id"], p["key"]) for p in got if p["pieces"] > 1}


def test_cuts_at_the_change_of_topic():
    a, b = "the weld seam holds the weld seam here.", "a fish swims past a fish that sleeps."
    text = " ".join([a] * 4 + [b] * 4)
    assert split.cuts(split.Text(text), 50, 0)[0] == (0, 32)
    assert split.cuts(split.Text("word " * 30), 10, 2)[0][1] <= 10  # nowhere to pause


def test_splitting_awkward_rows(spark):
    assert pieces(spark, [None, "", " \n "], [(1, 5, 1)]) == [] and pieces(spark, [], [(1, 5, 1)]) == [] and pieces(spark, ["a b"], []) == []
    df = spark.createDataFrame([(None, "a b c", 1), ("k", "a b c", 2), ("k", "a b c", 2)], "key string, text string, piece int")
    got = split.split(df, F.col("key"), F.col("text"), spark.createDataFrame([(1, 2, 0)], PLANS)).collect()
    assert len(got) == 6 and {g["key"] for g in got} == {None, "k"}
    for bad in ((1, 0, 0), (1, 5, 5), (1, 5, -1)):
        with pytest.raises(ValueError):
            pieces(spark, ["a"], [bad])


# ── 3 distinctive terms ──

ITEM = "place string, item_key string, text string"


def test_terms_against_plain_em(spark):
    r = random.Random(2)
    vocabulary = ["weld", "rails", "torque", "sensor", "batch", "rare", "x1yz", "abc"]
    items = [(p, f"i{k}", " ".join(r.choices(vocabulary, [9, 8, 7, 3, 2, 1, 1, 1], k=r.randrange(1, 60)))) for p in "ab" for k in range(25)]
    got = {(x["place"], x["item_key"], x["term"]): x for x in terms.distinctive_terms(spark.createDataFrame(items, ITEM)).collect()}
    fold = {"rails": "rail"}
    counts = {}
    for p, k, t in items:
        for w in t.split():
            if re.fullmatch("[a-z]{4,}", fold.get(w, w)):
                counts.setdefault((p, k), {}).setdefault(fold.get(w, w), 0)
                counts[p, k][fold.get(w, w)] += 1
    assert set(got) == {(p, k, w) for (p, k), c in counts.items() for w in c}
    for (p, k), c in counts.items():
        cf = {w: sum(d.get(w, 0) for (q, _), d in counts.items() if q == p) for w in c}
        total = sum(n for (q, _), d in counts.items() if q == p for n in d.values())
        prob = {w: n / sum(c.values()) for w, n in c.items()}
        moved = 1.0
        while moved > terms.TOLERANCE / 100:  # to the fixed point, however many rounds
            e = {w: c[w] * 0.1 * prob[w] / (0.9 * cf[w] / total + 0.1 * prob[w]) for w in c}
            old, prob = prob, {w: e[w] / sum(e.values()) for w in c}
            moved = max(abs(prob[w] - old[w]) for w in c)
        for w in c:
            x = got[p, k, w]
            assert x["tf"] == c[w] and x["df"] == sum(w in d for (q, _), d in counts.items() if q == p)
            assert abs(x["weight"] - prob[w]) < 2e-3


def test_terms_awkward_rows(spark):
    rows = [("a", "1", None), ("a", None, "word word"), (None, "2", "word"), ("a", "3", ""), ("a", "4", "ab 12"), ("a", "5", "Words word " * 30_000), ("a", "5", "Words word " * 30_000)]
    got = terms.distinctive_terms(spark.createDataFrame([(*r, 7) for r in rows], ITEM + ", tf int")).collect()
    assert [(g["item_key"], g["term"], g["tf"], g["df"]) for g in got] == [("5", "word", 60_000, 1)]
    assert terms.distinctive_terms(spark.createDataFrame([], ITEM)).count() == 0
    tie = terms.distinctive_terms(spark.createDataFrame([("a", "1", "beta alpha")], ITEM))
    assert [(r["rank"], r["term"]) for r in terms.top_terms(tie, 5).orderBy("rank").collect()] == [(1, "alpha"), (2, "beta")]


def test_item_of_a_batch_converges_for_itself():
    tf, bg = np.array([3.0, 1, 5, 2, 2]), np.array([0.1, 0.2, 0.01, 0.3, 0.05])
    both = terms.converge(tf, bg, np.array([0, 2]))
    assert np.array_equal(both[:2], terms.converge(tf[:2], bg[:2], np.array([0]))) and np.array_equal(both[2:], terms.converge(tf[2:], bg[2:], np.array([0])))


# ── 5 neighbours ──


def vector_rows(spark, rows):
    df = spark.createDataFrame(rows, "key string, model string, vectors array<array<float>>, h1 int")
    return neighbours.exploded(df, F.col("key"), F.col("model"), F.col("vectors"))


def brute(rows, threshold):
    flat = [(k, m, np.array(v, float)) for k, m, vs, _ in rows if k and m and vs for v in vs if v is not None and None not in v]
    flat = [(k, (m, len(v)), v / np.linalg.norm(v)) for k, m, v in flat if np.isfinite(v).all() and np.linalg.norm(v) > 0]
    out = set()
    for i, (k, m, v) in enumerate(flat):
        out |= {(min(k, q), max(k, q)) for q, n, w in flat[:i] if n == m and q != k and v @ w >= threshold}
    return out


def test_similar_pairs_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PARTITION", 60)
    monkeypatch.setattr(neighbours, "TILE", 64)
    r = np.random.default_rng(4)
    rows = []
    for i in range(600):
        v = r.standard_normal(24)
        rows.append((f"k{i:04d}", "m", [v.tolist()], 1))
        if i % 5 == 0:
            rows.append((f"t{i:04d}", "m", [(3 * v + 0.5 * r.standard_normal(24)).tolist(), r.standard_normal(24).tolist()], 1))
    rows += [(f"copy{i:03d}", "m", [[1.0] * 24], 1) for i in range(70)] + [("far", "other", [[1.0] * 24], 1), ("short", "m", [[1.0] * 23], 1)]
    rows += [("z", "m", [[0.0] * 24], 1), ("n", "m", [[float("nan")] * 24], 1), ("i", "m", [[float("inf")] * 24], 1), ("e", "m", [], 1), ("u", "m", None, 1),
             (None, "m", [[1.0] * 24], 1), ("nn", None, [[1.0] * 24], 1), ("q", "m", [None, [None] * 24], 1), rows[0]]
    index = neighbours.Index(vector_rows(spark, rows), threshold=0.9)
    assert len(index.routers["m#24"].weights) > 4
    got = {(p["key_a"], p["key_b"]) for p in neighbours.similar_keys(index, 0.9).collect()}
    want = brute(rows, 0.9)
    assert not got - want and len(want - got) <= 0.005 * len(want)
    classes = neighbours.similar_classes(index, 0.9)
    assert classes.count() == classes.dropDuplicates(["a1", "a2", "b1", "b2"]).count()


def test_nearest_recall_and_empty(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PARTITION", 100)
    r = np.random.default_rng(5)
    x = r.standard_normal((800, 12)) + 2 * r.standard_normal((20, 12))[r.integers(0, 20, 800)]
    rows = vector_rows(spark, [(f"k{i}", "m", [v.tolist()], 0) for i, v in enumerate(x)])
    index = neighbours.Index(rows, queries=rows.where(F.crc32("key") % 10 == 0))
    near = neighbours.nearest(index, 10).collect()
    keys = {(m["h1"], m["h2"]): m["key"] for m in index.members.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in {(n["h1"], n["h2"]) for n in near}:
        i = int(keys[q][1:])
        best = {f"k{j}" for j in [j for j in np.argsort(-(u @ u[i])) if j != i][:10]}
        hits += len(best & {n["near_key"] for n in near if (n["h1"], n["h2"]) == q})
        total += 10
    assert hits / total >= 0.9
    assert neighbours.similar_keys(neighbours.Index(vector_rows(spark, []), threshold=0.9), 0.9).count() == 0
    one = neighbours.Index(vector_rows(spark, [("a", "m", [[1.0, 2.0]], 0), ("b", "m", [[1.0, 2.0]], 0)]))
    assert [(n["near_key"], n["near_keys"], round(n["cosine"], 6)) for n in neighbours.nearest(one, 3).collect()] == [("a", 2, 1.0)]


def test_partitions_are_balanced():
    x = np.random.default_rng(1).standard_normal((500, 8))
    part = neighbours.balanced_partition(neighbours.neighbour_graph(x, 5), 3)
    assert np.ptp(np.bincount(part)) <= 8 and len(set(part)) == 8


# ── 6 leakage ──


def test_runs_against_brute_force(spark):
    r = random.Random(6)
    voc = [f"w{c}" for c in "abcdefgh"]
    items = [(str(i), f, " ".join(r.choices(voc, k=r.randrange(2, 16)))) for i in range(25) for f in ("question", "expect")]
    docs = [(str(d), " ".join(r.choices([*voc, "other"], k=r.randrange(0, 80)))) for d in range(120)]
    d = spark.createDataFrame(docs, "key string, text string")
    it = spark.createDataFrame(items, "item string, field string, text string")
    got = leakage.leaked_spans(d, F.col("key"), F.col("text"), it, run=4, shard_words=500).collect()
    want = {}
    for k, t in docs:
        w = t.split()
        for i, f, q in items:
            q = q.split()
            grams = {tuple(q[a : a + 4]) for a in range(len(q) - 3)}
            hit = {a + j for a in range(len(w) - 3) if tuple(w[a : a + 4]) in grams for j in range(4)}
            if hit:
                want[k, i, f] = hit
    found = {}
    for g in got:
        found.setdefault((g["doc"], g["item"], g["field"]), set()).update(range(g["first_word"], g["end_word"]))
    assert found == want


DISGUISES = [
    lambda t: t.upper(), lambda t: t.replace(" ", "\u00a0"), lambda t: t.replace(" ", "&nbsp;"), lambda t: t.replace(" ", "<b> </b>"),
    lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t), lambda t: t.replace("fi", "\ufb01"),
    lambda t: re.sub(r"(\w\w)(\w)", "\\1\u200b\\2", t), lambda t: re.sub(r"(\w\w)(\w)", "\\1\u00ad\\2", t), lambda t: t.replace("plinth", "pli-\n>> nth"),
    lambda t: t.replace(" ", "\n// "), lambda t: t.replace("'", "&#x27;"), lambda t: t.replace("'", "\u2019").replace("-", "\u2011"),
    lambda t: " ".join(f"**{w}**" for w in t.split()), lambda t: t.replace("sun-bleached", "sun-\nbleached"), lambda t: t.replace("plinth", "pl<i>in</i>th"),
    lambda t: "<p>" + t.replace(". ", ".</p><p>") + "</p>", lambda t: t.replace("caf\u00e9", "cafe\u0301"), lambda t: t.replace("plinth", "pli\u00ad\r\nnth"),
]


def test_disguised_passages(spark):
    text = "The fitter's plinth is sun-bleached. Its first caf\u00e9 was never oiled after dusk for a borrowed keystone"
    items = spark.createDataFrame([("1", "expect", text)], "item string, field string, text string")
    docs = [(str(i), "before it. " + f(text) + " and after") for i, f in enumerate(DISGUISES)]
    broken = [("x", text.replace("dusk", "dawn")), ("y", " ".join(reversed(text.split()))), ("z", " ".join(text.split()[:7]))]
    d = spark.createDataFrame(docs + broken, "key string, text string")
    got = {g["doc"] for g in leakage.leaked_spans(d, F.col("key"), F.col("text"), items).collect()}
    assert got - {"x"} == {str(i) for i in range(len(DISGUISES))}


def test_leakage_awkward_rows(spark):
    none = spark.createDataFrame([], "item string, field string, text string")
    d = spark.createDataFrame([("a", "x " * 300_000, 1), (None, "x", 2), ("b", None, 3), ("c", "", 4)], "key string, text string, doc int")
    assert leakage.leaked_spans(d, F.col("key"), F.col("text"), none).count() == 0
    items = spark.createDataFrame([("1", "q", "x " * 12), ("2", "q", None), (None, "q", "x " * 12), ("3", "q", "x")], "item string, field string, text string")
    got = leakage.leaked_spans(d, F.col("key"), F.col("text"), items).collect()
    assert [(g["doc"], g["item"], g["first_word"], g["end_word"]) for g in got] == [("a", "1", 0, 300_000)]
    assert leakage.leaked_spans(d.where("false"), F.col("key"), F.col("text"), items).count() == 0


def test_items_beyond_the_search_are_joined(spark, monkeypatch):
    r = random.Random(61)
    voc = [f"w{c}" for c in "abcdef"]
    items = [(str(i), f, " ".join(r.choices(voc, k=r.randrange(2, 14)))) for i in range(20) for f in ("question", "expect")]
    items += [("copy", "expect", items[0][2]), items[1], ("b", "q", "plinth wa sun bleached wb"), ("c", "q", "plinth wa sunbleached wb"), ("n", "q", None), (None, "q", "wa wb wc wd")]
    docs = [(str(d % 50), " ".join(r.choices([*voc, "other"], k=r.randrange(0, 80)))) for d in range(70)]
    docs += [("x", "wa " * 3000), ("y", "the pli-\nnth wa sun-\nbleached wb"), ("z", "plinth wa sun bleached wb"), (None, "wa wb wc wd"), ("u", None), docs[0]]
    d = spark.createDataFrame(docs, "key string, text string")
    it = spark.createDataFrame([*items, ("long", "q", "wa " * 9)], "item string, field string, text string")
    spans = lambda: sorted(leakage.leaked_spans(d, F.col("key"), F.col("text"), it, run=4).collect())
    searched = spans()
    assert {("y", "c"), ("z", "b"), ("x", "long")} <= {(s["doc"], s["item"]) for s in searched} and ("y", "b") not in {(s["doc"], s["item"]) for s in searched}
    # Nothing of the items is taken apart on the driver then.
    monkeypatch.setattr(leakage, "MAX_ITEM_BYTES", 90)
    monkeypatch.setattr(leakage, "Phrases", None)
    assert spans() == searched
    monkeypatch.setattr(leakage, "BLOOM", 1)  # as for more items than the filter holds
    assert spans() == searched


def test_places_of_items_in_parts(monkeypatch):
    r = random.Random(62)
    texts = [" ".join(r.choices("ab", k=9)) for _ in range(12)]
    phrases = leakage.Phrases([(str(i), "q", texts[i % 10]) for i in range(12)], 3)
    numbers = [np.array([*(r.randrange(1, 3) for _ in range(n)), 0], np.int32) for n in (3, 40, 5, 200)]
    places = [np.arange(len(x), dtype=np.int32) for x in numbers]

    def spans():
        frames = list(leakage._search(list("pqrs"), numbers, places, phrases, 3))
        assert max(map(len, frames)) <= leakage.AT_ONCE
        return sorted(row for f in frames for row in f.itertuples(index=False, name=None))

    whole = spans()
    assert {s[0] for s in whole} == set("pqrs")
    for at_once in (1, 7, 50):
        monkeypatch.setattr(leakage, "AT_ONCE", at_once)
        assert spans() == whole


def test_numbers_of_characters_of_any_length():
    got = leakage.seen_words("a &#" + "9" * 5000 + "; &#" + "0" * 5000 + "66; &#65;&#x43; &#99999999 b")
    assert got == ["a", "b", "ac", "b"]


# ── 7 mixtures ──


def test_water_filling():
    got = mixture.water_fill([100, 100, 1000], [0.5, 0.3, 0.2], [1, 9, 9], 1000)
    assert [c for c, _ in got] == [True, False, False] and np.allclose([g for _, g in got], [100, 540, 360])
    got = mixture.water_fill([100, 10, 1000], [0.5, 0.3, 0.2], [1, 1, 9], 1000)
    assert np.allclose([g for _, g in got], [100, 10, 890])
    assert np.allclose([g for _, g in mixture.water_fill([10, 0], [0.5, 0.5], [1, 5], 100)], [10, 0])
    assert mixture.water_fill([], [], [], 5) == []


TARGET = "source string, target_share double, max_repeats int"


def test_mix_and_report(spark):
    sizes = spark.createDataFrame([(i, "big" if i % 3 else "small", 10 + i % 7) for i in range(6000)], "key long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("none", 0.0, 3)], TARGET)
    plan = mixture.plan_mix(sizes, targets)
    p = {r["source"]: r for r in plan.collect()}
    assert not p["small"]["short"] and p["none"]["own_tokens"] == 0 and abs(p["small"]["repeats"] - 1.5) < 0.01
    mix = mixture.draw_mix(sizes, plan)
    assert mix.groupBy("key").count().where("count > 2").count() == 0
    assert mixture.draw_mix(sizes, plan).exceptAll(mix).count() == 0 and mixture.draw_mix(sizes, plan, 1).exceptAll(mix).count() > 0
    shares = {r["source"]: r["actual_share"] for r in mixture.mix_report(mix, plan).collect()}
    assert abs(shares["small"] - 0.5) < 0.02 and shares["none"] == 0.0
    short = mixture.plan_mix(sizes, spark.createDataFrame([("small", 0.9, 1), ("BIG ", 0.1, 1)], TARGET)).where("short").collect()
    assert [r["source"] for r in short] == ["small"]


def test_mixture_awkward_rows(spark):
    rows = [(1, " Run-Book", "a b c", 1), (2, "run book", None, 2), (3, None, "x", 3), (4, "odd", "y", 4), (None, "RUN_BOOK", "a b c", 5)]
    docs = spark.createDataFrame(rows, "id long, source string, text string, tokens int")
    args = (docs, F.col("id"), F.col("source"), F.col("text"))
    mix, report = mixture.mixture(*args, spark.createDataFrame([("run_book", 1.0, None), (None, 0.5, 1)], TARGET))
    assert mix.count() == 0 and [(r["own_tokens"], r["short"]) for r in report.collect()] == [(6, True)]
    mix, report = mixture.mixture(*args, spark.createDataFrame([("run_book", 1.0, 1)], TARGET))
    assert mix.count() == 3 and report.collect()[0]["actual_share"] == 1.0
    empty = mixture.mixture(docs.where("false"), *args[1:], spark.createDataFrame([("r", 1.0, 1)], TARGET))
    assert empty[0].count() == 0 and [(r["own_tokens"], r["actual_share"]) for r in empty[1].collect()] == [(0, 0.0)]
    with pytest.raises(ValueError):
        mixture.mixture(*args, spark.createDataFrame([("run_book", 1.0, 1), ("Run Book", 0.5, 1)], TARGET))
    got = [r[0] for r in spark.createDataFrame([("hello world",), ("",), ("a" * 20_000,)], "t string").select(mixture.count_tokens(F.col("t"))).collect()]
    assert got[:2] == [2, 0] and got[2] > 100


# ── 8 reading level ──


def corpus(r, n):
    easy = "we put the box on the old red cart and it was so big".split()
    hard = [f"{a}{b}ation" for a in ("epistemolog", "institution", "incommensur", "jurisdiction") for b in ("al", "ic", "iz", "ist")]
    rows = []
    for i in range(n):
        band = i % 4 + 1
        words = lambda k: [r.choice(hard) if r.random() < (0, 0.1, 0.3, 0.6)[band - 1] else r.choice(easy) for _ in range(k)]
        rows.append((i, ". ".join(" ".join(words((5, 9, 14, 25)[band - 1])) for _ in range(6)) + ".", band))
    return rows


def test_held_out_bands(spark):
    rows = corpus(random.Random(8), 800)
    docs = spark.createDataFrame([r[:2] for r in rows], "key long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:300]], "key long, band int")
    got = {r["key"]: r["band"] for r in reading.reading_levels(docs, F.col("key"), F.col("text"), labels).collect()}
    held_out = rows[300:]
    assert sum(got[k] == b for k, _, b in held_out) / len(held_out) > 0.9
    assert all((got[k] == 4) == (b == 4) for k, _, b in held_out)


def test_reading_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Die Anlage ist nicht alt und das Rad wird warm", 0), (None, "the cat is on it", 0), (5, "the cat " * 40_000, 0), (5, "the cat", 0)],
                                 "key long, text string, band int")
    labels = spark.createDataFrame([], "key long, band int")
    got = reading.reading_levels(docs, F.col("key"), F.col("text"), labels).collect()
    assert sorted((g["key"] or 0, g["words"]) for g in got) == [(0, 5), (2, 0), (5, 2), (5, 80_000)] and all(g["band"] is None for g in got)
    labels = spark.createDataFrame([(5, 1), (5, 2), (5, 2), (None, 3), (9, 4), (5, None), (5, 9)], "key long, band int")
    assert {g["band"] for g in reading.reading_levels(docs, F.col("key"), F.col("text"), labels).collect()} <= {1, 2}
    assert reading.reading_levels(docs.where("false"), F.col("key"), F.col("text"), labels).count() == 0
    assert reading.measure("A b. c d!", {"a": 1}, 1) == (4, 2.0, [0.75])


def test_items_converge_however_many_rounds_it_takes():
    r = np.random.default_rng(0)
    items = [(r.integers(1, 5, 8).astype(float), r.dirichlet(np.ones(8)) * 0.5) for _ in range(100)]
    got = terms.converge(*[np.concatenate(x) for x in zip(*items)], np.arange(0, 800, 8))
    most = 0
    for i, (tf, bg) in enumerate(items):
        p, moved, rounds = tf / tf.sum(), 1.0, 0
        while moved > terms.TOLERANCE:
            e = tf * 0.1 * p / (0.9 * bg + 0.1 * p)
            old, p, rounds = p, e / e.sum(), rounds + 1
            moved = np.abs(p - old).max()
        most = max(most, rounds)
        assert np.allclose(got[8 * i : 8 * i + 8], p, rtol=0, atol=1e-9)
    assert most > 200


def test_levels_of_routers(spark, monkeypatch):
    for name, value in (("PARTITION", 20), ("FANOUT", 8), ("DEEPER", 3), ("KEYS", 7)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(9)
    centres = 2 * r.standard_normal((40, 12))
    x = r.standard_normal((1500, 12)) + centres[r.integers(0, 40, 1500)]
    near = 1.0001 * x[:200] + 0.1 * r.standard_normal((200, 12))
    rows = [(f"k{i:04d}", "m", [v.tolist()], 0) for i, v in enumerate(np.concatenate([x, near]))]
    rows += [(f"c{i:03d}", "m", [[2.0] * 12], 0) for i in range(60)]
    found = []
    for limit in (neighbours.BROADCAST_BYTES, 0):
        monkeypatch.setattr(neighbours, "BROADCAST_BYTES", limit)
        index = neighbours.Index(vector_rows(spark, rows), threshold=0.95)
        deepest = max(p["node"].count("/") for p in index.placed.select("node").distinct().collect())
        report = index.report().collect()[0]
        assert deepest >= 2 and report["partitions"] > 40 and report["classes"] == 1701 and 0 < report["scanned"] < 1
        found.append({(p["key_a"], p["key_b"]) for p in neighbours.similar_keys(index, 0.95).collect()})
        assert index.placed.where("member").groupBy("h1", "h2").count().where("count > 1").count() == 0
    want = brute(rows, 0.95)
    assert found[0] == found[1] and not found[0] - want and len(want - found[0]) <= 0.02 * len(want)
    assert sum(a[0] == "c" == b[0] for a, b in found[0]) == 60 * 59 // 2


def test_beyond_what_is_sent_at_once(spark, monkeypatch):
    """Plans, items, targets and familiar words above the bounds of one pass give the same results."""
    text = " ".join(f"w{i % 17}{'.' if i % 9 == 0 else ''}" for i in range(60))
    plans = [(i, 8 + i, i % 5) for i in range(12)]
    items = spark.createDataFrame([(str(i), "q", " ".join(text.split()[i : i + 6])) for i in range(20)], "item string, field string, text string")
    docs = spark.createDataFrame([("a", text), ("b", text[20:])], "key string, text string")
    sizes = spark.createDataFrame([(i, f"s{i % 7}", 5 + i % 11) for i in range(300)], "key long, source string, tokens long")
    targets = spark.createDataFrame([(f"s{i}", (0.4, 0.2, 0.1, 0.1, 0.1, 0.1, 0.0)[i], 1 + i % 3) for i in range(7)], TARGET)
    rows = corpus(random.Random(3), 60)
    read = spark.createDataFrame([r[:2] for r in rows], "key long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "key long, band int")

    def results():
        plan = mixture.plan_mix(sizes, targets)
        return [
            sorted(pieces(spark, [text, text[:40]], plans)),
            sorted(leakage.leaked_spans(docs, F.col("key"), F.col("text"), items, run=4).collect()),
            sorted((r["source"], r["short"], r["clamped"], round(r["repeats"], 9)) for r in plan.collect()),
            sorted(mixture.draw_mix(sizes, plan).collect()),
            sorted(reading.reading_levels(read, F.col("key"), F.col("text"), labels).collect()),
        ]

    at_once = results()
    for module, name, value in ((split, "MAX_PLANS", 3), (leakage, "MAX_ITEM_BYTES", 90), (mixture, "MAX_SOURCES", 2), (reading, "MAX_WORDS", 5)):
        monkeypatch.setattr(module, name, value)
    assert results() == at_once and all(at_once)
