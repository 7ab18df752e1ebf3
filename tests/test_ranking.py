"""Rankings without a table of pairs: the results of ``retrieve``, and what is written on the way."""

import random

import pytest
from pyspark.sql import functions as F

from claimgraph.operators import lexical, ranking, retrieve, vectors
from claimgraph.plans import keeper_queries, retrieval_queries
from claimgraph.session import Workspace

from .test_retrieval import docs

SMALL = "/root/testdata/sf0.001"


def corpus(spark, n=150, m=25, seed=4, same_seq=False):
    r = random.Random(seed)
    words = "torque rail weld sensor drawing batch limit gauge licence spindle hose claim audit".split()
    said = lambda most: " ".join(r.choice(words) for _ in range(r.randrange(most)))
    rows = []
    for i in range(n):
        kind = r.choice(["claim", "claim", "claim", "gap", "hypothesis"])
        row = dict(record_id=f"r{r.randrange(10**6):06d}-{i}", text=None if i % 17 == 0 else said(12), kind=kind, refs=r.sample("abcdefgh", r.randrange(3)))
        if kind == "claim" and r.random() < 0.4:
            row |= dict(shape="attribute", attr_name="title", subject=r.choice([*"abcdefgh", "none", None]))
        rows.append(row)
    rows += [dict(record_id=f"x{i}", text="xylophone " * (i + 1)) for i in range(3)]
    d = docs(spark, rows)
    if same_seq:
        d = d.withColumn("seq", F.lit(7).cast("long"))
    asked = [(i, said(6) + (" of license" if i % 5 == 0 else "")) for i in range(m)] + [(100, "the of"), (101, ""), (102, None), (103, "unheard"), (104, "xylophone")]
    q = spark.createDataFrame(asked, "query_id long, text string")
    return d, d.where((F.pmod(F.xxhash64("record_id"), F.lit(3)) > 0) & ~F.col("record_id").startswith("x")), q


def both(spark, o, d, view, q):
    """The answers of pairs and those of ``ranking``, each as sorted rows."""
    embedded = lambda df, key: df.where("text IS NOT NULL").select(key, vectors.hash_embed(F.col("text"), 64).alias("vector"))
    similar = vectors.exact_similar(embedded(view.withColumnRenamed("record_id", "key"), "key"), embedded(q, "query_id"), 64, unique=True)
    index = lexical.TextIndex(d)
    pairs = retrieve.retrieve(lexical.search(index, q, view), similar.withColumnRenamed("key", "record_id"), d, o)
    log = ranking.write(d, view, 64)
    arrays = ranking.answers(log, *ranking.rank(log, q, o), o)
    out = []
    for a in (pairs, arrays):
        small = lambda df: df.select([F.round(c, 9).alias(c) if k == "double" else c for c, k in df.dtypes])
        tables = (a.outcomes, a.items, a.gaps, a.beyond)
        out.append([sorted(repr(sorted(r.asDict().items())) for r in small(t).collect()) for t in tables])
    return out


@pytest.mark.parametrize(
    "options",
    [
        {}, dict(titles="fold_behind", k=4), dict(titles="keep", drop_uncovered=False), dict(rrf_k=60.0, k=30, min_coverage=0.9),
        dict(rrf_k=None, weights=(1.0, 0.5), gap_budget=1), dict(drop_uncovered=False, k=1000),
    ],
)
def test_ranking_equals_pairs(spark, options):
    want, got = both(spark, retrieve.Options(**options), *corpus(spark))
    assert got == want and all(want)


def test_ranking_in_small_pieces(spark, monkeypatch):
    d, view, q = corpus(spark)
    want, got = both(spark, retrieve.Options(k=20), d, view, q)
    assert got == want
    log = ranking.write(d, view, 64)
    whole = sorted(map(repr, ranking.rank(log, q, retrieve.Options(k=20))[0].collect()))
    # Tasks are other processes; the same in this one, with bounds that are met.
    asked, terms = lexical.read_questions(log, q)
    words = terms.where("read IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("asked", "read", "idf"))).alias("t"))
    rows = q.select("query_id", vectors.hash_counts(F.col("text"), 64).alias("vector")).join(asked.select("query_id", "total_idf"), "query_id")
    rows = rows.join(words, "query_id", "left").select("query_id", "vector", "total_idf", "t.read", "t.idf").toPandas()
    for name, value in dict(KEPT=1, ROWS=7, FIRST=1, EXACT=1).items():
        monkeypatch.setattr(ranking, name, value)
    avgdl = log.stats().first()["avgdl"]
    parts = [ranking._answer(ranking.Reader(log.path, 64), rows[a : a + 3], avgdl, retrieve.Options(k=20)) for a in range(0, len(rows), 3)]
    found = spark.createDataFrame([tuple(None if x != x or x is None else x for x in r) for p in parts for r in p.astype(object).where(p.notna(), None).itertuples(index=False)], f"query_id long, {ranking.FOUND}")
    assert sorted(map(repr, found.collect())) == whole


def test_ranking_where_places_are_shared(spark):
    d, view, q = corpus(spark, n=40, same_seq=True)
    log = ranking.write(d, view, 64)
    found, _, _ = ranking.rank(log, q)
    twice = ranking.items(found).groupBy("query_id", "record_id").count().where("count > 1")
    assert twice.count() == 0 and ranking.items(found).count() > 0
    assert ranking.rank(ranking.write(d.limit(0), view.limit(0), 64), q)[0].where("what <> 'total'").count() == 0


NAMES = ["outcomes", "titles_folded", "why", "answer_items", "expanded_items", "hybrid_items", "uncovered_kept", "answer_excerpts", "gap_offers", "outcome_tags", "beyond_view", "golden_grade"]


@pytest.mark.parametrize("name", NAMES)
def test_no_table_of_pairs(spark, monkeypatch, name):
    """What is written grows with the questions and with the records, not with both."""
    for of in vars(retrieval_queries).values():
        if hasattr(of, "cache_clear"):
            of.cache_clear()
    sizes, table = {}, Workspace.table

    def counted(self, df, name):
        out = table(self, df, name)
        sizes[f"{self.path}/{name}"] = out.count()
        return out

    monkeypatch.setattr(Workspace, "table", counted)
    (retrieval_queries.QUERIES | keeper_queries.QUERIES)[name](spark, SMALL).collect()
    records, _, index = retrieval_queries._ledger(spark, SMALL)
    most = max(30 * retrieval_queries.questions(spark, SMALL).count(), index.all_postings.count())
    assert max(sizes.values()) <= most
