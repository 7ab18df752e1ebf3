"""Queries of the index, the rankings and the graded answers, over the test ledger.

The questions are those of ``eval_items``; the collection is every record's text.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import folded_stopwords
from claimgraph.operators import graph, lexical, ranking, retrieve, vectors, views
from claimgraph.plans import ledger as L
from claimgraph.plans.ledger_queries import ON, VIEW, _admitted
from claimgraph.plans.tables import table
from claimgraph.session import Workspace

DIMS = 256
#: Part of a sample's nearest that lsh_top5 is to meet.
LSH_RECALL = 0.95


@lru_cache(maxsize=8)
def _view(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ws = Workspace(s, "view")
    records = ws.table(L.records(s, d), "records")
    return records, ws.table(views.admitted(records, L.effects(s, d), VIEW), "view")


@lru_cache(maxsize=8)
def _ledger(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, lexical.TextIndex]:
    records, view = _view(s, d)
    return records, view, lexical.TextIndex(records).write()


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, lexical.TextIndex, DataFrame]:
    return *_ledger(s, d), questions(s, d)


def questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


def register_questions(s: SparkSession, d: str) -> DataFrame:
    """The questions of the registers, some of which the ledger holds as gaps."""
    rows = table(s, d, "register_unknowns").groupBy(F.col("origin_key").alias("query_id"))
    return rows.agg(F.max("question").alias("text"))


@lru_cache(maxsize=8)
def _search(s: SparkSession, d: str) -> lexical.Candidates:
    _, view, index, asked = _parts(s, d)
    return lexical.search(index, asked, view)


@lru_cache(maxsize=8)
def _vectors(s: SparkSession, d: str) -> DataFrame:
    """The vectors of what the view admits, worked out once."""
    view = _view(s, d)[1].where(F.col("text").isNotNull())
    docs = view.select(F.col("record_id").alias("key"), vectors.hash_embed(F.col("text"), DIMS).alias("vector"))
    return Workspace(s, "vectors").table(docs, "vectors")


def _similar(s: SparkSession, d: str, k: int | None = None) -> DataFrame:
    """Cosines above nought of what the view admits."""
    q = questions(s, d).select("query_id", vectors.hash_embed(F.col("text"), DIMS).alias("vector"))
    return vectors.exact_similar(_vectors(s, d), q, DIMS, k, unique=True).withColumnRenamed("key", "record_id")


@lru_cache(maxsize=8)
def _log(s: SparkSession, d: str) -> ranking.Log:
    """What the fused rankings read, written once."""
    return ranking.write(*_view(s, d), DIMS)


def _nothing(s: SparkSession) -> DataFrame:
    return s.createDataFrame([], "query_id long, record_id string, similarity double")


def tokenize_counts(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d)[2].postings().select("record_id", "term", "tf")


def term_frequencies(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d)[2].frequencies()


def idf_table(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)[2]
    n, df = F.col("n").cast("double"), F.col("df").cast("double")
    return index.frequencies().crossJoin(F.broadcast(index.stats())).select("term", F.round(lexical._idf(n, df), 6).alias("idf"))


def doc_lengths(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d)[2].lengths.select("record_id", "length")


def passage_lengths(s: SparkSession, d: str) -> DataFrame:
    return lexical.TextIndex(L.records(s, d), 64).lengths


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def bm25_top10(s: SparkSession, d: str) -> DataFrame:
    top = _search(s, d).ranked.where("admitted AND rank <= 10")
    return _rounded(top.select("query_id", "record_id", "rank", "score", "coverage"), "score", "coverage")


def bm25_scoped(s: SparkSession, d: str) -> DataFrame:
    """Each question asked of one entity: the n-th of those that records name, round and round."""
    _, view, index, asked = _parts(s, d)
    scope = asked.select("query_id", (F.col("query_id") % 20 + 1).alias("n")).join(_named(s, d), "n").select("query_id", "entity_id")
    found = lexical.search(index, asked, view, scope=scope).ranked.where("admitted AND rank <= 10")
    return _rounded(found.select("query_id", "record_id", "rank", "score"), "score")


def _named(s: SparkSession, d: str) -> DataFrame:
    """The twenty entities that most records name."""
    named = L.records(s, d).select(F.explode("refs").alias("entity_id")).groupBy("entity_id").count()
    top = named.orderBy(F.desc("count"), "entity_id").limit(20)
    return top.select("entity_id", F.row_number().over(Window.orderBy(F.desc("count"), "entity_id")).alias("n"))


def coverage_known(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_search(s, d).queries.select("query_id", "total_idf", "missing_idf", "known"), "total_idf", "missing_idf", "known")


def unknown_terms(s: SparkSession, d: str) -> DataFrame:
    return _search(s, d).queries.select("query_id", F.explode("unknown").alias("term"))


def near_terms(s: SparkSession, d: str) -> DataFrame:
    return _search(s, d).queries.select("query_id", F.explode("read_as").alias("r")).select("query_id", "r.asked", "r.read")


def shadow_counts(s: SparkSession, d: str) -> DataFrame:
    return _search(s, d).ranked.where("NOT admitted").groupBy("query_id").agg(
        F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best")
    )


def hash_embed_slots(s: SparkSession, d: str) -> DataFrame:
    asked = questions(s, d).select("query_id", F.posexplode(vectors.hash_embed(F.col("text"), DIMS)).alias("slot", "weight"))
    return asked.where("weight <> 0").select("query_id", "slot", F.round(F.abs("weight"), 6).alias("weight"))


def hash_cosine_top10(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_similar(s, d, 10).withColumnRenamed("similarity", "cosine"), "cosine")


def hash_window_top10(s: SparkSession, d: str) -> DataFrame:
    """The best window of 32 words of each text counts."""
    embedder = vectors.hashing_embedder(DIMS, window=32)
    docs = embedder.embedded(_ledger(s, d)[1].select("record_id", "text")).withColumnRenamed("record_id", "key")
    asked = questions(s, d).select("query_id", embedder.query(F.col("text")).alias("vector"))
    return _rounded(vectors.exact_similar(docs, asked, DIMS, 10).withColumnsRenamed({"key": "record_id", "similarity": "cosine"}), "cosine")


def knn_exact(s: SparkSession, d: str) -> DataFrame:
    """The external vectors: every twentieth asks, the five nearest others answer."""
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    asked = rows.where("key % 20 = 0").withColumnRenamed("key", "query_id")
    near = vectors.exact_similar(rows, asked, 64, 6, above=-2.0).where("query_id <> key")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
    ranked = near.withColumn("n", F.row_number().over(w)).where("n <= 5")
    return ranked.select("query_id", "key", F.round("similarity", 5).alias("cosine"))


def lsh_top5(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    asked = rows.where("key % 20 = 0").withColumnRenamed("key", "query_id")
    return vectors.SignBuckets(64).similar(rows, asked, 6, 200, LSH_RECALL).where("query_id <> key")


def lsh_recall(s: SparkSession, d: str) -> DataFrame:
    """``found, of, recall``: how many of the rows of knn_exact are in lsh_top5."""
    pairs = lsh_top5(s, d).select("query_id", "key", F.lit(1).alias("hit"))
    both = knn_exact(s, d).join(pairs, ["query_id", "key"], "left")
    return both.agg(F.count("hit").alias("found"), F.count("*").alias("of")).withColumn("recall", F.round(F.col("found") / F.col("of"), 4))


def _fused(s: SparkSession, d: str, rrf_k: float | None) -> DataFrame:
    records = _parts(s, d)[0]
    lex = _search(s, d).ranked.where("admitted")
    fused = retrieve.fuse(lex, retrieve.rank_similar(_similar(s, d), records), rrf_k)
    top = fused.where("fused_rank <= 10").select("query_id", "record_id", "fused_rank", "score", "via")
    return _rounded(top, "score")


def _items(s: SparkSession, d: str, **options: object) -> DataFrame:
    found, _, _ = ranking.rank(_log(s, d), questions(s, d), retrieve.Options(**options))
    return _rounded(ranking.items(found).select("query_id", "position", "record_id", "via", "coverage"), "coverage")


@lru_cache(maxsize=8)
def _ranked(s: SparkSession, d: str, ask: str = "items") -> tuple[DataFrame, DataFrame, DataFrame]:
    return ranking.rank(_log(s, d), questions(s, d) if ask == "items" else register_questions(s, d))


@lru_cache(maxsize=8)
def _answers(s: SparkSession, d: str, ask: str = "items") -> retrieve.Answers:
    return ranking.answers(_log(s, d), *_ranked(s, d, ask))


def _full_text(s: SparkSession, d: str) -> DataFrame:
    """``query_id, record_id, rank`` of the ten best admitted full-text matches of each question."""
    return _ranked(s, d)[0].where("what = 'lexical'").select("query_id", "record_id", F.col("n").alias("rank"))


def outcomes(s: SparkSession, d: str) -> DataFrame:
    o = _answers(s, d).outcomes
    return _rounded(o.select("query_id", "outcome", "items", "truncated", "known", "coverage", "relevance"), "known", "coverage", "relevance")


def outcome_tags(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d, "register").outcomes.select("query_id", F.concat_ws(",", "tags").alias("tags"))


def answer_items(s: SparkSession, d: str) -> DataFrame:
    items = _answers(s, d).items
    return items.select("query_id", "position", "record_id", F.col("excerpt").isNotNull().alias("cut"))


def answer_excerpts(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d).items.where(F.col("excerpt").isNotNull()).select("query_id", "position", "excerpt")


def why(s: SparkSession, d: str) -> DataFrame:
    told = retrieve.why(_answers(s, d))
    return told.select("query_id", "outcome", F.concat_ws(",", "short_of").alias("short_of"), F.size("unknown").alias("unknown"))


def expanded_items(s: SparkSession, d: str) -> DataFrame:
    """What stands one hop around the three best items of each question."""
    records, view = _view(s, d)
    found, _, _ = ranking.rank(_log(s, d), questions(s, d), retrieve.Options(k=3))
    items = ranking.items(found)
    seeds = Workspace(s, "seeds").table(items.join(records.select("record_id", "refs"), "record_id"), "seeds")
    return graph.expand(seeds, views.edges(view), views.about(view), 1).drop("path")


QUERIES = {
    "tokenize_counts": tokenize_counts,
    "term_frequencies": term_frequencies,
    "idf_table": idf_table,
    "doc_lengths": doc_lengths,
    "passage_lengths": passage_lengths,
    "bm25_top10": bm25_top10,
    "bm25_scoped": bm25_scoped,
    "coverage_known": coverage_known,
    "unknown_terms": unknown_terms,
    "near_terms": near_terms,
    "shadow_counts": shadow_counts,
    "hash_embed_slots": hash_embed_slots,
    "hash_cosine_top10": hash_cosine_top10,
    "hash_window_top10": hash_window_top10,
    "knn_exact": knn_exact,
    "lsh_top5": lsh_top5,
    "lsh_recall": lsh_recall,
    "rrf_k0": lambda s, d: _fused(s, d, 0.0),
    "rrf_k60": lambda s, d: _fused(s, d, 60.0),
    "weighted_fusion": lambda s, d: _fused(s, d, None),
    "hybrid_items": lambda s, d: _items(s, d),
    "uncovered_kept": lambda s, d: _items(s, d, drop_uncovered=False, titles="keep"),
    "titles_folded": lambda s, d: _items(s, d, titles="fold_behind"),
    "outcomes": outcomes,
    "outcome_tags": outcome_tags,
    "answer_items": answer_items,
    "answer_excerpts": answer_excerpts,
    "gap_offers": lambda s, d: _rounded(_answers(s, d, "register").gaps.select("query_id", "n", "record_id", "coverage"), "coverage"),
    "beyond_view": lambda s, d: _rounded(_answers(s, d, "register").beyond, "coverage"),
    "why": why,
    "expanded_items": expanded_items,
}

STOP = ", ".join(f"'{w}'" for w in folded_stopwords())
FOLD = """CASE WHEN strlen({0}) > 4 AND {0} LIKE '%ies' THEN {0}[:-4] || 'y' WHEN strlen({0}) > 4 AND {0} LIKE '%sses' THEN {0}[:-3]
  WHEN strlen({0}) > 3 AND {0} LIKE '%s' AND NOT regexp_matches({0}, '(ss|us|is)$') THEN {0}[:-2] ELSE {0} END"""
SPLIT = r"list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _tokens(text: str) -> str:
    return f"list_transform({SPLIT.format(text)}, lambda x: {FOLD.format('lower(x)')})"


INDEX = _admitted(ON, ON, "'promoted'") + f""", doc AS (
  SELECT * FROM (SELECT record_id, seq, refs, {_tokens('text')} AS toks FROM rec) WHERE len(toks) > 0
), post AS (SELECT record_id, term, count(*) AS tf FROM (SELECT record_id, unnest(toks) AS term FROM doc) GROUP BY ALL
), freq AS (SELECT term, count(*) AS df FROM post GROUP BY term
), stat AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM doc)"""

ITEMS = "SELECT item_id AS query_id, question AS text FROM eval_items"
REGISTER = "SELECT origin_key AS query_id, max(question) AS text FROM register_unknowns GROUP BY 1"

SEARCH = INDEX + f""", q AS ({ITEMS}), asked AS (SELECT DISTINCT query_id, unnest({_tokens('text')}) AS asked FROM q
), kept AS (SELECT a.*, df FROM asked a LEFT JOIN freq f ON a.asked = f.term, stat
  WHERE a.asked NOT IN ({STOP}) AND NOT (n >= 10 AND coalesce(df, 0) > 0.5 * n)
), near AS (SELECT asked, min(term) AS read FROM (SELECT DISTINCT asked FROM kept WHERE df IS NULL AND strlen(asked) >= 5) k
  JOIN freq ON strlen(term) >= 5 AND right(term, 1) = right(asked, 1) AND abs(length(term) - length(asked)) <= 1
  AND levenshtein(term, asked) = 1 GROUP BY asked HAVING count(*) = 1
), term0 AS (SELECT query_id, k.asked, CASE WHEN k.df IS NOT NULL THEN k.asked ELSE near.read END AS read FROM kept k
  LEFT JOIN near ON k.asked = near.asked
), term AS (SELECT query_id, asked, read, ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) AS idf
  FROM term0 LEFT JOIN freq ON read = freq.term, stat
), qs AS (SELECT e.query_id, sum(idf) AS total_idf, sum(CASE WHEN read IS NULL THEN idf ELSE CASE WHEN idf IS NULL THEN NULL ELSE 0 END END) AS missing_idf,
  CASE WHEN sum(idf) > 0 THEN 1 - sum(CASE WHEN read IS NULL THEN idf ELSE 0 END) / sum(idf) ELSE 0 END AS known
  FROM q e LEFT JOIN term ON e.query_id = term.query_id GROUP BY 1
), hit AS (SELECT query_id, record_id, seq, refs, sum(idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))) AS score, sum(idf) AS matched
  FROM term JOIN post ON read = post.term JOIN doc USING (record_id), stat GROUP BY query_id, record_id, seq, refs
), lexed AS (SELECT h.*, matched / total_idf AS coverage, record_id IN (SELECT record_id FROM v) AS admitted FROM hit h JOIN qs USING (query_id)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, admitted ORDER BY round(score, 9) DESC, seq) AS rank FROM lexed)"""

FEATURES = """list_concat(['w:' || w], list_concat(
  list_transform(range(1, greatest(length(w) + 1, 1)), lambda i: 'g:' || substring(' ' || w || ' ', i::INTEGER, 3)),
  list_transform(range(1, greatest(length(w), 1)), lambda i: 'g:' || substring(' ' || w || ' ', i::INTEGER, 4))))"""


def _embedded(name: str, rows: str) -> str:
    words = SPLIT.format("text")
    return f"""{name}_f AS (SELECT id, unnest({FEATURES}) AS f FROM (SELECT id, translate(unnest({words}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS w FROM ({rows}))), {name}_s AS (SELECT f, list_reduce(list_prepend(37::BIGINT,
      list_transform(range(0, octet_length(encode(f)) ), lambda i: ('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2])::BIGINT)),
      lambda h, b: (xor(h, b) * 179) & 255) AS slot FROM (SELECT DISTINCT f FROM {name}_f)),
    {name}_c AS (SELECT id, slot, count(*) AS c FROM {name}_f JOIN {name}_s USING (f) GROUP BY ALL),
    {name} AS (SELECT id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM {name}_c)"""


SIMILAR = ", " + _embedded("ev", "SELECT record_id AS id, text FROM v WHERE text IS NOT NULL") + ", " + _embedded(
    "eq", f"SELECT query_id AS id, text FROM ({ITEMS})") + """,
  sim AS (SELECT eq.id AS query_id, ev.id AS record_id, seq, sum(eq.w * ev.w) AS similarity FROM eq JOIN ev USING (slot)
    JOIN v ON v.record_id = ev.id GROUP BY ALL)"""  # fmt: skip

FUSED = SEARCH + SIMILAR + """, simr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, seq) AS rank FROM sim
), lexr AS (SELECT * FROM ranked WHERE admitted
), both_ AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.record_id, s.record_id) AS record_id, l.rank AS lr, s.rank AS vr,
    l.score AS relevance, s.similarity, coalesce(l.coverage, 0) AS coverage,
    CASE WHEN l.rank IS NULL THEN 'vector' WHEN s.rank IS NULL THEN 'lexical' ELSE 'hybrid' END AS via
  FROM lexr l FULL JOIN simr s ON l.query_id = s.query_id AND l.record_id = s.record_id)"""


def _fused_sql(score: str) -> str:
    return FUSED + f""", scored AS (SELECT *, {score} AS score FROM both_),
      f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, coalesce(lr, vr), record_id)::INTEGER AS fused_rank
      FROM scored)"""


RRF = "coalesce(1.0::DOUBLE / ({0} + lr), 0) + coalesce(1.0::DOUBLE / ({0} + vr), 0)"
TOP = " SELECT query_id, record_id, fused_rank, round(score, 6) AS score, via FROM f WHERE fused_rank <= 10"

LISTED = _fused_sql(RRF.format(0)).replace("WITH ent", "WITH RECURSIVE ent", 1) + """, cand AS (
  SELECT query_id, record_id, fused_rank, via, coalesce(relevance, 0) AS relevance, coverage, max(coverage) OVER (PARTITION BY query_id) AS best,
    CASE WHEN shape = 'attribute' AND attr_name = 'title' THEN subject END AS title, CASE WHEN kind = 'claim' THEN coalesce(refs, []) ELSE [] END AS about
  FROM f JOIN rec USING (record_id) WHERE kind <> 'gap'
), l AS (SELECT * FROM cand WHERE best <= 0 OR via <> 'vector' OR coverage > 0
), body AS (SELECT query_id, fused_rank, record_id, about, unnest(about) AS ref FROM l WHERE title IS NULL
), t AS (SELECT t.query_id, t.record_id, t.fused_rank, t.title, row_number() OVER (PARTITION BY t.query_id ORDER BY t.fused_rank) AS n,
    row_number() OVER (PARTITION BY t.query_id, t.title ORDER BY t.fused_rank) > 1 AS again, b.first, b.id AS taken, b.about
  FROM l t LEFT JOIN (SELECT query_id, ref, min(fused_rank) AS first, arg_min(record_id, fused_rank) AS id, arg_min(about, fused_rank) AS about
    FROM body GROUP BY ALL) b ON b.query_id = t.query_id AND b.ref = t.title WHERE t.title IS NOT NULL
), walk AS (SELECT DISTINCT query_id, 0::BIGINT AS n, []::VARCHAR[] AS moved, NULL::VARCHAR AS gone, NULL::VARCHAR AS taken, NULL::BIGINT AS slot FROM t
  UNION ALL SELECT query_id, n, CASE WHEN takes THEN list_concat(moved, about) ELSE moved END, CASE WHEN seen OR takes THEN record_id END,
    CASE WHEN takes THEN taken END, slot FROM (SELECT *, NOT seen AND first IS NOT NULL AS takes FROM (
      SELECT w.query_id, t.n, w.moved, t.record_id, t.taken, t.about, t.first, t.fused_rank AS slot,
        t.again OR coalesce(t.first < t.fused_rank, false) OR list_contains(w.moved, t.title) AS seen
      FROM walk w JOIN t ON t.query_id = w.query_id AND t.n = w.n + 1))
), fold AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY query_id ORDER BY pos)::INTEGER AS position FROM (
    SELECT l.*, coalesce(m.slot, l.fused_rank) AS pos FROM l LEFT JOIN walk m ON m.query_id = l.query_id AND m.taken = l.record_id
    WHERE NOT EXISTS (SELECT 1 FROM walk g WHERE g.query_id = l.query_id AND g.gone = l.record_id))
)"""
ANSWERED = LISTED + """, held AS (SELECT fold.query_id, position, fold.record_id, coalesce(len(toks), 0) AS size FROM fold LEFT JOIN doc USING (record_id) WHERE position <= 10
), top AS (SELECT query_id, coverage, relevance FROM fold WHERE position = 1
), num AS (SELECT query_id, count(*) AS total, least(count(*), 10) AS items FROM fold GROUP BY 1
), o AS (SELECT query_id, CASE WHEN total IS NULL THEN 'none' WHEN coverage >= 0.5 AND relevance >= 0 AND known >= 0.5 THEN 'matches' ELSE 'weak_matches' END AS outcome,
    coalesce(items, 0)::BIGINT AS items, (coalesce(total, 0) - coalesce(items, 0))::BIGINT AS truncated, coalesce(known, 0) AS known,
    coalesce(coverage, 0) AS coverage, coalesce(relevance, 0) AS relevance FROM qs LEFT JOIN top USING (query_id) LEFT JOIN num USING (query_id)
), gap AS (SELECT * FROM (SELECT query_id, record_id, coverage, row_number() OVER (PARTITION BY query_id ORDER BY round(coverage, 9) DESC,
    round(coalesce(similarity, 0), 9) DESC, record_id)::INTEGER AS n FROM both_ JOIN rec USING (record_id) JOIN qs USING (query_id)
    WHERE kind = 'gap' AND total_idf > 0 AND (coverage >= 0.25 OR similarity >= 0.5)) WHERE n <= 3
), dark AS (SELECT query_id, arg_min({'record_id': record_id, 'coverage': coverage}, rank) FILTER (kind <> 'gap') AS best, count(*) AS n
    FROM ranked JOIN rec USING (record_id) WHERE NOT admitted GROUP BY 1
), beyond AS (SELECT query_id, best.record_id AS record_id, best.coverage AS coverage, n AS count FROM dark JOIN o USING (query_id)
    WHERE outcome <> 'matches' AND best.coverage >= 0.5 AND known >= 0.5
)"""


def _register(sql: str) -> str:
    """The same asked by the registers."""
    return sql.replace(ITEMS, REGISTER)


SQL = {
    "hybrid_items": LISTED + " SELECT query_id, position, record_id, via, round(coverage, 6) AS coverage FROM fold WHERE position <= 10",
    "titles_folded": LISTED + """ SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank)::INTEGER AS position, record_id, via,
      round(coverage, 6) AS coverage FROM l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = l.query_id AND t.record_id = l.record_id
      AND (again OR first < t.fused_rank)) QUALIFY position <= 10""",
    "outcomes": ANSWERED + """ SELECT query_id, outcome, items, truncated, round(known, 6) AS known, round(coverage, 6) AS coverage,
      round(relevance, 6) AS relevance FROM o""",
    "answer_items": ANSWERED + " SELECT query_id, position, record_id, size > 400 AS cut FROM held",
    "why": ANSWERED + """ SELECT query_id, outcome, CASE WHEN outcome = 'weak_matches' THEN concat_ws(',', CASE WHEN coverage < 0.5 THEN 'coverage' END,
      CASE WHEN known < 0.5 THEN 'known' END) ELSE '' END AS short_of, (SELECT count(*) FROM term WHERE term.query_id = o.query_id AND read IS NULL)::INTEGER AS unknown FROM o""",
    "outcome_tags": _register(ANSWERED) + """ SELECT query_id, concat_ws(',', outcome, CASE WHEN query_id IN (SELECT query_id FROM gap) THEN 'registered_gap' END,
      CASE WHEN query_id IN (SELECT query_id FROM beyond) THEN 'beyond_view' END) AS tags FROM o""",
    "gap_offers": _register(ANSWERED) + " SELECT query_id, n, record_id, round(coverage, 6) AS coverage FROM gap",
    "beyond_view": _register(ANSWERED) + " SELECT query_id, record_id, round(coverage, 6) AS coverage, count FROM beyond",
    "expanded_items": LISTED + """, seed AS (SELECT query_id, position AS seed, record_id, refs FROM fold JOIN rec USING (record_id) WHERE position <= 3
      ), start AS (SELECT *, row_number() OVER (PARTITION BY query_id, seed ORDER BY entity) AS place FROM (SELECT DISTINCT query_id, seed, unnest(refs) AS entity FROM seed)
      ), way AS (SELECT subject AS entity, object_id AS other, 0 AS turn, seq, record_id FROM v WHERE shape = 'relation'
        UNION ALL SELECT object_id, subject, 1, seq, record_id FROM v WHERE shape = 'relation'
      ), step AS (SELECT query_id, seed, other, min((place, turn, seq, record_id)) AS way FROM start JOIN way USING (entity) WHERE other IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM start s WHERE s.query_id = start.query_id AND s.seed = start.seed AND s.entity = other) GROUP BY ALL
      ), hop AS (SELECT query_id, seed, other, row_number() OVER (PARTITION BY query_id, seed ORDER BY way) AS place FROM step
      ), said AS (SELECT h.query_id, a.record_id, min((seed, place, seq)) AS spot FROM hop h JOIN (SELECT unnest(refs) AS entity, seq, record_id FROM v
        WHERE shape IN ('text', 'pattern') OR kind = 'gap') a ON a.entity = h.other
        WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.query_id = h.query_id AND s.record_id = a.record_id) GROUP BY ALL)
      SELECT said.query_id, row_number() OVER (PARTITION BY said.query_id ORDER BY spot)::INTEGER AS n, said.record_id, seed.record_id AS seed_id, 1 AS hop
      FROM said JOIN seed ON seed.query_id = said.query_id AND seed.seed = spot[1]""",
    "tokenize_counts": INDEX + " SELECT record_id, term, tf FROM post",
    "term_frequencies": INDEX + " SELECT term, df FROM freq",
    "idf_table": INDEX + " SELECT term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM freq, stat",
    "doc_lengths": INDEX + " SELECT record_id, len(toks)::INTEGER AS length FROM doc",
    "passage_lengths": INDEX + """ SELECT record_id, (p - 1)::INTEGER AS passage, least(64, len(toks) - 64 * (p - 1))::INTEGER AS length
      FROM (SELECT *, unnest(generate_series(1, (len(toks) + 63) // 64)) AS p FROM doc)""",
    "bm25_top10": SEARCH + """ SELECT query_id, record_id, rank::INTEGER AS rank, round(score, 6) AS score, round(coverage, 6) AS coverage
      FROM ranked WHERE admitted AND rank <= 10""",
    "bm25_scoped": SEARCH + """, named AS (SELECT entity_id, row_number() OVER (ORDER BY c DESC, entity_id) AS n FROM (
        SELECT entity_id, count(*) AS c FROM (SELECT unnest(refs) AS entity_id FROM rec) GROUP BY 1) LIMIT 20
      ), s AS (SELECT l.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seq) AS r FROM lexed l
        JOIN named ON query_id % 20 + 1 = n AND list_contains(refs, entity_id) WHERE admitted)
      SELECT query_id, record_id, r::INTEGER AS rank, round(score, 6) AS score FROM s WHERE r <= 10""",
    "coverage_known": SEARCH + """ SELECT query_id, round(total_idf, 6) AS total_idf, round(missing_idf, 6) AS missing_idf,
      round(known, 6) AS known FROM qs""",
    "unknown_terms": SEARCH + " SELECT query_id, asked AS term FROM term WHERE read IS NULL",
    "near_terms": SEARCH + " SELECT query_id, asked, read FROM term WHERE read <> asked",
    "shadow_counts": SEARCH + """ SELECT query_id, count(*) AS n, round(max(score), 6) AS best FROM lexed WHERE NOT admitted GROUP BY 1""",
    "hash_embed_slots": "WITH " + _embedded("eq", "SELECT item_id AS id, question AS text FROM eval_items")
    + " SELECT id AS query_id, slot::INTEGER AS slot, round(w, 6) AS weight FROM eq",
    "hash_cosine_top10": _admitted(ON, ON, "'promoted'") + SIMILAR + """ SELECT query_id, record_id, round(similarity, 6) AS cosine FROM sim
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, record_id) <= 10""",
    "hash_window_top10": _admitted(ON, ON, "'promoted'") + ", w AS (SELECT record_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM v"
      " WHERE text IS NOT NULL), part AS (SELECT record_id, unnest(range(0, greatest(len(ws), 1)::BIGINT, 32)) AS a, ws FROM w), "
    + _embedded("ev", "SELECT record_id || '/' || a AS id, array_to_string(ws[a + 1 : a + 32], ' ') AS text FROM part") + ", "
    + _embedded("eq", f"SELECT query_id AS id, text FROM ({ITEMS})") + """, sim AS (SELECT eq.id AS query_id, split_part(ev.id, '/', 1) AS record_id,
        sum(eq.w * ev.w) AS c FROM eq JOIN ev USING (slot) GROUP BY eq.id, ev.id), best AS (SELECT query_id, record_id, max(c) AS c FROM sim GROUP BY ALL)
      SELECT query_id, record_id, round(c, 6) AS cosine FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, record_id) <= 10""",
    "knn_exact": """SELECT a.vec_id AS query_id, b.vec_id AS key, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id
      ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 5""",
    "rrf_k0": _fused_sql(RRF.format(0)) + TOP,
    "rrf_k60": _fused_sql(RRF.format(60)) + TOP,
    "weighted_fusion": _fused_sql("""coalesce(relevance / max(relevance) OVER (PARTITION BY query_id), 0)
      + coalesce(similarity / max(similarity) OVER (PARTITION BY query_id), 0)""") + TOP,
    "uncovered_kept": _fused_sql(RRF.format(0)) + """ SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank)::INTEGER AS position,
      record_id, via, round(coverage, 6) AS coverage FROM f JOIN rec USING (record_id) WHERE kind <> 'gap' QUALIFY position <= 10""",
}
SQL = {k: v for k, v in SQL.items() if v}
