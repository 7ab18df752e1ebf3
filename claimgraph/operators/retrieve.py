"""From candidates to a graded answer: fusion, items, titles, outcome, budget, gaps, disclosure.

Everything is keyed by ``query_id``: one plan answers a whole table of questions, and every
question has exactly one outcome row, with or without items. "The record does not settle this"
is a result, not an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import fold_py, folded_stopwords, tokens
from claimgraph.operators.lexical import Candidates, tie
from claimgraph.session import Workspace


@dataclass(frozen=True)
class Options:
    k: int = 10
    max_tokens: int = 4_000
    rrf_k: float | None = 0.0
    weights: tuple[float, float] = (1.0, 1.0)
    min_score: float = 0.0
    min_coverage: float = 0.5
    min_known: float = 0.5
    min_similarity: float = 0.5
    gap_budget: int = 3
    drop_uncovered: bool = True
    #: keep, fold_behind or prefer_body
    titles: str = "prefer_body"
    stopwords: tuple[str, ...] = field(default_factory=lambda: tuple(folded_stopwords()))


@dataclass
class Answers:
    #: query_id, outcome, items, truncated, known, coverage, relevance, unknown, read_as, tags
    outcomes: DataFrame
    #: query_id, position, record_id, score, relevance, coverage, similarity, via, excerpt
    items: DataFrame
    #: query_id, n, record_id, coverage, similarity
    gaps: DataFrame
    #: query_id, record_id, coverage, count
    beyond: DataFrame


def fuse(lexical: DataFrame, vector: DataFrame, rrf_k: float | None = 0.0, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``query_id, record_id, score, relevance, similarity, via, fused_rank``.

    ``lexical``: query_id, record_id, rank, score; ``vector``: query_id, record_id, rank,
    similarity. Reciprocal ranks, or with ``rrf_k`` None sums of scores divided by the best of
    their ranking. Ties: first rank, the lexical one if there is one, then record id.
    """
    both = lexical.select("query_id", "record_id", F.col("rank").alias("lr"), F.col("score").alias("relevance")).join(
        vector.select("query_id", "record_id", F.col("rank").alias("vr"), "similarity"), ["query_id", "record_id"], "full"
    )
    nought = lambda c: F.coalesce(c, F.lit(0.0))
    if rrf_k is None:
        per = Window.partitionBy("query_id")
        part = lambda c: F.when(F.max(c).over(per) > 0, F.col(c) / F.max(c).over(per)).otherwise(0.0)
        score = weights[0] * nought(part("relevance")) + weights[1] * nought(part("similarity"))
    else:
        score = nought(1.0 / (rrf_k + F.col("lr"))) + nought(1.0 / (rrf_k + F.col("vr")))
    via = F.when(F.col("lr").isNotNull() & F.col("vr").isNotNull(), "hybrid").when(F.col("lr").isNull(), "vector").otherwise("lexical")
    fused = both.select(
        "query_id", "record_id", score.alias("score"), nought(F.col("relevance")).alias("relevance"),
        nought(F.col("similarity")).alias("similarity"), via.alias("via"), F.coalesce("lr", "vr").alias("first_rank"),
    )
    w = Window.partitionBy("query_id").orderBy(tie("score").desc(), "first_rank", "record_id")
    return fused.withColumn("fused_rank", F.row_number().over(w)).drop("first_rank")


def rank_similar(similar: DataFrame, records: DataFrame) -> DataFrame:
    """``similar`` (query_id, record_id, similarity) with ranks; ties in log order."""
    w = Window.partitionBy("query_id").orderBy(tie("similarity").desc(), "seq")
    return similar.join(records.select("record_id", "seq"), "record_id").withColumn("rank", F.row_number().over(w))


def title_moves(rows: pd.DataFrame, prefer_body: bool) -> pd.DataFrame:
    """``record_id, slot`` of one question's items that titles concern; a null slot drops the item.

    In order of position, a title behind something about its subject goes. One before gives its
    place to the next thing about its subject, if bodies are preferred and there is one.
    """
    rows = rows.sort_values("fused_rank")
    bodies: dict[str, list[int]] = {}
    items = list(rows.itertuples(index=False))
    for at, it in enumerate(items):
        if it.title is None:
            for ref in it.refs if it.refs is not None else ():
                bodies.setdefault(ref, []).append(at)
    seen: set[str] = set()
    slot: dict[int, int | None] = {}
    for at, it in enumerate(items):
        if at in slot:
            continue
        if it.title is None:
            slot[at] = it.fused_rank
            seen.update(it.refs if it.refs is not None else ())
        elif it.title in seen:
            slot[at] = None
        else:
            body = next((b for b in bodies.get(it.title, ()) if b > at and b not in slot), None) if prefer_body else None
            if body is None:
                slot[at] = it.fused_rank
                seen.add(it.title)
            else:
                slot[at], slot[body] = None, it.fused_rank
                seen.update(items[body].refs)
    return pd.DataFrame(
        {
            "query_id": rows["query_id"].to_numpy(),
            "record_id": [it.record_id for it in items],
            "slot": pd.array([slot[i] for i in range(len(items))], dtype="Int64"),
        }
    )


def fold_titles(items: DataFrame, prefer_body: bool = True) -> DataFrame:
    """Items (with title, refs, fused_rank) after folding. Only titles and what is about their
    subjects is looked at one by one, of each question; the rest keeps its place."""
    kinds = dict(items.dtypes)
    subjects = items.where(F.col("title").isNotNull()).select("query_id", F.col("title").alias("ref")).distinct()
    touched = items.where(F.col("title").isNull()).select("query_id", "record_id", F.explode("refs").alias("ref"))
    touched = touched.join(subjects, ["query_id", "ref"], "left_semi").select("query_id", "record_id").distinct()
    concerned = items.where(F.col("title").isNotNull()).select("query_id", "record_id").unionByName(touched)
    slim = items.join(concerned, ["query_id", "record_id"], "left_semi").select("query_id", "record_id", "title", "refs", "fused_rank")
    moves = slim.groupBy("query_id").applyInPandas(
        lambda rows: title_moves(rows, prefer_body), f"query_id {kinds['query_id']}, record_id string, slot long"
    )
    moved = items.join(moves.withColumn("moved", F.lit(True)), ["query_id", "record_id"], "left")
    return moved.where(F.col("moved").isNull() | F.col("slot").isNotNull()).withColumn(
        "fused_rank", F.coalesce("slot", "fused_rank")
    ).drop("slot", "moved")


def best_window(text: str, terms: set[str], share: int) -> str:
    """The window of ``share`` words with most different terms, then most occurrences, then the earliest."""
    words = text.split()
    if len(words) <= share:
        return " ".join(words)
    answers = []
    for w in words:
        parts = "".join(c if c.isalnum() else " " for c in w).split()
        answers.append(next((t for t in (fold_py(p.lower()) for p in parts) if t in terms), None))
    count: dict[str, int] = {}
    total, best, start = 0, (-1, -1), 0
    for end, t in enumerate(answers):
        if t is not None:
            count[t] = count.get(t, 0) + 1
            total += 1
        out = answers[end - share] if end >= share else None
        if out is not None:
            total -= 1
            count[out] -= 1
            if not count[out]:
                del count[out]
        if end >= share - 1 and (len(count), total) > best:
            best, start = (len(count), total), end - share + 1
    body = " ".join(words[start : start + share])
    return ("… " if start else "") + body + (" …" if start + share < len(words) else "")


def excerpts(text: Column, terms: Column, share: int) -> Column:
    @F.pandas_udf("string")
    def cut(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else best_window(t, set(w if w is not None else ()), share) for t, w in zip(texts, wanted)])

    return cut(text, terms)


def apply_budget(items: DataFrame, texts: DataFrame, terms: DataFrame, k: int, max_tokens: int) -> DataFrame:
    """Items within the budget, in order of position, with an excerpt where a text exceeds its share.

    ``items``: query_id, record_id, position; ``texts``: record_id, text; ``terms``: query_id,
    terms. The first item always stays; then items as long as their tokens fit.
    """
    share = max(max_tokens // max(k, 1), 1)
    top = items.where(F.col("position") <= k).join(texts.select("record_id", "text"), "record_id", "left")
    top = top.withColumn("cost", F.coalesce(F.size(tokens(F.col("text"))), F.lit(0))).withColumn("cost", F.greatest("cost", F.lit(0)))
    top = top.join(terms, "query_id", "left")
    top = top.withColumn("excerpt", F.when(F.col("cost") > share, excerpts(F.col("text"), F.col("terms"), share)))
    top = top.withColumn("cost", F.coalesce(F.when(F.col("excerpt").isNotNull(), F.size(tokens(F.col("excerpt")))), F.col("cost")))
    w = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("spent", F.sum("cost").over(w))
    return top.where((F.col("position") == 1) | (F.col("spent") <= max_tokens)).drop("text", "terms", "cost", "spent")


def list_items(candidates: Candidates, similar: DataFrame, records: DataFrame, o: Options = Options()) -> DataFrame:
    """The fused ranking without gaps, uncovered vector hits and folded titles, numbered by ``position``."""
    lexical = candidates.ranked.where("admitted")
    fused = fuse(lexical, rank_similar(similar, records), o.rrf_k, o.weights)
    about = records.select(
        "record_id", "kind", "refs",
        F.when((F.col("shape") == "attribute") & (F.col("attr_name") == "title"), F.col("subject")).alias("title"),
    )
    items = fused.join(about, "record_id").where(F.col("kind") != "gap")
    # Only claims name entities here; what a hypothesis or gap is about folds no title.
    items = items.withColumn("refs", F.when(F.col("kind") == "claim", F.col("refs")).otherwise(F.array().cast("array<string>")))
    items = items.join(lexical.select("query_id", "record_id", "coverage"), ["query_id", "record_id"], "left")
    items = items.withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    if o.drop_uncovered:
        best = F.max("coverage").over(Window.partitionBy("query_id"))
        items = items.withColumn("best", best).where(
            (F.col("best") <= 0) | (F.col("via") != "vector") | (F.col("coverage") > 0)
        ).drop("best")
    if o.titles != "keep":
        # Folding reads the items several times.
        items = Workspace(records.sparkSession, "items").table(items, "unfolded")
        items = fold_titles(items, o.titles == "prefer_body")
    w = Window.partitionBy("query_id").orderBy("fused_rank")
    return items.withColumn("position", F.row_number().over(w)).drop("fused_rank", "kind", "title", "refs")


def gap_offers(candidates: Candidates, similar: DataFrame, records: DataFrame, o: Options = Options()) -> DataFrame:
    """Open questions that a question meets: by half the coverage of a match, or by similarity;
    ordered by coverage, then similarity, then record id."""
    seen = candidates.ranked.where("admitted").select("query_id", "record_id", "coverage").join(
        similar.select("query_id", "record_id", "similarity"), ["query_id", "record_id"], "full"
    ).fillna(0.0, ["coverage", "similarity"])
    met = seen.where((F.col("coverage") >= o.min_coverage * 0.5) | (F.col("similarity") >= o.min_similarity))
    gaps = met.join(records.where(F.col("kind") == "gap").select("record_id"), "record_id", "left_semi")
    # A question without words has nothing that could be covered.
    gaps = gaps.join(candidates.queries.where(F.col("total_idf") > 0).select("query_id"), "query_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy(tie("coverage").desc(), tie("similarity").desc(), "record_id")
    return gaps.withColumn("n", F.row_number().over(w)).where(F.col("n") <= o.gap_budget)


def scoped_gaps(view_rows: DataFrame, scope: DataFrame, gap_budget: int = 3) -> DataFrame:
    """``query_id, n, record_id``: the view's gaps about a question's entities, by entity and log order."""
    named = view_rows.where(F.col("kind") == "gap").select("record_id", "seq", F.explode("refs").alias("entity_id"))
    met = named.join(scope, "entity_id").groupBy("query_id", "record_id").agg(F.min(F.struct("entity_id", "seq")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at")
    return met.select("query_id", F.row_number().over(w).alias("n"), "record_id").where(F.col("n") <= gap_budget)


def retrieve(candidates: Candidates, similar: DataFrame, records: DataFrame, o: Options = Options(), expansion: DataFrame | None = None) -> Answers:
    """``records``: record_id, seq, kind, shape, attr_name, subject, refs, text of the whole log.
    ``similar``: query_id, record_id, similarity of admitted records, maybe none.
    ``expansion``: query_id, record_id and n, what ``graph.expand`` adds behind the items."""
    ws = Workspace(records.sparkSession, "retrieve")
    similar = ws.table(similar, "similar")
    listed = ws.table(list_items(candidates, similar, records, o), "listed")
    if expansion is not None:
        size = listed.groupBy("query_id").agg(F.max("position").alias("size"))
        more = expansion.join(size, "query_id").select(
            "query_id", "record_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("relevance"), F.lit(0.0).alias("similarity"),
            F.lit("expanded").alias("via"), F.lit(0.0).alias("coverage"), (F.col("size") + F.col("n")).cast("int").alias("position"),
        )
        listed = listed.unionByName(more)
    counts = listed.groupBy("query_id").agg(F.count("*").alias("total"))
    gaps = gap_offers(candidates, similar, records, o)
    shadow = candidates.ranked.where("NOT admitted")
    answers_ = shadow.join(records.where(F.col("kind") != "gap").select("record_id"), "record_id", "left_semi")
    top = answers_.groupBy("query_id").agg(F.min_by(F.struct("record_id", "score", "coverage"), "rank").alias("top"))
    size = shadow.groupBy("query_id").agg(F.count("*").alias("count"))
    return conclude(Parts(listed, counts, gaps, top.join(size, "query_id")), candidates.queries, candidates.terms, records, o)


@dataclass
class Parts:
    """What an answer is made of."""

    #: query_id, position, record_id, score, relevance, coverage, similarity, via; the first k at least
    listed: DataFrame
    #: query_id, total
    totals: DataFrame
    #: query_id, n, record_id, coverage, similarity
    gaps: DataFrame
    #: query_id, top (record_id, score, coverage), count
    dark: DataFrame


def conclude(parts: Parts, queries: DataFrame, terms: DataFrame, records: DataFrame, o: Options) -> Answers:
    """Budget, outcome and disclosure. ``queries`` and ``terms``: as ``Candidates`` has them."""
    ws = Workspace(records.sparkSession, "answers")
    listed = parts.listed
    first = listed.where("position = 1").select("query_id", "relevance", "coverage")
    words = terms.groupBy("query_id").agg(F.collect_set("asked").alias("a"), F.collect_set("read").alias("r"))
    words = words.select("query_id", F.array_union("a", "r").alias("terms"))
    items = ws.table(apply_budget(listed, records, words, o.k, o.max_tokens), "items")

    held = items.groupBy("query_id").agg(F.count("*").alias("items"))
    q = queries.join(first, "query_id", "left").join(parts.totals, "query_id", "left").join(held, "query_id", "left")
    q = q.fillna(0, ["total", "items"]).fillna(0.0, ["known"])
    sure = (
        (F.col("coverage") >= o.min_coverage) & (F.col("relevance") >= o.min_score) & (F.col("known") >= o.min_known)
    )
    outcome = F.when(F.col("total") == 0, "none").when(sure, "matches").otherwise("weak_matches")
    q = q.withColumn("outcome", outcome)

    gaps = ws.table(parts.gaps, "gaps")
    beyond = (
        parts.dark.join(q.where("outcome <> 'matches'").select("query_id", "known"), "query_id")
        .where(
            (F.col("top.coverage") >= o.min_coverage) & (F.col("top.score") >= o.min_score) & (F.col("known") >= o.min_known)
        )
        .select("query_id", "top.record_id", "top.coverage", "count")
    )
    beyond = ws.table(beyond, "beyond")
    q = q.join(gaps.select("query_id").distinct().withColumn("gap", F.lit("registered_gap")), "query_id", "left")
    q = q.join(beyond.select("query_id", F.lit("beyond_view").alias("hidden")), "query_id", "left")
    outcomes = q.select(
        "query_id", "outcome", "items", (F.col("total") - F.col("items")).alias("truncated"), "known",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
        "unknown", "read_as", F.array_compact(F.array("outcome", "gap", "hidden")).alias("tags"),
    )
    return Answers(outcomes, items, gaps, beyond)


def why(answers: Answers, o: Options = Options()) -> DataFrame:
    """The explanation of each outcome: ``query_id, outcome, coverage, min_coverage, known, min_known,
    short_of, read_as, unknown, sentence``; numbers to two places, ``short_of`` names the bounds missed."""
    two = lambda c: F.round(F.col(c).cast("double"), 2).alias(c)
    said = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    weak = F.col("outcome") == "weak_matches"
    bounds = (("coverage", o.min_coverage), ("relevance", o.min_score), ("known", o.min_known))
    short = F.array_compact(F.array(*[F.when(weak & (F.col(c) < least), F.lit(c)) for c, least in bounds]))
    shown = F.concat(
        F.lit("first item covers "), said("coverage"), F.lit(f" (least {o.min_coverage:.2f}), the record knows "), said("known"),
        F.lit(f" (least {o.min_known:.2f}) of the question"),
    )
    near = F.transform("read_as", lambda r: F.concat(r["asked"], F.lit(" as "), r["read"]))
    missing = F.when(F.size("unknown") > 0, F.concat(F.lit("unknown words: "), F.array_join("unknown", ", ")))
    read = F.when(F.size("read_as") > 0, F.concat(F.lit("taken "), F.array_join(near, ", ")))
    sentence = F.concat_ws("; ", F.concat(F.lit("outcome "), "outcome"), F.when(F.col("outcome") == "none", F.lit("no item meets the question")).otherwise(shown), missing, read)
    return answers.outcomes.withColumns({"short_of": short, "sentence": sentence}).select(
        "query_id", "outcome", two("coverage"), F.lit(o.min_coverage).alias("min_coverage"), two("known"), F.lit(o.min_known).alias("min_known"),
        "short_of", "read_as", "unknown", "sentence",
    )
