"""Full-text index and BM25 over DataFrames, for a whole table of questions at once.

Statistics (documents, frequencies, average length) are those of the collection; a view only
decides which matches are ranked and which are told apart as its shadow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import fold, folded_stopwords, raw_tokens, tokens
from claimgraph.session import Workspace

#: The ranking's constants.
K1, B = 1.2, 0.75
PRUNE_ABOVE, PRUNE_FROM = 0.5, 10
NEAR_BYTES = 5
#: Scores are added in whole parts of this size.
FINE = 1e12
#: Scores that are equal to a part of this size tie.
TIE = 1e9
#: Asked terms up to which they are broadcast; they are counted before.
BROADCAST_TERMS = 200_000


class TextIndex:
    """Passages and term statistics of documents (record_id, seq, text, refs).

    A document is one passage, or with ``passage_tokens`` as many as it has windows of so many
    tokens. Null texts and those without tokens are not indexed. ``write`` keeps the postings
    and lengths as tables, so that texts are taken apart once for any number of searches.
    """

    def __init__(self, documents: DataFrame, passage_tokens: int | None = None):
        self.documents, self.window = documents.select("record_id", "seq", "refs"), passage_tokens or 1 << 30
        raw = documents.select("record_id", "seq", raw_tokens(F.col("text")).alias("raw"))
        self.raw = raw.withColumn("size", F.size("raw")).where(F.col("size") > 0)
        passages = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / self.window).cast("int")))
        self.lengths = self.raw.select("record_id", "size", passages.alias("passage")).select(
            "record_id", "passage", self._length().alias("length")
        )
        # Words are folded after they are exploded: outside arrays that is compiled code.
        words = self.raw.select("record_id", "seq", "size", F.posexplode("raw").alias("at", "word")).select(
            "record_id", "seq", "size", F.floor(F.col("at") / self.window).cast("int").alias("passage"), fold(F.lower("word")).alias("term")
        )
        # Documents that lie partitioned by record_id stay so: nothing is shuffled here.
        counted = words.groupBy("record_id", "seq", "size", "passage", "term").agg(F.count("*").alias("tf"))
        self.all_postings = counted.select("term", "record_id", "seq", "passage", self._length().alias("length"), "tf")

    @classmethod
    def stored(cls, documents: DataFrame, postings: DataFrame, lengths: DataFrame) -> TextIndex:
        """An index whose tables are at hand; no text is read."""
        index = cls.__new__(cls)
        index.documents, index.all_postings, index.lengths = documents.select("record_id", "seq", "refs"), postings, lengths
        return index

    def _length(self) -> Column:
        return F.least(F.lit(self.window), F.col("size") - F.col("passage") * self.window).cast("int")

    def write(self) -> TextIndex:
        ws = Workspace(self.raw.sparkSession, "index")
        self.all_postings, self.lengths = ws.table(self.all_postings, "postings"), ws.table(self.lengths, "lengths")
        return self

    def stats(self) -> DataFrame:
        """One row: ``n`` passages and their average length ``avgdl``."""
        return self.lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))

    def frequencies(self) -> DataFrame:
        """``term, df``: the number of passages with each term."""
        return self.all_postings.groupBy("term").agg(F.count("*").alias("df"))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """``term, record_id, seq, passage, length, tf``, of the given terms only (they must be few)."""
        if terms is None:
            return self.all_postings
        return self.all_postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")


@dataclass
class Candidates:
    #: query_id, record_id, seq, score, coverage, admitted, rank (within query and admission)
    ranked: DataFrame
    #: query_id, terms, total_idf, missing_idf, known, unknown, read_as
    queries: DataFrame
    #: query_id, asked, read, df, idf
    terms: DataFrame


def query_terms(queries: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """``query_id, asked``: the distinct folded words of each question, without function words."""
    stop = folded_stopwords() if stopwords is None else stopwords
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("asked"))
    return asked.where(~F.col("asked").isin(stop)) if stop else asked


def near_terms(missing: DataFrame, frequencies: DataFrame, few: bool = True) -> DataFrame:
    """``asked, read``: for words the index lacks the one word of it that is a single inner edit away.

    Both words have five bytes or more and end alike; where two words come near, none is taken.
    Candidates meet on last letter and length, so no word is compared with the whole vocabulary.
    """
    end = lambda c: F.substring(c, -1, 1)
    ask = missing.where(F.octet_length("asked") >= NEAR_BYTES).select(
        "asked", end("asked").alias("end"), F.explode(F.array(*[F.char_length("asked") + d for d in (-1, 0, 1)])).alias("size")
    )
    words = frequencies.where(F.octet_length("term") >= NEAR_BYTES).select(
        F.col("term").alias("read"), end("term").alias("end"), F.char_length("term").alias("size")
    )
    near = words.join(F.broadcast(ask) if few else ask, ["end", "size"]).where(F.levenshtein("asked", "read", 1) == 1)
    return near.groupBy("asked").agg(F.min("read").alias("read"), F.count("*").alias("n")).where("n = 1").drop("n")


def tie(c: str) -> Column:
    return F.floor(F.col(c) * TIE + 0.5)


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def read_questions(index: TextIndex, queries: DataFrame, stopwords: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The questions and their scored words, as ``Candidates`` has them; terms have ``n`` and ``avgdl``, too.
    Of the index, statistics and frequencies are read only."""
    ws = Workspace(queries.sparkSession, "search")
    freq = ws.table(index.frequencies(), "frequencies")
    stats = F.broadcast(index.stats())
    asked = ws.table(query_terms(queries, stopwords), "asked")
    few = asked.select("asked").distinct().count() <= BROADCAST_TERMS
    small = F.broadcast if few else (lambda d: d)
    distinct = asked.select("asked").distinct()
    held = freq.join(small(distinct.withColumnRenamed("asked", "term")), "term", "left_semi")
    missing = distinct.join(held.withColumnRenamed("term", "asked"), "asked", "left_anti")
    near = near_terms(missing, freq, few)
    read = held.select(F.col("term").alias("asked"), F.col("term").alias("read")).unionByName(near)
    read = ws.table(read.join(freq.withColumnRenamed("term", "read"), "read"), "read")

    kept = asked.join(read, "asked", "left").crossJoin(stats)
    own = F.when(F.col("read") == F.col("asked"), F.col("df"))
    kept = kept.where(~F.coalesce((F.col("n") >= PRUNE_FROM) & (own > F.col("n") * PRUNE_ABOVE), F.lit(False)))
    kept = kept.withColumn("idf", _idf(F.col("n").cast("double"), F.coalesce(F.col("df"), F.lit(0)).cast("double")))
    terms = ws.table(kept.select("query_id", "asked", "read", "df", "idf", "n", "avgdl"), "terms")
    lists = lambda cond, c: F.array_sort(F.collect_list(F.when(cond, c)))
    per_query = terms.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("asked", "idf", "read"))).alias("t"),
        lists(F.col("read").isNull(), F.col("asked")).alias("unknown"),
        lists(F.col("read") != F.col("asked"), F.struct("asked", "read")).alias("read_as"),
    )
    total = F.aggregate("t", F.lit(0.0), lambda s, x: s + x["idf"])
    lost = F.aggregate("t", F.lit(0.0), lambda s, x: s + F.when(x["read"].isNull(), x["idf"]).otherwise(0.0))
    per_query = per_query.select(
        "query_id", F.size("t").alias("terms"), total.alias("total_idf"), lost.alias("missing_idf"), "unknown", "read_as"
    )
    per_query = queries.select("query_id").join(per_query, "query_id", "left")
    known = F.when(F.col("total_idf") > 0, 1.0 - F.col("missing_idf") / F.col("total_idf")).otherwise(0.0)
    per_query = ws.table(per_query.withColumn("known", known), "queries")
    return per_query, terms


def search(
    index: TextIndex,
    queries: DataFrame,
    admitted: DataFrame,
    scope: DataFrame | None = None,
    stopwords: list[str] | None = None,
) -> Candidates:
    """Rank all matches of each question (query_id, text).

    ``admitted``: record_id of what the view shows. ``scope``: query_id, entity_id; questions
    listed there only match documents that name one of their entities. Words in more than half
    of the passages are not scored, from ten passages on. A question of which no word is left
    has no match and ``known`` 0. Ties rank in log order.
    """
    ws = Workspace(queries.sparkSession, "search")
    per_query, terms = read_questions(index, queries, stopwords)
    few = terms.select("asked").distinct().count() <= BROADCAST_TERMS
    small = F.broadcast if few else (lambda d: d)
    hits = terms.where(F.col("read").isNotNull())
    wanted = hits.select(F.col("read").alias("term")) if few else None
    found = index.postings(wanted).withColumnRenamed("term", "read").join(small(hits), "read")
    if scope is not None:
        found = found.join(index.documents.select("record_id", "refs"), "record_id")
        scoped = scope.groupBy("query_id").agg(F.collect_set("entity_id").alias("wanted"))
        found = found.join(small(scoped), "query_id", "left").where(
            F.col("wanted").isNull() | F.coalesce(F.arrays_overlap("refs", "wanted"), F.lit(False))
        )
    tf, norm = F.col("tf"), 1.0 - B + B * F.col("length") / F.col("avgdl")
    part = F.col("idf") * (tf * (K1 + 1.0)) / (tf + K1 * norm)
    # Sums of floats depend on their order; whole numbers of billionths of a thousandth do not.
    whole = lambda c: F.sum((c * FINE + 0.5).cast("long")) / FINE
    passages = found.groupBy("query_id", "record_id", "seq", "passage").agg(
        whole(part).alias("score"), whole(F.col("idf")).alias("matched")
    )
    best = passages.groupBy("query_id", "record_id", "seq").agg(
        F.max_by(F.struct("score", "matched"), F.struct("score", -F.col("passage"))).alias("b")
    )
    shown = admitted.select("record_id").distinct().withColumn("admitted", F.lit(True))
    ranked = (
        best.select("query_id", "record_id", "seq", "b.*")
        .join(shown, "record_id", "left")
        .withColumn("admitted", F.coalesce("admitted", F.lit(False)))
        .join(small(per_query.select("query_id", "total_idf")), "query_id")
    )
    w = Window.partitionBy("query_id", "admitted").orderBy(tie("score").desc(), "seq")
    ranked = ranked.select(
        "query_id", "record_id", "seq", "score", (F.col("matched") / F.col("total_idf")).alias("coverage"), "admitted",
        F.row_number().over(w).alias("rank"),
    )
    return Candidates(ws.table(ranked, "ranked"), per_query, terms)
