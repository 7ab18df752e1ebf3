"""Queries of the training-data problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.functions.ids import norm_id
from claimgraph.llm.leakage import leaked_spans
from claimgraph.llm.mixture import mixture, plan_mix, sized, source_key
from claimgraph.llm.neighbours import Index, exploded, nearest, similar_keys
from claimgraph.llm.reading import reading_levels
from claimgraph.llm.split import split
from claimgraph.llm.terms import distinctive_terms, top_terms
from claimgraph.plans.tables import table


def latest_texts(records: DataFrame) -> DataFrame:
    """Each record once with the text of its last delivery."""
    return (
        records.select(norm_id(F.col("record_id")).alias("record_id"), "text", "ingested_at")
        .where(F.col("record_id").isNotNull())
        .groupBy("record_id")
        .agg(F.max_by("text", F.struct("ingested_at", "text")).alias("text"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = latest_texts(table(spark, sf_dir, "ledger_records"))
    pieces = split(texts, F.col("record_id"), F.col("text"), table(spark, sf_dir, "window_plans"), oversized_only=True)
    cut = pieces.where((F.col("piece") == 0) & (F.col("pieces") > 1))
    return cut.select("plan_id", F.col("key").alias("record_id"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = latest_texts(table(spark, sf_dir, "ledger_records"))
    return split(texts, F.col("record_id"), F.col("text"), table(spark, sf_dir, "window_plans"))


def p1_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each plan and text: the tokens that its pieces cover, whether none is beyond the limit, and whether
    each begins ``overlap_tokens`` before the end of the one before."""
    plans = table(spark, sf_dir, "window_plans")
    w = Window.partitionBy("plan_id", "key").orderBy("piece")
    pieces = p1_pieces(spark, sf_dir).withColumn("before", F.lag("end_token").over(w)).join(F.broadcast(plans), "plan_id")
    shared = F.col("before") - F.col("first_token")
    within = F.coalesce(F.col("end_token") - F.col("first_token") <= F.col("window_tokens"), F.lit(True))
    return pieces.groupBy("plan_id", F.col("key").alias("record_id")).agg(
        (F.sum(F.col("end_token") - F.col("first_token")) - F.coalesce(F.sum(shared), F.lit(0))).alias("tokens"),
        F.min(within).alias("within"), F.min(F.coalesce(shared == F.coalesce("overlap_tokens", F.lit(0)), F.lit(True))).alias("overlapping"),
        (F.max("pieces") == F.count("*")).alias("whole"),
    )


def term_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of one record have one text; the operator takes each item once."""
    records = table(spark, sf_dir, "ledger_records")
    questions = table(spark, sf_dir, "register_unknowns")
    return records.select(
        F.lit("record").alias("place"), norm_id(F.col("record_id")).alias("item_key"), "text"
    ).unionByName(
        questions.select(
            F.lit("question").alias("place"), F.col("origin_key").alias("item_key"), F.col("question").alias("text")
        )
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctive_terms(term_items(spark, sf_dir))
    return scored.where((F.col("tf") >= 2) & (F.col("df") <= 4)).select("place", "item_key", "term")


def p3_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_terms(distinctive_terms(term_items(spark, sf_dir)), 5)


def p3_best_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term that is most an item's own, where it holds a twentieth of the item's model at least."""
    best = top_terms(distinctive_terms(term_items(spark, sf_dir)), 1).where(F.col("weight") >= 0.05)
    return best.select("place", "item_key", "term", "tf", "df")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "embedded_records")
    return exploded(records, norm_id(F.col("record_id")), F.col("model_id"), F.col("vectors"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_keys(Index(vectors(spark, sf_dir), threshold=0.9), 0.9)
    return pairs.select(F.col("key_a").alias("record_id_a"), F.col("key_b").alias("record_id_b"))


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every twentieth record: those whose hash is divisible by 20 ask, all answer."""
    rows = vectors(spark, sf_dir)
    asking = rows.where(F.crc32("key") % 20 == 0)
    return nearest(Index(rows, queries=asking), 10)


def p5_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions, probes and the share of the vectors that a vector is compared with, in each space."""
    report = Index(vectors(spark, sf_dir), threshold=0.9).report()
    return report.withColumns({c: F.round(c, 4) for c in ("probes", "scanned")})


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    fields = items.select(F.col("item_id").alias("item"), F.lit("question").alias("field"), F.col("question").alias("text"))
    fields = fields.unionByName(
        items.select(F.col("item_id").alias("item"), F.lit("expect").alias("field"), F.col("expect").alias("text"))
    )
    spans = leaked_spans(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), fields)
    return spans.select(
        F.col("doc").cast("long").alias("doc_id"), F.col("item").cast("long").alias("item_id"), "field", "first_word", "end_word"
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sized(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("source"), F.col("text"))
    return plan_mix(sizes, table(spark, sf_dir, "mix_targets")).where("short").select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    mix, _ = mixture(documents, F.col("doc_id"), F.col("source"), F.col("text"), table(spark, sf_dir, "mix_targets"))
    return mix.withColumnRenamed("key", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    _, report = mixture(documents, F.col("doc_id"), F.col("source"), F.col("text"), table(spark, sf_dir, "mix_targets"))
    return report


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each listed source: its documents, and whether copies of each keep to the cap and differ by one at most."""
    targets = table(spark, sf_dir, "mix_targets").select(source_key(F.col("source")).alias("source"), "max_repeats")
    documents = table(spark, sf_dir, "documents").select(source_key(F.col("source")).alias("source"), "doc_id")
    mix = p7_mix(spark, sf_dir).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last"))
    each = documents.join(F.broadcast(targets), "source").join(mix, ["source", "doc_id"], "left").fillna(0, ["n", "last"])
    return each.groupBy("source").agg(
        F.count("*").alias("documents"), (F.max("n") <= F.max("max_repeats")).alias("within_cap"),
        (F.max("n") - F.min("n") <= 1).alias("even"), F.min(F.col("n") == F.col("last")).alias("numbered"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "reading_labels").select(F.col("doc_id").alias("key"), "band")
    return reading_levels(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), labels)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir).where(F.col("band") == 4).select(F.col("key").alias("doc_id"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir).withColumnRenamed("key", "doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_cover": p1_cover,
    "p3_found": p3_found,
    "p3_top_terms": p3_top_terms,
    "p3_best_terms": p3_best_terms,
    "p5_found": p5_found,
    "p5_nearest": p5_nearest,
    "p5_routing": p5_routing,
    "p6_found": p6_found,
    "p6_spans": p6_spans,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_copies": p7_copies,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
}

ID = "'rec_' || regexp_replace(upper(trim({0}, ' \t\r\n')), '^REC_', '')"
#: The characters with the property White_Space, as RE2 writes them.
NOT_WHITE = r"[^\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

TERMS = rf"""
      WITH items AS (
        SELECT 'record' AS place, {ID.format('record_id')} AS item_key, max(text) AS text FROM ledger_records GROUP BY 1, 2
        UNION ALL SELECT 'question', origin_key, max(question) FROM register_unknowns GROUP BY 1, 2
      ), words AS (
        SELECT place, item_key, lower(unnest(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}]+'))) AS w FROM items
      ), folded AS (
        SELECT place, item_key, CASE
          WHEN strlen(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y'
          WHEN strlen(w) > 4 AND w LIKE '%sses' THEN w[:-3]
          WHEN strlen(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN w[:-2] ELSE w END AS term
        FROM words
      ), counts AS (
        SELECT place, item_key, term, count(*) AS tf FROM folded
        WHERE regexp_full_match(term, '\p{{L}}{{4,}}') GROUP BY ALL
      ), df AS (SELECT place, term, count(*) AS df FROM counts GROUP BY ALL)
"""

#: The vectors that count, and all pairs of them.
VECTORS = f"""
      WITH v AS (SELECT DISTINCT {ID.format('record_id')} AS id, model_id, unnest(vectors) AS v FROM embedded_records
      ), u AS (SELECT DISTINCT id, model_id, v::DOUBLE[] AS v FROM v WHERE id IS NOT NULL AND model_id IS NOT NULL AND len(v) > 0
        AND NOT list_contains(list_transform(v, lambda c: c IS NULL OR isnan(c) OR isinf(c)), true)
        AND list_contains(list_transform(v, lambda c: c <> 0), true))"""

SPELLED = "regexp_replace(regexp_replace(lower({0}), '[\\s_\\-\\x{{a0}}]+', '_', 'g'), '^_+|_+$', '', 'g')"

SQL = {
    "p1_cover": f"""
      WITH texts AS (SELECT DISTINCT {ID.format('record_id')} AS record_id,
          len(regexp_extract_all(text, '{NOT_WHITE}')) AS n FROM ledger_records)
      SELECT plan_id, record_id, n AS tokens, true AS within, true AS overlapping, true AS whole FROM texts, window_plans WHERE n > 0""",
    # Any way to count tokens gives the same sources: here they are words.
    "p7_found": f"""
      WITH size AS (SELECT {SPELLED.format('source')} AS s, sum(len(regexp_extract_all(text, '\\S+'))) AS n FROM documents GROUP BY 1
      ), own AS (SELECT t.*, coalesce(n, 0) AS n FROM mix_targets t LEFT JOIN size ON s = {SPELLED.format('t.source')})
      SELECT source FROM own WHERE n * max_repeats < target_share * (SELECT sum(n) FROM own)""",
    "p7_copies": f"""
      SELECT {SPELLED.format('t.source')} AS source, count(*) AS documents, true AS within_cap, true AS even, true AS numbered
      FROM mix_targets t JOIN documents d ON {SPELLED.format('t.source')} = {SPELLED.format('d.source')} GROUP BY 1""",
    "p5_found": VECTORS + """ SELECT DISTINCT a.id AS record_id_a, b.id AS record_id_b FROM u a JOIN u b ON a.model_id = b.model_id
      AND len(a.v) = len(b.v) AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.9""",
    "p1_found": f"""
      WITH texts AS (SELECT DISTINCT {ID.format('record_id')} AS record_id,
          len(regexp_extract_all(text, '{NOT_WHITE}')) AS n FROM ledger_records)
      SELECT plan_id, record_id FROM texts, window_plans WHERE n > window_tokens""",
    "p3_found": TERMS + """
      SELECT place, item_key, term FROM counts JOIN df USING (place, term) WHERE tf >= 2 AND df <= 4""",
    # The fixed point of the EM in closed form: terms in order of tf over background have mass as long as
    # that ratio is above a level, which the terms down to it give.
    "p3_best_terms": TERMS + """, cf AS (SELECT place, term, sum(tf) AS cf FROM counts GROUP BY ALL
      ), size AS (SELECT place, sum(tf) AS total FROM counts GROUP BY ALL
      ), b AS (SELECT c.*, df, cf / total::DOUBLE AS bg FROM counts c JOIN cf USING (place, term) JOIN df USING (place, term) JOIN size USING (place)
      ), r AS (SELECT *, sum(tf) OVER w / (1 + 9 * sum(bg) OVER w) AS mu, tf / bg AS ratio FROM b
        WINDOW w AS (PARTITION BY place, item_key ORDER BY tf / bg DESC, term ROWS UNBOUNDED PRECEDING)
      ), level AS (SELECT place, item_key, arg_min(mu, ratio) AS mu FROM r WHERE ratio > 9 * mu GROUP BY ALL
      ), p AS (SELECT place, item_key, term, tf, df, tf / level.mu - 9 * bg AS weight FROM b JOIN level USING (place, item_key))
      SELECT place, item_key, term, tf, df FROM (SELECT *, row_number() OVER (PARTITION BY place, item_key ORDER BY weight DESC, term) AS n FROM p)
      WHERE n = 1 AND weight >= 0.05""",
}
