"""Queries of sync, attestation, grading and the audits, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph import store
from claimgraph.operators import keeper
from claimgraph.plans import ledger as L
from claimgraph.plans.ledger import WITH, sql_id
from claimgraph.plans.retrieval_queries import ANSWERED, STOP, _answers, _full_text, _tokens, questions
from claimgraph.plans.tables import table
from claimgraph.sources import formats

#: The ingest that counts as the one before.
BEFORE = "2015-02-20"


def _rows(s: SparkSession, d: str, before: bool) -> DataFrame:
    """Register rows as a source: identity and digest, of the last delivery, or the last before."""
    rows = table(s, d, "register_unknowns")
    rows = rows.where(F.col("ingested_at") < F.lit(BEFORE).cast("timestamp")) if before else rows
    return rows.groupBy(F.col("origin_key").alias("identity")).agg(
        F.max_by(F.sha2("raw_row", 256), F.struct("ingested_at", "raw_row")).alias("digest")
    )


def sync_dispositions(s: SparkSession, d: str) -> DataFrame:
    return keeper.dispositions(_rows(s, d, False), _rows(s, d, True))


def absent_records(s: SparkSession, d: str) -> DataFrame:
    late = table(s, d, "register_unknowns").where(F.col("ingested_at") >= F.lit(BEFORE).cast("timestamp"))
    return keeper.absent(late.select(F.col("origin_key").alias("identity")).distinct(), _rows(s, d, True))


def register_rows(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "register_unknowns").select("register_path", "line_no", "raw_row")
    return formats.parse_register_rows(rows).drop("raw_row").distinct()


def settlements(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "register_unknowns").groupBy("origin_key").agg(F.max_by("raw_row", F.struct("ingested_at", "raw_row")).alias("raw_row"))
    return keeper.settlements(formats.parse_register_rows(rows))


def mentions(s: SparkSession, d: str) -> DataFrame:
    return keeper.mentions(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))


def attestation_kinds(s: SparkSession, d: str) -> DataFrame:
    a = keeper.attestation(F.col("author_known_by"))
    return table(s, d, "ledger_records").groupBy(a["kind"].alias("kind"), a["strength"].alias("strength")).agg(F.count("*").alias("n"))


def attestation_weakest(s: SparkSession, d: str) -> DataFrame:
    """The records as lines, spans of a hundred of them."""
    rows = table(s, d, "ledger_records").select(F.col("seq").cast("int").alias("line"), F.col("author_known_by").alias("detail"))
    lines = rows.where(F.col("detail").isNotNull()).distinct()
    spans = lines.select((F.floor(F.col("line") / 100)).alias("id")).distinct()
    spans = spans.select("id", (F.col("id") * 100).alias("first_line"), (F.col("id") * 100 + 149).alias("last_line"))
    return keeper.weakest(spans, lines)


def golden_grade(s: SparkSession, d: str) -> DataFrame:
    """Questions of even number are to be abstained from; the others are to be answered by what the third
    full-text match is about, so that rankings that differ show."""
    anchored = keeper.anchors(L.records(s, d), L.entities(s, d))
    answers, third = _answers(s, d), _full_text(s, d).where("rank = 3")
    third = third.join(anchored, "record_id").select("query_id", F.col("anchor").alias("third"))
    asked = questions(s, d).join(third, "query_id", "left")
    odd = F.col("query_id") % 2 == 1
    asked = asked.select("query_id", F.when(odd, "answer").otherwise("abstain").alias("expects"), F.when(odd, F.col("third")).alias("expected"))
    return keeper.scorecard(keeper.grade(asked, answers, anchored))


def anchors(s: SparkSession, d: str) -> DataFrame:
    return keeper.anchors(L.records(s, d), L.entities(s, d))


def quoted_questions(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "text")
    return keeper.quoted_questions(questions(s, d), docs)


def absent_vocabulary(s: SparkSession, d: str) -> DataFrame:
    return keeper.absent_vocabulary(questions(s, d), L.records(s, d))


def vocabulary_drift(s: SparkSession, d: str) -> DataFrame:
    """What the documents brought since only the records were there."""
    was = keeper.absent_vocabulary(questions(s, d), L.records(s, d))
    now = keeper.absent_vocabulary(questions(s, d), L.records(s, d).select("text").unionByName(table(s, d, "documents").select("text")))
    return keeper.vocabulary_drift(was, now)


def record_out(s: SparkSession, d: str) -> DataFrame:
    out = store.record_out(L.records(s, d), L.effects(s, d), L.entities(s, d))
    return out.select("record_id", "kind", "state", F.size("about").alias("about"), F.coalesce(F.size("evidence"), F.lit(-1)).alias("evidence"))


def redacted_view(s: SparkSession, d: str) -> DataFrame:
    """How much of what was marked as redacted has really gone."""
    r = L.records(s, d)
    return r.groupBy(F.col("redacted_by").isNotNull().alias("marked"), F.col("text").isNull().alias("gone")).agg(F.count("*").alias("n"))


QUERIES = {
    "sync_dispositions": sync_dispositions,
    "absent_records": absent_records,
    "register_rows": register_rows,
    "settlements": settlements,
    "mentions": mentions,
    "attestation_kinds": attestation_kinds,
    "attestation_weakest": attestation_weakest,
    "golden_grade": golden_grade,
    "anchors": anchors,
    "quoted_questions": quoted_questions,
    "absent_vocabulary": absent_vocabulary,
    "vocabulary_drift": vocabulary_drift,
    "record_out": record_out,
    "redacted_view": redacted_view,
}

SYNC = f"""WITH src AS (SELECT origin_key AS identity, arg_max(raw_row, (epoch_us(ingested_at), raw_row)) AS digest FROM register_unknowns GROUP BY 1
), prior AS (SELECT origin_key AS identity, arg_max(raw_row, (epoch_us(ingested_at), raw_row)) AS digest FROM register_unknowns
  WHERE ingested_at < TIMESTAMP '{BEFORE}' GROUP BY 1)"""
ABSENT = f"""asked AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens('question')}) AS term FROM eval_items
), kept AS (SELECT * FROM asked WHERE term NOT IN ({STOP})
), said AS (SELECT DISTINCT unnest({_tokens('text')}) AS term FROM ledger_records
), told AS (SELECT DISTINCT unnest({_tokens('text')}) AS term FROM documents)"""
CELL = "trim(string_split(regexp_replace(trim(raw_row), '^\\||\\|$', '', 'g'), '|')[{0}])"
TAIL = f"CASE WHEN contains({CELL.format(2)}, '**Resolved') THEN regexp_extract({CELL.format(2)}, '\\*\\*Resolved(.*)$', 1, 's') END"

NAMED = """n AS (SELECT record_id, unnest(refs) AS entity_id, generate_subscripts(refs, 1) AS n FROM rec WHERE kind IN ('claim', 'gap')
      ), first_ AS (SELECT record_id, arg_min(label, n) AS label FROM n JOIN ent USING (entity_id) WHERE ent.kind IN ('decision', 'unknown', 'proposal')
        AND label IS NOT NULL GROUP BY 1), anchor AS (SELECT rec.record_id, coalesce(label, rec.record_id) AS anchor FROM rec LEFT JOIN first_ USING (record_id))"""
GRAMS = "(SELECT {0} AS id, toks, unnest(range(1, len(toks) - 3)) AS p FROM (SELECT {0}, {1} AS toks FROM {2}) WHERE len(toks) >= 5)"

SQL = {
    "golden_grade": ANSWERED + ", " + NAMED + """, third AS (SELECT query_id, anchor FROM ranked JOIN anchor USING (record_id) WHERE admitted AND rank = 3
      ), g AS (SELECT o.query_id, o.query_id % 2 = 1 AS odd, outcome = 'matches' AS sure, EXISTS (SELECT 1 FROM held JOIN anchor USING (record_id)
        WHERE held.query_id = o.query_id AND position <= 3 AND anchor.anchor = third.anchor) AS found,
        EXISTS (SELECT 1 FROM beyond JOIN anchor USING (record_id) WHERE beyond.query_id = o.query_id AND anchor.anchor = third.anchor) AS pointed
        FROM o LEFT JOIN third ON third.query_id = o.query_id)
      SELECT CASE WHEN NOT odd THEN CASE WHEN sure THEN 'BLUFFED' ELSE 'abstained' END WHEN found AND sure THEN 'answered' WHEN found THEN 'UNDERCONFIDENT'
        WHEN sure THEN 'WRONG ANCHOR' WHEN pointed THEN 'pointed+beyond' ELSE 'MISSED' END AS verdict, count(*) AS n FROM g GROUP BY 1""",
    "quoted_questions": f"""WITH qg AS (SELECT id, p, toks[p:p + 4] AS g FROM {GRAMS.format('item_id', _tokens('question'), 'eval_items')}
      ), dg AS (SELECT id, p, toks[p:p + 4] AS g FROM {GRAMS.format('doc_id', _tokens('text'), 'documents')}
      ), hit AS (SELECT DISTINCT q.id AS query_id, d.id AS record_id, d.p, d.p - q.p AS slant FROM qg q JOIN dg d USING (g)
      ), run AS (SELECT query_id, record_id, slant, p - row_number() OVER (PARTITION BY query_id, record_id, slant ORDER BY p) AS isle FROM hit)
      SELECT query_id, record_id::VARCHAR AS record_id, max(n) AS run FROM (SELECT query_id, record_id, count(*) + 4 AS n FROM run
        GROUP BY query_id, record_id, slant, isle) GROUP BY 1, 2""",
    "attestation_weakest": """WITH l AS (SELECT DISTINCT seq AS line, author_known_by AS detail, CASE split_part(author_known_by, ' ', 1) WHEN 'attest:signed' THEN 3
        WHEN 'attest:unknown-key' THEN 2 WHEN 'attest:unsigned' THEN 1 WHEN 'attest:none' THEN 0 ELSE -1 END AS s FROM ledger_records WHERE author_known_by IS NOT NULL
      ), sp AS (SELECT DISTINCT line // 100 AS id FROM l)
      SELECT id, arg_min(detail, (s, line)) AS detail FROM sp JOIN l ON line BETWEEN id * 100 AND id * 100 + 149 GROUP BY id""",
    "mentions": r"""WITH m AS (SELECT doc_id::VARCHAR AS id, regexp_extract_all(' ' || replace(text, ' ', '  ') || ' ',
        '[^0-9A-Za-z-](([DH]-[0-9]{4}|U-[0-9]{1,3}))(?:[^0-9A-Za-z]|$)', 1) AS found FROM documents WHERE text IS NOT NULL
      ), o AS (SELECT id, unnest(found) AS mentioned, generate_subscripts(found, 1) AS p FROM m
      ), f AS (SELECT id, mentioned, min(p) AS p FROM o WHERE mentioned <> id GROUP BY ALL)
      SELECT id, (row_number() OVER (PARTITION BY id ORDER BY p) - 1)::INTEGER AS n, mentioned FROM f""",
    "record_out": WITH + """ SELECT record_id, kind, state, CASE WHEN len(refs) > 0 THEN len(refs) ELSE -1 END::INTEGER AS about,
      CASE WHEN len(sources) > 0 THEN len(sources) ELSE -1 END::INTEGER AS evidence FROM st""",
    "sync_dispositions": SYNC + """ SELECT s.identity, CASE WHEN p.identity IS NULL THEN 'fresh' WHEN p.digest = s.digest THEN 'unchanged'
      ELSE 'changed' END AS disposition FROM src s LEFT JOIN prior p USING (identity)""",
    "absent_records": SYNC + f""" SELECT identity FROM prior WHERE identity NOT IN (SELECT origin_key FROM register_unknowns
      WHERE ingested_at >= TIMESTAMP '{BEFORE}') AND NOT contains(split_part(identity, '#', -1), '/')""",
    "settlements": f"""WITH r AS (SELECT origin_key, arg_max(raw_row, (epoch_us(ingested_at), raw_row)) AS raw_row FROM register_unknowns GROUP BY 1
      ), t AS (SELECT origin_key, {TAIL} AS tail FROM r), c AS (SELECT origin_key, nullif(regexp_extract(tail, '(^|[^0-9A-Za-z-])([DH]-[0-9]{{4}})([^0-9A-Za-z]|$)', 2), '') AS claim
        FROM t WHERE tail IS NOT NULL)
      SELECT origin_key, CASE WHEN claim IS NULL THEN 'withdraw' ELSE 'answer' END AS action, claim FROM c""",
    "attestation_kinds": """SELECT CASE WHEN kind IN ('signed', 'unknown-key', 'unsigned', 'none') THEN kind END AS kind,
      CASE kind WHEN 'signed' THEN 3 WHEN 'unknown-key' THEN 2 WHEN 'unsigned' THEN 1 WHEN 'none' THEN 0 END::INTEGER AS strength, count(*) AS n
      FROM (SELECT regexp_extract(author_known_by, '^attest:([a-z-]+)( |$)', 1) AS kind FROM ledger_records) GROUP BY 1, 2""",
    "anchors": WITH + """, n AS (SELECT record_id, unnest(refs) AS entity_id, generate_subscripts(refs, 1) AS n FROM rec WHERE kind IN ('claim', 'gap')
      ), f AS (SELECT record_id, arg_min(label, n) AS label FROM n JOIN ent USING (entity_id) WHERE ent.kind IN ('decision', 'unknown', 'proposal')
        AND label IS NOT NULL GROUP BY 1) SELECT rec.record_id, coalesce(label, rec.record_id) AS anchor FROM rec LEFT JOIN f USING (record_id)""",
    "absent_vocabulary": "WITH " + ABSENT + " SELECT query_id, term FROM kept WHERE term NOT IN (SELECT term FROM said WHERE term IS NOT NULL)",
    "vocabulary_drift": "WITH " + ABSENT + """, was AS (SELECT * FROM kept WHERE term NOT IN (SELECT term FROM said WHERE term IS NOT NULL)
      ), now AS (SELECT * FROM was WHERE term NOT IN (SELECT term FROM told WHERE term IS NOT NULL))
      SELECT query_id, term FROM was WHERE query_id IN (SELECT query_id FROM now) EXCEPT SELECT query_id, term FROM now""",
    "redacted_view": f"""SELECT marked, gone, count(*) AS n FROM (SELECT DISTINCT {sql_id('record_id')} AS id, redacted_by IS NOT NULL AS marked,
      text IS NULL AS gone FROM ledger_records) GROUP BY 1, 2""",
}
