"""The test tables as a ledger: each delivery once, ids and labels in one spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.functions.ids import norm_id, norm_label
from claimgraph.operators.changefeed import action_state
from claimgraph.plans.tables import table


def entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").select(
        norm_id(F.col("entity_id"), "ent").alias("entity_id"), norm_label(F.col("kind")).alias("kind"),
        norm_label(F.col("label")).alias("label"), "redacted_by",
    )
    return rows.distinct()


def records(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of one record are equal but for ``ingested_at``: any of them is the record."""
    ent = lambda c: norm_id(F.col(c), "ent").alias(c)
    return (
        table(spark, d, "ledger_records")
        .select(
            "seq", norm_id(F.col("record_id")).alias("record_id"), "kind", "shape", "author_name",
            norm_label(F.col("author_kind")).alias("author_kind"), F.col("source_channel").alias("channel"),
            F.col("source_reference").alias("reference"), "recorded_at", "valid_from", "valid_to", "due_at", "on_event",
            norm_id(F.col("supersedes")).alias("supersedes"), "text",
            norm_id(F.col("about_key"), "ent").alias("subject"), "attr_name", "value_text", "predicate", ent("object_id"),
            F.transform("refs", lambda r: norm_id(r, "ent")).alias("refs"),
            F.transform("evidence", lambda e: F.struct(norm_id(e["source"], "ent").alias("source"), e["span"].alias("span"))).alias("evidence"),
            "redacted_by", "version",
        )
        .where(F.col("record_id").isNotNull())
        .dropDuplicates(["record_id"])
    )


def effects(spark: SparkSession, d: str) -> DataFrame:
    """The updates of the feed: each number once, and each change that no delivery numbers.

    A delivery without number is the numbered change of equal record, verdict and time, if there is
    one. Else it stands by its time among the record's numbered changes: ``seq`` is the number of the
    last that was made up to then (null if none was), ``ordinal`` counts behind it; numbered have 0.
    """
    rows = table(spark, d, "verdict_feed").select(
        F.col("log_seq").alias("seq"), norm_id(F.col("record_id")).alias("target_id"), norm_label(F.col("op")).alias("op"),
        norm_id(F.col("verdict_id")).alias("verdict_id"), F.col("verdict_at").alias("recorded_at"), "action",
        norm_label(F.col("state")).alias("state"), norm_label(F.col("author_kind")).alias("author_kind"),
    )
    rows = rows.where((F.col("op") == "update") & F.col("target_id").isNotNull())
    rows = rows.withColumn("state", F.coalesce("state", action_state(F.col("action"), F.col("target_id"))))
    # An answer's reason is its claim.
    reason = F.regexp_extract("action", r"\((\w+)\)\s*$", 1)
    claim = F.regexp_extract("action", r"(?i)^\s*answer\s+\S+\s+with\s+(\S+)", 1)
    basis = F.regexp_extract("action", r"(?i)on the basis of (\w+)", 1)
    none = lambda c: F.when(c != "", c)
    same = ["target_id", "verdict_id", "recorded_at"]
    # Deliveries of a number are one change whatever else they say; those without are told apart by ``same``.
    loose = [F.when(F.col("seq").isNull(), F.col(c)).alias(f"loose_{c}") for c in same]
    changes = rows.groupBy("seq", *loose).agg(
        F.max("verdict_id").alias("verdict_id"), F.max("recorded_at").alias("recorded_at"),
        F.max("target_id").alias("target_id"), F.max(F.lower(F.regexp_extract("action", r"^\s*(\w+)", 1))).alias("action"),
        F.max("state").alias("new_state"), F.max(F.coalesce(none(claim), none(reason))).alias("reason"), F.max(none(basis)).alias("basis"),
        F.max("author_kind").alias("author_kind"),
    )
    # One shuffle: what follows groups and orders within a record.
    copies = Window.partitionBy(*same)
    changes = changes.repartition("target_id").withColumns(
        {"copy": F.max("seq").over(copies), "new_state": F.coalesce("new_state", F.max("new_state").over(copies))}
    )
    changes = changes.where(F.col("seq").isNotNull() | F.col("copy").isNull())
    loose_ = F.col("seq").isNull()
    upto = Window.partitionBy("target_id").orderBy("recorded_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = changes.withColumn("place", F.coalesce("seq", F.max("seq").over(upto)))
    behind = Window.partitionBy("target_id", "place", loose_).orderBy("recorded_at", "verdict_id")
    ordinal = F.when(loose_, F.row_number().over(behind)).otherwise(F.lit(0))
    return placed.select(
        F.col("place").alias("seq"), ordinal.alias("ordinal"), "verdict_id", "recorded_at", "target_id", "action",
        "new_state", "reason", "basis", "author_kind",
    )


def measurements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("target"), F.col("event_type").alias("name"),
        "value", F.col("ts").alias("at"), F.lit(None).cast("string").alias("by"),
    )


def reliability(records_: DataFrame) -> DataFrame:
    """A measurement on most relation records, in (0, 1], for paths of greatest likelihood."""
    return records_.where((F.col("shape") == "relation") & (F.col("seq") % 7 != 0)).select(
        F.col("record_id").alias("target"), F.lit("success").alias("name"), ((F.col("seq") % 90 + 10) / 100.0).alias("value")
    )


ID = "'{p}_' || regexp_replace(upper(trim({c}, ' \t\r\n')), '^{P}_', '')"


def sql_id(c: str, p: str = "rec") -> str:
    return ID.format(p=p, P=p.upper(), c=c)


LABEL = "nullif(lower(trim({0}, ' \t\r\n')), '')"

#: The same tables in SQL, for the checks; ``pos`` orders a record's changes.
WITH = rf"""
WITH ent AS (SELECT DISTINCT {sql_id('entity_id', 'ent')} AS entity_id, {LABEL.format('kind')} AS kind,
    {LABEL.format('label')} AS label, redacted_by FROM entities
), rec AS (SELECT DISTINCT seq, {sql_id('record_id')} AS record_id, kind, shape, author_name,
    {LABEL.format('author_kind')} AS author_kind, recorded_at, valid_from, valid_to, due_at, on_event,
    {sql_id('supersedes')} AS supersedes, text, {sql_id('about_key', 'ent')} AS subject, attr_name, value_text, predicate,
    {sql_id('object_id', 'ent')} AS object_id, list_transform(refs, lambda r: {sql_id('r', 'ent')}) AS refs,
    list_transform(evidence, lambda e: {sql_id('e.source', 'ent')}) AS sources, redacted_by, version FROM ledger_records
), eff0 AS (SELECT log_seq AS seq, {sql_id('record_id')} AS target_id, {sql_id('verdict_id')} AS verdict_id,
    verdict_at AS recorded_at, lower(split_part(trim(action), ' ', 1)) AS action, action AS said, {LABEL.format('state')} AS state,
    {LABEL.format('author_kind')} AS author_kind FROM verdict_feed WHERE {LABEL.format('op')} = 'update'
), eff1 AS (SELECT seq, max(verdict_id) AS verdict_id, max(recorded_at) AS recorded_at, max(target_id) AS target_id,
    max(action) AS action, max(coalesce(state, CASE WHEN action = 'promote' AND contains(upper(said), 'RETIRING ' || upper(target_id))
      THEN 'retired' ELSE MAP {{'promote': 'promoted', 'retire': 'retired', 'reject': 'rejected', 'answer': 'answered',
      'withdraw': 'withdrawn', 'abandon': 'abandoned', 'score': 'scored'}}[action] END)) AS new_state, max(author_kind) AS author_kind,
      max(nullif(regexp_extract(said, '(?i)^\s*answer\s+\S+\s+with\s+(\S+)', 1), '')) AS said_claim
    FROM eff0 GROUP BY seq, CASE WHEN seq IS NULL THEN concat_ws('/', target_id, verdict_id, epoch_us(recorded_at)) END
), own AS (SELECT l.* FROM eff1 l WHERE l.seq IS NULL AND NOT EXISTS (SELECT 1 FROM eff1 n WHERE n.seq IS NOT NULL
    AND n.target_id = l.target_id AND n.verdict_id = l.verdict_id AND n.recorded_at = l.recorded_at)
), placed AS (SELECT l.target_id, l.verdict_id, l.recorded_at, any_value(l.action) AS action, any_value(l.new_state) AS new_state,
    any_value(l.author_kind) AS author_kind, any_value(l.said_claim) AS said_claim, max(n.seq) AS seq FROM own l LEFT JOIN eff1 n ON n.target_id = l.target_id
    AND n.recorded_at <= l.recorded_at GROUP BY 1, 2, 3
), eff AS (SELECT *, coalesce(seq, -1) * 1000000 + nth AS pos FROM (
    SELECT seq, 0 AS nth, verdict_id, recorded_at, target_id, action, new_state, author_kind, said_claim FROM eff1 WHERE seq IS NOT NULL
    UNION ALL SELECT seq, row_number() OVER (PARTITION BY target_id, seq ORDER BY recorded_at, verdict_id), verdict_id, recorded_at,
      target_id, action, new_state, author_kind, said_claim FROM placed)
), last AS (SELECT target_id AS record_id, arg_max(new_state, pos) AS state FROM eff GROUP BY 1
), st AS (SELECT r.*, coalesce(l.state, CASE kind WHEN 'claim' THEN 'proposed' ELSE 'registered' END) AS state
    FROM rec r LEFT JOIN last l USING (record_id)
)"""
