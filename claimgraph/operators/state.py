"""The state fold and what is read from it. State is never stored: a record's state is that of
the last effect on it in the order of the log, or its opening state.

All functions take the tables of ``claimgraph.schema``. Null ids match nothing; empty tables
give empty results; where rows tie, the lower ``seq`` comes first.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.schema import is_live, opening_state

ORDER = ("seq", "ordinal")
#: What makes two records the same statement.
CONTENT = ("kind", "shape", "text", "subject", "attr_name", "value_text", "predicate", "object_id", "refs")


def last_effects(effects: DataFrame, at: datetime | None = None) -> DataFrame:
    """``record_id, state`` of the last effect on each target, up to a record-time."""
    seen = effects if at is None else effects.where(F.col("recorded_at") <= F.lit(at))
    return seen.groupBy(F.col("target_id").alias("record_id")).agg(F.max_by("new_state", F.struct(*ORDER)).alias("state"))


def with_state(records: DataFrame, effects: DataFrame, at: datetime | None = None) -> DataFrame:
    """``records`` with ``state``; at a past record-time only the records that then existed."""
    seen = records if at is None else records.where(F.col("recorded_at") <= F.lit(at))
    folded = seen.join(last_effects(effects, at), "record_id", "left")
    return folded.withColumn("state", F.coalesce("state", opening_state(F.col("kind"))))


def history(effects: DataFrame) -> DataFrame:
    """``record_id, n, seq, verdict_id, action, new_state``: the verdicts on each record, numbered in log order."""
    w = Window.partitionBy("target_id").orderBy("seq", "ordinal")
    return effects.select(
        F.col("target_id").alias("record_id"), F.row_number().over(w).alias("n"), "seq", "verdict_id", "action", "new_state"
    )


def promoted_claims(records: DataFrame, effects: DataFrame) -> DataFrame:
    return with_state(records, effects).where((F.col("kind") == "claim") & (F.col("state") == "promoted"))


def registered_gaps(records: DataFrame, effects: DataFrame) -> DataFrame:
    return with_state(records, effects).where((F.col("kind") == "gap") & (F.col("state") == "registered"))


def replaced_by(records: DataFrame) -> DataFrame:
    """``record_id, replacement, seq``: every record that supersedes another, forks kept, in log order by seq."""
    named = records.where(F.col("supersedes").isNotNull())
    known = records.select(F.col("record_id").alias("known"))
    return named.join(known, F.col("supersedes") == F.col("known"), "left_semi").select(
        F.col("supersedes").alias("record_id"), F.col("record_id").alias("replacement"), "seq"
    )


def _content(records: DataFrame, columns: tuple[str, ...] = CONTENT) -> list[Column]:
    """A narrow key and the content itself, so that equal hashes alone make no twins."""
    return [F.xxhash64(*columns), *[F.col(c) for c in columns]]


def identical_groups(records: DataFrame) -> DataFrame:
    """``record_id, first_id, twins``: records that state the same, with the first of them and their number."""
    w = Window.partitionBy(*_content(records))
    return (
        records.withColumn("first_id", F.min_by("record_id", F.struct("seq", "record_id")).over(w))
        .withColumn("twins", F.count("*").over(w))
        .where(F.col("twins") > 1)
        .select("record_id", "first_id", "twins")
    )


def pending(records: DataFrame, effects: DataFrame) -> DataFrame:
    """``record_id, seq, queue, head``: the proposed claims. ``superseded``: some record replaces it,
    whatever became of that; ``identical``: an earlier queued claim (``head``) states the same; else ``queued``."""
    proposed = with_state(records, effects).where((F.col("kind") == "claim") & (F.col("state") == "proposed"))
    replaced = records.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("record_id")).distinct()
    marked = proposed.join(replaced.withColumn("replaced", F.lit(True)), "record_id", "left")
    w = Window.partitionBy(*_content(marked), F.col("replaced").isNull())
    head = F.min_by("record_id", F.struct("seq", "record_id")).over(w)
    marked = marked.withColumn("head", head)
    queue = (
        F.when(F.col("replaced"), F.lit("superseded"))
        .when(F.col("head") != F.col("record_id"), F.lit("identical"))
        .otherwise(F.lit("queued"))
    )
    return marked.withColumn("queue", queue).select(
        "record_id", "seq", "queue", F.when(F.col("queue") == "identical", F.col("head")).alias("head")
    )


def ratification(records: DataFrame, effects: DataFrame) -> DataFrame:
    """``basis, n``: the promotions of what is promoted now, single ones or by the basis of their set."""
    promoted = promoted_claims(records, effects).select("record_id")
    given = effects.where((F.col("new_state") == "promoted") & (F.col("action") == "promote"))
    return (
        given.join(promoted, F.col("target_id") == F.col("record_id"), "left_semi")
        .groupBy(F.coalesce("basis", F.lit("individually")).alias("basis"))
        .agg(F.count("*").alias("n"))
    )


def review_queue(records: DataFrame, effects: DataFrame, now: datetime) -> DataFrame:
    """``record_id, queue``: promoted claims whose review is due, or that name no trigger at all."""
    queue = F.when(F.col("due_at") <= F.lit(now), F.lit("due")).when(
        F.col("due_at").isNull() & F.col("on_event").isNull(), F.lit("missing")
    )
    return promoted_claims(records, effects).withColumn("queue", queue).where(F.col("queue").isNotNull()).select(
        "record_id", "queue"
    )


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Half-open intervals; a null end never comes."""
    return (b_to.isNull() | (a_from < b_to)) & (a_to.isNull() | (b_from < a_to))


def contradictions(records: DataFrame, effects: DataFrame, at: datetime | None = None) -> DataFrame:
    """``subject, attr_name, record_a, record_b``: promoted attributes of one subject and name whose
    validities overlap, equal values too; a comes first in the log.

    Pairs are the result itself, so a subject with many overlapping claims has many rows; the join
    is on subject, name, and Spark splits its skewed partitions.
    """
    state = with_state(records, effects, at).where((F.col("shape") == "attribute") & (F.col("state") == "promoted"))
    side = lambda s: state.select(
        "subject", "attr_name", *[F.col(c).alias(f"{s}_{c}") for c in ("record_id", "seq", "valid_from", "valid_to")]
    )
    c = F.col
    return (
        side("a")
        .join(side("b"), ["subject", "attr_name"])
        .where((c("a_seq") < c("b_seq")) & overlaps(c("a_valid_from"), c("a_valid_to"), c("b_valid_from"), c("b_valid_to")))
        .select("subject", "attr_name", c("a_record_id").alias("record_a"), c("b_record_id").alias("record_b"))
    )


def panel(measurements: DataFrame) -> DataFrame:
    """The last value of each (target, name) in the order of the log, whatever its own time says."""
    return measurements.groupBy("target", "name").agg(
        F.max_by(F.struct("value", "at", "by"), "seq").alias("last")
    ).select("target", "name", "last.*")


def open_questions(records: DataFrame, effects: DataFrame) -> DataFrame:
    state = with_state(records, effects)
    return state.where(is_live(F.col("kind"), F.col("state")))
