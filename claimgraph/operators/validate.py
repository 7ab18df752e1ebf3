"""Replay validation: each rule of the log as a query whose result is the violations.

A log is legal exactly if there are none. Every function gives ``rule, id`` (and ``detail``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.ids import norm_id
from claimgraph.schema import ENVELOPE_VERSION, LEGAL, opening_state


def _found(df: DataFrame, rule: str, key: str, detail: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.col(key).alias("id"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail")
    )


def time_goes_back(records: DataFrame) -> DataFrame:
    """Record-time below the greatest one before it in the log.

    The greatest time so far is found in two steps, over spans of the log and within each, so that
    no task takes the whole log.
    """
    span = F.floor(F.col("seq") / 100_000)
    rows = records.select("record_id", "seq", "recorded_at", span.alias("span"))
    tops = rows.groupBy("span").agg(F.max("recorded_at").alias("top"))
    # One row for each 100,000 records: small enough for a single window.
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("span", F.max("top").over(before).alias("before"))
    within = Window.partitionBy("span").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    late = rows.withColumn("inner", F.max("recorded_at").over(within)).join(tops, "span", "left")
    return _found(late.where(F.col("recorded_at") < F.greatest("before", "inner")), "time_goes_back", "record_id")


def empty_validity(records: DataFrame) -> DataFrame:
    return _found(records.where(F.col("valid_to") <= F.col("valid_from")), "empty_validity", "record_id")


def dangling(rows: DataFrame, key: str, ref: str, known: DataFrame, known_key: str, rule: str) -> DataFrame:
    """References to what is not there."""
    missing = rows.where(F.col(ref).isNotNull()).join(known, F.col(ref) == F.col(known_key), "left_anti")
    return _found(missing, rule, key, F.col(ref))


def supersedes_other_kind(records: DataFrame) -> DataFrame:
    old = records.select(F.col("record_id").alias("old"), F.col("kind").alias("old_kind"))
    joined = records.join(old, F.col("supersedes") == F.col("old"))
    return _found(joined.where(F.col("kind") != F.col("old_kind")), "supersedes_other_kind", "record_id", F.col("old"))


def repeated_refs(records: DataFrame) -> DataFrame:
    """An entity named twice; a relation may join an entity with itself."""
    prose = (F.col("kind") != "claim") | F.col("shape").isin("text", "pattern")
    twice = F.size("refs") > F.size(F.array_distinct("refs"))
    return _found(records.where(prose & twice), "repeated_refs", "record_id")


def bad_evidence(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Evidence that names no entity of the kind source."""
    named = records.select("record_id", F.explode("evidence").alias("e")).select("record_id", F.col("e.source").alias("source"))
    sources = entities.where(F.lower("kind") == "source").select(F.col("entity_id").alias("known"))
    return _found(
        named.where(F.col("source").isNotNull()).join(sources, F.col("source") == F.col("known"), "left_anti"),
        "bad_evidence", "record_id", F.col("source"),
    )


def unknown_version(records: DataFrame) -> DataFrame:
    return _found(records.where(~F.col("version").eqNullSafe(F.lit(ENVELOPE_VERSION))), "unknown_version", "record_id")


def blank_text(records: DataFrame) -> DataFrame:
    """Text claims and gaps with nothing in them. Redacted ones have lost it rightly."""
    worded = (F.col("kind") == "gap") | (F.col("shape") == "text")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return _found(records.where(worded & blank & F.col("redacted_by").isNull()), "blank_text", "record_id")


def agent_verdicts(effects: DataFrame) -> DataFrame:
    """Only people rule."""
    bad = effects.where(~F.col("author_kind").eqNullSafe(F.lit("human")))
    return _found(bad.select("verdict_id").distinct(), "agent_verdict", "verdict_id")


def illegal_transitions(records: DataFrame, effects: DataFrame) -> DataFrame:
    """Effects whose target is missing, of another kind, or not in the state the action starts from."""
    w = Window.partitionBy("target_id").orderBy("seq", "ordinal")
    steps = effects.withColumn("before", F.lag("new_state").over(w)).join(
        records.select(F.col("record_id").alias("target_id"), "kind"), "target_id", "left"
    )
    verb = F.when((F.col("action") == "promote") & (F.col("new_state") == "retired"), F.lit("retire")).otherwise(F.col("action"))
    rules = F.create_map(*[F.lit(x) for k, v in LEGAL.items() for x in (k, ",".join(v))])
    came = F.coalesce("before", opening_state(F.col("kind")))
    steps = steps.withColumn("verb", verb).withColumn("came", came)
    step = F.concat_ws(",", F.coalesce("kind", F.lit("")), F.coalesce("came", F.lit("")), F.coalesce("new_state", F.lit("")))
    bad = steps.where(~step.eqNullSafe(F.element_at(rules, F.col("verb"))))
    return _found(bad, "illegal_transition", "target_id", F.concat_ws(" ", F.coalesce("came", F.lit("nothing")), F.lit("->"), "verb"))


def unpromoted_answers(effects: DataFrame) -> DataFrame:
    """Answers whose claim (``reason``) was not promoted at their place in the log."""
    given = effects.where("action = 'answer'").select("seq", "ordinal", "target_id", norm_id(F.col("reason")).alias("claim"))
    moves = effects.select(F.col("target_id").alias("claim"), F.struct("seq", "ordinal").alias("at"), "new_state")
    earlier = given.join(moves.where(F.col("claim").isNotNull()), "claim", "left").withColumn(
        "came", F.when(F.col("at") < F.struct("seq", "ordinal"), F.col("new_state"))
    )
    held = earlier.groupBy("seq", "ordinal", "target_id", "claim").agg(
        F.max_by("came", F.when(F.col("came").isNotNull(), F.col("at"))).alias("came")
    )
    bad = held.where(~F.col("came").eqNullSafe(F.lit("promoted")))
    return _found(bad, "unpromoted_answer", "target_id", F.concat_ws(" ", F.coalesce("claim", F.lit("nothing")), F.coalesce("came", F.lit("never moved"))))


def unreceipted_redactions(records: DataFrame) -> DataFrame:
    """Redaction marks whose declaration is not in the log."""
    known = records.where(F.col("kind") == "redaction").select(F.col("record_id").alias("receipt"))
    marked = records.where(F.col("redacted_by").isNotNull())
    return _found(marked.join(known, F.col("redacted_by") == F.col("receipt"), "left_anti"), "unreceipted_redaction", "record_id")


def violations(records: DataFrame, effects: DataFrame, entities: DataFrame) -> DataFrame:
    ids = records.select(F.col("record_id").alias("known"))
    ents = entities.select(F.col("entity_id").alias("known")).distinct()
    refs = records.select("record_id", F.explode("refs").alias("ref"))
    parts = [
        time_goes_back(records), empty_validity(records), supersedes_other_kind(records), repeated_refs(records),
        dangling(records, "record_id", "supersedes", ids, "known", "dangling_supersedes"),
        dangling(refs, "record_id", "ref", ents, "known", "dangling_ref"),
        dangling(records, "record_id", "object_id", ents, "known", "dangling_object"),
        bad_evidence(records, entities), unknown_version(records), blank_text(records), agent_verdicts(effects),
        illegal_transitions(records, effects), unpromoted_answers(effects), unreceipted_redactions(records),
    ]
    return reduce(DataFrame.unionByName, parts)
