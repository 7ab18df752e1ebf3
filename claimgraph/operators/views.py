"""Bitemporal views: what the record said at one time about another, and the graph under a view."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.operators.state import with_state
from claimgraph.schema import is_live

#: The claim states that each filter admits.
FILTERS = {
    "promoted": ("promoted",),
    "promoted_and_proposed": ("promoted", "proposed"),
    "all": ("proposed", "promoted", "retired", "rejected"),
}


@dataclass(frozen=True)
class ViewSpec:
    """A fully pinned view: the clock is read by the caller, never within a plan."""

    record_time: datetime
    valid_at: datetime
    states: str = "promoted"
    author_kind: str | None = None

    @classmethod
    def at(cls, moment: datetime, **more: object) -> ViewSpec:
        return cls(moment, moment, **more)


def contains(valid_from: Column, valid_to: Column, at: Column) -> Column:
    return (valid_from <= at) & (valid_to.isNull() | (at < valid_to))


def admits_envelope(view: ViewSpec) -> Column:
    ok = (F.col("recorded_at") <= F.lit(view.record_time)) & contains(
        F.col("valid_from"), F.col("valid_to"), F.lit(view.valid_at)
    )
    return ok & (F.col("author_kind") == view.author_kind) if view.author_kind else ok


def admitted(records: DataFrame, effects: DataFrame, view: ViewSpec) -> DataFrame:
    """The records a view admits, with their state as of its record-time. Claims by the state filter;
    gaps and hypotheses while open, or in any state under ``all``; verdicts and redactions never."""
    if view.states not in FILTERS:
        raise ValueError(f"states must be one of {sorted(FILTERS)}")
    state = with_state(records.where(admits_envelope(view)), effects, view.record_time)
    open_ = F.col("kind").isin("gap", "hypothesis") if view.states == "all" else is_live(F.col("kind"), F.col("state"))
    return state.where(((F.col("kind") == "claim") & F.col("state").isin(*FILTERS[view.states])) | open_)


def edges(view_rows: DataFrame) -> DataFrame:
    """The relation claims of a view as edges, parallel ones kept, in log order by seq."""
    return view_rows.where(F.col("shape") == "relation").select("seq", "record_id", "subject", "predicate", "object_id")


def degrees(view_edges: DataFrame) -> DataFrame:
    """``entity_id, out_degree, in_degree``."""
    ends = view_edges.select(
        F.explode(
            F.array(
                F.struct(F.col("subject").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("object_id").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")
    )


def properties(view_rows: DataFrame) -> DataFrame:
    """``entity_id, attr_name, claims, conflicted, value``: the first admitted value in log order of
    each entity and name; conflicted when two claims or more are admitted, even if they agree."""
    return (
        view_rows.where(F.col("shape") == "attribute")
        .groupBy(F.col("subject").alias("entity_id"), "attr_name")
        .agg(F.count("*").alias("claims"), F.min_by("value_text", "seq").alias("value"))
        .withColumn("conflicted", F.col("claims") >= 2)
    )


def property_claims(view_rows: DataFrame) -> DataFrame:
    """``entity_id, attr_name, n, record_id, value_text``: all admitted claims in log order."""
    w = Window.partitionBy("subject", "attr_name").orderBy("seq")
    return view_rows.where(F.col("shape") == "attribute").select(
        F.col("subject").alias("entity_id"), "attr_name", F.row_number().over(w).alias("n"), "record_id", "value_text"
    )


def unanimous_values(view_rows: DataFrame) -> DataFrame:
    """``entity_id, attr_name, value`` where all admitted claims agree."""
    g = view_rows.where(F.col("shape") == "attribute").groupBy(F.col("subject").alias("entity_id"), "attr_name")
    told = F.coalesce("value_text", F.lit("\0"))
    both = g.agg(F.min(told).alias("lo"), F.max(told).alias("hi"), F.min_by("value_text", "seq").alias("value"))
    return both.where(F.col("lo") == F.col("hi")).select("entity_id", "attr_name", "value")


def about(view_rows: DataFrame) -> DataFrame:
    """``entity_id, seq, record_id``: prose and gaps by the entities they name."""
    prose = view_rows.where(F.col("shape").isin("text", "pattern") | (F.col("kind") == "gap"))
    return prose.select(F.explode("refs").alias("entity_id"), "seq", "record_id", "kind")


def in_scope(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Rows that name an entity of the scope; an empty scope is none at all."""
    return rows.where(F.arrays_overlap("refs", F.array(*[F.lit(s) for s in scope]))) if scope else rows


def find_entities(entities: DataFrame) -> DataFrame:
    """``kind, label, entity_id``: the first id of each kind and label."""
    return entities.where(F.col("label").isNotNull()).groupBy("kind", "label").agg(F.min("entity_id").alias("entity_id"))


def is_stale(index_seq: int, records: DataFrame) -> bool:
    """Whether an index built up to ``index_seq`` lags behind the log."""
    return (records.agg(F.max("seq")).first()[0] or -1) > index_seq
