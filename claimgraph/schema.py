"""Types of the log: entities, records, effects, measurements, and the wire events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "entity_id string, kind string, label string, redacted_by string"
RECORD = (
    "seq long, record_id string, kind string, shape string, author_name string, author_kind string, "
    "channel string, reference string, recorded_at timestamp, valid_from timestamp, valid_to timestamp, "
    "due_at timestamp, on_event string, supersedes string, text string, subject string, attr_name string, "
    "value_text string, predicate string, object_id string, refs array<string>, "
    "evidence array<struct<source:string,span:string>>, redacted_by string, version short"
)
EFFECT = (
    "seq long, ordinal int, verdict_id string, recorded_at timestamp, target_id string, action string, "
    "new_state string, reason string, basis string, author_kind string"
)
MEASUREMENT = "seq long, target string, name string, value double, at timestamp, by string"
EDGE = "seq long, record_id string, subject string, predicate string, object_id string"

#: Kinds of records, and the states of each kind with its opening state first.
KINDS = ("claim", "gap", "hypothesis", "verdict", "redaction")
STATES = {
    "claim": ("proposed", "promoted", "retired", "rejected"),
    "gap": ("registered", "answered", "withdrawn"),
    "hypothesis": ("registered", "scored", "abandoned"),
}
#: The state from which each action may take its target, and the kind of target.
LEGAL = {
    "promote": ("claim", "proposed", "promoted"),
    "reject": ("claim", "proposed", "rejected"),
    "retire": ("claim", "promoted", "retired"),
    "answer": ("gap", "registered", "answered"),
    "withdraw": ("gap", "registered", "withdrawn"),
    "score": ("hypothesis", "registered", "scored"),
    "abandon": ("hypothesis", "registered", "abandoned"),
}
#: Reasons that verdicts name.
RETIRE_REASONS = ("Superseded", "NoLongerTrue", "PromotedInError")
CLOSE_REASONS = ("Superseded", "AnsweredElsewhere", "NoLongerRelevant", "RegisteredInError", "Unstated")
BASES = ("Ingestion", "OneAct", "ReviewedInFull")
ENVELOPE_VERSION = 1


def opening_state(kind: Column) -> Column:
    return F.when(kind == "claim", F.lit("proposed")).when(kind.isin("gap", "hypothesis"), F.lit("registered"))


def is_live(kind: Column, state: Column) -> Column:
    """Gaps and hypotheses that are still open."""
    return kind.isin("gap", "hypothesis") & (state == "registered")
