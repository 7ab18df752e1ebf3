"""How verdicts, states and texts are shown to a reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown_id(c: Column, prefix: str = "rec") -> Column:
    """On the wire ids are bare, elsewhere they carry their prefix."""
    return F.when(c.isNotNull() & ~c.startswith(f"{prefix}_"), F.concat(F.lit(f"{prefix}_"), c)).otherwise(c)


def describe_action(action: Column) -> Column:
    """A verdict's action (the struct of the wire) in words, as change feeds carry it."""
    of = lambda name, field: action[name][field]
    some = lambda name, field: F.coalesce(F.size(of(name, field)), F.lit(0))
    record = lambda name, field: shown_id(of(name, field))
    bracket = lambda c: F.concat(F.lit(" ("), c, F.lit(")"))
    verb = lambda word, *rest: F.concat(F.lit(f"{word} "), *rest)
    retiring = record("Promote", "retiring")
    return (
        F.when(action["Promote"].isNotNull(), verb(
            "promote", record("Promote", "target"), F.when(retiring.isNull(), "").otherwise(bracket(F.concat(F.lit("retiring "), retiring)))
        ))
        .when(action["PromoteSet"].isNotNull(), verb(
            "promote", some("PromoteSet", "targets").cast("string"), F.lit(" claim(s) on the basis of "), of("PromoteSet", "basis"),
            F.when(some("PromoteSet", "retiring") > 0, F.concat(F.lit(", retiring "), some("PromoteSet", "retiring").cast("string"))).otherwise(""),
        ))
        .when(action["Retire"].isNotNull(), verb("retire", record("Retire", "target"), bracket(of("Retire", "reason"))))
        .when(action["Reject"].isNotNull(), verb("reject", record("Reject", "target")))
        .when(action["Answer"].isNotNull(), verb("answer", record("Answer", "gap"), F.lit(" with "), record("Answer", "with_claim")))
        .when(action["Withdraw"].isNotNull(), verb("withdraw", record("Withdraw", "gap"), bracket(of("Withdraw", "reason"))))
        .when(action["Abandon"].isNotNull(), verb("abandon", record("Abandon", "hypothesis"), bracket(of("Abandon", "reason"))))
        .when(action["Score"].isNotNull(), verb("score", record("Score", "hypothesis"), F.lit(" "), of("Score", "outcome")))
    )


def state_label(state: Column) -> Column:
    return F.coalesce(state, F.lit("not in the record"))


def display_text(pattern: Column, text: Column) -> Column:
    """What a reader sees: of a pattern its solution first, then what it rests on; else the indexed text."""
    part = lambda title, c: F.when(F.length(c) > 0, F.concat(F.lit(f"\n\n{title}: "), c)).otherwise("")
    forces = F.array_join(F.transform(pattern["forces"], lambda f: F.trim(f)), "; ")
    laid_out = F.concat(F.trim(pattern["solution"]), part("Context", F.trim(pattern["context"])), part("Forces", forces))
    return F.when(pattern.isNotNull(), laid_out).otherwise(text)
