"""A change feed of inserts, updates and deletes to the current state of a table.

Signed multiset: every distinct change takes its before-image away (-1) and puts its
after-image in (+1); with the base rows added, what has a positive sum is the table.

The images need the state before each change. A record's changes are cut into spans of
time, so that a record with any share of the feed is spread over many tasks: a window
within each span, then one over the few spans of a record that carries the state on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.ids import norm_id, norm_label, strip

#: Length of the spans into which a record's changes are cut.
SPAN_SECONDS = 86_400

#: What each verdict does to its target.
VERDICT_STATE = {
    "promote": "promoted",
    "retire": "retired",
    "reject": "rejected",
    "answer": "answered",
    "withdraw": "withdrawn",
    "abandon": "abandoned",
    "score": "scored",
}


def action_state(action: Column, record_id: Column) -> Column:
    """The state that a displayed action gives to ``record_id`` (a normal id)."""
    verb = F.lower(F.regexp_extract(action, r"^\s*(\w+)", 1))
    retiring = norm_id(F.regexp_extract(action, r"(?i)retiring\s+((?:rec_)?[0-9a-z]{26})", 1))
    state = F.lit(None).cast("string")
    for name, to in VERDICT_STATE.items():
        state = F.when(verb == name, F.lit(to)).otherwise(state)
    return F.when((verb == "promote") & (retiring == record_id), F.lit("retired")).otherwise(state)


def changes_of(feed: DataFrame) -> DataFrame:
    """The verdict feed in the form that ``apply_changes`` takes."""
    return feed.select(
        norm_id(F.col("record_id")).alias("key"),
        F.lower(strip(F.col("op"))).alias("op"),
        norm_label(F.col("state")).alias("stated"),
        "action",
        F.col("verdict_at").alias("at"),
        F.col("log_seq").cast("long").alias("seq"),
        F.coalesce(norm_id(F.col("verdict_id")), F.lit("")).alias("change"),
    ).select(
        "key",
        "op",
        F.coalesce("stated", action_state(F.col("action"), F.col("key"))).alias("state"),
        "at",
        "seq",
        "change",
    )


def apply_changes(
    changes: DataFrame, base: DataFrame | None = None, span_seconds: int = SPAN_SECONDS
) -> DataFrame:
    """``key, state`` of what the table holds after all changes.

    ``changes``: key, op (insert, update, delete), state, at (time), seq (number), change
    (id of the change). Changes apply in order of ``at`` and then ``seq``; an insert puts
    the key in with its state or sets it, a delete takes it out, an update of a key that
    is not in does nothing. ``base``: key, state before the first change.

    Equal key, op, at, change and seq are one change; a delivery without number is the
    numbered change of equal key, op, at and change, if there is one. A null state on an
    update leaves the state; a key put in without a state has state ''. A null ``at``
    comes before every time; a null ``seq`` comes first at its instant for an insert, last
    for others. Changes with a null key or another op change nothing. Other columns are
    ignored. Of base rows with one key the greatest state counts. Empty tables are valid.
    """
    kinds = ("insert", "update", "delete")
    c = changes.where(F.col("key").isNotNull() & F.col("op").isin(*kinds)).select(
        F.lit(1).alias("level"),
        "key",
        F.coalesce(F.floor(F.unix_seconds("at") / span_seconds), F.lit(-(1 << 60))).alias("span"),
        "op",
        "at",
        "seq",
        F.coalesce("change", F.lit("")).alias("change"),
        "state",
    )
    if base is not None:
        rows = base.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("state").alias("state"))
        c = c.unionByName(
            rows.select(
                F.lit(0).alias("level"),
                "key",
                F.lit(-(1 << 61)).alias("span"),
                F.lit("insert").alias("op"),
                F.lit(None).cast(changes.schema["at"].dataType).alias("at"),
                F.lit(None).cast("long").alias("seq"),
                F.lit("").alias("change"),
                "state",
            )
        )
    # One shuffle: what follows groups and orders within (key, span).
    c = c.repartition("key", "span")
    same = ["key", "span", "level", "op", "at", "change"]
    c = c.groupBy(*same, "seq").agg(F.max("state").alias("state"))
    copies = Window.partitionBy(*same)
    c = (
        c.withColumn("numbered", F.max("seq").over(copies).isNotNull())
        .withColumn("state", F.coalesce("state", F.max("state").over(copies)))
        .where(F.col("seq").isNotNull() | ~F.col("numbered"))
    )
    unnumbered = F.when(F.col("op") == "insert", F.lit(-(1 << 62))).otherwise(F.lit(1 << 62))
    rank = F.when(F.col("op") == "insert", 0).when(F.col("op") == "update", 1).otherwise(2)
    c = c.select(
        "key",
        "span",
        F.struct(
            "level", "at", F.coalesce("seq", unnumbered).alias("seq"), rank.alias("rank"), "change"
        ).alias("order"),
        F.when(F.col("op") != "update", F.col("op")).alias("member"),
        F.when(F.col("op") == "insert", F.coalesce("state", F.lit("")))
        .when(F.col("op") == "update", F.col("state"))
        .alias("value"),
    )

    ordered = Window.partitionBy("key", "span").orderBy("order")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    ahead = ordered.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda x, w: F.last(x, ignorenulls=True).over(w)
    c = c.select(
        "key",
        "span",
        last("member", upto).alias("member"),
        last("value", upto).alias("value"),
        last("member", ahead).alias("member0"),
        last("value", ahead).alias("value0"),
        F.lead(F.lit(1)).over(ordered).isNull().alias("ends"),
    )
    earlier = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        c.where("ends")
        .select(
            "key", "span", last("member", earlier).alias("was"), last("value", earlier).alias("held")
        )
        .where(F.col("was") == "insert")
        .select("key", "span", "held")
    )
    c = c.join(carried, ["key", "span"], "left")

    def image(member: str, value: str) -> Column:
        return F.when(F.col(member) == "insert", F.col(value)).when(
            F.col(member).isNull() & F.col("held").isNotNull(), F.coalesce(value, "held")
        )

    images = c.select(
        "key",
        F.explode(
            F.array(
                F.struct(image("member0", "value0").alias("state"), F.lit(-1).alias("sign")),
                F.struct(image("member", "value").alias("state"), F.lit(1).alias("sign")),
            )
        ).alias("image"),
    ).select("key", "image.*").where(F.col("state").isNotNull())
    # A span's start image is its predecessor's end image, so the sums close over spans.
    return (
        images.groupBy("key", "state")
        .agg(F.sum("sign").alias("held"))
        .where(F.col("held") > 0)
        .select("key", "state")
    )
