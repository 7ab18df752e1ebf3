"""A corpus with known truth: topics with their own words, verdicts, contradictions and gaps.

Every topic is made by itself from the seed and its number, so a corpus of any size is made in
parallel and a topic is the same in each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMON = (
    "the of a and to in is on it for that with by this from at or an be as not are was but all can had one if they "
    "will when there each which their other about many then these so some"
).split()
SCHEMA = (
    "topic int, n int, kind string, shape string, text string, attr_name string, value_text string, author_kind string, "
    "state string, supersedes_n int, contradicts boolean"
)


@dataclass(frozen=True)
class Shape:
    topics: int = 24
    claims: int = 8
    bulk: int = 64
    seed: int = 7

    @classmethod
    def of_size(cls, n: int, seed: int = 7) -> Shape:
        topics = max(int(n**0.5), 4)
        return cls(topics, max(n // topics, 2), n, seed)


def topic_words(seed: int, topic: int) -> list[str]:
    r = Random(f"{seed}/{topic}/words")
    return ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(3)) for _ in range(6)]


def prose(r: Random, words: list[str]) -> str:
    """40 to 99 words, every seventh of the topic."""
    return " ".join(words[r.randrange(6)] if i % 7 == 3 else r.choice(COMMON) for i in range(r.randrange(40, 100)))


def topic_rows(seed: int, topic: int, claims: int) -> list[tuple]:
    r, words = Random(f"{seed}/{topic}"), topic_words(seed, topic)
    rows = []
    for c in range(claims):
        state = {0: "proposed", 1: "rejected", 2: "retired"}.get(c % 10, "promoted")
        rows.append((topic, len(rows), "claim", "text", prose(r, words), None, None, "agent" if c % 5 == 0 else "human", state, None, False))
        if state == "retired":  # by the claim that takes its place
            rows.append((topic, len(rows), "claim", "text", prose(r, words), None, None, "human", "promoted", len(rows) - 1, False))
    gap = {0: "answered", 1: "withdrawn"}.get(topic % 4, "registered")
    rows.append((topic, len(rows), "gap", None, f"how does {words[0]} depend on {words[1]}", None, None, "human", gap, None, False))
    if topic % 8 == 3:
        for value in ("12", "15"):
            rows.append((topic, len(rows), "claim", "attribute", f"limit {value}", "limit", value, "human", "promoted", None, True))
    if topic % 12 == 5:
        rows.append((topic, len(rows), "hypothesis", None, prose(r, words), None, None, "human", "abandoned", None, False))
    return rows


def generate(spark: SparkSession, shape: Shape = Shape()) -> DataFrame:
    """The records of all topics with the states that they are to have."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = [row for t in b["id"] for row in topic_rows(shape.seed, int(t), shape.claims)]
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(supersedes_n=pd.array(out["supersedes_n"], dtype="Int32"))

    topics = spark.range(shape.topics).mapInPandas(make, SCHEMA)
    bulk = spark.range(shape.bulk).select(
        F.lit(-1).alias("topic"), F.col("id").cast("int").alias("n"), F.lit("claim").alias("kind"), F.lit("text").alias("shape"),
        F.concat(F.lit("bulk record number "), F.col("id").cast("string")).alias("text"), F.lit(None).cast("string").alias("attr_name"),
        F.lit(None).cast("string").alias("value_text"), F.lit("human").alias("author_kind"), F.lit("promoted").alias("state"),
        F.lit(None).cast("int").alias("supersedes_n"), F.lit(False).alias("contradicts"),
    )
    return topics.unionByName(bulk)


def as_ledger(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Generated rows as records and effects, with numbers that put verdicts behind the records."""
    key = lambda t, n: F.format_string("rec_%06d_%04d", t, n)
    at = F.lit("2025-01-01").cast("timestamp")
    seq = (F.col("topic").cast("long") + 1) * 100_000 + F.col("n")
    records = rows.select(
        seq.alias("seq"), key("topic", "n").alias("record_id"), "kind", "shape", F.lit("keeper").alias("author_name"), "author_kind",
        at.alias("recorded_at"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
        F.when(F.col("supersedes_n").isNotNull(), key("topic", "supersedes_n")).alias("supersedes"), "text",
        F.format_string("ent_%06d", "topic").alias("subject"), "attr_name", "value_text", F.lit(None).cast("string").alias("predicate"),
        F.lit(None).cast("string").alias("object_id"), F.array(F.format_string("ent_%06d", "topic")).alias("refs"),
    )
    steps = F.when(F.col("state") == "retired", F.array(F.lit("promoted"), F.lit("retired"))).otherwise(F.array("state"))
    moves = rows.where(~F.col("state").isin("proposed", "registered")).select(
        F.posexplode(steps).alias("ordinal", "new_state"), seq.alias("base"), key("topic", "n").alias("target_id")
    )
    effects = moves.select(
        (F.col("base") + (1 << 40)).alias("seq"), "ordinal", "target_id", F.lit("v").alias("verdict_id"), at.alias("recorded_at"),
        F.lit("rule").alias("action"), "new_state", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("basis"),
        F.lit("human").alias("author_kind"),
    )
    return records, effects
