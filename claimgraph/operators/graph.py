"""Traversal of a view's edges: expansion around answers, and cheapest paths.

Both advance a frontier by one join for each step and write it to the shared folder, so the plan
of a step does not hold those before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from claimgraph.session import Workspace

MAX_HOPS = 3


def adjacency(edges: DataFrame, direction: str = "both", predicates: list[str] | None = None) -> DataFrame:
    """``entity, other, edge, turn, seq``: outward edges come before inward ones, each in log order."""
    kept = edges.where(F.col("predicate").isin(predicates)) if predicates else edges
    out = kept.select(F.col("subject").alias("entity"), F.col("object_id").alias("other"), F.col("record_id").alias("edge"), F.lit(0).alias("turn"), "seq")
    back = kept.select(F.col("object_id").alias("entity"), F.col("subject").alias("other"), F.col("record_id").alias("edge"), F.lit(1).alias("turn"), "seq")
    if direction not in ("out", "in", "both"):
        raise ValueError("direction is out, in or both")
    ways = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return ways.where(F.col("entity").isNotNull() & F.col("other").isNotNull())


def reach(starts: DataFrame, ways: DataFrame, hops: int) -> DataFrame:
    """``query_id, seed, entity, hop, place, path``: the entities reached from each seed (query_id,
    seed, entity), first by the earliest way; ``path`` are the edges, ``place`` the order in a hop."""
    if not 0 <= hops <= MAX_HOPS:
        raise ValueError(f"hops is 0 to {MAX_HOPS}")
    ws = Workspace(starts.sparkSession, "reach")
    key = ["query_id", "seed"]
    w = Window.partitionBy(*key).orderBy("entity")
    level = starts.select(*key, "entity").distinct().select(
        *key, "entity", F.lit(0).alias("hop"), F.row_number().over(w).alias("place"), F.array().cast("array<string>").alias("path")
    )
    ways = ws.table(ways, "ways")
    seen = level = ws.table(level, "hop-0")
    for hop in range(1, hops + 1):
        step = level.join(ways, "entity").select(
            *key, F.col("other").alias("entity"), F.struct("place", "turn", "seq", "edge").alias("way"), "path"
        )
        new = step.join(seen.select(*key, "entity"), [*key, "entity"], "left_anti")
        new = new.groupBy(*key, "entity").agg(F.min_by(F.struct("way", "path"), "way").alias("first"))
        w = Window.partitionBy(*key).orderBy("first.way")
        level = new.select(
            *key, "entity", F.lit(hop).alias("hop"), F.row_number().over(w).alias("place"),
            F.concat("first.path", F.array("first.way.edge")).alias("path"),
        )
        level = ws.table(level, f"hop-{hop}")
        seen = seen.unionByName(level)
    return seen


def expand(seeds: DataFrame, edges: DataFrame, about: DataFrame, hops: int = 1, direction: str = "both", predicates: list[str] | None = None) -> DataFrame:
    """``query_id, n, record_id, seed_id, hop, path``: what is said about the entities around the seeds.

    ``seeds``: query_id, position, record_id, refs; ``about``: entity_id, seq, record_id. Each record
    once, by its first seed and way; seeds themselves are not given again.
    """
    starts = seeds.select("query_id", F.col("position").alias("seed"), F.explode("refs").alias("entity"))
    found = reach(starts, adjacency(edges, direction, predicates), hops).where(F.col("hop") > 0)
    said = found.join(about.select(F.col("entity_id").alias("entity"), "seq", "record_id"), "entity")
    said = said.join(seeds.select("query_id", "record_id"), ["query_id", "record_id"], "left_anti")
    order = F.struct("seed", "hop", "place", "seq")
    first = said.groupBy("query_id", "record_id").agg(F.min_by(F.struct("seed", "hop", "place", "seq", "path"), order).alias("f"))
    w = Window.partitionBy("query_id").orderBy("f.seed", "f.hop", "f.place", "f.seq")
    numbered = first.select("query_id", F.row_number().over(w).alias("n"), "record_id", "f.seed", "f.hop", "f.path")
    names = seeds.select("query_id", F.col("position").alias("seed"), F.col("record_id").alias("seed_id"))
    return numbered.join(names, ["query_id", "seed"]).select("query_id", "n", "record_id", "seed_id", "hop", "path")


def edge_costs(edges: DataFrame, panel: DataFrame | None, name: str, transform: str = "identity", default: float | None = None) -> DataFrame:
    """``edges`` with ``cost``: the measurement of that name on the edge's record, as it is or as
    -ln; a missing one excludes the edge, or counts ``default`` untransformed."""
    if transform not in ("identity", "neg_ln"):
        raise ValueError("transform is identity or neg_ln")
    if panel is None:
        value: Column = F.lit(None).cast("double")
        rows = edges
    else:
        rows = edges.join(
            panel.where(F.col("name") == name).select(F.col("target").alias("record_id"), F.col("value").alias("measured")), "record_id", "left"
        )
        # The logarithm of nought or less is no cost; it shows as a NaN and is refused when met.
        value = F.col("measured") if transform == "identity" else F.when(F.col("measured").isNull(), None).when(
            F.col("measured") > 0, -F.log("measured")
        ).otherwise(F.lit(float("nan")))
    rows = rows.withColumn("cost", value if default is None else F.coalesce(value, F.lit(float(default))))
    return rows.where(F.col("cost").isNotNull()).select("seq", "record_id", "subject", "predicate", "object_id", "cost")


#: Steps after which the tables of the best ways so far are put together into one.
COMPACT = 8


def shortest_paths(costs: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``source, entity, cost, path``: the cheapest path from each source to each entity, as edges.

    ``costs``: record_id, subject, object_id, cost; ``sources``: source; ``targets``: source,
    target, if only those are wanted; ways that already cost more than all of a source's targets are
    then given up. A source reaches itself by the empty path at cost 0. Equal costs: fewer edges,
    then the smaller ids. A cost that is negative, infinite or no number raises ValueError if a
    search meets it. The search goes on until no way gets cheaper; a step writes only what did.
    """
    spark = costs.sparkSession
    ws = Workspace(spark, "paths")
    ways = ws.table(costs.select(F.col("subject").alias("entity"), F.col("object_id").alias("other"), F.col("record_id").alias("edge"), "cost")
                    .where(F.col("subject").isNotNull() & F.col("object_id").isNotNull()), "ways")
    wanted = ws.table(targets.select("source", "target").distinct(), "targets") if targets is not None else None
    zero = sources.select("source").distinct().select(
        "source", F.col("source").alias("entity"), F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("path")
    )
    frontier = ws.table(zero, "best-0")
    layers, n = [frontier], 0
    bad = ~(F.col("step") >= 0) | F.isnan("step") | (F.col("step") == float("inf"))
    order = F.struct("cost", F.size("path"), "path")

    def best() -> DataFrame:
        # Of the ways to a pair that stand in several layers the last is the cheapest.
        found = reduce(DataFrame.unionByName, layers).groupBy("source", "entity").agg(F.min_by(F.struct("cost", "path"), order).alias("g"))
        return found.select("source", "entity", "g.*")

    while True:
        n += 1
        seen = Observation()
        grown = frontier.join(ways.withColumnRenamed("cost", "step"), "entity").select(
            "source", F.col("other").alias("entity"), "step", (F.col("cost") + F.col("step")).alias("cost"), F.concat("path", F.array("edge")).alias("path")
        )
        grown = grown.observe(seen, F.count(F.when(bad, 1)).alias("bad"))
        grown = grown.groupBy("source", "entity").agg(F.min_by(F.struct("cost", "path"), order).alias("g"))
        grown = grown.select("source", "entity", "g.*")
        old = reduce(DataFrame.unionByName, [x.select("source", "entity", "cost") for x in layers])
        old = old.groupBy("source", "entity").agg(F.min("cost").alias("old"))
        better = grown.join(old, ["source", "entity"], "left").where(F.col("old").isNull() | (F.col("cost") < F.col("old")))
        if wanted is not None:
            limit = wanted.join(old.select("source", F.col("entity").alias("target"), "old"), ["source", "target"], "left")
            limit = limit.groupBy("source").agg(F.when(F.count("old") == F.count("*"), F.max("old")).alias("limit"))
            better = better.join(limit, "source", "left").where(F.col("limit").isNull() | (F.col("cost") < F.col("limit"))).drop("limit")
        frontier = ws.table(better.drop("old"), f"frontier-{n}")
        if seen.get["bad"]:
            raise ValueError("an edge's cost is negative, infinite or no number")
        if frontier.isEmpty():
            break
        layers.append(frontier)
        if len(layers) > COMPACT:
            layers = [ws.table(best(), f"best-{n}")]
    if wanted is None:
        return best()
    found = best()
    return wanted.join(found, (found["source"] == wanted["source"]) & (F.col("entity") == F.col("target"))).select(found["source"], "entity", "cost", "path")
