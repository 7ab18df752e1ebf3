"""Parent-child rows to full hierarchies.

Level-wise frontier joins: the roots are level 0, and each join extends the frontier by the
nodes that reach it in up to eight steps, with their paths. Its result is written to the
shared folder, so every plan is one join whatever the depth. Nodes that no level reaches
hang on a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.session import Workspace

#: A join advances by two to this power levels.
STRIDE_DOUBLINGS = 3
#: Bytes up to which a frontier is broadcast, its rows being counted before, and those of an id in it.
BROADCAST_BYTES, ID_BYTES = 8_000_000, 48
#: After so many joins the steps that are used up are taken out of the table.
COMPACT_EVERY = 4

TREE = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("on_cycle", T.BooleanType()),
    ]
)


def hierarchy(rows: DataFrame, node: Column, parent: Column) -> DataFrame:
    """Each node once: ``node, parent, root, depth, path, on_cycle``.

    ``path`` runs from the root to the node. A parent that is no node counts as none.
    A node whose way up never ends has depth -1, a null path and as root the smallest
    node of the cycle it reaches; ``on_cycle`` tells members of the cycle itself.

    Rows with a null node are no nodes and give none. A node in several rows is one
    node; if its rows name different parents, the smallest named parent is taken.
    Other columns of ``rows`` are ignored, so their names cannot clash. An empty table
    gives an empty result.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "hierarchy")
    nodes = (
        rows.select(node.cast("string").alias("node"), parent.cast("string").alias("named"))
        .where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min("named").alias("named"))
    )
    nodes = ws.table(nodes, "nodes")
    known = nodes.select(F.col("node").alias("named"), F.lit(True).alias("known"))
    linked = nodes.join(known, "named", "left").select(
        "node", F.when(F.col("known"), F.col("named")).alias("parent")
    )
    linked = ws.table(linked, "linked")

    # Each node's next ancestors, nearest first, so that one join advances the frontier by STRIDE levels.
    climbs = linked.where(F.col("parent").isNotNull()).select("node", F.array("parent").alias("up"))
    for k in range(STRIDE_DOUBLINGS):
        onward = climbs.select(F.col("node").alias("last"), F.col("up").alias("more"))
        climbs = climbs.withColumn("last", F.element_at("up", -1)).join(onward, "last", "left")
        climbs = climbs.select("node", F.concat("up", F.coalesce("more", F.array().cast("array<string>"))).alias("up"))
        climbs = ws.table(climbs, f"climbs-{k}")
    stride = 1 << STRIDE_DOUBLINGS
    # One row for each of these ancestors: from there the way to the node is known.
    steps = climbs.select("node", F.col("up")[0].alias("parent"), "up", F.posexplode("up").alias("at", "from"))
    below = F.reverse(F.slice("up", F.lit(1), F.col("at")))
    steps = ws.table(steps.select("node", "parent", "from", F.concat(below, F.array("node")).alias("way")), "steps")

    frontier = linked.where(F.col("parent").isNull()).select(
        "node",
        "parent",
        F.col("node").alias("root"),
        F.lit(0).cast("int").alias("depth"),
        F.array("node").alias("path"),
        F.lit(False).alias("on_cycle"),
    )
    round_, done = 0, []
    while True:
        ahead, found = Observation(), Observation()
        last = F.col("depth") == round_ * stride
        path = f"{ws.path}/round-{round_}"
        told = frontier.observe(ahead, F.count(F.when(last, 1)).alias("n")).observe(found, F.count(F.lit(1)).alias("n"))
        told.write.parquet(path)
        if found.get["n"] == 0:
            break
        done.append(path)
        n = ahead.get["n"]
        if n == 0:
            break
        up = spark.read.schema(TREE).parquet(path).where(last).select(F.col("node").alias("from"), "root", "depth", "path")
        # A row of the frontier holds its path: what is broadcast is bounded in bytes.
        small = n * (round_ * stride + 2) * ID_BYTES <= BROADCAST_BYTES
        round_ += 1
        if round_ % COMPACT_EVERY == 0:
            used = spark.read.schema(TREE).parquet(*done[-COMPACT_EVERY:]).select("node")
            steps = ws.table(steps.join(used, "node", "left_anti"), f"steps-{round_}")
        frontier = steps.join(F.broadcast(up) if small else up, "from").select(
            "node",
            "parent",
            "root",
            (F.col("depth") + F.size("way")).cast("int").alias("depth"),
            F.concat("path", "way").alias("path"),
            F.lit(False).alias("on_cycle"),
        )
    trees = spark.read.schema(TREE).parquet(*done) if done else spark.createDataFrame([], TREE)
    edges = linked.where(F.col("parent").isNotNull())
    rest = ws.table(edges.join(trees.select("node"), "node", "left_anti"), "rest")
    left = rest.count()
    if not left:
        return trees
    return trees.unionByName(_cycles(ws, rest, left))


def _cycles(ws: Workspace, rest: DataFrame, n: int) -> DataFrame:
    """The unreached nodes. Jumps are doubled until every way has surely entered its cycle."""
    jumps = rest.select("node", F.col("parent").alias("at"), F.col("parent").alias("least"))
    steps, k = 1, 0
    while steps < n:
        onward = jumps.select(
            F.col("node").alias("at"), F.col("at").alias("next"), F.col("least").alias("other")
        )
        jumps = ws.table(
            jumps.join(onward, "at").select(
                "node", F.col("next").alias("at"), F.least("least", "other").alias("least")
            ),
            f"jumps-{k}",
        )
        if k:
            ws.drop(f"jumps-{k - 1}")
        steps, k = steps * 2, k + 1
    # From a node of the cycle, that many steps see the whole cycle.
    cycle = jumps.select("at").distinct()
    least = jumps.join(
        cycle.select(F.col("at").alias("node")), "node", "left_semi"
    ).select(F.col("node").alias("at"), F.col("least").alias("root"))
    return (
        rest.join(jumps.select("node", "at"), "node")
        .join(least, "at")
        .join(cycle.select(F.col("at").alias("node"), F.lit(True).alias("member")), "node", "left")
        .select(
            "node",
            "parent",
            "root",
            F.lit(-1).cast("int").alias("depth"),
            F.lit(None).cast("array<string>").alias("path"),
            F.coalesce("member", F.lit(False)).alias("on_cycle"),
        )
    )


def descendants(trees: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` of every pair, from the paths of ``hierarchy``."""
    return trees.where(F.col("depth") > 0).select(
        F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "ancestor"),
        F.col("node").alias("descendant"),
        "depth",
    ).select("ancestor", "descendant", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
