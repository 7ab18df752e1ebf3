"""Queries of the two general problems: hierarchies (2) and the change feed (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.ids import norm_id, norm_label
from claimgraph.operators.changefeed import apply_changes, changes_of
from claimgraph.operators.hierarchy import descendants, hierarchy
from claimgraph.plans.tables import table


def supersession_trees(records: DataFrame) -> DataFrame:
    return hierarchy(records, norm_id(F.col("record_id")), norm_id(F.col("supersedes")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "ledger_records")
    superseding = records.where(norm_id(F.col("supersedes")).isNotNull())
    trees = supersession_trees(records)
    return trees.join(
        superseding.select(norm_id(F.col("record_id")).alias("node")).distinct(), "node"
    ).select(F.col("node").alias("record_id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = supersession_trees(table(spark, sf_dir, "ledger_records"))
    return trees.select(
        F.col("node").alias("record_id"),
        F.concat_ws(">", "path").alias("path"),
        "depth",
        F.col("root").alias("root_id"),
        "on_cycle",
    )


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(supersession_trees(table(spark, sf_dir, "ledger_records")))


def current_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_changes(changes_of(table(spark, sf_dir, "verdict_feed")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    exported = (
        table(spark, sf_dir, "ledger_records")
        .select(norm_id(F.col("record_id")).alias("key"), norm_label(F.col("state")).alias("old"))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max("old").alias("old"))
    )
    rebuilt = exported.join(current_states(spark, sf_dir), "key", "left").select(
        F.col("key").alias("record_id"), F.coalesce("state", F.lit("absent")).alias("state"), "old"
    )
    return rebuilt.where(~F.col("old").eqNullSafe(F.col("state"))).drop("old")


def p4_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_states(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


QUERIES = {
    "p2_found": p2_found,
    "p2_paths": p2_paths,
    "p2_descendants": p2_descendants,
    "p4_found": p4_found,
    "p4_state_counts": p4_state_counts,
}

ID = "'rec_' || regexp_replace(upper(trim({0}, ' \t\r\n')), '^REC_', '')"

WALK = f"""
WITH RECURSIVE rows AS (
  SELECT {ID.format('record_id')} AS node, {ID.format('supersedes')} AS named FROM ledger_records
), nodes AS (SELECT node, min(named) AS named FROM rows GROUP BY node
), linked AS (
  SELECT n.node, k.node AS parent FROM nodes n LEFT JOIN nodes k ON n.named = k.node
), walk AS (
  SELECT node, node AS spot, [node] AS ways, false AS ring FROM linked
  UNION ALL
  SELECT w.node, l.parent, list_append(w.ways, l.parent), list_contains(w.ways, l.parent)
  FROM walk w JOIN linked l ON l.node = w.spot WHERE l.parent IS NOT NULL AND NOT w.ring
), ends AS (
  SELECT node, spot, ways, ring FROM walk QUALIFY row_number() OVER (PARTITION BY node ORDER BY len(ways) DESC) = 1
), trees AS (
  SELECT e.node,
    CASE WHEN ring THEN list_min(list_slice(ways, list_position(ways, spot), len(ways))) ELSE spot END AS root,
    CASE WHEN ring THEN -1 ELSE len(ways) - 1 END::INTEGER AS depth,
    CASE WHEN NOT ring THEN list_reverse(ways) END AS path,
    ring AND list_position(ways, spot) = 1 AS on_cycle
  FROM ends e
)
"""

STATES = f"""
WITH c AS (
  SELECT {ID.format('record_id')} AS key, lower(trim(op, ' \t\r\n')) AS op,
    nullif(lower(trim(state, ' \t\r\n')), '') AS stated, action, verdict_at AS instant, log_seq AS seq,
    coalesce(verdict_id, '') AS change
  FROM verdict_feed
), d AS (
  SELECT *, coalesce(stated, CASE
      WHEN lower(action) LIKE 'promote%' AND contains(upper(action), 'RETIRING ' || upper(key)) THEN 'retired'
      WHEN lower(action) LIKE 'promote%' THEN 'promoted' WHEN lower(action) LIKE 'retire%' THEN 'retired'
      WHEN lower(action) LIKE 'reject%' THEN 'rejected' WHEN lower(action) LIKE 'answer%' THEN 'answered'
      WHEN lower(action) LIKE 'withdraw%' THEN 'withdrawn' WHEN lower(action) LIKE 'abandon%' THEN 'abandoned'
      WHEN lower(action) LIKE 'score%' THEN 'scored' END) AS state
  FROM c WHERE op IN ('insert', 'update', 'delete')
), e AS (
  SELECT key, op, instant, change, max(seq) AS seq, max(state) AS state FROM d GROUP BY ALL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY instant,
      coalesce(seq, CASE WHEN op = 'insert' THEN -1 ELSE 1000000000000 END),
      CASE op WHEN 'insert' THEN 0 WHEN 'update' THEN 1 ELSE 2 END, change) AS n FROM e
), m AS (
  SELECT key, arg_max(op, n) AS op, max(n) AS n FROM o WHERE op <> 'update' GROUP BY key
), states AS (
  SELECT o.key, arg_max(o.state, o.n) AS state FROM o JOIN m ON o.key = m.key
  WHERE m.op = 'insert' AND o.n >= m.n AND o.op <> 'delete' GROUP BY o.key
)
"""

SQL = {
    "p2_found": WALK
    + "SELECT t.node AS record_id, root AS root_id, depth FROM trees t JOIN nodes n ON t.node = n.node"
    " WHERE n.named IS NOT NULL",
    "p2_paths": WALK
    + "SELECT node AS record_id, coalesce(array_to_string(path, '>'), '') AS path, depth, root AS root_id,"
    " on_cycle FROM trees",
    "p2_descendants": WALK
    + "SELECT path[i] AS ancestor, node AS descendant, (depth + 1 - i)::INTEGER AS distance FROM"
    " (SELECT node, depth, path, unnest(generate_series(1, depth)) AS i FROM trees WHERE depth > 0)",
    "p4_found": STATES
    + f""", exported AS (SELECT {ID.format('record_id')} AS record_id,
      max(nullif(lower(trim(state, ' \t\r\n')), '')) AS old FROM ledger_records GROUP BY 1)
    SELECT record_id, coalesce(s.state, 'absent') AS state FROM exported LEFT JOIN states s ON s.key = record_id
    WHERE old IS DISTINCT FROM coalesce(s.state, 'absent')""",
    "p4_state_counts": STATES + "SELECT state, count(*) AS n FROM states GROUP BY state",
}
