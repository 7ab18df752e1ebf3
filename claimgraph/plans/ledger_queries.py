"""Queries of the state fold, the inbox, validation, views and the graph, over the test ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.operators import graph, state, validate, views
from claimgraph.plans import ledger as L
from claimgraph.plans.ledger import WITH, sql_id

#: A moment within the ledger, one behind it.
AS_OF = datetime(2015, 2, 15)
NOW = datetime(2026, 1, 1)
VIEW = views.ViewSpec.at(NOW)
PAST = views.ViewSpec(AS_OF, datetime(2015, 2, 1))
OPEN = views.ViewSpec.at(NOW, states="promoted_and_proposed")


def _both(f):
    return lambda s, d: f(L.records(s, d), L.effects(s, d))


def _view(f, spec=VIEW):
    return lambda s, d: f(views.admitted(L.records(s, d), L.effects(s, d), spec))


def state_at(r: DataFrame, e: DataFrame) -> DataFrame:
    return state.with_state(r, e, AS_OF).select("record_id", "kind", "state")


def history(s: SparkSession, d: str) -> DataFrame:
    return state.history(L.effects(s, d))


def violations(s: SparkSession, d: str) -> DataFrame:
    return validate.violations(L.records(s, d), L.effects(s, d), L.entities(s, d))


def bfs(s: SparkSession, d: str) -> DataFrame:
    """From every source entity outwards, up to three hops."""
    edges = views.edges(views.admitted(L.records(s, d), L.effects(s, d), OPEN))
    starts = L.entities(s, d).where("kind = 'source'").select("entity_id").distinct()
    starts = starts.select(F.col("entity_id").alias("query_id"), F.lit(1).alias("seed"), F.col("entity_id").alias("entity"))
    found = graph.reach(starts, graph.adjacency(edges, "out"), 3)
    return found.select(F.col("query_id").alias("source"), "entity", "hop")


def _paths(s: SparkSession, d: str, transform: str, default: float | None, measured: bool) -> DataFrame:
    records = L.records(s, d)
    edges = views.edges(views.admitted(records, L.effects(s, d), OPEN))
    costs = graph.edge_costs(edges, L.reliability(records) if measured else None, "success", transform, default)
    sources = L.entities(s, d).where("kind = 'source'").select(F.col("entity_id").alias("source")).distinct()
    return graph.shortest_paths(costs, sources).select("source", "entity", F.round("cost", 6).alias("cost"))


def shortest_path_hops(s: SparkSession, d: str) -> DataFrame:
    return _paths(s, d, "identity", 1.0, measured=False)


def shortest_path_neglog(s: SparkSession, d: str) -> DataFrame:
    return _paths(s, d, "neg_ln", None, measured=True)


def states_cube(r: DataFrame, e: DataFrame) -> DataFrame:
    """Extension: the states of all records by kind and author, with all totals."""
    return state.with_state(r, e).cube("kind", "author_kind", "state").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def verdicts_by_day(s: SparkSession, d: str) -> DataFrame:
    """Extension: verdicts in windows of a day."""
    days = L.effects(s, d).groupBy(F.window("recorded_at", "1 day").alias("w"), "action").agg(F.count("*").alias("n"))
    return days.select(F.col("w.start").alias("day"), "action", "n")


def tables_join(s: SparkSession, d: str) -> DataFrame:
    """How many records are about entities of each kind."""
    about = L.records(s, d).select("record_id", F.col("subject").alias("entity_id")).distinct()
    return about.join(L.entities(s, d).select("entity_id", "kind").distinct(), "entity_id").groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {
    "state_now": _both(lambda r, e: state.with_state(r, e).select("record_id", "state")),
    "state_as_of": _both(state_at),
    "history": history,
    "promoted_claims": _both(lambda r, e: state.promoted_claims(r, e).select("record_id", "seq")),
    "registered_gaps": _both(lambda r, e: state.registered_gaps(r, e).select("record_id", "seq")),
    "pending": _both(state.pending),
    "replaced_by": lambda s, d: state.replaced_by(L.records(s, d)),
    "identical_groups": lambda s, d: state.identical_groups(L.records(s, d)),
    "ratification": _both(state.ratification),
    "review_queue": _both(lambda r, e: state.review_queue(r, e, NOW)),
    "contradictions": _both(state.contradictions),
    "contradictions_at": _both(lambda r, e: state.contradictions(r, e, AS_OF)),
    "panel_latest": lambda s, d: state.panel(L.measurements(s, d)).select("target", "name", "value", "at"),
    "replay_violations": violations,
    "view_promoted": _view(lambda v: v.select("record_id", "state")),
    "view_bitemporal": _view(lambda v: v.select("record_id", "state"), PAST),
    "view_author_filter": _view(lambda v: v.select("record_id", "state"), views.ViewSpec.at(NOW, author_kind="agent")),
    "view_states_all": _view(lambda v: v.select("record_id", "state"), views.ViewSpec.at(NOW, states="all")),
    "edges_view": _view(views.edges),
    "degrees_view": _view(lambda v: views.degrees(views.edges(v))),
    "properties": _view(views.properties),
    "property_claims": _view(views.property_claims),
    "unanimous_values": _view(views.unanimous_values),
    "conflicts_now": _view(lambda v: views.properties(v).where("conflicted").select("entity_id", "attr_name", "claims")),
    "about_entity": _view(views.about),
    "find_entities": lambda s, d: views.find_entities(L.entities(s, d)),
    "bfs_3_hops": bfs,
    "shortest_path_hops": shortest_path_hops,
    "shortest_path_neglog": shortest_path_neglog,
    "states_cube": _both(states_cube),
    "verdicts_by_day": verdicts_by_day,
    "tables_join": tables_join,
}

AT, ON = "TIMESTAMP '2015-02-15'", "TIMESTAMP '2026-01-01'"


def _admitted(record_time: str, valid_at: str, states: str, gaps: str = "state = 'registered'", more: str = "") -> str:
    return f"""{WITH}, seen AS (SELECT target_id AS record_id, arg_max(new_state, pos) AS state FROM eff
      WHERE recorded_at <= {record_time} GROUP BY 1
    ), v AS (SELECT * FROM (SELECT r.*, coalesce(l.state, CASE kind WHEN 'claim' THEN 'proposed' ELSE 'registered' END) AS state
      FROM rec r LEFT JOIN seen l USING (record_id)) WHERE recorded_at <= {record_time} AND valid_from <= {valid_at}
      AND (valid_to IS NULL OR {valid_at} < valid_to) {more}
      AND CASE WHEN kind = 'claim' THEN state IN ({states}) ELSE {gaps} END)"""


V = _admitted(ON, ON, "'promoted'")
OPEN_EDGES = _admitted(ON, ON, "'promoted', 'proposed'") + """, edge AS (
  SELECT seq, record_id, subject, predicate, object_id FROM v WHERE shape = 'relation'
), src AS (SELECT DISTINCT entity_id FROM ent WHERE kind = 'source')"""
CONTRA = """ SELECT a.subject, a.attr_name, a.record_id AS record_a, b.record_id AS record_b FROM p a JOIN p b
  ON a.subject = b.subject AND a.attr_name = b.attr_name AND a.seq < b.seq
  AND (b.valid_to IS NULL OR a.valid_from < b.valid_to) AND (a.valid_to IS NULL OR b.valid_from < a.valid_to)"""
RECURSIVE = OPEN_EDGES.replace("WITH ent", "WITH RECURSIVE ent", 1)
RULE = "SELECT '{0}' AS rule, {1} AS id, {2}::VARCHAR AS detail FROM {3}"

SQL = {
    "state_now": WITH + " SELECT record_id, state FROM st",
    "state_as_of": WITH + f""", seen AS (SELECT target_id AS record_id, arg_max(new_state, pos) AS state FROM eff
      WHERE recorded_at <= {AT} GROUP BY 1) SELECT r.record_id, kind,
      coalesce(s.state, CASE kind WHEN 'claim' THEN 'proposed' ELSE 'registered' END) AS state
      FROM rec r LEFT JOIN seen s USING (record_id) WHERE recorded_at <= {AT}""",
    "history": WITH + """ SELECT target_id AS record_id, row_number() OVER (PARTITION BY target_id ORDER BY pos)::INTEGER AS n,
      seq, verdict_id, action, new_state FROM eff WHERE target_id IS NOT NULL""",
    "promoted_claims": WITH + " SELECT record_id, seq FROM st WHERE kind = 'claim' AND state = 'promoted'",
    "registered_gaps": WITH + " SELECT record_id, seq FROM st WHERE kind = 'gap' AND state = 'registered'",
    "pending": WITH + """, p AS (SELECT *, record_id IN (SELECT supersedes FROM rec WHERE supersedes IS NOT NULL) AS gone
        FROM st WHERE kind = 'claim' AND state = 'proposed'
      ), h AS (SELECT *, first_value(record_id) OVER (PARTITION BY gone, shape, text, subject, attr_name, value_text, predicate,
        object_id, refs ORDER BY seq, record_id) AS hd FROM p)
      SELECT record_id, seq, CASE WHEN gone THEN 'superseded' WHEN hd <> record_id THEN 'identical' ELSE 'queued' END AS queue,
        CASE WHEN NOT gone AND hd <> record_id THEN hd END AS head FROM h""",
    "replaced_by": WITH + """ SELECT supersedes AS record_id, record_id AS replacement, seq FROM rec
      WHERE supersedes IN (SELECT record_id FROM rec)""",
    "identical_groups": WITH + """ SELECT record_id, first_value(record_id) OVER (PARTITION BY kind, shape, text, subject, attr_name,
      value_text, predicate, object_id, refs ORDER BY seq, record_id) AS first_id, count(*) OVER (PARTITION BY kind, shape, text,
      subject, attr_name, value_text, predicate, object_id, refs) AS twins FROM rec QUALIFY twins > 1""",
    "ratification": WITH + """ SELECT 'individually' AS basis, count(*) AS n FROM eff WHERE action = 'promote'
      AND new_state = 'promoted' AND target_id IN (SELECT record_id FROM st WHERE kind = 'claim' AND state = 'promoted')
      HAVING count(*) > 0""",
    "review_queue": WITH + f""" SELECT record_id, CASE WHEN due_at <= {ON} THEN 'due' ELSE 'missing' END AS queue FROM st
      WHERE kind = 'claim' AND state = 'promoted' AND (due_at <= {ON} OR (due_at IS NULL AND on_event IS NULL))""",
    "contradictions": WITH + ", p AS (SELECT * FROM st WHERE shape = 'attribute' AND state = 'promoted')" + CONTRA,
    "contradictions_at": WITH + f""", seen AS (SELECT target_id AS record_id, arg_max(new_state, pos) AS state FROM eff
      WHERE recorded_at <= {AT} GROUP BY 1), p AS (SELECT r.* FROM rec r JOIN seen s USING (record_id)
      WHERE shape = 'attribute' AND recorded_at <= {AT} AND s.state = 'promoted')""" + CONTRA,
    "panel_latest": """SELECT user_id::VARCHAR AS target, event_type AS name, arg_max(value, event_id) AS value,
      arg_max(ts, event_id) AS "at" FROM events GROUP BY user_id, event_type""",
    "replay_violations": WITH + ", named AS (SELECT record_id, unnest(refs) AS ref FROM rec), ev AS (SELECT record_id, unnest(sources)"
      " AS source FROM rec), steps AS (SELECT e.*, kind, coalesce(lag(new_state) OVER (PARTITION BY target_id ORDER BY pos), CASE kind"
      " WHEN 'claim' THEN 'proposed' WHEN 'gap' THEN 'registered' WHEN 'hypothesis' THEN 'registered' END) AS came, CASE WHEN"
      " action = 'promote' AND new_state = 'retired' THEN 'retire' ELSE action END AS verb FROM eff e LEFT JOIN rec r ON"
      " e.target_id = r.record_id) " + " UNION ALL ".join([
        RULE.format("time_goes_back", "record_id", "NULL", "(SELECT record_id, recorded_at, max(recorded_at) OVER (ORDER BY seq ROWS"
          " BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM rec) WHERE recorded_at < top"),
        RULE.format("empty_validity", "record_id", "NULL", "rec WHERE valid_to <= valid_from"),
        RULE.format("supersedes_other_kind", "a.record_id", "b.record_id", "rec a JOIN rec b ON a.supersedes = b.record_id WHERE a.kind <> b.kind"),
        RULE.format("repeated_refs", "record_id", "NULL", "rec WHERE (kind <> 'claim' OR shape IN ('text', 'pattern')) AND len(refs) > len(list_distinct(refs))"),
        RULE.format("dangling_supersedes", "record_id", "supersedes", "rec WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT record_id FROM rec)"),
        RULE.format("dangling_ref", "record_id", "ref", "named WHERE ref NOT IN (SELECT entity_id FROM ent)"),
        RULE.format("dangling_object", "record_id", "object_id", "rec WHERE object_id NOT IN (SELECT entity_id FROM ent)"),
        RULE.format("bad_evidence", "record_id", "source", "ev WHERE source NOT IN (SELECT entity_id FROM ent WHERE kind = 'source')"),
        RULE.format("unknown_version", "record_id", "NULL", "rec WHERE version IS DISTINCT FROM 1"),
        RULE.format("blank_text", "record_id", "NULL", "rec WHERE (kind = 'gap' OR shape = 'text') AND trim(coalesce(text, '')) = '' AND redacted_by IS NULL"),
        RULE.format("agent_verdict", "verdict_id", "NULL", "(SELECT DISTINCT verdict_id FROM eff WHERE author_kind IS DISTINCT FROM 'human')"),
        RULE.format("illegal_transition", "target_id", "coalesce(came, 'nothing') || ' -> ' || verb", """steps WHERE NOT coalesce(
          (verb = 'promote' AND kind = 'claim' AND came = 'proposed' AND new_state = 'promoted')
          OR (verb = 'reject' AND kind = 'claim' AND came = 'proposed' AND new_state = 'rejected')
          OR (verb = 'retire' AND kind = 'claim' AND came = 'promoted' AND new_state = 'retired')
          OR (verb = 'answer' AND kind = 'gap' AND came = 'registered' AND new_state = 'answered')
          OR (verb = 'withdraw' AND kind = 'gap' AND came = 'registered' AND new_state = 'withdrawn')
          OR (verb = 'score' AND kind = 'hypothesis' AND came = 'registered' AND new_state = 'scored')
          OR (verb = 'abandon' AND kind = 'hypothesis' AND came = 'registered' AND new_state = 'abandoned'), false)"""),
        RULE.format("unpromoted_answer", "target_id", "coalesce(claim, 'nothing') || ' ' || coalesce(came, 'never moved')", f"""(SELECT a.target_id, a.claim,
          arg_max(c.new_state, c.pos) AS came FROM (SELECT *, {sql_id('said_claim')} AS claim FROM eff WHERE action = 'answer') a LEFT JOIN eff c
          ON c.target_id = a.claim AND c.pos < a.pos GROUP BY a.target_id, a.claim, a.pos) WHERE came IS DISTINCT FROM 'promoted'"""),
        RULE.format("unreceipted_redaction", "record_id", "NULL", "rec WHERE redacted_by IS NOT NULL AND redacted_by NOT IN (SELECT record_id FROM rec WHERE kind = 'redaction')"),
      ]),
    "view_promoted": V + " SELECT record_id, state FROM v",
    "view_bitemporal": _admitted(AT, "TIMESTAMP '2015-02-01'", "'promoted'") + " SELECT record_id, state FROM v",
    "view_author_filter": _admitted(ON, ON, "'promoted'", more="AND author_kind = 'agent'") + " SELECT record_id, state FROM v",
    "view_states_all": _admitted(ON, ON, "'promoted', 'proposed', 'retired', 'rejected'", "true") + " SELECT record_id, state FROM v",
    "edges_view": V + " SELECT seq, record_id, subject, predicate, object_id FROM v WHERE shape = 'relation'",
    "degrees_view": V + """ SELECT entity_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (
      SELECT subject AS entity_id, 1 AS o, 0 AS i FROM v WHERE shape = 'relation' UNION ALL
      SELECT object_id, 0, 1 FROM v WHERE shape = 'relation') WHERE entity_id IS NOT NULL GROUP BY 1""",
    "properties": V + """ SELECT subject AS entity_id, attr_name, count(*) AS claims, arg_min_null(value_text, seq) AS value,
      count(*) >= 2 AS conflicted FROM v WHERE shape = 'attribute' GROUP BY 1, 2""",
    "property_claims": V + """ SELECT subject AS entity_id, attr_name, row_number() OVER (PARTITION BY subject, attr_name
      ORDER BY seq)::INTEGER AS n, record_id, value_text FROM v WHERE shape = 'attribute'""",
    "unanimous_values": V + """ SELECT subject AS entity_id, attr_name, any_value(value_text) AS value FROM v WHERE shape = 'attribute'
      GROUP BY 1, 2 HAVING count(DISTINCT coalesce(value_text, chr(1))) = 1""",
    "conflicts_now": V + """ SELECT subject AS entity_id, attr_name, count(*) AS claims FROM v WHERE shape = 'attribute'
      GROUP BY 1, 2 HAVING count(*) >= 2""",
    "about_entity": V + """ SELECT unnest(refs) AS entity_id, seq, record_id, kind FROM v
      WHERE shape IN ('text', 'pattern') OR kind = 'gap'""",
    "find_entities": WITH + " SELECT kind, label, min(entity_id) AS entity_id FROM ent WHERE label IS NOT NULL GROUP BY 1, 2",
    "bfs_3_hops": RECURSIVE + """, walk AS (SELECT entity_id AS source, entity_id AS entity, 0 AS hop FROM src
      UNION SELECT source, object_id, hop + 1 FROM walk JOIN edge ON subject = entity WHERE hop < 3 AND object_id IS NOT NULL)
      SELECT source, entity, min(hop)::INTEGER AS hop FROM walk GROUP BY 1, 2""",
    "shortest_path_hops": RECURSIVE + """, walk AS (SELECT entity_id AS source, entity_id AS entity, 0 AS hop FROM src
      UNION SELECT source, object_id, hop + 1 FROM walk JOIN edge ON subject = entity WHERE hop < 40 AND object_id IS NOT NULL)
      SELECT source, entity, min(hop)::DOUBLE AS cost FROM walk GROUP BY 1, 2""",
    "shortest_path_neglog": RECURSIVE + """, cost AS (SELECT subject, object_id, -ln((seq % 90 + 10) / 100.0) AS c FROM edge WHERE seq % 7 <> 0 AND object_id IS NOT NULL
      ), walk AS (SELECT entity_id AS source, entity_id AS entity, 0.0::DOUBLE AS cost, [entity_id] AS way FROM src
      UNION ALL SELECT source, object_id, cost + c, list_append(way, object_id) FROM walk JOIN cost ON subject = entity WHERE NOT list_contains(way, object_id))
      SELECT source, entity, round(min(cost), 6) AS cost FROM walk GROUP BY 1, 2""",
    "states_cube": WITH + """ SELECT kind, author_kind, state, (4 * grouping(kind) + 2 * grouping(author_kind) + grouping(state))::INTEGER
      AS level, count(*) AS n FROM st GROUP BY CUBE (kind, author_kind, state)""",
    "verdicts_by_day": WITH + " SELECT date_trunc('day', recorded_at) AS day, action, count(*) AS n FROM eff GROUP BY 1, 2",
    "tables_join": WITH + """ SELECT kind, count(*) AS n FROM (SELECT DISTINCT record_id, subject FROM rec)
      JOIN (SELECT DISTINCT entity_id, kind FROM ent) ON subject = entity_id GROUP BY kind""",
}
