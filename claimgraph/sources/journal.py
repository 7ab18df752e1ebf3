"""The event log on the wire: one JSON object in a line, its place is its number.

A log is read as text, numbered, and taken apart with an explicit schema. Only the last line
may be torn: it is left out. Any other line that does not parse is corruption.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.display import describe_action, display_text, shown_id
from claimgraph.schema import ENVELOPE_VERSION

_MARK = "struct<by:string,fingerprint:string>"
_AUTHOR = "struct<name:string,kind:string,detail:string>"
_CLAIM = (
    "struct<Attribute:struct<subject:string,name:string,value:string>,"
    "Relation:struct<subject:string,predicate:string,object:string,properties:string>,"
    "Pattern:struct<context:string,forces:array<string>,solution:string,about:array<string>>,"
    "Text:struct<body:string,about:array<string>>>"
)
_ACTION = (
    "struct<Promote:struct<target:string,retiring:string>,"
    "PromoteSet:struct<targets:array<string>,retiring:array<string>,basis:string>,"
    "Retire:struct<target:string,reason:string>,Reject:struct<target:string>,Answer:struct<gap:string,with_claim:string>,"
    "Withdraw:struct<gap:string,reason:string>,Abandon:struct<hypothesis:string,reason:string>,"
    "Score:struct<hypothesis:string,outcome:string>>"
)
EVENT = (
    f"event string, id string, kind string, label string, redacted {_MARK}, recorded_at string, envelope_version int, "
    f"author {_AUTHOR}, source struct<channel:string,reference:string>, valid_from string, valid_to string, "
    "evidence array<struct<source:string,span:string>>, review_trigger struct<due_at:string,on_event:string>, supersedes string, "
    f"content struct<Claim:{_CLAIM},Gap:struct<question:string,territory:array<string>>,"
    f"Hypothesis:struct<statement:string,falsifier:string,score_by:string>,Verdict:struct<action:{_ACTION},rationale:string>,"
    "Redaction:struct<target:string,scope:string,reason:string>>, "
    f"target string, name string, value double, at string, by {_AUTHOR}, _bad string"
)
#: Actions whose reason ``Unstated`` is read from old logs but not written any more.
KINDS = ("entity", "record", "measurement")


class CorruptLog(ValueError):
    """A line that is no event, other than a torn last one; names the line."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``seq, line`` of a log; blank lines keep their number and are left out."""
    numbered = spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[1], x[0]))
    return spark.createDataFrame(numbered, "seq long, line string").where(F.trim("line") != "")


def parse_events(lines: DataFrame, check: bool = True) -> DataFrame:
    """``seq, line`` and the fields of each event. With ``check``, the torn last line is left out and any
    other bad line raises CorruptLog; so does an envelope version that is not known."""
    e = lines.select("seq", "line", F.from_json("line", EVENT, {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    e = e.select("seq", "line", "e.*")
    bad = F.col("_bad").isNotNull() | ~F.coalesce(F.col("event").isin(*KINDS), F.lit(False))
    if check:
        last = lines.agg(F.max("seq")).first()[0]
        wrong = e.where(bad & (F.col("seq") < F.lit(last))).agg(F.min("seq")).first()[0] if last is not None else None
        if wrong is not None:
            raise CorruptLog(f"line {wrong + 1} is no event")
        newer = e.where((F.col("event") == "record") & (F.col("envelope_version") != ENVELOPE_VERSION)).limit(1).collect()
        if newer:
            raise CorruptLog(f"line {newer[0]['seq'] + 1} has version {newer[0]['envelope_version']}")
    return e.where(~bad).drop("_bad")


def _ids(c: Column, prefix: str) -> Column:
    return F.transform(c, lambda x: shown_id(x, prefix))


def number_text(d: Column) -> Column:
    """A double as its shortest decimal, whole ones without a point, never with an exponent."""
    whole = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("decimal(38,0)").cast("string"))
    plain = F.regexp_replace(d.cast("decimal(38,17)").cast("string"), r"(\.\d*?)0+$", "$1")
    return F.coalesce(whole, F.regexp_replace(plain, r"\.$", ""))


def value_text(value: Column) -> Column:
    """A tagged value (``{"Number": 24.0}``) as it is indexed."""
    v = F.from_json(value, "struct<Text:string,Number:double,Integer:bigint,Boolean:boolean,Timestamp:string>")
    return F.coalesce(
        v["Text"], number_text(v["Number"]), v["Integer"].cast("string"), v["Boolean"].cast("string"), v["Timestamp"]
    )


def entities(events: DataFrame) -> DataFrame:
    e = events.where("event = 'entity'")
    return e.select(shown_id(F.col("id"), "ent").alias("entity_id"), "kind", "label", F.col("redacted.by").alias("redacted_by"))


def records(events: DataFrame) -> DataFrame:
    """The records that state something or redact; verdicts are read by ``effects``."""
    r = events.where("event = 'record'")
    claim, gap, hyp = F.col("content.Claim"), F.col("content.Gap"), F.col("content.Hypothesis")
    attr, rel, pat, txt = (claim[x] for x in ("Attribute", "Relation", "Pattern", "Text"))
    kind = (
        F.when(claim.isNotNull(), "claim").when(gap.isNotNull(), "gap").when(hyp.isNotNull(), "hypothesis")
        .when(F.col("content.Verdict").isNotNull(), "verdict").otherwise("redaction")
    )
    shape = (
        F.when(attr.isNotNull(), "attribute").when(rel.isNotNull(), "relation").when(pat.isNotNull(), "pattern").when(txt.isNotNull(), "text")
    )
    said = value_text(attr["value"])
    text = (
        F.when(attr.isNotNull(), F.concat_ws(" ", attr["name"], said))
        .when(rel.isNotNull(), rel["predicate"])
        .when(pat.isNotNull(), F.concat(pat["context"], F.lit(" "), F.array_join(pat["forces"], " "), F.lit(" "), pat["solution"]))
        .when(txt.isNotNull(), txt["body"])
        .when(gap.isNotNull(), gap["question"])
        .when(hyp.isNotNull(), F.concat(hyp["statement"], F.lit(" "), F.coalesce(hyp["falsifier"], F.lit(""))))
    )
    refs = F.coalesce(
        F.when(attr.isNotNull(), F.array(attr["subject"])), F.when(rel.isNotNull(), F.array(rel["subject"], rel["object"])),
        pat["about"], txt["about"], gap["territory"], F.array().cast("array<string>"),
    )
    ts = lambda c: F.col(c).cast("timestamp").alias(c.split(".")[-1])
    return r.select(
        "seq", shown_id(F.col("id")).alias("record_id"), kind.alias("kind"), shape.alias("shape"), F.col("author.name").alias("author_name"),
        F.lower("author.kind").alias("author_kind"), F.col("source.channel").alias("channel"), F.col("source.reference").alias("reference"),
        ts("recorded_at"), ts("valid_from"), ts("valid_to"), ts("review_trigger.due_at"), F.col("review_trigger.on_event").alias("on_event"),
        shown_id(F.col("supersedes")).alias("supersedes"), text.alias("text"),
        shown_id(F.coalesce(attr["subject"], rel["subject"]), "ent").alias("subject"), attr["name"].alias("attr_name"),
        said.alias("value_text"), rel["predicate"].alias("predicate"), shown_id(rel["object"], "ent").alias("object_id"),
        _ids(refs, "ent").alias("refs"),
        F.transform("evidence", lambda e: F.struct(shown_id(e["source"], "ent").alias("source"), e["span"].alias("span"))).alias("evidence"),
        shown_id(F.col("redacted.by")).alias("redacted_by"), F.col("envelope_version").cast("short").alias("version"),
    )


def shown_texts(events: DataFrame) -> DataFrame:
    """``record_id, shown``: each record's text as a reader sees it."""
    r = events.where("event = 'record' AND content.Verdict IS NULL")
    pattern = r.select(shown_id(F.col("id")).alias("record_id"), F.col("content.Claim.Pattern").alias("p"))
    return records(events).select("record_id", "text").join(pattern, "record_id").select(
        "record_id", display_text(F.col("p"), F.col("text")).alias("shown")
    )


def verdicts(events: DataFrame) -> DataFrame:
    """``seq, verdict_id, action, author, author_kind, at, rationale`` of each verdict, its action in words."""
    v = events.where("event = 'record' AND content.Verdict IS NOT NULL")
    return v.select(
        "seq", shown_id(F.col("id")).alias("verdict_id"), describe_action(F.col("content.Verdict.action")).alias("action"),
        F.col("author.name").alias("author"), F.lower("author.kind").alias("author_kind"), F.col("recorded_at").cast("timestamp").alias("at"),
        F.col("content.Verdict.rationale").alias("rationale"),
    )


def effects(events: DataFrame) -> DataFrame:
    """What each verdict does, one row for each record it moves: the one definition of that."""
    a = F.col("content.Verdict.action")
    to = lambda ids, state, action, reason=None, basis=None: F.transform(
        ids,
        lambda x: F.struct(
            x.alias("target"), F.lit(state).alias("state"), F.lit(action).alias("action"),
            (F.lit(None).cast("string") if reason is None else reason).alias("reason"),
            (F.lit(None).cast("string") if basis is None else basis).alias("basis"),
        ),
    )
    one = lambda c: F.array_compact(F.array(c))
    many = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    p, s = a["Promote"], a["PromoteSet"]
    moves = F.concat(
        to(one(p["target"]), "promoted", "promote"),
        to(one(p["retiring"]), "retired", "promote"),
        to(many(s["targets"]), "promoted", "promote", basis=s["basis"]),
        to(many(s["retiring"]), "retired", "promote", basis=s["basis"]),
        to(one(a["Retire"]["target"]), "retired", "retire", a["Retire"]["reason"]),
        to(one(a["Reject"]["target"]), "rejected", "reject"),
        to(one(a["Answer"]["gap"]), "answered", "answer", a["Answer"]["with_claim"]),
        to(one(a["Withdraw"]["gap"]), "withdrawn", "withdraw", a["Withdraw"]["reason"]),
        to(one(a["Abandon"]["hypothesis"]), "abandoned", "abandon", a["Abandon"]["reason"]),
        to(one(a["Score"]["hypothesis"]), "scored", "score", a["Score"]["outcome"]),
    )
    v = events.where((F.col("event") == "record") & F.col("content.Verdict").isNotNull())
    v = v.select("seq", "id", "recorded_at", "author", F.posexplode(moves).alias("ordinal", "m"))
    return v.select(
        "seq", "ordinal", shown_id(F.col("id")).alias("verdict_id"), F.col("recorded_at").cast("timestamp").alias("recorded_at"),
        shown_id(F.col("m.target")).alias("target_id"), "m.action", F.col("m.state").alias("new_state"), "m.reason", "m.basis",
        F.lower("author.kind").alias("author_kind"),
    )


def measurements(events: DataFrame) -> DataFrame:
    m = events.where("event = 'measurement'")
    t = F.from_json("target", "struct<Entity:string,Relation:string>")
    target = F.coalesce(shown_id(t["Entity"], "ent"), shown_id(t["Relation"]))
    return m.select("seq", target.alias("target"), "name", "value", F.col("at").cast("timestamp").alias("at"), F.col("by.name").alias("by"))
