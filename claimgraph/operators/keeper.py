"""What keeps the record in step with its sources: sync, attestation, grading, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import folded_stopwords, tokens
from claimgraph.operators.retrieve import Answers
from claimgraph.operators.state import promoted_claims
from claimgraph.sources.formats import mentioned_ids

#: An answer counts as found among so many first items.
ANSWER_RANK = 3
#: So many of a question's words in a row are a quotation.
QUOTE_RUN = 5
#: Rows of questions up to which they are broadcast; they are counted before.
BROADCAST_QUESTIONS = 100_000
#: Kinds of entities that a record can be anchored at.
ANCHORS = ("decision", "unknown", "proposal")
#: How much an attestation is worth.
STRENGTH = {"signed": 3, "unknown-key": 2, "unsigned": 1, "none": 0}
PASSES = ("answered", "abstained", "abstained+cited", "pointed+beyond")

# ── origins and sync ──


def parse_origin(reference: Column) -> Column:
    """``document#key [recorded:…] digest:<16 hex>`` as a struct, or null."""
    p = r"^([^#]+)#(\S+?)(?: recorded:(.*))? digest:([0-9a-fA-F]{16})$"
    part = lambda i: F.regexp_extract(reference, p, i)
    noted = part(3)
    return F.when(
        reference.rlike(p),
        F.struct(
            part(1).alias("document"), part(2).alias("key"), F.when(noted != "", noted).alias("noted"), part(4).alias("digest"),
            F.concat(part(1), F.lit("#"), part(2)).alias("identity"),
        ),
    )


def format_origin(document: Column, key: Column, digest: Column, noted: Column | None = None) -> Column:
    middle = F.lit("") if noted is None else F.when(noted.isNull(), "").otherwise(F.concat(F.lit(" recorded:"), noted))
    return F.concat(document, F.lit("#"), key, middle, F.lit(" digest:"), digest)


def prior_origins(records: DataFrame) -> DataFrame:
    """``identity, record_id, digest`` of the last ingest of each identity, in log order."""
    o = records.select("seq", "record_id", parse_origin(F.col("reference")).alias("o")).where(F.col("o").isNotNull())
    last = o.groupBy(F.col("o.identity").alias("identity")).agg(F.max_by(F.struct("record_id", "o.digest"), "seq").alias("l"))
    return last.select("identity", "l.record_id", "l.digest")


def dispositions(source: DataFrame, prior: DataFrame) -> DataFrame:
    """``identity, disposition`` of each source row (identity, digest): fresh, unchanged or changed."""
    old = prior.select("identity", F.col("digest").alias("old"))
    told = F.when(F.col("old").isNull(), "fresh").when(F.col("old") == F.col("digest"), "unchanged").otherwise("changed")
    return source.join(old, "identity", "left").select("identity", told.alias("disposition"))


def absent(source: DataFrame, prior: DataFrame) -> DataFrame:
    """Identities that were ingested once and are not in the source any more; parts (``key/role``) aside."""
    gone = prior.join(source, "identity", "left_anti")
    return gone.where(~F.substring_index("identity", "#", -1).contains("/")).select("identity")


def sync_actions(source: DataFrame, prior: DataFrame, states: DataFrame) -> DataFrame:
    """``identity, action``: what a sync has to do for each source row (identity, digest, kind).

    append: new; supersede: a claim reads otherwise; reword: an open gap or hypothesis does, so the
    old one is withdrawn or abandoned; drift: a settled one does, which only a person can resolve;
    none: nothing has changed. ``states``: record_id, state.
    """
    old = prior.join(states.select("record_id", "state"), "record_id", "left").select(
        "identity", F.col("digest").alias("old"), "state"
    )
    open_ = F.col("state") == "registered"
    action = (
        F.when(F.col("old").isNull(), "append")
        .when(F.col("old") == F.col("digest"), "none")
        .when(F.col("kind") == "claim", "supersede")
        .when(open_, "reword")
        .otherwise("drift")
    )
    return source.join(old, "identity", "left").select("identity", action.alias("action"))


def settlements(register: DataFrame) -> DataFrame:
    """``origin_key, action, claim``: open rows that are now resolved, by a decision or elsewhere."""
    done = register.where("resolved")
    return done.select(
        "origin_key", F.when(F.col("resolved_by").isNull(), "withdraw").otherwise("answer").alias("action"), F.col("resolved_by").alias("claim")
    )


def mentions(texts: DataFrame) -> DataFrame:
    """``id, n, mentioned``: what a text (id, text) names, in order of first mention, itself aside."""
    found = texts.select("id", F.posexplode(mentioned_ids(F.col("text"), F.coalesce("id", F.lit("")))).alias("n", "mentioned"))
    return found.select("id", F.col("n").cast("int").alias("n"), "mentioned")


def stale_triggers(rows: DataFrame, register: DataFrame) -> DataFrame:
    """``path, id, fired``: triggers (path, id, trigger) that wait for a question settled by now; the
    first that they name. ``register``: path, unknown_id, resolved."""
    settled = register.where("resolved").select("path", F.col("unknown_id").alias("mentioned")).distinct()
    named = rows.select("path", "id", F.posexplode(mentioned_ids(F.col("trigger"), F.col("id"))).alias("n", "mentioned"))
    fired = named.where(F.col("mentioned").startswith("U-")).join(settled, ["path", "mentioned"], "left_semi")
    return fired.groupBy("path", "id").agg(F.min_by("mentioned", "n").alias("fired"))


# ── attestation ──


def attestation(detail: Column) -> Column:
    """``attest:<kind> …`` as a struct (kind, commit, key, signer, by, because, strength), or null."""
    kind = F.regexp_extract(detail, r"^attest:([a-z-]+)(?: |$)", 1)
    get = lambda name, stop: F.regexp_extract(detail, rf"(?: {name}:)(.+?)(?: {stop}:|$)" if stop else rf"(?: {name}:)(.+)$", 1)
    none = lambda c: F.when(c != "", c)
    strength = F.lit(None).cast("int")
    for name, worth in STRENGTH.items():
        strength = F.when(kind == name, F.lit(worth)).otherwise(strength)
    return F.when(
        strength.isNotNull(),
        F.struct(
            kind.alias("kind"), none(get("commit", "(?:key|by)")).alias("commit"), none(get("key", "signer")).alias("key"),
            none(get("signer", None)).alias("signer"), none(get("by", None)).alias("by"), none(get("because", None)).alias("because"),
            strength.alias("strength"),
        ),
    )


def weakest(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """``id, detail``: the weakest attestation of the lines of each span (id, first_line, last_line).

    ``lines``: line, detail. A span without lines is attested by nothing. Both sides are cut into
    blocks of lines, so that a span meets only the lines of its own blocks.
    """
    block = 256
    cut = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("first_line") / block), F.floor(F.col("last_line") / block))))
    rows = lines.select("line", "detail", F.floor(F.col("line") / block).alias("block"), attestation(F.col("detail"))["strength"].alias("strength"))
    met = cut.join(rows, "block").where(F.col("line").between(F.col("first_line"), F.col("last_line")))
    found = met.groupBy("id").agg(F.min_by("detail", F.struct("strength", "line")).alias("detail"))
    nothing = F.lit("attest:none because:the document has no such lines")
    return spans.select("id").join(found, "id", "left").select("id", F.coalesce("detail", nothing).alias("detail"))


def policy_admits(detail: Column, policy: str = "observe", signers: list[str] | None = None) -> Column:
    """``observe`` admits all, ``require_signature`` what is signed, ``from`` what one of the signers signed."""
    a = attestation(detail)
    signed = F.coalesce(a["kind"] == "signed", F.lit(False))
    return {"observe": F.lit(True), "require_signature": signed, "from": signed & a["signer"].isin(signers or [])}[policy]


def unattested_promotions(records: DataFrame, effects: DataFrame, details: DataFrame) -> DataFrame:
    """``record_id, because``: promoted claims whose promotion nobody signed. ``details``: verdict_id, detail."""
    gave = effects.where("new_state = 'promoted'").select(F.col("target_id").alias("record_id"), "verdict_id")
    told = promoted_claims(records, effects).select("record_id").join(gave, "record_id").join(details, "verdict_id", "left")
    a = attestation(F.col("detail"))
    because = (
        F.when(F.col("detail").isNull(), "nobody vouched for the verdict")
        .when(a.isNull(), "the detail is no attestation")
        .when(a["kind"] != "signed", F.col("detail"))
    )
    return told.select("record_id", because.alias("because")).where(F.col("because").isNotNull())


def review_trust(recorded: DataFrame, today: DataFrame) -> DataFrame:
    """``id, verdict``: attestations (id, detail) against what their commits say today (commit, detail)."""
    a, now = attestation(F.col("detail")), attestation(F.col("now"))
    r = recorded.select("id", "detail", a["commit"].alias("commit"), a["strength"].alias("was"))
    r = r.join(today.select("commit", F.col("detail").alias("now")), "commit", "left").withColumn("is", now["strength"])
    told = (
        F.when(F.col("commit").isNull(), "nothing_to_recheck").when(F.col("now").isNull(), "unverifiable")
        .when(F.col("is") == F.col("was"), "unchanged").when(F.col("is") < F.col("was"), "weakened").otherwise("strengthened")
    )
    return r.select("id", told.alias("verdict"))


# ── grading ──


def anchors(records: DataFrame, entities: DataFrame) -> DataFrame:
    """``record_id, anchor``: the label of the first decision, unknown or proposal a record is about, else its id."""
    named = records.where(F.col("kind").isin("claim", "gap")).select("record_id", F.posexplode("refs").alias("n", "entity_id"))
    known = entities.where(F.col("kind").isin(*ANCHORS)).select("entity_id", "label")
    first = named.join(known, "entity_id").groupBy("record_id").agg(F.min_by("label", "n").alias("label"))
    return records.select("record_id").join(first, "record_id", "left").select("record_id", F.coalesce("label", "record_id").alias("anchor"))


def grade(questions: DataFrame, answers: Answers, anchored: DataFrame) -> DataFrame:
    """``query_id, verdict, passed``. ``questions``: query_id, expects (answer, abstain), expected (a label or null)."""
    top = answers.items.where(F.col("position") <= ANSWER_RANK).join(anchored, "record_id")
    top = top.groupBy("query_id").agg(F.collect_set("anchor").alias("top"))
    cited = answers.gaps.join(anchored, "record_id").groupBy("query_id").agg(F.collect_set("anchor").alias("cited"))
    beyond = answers.beyond.join(anchored, "record_id").select("query_id", F.col("anchor").alias("pointed"))
    q = questions.join(answers.outcomes.select("query_id", "outcome"), "query_id")
    q = q.join(top, "query_id", "left").join(cited, "query_id", "left").join(beyond, "query_id", "left")
    in_ = lambda c: F.coalesce(F.array_contains(c, F.col("expected")), F.lit(False))
    found, sure = in_("top"), F.col("outcome") == "matches"
    answer = (
        F.when(found & sure, "answered").when(found, "UNDERCONFIDENT").when(sure, "WRONG ANCHOR")
        .when(F.col("pointed") == F.col("expected"), "pointed+beyond").otherwise("MISSED")
    )
    abstain = (
        F.when(sure, "BLUFFED").when(F.col("expected").isNull(), "abstained").when(in_("cited"), "abstained+cited").otherwise("GAP NOT CITED")
    )
    v = q.select("query_id", F.when(F.col("expects") == "answer", answer).otherwise(abstain).alias("verdict"))
    return v.withColumn("passed", F.col("verdict").isin(*PASSES))


def scorecard(graded: DataFrame) -> DataFrame:
    return graded.groupBy("verdict").agg(F.count("*").alias("n"))


# ── audits of a suite ──


def _few(questions: DataFrame) -> DataFrame:
    return F.broadcast(questions) if questions.limit(BROADCAST_QUESTIONS + 1).count() <= BROADCAST_QUESTIONS else questions


def quoted_questions(questions: DataFrame, records: DataFrame, run: int = QUOTE_RUN) -> DataFrame:
    """``query_id, record_id, run``: the longest run of a question's words in a record, if it is a quotation.

    Runs of ``run`` words meet in a join; along a diagonal (place in the record minus place in the
    question) they grow to longer ones.
    """
    grams = lambda df, key: (
        df.select(key, tokens(F.col("text")).alias("t")).where(F.size("t") >= run)
        .select(key, "t", F.explode(F.sequence(F.lit(1), F.size("t") - (run - 1))).alias("at"))
        .select(key, "at", F.xxhash64(F.slice("t", F.col("at"), F.lit(run))).alias("h"), F.slice("t", F.col("at"), F.lit(run)).alias("g"))
    )
    q = _few(grams(questions, "query_id").withColumnsRenamed({"at": "qat"}))
    met = grams(records, "record_id").join(q, ["h", "g"]).select("query_id", "record_id", "at", (F.col("at") - F.col("qat")).alias("diagonal"))
    line = Window.partitionBy("query_id", "record_id", "diagonal").orderBy("at")
    met = met.withColumn("island", F.col("at") - F.row_number().over(line))
    runs = met.groupBy("query_id", "record_id", "diagonal", "island").agg((F.count("*") + (run - 1)).alias("run"))
    return runs.groupBy("query_id", "record_id").agg(F.max("run").alias("run"))


def absent_vocabulary(questions: DataFrame, records: DataFrame) -> DataFrame:
    """``query_id, term``: the discriminating words of each question that no record has."""
    asked = questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    asked = asked.where(~F.col("term").isin(folded_stopwords()))
    words = _few(asked.select("term").distinct())
    here = records.select(F.explode(tokens(F.col("text"))).alias("term")).join(words, "term", "left_semi").distinct()
    return asked.join(here, "term", "left_anti").select("query_id", "term")


def vocabulary_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Words (query_id, term) that were absent when the baseline was recorded and are there now."""
    known = current.select("query_id").distinct()
    return recorded.join(current, ["query_id", "term"], "left_anti").join(known, "query_id", "left_semi")


def missing_baseline(recorded: DataFrame, questions: DataFrame) -> DataFrame:
    return questions.select("query_id").join(recorded, "query_id", "left_anti")
