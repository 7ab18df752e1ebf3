"""Streams of log events: new lines of watched files are committed to a ledger batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimgraph.operators import validate
from claimgraph.session import Workspace
from claimgraph.sources import journal
from claimgraph.store import Ledger, Refused


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of every new file of JSON lines in a folder."""
    return spark.readStream.format("text").load(path).where(F.trim("value") != "").select(F.col("value").alias("line"))


def ingest(ledger: Ledger, lines: DataFrame, checkpoint: str, refused: str | None = None) -> StreamingQuery:
    """Commit each micro-batch of lines behind the log, if the log stays legal with it.

    A verdict can move several records, so a batch is judged as a whole, against what it names of
    the log before it: only the records, moves and entities that a batch names are brought to the
    rules. A batch that is not legal is written to ``refused``, or fails the stream. A batch
    that was committed before a restart is known by its number and is not committed again.
    """

    def commit(batch: DataFrame, number: int) -> None:
        name = f"{len(ledger.batches()):08d}-stream-{number:012d}"
        if any(b.partition("-")[2] == name.partition("-")[2] for b in ledger.batches()):
            return
        fresh = numbered(batch, ledger.last()["seq"] + 1).cache()
        try:
            added = journal.parse_events(fresh, check=False)
            wrong = [] if added.count() == fresh.count() else ["a line is no event"]
            wrong = wrong or violations_of(ledger, added)
            if wrong:
                if refused is None:
                    raise Refused("; ".join(wrong))
                fresh.write.mode("append").json(refused)
            elif not fresh.isEmpty():
                ledger.commit(fresh, name)
        finally:
            fresh.unpersist()

    return lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered(batch: DataFrame, start: int) -> DataFrame:
    """``seq, line`` of a batch. Its files have no order among them: record-time gives it, entities first.

    Lines are sorted into ranges of time; each range counts for itself, from where those before it end.
    """
    rows = batch.select("line", F.from_json("line", "struct<recorded_at:string,at:string,id:string>").alias("e"))
    rows = rows.select("line", F.coalesce("e.recorded_at", "e.at", F.lit("")).alias("t"), F.coalesce("e.id", F.lit("")).alias("i"))
    parts = rows.repartitionByRange("t", "i").withColumn("part", F.spark_partition_id()).cache()
    try:
        sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
        before, offsets = start, []
        for part in sorted(sizes):
            offsets.append((part, before))
            before += sizes[part]
        at = batch.sparkSession.createDataFrame(offsets, "part int, before long")
        w = Window.partitionBy("part").orderBy("t", "i", "line")
        counted = parts.join(F.broadcast(at), "part").select((F.col("before") + F.row_number().over(w) - 1).alias("seq"), "line")
        # The numbers must not depend on how a range falls if a part is worked out again.
        return Workspace(batch.sparkSession, "batch").table(counted, "numbered")
    finally:
        parts.unpersist()


def violations_of(ledger: Ledger, added: DataFrame) -> list[str]:
    """Up to five rules that new events break, seen with what they name of the log."""
    records = journal.records(added).where("kind <> 'verdict'")
    effects, entities = journal.effects(added), journal.entities(added)
    last = ledger.last()["at"]
    if last is not None:
        # Batches are sorted by time within, so only the log's end can be later.
        back = added.where(F.unix_micros(F.coalesce("recorded_at", "at").cast("timestamp")) < last).select("id").limit(1).collect()
        if back:
            return [f"time_goes_back {back[0]['id']}"]
    claims = effects.where("action = 'answer'").select(journal.shown_id(F.col("reason")).alias("id"))
    named = effects.select(F.col("target_id").alias("id")).unionByName(claims).unionByName(records.select(F.col("supersedes").alias("id")))
    named = named.unionByName(records.select(F.col("redacted_by").alias("id"))).where(F.col("id").isNotNull()).distinct()
    about = records.select(F.explode(F.array_union("refs", F.array_compact(F.array("subject", "object_id")))).alias("id"))
    about = about.unionByName(records.select(F.explode("evidence.source").alias("id"))).where(F.col("id").isNotNull()).distinct()
    # Of a record in the log only its kind counts here; its own links were judged when it came.
    bare = {f.name: F.lit(None).cast(f.dataType) for f in records.schema if f.name not in ("seq", "record_id", "kind", "recorded_at", "version")}
    old = ledger.records.join(named, F.col("record_id") == F.col("id"), "left_semi").withColumns(bare).withColumn("text", F.lit("-"))
    moved = ledger.effects.join(named, F.col("target_id") == F.col("id"), "left_semi")
    known = ledger.entities.join(about, F.col("entity_id") == F.col("id"), "left_semi")
    found = validate.violations(records.unionByName(old), effects.unionByName(moved), entities.unionByName(known))
    own = records.select(F.col("record_id").alias("id")).unionByName(effects.select(F.col("target_id").alias("id")))
    own = own.unionByName(effects.select(F.col("verdict_id").alias("id")))
    return [f"{r['rule']} {r['id']}" for r in found.join(own.distinct(), "id", "left_semi").limit(5).collect()]


def postings_stream(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the postings of new records to a table: text never changes, so an index only grows."""
    from claimgraph.operators.lexical import TextIndex

    def add(batch: DataFrame, number: int) -> None:
        numbered = batch.select(F.monotonically_increasing_id().alias("seq"), "line")
        records = journal.records(journal.parse_events(numbered, check=False)).where(F.col("text").isNotNull())
        TextIndex(records).postings().write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, late: str = "1 day", length: str = "1 day") -> DataFrame:
    """Extension: events (at, name) in windows of time, those later than ``late`` left out."""
    return events.withWatermark("at", late).groupBy(F.window("at", length), "name").agg(F.count("*").alias("n"))
