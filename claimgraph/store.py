"""A store of one log: committed batches of events, the writer, and the tools that read it.

The log is a table of (seq, line) in batches. A batch is written in full and counts from the
moment its commit file stands, so it is there as a whole or not at all. One writer at a time
holds the store's lock; readers never wait.
"""

from __future__ import annotations

import json
import os
import secrets
import socket
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.functions.display import state_label
from claimgraph.operators import graph, lexical, redact, retrieve, state, validate, vectors, views
from claimgraph.schema import CLOSE_REASONS, ENVELOPE_VERSION, LEGAL, RETIRE_REASONS
from claimgraph.session import Workspace
from claimgraph.sources import journal

#: A clock that steps back by no more than this holds record-time; by more, writing is refused.
TOLERANCE = timedelta(minutes=5)
#: Least, most and default of the tools' limits.
SEARCH_LIMIT, LIST_LIMIT, AUDIT_LIMIT = (1, 50, 8), (1, 200, 25), (1, 500, 50)
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


class Refused(ValueError):
    """A draft that breaks a rule of the log; nothing of its batch is written."""


def clamp(limit: int | None, bounds: tuple[int, int, int]) -> int:
    return bounds[2] if limit is None else max(bounds[0], min(bounds[1], limit))


def new_id() -> str:
    n = (int(time.time() * 1000) << 80) | secrets.randbits(80)
    return "".join(ALPHABET[(n >> (5 * i)) & 31] for i in range(25, -1, -1))


def bare(i: str) -> str:
    return i.strip().upper().removeprefix("REC_").removeprefix("ENT_")


def stamp(t: datetime) -> str:
    t = t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
    return t.isoformat(timespec="microseconds").replace("+00:00", "Z")


@dataclass
class Draft:
    """What a caller may say; record-time, id and version are the writer's."""

    content: dict
    author: str
    author_kind: str = "human"
    channel: str = "session"
    reference: str | None = None
    detail: str | None = None
    valid_from: datetime | None = None
    valid_to: datetime | None = None
    evidence: list[dict] = field(default_factory=list)
    due_at: datetime | None = None
    on_event: str | None = None
    supersedes: str | None = None
    #: Given where another draft of the same batch names this one.
    id: str | None = None

    @property
    def kind(self) -> str:
        return next(iter(self.content)).lower()


def text_claim(body: str, about: Iterable[str] = ()) -> dict:
    return {"Claim": {"Text": {"body": body, "about": [bare(a) for a in about]}}}


def attribute(subject: str, name: str, value: object) -> dict:
    tag = "Boolean" if isinstance(value, bool) else "Integer" if isinstance(value, int) else "Number" if isinstance(value, float) else "Text"
    return {"Claim": {"Attribute": {"subject": bare(subject), "name": name, "value": {tag: value}}}}


def relation(subject: str, predicate: str, object_: str) -> dict:
    return {"Claim": {"Relation": {"subject": bare(subject), "predicate": predicate, "object": bare(object_), "properties": {}}}}


def pattern(context: str, forces: list[str], solution: str, about: Iterable[str] = ()) -> dict:
    return {"Claim": {"Pattern": {"context": context, "forces": forces, "solution": solution, "about": [bare(a) for a in about]}}}


def gap(question: str, territory: Iterable[str] = ()) -> dict:
    return {"Gap": {"question": question, "territory": [bare(a) for a in territory]}}


def hypothesis(statement: str, score_by: datetime, falsifier: str | None = None) -> dict:
    return {"Hypothesis": {"statement": statement, "score_by": stamp(score_by)} | ({"falsifier": falsifier} if falsifier else {})}


def verdict(action: str, rationale: str | None = None, **fields: object) -> dict:
    ids = {"target", "retiring", "targets", "gap", "with_claim", "hypothesis"}
    clean = {k: [bare(x) for x in v] if isinstance(v, list) else bare(v) if k in ids else v for k, v in fields.items() if v is not None}
    return {"Verdict": {"action": {action: clean}} | ({"rationale": rationale} if rationale else {})}


def redaction(record: str | None = None, entity: str | None = None, scope: str = "Content", reason: str = "") -> dict:
    target = {"Record": bare(record)} if record else {"Entity": bare(entity or "")}
    return {"Redaction": {"target": target, "scope": scope, "reason": reason}}


def moves_of(content: dict) -> list[tuple[str, str, str]]:
    """(record, verb, new state) of a verdict, in its order."""
    (name, a), = content["Verdict"]["action"].items()
    if name == "Promote":
        return [(a["target"], "promote", "promoted")] + ([(a["retiring"], "retire", "retired")] if a.get("retiring") else [])
    if name == "PromoteSet":
        return [(t, "promote", "promoted") for t in a["targets"]] + [(t, "retire", "retired") for t in a.get("retiring", [])]
    verb = name.lower()
    return [(a.get("target") or a.get("gap") or a.get("hypothesis"), verb, LEGAL[verb][2])]


def refs_of(content: dict) -> tuple[list[str], bool]:
    """The entities a record names, and whether it may name one twice."""
    (kind, c), = content.items()
    if kind == "Claim":
        (shape, c), = c.items()
        if shape == "Attribute":
            return [c["subject"]], True
        if shape == "Relation":
            return [c["subject"], c["object"]], True
        return c["about"], False
    return (c["territory"], False) if kind == "Gap" else ([], True)


class Lock:
    """A lock file beside the store; one whose process is gone is taken over."""

    def __init__(self, path: str):
        self.path, self.held = f"{path}.lock", False

    def acquire(self) -> None:
        for _ in range(2):
            try:
                with open(self.path, "x") as f:
                    f.write(f"{socket.gethostname()} {os.getpid()}")
                self.held = True
                return
            except FileExistsError:
                host, _, pid = open(self.path).read().partition(" ")
                if host != socket.gethostname() or self._lives(pid):
                    raise Refused(f"the store is written by {host} {pid}") from None
                os.remove(self.path)
        raise Refused("the store's lock cannot be taken")

    @staticmethod
    def _lives(pid: str) -> bool:
        try:
            os.kill(int(pid), 0)
        except (ProcessLookupError, ValueError):
            return False
        except PermissionError:
            pass
        return True

    def release(self) -> None:
        if self.held:
            os.remove(self.path)
            self.held = False

    def __enter__(self) -> Lock:
        self.acquire()
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


class Ledger:
    """The log of a folder, as tables. ``now`` can be given for tests."""

    def __init__(self, spark: SparkSession, path: str, now=lambda: datetime.now(UTC), read_only: bool = False):
        self.spark, self.path, self.now, self.read_only = spark, path.rstrip("/"), now, read_only
        if not read_only:
            os.makedirs(f"{self.path}/log", exist_ok=True)
            os.makedirs(f"{self.path}/commits", exist_ok=True)
        elif not os.path.isdir(f"{self.path}/commits"):
            raise Refused(f"there is no store at {self.path}")

    # ── reading ──

    def batches(self) -> list[str]:
        return sorted(b for b in os.listdir(f"{self.path}/commits") if not b.endswith(".tmp"))

    def follow(self) -> bool:
        """Read anew if another process has committed since; whether it has."""
        changed = self.batches() != self.__dict__.get("_read")
        if changed:
            self.refresh()
        return changed

    def lines(self) -> DataFrame:
        self._read = self.batches()
        committed = [f"{self.path}/log/{b}" for b in self._read]
        if not committed:
            return self.spark.createDataFrame([], "seq long, line string")
        return self.spark.read.schema("seq long, line string").parquet(*committed)

    def refresh(self) -> None:
        for name in ("events", "records", "effects", "entities", "measurements"):
            self.__dict__.pop(name, None)

    @cached_property
    def events(self) -> DataFrame:
        return journal.parse_events(self.lines(), check=False)

    @cached_property
    def records(self) -> DataFrame:
        return journal.records(self.events).where("kind <> 'verdict'")

    @cached_property
    def effects(self) -> DataFrame:
        return journal.effects(self.events)

    @cached_property
    def entities(self) -> DataFrame:
        return journal.entities(self.events)

    @cached_property
    def measurements(self) -> DataFrame:
        return journal.measurements(self.events)

    def violations(self) -> DataFrame:
        return validate.violations(self.records, self.effects, self.entities)

    # ── writing ──

    def commit(self, lines: DataFrame, name: str | None = None) -> None:
        """``seq, line`` as one batch. Its marker says the last number and time of the log with it."""
        if self.read_only:
            raise Refused("the store is open for reading only")
        name = name or f"{len(self.batches()):08d}"
        folder = f"{self.path}/log/{name}"
        lines.write.mode("overwrite").parquet(folder)
        written = self.spark.read.schema("seq long, line string").parquet(folder)
        said = F.from_json("line", "struct<recorded_at:string,at:string>")
        at = F.max(F.coalesce(said["recorded_at"], said["at"]).cast("timestamp"))
        top = written.agg(F.max("seq").alias("seq"), F.unix_micros(at).alias("at")).first()
        last = self.last()
        self._mark(name, {"seq": max(-1 if top["seq"] is None else top["seq"], last["seq"]), "at": max(top["at"] or 0, last["at"] or 0) or None})
        self.refresh()

    def _mark(self, name: str, last: dict) -> None:
        """The marker that makes a batch count, behind its rows on the disk."""
        for f in os.scandir(f"{self.path}/log/{name}"):
            with open(f.path, "rb") as rows:
                os.fsync(rows.fileno())
        with open(f"{self.path}/commits/{name}.tmp", "w") as f:
            json.dump(last, f)
            f.flush()
            os.fsync(f.fileno())
        os.rename(f"{self.path}/commits/{name}.tmp", f"{self.path}/commits/{name}")

    def last(self) -> dict:
        """``seq`` and ``at`` (microseconds) of the log's end: from the last marker, or where that is an
        empty one of old, from the log."""
        batches = self.batches()
        if not batches:
            return {"seq": -1, "at": None}
        with open(f"{self.path}/commits/{batches[-1]}") as f:
            text = f.read()
        if text:
            return json.loads(text)
        top = self.lines().agg(F.max("seq")).first()[0]
        times = [x.agg(F.unix_micros(F.max("recorded_at"))).first()[0] for x in (self.records, self.effects)]
        return {"seq": -1 if top is None else top, "at": max((x for x in times if x), default=None)}

    def import_log(self, path: str) -> None:
        """A log file as one batch, if it is whole and breaks no rule."""
        events = journal.parse_events(journal.read_lines(self.spark, path))
        start = self._next_seq()
        numbered = events.select((F.col("seq") + start).alias("seq"), "line")
        records = journal.records(events).where("kind <> 'verdict'")
        wrong = validate.violations(records, journal.effects(events), journal.entities(events)).limit(3).collect()
        if wrong:
            raise Refused("; ".join(f"{w['rule']} {w['id']}" for w in wrong))
        self.commit(numbered)

    def _next_seq(self) -> int:
        return self.last()["seq"] + 1

    def _commit_events(self, events: list[dict]) -> None:
        start = self._next_seq()
        rows = [(start + i, json.dumps(e, ensure_ascii=False, separators=(",", ":"))) for i, e in enumerate(events)]
        self.commit(self.spark.createDataFrame(rows, "seq long, line string").coalesce(1))

    def add_entities(self, named: list[tuple[str, str]]) -> list[str]:
        ids = [new_id() for _ in named]
        self._commit_events([{"event": "entity", "id": i, "kind": k, "label": n} for i, (k, n) in zip(ids, named)])
        return [f"ent_{i}" for i in ids]

    def upsert_entities(self, named: list[tuple[str, str]]) -> list[str]:
        """Ids of (kind, label), the first where there are several; new ones are made once."""
        wanted = list(dict.fromkeys(named))
        asked = self.spark.createDataFrame(wanted, "kind string, label string") if wanted else None
        held = {} if asked is None else {
            (r["kind"], r["label"]): r["entity_id"] for r in views.find_entities(self.entities).join(F.broadcast(asked), ["kind", "label"]).collect()
        }
        missing = [n for n in wanted if n not in held]
        if missing:
            held |= dict(zip(missing, self.add_entities(missing)))
        return [held[n] for n in named]

    def record_time(self) -> datetime:
        """Now, or the log's last time while the clock is a little behind it."""
        last = self.last()["at"]
        last = None if last is None else datetime.fromtimestamp(0, UTC) + timedelta(microseconds=last)
        now = self.now()
        now = now.replace(tzinfo=UTC) if now.tzinfo is None else now
        if last is None:
            return now
        if now >= last:
            return now
        if last - now > TOLERANCE:
            raise Refused(f"the clock is {last - now} behind the log")
        return last

    def append(self, drafts: list[Draft], rehearse: dict[str, str] | None = None) -> list[str]:
        """Write drafts as one batch, or refuse them all. Each may build on those before it.

        With ``rehearse``, kinds of entities that would be made by then, all is checked and nothing written.

        The drafts are checked one after the other on the driver, against the state of what they
        name: a batch is small, and only the rows it names are read.
        """
        at = self.record_time()
        named = {bare(x) for d in drafts for x in self._named(d)}
        wanted = self.spark.createDataFrame([(n,) for n in sorted(named)], "id string") if named else None
        entity_kind = {bare(i): kind for i, kind in (rehearse or {}).items()}
        held: dict[str, list] = {}
        if wanted is not None:
            for r in self.entities.join(F.broadcast(wanted), F.expr("substr(entity_id, 5)") == F.col("id")).collect():
                entity_kind[r["id"]] = r["kind"]
            mine = self.records.join(F.broadcast(wanted), F.expr("substr(record_id, 5)") == F.col("id"))
            for r in state.with_state(mine, self.effects).select("id", "kind", "state").collect():
                held[r["id"]] = [r["kind"], r["state"]]
        events, ids = [], []
        for d in drafts:
            i = bare(d.id) if d.id else new_id()
            self._check(d, at, entity_kind, held)
            if d.kind != "verdict":
                opening = {"claim": "proposed", "gap": "registered", "hypothesis": "registered"}.get(d.kind)
                held[i] = [d.kind, opening]
            events.append(self._event(d, i, at))
            ids.append(f"rec_{i}")
        if rehearse is None:
            self._commit_events(events)
        return ids

    @staticmethod
    def _named(d: Draft) -> list[str]:
        out = [*refs_of(d.content)[0], *[e["source"] for e in d.evidence], *([d.supersedes] if d.supersedes else [])]
        if d.kind == "verdict":
            out += [m[0] for m in moves_of(d.content)]
            out += [a["with_claim"] for a in d.content["Verdict"]["action"].values() if a.get("with_claim")]
        if d.kind == "redaction":
            out += list(d.content["Redaction"]["target"].values())
        return out

    @staticmethod
    def _check(d: Draft, at: datetime, entity_kind: dict[str, str], held: dict[str, list]) -> None:
        utc = lambda t: t.replace(tzinfo=UTC) if t.tzinfo is None else t
        begin = utc(d.valid_from) if d.valid_from else at
        if d.valid_to is not None and utc(d.valid_to) <= begin:
            raise Refused("the validity is empty")
        for e in d.evidence:
            if entity_kind.get(bare(e["source"])) != "source":
                raise Refused(f"evidence {e['source']} is no source")
        if d.supersedes and held.get(bare(d.supersedes), [None])[0] != d.kind:
            raise Refused(f"{d.supersedes} is not there, or of another kind")
        refs, twice = refs_of(d.content)
        for r in refs:
            if r not in entity_kind:
                raise Refused(f"no entity {r}")
        if not twice and len(set(refs)) < len(refs):
            raise Refused("an entity is named twice")
        (kind, c), = d.content.items()
        worded = c.get("question") if kind == "Gap" else c.get("Text", {}).get("body", "x") if kind == "Claim" else "x"
        if not worded.strip():
            raise Refused("there is no text")
        if kind in ("Verdict", "Redaction") and d.author_kind != "human":
            raise Refused("only people rule and redact")
        if kind == "Redaction":
            (what, target), = c["target"].items()
            if target not in (held if what == "Record" else entity_kind) or not c["reason"].strip():
                raise Refused("a redaction needs a target that is there, and a reason")
        if kind == "Verdict":
            (name, a), = c["action"].items()
            reasons = {"Retire": RETIRE_REASONS, "Withdraw": CLOSE_REASONS[:-1], "Abandon": CLOSE_REASONS[:-1]}.get(name)
            if reasons and a.get("reason") not in reasons:
                raise Refused(f"{name} for {a.get('reason')}")
            moves = moves_of(d.content)
            if not moves or len({m[0] for m in moves}) < len(moves):
                raise Refused("a verdict moves every record once, and at least one")
            for target, verb, _ in moves:
                wants, before, _ = LEGAL[verb]
                if held.get(target) != [wants, before]:
                    raise Refused(f"{verb} {target}: it is {held.get(target)}")
            if name == "Answer" and held.get(a["with_claim"]) != ["claim", "promoted"]:
                raise Refused("only a promoted claim answers")
            for target, _, to in moves:
                held[target] = [held[target][0], to]

    def _event(self, d: Draft, i: str, at: datetime) -> dict:
        e = {
            "event": "record", "id": i, "recorded_at": stamp(at), "envelope_version": ENVELOPE_VERSION,
            "author": {"name": d.author, "kind": d.author_kind.capitalize()} | ({"detail": d.detail} if d.detail else {}),
            "source": {"channel": d.channel} | ({"reference": d.reference} if d.reference else {}),
            "valid_from": stamp(d.valid_from or at),
        }
        more = {
            "valid_to": stamp(d.valid_to) if d.valid_to else None,
            "evidence": [x | {"source": bare(x["source"])} for x in d.evidence],
            "review_trigger": {k: v for k, v in (("due_at", stamp(d.due_at) if d.due_at else None), ("on_event", d.on_event)) if v},
            "supersedes": bare(d.supersedes) if d.supersedes else None,
        }
        return e | {k: v for k, v in more.items() if v} | {"content": d.content}

    def measure(self, target: str, name: str, value: float, by: str) -> None:
        """An upsert on the panel; the last one in the log counts."""
        kind = "Relation" if target.startswith("rec_") else "Entity"
        known = (
            self.records.where((F.col("record_id") == target) & (F.col("shape") == "relation"))
            if kind == "Relation"
            else self.entities.where(F.col("entity_id") == target)
        )
        if known.isEmpty():
            raise Refused(f"no {kind.lower()} {target}")
        at = stamp(self.record_time())
        self._commit_events(
            [{"event": "measurement", "target": {kind: bare(target)}, "name": name, "value": value, "at": at, "by": {"name": by, "kind": "Human"}}]
        )

    def redact(self) -> dict[bool, int]:
        """Apply the log's own declarations; the old batches are removed once the new one stands."""
        done = redact.apply_redactions(self.events)
        old = self.batches()
        name = f"{len(old):08d}"
        done.select("seq", "line").write.mode("overwrite").parquet(f"{self.path}/log/{name}")
        fresh = self.spark.read.parquet(f"{self.path}/log/{name}")
        events = journal.parse_events(fresh, check=False)
        counts = {r["rewritten"]: r["n"] for r in redact.report(done).collect()}
        # The last validation of the old log holds but for receipts, which are new.
        missing = validate.unreceipted_redactions(journal.records(events)).limit(1).collect()
        if missing or fresh.count() != self.lines().count():
            raise Refused("the redacted log would not replay")
        last = self.last()
        for b in old:
            os.rename(f"{self.path}/commits/{b}", f"{self.path}/log/{b}/_dropped")
        self._mark(name, last)
        import shutil

        for b in old:
            shutil.rmtree(f"{self.path}/log/{b}")
        self.refresh()
        return counts


class Keeper:
    """The verdicts of a person at the keyboard."""

    def __init__(self, ledger: Ledger, author: str):
        self.ledger, self.author = ledger, author

    def _rule(self, content: dict) -> str:
        with Lock(self.ledger.path):
            return self.ledger.append([Draft(content, self.author, channel="keyboard", detail="asserted at the keyboard")])[0]

    def promote(self, target: str, retiring: str | None = None, rationale: str | None = None) -> str:
        return self._rule(verdict("Promote", rationale, target=target, retiring=retiring))

    def promote_set(self, targets: list[str], basis: str = "OneAct", retiring: list[str] | None = None) -> str:
        return self._rule(verdict("PromoteSet", targets=targets, basis=basis, retiring=retiring or []))

    def reject(self, target: str, rationale: str | None = None) -> str:
        return self._rule(verdict("Reject", rationale, target=target))

    def retire(self, target: str, reason: str, rationale: str | None = None) -> str:
        return self._rule(verdict("Retire", rationale, target=target, reason=reason))

    def answer(self, gap_id: str, with_claim: str, rationale: str | None = None) -> str:
        return self._rule(verdict("Answer", rationale, gap=gap_id, with_claim=with_claim))

    def withdraw(self, gap_id: str, reason: str, rationale: str | None = None) -> str:
        return self._rule(verdict("Withdraw", rationale, gap=gap_id, reason=reason))

    def score(self, hypothesis_id: str, outcome: str, rationale: str | None = None) -> str:
        return self._rule(verdict("Score", rationale, hypothesis=hypothesis_id, outcome=outcome))

    def abandon(self, hypothesis_id: str, reason: str, rationale: str | None = None) -> str:
        return self._rule(verdict("Abandon", rationale, hypothesis=hypothesis_id, reason=reason))


def record_out(records: DataFrame, effects: DataFrame, entities: DataFrame) -> DataFrame:
    """A record as the tools show it: with its state, the labels of what it is about and of its evidence."""
    labels = entities.select("entity_id", F.concat_ws(":", "kind", "label").alias("label"))
    about = records.select("record_id", F.posexplode("refs").alias("n", "entity_id")).join(labels, "entity_id", "left")
    about = about.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("n", "entity_id", "label"))).alias("about"))
    shown = F.coalesce(F.col("e.source"), F.lit(""))
    ev = records.select("record_id", F.posexplode("evidence").alias("n", "e")).join(labels, shown == F.col("entity_id"), "left")
    ev = ev.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("n", "label", F.col("e.span").alias("span")))).alias("evidence"))
    out = state.with_state(records.drop("evidence"), effects).join(about, "record_id", "left").join(ev, "record_id", "left")
    return out.withColumn("state", state_label(F.col("state"))).select(
        "record_id", "kind", "state", "text", "about", "evidence", "author_name", "author_kind", "channel", "reference",
        "recorded_at", "valid_from", "valid_to", "supersedes",
    )


class KnowledgeStore:
    """The ten tools of a host. Each gives a DataFrame; every call is written to the audit, failed ones too.

    Without the lock a host follows: it reads what others commit. The first write takes the lock,
    which is then held until ``close``; if another process has it, that write is refused.
    """

    def __init__(self, ledger: Ledger, agent: str = "agent", hold: bool = False, embedder: vectors.Embedder | None = None):
        from claimgraph.index import SearchIndex

        self.index = SearchIndex(ledger, embedder)
        self.ledger, self.agent = ledger, agent
        self.audit_path = f"{ledger.path}/audit.jsonl"
        self.lock = Lock(ledger.path)
        self.hold = hold
        #: Lines of the audit that the last read could not parse.
        self.audit_dropped = 0

    @contextmanager
    def _writing(self) -> Iterator[None]:
        """The lock, from now on if this host is to hold it; what was committed before is read first."""
        if not self.lock.held:
            self.lock.acquire()
            self.ledger.follow()
        try:
            yield
        finally:
            if not self.hold:
                self.lock.release()

    def close(self) -> None:
        self.lock.release()

    def _audited(self, tool: str, detail: str, call):
        outcome = "failed"
        try:
            if not self.lock.held:
                self.ledger.follow()
            result = call()
            outcome = "ok"
            return result
        finally:
            with open(self.audit_path, "a") as f:
                f.write(json.dumps({"at": stamp(self.ledger.now()), "tool": tool, "detail": detail, "outcome": outcome}) + "\n")

    def _view(self, proposed: bool = False, everything: bool = False, at: datetime | None = None) -> views.ViewSpec:
        moment = at or self.ledger.record_time()
        moment = moment.astimezone(UTC).replace(tzinfo=None) if moment.tzinfo else moment
        return views.ViewSpec.at(moment, states="all" if everything else "promoted_and_proposed" if proposed else "promoted")

    def _resolve(self, names: Iterable[str]) -> list[str]:
        """``kind:label`` or an id; an unknown name is refused, never made."""
        out = []
        for n in names:
            kind, colon, label = n.partition(":")
            found = (
                self.ledger.entities.where((F.col("kind") == kind) & (F.col("label") == label))
                if colon
                else self.ledger.entities.where(F.col("entity_id") == f"ent_{bare(n)}")
            )
            first = found.agg(F.min("entity_id")).first()[0]
            if first is None:
                raise Refused(f"no entity {n}")
            out.append(first)
        return out

    def search(self, text: str, k: int | None = None, scope: Iterable[str] = (), hops: int = 0, proposed: bool = False,
               everything: bool = False, vectors_too: bool = True, options: retrieve.Options = retrieve.Options()) -> retrieve.Answers:
        def call() -> retrieve.Answers:
            from dataclasses import replace

            spark, led = self.ledger.spark, self.ledger
            asked = spark.createDataFrame([(1, text)], "query_id long, text string")
            view = Workspace(spark, "search").table(views.admitted(led.records, led.effects, self._view(proposed, everything)), "view")
            scoped = self._resolve(scope)
            of = spark.createDataFrame([(1, s) for s in scoped], "query_id long, entity_id string") if scoped else None
            self.index.advance()
            found = lexical.search(self.index.texts(), asked, view, of)
            similar = spark.createDataFrame([], "query_id long, record_id string, similarity double")
            if vectors_too:
                similar = self.index.similar(asked, views.in_scope(view, scoped))
            o = replace(options, k=clamp(k, SEARCH_LIMIT))
            more = None
            if hops:
                seeds = retrieve.list_items(found, similar, led.records, o).join(led.records.select("record_id", "refs"), "record_id")
                more = graph.expand(seeds, views.edges(view), views.about(view), min(hops, graph.MAX_HOPS))
            answers = retrieve.retrieve(found, similar, led.records, o, more)
            if of is not None:
                answers.gaps = retrieve.scoped_gaps(view, of, o.gap_budget)
            return answers

        return self._audited("search", text, call)

    def get_record(self, record_id: str) -> DataFrame:
        def call() -> DataFrame:
            found = self.ledger.records.where(F.col("record_id") == f"rec_{bare(record_id)}")
            if found.isEmpty():
                raise Refused(f"no record {record_id}")
            shown = journal.shown_texts(self.ledger.events).withColumnRenamed("shown", "text")
            out = record_out(found, self.ledger.effects, self.ledger.entities)
            return out.drop("text").join(shown, "record_id", "left").select(*out.columns)

        return self._audited("get_record", record_id, call)

    def verdicts(self, record_id: str) -> DataFrame:
        """The verdicts that moved a record, in words, in log order."""

        def call() -> DataFrame:
            moved = self.ledger.effects.where(F.col("target_id") == f"rec_{bare(record_id)}").select("verdict_id").distinct()
            return journal.verdicts(self.ledger.events).join(moved, "verdict_id", "left_semi").orderBy("seq")

        return self._audited("verdicts", record_id, call)

    def history(self, record_id: str) -> DataFrame:
        mine = lambda: state.history(self.ledger.effects.where(F.col("target_id") == f"rec_{bare(record_id)}")).orderBy("n")
        return self._audited("history", record_id, mine)

    def open_questions(self, limit: int | None = None) -> DataFrame:
        n = clamp(limit, LIST_LIMIT)
        call = lambda: state.registered_gaps(self.ledger.records, self.ledger.effects).orderBy("seq").limit(n)
        return self._audited("open_questions", str(n), call)

    def as_of(self, record_id: str, at: datetime) -> DataFrame:
        def call() -> DataFrame:
            mine = self.ledger.records.where(F.col("record_id") == f"rec_{bare(record_id)}")
            return state.with_state(mine, self.ledger.effects, at).select("record_id", "state")

        return self._audited("as_of", f"{record_id} {at}", call)

    def contradictions(self, at: datetime | None = None, limit: int | None = None) -> DataFrame:
        call = lambda: state.contradictions(self.ledger.records, self.ledger.effects, at).limit(clamp(limit, LIST_LIMIT))
        return self._audited("contradictions", str(at), call)

    def pending_proposals(self, limit: int | None = None) -> DataFrame:
        """The newest of the queue, in log order, with what is folded under it."""
        n = clamp(limit, LIST_LIMIT)

        def call() -> DataFrame:
            w = Window.partitionBy("queue").orderBy(F.desc("seq"))
            rows = state.pending(self.ledger.records, self.ledger.effects).withColumn("back", F.row_number().over(w))
            return rows.where((F.col("queue") != "queued") | (F.col("back") <= n)).drop("back").orderBy("seq")

        return self._audited("pending_proposals", str(n), call)

    def propose_claim(self, content: dict, **envelope: object) -> tuple[str, DataFrame]:
        """The new id, and the records that already state the same."""

        def call() -> tuple[str, DataFrame]:
            with self._writing():
                i = self.ledger.append([Draft(content, self.agent, "agent", "agent_session", **envelope)])[0]
            same = state.identical_groups(self.ledger.records)
            mine = same.where(F.col("record_id") == i).select("first_id")
            return i, same.join(F.broadcast(mine), "first_id").where(F.col("record_id") != i)

        return self._audited("propose_claim", json.dumps(content, ensure_ascii=False)[:200], call)

    def register_gap(self, question: str, territory: Iterable[str] = ()) -> str:
        def call() -> str:
            about = self._resolve(territory)
            with self._writing():
                return self.ledger.append([Draft(gap(question, about), self.agent, "agent", "agent_session")])[0]

        return self._audited("register_gap", question, call)

    def _audit_tail(self, n: int) -> list[tuple[int, str]]:
        """The last lines of the audit with the bytes before each, read from the end in blocks."""
        if not os.path.exists(self.audit_path):
            return []
        with open(self.audit_path, "rb") as f:
            at, held = f.seek(0, os.SEEK_END), b""
            while at > 0 and held.count(b"\n") <= n:
                step = min(at, 1 << 16)
                at -= step
                f.seek(at)
                held = f.read(step) + held
        out = []
        for line in held.splitlines(keepends=True):
            if line.strip():
                out.append((at, line.decode(errors="replace")))
            at += len(line)
        return out[-n:]

    def audit(self, limit: int | None = None) -> DataFrame:
        """The last calls, newest first; lines that do not parse are left out and counted in ``audit_dropped``."""
        n = clamp(limit, AUDIT_LIMIT)

        def call() -> DataFrame:
            lines, self.audit_dropped = self._audit_tail(n), 0
            rows = []
            for at, line in lines:
                try:
                    said = json.loads(line)
                    rows.append((at, *(said[c] for c in ("at", "tool", "detail", "outcome"))))
                except (ValueError, KeyError, TypeError):
                    self.audit_dropped += 1
            return self.ledger.spark.createDataFrame(rows, "seq long, at string, tool string, detail string, outcome string").orderBy(F.desc("seq"))

        return self._audited("audit", str(n), call)
