"""Documents into a store: what is new or reads otherwise is appended, verdicts are transcribed.

A document's whole sync is one batch, so it is refused or written as a whole. What a row was
ingested from is in its reference (document, key, digest); a row whose digest is unchanged costs
nothing. Documents are bounded by a person's writing; of the log only what they name is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path, PurePosixPath

from pyspark.sql import functions as F

from claimgraph import store as S
from claimgraph.operators import keeper, state
from claimgraph.sources import formats


@dataclass
class Report:
    #: key -> fresh, unchanged or changed
    dispositions: dict[str, str] = field(default_factory=dict)
    #: keys whose settled record reads otherwise now: for a person to resolve
    drifted: list[str] = field(default_factory=list)
    #: keys that were ingested once and are gone from the documents
    absent: list[str] = field(default_factory=list)
    #: names that a document refers to and nothing has
    dangling: list[str] = field(default_factory=list)
    written: int = 0


def _date(text: str | None) -> datetime | None:
    found = re.match(r"\s*(\d{4})-(\d{2})-(\d{2})(?:\s|$)", text or "")
    return datetime(*map(int, found.groups()), tzinfo=UTC) if found else None


#: Fixed value: the document that evidence means by "this file".
THIS_FILE = "DECISIONS.md"


def split_entry(entry: str) -> tuple[str, str | None]:
    """Path and place of one entry of evidence; ``this file`` is the decisions themselves."""
    if entry.startswith("this file"):
        return THIS_FILE, entry[len("this file") :].lstrip(" —").strip() or None
    path, _, span = entry.partition(" ")
    return path, span.strip() or None


def contained(path: str, root: str) -> str | None:
    """The path below ``root``, of ``docs`` or else of the root itself; None if it is nowhere, or leads out.

    Paths that are absolute or go upwards are refused as written, links by where they end.
    """
    given = PurePosixPath(path)
    if not given.parts or given.is_absolute() or any(p in ("..", ".") for p in path.rstrip("/").split("/")):
        return None
    base = Path(root).resolve()
    for below in (PurePosixPath("docs") / given, given):
        if (base / below).exists():
            return str(below) if (base / below).resolve().is_relative_to(base) else None
    return None


def evidence_of(listed: str, own: str, root: str) -> list[tuple[str, str | None]]:
    """(source, place) of each entry; one that resolves to nothing in the repository refuses the document."""
    found = []
    for entry in formats.split_evidence(listed):
        path, span = split_entry(entry)
        below = contained(path, root)
        if below is None:
            raise formats.FormatError(f"{own}: evidence {entry!r} is not in the repository")
        found.append((below, span))
    return found


class _Sync:
    """One document's batch in the making."""

    def __init__(self, ledger: S.Ledger, document: str, admits=lambda key: True, rehearse: dict[str, str] | None = None):
        self.ledger, self.document, self.admits, self.rehearse = ledger, document, admits, rehearse
        self.drafts: list[S.Draft] = []
        self.report = Report()
        prior = keeper.prior_origins(ledger.records).where(F.col("identity").startswith(f"{document}#"))
        known = state.with_state(ledger.records, ledger.effects).select("record_id", "state", "kind")
        self.prior = {r["identity"].partition("#")[2]: r for r in prior.join(known, "record_id").collect()}
        self.seen: set[str] = set()

    def disposition(self, key: str, digest: str) -> str:
        self.seen.add(key)
        old = self.prior.get(key)
        told = "fresh" if old is None else "unchanged" if old["digest"] == digest else "changed"
        if "/" not in key:
            self.report.dispositions[key] = told
        return told

    def say(self, key: str, digest: str, content: dict, author: str, **more: object) -> str:
        """A draft for a key, in place of what was said there before."""
        i = S.new_id()
        old = self.prior.get(key)
        supersedes = old["record_id"] if old is not None and old["kind"] == next(iter(content)).lower() else None
        noted = more.pop("noted", None)
        reference = f"{self.document}#{key}" + (f" recorded:{noted}" if noted else "") + f" digest:{digest}"
        self.drafts.append(S.Draft(content, author, channel="corpus-ingest", reference=reference, supersedes=supersedes, id=i, **more))
        return i

    def rule(self, key: str, author: str, action: str, **fields: object) -> None:
        if self.admits(key):
            reference = f"{self.document} {key}"
            self.drafts.append(S.Draft(S.verdict(action, f"transcribed from {reference}", **fields), author, channel="corpus-ingest", reference=reference))

    def finish(self) -> Report:
        self.report.absent = sorted(k for k in self.prior if k not in self.seen and "/" not in k)
        self.report.written = len(self.drafts)
        if self.drafts and self.rehearse is not None:
            self.ledger.append(self.drafts, self.rehearse)
        elif self.drafts:
            with S.Lock(self.ledger.path):
                self.ledger.append(self.drafts)
        return self.report


def sync_decisions(
    ledger: S.Ledger, text: str, document: str = "DECISIONS.md", admits=lambda key: True, root: str | None = None, rehearse: bool = False
) -> Report:
    """Decisions and hypotheses: the body, its title as an attribute, and edges to what it mentions.

    A promoted decision promotes body and title in one act and retires the wording before. The edges
    are an agent's and stay proposed. An open hypothesis that reads otherwise is abandoned for its new
    wording; a scored one has drifted. With ``root``, the repository's folder, evidence becomes sources.
    With ``rehearse`` everything is checked and told, and nothing is written.
    """
    parsed = formats.parse_decisions(text)
    named = {m for d in parsed for m in formats.mentioned(d.raw, d.id)}
    labels = [("decision", d.id) for d in parsed]
    known = {d.id for d in parsed} | {n for n in named if n.startswith("U-")}
    labels += [("unknown", n) for n in sorted(named) if n.startswith("U-")]
    evidence = {d.id: evidence_of(d.yaml["evidence"], d.id, root) for d in parsed if root is not None and d.yaml.get("evidence")}
    labels += [("source", path) for path in sorted({path for e in evidence.values() for path, _ in e})]
    made = [S.new_id() for _ in labels] if rehearse else ledger.upsert_entities(labels)
    ids = dict(zip([n for _, n in labels], made))
    kinds = dict(zip(made, [kind for kind, _ in labels])) if rehearse else None
    sync = _Sync(ledger, document, admits, kinds)
    sync.report.dangling = sorted(named - known)
    for d in parsed:
        digest = formats.digest(d.raw)
        told, old = sync.disposition(d.id, digest), sync.prior.get(d.id)
        sync.seen |= {f"{d.id}/title"} | {f"{d.id}/mentions-{m}" for m in named}
        settled = told == "changed" and d.id[0] == "H" and old["state"] != "registered"
        if settled:
            sync.report.drifted.append(d.id)
        if told == "unchanged" or settled:
            continue
        author = d.yaml.get("author", "unknown")
        trigger = d.yaml.get("review_trigger")
        when = {"valid_from": _date(d.yaml.get("valid_from")), "noted": d.yaml.get("recorded"), "due_at": _date(trigger),
                "on_event": None if _date(trigger) else trigger}
        when["evidence"] = [{"source": ids[path]} | ({"span": span} if span else {}) for path, span in evidence.get(d.id, [])]
        kind, shape, body = d.content()
        if kind == "hypothesis":
            by = _date(d.yaml["score_by"])
            if by is None:
                raise formats.FormatError(f"{d.id}: score_by is no date")
            sync.say(d.id, digest, S.hypothesis(d.sections["Hypothesis"], by, d.sections.get("Falsifier")), author, **when)
            if old is not None:
                sync.rule(d.id, author, "Abandon", hypothesis=old["record_id"], reason="Superseded")
            continue
        if shape == "pattern":
            rest = "\n\n".join([d.sections.get("Assertion", ""), *[f"{k}. {v}" for k, v in d.sections.items() if k not in ("Assertion", "Forces")]])
            content = S.pattern(d.title, formats.split_forces(d.sections["Forces"]), rest, [ids[d.id]])
        else:
            content = S.text_claim(body, [ids[d.id]])
        body_id = sync.say(d.id, digest, content, author, **when)
        title_old = sync.prior.get(f"{d.id}/title")
        title_id = sync.say(f"{d.id}/title", digest, S.attribute(ids[d.id], "title", d.title), author)
        for m in formats.mentioned(d.raw, d.id):
            if m in ids:
                sync.say(f"{d.id}/mentions-{m}", digest, S.relation(ids[d.id], "mentions", ids[m]), "keeper", author_kind="agent")
        retiring = [o["record_id"] for o in (old, title_old) if o is not None and o["state"] == "promoted"]
        if d.yaml.get("state") in ("promoted", "retired"):
            sync.rule(d.id, author, "PromoteSet", targets=[body_id, title_id], retiring=retiring, basis="OneAct")
        if d.yaml.get("state") == "retired" and sync.admits(d.id):
            for i in (body_id, title_id):
                sync.rule(d.id, author, "Retire", target=i, reason="NoLongerTrue")
        if d.yaml.get("state") == "rejected":
            for i in (body_id, title_id):
                sync.rule(d.id, author, "Reject", target=i)
    return sync.finish()


def sync_register(ledger: S.Ledger, text: str, document: str = "REGISTER.md", decisions: str = "DECISIONS.md", admits=lambda key: True) -> Report:
    """Open questions: a reworded one is withdrawn for its new wording, a resolved one is answered by the
    promoted decision it names, or withdrawn as answered elsewhere; a settled one that reads otherwise has drifted."""
    author = formats.register_owner(text) or "unknown"
    lines = [(i, line.strip()) for i, line in enumerate(text.splitlines(), 1) if line.strip().startswith("| U-")]
    rows = formats.parse_register_rows(ledger.spark.createDataFrame(lines, "line int, raw_row string")).orderBy("line").collect()
    keys = [r["unknown_id"] for r in rows]
    if any(r["bad"] for r in rows) or len(set(keys)) < len(keys):
        raise formats.FormatError("a register row is bad, or an id stands twice")
    ids = dict(zip(keys, ledger.upsert_entities([("unknown", k) for k in keys])))
    claims = {k: v for k, v in _Sync(ledger, decisions).prior.items() if v["state"] == "promoted"}
    sync = _Sync(ledger, document, admits)
    for r in rows:
        key, digest = r["unknown_id"], formats.digest(r["raw_row"])
        told, old = sync.disposition(key, digest), sync.prior.get(key)
        open_ = old is not None and old["state"] == "registered"
        if told == "unchanged":
            continue
        if told == "changed" and not open_:
            sync.report.drifted.append(key)
            continue
        i = sync.say(key, digest, S.gap(r["question"], [ids[key]]), author, on_event=r["trigger_text"] or None)
        if old is not None:
            sync.rule(key, author, "Withdraw", gap=old["record_id"], reason="Superseded")
        if r["resolved"]:
            by = claims.get(r["resolved_by"])
            if by is not None:
                sync.rule(key, author, "Answer", gap=i, with_claim=by["record_id"])
            else:
                sync.rule(key, author, "Withdraw", gap=i, reason="AnsweredElsewhere")
    return sync.finish()


def sync_proposals(ledger: S.Ledger, texts: list[str], document: str = "proposals") -> Report:
    """Proposals: bodies take the state of their status; titles and requirements stay proposed.

    Links are resolved over all proposals of the call, in whatever order they come. A superseded one is
    retired by the promotion of the one that replaces it, or by itself.
    """
    parsed = sorted((formats.parse_proposal(t) | {"digest": formats.digest(t)} for t in texts), key=lambda p: p["number"])
    name = lambda n: f"PEP-{n:04d}"
    ids = dict(zip([p["number"] for p in parsed], ledger.upsert_entities([("proposal", name(p["number"])) for p in parsed])))
    sync, bodies, fresh = _Sync(ledger, document), {}, []
    for p in parsed:
        key = name(p["number"])
        told, author = sync.disposition(key, p["digest"]), ", ".join(p["authors"])
        sync.seen |= {f"{key}/title"} | {f"{key}/requires-{r}" for r in p["requires"]}
        sync.report.dangling += [name(n) for n in [*p["replaces"], *p["requires"]] if n not in ids]
        if told == "unchanged":
            bodies[p["number"]] = S.bare(sync.prior[key]["record_id"])
            continue
        fresh.append(p)
        about = {"valid_from": _date(p["created"]), "noted": p["created"]}
        bodies[p["number"]] = sync.say(key, p["digest"], S.text_claim(p["body"], [ids[p["number"]]]), author, **about)
        sync.say(f"{key}/title", p["digest"], S.attribute(ids[p["number"]], "title", p["title"]), author)
        for r in p["requires"]:
            if r in ids:
                sync.say(f"{key}/requires-{r}", p["digest"], S.relation(ids[p["number"]], "requires", ids[r]), author)
    held = {S.bare(o["record_id"]): o["state"] for o in sync.prior.values()}
    for p in fresh:
        key, author, old = name(p["number"]), p["authors"][0], sync.prior.get(name(p["number"]))
        if p["state"] in ("promoted", "replaced"):
            retiring = old["record_id"] if old is not None and old["state"] == "promoted" else None
            sync.rule(key, author, "Promote", target=bodies[p["number"]], retiring=retiring)
            held[bodies[p["number"]]] = "promoted"
        elif p["state"] == "refused":
            sync.rule(key, author, "Reject", target=bodies[p["number"]])
    gone = {p["number"] for p in fresh if p["state"] == "replaced"} | {n for p in fresh if p["state"] == "promoted" for n in p["replaces"]}
    for n in sorted(gone):
        if n in bodies and held.get(bodies[n]) == "promoted":
            sync.rule(name(n), "keeper", "Retire", target=bodies[n], reason="Superseded")
    return sync.finish()
