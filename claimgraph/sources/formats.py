"""Readers of the text formats: decision documents, registers, proposals, question suites.

A document is parsed as a whole, by ``mapInPandas`` over whole files; what is wrong in it
raises FormatError with the place. Register rows stand for themselves and are read natively.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.operators.vectors import fnv1a

#: The keys that a decision's yaml block may have.
YAML_KEYS = frozenset("id state author recorded valid_from source evidence review_trigger score_by".split())
#: A proposal's statuses, and the state in which each leaves it.
LIFECYCLE = {
    "Draft": "proposed", "Deferred": "proposed", "Accepted": "promoted", "Active": "promoted", "Final": "promoted",
    "Provisional": "promoted", "Rejected": "refused", "Withdrawn": "refused", "Superseded": "replaced",
}
JUDGED = ("Provisional", "Deferred")

RECORD_ID = re.compile(r"[DH]-[0-9]{4}")
UNKNOWN_ID = re.compile(r"U-[0-9]{1,3}")
MENTION = r"(?<![0-9A-Za-z-])([DH]-[0-9]{4}|U-[0-9]{1,3})(?![0-9A-Za-z])"
LABEL = re.compile(r"\*\*([^*\n]+)\.\*\*\s*(.*)", re.S)


class FormatError(ValueError):
    """A document that breaks its format's rules."""


def digest(text: str) -> str:
    return f"{fnv1a(text.encode()):016x}"


def mentioned(text: str, own: str = "") -> list[str]:
    """Ids that a text mentions, in order, each once, without its own."""
    return list(dict.fromkeys(m for m in re.findall(MENTION, text) if m != own))


def mentioned_ids(text: Column, own: Column) -> Column:
    return F.array_remove(F.array_distinct(F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))), own)


def split_evidence(listed: str) -> list[str]:
    """Entries of ``[a, b §1, §2]``; a part that begins with § belongs to the entry before it."""
    out: list[str] = []
    for part in (p.strip() for p in listed.strip().lstrip("[").rstrip("]").split(",")):
        if part.startswith("§") and out:
            out[-1] += f", {part}"
        elif part:
            out.append(part)
    return out


def split_forces(paragraph: str) -> list[str]:
    parts = [p.strip().rstrip(".").strip() for p in paragraph.split("; ")]
    return [p for p in parts if p] or [paragraph.strip()]


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


@dataclass
class Decision:
    id: str
    title: str
    yaml: dict[str, str]
    comments: dict[str, str]
    sections: dict[str, str]
    first_line: int
    last_line: int
    raw: str = field(repr=False, default="")

    def content(self) -> tuple[str, str | None, str]:
        """(kind, shape, text): a hypothesis, a pattern where there are forces, else a text."""
        if self.id[0] == "H":
            falsifier = self.sections.get("Falsifier")
            return "hypothesis", None, " ".join(filter(None, [self.sections["Hypothesis"], falsifier]))
        rest = [f"{k}. {v}" for k, v in self.sections.items() if k not in ("Assertion", "Forces")]
        body = "\n\n".join([self.sections.get("Assertion", ""), *rest])
        if "Forces" in self.sections:
            return "claim", "pattern", " ".join([self.title, " ".join(split_forces(self.sections["Forces"])), body])
        return "claim", "text", body


def parse_yaml(own: str, lines: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    values: dict[str, str] = {}
    comments: dict[str, str] = {}
    key = None
    for line in lines:
        if not line.strip():
            continue
        keyed = re.match(r"([a-z_]+):(.*)", line)
        text, mark, comment = (keyed[2] if keyed else line).strip().partition(" #")
        text = text.rstrip() if mark else text
        if keyed:
            key = keyed[1]
            if key not in YAML_KEYS:
                raise FormatError(f"{own}: unknown key {key}")
            if key in values:
                raise FormatError(f"{own}: key {key} twice")
            values[key] = text
        elif key is None:
            raise FormatError(f"{own}: a continuation before any key: {line}")
        else:
            values[key] += f" {text}"
        if mark:
            comments.setdefault(key, comment.strip())
    return values, comments


def parse_sections(own: str, prose: str) -> dict[str, str]:
    """Paragraphs by label: one that begins with ``**Label.**`` opens a section, others continue it."""
    sections: dict[str, str] = {}
    for paragraph in (p.strip() for p in prose.split("\n\n")):
        if paragraph in ("", "---"):
            continue
        labelled = LABEL.fullmatch(paragraph)
        body = " ".join(x.strip() for x in (labelled[2] if labelled else paragraph).split("\n")).strip()
        if labelled:
            if labelled[1] in sections:
                raise FormatError(f"{own}: section {labelled[1]} twice")
            sections[labelled[1]] = body
        elif sections:
            last = next(reversed(sections))
            sections[last] += f" {body}"
        else:
            raise FormatError(f"{own}: prose outside any section: {paragraph[:60]}")
    return sections


def parse_decisions(text: str) -> list[Decision]:
    lines = _lines(text)
    while lines and not lines[-1]:
        lines.pop()
    starts = [i for i, line in enumerate(lines) if line.startswith("## ")]
    out = []
    for start, end in zip(starts, [*starts[1:], len(lines)]):
        own, dot, title = (x.strip() for x in lines[start][3:].partition("·"))
        if not dot or not RECORD_ID.fullmatch(own):
            raise FormatError(f"line {start + 1}: no record heading: {lines[start]}")
        body = lines[start + 1 : end]
        fences = [i for i, line in enumerate(body) if line.lstrip().startswith("```")]
        if len(fences) < 2:
            raise FormatError(f"{own}: no yaml block")
        if any(line.strip() for line in body[: fences[0]]):
            raise FormatError(f"{own}: prose before the yaml block")
        values, comments = parse_yaml(own, body[fences[0] + 1 : fences[1]])
        if values.get("id", own) != own:
            raise FormatError(f"{own}: the yaml block is of {values['id']}")
        sections = parse_sections(own, "\n".join(body[fences[1] + 1 :]))
        if not sections.get("Assertion") and not sections.get("Hypothesis"):
            raise FormatError(f"{own}: nothing is asserted")
        if (own[0] == "H") != ("Hypothesis" in sections) or ("score_by" in values) != (own[0] == "H"):
            raise FormatError(f"{own}: a hypothesis by its id, its section and its score_by, or by none of them")
        out.append(Decision(own, title, values, comments, sections, start + 1, end, "\n".join(body)))
    return out


def parse_proposal(text: str) -> dict[str, object]:
    """Headers and body; continuation lines are indented; addresses are left out."""
    lines = _lines(text)
    headers: list[list[str]] = []
    at = 0
    for at, line in enumerate(lines):
        if not line.strip():
            break
        if line[0] in " \t" and headers:
            headers[-1][1] += f" {line.strip()}"
        elif ":" in line and line[0] not in " \t":
            headers.append([p.strip() for p in line.split(":", 1)])
        else:
            raise FormatError(f"a continuation before any header: {line.strip()}")
    if not headers:
        raise FormatError("no headers")
    held: dict[str, str] = {}
    for k, v in headers:
        held.setdefault(k.lower(), v)
    number = held.get("pep", "?")
    for key in ("pep", "title", "status", "type", "author"):
        if key not in held:
            raise FormatError(f"proposal {number}: no {key}")

    def numbers(key: str) -> list[int]:
        words = re.split(r"[, ]+", held.get(key, "").strip())
        if any(w and not w.isdecimal() for w in words):
            raise FormatError(f"proposal {number}: {key} is no number")
        return [int(w) for w in words if w]

    if held["status"] not in LIFECYCLE:
        raise FormatError(f"proposal {number}: unknown status {held['status']}")
    authors = [a for a in (re.sub(r"<.*", "", x).strip() for x in held["author"].split(",")) if a]
    body = "\n".join(lines[at + 1 :])
    if not numbers("pep") or not authors or not body.strip():
        raise FormatError(f"proposal {number}: number, author or body is empty")
    return {
        "number": numbers("pep")[0], "title": held["title"], "authors": authors, "status": held["status"], "type": held["type"],
        "created": held.get("created"), "replaces": numbers("replaces"), "superseded_by": next(iter(numbers("superseded-by")), None),
        "requires": numbers("requires"), "resolution": held.get("resolution"), "body": body,
        "state": LIFECYCLE[held["status"]], "judged": held["status"] in JUDGED,
    }


def _rows(text: str, start: str) -> Iterator[tuple[int, bool, list[str]]]:
    """(line, in the baseline section, cells) of table rows that begin so."""
    baseline = False
    for n, line in enumerate(_lines(text), 1):
        line = line.strip()
        if line.startswith("## "):
            baseline = "baseline" in line.lower()
        if line.startswith(f"| {start}"):
            yield n, baseline, [c.strip() for c in line.removeprefix("|").removesuffix("|").split("|")]


def parse_suite(text: str, prefix: str = "G-") -> list[dict[str, object]]:
    """Graded questions: id, question, expect (``answer ID`` or ``abstain [ID]``, maybe ``pending ID``), owner, trigger."""
    out: dict[str, dict[str, object]] = {}
    for n, baseline, cells in _rows(text, prefix):
        if baseline:
            continue
        if len(cells) != 5 or cells[0] in out:
            raise FormatError(f"line {n}: {len(cells)} cells, or {cells[0]} twice")
        told, pending, later = cells[2].partition("pending ")
        words = told.strip().rstrip("(").split()
        if not words or words[0] not in ("answer", "abstain") or words[0] == "answer" and len(words) < 2:
            raise FormatError(f"line {n}: expects neither an answer nor abstention")
        out[cells[0]] = {
            "golden_id": cells[0], "question": cells[1], "expects": words[0], "expected": words[1] if len(words) > 1 else None,
            "owner": cells[3], "review_trigger": cells[4], "pending": later.strip().rstrip(")").strip() if pending else None,
        }
    return list(out.values())


def parse_baseline(text: str, prefix: str = "G-") -> dict[str, list[str]]:
    return {c[0]: [] if c[1] == "—" else c[1].split() for _, b, c in _rows(text, prefix) if b and len(c) > 1}


def register_owner(text: str) -> str | None:
    names = (m.strip().rstrip("*. ").strip() for m in re.findall(r"Owner: (.*)", text))
    return next((n for n in names if n), None)


# ── readers ──

DECISIONS = (
    "path string, id string, title string, kind string, shape string, text string, state string, author string, recorded string, "
    "valid_from string, source string, evidence array<string>, review_trigger string, score_by string, first_line int, last_line int, digest string"
)
PROPOSALS = (
    "path string, number int, title string, authors array<string>, status string, type string, created string, replaces array<int>, "
    "superseded_by int, requires array<int>, resolution string, body string, state string, judged boolean"
)
SUITE = "path string, golden_id string, question string, expects string, expected string, owner string, review_trigger string, pending string"


def _whole(spark: SparkSession, path: str, schema: str, parse: Callable[[str, str], list[dict]]) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, text in zip(b["path"], b["value"]):
                found = [{"path": p} | r for r in parse(p, text)]
                yield pd.DataFrame(found, columns=names).astype(object).where(lambda d: d.notna(), None) if found else pd.DataFrame(columns=names)

    return files.mapInPandas(rows, schema)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    def parse(_: str, text: str) -> list[dict]:
        out = []
        for d in parse_decisions(text):
            kind, shape, body = d.content()
            told = {k: d.yaml.get(k) for k in ("state", "author", "recorded", "valid_from", "source", "review_trigger", "score_by")}
            out.append(
                told | {"id": d.id, "title": d.title, "kind": kind, "shape": shape, "text": body, "first_line": d.first_line,
                        "evidence": split_evidence(d.yaml.get("evidence", "")), "last_line": d.last_line, "digest": digest(d.raw)}
            )
        return out

    return _whole(spark, path, DECISIONS, parse)


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, PROPOSALS, lambda _, text: [parse_proposal(text)])


def read_suite(spark: SparkSession, path: str, prefix: str = "G-") -> DataFrame:
    return _whole(spark, path, SUITE, lambda _, text: parse_suite(text, prefix))


def parse_register_rows(rows: DataFrame) -> DataFrame:
    """``raw_row`` parsed: unknown_id, question, trigger_text, notes, resolved_on, resolved_by, bad.

    A row has four cells and an id like U-12; ``bad`` rows have other ones. A question with
    ``**Resolved`` is settled, on the date behind it and by the first decision named there.
    """
    trimmed = F.trim(F.col("raw_row"))
    cells = F.transform(F.split(F.regexp_replace(trimmed, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    cell = lambda i: F.get("cells", F.lit(i))
    out = rows.withColumn("cells", cells).withColumns(
        {"unknown_id": cell(0), "question": cell(1), "trigger_text": cell(2), "notes": cell(3)}
    )
    tail = F.when(F.col("question").contains("**Resolved"), F.regexp_extract("question", r"(?s)\*\*Resolved(.*)$", 1))
    day = F.regexp_extract(tail, r"^\s*([0-9-]{1,10})", 1)
    return out.withColumns(
        {
            "bad": (F.size("cells") != 4) | ~F.coalesce(F.col("unknown_id").rlike(r"^U-[0-9]{1,3}$"), F.lit(False)),
            "resolved": tail.isNotNull(),
            "resolved_on": F.when(day != "", day),
            "resolved_by": F.get(
                F.filter(F.regexp_extract_all(tail, F.lit(MENTION), F.lit(1)), lambda m: ~m.startswith("U")), F.lit(0)
            ),
        }
    ).drop("cells")


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Rows of registers by file; raises FormatError where a row is bad or an id stands twice in a file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("register_path"), F.col("value").alias("raw_row"))
    rows = parse_register_rows(lines.where(F.trim("raw_row").startswith("| U-")))
    wrong = rows.where("bad").limit(1).collect()
    twice = rows.groupBy("register_path", "unknown_id").count().where("count > 1").limit(1).collect()
    if wrong or twice:
        raise FormatError(f"bad register row: {wrong[0]['raw_row'] if wrong else twice[0]['unknown_id'] + ' twice'}")
    return rows.drop("bad")
