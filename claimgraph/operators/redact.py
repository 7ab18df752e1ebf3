"""Applying declared redactions to a log: fields go, structure and receipts stay.

Each declaration is joined to its target's line and the line is written anew without what its
scope covers, with a mark that names the declaration and a fingerprint of the old line. A line
that carries the mark of its latest declaration is left alone, so applying again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.operators.vectors import fnv1a

#: Fixed value: what stands where something was taken out.
REDACTED = "[redacted]"


def redact_line(line: str, orders: list[tuple[str, str]]) -> str:
    """``orders``: (declaration id, scope) in log order; scopes are Author, Content, Source, Record."""
    e = json.loads(line)
    if (e.get("redacted") or {}).get("by") == orders[-1][0]:
        return line
    scopes = {s for _, s in orders}
    if e["event"] == "entity":
        e["label"] = REDACTED
    else:
        if scopes & {"Author", "Record"}:
            e["author"]["name"] = REDACTED
            e["author"].pop("detail", None)
        if scopes & {"Source", "Record"}:
            e["source"].pop("reference", None)
        if scopes & {"Content", "Record"}:
            for x in e.get("evidence", []):
                x.pop("span", None)
            (kind, c), = e["content"].items()
            if kind == "Claim":
                (shape, c), = c.items()
                empty = {
                    "Attribute": {"value": {"Text": REDACTED}}, "Relation": {"properties": {}}, "Text": {"body": REDACTED},
                    "Pattern": {"context": REDACTED, "forces": [], "solution": REDACTED},
                }[shape]
            else:
                empty = {
                    "Gap": {"question": REDACTED}, "Hypothesis": {"statement": REDACTED, "falsifier": None},
                    "Verdict": {"rationale": None}, "Redaction": {"reason": REDACTED},
                }[kind]
            for k, v in empty.items():
                c.pop(k, None) if v is None else c.update({k: v})
    e["redacted"] = {"by": orders[-1][0], "fingerprint": f"{fnv1a(line.encode()):016x}"}
    return json.dumps(e, ensure_ascii=False, separators=(",", ":"))


def apply_redactions(events: DataFrame) -> DataFrame:
    """``seq, line, rewritten``: the whole log after its own declarations.

    ``events``: as ``journal.parse_events`` gives them. Write the result to another folder, read it
    back through validation, and only then put it in the place of the log.
    """
    d = events.where(F.col("content.Redaction").isNotNull())
    t = F.from_json("content.Redaction.target", "struct<Record:string,Entity:string>")
    orders = d.select(
        F.coalesce(t["Record"], t["Entity"]).alias("id"), F.struct("seq", F.col("id").alias("by"), F.col("content.Redaction.scope").alias("scope")).alias("o")
    )
    orders = orders.groupBy("id").agg(F.array_sort(F.collect_list("o")).alias("orders"))
    rows = events.select("seq", "line", "id").join(orders, "id", "left").select("seq", "line", "orders")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = [
                line if o is None else redact_line(line, [(x["by"], x["scope"]) for x in o]) for line, o in zip(b["line"], b["orders"])
            ]
            yield pd.DataFrame({"seq": b["seq"], "line": new, "rewritten": [x != y for x, y in zip(new, b["line"])]})

    untouched = rows.where(F.col("orders").isNull()).select("seq", "line", F.lit(False).alias("rewritten"))
    touched = rows.where(F.col("orders").isNotNull()).mapInPandas(rewrite, "seq long, line string, rewritten boolean")
    return untouched.unionByName(touched)


def report(redacted: DataFrame) -> DataFrame:
    return redacted.groupBy("rewritten").agg(F.count("*").alias("n"))
