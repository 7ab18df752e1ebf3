"""Who committed each line of a document, and whether the commit was signed, as a table.

Git runs on the driver, once for the file's blame and once for all commits it names.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

LINES = "line int, commit string, detail string"


def _git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, check=False)
    return done.stdout if done.returncode == 0 else None


#: Characters of a commit in an attestation.
SHORT = 7
#: git's signature marks that vouch for something. A good signature by a key that this
#: machine does not trust is not the same answer as one it does; all other marks vouch for nothing.
VOUCHES = {"G": "signed", "U": "unknown-key"}


def attested(commit: str, status: str, key: str, signer: str, author: str) -> str:
    """An attestation from git's fields of a commit. The stored forms."""
    short, kind = commit[:SHORT], VOUCHES.get(status.strip())
    if kind is None:
        return f"attest:unsigned commit:{short} by:{author.strip()}"
    return f"attest:{kind} commit:{short} key:{key.strip()} signer:{signer.partition('<')[0].strip()}"


def verify(root: str, commits: list[str]) -> dict[str, str]:
    """The attestation of each commit that the repository has, by its full and its short name."""
    wanted = sorted({c for c in commits if c})
    if not wanted:
        return {}
    form = "%H%x1f%G?%x1f%GK%x1f%GS%x1f%an"
    out = _git(root, "log", "--no-walk=unsorted", "--ignore-missing", f"--format={form}", *wanted)
    rows = [r.split("\x1f") for r in (out or "").splitlines()]
    found = {r[0]: attested(*r) for r in rows if len(r) == 5}
    return found | {c[:SHORT]: told for c, told in found.items()}


def blame(spark: SparkSession, root: str, path: str) -> DataFrame:
    """``line, commit, detail`` of a file; empty where git knows nothing of it."""
    out = _git(root, "blame", "--line-porcelain", "--", path)
    lines = [h.split() for h in (out or "").splitlines() if len(h.split(" ")[0]) == 40 and h[:1] != "\t"]
    lines = [x for x in lines if len(x) in (3, 4) and all(c in "0123456789abcdef" for c in x[0])]
    told = verify(root, [x[0] for x in lines])
    missing = "attest:none because:the line is not committed"
    return spark.createDataFrame([(int(x[2]), x[0], told.get(x[0], missing)) for x in lines], LINES)
