"""Ids: a ULID, shown as ``rec_…`` or ``ent_…``, is one id however it is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blanks that are stripped from ids and labels.
BLANKS = " \t\r\n\f\v "


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def norm_id(c: Column, prefix: str = "rec") -> Column:
    """``prefix_ULID`` in upper case; null for null and blank."""
    bare = F.regexp_replace(F.upper(strip(c)), f"^{prefix.upper()}_", "")
    return F.when(bare != "", F.concat(F.lit(f"{prefix}_"), bare))


def norm_label(c: Column) -> Column:
    """Lower case without outer blanks; null for null and blank."""
    t = F.lower(strip(c))
    return F.when(t != "", t)
