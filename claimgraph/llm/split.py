"""Splitting oversized texts at natural boundaries.

Lexical cohesion: for each place where the text pauses, the words of a block before it
are compared with those of a block after it. Low similarity between two higher ones is
a valley, a change of topic; within the room of each piece the deepest valley is cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
TOKEN = re.compile(f"[^{WHITE}]+")
LINE = re.compile("[\n\x0b\x0c\r\x85  ]")
ENDS = re.compile(r"[.!?…。！？][\"'”’»)\]*_`]*$")
PAUSES = re.compile(r"[,;:–—][\"'”’»)\]*_`]*$")
#: Words on either side of a boundary that are compared.
BLOCK = 24
#: Part of a window in whose end the deepest valley is looked for; the rest keeps pieces from being short.
SEARCHED = 0.5
#: Plans that go to the tasks at once; more take another pass over the texts.
MAX_PLANS = 10_000

PIECES = "plan_id int, key string, piece int, pieces int, first_token int, end_token int, first_char int, end_char int"


def _similarity(a: list[str], b: list[str]) -> float:
    x, y = Counter(a), Counter(b)
    dot = sum(n * y[w] for w, n in x.items() if w in y)
    return dot / sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values())) if dot else 0.0


def depths(words: list[str], gaps: list[int], block: int = BLOCK) -> list[float]:
    """For each gap (before the word of that number) the depth of its valley."""
    s = [_similarity(words[max(0, g - block) : g], words[g : g + block]) for g in gaps]
    left, right = s[:], s[:]
    for i in range(1, len(s)):  # the peak that is reached by climbing outwards
        left[i] = left[i - 1] if s[i - 1] >= s[i] else s[i]
    for i in range(len(s) - 2, -1, -1):
        right[i] = right[i + 1] if s[i + 1] >= s[i] else s[i]
    return [lo + hi - 2 * x for lo, hi, x in zip(left, right, s)]


class Text:
    """A text's tokens, pauses and valleys, worked out once for all plans."""

    def __init__(self, text: str):
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        self.text, self.known = text, {}
        self.words = [text[a:b].strip(".,;:!?…\"'()[]*_`").lower() for a, b in self.spans]

    def gaps(self, kind: int) -> tuple[list[int], list[float]]:
        """Gaps in order and their depths: 0 ends of sentences and lines, 1 other pauses, 2 every gap."""
        if kind not in self.known:
            t, s = self.text, self.spans
            at = range(1, len(s))
            if kind == 0:
                at = [
                    i for i in at if LINE.search(t, s[i - 1][1], s[i][0]) or ENDS.search(t[s[i - 1][0] : s[i - 1][1]])
                ]
            elif kind == 1:
                at = [i for i in at if PAUSES.search(t[s[i - 1][0] : s[i - 1][1]])]
            self.known[kind] = list(at), depths(self.words, list(at))
        return self.known[kind]


def cuts(text: Text, limit: int, overlap: int, searched: float = SEARCHED) -> list[tuple[int, int]]:
    """Token ranges of the pieces; each but the first begins ``overlap`` tokens before the last one's end."""
    n, start, pieces = len(text.spans), 0, []
    while n - start > limit:
        # More than the overlap in any case, so that every piece brings something new.
        least, most = start + max(overlap + 1, overlap + int((limit - overlap) * (1 - searched) + 0.5)), start + limit
        end = most
        for kind in (0, 1, 2):
            gaps, depth = text.gaps(kind)
            a, b = bisect_left(gaps, least), bisect_right(gaps, most)
            if a < b:
                end = max(zip(depth[a:b], gaps[a:b]))[1]
                break
        pieces.append((start, end))
        start = end - overlap
    return [*pieces, (start, n)] if n else []


def split(
    items: DataFrame, key: Column, text: Column, plans: DataFrame, oversized_only: bool = False, searched: float = SEARCHED
) -> DataFrame:
    """The pieces of each text under each plan: ``plan_id, key, piece, pieces, first_token,
    end_token, first_char, end_char`` (ends are exclusive; characters are code points).

    ``plans``: plan_id, window_tokens, overlap_tokens. A plan whose limit is null gives one
    piece. A null overlap counts as 0; a limit below 1 or an overlap that is negative or not
    below the limit raises ValueError. Null texts and texts without tokens give no piece;
    texts within the limit give one, unless ``oversized_only``. A token is never cut, however
    long. Repeated rows give repeated pieces; a null key stays null. Other columns of
    ``items`` are ignored. The deepest valley is taken from the last ``searched`` of each window.
    More than ``MAX_PLANS`` plans are worked off in groups.
    """
    plans = plans.select("plan_id", "window_tokens", "overlap_tokens").distinct()
    size = plans.count()
    if size > MAX_PLANS:
        groups = -(-2 * size // MAX_PLANS)
        group = F.pmod(F.xxhash64("plan_id", "window_tokens", "overlap_tokens"), F.lit(groups))
        parts = [split(items, key, text, plans.where(group == g), oversized_only, searched) for g in range(groups)]
        return reduce(DataFrame.unionByName, parts)
    known = plans.collect()
    listed = [(r[0], r[1], r[2] or 0) for r in known if not (oversized_only and r[1] is None)]
    for plan, limit, overlap in listed:
        if limit is not None and not 0 <= overlap < max(limit, 1) or limit is not None and limit < 1:
            raise ValueError(f"plan {plan}: overlap {overlap} does not fit limit {limit}")
    rows = items.select(key.cast("string").alias("key"), text.alias("text")).where(F.col("text").isNotNull())
    if oversized_only:
        # More than n tokens take at least 2n + 1 characters: what is shorter need not leave the JVM.
        least = min((limit for _, limit, _ in listed), default=0)
        rows = rows.where(F.char_length("text") >= 2 * least + 1)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            out = []
            for k, t in zip(batch["key"], batch["text"]):
                whole = Text(t)
                n = len(whole.spans)
                for plan, limit, overlap in listed:
                    if not n or oversized_only and n <= limit:
                        continue
                    found = cuts(whole, limit or n, overlap, searched)
                    for i, (a, b) in enumerate(found):
                        out.append((plan, k, i, len(found), a, b, whole.spans[a][0], whole.spans[b - 1][1]))
            yield pd.DataFrame(out, columns=names).astype({"key": object})

    return rows.mapInPandas(pieces, PIECES)
