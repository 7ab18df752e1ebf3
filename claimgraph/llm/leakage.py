"""Evaluation passages in a training corpus, found with an FM-index of each shard.

A shard of documents becomes one sequence of word numbers: words that no item has end a
run, and runs too short to hold a match are left out, which loses none. Over that sequence
stand a suffix array, its Burrows-Wheeler transform in a wavelet matrix and every 16th
suffix position. All phrases of the items are searched backwards at once; the places
found are joined to the longest spans.

Items beyond what every task can hold are not searched but joined: runs of both sides as two
hashes of 64 bits, each side after a Bloom filter of the other's has passed over it.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.session import Workspace

#: Words that a document and an item must share in a row.
RUN = 10
#: Indexed words of a shard, after which its index is built and searched.
SHARD_WORDS = 1_000_000
SAMPLED = 16
#: Bytes of item texts that go to the tasks; more are joined with the documents by hashes.
MAX_ITEM_BYTES = 40_000_000
#: Phrases searched, and places of items held, at once.
AT_ONCE = 500_000
#: Words of a task that are hashed at once.
HASHED_WORDS = 200_000
#: A Bloom filter has two to this power bits at most (128 MB); for more than half as many runs it is left out.
BLOOM = 30

WORD = re.compile(r"[^\W_]+")
#: Characters within a word that a reader does not see.
UNSEEN = dict.fromkeys(map(ord, "\xad​‌‍⁠﻿"))
UNSEEN_RE = re.compile("[\xad​‌‍⁠﻿]")
#: Elements around which a reader sees a gap; others stand within a word.
BLOCKS = "address article aside blockquote br caption dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
TAG = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>", re.S)
HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>", re.S | re.I)
LEADING = re.compile("&#0+(?=[0-9])")
HUGE = re.compile("&#[0-9]{8,};?")
LINK = re.compile(r"\]\([^()\s]*\)")
#: A hyphen at the end of a line, and what may stand before the next line's text.
BROKEN = re.compile(r"([^\W_]+)[-‐\xad][ \t]*\r?\n[ \t]*(?:[>|#*+/%;:!-]+[ \t]*)*([^\W_]+)")

FOUND = "doc string, item string, field string, first_word int, end_word int"


def visible(text: str) -> str:
    """The text as a reader sees it: markup, entities and unseen characters resolved, case folded."""
    if not text.isascii() or "<" in text or "&" in text or "](" in text:
        if "<" in text:
            text = HIDDEN.sub(" ", text)
            text = TAG.sub(lambda m: " " if m[2] and m[2].lower() in BLOCKS else "", text)
        if "&" in text:
            # Python reads no number of more than 4300 digits; one of 8 is beyond all characters.
            text = html.unescape(HUGE.sub("\ufffd", LEADING.sub("&#", text)) if "&#" in text else text)
        text = LINK.sub("] ", text)
        if not text.isascii():
            # A soft hyphen before a line end marks a broken word as a hyphen does.
            text = re.sub("\xad(?=[ \t]*\r?\n)", "-", text).translate(UNSEEN)
            text = unicodedata.normalize("NFKC", text)
    return text.casefold() if not text.isascii() else text.lower()


def has_breaks(text: str) -> bool:
    return "-\n" in text or "-\r" in text or "- " in text or "‐" in text


def seen_words(text: str, known: dict[str, int] | set[str] = frozenset()) -> list[str]:
    """The words of a text. One broken over lines is joined where ``known`` has the whole."""
    text = visible(text)
    if has_breaks(text):
        text = BROKEN.sub(lambda m: m[1] + m[2] if m[1] + m[2] in known else f"{m[1]} {m[2]}", text)
    return WORD.findall(text)


class Wavelet:
    """Ranks of any symbol in a sequence, for many positions at once."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels, n = [], len(s)
        for b in range(self.bits - 1, -1, -1):
            one = (s >> b) & 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = one
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
            self.levels.append((words, before, n - int(one.sum())))
            s = np.concatenate([s[one == 0], s[one == 1]])

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbols before ``at`` end up in the sequence sorted by all levels."""
        for k, (words, before, zeros) in enumerate(self.levels):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & mask)
            bit = (symbol >> (self.bits - 1 - k)) & 1
            at = np.where(bit == 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Over runs of symbols from 1 up; a 0 ends each run and sorts by its place."""

    def __init__(self, seq: np.ndarray, symbols: int):
        n = len(seq)
        ends = np.flatnonzero(seq == 0)
        # The zeros get different ranks, so that no two suffixes are equal.
        rank = seq.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        _, rank = np.unique(rank, return_inverse=True)
        rank, k = rank.astype(np.int64), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1 if k < n else 0
            order = np.argsort(rank * (n + 1) + after, kind="stable")
            key = (rank * (n + 1) + after)[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank, k = new, 2 * k
            if rank[order[-1]] == n - 1:
                break
        bwt = seq[order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.wavelet = Wavelet(bwt.astype(np.int64), symbols)
        all_symbols = np.arange(symbols, dtype=np.int64)
        self.base = self.wavelet.down(all_symbols, np.zeros(symbols, np.int64))
        self.bwt = bwt
        first = np.ones(n, bool)
        first[1:] = seq[:-1] == 0
        keep = (order % SAMPLED == 0) | first[order]
        self.kept = np.cumsum(keep)
        self.keep, self.places = keep, order[keep]

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.starts[symbol] + self.wavelet.down(symbol, at) - self.base[symbol]

    def search(self, words: np.ndarray, first: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur (``run`` of the words from each ``first``), with the range of their suffixes."""
        alive = np.arange(len(first))
        last = words[first + run - 1]
        lo, hi = self.starts[last], self.starts[last + 1]
        for j in range(run - 2, -1, -1):
            held = lo < hi
            alive, lo, hi = alive[held], lo[held], hi[held]
            symbol = words[first[alive] + j]
            lo, hi = self._step(symbol, lo), self._step(symbol, hi)
        held = lo < hi
        return alive[held], lo[held], hi[held]

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places of suffixes, by walking back to a sampled one."""
        steps = np.zeros(len(at), np.int64)
        going = np.flatnonzero(~self.keep[at])
        at = at.copy()
        while len(going):
            at[going] = self._step(self.bwt[at[going]].astype(np.int64), at[going])
            steps[going] += 1
            going = going[~self.keep[at[going]]]
        return self.places[self.kept[at] - 1] + steps


def _table(pairs: np.ndarray, keys: int) -> np.ndarray:
    """Where the rows of each key begin among ``pairs``, the sorted keys of the rows."""
    return np.concatenate([[0], np.cumsum(np.bincount(pairs, minlength=keys))]).astype(np.int64)


def _spread(which: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``which`` its rows in a table: places in ``which``, and rows."""
    count = begins[which + 1] - begins[which]
    row = np.arange(count.sum()) + np.repeat(begins[which] - np.cumsum(count) + count, count)
    return np.repeat(np.arange(len(which)), count), row


class Phrases:
    """All runs of ``run`` words of the items: each once, by where it begins in ``words``, with the texts that have it."""

    def __init__(self, fields: list[tuple[str, str, str]], run: int):
        # A word broken over lines in an item is taken in two; so must be the same break in a document.
        self.known: dict[str, int] = {}
        texts: dict[str, int] = {}
        words, owner = [], np.empty(len(fields), np.int64)
        for k, (_, _, t) in enumerate(fields):
            if t not in texts:
                words.append(np.array([self.known.setdefault(w, len(self.known) + 1) for w in seen_words(t)], np.int32))
            owner[k] = texts.setdefault(t, len(texts))
        order = np.argsort(owner, kind="stable")
        self.items, self.names = (np.array([f[j] for f in fields], object)[order] for j in (0, 1))
        self.fields = _table(owner, len(texts))
        size = np.array([len(x) for x in words], np.int64)
        self.words = np.concatenate([*words, np.zeros(0, np.int32)])
        text = np.repeat(np.arange(len(words), dtype=np.int32), size)
        del texts, words
        fits = np.flatnonzero(np.arange(len(text)) + run <= np.repeat(np.cumsum(size), size))
        # Equal numbers for equal runs of k words, until k is run.
        number, k = self.words.astype(np.int64), 1
        while k < run and len(number) > k:
            more = min(k, run - k)
            number = np.unique(number[:-more] * (number.max() + 1) + number[more:], return_inverse=True)[1]
            k += more
        _, begin, number = np.unique(number[fits], return_index=True, return_inverse=True)
        self.first = fits[begin]
        pairs = np.unique(number * max(1, len(size)) + text[fits])
        self.owned = _table(pairs // max(1, len(size)), len(self.first))
        self.owners = (pairs % max(1, len(size))).astype(np.int32)


def _found(docs: np.ndarray, doc: np.ndarray, place: np.ndarray, which: np.ndarray, phrases: Phrases, run: int) -> Iterator[pd.DataFrame]:
    """The spans of whole documents, from the places of phrases in them."""
    total = int((phrases.owned[which + 1] - phrases.owned[which]).sum())
    parts = -(-total // AT_ONCE)
    for part in range(parts):
        owners, owned = phrases.owners, phrases.owned
        if parts > 1:
            mine = owners % parts == part
            owners, owned = owners[mine], np.concatenate([[0], np.cumsum(mine)])[owned]
        hit, row = _spread(which, owned)
        d, w, text = doc[hit], place[hit], owners[row]
        order = np.lexsort((w, text, d))
        d, w, text = d[order], w[order], text[order]
        fresh = np.ones(len(d), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (text[1:] != text[:-1]) | (w[1:] > w[:-1] + run)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(d)) - 1 if len(d) else first
        d, begin, end, text = d[first], w[first], w[last] + run, text[first]
        many = np.cumsum(phrases.fields[text + 1] - phrases.fields[text])
        a = 0
        while a < len(d):
            # So many spans as have AT_ONCE fields, one at least.
            b = max(a + 1, int(np.searchsorted(many, (many[a - 1] if a else 0) + AT_ONCE, "right")))
            span, field = _spread(text[a:b], phrases.fields)
            for c in range(0, len(span), AT_ONCE):
                s, f = span[c : c + AT_ONCE] + a, field[c : c + AT_ONCE]
                columns = docs[d[s]], phrases.items[f], phrases.names[f], begin[s].astype("int32"), end[s].astype("int32")
                yield pd.DataFrame(dict(zip([x.split()[0] for x in FOUND.split(", ")], columns)))
            a = b


def _search(docs: list, numbers: list[np.ndarray], places: list[np.ndarray], phrases: Phrases, run: int) -> Iterator[pd.DataFrame]:
    """The spans of one shard. ``numbers``: the word numbers of each document's runs of known words, a 0 after each run."""
    doc = np.repeat(np.arange(len(docs)), [len(x) for x in numbers])
    place, seq = np.concatenate(places), np.concatenate(numbers)
    index = FMIndex(seq, len(phrases.known) + 1)
    which, spot = [], []
    for a in range(0, len(phrases.first), AT_ONCE):
        found, lo, hi = index.search(phrases.words, phrases.first[a : a + AT_ONCE], run)
        count = hi - lo
        which.append(np.repeat(found + a, count))
        spot.append(index.locate(np.arange(count.sum()) + np.repeat(lo - np.cumsum(count) + count, count)))
    which, spot = np.concatenate(which), np.concatenate(spot)
    del index
    # At most one phrase begins at a place.
    order = np.argsort(spot)
    which, spot = which[order], spot[order]
    doc, place, docs = doc[spot], place[spot].astype(np.int64), np.array(docs, object)
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    many = np.cumsum(phrases.owned[which + 1] - phrases.owned[which])
    a = 0
    while a < len(doc):
        # So many whole documents as have AT_ONCE places of texts, one at least.
        b = np.searchsorted(many, (many[a - 1] if a else 0) + AT_ONCE, "right")
        after = np.searchsorted(ends, a, "right")
        b = int(ends[max(after, np.searchsorted(ends, b, "right") - 1)])
        yield from _found(docs, doc[a:b], place[a:b], which[a:b], phrases, run)
        a = b


def leaked_spans(
    documents: DataFrame, key: Column, text: Column, items: DataFrame, run: int = RUN, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``doc, item, field, first_word, end_word``: the spans of each document made of runs of
    ``run`` words or more that stand within one field of an item; runs of one field that overlap
    or touch are merged into one span.

    ``items``: item, field, text. Words are runs of letters or digits as a reader sees them:
    case, encoding forms, markup, entities, unseen characters, spacing and broken lines make
    no difference. Spans count the document's words from 0; the end is exclusive.

    Null keys and texts are left out on either side, and so are fields of fewer words.
    Repeated rows give repeated spans. Other columns are ignored. Without items or
    documents the result is empty. Items of more than ``MAX_ITEM_BYTES`` are joined, not searched.
    """
    fields = items.select(F.col("item").cast("string"), F.col("field").cast("string"), "text").where(
        F.col("item").isNotNull() & F.col("text").isNotNull()
    )
    pairs = documents.select(key.cast("string").alias("key"), text.alias("text")).where(
        F.col("key").isNotNull() & F.col("text").isNotNull()
    )
    size = fields.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _joined(pairs, fields, run, size) if size > MAX_ITEM_BYTES else _searched(pairs, fields, run, shard_words)


def _searched(pairs: DataFrame, fields: DataFrame, run: int, shard_words: int) -> DataFrame:
    rows = sorted({(r[0], r[1], r[2]) for r in fields.collect()}, key=str)
    # Taken apart once; each worker keeps one copy.
    shared = pairs.sparkSession.sparkContext.broadcast(Phrases(rows, run))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = shared.value
        if not len(phrases.first):
            return
        known, docs, numbers, places, held = phrases.known, [], [], [], 0
        for batch in batches:
            for k, t in zip(batch["key"], batch["text"]):
                ids = np.array([*(known.get(w, 0) for w in seen_words(t, known)), 0], np.int32)
                # Runs of known words; the shorter ones cannot hold a match, and nothing else is kept.
                stop = np.flatnonzero(ids == 0)
                size = np.diff(np.concatenate([[-1], stop])) - 1
                keep = np.flatnonzero(np.repeat(size >= run, size + 1))
                if len(keep):
                    docs.append(k)
                    numbers.append(ids[keep])
                    places.append(keep.astype(np.int32))
                    held += len(keep)
                if held >= shard_words:
                    yield from _search(docs, numbers, places, phrases, run)
                    docs, numbers, places, held = [], [], [], 0
        if docs:
            yield from _search(docs, numbers, places, phrases, run)

    return pairs.mapInPandas(find, FOUND)


def _hashed(rows: Iterable[tuple], known: set[str], run: int) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    """Names of texts, and each run of words by two hashes, with the number of its text's name and its place."""
    factors = np.random.default_rng(0).integers(1 << 63, size=(2, run), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def runs() -> tuple[np.ndarray, pd.DataFrame]:
        word = pd.util.hash_array(np.array(words, object))
        n = len(word) - run + 1
        h = [sum(word[j : j + n] * by[j] for j in range(run)).view(np.int64) for by in factors]
        size = np.array(sizes)
        name = np.repeat(np.arange(len(names)), size)[:n]
        place = np.arange(n) - (np.cumsum(size) - size)[name]
        fits = place + run <= size[name]
        columns = {"h1": h[0], "h2": h[1], "name": name, "place": place.astype(np.int32)}
        return np.array(names), pd.DataFrame({c: x[fits] for c, x in columns.items()})

    names, words, sizes = [], [], []
    for name, text in rows:
        found = seen_words(text, known)
        if len(found) >= run:
            names.append(name)
            words += found
            sizes.append(len(found))
        if len(words) >= HASHED_WORDS:
            yield runs()
            names, words, sizes = [], [], []
    if words:
        yield runs()


class Bloom:
    """A filter that all runs of a table pass and few others do; for too many runs it lets all pass."""

    def __init__(self, table: DataFrame, runs: Callable[[pd.DataFrame], Iterable[pd.DataFrame]], count: int):
        # Four bits and more a run, while they can be had.
        power = self.power = min(BLOOM, max(16, (4 * count).bit_length()))
        self.bits = None
        if count > 1 << BLOOM - 1:
            return
        nothing = np.zeros((1 << power) // 8, np.uint8)
        piece = len(nothing) // 64

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bits = np.zeros((1 << power) // 8, np.uint8)
            for batch in batches:
                for part in runs(batch):
                    for at in _bits(part, power):
                        np.bitwise_or.at(bits, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
            for a in range(0, len(bits), piece):
                if bits[a : a + piece].any():
                    yield pd.DataFrame({"a": [a], "bits": [zlib.compress(bits[a : a + piece].tobytes(), 1)]})

        def unite(rows: pd.DataFrame) -> pd.DataFrame:
            whole = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in rows["bits"]])
            return pd.DataFrame({"a": rows["a"][:1], "bits": [zlib.compress(whole.tobytes(), 1)]})

        for r in table.mapInPandas(fill, "a long, bits binary").groupBy("a").applyInPandas(unite, "a long, bits binary").toLocalIterator():
            nothing[r["a"] : r["a"] + piece] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        self.bits = nothing

    def passed(self, runs: pd.DataFrame) -> pd.DataFrame:
        if self.bits is None:
            return runs
        held = [(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 for at in _bits(runs, self.power)]
        return runs[(held[0] & held[1]).astype(bool)]


def _bits(runs: pd.DataFrame, power: int) -> list[np.ndarray]:
    return [runs[h].to_numpy().view(np.uint64) >> np.uint64(64 - power) for h in ("h1", "h2")]


def _whole_words(pairs: DataFrame, texts: DataFrame) -> set[str]:
    """Words broken over lines in a document that an item has whole."""

    def words(batches: Iterator[pd.DataFrame], of) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        found: set[str] = set()
        for batch in batches:
            for t in batch["text"]:
                found.update(of(t))
                if len(found) >= HASHED_WORDS:
                    yield pd.DataFrame({"word": list(found)})
                    found = set()
        yield pd.DataFrame({"word": pd.Series(list(found), dtype=object)})

    def joined(text: str) -> list[str]:
        text = visible(text)
        return [m[1] + m[2] for m in BROKEN.finditer(text)] if has_breaks(text) else []

    broken = pairs.select("text").mapInPandas(lambda b: words(b, joined), "word string")
    whole = texts.select("text").mapInPandas(lambda b: words(b, seen_words), "word string")
    return {r[0] for r in broken.distinct().join(whole, "word", "left_semi").toLocalIterator()}


def _joined(pairs: DataFrame, fields: DataFrame, run: int, size: int) -> DataFrame:
    """As ``_searched``, for items of any number: equal runs of words meet in a join."""
    context = pairs.sparkSession.sparkContext
    fields = fields.withColumn("tid", F.xxhash64("text"))
    whole = context.broadcast(_whole_words(pairs, fields))

    def item_runs(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for tids, runs in _hashed(zip(batch["tid"], batch["text"]), frozenset(), run):
            yield runs.assign(tid=tids[runs["name"]])

    # A word begins one run at most and takes six bytes on average.
    of_items = context.broadcast(Bloom(fields, item_runs, size // 6))

    def document_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["key"].to_numpy(object)
            for rows, runs in _hashed(enumerate(batch["text"]), whole.value, run):
                runs = of_items.value.passed(runs)
                row = rows[runs.pop("name")]
                yield runs.assign(id=batch["id"].to_numpy()[row], key=keys[row])[["h1", "h2", "id", "key", "place"]]

    # Rows are told apart by a number, as keys may repeat.
    numbered = pairs.withColumn("id", F.monotonically_increasing_id())
    places = numbered.mapInPandas(document_runs, "h1 long, h2 long, id long, key string, place int")
    places = Workspace(pairs.sparkSession, "leakage").table(places, "places")
    of_documents = context.broadcast(Bloom(places.select("h1", "h2"), lambda batch: [batch], places.count()))

    def item_side(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for runs in item_runs(batch):
                yield of_documents.value.passed(runs)[["h1", "h2", "tid"]]

    texts = fields.mapInPandas(item_side, "h1 long, h2 long, tid long").distinct()
    hits = places.join(texts, ["h1", "h2"]).select("id", "key", "tid", "place")
    w = Window.partitionBy("id", "tid").orderBy("place")
    fresh = F.coalesce(F.col("place") > F.lag("place").over(w) + run, F.lit(True)).cast("int")
    spans = (
        hits.withColumn("fresh", fresh)
        .withColumn("span", F.sum("fresh").over(w))
        .groupBy("id", "key", "tid", "span")
        .agg(F.min("place").alias("first_word"), (F.max("place") + run).cast("int").alias("end_word"))
    )
    owners = fields.select("tid", "item", "field").distinct()
    return spans.join(owners, "tid").select(F.col("key").alias("doc"), "item", "field", "first_word", "end_word")
