"""Fused rankings of whole logs without a table of pairs.

Nearly every question shares a word or a feature with nearly every record, so lists of pairs grow
with questions times records. Here a task takes some questions, reads what is ranked (postings of
their words, vectors, a few columns a record) from the shared folder in pieces, and works out all
scores and both rankings of one question at a time as arrays. Only the first items, the numbers and
what they were counted from leave the task. Results are those of ``retrieve.retrieve``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import fold, raw_tokens
from claimgraph.operators.lexical import B, FINE, K1, TIE, read_questions
from claimgraph.operators.retrieve import Answers, Options, Parts, conclude
from claimgraph.operators.vectors import hash_counts
from claimgraph.session import Workspace

#: Bytes of cosines that a task holds, of questions it takes at once at least, and at most.
AT_ONCE, LEAST, MOST = 32_000_000, 8, 256
#: Words that are packed at a time, at least.
PACKED = 500_000
#: Bytes of postings that a task remembers.
KEPT = 64_000_000
#: Rows of vectors that are read at a time.
ROWS = 8_192
#: Items that are put in order first; more as long as too few are left after folding.
FIRST = 64
#: Whole numbers below this are exact as float32.
EXACT = 1 << 24

#: What a task returns: ``what`` is item, gap, lexical (the full-text ranking), dark (the best of the shadow) or total.
FOUND = "what string, n int, record_id string, score double, relevance double, coverage double, similarity double, via string, count long"


@dataclass
class Log:
    """What is ranked, as tables of the shared folder; for ``read_questions`` it is an index."""

    path: str
    #: All records, of which record_id and text are read; how many of them the view admits.
    records: DataFrame
    admitted: int
    dims: int

    def _table(self, name: str) -> DataFrame:
        return self.records.sparkSession.read.parquet(f"{self.path}/{name}")

    def stats(self) -> DataFrame:
        return self._table("docs").where("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))

    def frequencies(self) -> DataFrame:
        return self._table("postings").groupBy("term").agg(F.sum((F.octet_length("seqs") / 4).cast("long")).alias("df"))


def write(records: DataFrame, view: DataFrame, dims: int) -> Log:
    """``records``: record_id, seq, kind, shape, attr_name, subject, refs, text; ``view``: what is admitted of
    them, record_id, seq and text. A record is one passage."""
    ws = Workspace(records.sparkSession, "ranking")
    numbered, told = records, view
    n = records.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("m")).first()
    if n["n"] != n["m"]:
        # Tasks know a record by its place in the log.
        at = records.select("record_id", F.row_number().over(Window.orderBy("seq", "record_id")).cast("long").alias("seq"))
        at = ws.table(at, "places")
        numbered, told = records.drop("seq").join(at, "record_id"), view.drop("seq").join(at, "record_id")
    numbered = numbered.withColumn("seq", F.col("seq").cast("long"))
    title = F.when((F.col("shape") == "attribute") & (F.col("attr_name") == "title"), F.col("subject"))
    length = F.greatest(F.coalesce(F.size(raw_tokens(F.col("text"))), F.lit(0)), F.lit(0))
    docs = numbered.select("seq", "record_id", F.coalesce(F.col("kind") == "gap", F.lit(False)).alias("gap"), length.alias("length"), title.alias("title"))
    shown = view.select("record_id").distinct().withColumn("admitted", F.lit(True))
    ws.table(docs.join(shown, "record_id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False))), "docs")
    bodies = numbered.where((F.col("kind") == "claim") & title.isNull())
    ws.table(bodies.select("seq", F.explode("refs").alias("ref")).where(F.col("ref").isNotNull()), "refs")
    told = told.where(F.col("text").isNotNull())
    ws.table(told.select(F.col("seq").cast("long").alias("seq"), hash_counts(F.col("text"), dims).alias("vector")), "vectors")
    # Tasks count and pack the words of the records they read; nothing is shuffled.
    words = numbered.select("seq", F.explode(raw_tokens(F.col("text"))).alias("word")).select("seq", fold(F.lower("word")).alias("term"))
    ws.table(words.mapInArrow(_pack, "term string, high long, seqs binary, tfs binary"), "postings")
    return Log(ws.path, records, shown.count(), dims)


def _pack(batches: Iterator) -> Iterator:
    """Words (seq, term; those of a record behind each other) as rows of a word, the numbers of its records
    and how often each has it; numbers without their bits above the 31st, which are ``high``."""
    import pyarrow as pa

    def packed(t: pa.Table) -> pa.RecordBatch:
        term = t["term"].combine_chunks().dictionary_encode()
        code, seq = term.indices.to_numpy(), t["seq"].to_numpy()
        order = np.lexsort((seq, code))
        code, seq = code[order], seq[order]
        new = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(seq, prepend=seq[0] - 1))
        tf = np.diff(np.append(new, len(code))).astype(np.int32)
        code, seq = code[new], seq[new]
        high = seq >> 31
        starts = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(high, prepend=high[0] - 1))
        ends = pa.py_buffer((np.append(starts, len(code)) * 4).astype(np.int32))
        binary = lambda x: pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(x)])
        low = (seq & (2**31 - 1)).astype(np.int32)
        columns = [term.dictionary.take(pa.array(code[starts])), pa.array(high[starts]), binary(low), binary(tf)]
        return pa.RecordBatch.from_arrays(columns, names=["term", "high", "seqs", "tfs"])

    held, count, least = [], 0, PACKED
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count >= least:
            t = pa.Table.from_batches(held)
            seq = t["seq"].to_numpy()
            whole = len(seq) - int(np.argmax(seq[::-1] != seq[-1])) if seq[0] != seq[-1] else 0
            if whole:
                yield packed(t.slice(0, whole))
            held, count = t.slice(whole).to_batches(), len(seq) - whole
            least = max(PACKED, 2 * count)
    if held and count:
        yield packed(pa.Table.from_batches(held))


def _order(ties: np.ndarray) -> np.ndarray:
    """Positions by value, the greatest first; equal ones in their order."""
    n = len(ties)
    if n and ties.min() >= 0 and ties.max() * n < 2.0**61:
        bits = n.bit_length()
        c = (ties.astype(np.int64) << bits) + np.arange(n - 1, -1, -1)
        c.sort()
        return n - 1 - (c[::-1] & ((1 << bits) - 1))
    return np.argsort(-ties, kind="stable")


def _tie(x: np.ndarray) -> np.ndarray:
    return np.floor(x * TIE + 0.5)


class Reader:
    """A task's side of a log: its columns as arrays in log order, its postings and vectors piece by piece."""

    held: dict[str, Reader] = {}

    @classmethod
    def of(cls, path: str, dims: int) -> Reader:
        """A worker keeps one log."""
        if path not in cls.held:
            cls.held.clear()
            cls.held[path] = cls(path, dims)
        return cls.held[path]

    def __init__(self, path: str, dims: int):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(path)
        self.dims, self.pa, self.pc = dims, pa, pc
        docs = self._dataset("docs", seq=pa.int64(), record_id=pa.string(), admitted=pa.bool_(), gap=pa.bool_(), length=pa.int32(), title=pa.string()).to_table()
        docs = docs.sort_by("seq").combine_chunks()
        flat = lambda c: docs[c].to_numpy()
        self.seq, self.length = flat("seq"), flat("length").astype(float)
        self.admitted, self.gap, self.n = flat("admitted"), flat("gap"), docs.num_rows
        self.ids = docs["record_id"]
        self.id_rank = np.empty(self.n, np.int32)
        self.id_rank[pc.sort_indices(self.ids).to_numpy()] = np.arange(self.n)
        refs = self._dataset("refs", seq=pa.int64(), ref=pa.string()).to_table()
        both = pa.chunked_array([*docs["title"].chunks, *refs["ref"].chunks], pa.string()).combine_chunks().dictionary_encode()
        if isinstance(both, pa.ChunkedArray):
            both = both.combine_chunks()
        codes = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False)
        self.entities = len(both.dictionary)
        self.title = codes[: self.n]
        doc = np.searchsorted(self.seq, refs["seq"].to_numpy())
        order = np.argsort(doc, kind="stable")
        #: Of what is no title: its entities, by record; and the records of each entity.
        self.ref_doc, self.ref_code = doc[order], codes[self.n :][order]
        self.by_code = np.argsort(self.ref_code, kind="stable").astype(np.int32)
        self.code_starts = np.searchsorted(self.ref_code[self.by_code], np.arange(self.entities + 1))
        self.terms: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.bytes, self.avgdl, self.norm = 0, None, self.length
        self.arrays: dict[str, np.ndarray] = {}
        del docs, refs, both
        pa.default_memory_pool().release_unused()

    def _dataset(self, name: str, **columns: object):
        from pyarrow import dataset

        return dataset.dataset(f"{self.path}/{name}", self.pa.schema(list(columns.items())), format="parquet", filesystem=self.files)

    def scratch(self, name: str, kind: type) -> np.ndarray:
        """Noughts, one for each record; the same array for each question, as fresh memory costs more than sums in it."""
        if name not in self.arrays:
            self.arrays[name] = np.zeros(self.n, kind)
        self.arrays[name].fill(0)
        return self.arrays[name]

    def norms(self, avgdl: float) -> np.ndarray:
        if self.avgdl != avgdl:
            self.avgdl, self.norm = avgdl, K1 * (1.0 - B + B * self.length / avgdl)
        return self.norm

    @staticmethod
    def _batches(rows: object, size: int, **more: object) -> Iterator:
        # No more is read ahead than is looked at: executors have little memory beside the heap.
        return rows.to_batches(batch_size=size, batch_readahead=1, fragment_readahead=1, use_threads=False, **more)

    def refs_of(self, doc: int) -> np.ndarray:
        a, e = np.searchsorted(self.ref_doc, [doc, doc + 1])
        return self.ref_code[a:e]

    def about(self, code: int) -> np.ndarray:
        return self.ref_doc[self.by_code[self.code_starts[code] : self.code_starts[code + 1]]]

    def postings(self, wanted: dict[str, float], avgdl: float) -> None:
        """Makes ``terms`` hold the records of all wanted words (by word, its idf) and what it adds to their scores."""
        new = wanted.keys() - self.terms.keys()
        if not new:
            return
        if self.bytes > KEPT:
            self.terms, self.bytes, new = {}, 0, wanted.keys()
        pa = self.pa
        rows = self._dataset("postings", term=pa.string(), high=pa.int64(), seqs=pa.binary(), tfs=pa.binary())
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {t: [] for t in new}
        for b in self._batches(rows, 1024, filter=self.pc.field("term").isin(sorted(new))):
            for t, high, s, f in zip(b["term"].to_pylist(), b["high"].to_pylist(), b["seqs"], b["tfs"]):
                seq = np.frombuffer(s.as_py(), np.int32) + np.int64(high << 31)
                parts[t].append((np.searchsorted(self.seq, seq).astype(np.int32), np.frombuffer(f.as_py(), np.int32)))
        for t, p in parts.items():
            docs, tf = (np.concatenate(x) for x in zip(*p)) if p else (np.zeros(0, np.int32), np.zeros(0, np.int32))
            # The operations are those of ``search``, one by one, so that scores have the same bits.
            part = wanted[t] * (tf * (K1 + 1.0)) / (tf + self.norms(avgdl)[docs])
            self.terms[t] = docs, (part * FINE + 0.5).astype(np.int64)
            self.bytes += sum(x.nbytes for x in self.terms[t])

    def dots(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all vectors: their record, length, and products with the rows of ``q``; counts, so whole numbers."""
        rows = self._dataset("vectors", seq=self.pa.int64(), vector=self.pa.binary())
        count = rows.count_rows()
        at, size, out, a = np.empty(count, np.int64), np.empty(count), np.empty((len(q), count), np.float32), 0
        for b in self._batches(rows, ROWS):
            if not b.num_rows:
                continue
            v = b["vector"]
            x = np.frombuffer(v.buffers()[2], np.int32)[v.offset * self.dims :][: len(v) * self.dims].reshape(-1, self.dims)
            exact = np.abs(x).max(initial=0) * float(np.abs(q).sum(axis=1).max(initial=0)) < EXACT
            f = x.astype(np.float32 if exact else np.float64)
            e = a + len(f)
            at[a:e], size[a:e] = np.searchsorted(self.seq, b["seq"].to_numpy()), np.sqrt(np.einsum("ij,ij->i", f, f, dtype=float))
            s = q.astype(f.dtype) @ f.T
            if not exact and out.dtype != np.float64:
                out = out.astype(np.float64)
            out[:, a:e], a = s, e
        return at, size, out

    def id(self, doc: int) -> str:
        return self.ids[int(doc)].as_py()


def _folded(r: Reader, listed: np.ndarray, in_list: np.ndarray, ordered: Callable[[np.ndarray], np.ndarray], k: int, titles: str) -> list[int]:
    """The first k of a list after folding; less than k if it is too short. ``listed``: in order; ``in_list``:
    of every record, whether it is in the whole list; ``ordered``: puts records in order."""
    seen: set[int] = set()
    gone: set[int] = set()
    out: list[int] = []
    for doc in listed:
        if len(out) == k:
            break
        if doc in gone:
            continue
        title = int(r.title[doc])
        if titles == "keep" or title < 0:
            out.append(doc)
            if titles != "keep":
                seen.update(r.refs_of(doc).tolist())
        elif title not in seen:
            # What is about the subject and stood before would have been seen.
            bodies = r.about(title) if titles == "prefer_body" else np.zeros(0, int)
            bodies = bodies[in_list[bodies]]
            if len(bodies):
                body = ordered(bodies)[0]
                gone.add(body)
                out.append(body)
                seen.update(r.refs_of(body).tolist())
            else:
                out.append(doc)
                seen.add(title)
    return out


def _left(r: Reader, listed: np.ndarray, in_list: np.ndarray, ordered: Callable[[np.ndarray], np.ndarray], titles: str) -> int:
    """How many items folding leaves: a subject's titles leave one place, none if something else is about it
    (``fold_behind``: if that stands before)."""
    mine = listed[r.title[listed] >= 0]
    if titles == "keep" or not len(mine):
        return len(listed)
    bodies = in_list[r.ref_doc]
    if titles == "prefer_body":
        about = np.zeros(r.entities, bool)
        about[r.ref_code[bodies]] = True
        return len(listed) - len(mine) + int((~about[np.unique(r.title[mine])]).sum())
    place = np.empty(r.n, np.int64)
    place[ordered(listed)] = np.arange(len(listed))
    title, body = np.full(r.entities, r.n), np.full(r.entities, r.n)
    np.minimum.at(title, r.title[mine], place[mine])
    np.minimum.at(body, r.ref_code[bodies], place[r.ref_doc[bodies]])
    return len(listed) - len(mine) + int((title < body).sum())


def _rank(r: Reader, q: object, at: np.ndarray, cosine: np.ndarray, o: Options) -> list[tuple]:
    """The rows of one question."""
    score, matched = r.scratch("score", np.int64), r.scratch("matched", np.int64)
    for term, idf in zip(q.read, q.idf):
        docs, part = r.terms[term]
        score[docs] += part
        matched[docs] += np.int64(idf * FINE + 0.5)
    hits = np.flatnonzero(matched != 0)
    shown = hits[r.admitted[hits]]
    dark = hits[~r.admitted[hits]]
    rows: list[tuple] = []
    total = q.total_idf
    cover = lambda d: float(matched[d] / FINE / total)
    if len(dark):
        known = dark[~r.gap[dark]]
        if len(known):
            best = known[np.argmax(_tie(score[known] / FINE))]
            rows.append(("dark", 1, r.id(best), float(score[best] / FINE), None, cover(best), None, None, len(dark)))
    lr, vr = r.scratch("lr", np.int32), r.scratch("vr", np.int32)
    ranked = shown[_order(_tie(score[shown] / FINE))]
    lr[ranked] = np.arange(1, len(ranked) + 1)
    for n, d in enumerate(ranked[: o.k], 1):
        rows.append(("lexical", n, r.id(d), float(score[d] / FINE), None, cover(d), None, None, None))
    similar = r.scratch("similar", float)
    similar[at] = cosine
    near = np.flatnonzero(similar > 0)
    near = near[_order(_tie(similar[near]))]
    vr[near] = np.arange(1, len(near) + 1)
    both = np.flatnonzero((lr != 0) | (vr != 0))

    fused = r.scratch("fused", float)
    with np.errstate(divide="ignore", invalid="ignore"):
        if o.rrf_k is None:
            top = score[shown].max(initial=0) / FINE, similar[near].max(initial=0.0)
            if top[0] > 0:
                fused[shown] = o.weights[0] * (score[shown] / FINE / top[0])
            if top[1] > 0:
                fused[near] += o.weights[1] * (similar[near] / top[1])
        else:
            fused[ranked] = 1.0 / (o.rrf_k + lr[ranked])
            fused[near] += 1.0 / (o.rrf_k + vr[near])
    def ordered(docs: np.ndarray) -> np.ndarray:
        first = np.where(lr[docs] > 0, lr[docs], vr[docs])
        return docs[np.lexsort((r.id_rank[docs], first, -_tie(fused[docs])))]

    gaps = both[r.gap[both]]
    if len(gaps) and total is not None and total > 0:
        covered = np.where(lr[gaps] > 0, matched[gaps] / FINE / total, 0.0)
        near_by = np.where(vr[gaps] > 0, similar[gaps], 0.0)
        met = (covered >= o.min_coverage * 0.5) | (near_by >= o.min_similarity)
        gaps, covered, near_by = gaps[met], covered[met], near_by[met]
        order = np.lexsort((r.id_rank[gaps], -_tie(near_by), -_tie(covered)))[: o.gap_budget]
        for n, i in enumerate(order, 1):
            rows.append(("gap", n, r.id(gaps[i]), None, None, float(covered[i]), float(near_by[i]), None, None))

    items = both[~r.gap[both]]
    if o.drop_uncovered and (lr[items] > 0).any():
        items = items[lr[items] > 0]
    in_list = r.scratch("in_list", bool)
    in_list[items] = True
    ties, prefix = -_tie(fused[items]), FIRST
    while True:
        some = items
        if len(items) > prefix:
            some = items[ties <= np.partition(ties, prefix)[prefix]]
        top = _folded(r, ordered(some), in_list, ordered, o.k, o.titles)
        if len(top) == o.k or len(some) == len(items):
            break
        prefix *= 4
    for n, d in enumerate(top, 1):
        via = "hybrid" if lr[d] and vr[d] else "lexical" if lr[d] else "vector"
        relevance, coverage = (float(score[d] / FINE), cover(d)) if lr[d] else (0.0, 0.0)
        rows.append(("item", n, r.id(d), float(fused[d]), relevance, coverage, float(similar[d]) if vr[d] else 0.0, via, None))
    rows.append(("total", 0, None, None, None, None, None, None, _left(r, items, in_list, ordered, o.titles)))
    return rows


def rank(log: Log, questions: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the tasks find (query_id and ``FOUND``), the questions and the terms as ``search`` has them.

    ``questions``: query_id, text.
    """
    ws = Workspace(questions.sparkSession, "ranked")
    asked, terms = read_questions(log, questions)
    avgdl = log.stats().first()["avgdl"] or 1.0
    words = terms.where(F.col("read").isNotNull()).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("asked", "read", "idf"))).alias("t"))
    rows = questions.select("query_id", hash_counts(F.col("text"), log.dims).alias("vector")).join(asked.select("query_id", "total_idf"), "query_id")
    rows = rows.join(words, "query_id", "left").select("query_id", "vector", "total_idf", "t.read", "t.idf")
    rows = ws.table(rows, "rows")
    at_once = int(min(max(AT_ONCE // (4 * max(log.admitted, 1)), LEAST), MOST))
    tasks = -(-rows.count() // at_once)
    path, dims = log.path, log.dims

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), at_once):
                yield _answer(Reader.of(path, dims), batch.iloc[a : a + at_once], avgdl, o)

    kind = dict(questions.dtypes)["query_id"]
    # A number of partitions that is given stays, however few bytes there are.
    found = rows.repartition(max(tasks, questions.sparkSession.sparkContext.defaultParallelism)).mapInPandas(run, f"query_id {kind}, {FOUND}")
    return ws.table(found, "found"), asked, terms


def _answer(r: Reader, batch: pd.DataFrame, avgdl: float, o: Options) -> pd.DataFrame:
    names = ["query_id", *(c.split()[0] for c in FOUND.split(", "))]
    q = np.stack([np.frombuffer(v, np.int32) if v is not None else np.zeros(r.dims, np.int32) for v in batch["vector"]]).astype(float)
    r.postings({t: x for read, idf in zip(batch["read"], batch["idf"]) if read is not None for t, x in zip(read, idf)}, avgdl)
    at, sizes, dots = r.dots(q)
    sizes[sizes == 0] = 1.0
    lengths = np.sqrt((q * q).sum(axis=1))
    out = []
    for i, row in enumerate(batch.itertuples(index=False)):
        own = row._replace(read=[], idf=[]) if row.read is None else row
        cosine = dots[i] / (sizes * (lengths[i] or 1.0))
        out += [(row.query_id, *x) for x in _rank(r, own, at, cosine, o)]
    df = pd.DataFrame(out, columns=names)
    return df.astype({"n": "int32", "count": "Int64"} | {c: float for c in ("score", "relevance", "coverage", "similarity")})


def items(found: DataFrame) -> DataFrame:
    """``query_id, position, record_id, score, relevance, coverage, similarity, via`` of the k first items."""
    return found.where("what = 'item'").select("query_id", F.col("n").alias("position"), "record_id", "score", "relevance", "coverage", "similarity", "via")


def answers(log: Log, found: DataFrame, asked: DataFrame, terms: DataFrame, o: Options = Options()) -> Answers:
    """``retrieve.retrieve`` of what ``rank`` gave, with the same options."""
    gaps = found.where("what = 'gap'").select("query_id", "n", "record_id", "coverage", "similarity")
    dark = found.where("what = 'dark'").select("query_id", F.struct("record_id", "score", "coverage").alias("top"), "count")
    total = found.where("what = 'total'").select("query_id", F.col("count").alias("total"))
    return conclude(Parts(items(found), total, gaps, dark), asked, terms, log.records, o)
