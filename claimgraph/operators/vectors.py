"""Embeddings by feature hashing, exact cosine rankings, and sign-projection buckets.

Any embedder is a function from a text column to an array column; vectors of different models
are never compared: the model id is part of every key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of all question vectors that are compared at once, as they go to every task; more questions
#: take another pass over the documents.
MAX_NUMBERS = 8_000_000
#: Words whose features a task remembers.
REMEMBERED = 200_000
#: Questions on which the number of candidates is measured.
SAMPLE = 64
#: The hash that picks a feature's slot, and the seed of the one that picks its sign.
BASIS, PRIME, SIGN_SEED = 0xCBF29CE484222325, 0x100000001B3, 0x9E3779B9


def fnv1a(data: bytes, seed: int = 0) -> int:
    h = BASIS ^ seed
    for b in data:
        h = ((h ^ b) * PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def word_features(text: str, grams: tuple[int, ...] = (3, 4)) -> list[str]:
    """Each word and its character grams, blanks at both ends; only ASCII letters change case."""
    out = []
    for word in "".join(c if c.isalnum() else " " for c in text).split():
        word = "".join(c.lower() if c.isascii() else c for c in word)
        out.append(f"w:{word}")
        padded = f" {word} "
        out += [f"g:{padded[i : i + n]}" for n in grams for i in range(len(padded) - n + 1)]
    return out


def model_id(dims: int = 256, grams: tuple[int, ...] = (3, 4)) -> str:
    return f"hashing-char{'-'.join(map(str, grams))}-d{dims}"


def _hasher(dims: int, grams: tuple[int, ...]) -> Callable[[str], np.ndarray]:
    """The signed feature counts of a text."""
    known: dict[str, np.ndarray] = {}

    def of_word(word: str) -> np.ndarray:
        """The signed slots of a word's features; a worker works each word out once."""
        v = known.get(word)
        if v is None:
            if len(known) >= REMEMBERED:
                known.clear()
            v = np.zeros(dims, np.float32)
            for f in word_features(word, grams):
                data = f.encode()
                v[fnv1a(data) % dims] += 1.0 if fnv1a(data, SIGN_SEED) % 2 == 0 else -1.0
            known[word] = v
        return v

    def of_text(text: str) -> np.ndarray:
        v = np.zeros(dims)
        for word, n in Counter("".join(c if c.isalnum() else " " for c in text).split()).items():
            v += n * of_word(word)
        return v

    return of_text


def hash_embed(text: Column, dims: int = 256, grams: tuple[int, ...] = (3, 4)) -> Column:
    """Unit vectors of signed feature counts; all zero for a text without words, null for null."""
    counts = _hasher(dims, grams)

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            v = counts(t)
            norm = np.linalg.norm(v)
            out.append(v / norm if norm else v)
        return pd.Series(out)

    return embed(text)


def hash_counts(text: Column, dims: int = 256, grams: tuple[int, ...] = (3, 4)) -> Column:
    """The counts of ``hash_embed`` before they become unit vectors, as the bytes of 32-bit numbers; null for null."""
    counts = _hasher(dims, grams)

    @F.pandas_udf("binary")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else counts(t).astype(np.int32).tobytes() for t in texts], dtype=object)

    return count(text)


@dataclass(frozen=True)
class Embedder:
    """A source of vectors: ``document`` and ``query`` take a text column to an array column of ``dims``.

    Models that want questions told apart from documents give another ``query``. With ``window``, so
    many words at a time are embedded. Vectors of different ``model_id`` are never compared.
    """

    model_id: str
    dims: int
    document: Callable[[Column], Column]
    query: Callable[[Column], Column]
    window: int | None = None

    def embedded(self, records: DataFrame) -> DataFrame:
        """``record_id, window, content_hash, vector`` of records (record_id, text); null texts have none."""
        rows = records.where(F.col("text").isNotNull()).select("record_id", F.xxhash64("text").alias("content_hash"), "text")
        rows = rows.select("record_id", F.posexplode(windows(F.col("text"), self.window)).alias("window", "said"), "content_hash")
        return rows.select("record_id", "window", "content_hash", self.document(F.col("said")).alias("vector"))


def windows(text: Column, words: int | None) -> Column:
    """A text in windows of so many words, joined by blanks; a text without words, or without limit, as it is."""
    if words is None:
        return F.array(text)
    split = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size(split), F.lit(1)), F.lit(words))
    cut = F.transform(starts, lambda i: F.array_join(F.slice(split, i, F.lit(words)), " "))
    return F.when(F.size(split) > 0, cut).otherwise(F.array(text))


def hashing_embedder(dims: int = 256, grams: tuple[int, ...] = (3, 4), window: int | None = None) -> Embedder:
    embed = lambda text: hash_embed(text, dims, grams)
    return Embedder(model_id(dims, grams), dims, embed, embed, window)


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Unit rows; what is not a finite vector of the dimension, or is zero, becomes zero."""
    x = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims:
            row = np.array([np.nan if c is None else c for c in v], float)
            size = np.linalg.norm(row)
            if np.isfinite(size) and size > 0:
                x[i] = row / size
    return x


def exact_similar(
    documents: DataFrame, queries: DataFrame, dims: int, k: int | None = None, above: float = 0.0, unique: bool = False
) -> DataFrame:
    """``query_id, key, similarity``: each question's documents of cosine greater than ``above``.

    ``documents``: key, vector; ``queries``: query_id, vector, a bounded set that is compared in
    blocks with every row. With k, the k best; ties by key. A document in several rows counts
    with its best; say ``unique`` where there are none. Vectors of another length are similar to nothing.
    """
    groups = -(-queries.count() * dims // MAX_NUMBERS)
    if groups > 1:
        group = F.pmod(F.xxhash64("query_id"), F.lit(groups))
        parts = [exact_similar(documents, queries.where(group == g), dims, k, above, unique) for g in range(groups)]
        return reduce(DataFrame.unionByName, parts)
    asked = queries.select("query_id", "vector").toPandas()
    ids, q = asked["query_id"].to_numpy(), _matrix(asked["vector"], dims)
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *documents.schema]}

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, keys = _matrix(b["vector"], dims), b["key"].to_numpy()
            if not unique and len(b):
                # Rows of one key count as one, with the best of them, before the k best are taken.
                of, keys = pd.factorize(b["key"], use_na_sentinel=False)
                order = np.argsort(of, kind="stable")
                x, first = x[order], np.flatnonzero(np.diff(of[order], prepend=-1))
            for a in range(0, len(ids), 256):
                s = q[a : a + 256] @ x.T
                if not unique and len(b):
                    s = np.maximum.reduceat(s, first, axis=1)
                i, j = np.nonzero(s > above)
                if k is not None and s.shape[1] > k:
                    # All that tie with the k-th best of this batch stay; the final ranking decides.
                    least = np.partition(s, -k, axis=1)[:, -k]
                    held = s[i, j] >= least[i]
                    i, j = i[held], j[held]
                yield pd.DataFrame({"query_id": ids[a + i], "key": keys[j], "similarity": s[i, j]})

    rows = documents.select("key", "vector").mapInPandas(
        compare, f"query_id {kinds['query_id']}, key {kinds['key']}, similarity double"
    )
    if not unique:
        rows = rows.groupBy("query_id", "key").agg(F.max("similarity").alias("similarity"))
    if k is None:
        return rows
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


class SignBuckets:
    """Sign projections in several tables; centred planes from a seed.

    A question looks into its own bucket, then those that differ in one bit, then in two, and so
    on to all bits, and stops after the ring with which ``want`` documents are found. With fewer
    documents than that it meets them all. Vectors that are null, zero, not finite or of another
    length have no bucket.
    """

    def __init__(self, dims: int, tables: int = 8, bits: int = 12, seed: int = 1):
        self.dims, self.tables, self.bits = dims, tables, bits
        self.planes = np.random.default_rng(seed).uniform(-1, 1, (tables * bits, dims))

    def _signs(self, x: np.ndarray) -> np.ndarray:
        """A signature for each row and table."""
        signs = (x @ self.planes.T >= 0).reshape(len(x), self.tables, self.bits)
        return (signs * (1 << np.arange(self.bits))).sum(axis=2).astype("int32")

    def signatures(self, vector: Column) -> Column:
        dims, signs = self.dims, self._signs

        @F.pandas_udf("array<int>")
        def sign(vectors: pd.Series) -> pd.Series:
            x = _matrix(vectors, dims)
            return pd.Series([s if usable else None for s, usable in zip(signs(x), x.any(axis=1), strict=True)], dtype=object)

        return sign(vector)

    def buckets(self, documents: DataFrame) -> DataFrame:
        signed = documents.select("key", self.signatures(F.col("vector")).alias("s"))
        return signed.select("key", F.posexplode("s").alias("table", "bucket"))

    def candidates(self, documents: DataFrame, queries: DataFrame, want: int) -> DataFrame:
        """``query_id, key, ring``.

        A table has each key in one bucket, so the keys of its rings are counted before any is
        read: the ring at which one table alone has enough is the widest that is looked into.
        There are at most 2 ** bits buckets a table, however many documents.
        """
        members = self.buckets(documents)
        one = members.groupBy("table", "key").agg(F.min("bucket").alias("bucket"))
        filled = members.select("table", "bucket").distinct().join(
            one.groupBy("table", "bucket").agg(F.count("*").alias("n")), ["table", "bucket"], "left"
        )
        probes = (
            queries.select("query_id", self.signatures(F.col("vector")).alias("s"))
            .select("query_id", F.posexplode("s").alias("table", "own"))
            .join(filled, "table")
            .select("query_id", "table", "bucket", "n", F.bit_count(F.col("own").bitwiseXOR(F.col("bucket"))).alias("ring"))
        )
        upto = Window.partitionBy("query_id", "table").orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)
        held = probes.groupBy("query_id", "table", "ring").agg(F.sum("n").alias("n")).withColumn("n", F.sum("n").over(upto))
        reach = held.groupBy("query_id").agg(F.min(F.when(F.col("n") >= want, F.col("ring"))).alias("reach"))
        probes = probes.join(reach, "query_id").where(F.col("ring") <= F.coalesce("reach", F.lit(self.bits)))
        met = members.join(probes.select("query_id", "table", "bucket", "ring"), ["table", "bucket"])
        first = met.groupBy("query_id", "key").agg(F.min("ring").alias("ring"))
        sizes = first.groupBy("query_id", "ring").agg(F.count("*").alias("n"))
        inner = Window.partitionBy("query_id").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
        open_ = sizes.withColumn("had", F.coalesce(F.sum("n").over(inner), F.lit(0))).where(F.col("had") < want)
        return first.join(open_.select("query_id", "ring"), ["query_id", "ring"]).select("query_id", "key", "ring")

    def want_for(self, documents: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
        """The least ``want`` with which a sample of the questions meets that part of its k nearest.

        The sample is compared with every document; the nearest and the sizes of the rings go to the driver.
        """
        asked = queries.select("query_id", "vector").orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE).toPandas()
        q = _matrix(asked["vector"], self.dims)
        q = q[q.any(axis=1)]
        own, signs, dims, bits = self._signs(q), self._signs, self.dims, self.bits

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = _matrix(b["vector"], dims)
                x = x[x.any(axis=1)]
                if not len(x):
                    continue
                mine = signs(x)
                for i in range(len(q)):
                    ring = np.bitwise_count(mine ^ own[i]).min(axis=1).astype("int64")
                    cosine = x @ q[i]
                    best = np.argsort(-cosine, kind="stable")[:k]
                    yield pd.DataFrame({"i": i, "ring": ring[best], "similarity": cosine[best], "n": None}).astype({"n": "float"})
                    yield pd.DataFrame({"i": i, "ring": range(bits + 1), "similarity": None, "n": np.bincount(ring, minlength=bits + 1)}).astype(
                        {"similarity": "float", "n": "float"}
                    )

        rows = documents.select("vector").mapInPandas(compare, "i long, ring long, similarity double, n double")
        # A column of pandas without a number is NaN here.
        nearest = rows.where(~F.isnan("similarity") & F.col("similarity").isNotNull())
        w = Window.partitionBy("i").orderBy(F.desc("similarity"), "ring")
        nearest = nearest.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).select("i", "ring")
        sizes = rows.where(~F.isnan("n") & F.col("n").isNotNull()).groupBy("i", "ring").agg(F.sum("n").alias("n"))
        inner = Window.partitionBy("i").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
        had = sizes.withColumn("had", F.coalesce(F.sum("n").over(inner), F.lit(0.0))).drop("n")
        needs = sorted(int(r["had"]) + 1 for r in nearest.join(had, ["i", "ring"]).collect())
        return needs[max(0, int(np.ceil(recall * len(needs))) - 1)] if needs else 1

    def similar(
        self, documents: DataFrame, queries: DataFrame, k: int, want: int | None = None, recall: float | None = None
    ) -> DataFrame:
        """``query_id, key, similarity``: the k best of the candidates, by exact cosine.

        With ``recall``, ``want`` is raised to what meets that part of a sample's nearest.
        """
        want = want or 4 * k
        if recall is not None:
            want = max(want, self.want_for(documents, queries, k, recall))
        near = self.candidates(documents, queries, want)
        both = near.join(documents.select("key", F.col("vector").alias("x")), "key").join(
            F.broadcast(queries.select("query_id", F.col("vector").alias("y"))), "query_id"
        )
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
        cos = dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
        ranked = both.select("query_id", "key", cos.alias("similarity")).withColumn("n", F.row_number().over(w))
        return ranked.where(F.col("n") <= k).drop("n")
