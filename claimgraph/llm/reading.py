"""Reading level: share of unfamiliar words and length of sentences.

The familiar words are those of high document frequency in the collection itself, counted
over all its English documents. How much of a text lies outside that list, for lists of
several sizes, and how long its sentences are, is turned into a band by a small ordinal
classifier that is fitted on labelled documents.

Texts are taken apart once, into the numbers of their words; everything after works on those.
Their language is told by ``claimgraph.llm.language``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.language import fit_languages, in_language, seed_language, set_least, told
from claimgraph.session import Workspace

#: A list holds the words that occur in at least this share of the English documents.
LISTS = (0.3, 0.2, 0.1, 0.08, 0.06, 0.04, 0.02)
#: Labelled documents that the classifier is fitted on, at most; chosen by hash of the id.
MAX_LABELLED = 20_000
#: Words of the lists that are sent to a task at once; more go in several passes over the words.
MAX_WORDS = 500_000
BANDS = (1, 2, 3, 4)
RIDGE = 3.0

WORD = re.compile(r"[^\W\d_]+")
#: A mark that ends a sentence, an empty line, or a line that begins anew.
SENTENCE = re.compile(r"[.!?…。]+[\"'”’»)\]*_`]*(?=\s|$)|\n\s*\n|\n(?=\s*(?:[A-Z#|*\-+>]|\d+[.)]))")
TAKEN = "key long, seed string, n int, sentences int, words array<string>, counts array<int>"
LEVEL = "key long, words int, sentence_words double, unfamiliar array<double>, band int"
MEASURED = "row long, key long, n int, length double, inside array<int>"


def take_apart(text: str) -> tuple[str | None, int, int, list[str], list[int]]:
    """The language that its function words tell, words, sentences, and each word with its number."""
    count = Counter(WORD.findall(text.lower()))
    sentences = max(1, sum(1 for s in SENTENCE.split(text) if WORD.search(s))) if count else 1
    return seed_language(count.keys()), count.total(), sentences, list(count), list(count.values())


def word_numbers(texts: DataFrame) -> DataFrame:
    """``key, seed, n, sentences, words, counts`` of each text (key, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [take_apart(t) for t in b.column(1).to_pylist()]
            seed, n, sentences, words, counts = zip(*parts) if parts else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()), pa.array(seed, pa.string()), pa.array(n, pa.int32()), pa.array(sentences, pa.int32()),
                    pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32())),
                ],
                ["key", "seed", "n", "sentences", "words", "counts"],
            )

    return texts.select("key", "text").mapInArrow(count, TAKEN)


def familiar_words(english: DataFrame, lists: tuple[float, ...] = LISTS) -> DataFrame:
    """``word, lists``: each listed word and how many of the lists hold it, by its share of the English documents."""
    df = english.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    n = english.count()
    in_lists = sum(((F.col("df") >= t * n).cast("int") for t in lists), F.lit(0))
    return df.select("word", in_lists.alias("lists")).where(F.col("lists") > 0)


def measures(english: DataFrame, familiar: DataFrame, lists: int, max_words: int | None = None) -> DataFrame:
    """``key, n, length, inside``: words, words in a sentence, and how many words are in each number of lists.

    The lists go to the tasks. If they have more than ``max_words`` words they go in parts, and the
    numbers of the parts are put together by the row of ``english``.
    """
    parts = max(1, -(-familiar.count() // (max_words or MAX_WORDS)))

    def inside(words: pd.DataFrame):  # noqa: ANN202
        known = pa.array(words["word"].tolist(), pa.string())
        of = np.append(words["lists"].to_numpy(np.int64), 0)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes = b.column("words").value_lengths().to_numpy(zero_copy_only=False)
                held = np.zeros(b.num_rows * (lists + 1), np.int32)
                terms = b.column("words").flatten().dictionary_encode()
                if len(terms):
                    at = pc.index_in(terms.dictionary, value_set=known).fill_null(len(of) - 1).to_numpy(zero_copy_only=False)
                    level = of[at][terms.indices.to_numpy(zero_copy_only=False)]
                    rows = np.repeat(np.arange(b.num_rows), sizes)
                    weight = b.column("counts").flatten().to_numpy(zero_copy_only=False)
                    held = np.bincount(rows * (lists + 1) + level, weight, len(held)).astype(np.int32)
                length = b.column("n").to_numpy(zero_copy_only=False) / b.column("sentences").to_numpy(zero_copy_only=False)
                offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (lists + 1))
                columns = [b.column("row"), b.column("key"), b.column("n"), pa.array(length), pa.ListArray.from_arrays(offsets, pa.array(held))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "key", "n", "length", "inside"])

        return count

    columns = english.select("row", "key", "n", "sentences", "words", "counts")
    if parts == 1:
        return columns.mapInArrow(inside(familiar.toPandas()), MEASURED).drop("row")
    part = F.pmod(F.xxhash64("word"), F.lit(parts))
    each = [columns.mapInArrow(inside(familiar.where(part == i).toPandas()), MEASURED) for i in range(parts)]
    # A word counts as listed in its own part only; what no part lists is the rest.
    found = [F.sum(F.col("inside")[i]).cast("int").alias(f"i{i}") for i in range(1, lists + 1)]
    total = reduce(DataFrame.unionByName, each).groupBy("row", "key", "n", "length").agg(*found)
    listed = [F.col(f"i{i}") for i in range(1, lists + 1)]
    return total.select("key", "n", "length", F.array(F.col("n") - sum(listed, F.lit(0)), *listed).alias("inside"))


def shares(n: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """For each list the share of words outside it. The lists are nested: a word in k of them is in the k longest."""
    within = np.cumsum(inside[:, ::-1], axis=1)[:, ::-1][:, :0:-1]
    return np.where(n[:, None] > 0, 1 - within / np.maximum(n, 1)[:, None], 0.0)


def expand(sentence_words: np.ndarray, unfamiliar: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.log1p(sentence_words), unfamiliar])
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.column_stack([x, *pairs])


class Bands:
    """Ordinal bands: for each band above the first, a ridge logistic model of reaching it."""

    def __init__(self, x: np.ndarray, band: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._scaled(x)
        self.weights = [self._fit(z, (band >= b).astype(float)) for b in BANDS[1:]]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    @staticmethod
    def _fit(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        w = np.zeros(z.shape[1])
        ridge = np.diag([1e-3, *[RIDGE] * (z.shape[1] - 1)])
        for _ in range(30):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + ridge
            step = np.linalg.solve(h, z.T @ (p - y) + ridge @ w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        return w

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self._scaled(x)
        return 1 + sum((z @ w > 0).astype(int) for w in self.weights)


def measure(text: str, familiar: dict[str, int], lists: int) -> tuple[int, float, list[float]]:
    """Words of one text, words in a sentence, and for each list the share of words outside it."""
    _, n, sentences, words, counts = take_apart(text)
    held = np.bincount([familiar.get(w, 0) for w in words], counts, lists + 1) if n else np.zeros(lists + 1)
    return n, n / sentences, shares(np.array([n]), held[None, :])[0].tolist()


def reading_levels(
    documents: DataFrame, key: Column, text: Column, labels: DataFrame, lists: tuple[float, ...] = LISTS
) -> DataFrame:
    """``key, words, sentence_words, unfamiliar, band`` of every English document.

    ``labels``: key, band; documents with several labels count with their mean, rounded
    half up, repeated rows once. ``unfamiliar`` has one share for each list. Documents in
    other languages and null texts are left out; a text without words has band 1. Without
    any labelled document the band is null. Keys are long; rows with equal keys are
    measured each; a null key stays null. Other columns are ignored.
    """
    ws = Workspace(documents.sparkSession, "reading")
    texts = documents.select(key.cast("long").alias("key"), text.alias("text")).where(F.col("text").isNotNull())
    numbers = ws.table(word_numbers(texts).withColumn("row", F.monotonically_increasing_id()), "numbers")
    model = fit_languages(numbers)
    if model is not None:
        numbers = ws.table(told(numbers, model), "told")
        model = set_least(model, numbers)
    english = numbers.where(in_language(model, "en"))
    familiar = ws.table(familiar_words(english, lists), "familiar")
    measured = ws.table(measures(english, familiar, len(lists)), "measured")

    sample = (
        labels.select("key", "band")
        .where(F.col("key").isNotNull() & F.col("band").isin(*BANDS))
        .distinct()
        .groupBy("key")
        .agg(F.floor(F.avg("band") + 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(MAX_LABELLED)
    )
    rows = measured.join(F.broadcast(sample), "key").where(F.col("n") > 0).select("label", "n", "length", "inside").toPandas()
    bands = None
    if len(rows):
        rows = rows.assign(inside=rows["inside"].map(tuple)).sort_values(["label", "length", "inside"])
        outside = shares(rows["n"].to_numpy(), np.array(rows["inside"].tolist()))
        bands = Bands(expand(rows["length"].to_numpy(), outside), rows["label"].to_numpy())

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            n, length = b["n"].to_numpy(), b["length"].to_numpy()
            outside = shares(n, np.stack(b["inside"].to_numpy()))
            band = np.where(n > 0, bands.predict(expand(length, outside)), 1) if bands else [pd.NA] * len(b)
            yield pd.DataFrame(
                {"key": b["key"], "words": n, "sentence_words": length, "unfamiliar": list(outside), "band": pd.array(band, dtype="Int32")}
            )

    return measured.mapInPandas(levels, LEVEL)
