"""The language of texts by a model of character trigrams that is fitted on the corpus itself.

Texts with clearly more function words of one known language than of any other are its seeds. The
trigrams of their words, counted over all seeds, make a model of each language; a text is in the
language under which its characters are told best from those before them, but in none of them
where that is nearer to what seeds of other languages get than to what its own get.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frequent function words by which seeds are chosen.
FUNCTION_WORDS = {
    "en": "the of and a to is was that for it not by as with which be in or on had has this its if no from are an",
    "de": "der die das und nicht ist ein eine den mit auf für von wird noch keine es im sich zu dem ob an war wenn",
    "es": "el la los las de que y en un una no se es por con del para si hay al lo su como más cada",
}
LISTED = {language: frozenset(words.split()) for language, words in FUNCTION_WORDS.items()}
#: A seed has so many different function words of its language at least, and twice those of any other.
SEED_WORDS = 3
#: Trigrams of a language's model, the most frequent ones; the rest count as unseen.
GRAMS = 50_000
#: Weight of the characters' own frequencies against those behind a pair.
SMOOTH = 5.0
#: Words whose gains a task remembers.
REMEMBERED = 500_000


def seed_language(words: Iterable[str]) -> str | None:
    count = sorted(((len(listed.intersection(words)), name) for name, listed in LISTED.items()), reverse=True)
    (best, name), (second, _) = count[0], count[1]
    return name if best >= SEED_WORDS and best >= 2 * second else None


def grams_of(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


@dataclass
class Languages:
    """``gains``: of each trigram, and of each pair for the trigrams that were not seen, the logarithm
    of how much better its last character is foretold in each language than by its frequency alone."""

    names: list[str]
    gains: dict[str, np.ndarray]
    #: Least mean gain of a text in each language.
    least: np.ndarray
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def word(self, word: str) -> np.ndarray:
        """The gains of a word in each language, and its trigrams."""
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) >= REMEMBERED:
                self.cache.clear()
            known = np.zeros(len(self.names) + 1)
            for g in grams_of(word):
                gain = self.gains.get(g)
                gain = self.gains.get(g[:2]) if gain is None else gain
                if gain is not None:
                    known[:-1] += gain
                known[-1] += 1
            self.cache[word] = known
        return known

    def scores(self, words: pa.Array, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The mean gain in each language of texts whose words lie one after the other."""
        sums = np.zeros((len(sizes), len(self.names) + 1))
        if len(words):
            coded = words.dictionary_encode()
            table = np.stack([self.word(w) for w in coded.dictionary.to_pylist()])
            rows = np.repeat(np.arange(len(sizes)), sizes)
            at = coded.indices.to_numpy(zero_copy_only=False)
            for j in range(sums.shape[1]):
                sums[:, j] = np.bincount(rows, table[at, j] * counts, len(sizes))
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1)


def count_grams(numbers: DataFrame) -> DataFrame:
    """``seed, gram, n`` of the seeds, the most frequent of each language."""
    pairs = numbers.where(F.col("seed").isNotNull()).select("seed", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    words = pairs.groupBy("seed", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    places = F.sequence(F.lit(1), F.char_length("word"))
    grams = words.select("seed", "n", F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(3)))).alias("gram"))
    grams = grams.groupBy("seed", "gram").agg(F.sum("n").alias("n"))
    # Trigrams are far fewer than words: one window for each language holds them.
    w = Window.partitionBy("seed").orderBy(F.desc("n"), "gram")
    return grams.withColumn("r", F.row_number().over(w)).where(F.col("r") <= GRAMS).drop("r")


def fit_languages(numbers: DataFrame) -> Languages | None:
    """The model from texts (seed, words, counts); None without seeds."""
    rows = count_grams(numbers).collect()
    if not rows:
        return None
    names = sorted({r["seed"] for r in rows})
    of = {name: i for i, name in enumerate(names)}
    seen, after, last = {}, {}, {}
    for r in rows:
        g, i = r["gram"], of[r["seed"]]
        for key, table in ((g, seen), (g[:2], after)):
            table.setdefault(key, np.zeros(len(names)))[i] += r["n"]
        last[g[2]] = last.get(g[2], 0) + r["n"]
    total = sum(last.values())
    # log((n + SMOOTH p) / (after + SMOOTH)) - log p; what follows an unseen pair is told no better.
    gains = {pair: np.log(SMOOTH / (n + SMOOTH)) for pair, n in after.items()}
    for g, n in seen.items():
        p = last[g[2]] / total
        gains[g] = np.log((n / p + SMOOTH) / (after[g[:2]] + SMOOTH))
    return Languages(names, gains, np.zeros(len(names)))


def told(numbers: DataFrame, model: Languages | None) -> DataFrame:
    """``numbers`` with ``scores``, the mean gain in each language of ``model``; null without one."""
    if model is None:
        return numbers.withColumn("scores", F.lit(None).cast("array<double>"))
    fields = numbers.schema.names
    at = {name: i for i, name in enumerate(fields)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, counts = b.column(at["words"]), b.column(at["counts"])
            sizes = words.value_lengths().to_numpy(zero_copy_only=False)
            s = model.scores(words.flatten(), counts.flatten().to_numpy(zero_copy_only=False), sizes)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * s.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*fields, "scores"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in numbers.dtypes)
    return numbers.mapInArrow(score, f"{kinds}, scores array<double>")


def set_least(model: Languages, scored: DataFrame) -> Languages:
    """The model with the bounds between its languages and none, from the means of all seeds.

    The bound lies halfway between the mean of a language's own seeds and the highest mean that
    seeds of another language get; with one language only at half its own.
    """
    means = scored.where(F.col("seed").isNotNull()).groupBy("seed").agg(
        *[F.avg(F.col("scores")[i]).alias(name) for i, name in enumerate(model.names)]
    )
    by = {r["seed"]: r for r in means.collect()}
    for i, name in enumerate(model.names):
        others = [by[o][name] for o in by if o != name]
        model.least[i] = (by[name][name] + max(others, default=0.0)) / 2
    return model


def in_language(model: Languages | None, name: str) -> F.Column:
    """Whether ``scores`` tell that language. Without a model, by function words of the array ``words``.

    A text without words is in any language.
    """
    if model is None:
        share = {k: F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in sorted(v)]))) for k, v in LISTED.items()}
        told_ = (share[name] > 0) & (share[name] >= F.greatest(*share.values()))
    elif name not in model.names:
        told_ = F.lit(False)
    else:
        i = model.names.index(name)
        told_ = (F.col("scores")[i] >= F.array_max("scores")) & (F.col("scores")[i] >= float(model.least[i]))
    return (F.size("words") == 0) | told_
