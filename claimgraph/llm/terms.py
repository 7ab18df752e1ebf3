"""How distinctive a term is of an item: a parsimonious language model.

A term's occurrences in an item are explained either by the collection as a whole or by
the item's own model. Expectation maximisation moves the mass of common terms to the
collection; what stays is the item's own, and ranks its terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import NOT_ALNUM, fold
from claimgraph.session import Workspace

#: Share of an item's text that its own model may explain.
OWN = 0.1
TOLERANCE = 1e-6
#: Most rounds until converged items are dropped, if they are not half of those left before.
MAX_ROUNDS = 200
#: A term of a place that makes at least this part of all rows is hot. So many parts at most exist,
#: over all places together, which bounds what is broadcast; each other term is less than one part.
HOT_PARTS = 50_000
#: Over so many rows the size of a collection is spread to its terms.
SALTS = 32


def term_counts(items: DataFrame) -> DataFrame:
    """``place, item_key, term, tf`` of items (place, item_key, text), whose keys are unique in a place.

    Terms are words of letters alone and of four characters or more, lower case, plural folded.
    """
    raw = items.select("place", "item_key", F.explode(F.split("text", NOT_ALNUM)).alias("raw"))
    # Folding makes no word longer, so the short ones need neither folding nor the pattern.
    raw = raw.where(F.char_length("raw") >= 4)
    folded = raw.select("place", "item_key", fold(F.lower("raw")).alias("term"))
    return (
        folded.where(F.col("term").rlike(r"^\p{L}{4,}$"))
        .groupBy("place", "item_key", "term")
        .agg(F.count("*").alias("tf"))
    )


def converge(tf: np.ndarray, background: np.ndarray, starts: np.ndarray, own: float = OWN) -> np.ndarray:
    """The items' own term probabilities. ``starts``: where each item's terms begin.

    An item stops for itself, so its result doesn't depend on what else is in the batch. Each goes
    on until it has met the tolerance; those that have are dropped from the arrays.
    """
    sizes = np.diff(np.append(starts, len(tf)))
    p = tf / np.repeat(np.add.reduceat(tf, starts), sizes)
    done, rows = np.empty_like(p), np.arange(len(tf))
    going, rounds = np.ones(len(starts), bool), 0
    while len(starts):
        e = tf * (own * p) / ((1 - own) * background + own * p)
        total = np.add.reduceat(e, starts)
        new = e / np.repeat(np.where(total > 0, total, 1), sizes)
        moved = np.maximum.reduceat(np.abs(new - p), starts)
        p = np.where(np.repeat(going, sizes), new, p)
        going &= moved > TOLERANCE
        rounds += 1
        if 2 * going.sum() <= len(going) or rounds % MAX_ROUNDS == 0:
            held = np.repeat(going, sizes)
            done[rows[~held]] = p[~held]
            tf, background, p, rows = tf[held], background[held], p[held], rows[held]
            sizes = sizes[going]
            starts = np.cumsum(sizes) - sizes
            going = np.ones(len(starts), bool)
    return done


def distinctive_terms(items: DataFrame, own: float = OWN) -> DataFrame:
    """``place, item_key, term, tf, df, weight``: every term of every item.

    ``items``: place (the collection), item_key, text. df: items of the place with the term;
    weight: converged probability in the item's own model, high for what is characteristic.

    A key in several rows of a place is one item: the greatest text counts. Rows with a null
    place, key or text, and texts without terms, give nothing. Other columns are ignored.
    """
    ws = Workspace(items.sparkSession, "terms")
    once = (
        items.select("place", "item_key", "text")
        .where(F.col("place").isNotNull() & F.col("item_key").isNotNull() & F.col("text").isNotNull())
        .groupBy("place", "item_key")
        .agg(F.max("text").alias("text"))
    )
    counts = ws.table(term_counts(once), "counts")
    by_term = counts.groupBy("place", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    by_term = ws.table(by_term, "by_term")
    rows = by_term.agg(F.sum("df")).first()[0] or 0
    # A collection may have most of the terms, so its total is spread before it meets them.
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    totals = by_term.groupBy("place").agg(F.sum("cf").alias("total"))
    totals = totals.select("place", "total", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    model = by_term.withColumn("salt", salt).join(totals, ["place", "salt"]).select(
        "place", "term", "df", (F.col("cf") / F.col("total")).alias("background")
    )
    # Hot terms have too many rows for one task each, but are few: they are broadcast.
    hot = F.col("df") * HOT_PARTS >= rows
    few = F.broadcast(model.where(hot))
    common = counts.join(few, ["place", "term"])
    rare = counts.join(few.select("place", "term"), ["place", "term"], "left_anti").join(model.where(~hot), ["place", "term"])
    grouped = common.unionByName(rare).groupBy("place", "item_key").agg(
        F.array_sort(F.collect_list(F.struct("term", "tf", "df", "background"))).alias("terms")
    )

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            # The four fields of all items one after the other; flattening an array keeps its slice.
            term, tf, df, background = lists.flatten().flatten()
            p = converge(
                tf.to_numpy(zero_copy_only=False).astype(float), background.to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes, own
            )
            of = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            columns = [b.column(0).take(of), b.column(1).take(of), term, tf, df, pa.array(p)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, TYPES)], NAMES)

    return grouped.mapInArrow(weights, "place string, item_key string, term string, tf long, df long, weight double")


NAMES = ["place", "item_key", "term", "tf", "df", "weight"]
TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]


def top_terms(scored: DataFrame, k: int) -> DataFrame:
    """The k terms of greatest weight of each item, with their rank; ties in order of the term."""
    w = Window.partitionBy("place", "item_key").orderBy(F.desc("weight"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
