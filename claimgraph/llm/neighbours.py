"""Most similar vectors for every vector, by learned partitions.

Of each space of vectors a bounded sample gives a neighbour graph. The graph is cut into
balanced partitions by recursive spectral bisection, and a small linear classifier learns
to tell a vector's partition. Every vector is indexed under its most probable partition
and looks for neighbours in its several most probable ones; how many, is found on the
sample. Candidates are ranked by exact cosines.

A partition that is still too large is a space of its own for the next level: a sample of
it gives a classifier below the one that led there. So partitions stay near one size,
however many vectors there are. Classifiers are learned in tasks, one for each node.

Copies of a vector are one class: only classes are indexed, so a group of copies of any
size costs one row. A partition of any size is compared in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.session import Workspace

#: Vectors of each node that its classifier is learned from, about; chosen by hash.
SAMPLE = 12_000
#: Classes that a partition holds on average, and the most partitions below one node.
PARTITION = 1_500
FANOUT = 256
#: Below the first level only nodes of so many partitions and more are cut further.
DEEPER = 4
#: Levels of classifiers at most: FANOUT ** LEVELS partitions; beyond, partitions just get larger.
LEVELS = 6
GRAPH_K = 10
#: Rows on either side of a tile.
TILE = 4_096
#: Share of the sample's pairs that routing must bring together.
ROUTED = 0.999
NEIGHBOUR_ROUTED = 0.97
#: Error of a cosine of half-precision unit vectors, with room to spare.
HALF_ERROR = 2e-3
#: Bytes of one level's classifiers up to which they go to every task; they are added up before.
#: Beyond, vectors are brought to their node's classifier, so many of a node together.
BROADCAST_BYTES = 64 << 20
ROUTE_ROWS = 100_000
#: Keys of a class in one row; what is paired are such rows.
KEYS = 1_000


@dataclass
class Router:
    """A space's classifier; rows of ``weights`` are partitions, the last column a bias."""

    weights: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:, :-1].T + self.weights[:, -1]

    def route(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The most probable partitions of each row, best first."""
        m = min(probes or self.probes, len(self.weights))
        s = self.scores(x)
        best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < s.shape[1] else np.tile(np.arange(m), (len(x), 1))
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)


def neighbour_graph(x: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """The k nearest rows of each row, by cosine."""
    k = min(k, len(x) - 1)
    near = np.empty((len(x), max(k, 0)), np.int64)
    for a in range(0, len(x) if k > 0 else 0, block):
        s = -(x[a : a + block] @ x.T)
        s[np.arange(len(s)), np.arange(a, a + len(s))] = np.inf
        near[a : a + block] = np.argpartition(s, k - 1, axis=1)[:, :k]
    return near


def balanced_partition(near: np.ndarray, depth: int, seed: int = 0) -> np.ndarray:
    """2**depth parts of equal size: each part's graph is halved at the median of a slow vector of its walk."""
    n = len(near)
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    for _ in range(depth):
        v = rng.standard_normal(n)
        inside = part[near] == part[:, None]
        degree = inside.sum(axis=1) + 1
        for _ in range(25):
            # A step of the lazy walk within the parts, both ways along the edges; the constant is taken out.
            out = (np.where(inside, v[near], 0).sum(axis=1) + v) / degree
            back = np.zeros(n)
            np.add.at(back, near[inside], np.repeat(out / degree, inside.sum(axis=1)))
            v = out + back
            size = np.bincount(part)
            v -= (np.bincount(part, v) / np.maximum(size, 1))[part]
            v /= np.sqrt(np.bincount(part, v * v) / np.maximum(size, 1) + 1e-30)[part]
        order = np.lexsort((v, part))
        start = np.concatenate([[0], np.cumsum(np.bincount(part))])[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - start[part[order]]
        part = 2 * part + (2 * rank >= np.bincount(part)[part])
    return part


def train_classifier(x: np.ndarray, part: np.ndarray, parts: int, seed: int = 0, epochs: int = 12) -> np.ndarray:
    """Softmax weights with a bias, from the partitions' centres on."""
    centre = np.zeros((parts, x.shape[1]))
    np.add.at(centre, part, x)
    centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
    w = np.column_stack([8.0 * centre, np.zeros(parts)]).astype(np.float32)
    data = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.default_rng(seed)
    for _ in range(epochs if parts > 1 else 0):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 512):
            rows = order[a : a + 512]
            s = data[rows] @ w.T
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), part[rows]] -= 1
            g = p.T @ data[rows] / len(rows) + 1e-4 * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def learn(x: np.ndarray, parts: int, threshold: float | None, levels: int = 1, share: float = 1.0, seed: int = 0) -> Router:
    """A router into about so many parts from unit rows of a sample. With several ``levels`` each
    may lose only its part of what all may.

    With a threshold the probes are as many as bring together pairs of exactly that
    cosine, made from the sample by turning its vectors in random directions; without, the
    sample's own neighbours, as many of them as the sample's ``share`` of the node leaves.
    """
    parts = max(1, min(parts, len(x) // 16))
    depth = int(parts - 1).bit_length()
    x = x.astype(np.float32)
    near = neighbour_graph(x, GRAPH_K)
    part = balanced_partition(near, depth, seed) if near.shape[1] else np.zeros(len(x), np.int64)
    weights = train_classifier(x, part, 2**depth, seed)
    router = Router(weights, 1)
    if depth == 0:
        return router
    rng = np.random.default_rng(seed + 1)
    rows = rng.permutation(len(x))[:4000]
    if threshold is None:
        # Of a part of the vectors, only so many of a vector's nearest are as near as those it has in all.
        cosine = (x[rows, None] * x[near[rows]]).sum(axis=2)
        k = max(1, int(np.ceil(near.shape[1] * share)))
        best = np.take_along_axis(near[rows], np.argsort(-cosine, axis=1)[:, :k], 1)
        pairs = np.repeat(rows, k), best.ravel()
        a, b, wanted = x[pairs[0]], x[pairs[1]], NEIGHBOUR_ROUTED
    else:
        a = x[rows]
        noise = rng.standard_normal(a.shape)
        noise -= (noise * a).sum(axis=1, keepdims=True) * a
        noise /= np.linalg.norm(noise, axis=1, keepdims=True) + 1e-30
        b, wanted = threshold * a + np.sqrt(1 - threshold**2) * noise, ROUTED
    # A pair meets if either vector's own partition is among the other's probes.
    sa, sb = router.scores(a), router.scores(b)
    at_a, at_b = sa.argmax(axis=1), sb.argmax(axis=1)
    line = np.arange(len(a))
    need = (sa > sa[line, at_b][:, None]).sum(axis=1)
    if threshold is not None:
        need = np.minimum(need, (sb > sb[line, at_a][:, None]).sum(axis=1))
    router.probes = int(np.ceil(np.quantile(need, 1 - (1 - wanted) / levels))) + 1
    return router


def exploded(items: DataFrame, key: Column, space: Column, vectors: Column) -> DataFrame:
    """``key, space, h1, h2, vector`` of each vector that counts, with two hashes of the vector."""
    rows = items.select(
        key.cast("string").alias("key"), space.cast("string").alias("model"), F.explode(vectors).alias("vector")
    ).where(F.col("key").isNotNull() & F.col("model").isNotNull() & F.col("vector").isNotNull())
    v = F.col("vector")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = rows.where(finite & F.exists(v, lambda c: c != 0))
    return rows.select(
        "key",
        F.concat_ws("#", "model", F.size("vector").cast("string")).alias("space"),
        F.xxhash64(F.lit(1), "vector").alias("h1"),
        F.xxhash64(F.lit(2), "vector").alias("h2"),
        "vector",
    )


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps the squares of tiny and huge numbers finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unpack(weights: bytes, parts: int, probes: int) -> Router:
    return Router(np.frombuffer(weights, np.float32).reshape(parts, -1), int(probes))


def _halves(halves: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(h, np.float16) for h in halves]).astype(np.float32)


class Index:
    """The classes of all vectors, routed. ``members``: key, space, h1, h2, one row for each key of a class."""

    def __init__(self, vectors: DataFrame, threshold: float | None = None, queries: DataFrame | None = None):
        """``vectors``: as from ``exploded``. ``queries``: space, h1, h2 of the classes that look for
        neighbours; all of them by default."""
        self.threshold = threshold
        self.ws = Workspace(vectors.sparkSession, "neighbours")
        flat = self.ws.table(vectors, "vectors")
        self.vectors = flat
        self.members = flat.select("key", "space", "h1", "h2").distinct()
        # What a class with one key only is near to must belong to another key.
        alone = F.when(F.min("key") == F.max("key"), F.xxhash64(F.min("key"))).otherwise(F.lit(0))
        classes = flat.groupBy("space", "h1", "h2").agg(F.first("vector").alias("vector"), alone.alias("alone"))
        self.classes = self.ws.table(classes, "classes")
        asked = self.classes.withColumn("asks", F.lit(True))
        if queries is not None:
            asks = queries.select("space", "h1", "h2").distinct().withColumn("asks", F.lit(True))
            asked = self.classes.join(asks, ["space", "h1", "h2"], "left").withColumn("asks", F.col("asks").isNotNull())

        @F.pandas_udf("binary")
        def half(vectors: pd.Series) -> pd.Series:
            out = np.empty(len(vectors), object)
            lengths = vectors.map(len).to_numpy()
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                out[rows] = [h.tobytes() for h in _units(vectors.iloc[rows]).astype(np.float16)]
            return pd.Series(out)

        #: node, space, h1, h2, alone, half, member (its own place), asks (looks for neighbours here).
        self.placed = asked.select(
            F.col("space").alias("node"), "space", "h1", "h2", "alone", half("vector").alias("half"), F.lit(True).alias("member"), "asks"
        )
        self._descend()

    def _descend(self) -> None:
        """Level after level, until no node has so many members that it is worth cutting."""
        held, self.first = self.classes.groupBy(F.col("space").alias("node")).agg(F.count("*").alias("n")), None
        for level in range(LEVELS):
            least = 2 if level == 0 else DEEPER
            sizes = self.ws.table(held.where(F.col("n") >= least * PARTITION), f"sizes-{level}")
            if sizes.isEmpty():
                break
            routers = self._learn(sizes, level)
            self.first = routers if level == 0 else self.first
            self.placed = self.ws.table(self._route(routers, sizes), f"placed-{level}")
            held = self.placed.where("member").groupBy("node").agg(F.count("*").alias("n"))
        if level == 0:
            self.placed = self.ws.table(self.placed, "placed")

    def _learn(self, sizes: DataFrame, level: int) -> DataFrame:
        """``node, weights, parts, probes`` of the nodes that are cut, each learned in a task of its own."""
        threshold, partition, fanout = self.threshold, PARTITION, FANOUT
        # A class's hash decides, so the sample of a node is spread evenly and about of the wanted size.
        sample = self.placed.where("member").join(sizes, "node").where(F.pmod(F.xxhash64("h1", "h2"), F.col("n")) < SAMPLE)

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["h1", "h2"])
            n = int(rows["n"].iloc[0])
            levels = max(1, int(np.ceil(np.log(n / partition) / np.log(fanout)))) if level == 0 else 1
            router = learn(_halves(rows["half"]).astype(np.float64), min(fanout, n // partition), threshold, levels + (level > 0), len(rows) / n)
            return pd.DataFrame(
                {"node": rows["node"].iloc[:1], "weights": [router.weights.tobytes()], "parts": len(router.weights), "probes": router.probes}
            )

        rows = sample.select("node", "n", "h1", "h2", "half")
        fitted = rows.groupBy("node").applyInPandas(fit, "node string, weights binary, parts int, probes int")
        return self.ws.table(fitted, f"routers-{level}")

    def _route(self, routers: DataFrame, sizes: DataFrame) -> DataFrame:
        fields = self.placed.schema.names

        def move(rows: pd.DataFrame, router: Router) -> pd.DataFrame:
            """The rows below a node: a member under its best child, what asks under all it probes."""
            to = router.route(_halves(rows["half"]))
            times = np.where(rows["asks"], to.shape[1], 1)
            at = np.repeat(np.arange(len(rows)), times)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            out = rows.iloc[at].reset_index(drop=True)
            out["node"] = [f"{node}/{child}" for node, child in zip(out["node"], to[at, nth])]
            out["member"] = out["member"].to_numpy() & (nth == 0)
            # A probe that neither is at home here nor asks would be no use.
            return out[out["member"] | out["asks"]][fields]

        kinds = ", ".join(f"{n} {t}" for n, t in self.placed.dtypes)
        if (routers.agg(F.sum(F.octet_length("weights"))).first()[0] or 0) <= BROADCAST_BYTES:
            known = {r["node"]: _unpack(r["weights"], r["parts"], r["probes"]) for r in routers.collect()}

            def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for node, rows in b.groupby("node", sort=True):
                        yield move(rows, known[node]) if node in known else rows

            return self.placed.mapInPandas(route, kinds)
        # Too many classifiers for every task: each goes to chunks of its own node.
        chunks = F.ceil(F.col("n") * 4 / ROUTE_ROWS).cast("int")
        cut = sizes.select("node", chunks.alias("chunks"))
        rows = self.placed.join(cut, "node").withColumn("chunk", F.pmod(F.xxhash64("h1", "h2"), "chunks").cast("int")).drop("chunks")
        led = routers.join(cut, "node").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

        def route_group(rows: pd.DataFrame, led: pd.DataFrame) -> pd.DataFrame:
            r = led.iloc[0] if len(led) else None
            return move(rows[fields], _unpack(r["weights"], r["parts"], r["probes"])) if len(rows) and r is not None else rows[fields]

        moved = rows.groupBy("node", "chunk").cogroup(led.groupBy("node", "chunk")).applyInPandas(route_group, kinds)
        return moved.unionByName(self.placed.join(cut, "node", "left_anti"))

    @property
    def routers(self) -> dict[str, Router]:
        """The classifiers of the first level, by space."""
        return {} if self.first is None else {r["node"]: _unpack(r["weights"], r["parts"], r["probes"]) for r in self.first.collect()}

    def report(self) -> DataFrame:
        """``space, classes, partitions, largest, probes, scanned``: of each space the partitions with members, the
        partitions that an asking class looks into on average, and the share of the classes it is compared with."""
        per = self.placed.groupBy("space", "node").agg(
            F.count(F.when(F.col("member"), 1)).alias("held"), F.count(F.when(F.col("asks"), 1)).alias("asked")
        )
        asking = self.placed.where(F.col("member") & F.col("asks")).groupBy("space").agg(F.count("*").alias("asking"))
        space = per.groupBy("space").agg(
            F.sum("held").alias("classes"), F.count(F.when(F.col("held") > 0, 1)).alias("partitions"), F.max("held").alias("largest"),
            F.sum("asked").alias("probed"), F.sum(F.col("held") * F.col("asked")).alias("pairs"),
        )
        return space.join(asking, "space").select(
            "space", "classes", "partitions", "largest", (F.col("probed") / F.col("asking")).alias("probes"),
            (F.col("pairs") / F.col("asking") / F.col("classes")).alias("scanned"),
        )

    def tiles(self) -> DataFrame:
        """Every class as a member of its own partition and as a query in its probed ones, by tile."""
        count = lambda flag: F.ceil(F.count(F.when(F.col(flag), 1)) / TILE).cast("int")
        sizes = self.placed.groupBy("node").agg(count("member").alias("across"), count("asks").alias("down"))
        rows = self.placed.join(sizes.where("across > 0 AND down > 0"), "node")
        slot = lambda h, n: F.pmod(F.xxhash64(F.lit(7), h), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        shown = ("node", "x", "y", "asks", "space", "h1", "h2", "alone", "half")
        members = rows.where("member").withColumn("asks", F.lit(False)).withColumn("x", slot("h1", "across")).withColumn("y", every("down"))
        queries = rows.where("asks").withColumn("x", every("across")).withColumn("y", slot("h2", "down"))
        return members.select(*shown).unionByName(queries.select(*shown))

    def candidates(self, threshold: float | None, k: int | None) -> DataFrame:
        """``space, a1, a2, b1, b2, close``: of each tile the pairs near the threshold, or each query's
        k best; a is the query."""

        def rank(b: pd.DataFrame) -> pd.DataFrame:
            q, m = b[b["asks"]], b[~b["asks"]]
            out = []
            if len(q) and len(m):
                y, m1, m2 = _halves(m["half"]).T, m["h1"].to_numpy(), m["h2"].to_numpy()
                q1, q2 = q["h1"].to_numpy(), q["h2"].to_numpy()
                x, key, keys = _halves(q["half"]), q["alone"].to_numpy(), m["alone"].to_numpy()
                for a in range(0, len(q), 512):
                    s = x[a : a + 512] @ y
                    if threshold is not None:
                        i, j = np.nonzero(s >= threshold - HALF_ERROR)
                    else:
                        own = key[a : a + 512, None]
                        s[(own == keys) & (own != 0)] = -np.inf
                        best = min(k, s.shape[1])
                        j = np.argpartition(-s, best - 1, axis=1)[:, :best]
                        i, j = np.repeat(np.arange(len(s)), best), j.ravel()
                        held = np.isfinite(s[i, j])
                        i, j = i[held], j[held]
                    out.append(pd.DataFrame({"a1": q1[a + i], "a2": q2[a + i], "b1": m1[j], "b2": m2[j], "close": s[i, j]}))
            found = pd.concat(out) if out else pd.DataFrame(columns=["a1", "a2", "b1", "b2", "close"])
            found.insert(0, "space", b["space"].iloc[0])
            return found

        return self.tiles().groupBy("node", "x", "y").applyInPandas(
            rank, "space string, a1 long, a2 long, b1 long, b2 long, close double"
        )

    def exact(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``cosine`` in double precision."""
        side = lambda s: self.classes.select(
            "space", F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("vector").alias(f"v{s}")
        )
        both = pairs.join(side("a"), ["space", "a1", "a2"]).join(side("b"), ["space", "b1", "b2"])

        @F.pandas_udf("double")
        def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
            out = np.empty(len(a))
            lengths = a.map(len).to_numpy()
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                out[rows] = (_units(a.iloc[rows]) * _units(b.iloc[rows])).sum(axis=1)
            return pd.Series(out)

        return both.withColumn("cosine", cosine("va", "vb")).drop("va", "vb")


def similar_classes(index: Index, threshold: float) -> DataFrame:
    """``space, a1, a2, b1, b2, cosine``: each pair of different classes at or above the threshold once."""
    first = (F.col("a1") < F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") < F.col("b2")))
    same = (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))
    flip = lambda s, n: F.when(first, F.col(f"{s}{n}")).otherwise(F.col(f"{'b' if s == 'a' else 'a'}{n}"))
    pairs = index.candidates(threshold, None).where(~same)
    pairs = pairs.select("space", *[flip(s, n).alias(f"{s}{n}") for s in "ab" for n in "12"]).distinct()
    return index.exact(pairs).where(F.col("cosine") >= threshold)


def similar_keys(index: Index, threshold: float) -> DataFrame:
    """``key_a, key_b``: pairs of different keys, smaller first, with vectors at or above the threshold.

    Vectors of one space only are compared. Classes are compared, then their members joined: the
    keys of a class lie in rows of ``KEYS``, and each pair of such rows is spread out for itself, so
    no class is one task. Null, empty and zero vectors and those with a null, a NaN or an infinite
    number have no part. Who wants no pairs within classes takes ``similar_classes`` and ``index.members``.
    """
    place = ["space", "h1", "h2"]
    counts = index.members.groupBy(*place).agg(F.count("*").alias("m"))
    chunk = F.pmod(F.xxhash64("key"), F.ceil(F.col("m") / KEYS)).cast("int")
    rows = index.members.join(counts, place).groupBy(*place, "m", chunk.alias("chunk")).agg(F.collect_list("key").alias("keys"))
    rows = index.ws.table(rows, "keys")
    side = lambda s: rows.select(
        "space", F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("chunk").alias(f"chunk_{s}"),
        F.col("keys").alias(f"keys_{s}"), F.col("m").alias(f"m_{s}"),
    )
    between = similar_classes(index, threshold).drop("cosine")
    between = between.join(side("a"), ["space", "a1", "a2"]).join(side("b"), ["space", "b1", "b2"])
    within = side("a").where("m_a > 1").join(side("b").withColumnsRenamed({"b1": "a1", "b2": "a2"}), ["space", "a1", "a2"]).where("chunk_a <= chunk_b")
    both = between.select("keys_a", "keys_b").unionByName(within.select("keys_a", "keys_b"))
    pairs = both.withColumn("key_a", F.explode("keys_a")).select("key_a", F.explode("keys_b").alias("key_b"))
    return pairs.where(F.col("key_a") != F.col("key_b")).select(
        F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")
    ).distinct()


def nearest(index: Index, k: int) -> DataFrame:
    """``space, h1, h2, rank, near1, near2, near_key, near_keys, cosine``: for each asking class its
    k nearest classes that hold a vector of another key, best first; ties by hash.

    ``near_key`` is the smallest key of the neighbour, ``near_keys`` their number; a class that
    several keys share is its own neighbour with cosine 1.
    """
    about = index.members.groupBy("space", "h1", "h2").agg(
        F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("keys")
    )
    side = lambda s: about.select(
        "space", F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"),
        F.struct("least", "most", "keys").alias(s),
    )
    # Halves of numbers may swap near neighbours, so a few more candidates are compared exactly.
    found = index.candidates(None, k + 5).drop("close").distinct()
    found = found.join(side("a"), ["space", "a1", "a2"]).join(side("b"), ["space", "b1", "b2"])
    alone = (F.col("a.keys") == 1) & (F.col("b.keys") == 1) & (F.col("a.least") == F.col("b.least"))
    found = index.exact(found.where(~alone))
    w = Window.partitionBy("space", "a1", "a2").orderBy(F.desc("cosine"), "b1", "b2")
    return (
        found.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select(
            "space", F.col("a1").alias("h1"), F.col("a2").alias("h2"), "rank", F.col("b1").alias("near1"),
            F.col("b2").alias("near2"), F.col("b.least").alias("near_key"), F.col("b.keys").alias("near_keys"), "cosine",
        )
    )
