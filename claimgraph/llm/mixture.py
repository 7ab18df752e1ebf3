"""Mixing sources to target weights by capped water-filling.

Every source is to give its share of the whole, but no source may be repeated more often
than its cap. Sources that cannot reach their share are clamped at the cap, what they
leave open is spread over the others in proportion to their weights, and so on until
nothing is clamped anew.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.session import Workspace

#: Where the public tokenizers' rank files lie, and the one that sizes are counted in.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Target rows that are planned on the driver and sent to every task; more are planned as a table.
MAX_SOURCES = 100_000
#: Over so many rows a source's rate is spread where it is joined.
SALTS = 64

PLAN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target_share", T.DoubleType()),
        T.StructField("max_repeats", T.IntegerType()),
        T.StructField("own_tokens", T.LongType()),
        T.StructField("short", T.BooleanType()),
        T.StructField("clamped", T.BooleanType()),
        T.StructField("repeats", T.DoubleType()),
        T.StructField("planned_tokens", T.DoubleType()),
    ]
)


def source_key(c: Column) -> Column:
    """One spelling of a source: lower case, words joined by an underscore."""
    t = F.regexp_replace(F.lower(c), r"[\s_\-\x{a0}]+", "_")
    return F.regexp_replace(t, r"^_+|_+$", "")


def count_tokens(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of each text under a public byte-pair vocabulary; 0 for null."""
    loaded: list = []

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if not loaded:
            import base64

            import tiktoken

            with open(tokenizer, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            loaded.append(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
        return pd.Series([0 if t is None else len(loaded[0].encode_ordinary(t)) for t in texts], dtype="int64")

    return count(text)


def water_fill(own: list[int], share: list[float], cap: list[int], total: float) -> list[tuple[int, float]]:
    """For each source the pass in which it was clamped (0 for never), and its tokens in a mix of ``total`` tokens.

    The first pass gives every source its own share: who is clamped in it cannot reach that share.
    """
    given = [0.0] * len(own)
    clamped = [0] * len(own)
    n = 0
    while True:
        n += 1
        room = total - sum(g for g, c in zip(given, clamped) if c)
        weight = sum(s for s, c in zip(share, clamped) if not c)
        anew = False
        for i, (o, s, m) in enumerate(zip(own, share, cap)):
            if clamped[i]:
                continue
            # Shares that add up to 1 but for rounding are taken as they are.
            part = s if n == 1 and abs(weight - 1) < 1e-9 else s / weight if weight > 0 else 0.0
            given[i] = max(room, 0.0) * part
            if given[i] > o * m:
                given[i], clamped[i], anew = float(o * m), n, True
        if not anew:
            return list(zip(clamped, given))


def fill_table(sources: DataFrame, total: float | None) -> DataFrame:
    """``water_fill`` over a table of any length: source, target_share, max_repeats, own_tokens, with
    ``clamped`` and ``given``. Only sums of each pass come to the driver."""
    ws = Workspace(sources.sparkSession, "filling")
    reach = F.col("own_tokens") * F.col("max_repeats")
    rows = ws.table(sources.withColumns({"clamped": F.lit(0), "given": F.lit(0.0)}), "pass-0")
    n = 0
    while True:
        n += 1
        open_ = F.col("clamped") == 0
        s = rows.agg(
            F.sum("own_tokens"), F.sum(F.when(~open_, F.col("given"))), F.sum(F.when(open_, F.col("target_share"))), F.count(F.when(~open_, 1))
        ).first()
        room = max((float(s[0] or 0) if total is None else total) - (s[1] or 0.0), 0.0)
        weight = s[2] or 0.0
        scale = 1.0 if n == 1 and abs(weight - 1) < 1e-9 else 1 / weight if weight > 0 else 0.0
        part = F.lit(room) * (F.col("target_share") * scale)
        over = open_ & (part > reach)
        rows = ws.table(
            rows.select(
                "source", "target_share", "max_repeats", "own_tokens",
                F.when(over, reach.cast("double")).when(open_, part).otherwise(F.col("given")).alias("given"),
                F.when(over, F.lit(n)).otherwise(F.col("clamped")).alias("clamped"),
            ),
            f"pass-{n}",
        )
        if rows.where("clamped > 0").count() == s[3]:
            return rows


def sized(documents: DataFrame, key: Column, source: Column, text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, source, tokens`` of each row; the source in its one spelling."""
    return documents.select(
        key.alias("key"), source_key(source).alias("source"), count_tokens(text, tokenizer).alias("tokens")
    )


def plan_mix(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per target: ``source, target_share, max_repeats, own_tokens, short, clamped,
    repeats, planned_tokens``.

    ``sizes``: source (one spelling), tokens. ``targets``: source, target_share, max_repeats.
    ``total`` is the size of the mix; by default all tokens of the listed sources, each once.
    ``short``: the first pass of the filling clamps the source, as its share is beyond its cap.
    ``repeats`` says how often each of its documents is taken on average. A source without
    documents has 0 tokens and is clamped at 0. Null sizes count 0; null shares and caps count
    0; documents of null or unlisted sources take no part; targets of a null source are left
    out; several targets of one source raise ValueError. More than ``MAX_SOURCES`` targets are
    filled as a table instead of on the driver, with the same result.
    """
    named = targets.where(F.col("source").isNotNull()).select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
        source_key(F.col("source")).alias("spelled"),
    )
    rows = named.limit(MAX_SOURCES + 1).collect()
    many = len(rows) > MAX_SOURCES
    if named.groupBy("spelled").count().where("count > 1").limit(1).count() if many else len({r[3] for r in rows}) < len(rows):
        raise ValueError("a source has several targets")
    spark = sizes.sparkSession
    listed = named.select(F.col("spelled").alias("source")) if many else F.broadcast(spark.createDataFrame([(r[3],) for r in rows], "source string"))
    counted = sizes.join(listed, "source", "left_semi").groupBy("source").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))
    if many:
        sources = named.join(counted.withColumnsRenamed({"source": "spelled"}), "spelled", "left").select(
            "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).cast("long").alias("own_tokens")
        )
        filled = fill_table(sources, total)
        repeats = F.when(F.col("own_tokens") > 0, F.col("given") / F.col("own_tokens")).otherwise(0.0)
        return filled.select(
            "source", "target_share", F.col("max_repeats").cast("int").alias("max_repeats"), "own_tokens", (F.col("clamped") == 1).alias("short"),
            (F.col("clamped") > 0).alias("clamped"), repeats.alias("repeats"), F.col("given").alias("planned_tokens"),
        )
    held = {r[0]: int(r[1] or 0) for r in counted.collect()}
    own = [held.get(r[3], 0) for r in rows]
    whole = float(sum(own)) if total is None else float(total)
    filled = water_fill(own, [r[1] for r in rows], [r[2] for r in rows], whole)
    out = [(r[0], r[1], r[2], o, c == 1, c > 0, g / o if o else 0.0, g) for r, o, (c, g) in zip(rows, own, filled)]
    return spark.createDataFrame(out, PLAN)


def draw_mix(sizes: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """``key, source, tokens, copy``: each document as often as its source is repeated.

    A source repeated 2.3 times gives every document twice, and a third time those whose
    seeded hash falls into the first 0.3. A plan of more than ``MAX_SOURCES`` rows is joined
    over salts, so that a source of any size is spread.
    """
    rates = plan.select(source_key(F.col("source")).alias("source"), "repeats")
    on = ["source"]
    if plan.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        on = ["source", "salt"]
        rates = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sizes = sizes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    else:
        rates = F.broadcast(rates)
    unit = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("repeats")
    times = (whole + F.when(unit < F.col("repeats") - whole, 1).otherwise(0)).cast("int")
    drawn = sizes.join(rates, on).withColumn("times", times).where(F.col("times") > 0)
    return drawn.select("key", "source", "tokens", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))


def mix_report(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with the tokens and the share that the drawn mix really has of each source."""
    got = mix.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens")).withColumnRenamed("source", "spelled")
    joined = plan.join(got, source_key(F.col("source")) == F.col("spelled"), "left").drop("spelled")
    joined = joined.withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    whole = joined.agg(F.sum("mixed_tokens").alias("whole"))
    return joined.crossJoin(F.broadcast(whole)).withColumn(
        "actual_share", F.when(F.col("whole") > 0, F.col("mixed_tokens") / F.col("whole")).otherwise(0.0)
    ).drop("whole")


def mixture(
    documents: DataFrame, key: Column, source: Column, text: Column, targets: DataFrame, seed: int = 0,
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report; see ``draw_mix`` and ``mix_report``. Texts are tokenized once."""
    ws = Workspace(documents.sparkSession, "mixture")
    sizes = ws.table(sized(documents, key, source, text, tokenizer), "sizes")
    plan = plan_mix(sizes, targets)
    mix = draw_mix(sizes, plan, seed)
    return mix, mix_report(mix, plan)
