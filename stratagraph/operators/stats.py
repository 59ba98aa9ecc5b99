"""Comparing a flagged group with the rest: effect sizes, permutation and bootstrap."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .ordering import medians

#: Distinct values (of all strata) up to which the table of counts goes to each task; with more, draws are dealt out to blocks of about BLOCK values first.
DISTINCT, BLOCK = 2_000_000, 200_000


def group_differences(df: DataFrame, value: str, flag: str, by: list[str] = []) -> DataFrame:
    """Means, medians, variances and counts of the flagged and the others, their differences, and Cohen's d."""
    yes, no = F.col(flag), ~F.col(flag)
    pick = lambda c: F.when(c, F.col(value).cast("double"))
    out = df.groupBy(*by).agg(
        F.count(pick(yes)).alias("n_flagged"), F.count(pick(no)).alias("n_other"), F.avg(pick(yes)).alias("mean_flagged"), F.avg(pick(no)).alias("mean_other"),
        F.var_samp(pick(yes)).alias("__va"), F.var_samp(pick(no)).alias("__vb"),
    )
    a, b = F.col("n_flagged") - 1, F.col("n_other") - 1
    pooled = F.sqrt((a * F.col("__va") + b * F.col("__vb")) / (a + b))
    diff = F.col("mean_flagged") - F.col("mean_other")
    middle = medians(df.where(F.col(flag).isNotNull()), [*by, flag], value).groupBy(*by).agg(F.max(F.when(yes, F.col("median"))).alias("median_flagged"), F.max(F.when(no, F.col("median"))).alias("median_other"))
    if by:
        same = [F.col(f"__{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
        out = out.join(middle.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], "median_flagged", "median_other"), reduce(lambda x, y: x & y, same), "left").drop(*[f"__{i}" for i in range(len(by))])
    else:
        out = out.crossJoin(F.broadcast(middle))  # one row each
    return out.withColumn("mean_difference", diff).withColumn("median_difference", F.col("median_flagged") - F.col("median_other")).withColumn("cohens_d", F.when((a > 0) & (b > 0) & (pooled > 0), diff / pooled)).drop("__va", "__vb")


def _counts(df: DataFrame, stratum: str, value: str, flag: str) -> DataFrame:
    """(stratum, value, n, n_flagged): how often each value is there, whose size is that of the distinct values."""
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(stratum).alias("stratum"), F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_flagged"))
    return settle(c, "counts")


def _gathered(counts: DataFrame) -> list[pd.DataFrame]:
    """The counts of each stratum, by value."""
    every = counts.toPandas().sort_values(["stratum", "value"]).reset_index(drop=True)
    return [g for _, g in every.groupby("stratum", sort=True, dropna=False)]


def _drawn(counts: DataFrame, distinct: int, draws: int, seed: int, chunk: int, sides: list[tuple[str, str]], replace: bool) -> DataFrame:
    """(draw, side, s): the sum of what each draw takes from a side, over all strata and blocks.

    sides are pairs of SQL expressions: of how many of a value there are, and how many rows of a block are wanted. Each stratum's wanted rows are dealt over its blocks, then each block's over its values: that is the same
    distribution as one draw over all values, and no task holds more than a block's values. What comes to tasks whole is a row a block. Seeds are those of chunk, stratum and block.
    """
    spark = counts.sparkSession
    blocks = -(-distinct // BLOCK)
    key = F.dense_rank().over(W.orderBy("stratum"))
    names = counts.select("stratum").distinct().withColumn("place", key)  # a row a stratum
    placed = counts.join(F.broadcast(names), counts["stratum"].eqNullSafe(names["stratum"])).select("place", "value", "n", "n_flagged", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int").alias("block"))
    each = [placed.select("place", "block", "value", F.expr(have).alias("have"), F.expr(want).alias("want"), F.lit(k).alias("side")) for k, (have, want) in enumerate(sides)]
    values = settle(reduce(DataFrame.unionByName, each).where("have > 0"), "drawn-from")
    totals = values.groupBy("side", "place", "block").agg(F.sum("have").alias("have"), F.sum("want").alias("want")).toPandas().sort_values(["side", "place", "block"])
    strata = [(int(a), int(b), g["block"].to_numpy(), g["have"].to_numpy(), int(g["want"].sum())) for (a, b), g in totals.groupby(["side", "place"])]

    def pick(rng: np.random.Generator, have: np.ndarray, want: int, size: int | None = None) -> np.ndarray:
        return rng.multinomial(want, have / have.sum(), size=size) if replace else rng.multivariate_hypergeometric(have, want, size=size, method="marginals")

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for c in part["id"].tolist():
                size = min(chunk, draws - c * chunk)
                for side, place, block, have, want in strata:
                    got = pick(np.random.default_rng([seed, c, side, place]), have, want, size)
                    yield pd.DataFrame({"side": side, "place": place, "block": block, "chunk": c, "wanted": list(got.T.copy())})

    n = -(-draws // chunk)
    dealt = spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism))).mapInPandas(deal, "side int, place int, block int, chunk int, wanted array<long>")

    def take(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("value")
        have, value, side, place, block = own["have"].to_numpy(), own["value"].to_numpy(), int(own["side"].iloc[0]), int(own["place"].iloc[0]), int(own["block"].iloc[0])
        out = []
        for c, some in zip(wanted["chunk"].tolist(), wanted["wanted"], strict=True):
            rng = np.random.default_rng([seed, c, side, place, block])
            out += [(c * chunk + i, float(pick(rng, have, int(k)) @ value)) for i, k in enumerate(some)]
        return pd.DataFrame({"draw": [d for d, _ in out], "side": side, "s": [x for _, x in out]})

    keys = ["side", "place", "block"]
    return values.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(take, "draw long, side int, s double").groupBy("draw", "side").agg(F.sum("s").alias("s"))


def permutation_test(df: DataFrame, stratum: str, value: str, flag: str, draws: int = 10_000, seed: int = 42, chunk: int = 500) -> DataFrame:
    """(observed, p_value, draws): the difference of means against draws that pick as many rows as are flagged, within each stratum.

    A draw needs but how many of each value it has: multivariate hypergeometric, from the table of counts, not from the rows. Chunks of draws are
    seeded by their number, so the result doesn't depend on partitions. Strata may have up to 10**9 rows, as numpy draws no more.
    """
    spark = df.sparkSession
    counts = _counts(df, stratum, value, flag)
    distinct, n, k, total, got = counts.agg(F.count(F.lit(1)), F.sum("n"), F.sum("n_flagged"), F.sum(F.col("value") * F.col("n")), F.sum(F.col("value") * F.col("n_flagged"))).first()
    if not n or not 0 < k < n:
        return spark.createDataFrame([(None, None, 0)], "observed double, p_value double, draws int")
    difference = lambda s: s / k - (total - s) / (n - k)
    observed = difference(got)
    if distinct > DISTINCT:
        extreme = F.count_if(F.abs(difference(F.col("s"))) >= abs(observed) - 1e-12)
        out = _drawn(counts, distinct, draws, seed, chunk, [("n", "n_flagged")], False).agg(extreme.alias("b"), F.count(F.lit(1)).cast("int").alias("draws"))
        return out.select(F.lit(observed).alias("observed"), ((F.col("b") + 1) / (F.col("draws") + 1)).alias("p_value"), "draws")
    groups = [(g["value"].to_numpy(), g["n"].to_numpy(), int(g["n_flagged"].sum())) for g in _gathered(counts)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for c in part["id"]:
                rng = np.random.default_rng([seed, int(c)])
                size = min(chunk, draws - int(c) * chunk)
                s = np.zeros(size)
                for values, have, want in groups:
                    if want:
                        s += rng.multivariate_hypergeometric(have, want, size=size, method="marginals") @ values
                yield pd.DataFrame({"extreme": [int((np.abs(difference(s)) >= abs(observed) - 1e-12).sum())], "draws": [size]})

    chunks = spark.range(0, -(-draws // chunk), 1, max(1, min(-(-draws // chunk), spark.sparkContext.defaultParallelism)))
    out = chunks.mapInPandas(run, "extreme long, draws long").agg(F.sum("extreme").alias("b"), F.sum("draws").cast("int").alias("draws"))
    return out.select(F.lit(observed).alias("observed"), ((F.col("b") + 1) / (F.col("draws") + 1)).alias("p_value"), "draws")


def bootstrap_interval(df: DataFrame, stratum: str, value: str, flag: str, draws: int = 2000, level: float = 0.95, seed: int = 42, chunk: int = 250) -> DataFrame:
    """(low, high, draws): percentiles of the difference of means over resamples with replacement, within each stratum and group."""
    spark = df.sparkSession
    counts = _counts(df, stratum, value, flag)
    distinct, n, k = counts.agg(F.count(F.lit(1)), F.sum("n"), F.sum("n_flagged")).first()
    if not n or not 0 < k < n:
        return spark.createDataFrame([(None, None, 0)], "low double, high double, draws int")
    other = n - k
    q = [(1 - level) / 2, 1 - (1 - level) / 2]
    ends = lambda d: d.agg(F.percentile("d", q).alias("q"), F.count(F.lit(1)).cast("int").alias("draws")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "draws")
    if distinct > DISTINCT:
        s = _drawn(counts, distinct, draws, seed, chunk, [("n_flagged", "n_flagged"), ("n - n_flagged", "n - n_flagged")], True)
        return ends(s.groupBy("draw").agg(F.sum(F.when(F.col("side") == 0, F.col("s") / k).otherwise(-F.col("s") / other)).alias("d")))
    parts_ = [(g["value"].to_numpy(), g["n_flagged"].to_numpy(), (g["n"] - g["n_flagged"]).to_numpy()) for g in _gathered(counts)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for c in part["id"]:
                rng = np.random.default_rng([seed, 1, int(c)])
                size = min(chunk, draws - int(c) * chunk)
                sums = np.zeros((2, size))
                for values, *both in parts_:
                    for i, have in enumerate(both):
                        if have.sum():
                            sums[i] += rng.multinomial(int(have.sum()), have / have.sum(), size=size) @ values
                yield pd.DataFrame({"d": sums[0] / k - sums[1] / other})

    chunks = spark.range(0, -(-draws // chunk), 1, max(1, min(-(-draws // chunk), spark.sparkContext.defaultParallelism)))
    return ends(chunks.mapInPandas(run, "d double"))
