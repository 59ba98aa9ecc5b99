"""Replicate measurements in long form: (entity, sample, condition, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import log2_plus_one, regulation
from ..session import settle
from .ordering import medians

#: Groups whose figures go to each task, and keys that a group's rows are dealt to where there are more.
GROUPS, SALTS = 100_000, 32


def to_long(df: DataFrame, ids: list[str], samples: list[str], sample: str = "sample_id", value: str = "value") -> DataFrame:
    """Wide to long; the samples' columns are numbers or all text."""
    return df.unpivot(ids, samples, sample, value)


def with_condition(df: DataFrame, sample: str, conditions: dict[str, list[str]], name: str = "condition") -> DataFrame:
    """Labels samples by explicit lists; samples in no list go."""
    c = F.lit(None).cast("string")
    for label, some in conditions.items():
        c = F.when(F.col(sample).isin(*some), label).otherwise(c)
    return df.withColumn(name, c).where(F.col(name).isNotNull())


def inferred_condition(media: Column, labels: dict[str, str]) -> Column:
    """The label whose keyword the medium's name contains, whatever the case."""
    c = F.lit(None).cast("string")
    for label, word in labels.items():
        c = F.when(F.lower(media).contains(word.lower()), label).otherwise(c)
    return c


def counts_per_million(df: DataFrame, sample: str, value: str, name: str = "cpm") -> DataFrame:
    """value as a share of its sample's total, in millionths; 0 in samples that sum to 0. Totals are joined, as a window would gather a sample in one task."""
    total = df.groupBy(sample).agg(F.sum(value).alias("__total"))
    return df.join(total, sample).withColumn(name, F.when(F.col("__total") > 0, F.col(value) / F.col("__total") * F.lit(1e6)).otherwise(0.0)).drop("__total")


def condition_means(df: DataFrame, entity: list[str], condition: str, value: str, base: str, treated: str, prefix: str, order: str = "plain") -> DataFrame:
    """(entity, <prefix>_<base>, <prefix>_<treated>, <prefix>_logFC).

    order: plain (values are logs already), log_of_mean (log2(mean + 1)) or mean_of_log (mean of log2(x + 1)); the two differ.
    """
    v = log2_plus_one(F.col(value)) if order == "mean_of_log" else F.col(value)
    after = log2_plus_one if order == "log_of_mean" else lambda c: c
    mean = lambda label: after(F.avg(F.when(F.col(condition) == label, v)))
    out = df.groupBy(*entity).agg(mean(base).alias(f"{prefix}_{base}"), mean(treated).alias(f"{prefix}_{treated}"))
    return out.withColumn(f"{prefix}_logFC", F.col(f"{prefix}_{treated}") - F.col(f"{prefix}_{base}"))


def with_regulation(df: DataFrame, change: str, name: str, threshold: float = 1.0, deviations: float = 0.0, by: list[str] = []) -> DataFrame:
    """The call of direction; with deviations > 0 the threshold is so many sample standard deviations of all changes (of each group in by)."""
    if deviations <= 0:
        return df.withColumn(name, regulation(F.col(change), threshold))
    if by:
        t = df.groupBy(*by).agg((F.stddev_samp(change) * deviations).alias("__t"))
        return df.join(t, by, "left").withColumn(name, regulation(F.col(change), F.col("__t"))).drop("__t")
    t = df.agg((F.stddev_samp(change) * deviations).alias("__t"))
    return df.crossJoin(F.broadcast(t)).withColumn(name, regulation(F.col(change), F.col("__t"))).drop("__t")  # one row


def group_means(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def scaled_to_common_median(df: DataFrame, group: str, value: str, name: str = "scaled") -> DataFrame:
    """value times (mean of the groups' medians) / (its group's median); medians are of positive values. Unchanged with fewer than two groups; null in a group without a median."""
    groups = df.select(group).distinct()
    own = settle(groups.join(medians(df.where(F.col(value) > 0), [group], value, "__median"), group, "left"), "medians")
    overall = own.agg(F.avg("__median").alias("__mean"), F.count(F.lit(1)).alias("__groups"))
    scale = own.crossJoin(F.broadcast(overall))  # one row
    out = _with_group(df, scale, group).withColumn(name, F.when(F.col("__groups") < 2, F.col(value)).otherwise(F.col(value) * F.col("__mean") / F.col("__median")))
    return out.drop("__median", "__mean", "__groups")


def _with_group(df: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """df with the columns of groups, one row per group. Up to GROUPS of them go to each task; beyond, a group's rows are dealt to SALTS keys, so that none of it goes to one task."""
    if groups.count() <= GROUPS:
        return df.join(F.broadcast(groups), group)
    dealt = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [group, "__salt"]).drop("__salt")


def merged_entities(df: DataFrame, key: str, order: str, firsts: list[str], means: list[str], sets: dict[str, str], source: str) -> DataFrame:
    """One row per key: means, first values that aren't null, sorted distinct entries as text, and how many sources."""
    aggs = [F.avg(m).alias(m) for m in means]
    aggs += [F.expr(f"min_by(`{c}`, `{order}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in firsts]
    aggs += [F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(name) for name, c in sets.items()]
    return df.groupBy(key).agg(*aggs, F.countDistinct(source).alias("n_sources"))


def regulation_counts(df: DataFrame, call: str, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by, call).agg(F.count(F.lit(1)).alias("n"))


def imputed(df: DataFrame, sample: str, value: str, name: str) -> DataFrame:
    """Missing values become the mean of their sample."""
    means = df.groupBy(sample).agg(F.avg(value).alias("__mean"))
    return df.join(means, sample).withColumn(name, F.coalesce(value, "__mean")).drop("__mean")


def up_down_counts(df: DataFrame, change: str, threshold: float) -> DataFrame:
    return df.agg(F.count_if(F.col(change) > threshold).alias("n_up"), F.count_if(F.col(change) < -threshold).alias("n_down"), F.count(F.lit(1)).alias("n"))
