"""Set operations on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def universe(tables: list[tuple[DataFrame, str]], name: str, by: list[str] = []) -> DataFrame:
    """Distinct ids that occur in any of the tables' columns; null and empty ones don't count."""
    parts = [t.select(*by, F.col(c).cast("string").alias(name)).where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "") for t, c in tables]
    return reduce(DataFrame.unionByName, parts).distinct()


def append_missing(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base and those rows of new whose keys it hasn't, each row once; doing it again changes nothing."""
    return base.unionByName(new.join(base.select(*keys).distinct(), keys, "left_anti")).distinct()


def missing_from(expected: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(have, keys, "left_anti")


def with_both_ends(edges: DataFrame, nodes: DataFrame, a: str, b: str, key: str, by: list[str] = []) -> DataFrame:
    """Edges whose ends are both among nodes(by, key)."""
    n = nodes.select(*by, key).distinct()
    out = edges
    for end in (a, b):
        out = out.join(n.withColumnRenamed(key, end), [*by, end], "left_semi")
    return out


def in_every_group(df: DataFrame, item: str, group: str) -> DataFrame:
    """Relational division: items that occur in each of the groups."""
    groups = df.agg(F.countDistinct(group).alias("__all"))
    own = df.groupBy(item).agg(F.countDistinct(group).alias("n_groups"))
    return own.crossJoin(F.broadcast(groups)).where(F.col("n_groups") == F.col("__all")).select(item, "n_groups")  # one row


def spread_over_groups(df: DataFrame, item: str, group: str) -> DataFrame:
    """(item, n_groups, kind): in one group only is specific, in several shared."""
    own = df.groupBy(item).agg(F.countDistinct(group).alias("n_groups"))
    return own.withColumn("kind", F.when(F.col("n_groups") >= 2, "shared").otherwise("specific"))


def mapped_share(submitted: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """submitted, mapped and their ratio; 0 where nothing was submitted."""
    ids = submitted.select(key).where(F.col(key).isNotNull()).distinct()
    hit = ids.join(mapped.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    return hit.agg(F.count(F.lit(1)).alias("submitted"), F.count("__hit").alias("mapped")).withColumn("coverage", F.col("mapped") / F.greatest(F.col("submitted"), F.lit(1)))
