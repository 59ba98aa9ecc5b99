"""Ordering-dependent operators: neighbours, first and last rows, best rows, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import proximity_weight
from ..session import settle
from .ordering import in_ranges, numbered


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by the given order, which has to be total. Aggregates before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ranked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return ranked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ranked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return ranked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def first_occurrences(df: DataFrame, key: str, position: str) -> DataFrame:
    """(key, position): distinct keys by where they occur first; null and empty ones don't count."""
    return df.where(F.coalesce(F.trim(key), F.lit("")) != "").groupBy(F.trim(key).alias(key)).agg(F.min(position).alias(position))


def best_match(df: DataFrame, key: str, candidate: str, merits: list[str]) -> DataFrame:
    """(key, candidate): that with the largest merits in order, the largest id last."""
    return df.groupBy(key).agg(F.max_by(candidate, F.struct(*merits, candidate)).alias(candidate))


def first_non_null(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """The first value of each column that isn't null, by an ordering column."""
    return df.groupBy(*keys).agg(*[F.expr(f"min_by(`{c}`, `{order}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in columns])


def sequential_neighbours(df: DataFrame, group: list[str], start: str, end: str, entity: str, most: int) -> DataFrame:
    """(group, <entity>_a, <entity>_b, distance, weight) of rows that follow each other at a distance of 1 to most.

    Overlapping neighbours have no edge and aren't bridged. Groups are scanned by ranges: the last row of a range is followed by the first one of the next range that has its group.
    """
    ranges = in_ranges(df.select(*group, start, end, entity), group, list(dict.fromkeys([start, end, entity])))
    row = F.struct(*ranges.order)
    first = ranges.borders(F.min(row).alias("__first"))
    after = first.select("__part", *group, F.lead("__first").over(W.partitionBy(*group).orderBy("__part")).alias("__after"))  # two rows a range
    both = ranges.passed(ranges.rows.withColumn("__next", F.lead(row).over(ranges.window())), after).withColumn("__next", F.coalesce("__next", "__after"))
    d = F.col("__next")[start] - F.col(end)
    out = both.select(*group, F.col(entity).alias(f"{entity}_a"), F.col("__next")[entity].alias(f"{entity}_b"), d.cast("long").alias("distance"))
    return out.where((F.col("distance") > 0) & (F.col("distance") <= most)).withColumn("weight", proximity_weight(F.col("distance")))


def dedup_pairs(df: DataFrame, a: str, b: str, score: str, order: list[str], by: list[str] = []) -> DataFrame:
    """Undirected pairs once each, with the row of the largest score, the first of those; a pair comes out ordered."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    rest = [c for c in df.columns if c not in (a, b, *by)]
    ranked = df.groupBy(*by, lo.alias(a), hi.alias(b)).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), *order)).alias("__row"))
    return ranked.select(*by, a, b, *[F.col("__row")[c].alias(c) for c in rest])


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")


def top_with_one_per_type(df: DataFrame, kind: str, score: str, key: str, n: int) -> DataFrame:
    """The n rows of the largest score and, of each type, at least its best one."""
    order = [F.desc(score), F.asc(key)]
    return df.orderBy(*order).limit(n).unionByName(keep_first(df, [kind], [(-F.col(score)).alias("s"), F.col(key)]).select(*df.columns)).distinct()


def extremes(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n largest and the n smallest, marked by side; missing scores aren't among them."""
    some = df.where(F.col(score).isNotNull())
    high = some.orderBy(F.desc(score), key).limit(n).withColumn("side", F.lit("largest"))
    return high.unionByName(some.orderBy(F.asc(score), key).limit(n).withColumn("side", F.lit("smallest")))


def node_index(nodes: DataFrame, kind: str, key: str) -> DataFrame:
    """nodes with idx: 0, 1, ... within each type, by id. The whole table is ranked by ranges, and each type's first rank taken off."""
    ranked = numbered(nodes, [F.col(kind), F.col(key)], "__rank")
    first = ranked.groupBy(kind).agg(F.min("__rank").alias("__first"))  # a row per type
    return ranked.join(F.broadcast(first), kind).withColumn("idx", F.col("__rank") - F.col("__first")).select(*nodes.columns, "idx")


def filled_forward(df: DataFrame, group: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The last value that isn't null so far. Groups are scanned by ranges: what a range has found last is passed on to the next ones of its group."""
    ranges = in_ranges(df, group, order)
    own = F.last(column, ignorenulls=True).over(ranges.window().rowsBetween(W.unboundedPreceding, 0))
    there = F.col(column).isNotNull()
    ends = ranges.borders(F.max_by(F.when(there, F.col(column)), F.when(there, F.struct(*order))).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # two rows a range
    carried = ranges.passed(ranges.rows.withColumn("__own", own), ends.select("__part", *group, before.alias("__before")))
    return carried.select(*df.columns, F.coalesce("__own", "__before").alias(name))


def bh_adjust(df: DataFrame, p: str, key: list[str], name: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg: p * m / rank, the least of that from here to the largest p, 1 at most; missing p stay missing.

    Ranks come from a sort by ranges and the running minimum from that of each range, so no task sees the whole table.
    """
    there = numbered(df.where(F.col(p).isNotNull()), [F.col(p), *[F.col(k) for k in key]], "__rank")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = there.agg(F.count(F.lit(1)).alias("__m"))
    raw = settle(there.crossJoin(F.broadcast(m)).withColumn("__raw", F.col(p) * F.col("__m").cast("double") / F.col("__rank")))
    block = F.floor((F.col("__rank") - 1) * F.lit(parts) / F.col("__m"))
    raw = raw.withColumn("__block", block)
    least = raw.groupBy("__block").agg(F.min("__raw").alias("__own"))
    later = least.select("__block", F.min("__own").over(W.orderBy(F.desc("__block")).rowsBetween(W.unboundedPreceding, -1)).alias("__later"))  # a row per block
    within = F.min("__raw").over(W.partitionBy("__block").orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, 0))
    done = raw.withColumn("__within", within).join(F.broadcast(later), "__block").withColumn(name, F.least(F.lit(1.0), F.least("__within", F.coalesce("__later", "__within"))))
    return done.select(*df.columns, name).unionByName(df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))
