"""Correlation edges among entities measured in the same samples, for any number of groups (strains, plates, ...) in one plan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle

#: Entities of a tile: a task multiplies one tile with another, 8 * BLOCK ** 2 bytes of correlations at once.
BLOCK = 2000
#: Tiles of a block, at most. A task has two blocks, so an entity's values go to a task for each block of its group.
TILES = 8
#: Bytes of values in a block, at most, where a tile has fewer.
BLOCK_BYTES = 64 << 20
DIGITS = 10
#: More than rounding to DIGITS changes.
SLACK = 1e-9


def standardised(df: DataFrame, entity: str, sample: str, value: str, least_samples: int = 3, by: list[str] = []) -> DataFrame:
    """(by, entity, z): values over all samples of the group, in their order, missing ones at the sample's mean, centred and of unit length.

    Entities that don't vary are left out, and all of a group are if it has fewer samples than least_samples.
    """
    samples = df.groupBy(*by, sample).agg(F.avg(value).alias("__mean"))
    listed = samples.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("s"), F.col("__mean").alias("m")))).alias("__all"))  # samples, not entities
    own = df.where(F.col(entity).isNotNull()).groupBy(*by, entity).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(value).cast("double").alias("v")))).alias("__v"))
    both = (own.join(listed, by) if by else own.crossJoin(F.broadcast(listed))).where(F.size("__all") >= least_samples)  # without groups, one row
    # entities that have all samples need no lookup
    complete = (F.size("__v") == F.size("__all")) & F.forall("__v", lambda p: p["v"].isNotNull())
    known = F.map_from_entries(F.transform("__v", lambda p: F.struct(p["s"], p["v"])))
    x = F.when(complete, F.transform("__v", lambda p: p["v"])).otherwise(F.transform("__all", lambda s: F.coalesce(F.try_element_at(known, s["s"]), s["m"])))
    zero = F.lit(0.0)
    both = both.withColumn("__x", x).withColumn("__c", F.aggregate("__x", zero, lambda a, b: a + b) / F.size("__x"))
    both = both.withColumn("__d", F.transform("__x", lambda v: v - F.col("__c"))).withColumn("__n", F.sqrt(F.aggregate("__d", zero, lambda a, b: a + b * b)))
    return both.where(F.col("__n") > 1e-12).select(*by, entity, F.transform("__d", lambda v: v / F.col("__n")).alias("z"))


def _strongest(own: np.ndarray, strong: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs are among the k strongest of own; ties go to the smaller other."""
    order = np.lexsort((other, -strong, own))
    sorted_ = own[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_, side="left")
    return order[rank < k]


def _block(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """ids in their order, and their rows of z."""
    ids = table.column("id").combine_chunks()
    order = pc.sort_indices(ids)
    z = table.column("z").combine_chunks().take(order)
    width = len(z[0]) if len(z) else 0
    return ids.take(order), z.flatten().to_numpy().reshape(len(z), width)


def _pairs(a: np.ndarray, b: np.ndarray, same: bool, pa_: np.ndarray, pb: np.ndarray, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, other, r) of two blocks whose rows have the places pa_ and pb, tile by tile: each pair once or, with k, the k strongest others of each place of either side."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # with k, the k-th strongest of each place so far: what is weaker for both of its places is among no k strongest
    weakest = np.full(len(pa_) if same else len(pa_) + len(pb), threshold)
    held, new = 0, 0
    tile, size, above = (np.empty(min(BLOCK, len(a)) * min(BLOCK, len(b)), kind) for kind in (float, float, bool))
    for i in range(0, len(a), BLOCK):
        for j in range(i if same else 0, len(b), BLOCK):
            x, y = a[i : i + BLOCK], b[j : j + BLOCK]
            r = np.matmul(x, y.T, out=tile[: len(x) * len(y)].reshape(len(x), len(y)))
            strong = np.abs(r, out=size[: r.size].reshape(r.shape))
            if same and i == j:
                strong[np.tril_indices(len(r))] = -1.0
            rows, columns = weakest[pa_[i : i + BLOCK]], weakest[pb[j : j + BLOCK]]
            if k and not (same and i == j):
                # where few are known yet, a place's k-th strongest of this tile
                if strong.shape[1] > k and (few := rows <= threshold).any():
                    rows[few] = np.fmax(threshold, np.partition(strong[few], -k, axis=1)[:, -k])
                if strong.shape[0] > k and (few := columns <= threshold).any():
                    columns[few] = np.fmax(threshold, np.partition(np.ascontiguousarray(strong.T[few]), -k, axis=1)[:, -k])
            # a rounded r may be as strong as a limit that r is below by half a digit
            if not k:
                x, y = np.divmod(np.flatnonzero(strong >= threshold - SLACK), strong.shape[1])
                value = np.round(r[x, y], DIGITS)
                enough = np.abs(value) >= threshold
                found.append((pa_[i + x[enough]], pb[j + y[enough]], value[enough]))
                continue
            for limit, turned in ((rows[:, None], False), (columns[None], True)):
                x, y = np.divmod(np.flatnonzero(np.greater_equal(strong, limit - SLACK, out=above[: r.size].reshape(r.shape))), strong.shape[1])
                value = np.round(r[x, y], DIGITS)
                enough = np.abs(value) >= threshold
                own, other, value = pa_[i + x[enough]], pb[j + y[enough]], value[enough]
                found.append((other, own, value) if turned else (own, other, value))
                new += len(own)
            if new > held // 4:
                found = [_kept(*(np.concatenate(c) for c in zip(*found, strict=True)), k)]
                at, first, n = np.unique(found[0][0], return_index=True, return_counts=True)  # sorted by place, strongest first
                weakest[at[n == k]] = np.abs(found[0][2][first[n == k] + k - 1])
                held, new = len(found[0][0]), 0
    if k and found:
        found = [_kept(*(np.concatenate(c) for c in zip(*found, strict=True)), k)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _kept(own: np.ndarray, other: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep = _strongest(own, np.abs(r), other, k)
    return own[keep], other[keep], r[keep]


def _partners(z: DataFrame, entity: str, by: list[str], threshold: float, k: int) -> DataFrame:
    """(by, entity, other, r) of |r| >= threshold: each pair once as entity < other, or, with k, the k strongest partners of each entity.

    Each group is cut into blocks of up to TILES tiles of BLOCK entities, eight blocks at least where tiles allow, and each unordered pair of blocks is one task's product, tile by tile. With k a task finds the k strongest of each of its rows and of its columns, as both
    have the task's whole part of their partners; what the tasks of an entity found is ranked again, k rows a task, of which Spark keeps k before it shuffles them.
    """
    kind = z.schema[entity].dataType.simpleString()
    z = settle(z, "standardised")
    tiles = F.ceil(F.count(F.lit(1)) / F.lit(BLOCK))
    room = F.greatest(F.lit(1), F.least(F.lit(TILES), F.floor(F.lit(BLOCK_BYTES) / (F.max(F.size("z")) * 8 * BLOCK))))
    sizes = z.groupBy(*by).agg(F.greatest(F.ceil(tiles / room), F.least(tiles, F.lit(8))).cast("int").alias("__blocks"))
    sized = z.join(sizes, by) if by else z.crossJoin(F.broadcast(sizes))  # a row per group
    numbered = sized.withColumn("__b", F.pmod(F.xxhash64(entity), "__blocks").cast("int"))
    met = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__c")
    rows = numbered.select(*by, "__b", F.col(entity).alias("id"), "z", met).select(*by, F.least("__b", "__c").alias("__p"), F.greatest("__b", "__c").alias("__q"), (F.col("__b") > F.col("__c")).alias("right"), "id", "z")
    keys = [*by, "__p", "__q"]

    def multiply(table: pa.Table) -> pa.Table:
        first, second = table.column("__p")[0].as_py(), table.column("__q")[0].as_py()
        side = table.column("right")
        ids_a, a = _block(table.filter(pc.invert(side)), "a")
        ids_b, b = (ids_a, a) if first == second else _block(table.filter(side), "b")
        # places in the order of both blocks' ids, so that ties are cut as the ranking of all cuts them
        every = pa.concat_arrays([ids_a, ids_b]) if first != second else ids_a
        place = np.empty(len(every), np.int64)
        place[pc.sort_indices(every).to_numpy()] = np.arange(len(every))
        shift = len(ids_a) if first != second else 0
        own, other, r = _pairs(a, b, first == second, place[: len(a)], place[shift:], threshold, k)
        at = np.empty(len(every), np.int64)
        at[place] = np.arange(len(every))
        left, right = every.take(pa.array(at[own])), every.take(pa.array(at[other]))
        named = {c: pa.repeat(table.column(c)[0], len(left)) for c in by}
        return pa.table(named | {entity: left, "other": right, "r": pa.array(r, pa.float64())})

    schema = ", ".join([*(f"`{c}` {z.schema[c].dataType.simpleString()}" for c in by), f"`{entity}` {kind}", f"other {kind}", "r double"])
    found = rows.groupBy(*keys).applyInArrow(multiply, schema)
    if not k:
        return found.select(*by, F.least(entity, "other").alias(entity), F.greatest(entity, "other").alias("other"), "r")
    w = W.partitionBy(*by, entity).orderBy(F.desc(F.abs("r")), "other")
    return found.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def correlation_edges(df: DataFrame, entity: str, sample: str, value: str, threshold: float = 0.7, top_k: int = 0, mode: str = "either", least_samples: int = 3, by: list[str] = []) -> DataFrame:
    """(by, a, b, r) with a < b of the pairs of one group with |r| >= threshold, rounded to DIGITS digits.

    With top_k, a pair has to be among the top_k - 1 strongest of one of the two (mode either) or of both (mutual): an entity's own place counts as one. All groups are one plan: neither
    jobs nor tasks' sizes follow their number, and nothing is collected. Rows whose group has a null belong to no group.
    """
    ends: list[Column] = [F.least(entity, "other").alias("a"), F.greatest(entity, "other").alias("b")]
    p = _partners(standardised(df, entity, sample, value, least_samples, by), entity, by, threshold, max(1, top_k - 1) if top_k else 0)
    if not top_k:
        return p.select(*by, *ends, "r")
    pairs = p.select(*by, *ends, "r").groupBy(*by, "a", "b").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("__sides"))
    if mode == "mutual":
        pairs = pairs.where(F.col("__sides") == 2)
    return pairs.select(*by, "a", "b", "r")
