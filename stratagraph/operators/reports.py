"""Small tables that reports and figures are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle

#: Strains' types that a dashboard marks as bits of one number.
MASKED = 64


def pivot_counts(df: DataFrame, row: str, column: str, labels: list[str]) -> DataFrame:
    """A row per row, and how many of each label; labels that don't occur are 0."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in labels])


def presence_matrix(df: DataFrame, row: str, column: str, labels: list[str]) -> DataFrame:
    return df.groupBy(row).agg(*[F.coalesce(F.max((F.col(column) == v).cast("int")), F.lit(0)).alias(str(v)) for v in labels])


def support_matrix(df: DataFrame, row: str, status: dict[str, str]) -> DataFrame:
    """status columns as 1 (observed), 0 (unavailable) and 0.5 (not observed)."""
    value = lambda c: F.when(F.col(c) == "observed", 1.0).when(F.col(c) == "unavailable", 0.0).otherwise(0.5)
    return df.select(row, *[value(c).alias(name) for name, c in status.items()])


def preferred_then_filled(df: DataFrame, name: str, preferred: list[str], order: list[Column], n: int) -> DataFrame:
    """The preferred rows in their order, then others by order, n in all."""
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]).cast("array<string>"), F.col(name))
    return df.orderBy(F.when(place > 0, place).otherwise(len(preferred) + 1), *order).limit(n)


def specific_hubs(members: DataFrame, seeds: DataFrame, hub: str, node: str, seed: str, measured: str, most_hubs: int = 12, largest: int = 60, most_members: int = 5) -> DataFrame:
    """(seed, hub, node): around each of seeds(seed, node) the smallest hubs of at most largest members, and of each a few members, measured ones first."""
    size = members.groupBy(hub).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= largest)
    near = members.select(hub, node).join(seeds.select(seed, node), node).select(seed, hub).distinct().join(size, hub)
    chosen = near.withColumn("__r", F.row_number().over(W.partitionBy(seed).orderBy("__n", hub))).where(F.col("__r") <= most_hubs).select(seed, hub)
    around = chosen.join(members.select(hub, node, measured), hub).join(seeds.select(seed, node), [seed, node], "left_anti")
    w = W.partitionBy(seed, hub).orderBy(F.desc(measured), node)
    return around.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most_members).select(seed, hub, node)


def representatives(edges: DataFrame, family: str, name: str, size: str, preferred: list[str], least: int = 3) -> DataFrame:
    """One hyperedge per family: a preferred one, else the smallest of at least so many nodes."""
    wanted = F.when(F.col(name).isin(*preferred), 0).otherwise(1) if preferred else F.lit(1)
    some = edges.where((F.col(size) >= least) | (wanted == 0))
    return some.groupBy(family).agg(F.min_by(F.struct(name, size), F.struct(wanted.alias("w"), size, name)).alias("r")).select(family, f"r.{name}", f"r.{size}")


def uncovered(expected: DataFrame, drawn: DataFrame, keys: list[str]) -> DataFrame:
    """What a drawing lacks; it is complete if this is empty."""
    return expected.select(*keys).distinct().join(drawn, keys, "left_anti")


def marker_report(markers: DataFrame, categories: DataFrame, pathways: DataFrame, ppi: DataFrame, genes: DataFrame, aligned: DataFrame) -> DataFrame:
    """A row per marker and locus: its categories, how many pathways, neighbours of the marker's first protein, in the genome, in the aligned table."""
    key = ["strain", "locus_tag"]
    cats = categories.groupBy("strain", F.col("gene_id").alias("locus_tag")).agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("cog"))
    paths = pathways.groupBy("strain", F.col("gene_id").alias("locus_tag")).agg(F.countDistinct("pathway").alias("n_kegg_pathways"))
    both = ppi.select("strain", "a", "b").unionByName(ppi.select("strain", F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("strain", F.col("a").alias("protein_id")).agg(F.countDistinct("b").alias("n_ppi_neighbors"))
    flag = lambda t, name: t.select("strain", F.col("gene_id").alias("locus_tag")).distinct().withColumn(name, F.lit(True))
    out = markers.join(cats, key, "left").join(paths, key, "left").join(near, ["strain", "protein_id"], "left").join(flag(genes, "in_genome"), key, "left").join(flag(aligned, "in_aligned"), key, "left")
    return out.fillna(0, ["n_kegg_pathways", "n_ppi_neighbors"]).fillna(False, ["in_genome", "in_aligned"]).fillna("", ["cog"])


def edge_rows(edges: DataFrame) -> DataFrame:
    """(strain, kind, type, id): each edge as one row of its relation and two of its ends, out of one scan."""
    row = lambda kind, type_, id_: F.struct(F.lit(kind).alias("kind"), type_.alias("type"), id_.alias("id"))
    label = F.concat_ws("\t", "src", "relation", "dst")
    each = F.array(row("edge", F.col("relation"), label), row("node", F.col("src_type"), F.col("src")), row("node", F.col("dst_type"), F.col("dst")))
    return edges.select("strain", F.explode(each).alias("x")).select("strain", "x.*")


def member_rows(members: DataFrame) -> DataFrame:
    """(strain, kind, type, id): each membership as one row of its hyperedge and one of its node."""
    row = lambda kind, id_: F.struct(F.lit(kind).alias("kind"), F.col("type"), id_.alias("id"))
    return members.select("strain", F.explode(F.array(row("hyperedge", F.col("name")), row("member", F.col("node")))).alias("x")).select("strain", "x.*")


def dashboard(rows: DataFrame) -> DataFrame:
    """(strain, kind, type, level, n, n_distinct) of rows(strain, kind, type, id): rows and distinct ids of each type and strain, each strain, each type of all strains, and each kind.

    level tells a total's null from a missing value: 0 for a strain's type, 1 for a strain, 4 for a type, 5 for a kind. Rows are counted by strain, kind and type first. Where there are
    up to MASKED of these, each is a bit, and each id is grouped once for all levels, with the bits that it occurs in; else all of it are grouping sets over one scan.
    """
    keys = ["strain", "kind", "type"]
    each = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "totals")
    if each.limit(MASKED + 1).count() > MASKED:
        sets = [keys, ["strain", "kind"], ["kind", "type"], ["kind"]]
        out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_distinct"))
        return out.select(*keys, F.col("level").cast("int").alias("level"), "n", "n_distinct")
    bits, totals = [], {}
    for i, (strain, kind, type_, n) in enumerate(each.collect()):
        bit = 1 << i if i < 63 else -(1 << 63)
        bits.append((strain, kind, type_, bit))
        for total in ((strain, kind, type_, 0), (strain, kind, None, 1), (None, kind, type_, 4), (None, kind, None, 5)):
            mask, so_far = totals.get(total, (0, 0))
            totals[total] = (mask | bit, so_far + n)
    spark = rows.sparkSession
    names = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    own = spark.createDataFrame(bits, f"{names}, bit long").select(*[F.col(k).alias(f"__{k}") for k in keys], "bit")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    marked = rows.where(F.col("id").isNotNull()).join(F.broadcast(own), same).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    seen = marked.groupBy("bits").agg(F.count(F.lit(1)).alias("ids")).unionByName(spark.range(1).select(F.lit(0).cast("long").alias("bits"), F.lit(0).cast("long").alias("ids")))
    wanted = spark.createDataFrame([(*k, *v) for k, v in totals.items()], f"{names}, level int, mask long, n long")
    return seen.crossJoin(F.broadcast(wanted)).groupBy(*keys, "level", "n").agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("mask")) != 0, F.col("ids")).otherwise(0)).alias("n_distinct"))


def checked_claims(metrics: DataFrame, claims: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """claims(metric, strain, relation, published) with the value of metrics(metric, strain, relation, value), the difference and a verdict: agrees, differs, or not found.

    Empty and missing strains and relations are the same. A difference counts beyond tolerance times the published value.
    """
    keys = ["metric", "strain", "relation"]
    plain = lambda t, v: t.select(*[F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")).alias(k) for k in keys], F.col(v).cast("double").alias(v))
    own = plain(metrics, "value").groupBy(*keys).agg(F.max("value").alias("value"))
    both = plain(claims, "published").join(own, keys, "left")
    gap = F.col("value") - F.col("published")
    near = F.abs(gap) <= F.abs(F.col("published")) * tolerance + 1e-9
    return both.select(*keys, "published", "value", gap.alias("difference"), F.when(F.col("value").isNull(), "not found").when(near, "agrees").otherwise("differs").alias("verdict"))


def contrast(rows: DataFrame, by: str, group: str, labels: tuple[str, str], features: list[str]) -> DataFrame:
    """(by, feature, and for each of two labels of group its mean and number) where both have rows."""
    a, b = labels
    each = rows.where(F.col(group).isin(a, b)).unpivot([by, group], features, "feature", "value")
    here = lambda label: F.col(group) == label
    out = each.groupBy(by, "feature").agg(*[f(F.when(here(x), F.col("value"))).alias(f"{name}_{x}") for x in labels for name, f in (("mean", F.avg), ("n", F.count))])
    return out.where((F.col(f"n_{a}") > 0) & (F.col(f"n_{b}") > 0))


def pair_summary(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Edges, distinct ends on either side, and the mean score."""
    return pairs.agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(pairs.select(F.explode(F.array(a, b)).alias("x")).agg(F.countDistinct("x").alias("n_nodes"))).crossJoin(pairs.agg(F.avg(score).alias("mean_score")))  # one row each
