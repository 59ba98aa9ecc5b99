"""Hypergraphs: hyperedges as groups of nodes, incidence and Laplacian as sparse tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import CATEGORIES
from .ordering import numbered

#: Nodes of a hyperedge that one key of the Laplacian's join holds at once.
NODES = 500


def members(df: DataFrame, family: str, group: str, node: str, name: str | None = None) -> DataFrame:
    """(strain, type, name, node) of one family, each node once; without an end, no row."""
    label = F.col(group).cast("string") if name is None else F.expr(name)
    out = df.select("strain", F.lit(family).alias("type"), label.alias("name"), F.col(node).cast("string").alias("node"))
    return out.where(F.coalesce(F.col("node"), F.lit("")) != "").where(F.col("name").isNotNull()).distinct()


def triples(aligned: DataFrame) -> DataFrame:
    """Gene, its transcript and its protein, for each row of an aligned table."""
    parts = F.explode(F.array(F.col("gene_id"), F.concat("gene_id", F.lit("_RNA")), F.col("protein_id")))
    return members(aligned.select("strain", "gene_id", parts.alias("node")), "multi_omics_triple", "gene_id", "node")


def triple_features(aligned: DataFrame) -> DataFrame:
    """rna_logfc (0 if missing), protein_logfc, has_rna, agreement (the product; missing without expression)."""
    rna = F.col("RNA_logFC")
    return aligned.select("strain", F.col("gene_id").alias("name"), F.coalesce(rna, F.lit(0.0)).alias("rna_logfc"), F.col("Protein_logFC").alias("protein_logfc"), rna.isNotNull().alias("has_rna"), (rna * F.col("Protein_logFC")).alias("agreement"))


def category_members(gene_category: DataFrame, encodes: DataFrame) -> DataFrame:
    """Genes of a category and their proteins; the name says what the letter stands for."""
    names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    label = F.concat(F.lit("COG_"), F.col("category"), F.lit(": "), F.coalesce(F.try_element_at(names, F.col("category")), F.lit("Unknown")))
    genes = gene_category.select("strain", label.alias("label"), F.col("gene_id").alias("node"), "gene_id")
    proteins = genes.join(encodes.select("strain", "gene_id", "protein_id"), ["strain", "gene_id"]).select("strain", "label", F.col("protein_id").alias("node"))
    return members(genes.select("strain", "label", "node").unionByName(proteins), "cog_category", "label", "node")


def mechanism_members(markers: DataFrame) -> DataFrame:
    """markers(strain, amr_class, locus_tag, protein_id): loci, proteins and the mechanism's own node."""
    label = F.concat("amr_class", F.lit("_resistance"))
    node = F.explode(F.array(F.col("locus_tag"), F.col("protein_id"), F.concat(F.lit("AMR:"), F.col("amr_class"))))
    return members(markers.select("strain", label.alias("label"), node.alias("node")), "amr_mechanism", "label", "node")


def metabolic_members(metabolite_pathway: DataFrame, gene_pathway: DataFrame) -> DataFrame:
    """Metabolites of a pathway and the genes of it."""
    m = metabolite_pathway.select("strain", "pathway", F.col("metabolite_id").alias("node"))
    g = gene_pathway.select("strain", "pathway", F.col("gene_id").alias("node")).join(m.select("strain", "pathway").distinct(), ["strain", "pathway"], "left_semi")
    return members(m.unionByName(g), "metabolic_pathway", "pathway", "node")


def sized(all_members: DataFrame, least: int = 2) -> DataFrame:
    """Members of hyperedges of at least so many nodes; counted by the group, joined back, so that a group is never gathered."""
    n = all_members.groupBy("strain", "type", "name").agg(F.count(F.lit(1)).alias("n_nodes")).where(F.col("n_nodes") >= least)
    return all_members.join(n, ["strain", "type", "name"])


def union(*families: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, families)


def hyperedges(all_members: DataFrame, least: int = 2) -> DataFrame:
    """(strain, type, name, nodes, n_nodes): the nodes joined by ;, for export. Sizes of groups are those of annotations."""
    g = all_members.groupBy("strain", "type", "name").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return g.where(F.size("nodes") >= least).select("strain", "type", "name", F.array_join("nodes", ";").alias("nodes"), F.size("nodes").cast("long").alias("n_nodes"))


def with_ids(edges: DataFrame, family_order: list[str]) -> DataFrame:
    """hyperedge_id within each strain: families in the given order, then names. All are ranked by ranges, and each strain's first rank taken off."""
    place = F.array_position(F.array(*[F.lit(f) for f in family_order]), F.col("type"))
    ranked = numbered(edges, [F.col("strain"), F.when(place == 0, len(family_order) + 1).otherwise(place), F.col("type"), F.col("name")], "__rank")
    first = ranked.groupBy("strain").agg(F.min("__rank").alias("__first"))
    return ranked.join(first, "strain").withColumn("hyperedge_id", F.col("__rank") - F.col("__first")).select(*edges.columns, "hyperedge_id")


def incidence(all_members: DataFrame, edge: list[str], node: str, least: int = 2) -> DataFrame:
    """(node, edge) of hyperedges of at least so many nodes; only their nodes are in it."""
    rows = all_members.select(*edge, node).distinct()
    n = rows.groupBy(*edge).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    return rows.join(n, edge, "left_semi")


def laplacian(inc: DataFrame, edge: list[str], node: str) -> DataFrame:
    """(i, j, value) of Dv^-1/2 H De^-1 H' Dv^-1/2, both triangles and the diagonal, as far as not zero.

    Its size is the sum of the squared sizes of the hyperedges: what is asked for, as any pair that shares one has an entry. A hyperedge's nodes are cut into blocks of about NODES, and a task joins one block with
    another, each unordered pair of blocks once: a hub's pairs are many keys of NODES ** 2 rows instead of one of its size squared. Sums begin on the map side; the lower triangle is the mirrored upper one.
    """
    de = inc.groupBy(*edge).agg(F.count(F.lit(1)).cast("double").alias("de"))
    dv = inc.groupBy(node).agg(F.count(F.lit(1)).cast("double").alias("dv"))
    rows = inc.join(de, edge).join(dv, node).withColumn("__blocks", F.ceil(F.col("de") / NODES).cast("int"))
    rows = rows.select(*edge, F.struct(F.col(node).alias("v"), F.sqrt("dv").alias("d")).alias("n"), "de", "__blocks", F.pmod(F.xxhash64(node), "__blocks").cast("int").alias("__b"))
    left = rows.select(*edge, "de", F.col("n").alias("a"), F.col("__b").alias("__p"), F.explode(F.sequence("__b", F.col("__blocks") - 1)).alias("__q"))
    right = rows.select(*edge, F.col("n").alias("b"), F.explode(F.sequence(F.lit(0), "__b")).alias("__p"), F.col("__b").alias("__q"))
    pairs = left.join(right, [*edge, "__p", "__q"]).where("__p < __q OR a.v <= b.v")
    i, j = F.least("a", "b"), F.greatest("a", "b")
    total = pairs.groupBy(i.alias("i"), j.alias("j")).agg(F.sum(1.0 / F.col("de")).alias("t"))
    upper = total.select(F.col("i.v").alias("i"), F.col("j.v").alias("j"), (F.col("t") / (F.col("i.d") * F.col("j.d"))).alias("value"))
    # both triangles out of one pass over the sums
    ends = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return upper.select(F.explode(ends).alias("x"), "value").select("x.i", "x.j", "value")


def type_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n_hyperedges"), F.avg("n_nodes").alias("mean_size"), F.max("n_nodes").alias("largest"))


def summary(inc: DataFrame, edge: list[str], node: str) -> DataFrame:
    """n_nodes, n_hyperedges, n_incidences, density."""
    s = inc.agg(F.countDistinct(node).alias("n_nodes"), F.countDistinct(*edge).alias("n_hyperedges"), F.count(F.lit(1)).alias("n_incidences"))
    return s.withColumn("density", F.col("n_incidences") / F.greatest(F.lit(1.0), F.col("n_nodes").cast("double") * F.col("n_hyperedges")))


def family_participation(all_members: DataFrame, encodes: DataFrame, families: list[str]) -> DataFrame:
    """(strain, gene_id, a column for each family, hyperedge_participation): whether a gene or its protein is in hyperedges of the family.

    Participation counts the gene's families and its protein's. Members may be loci with gene_ before them or _RNA behind. encodes(strain, gene_id, protein_id) has all genes.
    """
    node = F.col("node")
    plain = F.when(node.startswith("gene_"), F.substring(node, F.lit(6), F.length(node))).when(node.endswith("_RNA"), F.substring(node, F.lit(1), F.length(node) - 4))
    keys = all_members.select("strain", "type", F.explode(F.array_compact(F.array(node, plain))).alias("node")).distinct()
    own = encodes.select("strain", "gene_id").distinct().withColumn("node", F.col("gene_id")).withColumn("side", F.lit("gene"))
    proteins = encodes.where("protein_id is not null").select("strain", "gene_id", F.col("protein_id").alias("node")).distinct().withColumn("side", F.lit("protein"))
    hits = own.unionByName(proteins).join(keys, ["strain", "node"], "left").select("strain", "gene_id", "side", "type").distinct()
    return hits.groupBy("strain", "gene_id").agg(*[F.coalesce(F.max((F.col("type") == f).cast("int")), F.lit(0)).alias(f) for f in families], F.count("type").alias("hyperedge_participation"))
