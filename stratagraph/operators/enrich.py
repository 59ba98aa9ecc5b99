"""Adding to a finished graph and hypergraph what is known of its determinants: missing edges, memberships, and annotations found later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_accession, listed
from . import graph
from .sets import append_missing

#: What tells edges apart: all but their weight.
EDGE_KEY = ["strain", "src_type", "relation", "dst_type", "src", "dst"]


def by_either_form(rows: DataFrame, accession: str, table: DataFrame, key: str) -> DataFrame:
    """rows with those of table whose key is the accession as it is or without its version, each once."""
    both = F.array_distinct(F.array_compact(F.array(F.trim(accession), canonical_accession(F.col(accession)))))
    return rows.withColumn("__form", F.explode(both)).join(table.withColumnRenamed(key, "__form"), "__form").drop("__form").distinct()


def by_canonical_form(rows: DataFrame, accession: str, table: DataFrame, key: str, by: list[str] = []) -> DataFrame:
    """rows with those of table (of the same by) whose key is the same accession, whichever of the two has a version."""
    own = rows.withColumn("__form", canonical_accession(F.col(accession)))
    return own.join(table.withColumn("__form", canonical_accession(F.col(key))), [*by, "__form"]).drop("__form")


def recovered_terms(recovery: DataFrame) -> DataFrame:
    """recovery(accession, go_terms as a ; list) -> (accession, go_id)."""
    return recovery.where(F.coalesce(F.trim("accession"), F.lit("")) != "").select(F.trim("accession").alias("accession"), F.explode(listed(F.col("go_terms"), ";")).alias("go_id")).distinct()


def _terms(determinants: DataFrame, categories: DataFrame, pathways: DataFrame, recovered: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(strain, gene_id, protein_id, category), the same with pathway and with go_id, of determinants(strain, gene_id, protein_id).

    categories and pathways are keyed by accessions without version, recovered by either form.
    """
    d = determinants.select("strain", "gene_id", "protein_id").where("gene_id is not null").distinct()
    keyed = d.withColumn("accession", canonical_accession(F.col("protein_id")))
    return keyed.join(categories, "accession").drop("accession"), keyed.join(pathways, "accession").drop("accession"), by_either_form(d.where("protein_id is not null"), "protein_id", recovered, "accession")


def enriched_edges(edges: DataFrame, determinants: DataFrame, categories: DataFrame, pathways: DataFrame, recovered: DataFrame, neighbours: DataFrame) -> DataFrame:
    """edges and, of the determinants, those that are missing: encodes, cog_category, in_pathway, annotated_by, genomic_proximity.

    categories(accession, category), pathways(accession, pathway), recovered(accession, go_id), neighbours(strain, gene_a, gene_b) of the whole genome; a neighbour
    counts only if the graph has it. Doing it again changes nothing.
    """
    cats, paths, terms = _terms(determinants, categories, pathways, recovered)
    either = neighbours.select("strain", F.col("gene_a").alias("gene_id"), F.col("gene_b").alias("other")).unionByName(neighbours.select("strain", F.col("gene_b").alias("gene_id"), F.col("gene_a").alias("other")))
    near = determinants.select("strain", "gene_id").distinct().join(either, ["strain", "gene_id"]).where("other <> gene_id")
    near = near.join(graph.nodes_of(edges).select("strain", F.col("node_id").alias("other")).distinct(), ["strain", "other"], "left_semi").distinct()
    new = graph.union(
        graph.edges(determinants.select("strain", "gene_id", "protein_id").distinct(), "gene_id", "protein_id", "gene", "encodes", "protein"),
        graph.functional_edges(cats, "gene_id", "category", "gene", "cog_category"),
        graph.functional_edges(paths, "gene_id", "pathway", "gene", "in_pathway"),
        graph.functional_edges(terms, "protein_id", "go_id", "protein", "annotated_by"),
        graph.edges(near, "gene_id", "other", "gene", "genomic_proximity", "gene"),
    )
    return append_missing(edges, new, EDGE_KEY)


def enriched_members(members: DataFrame, determinants: DataFrame, categories: DataFrame, pathways: DataFrame, recovered: DataFrame) -> DataFrame:
    """members(strain, type, name, node) and the determinants' own memberships of pathways, categories and terms.

    A term's hyperedge is that whose name is the term, or begins with it and a colon (the first such name); where there is none, a new one is named after the term, even if it
    has one node only.
    """
    cats, paths, terms = _terms(determinants, categories, pathways, recovered)
    wanted = graph.union(
        paths.select("strain", F.lit("kegg_pathway").alias("type"), F.col("pathway").alias("term"), F.col("pathway").alias("own"), F.col("gene_id").alias("node")),
        cats.select("strain", F.lit("cog_category").alias("type"), F.concat(F.lit("COG_"), F.col("category")).alias("term"), F.concat_ws(": ", F.concat(F.lit("COG_"), F.col("category")), "category").alias("own"), F.col("gene_id").alias("node")),
        terms.select("strain", F.lit("go_term").alias("type"), F.col("go_id").alias("term"), F.concat_ws(": ", "go_id", "go_id").alias("own"), F.col("protein_id").alias("node")),
    )
    named = members.groupBy("strain", "type", F.split_part("name", F.lit(": "), F.lit(1)).alias("term")).agg(F.min("name").alias("name"))
    new = wanted.join(named, ["strain", "type", "term"], "left").select("strain", "type", F.coalesce("name", "own").alias("name"), "node")
    return append_missing(members.select("strain", "type", "name", "node"), new, ["strain", "type", "name", "node"])
