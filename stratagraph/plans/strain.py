"""The strain pipeline: from files to aligned tables, a typed graph, a hypergraph, traces and candidates.

All strains go through one set of plans, with the strain as a column; a strain that lacks a layer has nulls there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_accession, category_letters, listed
from ..operators import align, candidates, community, correlation, enrich, evidence, graph, hyper, paths, quant, sets, windows
from ..session import settle
from ..sources import annotations, gff, tables
from ..sources.config import Strain

def _all(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], schema)


@dataclass
class Layers:
    genes: DataFrame
    rna: DataFrame
    rna_replicates: DataFrame
    protein: DataFrame
    protein_replicates: DataFrame
    metabolite: DataFrame
    metabolite_replicates: DataFrame
    aligned: DataFrame
    gene_protein: DataFrame


GENES = "gene_id string, gene_name string, protein_id string, product string, replicon string, start long, end long, strand string, cds_length long, line_order struct<replicon:string,start:long,end:long,line:string>, path string, strain string"
RNA_ROWS = "gene_id string, gene_name string, sample_id string, value double, condition string, strain string"
PROTEIN_ROWS = "protein_id string, sample_id string, condition string, value double, strain string"
METABOLITE_ROWS = "metabolite_id string, name string, database string, formula string, mz double, rt double, instrument string, sample_id string, value double, row_order struct<instrument:string,name:string,formula:string,mz:double,rt:double>, scaled double, condition string, strain string"


def _tagged(df: DataFrame, s: Strain) -> DataFrame:
    return df.withColumn("strain", F.lit(s.name))


def read_genes(spark: SparkSession, strains: list[Strain]) -> DataFrame:
    return _all([_tagged(gff.coding_genes(spark, s.files["gff"]), s) for s in strains if "gff" in s.files], spark, GENES)


def read_rna(spark: SparkSession, strains: list[Strain]) -> DataFrame:
    """Replicates as logs: a table of logs goes before counts, which become logs of counts per million."""
    parts = []
    for s in strains:
        path = s.files.get("expression") or s.files.get("counts")
        if path:
            rows = quant.with_condition(tables.expression(spark, path), "sample_id", s.samples["rna"])
            if "expression" not in s.files:
                rows = quant.counts_per_million(rows, "sample_id", "value").withColumn("value", F.log2(F.col("cpm") + 1.0)).drop("cpm")
            parts.append(_tagged(rows, s))
    return _all(parts, spark, RNA_ROWS)


def rna_means(rows: DataFrame) -> DataFrame:
    return quant.condition_means(rows, ["strain", "gene_id"], "condition", "value", "RPMI", "Sera", "RNA")


def read_proteins(spark: SparkSession, strains: list[Strain]) -> DataFrame:
    parts = [_tagged(tables.protein_areas(spark, s.files["proteins"], s.swath["protein"], s.swath, s.samples["protein"], s.swath.get("sheet")), s) for s in strains if "proteins" in s.files]
    return _all(parts, spark, PROTEIN_ROWS)


def protein_means(rows: DataFrame, deviations: float) -> DataFrame:
    means = quant.condition_means(rows, ["strain", "protein_id"], "condition", "value", "RPMI", "Sera", "Protein", "log_of_mean")
    return quant.with_regulation(means, "Protein_logFC", "Protein_Regulation", deviations=deviations, by=["strain"])


def read_metabolites(spark: SparkSession, strains: list[Strain]) -> DataFrame:
    """Replicates, scaled to the instruments' common median over all samples, before those of the strain are taken."""
    parts = []
    for s in strains:
        if s.metabolite_files:
            rows = quant.scaled_to_common_median(tables.metabolite_files(spark, s.metabolite_files), "instrument", "value")
            parts.append(_tagged(quant.with_condition(rows, "sample_id", s.samples["metabolite"]), s))
    return _all(parts, spark, METABOLITE_ROWS)


def metabolite_means(rows: DataFrame) -> DataFrame:
    key = ["strain", "metabolite_id"]
    by_instrument = quant.condition_means(rows, [*key, "instrument"], "condition", "scaled", "RPMI", "Sera", "Metabolite", "log_of_mean")
    instruments = F.array_join(F.array_sort(F.collect_set("instrument")), ", ")
    merged = by_instrument.groupBy(*key).agg(F.avg("Metabolite_RPMI").alias("Metabolite_RPMI"), F.avg("Metabolite_Sera").alias("Metabolite_Sera"), instruments.alias("instruments"), F.countDistinct("instrument").alias("n_instruments"))
    names = windows.first_non_null(rows, key, ["name", "formula", "mz", "rt", "database"], "row_order")
    return merged.withColumn("Metabolite_logFC", F.col("Metabolite_Sera") - F.col("Metabolite_RPMI")).join(names, key, "left")


def align_layers(genes: DataFrame, rna: DataFrame, protein: DataFrame) -> DataFrame:
    """A row per gene and protein of it, with both layers' means and the gene's place; a strain without expression has nulls there."""
    links = align.bridge(genes, "protein_id", "gene_id", ["line_order"], ["strain"])
    placed = protein.join(links, ["strain", "protein_id"])
    both = settle(align.aligned(rna, placed, ["strain", "gene_id"], ["protein_id"], rna, "strain"))
    return align.attributes(both, genes, ["strain", "gene_id"], ["replicon", "start", "end", "strand", "cds_length"], "line_order")


def measure(spark: SparkSession, strains: list[Strain]) -> Layers:
    """Reads what each strain has and summarises it by condition. Each table is written out, as later stages use it many times."""
    genes, rna_rows, protein_rows, metabolite_rows = (settle(read(spark, strains)) for read in (read_genes, read_rna, read_proteins, read_metabolites))
    rna = settle(rna_means(rna_rows))
    protein = settle(protein_means(protein_rows, max((s.deviations for s in strains), default=0.0)))
    aligned = settle(align_layers(genes, rna, protein))
    return Layers(genes, rna, rna_rows, protein, protein_rows, settle(metabolite_means(metabolite_rows)), metabolite_rows, aligned, aligned.select("strain", "gene_id", "protein_id"))


@dataclass
class Annotations:
    """Edge tables, each with the strain: categories(gene_id, category), pathways(gene_id, pathway), go(protein_id, go_id), protein_ec(protein_id, ec),
    metabolite_ec(metabolite_id, ec), metabolite_pathway(metabolite_id, pathway), interactions(protein_a, protein_b, combined_score), markers(marker, amr_class, locus_tag, protein_id).

    recovered(accession, go_id), for all strains: terms found later for determinants' proteins, or None."""

    categories: DataFrame
    pathways: DataFrame
    go: DataFrame
    protein_ec: DataFrame
    metabolite_ec: DataFrame
    metabolite_pathway: DataFrame
    interactions: DataFrame
    markers: DataFrame
    recovered: DataFrame | None = None


def annotate_by_orthologs(layers: Layers, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(categories, pathways) of genes: the table's id is the locus or its protein, with a version or without."""
    keyed = table.select(canonical_accession(F.col("gene_id")).alias("key"), "category", "kegg_pathway")
    ids = sets.universe([(layers.genes, "gene_id")], "gene_id", ["strain"]).join(layers.genes.select("strain", "gene_id", "protein_id").distinct(), ["strain", "gene_id"], "left")
    forms = ids.select("strain", "gene_id", F.explode(F.array_compact(F.array("gene_id", canonical_accession(F.col("protein_id"))))).alias("key")).distinct().join(keyed, "key")
    forms = settle(forms)
    cats = forms.select("strain", "gene_id", F.explode(category_letters(F.col("category"))).alias("category")).distinct()
    paths_ = forms.select("strain", "gene_id", F.explode(listed(F.col("kegg_pathway"))).alias("pathway")).where(F.col("pathway").rlike("^(ko|map)")).distinct()
    return cats, paths_


def empty_annotations(spark: SparkSession) -> Annotations:
    t = lambda s: spark.createDataFrame([], "strain string, " + s)
    return Annotations(t("gene_id string, category string"), t("gene_id string, pathway string"), t("protein_id string, go_id string"), t("protein_id string, ec string"), t("metabolite_id string, ec string"), t("metabolite_id string, pathway string"), t("protein_a string, protein_b string, combined_score double"), t("marker string, amr_class string, locus_tag string, protein_id string"))


def _correlated(rows: DataFrame, entity: str, kind: str, relation: str, value: str, threshold: float, top_k: int) -> DataFrame:
    own = rows.groupBy("strain", entity, "sample_id").agg(F.avg(value).alias("value"))
    found = correlation.correlation_edges(own, entity, "sample_id", "value", threshold, top_k, by=["strain"])
    return graph.edges(found, "a", "b", kind, relation, kind, "r")


def _interacting(a: Annotations) -> DataFrame:
    return windows.dedup_pairs(a.interactions.select("strain", "protein_a", "protein_b", "combined_score"), "protein_a", "protein_b", "combined_score", ["combined_score"], ["strain"])


def _clustered(a: Annotations) -> DataFrame:
    clusters = community.communities(settle(_interacting(a)), "strain", "protein_a", "protein_b", "combined_score").withColumn("cluster", F.concat(F.lit("Cluster_"), F.col("community")))
    return graph.functional_edges(clusters, "node", "cluster", "protein", "member_of_cluster")


@dataclass(frozen=True)
class Part:
    """Edges or members that are made of the same tables: these tables' names, and how."""

    needs: tuple[str, ...]
    build: Callable[..., DataFrame]


#: Kinds of edges, by the layers (l) and annotations (a) that they depend on; threshold t and number k are those of correlations.
EDGE_PARTS: dict[str, Part] = {
    "proximity": Part(("genes",), lambda l, a, t, k: graph.proximity_edges(l.genes)),
    "encodes": Part(("gene_protein",), lambda l, a, t, k: graph.edges(l.gene_protein, "gene_id", "protein_id", "gene", "encodes", "protein")),
    "interactions": Part(("interactions",), lambda l, a, t, k: graph.edges(_interacting(a), "protein_a", "protein_b", "protein", "ppi", "protein", "combined_score")),
    "pathways": Part(("pathways",), lambda l, a, t, k: graph.functional_edges(a.pathways, "gene_id", "pathway", "gene", "in_pathway")),
    "categories": Part(("categories",), lambda l, a, t, k: graph.functional_edges(a.categories, "gene_id", "category", "gene", "cog_category")),
    "terms": Part(("go",), lambda l, a, t, k: graph.functional_edges(a.go, "protein_id", "go_id", "protein", "annotated_by")),
    "mechanisms": Part(("markers",), lambda l, a, t, k: graph.functional_edges(a.markers.where("locus_tag is not null"), "locus_tag", "amr_class", "gene", "associated_with")),
    "metabolic": Part(("metabolite_pathway",), lambda l, a, t, k: graph.functional_edges(a.metabolite_pathway, "metabolite_id", "pathway", "metabolite", "in_pathway")),
    "enzymes": Part(("metabolite_ec", "protein_ec"), lambda l, a, t, k: graph.enzyme_edges(a.metabolite_ec, a.protein_ec)),
    "clusters": Part(("interactions",), lambda l, a, t, k: _clustered(a)),
    "transcripts": Part(("rna_replicates",), lambda l, a, t, k: _correlated(l.rna_replicates, "gene_id", "gene", "transcriptional_correlation", "value", t, k)),
    "abundances": Part(("protein_replicates",), lambda l, a, t, k: _correlated(l.protein_replicates, "protein_id", "protein", "abundance_correlation", "value", t, k)),
    "metabolites": Part(("metabolite_replicates",), lambda l, a, t, k: _correlated(l.metabolite_replicates, "metabolite_id", "metabolite", "abundance_correlation", "scaled", t, k)),
}


def build_graph(layers: Layers, a: Annotations, threshold: float = 0.7, top_k: int = 10) -> DataFrame:
    """All typed edges of all strains."""
    return settle(graph.union(*[p.build(layers, a, threshold, top_k) for p in EDGE_PARTS.values()]))


def _cluster_members(edges: DataFrame) -> DataFrame:
    clusters = edges.where("relation = 'member_of_cluster'").select("strain", F.col("dst").alias("cluster"), F.col("src").alias("protein_id"))
    return hyper.members(clusters, "ppi_cluster", "cluster", "protein_id")


#: Families of hyperedges, by what they depend on; e are the edges.
MEMBER_PARTS: dict[str, Part] = {
    "multi_omics_triple": Part(("gene_protein",), lambda l, a, e: hyper.triples(l.gene_protein)),
    "kegg_pathway": Part(("pathways",), lambda l, a, e: hyper.members(a.pathways, "kegg_pathway", "pathway", "gene_id")),
    "cog_category": Part(("categories", "gene_protein"), lambda l, a, e: hyper.category_members(a.categories, l.gene_protein)),
    "go_term": Part(("go",), lambda l, a, e: hyper.members(a.go, "go_term", "go_id", "protein_id")),
    "ppi_cluster": Part(("edges_clusters",), lambda l, a, e: _cluster_members(e)),
    "amr_mechanism": Part(("markers",), lambda l, a, e: hyper.mechanism_members(a.markers)),
    "metabolic_pathway": Part(("metabolite_pathway", "pathways"), lambda l, a, e: hyper.metabolic_members(a.metabolite_pathway, a.pathways)),
}
FAMILIES = list(MEMBER_PARTS)


def build_hypergraph(layers: Layers, a: Annotations, edges: DataFrame) -> DataFrame:
    """(strain, type, name, node) of all families; hyperedges of one node are left out where they are counted or written."""
    return settle(hyper.sized(settle(hyper.union(*[p.build(layers, a, edges) for p in MEMBER_PARTS.values()]))).drop("n_nodes"))


def enriched(layers: Layers, a: Annotations, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges and members with what the annotations know of the determinants and the graph lacks: their categories, pathways, recovered terms, proteins and neighbours on the genome."""
    determinants = a.markers.select("strain", F.col("locus_tag").alias("gene_id"), "protein_id").where("gene_id is not null")
    accession = layers.genes.select("strain", "gene_id", canonical_accession(F.col("protein_id")).alias("accession")).where("accession is not null").distinct()
    of = lambda t, c: t.join(accession, ["strain", "gene_id"]).select("accession", c).distinct()
    cats, pathways = settle(of(a.categories, "category")), settle(of(a.pathways, "pathway"))
    recovered = a.recovered if a.recovered is not None else edges.sparkSession.createDataFrame([], "accession string, go_id string")
    recovered = recovered.unionByName(recovered.withColumn("accession", canonical_accession(F.col("accession")))).distinct()  # keyed by both forms
    near = graph.proximity_edges(layers.genes).select("strain", F.col("src").alias("gene_a"), F.col("dst").alias("gene_b"))
    more = enrich.enriched_edges(edges, determinants, cats, pathways, recovered, near)
    return settle(more), settle(enrich.enriched_members(members, determinants, cats, pathways, recovered))


def entities_of(determinants: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """determinants(strain, ..., gene_id, protein_id) with side and node: the locus, the protein, and the protein's other form (with or without a version) where graph or hypergraph have that."""
    known = graph.nodes_of(edges).where("node_type = 'protein'").select("strain", F.col("node_id").alias("node")).unionByName(members.select("strain", "node")).distinct()
    proteins = determinants.where("protein_id is not null")
    other = enrich.by_canonical_form(proteins, "protein_id", known, "node", ["strain"])
    own = [determinants.withColumn("node", F.col("gene_id")), proteins.withColumn("node", F.col("protein_id")), other.select(*determinants.columns, "node")]
    sides = [t.withColumn("side", F.lit(side)) for t, side in zip(own, ("gene", "protein", "protein"), strict=True)]
    return graph.union(*sides).distinct()


@dataclass
class Tracing:
    traces: DataFrame
    evidence: DataFrame
    candidates: DataFrame


def trace(layers: Layers, a: Annotations, edges: DataFrame, members: DataFrame, depth: int = 4, scale: str = "log") -> Tracing:
    """Traces of all determinants, the evidence behind them, and ranked candidates."""
    rows, all_rows, ids = evidence_of(layers, a, edges, members, depth, scale)
    return Tracing(rows, all_rows, ranked(layers, ids, all_rows))


def evidence_of(layers: Layers, a: Annotations, edges: DataFrame, members: DataFrame, depth: int = 4, scale: str = "log") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Traces of all determinants, the evidence behind them, and the entities that each determinant stands for.

    The graph is enriched first, and a determinant's protein is found in either of its forms.
    """
    determinants = a.markers.select("strain", "marker", "amr_class", F.col("locus_tag").alias("gene_id"), "protein_id").where("gene_id is not null")
    determinants = settle(determinants)
    edges, members = enriched(layers, a, edges, members)
    ids = settle(entities_of(determinants, edges, members))
    enzymes = edges.where("relation = 'metabolised_by'").select("strain", F.col("src").alias("metabolite_id"), F.col("dst").alias("node")).join(ids.where("side = 'protein'"), ["strain", "node"])
    linked = evidence.metabolite_links(a.pathways, a.metabolite_pathway, enzymes.select("strain", "metabolite_id", "protein_id").distinct(), determinants)
    linked = settle(linked.join(layers.metabolite.select("strain", "metabolite_id").distinct().withColumn("measured", F.lit(True)), ["strain", "metabolite_id"], "left").fillna(False, ["measured"]))
    near = edges.where("relation in ('genomic_proximity', 'ppi')")
    near = near.select("strain", "relation", "src", "dst").unionByName(near.select("strain", "relation", F.col("dst").alias("src"), F.col("src").alias("dst")))

    def around(relation: str, layer: str, end: str, label: str) -> DataFrame:
        own = near if relation in ("genomic_proximity", "ppi") else edges.select("strain", "relation", "src", "dst")
        hit = own.where(F.col("relation") == relation).select("strain", F.col("src").alias("node"), F.col("dst").alias("target"))
        found = ids.where(F.col("side") == end.removesuffix("_id")).join(hit, ["strain", "node"]).where("target <> node")
        return settle(found.select("strain", "marker", "amr_class", "gene_id", "protein_id", F.lit(layer).alias("layer"), F.lit(label).alias("relation"), "target").distinct())

    direct = [around("genomic_proximity", "genome", "gene_id", "genomic_proximity"), around("ppi", "ppi_amr", "protein_id", "ppi"), around("member_of_cluster", "ppi_amr", "protein_id", "member_of_cluster"), around("in_pathway", "kegg", "gene_id", "in_pathway"), around("cog_category", "cog", "gene_id", "cog_category"), around("annotated_by", "go", "protein_id", "go_annotation"), around("associated_with", "ppi_amr", "gene_id", "amr_mechanism")]
    groups = ids.join(members, ["strain", "node"]).select("strain", "marker", "amr_class", "gene_id", "protein_id", F.lit("hypergraph").alias("layer"), F.lit("hyperedge_membership").alias("relation"), F.col("name").alias("target")).distinct()
    groups = settle(groups)
    entity_edges = edges.where("relation in ('encodes', 'genomic_proximity', 'ppi', 'metabolised_by') or (relation = 'in_pathway')")
    seeds = ids.select("strain", F.col("marker").alias("seed"), "node")
    found = paths.bounded_paths(paths.entity_graph(entity_edges, members), seeds, depth)
    node = lambda kind: graph.nodes_of(edges).where(F.col("node_type") == kind).select("strain", F.col("node_id").alias("node"))
    ends = paths.context(found, paths.layers_of(node("metabolite"), node("protein"), node("gene")), seeds)
    ends = settle(ends.withColumnRenamed("seed", "marker").join(determinants.select("strain", "marker", "amr_class", "gene_id").distinct(), ["strain", "marker"]))
    counted = [x.select("strain", "marker", "layer", "relation", "target", F.lit(False).alias("measured")) for x in [*direct, groups]]
    counted.append(linked.select("strain", "marker", F.lit("metabolome").alias("layer"), F.lit("metabolite").alias("relation"), F.col("metabolite_id").alias("target"), "measured"))
    counted.append(ends.select("strain", "marker", F.lit("context").alias("layer"), F.lit("graph_context").alias("relation"), F.col("node").alias("target"), F.lit(False).alias("measured")))
    layer_tables = {"genome": layers.genes, "transcriptome": layers.rna, "proteome": layers.protein, "metabolome": layers.metabolite, "kegg": a.pathways, "cog": a.categories, "go": a.go, "ppi_amr": a.interactions}
    available = evidence.availability(determinants, layer_tables)
    rows = settle(evidence.traces(determinants, layers.genes, layers.aligned, available, settle(graph.union(*counted)), scale))

    measured = rows.select("strain", "marker", "amr_class", "gene_id", "protein_id", "transcriptome_present", "proteome_present")
    rna = measured.where("transcriptome_present").withColumn("target", F.concat("gene_id", F.lit("_RNA")))
    parts = [
        evidence.row(rna, "gene_id", "genome", "target", "transcriptome", "rna_quantified", 0, "aligned table", observed="observed"),
        evidence.row(measured.where("proteome_present"), "gene_id", "genome", "protein_id", "proteome", "protein_quantified", 0, "aligned table", observed="observed"),
        evidence.row(groups, "gene_id", "hypergraph", "target", "hypergraph", "hyperedge_membership", 1, "hyperedges", ["gene_id", "target"], ["member_of"]),
    ]
    for d, (end, layer, target_layer) in zip(direct, (("gene_id", "genome", "genome"), ("protein_id", "proteome", "proteome"), ("protein_id", "proteome", "ppi_amr"), ("gene_id", "genome", "kegg"), ("gene_id", "genome", "cog"), ("protein_id", "proteome", "go"), ("gene_id", "genome", "ppi_amr")), strict=True):
        relation = ("genomic_proximity", "ppi", "member_of_cluster", "in_pathway", "cog_category", "go_annotation", "amr_mechanism")[direct.index(d)]
        parts.append(evidence.row(d, end, layer, "target", target_layer, relation, 1, "edges", [end, "target"], [relation]))
    m = linked.join(determinants, ["strain", "marker"])
    parts.append(evidence.row(m.where("via = 'pathway'"), "gene_id", "genome", "metabolite_id", "metabolome", "shares_pathway", 2, "pathways", ["gene_id", "pathway", "metabolite_id"], ["in_pathway", "in_pathway"]))
    parts.append(evidence.row(m.where("via = 'enzyme'"), "protein_id", "proteome", "metabolite_id", "metabolome", "metabolised_by", 1, "enzymes", ["protein_id", "metabolite_id"], ["metabolised_by"]))
    parts.append(evidence.row(m.where("measured"), "gene_id", "genome", "metabolite_id", "metabolome", "metabolite_quantified", F.col("path_length"), "metabolite table", observed="observed"))
    all_rows = settle(evidence.union(*parts, evidence.context_rows(ends, linked, depth)))
    return rows, all_rows, ids


def ranked(layers: Layers, ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidates of evidence rows, by rank; ids(strain, side, node) are the determinants' own entities."""
    own = ids.select("strain", F.when(F.col("side") == "gene", "genome").otherwise("proteome").alias("target_layer"), F.col("node").alias("entity")).distinct()
    quantified = layers.rna.select("strain", F.col("gene_id").alias("entity"), F.lit("gene").alias("entity_type")).unionByName(layers.aligned.select("strain", F.col("gene_id").alias("entity"), F.lit("gene").alias("entity_type")))
    quantified = quantified.unionByName(layers.protein.select("strain", F.col("protein_id").alias("entity"), F.lit("protein").alias("entity_type"))).unionByName(layers.metabolite.select("strain", F.col("metabolite_id").alias("entity"), F.lit("metabolite").alias("entity_type")))
    c = candidates.with_hubs(candidates.candidates(rows, own))
    return candidates.ranked(candidates.with_measured(settle(candidates.with_enrichment(c)), quantified))


def load_markers(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    return annotations.marker_loci(annotations.manifest(spark, path), first_only)
