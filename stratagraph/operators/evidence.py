"""Tracing of determinants through eight layers, and the evidence behind it.

A trace has child tables instead of lists in columns: neighbours(strain, marker, layer, relation, target) hold what each layer gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import agreement, direction, layer_status, log2_ratio

#: Layers, levels of evidence, and the level of each relationship.
LAYERS = ("genome", "transcriptome", "proteome", "metabolome", "kegg", "cog", "go", "ppi_amr")
DIRECT, GRAPH, ANNOTATION, INFERRED, UNAVAILABLE = "directly_observed", "graph_derived", "annotation_mediated", "inferred", "unavailable"
LEVELS = {
    "rna_quantified": DIRECT,
    "protein_quantified": DIRECT,
    "metabolite_quantified": DIRECT,
    "genomic_proximity": GRAPH,
    "ppi": GRAPH,
    "member_of_cluster": GRAPH,
    "hyperedge_membership": GRAPH,
    "in_pathway": ANNOTATION,
    "cog_category": ANNOTATION,
    "go_annotation": ANNOTATION,
    "amr_mechanism": ANNOTATION,
    "shares_pathway": INFERRED,
    "metabolised_by": INFERRED,
}
COLUMNS = ["strain", "amr_determinant", "amr_class", "source_entity", "source_layer", "target_entity", "target_layer", "relationship", "path_length", "node_sequence", "edge_sequence", "evidence_type", "evidence_source", "observed_status"]


def metabolite_links(gene_pathway: DataFrame, metabolite_pathway: DataFrame, protein_metabolite: DataFrame, determinants: DataFrame) -> DataFrame:
    """(strain, marker, metabolite_id, via, pathway, path_length): over a shared pathway (the first by id), else over an enzyme."""
    own = determinants.select("strain", "marker", "gene_id", "protein_id")
    shared = own.join(gene_pathway, ["strain", "gene_id"]).join(metabolite_pathway, ["strain", "pathway"]).select("strain", "marker", "metabolite_id", F.lit(0).alias("p"), F.lit("pathway").alias("via"), "pathway", F.lit(2).alias("path_length"))
    enzyme = own.join(protein_metabolite, ["strain", "protein_id"]).select("strain", "marker", "metabolite_id", F.lit(1).alias("p"), F.lit("enzyme").alias("via"), F.lit(None).cast("string").alias("pathway"), F.lit(1).alias("path_length"))
    both = shared.unionByName(enzyme).groupBy("strain", "marker", "metabolite_id").agg(F.min(F.struct("p", F.coalesce("pathway", F.lit("")).alias("o"), "via", "pathway", "path_length")).alias("b"))
    return both.select("strain", "marker", "metabolite_id", "b.via", "b.pathway", "b.path_length")


def availability(strains: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """strains(strain) with a flag has_<layer> for each table(strain) that has a row of it."""
    out = strains.select("strain").distinct()
    for layer, t in tables.items():
        out = out.join(t.select("strain").where(F.col("strain").isNotNull()).distinct().withColumn(f"has_{layer}", F.lit(True)), "strain", "left").fillna(False, [f"has_{layer}"])
    return out


def traces(determinants: DataFrame, genes: DataFrame, aligned: DataFrame, available: DataFrame, neighbours: DataFrame, scale: str = "log") -> DataFrame:
    """A row per determinant (strain, marker, amr_class, gene_id, protein_id).

    genes(strain, gene_id) is the genome; aligned has RNA_* and Protein_* per gene; neighbours(strain, marker, layer, relation, target, measured) are
    what the other layers give; available has has_<layer> flags. scale says if RNA values are logs (the change is their difference) or linear (log2 of the ratio).
    """
    key = ["strain", "marker"]
    there = genes.select("strain", "gene_id").distinct().withColumn("in_genome", F.lit(True))
    rows = determinants.join(there, ["strain", "gene_id"], "left").fillna(False, ["in_genome"])
    rows = rows.join(aligned.drop("protein_id"), ["strain", "gene_id"], "left").join(available, "strain", "left")
    counts = neighbours.groupBy(*key).agg(
        *[F.countDistinct(F.when(F.col("layer") == layer, F.struct("relation", "target"))).alias(f"n_{layer}") for layer in ("genome", "metabolome", "kegg", "cog", "go", "ppi_amr", "hypergraph", "context")],
        F.countDistinct(F.when(F.col("relation") == "ppi", F.col("target"))).alias("n_ppi"),
        F.countDistinct(F.when(F.col("relation") == "member_of_cluster", F.col("target"))).alias("n_clusters"),
        F.countDistinct(F.when(F.col("relation") == "amr_mechanism", F.col("target"))).alias("n_mechanisms"),
        F.countDistinct(F.when((F.col("layer") == "metabolome") & F.col("measured"), F.col("target"))).alias("n_measured"),
    )
    names = [c for c in counts.columns if c not in key]
    rows = rows.join(counts, key, "left").fillna(0, names)
    flag = lambda layer: F.coalesce(F.col(f"has_{layer}"), F.lit(False))
    has_rna = flag("transcriptome") & F.col("RNA_RPMI").isNotNull()
    has_protein = flag("proteome") & F.col("Protein_logFC").isNotNull() & F.col("protein_id").isNotNull()
    change = F.when(has_rna, log2_ratio(F.col("RNA_Sera"), F.col("RNA_RPMI")) if scale == "linear" else F.col("RNA_logFC"))
    presence = {"genome": F.col("in_genome"), "transcriptome": has_rna, "proteome": has_protein, "metabolome": F.col("n_metabolome") > 0, "kegg": F.col("n_kegg") > 0, "cog": F.col("n_cog") > 0, "go": F.col("n_go") > 0, "ppi_amr": F.col("n_ppi_amr") > 0}
    rows = rows.withColumns({f"{layer}_present": F.coalesce(c, F.lit(False)) for layer, c in presence.items()})
    rows = rows.withColumns({f"{layer}_status": layer_status(flag(layer), F.col(f"{layer}_present")) for layer in LAYERS})
    covered = reduce(lambda a, b: a + b, [F.col(f"{layer}_present").cast("int") for layer in LAYERS])
    missing = reduce(lambda a, b: a + b, [(~flag(layer)).cast("int") for layer in LAYERS])
    rows = rows.withColumns({
        "rna_change": change,
        "rna_direction": direction(change),
        "concordance": agreement(change, F.col("Protein_logFC")),
        "layer_coverage": covered,
        "n_direct": F.col("transcriptome_present").cast("long") + F.col("proteome_present").cast("long") + F.col("n_measured"),
        "n_graph_derived": F.col("n_genome") + F.col("n_ppi") + F.col("n_clusters") + F.col("n_hypergraph") + F.col("n_context"),
        "n_annotation_mediated": F.col("n_kegg") + F.col("n_cog") + F.col("n_go") + F.col("n_mechanisms"),
        "n_inferred": F.col("n_metabolome"),
        "n_missing_layers": missing,
    })
    status = F.when(F.col("transcriptome_present") | F.col("proteome_present"), "multi_omics").when(F.col("in_genome"), "genome_only").otherwise("unavailable")
    some = lambda c, name: F.when(c > 0, F.lit(name))
    kinds = F.array_compact(F.array(some(F.col("n_direct"), DIRECT), some(F.col("n_graph_derived"), GRAPH), some(F.col("n_annotation_mediated"), ANNOTATION), some(F.col("n_inferred"), INFERRED), some(F.col("n_missing_layers"), UNAVAILABLE)))
    rows = rows.withColumns({"status": status, "genome_only_by_alignment": F.col("in_genome") & F.col("Protein_logFC").isNull(), "evidence_types": F.array_join(kinds, "; "), "layer_coverage_pct": F.format_string("%.1f%%", F.col("layer_coverage") * 100.0 / len(LAYERS))})
    keep = ["strain", "marker", "amr_class", "gene_id", "protein_id", "status", "genome_only_by_alignment", "layer_coverage", "layer_coverage_pct", "rna_change", "rna_direction", "Protein_logFC", "concordance", "evidence_types", "n_direct", "n_graph_derived", "n_annotation_mediated", "n_inferred", "n_missing_layers", "n_hypergraph", "n_ppi"]
    return rows.select(*keep, *[f"{layer}_present" for layer in LAYERS], *[f"{layer}_status" for layer in LAYERS])


def context_level(layer: Column, edge_sequence: Column) -> Column:
    """How well a path of several edges supports its end."""
    return (
        F.when(layer == "metabolome", INFERRED)
        .when(F.array_contains(edge_sequence, "member_of_ppi_cluster"), GRAPH)
        .when(F.exists(edge_sequence, lambda e: e.startswith("member_of_") | (e == "in_pathway")), ANNOTATION)
        .otherwise(GRAPH)
    )


def row(df: DataFrame, source: str, source_layer: str, target: str, target_layer: str, relationship: str, length: Column | int, origin: str, via: list[str] | None = None, relations: list[str] | None = None, observed: str | None = None) -> DataFrame:
    """df(strain, marker, amr_class, ...) as evidence of one relationship; via are the columns of the path's nodes."""
    level = LEVELS[relationship]
    size = length if isinstance(length, Column) else F.lit(length)
    nodes = F.concat_ws(";", *[F.col(c) for c in via]) if via else F.lit("")
    return df.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(
        "strain", F.col("marker").alias("amr_determinant"), "amr_class", F.col(source).alias("source_entity"), F.lit(source_layer).alias("source_layer"), F.col(target).alias("target_entity"), F.lit(target_layer).alias("target_layer"),
        F.lit(relationship).alias("relationship"), size.cast("int").alias("path_length"), nodes.alias("node_sequence"), F.lit(";".join(relations or [])).alias("edge_sequence"), F.lit(level).alias("evidence_type"), F.lit(origin).alias("evidence_source"), F.lit(observed or level).alias("observed_status"),
    )


def context_rows(paths: DataFrame, known_metabolites: DataFrame, depth: int = 4) -> DataFrame:
    """Evidence of paths(strain, marker, amr_class, gene_id, node, layer, path_length, node_sequence, edge_sequence); metabolites known already are left out."""
    known = known_metabolites.select("strain", "marker", F.col("metabolite_id").alias("node"), F.lit("metabolome").alias("layer")).distinct()
    rows = paths.join(known, ["strain", "marker", "node", "layer"], "left_anti")
    level = context_level(F.col("layer"), F.col("edge_sequence"))
    return rows.select(
        "strain", F.col("marker").alias("amr_determinant"), "amr_class", F.col("gene_id").alias("source_entity"), F.lit("genome").alias("source_layer"), F.col("node").alias("target_entity"), F.col("layer").alias("target_layer"),
        F.lit("graph_context").alias("relationship"), F.col("path_length").cast("int").alias("path_length"), F.array_join("node_sequence", ";").alias("node_sequence"), F.array_join("edge_sequence", ";").alias("edge_sequence"), level.alias("evidence_type"), F.lit(f"bounded paths (up to {depth} edges)").alias("evidence_source"), level.alias("observed_status"),
    )


def union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).select(*COLUMNS)


def cross_matrix(df: DataFrame, row_key: str, column: str, labels: list[str], values: dict[str, Column], absent: str = "absent") -> DataFrame:
    """A row per row_key, and for each label a presence and the first of each value, as text; what isn't there is absent or ''."""
    aggs = []
    for s in labels:
        here = F.col(column) == s
        aggs.append(F.when(F.count_if(here) > 0, "present").otherwise(absent).alias(f"{s}_presence"))
        aggs += [F.coalesce(F.min(F.when(here, v.cast("string"))), F.lit("")).alias(f"{s}_{name}") for name, v in values.items()]
    return df.groupBy(row_key).agg(*aggs)


def pathway_quality(df: DataFrame, group: str, annotation: str, least: int = 20, share: float = 0.5, umbrella: str = r"^(map|ko)0110") -> DataFrame:
    """(group, n, n_distinct, umbrella_share, verdict): degenerate with under least annotations, unspecific with most rows in umbrella maps."""
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(annotation).alias("n_distinct"), (F.count_if(F.col(annotation).rlike(umbrella)) / F.count(F.lit(1))).alias("umbrella_share"))
    return out.withColumn("verdict", F.when(F.col("n_distinct") < least, "degenerate").when(F.col("umbrella_share") > share, "unspecific").otherwise("ok"))


def unversioned_counts(df: DataFrame, group: str, accession: str) -> DataFrame:
    return df.where(F.col(accession).rlike(r"^WP_\d+$")).groupBy(group).agg(F.count(F.lit(1)).alias("n_unversioned"))
