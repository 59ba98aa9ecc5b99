"""A project's report: counts out of its saved tables, checked against what was published, as tables of Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, graph, hyper, reports
from ..session import settle
from ..sinks import markdown
from .project import Run

#: Candidates that a report shows, and rows of any other table.
CANDIDATES, ROWS = 25, 1000
_COUNTS = {"determinants": "true", "multi_omics": "status = 'multi_omics'", "genome_only": "status = 'genome_only'"}
_LEVELS = ["n_direct", "n_graph_derived", "n_annotation_mediated", "n_inferred", "n_missing_layers"]
_CONCORDANCE = ["concordant", "discordant", "neutral", "unavailable"]


def _by_strain(traces: DataFrame) -> DataFrame:
    """(strain, determinants, multi_omics, genome_only, mean_layer_coverage, evidence levels, concordance)."""
    counts = [F.count_if(F.expr(c)).alias(name) for name, c in _COUNTS.items()]
    concordance = [F.count_if(F.col("concordance") == c).alias(c) for c in _CONCORDANCE]
    return traces.groupBy("strain").agg(*counts, F.avg("layer_coverage").alias("mean_layer_coverage"), *[F.sum(c).alias(c) for c in _LEVELS], *concordance)


def metrics(run: Run) -> DataFrame:
    """(metric, strain, relation, value) of all that a report counts: nodes, edges, hyperedges, rows of layers, calls of direction, determinants and their evidence."""
    names = [s.name for s in run.strains]
    counted = reports.dashboard(reports.edge_rows(run.edges(names)).unionByName(reports.member_rows(run.members(names))))
    n = F.when(F.col("kind") == "edge", F.col("n")).otherwise(F.col("n_distinct"))
    graphs = counted.select(F.col("kind").alias("metric"), "strain", F.col("type").alias("relation"), n.cast("double").alias("value"))
    layers = run.layers(names)
    size = lambda name, t: t.groupBy("strain").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "strain", F.lit("").alias("relation"), "value")
    calls = layers.protein.groupBy("strain", F.col("Protein_Regulation").alias("relation")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("protein_regulation").alias("metric"), "strain", "relation", "value")
    own = _by_strain(run.store.table("traces"))
    columns = [c for c in own.columns if c != "strain"]
    traced = own.select("strain", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("strain", columns, "metric", "value").select("metric", "strain", F.lit("").alias("relation"), "value")
    sizes = [size("genes", layers.genes), size("aligned", layers.aligned), size("metabolites", layers.metabolite), size("markers", run.store.table("markers"))]
    return reduce(DataFrame.unionByName, [graphs, calls, traced, *sizes])


def checked(run: Run, claims: str, tolerance: float = 0.0) -> DataFrame:
    """The claims of a CSV file (metric, strain, relation, published) beside what the saved tables say."""
    return reports.checked_claims(metrics(run), run.spark.read.csv(claims, header=True), tolerance)


def sections(run: Run, claims: str | None = None) -> dict[str, DataFrame]:
    """The report's tables, by title. Each is bounded by strains, relations, families, markers or CANDIDATES."""
    names = [s.name for s in run.strains]
    traces = settle(run.store.table("traces"))
    edges, members, a, layers = run.edges(names), run.members(names), run.annotations(names), run.layers(names)
    own = _by_strain(traces)
    ppi = edges.where("relation = 'ppi'").select("strain", F.col("src").alias("a"), F.col("dst").alias("b"))
    entities = run.store.table("entities").select("strain", "marker", "node").distinct()
    families = members.join(entities, ["strain", "node"]).select("strain", "marker", "type").distinct()
    degrees = graph.degrees(edges, {"neighbours": ["genomic_proximity"], "interactions": ["ppi"], "annotations": ["in_pathway", "cog_category", "annotated_by"]})
    features = traces.select("strain", "gene_id", "status", F.col("layer_coverage").cast("double").alias("layer_coverage")).join(degrees.withColumnRenamed("node_id", "gene_id"), ["strain", "gene_id"], "left").fillna(0)
    features = features.select("strain", "status", "layer_coverage", *[F.col(c).cast("double").alias(c) for c in ("neighbours", "interactions", "annotations")])
    out = {
        "Determinants by strain": own.select("strain", *_COUNTS, F.round("mean_layer_coverage", 2).alias("mean_layer_coverage")),
        "Edges by relation": reports.pivot_counts(edges, "relation", "strain", names),
        "Hyperedges by family": reports.pivot_counts(members.select("strain", "type", "name").distinct(), "type", "strain", names),
        "Evidence by level": own.select("strain", *_LEVELS),
        "Concordance of expression and abundance": own.select("strain", *_CONCORDANCE),
        "Families that determinants belong to": families.groupBy("type").agg(F.count(F.lit(1)).alias("memberships")),
        "Markers": reports.marker_report(a.markers, a.categories, a.pathways, ppi, layers.genes, layers.aligned),
        "Markers across strains": evidence.cross_matrix(traces, "marker", "strain", names, {"status": F.col("status")}),
        "Genome only against multi-omics": reports.contrast(features, "strain", "status", ("genome_only", "multi_omics"), ["layer_coverage", "neighbours", "interactions", "annotations"]),
        "Size of hyperedges": hyper.type_summary(members.groupBy("strain", "type", "name").agg(F.count(F.lit(1)).alias("n_nodes"))),
        "Candidates": run.store.table("candidates").where(F.col("rank") <= CANDIDATES).orderBy("rank"),
    }
    if claims:
        out["Published counts that differ"] = checked(run, claims).where("verdict <> 'agrees'")
    return out


def written(run: Run, claims: str | None = None) -> str:
    """The report as Markdown."""
    lines = ["# Report", "", f"Strains: {', '.join(s.name for s in run.strains)}. Paths of up to {run.depth} edges; correlations from {run.threshold}, {run.top_k} at most.", ""]
    for title, df in sections(run, claims).items():
        shown = [c for c, kind in df.dtypes if not kind.startswith(("array", "struct", "map"))]
        rows = df if title == "Candidates" else df.orderBy(*shown)
        lines += [f"## {title}", "", markdown(rows, shown, ROWS), ""]
    return "\n".join(lines)
