"""Writers: tables by strain, edges by type, text exports and the run's manifest."""

from __future__ import annotations

import datetime
import json
import platform
import subprocess

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, hyper
from ..session import ROOT


def write_table(df: DataFrame, path: str, by: list[str] = ["strain"]) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """A folder for each source type, relation and target type."""
    edges.write.mode("overwrite").partitionBy("src_type", "relation", "dst_type").parquet(path)


def indexed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by the numbers of nodes(strain, node_type, node_id, idx) instead of their ids."""
    out = edges
    for end in ("src", "dst"):
        n = nodes.select("strain", F.col("node_type").alias(f"{end}_type"), F.col("node_id").alias(end), F.col("idx").alias(f"{end}_idx"))
        out = out.join(n, ["strain", f"{end}_type", end])
    return out.select("strain", "src_type", "relation", "dst_type", "src_idx", "dst_idx", "weight")


def gene_table(genes: DataFrame, loci: DataFrame) -> DataFrame:
    """genes with is_amr_gene and amr_class, whether or not any matches."""
    return marked(genes, class_lists(loci.withColumnRenamed("locus_tag", "gene_id"), ["strain", "gene_id"]), ["strain", "gene_id"])


def class_lists(loci: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, amr_class): the sorted distinct classes as one text."""
    return loci.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("amr_class")), ";").alias("amr_class"))


def marked(genes: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """genes with is_amr_gene and amr_class by keys that several genes may share; their list is made once."""
    return genes.join(lists, keys, "left").withColumn("is_amr_gene", F.col("amr_class").isNotNull()).withColumn("amr_class", F.coalesce("amr_class", F.lit("")))


def write_hypergraph(members: DataFrame, path: str, family_order: list[str]) -> None:
    """hyperedges, incidence, nodes and counts of types, all from the same members."""
    edges = hyper.with_ids(hyper.hyperedges(members), family_order)
    inc = hyper.incidence(members, ["strain", "type", "name"], "node")
    write_table(edges, f"{path}/hyperedges")
    write_table(inc, f"{path}/incidence")
    write_table(inc.select("strain", F.col("node").alias("node_id")).distinct(), f"{path}/hypergraph_nodes")
    write_table(edges.groupBy("strain", "type").agg(F.count(F.lit(1)).alias("n")), f"{path}/hyperedge_type_counts")


def write_laplacian(members: DataFrame, path: str) -> None:
    """Sparse, a row per entry that isn't zero; a dense matrix has no use on a cluster."""
    hyper.laplacian(hyper.incidence(members, ["strain", "type", "name"], "node"), ["strain", "type", "name"], "node").write.mode("overwrite").parquet(path)


def write_sif(edges: DataFrame, path: str) -> None:
    graph.sif(edges).write.mode("overwrite").text(path)


def metadata_lines(edges: DataFrame) -> list[str]:
    """What a graph has, for people: a line for each type of node and each relation."""
    nodes = graph.nodes_of(edges).groupBy("strain", "node_type").count().orderBy("strain", "node_type").collect()
    rel = graph.edge_counts(edges).orderBy("strain", "relation").collect()
    return [f"{r[0]}: {r[2]} {r[1]} nodes" for r in nodes] + [f"{r[0]}: {r[2]} {r[1]} edges" for r in rel]


def input_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length, sha256 of input files."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def git_state(folder: str) -> dict[str, object]:
    """The commit that a folder is at and whether it has changes; nothing outside a repository."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=False)
    head = git("rev-parse", "HEAD")
    return {"commit": head.stdout.strip(), "changed": bool(git("status", "--porcelain").stdout.strip())} if head.returncode == 0 else {}


def run_manifest(spark: SparkSession, inputs: list[str], parameters: dict, seed: int | None = None) -> str:
    """JSON of when, with what and on which inputs a run was made."""
    digests = {r["path"]: r["sha256"] for r in input_digests(spark, inputs).collect()} if inputs else {}
    now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({"created": now, "inputs": digests, "parameters": parameters, "seed": seed, "git": git_state(ROOT), "versions": {"pyspark": pyspark.__version__, "python": platform.python_version()}}, indent=2, sort_keys=True)


def markdown(df: DataFrame, columns: list[str], limit: int) -> str:
    """The first rows as a table in Markdown; for reports of small tables."""
    rows = df.select(*columns).limit(limit).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
