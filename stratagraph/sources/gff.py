"""GFF3 annotation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import present

_ACCESSION = r"GenBank:([^\s,;]+)"


def attributes(text: Column, separator: str = ";") -> Column:
    """k=v pairs as a map; each is split at its first =, entries without one are left out, and of a repeated key the last counts."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), "\\Q" + separator + "\\E"), lambda x: F.instr(x, "=") > 0)
    pairs = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.substr(x, F.instr(x, "=") + F.lit(1)).alias("value")))
    # the last of each key: those that no later entry has the key of
    n = F.size(pairs)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def features(spark: SparkSession, path: str) -> DataFrame:
    """Rows of at least nine fields that aren't comments: seqid, type, start, end, strand, attributes (a map), line."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")))
    f = lines.select(F.split("value", "\t").alias("f"), F.col("value").alias("line"), F.col("_metadata.file_path").alias("path")).where(F.size("f") >= 9)
    cell = lambda i: F.try_element_at("f", F.lit(i + 1))
    return f.select(cell(0).alias("replicon"), cell(2).alias("type"), cell(3).cast("long").alias("start"), cell(4).cast("long").alias("end"), cell(6).alias("strand"), attributes(cell(8)).alias("attributes"), "line", "path")


def _get(key: str) -> Column:
    return present(F.try_element_at("attributes", F.lit(key)))


def coding_genes(spark: SparkSession, path: str) -> DataFrame:
    """One row per CDS: gene_id, gene_name, protein_id, product, replicon, start, end, strand, cds_length; without a gene_id none.

    protein_id falls back to a GenBank reference, gene_id to the parent's name without gene-. line_order orders rows as they count when keys repeat.
    """
    rows = features(spark, path).where("type = 'CDS'")
    reference = F.nullif(F.regexp_extract(F.coalesce(_get("Dbxref"), F.lit("")), _ACCESSION, 1), F.lit(""))
    gene = F.coalesce(_get("locus_tag"), present(F.regexp_replace(_get("Parent"), "^gene-", "")))
    out = rows.select(
        gene.alias("gene_id"), _get("gene").alias("gene_name"), F.coalesce(_get("protein_id"), reference).alias("protein_id"), _get("product").alias("product"), "replicon", "start", "end", "strand",
        (F.col("end") - F.col("start") + 1).alias("cds_length"), F.struct("replicon", "start", "end", "line").alias("line_order"), "path",
    )
    return out.where(F.col("gene_id").isNotNull())


def genes_and_proteins(spark: SparkSession, path: str) -> DataFrame:
    """Genes' places with their CDS's protein, the last of each; a CDS's symbol goes before the gene's."""
    rows = features(spark, path)
    gene = rows.where("type = 'gene'").select(_get("locus_tag").alias("gene_id"), _get("gene").alias("__g"), "replicon", "start", "end", "strand", "line").where("gene_id is not null")
    gene = gene.groupBy("gene_id").agg(F.max_by(F.struct("__g", "replicon", "start", "end", "strand"), F.struct("replicon", "start", "line")).alias("r")).select("gene_id", "r.*")
    cds = rows.where("type = 'CDS'").select(_get("locus_tag").alias("gene_id"), _get("protein_id").alias("protein_id"), _get("gene").alias("__c"), _get("product").alias("product"), "replicon", "start", "line").where("gene_id is not null")
    cds = cds.groupBy("gene_id").agg(F.max_by(F.struct("protein_id", "__c", "product"), F.struct("replicon", "start", "line")).alias("r")).select("gene_id", "r.*")
    return gene.join(cds, "gene_id", "left").select("gene_id", F.coalesce("__c", "__g").alias("gene_name"), "protein_id", "product", "replicon", "start", "end", "strand", (F.col("end") - F.col("start") + 1).alias("cds_length"))
