"""What people read: names of nodes, and the text of each layer of a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import present

RNA = "_RNA"


def shown_type(node: Column, known: Column, locus_prefix: str) -> Column:
    """The known type of a node; without one, what its id looks like; annotations are all others."""
    guess = F.when(node.startswith("WP_"), "protein").when(node.endswith(RNA), "transcriptome").when(node.startswith("CHEBI:"), "metabolite").when(node.startswith("AMR:"), "annotation")
    return F.coalesce(known, guess.when(node.startswith(locus_prefix), "genome").otherwise("annotation"))


def display_names(nodes: DataFrame, genes: DataFrame, metabolites: DataFrame) -> DataFrame:
    """nodes(node) with shown: the gene's name for its locus and its protein, the metabolite's for its id, with RNA behind a transcript's; else the node itself.

    genes(gene_id, gene_name, protein_id), metabolites(metabolite_id, name); of several names of an id the first in order holds.
    """
    name = F.coalesce(present(F.col("gene_name")), F.col("gene_id"))
    by_gene = genes.select(F.lit(1).alias("rank"), F.col("gene_id").alias("base"), name.alias("name"))
    by_protein = genes.where(present(F.col("protein_id")).isNotNull()).select(F.lit(2).alias("rank"), F.col("protein_id").alias("base"), name.alias("name"))
    by_metabolite = metabolites.select(F.lit(3).alias("rank"), F.col("metabolite_id").alias("base"), F.coalesce(present(F.col("name")), F.col("metabolite_id")).alias("name"))
    names = by_gene.unionByName(by_protein).unionByName(by_metabolite).where("base is not null").groupBy("base").agg(F.min(F.struct("rank", "name"))["name"].alias("__name"))
    rna = F.col("node").endswith(RNA)
    based = nodes.withColumn("base", F.when(rna, F.substring("node", F.lit(1), F.length("node") - len(RNA))).otherwise(F.col("node")))
    shown = F.when(rna, F.concat(F.coalesce("__name", "base"), F.lit(" RNA"))).otherwise(F.coalesce("__name", "node"))
    return based.join(names, "base", "left").withColumn("shown", shown).drop("base", "__name")


def shortened(text: Column, most: int) -> Column:
    """Trimmed to at most so many characters, the last of them … where more were there."""
    return F.when(F.length(F.trim(text)) > most, F.concat(F.substring(F.trim(text), 1, most - 1), F.lit("…"))).otherwise(F.trim(text))


def number_text(value: Column, digits: int = 2) -> Column:
    return F.when(value.isNull() | F.isnan(value.cast("double")), "n/a").otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def measured_text(present_: Column, value: Column, call: Column, label: str, none: str) -> Column:
    """label, change and call of direction of what was measured, n/a for either that is missing; none says that it wasn't measured."""
    return F.when(~F.coalesce(present_, F.lit(False)), none).otherwise(F.concat(F.lit(label + " "), number_text(value), F.lit(" ("), F.coalesce(present(call), F.lit("n/a")), F.lit(")")))


def counted_text(n: Column, names: Column, noun: str, none: str, most: int = 68) -> Column:
    """How many there are, and on a second line their names."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, none).otherwise(F.concat(n.cast("string"), F.lit(f" {noun}\n"), shortened(F.coalesce(names, F.lit("")), most)))
