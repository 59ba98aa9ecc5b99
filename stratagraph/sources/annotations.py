"""Annotation files and snapshots of knowledge bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.entries import entries
from ..functions.ids import UNKNOWN_CATEGORY, canonical_accession, present
from ..functions.numeric import lenient
from ..operators.windows import filled_forward
from .tables import wide


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def orthologs(spark: SparkSession, path: str, gene: str = "GeneID", category: str = "COG_category") -> DataFrame:
    """A precomputed table with at least these two columns; others stay."""
    return required(wide(spark, path), [gene, category])


def mapper_annotations(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, category, description, preferred_name, kegg_ko, kegg_pathway of a mapper's annotation file.

    The header is the comment that has seed_ortholog; other comments are left out. A missing category is the unknown one, a missing description Unknown; ids lose
    their version, and of a repeated id the last line counts.
    """
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__line"))
    head = rows.where(F.startswith("value", F.lit("#")) & F.contains("value", F.lit("seed_ortholog"))).orderBy("__line").first()
    if head is None:
        raise ValueError(f"{path} has no header line")
    names = head["value"].lstrip("#").strip().split("\t")
    body = rows.where(~F.startswith("value", F.lit("#"))).withColumn("f", F.split("value", "\t"))
    cell = lambda *options: F.coalesce(*[F.try_element_at("f", F.lit(names.index(o) + 1)) for o in options if o in names], F.lit(""))
    kept = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("-")), F.lit(""))
    out = body.select(
        canonical_accession(cell("query_name", "query")).alias("gene_id"), F.coalesce(F.nullif(kept(cell("COG_category")), F.lit("")), F.lit(UNKNOWN_CATEGORY)).alias("category"), F.coalesce(present(cell("Description")), F.lit("Unknown")).alias("description"),
        F.trim(cell("Preferred_name")).alias("preferred_name"), F.trim(cell("KEGG_ko", "KEGG_KO")).alias("kegg_ko"), F.trim(cell("KEGG_Pathway")).alias("kegg_pathway"), "__file", "__line",
    )
    rest = ["category", "description", "preferred_name", "kegg_ko", "kegg_pathway"]
    return out.where("gene_id <> ''").groupBy("gene_id").agg(F.max_by(F.struct(*rest), F.struct("__file", "__line")).alias("r")).select("gene_id", "r.*")


def entry_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a snapshot with one JSON document per line; what no executor should ask a service for."""
    return entries(spark.read.text(path), "value")


def entry_bridge(flat: DataFrame) -> DataFrame:
    """(protein_id, accession) candidates of entries by their references, without versions."""
    return flat.select(F.explode(F.split("refseq", ";")).alias("p"), "accession", "taxon_id", "reviewed", "score").where("p <> ''").select(canonical_accession(F.col("p")).alias("protein_id"), "accession", "taxon_id", "reviewed", "score")


def best_entries(bridge: DataFrame, taxon: int) -> DataFrame:
    """One accession per protein: of the organism before others, then reviewed, then by score and id."""
    merit = F.struct((F.col("taxon_id") == taxon).alias("o"), "reviewed", "score", "accession")
    return bridge.groupBy("protein_id").agg(F.max_by("accession", merit).alias("accession"))


def mapped_entries(ids: DataFrame, flat: DataFrame, taxon: int) -> DataFrame:
    """(protein_id, accession, position) of ids(protein_id, position): the best entry of each that has any, by its id without version; of forms of one id the first counts."""
    own = ids.where(present(F.col("protein_id")).isNotNull()).groupBy(canonical_accession(F.col("protein_id")).alias("protein_id")).agg(F.min("position").alias("position"))
    return own.join(best_entries(entry_bridge(flat), taxon), "protein_id").select("protein_id", "accession", "position")


def annotated(ids: DataFrame, flat: DataFrame, taxon: int) -> DataFrame:
    """flat's rows of the entries that ids map to, each once (of an accession's rows the last by position counts, if flat has one), with protein_id: the first id that maps to it."""
    rows = flat.groupBy("accession").agg(F.max_by(F.struct(*[c for c in flat.columns if c != "accession"]), F.col("position") if "position" in flat.columns else F.struct("reviewed", "score")).alias("r")).select("accession", "r.*")
    back = mapped_entries(ids, flat, taxon).groupBy("accession").agg(F.min_by("protein_id", "position").alias("protein_id"))
    return rows.drop("position").join(back, "accession")


def annotation_stats(ids: DataFrame, flat: DataFrame, taxon: int, terms: str = "n_terms") -> DataFrame:
    """One row: requested (ids without versions), mapped, coverage, annotated (entries), reviewed, unreviewed, missing (mapped to no row), mean_terms."""
    found = mapped_entries(ids, flat, taxon)
    wanted = ids.select(canonical_accession(F.col("protein_id")).alias("protein_id")).where(present(F.col("protein_id")).isNotNull()).distinct()
    rows = annotated(ids, flat, taxon)
    one = wanted.agg(F.count(F.lit(1)).alias("requested")).crossJoin(found.agg(F.count(F.lit(1)).alias("mapped")))  # one row each
    own = rows.agg(F.count(F.lit(1)).alias("annotated"), F.count_if("reviewed").alias("reviewed"), F.count_if(~F.col("reviewed")).alias("unreviewed"), F.avg(terms).alias("mean_terms"))
    return one.crossJoin(own).withColumn("coverage", F.col("mapped") / F.greatest(F.col("requested"), F.lit(1))).withColumn("missing", F.lit(0) + F.greatest(F.col("mapped") - F.col("annotated"), F.lit(0)))


def interactions(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """protein_a, protein_b and their scores from a snapshot of a network, those of at least so much combined."""
    df = wide(spark, path)
    scores = [c for c in df.columns if c.endswith("_score")]
    return df.select(present(F.col(df.columns[0])).alias("protein_a"), present(F.col(df.columns[1])).alias("protein_b"), *[lenient(F.col(f"`{c}`")).alias(c) for c in scores]).where(F.coalesce(F.col("combined_score"), F.lit(0.0)) >= least)


def link_table(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """Two columns without a header, ids without what stands before the colon."""
    df = spark.read.csv(path, sep="\t", schema="a string, b string")
    bare = lambda c: F.element_at(F.split(F.trim(c), ":"), -1)
    return df.select(bare(F.col("a")).alias(source), bare(F.col("b")).alias(target)).where(F.col(source) != "").distinct()


def name_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """id and name: names separate their synonyms by ;, each is a row with its place."""
    df = spark.read.csv(path, sep="\t", schema="a string, b string")
    return df.select(F.element_at(F.split(F.trim("a"), ":"), -1).alias(key), F.posexplode(F.split("b", ";")).alias("position", "name")).select(key, "position", F.trim("name").alias("name"))


def compound_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flat files of one compound each, named by it: (compound, name, formula), (compound, ec), (compound, pathway, pathway_name).

    A line that doesn't begin with a blank opens a block, others go on with it; /// ends the record. Only full EC numbers and pathways of the map kind stay.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("compound"), "value")
    body = F.split_part("value", F.lit("\n//"), F.lit(1))
    lines = whole.select("compound", F.posexplode(F.split(body, "\r?\n")).alias("n", "line")).where(F.trim("line") != "")
    head = F.when(~F.startswith("line", F.lit(" ")), F.split_part("line", F.lit(" "), F.lit(1)))
    blocks = filled_forward(lines.withColumn("head", head), ["compound"], ["n"], "head", "block")
    text = F.trim(F.when(F.col("head").isNotNull(), F.substr("line", F.length("head") + 1)).otherwise(F.col("line")))
    blocks = blocks.withColumn("text", text)
    opened = blocks.where("head is not null")
    first = lambda name: F.expr(f"min_by(text, n) FILTER (WHERE block = '{name}')")
    info = opened.groupBy("compound").agg(F.rtrim(F.regexp_replace(first("NAME"), ";$", "")).alias("name"), first("FORMULA").alias("formula"))
    ec = blocks.where("block = 'ENZYME'").select("compound", F.explode(F.split("text", r"\s+")).alias("ec")).where(F.col("ec").rlike(r"^\d+\.\d+\.\d+\.\d+$")).distinct()
    pathway = blocks.where("block = 'PATHWAY'").select("compound", F.split("text", r"\s+", 2).alias("f")).where(F.size("f") == 2).select("compound", F.col("f")[0].alias("pathway"), F.col("f")[1].alias("pathway_name"))
    return info, ec, pathway.where(F.lower("pathway").startswith("map")).distinct()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """strain, marker, name, amr_class, locus_tags, protein_ids, source: ids that are one text, a list or null become lists."""
    doc = spark.read.text(path, wholetext=True)
    markers = doc.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("strain", "m")).select("strain", F.explode("m").alias("marker", "record"))
    fields = "name string, amr_class string, locus_tag string, protein_id string, source string, note string"
    r = markers.select("strain", "marker", F.from_json("record", fields).alias("r"))

    def as_list(c):
        many = F.from_json(c, "array<string>")
        return F.filter(F.coalesce(F.when(F.startswith(c, F.lit("[")), many).when(F.trim(c) != "", F.array(c)), F.array().cast("array<string>")), lambda x: F.trim(x) != "")

    return r.select("strain", "marker", F.coalesce("r.name", "marker").alias("name"), "r.amr_class", as_list(F.col("r.locus_tag")).alias("locus_tags"), as_list(F.col("r.protein_id")).alias("protein_ids"), "r.source")


def marker_loci(markers: DataFrame, first_only: bool = False) -> DataFrame:
    """strain, marker, amr_class, locus_tag, protein_id: a row for every locus (or the first) with the protein in the same place."""
    rows = markers.select("strain", "marker", "amr_class", "protein_ids", F.posexplode_outer("locus_tags").alias("n", "locus_tag"))
    out = rows.select("strain", "marker", "amr_class", "locus_tag", F.try_element_at("protein_ids", F.coalesce(F.col("n"), F.lit(0)) + 1).alias("protein_id"), "n")
    return (out.where(F.coalesce(F.col("n"), F.lit(0)) == 0) if first_only else out).drop("n")


def class_counts(markers: DataFrame) -> DataFrame:
    return markers.select("strain", "amr_class", F.explode("locus_tags").alias("locus")).groupBy("strain", "amr_class").agg(F.countDistinct("locus").alias("n_loci"))


