"""Delimited measurement tables and sheets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import first_accession, is_bacterial, last_token, matching_or_all, metabolite_id, present, without_prefix
from ..functions.numeric import lenient, lenient_zero
from . import workbook

GENE_COLUMNS = ("geneid", "gene_id", "gene", "locus_tag")
NAME_COLUMNS = ("genename", "gene_name", "name", "symbol")
_SAMPLE = re.compile(r"^(?:\d+|102\.\d+\.\d+/\d+)$")


def separator(path: str) -> str:
    """By the suffix, that of .gz apart: comma for .csv, else tab."""
    plain = path[:-3] if path.lower().endswith(".gz") else path
    return "," if plain.lower().endswith(".csv") else "\t"


def wide(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A table with a header, all columns as text. Of a workbook the named sheet, or the first one; the older binary workbooks (.xls) have to be exported first."""
    if path.lower().endswith(".xls"):
        raise ValueError(f"export {path} as xlsx, csv, tsv or parquet first")
    if path.lower().endswith(".xlsx"):
        return workbook.read(spark, path, sheet)
    if path.lower().endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return spark.read.csv(path, sep=separator(path), header=True)


def _named(columns: list[str], names: tuple[str, ...]) -> str | None:
    return next((c for c in columns if c.strip().lower().replace(" ", "_") in names), None)


def expression(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, gene_name, sample_id, value: every column that names neither gene nor symbol is a sample; what isn't a number counts as 0."""
    df = wide(spark, path)
    gene = _named(df.columns, GENE_COLUMNS) or df.columns[0]
    symbol = _named([c for c in df.columns if c != gene], NAME_COLUMNS)
    samples = [c for c in df.columns if c not in (gene, symbol)]
    ids = df.select(present(F.col(f"`{gene}`")).alias("gene_id"), (F.col(f"`{symbol}`") if symbol else F.lit(None).cast("string")).alias("gene_name"), *[F.col(f"`{c}`").cast("string").alias(c) for c in samples])
    return ids.unpivot(["gene_id", "gene_name"], samples, "sample_id", "raw").where("gene_id is not null").select("gene_id", "gene_name", F.trim("sample_id").alias("sample_id"), lenient_zero(F.col("raw")).alias("value"))


def samples_named(columns: list[str], wanted: list[str]) -> dict[str, str]:
    """The column of each wanted sample: its own name, else the first that contains it."""
    out = {}
    for w in wanted:
        hits = [c for c in columns if c == w] or [c for c in columns if w in c]
        if not hits:
            raise KeyError(f"no column for sample {w}")
        out[w] = hits[0]
    return out


def protein_areas(spark: SparkSession, path: str, protein: str, templates: dict[str, str], samples: dict[str, list], sheet: str | None = None) -> DataFrame:
    """protein_id, sample_id, condition, value of an area sheet; templates name each condition's columns by {sid}.

    Samples without a column are left out. ValueError names what is missing if that is the column of proteins or all samples.
    """
    df = wide(spark, path, sheet)
    every = [(label, str(s), templates[label].format(sid=s)) for label, some in samples.items() for s in some]
    cols = [(label, s, c) for label, s, c in every if c in df.columns]
    missing = [c for c in [protein] if c not in df.columns] + ([] if cols else [c for _, _, c in every])
    if missing or not cols:
        raise ValueError(f"{path}: missing columns: {', '.join(missing) or 'of any sample'}")
    rows = F.explode(F.array(*[F.struct(F.lit(label).alias("condition"), F.lit(s).alias("sample_id"), lenient_zero(F.col(f"`{c}`")).alias("value")) for label, s, c in cols]))
    accession = without_prefix(F.trim(F.col(f"`{protein}`")), "ref|")
    return df.select(present(F.regexp_replace(accession, r"\|$", "")).alias("protein_id"), rows.alias("r")).where("protein_id is not null").select("protein_id", "r.sample_id", "r.condition", "r.value")


def protein_groups(spark: SparkSession, path: str, ids: str = "Protein IDs", headers: str | None = "Fasta headers", species: str | None = None, bacterial_only: bool = False) -> DataFrame:
    """protein_id, sample_id, value of a groups table: LFQ columns, else Intensity ones; the first accession of each group, decoys' mark taken off.

    With species, rows whose header matches (all, if none does); with bacterial_only, groups whose first verdict is that they are.
    """
    df = wide(spark, path)
    cols = [c for c in df.columns if c.startswith("LFQ intensity ")] or [c for c in df.columns if c.startswith("Intensity ")]
    if species and headers in df.columns:
        df = matching_or_all(df, headers, species)
    if bacterial_only:
        df = df.where(is_bacterial(F.col(f"`{ids}`")))
    rows = F.explode(F.array(*[F.struct(F.lit(re.sub(r"^(LFQ intensity|Intensity) ", "", c)).alias("sample_id"), lenient_zero(F.col(f"`{c}`")).alias("value")) for c in cols]))
    return df.select(without_prefix(first_accession(F.col(f"`{ids}`")), "REV__").alias("protein_id"), rows.alias("r")).where("protein_id <> ''").select("protein_id", "r.sample_id", "r.value")


def sample_sheet(spark: SparkSession, path: str, media: str = "growth media", strain: str = "strain or isolate") -> DataFrame:
    """sample_id, media, strain. Headers repeat, so columns are found by their place in the header line."""
    lines = spark.read.text(path)
    header = lines.first()
    if header is None:
        return spark.createDataFrame([], "sample_id string, media string, strain string")
    names = [c.strip().strip('"').lower() for c in header[0].split("\t")]
    at = lambda word: next((i for i, c in enumerate(names) if word in c), None)
    f = F.split("value", "\t")
    cell = lambda i: F.try_element_at(f, F.lit(i + 1)) if i is not None else F.lit(None).cast("string")
    rows = lines.where(F.col("value") != header[0]).where(F.trim("value") != "")
    return rows.select(last_token(F.trim(cell(0)), "/").alias("sample_id"), present(cell(at(media))).alias("media"), present(cell(at(strain))).alias("strain"))


def metabolite_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Long form of several assignment files: metabolite_id, name, database, formula, mz, rt, instrument, sample_id, value, row_order.

    Files that aren't there are left out; if none is, FileNotFoundError. Samples are the columns named by a number, or 102.x.y/ and a number.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    if not there:
        raise FileNotFoundError(f"none of {paths}")
    out = None
    for p in there:
        df = wide(spark, p)
        samples = [c for c in df.columns if _SAMPLE.match(c.strip())]
        get = lambda c, df=df: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
        rows = F.explode(F.array(*[F.struct(F.lit(c.strip().rsplit("/", 1)[-1]).alias("sample_id"), lenient(F.col(f"`{c}`")).alias("value")) for c in samples]))
        stem = re.sub(r"(\.[A-Za-z]+)+$", "", p.rstrip("/").rsplit("/", 1)[-1])
        part = df.select(
            metabolite_id(get("database_identifier"), get("metabolite_identification")).alias("metabolite_id"), present(get("metabolite_identification")).alias("name"), present(get("database")).alias("database"), present(get("chemical_formula")).alias("formula"),
            lenient(get("mass_to_charge")).alias("mz"), lenient(get("retention_time")).alias("rt"), F.lit(stem).alias("instrument"), rows.alias("r"),
        ).where("metabolite_id is not null").select("*", "r.sample_id", "r.value").drop("r")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("row_order", F.struct("instrument", "name", "formula", "mz", "rt"))
