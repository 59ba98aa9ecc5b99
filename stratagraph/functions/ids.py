"""Identifiers: trimming, versions, prefixes, delimited lists and types by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 26 functional categories and what they stand for.
CATEGORIES = {
    "A": "RNA processing and modification",
    "B": "Chromatin structure and dynamics",
    "C": "Energy production and conversion",
    "D": "Cell cycle control, cell division, chromosome partitioning",
    "E": "Amino acid transport and metabolism",
    "F": "Nucleotide transport and metabolism",
    "G": "Carbohydrate transport and metabolism",
    "H": "Coenzyme transport and metabolism",
    "I": "Lipid transport and metabolism",
    "J": "Translation, ribosomal structure and biogenesis",
    "K": "Transcription",
    "L": "Replication, recombination and repair",
    "M": "Cell wall/membrane/envelope biogenesis",
    "N": "Cell motility",
    "O": "Post-translational modification, protein turnover, chaperones",
    "P": "Inorganic ion transport and metabolism",
    "Q": "Secondary metabolites biosynthesis, transport and catabolism",
    "R": "General function prediction only",
    "S": "Function unknown",
    "T": "Signal transduction mechanisms",
    "U": "Intracellular trafficking, secretion, and vesicular transport",
    "V": "Defense mechanisms",
    "W": "Extracellular structures",
    "X": "Mobilome: prophages, transposons",
    "Y": "Nuclear structure",
    "Z": "Cytoskeleton",
}
UNKNOWN_CATEGORY = "S"


def present(c: Column) -> Column:
    """Trimmed text; null where that is empty. Empty and missing mean the same in all inputs."""
    return F.nullif(F.trim(c), F.lit(""))


def canonical_accession(c: Column) -> Column:
    """Drops the version of WP_ accessions; other ids stay as they are."""
    return F.regexp_replace(F.trim(c), r"^(WP_\d+)\.\d+$", "$1")


def unversioned(c: Column) -> Column:
    """Drops the numeric tail after the last dot of any id."""
    return F.regexp_replace(F.trim(c), r"\.\d+$", "")


def before_dot(c: Column) -> Column:
    return F.split_part(F.trim(c), F.lit("."), F.lit(1))


def first_accession(c: Column, delimiter: str = ";") -> Column:
    return F.trim(F.split_part(c, F.lit(delimiter), F.lit(1)))


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def last_token(c: Column, delimiter: str) -> Column:
    return F.element_at(F.split(c, "\\Q" + delimiter + "\\E"), -1)


def metabolite_id(database_id: Column, name: Column) -> Column:
    """CHEBI:n where the database id is one, else M-<name>, else null."""
    plain = present(name)
    return F.when(F.trim(database_id).rlike(r"^CHEBI:\d+$"), F.trim(database_id)).when(plain.isNotNull(), F.concat(F.lit("M-"), plain))


def is_bacterial(accessions: Column) -> Column:
    """Walks the ; list: the first decoy or contaminant says no, the first WP_ accession yes; no decision is no."""
    verdicts = F.transform(
        F.split(F.coalesce(accessions, F.lit("")), ";"),
        lambda x: F.when(F.trim(x).startswith("REV__") | F.trim(x).startswith("CON__"), F.lit(False)).when(F.trim(x).startswith("WP_"), F.lit(True)),
    )
    return F.coalesce(F.try_element_at(F.filter(verdicts, lambda v: v.isNotNull()), F.lit(1)), F.lit(False))


def matching_or_all(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column matches the pattern, whatever the case; all rows if none does."""
    hit = F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False))
    any_hit = df.agg(F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("__any"))
    return df.crossJoin(F.broadcast(any_hit)).where(hit | (F.col("__any") == 0)).drop("__any")  # one row


def listed(c: Column, delimiter: str = ",", junk: tuple[str, ...] = ("", "-", "nan")) -> Column:
    """The entries of a delimited list, trimmed, without junk and repeats, in order of first occurrence."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "\\Q" + delimiter + "\\E"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: ~x.isin(*junk)))


def category_letters(c: Column) -> Column:
    """The category letters of a string, one entry each, in order of first occurrence."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x.isin(*CATEGORIES)))


def category_label(letter: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return F.concat(letter, F.lit(" ("), F.coalesce(F.try_element_at(names, letter), F.lit("Unknown")), F.lit(")"))


def node_type(c: Column) -> Column:
    """Kind of a hypergraph node by its id, for nodes that come without one."""
    return F.when(c.endswith("_RNA"), "transcriptome").when(c.startswith("AMR:"), "amr").when(c.startswith("WP_") | c.contains("."), "protein").otherwise("genome")


def joined(c: Column, delimiter: str = ";") -> Column:
    """Sorted distinct entries as text."""
    return F.array_join(F.array_sort(F.array_distinct(c)), delimiter)
