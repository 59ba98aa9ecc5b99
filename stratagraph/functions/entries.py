"""Knowledge-base entries: nested JSON to one flat row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VALUE = "struct<value:string>"
_NAME = f"struct<fullName:{_VALUE},ecNumbers:array<{_VALUE}>>"
ENTRY = (
    "struct<primaryAccession:string,uniProtkbId:string,entryType:string,annotationScore:double,"
    "organism:struct<scientificName:string,taxonId:bigint>,"
    f"proteinDescription:struct<recommendedName:{_NAME},submissionNames:array<{_NAME}>,alternativeNames:array<{_NAME}>>,"
    f"genes:array<struct<geneName:{_VALUE},orderedLocusNames:array<{_VALUE}>,orfNames:array<{_VALUE}>>>,"
    f"comments:array<struct<commentType:string,texts:array<{_VALUE}>,reaction:struct<name:string,ecNumber:string>,subcellularLocations:array<struct<location:{_VALUE}>>>>,"
    "keywords:array<struct<id:string,name:string,category:string>>,"
    "uniProtKBCrossReferences:array<struct<database:string,id:string,properties:array<struct<key:string,value:string>>>>,"
    "sequence:struct<length:bigint>>"
)


def _or_empty(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _texts(comments: Column, kind: str) -> Column:
    of_kind = F.filter(comments, lambda c: c["commentType"] == kind)
    return F.array_join(F.flatten(F.transform(of_kind, lambda c: F.transform(c["texts"], lambda t: t["value"]))), "; ")


def entries(df: DataFrame, column: str = "json") -> DataFrame:
    """A row per entry of the JSON texts in column; texts that aren't JSON give none."""
    e = df.select(F.from_json(column, ENTRY).alias("e")).where("e.primaryAccession is not null").select("e.*")
    xrefs = _or_empty(F.col("uniProtKBCrossReferences"), "array<struct<database:string,id:string,properties:array<struct<key:string,value:string>>>>")
    comments = _or_empty(F.col("comments"), "array<struct<commentType:string,texts:array<struct<value:string>>,reaction:struct<name:string,ecNumber:string>,subcellularLocations:array<struct<location:struct<value:string>>>>>")
    description = F.col("proteinDescription")
    submitted = F.try_element_at(description["submissionNames"], F.lit(1))
    gene = F.try_element_at(F.col("genes"), F.lit(1))
    ec_named = F.transform(description["recommendedName"]["ecNumbers"], lambda x: x["value"])
    ec_reaction = F.transform(F.filter(comments, lambda c: (c["commentType"] == "CATALYTIC ACTIVITY") & c["reaction"]["ecNumber"].isNotNull()), lambda c: c["reaction"]["ecNumber"])
    ec_xref = F.transform(F.filter(xrefs, lambda x: x["database"] == "EC"), lambda x: x["id"])
    no_text = F.array().cast("array<string>")
    located = F.filter(comments, lambda c: (c["commentType"] == "SUBCELLULAR LOCATION") & c["subcellularLocations"].isNotNull())

    def aspect(letter: str) -> Column:
        term = lambda x: F.filter(x["properties"], lambda p: (p["key"] == "GoTerm") & p["value"].startswith(letter + ":"))
        return F.array_sort(F.transform(F.filter(xrefs, lambda x: (x["database"] == "GO") & (F.size(F.coalesce(term(x), F.array().cast("array<struct<key:string,value:string>>"))) > 0)), lambda x: x["id"]))

    def references(database: str) -> Column:
        return F.array_join(F.transform(F.filter(xrefs, lambda x: x["database"] == database), lambda x: x["id"]), ";")

    return e.select(
        F.col("primaryAccession").alias("accession"),
        F.col("uniProtkbId").alias("entry_name"),
        F.coalesce(gene["geneName"]["value"], F.try_element_at(gene["orderedLocusNames"], F.lit(1))["value"]).alias("gene_name"),
        F.coalesce(description["recommendedName"]["fullName"]["value"], submitted["fullName"]["value"]).alias("protein_name"),
        F.array_join(F.transform(description["alternativeNames"], lambda n: n["fullName"]["value"]), "; ").alias("alternative_names"),
        _texts(comments, "FUNCTION").alias("function"),
        _texts(comments, "PATHWAY").alias("pathway"),
        F.array_join(F.flatten(F.transform(located, lambda c: F.transform(c["subcellularLocations"], lambda s: s["location"]["value"]))), "; ").alias("locations"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce(ec_named, no_text), F.coalesce(ec_reaction, no_text), F.coalesce(ec_xref, no_text)))), ";").alias("ec_numbers"),
        F.transform(F.col("keywords"), lambda k: k["name"]).alias("keywords"),
        aspect("P").alias("go_bp"),
        aspect("F").alias("go_mf"),
        aspect("C").alias("go_cc"),
        references("KEGG").alias("kegg"),
        references("RefSeq").alias("refseq"),
        references("STRING").alias("string_id"),
        F.col("organism.scientificName").alias("organism"),
        F.col("organism.taxonId").alias("taxon_id"),
        F.col("sequence.length").alias("length"),
        F.col("annotationScore").alias("score"),
        F.coalesce(F.col("entryType").contains("Swiss-Prot"), F.lit(False)).alias("reviewed"),
    )


def go_terms(df: DataFrame) -> DataFrame:
    """(accession, aspect, go_id) of rows of entries()."""
    return df.select("accession", F.explode(F.create_map(*[x for k in ("bp", "mf", "cc") for x in (F.lit(k), F.col(f"go_{k}"))])).alias("aspect", "ids")).select("accession", "aspect", F.explode("ids").alias("go_id"))


def coverage(df: DataFrame) -> DataFrame:
    """How many entries have each kind of annotation, and how many of it on average."""
    has = lambda c: F.count_if(F.coalesce(F.length(c), F.lit(0)) > 0)
    n_go = F.size("go_bp") + F.size("go_mf") + F.size("go_cc")
    return df.agg(
        F.count("*").alias("entries"),
        F.count_if("reviewed").alias("reviewed"),
        has("function").alias("with_function"),
        has("ec_numbers").alias("with_ec"),
        F.count_if(n_go > 0).alias("with_go"),
        F.avg(n_go).alias("avg_go"),
        F.avg(F.greatest(F.size("keywords"), F.lit(0))).alias("avg_keywords"),
    )
