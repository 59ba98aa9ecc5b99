"""Bringing layers together by bridges of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .windows import first_non_null, keep_first

#: Names asked for that are sent to each task (a few MB); more are shuffled with the entries.
FEW = 100_000


def bridge(df: DataFrame, source: str, target: str, order: list[str], by: list[str] = []) -> DataFrame:
    """(by, source, target): the last row of each source by the given order, which is part of the data."""
    rows = df.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    return rows.groupBy(*by, source).agg(F.max_by(target, F.struct(*order)).alias(target))


def through_bridge(df: DataFrame, links: DataFrame, source: str) -> DataFrame:
    """df with the bridge's target; rows without one go."""
    return df.join(links, source)


def aligned(measured: DataFrame, protein: DataFrame, key: list[str], order: list[str], has_measured: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """protein joined to measured, one row per key, the first by order.

    With has_measured(by), groups that aren't in it have no measurements at all: their rows stay, with nulls; elsewhere rows without a measurement go.
    """
    if has_measured is None:
        both = protein.join(measured, key)
    else:
        flag = has_measured.select(by).distinct().withColumn("__has", F.lit(True))
        both = protein.join(flag, by, "left").join(measured.withColumn("__found", F.lit(True)), key, "left")
        both = both.where(F.col("__found") | F.col("__has").isNull()).drop("__has", "__found")
    return keep_first(both, key, [F.col(c) for c in order])


def attributes(df: DataFrame, genes: DataFrame, key: list[str], columns: list[str], order: str) -> DataFrame:
    """df with each column's first value for its key that isn't null."""
    return df.join(first_non_null(genes, key, columns, order), key, "left")


def aligned_all_loci(genes: DataFrame, protein: DataFrame, rna: DataFrame, protein_key: str, gene_key: str, order: list[str]) -> DataFrame:
    """Every locus that encodes a measured protein, with its expression; one row per gene."""
    return keep_first(genes.join(protein, protein_key).join(rna, gene_key), [gene_key], [F.col(c) for c in order])


def by_priority(df: DataFrame, key: str, lookups: list[tuple[DataFrame, Column]], target: str, name: str) -> DataFrame:
    """df with name: target of the first lookup(key, target) that has it; each is asked with its own form of the key. Lookups have unique keys."""
    out, found = df, []
    for i, (table, form) in enumerate(lookups):
        t = table.select(F.col(key).alias(f"__k{i}"), F.col(target).alias(f"__t{i}"))
        out = out.join(t, form == F.col(f"__k{i}"), "left")
        found.append(F.col(f"__t{i}"))
    return out.withColumn(name, F.coalesce(*found)).select(*df.columns, name)


def row_or_fallback(df: DataFrame, first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All columns from first where it has the row, else all from second."""
    a = first.select(F.col(key).alias("__ka"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = second.select(F.col(key).alias("__kb"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    both = df.join(a, F.col(key) == F.col("__ka"), "left").join(b, F.col(key) == F.col("__kb"), "left")
    return both.select(*[F.col(c) for c in df.columns], *[F.when(F.col("__ka").isNotNull(), F.col(f"__a_{c}")).otherwise(F.col(f"__b_{c}")).alias(c) for c in columns])


def name_match(df: DataFrame, query: str, names: DataFrame, key: str, text: str, position: str) -> DataFrame:
    """(query, key): the entry of that name whatever the case, else the first that begins so, else the first whose name contains it.

    Joined on the first three letters for the first two classes; only what these leave is looked for inside names, by trigrams of both sides.
    """
    lower = lambda c: F.lower(F.trim(F.col(c)))
    head = lambda c: F.substring(c, 1, 3)
    asked = settle(df.select(query).where(F.col(query).isNotNull()).distinct().withColumn("__q", lower(query)).where("length(__q) > 0"), "asked")
    entries = names.select(key, F.col(position).alias("__p"), lower(text).alias("__t"))
    near = _few(asked).withColumn("__h", head(F.col("__q"))).join(entries.withColumn("__h", head(F.col("__t"))).hint("merge"), "__h").where(F.startswith("__t", "__q"))
    grade = F.when(F.col("__t") == F.col("__q"), 0).otherwise(1)
    best = settle(near.groupBy(query).agg(F.min_by(key, F.struct(grade.alias("g"), "__p")).alias(key)), "named")
    left = settle(asked.join(best, query, "left_anti").where("length(__q) >= 3").withColumn("__g", head(F.col("__q"))), "unnamed")
    grams = entries.withColumn("__g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("__t") - 2, F.lit(1))), lambda i: F.substring(F.col("__t"), i, F.lit(3))))))
    inside = _few(left).join(grams.hint("merge"), "__g").where(F.contains("__t", "__q"))
    return best.unionByName(inside.groupBy(query).agg(F.min_by(key, "__p").alias(key)))


def _few(asked: DataFrame) -> DataFrame:
    """asked, to be broadcast if it has at most FEW rows. The other side of its joins is names, which never are: Spark takes exploded trigrams to be as small as the file that they come from."""
    return F.broadcast(asked) if asked.limit(FEW + 1).count() <= FEW else asked


def resolved_aliases(queries: DataFrame, aliases: DataFrame, taxa: list[int], fold_case: bool = True) -> DataFrame:
    """queries(query, position) with target, taxon, matched (exact or folded), n_targets, ambiguous, and canonical: whether the query is the first that maps to its target.

    aliases(alias, taxon, target, score) may hold an alias several times. Of its hits the best is an exact match before one in another case, of the first of taxa that has any, of the largest score, and the least
    target; taxa that aren't listed don't count. Queries without a hit stay, with nulls: they are what is unmapped. Empty queries go.
    """
    place = F.array_position(F.array(*[F.lit(t) for t in taxa]).cast("array<bigint>"), F.col("taxon").cast("bigint"))
    known = aliases.where(F.trim("alias") != "").select(F.trim("alias").alias("alias"), "taxon", "target", "score", place.alias("__place")).where("__place > 0")
    own = queries.select(F.trim("query").alias("query"), "position").where("query <> ''").groupBy("query").agg(F.min("position").alias("position"))
    key = F.lower if fold_case else (lambda c: F.col(c))
    hits = own.withColumn("__key", key("query")).join(known.withColumn("__key", key("alias")), "__key")
    exact = F.col("alias") == F.col("query")
    merit = F.struct(exact.cast("int").alias("e"), (-F.col("__place")).alias("p"), F.coalesce("score", F.lit(float("-inf"))).alias("s"))
    best = hits.groupBy("query").agg(F.max(merit).alias("m"), F.countDistinct("taxon", "target").alias("n_targets"))
    tied = hits.withColumn("__m", merit).join(best, "query").where(F.col("__m") == F.col("m"))
    chosen = tied.groupBy("query", "n_targets").agg(F.min_by(F.struct("target", "taxon", F.when(exact, "exact").otherwise("folded").alias("matched")), F.struct("target", "taxon")).alias("h"), (F.countDistinct("target") > 1).alias("ambiguous"))
    out = own.join(chosen.select("query", "h.target", "h.taxon", "h.matched", "n_targets", "ambiguous"), "query", "left").fillna(0, ["n_targets"]).fillna(False, ["ambiguous"])
    first = out.where("target is not null").groupBy("target").agg(F.min("position").alias("__first"))
    return out.join(first, "target", "left").select("query", "position", "target", "taxon", "matched", "n_targets", "ambiguous", F.coalesce(F.col("position") == F.col("__first"), F.lit(False)).alias("canonical"))
