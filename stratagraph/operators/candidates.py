"""Candidates: entities around the determinants, ranked, with the tail of a binomial as their chance."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_accession
from ..session import settle
from .evidence import ANNOTATION, DIRECT, GRAPH, INFERRED
from .ordering import numbered
from .windows import bh_adjust

HUB_SHARE, SIGNIFICANT = 0.75, 0.05
ENTITY_TYPES = {"genome": "gene", "proteome": "protein", "metabolome": "metabolite"}


def candidates(evidence: DataFrame, known: DataFrame) -> DataFrame:
    """(candidate, entity_type) with what leads to them; known(strain, target_layer, entity) are the determinants' own loci and proteins."""
    kind = F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair])
    rows = evidence.withColumn("entity_type", F.try_element_at(kind, F.col("target_layer"))).where(F.col("entity_type").isNotNull())
    rows = rows.where((F.coalesce(F.col("target_entity"), F.lit("")) != "") & ~F.col("target_entity").eqNullSafe(F.col("source_entity")))
    rows = rows.withColumn("entity", canonical_accession(F.col("target_entity"))).join(known.select("strain", "target_layer", canonical_accession(F.col("entity")).alias("entity")).distinct(), ["strain", "target_layer", "entity"], "left_anti")
    texts = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    n = lambda level: F.count_if(F.col("evidence_type") == level)
    return rows.groupBy(F.col("target_entity").alias("candidate"), "entity_type").agg(
        F.countDistinct("strain", "amr_determinant").alias("n_determinants"),
        F.countDistinct("strain").alias("n_strains"),
        texts("target_layer").alias("layers_supported"),
        F.min("path_length").alias("min_path"),
        texts("evidence_type").alias("evidence_types"),
        n(DIRECT).alias("n_direct"),
        n(GRAPH).alias("n_graph"),
        n(ANNOTATION).alias("n_annotation"),
        n(INFERRED).alias("n_inferred"),
        texts("strain").alias("strains"),
        texts("amr_determinant").alias("determinants"),
    ).withColumn("repeated_across_strains", F.col("n_strains") >= 2)


def with_hubs(df: DataFrame, n: str = "n_determinants", share: float = HUB_SHARE) -> DataFrame:
    """determinant_fraction of the largest count, and whether that makes it a hub."""
    top = df.agg(F.max(n).alias("__top"))
    out = df.crossJoin(F.broadcast(top))  # one row
    return out.withColumn("determinant_fraction", F.when(F.col("__top") > 0, F.col(n) / F.col("__top")).otherwise(0.0)).withColumn("hub_candidate", F.col(n) >= F.col("__top") * share).drop("__top")


#: Terms of Stirling's series for the logarithm of the gamma function, by odd powers of 1 / z; fixed values.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_SMALLEST = 1e-300


def log_gamma(z: Column) -> Column:
    """For z >= 1: Stirling's series 10 further on, less the logarithm of what lies between."""
    y = z + 10.0
    series = reduce(lambda total, k: total + _STIRLING[k] / F.pow(y, F.lit(2 * k + 1)), range(len(_STIRLING)), F.lit(0.0))
    between = reduce(lambda a, b: a * b, [z + float(k) for k in range(10)])
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(between)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function for 0 < x < 1 and a, b >= 1: a continued fraction, of as many steps as the root of a and b asks for."""

    def fraction(x: Column, a: Column, b: Column) -> Column:
        off = lambda v: F.when(F.abs(v) < _SMALLEST, _SMALLEST).otherwise(v)

        def step(state: Column, m: Column) -> Column:
            c, d, h = state["c"], state["d"], state["h"]
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d1, c1 = 1 / off(1 + even * d), off(1 + even / c)
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d2, c2 = 1 / off(1 + odd * d1), off(1 + odd / c1)
            return F.struct(c2.alias("c"), d2.alias("d"), (h * d1 * c1 * d2 * c2).alias("h"))

        first = 1 / off(1 - (a + b) * x / (a + 1))
        steps = F.sequence(F.lit(1), (F.lit(60) + 6 * F.sqrt(F.greatest(a, b))).cast("int"))
        ended = F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), lambda s, m: step(s, m.cast("double")))
        return F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)) * ended["h"] / a

    return F.when(x < (a + 1) / (a + b + 2), fraction(x, a, b)).otherwise(1 - fraction(1 - x, b, a))


def binomial_tails(df: DataFrame, k: str, s: str, n: str, name: str = "p_value") -> DataFrame:
    """P(X >= k) for X of Binomial(s, 1/n); 1 for k <= 0, null for n <= 1 or s <= 0.

    The tail is an incomplete beta function, worked out once for each distinct (k, s, n), in steps that grow as the root of s.
    """
    cases = df.select(F.col(k).cast("long").alias("__tail_k"), F.col(s).cast("long").alias("__tail_s"), F.col(n).cast("long").alias("__tail_n")).distinct()
    valid = cases.where((F.col("__tail_n") > 1) & (F.col("__tail_s") > 0) & (F.col("__tail_k") > 0) & (F.col("__tail_k") <= F.col("__tail_s")))
    a, b = F.col("__tail_k").cast("double"), (F.col("__tail_s") - F.col("__tail_k") + 1).cast("double")
    tails = valid.withColumn("__tail_p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), incomplete_beta(F.lit(1.0) / F.col("__tail_n"), a, b))))
    on = [F.col(k).cast("long") == F.col("__tail_k"), F.col(s).cast("long") == F.col("__tail_s"), F.col(n).cast("long") == F.col("__tail_n")]
    out = df.join(tails, on[0] & on[1] & on[2], "left")
    value = F.when((F.col(n) <= 1) | (F.col(s) <= 0), F.lit(None).cast("double")).when(F.col(k) <= 0, 1.0).when(F.col(k) > F.col(s), 0.0).otherwise(F.col("__tail_p"))
    return out.withColumn(name, value).drop("__tail_k", "__tail_s", "__tail_n", "__tail_p")


def with_enrichment(df: DataFrame, n: str = "n_determinants") -> DataFrame:
    """p_value, q_value and enrichment_significant: an entity's count against the total of its type, dealt evenly over the type's candidates."""
    df = settle(df, "candidates")  # three plans read it
    pool = df.groupBy("entity_type").agg(F.sum(n).alias("__S"), F.count(F.lit(1)).alias("__N"))
    tested = binomial_tails(df.join(F.broadcast(pool), "entity_type"), n, "__S", "__N").drop("__S", "__N")  # a row per type
    return bh_adjust(tested, "p_value", ["candidate", "entity_type"]).withColumn("enrichment_significant", F.coalesce(F.col("q_value") <= SIGNIFICANT, F.lit(False)))


def with_measured(df: DataFrame, quantified: DataFrame) -> DataFrame:
    """n_measured_strains: strains of quantified(strain, entity, entity_type) in which the candidate itself was measured; proteins by their canonical accession."""
    own = quantified.select("entity_type", canonical_accession(F.col("entity")).alias("__e"), "strain").distinct().groupBy("entity_type", "__e").agg(F.countDistinct("strain").alias("n_measured_strains"))
    return df.withColumn("__e", canonical_accession(F.col("candidate"))).join(own, ["entity_type", "__e"], "left").drop("__e").fillna(0, ["n_measured_strains"])


def ranked(df: DataFrame) -> DataFrame:
    """Hubs last, then by determinants, strains, path and direct observations; ids break ties."""
    order = [F.col("hub_candidate"), F.desc("n_determinants"), F.desc("n_strains"), F.col("min_path"), F.desc("n_direct"), F.col("candidate"), F.col("entity_type")]
    return numbered(df, order)
