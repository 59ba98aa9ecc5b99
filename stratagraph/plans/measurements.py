"""Queries of quantification, alignment and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.numeric import agreement, lenient, lenient_zero, log2_plus_one, log2_ratio, regulation
from ..operators import align, quant, sets, windows
from .registry import Tables, query


# Means of amounts in cents fall on halves of the last digit; a small constant on both sides keeps rounding off them.
def _r(c: str, digits: int = 6) -> F.Column:
    return F.round(c, digits).alias(c)


@query(
    "A1 P11 A8",
    """
WITH m AS (SELECT l_partkey AS entity, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS q_A, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS q_R FROM lineitem GROUP BY 1)
SELECT entity, round(q_A, 6) AS q_A, round(q_R, 6) AS q_R, round(q_R - q_A, 6) AS q_logFC, CASE WHEN q_R - q_A > 1 THEN 'Up' WHEN q_R - q_A < -1 THEN 'Down' ELSE 'Stable' END AS regulation FROM m""",
)
def condition_summary(t: Tables) -> DataFrame:
    rows = t("lineitem").select(F.col("l_partkey").alias("entity"), "l_returnflag", "l_quantity")
    m = quant.condition_means(rows, ["entity"], "l_returnflag", "l_quantity", "A", "R", "q")
    return quant.with_regulation(m, "q_logFC", "regulation").select("entity", _r("q_A"), _r("q_R"), _r("q_logFC"), "regulation")


@query(
    "P11",
    """
WITH m AS (SELECT l_suppkey AS entity, avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) - avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS c FROM lineitem GROUP BY 1), s AS (SELECT stddev_samp(c) AS sd FROM m)
SELECT entity, round(c, 4) AS change, CASE WHEN c > sd THEN 'Up' WHEN c < -sd THEN 'Down' ELSE 'Stable' END AS regulation FROM m, s""",
)
def regulation_std(t: Tables) -> DataFrame:
    m = quant.condition_means(t("lineitem"), ["l_suppkey"], "l_returnflag", "l_extendedprice", "A", "R", "p")
    return quant.with_regulation(m, "p_logFC", "regulation", deviations=1.0).select(F.col("l_suppkey").alias("entity"), F.round("p_logFC", 4).alias("change"), "regulation")


@query(
    "P4 P3 S4",
    """
WITH v AS (SELECT l_suppkey AS entity, l_linenumber AS sample, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2), s AS (SELECT sample, sum(value) AS total FROM v GROUP BY 1)
SELECT entity, v.sample, round(CASE WHEN total > 0 THEN value / total * 1e6 ELSE 0 END, 4) AS cpm, round(log2(CASE WHEN total > 0 THEN value / total * 1e6 ELSE 0 END + 1), 6) AS log2_cpm FROM v JOIN s ON v.sample = s.sample""",
)
def cpm_log2(t: Tables) -> DataFrame:
    v = t("lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("sample")).agg(F.sum("l_quantity").alias("value"))
    out = quant.counts_per_million(v, "sample", "value")
    return out.select("entity", "sample", F.round("cpm", 4).alias("cpm"), F.round(log2_plus_one(F.col("cpm")), 6).alias("log2_cpm"))


@query(
    "A2",
    """
SELECT l_suppkey AS entity, round(log2(avg(l_quantity) FILTER (WHERE l_returnflag = 'R') + 1) - log2(avg(l_quantity) FILTER (WHERE l_returnflag = 'A') + 1), 6) AS log_of_mean,
       round(avg(log2(l_quantity + 1)) FILTER (WHERE l_returnflag = 'R') - avg(log2(l_quantity + 1)) FILTER (WHERE l_returnflag = 'A'), 6) AS mean_of_log
FROM lineitem GROUP BY 1""",
)
def log_of_mean_vs_mean_of_log(t: Tables) -> DataFrame:
    rows = t("lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    a = quant.condition_means(rows, ["l_suppkey"], "l_returnflag", "l_quantity", "A", "R", "a", "log_of_mean")
    b = quant.condition_means(rows, ["l_suppkey"], "l_returnflag", "l_quantity", "A", "R", "b", "mean_of_log")
    return a.join(b, "l_suppkey").select(F.col("l_suppkey").alias("entity"), F.round("a_logFC", 6).alias("log_of_mean"), F.round("b_logFC", 6).alias("mean_of_log"))


@query(
    "A6",
    """
WITH m AS (SELECT l_returnflag, median(CASE WHEN l_extendedprice > 0 THEN l_extendedprice END) AS med FROM lineitem GROUP BY 1), o AS (SELECT avg(med) AS mean_med FROM m)
SELECT l_linenumber, l.l_returnflag, count(*) AS n, round(avg(l_extendedprice * mean_med / med), 4) AS mean_scaled FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag, o GROUP BY 1, 2""",
)
def scale_by_group_median(t: Tables) -> DataFrame:
    out = quant.scaled_to_common_median(t("lineitem").select("l_linenumber", "l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")
    return out.groupBy("l_linenumber", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("scaled"), 4).alias("mean_scaled"))


@query(
    "A5 A7 P12",
    """
SELECT user_id, round(avg(value) + 3e-9, 6) AS value, arg_min(event_type, event_id) AS first_type, arg_min(props, event_id) FILTER (WHERE props IS NOT NULL) AS first_props,
       string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS types, count(DISTINCT event_type) AS n_sources
FROM events GROUP BY 1""",
)
def merge_first_nonnull(t: Tables) -> DataFrame:
    e = t("events").select("user_id", "event_id", "value", F.col("event_type").alias("first_type"), F.col("props").alias("first_props"), "event_type")
    out = quant.merged_entities(e, "user_id", "event_id", ["first_type", "first_props"], ["value"], {"types": "event_type"}, "event_type")
    return out.select("user_id", F.round(F.col("value") + 3e-9, 6).alias("value"), "first_type", "first_props", "types", "n_sources")


@query("A17", "SELECT l_suppkey, l_linenumber, count(*) AS n, round(sum(coalesce(CASE WHEN l_quantity > 10 THEN l_quantity END, m)), 4) AS total FROM lineitem JOIN (SELECT l_linenumber AS s, avg(CASE WHEN l_quantity > 10 THEN l_quantity END) AS m FROM lineitem GROUP BY 1) ON s = l_linenumber GROUP BY 1, 2")
def impute_sample_mean(t: Tables) -> DataFrame:
    rows = t("lineitem").select("l_suppkey", "l_linenumber", F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("v"))
    return quant.imputed(rows, "l_linenumber", "v", "w").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("total"))


@query("A3 A8", "SELECT l_partkey, count(*) AS n, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY 1")
def group_means(t: Tables) -> DataFrame:
    rows = t("lineitem").select("l_partkey", "l_quantity", "l_discount")
    n = rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return quant.group_means(rows, ["l_partkey"], ["l_quantity", "l_discount"]).join(n, "l_partkey").select("l_partkey", "n", _r("l_quantity"), _r("l_discount"))


@query("A8 P12", "SELECT count(*) FILTER (WHERE c_acctbal - 4500 > 0.5) AS n_up, count(*) FILTER (WHERE c_acctbal - 4500 < -0.5) AS n_down, count(*) AS n FROM customer")
def up_down_counts(t: Tables) -> DataFrame:
    return quant.up_down_counts(t("customer").select((F.col("c_acctbal") - 4500).alias("change")), "change", 0.5)


@query("S3 A1", "SELECT s_suppkey, sample_id, round(value, 4) AS value FROM (SELECT s_suppkey, 's_acctbal' AS sample_id, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS DOUBLE) FROM supplier)")
def wide_to_long(t: Tables) -> DataFrame:
    s = t("supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey"))
    return quant.to_long(s, ["s_suppkey"], ["s_acctbal", "s_nationkey"]).select("s_suppkey", "sample_id", F.round("value", 4).alias("value"))


@query("J1", "SELECT s_nationkey, arg_max(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1")
def bridge_last_wins(t: Tables) -> DataFrame:
    return align.bridge(t("supplier"), "s_nationkey", "s_name", ["s_suppkey"])


@query(
    "J1 J2 W4",
    """
WITH b AS (SELECT s_nationkey AS nk, arg_max(s_suppkey, s_suppkey) AS suppkey FROM supplier GROUP BY 1), r AS (SELECT o_custkey AS custkey, avg(o_totalprice) AS rna FROM orders GROUP BY 1),
p AS (SELECT c_custkey AS custkey, c_acctbal, suppkey FROM customer JOIN b ON nk = c_nationkey)
SELECT custkey, suppkey, round(c_acctbal, 4) AS protein, round(rna + 3e-7, 4) AS rna FROM p JOIN r USING (custkey)""",
)
def align_inner(t: Tables) -> DataFrame:
    b = align.bridge(t("supplier"), "s_nationkey", "s_suppkey", ["s_suppkey"]).select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("suppkey"))
    p = align.through_bridge(t("customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey", F.col("c_acctbal").alias("protein")), b, "c_nationkey")
    r = t("orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.avg("o_totalprice").alias("rna"))
    return align.aligned(r, p, ["custkey"], ["suppkey"]).select("custkey", "suppkey", F.round("protein", 4).alias("protein"), F.round(F.col("rna") + 3e-7, 4).alias("rna"))


@query(
    "J3",
    """
WITH r AS (SELECT c_mktsegment AS strain, c_custkey AS custkey, avg(o_totalprice) AS rna FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1, 2)
SELECT c_mktsegment AS strain, c_custkey AS custkey, round(c_acctbal, 4) AS protein, round(rna + 3e-7, 4) AS rna FROM customer LEFT JOIN r ON r.custkey = c_custkey AND r.strain = c_mktsegment WHERE rna IS NOT NULL OR c_mktsegment = 'BUILDING'""",
)
def align_left_fallback(t: Tables) -> DataFrame:
    p = t("customer").select(F.col("c_mktsegment").alias("strain"), F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("protein"))
    r = t("orders").join(p.select("strain", "custkey"), F.col("o_custkey") == F.col("custkey")).where("strain <> 'BUILDING'").groupBy("strain", "custkey").agg(F.avg("o_totalprice").alias("rna"))
    return align.aligned(r, p, ["strain", "custkey"], ["protein"], r, "strain").select("strain", "custkey", F.round("protein", 4).alias("protein"), F.round(F.col("rna") + 3e-7, 4).alias("rna"))


@query("J4", "SELECT p_partkey, brand_size, first_type FROM part JOIN (SELECT p_brand AS b, arg_min(p_size, p_partkey) FILTER (WHERE p_size > 10) AS brand_size, arg_min(p_type, p_partkey) AS first_type FROM part GROUP BY 1) ON b = p_brand")
def attach_first_non_null(t: Tables) -> DataFrame:
    genes = t("part").select("p_brand", "p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("brand_size"), F.col("p_type").alias("first_type"))
    return align.attributes(t("part").select("p_partkey", "p_brand"), genes, ["p_brand"], ["brand_size", "first_type"], "p_partkey").select("p_partkey", "brand_size", "first_type")


@query(
    "J5 W4",
    """
WITH pr AS (SELECT l_partkey, avg(l_extendedprice) AS protein FROM lineitem GROUP BY 1), rn AS (SELECT l_suppkey, avg(l_quantity) AS rna FROM lineitem GROUP BY 1), g AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
j AS (SELECT l_suppkey, l_partkey, protein, rna, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS k FROM g JOIN pr USING (l_partkey) JOIN rn USING (l_suppkey))
SELECT l_suppkey, l_partkey, round(protein, 4) AS protein, round(rna + 3e-7, 4) AS rna FROM j WHERE k = 1""",
)
def align_all_loci(t: Tables) -> DataFrame:
    li = t("lineitem")
    g = li.select("l_partkey", "l_suppkey").distinct()
    p, r = li.groupBy("l_partkey").agg(F.avg("l_extendedprice").alias("protein")), li.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("rna"))
    return align.aligned_all_loci(g, p, r, "l_partkey", "l_suppkey", ["l_partkey"]).select("l_suppkey", "l_partkey", F.round("protein", 4).alias("protein"), F.round(F.col("rna") + 3e-7, 4).alias("rna"))


@query(
    "J8 J10 J7",
    """
WITH a AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, min(s_name) AS v FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1), b AS (SELECT CAST(n_nationkey AS VARCHAR) AS k, min(n_name) AS v FROM nation GROUP BY 1)
SELECT c_custkey, coalesce(a.v, b.v, c_name) AS label FROM customer LEFT JOIN a ON a.k = CAST(c_custkey AS VARCHAR) LEFT JOIN b ON b.k = CAST(c_nationkey AS VARCHAR)""",
)
def priority_lookup(t: Tables) -> DataFrame:
    a = t("supplier").where("s_suppkey % 2 = 0").groupBy(F.col("s_suppkey").cast("string").alias("k")).agg(F.min("s_name").alias("v"))
    b = t("nation").groupBy(F.col("n_nationkey").cast("string").alias("k")).agg(F.min("n_name").alias("v"))
    c = t("customer").select("c_custkey", "c_nationkey", "c_name")
    found = align.by_priority(c, "k", [(a, F.col("c_custkey").cast("string")), (b, F.col("c_nationkey").cast("string"))], "v", "label")
    return found.select("c_custkey", F.coalesce("label", "c_name").alias("label"))


@query(
    "J15",
    """
WITH a AS (SELECT l_partkey AS k, max(l_quantity) AS q, CAST(NULL AS DOUBLE) AS d FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT p_partkey, CASE WHEN a.k IS NOT NULL THEN a.q ELSE b.q END AS q, CASE WHEN a.k IS NOT NULL THEN a.d ELSE b.d END AS d FROM part LEFT JOIN a ON a.k = p_partkey LEFT JOIN b ON b.k = p_partkey""",
)
def row_fallback(t: Tables) -> DataFrame:
    li = t("lineitem")
    a = li.where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("q"), F.lit(None).cast("double").alias("d"))
    b = li.where("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    return align.row_or_fallback(t("part").select("p_partkey"), a, b, "p_partkey", ["q", "d"])


@query("J6 W3", "SELECT source, arg_max(doc_id, (quality, n_chars, doc_id)) AS doc_id FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def best_match(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", "source", "n_chars").join(t("labels"), "doc_id")
    return windows.best_match(d, "source", "doc_id", ["quality", "n_chars"])


@query("J9 U4 X6", "SELECT DISTINCT r_name, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def inverted_membership(t: Tables) -> DataFrame:
    ko = t("customer").select("c_nationkey", "c_mktsegment").distinct().join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ko.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "c_mktsegment").distinct()


@query("J11 G14", "SELECT o_custkey, l_suppkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2")
def two_hop_links(t: Tables) -> DataFrame:
    m = t("orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderkey").alias("k"))
    p = t("lineitem").select(F.col("l_orderkey").alias("k"), "l_suppkey")
    return m.join(p, "k").groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J12",
    """
WITH q AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS q FROM part), n AS (SELECT p_partkey, lower(p_name) AS t FROM part),
m AS (SELECT q, p_partkey, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN t = q THEN 0 WHEN starts_with(t, q) THEN 1 ELSE 2 END, p_partkey) AS k FROM q JOIN n ON contains(t, q) WHERE length(q) >= 3)
SELECT q AS query, p_partkey FROM m WHERE k = 1""",
)
def name_match(t: Tables) -> DataFrame:
    asked = t("part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("query")).where("length(query) >= 3")
    return align.name_match(asked, "query", t("part").select("p_partkey", "p_name"), "p_partkey", "p_name", "p_partkey")


@query(
    "J13",
    """
WITH s AS (SELECT o_custkey AS c, min(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), e AS (SELECT DISTINCT o_custkey AS c FROM orders)
SELECT e.c AS custkey, CASE WHEN s.c IS NOT NULL THEN 'pathway' ELSE 'enzyme' END AS via, s.p AS pathway FROM e LEFT JOIN s ON s.c = e.c""",
)
def pathway_before_enzyme(t: Tables) -> DataFrame:
    o = t("orders")
    shared = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey"), F.lit(0).alias("p"), F.lit("pathway").alias("via"), F.col("o_orderpriority").alias("pathway"))
    enzyme = o.select(F.col("o_custkey").alias("custkey"), F.lit(1).alias("p"), F.lit("enzyme").alias("via"), F.lit(None).cast("string").alias("pathway"))
    return windows.keep_first(shared.unionByName(enzyme), ["custkey"], [F.col("p"), F.coalesce("pathway", F.lit("")).alias("o")]).select("custkey", "via", "pathway")


@query("J14 X10 X14", "SELECT coalesce(min(s_name), min(n_name)) AS name, n_nationkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def first_name_of(t: Tables) -> DataFrame:
    s = t("supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("name"), F.lit(0).alias("p"))
    n = t("nation").select("n_nationkey", F.col("n_name").alias("name"), F.lit(1).alias("p"))
    return windows.keep_first(s.unionByName(n), ["n_nationkey"], [F.col("p"), F.col("name")]).select("name", "n_nationkey")


@query("J16", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0) GROUP BY 1, 2")
def both_ends_exist(t: Tables) -> DataFrame:
    e = t("lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"))
    nodes = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("a"))
    others = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("b"))
    kept = e.join(nodes, "a", "left_semi").join(others, "b", "left_semi")
    return kept.groupBy(F.col("a").alias("l_orderkey"), F.col("b").alias("l_suppkey")).agg(F.count(F.lit(1)).alias("n"))


@query("J16", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey < s_suppkey AND c_custkey IN (SELECT o_custkey FROM orders) AND s_suppkey IN (SELECT o_custkey FROM orders)")
def ends_in_one_universe(t: Tables) -> DataFrame:
    e = t("customer").join(t("supplier"), F.col("c_nationkey") == F.col("s_nationkey")).where("c_custkey < s_suppkey").select("c_custkey", "s_suppkey")
    return sets.with_both_ends(e, t("orders").select("o_custkey"), "c_custkey", "s_suppkey", "o_custkey")


@query("J17 U7", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unresolved(t: Tables) -> DataFrame:
    return sets.missing_from(t("customer"), t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("U1 U2 X9", "SELECT DISTINCT id FROM (SELECT CAST(o_custkey AS VARCHAR) AS id FROM orders UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer UNION SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)")
def universe(t: Tables) -> DataFrame:
    return sets.universe([(t("orders"), "o_custkey"), (t("customer"), "c_custkey"), (t("supplier"), "s_suppkey")], "id")


@query("U5 E1", "SELECT DISTINCT o_orderkey, o_custkey FROM orders")
def append_missing(t: Tables) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_custkey")
    base = o.where("o_orderkey % 3 = 0")
    once = sets.append_missing(base, o, ["o_orderkey"])
    return sets.append_missing(once, o, ["o_orderkey"])


@query("U3 W2", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_quantity) AS score FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2")
def pair_dedup_max(t: Tables) -> DataFrame:
    li = t("lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("score"), "l_returnflag")
    both = li.where("l_returnflag = 'A'").unionByName(li.where("l_returnflag = 'R'"))
    return windows.dedup_pairs(both.drop("l_returnflag"), "a", "b", "score", ["score"])


@query("A16", "SELECT p_type, count(DISTINCT s_nationkey) AS n_groups FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING count(DISTINCT s_nationkey) = (SELECT count(DISTINCT s_nationkey) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)")
def relational_division(t: Tables) -> DataFrame:
    d = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("p_type", "s_nationkey").distinct()
    return sets.in_every_group(d, "p_type", "s_nationkey")


@query("A16", "SELECT p_brand, count(DISTINCT p_size) AS n_groups, CASE WHEN count(DISTINCT p_size) >= 2 THEN 'shared' ELSE 'specific' END AS kind FROM part GROUP BY 1")
def shared_and_specific(t: Tables) -> DataFrame:
    return sets.spread_over_groups(t("part"), "p_brand", "p_size")


@query("S8 K1 U3", "SELECT 'customer' AS instrument, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def instrument_union(t: Tables) -> DataFrame:
    c = t("customer").select(F.lit("customer").alias("instrument"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t("supplier").select(F.lit("supplier").alias("instrument"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query(
    "P1 P2 P17 P18",
    """
WITH v AS (SELECT c_custkey, TRY_CAST(CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR) END AS DOUBLE) AS a, CAST(c_custkey % 5 AS DOUBLE) AS b FROM customer)
SELECT c_custkey, coalesce(a, 0) AS zero_filled, a AS kept, round(CASE WHEN a > 0 AND b > 0 THEN log2(a / b) END, 6) AS ratio,
       CASE WHEN a IS NULL THEN 'unavailable' WHEN a - 500 = 0 OR b - 2 = 0 THEN 'neutral' WHEN (a - 500 > 0) = (b - 2 > 0) THEN 'concordant' ELSE 'discordant' END AS agreement,
       CASE WHEN a > 700 THEN 'Up' WHEN a < -700 THEN 'Down' ELSE 'Stable' END AS regulation
FROM v""",
)
def numbers_from_text(t: Tables) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_custkey").cast("string"))
    v = t("customer").select("c_custkey", raw.alias("raw"), (F.col("c_custkey") % 5).cast("double").alias("b")).withColumn("a", lenient(F.col("raw")))
    ratio = F.round(log2_ratio(F.col("a"), F.col("b")), 6)
    return v.select("c_custkey", lenient_zero(F.col("raw")).alias("zero_filled"), F.col("a").alias("kept"), ratio.alias("ratio"), agreement(F.col("a") - 500, F.col("b") - 2).alias("agreement"), regulation(F.col("a"), 700).alias("regulation"))


@query(
    "P5 P6 P7 P8 P20 X5",
    """
SELECT s_suppkey, regexp_replace('WP_00' || s_suppkey || '.1', '^(WP_\\d+)\\.\\d+$', '\\1') AS canonical, trim(split_part(s_name || ' ; other', ';', 1)) AS first_one,
       CASE WHEN s_suppkey % 3 = 0 THEN 'CHEBI:' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'M-' || s_name END AS metabolite,
       CASE WHEN s_suppkey % 4 = 0 THEN 'transcriptome' WHEN s_suppkey % 4 = 1 THEN 'amr' WHEN s_suppkey % 4 = 2 THEN 'protein' ELSE 'genome' END AS node_type, s_name AS stripped
FROM supplier""".replace("\\\\", "\\"),
)
def identifiers(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    chebi = F.when(k % 3 == 0, F.concat(F.lit("CHEBI:"), k)).otherwise("x")
    name = F.when(k % 3 == 1, F.col("s_name")).otherwise("")
    node = F.when(k % 4 == 0, F.concat(F.lit("g"), k, F.lit("_RNA"))).when(k % 4 == 1, "AMR:x").when(k % 4 == 2, F.concat(F.lit("WP_"), k)).otherwise("g1")
    return t("supplier").select(
        "s_suppkey", ids.canonical_accession(F.concat(F.lit("WP_00"), k, F.lit(".1"))).alias("canonical"), ids.first_accession(F.concat("s_name", F.lit(" ; other"))).alias("first_one"),
        ids.metabolite_id(chebi, name).alias("metabolite"), ids.node_type(node).alias("node_type"), ids.without_prefix(F.concat(F.lit("ref|"), F.col("s_name")), "ref|").alias("stripped"),
    )


@query("P9", "SELECT p_partkey, p_partkey % 4 = 2 AS bacterial FROM part")
def first_verdict(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "REV__x;WP_1").when(k == 1, "sp|x;CON__y;WP_1").when(k == 2, "sp|x; WP_1;REV__z").otherwise("none;here")
    return t("part").select("p_partkey", ids.is_bacterial(text).alias("bacterial"))


@query("P10", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '(?i)promo|econ') OR NOT EXISTS (SELECT 1 FROM part WHERE regexp_matches(p_type, '(?i)promo|econ'))")
def matching_or_all(t: Tables) -> DataFrame:
    return ids.matching_or_all(t("part").select("p_partkey", "p_type"), "p_type", "promo|econ").select("p_partkey")


@query("P13 X3 A11", "SELECT letter, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_type, '')) AS letter FROM part) WHERE regexp_matches(letter, '^[A-Z]$') GROUP BY 1")
def cog_letters(t: Tables) -> DataFrame:
    return t("part").select(F.explode(ids.category_letters(F.col("p_type"))).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))


@query("P14 P22 G7 G15", "SELECT DISTINCT p_partkey, trim(x) AS annotation FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x FROM part) WHERE trim(x) NOT IN ('', '-', 'nan')")
def functional_edges(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.explode(ids.listed(F.col("p_name"), " ")).alias("annotation")).distinct()


@query("X4 X7", "SELECT c_custkey, coalesce(c, 'S') AS category FROM customer LEFT JOIN (SELECT o_custkey AS k, min(o_orderpriority) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON k = c_custkey")
def placeholder_category(t: Tables) -> DataFrame:
    known = t("orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("c"))
    return t("customer").select("c_custkey").join(known, "c_custkey", "left").select("c_custkey", F.coalesce("c", F.lit(ids.UNKNOWN_CATEGORY)).alias("category"))


@query("P15 S7", "SELECT c_custkey, CASE WHEN lower(c_mktsegment) LIKE '%build%' THEN 'Sera' WHEN lower(c_mktsegment) LIKE '%auto%' THEN 'RPMI' END AS condition FROM customer")
def condition_labels(t: Tables) -> DataFrame:
    return t("customer").select("c_custkey", quant.inferred_condition(F.col("c_mktsegment"), {"RPMI": "auto", "Sera": "Build"}).alias("condition"))


@query("X1 X2 X13", "SELECT l_partkey, min(l_suppkey) AS first_supplier FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def first_by_direction(t: Tables) -> DataFrame:
    return windows.keep_first(t("lineitem").where("l_returnflag = 'R'").select("l_partkey", F.col("l_suppkey").alias("first_supplier")), ["l_partkey"], [F.col("first_supplier")])
