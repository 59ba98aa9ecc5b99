import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.operators import align, candidates, community, correlation, evidence, graph, hyper, ordering, paths, quant, stats, windows


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_accession_at_two_loci(spark):
    genes = spark.createDataFrame([("g1", "p", 1), ("g2", "p", 2), ("g3", "q", 3)], "gene_id string, protein_id string, n int")
    assert got(align.bridge(genes, "protein_id", "gene_id", ["n"]), "protein_id", "gene_id") == [("p", "g2"), ("q", "g3")]
    protein = spark.createDataFrame([("p", 1.0)], "protein_id string, v double")
    rna = spark.createDataFrame([("g1", 1.0), ("g2", 2.0)], "gene_id string, r double")
    assert got(align.aligned_all_loci(genes, protein, rna, "protein_id", "gene_id", ["n"]), "gene_id") == [("g1",), ("g2",)]


def test_strain_without_expression_keeps_its_proteins(spark):
    p = spark.createDataFrame([("a", "g1", "p1"), ("a", "g2", "p2"), ("b", "g1", "p1")], "strain string, gene_id string, protein_id string")
    r = spark.createDataFrame([("a", "g1", 1.0)], "strain string, gene_id string, rna double")
    assert got(align.aligned(r, p, ["strain", "gene_id"], ["protein_id"], r, "strain"), "strain", "gene_id", "rna") == [("a", "g1", 1.0), ("b", "g1", None)]


def test_priority_cascade(spark):
    ids = spark.createDataFrame([("x",), ("y_2",), ("z_K3",), ("w",)], "id string")
    a = spark.createDataFrame([("x", "K1")], "k string, ko string")
    b = spark.createDataFrame([("y_2", "K2"), ("x", "no")], "k string, ko string")
    c = spark.createDataFrame([("K3", "K3")], "k string, ko string")
    out = align.by_priority(ids, "k", [(a, F.col("id")), (b, F.col("id")), (c, F.element_at(F.split("id", "_"), -1))], "ko", "found")
    assert got(out, "id", "found") == [("w", None), ("x", "K1"), ("y_2", "K2"), ("z_K3", "K3")]


def test_names(spark):
    names = spark.createDataFrame([("C00036", 0, "Oxaloacetic acid"), ("C00042", 1, "Succinic acid"), ("C00043", 2, "Succinic acid semialdehyde")], "c string, n int, t string")
    asked = spark.createDataFrame([("succinic ACID",), ("Succinic acid s",), ("acid",), ("nothing",), (None,), (" ",)], "q string")
    assert got(align.name_match(asked, "q", names, "c", "t", "n"), "q", "c") == [("Succinic acid s", "C00043"), ("acid", "C00036"), ("succinic ACID", "C00042")]


def test_means_of_logs_and_logs_of_means(spark):
    df = spark.createDataFrame([("p", "a", 1.0), ("p", "a", 7.0), ("p", "b", 3.0)], "e string, c string, v double")
    x = quant.condition_means(df, ["e"], "c", "v", "a", "b", "x", "log_of_mean").first()
    y = quant.condition_means(df, ["e"], "c", "v", "a", "b", "y", "mean_of_log").first()
    assert x.x_a == pytest.approx(math.log2(5)) and y.y_a == pytest.approx(2.0)


def test_sample_of_zeros(spark):
    df = spark.createDataFrame([("g", "s", 0.0), ("h", "s", 0.0), ("g", "t", 1.0), ("h", "t", 3.0)], "g string, s string, v double")
    assert got(quant.counts_per_million(df, "s", "v"), "s", "g", "cpm") == [("s", "g", 0.0), ("s", "h", 0.0), ("t", "g", 250000.0), ("t", "h", 750000.0)]


def test_instruments(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("c", 0.0)], "i string, v double")
    assert got(quant.scaled_to_common_median(df, "i", "v"), "i", "scaled") == [("a", 3.0), ("a", 9.0), ("b", 6.0), ("c", None)]
    assert got(quant.scaled_to_common_median(df.where("i = 'a'"), "i", "v"), "scaled") == [(1.0,), (3.0,)]


@pytest.mark.parametrize("groups", [100_000, 1])
def test_rows_of_an_instrument_are_not_gathered(spark, monkeypatch, groups):
    """Figures of groups go to the rows, or to keys that a group's rows are dealt to; medians are joined by rank."""
    monkeypatch.setattr(quant, "GROUPS", groups, raising=False)
    monkeypatch.setattr(ordering, "HELD", 2)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 10.0), ("b", 10.0), ("b", -1.0), ("c", 0.0), (None, 8.0)], "i string, v double")
        out = quant.scaled_to_common_median(df, "i", "v")
        assert got(out, "i", "scaled") == [("a", 3.0), ("a", 6.0), ("a", 9.0), ("b", -0.6), ("b", 6.0), ("b", 6.0), ("c", None)]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(i#\d+, \d", plan) and ("__salt" in plan) == (groups == 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_mirrored_pairs(spark):
    df = spark.createDataFrame([("A", "B", 0.4, 1), ("B", "A", 0.9, 2), ("A", "B", 0.9, 3)], "a string, b string, s double, n int")
    assert got(windows.dedup_pairs(df, "a", "b", "s", ["n"]), "a", "b", "s", "n") == [("A", "B", 0.9, 2)]


def test_bh(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.02), (4, 0.5), (5, None)], "k int, p double")
    q = {r.k: r.q_value for r in windows.bh_adjust(df, "p", ["k"]).collect()}
    assert q[5] is None and q[4] == 0.5 and all(q[k] == pytest.approx(0.08 / 3) for k in (1, 2, 3))


def test_numbers_rows(spark):
    out = ordering.numbered(spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1000), [F.col("x")])
    assert got(out.where("rank <> x + 1"), "id") == []


def test_binomial(spark):
    df = spark.createDataFrame([(k, 4, 2) for k in range(6)] + [(1, 4, 1), (1, 0, 3)], "k int, s int, n int")
    p = {(r.k, r.s, r.n): r.p_value for r in candidates.binomial_tails(df, "k", "s", "n").collect()}
    assert [p[k, 4, 2] for k in range(6)] == pytest.approx([1, 15 / 16, 11 / 16, 5 / 16, 1 / 16, 0])
    assert p[1, 4, 1] is None and p[1, 0, 3] is None


@pytest.mark.parametrize("block", [2000, 20, 7])
def test_correlation(spark, monkeypatch, block):
    monkeypatch.setattr(correlation, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[0] = 5  # doesn't vary
    df = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(8)], "e int, s int, v double")
    r = np.corrcoef(x[1:])
    for k, mode in ((0, "either"), (4, "either"), (4, "mutual")):
        a = np.abs(r) - 2 * np.eye(59)
        top = np.zeros_like(a, bool)
        for i in range(59):
            top[i, np.argsort(-a[i], kind="stable")[: (k - 1 if k else 59)]] = True
        top &= a >= 0.5
        both = top & top.T if mode == "mutual" else top | top.T
        want = {(i + 1, j + 1) for i, j in zip(*np.nonzero(np.triu(both)), strict=True)}
        assert {(e.a, e.b) for e in correlation.correlation_edges(df, "e", "s", "v", 0.5, k, mode).collect()} == want
    assert correlation.correlation_edges(df.where("s < 2"), "e", "s", "v", 0.5).count() == 0


def test_hypergraph(spark):
    m = spark.createDataFrame([("s", "t", "e1", n) for n in "abc"] + [("s", "t", "e2", n) for n in "cd"] + [("s", "t", "e3", "e")], "strain string, type string, name string, node string")
    inc = hyper.incidence(m, ["name"], "node")
    assert got(inc, "name", "node") == [("e1", "a"), ("e1", "b"), ("e1", "c"), ("e2", "c"), ("e2", "d")]
    lap = {(r.i, r.j): r.value for r in hyper.laplacian(inc, ["name"], "node").collect()}
    assert lap["a", "b"] == pytest.approx(1 / 3) and lap["c", "c"] == pytest.approx((1 / 3 + 1 / 2) / 2) and lap["c", "d"] == lap["d", "c"] == pytest.approx(0.5 / math.sqrt(2)) and ("a", "d") not in lap
    assert got(hyper.with_ids(hyper.hyperedges(m), ["t"]), "hyperedge_id", "nodes") == [(0, "a;b;c"), (1, "c;d")]


def test_paths(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g")] + [("a", f"h{i}") for i in range(10)]
    df = spark.createDataFrame([("s", x, y, "r") for x, y in edges], "strain string, src string, dst string, relation string")
    seeds = spark.createDataFrame([("s", "m", "a")], "strain string, seed string, node string")
    found = {r.node: r for r in paths.bounded_paths(paths.entity_graph(df), seeds, 4).collect()}
    assert found["d"].node_sequence == ["a", "b", "d"] and found["f"].path_length == 4 and "g" not in found and found["a"].path_length == 0


def test_features_of_unmeasured_genes(spark):
    g = spark.createDataFrame([("s", "g1", 2_000_000, 900, "+"), ("s", "g2", 0, 100, "-")], "strain string, gene_id string, start int, cds_length int, strand string")
    r = spark.createDataFrame([("s", "g1", 1.0, 2.0, 1.0)], "strain string, gene_id string, RNA_RPMI double, RNA_Sera double, RNA_logFC double")
    rows = {x.node_id: x for x in graph.gene_features(g, r).collect()}
    assert rows["g1"].features == [1.0, 2.0, 1.0, 2.0, 0.9, 1.0, 0.0] and rows["g1"].mask == [False] * 7
    assert rows["g2"].features == [0.0, 0.0, 0.0, 0.0, 0.1, 0.0, 1.0] and rows["g2"].mask == [True] * 3 + [False] * 4


def test_components_and_communities(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    c = {r.node: r.component for r in community.components(df, "a", "b").collect()}
    assert c[40] == 0 and c[101] == 100
    two = [("x", f"{p}{i}", f"{p}{j}", 1.0) for p in "ab" for i in range(4) for j in range(i)] + [("x", "a0", "b0", 0.1), ("x", "z1", "z2", 1.0)]
    e = spark.createDataFrame(two, "g string, a string, b string, w double")
    found = {r.node: r.community for r in community.communities(e, "g", "a", "b", "w").collect()}
    assert len({found[f"a{i}"] for i in range(4)}) == 1 and found["a0"] != found["b0"] and "z1" not in found
    lp = {r.node: r.community for r in community.label_propagation(e, "a", "b", "w").collect()}
    assert len({lp[f"a{i}"] for i in range(4)}) == 1


def test_permutation_and_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [(s, float(np.round(rng.normal(3 if f else 0), 2)), f) for s in ("a", "b") for f in [True] * 10 + [False] * 90]
    df = spark.createDataFrame(rows, "s string, v double, f boolean")
    p = stats.permutation_test(df, "s", "v", "f", 2000).first()
    b = stats.bootstrap_interval(df, "s", "v", "f", 1000).first()
    assert p.p_value < 0.01 and p.draws == 2000 and b.low > 1 and b.high < 5
    null = spark.createDataFrame([(s, float(i % 10), i % 7 == 0) for s in ("a", "b") for i in range(200)], "s string, v double, f boolean")
    assert stats.permutation_test(null, "s", "v", "f", 1000).first().p_value > 0.05
    assert stats.permutation_test(df.where("f"), "s", "v", "f", 10).first().p_value is None
    d = stats.group_differences(df, "v", "f").first()
    a, o = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    pooled = math.sqrt((19 * np.var(a, ddof=1) + 179 * np.var(o, ddof=1)) / 198)
    assert d.cohens_d == pytest.approx((np.mean(a) - np.mean(o)) / pooled)


def test_draws_in_blocks(spark, monkeypatch):
    """More distinct values than go to a task: the same distribution by blocks, the same rows of each draw, the same result again."""
    rng = np.random.default_rng(2)
    data = [(s, float(np.round(rng.normal(0.4 if f else 0), 1)), f) for s in ("a", "b", None) for f in [True] * 15 + [False] * 60]
    df = spark.createDataFrame(data, "s string, v double, f boolean")
    whole = stats.permutation_test(df, "s", "v", "f", 3000).first(), stats.bootstrap_interval(df, "s", "v", "f", 1000).first()
    monkeypatch.setattr(stats, "DISTINCT", 5)
    monkeypatch.setattr(stats, "BLOCK", 8)
    p, again = (stats.permutation_test(df, "s", "v", "f", 3000).first() for _ in range(2))
    assert p == again and p.observed == pytest.approx(whole[0].observed) and p.draws == 3000 and abs(p.p_value - whole[0].p_value) < 0.04
    b = stats.bootstrap_interval(df, "s", "v", "f", 1000).first()
    assert b.draws == 1000 and abs(b.low - whole[1].low) < 0.1 and abs(b.high - whole[1].high) < 0.1
    counts = stats._counts(df, "s", "v", "f")
    s = np.array([r.s for r in stats._drawn(counts, counts.count(), 4000, 7, 500, [("n", "n_flagged")], False).collect()])
    by = {g: np.array([v for x, v, _ in data if x == g]) for g in ("a", "b", None)}
    mean, var = sum(15 * x.mean() for x in by.values()), sum(15 * 60 / 75 * x.var(ddof=1) for x in by.values())
    assert len(s) == 4000 and abs(s.mean() - mean) < 5 * (var / 4000) ** 0.5 and s.var() == pytest.approx(var, rel=0.12)


def test_candidates(spark):
    cols = "strain string, amr_determinant string, source_entity string, target_layer string, target_entity string, path_length int, evidence_type string"
    ev = spark.createDataFrame([("S1", "bla1", "X_1", "genome", "X_2", 2, evidence.GRAPH), ("S1", "bla1", "X_1", "genome", "X_4", 2, evidence.GRAPH), ("S2", "bla2", "X_9", "genome", "X_2", 3, evidence.DIRECT), ("S1", "bla1", "X_1", "kegg", "k", 1, evidence.GRAPH)], cols)
    known = spark.createDataFrame([("S1", "genome", "X_4")], "strain string, target_layer string, entity string")
    r = candidates.candidates(ev, known).collect()
    assert len(r) == 1 and (r[0].candidate, r[0].n_determinants, r[0].n_strains, r[0].min_path, r[0].n_direct) == ("X_2", 2, 2, 2, 1)
    hub = spark.createDataFrame([("CHEBI:HUB", "metabolite", 4, 1, 1, 0), ("X_2", "gene", 1, 1, 2, 0)], "candidate string, entity_type string, n_determinants long, n_strains long, min_path int, n_direct long")
    assert [(x.candidate, x.hub_candidate) for x in candidates.ranked(candidates.with_hubs(hub)).orderBy("rank").collect()] == [("X_2", False), ("CHEBI:HUB", True)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "strain string, src string, dst string, relation string, weight double")
    assert paths.entity_graph(e).count() == 0
    assert windows.bh_adjust(spark.createDataFrame([], "k int, p double"), "p", ["k"]).count() == 0
    assert correlation.correlation_edges(spark.createDataFrame([], "e int, s int, v double"), "e", "s", "v").count() == 0
    assert community.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
