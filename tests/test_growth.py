"""Queries whose cost grew faster than their tables, against plain loops and SQL, and what their plans hold."""

import os
import random
import re
import time
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from stratagraph.operators import align, community, correlation, paths
from stratagraph.plans import QUERIES


def under(df, node, inner):
    """Lines of the plan that have inner and are below a node of that name."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+\-]*", x).group()) for x in lines]
    found = []
    for i, x in enumerate(lines):
        if node in x:
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                found += [lines[j]] if inner in lines[j] else []
    return found


def test_trigrams_of_names_are_not_broadcast(spark, monkeypatch):
    names = spark.createDataFrame([(i, f"Word{i % 50} inner{i % 7}") for i in range(500)], "k int, t string")
    asked = spark.createDataFrame([("word3",), ("INNER4",), ("ner6",), ("word49 inner0",), ("zzz",), (None,)], "q string")
    want = {("word3", 3), ("INNER4", 4), ("ner6", 6), ("word49 inner0", 49)}
    for few in (align.FEW, 2):
        monkeypatch.setattr(align, "FEW", few)
        out = align.name_match(asked, "q", names, "k", "t", "k")
        assert {(r.q, r.k) for r in out.collect()} == want and not under(out, "BroadcastExchange", "Generate")


def reached(edges):
    root = {n: n for e in edges for n in e if n is not None}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and b is not None and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


@pytest.mark.parametrize("text", [False, True])
def test_components_shrink(spark, monkeypatch, text):
    """Chains, stars, cycles, loops and missing ends, in rounds and at once; the graph of a round is never larger than the one before."""
    monkeypatch.setattr(community, "FINISHED", 4)
    sizes = []
    count = community.settle

    def settled(df, name="x"):
        out = count(df, name)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(community, "settle", settled)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(120)] + [(500, 501 + i) for i in range(60)] + [(700 + i, 700 + (i + 1) % 9) for i in range(9)] + [(900, 900), (901, None)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    name = (lambda n: None if n is None else f"n{n:05d}") if text else (lambda n: n)
    edges = [(name(a), name(b)) for a, b in edges]
    rng.shuffle(edges)
    got = {r.node: r.component for r in community.components(spark.createDataFrame(edges, "x string, y string" if text else "x long, y long"), "x", "y").collect()}
    assert got.pop(None, None) is None and got == reached(edges)
    assert len(sizes) < 20 and all(b <= 0.9 * a for a, b in zip(sizes, sizes[2:], strict=False)) and sizes[-1] <= 4


def test_communities_of_many_components(spark, monkeypatch):
    """No task has a whole group of components, and numbers are those of the group clustered at once."""
    monkeypatch.setattr(community, "BIN", 30)
    rng = random.Random(7)
    edges = sorted({(g, *sorted(rng.sample(range(c * 10, c * 10 + 10), 2))) for g in "xy" for c in range(12) for _ in range(20)})
    rows = [(g, f"n{a:03d}", f"n{b:03d}", float(rng.randrange(1, 9))) for g, a, b in edges]
    want = set()
    for g in "xy":
        some = [r for r in rows if r[0] == g]
        names = sorted({n for r in some for n in r[1:3]})
        node, found = community.modularity_communities(*(np.array([names.index(r[i]) for r in some]) for i in (1, 2)), np.array([r[3] for r in some]))
        size = Counter(found.tolist())
        want |= {(g, names[n], c) for n, c in zip(node.tolist(), found.tolist(), strict=True) if size[c] >= 3}
    out = community.communities(spark.createDataFrame(rows + [("x", "n000", None, 1.0)], "g string, a string, b string, w double"), "g", "a", "b", "w")
    assert {tuple(r) for r in out.collect()} == want and len({c for _, _, c in want}) >= 12
    df = spark.createDataFrame(rows, "g string, a string, b string, w double")
    monkeypatch.setattr(community, "BIN", 10**9)
    assert {tuple(r) for r in community.communities(df, "g", "a", "b", "w").collect()} == want


def test_communities_of_one_large_component(spark, monkeypatch):
    """A task gets batches and holds nodes and a chunk of edges, not its component."""
    monkeypatch.setattr(community, "CHUNK", 5000)
    a, b = np.triu_indices(900, 1)
    w = np.where(a // 300 == b // 300, 5.0, 1.0)
    rows = [pa.RecordBatch.from_pydict({"bin": np.zeros(len(x), int), "of": np.zeros(len(x), int), "a": a[x], "b": b[x], "w": w[x], "two_m": np.full(len(x), 2 * w.sum())}) for x in np.array_split(np.arange(len(a)), 80)]
    tracemalloc.start()
    found = [tuple(r.values()) for x in community._clustered(3)(iter(rows)) for r in x.to_pylist()]
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found == [(n, n // 300 * 300, 300) for n in range(900)] and most < 8 * len(a)
    node, label = community.modularity_communities(a, b, w)
    assert node.tolist() == list(range(900)) and label.tolist() == [n // 300 for n in range(900)]
    df = spark.createDataFrame([("x", i, j, 1.0) for j in range(5) for i in range(j)], "g string, a int, b int, w double")
    settle, plans = community.settle, []
    monkeypatch.setattr(community, "settle", lambda df, *name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settle(df, *name))[1])
    assert community.communities(df, "g", "a", "b", "w").count() == 5
    assert any("MapInArrow" in p for p in plans) and not any("FlatMapGroups" in p for p in plans)


def test_votes_are_by_node(spark, monkeypatch):
    """The edges that each round reads are written by node."""
    plans, settle = [], community.settle
    monkeypatch.setattr(community, "settle", lambda df, *name: (plans.append(df), settle(df, *name))[1])
    e = spark.createDataFrame([(i, j, 1.0) for i in range(9) for j in range(i) if i // 3 == j // 3] + [(2, 3, 0.5), (5, 6, 0.5)], "a int, b int, w double")
    got = {r.node: r.community for r in community.label_propagation(e, "a", "b", "w", 6).collect()}
    assert got == {n: n // 3 * 3 for n in range(9)}
    assert "hashpartitioning(a" in plans[0]._jdf.queryExecution().executedPlan().toString() and "Union" not in plans[0]._jdf.queryExecution().executedPlan().toString()


def test_a_list_of_classes_is_made_once(spark):
    """No row for each pair of a gene and a class of its key."""
    customers = spark.createDataFrame([(20 * i + 3, 1) for i in range(200)] + [(4, 1), (3, 2)], "c_custkey long, c_nationkey int")
    suppliers = spark.createDataFrame([(20 * i + 3, 1, f"S{i:03d}") for i in range(150)] + [(4, 2, "x")], "s_suppkey long, s_nationkey int, s_name string")
    out = QUERIES["marked_genes"].build({"customer": customers, "supplier": suppliers}.__getitem__)
    marked = ";".join(f"S{i:03d}" for i in range(150))
    assert {(r.gene_id, r.strain, r.is_amr_gene, r.amr_class) for r in out.collect()} == {(str(20 * i + 3), "n1", True, marked) for i in range(200)} | {("4", "n1", False, ""), ("3", "n2", False, "")}
    assert out._jdf.queryExecution().executedPlan().toString().count("Join") in (1, 2) and not under(out, "HashAggregate", "Join")


def test_features_of_repeated_customers(spark):
    """As in SQL, a customer's rows are one, and each of them counts its orders."""
    customers = spark.createDataFrame([(1, 1000.0), (1, 1000.0), (1, 2000.0), (2, -500.0)], "c_custkey long, c_acctbal double")
    orders = spark.createDataFrame([(7, 1, "P", 3000.0), (8, 1, "P", 5000.0), (9, 1, "F", 1.0)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    out = QUERIES["node_features_masked"].build({"customer": customers, "orders": orders}.__getitem__)
    assert sorted((r.c_custkey, *r.features, *r.mask) for r in out.collect()) == [(1, 4.0, 2.0, 2.0, False, False, False), (1, 4.0, 4.0, 1.0, False, False, False), (2, 0.0, 0.0, -0.5, True, False, False)]


def test_features_of_balances_near_zero(spark):
    """As in SQL, a balance of some cents below zero is -0.0 and a missing one null."""
    cents = (-0.06, -0.05, -0.04, -0.01, 0.0, 0.04, 0.05, -999.99, None)
    customers = spark.createDataFrame(list(enumerate(cents)), "c_custkey long, c_acctbal double")
    orders = spark.createDataFrame([(7, 1, "P", 3000.0)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    out = QUERIES["node_features_masked"].build({"customer": customers, "orders": orders}.__getitem__).collect()
    with duckdb.connect() as c:
        c.register("customer", customers.toPandas())
        c.register("orders", orders.toPandas())
        c.execute("CREATE TABLE kept AS SELECT c_custkey, nullif(c_acctbal, 'nan'::DOUBLE) AS c_acctbal FROM customer")
        want = c.execute(QUERIES["node_features_masked"].sql.replace("FROM customer", "FROM kept")).fetchall()
    assert sorted(map(repr, ((r.c_custkey, r.features, r.mask) for r in out))) == sorted(map(repr, want)) and "-0.0" in repr(want)


def test_seeds_with_enough_paths_stop(spark, monkeypatch):
    """Of 420 suppliers with a common order each has 400 rows after two steps; none goes on to the orders of a third."""
    sizes, settle = [], paths.settle

    def settled(df, *name):
        out = settle(df, *name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(paths, "settle", settled)
    lines = [(0, s) for s in range(420)] + [(1 + s, s) for s in range(420)] + [(900, 500), (900, 501), (901, 501), (901, 502)]
    tables = {"lineitem": spark.createDataFrame(lines, "l_orderkey long, l_suppkey long"), "supplier": spark.createDataFrame([(s,) for s in [*range(420), 500, 501, 502]], "s_suppkey long")}
    got = Counter()
    for r in QUERIES["path_context"].build(tables.__getitem__).collect():
        got[r.seed] += 1
        assert r.node_sequence == f"{r.seed};O0;{r.node}" or r.seed in ("S500", "S501", "S502")
    assert {got[f"S{s}"] for s in range(420)} == {400} and (got["S500"], got["S501"], got["S502"]) == (2, 2, 2)
    assert max(sizes) < 420 * 420 + 10


@pytest.mark.parametrize("search", ["bounded_paths", "bounded_distances"])
def test_shuffles_of_levels_go(spark, monkeypatch, search):
    """After each level that is written out, what it has shuffled is let go; then it isn't on disk any more."""
    calls, forget, settle = [], paths.forget_shuffles, paths.settle
    monkeypatch.setattr(paths, "settle", lambda df, *name: (calls.append("settle"), settle(df, *name))[1])
    monkeypatch.setattr(paths, "forget_shuffles", lambda s: (calls.append("forget"), forget(s))[1])
    edges = spark.createDataFrame([("s", str(i), str(i + k), "r") for i in range(60) for k in (1, 2)], "strain string, src string, dst string, relation string")
    seeds = spark.createDataFrame([("s", str(i), str(i)) for i in range(0, 60, 3)], "strain string, seed string, node string")
    getattr(paths, search)(paths.entity_graph(edges), seeds, 4)
    assert calls.count("forget") == 5 and calls[-8:] == ["settle", "forget"] * 4
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    for _ in range(40):
        left = {f.split("_")[1] for d in folders for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_") and f.endswith(".data")}
        if len(left) <= 3:
            break
        time.sleep(0.25)
    assert len(left) <= 3


def test_relations_are_not_carried_unasked(spark):
    """The same nodes as with relations, one row for nodes that several relations join."""
    edges = spark.createDataFrame([("s", "a", "b", "r"), ("s", "a", "b", "q"), ("s", "a", "c", "r"), ("s", "b", "d", "r"), ("s", "c", "d", "q"), ("s", "d", "e", "r")], "strain string, src string, dst string, relation string")
    seeds = spark.createDataFrame([("s", "a", "a"), ("s", "m", "e"), ("s", "m", "b")], "strain string, seed string, node string")
    with_, without = (paths.bounded_paths(paths.entity_graph(edges), seeds, 3, relations=r) for r in (True, False))
    assert without.columns == [c for c in with_.columns if c != "edge_sequence"]
    assert sorted(without.collect()) == sorted(with_.drop("edge_sequence").collect()) and {tuple(r.node_sequence) for r in without.collect()} >= {("a", "b", "d", "e"), ("b", "a", "c")}


def test_blocks_of_many_tiles(spark, monkeypatch):
    """60 tiles are 8 blocks, and give the rows of one tile."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, j, float(v)) for i in range(300) for j, v in enumerate(np.round(rng.normal(size=4), 1))], "e int, s int, v double")
    rows = {}
    for block in (2000, 5):
        monkeypatch.setattr(correlation, "BLOCK", block)
        monkeypatch.setattr(correlation, "TILES", 8)
        rows[block] = [sorted(tuple(r) for r in correlation.correlation_edges(df, "e", "s", "v", 0.5, k, mode).collect()) for k, mode in ((0, "either"), (4, "either"), (4, "mutual"))]
    assert rows[5] == rows[2000] and all(rows[5])


@pytest.mark.parametrize("same", [True, False])
def test_tiles_are_cut_by_what_is_known(monkeypatch, same):
    """Only tiles of places of which fewer than k partners are known are partitioned; with ties, the pairs are those of ranking all."""
    monkeypatch.setattr(correlation, "BLOCK", 40)
    sizes, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **k: (sizes.append(x.size), partition(x, *a, **k))[1])
    z = np.round(np.random.default_rng(6).normal(size=(800, 5)))
    z -= z.mean(1, keepdims=True)
    z = z[(z != 0).any(1)]
    z /= np.sqrt((z * z).sum(1, keepdims=True))
    a, b = (z, z) if same else (z[:390], z[390:])
    order = np.random.default_rng(8).permutation(len(z))
    pa_, pb = (np.arange(len(z)),) * 2 if same else (np.sort(order[:390]), np.sort(order[390:]))
    r = np.round(a @ b.T, correlation.DIGITS)
    x, y = np.nonzero(np.triu(np.ones(r.shape, bool), 1) if same else np.ones(r.shape, bool))
    keep = np.abs(r[x, y]) >= 0.6
    x, y = x[keep], y[keep]
    sides = np.concatenate([pa_[x], pb[y]]), np.concatenate([pb[y], pa_[x]]), np.tile(r[x, y], 2)
    want = correlation._kept(*sides, 5)
    got = correlation._pairs(a, b, same, pa_, pb, 0.6, 5)
    rows = [sorted(zip(*(c.tolist() for c in v), strict=True)) for v in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) > 3000
    assert sum(sizes) < 0.8 * r.size
