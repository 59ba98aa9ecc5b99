"""Queries over whole tables and whole texts, against brute force on fixtures."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.operators import community, paths
from stratagraph.plans import QUERIES
from stratagraph.session import settle


def run(name, **tables):
    return [tuple(r) for r in QUERIES[name].build(tables.__getitem__).collect()]


def test_lines_of_long_texts(spark):
    texts = {1: "a b\n\nc\na", 2: "\n".join(f"w{i % 7} x" for i in range(2000)), 3: "", 4: None, 5: "y" * 5000}
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts.items()], "doc_id long, text string, n_chars int")
    want = Counter((i, line.split(" ")[0]) for i, t in texts.items() for line in (t or "").split("\n") if line)
    assert sorted(run("block_parse", documents=docs)) == sorted((i, w, n) for (i, w), n in want.items())


@pytest.fixture(scope="module")
def lines():
    """(order, supplier, quantity): groups of suppliers, a chain of orders between them, repeated lines and small quantities."""
    rng = random.Random(5)
    out = [(o, rng.randint(1 + 10 * (o % 3), 10 + 10 * (o % 3)), rng.randint(1, 50)) for o in range(60) for _ in range(rng.randint(1, 4))]
    out += [(100 + i, i + k, 1) for i in range(1, 30, 10) for k in (0, 9, 10)] + [(100 + i, i, 50) for i in (40, 41, 42)] + [(140, 40, 1), (140, 41, 1), (150, 41, 1), (150, 42, 1)]
    return out + [(200, s, 2) for s in range(1, 65)]


@pytest.fixture(scope="module")
def tables(spark, lines):
    return {"lineitem": spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity int"), "supplier": spark.createDataFrame([(s,) for s in range(1, 70)], "s_suppkey long")}


def shortest(lines, depth):
    """(seed, node) -> the least of the shortest sequences, by going through all of them."""
    near: dict = {}
    for o, s, _ in lines:
        near.setdefault(f"S{s}", set()).add(f"O{o}")
        near.setdefault(f"O{o}", set()).add(f"S{s}")
    best = {}
    for seed in (f"S{s}" for s in range(1, 70)):
        level = {seed: [seed]}
        seen = dict(level)
        for _ in range(depth):
            step: dict = {}
            for node, path in level.items():
                for b in near.get(node, ()):
                    if b not in seen:
                        step[b] = min(step.get(b, [*path, b]), [*path, b])
            level = step
            seen |= step
        best |= {(seed, n): p for n, p in seen.items()}
    return best


@pytest.mark.parametrize("hub", [True, False])
def test_paths_from_all_seeds(spark, tables, lines, hub):
    lines = lines if hub else [x for x in lines if x[0] != 200]
    some = tables | {"lineitem": spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity int")}
    best = shortest(lines, 4)
    assert sorted(run("bounded_bfs", **some)) == sorted((s, n, len(p) - 1) for (s, n), p in best.items())
    want = sorted((s, n, ";".join(p)) for (s, n), p in best.items() if n[0] == "S" and n != s)
    assert sorted(run("path_context", **some)) == want and len({s for s, _, _ in want}) > 30


def test_paths_have_400_rows_a_seed(spark):
    some = {"lineitem": spark.createDataFrame([(1, s) for s in range(1, 451)] + [(2, 450), (2, 451)], "l_orderkey long, l_suppkey long"), "supplier": spark.createDataFrame([(s,) for s in range(1, 452)], "s_suppkey long")}
    n = Counter(s for s, _, _ in run("path_context", **some))
    assert set(n.values()) == {400} and len(n) == 451


def test_hubs_of_all_seeds(tables, lines):
    members: dict = {}
    for o, s, _ in lines:
        members.setdefault(o, set()).add(s)
    want = []
    for s in range(1, 70):
        for _, o in sorted((len(m), o) for o, m in members.items() if s in m and len(m) <= 60)[:12]:
            want += [(s, o, n) for n in sorted(members[o] - {s}, key=lambda n: (n % 2, n))[:5]]
    assert sorted(run("specific_hubs", **tables)) == sorted(want)


def test_components_of_all_orders(spark):
    orders = spark.createDataFrame([(o, o % 7, 1000.0 * o) for o in range(1, 50)], "o_orderkey long, o_custkey long, o_totalprice double")
    assert sorted(run("connected_components", orders=orders)) == sorted([(o, o % 7 or 7) for o in range(1, 50)] + [(1000000 + c, c or 7) for c in range(7)])


def greedy(edges: list[tuple[str, str, float]]) -> dict[str, int]:
    """Communities by greedy moves and merging into super-nodes, in sorted order, so that the result is always the same."""
    graph: dict = defaultdict(lambda: defaultdict(float))
    for u, v, w in edges:
        if u != v:
            graph[u][v] += w
            graph[v][u] += w
    member = {n: [n] for n in graph}
    two_m = sum(sum(x.values()) for x in graph.values())
    while two_m > 0:
        degree = {n: sum(x.values()) for n, x in graph.items()}
        community = {n: n for n in graph}
        total = dict(degree)
        moved = True
        while moved:
            moved = False
            for n in sorted(graph):
                links: dict = defaultdict(float)
                for v, w in graph[n].items():
                    if v != n:
                        links[community[v]] += w
                old = community[n]
                total[old] -= degree[n]
                gain = lambda c, links=links, n=n: links.get(c, 0.0) - total.get(c, 0.0) * degree[n] / two_m
                best = old
                for c in sorted(links):
                    if gain(c) > gain(best) + 1e-12:
                        best = c
                total[best] = total.get(best, 0.0) + degree[n]
                community[n] = best
                moved |= best != old
        merged: dict = defaultdict(list)
        for n, c in community.items():
            merged[c] += member[n]
        if len(merged) == len(graph):
            break
        new: dict = defaultdict(lambda: defaultdict(float))
        for n, x in graph.items():
            for v, w in x.items():
                new[community[n]][community[v]] += w
        graph, member = new, dict(merged)
    order = sorted(member.values(), key=lambda m: (-len(m), min(m)))
    return {n: i for i, m in enumerate(order) for n in m}


def test_communities_of_all_pairs(tables, lines):
    members: dict = {}
    for o, s, _ in lines:
        if o != 200:
            members.setdefault(o, set()).add(s)
    few = tables | {"lineitem": tables["lineitem"].where("l_orderkey <> 200")}
    w = Counter(p for m in members.values() for p in combinations(sorted(m), 2))
    found = greedy(sorted((str(a), str(b), float(n)) for (a, b), n in w.items()))
    size = Counter(found.values())
    assert sorted(run("communities", **few)) == sorted(("x", n, c) for n, c in found.items() if size[c] >= 3)
    assert {n for n, _ in run("label_propagation", **few)} == {n for p in w for n in p}


@pytest.mark.parametrize("seed", range(12))
def test_communities_by_brute_force(seed):
    rng = random.Random(seed)
    n = rng.choice([4, 20, 60, 200])
    edges = sorted((a, b, rng.choice([0.1, 0.3, 1.0, rng.random()])) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(n * rng.choice([1, 2, 5]))))
    node, found = community.modularity_communities(*(np.array(x) for x in zip(*edges, strict=True)))
    assert dict(zip(node.tolist(), found.tolist(), strict=True)) == greedy(edges)


def test_communities_of_a_large_graph(spark):
    """A ring of 1200 groups of 30 nodes, each of 435 edges."""
    pairs = spark.range(1200 * 900).select((F.col("id") / 900).cast("int").alias("k"), (F.col("id") % 900 / 30).cast("int").alias("i"), (F.col("id") % 30).cast("int").alias("j"))
    e = pairs.where("i < j").selectExpr("'x' g", "k * 30 + i a", "k * 30 + j b", "1.0 w").unionByName(spark.range(1200).selectExpr("'x' g", "cast(id * 30 as int) a", "cast((id + 1) % 1200 * 30 as int) b", "0.01 w"))
    rows = community.communities(e, "g", "a", "b", "w").collect()
    together = defaultdict(set)
    for r in rows:
        together[int(r.node) // 30].add(r.community)
    assert e.count() == 523_200 and len(rows) == 36_000 and all(len(c) == 1 for c in together.values())


def test_an_edge_is_followed_once_for_many_seeds(spark, monkeypatch):
    """700 seeds, two of them with several starts, around one hub, in two strains; what is written between levels has a row for WORDS * 64 seeds."""
    written = []

    def settled(df, name="settled"):
        out = settle(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(paths, "settle", settled)
    edges = [("x", f"n{i}", "hub") for i in range(700)] + [("y", "n0", "far"), ("y", "far", "end")]
    graph = spark.createDataFrame([(s, *e) for s, a, b in edges for e in ((a, b), (b, a))], "strain string, a string, b string")
    seeds = [("x", f"s{i}", f"n{i}") for i in range(700)] + [("x", "s0", "n1"), ("y", "s0", "n0"), ("y", "s1", None)]
    got = paths.bounded_distances(graph, spark.createDataFrame(seeds, "strain string, seed string, node string"), 2)
    assert got.columns == ["strain", "seed", "node", "path_length"]
    want = [("x", f"s{i}", n, d) for i in range(700) for n, d in [("hub", 1), *((f"n{j}", 2) for j in range(700) if j != i and (i, j) != (0, 1)), (f"n{i}", 0)]]
    want += [("x", "s0", "n1", 0), ("y", "s0", "n0", 0), ("y", "s0", "far", 1), ("y", "s0", "end", 2), ("y", "s1", None, 0)]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert max(written) <= 2 * 1403
