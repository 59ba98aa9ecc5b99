"""Operators whose groups may be larger than a task, against plain loops on tables of one group."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.operators import correlation, hyper, ordering, windows, reports
from stratagraph.plans import QUERIES


def rows(df, *by):
    return sorted((tuple(r) for r in df.select(*by).collect()), key=repr)


@pytest.mark.parametrize("groups", [1, 3, 40])
def test_neighbours_over_borders_of_ranges(spark, groups):
    rng = random.Random(groups)
    places = rng.sample(range(100_000), 3000)
    df = spark.createDataFrame([(f"c{rng.randrange(groups)}", s, s + rng.randrange(40), f"e{k}") for k, s in enumerate(places)] + [("alone", 5, 9, "z"), (None, 1, 2, "n1"), (None, 4, 6, "n2")], "replicon string, start long, end long, id string")
    w = W.partitionBy("replicon").orderBy("start", "end", "id")
    want = df.select("replicon", F.col("id").alias("id_a"), F.lead("id").over(w).alias("id_b"), (F.lead("start").over(w) - F.col("end")).alias("distance")).where("distance > 0 AND distance <= 60")
    got = windows.sequential_neighbours(df, ["replicon"], "start", "end", "id", 60)
    assert rows(got, "replicon", "id_a", "id_b", "distance") == rows(want, "replicon", "id_a", "id_b", "distance") and want.count() > 50


@pytest.mark.parametrize(("groups", "share"), [(1, 0.3), (1, 0.002), (1, 0.0), (5, 0.01), (300, 0.2)])
def test_filling_over_borders_of_ranges(spark, groups, share):
    rng = random.Random(groups)
    df = spark.createDataFrame([(rng.randrange(groups), n, f"h{n}" if rng.random() < share else None, n % 7) for n in range(2500)] + [(None, 1, None, 0), (None, 2, "x", 0), (None, 3, None, 0)], "file int, n int, head string, rest int")
    w = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumn("block", F.last("head", ignorenulls=True).over(w))
    got = windows.filled_forward(df, ["file"], ["n"], "head", "block")
    assert got.columns == want.columns and rows(got, *want.columns) == rows(want, *want.columns)


def test_a_group_is_many_ranges(spark):
    df = spark.range(8000).select(F.lit("c").alias("g"), "id")
    ranges = ordering.in_ranges(df, ["g"], ["id"])
    sizes = [r["count"] for r in ranges.rows.groupBy("__part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 4000 and ranges.borders(F.count("*").alias("n")).count() == 4
    assert windows.filled_forward(df.limit(0), ["g"], ["id"], "id", "x").count() == 0


def brute_laplacian(members):
    de, dv = Counter(e for e, _ in members), Counter(v for _, v in members)
    own = {e: [v for f, v in members if f == e] for e in de}
    total = Counter()
    for e, nodes in own.items():
        for i in nodes:
            for j in nodes:
                total[i, j] += 1 / de[e]
    return {k: t / (dv[k[0]] * dv[k[1]]) ** 0.5 for k, t in total.items()}


@pytest.mark.parametrize("nodes", [500, 7, 1])
def test_laplacian_in_blocks(spark, monkeypatch, nodes):
    monkeypatch.setattr(hyper, "NODES", nodes)
    rng = random.Random(nodes)
    members = sorted({(e, f"n{rng.randrange(60)}") for e in range(12) for _ in range(4 * e + 1)})
    got = {(r.i, r.j): r.value for r in hyper.laplacian(spark.createDataFrame(members, "e int, v string"), ["e"], "v").collect()}
    want = brute_laplacian(members)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_a_hub_is_many_keys(spark):
    """One hyperedge of 3000 nodes: no key of the join has more than its block's share."""
    inc = spark.range(3000).select(F.lit(1).alias("e"), F.col("id").alias("v"))
    out = hyper.laplacian(inc, ["e"], "v")
    assert out.count() == 9_000_000 and out.where("abs(value - 1 / 3000d) > 1e-12").count() == 0


@pytest.mark.parametrize(("block", "top_k", "mode"), [(2000, 0, "either"), (9, 0, "either"), (9, 4, "either"), (9, 4, "mutual"), (2000, 4, "mutual")])
def test_correlation_of_groups(spark, monkeypatch, block, top_k, mode):
    """Groups with other samples, ties, missing values and one entity in several groups give the rows that each gives alone."""
    monkeypatch.setattr(correlation, "BLOCK", block)
    rng = np.random.default_rng(3)
    data = []
    for g, (entities, samples) in enumerate([(30, 6), (45, 5), (3, 8), (20, 2), (1, 4)]):
        shapes = rng.normal(size=(5, samples))
        for i in range(entities):
            for j in range(samples):
                v = float(shapes[i % 5, j] * (1 if i % 2 else -2)) if i % 3 else float(rng.normal())
                data.append((f"s{g}", f"e{i}", f"r{j}", None if (i, j) == (4, 1) else v))
    df = spark.createDataFrame(data, "strain string, e string, r string, v double")
    got = correlation.correlation_edges(df, "e", "r", "v", 0.6, top_k, mode, by=["strain"])
    assert got.columns == ["strain", "a", "b", "r"]
    want = []
    for g in range(5):
        one = correlation.correlation_edges(df.where(F.col("strain") == f"s{g}"), "e", "r", "v", 0.6, top_k, mode)
        want += [(f"s{g}", *r) for r in one.collect()]
    assert sorted(want) == sorted(tuple(r) for r in got.collect()) and {"s0", "s1"} <= {w[0] for w in want} <= {"s0", "s1", "s2"}


def test_jobs_do_not_follow_groups(spark):
    """As many jobs for 24 groups as for two."""
    jobs = []
    for groups in (2, 24):
        rng = np.random.default_rng(groups)
        df = spark.createDataFrame([(f"s{g}", i, j, float(rng.normal())) for g in range(groups) for i in range(12) for j in range(5)], "strain string, e int, r int, v double")
        spark.sparkContext.setJobGroup(f"correlation-{groups}", "")
        assert correlation.correlation_edges(df, "e", "r", "v", 0.5, 4, by=["strain"]).select("strain").distinct().count() == groups
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"correlation-{groups}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_a_dashboard_is_one_scan(spark):
    plan = QUERIES["dashboard_counts"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_returnflag:string,l_linestatus:string>" in plan.replace(",l_quantity:double", "")


@pytest.mark.parametrize("types", [3, 40])
def test_dashboard_groups_each_id_once(spark, types):
    """As many totals as bits: an id is shuffled once for all levels. More: grouping sets."""
    rng = np.random.default_rng(types)
    rows = [(None if s == 2 else f"s{s}", "node" if i % 3 else "edge", f"t{t}" if t else None, f"i{i}" if i % 7 else None) for s, t, i in zip(rng.integers(0, 3, 600), rng.integers(0, types, 600), rng.integers(0, 90, 600), strict=True)]
    out = reports.dashboard(spark.createDataFrame(rows, "strain string, kind string, type string, id string"))
    want = {}
    for s, k, t, i in rows:
        for total in ((s, k, t, 0), (s, k, None, 1), (None, k, t, 4), (None, k, None, 5)):
            want.setdefault(total, []).append(i)
    assert out.columns == ["strain", "kind", "type", "level", "n", "n_distinct"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(str((*k, len(v), len(set(v) - {None}))) for k, v in want.items())
    assert ("Expand" in out._jdf.queryExecution().executedPlan().toString()) == (types == 40)


def test_dashboard_of_nothing(spark):
    assert reports.dashboard(spark.createDataFrame([], "strain string, kind string, type string, id string")).collect() == []
    only = spark.createDataFrame([("s", "node", "t", None)], "strain string, kind string, type string, id string")
    assert sorted(tuple(r)[3:] for r in reports.dashboard(only).collect()) == [(0, 1, 0), (1, 1, 0), (4, 1, 0), (5, 1, 0)]
