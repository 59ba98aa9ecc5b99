"""Enrichment of determinants, lookups by either form, tails of binomials and medians, against plain loops."""

import json
import math
import statistics

import pytest
from pyspark.sql import functions as F

from stratagraph import __main__ as cli
from stratagraph import sinks
from stratagraph.operators import candidates, display, enrich, graph, hyper, ordering
from stratagraph.plans import QUERIES, saved
from stratagraph.session import stage


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def known(spark):
    determinants = frame(spark, [("s", "L1", "WP_1.2"), ("s", "L2", "WP_2"), ("s", "L3", None), ("u", "L1", "WP_9.1")], "strain string, gene_id string, protein_id string")
    categories = frame(spark, [("WP_1", "K"), ("WP_1", "V"), ("WP_2", "K"), ("WP_7", "K")], "accession string, category string")
    pathways = frame(spark, [("WP_1", "ko1"), ("WP_2", "ko2")], "accession string, pathway string")
    recovered = enrich.recovered_terms(frame(spark, [("WP_1.2", "GO:1; GO:2;"), ("WP_1", "GO:2"), ("WP_2.5", "GO:9"), ("", "GO:3"), (None, None)], "accession string, go_terms string"))
    return determinants, categories, pathways, recovered


def test_recovered_terms_are_found_by_either_form(spark, known):
    determinants, _, _, recovered = known
    got = enrich.by_either_form(determinants, "protein_id", recovered, "accession").select("gene_id", "go_id").collect()
    # a table's version that the id doesn't have isn't guessed
    assert sorted(map(tuple, got)) == [("L1", "GO:1"), ("L1", "GO:2")]


def test_edges_are_found_whichever_has_the_version(spark):
    ids = frame(spark, [("a", "WP_1.1"), ("b", "WP_2"), ("c", None)], "m string, p string")
    e = frame(spark, [("WP_1", 1), ("WP_1.3", 2), ("WP_2.1", 3), ("x.1", 4)], "src string, n int")
    assert sorted((r.m, r.n) for r in enrich.by_canonical_form(ids, "p", e, "src").collect()) == [("a", 1), ("a", 2), ("b", 3)]


def test_missing_edges_are_added_once(spark, known):
    base = graph.edges(frame(spark, [("s", "L1", "K"), ("s", "N1", "K")], "strain string, a string, b string"), "a", "b", "gene", "cog_category", "annotation")
    near = frame(spark, [("s", "L1", "N1"), ("s", "N2", "L1"), ("s", "L2", "L2"), ("u", "L1", "N1")], "strain string, gene_a string, gene_b string")
    once = enrich.enriched_edges(base, *known, near)
    want = {("s", "cog_category", "L1", "K"), ("s", "cog_category", "N1", "K"), ("s", "cog_category", "L1", "V"), ("s", "cog_category", "L2", "K"), ("s", "in_pathway", "L1", "ko1"), ("s", "in_pathway", "L2", "ko2")}
    want |= {("s", "encodes", "L1", "WP_1.2"), ("s", "encodes", "L2", "WP_2"), ("u", "encodes", "L1", "WP_9.1"), ("s", "annotated_by", "WP_1.2", "GO:1"), ("s", "annotated_by", "WP_1.2", "GO:2"), ("s", "genomic_proximity", "L1", "N1")}
    got = [(r.strain, r.relation, r.src, r.dst) for r in once.collect()]
    assert sorted(got) == sorted(want)
    assert enrich.enriched_edges(once, *known, near).count() == len(want)


def test_hyperedges_get_members_or_are_new(spark, known):
    rows = [("s", "cog_category", "COG_K: Transcription", "N1"), ("s", "kegg_pathway", "ko1", "N1"), ("s", "go_term", "GO:1: binding", "P1"), ("u", "go_term", "GO:2: other", "P1")]
    members = frame(spark, rows, "strain string, type string, name string, node string")
    want = set(rows) | {("s", "cog_category", "COG_K: Transcription", "L1"), ("s", "cog_category", "COG_K: Transcription", "L2"), ("s", "cog_category", "COG_V: V", "L1"), ("s", "kegg_pathway", "ko1", "L1"), ("s", "kegg_pathway", "ko2", "L2"), ("s", "go_term", "GO:1: binding", "WP_1.2"), ("s", "go_term", "GO:2: GO:2", "WP_1.2")}
    got = enrich.enriched_members(members, *known)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert enrich.enriched_members(got, *known).count() == len(want)


def test_tails_equal_sums(spark):
    cases = [(k, s, n) for s, n in ((1, 2), (5, 3), (40, 7), (300, 2), (2000, 900), (5000, 11)) for k in sorted({1, 2, s // n, s // n + 3, s // 2, s}) if k <= s] + [(0, 5, 3), (6, 5, 3), (1, 0, 3), (1, 5, 1)]

    def tail(k, s, n):
        if n <= 1 or s <= 0:
            return None
        log = lambda i: math.lgamma(s + 1) - math.lgamma(i + 1) - math.lgamma(s - i + 1) + i * math.log(1 / n) + (s - i) * math.log(1 - 1 / n)
        return 1.0 if k <= 0 else min(1.0, math.fsum(math.exp(log(i)) for i in range(k, s + 1)))

    got = candidates.binomial_tails(frame(spark, cases, "k long, s long, n long"), "k", "s", "n").collect()
    assert len(got) == len(cases)
    for r in got:
        want = tail(r.k, r.s, r.n)
        assert r.p_value is None if want is None else abs(r.p_value - want) < 1e-9


@pytest.mark.parametrize("held", [1_000_000, 2])
def test_medians(spark, monkeypatch, held):
    monkeypatch.setattr(ordering, "HELD", held)
    rows = [("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 7.0), ("b", 7.0), ("b", 1.0), ("c", None), (None, 4.0)]
    df = frame(spark, rows, "g string, v double")
    got = {r.g: r["median"] for r in ordering.medians(df, ["g"], "v").collect()}
    assert got == {g: statistics.median([v for x, v in rows if x == g and v is not None]) for g in ("a", "b", None)}
    assert ordering.medians(df, [], "v").first()["median"] == 3.5


def test_hyperedge_ids_by_strain(spark):
    rows = [("s", "b", "y"), ("s", "a", "z"), ("s", "c", "x"), ("u", "c", "x"), ("s", "b", "x")]
    got = hyper.with_ids(frame(spark, rows, "strain string, type string, name string"), ["b", "a"]).collect()
    assert sorted((r.strain, r.hyperedge_id, r.type, r.name) for r in got) == [("s", 0, "b", "x"), ("s", 1, "b", "y"), ("s", 2, "a", "z"), ("s", 3, "c", "x"), ("u", 0, "c", "x")]


def test_texts_of_layers(spark):
    df = frame(spark, [(True, 1.25, "Up", 2, "a; b"), (False, None, None, 0, None), (True, float("nan"), " ", 3, "x" * 30), (True, None, "Up", 1, " y "), (None, 1.0, "Up", 1, "z" * 10)], "there boolean, v double, c string, n int, names string")
    got = df.select(display.measured_text(F.col("there"), F.col("v"), F.col("c"), "RNA", "none").alias("m"), display.counted_text(F.col("n"), F.col("names"), "terms", "no term", 10).alias("t")).collect()
    assert [tuple(r) for r in got] == [("RNA 1.25 (Up)", "2 terms\na; b"), ("none", "no term"), ("RNA n/a (n/a)", "3 terms\nxxxxxxxxx…"), ("RNA n/a (Up)", "1 terms\ny"), ("none", "1 terms\nzzzzzzzzzz")]


def test_names_of_nodes(spark):
    genes = frame(spark, [("L1", "abcA", "WP_1"), ("L1", "zzz", "WP_1"), ("L2", " ", None)], "gene_id string, gene_name string, protein_id string")
    metabolites = frame(spark, [("CHEBI:1", None), ("M-x", "x")], "metabolite_id string, name string")
    nodes = frame(spark, [(n,) for n in ("L1", "L1_RNA", "WP_1", "L2", "L9_RNA", "CHEBI:1", "M-x", "ko1")], "node string")
    got = {r.node: r.shown for r in display.display_names(nodes, genes, metabolites).collect()}
    assert got == {"L1": "abcA", "L1_RNA": "abcA RNA", "WP_1": "abcA", "L2": "L2", "L9_RNA": "L9 RNA", "CHEBI:1": "CHEBI:1", "M-x": "x", "ko1": "ko1"}


def test_summaries_of_saved_tables(spark, tmp_path):
    frame(spark, [("g1", "Up"), ("g2", "Up"), ("g3", "Down")], "gene_id string, call string").write.parquet(f"{tmp_path}/aligned")
    frame(spark, [("s", "go_term", "GO:1", n) for n in "ab"] + [("s", "go_term", "GO:2", "a")], "strain string, type string, name string, node string").write.parquet(f"{tmp_path}/members")
    tables, issues = saved.rebuilt(spark, (f"{tmp_path}/aligned", "call"), f"{tmp_path}/edges", f"{tmp_path}/members")
    assert {r["call"]: r.n for r in tables["regulation"].collect()} == {"Up": 2, "Down": 1}
    assert tuple(tables["families"].first()) == ("go_term", 1, 2.0, 2) and tuple(tables["hypergraph"].first())[:3] == (2, 1, 2)
    assert issues == [f"{tmp_path}/edges: isn't there"] and "relations" not in tables


def test_stages_are_timed_and_manifests_say_where_from(spark):
    seconds = {}
    with pytest.raises(ZeroDivisionError), stage(spark, "a", seconds):
        1 / 0
    assert seconds["a"] >= 0
    m = json.loads(sinks.run_manifest(spark, [], {"depth": 4}, seed=42))
    assert m["seed"] == 42 and set(m["git"]) in ({"commit", "changed"}, set())


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and len(capsys.readouterr().out.splitlines()) == len(QUERIES)
    assert cli.main(["sql", "unresolved"]) == 0 and "SELECT" in capsys.readouterr().out
    assert cli.main(["sql", "perm_test"]) == 1
