"""A project of two strains: resumed runs, changed layers, reports, and the command line."""

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from stratagraph import __main__ as command
from stratagraph.plans import project, report
from stratagraph.plans import strain as plan
from stratagraph.sources import config

N = 12


def write_rna(own, seed):
    rng = random.Random(seed)
    base = [rng.random() for _ in range(6)]
    rows = ["gene_id\t" + "\t".join(f"r{j}" for j in range(6))] + [f"g{i:02}\t" + "\t".join(str(round(5 + (base[j] * i if i < 7 else rng.random()), 3)) for j in range(6)) for i in range(N)]
    (own / "transcriptomic" / "x_cpmlog2.tsv").write_text("\n".join(rows))


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    for k, name in enumerate(("S1", "S2")):
        own, rng = root / "strains" / name, random.Random(k)
        for folder in ("genome", "transcriptomic", "proteomics", "annotation"):
            (own / folder).mkdir(parents=True)
        lines = ["\t".join(["c1", "x", "CDS", str(1000 * i + 1), str(1000 * i + 900), ".", "+", "0", f"locus_tag=g{i:02};protein_id=WP_{i:02}.1"]) for i in range(N)]
        (own / "genome" / "a.gff").write_text("\n".join(lines))
        write_rna(own, 10 + k)
        rows = ["Protein," + ",".join(f"p{j}" for j in range(6))] + [f"ref|WP_{i:02}.1|," + ",".join(str(round(100 + 50 * rng.random() * (i + 1), 2)) for _ in range(6)) for i in range(10)]
        (own / "proteomics" / "areas.csv").write_text("\n".join(rows))
        (own / "annotation" / "eggnog.annotations").write_text("#query\tseed_ortholog\tCOG_category\tDescription\tPreferred_name\tKEGG_ko\tKEGG_Pathway\n" + "\n".join(f"WP_{i:02}.1\ts\t{'VK'[i % 2]}\td\tp\tko:K1\tko0{i % 3}" for i in range(N)))
        (root / "maf.tsv").write_text("database_identifier\tmetabolite_identification\tmass_to_charge\t1\t2\t3\t4\nCHEBI:1\tCitrate\t1\t10\t12\t30\t33\n\tMalate\t2\t5\t6\t5\t8\n")
        doc = {"name": name, "transcriptomics": {"rpmi_samples": ["r0", "r1", "r2"], "sera_samples": ["r3", "r4", "r5"]}, "proteomics": {"rpmi_ids": ["p0", "p1", "p2"], "sera_ids": ["p3", "p4", "p5"], "swath": {}}, "metabolomics": {"enabled": True, "maf_files": ["../../maf.tsv"], "rpmi_samples": ["1", "2"], "sera_samples": ["3", "4"]}}
        (own / "config.json").write_text(json.dumps(doc))
    (root / "markers.json").write_text(json.dumps({s: {"tet": {"amr_class": "tetracycline", "locus_tag": "g03", "protein_id": "WP_03"}, "far": {"amr_class": "other", "locus_tag": ["g11"], "protein_id": None}} for s in ("S1", "S2")}))
    tables = root / "tables"
    both = [(s, f"WP_{i:02}.1", f"WP_{j:02}.1", 0.9) for s in ("S1", "S2") for i, j in ((3, 4), (4, 5), (3, 5))]
    spark.createDataFrame(both, "strain string, protein_a string, protein_b string, combined_score double").write.parquet(str(tables / "interactions.parquet"))
    spark.createDataFrame([(s, f"WP_0{i}.1", "GO:1") for s in ("S1", "S2") for i in (3, 4)], "strain string, protein_id string, go_id string").write.parquet(str(tables / "go.parquet"))
    spark.createDataFrame([("S1", "CHEBI:1", "ko00"), ("S2", "CHEBI:1", "ko00")], "strain string, metabolite_id string, pathway string").write.parquet(str(tables / "metabolite_pathway.parquet"))
    spark.createDataFrame([(s, "WP_03.1", "GO:77") for s in ("S1", "S2")], "strain string, accession string, go_id string").write.parquet(str(tables / "recovered.parquet"))
    return root


def run_of(spark, inputs, out, names=("S1", "S2"), **more):
    tables = {p.name[:-8]: str(p) for p in (inputs / "tables").glob("*.parquet")}
    strains = [config.load(s, str(inputs / "strains")) for s in names]
    return project.Run(spark, str(out), strains, str(inputs / "markers.json"), tables, **more)


def rows_of(run, stage):
    return sorted(map(repr, run.store.table(stage).collect()))


@pytest.fixture(scope="module")
def done(spark, inputs, tmp_path_factory):
    out = tmp_path_factory.mktemp("project") / "out"
    first = project.advance(run_of(spark, inputs, out), "protein")  # stopped here
    rest = project.advance(run_of(spark, inputs, out))
    return out, first, rest


def test_a_stopped_run_goes_on(spark, inputs, done):
    out, first, rest = done
    names = [s.name for s in project.stages(run_of(spark, inputs, out))]
    assert [*first, *rest] == names and list(first)[-1] == "protein" and rest["candidates"] == ["*"] and rest["aligned"] == ["S1", "S2"]
    assert project.advance(run_of(spark, inputs, out)) == {}


def test_a_replaced_layer_touches_what_depends_on_it(spark, inputs, done, tmp_path):
    copy, out = tmp_path / "inputs", tmp_path / "out"
    shutil.copytree(inputs, copy)
    shutil.copytree(done[0], out)
    before = json.loads((out / "manifest.json").read_text())
    files = {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet")}
    write_rna(copy / "strains" / "S1", 99)
    made = project.advance(run_of(spark, copy, out))
    own = {"rna_replicates", "rna", "aligned", "gene_protein", "edges_transcripts", "traces", "evidence", "entities"}
    assert {s for s, names in made.items() if names == ["S1"]} == own and set(made) - own == {"candidates"}
    after = json.loads((out / "manifest.json").read_text())
    for stage, entry in before.items():
        assert after[stage]["strains"].get("S2") == entry["strains"].get("S2")
        assert stage in made or after[stage] == entry
    kept = [p for p in files if p.exists() and f"/{'__strain=S2'}/" in str(p)]
    assert kept and all(p.stat().st_mtime_ns == files[p] for p in kept)
    # the same as the plan in one go on the new files
    run = run_of(spark, copy, out)
    layers = plan.measure(spark, run.strains)
    a = run.annotations(["S1", "S2"])
    edges = plan.build_graph(layers, a)
    members = plan.build_hypergraph(layers, a, edges)
    t = plan.trace(layers, a, edges, members)
    for got, want in ((run.edges(["S1", "S2"]), edges), (run.members(["S1", "S2"]), members), (run.store.table("aligned"), layers.aligned), (run.store.table("traces"), t.traces), (run.store.table("evidence"), t.evidence), (run.store.table("candidates"), t.candidates)):
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and want.count()


def test_a_killed_stage_is_made_again(spark, inputs, done, tmp_path):
    """A write that the manifest doesn't name yet isn't read, and the next run overwrites it."""
    out = tmp_path / "out"
    shutil.copytree(done[0], out)
    manifest = json.loads((out / "manifest.json").read_text())
    want = rows_of(run_of(spark, inputs, out), "edges_transcripts")
    del manifest["edges_transcripts"]["strains"]["S1"]
    (out / "manifest.json").write_text(json.dumps(manifest))
    (out / ".manifest.json.crc").unlink()
    broken = next((out / "edges_transcripts" / "__strain=S1").rglob("*.parquet"))
    shutil.copy(broken, broken.with_name("part-left-over.snappy.parquet"))
    run = run_of(spark, inputs, out)
    assert run.store.table("edges_transcripts").where("strain = 'S1'").count() == 0
    assert project.advance(run) == {"edges_transcripts": ["S1"]} and rows_of(run, "edges_transcripts") == want


def test_parameters_and_strains(spark, inputs, done, tmp_path):
    out = tmp_path / "out"
    shutil.copytree(done[0], out)
    made = project.advance(run_of(spark, inputs, out, top_k=3), "edges_metabolites")
    assert set(made) == {"edges_transcripts", "edges_abundances", "edges_metabolites"}
    shutil.rmtree(out)
    shutil.copytree(done[0], out)
    run = run_of(spark, inputs, out, ["S2"])
    assert project.advance(run) == {"candidates": ["*"]} and run.store.table("genes").select("strain").distinct().collect() == [("S2",)]


def test_both_forms_and_recovered_terms(spark, inputs, done):
    """The marker is WP_03, the graph and the members have WP_03.1, and GO:77 was found later."""
    run = run_of(spark, inputs, done[0])
    rows = run.store.table("evidence").where("strain = 'S1' AND amr_determinant = 'tet'")
    found = {(r.relationship, r.target_entity) for r in rows.collect()}
    assert {("go_annotation", "GO:1"), ("go_annotation", "GO:77"), ("ppi", "WP_04.1"), ("ppi", "WP_05.1")} <= found
    assert any(k == "member_of_cluster" for k, _ in found) and ("hyperedge_membership", "GO:1") in found
    trace = run.store.table("traces").where("strain = 'S1' AND marker = 'tet'").first()
    assert trace.go_present and trace.ppi_amr_present and trace.n_ppi == 2
    assert not {"WP_03", "WP_03.1", "g03"} & {r.candidate for r in run.store.table("candidates").collect()}


def test_report_and_claims(spark, inputs, done, tmp_path):
    run = run_of(spark, inputs, done[0])
    claims = tmp_path / "claims.csv"
    claims.write_text(f"metric,strain,relation,published\ngenes,S1,,{N}\nedge,S1,ppi,3\nedge,S2,ppi,4\nnode,,gene,{N * 2}\ndeterminants,S2,,2\nedge,S1,nothing,1\n")
    rows = {(r.metric, r.strain, r.relation): (r.value, r.verdict) for r in report.checked(run, str(claims)).collect()}
    assert rows["genes", "S1", ""] == (N, "agrees") and rows["edge", "S1", "ppi"] == (3, "agrees") and rows["edge", "S2", "ppi"] == (3, "differs")
    assert rows["edge", "S1", "nothing"] == (None, "not found") and rows["determinants", "S2", ""][1] == "agrees" and rows["node", "", "gene"][1] == "differs"
    text = report.written(run, str(claims))
    for title in report.sections(run, str(claims)):
        assert f"## {title}\n\n| " in text
    assert "| tet | tetracycline |" in text and "| edge | S2 | ppi | 4.0 | 3.0 | -1.0 | differs |" in text


def test_command_line(spark, inputs, done, capsys, monkeypatch):
    monkeypatch.setattr(command, "_session", lambda master: spark)
    args = [str(inputs / "strains"), str(done[0]), "--markers", str(inputs / "markers.json"), "--annotations", str(inputs / "tables")]
    assert command.main(["strain", *args]) == 0 and capsys.readouterr().out == "all is up to date\n"
    assert command.main(["strain", *args, "--top-k", "3", "--until", "rna"]) == 0
    capsys.readouterr()
    assert command.main(["report", *args]) == 0 and "## Candidates" in capsys.readouterr().out
