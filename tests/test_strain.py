"""The whole strain pipeline on files of two small strains, one of them without expression."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stratagraph import sinks
from stratagraph.plans import strain as plan
from stratagraph.sources import annotations, config
from stratagraph.streaming import windowed_means

N = 14


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("strains")
    rng = random.Random(5)
    for name, expressed in (("S1", True), ("S2", False)):
        own = root / name
        (own / "genome").mkdir(parents=True)
        (own / "proteomics").mkdir()
        lines = ["\t".join(["c1", "x", "CDS", str(1000 * i + 1), str(1000 * i + 900), ".", "+" if i % 2 else "-", "0", f"locus_tag=g{i:02};protein_id=WP_{i:02}.1"]) for i in range(N)]
        (own / "genome" / "a.gff").write_text("\n".join(lines))
        base = [rng.random() for _ in range(6)]
        if expressed:
            (own / "transcriptomic").mkdir()
            rows = ["gene_id\t" + "\t".join(f"r{j}" for j in range(6))] + [f"g{i:02}\t" + "\t".join(str(round(5 + (base[j] * i if i < 7 else rng.random()) + (2 if j > 2 and i == 3 else 0), 3)) for j in range(6)) for i in range(N)]
            (own / "transcriptomic" / "x_cpmlog2.tsv").write_text("\n".join(rows))
        rows = ["Protein," + ",".join(f"p{j}" for j in range(6))] + [f"ref|WP_{i:02}.1|," + ",".join(str(round(100 + 50 * rng.random() * (i + 1), 2)) for _ in range(6)) for i in range(10)]
        (own / "proteomics" / "areas.csv").write_text("\n".join(rows))
        (root / "maf.tsv").write_text("database_identifier\tmetabolite_identification\tmass_to_charge\t1\t2\t3\t4\nCHEBI:1\tCitrate\t1\t10\t12\t30\t33\n\tMalate\t2\t5\t5\t5\t5\n")
        doc = {"name": name, "transcriptomics": {"rpmi_samples": ["r0", "r1", "r2"], "sera_samples": ["r3", "r4", "r5"]}, "proteomics": {"rpmi_ids": ["p0", "p1", "p2"], "sera_ids": ["p3", "p4", "p5"], "swath": {}}, "metabolomics": {"enabled": True, "maf_files": ["../maf.tsv"], "rpmi_samples": ["1", "2"], "sera_samples": ["3", "4"]}}
        (own / "config.json").write_text(json.dumps(doc))
    (root / "m.annotations").write_text("#query\tseed_ortholog\tCOG_category\tDescription\tPreferred_name\tKEGG_ko\tKEGG_Pathway\n" + "\n".join(f"WP_{i:02}.1\ts\t{'VK'[i % 2]}\td\tp\tko:K1\tko0{i % 3}" for i in range(N)))
    (root / "amr.json").write_text(json.dumps({s: {"tet": {"name": "tet", "amr_class": "tetracycline", "locus_tag": "g03", "protein_id": "WP_03.1"}, "far": {"amr_class": "other", "locus_tag": ["g12", "g13"], "protein_id": None}} for s in ("S1", "S2")}))
    layers = plan.measure(spark, [config.load(s, str(root)) for s in ("S1", "S2")])
    a = plan.empty_annotations(spark)
    a.categories, a.pathways = plan.annotate_by_orthologs(layers, annotations.mapper_annotations(spark, str(root / "m.annotations")))
    a.markers = plan.load_markers(spark, str(root / "amr.json"))
    both = [(s, f"WP_{i:02}.1", f"WP_{j:02}.1", 0.9) for s in ("S1", "S2") for i, j in ((3, 4), (4, 5), (3, 5), (5, 3))]
    a.interactions = spark.createDataFrame(both, "strain string, protein_a string, protein_b string, combined_score double")
    a.go = spark.createDataFrame([(s, f"WP_0{i}.1", "GO:1") for s in ("S1", "S2") for i in (3, 4)], "strain string, protein_id string, go_id string")
    a.metabolite_pathway = spark.createDataFrame([("S1", "CHEBI:1", "ko00"), ("S2", "CHEBI:1", "ko00")], "strain string, metabolite_id string, pathway string")
    a.metabolite_ec = spark.createDataFrame([("S1", "M-Malate", "1.1.1.1")], "strain string, metabolite_id string, ec string")
    a.protein_ec = spark.createDataFrame([("S1", "WP_03.1", "1.1.1.1")], "strain string, protein_id string, ec string")
    edges = plan.build_graph(layers, a)
    members = plan.build_hypergraph(layers, a, edges)
    return layers, a, edges, members


def test_layers(made):
    layers, *_ = made
    assert layers.aligned.groupBy("strain").count().orderBy("strain").collect() == [("S1", 10), ("S2", 10)]
    assert layers.aligned.where("strain = 'S2' and RNA_logFC is not null").count() == 0
    assert layers.aligned.where("strain = 'S1' and RNA_logFC is null").count() == 0
    up = layers.aligned.where("gene_id = 'g03' and strain = 'S1'").first()
    assert up.cds_length == 900 and up.RNA_logFC > 1
    assert layers.metabolite.where("metabolite_id = 'CHEBI:1'").first().n_instruments == 1


def test_graph(made):
    _, _, edges, _ = made
    n = {(r.strain, r.relation): r.n for r in edges.groupBy("strain", "relation").agg(F.count("*").alias("n")).collect()}
    assert n["S1", "genomic_proximity"] == N - 1 and n["S1", "encodes"] == 10 and n["S2", "ppi"] == 3
    assert n["S1", "transcriptional_correlation"] > 0 and ("S2", "transcriptional_correlation") not in n
    assert n["S1", "member_of_cluster"] == 3 and n["S1", "metabolised_by"] == 1 and n["S1", "in_pathway"] == N + 1 and n["S1", "cog_category"] == N


def test_trace(made, spark):
    layers, a, edges, members = made
    t = plan.trace(layers, a, edges, members)
    rows = {(r.strain, r.marker, r.gene_id): r for r in t.traces.collect()}
    tet = rows["S1", "tet", "g03"]
    assert tet.status == "multi_omics" and tet.layer_coverage == 8 and tet.rna_direction == "up" and tet.metabolome_status == "observed"
    assert rows["S2", "tet", "g03"].transcriptome_status == "unavailable" and rows["S2", "tet", "g03"].status == "multi_omics"
    assert rows["S2", "far", "g12"].status == "genome_only" and rows["S2", "far", "g12"].genome_only_by_alignment
    kinds = {r.relationship for r in t.evidence.select("relationship").distinct().collect()}
    assert {"rna_quantified", "protein_quantified", "genomic_proximity", "ppi", "in_pathway", "cog_category", "go_annotation", "amr_mechanism", "shares_pathway", "metabolite_quantified", "hyperedge_membership", "graph_context"} <= kinds
    c = t.candidates.collect()
    assert sorted(r["rank"] for r in c) == list(range(1, len(c) + 1)) and not {"g03", "WP_03.1"} & {r.candidate for r in c}


def test_sinks(made, spark, tmp_path):
    layers, a, edges, members = made
    sinks.write_edges(edges, str(tmp_path / "edges"))
    assert spark.read.parquet(str(tmp_path / "edges")).count() == edges.count()
    sinks.write_hypergraph(members, str(tmp_path / "hyper"), plan.FAMILIES)
    h = spark.read.parquet(str(tmp_path / "hyper" / "hyperedges"))
    assert h.where("n_nodes < 2").count() == 0 and h.where("strain = 'S1'").agg(F.min("hyperedge_id"), F.max("hyperedge_id"), F.count("*")).first()[:2] == (0, h.where("strain = 'S1'").count() - 1)
    sinks.write_laplacian(members, str(tmp_path / "lap"))
    sinks.write_sif(edges, str(tmp_path / "sif"))
    assert spark.read.text(str(tmp_path / "sif")).first()[0].count("\t") == 2
    g = sinks.gene_table(layers.genes.select("strain", "gene_id"), a.markers)
    assert g.where("is_amr_gene").count() == 6 and g.where("amr_class is null").count() == 0
    assert any("encodes edges" in line for line in sinks.metadata_lines(edges))
    (tmp_path / "in.txt").write_text("abc")
    doc = json.loads(sinks.run_manifest(spark, [str(tmp_path / "in.txt")], {"top_k": 10}))
    assert list(doc["inputs"].values()) == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]
    assert sinks.markdown(g.orderBy("gene_id"), ["gene_id"], 1).splitlines()[-1] == "| g00 |"


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'g' AS e, 'A' AS c, 1.0D AS v UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'g', 'B', 4.0D")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_means(stream, "ts", "e", "c", "v", "A", "B").writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT change FROM means").first()[0] == 3.0 == windowed_means(rows, "ts", "e", "c", "v", "A", "B").first().change
