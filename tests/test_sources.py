import json
import zipfile

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import align
from stratagraph.sources import annotations, config, gff, kept, saved, tables, workbook


def cds(start, end, attrs, replicon="c1", kind="CDS"):
    return "\t".join([replicon, "x", kind, str(start), str(end), ".", "+", "0", attrs])


GFF = "\n".join(["##gff-version 3", cds(1, 90, "locus_tag=g1;protein_id=WP_1.1;gene=a"), cds(91, 200, "locus_tag=g2;Dbxref=Genbank:x,GenBank:WP_2.1"), cds(180, 300, "Parent=gene-g3;protein_id=WP_3.1;note=a=b"), cds(5300, 5400, "locus_tag=g4;locus_tag=g4b;protein_id=WP_4.1"), cds(10402, 10500, "locus_tag=g5;protein_id=WP_5.1"), cds(1, 50, "locus_tag=h1;protein_id=WP_1.1", "c2"), cds(1, 9, "product=none"), "short\trow", cds(1, 9, "locus_tag=t", kind="tRNA"), cds(1, 90, "locus_tag=g1;gene=sym", kind="gene")])


@pytest.fixture()
def genes(spark, tmp_path):
    (tmp_path / "a.gff").write_text(GFF)
    return gff.coding_genes(spark, str(tmp_path / "a.gff"))


def test_gff(spark, genes, tmp_path):
    rows = {r.gene_id: r for r in genes.collect()}
    assert set(rows) == {"g1", "g2", "g3", "g4b", "g5", "h1"}
    assert rows["g2"].protein_id == "WP_2.1" and rows["g3"].cds_length == 121
    both = {r.gene_id: r for r in gff.genes_and_proteins(spark, str(tmp_path / "a.gff")).collect()}
    assert both["g1"].gene_name == "a" and both["g1"].protein_id == "WP_1.1"


def test_proximity(genes):
    from pyspark.sql import functions as F

    from stratagraph.operators import graph

    found = {(r.src, r.dst, r.weight) for r in graph.proximity_edges(genes.withColumn("strain", F.lit("s"))).collect()}
    assert found == {("g1", "g2", 1.0), ("g3", "g4b", 1 / 5000)}  # g2 and g3 overlap; g4b to g5 is 5002


def test_expression(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Gene ID\tSymbol\t1\t2\ng1\ta\t1.5\tx\ng2\t\t\t3\n\tz\t1\t1\n")
    rows = {(r.gene_id, r.sample_id): r.value for r in tables.expression(spark, str(tmp_path / "m.tsv")).collect()}
    assert rows == {("g1", "1"): 1.5, ("g1", "2"): 0.0, ("g2", "1"): 0.0, ("g2", "2"): 3.0}
    with pytest.raises(ValueError, match="export"):
        tables.wide(spark, "x.xls")
    assert tables.samples_named(["log 50857", "50858"], ["50857", "50858"]) == {"50857": "log 50857", "50858": "50858"}
    with pytest.raises(KeyError):
        tables.samples_named(["a"], ["b"])


def test_proteins(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Protein,5 (r),6 (s),7 (s)\nref|WP_1.1|,1,2,x\nWP_2.1,0,4,4\n")
    rows = tables.protein_areas(spark, str(tmp_path / "p.csv"), "Protein", {"RPMI": "{sid} (r)", "Sera": "{sid} (s)"}, {"RPMI": [5, 9], "Sera": [6, 7]}).collect()
    assert sorted((r.protein_id, r.sample_id, r.condition, r.value) for r in rows)[:3] == [("WP_1.1", "5", "RPMI", 1.0), ("WP_1.1", "6", "Sera", 2.0), ("WP_1.1", "7", "Sera", 0.0)]
    (tmp_path / "g.txt").write_text("Protein IDs\tFasta headers\tIntensity 5_RPMI\nREV__WP_1;WP_2\tEscherichia\t3\nWP_3;WP_4\tother\t4\n")
    assert {r.protein_id for r in tables.protein_groups(spark, str(tmp_path / "g.txt"), species="escherichia").collect()} == {"WP_1"}
    assert {r.protein_id for r in tables.protein_groups(spark, str(tmp_path / "g.txt"), bacterial_only=True).collect()} == {"WP_3"}


def test_sample_sheet(spark, tmp_path):
    (tmp_path / "s.txt").write_text("Source Name\tTerm Source REF\tFactor Value[Growth media]\tTerm Source REF\tFactor Value[Strain or isolate]\n102.1.1/50913\tx\tRPMI\ty\tK12\n102.1.1/50914\tx\tPooled sera\ty\tK12\n")
    assert [tuple(r) for r in tables.sample_sheet(spark, str(tmp_path / "s.txt")).orderBy("sample_id").collect()] == [("50913", "RPMI", "K12"), ("50914", "Pooled sera", "K12")]


def test_metabolites(spark, tmp_path):
    head = "database_identifier\tmetabolite_identification\tmass_to_charge\t"
    (tmp_path / "gc.tsv").write_text(head + "50913\t50914\nCHEBI:1\tCitrate\t1.5\t1\t3\n\tMalate\t\t2\t2\n\t\t\t9\t9\n")
    (tmp_path / "lc.tsv").write_text(head + "102.1.1/50913\nCHEBI:1\tCitrate\tbad\t100\n")
    rows = tables.metabolite_files(spark, [str(tmp_path / n) for n in ("gc.tsv", "lc.tsv", "no.tsv")]).collect()
    assert sorted((r.metabolite_id, r.instrument, r.sample_id, r.value) for r in rows) == [("CHEBI:1", "gc", "50913", 1.0), ("CHEBI:1", "gc", "50914", 3.0), ("CHEBI:1", "lc", "50913", 100.0), ("M-Malate", "gc", "50913", 2.0), ("M-Malate", "gc", "50914", 2.0)]
    with pytest.raises(FileNotFoundError):
        tables.metabolite_files(spark, [str(tmp_path / "no.tsv")])


def test_mapper(spark, tmp_path):
    (tmp_path / "m.annotations").write_text("## run\n#query\tseed_ortholog\tCOG_category\tDescription\tPreferred_name\tKEGG_ko\tKEGG_Pathway\nWP_2.1\ts\tV\td\tp\tko:K1\tko1,map1\nWP_1.1\ts\t-\t\t\t-\t-\nWP_2.2\ts\tKL\td2\tp\tko:K2\t-\n## end\n")
    rows = {r.gene_id: r for r in annotations.mapper_annotations(spark, str(tmp_path / "m.annotations")).collect()}
    assert set(rows) == {"WP_1", "WP_2"}
    assert rows["WP_1"].category == "S" and rows["WP_1"].description == "Unknown" and rows["WP_2"].category == "KL"
    with pytest.raises(ValueError, match="missing columns"):
        annotations.orthologs(spark, str(tmp_path / "m.annotations"))


def test_compounds(spark, tmp_path):
    (tmp_path / "C00042.txt").write_text("ENTRY       C00042\nNAME        Succinate;\n            Succinic acid\nFORMULA     C4H6O4\nPATHWAY     map00020  Citrate cycle\n            rn1 x\nENZYME      1.1.1.1  2.4.1.-\n            1.3.5.1\n///\nENZYME      9.9.9.9\n")
    info, ec, pathway = annotations.compound_records(spark, str(tmp_path / "C00042.txt"))
    assert tuple(info.first()) == ("C00042", "Succinate", "C4H6O4")
    assert {r.ec for r in ec.collect()} == {"1.1.1.1", "1.3.5.1"}
    assert [tuple(r) for r in pathway.collect()] == [("C00042", "map00020", "Citrate cycle")]


def test_manifest(spark, tmp_path):
    doc = {"S1": {"tet": {"name": "tet(A)", "amr_class": "tetracycline", "locus_tag": "g1", "protein_id": "WP_1.1"}, "str": {"name": "strAB", "amr_class": "amino", "locus_tag": ["g2", "g3"], "protein_id": None}}}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    m = annotations.manifest(spark, str(tmp_path / "m.json"))
    assert {(r.marker, tuple(r.locus_tags), tuple(r.protein_ids)) for r in m.collect()} == {("tet", ("g1",), ("WP_1.1",)), ("str", ("g2", "g3"), ())}
    assert annotations.marker_loci(m).count() == 3 and annotations.marker_loci(m, True).count() == 2
    assert {tuple(r) for r in annotations.class_counts(m).collect()} == {("S1", "tetracycline", 1), ("S1", "amino", 2)}


def test_links_and_names(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("eco:b1\tko:K1\neco:b1\tko:K1\neco:b2\tko:K2\n")
    assert {tuple(r) for r in annotations.link_table(spark, str(tmp_path / "l.tsv"), "gene", "ko").collect()} == {("b1", "K1"), ("b2", "K2")}
    (tmp_path / "n.tsv").write_text("cpd:C00042\tSuccinate; Succinic acid\n")
    assert [tuple(r) for r in annotations.name_table(spark, str(tmp_path / "n.tsv"), "compound").orderBy("position").collect()] == [("C00042", 0, "Succinate"), ("C00042", 1, "Succinic acid")]


def test_best_entry(spark):
    rows = spark.createDataFrame([("p", "A", 562, False, 3.0), ("p", "B", 83333, True, 5.0), ("q", "C", 1, True, 1.0), ("q", "D", 1, False, 5.0), ("r", "E", 1, True, 1.0), ("r", "F", 1, True, 2.0)], "protein_id string, accession string, taxon_id long, reviewed boolean, score double")
    assert {tuple(r) for r in annotations.best_entries(rows, 562).collect()} == {("p", "A"), ("q", "C"), ("r", "F")}


def test_config(tmp_path):
    own = tmp_path / "S1"
    (own / "genome" / "deep").mkdir(parents=True)
    (own / "genome" / "deep" / "x.gff").write_text("")
    (own / "config.json").write_text(json.dumps({"name": "Strain one", "transcriptomics": {"rpmi_samples": ["1"], "sera_samples": ["2"]}, "paths": {"rna_counts": "c.tsv"}}))
    (tmp_path / "central.json").write_text(json.dumps({"strains": {"S1": {"name": "other"}, "S2": {"name": "two"}}}))
    s = config.load("S1", str(tmp_path), str(tmp_path / "central.json"))
    assert s.title == "Strain one" and s.files["gff"].endswith("x.gff") and s.files["counts"] == str(own / "c.tsv") and s.samples["rna"] == {"RPMI": ["1"], "Sera": ["2"]}
    assert config.load("S2", str(tmp_path), str(tmp_path / "central.json")).title == "two"
    assert config.names(str(tmp_path), str(tmp_path / "central.json")) == ["S1", "S2"]
    assert s.interaction_species == [config.SPECIES] and s.swath["sheet"] == "Area - proteins"
    with pytest.raises(ValueError, match="no configuration"):
        config.load("S3", str(tmp_path))


def test_saved(spark, tmp_path):
    spark.range(2).withColumnRenamed("id", "gene_id").write.parquet(str(tmp_path / "t"))
    df, issues = saved.table(spark, str(tmp_path / "t"), ["gene_id", "other"])
    assert df.count() == 2 and issues == [f"{tmp_path / 't'}: column other is missing"]
    assert saved.table(spark, str(tmp_path / "none")) == (None, [])
    spark.range(3).withColumnRenamed("id", "locus").write.parquet(str(tmp_path / "u"))
    df, issues = saved.first_table(spark, [str(tmp_path / n) for n in ("none", "u", "t")], ["gene_id"])
    assert df.count() == 2 and [i.rsplit("/", 1)[-1] for i in issues] == ["none: isn't there", "u: column gene_id is missing"]
    assert saved.first_table(spark, [str(tmp_path / "u")], ["gene_id"])[0] is None
    assert saved.edge_name("x/edges_gene_in_pathway_annotation.csv") == ("gene", "in_pathway", "annotation")


def test_central_file_with_strains_at_its_top(tmp_path):
    """The older layout: one file, strains by name, with other names for paths and proteomics."""
    doc = {"B1": {"name": "one", "string_species_primary": 199310, "paths": {"genome_gff": "g/a.gff", "rna_cpmlog2": "t/x.txt.gz", "prot_file": "p/m.xlsx"}, "proteomics": {"sheet": "Areas", "protein_col": "Prot", "gene_col": None, "rpmi_ids": [1], "sera_ids": [2], "swath": {"enabled": True, "rpmi_template": "{sid} a", "sera_template": "{sid} b"}}}, "B2": {"name": "two"}}
    central = tmp_path / "strains_config.json"
    central.write_text(json.dumps(doc))
    assert config.names(str(tmp_path), str(central)) == ["B1", "B2"]
    s = config.load("B1", str(tmp_path), str(central))
    assert s.files == {"gff": str(tmp_path / "g/a.gff"), "expression": str(tmp_path / "t/x.txt.gz"), "proteins": str(tmp_path / "p/m.xlsx")} and s.interaction_species == [199310, 511145]
    assert s.swath == {"protein": "Prot", "RPMI": "{sid} a", "Sera": "{sid} b", "sheet": "Areas"} and s.samples["protein"] == {"RPMI": ["1"], "Sera": ["2"]}


SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, sheets, dimension=True):
    """A workbook: texts are shared, inline for those that begin with =, numbers plain; None leaves a cell out."""
    shared = []

    def cell(r, c, v):
        at = f"{'ABCDEFGHIJ'[c]}{r}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        if v.startswith("#"):
            return f'<c r="{at}" t="e"><v>{v}</v></c>'
        if v.startswith("="):
            return f'<c r="{at}" t="inlineStr"><is><t>{v[1:]}</t></is></c>'
        if v not in shared:
            shared.append(v)
        return f'<c r="{at}" t="s"><v>{shared.index(v)}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (_, rows) in enumerate(sheets.items(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1) if row)
            size = f'<dimension ref="A1:J{len(rows)}"/>' if dimension else ""
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{SHEET}">{size}<sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SHEET}">' + "".join(f"<si><r><t>{x[:1]}</t></r><r><t>{x[1:]}</t></r><rPh><t>zz</t></rPh></si>" for x in shared) + "</sst>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")


@pytest.mark.parametrize("dimension", [True, False])
def test_workbook(spark, tmp_path, dimension):
    path = str(tmp_path / "a.xlsx")
    data = [["x", "=y", None, True, "#DIV/0!", i * 0.5] if i % 7 else [] for i in range(1, 500)]
    book(path, {"Notes": [["n"], ["hello"]], "Area - proteins": [[], ["Protein", "1 (a)", None, "1 (a)", "e", "f"], *data]}, dimension)
    assert tables.wide(spark, path).collect() == [("hello",)]
    df = workbook.read(spark, path, "Area - proteins", 100)
    assert df.columns == ["Protein", "1 (a)", "C", "1 (a)_D", "e", "f"] and df.rdd.getNumPartitions() == (5 if dimension else 1)
    want = [("x", "y", None, "TRUE", None, repr(i * 0.5)) for i in range(1, 500) if i % 7]
    assert [tuple(r) for r in df.collect()] == want
    stored = workbook._from_store(spark, path, "Area - proteins")
    assert stored.columns == df.columns and [tuple(r) for r in stored.collect()] == want
    with pytest.raises(Exception, match="no sheet Nothing; there are Notes, Area - proteins"):
        workbook.read(spark, path, "Nothing")


def test_areas_of_a_workbook(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    book(path, {"Area - proteins": [["Protein", "7 (a)", "8 (a)"], ["ref|WP_1.1|", 3, 4.5], ["ref|WP_2.1|", "none", None], [None, 1, 2]]})
    got = tables.protein_areas(spark, path, "Protein", {"A": "{sid} (a)", "B": "{sid} (a)"}, {"A": ["7"], "B": ["8", "9"]}, "Area - proteins")
    assert sorted(tuple(r) for r in got.collect()) == [("WP_1.1", "7", "A", 3.0), ("WP_1.1", "8", "B", 4.5), ("WP_2.1", "7", "A", 0.0), ("WP_2.1", "8", "B", 0.0)]
    with pytest.raises(ValueError, match=r"missing columns: Accession, 9 \(a\)"):
        tables.protein_areas(spark, path, "Accession", {"B": "{sid} (a)"}, {"B": ["9"]})


def test_answers_are_kept(spark, tmp_path):
    store = kept.Kept(spark, str(tmp_path / "answers"), buckets=8)
    asked = []

    def ask(keys):
        asked.append(sorted(r[0] for r in keys.collect()))
        return keys.where("key <> 'none'").select("key", F.concat(F.lit('{"id": "'), "key", F.lit('"}')).alias("value"), F.lit(1).alias("position")).unionByName(keys.where("key = 'a'").select("key", F.lit('{"id": "later"}').alias("value"), F.lit(2).alias("position")))

    frame = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    have, n = store.answers(frame("a", "b", "none", "a", None), "k", ask)
    assert n == {"wanted": 3, "asked": 3, "answered": 2} and {r.key: r.value for r in have.collect()} == {"a": '{"id": "later"}', "b": '{"id": "b"}'}
    # nothing is asked for twice, not even what has no answer
    assert store.answers(frame("a", "none"), "k", ask)[1] == {"wanted": 2, "asked": 0, "answered": 1} and asked == [["a", "b", "none"]]
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "answers").rglob("*.parquet")}
    store.put(frame(*[f"k{i}" for i in range(60)]).select(F.col("k").alias("key"), F.lit("1").alias("value")))
    before = files()
    store.put(frame("a").select(F.col("k").alias("key"), F.lit('"new"').alias("value")))
    bucket = store.rows().where("key = 'a'").first().bucket
    changed = set(before.items()) ^ set(files().items())
    assert len(before) == 8 and {p.parent.name for p, _ in changed} == {f"bucket={bucket}"}
    assert store.rows().count() == 63 and store.rows().where("key = 'a'").first().value == '"new"'
    store.invalidate(frame("a", "unknown"), "k")
    assert [r.key for r in store.missing(frame("a", "b"), "k").collect()] == ["a"]
    store.put(frame("b").select(F.col("k").alias("key"), F.lit("{cut off").alias("value")))
    assert sorted(r.key for r in store.missing(frame("a", "b", "k1"), "k").collect()) == ["a", "b"]
    old = kept.Kept(spark, store.path, 8, max_days=0.0)
    assert old.missing(frame("k1", "none"), "k").count() == 2 and kept.Kept(spark, store.path, 8, 1.0).missing(frame("k1", "none"), "k").count() == 0


def test_chain_of_annotations(spark):
    ids = spark.createDataFrame([("WP_1.1", 1), ("WP_2.1", 2), ("WP_1", 3), ("WP_9.1", 4), (" ", 5), (None, 6)], "protein_id string, position long")
    flat = spark.createDataFrame([("A1", "WP_1.2;WP_2.1", 562, True, 3.0, 5), ("A2", "WP_2.1", 9, True, 9.0, 7), ("A3", "WP_2.3", 562, True, 3.0, 9), ("A4", "WP_7.1", 562, True, 1.0, 1)], "accession string, refseq string, taxon_id long, reviewed boolean, score double, n_terms int")
    # two proteins: A1 and A3 tie for WP_2 but for the id; A1 is the best of WP_1
    assert sorted((r.accession, r.protein_id) for r in annotations.annotated(ids, flat, 562).collect()) == [("A1", "WP_1"), ("A3", "WP_2")]
    one = annotations.annotation_stats(ids, flat, 562).first()
    assert (one.requested, one.mapped, one.annotated, one.reviewed, one.unreviewed, one.missing, one.mean_terms) == (3, 2, 2, 2, 0, 0, 7.0) and abs(one.coverage - 2 / 3) < 1e-9


def test_aliases(spark):
    q = spark.createDataFrame([("abc", 1), ("ABC", 2), ("x", 3), (" ", 4), (None, 5), ("two", 6), ("abc", 7)], "query string, position long")
    a = spark.createDataFrame([("abc", 9, "t1", 0.5), ("Abc", 7, "t2", 0.9), ("two", 7, "u2", 0.1), ("two", 7, "u1", 0.1), ("x", 1, "no", 1.0), ("", 7, "e", 1.0)], "alias string, taxon int, target string, score double")
    got = {r.query: (r.position, r.target, r.taxon, r.matched, r.n_targets, r.ambiguous, r.canonical) for r in align.resolved_aliases(q, a, [7, 9]).collect()}
    assert got == {"abc": (1, "t1", 9, "exact", 2, False, True), "ABC": (2, "t2", 7, "folded", 2, False, True), "x": (3, None, None, None, 0, False, False), "two": (6, "u1", 7, "exact", 2, True, True)}
