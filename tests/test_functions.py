import json

import pytest
from pyspark.sql import functions as F

from stratagraph.functions import entries, ids, numeric


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [("WP_7315.4", "WP_7315"), ("XP_7315.4", "XP_7315.4"), ("WP_7315", "WP_7315"), ("WP_.4", "WP_.4"), ("", ""), (None, None), (" WP_9.10 ", "WP_9")])
def test_canonical_accession(spark, text, want):
    assert one(spark, text, ids.canonical_accession) == want


@pytest.mark.parametrize(("text", "want"), [("REV__x;WP_1", False), ("sp|x;CON__y;WP_1", False), ("sp|x; WP_1;REV__z", True), ("", False), (None, False), ("a;b", False)])
def test_first_verdict(spark, text, want):
    assert one(spark, text, ids.is_bacterial) is want


def test_metabolite_ids(spark):
    rows = spark.createDataFrame([("CHEBI:12", "x"), ("CHEBI:1x", "Citrate"), (None, "  "), (None, None)], "d string, n string")
    assert [r[0] for r in rows.select(ids.metabolite_id(F.col("d"), F.col("n"))).collect()] == ["CHEBI:12", "M-Citrate", None, None]


def test_lists_and_letters(spark):
    assert one(spark, "ko1, map2,-,nan,,ko1", ids.listed) == ["ko1", "map2"]
    assert one(spark, "KLx-K", ids.category_letters) == ["K", "L"]
    assert one(spark, "V", ids.category_label) == "V (Defense mechanisms)"
    assert len(ids.CATEGORIES) == 26


def test_matching_or_all(spark):
    df = spark.createDataFrame([("E. coli K12",), ("Homo",), (None,)], "h string")
    assert ids.matching_or_all(df, "h", r"e\. coli").count() == 1
    assert ids.matching_or_all(df, "h", "nothing").count() == 3


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "x string")
    assert [r[0] for r in df.select(numeric.lenient(F.col("x"))).collect()] == [1.5, None, None, None]
    assert [r[0] for r in df.select(numeric.lenient_zero(F.col("x"))).collect()] == [1.5, 0, 0, 0]


def test_calls(spark):
    df = spark.createDataFrame([(1.0,), (1.01,), (-1.0,), (-1.01,), (None,)], "x double")
    assert [r[0] for r in df.select(numeric.regulation(F.col("x"), 1.0)).collect()] == ["Stable", "Up", "Stable", "Down", "Stable"]
    two = spark.createDataFrame([(1.0, 2.0), (1.0, -1.0), (0.0, 1.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in two.select(numeric.agreement(F.col("a"), F.col("b"))).collect()] == ["concordant", "discordant", "neutral", "unavailable"]
    assert [r[0] for r in two.select(numeric.log2_ratio(F.col("b"), F.col("a"))).collect()] == [1.0, None, None, None]


def test_entries(spark):
    ref = lambda db, i, term=None: {"database": db, "id": i, "properties": [{"key": "GoTerm", "value": term}] if term else []}
    doc = {
        "primaryAccession": "Q7ZZ31", "uniProtkbId": "LMP_TESTU", "entryType": "UniProtKB reviewed (Swiss-Prot)", "annotationScore": 3, "organism": {"scientificName": "Testudo", "taxonId": 8469},
        "proteinDescription": {"recommendedName": {"fullName": {"value": "Lampase"}, "ecNumbers": [{"value": "1.9.7.2"}]}}, "genes": [{"geneName": {"value": "lmpA"}}],
        "comments": [{"commentType": "FUNCTION", "texts": [{"value": "Does it"}]}, {"commentType": "CATALYTIC ACTIVITY", "reaction": {"ecNumber": "1.9.7.2"}}],
        "keywords": [{"name": "a"}, {"name": "b"}], "uniProtKBCrossReferences": [ref("GO", "GO:1", "P:x"), ref("GO", "GO:2", "F:y"), ref("GO", "GO:3", "C:z"), ref("KEGG", "tst:k17"), ref("GO", "GO:4")], "sequence": {"length": 64},
    }
    flat = entries.entries(spark.createDataFrame([(json.dumps(doc),), ("broken",), (None,)], "json string"))
    r = flat.first()
    assert flat.count() == 1
    assert (r.ec_numbers, r.go_bp, r.go_mf, r.go_cc, r.kegg, r.length, r.reviewed) == ("1.9.7.2", ["GO:1"], ["GO:2"], ["GO:3"], "tst:k17", 64, True)
    c = entries.coverage(flat).first()
    assert (c.avg_go, c.avg_keywords) == (3.0, 2.0)
    assert entries.go_terms(flat).count() == 3
