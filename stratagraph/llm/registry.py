"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codebooks, decontam, hard_negatives, langid, license_scan, media, ngram_join, pii, suffix_dedup, token_tree, toxicity, warc
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read(spark, sf_dir, "documents"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tree.recount(read(spark, sf_dir, "documents"))


def op10_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.find_edited(read(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    own = (
        op1_warc_normaliser, op2_language_id, op3_suffix_dedup, op4_bpe_codec, op5_decontamination, op6_toxicity, op7_ngram_join, op8_license_scan, op9_token_counts, op10_media_copies,
        op11_hard_negatives, op12_sanitisation, op13_vector_codes,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_normaliser": warc.ORACLE_SQL,
        "op7_ngram_join": ngram_join.ORACLE_SQL,
        "op8_license_scan": license_scan.oracle_sql(),
        "op11_hard_negatives": hard_negatives.ORACLE_SQL,
        "op13_vector_codes": codebooks.ORACLE_SQL,
    }
