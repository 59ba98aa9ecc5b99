"""A training corpus out of documents, in five stages that each write Parquet: toxicity, near duplicates, repeated passages, benchmark leaks, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratagraph.llm import bpe, decontam, ngram_join, suffix_dedup, toxicity
from stratagraph.llm.common import id_hash, read, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that are predicted toxic, by a model of the labels whose crc32(doc_id) mod 5 is not 0.

    Null, empty and wordless texts score as a text of which no window saves a byte. Without labels of both classes all stay. Repeated rows stay or go together; an empty table stays empty.
    """
    labels = read(spark, sf_dir, "labels")
    model = toxicity.fit_table(docs, labels.where(id_hash("doc_id") % 5 != 0))
    return toxicity.keep_clean(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-equal documents the row with the smallest id; rows without an id come last.

    Texts without words stand alone: each id's is kept, and so are all rows that have neither id nor words. Repeated rows are one. Different texts of one id are different documents.
    """
    return ngram_join.representatives(docs)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of each text the bytes that 400-byte strings cover which also start elsewhere in what is left of the corpus, and puts n_chars right.

    Null texts stay null; a text that repeats throughout becomes empty; no row goes.
    """
    return suffix_dedup.strip_text(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold an item of the benchmark, up to a fifth of its words edited.

    Null and empty texts stay. Items without an id or a word match nothing.
    """
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256; null texts are empty."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("suffix_dedup", strip_repeats),
    ("decontamination", drop_leaks),
    ("bpe", tokenize),
]

#: No SQL: training, edit distance and the tokenizer aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
