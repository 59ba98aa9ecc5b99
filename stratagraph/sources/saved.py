"""Tables that a pipeline has saved, with checks of their columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, path: str, columns: list[str] = []) -> tuple[DataFrame | None, list[str]]:
    """The table, or None if it isn't there, and what is wrong with its columns."""
    try:
        df = spark.read.csv(path, header=True) if path.endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None, []
        raise
    issues = [f"{path}: column {c} is missing" for c in columns if c not in df.columns]
    lower = [c.lower() for c in df.columns]
    issues += [f"{path}: column {c} is there more than once" for c in dict.fromkeys(c for c in lower if lower.count(c) > 1)]
    return df, issues


def first_table(spark: SparkSession, paths: list[str], columns: list[str]) -> tuple[DataFrame | None, list[str]]:
    """The first of several tables that is there and has the columns, and what is wrong with those before it; a later one stands in for an earlier one that is missing."""
    issues: list[str] = []
    for path in paths:
        df, found = table(spark, path, columns)
        if df is not None and not found:
            return df, issues
        issues += found or [f"{path}: isn't there"]
    return None, issues


def edge_name(file_name: str) -> tuple[str, str, str]:
    """(src_type, relation, dst_type) of edges_<src>_<relation>_<dst>.csv; the relation may have _ in it."""
    parts = file_name.rsplit("/", 1)[-1].removesuffix(".csv").split("_")[1:]
    if len(parts) < 3:
        raise ValueError(f"{file_name} doesn't name an edge type")
    return parts[0], "_".join(parts[1:-1]), parts[-1]
