"""Summaries made again from what a run has saved, without running it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, hyper, quant
from ..sources import saved


def rebuilt(spark: SparkSession, calls: tuple[str, str] | None = None, edges: str | None = None, members: str | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables, issues) from saved tables of which any may be missing.

    calls is (path, column of the calls of direction): regulation, with n for each call. edges: relations, with n for each. members(strain, type, name, node): families and hypergraph.
    """
    out: dict[str, DataFrame] = {}
    issues: list[str] = []

    def read(path: str, columns: list[str]) -> DataFrame | None:
        df, found = saved.table(spark, path, columns)
        issues.extend(found if df is not None else [f"{path}: isn't there"])
        return df if df is not None and not found else None

    if calls and (df := read(calls[0], [calls[1]])) is not None:
        out["regulation"] = quant.regulation_counts(df, calls[1])
    if edges and (df := read(edges, graph.EDGE[:6])) is not None:
        out["relations"] = graph.edge_counts(df)
    if members and (df := read(members, ["strain", "type", "name", "node"])) is not None:
        key = ["strain", "type", "name"]
        out["families"] = hyper.type_summary(hyper.hyperedges(df))
        out["hypergraph"] = hyper.summary(hyper.incidence(df, key, "node").withColumn("edge", F.concat_ws("\t", *key)), ["edge"], "node")
    return out, issues
