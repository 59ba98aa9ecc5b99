"""A store of answers by key: what was asked for once isn't asked for again.

A store is a Parquet table in buckets of the key's hash. Updating it rewrites the buckets of the keys that changed and no others; a key that was asked for and has no answer is kept as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

SCHEMA = "key string, value string, asked timestamp, bucket int"


class Kept:
    """path may be anywhere Spark writes; buckets is fixed when a store is begun. max_days is how long an answer holds, None for ever."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, max_days: float | None = None):
        self.spark, self.path, self.buckets, self.max_days = spark, path.rstrip("/"), buckets, max_days

    def rows(self) -> DataFrame:
        """key, value (JSON, null if there was no answer), asked, bucket."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def _bucket(self, key: str = "key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def valid(self) -> DataFrame:
        """Rows that still hold: not too old, and no text that isn't JSON."""
        rows = self.rows().where(F.col("value").isNull() | F.try_parse_json("value").isNotNull())
        return rows if self.max_days is None else rows.where(F.col("asked") > F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(self.max_days * 86400.0)))

    def missing(self, keys: DataFrame, key: str) -> DataFrame:
        """(key): those of keys that have to be asked for, each once."""
        wanted = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
        return wanted.join(self.valid().select("key"), "key", "left_anti")

    def put(self, answers: DataFrame) -> None:
        """answers(key, value[, position]): of a key's answers that with the last position counts, or the last by text where there is none."""
        order = F.struct("position", "value") if "position" in answers.columns else F.struct("value")
        new = answers.where("key is not null").groupBy("key").agg(F.max_by("value", order).alias("value"))
        new = settle(new.select("key", "value", F.current_timestamp().alias("asked"), self._bucket().alias("bucket")), "answers")
        self._rewrite(self.rows().join(new.select("key"), "key", "left_anti").select("key", "value", "asked", "bucket").unionByName(new), new.select("bucket").distinct())

    def _rewrite(self, rows: DataFrame, buckets: DataFrame) -> None:
        """Overwrites these buckets; the new rows are written out first, as they are made of the old ones."""
        touched = sorted(r[0] for r in buckets.collect())  # buckets, not keys
        if touched:
            some = settle(rows.where(F.col("bucket").isin(touched)), "buckets")
            some.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def invalidate(self, keys: DataFrame, key: str) -> None:
        """Forgets the answers of keys. A forgotten answer is kept as a text that isn't JSON, so that a bucket that loses its last one is rewritten too."""
        gone = keys.select(F.col(key).cast("string").alias("key")).distinct()
        hit = settle(self.rows().join(gone, "key", "left_semi"), "invalid")
        new = hit.select("key", F.lit("").alias("value"), F.current_timestamp().alias("asked"), "bucket")
        self._rewrite(self.rows().join(hit.select("key"), "key", "left_anti").select("key", "value", "asked", "bucket").unionByName(new), hit.select("bucket").distinct())

    def answers(self, keys: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, int]]:
        """(key, value) of the keys that have an answer, and how many were wanted, asked for and answered.

        ask gets (key) of those that are missing and returns (key, value[, position]): a join with a snapshot, or a function that asks a service in batches. It isn't called if none is missing.
        """
        wanted = settle(keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct(), "wanted")
        todo = settle(self.missing(wanted, "key"), "asked")
        asked = todo.count()
        if asked:
            found = ask(todo).join(todo, "key", "left_semi")
            found = settle(found, "found")
            none = todo.join(found.select("key"), "key", "left_anti").select("key", F.lit(None).cast("string").alias("value"))
            self.put(found.unionByName(none.withColumn("position", F.lit(None).cast(found.schema["position"].dataType)) if "position" in found.columns else none))
        have = self.valid().where("value is not null").join(wanted, "key", "left_semi").select("key", "value")
        return have, {"wanted": wanted.count(), "asked": asked, "answered": have.count()}
