"""Sessions: the settings that the library is meant to run with, and how workers find it."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def visible_to_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the library from where the driver did; clusters get it by --py-files or an installation."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset, which goes with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not root:
        folder = tempfile.mkdtemp(prefix="stratagraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextlib.contextmanager
def stage(spark: SparkSession, name: str, seconds: dict[str, float]) -> Iterator[None]:
    """Jobs inside are a group of that name, and seconds gets how long they took, also if one fails."""
    began = time.perf_counter()
    spark.sparkContext.setJobGroup(name, name)
    try:
        yield
    finally:
        seconds[name] = seconds.get(name, 0.0) + time.perf_counter() - began
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing else uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """df written to the shared folder and read again; later jobs neither repeat the work nor depend on executors' disks."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that nothing refers to any more; it notices them when the driver's memory is collected, which may be long after."""
    spark.sparkContext._jvm.System.gc()


def local_session(cores: str = "*", partitions: int = 8, memory: str = "4g", name: str = "stratagraph") -> SparkSession:
    return visible_to_workers(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
