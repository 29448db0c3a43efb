"""Sessions for local use, and workers that can import the package."""

from __future__ import annotations

import functools
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HOME = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", os.environ.get("PAGEWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def session() -> SparkSession:
    """The session that spark-submit has configured, or a local one where the program runs by itself."""
    return SparkSession.builder.getOrCreate() if "PYSPARK_GATEWAY_PORT" in os.environ else local_session()


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="pagewright-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir, or one of our own where that is unset and all run on one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all machines of {master} see")
    return _own_dir()


def reach(spark: SparkSession) -> None:
    """Let Python workers import the package from where the driver has it (on a cluster, ship it with --py-files)."""
    env = spark.sparkContext.environment
    if HOME not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [HOME, env.get("PYTHONPATH", "")]))


def reaching(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reach(spark)
        return f(spark, sf_dir)

    return run
