"""Incremental runs as a stream (an extension): new files are picked up once, results upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions import pages as P
from pagewright.operators import manifest
from pagewright.sources import files


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.pdf", per_batch: int = 100) -> DataFrame:
    """(path, stem, content) of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)
    return found.select("path", P.stem(F.col("path")).alias("stem"), "content")


def table_stream(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).parquet(folder)


#: Batches from one snapshot to the next.
SNAPSHOT_EVERY = 16


def upserting(stream: DataFrame, table: str, keys: list[str], order: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x, every: int = SNAPSHOT_EVERY) -> StreamingQuery:
    """Keep the latest row of each key below ``table``. A batch writes its own latest rows (d=N), each ``every``-th the whole
    table, too (s=N), so a batch costs what it brings, and a reader puts few parts together. A batch that runs again writes
    the same parts again, so results are the same after a failure. What is older than the last snapshot can go."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        manifest.latest(transform(batch), keys, order).drop("position").write.mode("overwrite").parquet(f"{table}/d={number}")
        if number % every == every - 1:
            _merged(spark, table, number, keys, order, every, number - every).write.mode("overwrite").parquet(f"{table}/s={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _merged(spark: SparkSession, table: str, number: int, keys: list[str], order: str, every: int, snapshot: int) -> DataFrame:
    parts = [f"{table}/s={snapshot}"] * (snapshot >= 0) + [f"{table}/d={i}" for i in range(max(0, snapshot + 1), number + 1)]
    if len(parts) == 1:
        return spark.read.parquet(parts[0])
    rows = spark.read.parquet(parts[0])
    for part in parts[1:]:
        rows = rows.unionByName(spark.read.parquet(part))
    return manifest.latest(rows, keys, order).drop("position")


def latest(spark: SparkSession, table: str, number: int | None, keys: list[str], order: str, every: int = SNAPSHOT_EVERY) -> DataFrame:
    """The table after a batch: the last snapshot, and what came after it. number: of the batch; None: the last that is written whole."""
    if number is not None:
        return _merged(spark, table, number, keys, order, every, (number + 1) // every * every - 1)
    whole = [x for x in files.folders(table) if files.exists(files.joined(table, x, "_SUCCESS"))]
    batches, snapshots = ([int(x[2:]) for x in whole if x.startswith(kind)] for kind in ("d=", "s="))
    if not batches:
        raise FileNotFoundError(f"no batch is written below {table}")
    return _merged(spark, table, max(batches), keys, order, every, max((n for n in snapshots if n <= max(batches)), default=-1))
