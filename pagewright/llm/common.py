"""What the operators share: the folder all machines see, stored intermediate tables, Arrow text access, hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import shared_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pagewright/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, light: bool = False, packed: bool = False) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, so a lost executor costs no recomputation.

    light: the rows are short and few beside the corpus, and so are made by few tasks in as many files (a sixteenth of the
    shards).
    packed: the rows are hashes or compressed already, and aren't compressed again."""
    path = scratch_path(df.sparkSession, name)
    df = df.coalesce(max(4, shards(df.sparkSession) // 16)) if light else df
    df.write.parquet(path, compression="none" if packed else None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch that goes to Python, at most (a longer row is alone). Texts may be of any length.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def release() -> None:
    """What this process has freed goes back to the system: Arrow's pool and the C library else keep it for the next task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def releasing(f: Callable) -> Callable:
    """f, a function of batches, that releases its memory when it ends: workers stay for later tasks and stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def in_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow with bounded batches; the session keeps the bounds, which count when the job runs."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(BATCH_ROWS, int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(releasing(f), schema)


def columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def row(df: DataFrame) -> Column:
    """All columns of df as one: so they go along under names of their own, whatever columns are made beside them."""
    return F.struct(*columns(df))


def ddl(kind: T.DataType) -> str:
    """A type as a schema string has it, names quoted."""
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join("`{}`: {}".format(f.name.replace("`", "``"), ddl(f.dataType)) for f in kind) + ">"
    if isinstance(kind, T.ArrayType):
        return f"array<{ddl(kind.elementType)}>"
    return f"map<{ddl(kind.keyType)}, {ddl(kind.valueType)}>" if isinstance(kind, T.MapType) else kind.simpleString()


def shards(spark: SparkSession) -> int:
    """How many ways keyed state is dealt out: the cluster's own setting for its data size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A key with more than this share of all rows is hot. So there are at most 2,000 hot keys, whatever the table's size.
HOT_SHARE = 1 / 2000


def joined(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows inner joined to table on keys that aren't null. table has one row a key, with the number n of its rows (or more), of total.

    What belongs to hot keys is broadcast, so no task gets all rows of one; the rest meets in a shuffle. Both are read twice:
    they should be stored tables."""
    hot = F.broadcast(table.filter(F.col(n) > total * HOT_SHARE).drop(n))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.filter(F.col(n) <= total * HOT_SHARE).drop(n), keys)
    return rows.join(hot, keys).unionByName(rest)


def named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a dense number (0, 1, ...) for every different value of keys (not null), under a name. rows should be stored."""
    spark, low = rows.sparkSession, (1 << 33) - 1
    # the number of the task that has the key, and that of the key in it: fixed once they are written
    found = stored(rows.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__at", F.monotonically_increasing_id()), "names")
    tasks = found.groupBy(F.shiftright("__at", 33).alias("task")).agg(F.count("*"), F.sum("__n")).orderBy("task").collect()
    before, start = [], 0
    for task, count, _ in tasks:
        before.append((task, start))
        start += count
    starts = F.broadcast(spark.createDataFrame(before, "__task long, __start long"))
    numbered = found.join(starts, F.shiftright("__at", 33) == F.col("__task")).select(*keys, "__n", (F.col("__start") + F.col("__at").bitwiseAND(low)).alias(name))
    return joined(rows, numbered, keys, "__n", sum(x[2] for x in tasks))


def finite(vector: str, dim: int | None = None) -> Column:
    """Whether a vector has components (dim of them, where given) and none of them is null or non-finite."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    size = F.size(vector) == dim if dim is not None else F.size(vector) > 0
    return F.coalesce(F.col(vector).isNotNull() & size & F.coalesce(plain, F.lit(False)), F.lit(False))


def summed(rows: DataFrame, kind: str) -> dict[int, list]:
    """The sums of arrays (column cells) by number (column name), component by component; the driver gets one array a name.

    Rows are a task's partial sums, as few as it has names; components are added by Spark's aggregation, in a type."""
    cells = rows.select("name", F.posexplode("cells").alias("at", "value")).groupBy("name", "at").agg(F.sum(F.col("value").cast(kind)).alias("value"))
    found: dict[int, dict] = {}
    for name, at, value in cells.collect():
        found.setdefault(name, {})[at] = value
    return {name: [x for _, x in sorted(values.items())] for name, values in found.items()}


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 4 << 20, most_rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column holds about most_bytes at most (a longer value is alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(batch.column(column)).to_pylist()], np.int64)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None for their end."""
    yield from batches
    yield None


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise on uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
