"""What the operators of this package share: the folder that all machines see, tables written there, prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one is made once per session, if the session runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='kelpforge-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders made within each open scratch block, innermost last.
_made: list[list[str]] = []


def fresh_dir(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that operators write within the block are removed at its end, also where it fails. Results are read from them, so they must have been written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        paths = spark._jvm.org.apache.hadoop.fs.Path
        for path in _made.pop():
            p = paths(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, is computed once, and survives lost executors."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, after which the Python process gives memory back: it waits for its next task beside others, within the executor's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def open_store(path: str):
    """(filesystem, path in it) for a folder of any kind that pyarrow knows; used inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def with_prefix_sums(rows: DataFrame, order: Sequence[Column], size: str) -> DataFrame:
    """Adds _before (sum of size over all rows that come earlier in the order), _index (how many they are) and _total.

    The rows are dealt out by ranges of the order; each range is totalled, the few totals are summed
    up, and each range adds its own running sums to where it starts. Rows that tie in the order
    are told apart by their place in the input, which can only exchange rows that are alike.
    """
    tied = written(rows.withColumn("_tie", F.monotonically_increasing_id()), "rows")  # ranges are found by sampling, which reads the rows once more
    keys = [*order, F.col("_tie").asc()]
    placed = written(tied.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "prefix")
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_start"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    own = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_before", F.coalesce(F.sum(size).over(own), F.lit(0))).withColumn("_index", F.coalesce(F.count(F.lit(1)).over(own), F.lit(0)))
    # A row per range: as many as there are shuffle partitions, however large the input is.
    out = summed.join(F.broadcast(starts), "_part")
    return out.withColumn("_before", F.col("_before") + F.col("_start")).withColumn("_index", F.col("_index") + F.col("_first")).drop("_part", "_start", "_first", "_tie")
