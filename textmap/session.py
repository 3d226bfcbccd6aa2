"""Session helpers: the shared staging folder, size limits, task counts and code shipping."""

import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Largest matrix sent to every executor in one broadcast variable.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

_local_roots: dict[str, str] = {}


def ship_code() -> None:
    """Send this package's functions to Python workers by value, so that workers need no install."""
    cloudpickle.register_pickle_by_value(sys.modules["textmap"])


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a fresh local one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="textmap-")
    return _local_roots[app]


def staging_path(spark: SparkSession, name: str) -> str:
    return os.path.join(staging_root(spark), "textmap", f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Store ``df`` as a parquet table in the staging folder and read it back.

    The stored table cuts the lineage and survives the loss of executors.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._staged = path
    return stored


def release(stored: DataFrame) -> None:
    """Delete the folder of a table that ``stage`` stored and that nothing reads any more."""
    path = getattr(stored, "_staged", None)
    if path is not None:
        context = stored.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside drop their shuffle files when they end; what they leave must be stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def short_batches(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """Queries run inside send rows to Python in batches of some bytes: 10,000 texts have no bound of their own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(n_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stage_observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """As ``stage``, with aggregates of ``df`` that are taken while it is written: no scan of their own."""
    seen = Observation(name)
    stored = stage(df.observe(seen, *[measure.alias(key) for key, measure in measures.items()]), name)
    return stored, seen.get


def fits_broadcast(n_bytes: int) -> bool:
    return n_bytes <= BROADCAST_LIMIT_BYTES


def rows_in_broadcast(row_entries: int) -> int:
    """How many rows of that many doubles one broadcast variable may hold."""
    return BROADCAST_LIMIT_BYTES // (8 * max(1, row_entries))


def few_tasks(df: DataFrame) -> DataFrame:
    """Bound the task count by the cores, so that per-task partial matrices stay few.

    Narrow: no shuffle. A table with fewer partitions is left as it is.
    """
    spark = df.sparkSession
    wanted = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.coalesce(wanted)


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a small file scan spread over all cores, for work that costs far more than reading.

    Only a scan with fewer parts than cores is moved, so the amount is bounded by the part size. Use
    it on scans alone: asking a plan with shuffles for its parts would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
