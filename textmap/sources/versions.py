"""Tables in versions: an update rewrites only the buckets it touches, and readers follow a small pointer.

A version is a list of folders, one for each bucket of keys, kept as a few rows under ``versions/v=N``. An update writes
new folders for the buckets it touches and then the next list; the other buckets keep their folders and files. A list
appears whole or not at all, so readers never see half an update, and one that was interrupted leaves only folders
that no list names. Lists before the last two, and folders that only they name, are removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.sources.sinks import upsert

KEPT_VERSIONS = 2
_LIST = "bucket int, folder string, columns string"


def _folder(spark: SparkSession, path: str):
    """The store behind ``path`` and the path in it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the stored versions, oldest first."""
    store, at = _folder(spark, f"{path}/versions")
    if not store.exists(at):
        return []
    names = [entry.getPath().getName() for entry in store.listStatus(at)]
    found = [int(name.removeprefix("v=")) for name in names if name.startswith("v=")]
    return sorted(n for n in found if store.exists(_folder(spark, f"{path}/versions/v={n}/_SUCCESS")[1]))


def _listed(spark: SparkSession, path: str, version: int) -> list:
    return spark.read.schema(_LIST).parquet(f"{path}/versions/v={version}").collect()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or a given one of those kept."""
    found = versions(spark, path)
    if not found:
        raise ValueError(f"no table is stored at {path}")
    listed = _listed(spark, path, found[-1] if version is None else version)
    folders = sorted({r["folder"] for r in listed if r["folder"]})
    columns = listed[0]["columns"]
    if not folders:
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(*folders)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, path: str, number: int, folders: dict[int, str | None], columns: str) -> None:
    rows = [(bucket, folder, columns) for bucket, folder in sorted(folders.items())]
    store, at = _folder(spark, f"{path}/versions/v={number}")
    if store.exists(at) and not store.exists(_folder(spark, f"{path}/versions/v={number}/_SUCCESS")[1]):
        store.delete(at, True)  # what an interrupted commit left
    spark.createDataFrame(rows, _LIST).coalesce(1).write.parquet(f"{path}/versions/v={number}")
    _clear(spark, path)


def _clear(spark: SparkSession, path: str) -> None:
    found = versions(spark, path)
    kept = {r["folder"] for n in found[-KEPT_VERSIONS:] for r in _listed(spark, path, n) if r["folder"]}
    for number in found[:-KEPT_VERSIONS]:
        dropped = {r["folder"] for r in _listed(spark, path, number) if r["folder"]} - kept
        for folder in [*sorted(dropped), f"{path}/versions/v={number}"]:
            store, at = _folder(spark, folder)
            store.delete(at, True)


def _write(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> dict[int, str]:
    """The folder of each bucket that ``df`` has rows in."""
    target = f"{path}/data/{uuid.uuid4().hex}"
    dealt = df.withColumn("_bucket", _bucket(keys, buckets))
    dealt.repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(target)
    spark = df.sparkSession
    store, at = _folder(spark, target)
    names = [entry.getPath().getName() for entry in store.listStatus(at)]
    return {int(n.removeprefix("_bucket=")): f"{target}/{n}" for n in names if n.startswith("_bucket=")}


def overwrite(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 1) -> int:
    """Store ``df`` as the next version; the number of the version."""
    spark = df.sparkSession
    number = (versions(spark, path) or [0])[-1] + 1
    folders: dict[int, str | None] = dict.fromkeys(range(buckets))
    folders |= _write(df, path, keys, buckets)
    _commit(spark, path, number, folders, _columns(df))
    return number


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def update(new: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Rows of ``new`` replace stored rows with the same key or are added; the number of the new version.

    Only buckets that ``new`` has keys in are read and written. Columns that only ``new`` has are added; they are
    null in the other rows. A repeated update gives the same rows. ``new`` must hold each key once.
    """
    spark = new.sparkSession
    number = versions(spark, path)[-1]
    listed = _listed(spark, path, number)
    folders = {r["bucket"]: r["folder"] for r in listed}
    columns = listed[0]["columns"]
    touched = [r[0] for r in new.select(_bucket(keys, len(folders)).alias("b")).distinct().collect()]
    held = [folders[b] for b in touched if folders[b]]
    old = spark.read.schema(columns).parquet(*held) if held else spark.createDataFrame([], columns)
    after = upsert(old, new, keys)
    fresh = _write(after, path, keys, len(folders)) if touched else {}
    _commit(spark, path, number + 1, folders | fresh, _columns(after))
    return number + 1
