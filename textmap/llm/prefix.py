"""Running sums over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmap.session import stage


def running_sums(
    df: DataFrame, order: list[Column], values: dict[str, str], name: str, group: str | None = None
) -> DataFrame:
    """``df`` with, for each ``column: result`` of ``values``, the sum of the column over all rows before this one.

    Rows are ordered by ``order`` within each ``group`` (null is a group of its own), or over the whole
    table. ``order`` must tell all rows apart that differ. The rows are range partitioned and stored; one
    short table holds the totals of each part, its sums are the offsets of the parts, and each part is
    then summed where it lies. A group may span any number of parts, so a hot group is split.

    Empty tables give empty tables. Null values count as zero.
    """
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["part__"] + ([group] if group else [])
    ranged = df.repartitionByRange(n_parts, *([F.col(group)] if group else []), *order)
    rows = stage(ranged.withColumn("part__", F.spark_partition_id()), name)
    totals = rows.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{r}__total") for c, r in values.items()])
    over_parts = (W.partitionBy(group) if group else W.partitionBy()).orderBy("part__")
    before = over_parts.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"{k}__of") for k in keys],
        *[F.coalesce(F.sum(f"{r}__total").over(before), F.lit(0)).alias(f"{r}__offset") for r in values.values()],
    )
    offsets = stage(offsets, f"{name}-offsets")
    same = [F.col(k).eqNullSafe(F.col(f"{k}__of")) for k in keys]
    joined = rows.join(offsets, same, "left")
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return joined.select(
        *df.columns,
        *[
            (F.col(f"{r}__offset") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(r)
            for c, r in values.items()
        ],
    )
