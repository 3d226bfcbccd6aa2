"""Reading corpora and the row operators applied on load."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.functions import text as tx
from textmap.session import spread

FORMATS = ("parquet", "csv", "json", "orc", "jdbc")


def read_corpus(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
    schema: str | None = None,
    size_limit: int | None = None,
    order_by: str = "doc_id",
    **options: str,
) -> DataFrame:
    """Rows of a stored corpus; columns are pruned and the limit is taken in ``order_by`` order.

    A corpus of few files is spread over the cores, since reading text is cheaper than analysing it.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown corpus format: {fmt}")
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path) if path is not None else reader.load()
    if columns is not None:
        df = project(df, columns)
    return spread(df) if size_limit is None else first_rows(df, size_limit, order_by)


def documents_as_articles(documents: DataFrame) -> DataFrame:
    """(doc_id, title, body) of a plain document table: the title is the first line."""
    return documents.select("doc_id", tx.title_of(F.col("text")).alias("title"), F.col("text").alias("body"))


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns is not None else None)


def drop_duplicates(df: DataFrame, key: str = "doc_id", columns: Sequence[str] = ("title", "body")) -> DataFrame:
    """Rows whose ``columns`` repeat an earlier row are dropped; the smallest key stays.

    Only digests and keys are grouped, so a large group of copies is reduced before the shuffle
    and the texts move at most once, spread by the unique key.
    """
    digests = [F.sha2(F.col(c).cast("string"), 256).alias(f"digest_{i}") for i, c in enumerate(columns)]
    keep = (
        df.select(key, *digests)
        .groupBy(*[f"digest_{i}" for i in range(len(columns))])
        .agg(F.min(key).alias(key))
        .select(key)
    )
    return df.join(keep, key, "left_semi")


def first_rows(df: DataFrame, n: int, order_by: str | Column = "doc_id") -> DataFrame:
    return df.orderBy(order_by).limit(n)


def rows_with(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def rows_in(df: DataFrame, column: str, ids: DataFrame | Iterable[int]) -> DataFrame:
    """Rows whose ``column`` is in a list of ids, or in the one column of a table of ids."""
    if isinstance(ids, DataFrame):
        wanted = ids.toDF(column).distinct()
    else:
        kind = df.schema[column].dataType.simpleString()
        wanted = df.sparkSession.createDataFrame([(i,) for i in ids], f"{column} {kind}")
    return df.join(wanted, column, "left_semi")


def fill_numbers(df: DataFrame, value: float = 0) -> DataFrame:
    return df.na.fill(value)
