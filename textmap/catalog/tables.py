"""Input tables of the catalog, read whole."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.session import spread
from textmap.sources import corpus as co


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return co.read_corpus(spark, f"{folder}/documents.parquet")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return co.documents_as_articles(documents(spark, folder))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as document vectors."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )
