"""A corpus pipeline: language, quality, near duplicates, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; the first four return documents
with the columns they came with, the last one their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.llm import catalog, langid, mixing, neardup, pieces, quality
from textmap.llm.folds import fold
from textmap.session import ship_code, stage

ship_code()


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network tells; texts that are null or without a letter go."""
    return langid.with_known_language(docs, catalog.language_net(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model does not score below 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    taught = docs.where(fold() != 0).join(F.broadcast(labels.select("doc_id").distinct()), "doc_id", "left_semi") if _few(labels) else docs
    model = catalog.quality_model(quality.measure(taught), labels)
    return quality.with_good_quality(docs, model)


def _few(labels: DataFrame) -> bool:
    from textmap.session import fits_broadcast

    return fits_broadcast(labels.count() * 16)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.85 of five-word shingles)."""
    return neardup.without_near_duplicates(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, ids) of each document of the mix."""
    import public_tokenizers

    model = public_tokenizers.path(catalog.PIECE_MODEL)
    return pieces.encode(docs, model, then=(pieces.without_text, "doc_id long, n_words long, ids array<int>"))


STAGES = [
    ("language_id", known_language),
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", one_of_each_group),
    ("source_mixing", mixed_sources),
    ("sentencepiece", piece_ids),
]

ORACLE_SQL = None  # trained models and sketches are not SQL; the tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
