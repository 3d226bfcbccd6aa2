"""Writing results: appended tables, overwritten tables, upserts, the nested session document."""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.functions import grid
from textmap.operators import som
from textmap.operators import summaries as sm


def append_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).format(fmt).save(path)


def overwrite_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; the others stay.

    Columns that ``new`` lacks keep their old values; columns that only ``new`` has are added, null in rows it does
    not hold. Write the result to a new path, or use ``sources.versions`` to rewrite only what changes.
    """
    present = "_new"
    fresh = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(True).alias(present))
    joined = old.join(fresh, list(keys), "full_outer")
    values = [
        F.when(F.col(present), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c)
        for c in old.columns
        if c not in keys
    ]
    added = [F.col(f"_n_{c}").alias(c) for c in new.columns if c not in old.columns]
    return joined.select(*keys, *values, *added)


def posts_with_nodes(posts: DataFrame, assigned: DataFrame) -> DataFrame:
    """Each post with the node of its document; null where it was not mapped."""
    return posts.join(assigned.select("doc_id", "node"), "doc_id", "left")


def posts_with_nodes_by_title(posts: DataFrame, titled: DataFrame) -> DataFrame:
    """For sources without a shared id: (title, node) rows go to the first post of that title.

    Of several documents with one title the last one counts.
    """
    last = titled.groupBy("title").agg(F.max_by("node", "doc_id").alias("node"))
    first = posts.groupBy("title").agg(F.min("doc_id").alias("doc_id"))
    return posts.join(first.join(last, "title").select("doc_id", "node"), "doc_id", "left")


@dataclass(frozen=True)
class SessionTables:
    """One run as flat tables: header, nodes, topics, and article ids in pages per node."""

    header: DataFrame
    nodes: DataFrame
    topics: DataFrame
    articles: DataFrame


def session_tables(
    run_id: str, timestamp: datetime, codebook: DataFrame, assigned: DataFrame, components: DataFrame,
    terms: DataFrame, kshape: tuple[int, int], n_clusters: int, n_topics: int,
    max_features: int = 10, max_topics: int = 5, page_size: int = sm.PAGE_SIZE,
) -> SessionTables:
    spark = codebook.sparkSession
    run = F.lit(run_id).alias("run_id")
    header = spark.createDataFrame(
        [(run_id, timestamp, n_clusters, (kshape[0], kshape[1]), kshape[0] * kshape[1], n_topics)],
        "run_id string, timestamp timestamp, n_clusters int, k_shape struct<x_shape: int, y_shape: int>, "
        "n_nodes int, n_topics int",
    )
    topics = sm.nested_topics(sm.node_topics(codebook, components, terms, max_topics, max_features))
    nodes = (
        grid.nodes(spark, kshape)
        .join(som.hits(assigned, kshape), "node")
        .join(topics, "node", "left")
        .select(
            run,
            F.col("node").alias("id"),
            F.struct(F.col("x").alias("x_shape"), F.col("y").alias("y_shape")).alias("coordinates"),
            F.col("hits").alias("article_hits"),
            "topics",
        )
    )
    token = F.struct("rank", "name", "weight")
    per_topic = sm.top_terms(components, terms, max_features).groupBy("topic_id").agg(
        F.array_sort(F.collect_list(token)).alias("tokens")
    )
    articles = sm.article_pages(assigned, page_size)
    return SessionTables(
        header, nodes, per_topic.select(run, F.col("topic_id").alias("id"), "tokens"),
        articles.select(run, "node", "page", "articles"),
    )


def write_session(session: SessionTables, path: str) -> None:
    """Append one run to the session tables, partitioned by run."""
    for name in ("header", "nodes", "topics", "articles"):
        append_table(getattr(session, name), f"{path}/{name}", partition_by=["run_id"])


def fold_session(session: SessionTables) -> DataFrame:
    """One nested document per run: header fields, ``nodes`` and ``topics`` arrays.

    Both arrays are as large as the map and its topics; article ids stay in their paged table.
    """
    nodes = session.nodes.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "coordinates", "article_hits", "topics"))).alias("nodes")
    )
    topics = session.topics.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("id", "tokens"))).alias("topics"))
    return session.header.join(nodes, "run_id").join(topics, "run_id")


def session_node(documents: DataFrame, node: int) -> DataFrame:
    """The element of ``nodes`` with the given id, from nested session documents."""
    found = F.filter("nodes", lambda n: n["id"] == node)
    return documents.where(F.size(found) > 0).select("run_id", F.get(found, F.lit(0)).alias("node"))


def attribute_rows(spark: SparkSession, run_id: str, attributes: dict[str, dict[str, object]]) -> DataFrame:
    """(run_id, model, key, value) rows of the attributes of each fitted step."""
    rows = [(run_id, model, key, str(value)) for model, pairs in attributes.items() for key, value in pairs.items()]
    return spark.createDataFrame(rows, "run_id string, model string, key string, value string")
