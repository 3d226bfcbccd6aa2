"""Streaming queries: each drains the given tables as a file stream and reads its result back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.catalog import maps
from textmap.catalog import sql as q
from textmap.catalog import web as cw
from textmap.catalog.maps import MAP
from textmap.operators import som
from textmap.session import staging_path
from textmap.sources import sinks, versions
from textmap.streaming import streams as st

PAGE_SCHEMA = "page_id long, url string, html string"
CRAWL_SCHEMA = "page_id long, url string, html string, fetched timestamp_ntz"
OTHER, DELAY, DELAY_MINUTES = 1_000_000, "2 hours", 120
VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int"


def st1_store_articles(spark: SparkSession, folder: str) -> DataFrame:
    path, marks = staging_path(spark, "articles"), staging_path(spark, "marks")
    pages = st.read_files(spark, folder, PAGE_SCHEMA, "pages.parquet")
    st.store_rows(st.article_stream(pages), path, marks).awaitTermination()
    return sinks.read_table(spark, path)


def _crawls(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Three crawls of the pages, a page a minute: all pages, all of them again, and other addresses of the same pages."""
    first = cw.pages(spark, folder).select(
        "page_id", F.concat("url", F.lit("#"), "page_id").alias("url"), "html",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(page_id AS int))").alias("fetched"),
    )
    again = first.withColumn("fetched", F.expr("fetched + interval '20' second"))
    other = first.select(
        (F.col("page_id") + OTHER).alias("page_id"), F.concat("url", F.lit("x")).alias("url"), "html",
        F.expr("fetched + interval '30' second").alias("fetched"),
    )
    return [first, again, other]


def st1_store_crawls(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of several crawls as they arrive: pages seen again are dropped, and so are late ones.

    The stream is stopped after the second crawl and started again on its checkpoint for the third.
    """
    source, path, marks = (staging_path(spark, n) for n in ("crawls", "articles", "marks"))
    crawls, files = _crawls(spark, folder), 0
    for wave in (crawls[:2], crawls[2:]):
        for crawl in wave:
            crawl.write.mode("append").parquet(source)
            # every crawl is cut as the first one, so that many files are one crawl and one batch
            files = files or len(spark.read.schema(CRAWL_SCHEMA).parquet(source).inputFiles())
        pages = st.read_files(spark, source, CRAWL_SCHEMA, files_per_trigger=max(1, files))
        st.store_rows(st.article_stream(pages, event_time="fetched", delay=DELAY), path, marks).awaitTermination()
    return sinks.read_table(spark, path)


def st3_running_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits kept by the stream itself: counted in its state, stored as they change, counted on after a restart."""
    source, path, marks = (staging_path(spark, n) for n in ("vectors", "hits", "marks"))
    rows = maps.vectors(spark, folder)
    codebook = maps.trained(rows)
    for label in ("label < 4", "label >= 4 AND label < 7", "label >= 7 OR label IS NULL"):
        rows.where(label).select("doc_id", "vec").coalesce(2).write.mode("append").parquet(source)
        stream = st.read_files(spark, source, "doc_id long, vec array<double>", files_per_trigger=1)
        hits = st.running_hits(st.score_stream(stream, codebook))
        st.store_running(hits, ["node"], path, marks, buckets=4).awaitTermination()
    return versions.read(spark, path).select("node", "hits")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    codebook = maps.trained(maps.vectors(spark, folder))
    stream = st.read_files(spark, folder, VECTOR_SCHEMA, "embeddings.parquet")
    return st.score_stream(stream.selectExpr("vec_id AS doc_id", "embedding AS vec"), codebook)


def st2_refresh_map(spark: SparkSession, folder: str) -> DataFrame:
    path, marks = staging_path(spark, "map"), staging_path(spark, "marks")
    hits = st.running_hits(_scored(spark, folder))
    st.refresh_map(hits, MAP.kshape, path, marks, interval=None).awaitTermination()
    return st.latest_map(spark, path)


def st3_score_documents(spark: SparkSession, folder: str) -> DataFrame:
    path, marks = staging_path(spark, "scored"), staging_path(spark, "marks")
    scored = _scored(spark, folder).select("doc_id", "node")
    st.store_rows(scored, path, marks).awaitTermination()
    return som.hits(sinks.read_table(spark, path), MAP.kshape)


QUERIES = {f.__name__: f for f in (st1_store_articles, st1_store_crawls, st2_refresh_map, st3_score_documents, st3_running_hits)}

ORACLES = {
    "st1_store_articles": cw.ARTICLES_SQL,
    # the watermark is the newest minute of the first two crawls less the delay
    "st1_store_crawls": cw.articles_sql(cw.fields_sql(cw.web.ARTICLE_TAG, f"""(SELECT page_id, url || '#' || page_id AS url, html FROM pages
        UNION ALL SELECT page_id + {OTHER}, url || '#' || page_id || 'x', html FROM pages
        WHERE page_id * 60 + 30 > (SELECT max(page_id) FROM pages) * 60 + 20 - {DELAY_MINUTES} * 60)"""), ("title", "body")),
    "st3_running_hits": q.with_(*maps._final()) + "SELECT node, count(*) AS hits FROM aa GROUP BY node",
    "st2_refresh_map": q.with_(*maps._final(), f"hits AS ({maps._HITS})")
    + "SELECT grid.node, gx AS x, gy AS y, hits FROM grid JOIN hits USING (node)",
    "st3_score_documents": q.with_(*maps._final()) + maps._HITS,
}
