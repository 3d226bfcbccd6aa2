"""Streams: articles stored as pages arrive, documents scored against a fitted map."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textmap.functions import grid
from textmap.operators import som, web
from textmap.session import release, stage
from textmap.sources import versions


def read_files(
    spark: SparkSession, folder: str, schema: str, name_glob: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """A stream of parquet files as they appear in a folder.

    ``name_glob`` picks entries of the folder by name: single files, or tables of several files, which are read whole.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a stream takes a plain path for a folder; a pattern, even of one name, may also be a file
    return reader.parquet(folder if name_glob is None else f"{folder}/{{{name_glob}}}")


def with_event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark on ``column``; zone-less times are read in the session zone first."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def article_stream(
    pages: DataFrame, patterns: web.FieldPatterns = web.ARTICLE_TAG, event_time: str | None = None, delay: str = "1 day"
) -> DataFrame:
    """Pages to articles, as the batch job does. With an event time, a page seen again within ``delay`` is dropped."""
    if event_time is not None:
        pages = with_event_time(pages, event_time, delay).dropDuplicatesWithinWatermark(["url"])
    return web.articles(pages, patterns)


def store_rows(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def score_stream(vectors: DataFrame, codebook: som.Codebook, id_col: str = "doc_id") -> DataFrame:
    """Arriving document vectors with their node; stateless."""
    return som.predict(vectors, codebook, id_col)


def running_hits(assigned: DataFrame) -> DataFrame:
    """Hits per node so far; run it in update or complete mode."""
    return assigned.groupBy("node").agg(F.count(F.lit(1)).alias("hits"))


def _trigger(interval: str | None) -> dict:
    return {"availableNow": True} if interval is None else {"processingTime": interval}


def store_running(
    changed: DataFrame, keys: Sequence[str], path: str, checkpoint: str, interval: str | None = None, buckets: int = 1
) -> StreamingQuery:
    """Keep the newest row of each key of an aggregated stream as a versioned table.

    Runs in update mode: the counts live in the state store, a batch hands on only the keys it changed, and only their
    buckets are rewritten. Started again on its checkpoint it goes on counting; a batch that is repeated after a
    failure writes the same rows again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = stage(batch, "changed")
        if versions.versions(spark, path):
            versions.update(rows, path, keys)
        else:
            versions.overwrite(rows, path, keys, buckets)

    writer = changed.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(interval)).start()


def refresh_map(
    hits: DataFrame, kshape: tuple[int, int], path: str, checkpoint: str,
    interval: str | None = "1 second", then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Store the map table (node, x, y, hits) anew after every batch; ``interval`` None drains what is there.

    Each table is a version of its own: readers never see a half-written one, and only the last two are kept.
    """

    def rewrite(batch: DataFrame, number: int) -> None:
        # stored first: a join that skips a partition without nodes would leave its state uncommitted
        rows = stage(batch, "hits")
        table = grid.nodes(batch.sparkSession, kshape).join(rows, "node", "left").na.fill(0, ["hits"])
        versions.overwrite(table, path, ["node"])
        release(rows)
        if then is not None:
            then(latest_map(batch.sparkSession, path), number)

    writer = hits.writeStream.outputMode("complete").foreachBatch(rewrite).option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(interval)).start()


def latest_map(spark: SparkSession, path: str) -> DataFrame:
    """The map table of the newest batch."""
    return versions.read(spark, path)
