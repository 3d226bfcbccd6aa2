"""Contiguous shards of nearly equal bytes, cut from global prefix sums of the row sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.llm.prefix import running_sums
from textmap.session import stage

ROW_OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` with its size, its shard 0 to ``n_shards`` - 1 and its slot in the shard.

    Columns: ``id_col``, size, text_crc32, shard, slot. The size is the text's UTF-8 bytes plus 16. Rows
    are ordered by id (null first), then checksum and size; a row goes to the shard that holds the middle of
    its bytes when all bytes lie in one line cut at equal targets. Slots count from 0 in that order.

    A null text has no bytes and the checksum 0, as an empty one. Repeated rows are placed each for
    themselves, next to one another. A row longer than a shard leaves shards empty. Other columns of the
    input play no part, whatever their names. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + F.lit(ROW_OVERHEAD)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col(id_col), F.col("text_crc32"), F.col("size"), F.col("row")]
    placed = running_sums(sized, order, {"size": "before", "one": "index"}, "shard-rows")
    placed = stage(placed, "shard-places")
    total = placed.agg(F.max(F.col("before") + F.col("size"))).first()[0] or 1
    cut = placed.withColumn("shard", F.expr(f"cast(((2 * before + size) * {n_shards}) div (2 * {total}) as int)"))
    first = stage(cut.groupBy("shard").agg(F.min("index").alias("first")), "shard-first")
    return cut.join(F.broadcast(first), "shard").select(  # one row a shard
        id_col, "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot")
    )
