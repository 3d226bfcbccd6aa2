"""Rows that a judge of texts lets pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmap.llm.workers import give_back

ROWS_AT_ONCE = 1_000


def passing(docs: DataFrame, judge: Callable, found: str, kept: Column, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` for which ``kept`` holds, a condition on the columns ``found`` that ``judge`` gives.

    ``judge`` turns batches (id, text, further columns) into (id, found columns, further columns). The text goes to
    the task once and comes back as it is, some rows at a time; the other columns ride along as one.
    """
    others = [f.name for f in docs.schema.fields if f.name != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), F.col(f"`{text_col}`").alias("text"))
    kind = T.StructType([packed.schema["rest"], *T.StructType.fromDDL(found).fields, T.StructField("body", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(first, ROWS_AT_ONCE)
                again = pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(1)], ["rest", "text", "body"])
                yield from judge(iter([again]))
        give_back()

    told = packed.mapInArrow(run, kind).where(kept)
    return told.select(*[F.col("body").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns])
