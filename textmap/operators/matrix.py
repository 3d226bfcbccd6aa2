"""Matrix products over distributed rows.

A row table is dense, (id, vec array<double>), or sparse, (id, indices array<int>, values array<double>).
Tasks turn Arrow batches into numpy blocks of bounded size; Spark adds the per-task partial sums.
"""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.functions.vectors import unit as unit_column
from textmap.session import few_tasks, fits_broadcast, rows_in_broadcast, stage

# Entries of one numpy block: 4 million doubles, 32 MB.
BLOCK_ENTRIES = 4_000_000
# Longest row piece that is shuffled; a batch of ten thousand pieces stays under 100 MB.
PIECE_ENTRIES = 1_024
# A matrix over the broadcast limit is cut into blocks of rows that fit, but of no fewer rows than these.
LEAST_ROWS = 256
# Most blocks that a task holds at once, with as many sums, so that its rows are read once for all of them.
BLOCKS_AT_ONCE = 2


def is_sparse(rows: DataFrame) -> bool:
    return "indices" in rows.columns


def row_columns(rows: DataFrame, id_col: str) -> DataFrame:
    """The columns a task needs, and no others; rows without a vector are not rows of the matrix."""
    if is_sparse(rows):
        return rows.select(F.col(id_col).cast("long").alias("id"), "indices", "values").where(
            F.col("indices").isNotNull()
        )
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where(
        F.col("vec").isNotNull()
    )


def have_own_ids(rows: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether every row has an id and no two rows have the same. Only the ids move."""
    shared_ids = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
    return shared_ids.isEmpty()


def width_of(rows: DataFrame) -> int:
    """Row length of a dense table, from one row; the tasks refuse rows of another length."""
    found = rows.where(F.col("vec").isNotNull()).select(F.size("vec").alias("n")).first()
    if found is None:
        raise ValueError("the table holds no vectors")
    return found["n"]


@contextmanager
def shared(spark: SparkSession, value: np.ndarray) -> Iterator[Broadcast]:
    """A broadcast variable for one finished job; released afterwards."""
    sent = spark.sparkContext.broadcast(np.ascontiguousarray(value))
    try:
        yield sent
    finally:
        sent.destroy()


def read_anew(sent: Broadcast) -> np.ndarray:
    """The value of a broadcast variable inside a task, read from the executor's disk where it lies there and not kept."""
    path = getattr(sent, "_path", None)
    return sent.value if path is None else sent.load_from_path(path)


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows x width matrix) blocks of bounded size from Arrow batches of a row table."""
    step = max(1, BLOCK_ENTRIES // max(1, width))
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for start in range(0, len(ids), step):
            part = batch.slice(start, step)
            if batch.num_columns == 2:
                if not (np.diff(part.column(1).offsets.to_numpy(zero_copy_only=False)) == width).all():
                    raise ValueError(f"every row must have {width} entries")
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                yield ids[start : start + step], flat.reshape(-1, width)
                continue
            columns = part.column(1).flatten().to_numpy(zero_copy_only=False)
            values = part.column(2).flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(part.column(1).offsets.to_numpy(zero_copy_only=False))
            dense = np.zeros((part.num_rows, width))
            dense[np.repeat(np.arange(part.num_rows), lengths), columns] = values
            yield ids[start : start + step], dense


def list_array(matrix: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column."""
    n_rows, width = matrix.shape
    offsets = np.arange(0, (n_rows + 1) * width, width, dtype=np.int32) if width else np.zeros(n_rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix, dtype=float).ravel()))


def map_rows(
    rows: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray], id_col: str = "doc_id", out: str = "vec"
) -> DataFrame:
    """(id, out): ``work`` applied to each block of rows. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in blocks(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), list_array(work(block))], [id_col, out])

    return row_columns(rows, id_col).mapInArrow(run, f"{id_col} long, {out} array<double>")


def sum_rows(
    rows: DataFrame, width: int, shape: tuple[int, int], work: Callable[[np.ndarray], np.ndarray], id_col: str = "doc_id"
) -> DataFrame:
    """(row, vec): the sum over all blocks of ``work(block)``, a matrix of the given shape.

    Each task adds up its own blocks and ships one partial matrix; the rows of the partials are
    summed by row number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, block in blocks(batches, width):
            part = work(block)
            total = part if total is None else total + part
        if total is None:
            return
        step = max(1, BLOCK_ENTRIES // max(1, shape[1]))
        for start in range(0, shape[0], step):
            piece = total[start : start + step]
            numbers = np.arange(start, start + len(piece), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), list_array(piece)], ["row", "vec"])

    partial = few_tasks(row_columns(rows, id_col)).mapInArrow(run, "row int, vec array<double>")
    return merge_partials(partial, "row", shape[1])


def add_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the value rows of each."""
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    return found, np.add.reduceat(values[order], starts, axis=0)


def add_in_order(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``add_by_key`` for keys that are in order already."""
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(values, starts, axis=0) if len(starts) else values


def merge_partials(partial: DataFrame, key: str, width: int) -> DataFrame:
    """(key int, vec): sums of per-task partial rows, spread by key.

    A key has at most one row per task, so no key is hot, and a task holds one sum per key. Long rows
    are cut into pieces that are summed apart, which also spreads a table of few keys.
    """
    if width > PIECE_ENTRIES:
        return _merge_pieces(partial, key, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            keys, sums = add_by_key(np.concatenate([keys, numbers]), np.concatenate([sums, flat]))
        yield pa.RecordBatch.from_arrays([pa.array(keys), list_array(sums)], [key, "vec"])

    spread = partial.select(F.col(key).cast("long").alias(key), "vec").repartition(key)
    return spread.mapInArrow(run, f"{key} long, vec array<double>").withColumn(key, F.col(key).cast("int"))


def _merge_pieces(partial: DataFrame, key: str, width: int) -> DataFrame:
    parts = -(-width // PIECE_ENTRIES)
    padded = F.concat("vec", F.array_repeat(F.lit(0.0), parts * PIECE_ENTRIES - width))
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(F.col("_row"), i * PIECE_ENTRIES + 1, F.lit(PIECE_ENTRIES))
    )
    cut = partial.select(key, padded.alias("_row")).select(key, F.posexplode(pieces).alias("_part", "vec"))
    numbered = cut.select((F.col(key).cast("long") * parts + F.col("_part")).cast("int").alias("_piece"), "vec")
    merged = merge_partials(numbered, "_piece", PIECE_ENTRIES)
    row = F.floor(F.col("_piece") / F.lit(parts)).cast("int")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "vec"))), lambda p: p["vec"]))
    return merged.groupBy(row.alias(key)).agg(F.slice(whole, 1, width).alias("vec"))


def sum_vectors(df: DataFrame, key: str) -> DataFrame:
    """(key, vec): element-wise sums of ``vec`` per key."""
    return df.groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("vec")))).alias("vec"))


def collect_matrix(df: DataFrame, shape: tuple[int, int], key: str = "row") -> np.ndarray:
    """A (key, vec) table of known, driver-sized shape as a numpy matrix; absent rows are zero."""
    table = df.select(F.col(key).cast("long").alias("key"), "vec").toArrow().combine_chunks()
    out = np.zeros(shape)
    if table.num_rows:
        values = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out[table.column("key").to_numpy()] = values.reshape(table.num_rows, shape[1])
    return out


def multiply(rows: DataFrame, matrix: np.ndarray, id_col: str = "doc_id", unit: bool = False) -> DataFrame:
    """(id, vec) = rows x matrix; ``unit`` scales each result row to length one.

    A matrix over the broadcast limit is sent in blocks.
    """
    if not fits_broadcast(matrix.nbytes):
        return multiply_by_blocks(rows, matrix, *matrix.shape, id_col, unit)
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix))

    def work(block: np.ndarray) -> np.ndarray:
        product = block @ shared.value
        return unit_rows(product) if unit else product

    return map_rows(rows, matrix.shape[0], work, id_col)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(length > 0, length, 1.0)


def to_sparse(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    entries = F.filter(
        F.transform("vec", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0
    )
    return rows.select(id_col, entries.alias("e")).select(
        id_col, F.col("e.i").alias("indices"), F.col("e.v").alias("values")
    )


def matrix_table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """A driver matrix as a (feature, weights) table, sent in slices of bounded size."""
    step = max(1, BLOCK_ENTRIES // max(1, matrix.shape[1]))
    table = None
    for start in range(0, len(matrix), step):
        piece = matrix[start : start + step]
        arrow = pa.table(
            {"feature": pa.array(np.arange(start, start + len(piece), dtype=np.int32)), "weights": list_array(piece)}
        )
        part = spark.createDataFrame(arrow)
        table = part if table is None else table.unionByName(part)
    return table


def row_blocks(n_rows: int, width: int) -> list[tuple[int, int]]:
    """Stretches (start, stop) of a matrix of that many rows, each small enough to be sent."""
    step = max(LEAST_ROWS, rows_in_broadcast(width))
    return [(start, min(start + step, n_rows)) for start in range(0, n_rows, step)]


def _block_of(weights: DataFrame | np.ndarray, start: int, stop: int, width: int) -> np.ndarray:
    if isinstance(weights, np.ndarray):
        return weights[start:stop]
    own = weights.where(F.col("feature").between(start, stop - 1))
    return collect_matrix(own.select((F.col("feature") - start).alias("row"), F.col("weights").alias("vec")), (stop - start, width))


def _cells(batch: pa.RecordBatch, start: int, stop: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the batch, features less ``start``, values) of the cells within a block, some at a time, in row order."""
    offsets = batch.column(1).offsets.to_numpy(zero_copy_only=False)
    feature = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    value = batch.column(2).flatten().to_numpy(zero_copy_only=False)
    number = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    own = np.flatnonzero((feature >= start) & (feature < stop))
    step = max(1, BLOCK_ENTRIES // max(1, width))
    for first in range(0, len(own), step):
        some = own[first : first + step]
        yield number[some], feature[some] - start, value[some]


def multiply_by_blocks(
    rows: DataFrame, weights: DataFrame | np.ndarray, n_features: int, n_out: int, id_col: str = "doc_id", unit: bool = False
) -> DataFrame:
    """(id, vec) = rows x matrix, the matrix as an array or a (feature, weights) table of any length.

    Its blocks are sent in turn; each gives one narrow product per row that has cells in it, and the products of a
    row are added. No cell leaves its row. Rows without a cell become zero rows.
    """
    spark, held = rows.sparkSession, row_columns(rows if is_sparse(rows) else to_sparse(rows, id_col), id_col)

    def product_with(start: int, stop: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(np.ascontiguousarray(_block_of(weights, start, stop, n_out)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                step = max(1, BLOCK_ENTRIES // max(1, n_out))
                for first in range(0, whole.num_rows, step):
                    batch = whole.slice(first, step)
                    total = np.zeros((batch.num_rows, n_out))
                    hit = np.full(batch.num_rows, start == 0)
                    for number, feature, value in _cells(batch, start, stop, n_out):
                        found, part = add_in_order(number, sent.value[feature] * value[:, None])
                        total[found] += part
                        hit[found] = True
                    ids = batch.column(0).to_numpy(zero_copy_only=False)[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), list_array(total[hit])], [id_col, "vec"])

        return held.mapInArrow(run, f"{id_col} long, vec array<double>")

    parts = [product_with(start, stop) for start, stop in row_blocks(n_features, n_out) or [(0, 0)]]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if len(parts) > 1:
        whole = sum_vectors(whole, id_col)
    return whole.select(id_col, unit_column(F.col("vec")).alias("vec")) if unit else whole


def transpose_product(
    rows: DataFrame, n_features: int, vectors: DataFrame, width: int, id_col: str = "doc_id"
) -> DataFrame:
    """(row, vec): transpose(rows) x vectors, where both tables share ``id_col``.

    The joined tables are multiplied block by block inside the tasks; while one partial matrix stays
    under the limit it is kept dense per task, otherwise stretches of its rows are summed in turn.
    """
    joined = rows.join(vectors, id_col).select("indices", "values", "vec")
    if not fits_broadcast(n_features * width * 8):
        return transpose_by_blocks(stage(joined, "joined"), n_features, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((n_features, width)), False
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows, dtype=np.int64))
            sparse = pa.RecordBatch.from_arrays([ids, batch.column(0), batch.column(1)], ["id", "indices", "values"])
            right = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for numbers, block in blocks(iter([sparse]), n_features):
                total += block.T @ right[numbers]
                seen = True
        if seen:
            rows_out = np.arange(n_features, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(rows_out), list_array(total)], ["row", "vec"])

    return merge_partials(few_tasks(joined).mapInArrow(run, "row int, vec array<double>"), "row", width)


def transpose_by_blocks(joined: DataFrame, n_features: int, width: int) -> DataFrame:
    """(row, vec): transpose(rows) x vectors for a stored table (indices, values, vec), rows without a cell left out.

    One pass for each stretch of features, whose sums a task holds dense; at most one row per task and feature moves.
    """

    def sums_of(start: int, stop: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, hit = np.zeros((stop - start, width)), np.zeros(stop - start, bool)
            for batch in batches:
                right = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                lists = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(0), batch.column(1)], ["id", "indices", "values"])
                for number, feature, value in _cells(lists, start, stop, width):
                    found, part = add_by_key(feature, right[number] * value[:, None])
                    total[found] += part
                    hit[found] = True
            numbers = np.flatnonzero(hit)
            step = max(1, BLOCK_ENTRIES // max(1, width))
            for first in range(0, len(numbers), step):
                some = numbers[first : first + step]
                yield pa.RecordBatch.from_arrays([pa.array((start + some).astype(np.int32)), list_array(total[some])], ["row", "vec"])

        return merge_partials(few_tasks(joined).mapInArrow(run, "row int, vec array<double>"), "row", width)

    whole = None
    for start, stop in row_blocks(n_features, width):
        part = sums_of(start, stop)
        whole = part if whole is None else whole.unionByName(part)
    return whole
