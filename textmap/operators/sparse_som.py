"""The map on raw sparse rows, with the codebook as a table.

For feature lists too long to keep a codebook in one place: it is stored as (feature, weights), one array over
the nodes per feature, and sent in blocks of features. Each block gives narrow products, which are added per row; no
cell leaves its row. Smaller codebooks are trained faster by ``textmap.operators.som``, which takes sparse rows too.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.functions import grid
from textmap.operators import matrix as mx
from textmap.operators import som
from textmap.params import SomParams
from textmap.session import few_tasks, release, shuffles_removed, stage

# Nodes whose products a row carries at once.
NODES_AT_ONCE = 1_024
# Cells and products of the rows that a task holds while the blocks of a long codebook pass by: 100 MB.
HELD_ENTRIES = 8_000_000


@dataclass(frozen=True)
class WideCodebook:
    """``weights`` is (feature, weights array<double>), stored; ``stored`` is the table behind them, where ``stage`` made it."""

    kshape: tuple[int, int]
    n_features: int
    weights: DataFrame
    stored: DataFrame | None = None

    @property
    def n_nodes(self) -> int:
        return self.kshape[0] * self.kshape[1]


@dataclass(frozen=True)
class WideModel:
    """A fitted map; ``trace`` has the columns of ``som.TRACE_SCHEMA``."""

    params: SomParams
    codebook: WideCodebook
    trace: tuple[tuple, ...]


def random_codebook(spark: SparkSession, kshape: tuple[int, int], n_features: int, seed: int = 0) -> WideCodebook:
    """The same values as the dense random codebook of that seed."""

    def value(node: int):
        text = F.concat(F.lit(f"{seed}:{node}:"), F.col("feature").cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)

    features = spark.range(n_features).select(F.col("id").cast("int").alias("feature"))
    weights = features.select("feature", F.array(*[value(n) for n in range(kshape[0] * kshape[1])]).alias("weights"))
    stored = stage(weights, "codebook")
    return WideCodebook(kshape, n_features, stored, stored)


def first_rows_codebook(rows: DataFrame, kshape: tuple[int, int], n_features: int, id_col: str = "doc_id") -> WideCodebook:
    """The rows with the smallest ids as nodes."""
    size = kshape[0] * kshape[1]
    first = rows.where(F.col("indices").isNotNull()).orderBy(id_col).limit(size).select("indices", "values")
    held = first.toArrow()
    if held.num_rows < size:
        raise ValueError(f"{held.num_rows} rows cannot fill a map of {size} nodes")
    spark = rows.sparkSession
    nodes = spark.createDataFrame(held.append_column("node", pa.array(np.arange(size, dtype=np.int32))))
    cells = nodes.select("node", F.inline(F.arrays_zip("indices", "values"))).toDF("node", "feature", "v")
    by_node = cells.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("node", "v"))).alias("by_node"))
    every = spark.range(n_features).select(F.col("id").cast("int").alias("feature"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda n: F.coalesce(F.try_element_at(F.col("by_node"), n), F.lit(0.0)))
    stored = stage(every.join(by_node, "feature", "left").select("feature", spread.alias("weights")), "codebook")
    return WideCodebook(kshape, n_features, stored, stored)


def unit_rows(rows: DataFrame, id_col: str) -> DataFrame:
    length = F.sqrt(F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v * v))
    scaled = F.transform("values", lambda v: F.when(F.col("length") > 0, v / F.col("length")).otherwise(v))
    return rows.select(id_col, "indices", "values", length.alias("length")).select(
        id_col, "indices", scaled.alias("values")
    )


def node_lengths(codebook: WideCodebook) -> np.ndarray:
    squares = mx.sum_rows(
        codebook.weights.select(F.col("feature").alias("id"), F.col("weights").alias("vec")),
        codebook.n_nodes, (1, codebook.n_nodes), lambda block: (block * block).sum(axis=0, keepdims=True), "id",
    )
    return np.sqrt(mx.collect_matrix(squares, (1, codebook.n_nodes))[0])


def predict(rows: DataFrame, codebook: WideCodebook, id_col: str = "doc_id") -> DataFrame:
    """(id, node, score, qe), as the dense map gives it. A stretch of nodes at a time gives each row's best node there."""
    lengths = node_lengths(codebook)
    scale = np.where(lengths > 0, lengths, 1.0)
    units = unit_rows(rows, id_col)

    def of_nodes(start: int, stop: int) -> DataFrame:
        own = codebook.weights.select("feature", F.slice("weights", start + 1, stop - start).alias("weights"))
        products = mx.multiply_by_blocks(units, own, codebook.n_features, stop - start, id_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, block in mx.blocks(batches, stop - start):
                similarity = block / scale[start:stop]
                rounded = np.round(similarity, som.TIE_DIGITS)
                node = np.argmax(rounded, axis=1)
                every = np.arange(len(block))
                score = similarity[every, node]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(-rounded[every, node]),
                        pa.array((node + start).astype(np.int32)),
                        pa.array(score),
                        pa.array(som.quantization_error(score)),
                    ],
                    [id_col, "key", "node", "score", "qe"],
                )

        return mx.row_columns(products, id_col).mapInArrow(run, f"{id_col} long, key double, node int, score double, qe double")

    size = codebook.n_nodes
    parts = [of_nodes(start, min(start + NODES_AT_ONCE, size)) for start in range(0, size, NODES_AT_ONCE)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if len(parts) > 1:
        best = F.min(F.struct("key", "node", "score", "qe")).alias("best")
        whole = whole.groupBy(id_col).agg(best).select(id_col, "best.*")
    return whole.select(id_col, "node", "score", "qe")


def _node_sums(placed: DataFrame, n_features: int, size: int) -> DataFrame:
    """(feature, sums): the summed values of each feature by node, of stored rows (node, indices, values)."""

    def of_block(start: int, stop: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((stop - start) * size)
            for batch in batches:
                node = batch.column(0).to_numpy(zero_copy_only=False)
                for number, feature, value in mx._cells(batch, start, stop, 1):
                    found, part = mx.add_by_key(feature.astype(np.int64) * size + node[number], value[:, None])
                    total[found] += part[:, 0]
            table = total.reshape(stop - start, size)
            hit = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array((start + hit).astype(np.int32)), mx.list_array(table[hit])], ["row", "vec"])

        return mx.merge_partials(few_tasks(placed).mapInArrow(run, "row int, vec array<double>"), "row", size)

    whole = None
    for start, stop in mx.row_blocks(n_features, size):
        part = of_block(start, stop)
        whole = part if whole is None else whole.unionByName(part)
    return whole.select(F.col("row").alias("feature"), F.col("vec").alias("sums"))


def _in_one_pass(rows: DataFrame, codebook: WideCodebook, id_col: str) -> bool:
    """Whether a row can be placed and added where it lies; rows that share an id meet each other in a join."""
    return codebook.n_nodes <= NODES_AT_ONCE and mx.have_own_ids(rows, id_col)


def _rounds(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches to be held together: until their cells and products reach ``most``, one at least."""
    held, entries = [], 0
    for whole in batches:
        step = max(1, mx.BLOCK_ENTRIES // size)
        for first in range(0, whole.num_rows, step):
            batch = whole.slice(first, step)
            held.append(batch)
            entries += len(batch.column(1).flatten()) + batch.num_rows * size
            if entries >= most:
                yield held
                held, entries = [], 0
    if held:
        yield held


def _sums_in_one_pass(rows: DataFrame, codebook: WideCodebook, id_col: str) -> tuple[DataFrame, np.ndarray, float, DataFrame]:
    """(feature, sums) by node, the rows by node, the sum of the errors, and the stored table behind the sums.

    Each row is placed and added where it lies. A task keeps up to two blocks of the codebook, with their sums; of a longer
    one it reads the blocks in turn for some rows at a time, and ships the sums of these.
    """
    size, n_features = codebook.n_nodes, codebook.n_features
    context, stretches = rows.sparkSession.sparkContext, mx.row_blocks(n_features, size)
    sent, squares = [], np.zeros(size)
    for start, stop in stretches:
        block = np.ascontiguousarray(mx._block_of(codebook.weights, start, stop, size))
        squares += (block * block).sum(axis=0)
        sent.append(context.broadcast(block))
    scale = np.where(squares > 0, np.sqrt(squares), 1.0)
    keeps = len(stretches) <= mx.BLOCKS_AT_ONCE

    def packed(start: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = total.reshape(-1, size)
        hit = np.flatnonzero(table.any(axis=1))
        step = max(1, mx.BLOCK_ENTRIES // size)
        for first in range(0, len(hit), step):
            some = hit[first : first + step]
            yield pa.RecordBatch.from_arrays([pa.array((start + some).astype(np.int32)), mx.list_array(table[some])], ["row", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((stop - start) * size) for start, stop in stretches] if keeps else []
        seen = np.zeros((2, size))
        for held in _rounds(batches, size, 0 if keeps else HELD_ENTRIES):
            products = [(np.zeros((batch.num_rows, size)), np.zeros(batch.num_rows)) for batch in held]
            for (start, stop), block in zip(stretches, sent, strict=True):
                weights = block.value if keeps else mx.read_anew(block)
                for batch, (product, length) in zip(held, products, strict=True):
                    for number, feature, value in mx._cells(batch, start, stop, size):
                        found, part = mx.add_in_order(number, weights[feature] * value[:, None])
                        product[found] += part
                        length += np.bincount(number, value * value, batch.num_rows)
            nodes = []
            for product, squared in products:
                length = np.sqrt(squared)
                similarity = product / np.where(length > 0, length, 1.0)[:, None] / scale
                node = np.argmax(np.round(similarity, som.TIE_DIGITS), axis=1)
                errors = som.quantization_error(similarity[np.arange(len(node)), node])
                seen += np.bincount(node, minlength=size), np.bincount(node, errors, size)
                nodes.append(node)
            for place, (start, stop) in enumerate(stretches):
                total = totals[place] if keeps else np.zeros((stop - start) * size)
                for batch, node in zip(held, nodes, strict=True):
                    for number, feature, value in mx._cells(batch, start, stop, size):
                        np.add.at(total, feature.astype(np.int64) * size + node[number], value)
                if not keeps:
                    yield from packed(start, total)
        # the counts and the errors travel as rows below the features
        yield pa.RecordBatch.from_arrays([pa.array(np.array([-1, -2], np.int32)), mx.list_array(seen)], ["row", "vec"])
        for (start, _), total in zip(stretches, totals, strict=False):
            yield from packed(start, total)

    partial = few_tasks(mx.row_columns(rows, id_col)).mapInArrow(run, "row int, vec array<double>")
    merged = stage(mx.merge_partials(partial, "row", size), "node-sums")
    for block in sent:
        block.destroy()
    seen = mx.collect_matrix(merged.where("row < 0").select((-1 - F.col("row")).alias("row"), "vec"), (2, size))
    sums = merged.where("row >= 0").select(F.col("row").alias("feature"), F.col("vec").alias("sums"))
    return sums, seen[0], float(seen[1].sum()), merged


def _sums_by_node(rows: DataFrame, codebook: WideCodebook, id_col: str) -> tuple[DataFrame, np.ndarray, float, DataFrame]:
    """As ``_sums_in_one_pass``, with a pass over the rows for each block of the codebook and its sums."""
    size = codebook.n_nodes
    assigned = stage(predict(rows, codebook, id_col), "assigned")
    counts, errors = np.zeros(size), 0.0
    for row in assigned.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("qe").alias("qe")).collect():
        counts[row["node"]] = row["n"]
        errors += row["qe"]
    placed = stage(rows.join(assigned.select(id_col, "node"), id_col).select("node", "indices", "values"), "placed")
    release(assigned)
    return _node_sums(placed, codebook.n_features, size), counts, errors, placed


def _epoch(
    rows: DataFrame, codebook: WideCodebook, params: SomParams, it: int, id_col: str, one_pass: bool
) -> tuple[WideCodebook, tuple]:
    """The codebook after one epoch, and its line of the trace."""
    size = params.n_nodes
    sums, counts, errors, behind = (_sums_in_one_pass if one_pass else _sums_by_node)(rows, codebook, id_col)
    pair = codebook.weights.join(sums, "feature", "left").select(
        F.col("feature").alias("id"), F.concat("weights", F.coalesce("sums", F.array_repeat(F.lit(0.0), size))).alias("vec")
    )
    strength = grid.influence_matrix(grid.distance_matrix(params.kshape, params.topology), params, it)
    strength = np.where(strength > params.min_influence, strength, 0.0)
    weight = strength.T @ counts

    def move(block: np.ndarray) -> np.ndarray:
        old, pull = block[:, :size], block[:, size:] @ strength
        if params.update == "sum":
            new = old + pull - weight * old
        else:
            new = np.where(weight > 0, pull / np.where(weight > 0, weight, 1.0), old)
        # the squares of the way and of the length travel behind the weights
        return np.column_stack([new, ((new - old) ** 2).sum(axis=1), (new * new).sum(axis=1)])

    moved = stage(mx.map_rows(pair, 2 * size, move, "id", "vec"), "codebook")
    release(behind)
    norms = moved.agg(F.sqrt(F.sum(F.element_at("vec", size + 1))).alias("way"), F.sqrt(F.sum(F.element_at("vec", size + 2))).alias("length")).first()
    weights = moved.select(F.col("id").cast("int").alias("feature"), F.slice("vec", 1, size).alias("weights"))
    radius, rate, _, _ = grid.schedule(params, it)
    error = float(errors / counts.sum()) if counts.sum() else float("nan")
    line = (it, radius, rate, error, float(norms["way"] or 0.0), float(norms["length"] or 0.0))
    return WideCodebook(codebook.kshape, codebook.n_features, weights, moved), line


def run_epoch(
    rows: DataFrame, codebook: WideCodebook, params: SomParams, it: int, id_col: str = "doc_id"
) -> tuple[WideCodebook, float]:
    """The codebook after one epoch, and the mean error against the codebook before."""
    with shuffles_removed(rows.sparkSession):
        after, line = _epoch(rows, codebook, params, it, id_col, _in_one_pass(rows, codebook, id_col))
    return after, line[3]


def train(
    rows: DataFrame, n_features: int, params: SomParams, k_init: WideCodebook | None = None, id_col: str = "doc_id"
) -> WideModel:
    """As ``som.fit``, with its start, tolerance, clipping and trace. ``rows`` should be a stored table."""
    if params.update not in ("mean", "sum"):
        raise ValueError(f"unknown update: {params.update}")
    if k_init is not None:
        codebook = k_init
    elif params.init == "first":
        codebook = first_rows_codebook(rows, params.kshape, n_features, id_col)
    elif params.init == "random":
        codebook = random_codebook(rows.sparkSession, params.kshape, n_features, params.seed)
    else:
        raise ValueError(f"unknown init: {params.init}")
    if codebook.kshape != params.kshape or codebook.n_features != n_features:
        raise ValueError(f"given map {codebook.kshape} x {codebook.n_features} does not fit {params.kshape} x {n_features}")
    trace: list[tuple] = []
    one_pass = _in_one_pass(rows, codebook, id_col)
    for it in range(1, params.n_iter + 1):
        before = codebook
        with shuffles_removed(rows.sparkSession):
            codebook, line = _epoch(rows, before, params, it, id_col, one_pass)
        if before is not k_init:
            release(before.stored)
        trace.append(line)
        if params.tolerance is not None and it > 1 and abs(trace[-2][3] - line[3]) <= params.tolerance * abs(trace[-2][3]):
            break
    if params.clip_below is not None:
        clipped = F.transform("weights", lambda w: F.when(w < params.clip_below, F.lit(0.0)).otherwise(w))
        codebook = WideCodebook(codebook.kshape, n_features, codebook.weights.select("feature", clipped.alias("weights")))
    return WideModel(params, codebook, tuple(trace))


def fit(
    rows: DataFrame, n_features: int, params: SomParams, k_init: WideCodebook | None = None, id_col: str = "doc_id"
) -> tuple[WideCodebook, list[float]]:
    """(codebook, error per epoch) of ``train``."""
    model = train(rows, n_features, params, k_init, id_col)
    return model.codebook, [line[3] for line in model.trace]


def entries(codebook: WideCodebook) -> DataFrame:
    """(node, feature, w) of the codebook."""
    return codebook.weights.select("feature", F.posexplode("weights").alias("node", "w")).select("node", "feature", "w")
