"""Many maps trained side by side: one map per value of a column, one pass over the rows per epoch.

The maps of a page are one stack of node vectors of bounded size. A row looks only at the nodes of its own map, and a
task adds up its rows by (map, best unit), so neither a map with a third of all rows nor thousands of small maps
change the shape of the job. Maps beyond a page are trained page after page, each on its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.functions import grid
from textmap.operators import matrix as mx
from textmap.operators import som
from textmap.params import SomParams
from textmap.session import BROADCAST_LIMIT_BYTES, few_tasks, stage

TRACE = "it int, quantization_error double, unit_deltas_update double, codebook_norm double"


@dataclass(frozen=True)
class Maps:
    """``codebooks`` (group, node, vec) and ``trace`` (group, one row per epoch), both stored; ``group`` names the column."""

    params: SomParams
    group: str
    width: int
    codebooks: DataFrame
    trace: DataFrame


def _pages(rows: DataFrame, group: str, per_page: int) -> tuple[DataFrame, int]:
    """(group, page) with at most about ``per_page`` groups a page, and the number of pages; null is a group."""
    groups = rows.select(group).distinct()
    n = groups.count()
    pages = max(1, -(-n // per_page))
    return groups.withColumn("_page", F.pmod(F.xxhash64(group, F.col(group).isNull()), F.lit(pages)).cast("int")), pages


def _numbered(rows: DataFrame, group: str, names: list) -> DataFrame:
    """``rows`` of the named groups with their place in ``names`` as ``_map``."""
    spark = rows.sparkSession
    kind = rows.schema[group].dataType.simpleString()
    table = spark.createDataFrame([(name, i) for i, name in enumerate(names)], f"_name {kind}, _map long")
    return rows.join(F.broadcast(table), F.col(group).eqNullSafe(F.col("_name"))).drop("_name")


def _vectors(rows: DataFrame) -> list[str]:
    return ["indices", "values"] if mx.is_sparse(rows) else ["vec"]


def _start(rows: DataFrame, names: list, width: int, params: SomParams, id_col: str) -> np.ndarray:
    """maps x nodes x width: random, the same for each map, or the rows of each map with the smallest ids, in turn."""
    size = params.n_nodes
    if params.init == "random":
        return np.repeat(som.random_codebook(params.kshape, width, params.seed).weights[None], len(names), axis=0)
    if params.init != "first":
        raise ValueError(f"unknown init: {params.init}")
    if mx.is_sparse(rows):
        raise ValueError("a map on sparse rows starts at random")
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("_map").orderBy(id_col))
    first = rows.select("_map", id_col, F.col("vec").cast("array<double>").alias("vec")).withColumn("_place", place)
    found: list[list] = [[] for _ in names]
    for r in first.where(F.col("_place") <= size).select("_map", "_place", "vec").orderBy("_map", "_place").toLocalIterator():
        found[r["_map"]].append(r["vec"])
    return np.array([[own[k % len(own)] for k in range(size)] for own in found], dtype=float).reshape(len(names), size, width)


def _epoch_sums(rows: DataFrame, sent: Broadcast, n_maps: int, size: int, width: int) -> DataFrame:
    """(unit, vec): per unit map * size + node its rows, their summed error and their summed vectors in one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, sums = sent.value, np.zeros((n_maps * size, width + 2))
        for numbers, block in mx.blocks(batches, width):
            for number in np.unique(numbers):
                own = block[numbers == number]
                node, _, error = som.best_units(own, stack[number], "cosine")
                found, part = mx.add_by_key(node, np.column_stack([np.ones(len(own)), error, own]))
                sums[number * size + found] += part
        hit = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(hit), mx.list_array(sums[hit])], ["unit", "vec"])

    numbered = rows.select(F.col("_map").alias("id"), *_vectors(rows))
    partial = few_tasks(numbered).mapInArrow(run, "unit long, vec array<double>")
    return mx.merge_partials(partial, "unit", width + 2)


def _train_page(rows: DataFrame, stack: np.ndarray, params: SomParams) -> tuple[np.ndarray, list[tuple]]:
    n_maps, size, width = stack.shape
    dist, trace = grid.distance_matrix(params.kshape, params.topology), []
    active, last = np.ones(n_maps, bool), np.full(n_maps, np.nan)
    for it in range(1, params.n_iter + 1):
        with mx.shared(rows.sparkSession, stack) as sent:
            found = mx.collect_matrix(_epoch_sums(rows, sent, n_maps, size, width), (n_maps * size, width + 2), "unit")
        found = found.reshape(n_maps, size, width + 2)
        strength = grid.influence_matrix(dist, params, it)
        strength = np.where(strength > params.min_influence, strength, 0.0)
        moved = stack.copy()
        for k in np.flatnonzero(active).tolist():
            counts, errors, sums = found[k, :, 0], found[k, :, 1].sum(), found[k, :, 2:]
            moved[k] = som.apply_epoch(som.Codebook(params.kshape, stack[k]), strength, counts, sums, params.update).weights
            error = errors / counts.sum() if counts.sum() else float("nan")
            trace.append((k, it, float(error), float(np.linalg.norm(moved[k] - stack[k])), float(np.linalg.norm(moved[k]))))
            if params.tolerance is not None and abs(last[k] - error) <= params.tolerance * abs(last[k]):
                active[k] = False
            last[k] = error
        stack = moved
        if not active.any():
            break
    if params.clip_below is not None:
        stack = np.where(stack < params.clip_below, 0.0, stack)
    return stack, trace


def fit(
    rows: DataFrame, group: str, params: SomParams = SomParams(), width: int | None = None, id_col: str = "doc_id",
    page_bytes: int = BROADCAST_LIMIT_BYTES,
) -> Maps:
    """One map for each value of ``group``, as ``som.fit`` trains it on the rows of that value.

    A start from the first rows takes them in turn where a map has fewer rows than nodes. With a tolerance each map
    stops by itself. Rows without a vector belong to no map; a null value is a map of its own. ``rows`` should be a
    stored table. An empty table gives no maps.
    """
    if params.update not in ("mean", "sum"):
        raise ValueError(f"unknown update: {params.update}")
    spark = rows.sparkSession
    held = rows.select(group, id_col, *_vectors(rows)).where(F.col(_vectors(rows)[0]).isNotNull())
    if width is None:
        first = held.select(F.size("vec").alias("n")).first()
        width = first["n"] if first else 0
    per_map = params.n_nodes * max(width, 1) * 8
    pages, n_pages = _pages(held, group, max(1, page_bytes // per_map))
    pages = stage(pages, "map-pages")
    kind = rows.schema[group].dataType.simpleString()
    codebooks = traces = None
    for page in range(n_pages):
        names = [r[0] for r in pages.where(F.col("_page") == page).select(group).toLocalIterator()]
        if not names and codebooks is not None:
            continue
        own = stage(_numbered(held, group, names), "map-rows")
        stack, trace = _train_page(own, _start(own, names, width, params, id_col), params) if names else (np.empty((0, 1, 1)), [])
        flat = spark.createDataFrame(
            pa.table({"_unit": pa.array(np.arange(stack.shape[0] * stack.shape[1])), "vec": mx.list_array(stack.reshape(-1, stack.shape[2]))})
        ) if names else spark.createDataFrame([], "_unit long, vec array<double>")
        named = spark.createDataFrame([(i, name) for i, name in enumerate(names)], f"_map long, {_quoted(group)} {kind}")
        size = params.n_nodes
        units = flat.select(F.expr(f"_unit div {size}").alias("_map"), (F.col("_unit") % size).cast("int").alias("node"), "vec")
        found = stage(units.join(F.broadcast(named), "_map").select(group, "node", "vec"), "map-codebooks")
        steps = spark.createDataFrame(trace, f"_map long, {TRACE}").join(F.broadcast(named), "_map").drop("_map")
        steps = stage(steps.select(group, *steps.columns[:-1]), "map-traces")
        codebooks = found if codebooks is None else codebooks.unionByName(found)
        traces = steps if traces is None else traces.unionByName(steps)
    return Maps(params, group, width, codebooks, traces)


def _quoted(name: str) -> str:
    return f"`{name}`"


def predict(rows: DataFrame, maps: Maps, id_col: str = "doc_id", page_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """(group, id, node, score, qe): each row's best unit on the map of its group; rows of other groups are left out."""
    group, size, width = maps.group, maps.params.n_nodes, maps.width
    held = rows.select(group, F.col(id_col).cast("long").alias(id_col), *_vectors(rows)).where(F.col(_vectors(rows)[0]).isNotNull())
    pages, n_pages = _pages(maps.codebooks, group, max(1, page_bytes // (size * max(width, 1) * 8)))
    pages = stage(pages, "map-pages")
    kind = rows.schema[group].dataType.simpleString()
    whole = None
    for page in range(n_pages):
        names = [r[0] for r in pages.where(F.col("_page") == page).select(group).toLocalIterator()]
        stack = np.zeros((len(names) * size, width))
        own = _numbered(maps.codebooks, group, names).select((F.col("_map") * size + F.col("node")).alias("unit"), "vec")
        if names:
            stack = mx.collect_matrix(own, (len(names) * size, width), "unit")
        sent = rows.sparkSession.sparkContext.broadcast(stack.reshape(len(names), size, width))

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = pa.array(np.arange(batch.num_rows, dtype=np.int64))
                vectors = pa.RecordBatch.from_arrays([places, *batch.columns[3:]], [f"c{i}" for i in range(batch.num_columns - 2)])
                maps_of = batch.column(2).to_numpy()
                for at, block in mx.blocks(iter([vectors]), width):
                    node, score, error = np.zeros(len(at), np.int32), np.zeros(len(at)), np.zeros(len(at))
                    for number in np.unique(maps_of[at]):
                        mine = np.flatnonzero(maps_of[at] == number)
                        node[mine], score[mine], error[mine] = som.best_units(block[mine], sent.value[number], "cosine")
                    part = batch.slice(int(at[0]), len(at))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(node), pa.array(score), pa.array(error)], [group, id_col, "node", "score", "qe"]
                    )

        placed = _numbered(held, group, names).select(group, id_col, "_map", *_vectors(rows))
        found = placed.mapInArrow(run, f"{_quoted(group)} {kind}, {_quoted(id_col)} long, node int, score double, qe double")
        whole = found if whole is None else whole.unionByName(found)
    return whole
