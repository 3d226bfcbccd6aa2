"""Self-organizing map: codebook, best units, batch epochs, fit, predict.

The codebook is frozen during an epoch, so an epoch is one grouped sum over the rows:
per best unit the number of rows and the sum of their vectors. The node update needs only those.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.functions import grid
from textmap.functions import vectors as vx
from textmap.operators import matrix as mx
from textmap.params import SomParams
from textmap.session import few_tasks, fits_broadcast, stage, stage_observed

# Similarities equal to this many digits are ties; the lowest node wins.
TIE_DIGITS = 12
TRACE_SCHEMA = (
    "it int, radius double, learning_rate double, quantization_error double, "
    "unit_deltas_update double, codebook_norm double"
)


@dataclass(frozen=True)
class Codebook:
    """Node vectors, one row per node; map-sized, so it lives on the driver."""

    kshape: tuple[int, int]
    weights: np.ndarray

    def __post_init__(self) -> None:
        if self.weights.ndim != 2 or len(self.weights) != self.kshape[0] * self.kshape[1]:
            raise ValueError(f"codebook of shape {self.weights.shape} does not fit a map of {self.kshape}")

    @property
    def width(self) -> int:
        return self.weights.shape[1]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(node, vec), spread over several slices of bounded size."""
        return mx.matrix_table(spark, self.weights).select(
            F.col("feature").alias("node"), F.col("weights").alias("vec")
        )


def codebook_from(df: DataFrame, kshape: tuple[int, int]) -> Codebook:
    """A (node, vec) table as a codebook; nodes must be exactly 0 .. n_nodes - 1."""
    size = kshape[0] * kshape[1]
    # one row more than a correct table has is enough to see that it does not fit
    rows = df.select("node", "vec").orderBy("node").limit(size + 1).collect()
    if [r["node"] for r in rows] != list(range(size)):
        raise ValueError(f"the table does not hold the {size} nodes of a map of {kshape}")
    if len({len(r["vec"]) for r in rows}) != 1:
        raise ValueError("codebook rows differ in length")
    return Codebook(kshape, np.array([r["vec"] for r in rows], dtype=float))


def random_value(seed: int, node: int, feature: int) -> float:
    """Uniform in [0, 1), the same on every machine: 32 bits of a digest."""
    return int(md5(f"{seed}:{node}:{feature}".encode()).hexdigest()[:8], 16) / 2.0**32


def random_codebook(kshape: tuple[int, int], width: int, seed: int = 0) -> Codebook:
    size = kshape[0] * kshape[1]
    weights = [[random_value(seed, node, feature) for feature in range(width)] for node in range(size)]
    return Codebook(kshape, np.array(weights).reshape(size, width))


def first_rows_codebook(vectors: DataFrame, kshape: tuple[int, int], id_col: str = "doc_id") -> Codebook:
    size = kshape[0] * kshape[1]
    rows = vectors.select(F.col("vec").cast("array<double>").alias("vec"), id_col).orderBy(id_col).limit(size).collect()
    if len(rows) < size:
        raise ValueError(f"{len(rows)} rows cannot fill a map of {size} nodes")
    return Codebook(kshape, np.array([r["vec"] for r in rows]))


def initial_codebook(
    vectors: DataFrame,
    width: int,
    params: SomParams,
    k_init: Codebook | DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    id_col: str = "doc_id",
) -> Codebook:
    """Warm start from a map, a table or a function of the data; else as ``params.init`` says."""
    if callable(k_init) and not isinstance(k_init, DataFrame):
        k_init = k_init(vectors)
    if isinstance(k_init, DataFrame):
        k_init = codebook_from(k_init, params.kshape)
    if k_init is not None:
        if k_init.kshape != params.kshape or k_init.width != width:
            raise ValueError(
                f"given map {k_init.kshape} x {k_init.width} does not fit {params.kshape} x {width}"
            )
        return k_init
    if params.init == "first":
        return first_rows_codebook(vectors, params.kshape, id_col)
    if params.init == "random":
        return random_codebook(params.kshape, width, params.seed)
    raise ValueError(f"unknown init: {params.init}")


def squared_distances(block: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """rows x nodes matrix of squared Euclidean distances."""
    lengths = (weights * weights).sum(axis=1)
    return np.maximum((block * block).sum(axis=1)[:, None] - 2 * (block @ weights.T) + lengths, 0.0)


def best_units(block: np.ndarray, weights: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the best node, its score and its error; ties go to the lowest node.

    "cosine" scores by similarity, "euclid" by squared distance.
    """
    every = np.arange(len(block))
    if metric == "euclid":
        squared = squared_distances(block, weights)
        node = np.argmin(np.round(squared, TIE_DIGITS), axis=1)
        return node, squared[every, node], np.sqrt(squared[every, node])
    similarity = mx.unit_rows(block) @ mx.unit_rows(weights).T
    node = np.argmax(np.round(similarity, TIE_DIGITS), axis=1)
    score = similarity[every, node]
    return node, score, quantization_error(score)


def check_metric(metric: str) -> None:
    if metric not in ("cosine", "euclid"):
        raise ValueError(f"unknown metric: {metric}")


def quantization_error(similarity: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0e-4 + similarity) - 1.0


def _blocks(rows: DataFrame, codebook: Codebook) -> list[tuple[int, Broadcast]]:
    """The nodes in blocks that are small enough to be sent: the first node of each and its block."""
    context = rows.sparkSession.sparkContext
    stretches = mx.row_blocks(len(codebook.weights), codebook.width)
    if fits_broadcast(codebook.weights.nbytes):
        stretches = [(0, len(codebook.weights))]
    return [(start, context.broadcast(codebook.weights[start:stop])) for start, stop in stretches]


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def predict(rows: DataFrame, codebook: Codebook, id_col: str = "doc_id", metric: str = "cosine") -> DataFrame:
    """(id, node, score, qe) per row. Narrow while the codebook is small enough to be sent, so it also runs on a stream.

    A larger codebook is sent in blocks of nodes; each gives every row's best node there, and the best of these stays.
    """
    check_metric(metric)
    width = codebook.width

    def of_block(start: int, sent: Broadcast, key: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, block in mx.blocks(batches, width):
                node, score, error = best_units(block, sent.value, metric)
                columns = [pa.array(ids, pa.int64()), pa.array((node + start).astype(np.int32)), pa.array(score), pa.array(error)]
                names = [id_col, "node", "score", "qe"]
                if key:
                    rounded = np.round(score, TIE_DIGITS)
                    columns, names = [*columns, pa.array(rounded if metric == "euclid" else -rounded)], [*names, "key"]
                yield pa.RecordBatch.from_arrays(columns, names)

        schema = f"{id_col} long, node int, score double, qe double" + (", key double" if key else "")
        return mx.row_columns(rows, id_col).mapInArrow(run, schema)

    parts = _blocks(rows, codebook)
    found = _union([of_block(start, sent, len(parts) > 1) for start, sent in parts])
    if len(parts) == 1:
        return found
    best = F.min(F.struct("key", "node", "score", "qe")).alias("best")
    return found.groupBy(id_col).agg(best).select(id_col, "best.node", "best.score", "best.qe")


def two_nearest(rows: DataFrame, codebook: Codebook, id_col: str = "doc_id") -> DataFrame:
    """(id, node, second, d1, d2): the two nodes nearest by squared distance, on raw vectors."""
    width = codebook.width
    if len(codebook.weights) < 2:
        raise ValueError("a map of one node has no second unit")

    def of_block(start: int, sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, block in mx.blocks(batches, width):
                squared = squared_distances(block, sent.value)
                order = np.argsort(np.round(squared, TIE_DIGITS), axis=1, kind="stable")[:, :2]
                near = np.take_along_axis(squared, order, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), mx.list_array(order + start), mx.list_array(near)], [id_col, "nodes", "d"]
                )

        return mx.row_columns(rows, id_col).mapInArrow(run, f"{id_col} long, nodes array<double>, d array<double>")

    parts = _blocks(rows, codebook)
    found = _union([of_block(start, sent) for start, sent in parts])
    if len(parts) > 1:
        both = F.flatten(F.collect_list(F.arrays_zip("nodes", "d")))
        rounded = F.transform(both, lambda e: F.struct(F.round(e["d"], TIE_DIGITS).alias("key"), e["nodes"].alias("nodes"), e["d"].alias("d")))
        found = found.groupBy(id_col).agg(F.slice(F.array_sort(rounded), 1, 2).alias("two"))
        found = found.select(id_col, F.col("two.nodes").alias("nodes"), F.col("two.d").alias("d"))
    return found.select(
        id_col, F.col("nodes")[0].cast("int").alias("node"), F.col("nodes")[1].cast("int").alias("second"),
        F.col("d")[0].alias("d1"), F.col("d")[1].alias("d2"),
    )


def predict_measured(rows: DataFrame, codebook: Codebook, id_col: str = "doc_id") -> DataFrame:
    """(id, node, score, qe, step): as ``predict``, with the grid distance between the two nodes nearest to the raw row.

    One narrow pass while the codebook is small enough to be sent. A map of one node has no step.
    """
    width, cols = codebook.width, codebook.kshape[1]
    if len(codebook.weights) < 2:
        return predict(rows, codebook, id_col).withColumn("step", F.lit(None).cast("double"))
    if not fits_broadcast(codebook.weights.nbytes):
        near = two_nearest(rows, codebook, id_col)
        dx = grid.node_x(F.col("node"), cols) - grid.node_x(F.col("second"), cols)
        dy = grid.node_y(F.col("node"), cols) - grid.node_y(F.col("second"), cols)
        return predict(rows, codebook, id_col).join(near.select(id_col, F.sqrt((dx * dx + dy * dy).cast("double")).alias("step")), id_col)
    sent = _blocks(rows, codebook)[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in mx.blocks(batches, width):
            node, score, error = best_units(block, sent.value, "cosine")
            squared = np.round(squared_distances(block, sent.value), TIE_DIGITS)
            two = np.argsort(squared, axis=1, kind="stable")[:, :2]
            x, y = np.divmod(two, cols)
            step = np.hypot(x[:, 0] - x[:, 1], y[:, 0] - y[:, 1])
            columns = [pa.array(ids, pa.int64()), pa.array(node.astype(np.int32)), pa.array(score), pa.array(error), pa.array(step)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "node", "score", "qe", "step"])

    schema = f"{id_col} long, node int, score double, qe double, step double"
    return mx.row_columns(rows, id_col).mapInArrow(run, schema)


def place(rows: DataFrame, codebook: Codebook, id_col: str = "doc_id") -> tuple[DataFrame, dict]:
    """The stored rows of ``predict`` and, from the same pass: rows, quant_error, topo_error."""
    stored, seen = stage_observed(
        predict_measured(rows, codebook, id_col), "assigned",
        rows=F.count(F.lit(1)), quant_error=F.avg("qe"), topo_error=F.avg("step"),
    )
    return stored.drop("step"), seen


def topographic_error(rows: DataFrame, codebook: Codebook, id_col: str = "doc_id") -> DataFrame:
    """One row: mean grid distance between the two nearest nodes of each row."""
    cols = codebook.kshape[1]
    near = two_nearest(rows, codebook, id_col)
    dx = grid.node_x(F.col("node"), cols) - grid.node_x(F.col("second"), cols)
    dy = grid.node_y(F.col("node"), cols) - grid.node_y(F.col("second"), cols)
    return near.agg(F.avg(F.sqrt((dx * dx + dy * dy).cast("double"))).alias("topographic_error"))


def node_distances(rows: DataFrame, codebook: Codebook, id_col: str = "doc_id") -> DataFrame:
    """(id, distances): squared distance of each row to every node, in node order."""
    def of_block(sent: Broadcast) -> DataFrame:
        return mx.map_rows(rows, codebook.width, lambda block: squared_distances(block, sent.value), id_col, "distances")

    parts = _blocks(rows, codebook)
    if len(parts) == 1:
        return of_block(parts[0][1])
    found = _union([of_block(sent).withColumn("_start", F.lit(start)) for start, sent in parts])
    whole = F.array_sort(F.collect_list(F.struct("_start", "distances")))
    return found.groupBy(id_col).agg(F.flatten(F.transform(whole, lambda e: e["distances"])).alias("distances"))


def epoch_sums(
    rows: DataFrame, codebook: Codebook, id_col: str = "doc_id", metric: str = "cosine", sent: Broadcast | None = None
) -> DataFrame:
    """(node, n, qe, vec): per best unit the rows, their summed error and their summed vectors.

    Every task adds up its rows first and ships at most one row per node, so a node that holds a
    third of all rows costs no more than any other.
    """
    check_metric(metric)
    width, size = codebook.width, len(codebook.weights)
    if not fits_broadcast(codebook.weights.nbytes):
        return _sums_by_blocks(rows, codebook, id_col, metric)
    shared = sent or _blocks(rows, codebook)[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, width + 2))
        for _, block in mx.blocks(batches, width):
            node, _, error = best_units(block, shared.value, metric)
            _add(sums, node, error, block)
        hit = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), mx.list_array(sums[hit])], ["node", "vec"])

    return _unpacked(few_tasks(mx.row_columns(rows, id_col)).mapInArrow(run, "node int, vec array<double>"), width)


def _add(sums: np.ndarray, node: np.ndarray, error: np.ndarray, block: np.ndarray) -> None:
    """Add rows to the sums of their nodes; count and error travel as the first two entries."""
    found, part = mx.add_by_key(node, np.column_stack([np.ones(len(block)), error, block]))
    sums[found] += part


def _unpacked(partial: DataFrame, width: int) -> DataFrame:
    return mx.merge_partials(partial, "node", width + 2).select(
        "node",
        F.element_at("vec", 1).cast("long").alias("n"),
        F.element_at("vec", 2).alias("qe"),
        F.slice("vec", 3, width).alias("vec"),
    )


def _sums_by_blocks(rows: DataFrame, codebook: Codebook, id_col: str, metric: str) -> DataFrame:
    """The same for a codebook in blocks: each row is placed first, then each block of nodes adds up its own rows."""
    width = codebook.width
    placed = predict(rows, codebook, id_col, metric).select(id_col, "node", "qe")
    vectors = ["indices", "values"] if mx.is_sparse(rows) else ["vec"]
    joined = stage(rows.select(F.col(id_col).cast("long").alias(id_col), *vectors).join(placed, id_col), "placed")

    def of_block(start: int, stop: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((stop - start, width + 2))
            for batch in batches:
                node, error = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
                places = pa.array(np.arange(batch.num_rows))
                lists = pa.RecordBatch.from_arrays([places, *batch.columns[2:]], [str(i) for i in range(batch.num_columns - 1)])
                for at, block in mx.blocks(iter([lists]), width):
                    _add(sums, node[at] - start, error[at], block)
            hit = np.flatnonzero(sums[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array((start + hit).astype(np.int32)), mx.list_array(sums[hit])], ["node", "vec"])

        own = joined.where(F.col("node").between(start, stop - 1)).select("node", "qe", *vectors)
        return few_tasks(own).mapInArrow(run, "node int, vec array<double>")

    return _unpacked(_union([of_block(start, stop) for start, stop in mx.row_blocks(len(codebook.weights), width)]), width)


def apply_epoch(codebook: Codebook, influence: np.ndarray, counts: np.ndarray, sums: np.ndarray, update: str) -> Codebook:
    """The codebook after an epoch, from its per-node row counts and vector sums."""
    pull = influence.T @ sums
    weight = (influence.T @ counts)[:, None]
    if update == "sum":
        return Codebook(codebook.kshape, codebook.weights + pull - weight * codebook.weights)
    if update == "mean":
        # a node out of reach of every row keeps its vector
        moved = pull / np.where(weight > 0, weight, 1.0)
        return Codebook(codebook.kshape, np.where(weight > 0, moved, codebook.weights))
    raise ValueError(f"unknown update: {update}")


def _apply_by_blocks(
    codebook: Codebook, params: SomParams, it: int, counts: np.ndarray, sums: np.ndarray, dist: np.ndarray | None
) -> Codebook:
    """``apply_epoch`` for some nodes at a time, so that node-by-node distances never stand whole beside a large map."""
    size = len(codebook.weights)
    step = size if dist is not None else max(1, mx.BLOCK_ENTRIES // size)
    moved = codebook.weights.copy()
    for start in range(0, size, step):
        stop = min(start + step, size)
        near = grid.distance_block(params.kshape, params.topology, start, stop) if dist is None else dist[start:stop]
        strength = grid.influence_matrix(near, params, it).T
        strength = np.where(strength > params.min_influence, strength, 0.0)
        own = Codebook((stop - start, 1), codebook.weights[start:stop])
        moved[start:stop] = apply_epoch(own, strength, counts, sums, params.update).weights
    return Codebook(codebook.kshape, moved)


@dataclass(frozen=True)
class Epoch:
    codebook: Codebook
    quantization_error: float


def run_epoch(
    rows: DataFrame, codebook: Codebook, params: SomParams, it: int, dist: np.ndarray | None = None, id_col: str = "doc_id"
) -> Epoch:
    """One epoch. ``dist`` is the whole node-by-node distance matrix, where it was formed."""
    size = params.n_nodes

    def collected(sent: Broadcast | None) -> np.ndarray:
        # one map-sized fetch
        packed = epoch_sums(rows, codebook, id_col, sent=sent).select(
            "node", F.concat(F.array(F.col("n").cast("double"), "qe"), "vec").alias("vec")
        )
        return mx.collect_matrix(packed, (size, codebook.width + 2), "node")

    if fits_broadcast(codebook.weights.nbytes):
        with mx.shared(rows.sparkSession, codebook.weights) as sent:
            found = collected(sent)
    else:
        found = collected(None)
    counts, errors, sums = found[:, 0], found[:, 1].sum(), found[:, 2:]
    total = counts.sum()
    return Epoch(_apply_by_blocks(codebook, params, it, counts, sums, dist), errors / total if total else float("nan"))


def distances(params: SomParams) -> np.ndarray | None:
    """Node-by-node distances of a map, unless they are too many to hold; epochs then form them in stretches."""
    if fits_broadcast(params.n_nodes**2 * 8):
        return grid.distance_matrix(params.kshape, params.topology)
    return None


@dataclass(frozen=True)
class SomModel:
    params: SomParams
    codebook: Codebook
    trace: tuple[tuple, ...]

    def trace_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.trace), TRACE_SCHEMA)

    @property
    def quantization_error(self) -> float | None:
        return self.trace[-1][3] if self.trace else None

    @property
    def n_iter(self) -> int:
        return len(self.trace)

    @property
    def converged(self) -> bool:
        """The schedule ran to its end, or the error settled before."""
        return self.n_iter == self.params.n_iter or self.params.tolerance is not None


def fit(
    rows: DataFrame,
    params: SomParams = SomParams(),
    width: int | None = None,
    k_init: Codebook | DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    id_col: str = "doc_id",
) -> SomModel:
    """Train a map: one Spark job per epoch over ``rows``, which should be a stored table.

    The error of an epoch is measured against the codebook before its update. With a tolerance the
    fit stops early once the error changes by less than that share.
    """
    width = mx.width_of(rows) if width is None else width
    codebook = initial_codebook(rows, width, params, k_init, id_col)
    dist = distances(params)
    trace, last = [], None
    for it in range(1, params.n_iter + 1):
        epoch = run_epoch(rows, codebook, params, it, dist, id_col)
        radius, rate, _, _ = grid.schedule(params, it)
        moved = float(np.linalg.norm(epoch.codebook.weights - codebook.weights))
        codebook = epoch.codebook
        error = float(epoch.quantization_error)
        trace.append((it, radius, rate, error, moved, float(np.linalg.norm(codebook.weights))))
        if params.tolerance is not None and last is not None and abs(last - error) <= params.tolerance * abs(last):
            break
        last = error
    if params.clip_below is not None:
        weights = codebook.weights
        codebook = Codebook(codebook.kshape, np.where(weights < params.clip_below, 0.0, weights))
    return SomModel(params, codebook, tuple(trace))


def hits(assigned: DataFrame, kshape: tuple[int, int]) -> DataFrame:
    """(node, hits) for every node of the map, zero where no row landed."""
    counted = assigned.groupBy("node").agg(F.count(F.lit(1)).alias("hits"))
    all_nodes = grid.nodes(assigned.sparkSession, kshape).select("node")
    return all_nodes.join(counted, "node", "left").na.fill(0, ["hits"])


def u_matrix(codebook: DataFrame, kshape: tuple[int, int]) -> DataFrame:
    """(node, u): mean cosine similarity of a node to its surrounding nodes."""
    units = codebook.select("node", vx.unit(F.col("vec")).alias("vec"))
    others = units.toDF("neighbour", "other_vec")
    pairs = grid.neighbours(codebook.sparkSession, kshape).join(units, "node").join(others, "neighbour")
    return pairs.groupBy("node").agg(F.avg(vx.dot(F.col("vec"), F.col("other_vec"))).alias("u"))


def projection(codebook: DataFrame, features: list[int] | None = None) -> DataFrame:
    """(node, p): mean of the chosen non-zero features of the unit-length node vector."""
    entries = codebook.select("node", F.posexplode(vx.unit(F.col("vec"))).alias("feature", "v"))
    if features is not None:
        entries = entries.where(F.col("feature").isin(features))
    means = entries.where(F.col("v") != 0).groupBy("node").agg(F.avg("v").alias("p"))
    return codebook.select("node").join(means, "node", "left")


def clip(codebook: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    return codebook.withColumn("vec", vx.clip_below(F.col("vec"), epsilon))


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """left - right for long-form sparse matrices (row, feature, v); zero results are dropped."""
    keys = ["row", "feature"]
    joined = left.select(*keys, F.col("v").alias("a")).join(right.select(*keys, F.col("v").alias("b")), keys, "full_outer")
    value = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return joined.select(*keys, value.alias("v")).where(F.col("v") != 0)
