"""Regions of a map: Ward agglomeration on the grid, k-means on vectors."""

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.functions import grid
from textmap.operators import som
from textmap.session import stage_observed

# Largest map that one task clusters; the size of a map does not depend on the corpus.
MAX_NODES = 10_000


def grid_edges(kshape: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of cells that share a side."""
    n_rows, n_cols = kshape
    across = [(x * n_cols + y, x * n_cols + y + 1) for x in range(n_rows) for y in range(n_cols - 1)]
    down = [(x * n_cols + y, (x + 1) * n_cols + y) for x in range(n_rows - 1) for y in range(n_cols)]
    return across + down


def ward_labels(vectors: np.ndarray, edges: Sequence[tuple[int, int]], n_clusters: int) -> np.ndarray:
    """Greedy Ward merges along ``edges`` until ``n_clusters`` are left; cut by merge count.

    A merge costs na * nb / (na + nb) * |ca - cb|^2. Equal costs go to the pair with the lowest
    nodes. Labels number the regions by their lowest node.
    """
    size = len(vectors)
    totals = {i: vectors[i].astype(float) for i in range(size)}
    counts = {i: 1 for i in range(size)}
    around: dict[int, set[int]] = {i: set() for i in range(size)}
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    # regions are named by their lowest node; an entry is stale once either side has grown
    version = {i: 0 for i in range(size)}

    def offer(a: int, b: int) -> tuple[float, int, int, int, int]:
        a, b = min(a, b), max(a, b)
        gap = totals[a] / counts[a] - totals[b] / counts[b]
        cost = counts[a] * counts[b] / (counts[a] + counts[b]) * float(gap @ gap)
        return (round(cost, 12), a, b, version[a], version[b])

    queue = [offer(a, b) for a, b in edges]
    heapq.heapify(queue)
    owner = np.arange(size)
    while len(totals) > n_clusters and queue:
        _, a, b, seen_a, seen_b = heapq.heappop(queue)
        if a not in totals or b not in totals or version[a] != seen_a or version[b] != seen_b:
            continue
        totals[a] = totals[a] + totals.pop(b)
        counts[a] += counts.pop(b)
        version[a] += 1
        owner[owner == b] = a
        joined = (around[a] | around.pop(b)) - {a, b}
        around[a] = joined
        for other in joined:
            around[other].discard(b)
            around[other].add(a)
            heapq.heappush(queue, offer(a, other))
    return np.unique(owner, return_inverse=True)[1]


def ward_regions(
    codebooks: DataFrame, kshape: tuple[int, int], n_clusters: int = 6, group_cols: Sequence[str] = ()
) -> DataFrame:
    """(group columns, node, cluster): every map in ``codebooks`` cut into connected regions.

    One task per map; many maps run side by side. A map is as large as its grid, whatever the corpus.
    """
    size = kshape[0] * kshape[1]
    if size > MAX_NODES:
        raise ValueError(f"a map of {size} nodes is over the limit of {MAX_NODES}")
    edges, keys = grid_edges(kshape), list(group_cols)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        if pdf["node"].tolist() != list(range(size)):
            raise ValueError(f"a map of {kshape} needs the nodes 0 .. {size - 1}")
        labels = ward_labels(np.array(pdf["vec"].tolist(), dtype=float), edges, n_clusters)
        return pdf[[*keys, "node"]].assign(cluster=labels.astype(np.int32))

    fields = [codebooks.schema[k] for k in keys]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + ["node int", "cluster int"])
    # without group columns there is one map, hence one group
    grouped = codebooks.select(F.lit(0).alias("_map"), *keys, F.col("node").cast("int").alias("node"), "vec")
    # an asked-for number of tasks, which small tables keep: each map's merges are work of their own
    tasks = int(codebooks.sparkSession.conf.get("spark.sql.shuffle.partitions")) if keys else 1
    return grouped.repartition(tasks, "_map", *keys).groupBy("_map", *keys).applyInPandas(cut, schema)


def kmeans(
    vectors: DataFrame, n_clusters: int = 6, id_col: str = "node", max_iter: int = 100, restarts: int = 10, seed: int = 0
) -> tuple[DataFrame, DataFrame, float]:
    """(labels, centres, inertia) of the best of several seeded k-means runs."""
    points = vectors.select(id_col, array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    best = None
    for run in range(restarts):
        model = KMeans(k=n_clusters, maxIter=max_iter, seed=seed + run, initMode="k-means||").fit(points)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    centres = vectors.sparkSession.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(best.clusterCenters())], "cluster int, vec array<double>"
    )
    labels = best.transform(points).select(id_col, F.col("prediction").alias("cluster"))
    return labels, centres, float(best.summary.trainingCost)


def _centres(centres: np.ndarray) -> som.Codebook:
    return som.Codebook((len(centres), 1), np.asarray(centres, dtype=float))


def nearest_centre(vectors: DataFrame, centres: np.ndarray, id_col: str = "node") -> DataFrame:
    """(id, cluster, d): the centre of least squared distance, the lowest cluster on ties."""
    rows = vectors.select(F.col(id_col).alias("_row"), "vec")
    found = som.predict(rows, _centres(centres), "_row", "euclid")
    return found.select(F.col("_row").alias(id_col), F.col("node").alias("cluster"), F.col("score").alias("d"))


def lloyd_step(vectors: DataFrame, centres: np.ndarray, id_col: str = "node") -> DataFrame:
    """(cluster, n, vec): the centres after one k-means step over all rows."""
    sums = som.epoch_sums(vectors, _centres(centres), id_col, "euclid")
    mean = F.transform("vec", lambda v: v / F.col("n"))
    return sums.select(F.col("node").alias("cluster"), "n", mean.alias("vec"))


@dataclass(frozen=True)
class Clusters:
    """``labels`` (id, cluster, d) stored, ``centres`` in their order, and what the last pass measured."""

    labels: DataFrame
    centres: np.ndarray
    inertia: float
    n_iter: int
    converged: bool


def lloyd(vectors: DataFrame, centres: np.ndarray, id_col: str = "node", max_iter: int = 100, tolerance: float = 1e-9) -> Clusters:
    """k-means from given centres, one grouped sum per step, until no centre moves by more than ``tolerance``.

    A centre without rows stays where it is. The inertia is taken while the labels are written.
    """
    converged, step = False, 0
    while step < max_iter and not converged:
        moved = centres.copy()
        found = lloyd_step(vectors, centres, id_col).select("cluster", "vec").toArrow()
        for cluster, vec in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            moved[cluster] = vec
        step += 1
        converged = bool(np.abs(moved - centres).max(initial=0.0) <= tolerance)
        centres = moved
    labels, seen = stage_observed(nearest_centre(vectors, centres, id_col), "labels", inertia=F.sum("d"))
    return Clusters(labels, centres, float(seen["inertia"] or 0.0), step, converged)


def document_clusters(assigned: DataFrame, node_clusters: DataFrame) -> DataFrame:
    """Add the region of each document's node."""
    return assigned.join(node_clusters.select("node", "cluster"), "node")


def with_coordinates(df: DataFrame, kshape: tuple[int, int]) -> DataFrame:
    n = F.col("node")
    return df.withColumn("x", grid.node_x(n, kshape[1])).withColumn("y", grid.node_y(n, kshape[1]))
