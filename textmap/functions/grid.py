"""Map grid: node numbers, coordinates, distances. Row-major: node = x * columns + y."""

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.params import SomParams


# The last radius is one cell by design; rounding must not decide whether that cell is inside.
EDGE = 1e-9


def node_x(node: Column, n_cols: int) -> Column:
    return F.floor(node / F.lit(n_cols)).cast("int")


def node_y(node: Column, n_cols: int) -> Column:
    return (node % F.lit(n_cols)).cast("int")


def nodes(spark: SparkSession, kshape: tuple[int, int]) -> DataFrame:
    n = F.col("id")
    return spark.range(kshape[0] * kshape[1], numPartitions=1).select(
        n.cast("int").alias("node"), node_x(n, kshape[1]).alias("x"), node_y(n, kshape[1]).alias("y")
    )


def node_pairs(spark: SparkSession, kshape: tuple[int, int], topology: str = "rect") -> DataFrame:
    """Every (node, other) pair of the grid with its distance; numbered, not joined."""
    size, n_cols = kshape[0] * kshape[1], kshape[1]
    a, b = F.floor(F.col("id") / F.lit(size)), F.col("id") % F.lit(size)
    pairs = spark.range(size * size).select(a.cast("int").alias("node"), b.cast("int").alias("other"))
    dist = distance(
        node_x(F.col("node"), n_cols), node_y(F.col("node"), n_cols),
        node_x(F.col("other"), n_cols), node_y(F.col("other"), n_cols), kshape, topology,
    )
    return pairs.withColumn("distance", dist)


def neighbours(spark: SparkSession, kshape: tuple[int, int], radius: int = 1) -> DataFrame:
    """(node, neighbour): the cells within ``radius`` in both directions, the node itself left out."""
    steps = F.array(*[F.lit(s) for s in range(-radius, radius + 1)])
    moved = (
        nodes(spark, kshape)
        .withColumn("dx", F.explode(steps))
        .withColumn("dy", F.explode(steps))
        .where((F.col("dx") != 0) | (F.col("dy") != 0))
        .select("node", (F.col("x") + F.col("dx")).alias("nx"), (F.col("y") + F.col("dy")).alias("ny"))
        .where(F.col("nx").between(0, kshape[0] - 1) & F.col("ny").between(0, kshape[1] - 1))
    )
    return moved.select("node", (F.col("nx") * kshape[1] + F.col("ny")).cast("int").alias("neighbour"))


def _half(value: Column) -> Column:
    """Half of a whole number, cut towards zero."""
    return F.call_function("div", value.cast("long"), F.lit(2))


def to_hex(i: Column, j: Column) -> tuple[Column, Column]:
    """Array cell (i, j) in the hexagonal frame: the j steps are shared out to both axes."""
    return (i - _half(j)).cast("int"), (i + j - _half(j)).cast("int")


def from_hex(hx: Column, hy: Column) -> tuple[Column, Column]:
    return _half(hx + hy).cast("int"), (hy - hx).cast("int")


def hex_distance(dx: Column, dy: Column) -> Column:
    """Steps between two hexagons whose frame coordinates differ by (dx, dy)."""
    ax, ay = F.abs(dx), F.abs(dy)
    # signs are compared, not multiplied: the product of two whole numbers may not fit
    alike = ((dx >= 0) & (dy >= 0)) | ((dx <= 0) & (dy <= 0))
    return F.when(alike, F.greatest(ax, ay)).otherwise(ax + ay)


def distance(
    x1: Column, y1: Column, x2: Column, y2: Column, kshape: tuple[int, int], topology: str = "rect"
) -> Column:
    if topology == "hex":
        ax, ay = to_hex(x1, y1)
        bx, by = to_hex(x2, y2)
        return hex_distance(bx - ax, by - ay).cast("double")
    dx, dy = F.abs(x1 - x2), F.abs(y1 - y2)
    if topology == "torus":
        dx, dy = F.least(dx, F.lit(kshape[0]) - dx), F.least(dy, F.lit(kshape[1]) - dy)
    elif topology != "rect":
        raise ValueError(f"unknown topology: {topology}")
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def distance_matrix(kshape: tuple[int, int], topology: str) -> np.ndarray:
    """Node-by-node distances for the driver's codebook update; grid-sized."""
    return distance_block(kshape, topology, 0, kshape[0] * kshape[1])


def distance_block(kshape: tuple[int, int], topology: str, start: int, stop: int) -> np.ndarray:
    """Distances of the nodes ``start`` to ``stop`` - 1 to all nodes."""
    x, y = np.divmod(np.arange(kshape[0] * kshape[1]), kshape[1])
    if topology == "hex":
        hx, hy = x - y // 2, x + (y + 1) // 2
        dx, dy = hx[start:stop, None] - hx, hy[start:stop, None] - hy
        ax, ay = np.abs(dx), np.abs(dy)
        return np.where(dx * dy >= 0, np.maximum(ax, ay), ax + ay).astype(float)
    dx, dy = np.abs(x[start:stop, None] - x), np.abs(y[start:stop, None] - y)
    if topology == "torus":
        dx, dy = np.minimum(dx, kshape[0] - dx), np.minimum(dy, kshape[1] - dy)
    elif topology != "rect":
        raise ValueError(f"unknown topology: {topology}")
    return np.sqrt((dx * dx + dy * dy).astype(float))


def schedule(params: SomParams, it: int) -> tuple[float, float, float, int]:
    """(radius, rate, width, power) of epoch ``it``, counted from 1.

    The influence at distance d is rate * exp(-d**power / width) up to the radius, zero beyond.
    """
    span = max(params.kshape) if params.decay == "sparse" else min(params.kshape)
    # a span of one cell has no decay: ln(1) = 0 would put the time scale at infinity
    fade = math.exp(-it * math.log(span) / params.n_iter)
    radius = span * fade
    if params.decay == "default":
        return radius, params.learning_rate * fade, 2 * radius**2, 2
    if params.decay == "sparse":
        return radius, params.learning_rate * fade, 2 * radius * it, 1
    if params.decay == "sigma":
        part = it / params.n_iter
        start, end = math.sqrt(params.n_nodes), 0.2
        sigma = start * (end / start) ** part
        return radius, params.learning_rate * 0.05**part, sigma**2, 2
    raise ValueError(f"unknown decay: {params.decay}")


def influence(dist: Column, params: SomParams, it: int) -> Column:
    radius, rate, width, power = schedule(params, it)
    value = F.lit(rate) * F.exp(-F.pow(dist, F.lit(float(power))) / F.lit(width))
    return F.when(dist <= F.lit(radius + EDGE), value).otherwise(F.lit(0.0))


def influence_matrix(dist: np.ndarray, params: SomParams, it: int) -> np.ndarray:
    radius, rate, width, power = schedule(params, it)
    return np.where(dist <= radius + EDGE, rate * np.exp(-(dist**power) / width), 0.0)
