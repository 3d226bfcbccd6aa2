"""Near duplicates of vectors by refining a neighbour graph (NN-descent)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmap.llm.components import components
from textmap.llm.vectors import matrix, units, usable
from textmap.session import stage

NEIGHBOURS = 10
TREES = 4
LEAF = 64
ROUNDS = 6
SETTLED = 0.002  # share of list entries that a round may still change when the descent ends
ENLARGED = 2  # how often full lists are doubled
ATTEMPTS = 3
LARGE = 64  # nodes of a component that the audit counts by itself
SAMPLE = (256, 64, 64)  # audited nodes: alone, in small and in large components
TARGET = 0.95
BLOCK = 256
ROUGH = 0.02  # bound of the error of cosines of one-byte codes
CENTRES = 256


def _coded(unit: np.ndarray) -> list[bytes]:
    """Unit vectors as a scale and one signed byte per part."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale.astype("<f4"), codes, strict=True)]


def _decoded(column) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view("<f4")
    return np.ascontiguousarray(raw[:, 4:]).view(np.int8).astype(np.float32) * scale


EDGE = "node long, other long, near float"


def _edges(node, other, near) -> pa.Table:
    return pa.table({
        "node": pa.array(np.asarray(node), pa.int64()), "other": pa.array(np.asarray(other), pa.int64()),
        "near": pa.array(np.asarray(near), pa.float32()),
    })


def _leaf_edges(table: pa.Table) -> pa.Table:
    nodes, unit = table.column("node").to_numpy(), _decoded(table.column("code"))
    if len(nodes) < 2:
        return _edges([], [], [])
    near = unit @ unit.T
    np.fill_diagonal(near, -2)
    k = min(NEIGHBOURS, len(nodes) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    at = np.repeat(np.arange(len(nodes)), k)
    return _edges(nodes[at], nodes[best.reshape(-1)], near[at, best.reshape(-1)])


def _joined(table: pa.Table) -> pa.Table:
    """Pairs of members of each centre that are nearer than the worst entry of a member's list."""
    centre = table.column("centre").to_numpy()
    order = np.argsort(centre, kind="stable")
    centre = centre[order]
    nodes, worst = table.column("node").to_numpy()[order], table.column("worst").to_numpy()[order]
    unit = _decoded(table.column("code"))[order]
    found = [[], [], []]
    bounds = np.concatenate([[0], np.nonzero(np.diff(centre))[0] + 1, [len(centre)]])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        near = unit[a:b] @ unit[a:b].T
        np.fill_diagonal(near, -2)
        i, j = np.nonzero(near > worst[a:b, None])
        for column, values in zip(found, (nodes[a + i], nodes[a + j], near[i, j]), strict=True):
            column.append(values)
    return _edges(*[np.concatenate(c) if c else [] for c in found])


def _lists(edges: DataFrame, room: DataFrame | None, name: str) -> DataFrame:
    """The nearest entries of each node: as many as it has room for. All of it happens where the edges of the node lie."""
    once = edges.repartition("node").groupBy("node", "other").agg(F.max("near").alias("near"))
    return stage(_nearest_of(once, room), name)


def _next_lists(before: DataFrame, found: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The lists after a round, and how many of their entries it found; these are counted while they are written."""
    edges = before.withColumn("fresh", F.lit(1)).unionByName(found.withColumn("fresh", F.lit(2)))
    once = edges.repartition("node").groupBy("node", "other").agg(F.max("near").alias("near"), F.min("fresh").alias("fresh"))
    seen = Observation(name)
    kept = _nearest_of(once, None).observe(seen, F.count(F.when(F.col("fresh") == 2, 1)).alias("changed"))
    lists = stage(kept.drop("fresh"), name)
    return lists, seen.get["changed"]


def _nearest_of(once: DataFrame, room: DataFrame | None) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.col("near").desc(), "other"))
    ranked = once.withColumn("rank", rank)
    if room is None:
        return ranked.where(F.col("rank") <= NEIGHBOURS).drop("rank")
    roomy = ranked.join(room, "node", "left")
    return roomy.where(F.col("rank") <= F.coalesce("room", F.lit(NEIGHBOURS))).select("node", "other", "near")


def _descend(lists: DataFrame, codes: DataFrame, room: DataFrame | None, only: DataFrame | None, n_groups: int) -> DataFrame:
    """One round: members of each node's list and of those that list it meet one another."""
    kept = F.coalesce("room", F.lit(NEIGHBOURS)) if room is not None else F.lit(NEIGHBOURS)
    back = lists.select(F.col("other").alias("centre"), "node", "near")
    if room is not None:
        back = back.join(room.withColumnRenamed("node", "centre"), "centre", "left")
    rank = F.row_number().over(W.partitionBy("centre").orderBy(F.col("near").desc(), "node"))
    back = back.withColumn("rank", rank).where(F.col("rank") <= kept).select("centre", "node")
    ahead = lists.select(F.col("node").alias("centre"), F.col("other").alias("node"))
    own = ahead.select("centre", F.col("centre").alias("node"))
    members = ahead.unionByName(back).unionByName(own)
    if only is not None:
        members = members.join(only.withColumnRenamed("node", "centre"), "centre", "left_semi")
    members = members.repartition("node").distinct()  # lie where the join below needs them
    full = lists.groupBy("node").agg(F.min("near").alias("worst"), F.count("*").alias("n"))
    if room is not None:
        full = full.join(room, "node", "left")
    worst = full.select("node", F.when(F.col("n") >= kept, F.col("worst")).otherwise(F.lit(-1.5)).cast("float").alias("worst"))
    known = codes.join(worst, "node", "left").select("node", "code", F.coalesce("worst", F.lit(-1.5)).cast("float").alias("worst"))
    met = members.join(known, "node").withColumn("part", F.pmod(F.xxhash64("centre"), F.lit(n_groups)))
    return met.groupBy("part").applyInArrow(_joined, EDGE)


def _sampled_links(units_of: np.ndarray, rows: np.ndarray, components_of: np.ndarray, threshold: float):
    """Per sampled row: how many of a batch it is linked with, and how many of these are of its component."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, component = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                linked = (units_of @ units(matrix(batch.column(1))).T >= threshold) & (rows[:, None] != node[None, :])
                met = linked & (components_of[:, None] == component[None, :])
                held = [pa.array(x, pa.int64()) for x in (rows, linked.sum(axis=1), met.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(held, ["a", "links", "met"])

    return compare


def _recall(sampled: list[tuple[int, int, int]], totals: dict[int, int]) -> float | None:
    """From (layer, links, met) of sampled nodes the least share of met links: in large components, in all others.

    A node counts once however many links it has, and as often as its layer was thinned. None without a link.
    """
    held = {layer: sum(1 for x in sampled if x[0] == layer) for layer in totals}
    shares = []
    for layers in ((0, 1), (2,)):
        rows = [(totals[layer] / held[layer], met / links) for layer, links, met in sampled if layer in layers and links]
        if rows:
            shares.append(sum(w * share for w, share in rows) / sum(w for w, _ in rows))
    return min(shares, default=None)


def _audit(found: DataFrame, nodes: DataFrame, threshold: float, attempt: int) -> float | None:
    """The share of true links that lie within components, on nodes drawn by the size of their component."""
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    layer = F.when(F.col("n").isNull(), 0).when(F.col("n") <= LARGE, 1).otherwise(2)
    named = found.join(sizes, "component").select("node", "component", "n")
    placed = stage(
        nodes.select("node").join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"), layer.alias("layer")),
        "nnd-audit",
    )
    totals = {r["layer"]: r["count"] for r in placed.groupBy("layer").count().collect()}
    drawn = [
        r for k in totals for r in placed.where(F.col("layer") == k).orderBy(F.xxhash64("node", F.lit(attempt)), "node").limit(SAMPLE[k]).collect()
    ]
    of = {r["node"]: r for r in drawn}
    sample = nodes.where(F.col("node").isin(list(of))).select("node", "vector").collect()
    picked = np.array([r["node"] for r in sample], np.int64)
    own = np.array([of[r["node"]]["component"] for r in sample], np.int64)
    seen = units(np.array([r["vector"] for r in sample]))
    compared = nodes.select("node", "vector").join(placed, "node").select("node", "vector", "component")
    counts = compared.mapInArrow(_sampled_links(seen, picked, own, threshold), "a long, links long, met long")
    sums = counts.groupBy("a").agg(F.sum("links").alias("links"), F.sum("met").alias("met")).collect()
    return _recall([(of[r["a"]]["layer"], r["links"], r["met"]) for r in sums], totals)


def _confirmed(threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (units(matrix(batch.column(2))) * units(matrix(batch.column(3)))).sum(axis=1)
                keep = pa.array(near >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return check


def _block_counts(threshold: float):
    """How many rows each node of two blocks is linked with, across the blocks or within the one."""

    def count(table: pa.Table) -> pa.Table:
        node, group, block = (table.column(c).to_numpy() for c in ("node", "component", "block"))
        copies = table.column("copies").to_numpy().astype(np.float64)
        unit = units(matrix(table.column("vector")))
        linked = (unit @ unit.T >= threshold) & (group[:, None] == group[None, :])
        np.fill_diagonal(linked, False)
        if block.min() != block.max():
            linked &= block[:, None] != block[None, :]
        return pa.table({"node": node, "links": (linked @ copies).astype(np.int64)})

    return count


BALL = "component long, block int, centre array<double>, radius double"


def _ball(table: pa.Table) -> pa.Table:
    """The middle of a block and the largest angle between it and a member."""
    unit = units(matrix(table.column("vector")))
    centre = unit.mean(axis=0)
    size = np.linalg.norm(centre)
    centre = centre / size if size > 1e-9 else unit[0]
    radius = float(np.arccos(np.clip(unit @ centre, -1, 1).min()))
    kinds = pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64()
    first = table.column("component")[0].as_py(), table.column("block")[0].as_py()
    return pa.table([pa.array([x], k) for x, k in zip((*first, centre, radius), kinds, strict=True)], ["component", "block", "centre", "radius"])


def _near_balls(threshold: float):
    """Pairs of balls of two components that can hold a link: angles obey the triangle inequality."""

    def compare(table: pa.Table) -> pa.Table:
        component, block, chunk, radius = (table.column(c).to_numpy() for c in ("component", "block", "chunk", "radius"))
        centre = matrix(table.column("centre"))
        reach = radius[:, None] + radius[None, :] + np.arccos(threshold) + 1e-6
        asked = (component[:, None] < component[None, :]) & (np.arccos(np.clip(centre @ centre.T, -1, 1)) <= reach)
        if chunk.min() != chunk.max():
            asked &= chunk[:, None] != chunk[None, :]
        i, j = np.nonzero(asked)
        return pa.table({"component": component[i], "block": block[i], "component_2": component[j], "block_2": block[j]})

    return compare


def _nearest_link(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        unit = units(matrix(table.column("vector")))
        near = unit[side == 0] @ unit[side == 1].T
        i, j = np.unravel_index(near.argmax(), near.shape)
        found = near[i, j] >= threshold
        ends = ([node[side == 0][i]], [node[side == 1][j]]) if found else ([], [])
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    return compare


def _crossed(dense: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame | None:
    """Links (a, b) that connect all components of ``dense`` (node, component) which any link between its nodes joins.

    Exact: the nodes of a component are cut into blocks, and any two blocks of different components that are not too
    far apart for a link are compared. Each two blocks give one link at most.
    """
    dense = stage(dense, "nnd-dense")
    sizes = dense.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    if sizes.limit(2).count() < 2:
        return None
    cut = dense.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = stage(cut.join(nodes.select("node", "vector"), "node").select("component", "block", "node", "vector"), "nnd-blocks")
    balls = stage(held.groupBy("component", "block").applyInArrow(_ball, BALL), "nnd-balls")
    chunks = -(-balls.count() // BLOCK)
    placed = balls.withColumn("chunk", F.pmod(F.xxhash64("component", "block"), F.lit(chunks)).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn(
        "low", F.least("chunk", "other")
    ).withColumn("high", F.greatest("chunk", "other"))
    near = met.groupBy("low", "high").applyInArrow(_near_balls(threshold), "component long, block int, component_2 long, block_2 int")
    near = stage(near, "nnd-near")
    key = ["component", "block", "component_2", "block_2"]
    left = near.join(held, ["component", "block"]).select(*key, "node", "vector", F.lit(0).alias("side"))
    other = held.select(F.col("component").alias("component_2"), F.col("block").alias("block_2"), "node", "vector")
    right = near.join(other, ["component_2", "block_2"]).select(*key, "node", "vector", F.lit(1).alias("side"))
    return left.unionByName(right).groupBy(*key).applyInArrow(_nearest_link(threshold), "a long, b long")


def _merged(found: DataFrame, links: DataFrame | None) -> DataFrame:
    """``found`` (node, component) with further links."""
    if links is None:
        return found
    edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    return stage(components(edges, "nnd-merged"), "nnd-found")


def near_vectors(
    embeddings: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept, audit_recall.

    Equal vectors are one node. Lists of 10 neighbours start from the leaves of four random-hyperplane trees and
    are refined by joining the neighbours of neighbours, on codes of one byte per part, until a round changes few
    entries. Nodes whose list is full of links get lists of twice, then four times the room. Entries near the
    threshold are confirmed in double precision; they span the components. Last, lists are enlarged to the
    whole component: its blocks are compared with one another, so that every link within a component counts and no
    pair becomes a row. Components with lists that are still full are compared with one another in blocks, exactly,
    unless the angles between the blocks exclude a link. The links of bounded samples of nodes, drawn apart from nodes
    alone, in small and in large components, are found by brute force; while less than 95 % of a node's links
    lie within its component, on the mean of large or of all other components, the descent runs again from more trees, at
    most three times, and then all blocks are compared. The last of these shares, the lesser one, is
    ``audit_recall`` (null if no sampled node has a link).

    Vectors that are null, zero, not finite or of another length than most are linked with nothing. A
    component's id is the smallest id in it; null ids count as larger than all.
    """
    rows, vectors, length = usable(embeddings, "nnd", id_col, vector_col)
    vectors = stage(vectors.select("row", "vec_id", "vector"), "nnd-vectors")
    nodes = stage(
        vectors.groupBy("vector").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id")),
        "nnd-nodes",
    )
    n = nodes.count()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_coded(units(matrix(batch.column(1)))))], ["node", "code"])

    codes = stage(nodes.select("node", "vector").mapInArrow(code, "node long, code binary"), "nnd-codes")
    n_groups = max(1, -(-n // CENTRES))
    lists = found = None
    recall = None
    for attempt in range(ATTEMPTS if n > 1 else 0):
        lists, full = _graph(codes, lists, length, n, n_groups, threshold, attempt)
        pairs = lists.where(F.col("near") >= threshold - ROUGH).select(
            F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
        ).distinct()
        both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a").join(
            nodes.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b"
        )
        links = both.select("a", "b", "va", "vb").mapInArrow(_confirmed(threshold), "a long, b long")
        found = stage(components(links, "nnd"), "nnd-found")
        # a full list can lack links to another dense component
        found = _merged(found, _crossed(found.join(full, "node").select("node", "component"), nodes, threshold))
        recall = _audit(found, nodes, threshold, attempt)
        if recall is None or recall >= TARGET:
            break
    else:
        if found is not None:  # the descent does not reach the target: whatever can hold a link is compared
            everyone = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
            found = _merged(found, _crossed(everyone, nodes, threshold))
            recall = _audit(found, nodes, threshold, ATTEMPTS)
    if found is None:
        counted = nodes.select("node", F.col("node").alias("component"), F.lit(0).cast("long").alias("links"))
    else:
        counted = _counted(found, nodes, threshold)
    whole = nodes.select("node", "vector", "copies", "first_id").join(counted, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    smallest = whole.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = whole.join(smallest, "component").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = vectors.join(known, "vector").select("row", "n_links", "component_id")
    out = rows.join(linked, "row", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("vec_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
        F.lit(recall).cast("double").alias("audit_recall"),
    )


def _graph(codes: DataFrame, lists: DataFrame | None, length: int, n: int, n_groups: int, threshold: float, attempt: int):
    """Neighbour lists from random trees, refined by descent, enlarged where full of links; the nodes still full."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / LEAF)))))
    planes = np.random.default_rng(7 + attempt).standard_normal((TREES, bits, length)).astype(np.float32)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            unit = _decoded(batch.column(1)) if batch.num_rows else None
            for tree in range(TREES if batch.num_rows else 0):
                leaf = (unit @ planes[tree].T > 0).astype(np.int64) @ powers + (tree << 40)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], ["node", "code", "leaf"])

    placed = stage(codes.mapInArrow(leaves, "node long, code binary, leaf long"), "nnd-leaves")
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / (4 * LEAF)).alias("parts"))
    split = placed.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("node", "leaf", F.lit(attempt)), F.col("parts")))
    start = split.groupBy("leaf", "part").applyInArrow(_leaf_edges, EDGE)
    lists = _lists(start if lists is None else lists.unionByName(start), None, "nnd-lists")
    for _ in range(ROUNDS):
        lists, changed = _next_lists(lists, _descend(lists, codes, None, None, n_groups), "nnd-lists")
        if changed <= SETTLED * NEIGHBOURS * n:
            break
    room, size = None, NEIGHBOURS
    linked = F.count(F.when(F.col("near") >= threshold - ROUGH, 1))
    for _ in range(ENLARGED):
        full = lists.groupBy("node").agg(linked.alias("n")).where(F.col("n") >= size).select("node")
        full = stage(full, "nnd-full")
        if full.isEmpty():
            break
        size *= 2
        grown = full.select("node", F.lit(size).alias("room"))
        room = grown if room is None else grown.unionByName(room).groupBy("node").agg(F.max("room").alias("room"))
        room = stage(room, "nnd-room")
        lists = _lists(lists.unionByName(_descend(lists, codes, room, full, n_groups)), room, "nnd-lists")
    held = lists.groupBy("node").agg(linked.alias("n"))
    if room is None:
        return lists, held.where(F.col("n") >= NEIGHBOURS).select("node")
    return lists, held.join(room, "node", "left").where(F.col("n") >= F.coalesce("room", F.lit(NEIGHBOURS))).select("node")


def _counted(found: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, component, links): every node of a component compared with all others of it."""
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    # small components share tasks; a large one is cut into blocks that meet in pairs
    small = F.pmod(F.xxhash64("component"), F.lit(4096))
    held = found.join(sizes, "component").select(
        "node", "component",
        F.when(F.col("n") <= BLOCK // 4, -1 - small).otherwise(F.col("component")).alias("crowd"),
        F.when(F.col("n") <= BLOCK // 4, F.lit(1)).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks"),
    )
    shared = held.where("crowd < 0").groupBy("crowd").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("long").alias("parts"))
    held = held.join(shared, "crowd", "left").withColumn(
        "part", F.when(F.col("crowd") < 0, F.pmod(F.xxhash64("component", F.lit(1)), F.col("parts"))).otherwise(F.lit(0))
    ).withColumn("block", F.when(F.col("crowd") < 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int"))
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "crowd", "part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component"
    )
    full = met.join(nodes.select("node", "vector", "copies"), "node")
    counts = full.groupBy("crowd", "part", "low", "high").applyInArrow(_block_counts(threshold), "node long, links long")
    return found.join(counts.groupBy("node").agg(F.sum("links").alias("links")), "node")
