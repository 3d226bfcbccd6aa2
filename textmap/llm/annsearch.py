"""Nearest neighbours by cosine: multiprobe p-stable hashing and exact reranking.

Unit vectors are projected on Gaussian directions, shifted and cut into intervals; the intervals of a
few directions name the bucket in one table. A query visits its own bucket and the neighbouring ones (one interval up
or down in any direction) in the order of their estimated success, the sum of squared distances to the
intervals' borders. Buckets are compared with their visitors as blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmap.llm.vectors import matrix, units, usable
from textmap.llm.workers import mixed64
from textmap.session import stage

TABLES = 6
WIDTH = 1.5
SAMPLE = 64  # queries whose true neighbours are found by brute force to choose tables and probes
TARGET = 0.98  # share of those neighbours that the chosen probes must meet
BLOCK = 4096
SLACK = 1e-9


class Hashes:
    """The hash functions of all tables for vectors of one length."""

    def __init__(self, length: int, n_hashes: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((TABLES, n_hashes, length))
        self.shifts = rng.uniform(0, WIDTH, (TABLES, n_hashes))
        self.steps = np.array(list(product((0, -1, 1), repeat=n_hashes)), np.int64)

    def places(self, unit: np.ndarray, table: int) -> np.ndarray:
        return (unit @ self.directions[table].T + self.shifts[table]) / WIDTH

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        key = np.full(cells.shape[:-1], table + 1, np.uint64)
        for i in range(cells.shape[-1]):
            key = mixed64(key * np.uint64(0x9E3779B97F4A7C15) + cells[..., i].astype(np.int64).view(np.uint64))
        return key.view(np.int64)

    def own(self, unit: np.ndarray, table: int) -> np.ndarray:
        return self.keys(np.floor(self.places(unit, table)).astype(np.int64), table)

    def probes(self, unit: np.ndarray, table: int, n: int) -> np.ndarray:
        """Keys of the first ``n`` buckets to visit, likeliest first; a row per vector."""
        places = self.places(unit, table)
        cells = np.floor(places)
        down = places - cells
        cost = np.zeros((len(unit), len(self.steps)))
        for i in range(places.shape[1]):
            step = self.steps[:, i]
            cost += np.where(step < 0, down[:, i, None] ** 2, np.where(step > 0, (1 - down[:, i, None]) ** 2, 0.0))
        order = np.argsort(cost, axis=1, kind="stable")[:, :n]
        return self.keys(cells.astype(np.int64)[:, None, :] + self.steps[order], table)


def _scores(queries: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosine of each row pair; the same two vectors always give the same double."""
    a = queries / np.abs(queries).max(axis=1, keepdims=True)
    b = others / np.abs(others).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _best(q_rows, q_vectors, rows, ids, vectors, k: int):
    """(query row, row, vec_id, score) of the ``k`` nearest rows of a block for each query, ties to smaller ids."""
    found = []
    unit_q, unit_x = units(q_vectors), units(vectors)
    for start in range(0, len(q_rows), 512):
        part = slice(start, start + 512)
        rough = unit_q[part] @ unit_x.T
        rough[q_rows[part, None] == rows[None, :]] = -2
        if rough.shape[1] > k:
            limit = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k]
        else:
            limit = np.full(len(rough), -1.5)
        at_q, at_x = np.nonzero(rough >= np.maximum(limit, -1.5)[:, None] - SLACK)
        score = _scores(q_vectors[part][at_q], vectors[at_x])
        order = np.lexsort((rows[at_x], ids[at_x], -score, at_q))
        at_q, at_x, score = at_q[order], at_x[order], score[order]
        first = np.searchsorted(at_q, at_q)
        keep = np.arange(len(at_q)) - first < k
        found.append((q_rows[part][at_q[keep]], rows[at_x[keep]], ids[at_x[keep]], score[keep]))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


MATCH = "query_row long, row long, vec_id long, score double"


def _matches(columns) -> pa.Table:
    return pa.table(dict(zip(("query_row", "row", "vec_id", "score"), columns, strict=True)))


def _in_block(k: int):
    def compare(queries: pa.Table, members: pa.Table) -> pa.Table:
        if not queries.num_rows or not members.num_rows:
            return _matches([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())])
        return _matches(_best(
            queries.column("row").to_numpy(), matrix(queries.column("vector")),
            members.column("row").to_numpy(), members.column("vec_id").to_numpy(), matrix(members.column("vector")), k,
        ))

    return compare


def _against(q_rows: np.ndarray, q_vectors: np.ndarray, k: int):
    """Brute force of a few queries against the rows of a task."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _best(q_rows, q_vectors, batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2)), k)
                yield from _matches(found).to_batches()

    return compare


def _top(found: DataFrame, k: int) -> DataFrame:
    nearest = W.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    once = found.groupBy("query_row", "row").agg(F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _choose(vectors: DataFrame, queries: DataFrame, hashes: Hashes, keyed: DataFrame, k: int) -> tuple[int, int]:
    """The number of tables and probes that meet the target on the sample with the fewest comparisons."""
    sample = queries.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()
    if not sample:
        return 1, 1
    q_rows = np.array([r["row"] for r in sample])
    q_vectors = np.array([r["vector"] for r in sample])
    true = _top(vectors.mapInArrow(_against(q_rows, q_vectors, k), MATCH), k)
    true = true.join(vectors.select("row", "vector"), "row").select("query_row", "vector").collect()
    n_steps = len(hashes.steps)
    at = {row: i for i, row in enumerate(q_rows.tolist())}
    unit_q = units(q_vectors)
    probes = np.stack([hashes.probes(unit_q, t, n_steps) for t in range(TABLES)])
    spark = vectors.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in np.unique(probes)], "key long")
    sizes = {r["key"]: r["n"] for r in keyed.join(F.broadcast(wanted), "key").groupBy("key").agg(F.count("*").alias("n")).collect()}
    visited = np.vectorize(lambda x: sizes.get(int(x), 0), otypes=[np.int64])(probes).sum(axis=1).cumsum(axis=1)
    if not true:
        return 1, 1
    owner = np.array([at[r["query_row"]] for r in true])
    unit_x = units(np.array([r["vector"] for r in true]))
    needed = np.empty((TABLES, len(owner)))
    for t in range(TABLES):
        same = probes[t][owner] == hashes.own(unit_x, t)[:, None]
        needed[t] = np.where(same.any(axis=1), same.argmax(axis=1), np.inf)
    best = None
    for n_tables in range(1, TABLES + 1):
        least = np.sort(needed[:n_tables].min(axis=0))
        last = least[int(np.ceil(TARGET * len(least))) - 1]
        if np.isfinite(last):
            cost = visited[:n_tables, int(last)].sum()
            if best is None or cost < best[0]:
                best = (cost, n_tables, int(last) + 1)
    return (best[1], best[2]) if best else (TABLES, n_steps)


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found nearest to each row whose id is divisible by ``every``.

    All rows but the query's own are indexed; score is the cosine in double precision. Directions per table grow with
    the logarithm of the rows. A bounded sample of queries is answered by brute force, and the tables and probes are
    chosen so that the visited buckets hold 98 % of those true neighbours; the answers are approximate beyond.
    Large buckets and crowds of visitors are compared in blocks. A query whose visited buckets hold fewer than ``k``
    other rows visits all probes of all tables, and if they do not suffice all rows, so every query gets ``k`` rows or all.

    Rows with null, zero or broken vectors, or of another length than most, take no part; a null id is no query
    and loses ties. Repeated rows are candidates each for themselves. Fewer rows than ``k`` give all of them.
    """
    _, vectors, length = usable(embeddings, "ann", id_col, vector_col)
    vectors = stage(vectors, "ann-vectors")
    n = vectors.count()
    hashes = Hashes(max(1, length), max(2, min(8, round(np.log2(max(2, n)) / 4))))
    queries = vectors.where(F.col("vec_id") % every == 0)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = units(matrix(batch.column(1)))
            for t in range(TABLES if batch.num_rows else 0):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(unit), t, np.int32)), pa.array(hashes.own(unit, t))], ["row", "part", "key"]
                )

    keyed = stage(vectors.select("row", "vector").mapInArrow(keys, "row long, part int, key long"), "ann-keys")
    def searched(asked: DataFrame, n_tables: int, n_probes: int) -> DataFrame:
        """Matches of the ``asked`` queries in their visited buckets."""

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = units(matrix(batch.column(1)))
                for t in range(n_tables if batch.num_rows else 0):
                    found = hashes.probes(unit, t, n_probes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(batch.column(0).to_numpy(), found.shape[1])), pa.array(found.reshape(-1))], ["row", "key"]
                    )

        members = keyed.where(F.col("part") < n_tables).select("row", "key")
        return _met(vectors, stage(asked.select("row", "vector").mapInArrow(visits, "row long, key long"), "ann-visits"), members, k)

    top = stage(_top(searched(queries, *_choose(vectors, queries, hashes, keyed, k)), k), "ann-top")
    # queries whose buckets held too few rows visit all probes of all tables, then all rows
    for last in (False, True):
        known = top.groupBy("query_row").agg(F.count("*").alias("known"))
        short = queries.join(known, F.col("row") == F.col("query_row"), "left").where(F.coalesce("known", F.lit(0)) < min(k, n - 1))
        short = stage(short.select("row", "vector"), "ann-short")
        if short.isEmpty():
            break
        if last:
            one = F.lit(0).cast("long").alias("key")
            more = _met(vectors, short.select("row", one), vectors.select("row", one), k)
        else:
            more = searched(short, TABLES, len(hashes.steps))
        others = top.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti")
        top = stage(others.unionByName(_top(more, k)), "ann-top")
    named = vectors.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return top.join(named, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _met(vectors: DataFrame, visitors: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Matches of visitors (row, key) with the members (row, key) of their buckets, compared in blocks of bounded size."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    cut = stage(blocks(members, "m").join(blocks(visitors, "v"), "key"), "ann-blocks")

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        spread = df.join(cut, "key").select(
            "row", "key", F.pmod(F.xxhash64("row"), F.col(own)).cast("int").alias(f"block_{own}"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"block_{other}"),
        )
        known = vectors.select(*[F.col(c).alias(c) for c in vectors.columns])
        full = spread.join(known, "row")
        return full.select(*[F.col(c).alias(c) for c in ("key", "block_m", "block_v", "row", "vec_id", "vector")])

    where = ["key", "block_m", "block_v"]
    return placed(visitors, "v", "m").groupBy(*where).cogroup(placed(members, "m", "v").groupBy(*where)).applyInArrow(_in_block(k), MATCH)
