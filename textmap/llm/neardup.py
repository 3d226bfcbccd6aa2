"""Near duplicates by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.llm.components import components
from textmap.llm.workers import mixed64, worker_cache
from textmap.session import fits_broadcast, stage

SHINGLE = 5
COORDINATES = 180
MISSED = 1e-6  # probability that a pair on the limit shares no band
CACHED_WORDS = 200_000
BATCH_SHINGLES = 400_000
CROWD = 16  # classes left in a band that are compared pair by pair; more are compared in blocks
BLOCK = 128
COLUMNS = 4096
HASHED_ROW = 128  # bytes of a short row in a broadcast table


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of ``text``.

    Words are runs of bytes other than blank, tab to carriage return; A-Z count as a-z. A text of fewer
    words is one shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    for i in range(width):
        mixed = mixed64(mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n])
    return np.unique(mixed)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``COORDINATES`` values per non-empty set.

    Round i throws every element into the bin that its i-th hash names; a bin still empty before the round keeps
    the least value thrown into it. The first t rounds choose bins at random, the next t rounds fill bin
    i - t from all elements, so every coordinate is filled after 2 t rounds at most.
    """
    t = COORDINATES
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    kept = np.full(len(sets) * t, top, np.uint64)
    empty = np.ones(len(sets) * t, bool)
    for i in range(2 * t):
        hashed = mixed64(values + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        bins = (hashed >> np.uint64(32)) % np.uint64(t) if i < t else np.full(len(values), i - t, np.uint64)
        cell = owner * t + bins.astype(np.int64)
        thrown = empty[cell]
        cell, fresh = cell[thrown], mixed64(hashed[thrown])
        np.minimum.at(kept, cell, fresh)
        empty[cell] = False
        unfilled = empty.reshape(-1, t).any(axis=1)
        if not unfilled.any():
            break
        stay = unfilled[owner]
        if not stay.all():
            values, owner = values[stay], owner[stay]
    return kept.reshape(-1, t)


def rows_of_band(percent: int) -> int:
    """The most coordinates that a band may have: at 85 six (7e-7), at 80 five (6e-7)."""
    fitting = [r for r in range(1, COORDINATES + 1) if COORDINATES % r == 0 and (1 - (percent / 100) ** r) ** (COORDINATES // r) <= MISSED]
    return max(fitting, default=1)


def band_keys(sketches: np.ndarray, size: int) -> np.ndarray:
    bands = COORDINATES // size
    parts = sketches.reshape(len(sketches), bands, size)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(size):
        keys = mixed64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys.view(np.int64) if keys.flags.c_contiguous else np.ascontiguousarray(keys).view(np.int64)


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    import xxhash

    raw = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


SIGNATURE = "doc_id long, row long, n long, d1 long, d2 long, bands array<long>"


def _signatures(size: int):
    """Sizes, digests and band keys of texts; a band has ``size`` coordinates."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("near").setdefault("words", _WordHashes())
        types = [pa.int64()] * 5 + [pa.list_(pa.int64())]
        names = ["doc_id", "row", "n", "d1", "d2", "bands"]

        def flushed(ids, rows, sets):
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(sketch(full), size)) if full else iter(())
            digests = [digest(s) for s in sets]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(column, kind)
                    for column, kind in zip(
                        (ids, rows, [len(s) for s in sets], [d[0] for d in digests], [d[1] for d in digests],
                         [next(keys) if len(s) else None for s in sets]),
                        types, strict=True,
                    )
                ],
                names,
            )

        for batch in batches:
            ids, rows, sets, held = [], [], [], 0
            for doc_id, row, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                shingles = shingle_set(text.as_py(), hashes)
                ids.append(doc_id.as_py()), rows.append(row.as_py()), sets.append(shingles)
                held += len(shingles)
                if held >= BATCH_SHINGLES:
                    yield flushed(ids, rows, sets)
                    ids, rows, sets, held = [], [], [], 0
            if ids:
                yield flushed(ids, rows, sets)

    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of wanted texts; rows of a wanted id with another text are left out."""
    hashes = worker_cache("near").setdefault("words", _WordHashes())
    for batch in batches:
        nodes, sets = [], []
        for text, node, d1, d2 in zip(*(batch.column(i) for i in range(4)), strict=True):
            shingles = shingle_set(text.as_py(), hashes)
            if digest(shingles) == (d1.as_py(), d2.as_py()):
                nodes.append(node.as_py()), sets.append(shingles.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def _shingle_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """(node, shingles) of the ``wanted`` nodes, made again from the text of one document of each class."""
    wanted = stage(
        classes.join(wanted, "node").select(F.col("first_doc").alias("wanted_doc"), "node", "d1", "d2"), f"{name}-wanted"
    )
    if fits_broadcast(wanted.count() * HASHED_ROW):
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_doc"))).select("text", "node", "d1", "d2")
    return stage(texts.mapInArrow(_sets, "node long, shingles array<long>").dropDuplicates(["node"]), f"{name}-sets")


def _block_links(percent: int):
    """Compares two blocks of classes at once; gives as many links as connect what belongs together."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, apart, block = (table.column(c).to_numpy() for c in ("node", "component", "block"))
        lists = table.column("shingles").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        owner = np.repeat(np.arange(len(nodes)), lengths)
        values, column, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
        by_column = np.argsort(column, kind="stable")
        owner, column = owner[by_column], column[by_column]
        common = np.zeros((len(nodes), len(nodes)), np.float32)
        n_columns = int(column[-1]) + 1 if len(column) else 0
        for start in range(0, n_columns, COLUMNS):
            part = slice(*np.searchsorted(column, [start, start + COLUMNS]))
            held = np.zeros((len(nodes), COLUMNS), np.float32)
            held[owner[part], column[part] - start] = 1
            common += held @ held.T
        union = lengths[:, None] + lengths[None, :] - common
        first, last = block.min(), block.max()
        asked = (nodes[:, None] < nodes[None, :]) & (apart[:, None] != apart[None, :])
        if first != last:
            asked &= block[:, None] != block[None, :]
        left, right = np.nonzero(asked & (common * 100 >= union * percent))
        parent = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        links = []
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            x, y = root(apart[a]), root(apart[b])
            if x != y:
                parent[x] = y
                links.append((nodes[a], nodes[b]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return compare


def _crowd_links(crowd: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links within crowds: (node, component, first) says which nodes share a full band.

    Crowds that share nodes are one group. A group is cut into blocks of about ``BLOCK`` nodes by hash, and
    every two blocks meet in one task, so no row is made per pair.
    """
    groups = stage(components(crowd.select(F.col("node").alias("a"), F.col("first").alias("b")), "near-crowds"), "near-crowd")
    if groups.isEmpty():
        return groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sets = _shingle_sets(groups.select("node"), classes, docs, "near-crowd")
    placed = (
        groups.join(sizes, "component").withColumnRenamed("component", "crowd")
        .join(crowd.select("node", "component").distinct(), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "crowd", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component"
    )
    return met.join(sets, "node").groupBy("crowd", "low", "high").applyInArrow(_block_links(percent), "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """``pairs`` (a, b) of nodes with the sizes of intersection and union of their full sets."""
    pairs = stage(pairs, f"{name}-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _shingle_sets(wanted, classes, docs, name)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    counted = both.select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b")).cast("long").alias("sizes"))
    return stage(counted.select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("all")), f"{name}-verified")


def near_duplicates(
    docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, kept.

    Two documents are linked if ``100 * intersection >= percent * union`` of their five-word shingle sets. The
    component is the smallest id that links reach; a document is kept if it is that one.

    Equal sets form one class and are handled once. Classes that share a band are candidates. In each band every
    class is first compared with the smallest one; links found so connect almost all. Then any two classes
    of a band that are still apart are compared, unless their distances to the smallest one already show,
    by the triangle inequality of the Jaccard distance, that they can't be linked; where more than 16 are
    apart in a band, whole blocks of classes are compared at once. So no pair of a band is left undecided
    and no group is opened into all its pairs. All links are confirmed on full sets.

    Null or empty texts have empty sets and stay alone. Rows with a null id can link others; they get
    the smallest other id of their component, or null and are kept. Rows of one id count as one document each.
    ``docs`` must be a scan or another plan that gives the same rows twice. Other columns play no part.
    """
    out = _grouped_rows(docs, percent, id_col, text_col)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component.eqNullSafe(F.col("doc_id")), F.lit(False)).alias("kept"),
    )


def _grouped_rows(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, n, d1, d2, component, component_id) of every row; ``component`` numbers its group, null for empty sets."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    signed = stage(numbered.mapInArrow(_signatures(rows_of_band(percent)), SIGNATURE), "near-signed")
    classes = stage(
        signed.where("n > 0").groupBy("n", "d1", "d2").agg(
            F.min("row").alias("node"), F.min("doc_id").alias("first_doc"), F.any_value("bands").alias("bands")
        ),
        "near-classes",
    )
    members = classes.select("node", "n", F.explode("bands").alias("band"))
    leaders = members.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1")
    grouped = stage(members.join(leaders, "band").where("node <> leader").select("band", "leader", "node", "n", "size"), "near-grouped")
    first = _verified(grouped.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), classes, docs, "near-first")
    linked = F.col("common") * 100 >= F.col("all") * percent
    links = first.where(linked).select("a", "b")
    found = stage(components(links, "near-first"), "near-found")

    # what is still apart within a band
    near = first.select(F.col("a").alias("leader"), F.col("b").alias("node"), (F.col("common") / F.col("all")).alias("near"))
    rest = (
        grouped.where("size > 2")
        .join(near, ["leader", "node"])
        .join(found, "node", "left")
        .select("band", "node", "n", "near", F.coalesce("component", "node").alias("component"))
    )
    mixed = rest.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rest = stage(rest.join(mixed.where("low <> high").select("band"), "band", "left_semi"), "near-rest")
    sizes = rest.groupBy("band").agg(F.count("*").alias("left"), F.min("node").alias("first"))
    rest = rest.join(sizes, "band")
    crowded = _crowd_links(rest.where(F.col("left") > CROWD), classes, docs, percent)
    rest = rest.where(F.col("left") <= CROWD)
    other = rest.select("band", *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "near", "component")])
    apart = rest.join(
        other,
        (rest["band"] == other["band"])
        & (F.col("node") < F.col("node_2"))
        & (F.col("component") != F.col("component_2"))
        & (F.abs(F.col("near") - F.col("near_2")) <= F.lit(1 - percent / 100 + 1e-9))
        & (F.least("n", "n_2") * 100 >= F.greatest("n", "n_2") * percent),
    )
    second = _verified(apart.select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct(), classes, docs, "near-second")
    more = stage(second.where(linked).select("a", "b").unionByName(crowded), "near-more")
    if more.isEmpty():
        final = found
    else:
        final = stage(components(links.unionByName(more), "near-all"), "near-final")

    in_class = classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = in_class.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = in_class.join(smallest, "component").select("n", "d1", "d2", "component", "component_id")
    return signed.select("doc_id", "row", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")


def without_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Exactly one row of ``docs`` for each group of near duplicates, with all its columns.

    It is the row with the smallest id (null ids last), of rows with one id the first text by its digest, of equal
    rows one. So an id that comes with two texts loses only the text that is a copy, and a repeated row stays once.
    Rows without words belong to no group and stay. ``docs`` must be a scan of stored files, which numbers its rows
    alike each time it is read.
    """
    grouped = _grouped_rows(docs, percent, "doc_id", "text").where("n > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "d1", "d2", "row")
    stays = grouped.groupBy("component").agg(F.min(order)["row"].alias("first"))
    lost = grouped.join(stays, "component").where("row <> first").select(F.col("row").alias("lost"))
    lost = stage(lost, "near-lost")
    if fits_broadcast(lost.count() * HASHED_ROW):
        lost = F.broadcast(lost)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"), F.monotonically_increasing_id().alias("row"))
    left = held.join(lost, F.col("row") == F.col("lost"), "left_anti")
    return left.select(*[F.col(f"rest.`{c}`") for c in docs.columns])
