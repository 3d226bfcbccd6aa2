"""How far the sources of a language lie apart in their words: a K-squared quadtree over counts of groups and terms.

Per language the counts form a matrix of groups (its sources) by kept terms. It is cut into tiles of ROWS x COLS
cells, the upper quadrants of the tree; the quadrants of a tile are split K x K down to leaves. Two tiles over the same
terms are walked jointly from the top: where both hold no count, every term costs the same, so the quadrant's price
is its width times that cost and nothing below it is visited; where one does, the walk goes on to the leaves, which
are compared for all their pairs of groups at once. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmap.llm.prefix import running_sums
from textmap.llm.stretches import stretches
from textmap.session import stage

SCALE, PRIOR = 1_000_000_000, 5
K = 4
LEAF = K**2
ROWS, COLS = K**3, K**5
HELD = 500_000  # counts that a task holds before it hands them on

# A-Z in lower case; every other byte below 128 that is no letter parts terms
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Uses and documents of each term of a group; a group without terms is a row without a term."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, docs) in groups.items():
            terms = list(uses)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)),
                    pa.array([*terms, None], pa.binary()).cast(pa.string()),
                    pa.array([*uses.values(), 0], pa.int64()), pa.array([*(docs[t] for t in terms), 0], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (lang, source) not in groups:
                groups[lang, source] = (Counter(), Counter())
            uses, docs = groups[lang, source]
            before, seen = len(uses), set()
            for part in stretches(text.as_py().encode().translate(_LETTERS)):
                terms = part.split()
                uses.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += 1 + len(uses) - before
            if held > HELD:
                yield from out()
                groups.clear()
                held = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): uses of each term and documents with it; null columns of ``docs`` read as ''.

    Every group has one more row with a null term, so that a group without terms is there, too.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def prices(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), in decimal steps that stay within 64 bits."""
    rest = counts + PRIOR
    whole, rest = np.divmod(rest, totals)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + more
    return 1 + whole


def _price(count: str, total: str) -> F.Column:
    return F.expr(f"1 + (cast({count} + {PRIOR} as decimal(20,0)) * {SCALE}) div cast({total} as decimal(20,0))")


class QuadTree:
    """The counts of one tile: at each level the nodes with a count, at the leaves blocks of prices.

    ``cells``: count << 16 | row * COLS + column. ``totals`` of the tile's rows; ``width`` of its columns are terms.
    """

    def __init__(self, cells: np.ndarray, totals: np.ndarray, width: int):
        self.width, self.n_rows = width, len(totals)
        self.totals = np.ones(ROWS, np.int64)
        self.totals[: len(totals)] = np.maximum(totals, 1)
        self.blank = prices(np.zeros(ROWS, np.int64), self.totals)
        row, col = np.divmod(cells & 0xFFFF, COLS)
        self.levels = {}
        side = COLS
        while side >= LEAF:
            self.levels[side] = np.unique(row // side * (COLS // side) + col // side)
            side //= K
        nodes = self.levels[LEAF]
        own = np.searchsorted(nodes, row // LEAF * (COLS // LEAF) + col // LEAF)
        leaf_rows = (nodes // (COLS // LEAF))[:, None] * LEAF + np.arange(LEAF)
        self.leaves = np.repeat(self.blank[leaf_rows][:, :, None], LEAF, axis=2)
        self.leaves[own, row % LEAF, col % LEAF] = prices(cells >> 16, self.totals[row])

    def find(self, side: int, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """The place of each node among those with a count, -1 for an empty quadrant."""
        nodes = self.levels[side]
        code = row * (COLS // side) + col
        if not len(nodes):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(nodes, code), len(nodes) - 1)
        return np.where(nodes[at] == code, at, -1)

    def blocks(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Prices of leaves; an empty one holds its rows' price for no use."""
        blank = np.repeat(self.blank.reshape(-1, LEAF)[row][:, :, None], LEAF, axis=2)
        if len(self.leaves):
            blank[at >= 0] = self.leaves[at[at >= 0]]
        return blank


def joint_walk(a: QuadTree, b: QuadTree) -> np.ndarray:
    """Sum of absolute price differences over the tile's terms, for every row of ``a`` and of ``b``."""
    total = np.zeros((ROWS // LEAF, ROWS // LEAF, LEAF, LEAF), np.int64)
    empty = np.zeros((ROWS // LEAF, ROWS // LEAF), np.int64)  # terms priced without a visit
    side = COLS
    ra = rb = col = np.zeros(1, np.int64)
    while len(ra):
        at, bt = a.find(side, ra, col), b.find(side, rb, col)
        none = (at < 0) & (bt < 0)
        span = max(1, min(side, ROWS) // LEAF)
        width = np.clip(a.width - col[none] * side, 0, side)
        priced = np.zeros((len(empty) // span, len(empty) // span), np.int64)
        np.add.at(priced, (ra[none], rb[none]), width)
        empty += np.repeat(np.repeat(priced, span, axis=0), span, axis=1)
        ra, rb, col, at, bt = (x[~none] for x in (ra, rb, col, at, bt))
        if side == LEAF:
            break
        side //= K
        fit = max(1, min(K, ROWS // side))  # rows of quadrants below a node of this tile
        i, j, k = (x.ravel() for x in np.meshgrid(np.arange(fit), np.arange(fit), np.arange(K), indexing="ij"))
        ra, rb, col = ((x[:, None] * K + y).ravel() for x, y in ((ra, i), (rb, j), (col, k)))
    for first in range(0, len(ra), 256):
        s = slice(first, first + 256)
        live = (col[s, None] * LEAF + np.arange(LEAF) < a.width)[:, None, None, :]
        apart = np.abs(a.blocks(at[s], ra[s])[:, :, None, :] - b.blocks(bt[s], rb[s])[:, None, :, :])
        np.add.at(total, (ra[s], rb[s]), (apart * live).sum(axis=3))
    sums = total.transpose(0, 2, 1, 3).reshape(ROWS, ROWS)
    widths = np.repeat(np.repeat(empty, LEAF, axis=0), LEAF, axis=1)
    return sums + widths * np.abs(a.blank[:, None] - b.blank[None, :])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (lang, one, other, width, tiles) to (lang, a, b, value) with a < b."""
    for batch in batches:
        for lang, one, other, width, tiles in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
            trees = {}
            for tile in tiles.values:
                cells = tile["cells"].values if tile["cells"].is_valid else pa.array([], pa.int64())
                trees[tile["block"].as_py()] = QuadTree(
                    cells.to_numpy(zero_copy_only=False).astype(np.int64), tile["totals"].values.to_numpy().astype(np.int64), width
                )
            a, b = trees[one], trees[other]
            sums = joint_walk(a, b)[: a.n_rows, : b.n_rows]
            i, j = np.triu_indices(a.n_rows, 1) if one == other else (x.ravel() for x in np.indices(sums.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(i), pa.string()), pa.array(one * ROWS + i), pa.array(other * ROWS + j), pa.array(sums[i, j])],
                ["lang", "a", "b", "value"],
            )


def _tile_pairs(cells: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, one, other, width, tiles): both tiles of each two blocks of groups over the same terms.

    A tile holds at most ROWS x COLS numbers however the counts are spread, so no language or source is hot.
    """
    packed = cells.select(
        "lang", F.expr(f"row div {ROWS}").alias("block"), F.expr(f"col div {COLS}").alias("stripe"),
        (F.shiftleft("n", 16) + F.col("row") % ROWS * COLS + F.col("col") % COLS).alias("cell"),
    ).groupBy("lang", "block", "stripe").agg(F.collect_list("cell").alias("cells"))
    blocks = groups.groupBy("lang", F.expr(f"row div {ROWS}").alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "total"))), lambda x: x["total"]).alias("totals")
    ).join(langs, "lang")
    whole = blocks.withColumn("stripe", F.explode(F.expr(f"sequence(0L, greatest((terms - 1) div {COLS}, 0L))")))
    tiles = whole.join(packed, ["lang", "block", "stripe"], "left")
    met = tiles.withColumn("partner", F.explode(F.expr(f"sequence(0L, (sources - 1) div {ROWS})")))
    return met.groupBy(
        "lang", F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("other"), "stripe",
        F.least(F.lit(COLS), F.col("terms") - F.col("stripe") * COLS).alias("width"),
    ).agg(F.collect_list(F.struct("block", "totals", "cells")).alias("tiles")).select("lang", "one", "other", "width", "tiles")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source lies from the others of its language, and by which terms.

    Terms are runs of letters and of characters from 128 on, A-Z in lower case; a language keeps those in at least
    ``min_docs`` of its documents. Part ``pair``: every other source of the language with the summed price difference
    over all kept terms. Part ``term``: the group's terms that cost more than in the whole language, the ``top``
    widest. Ties go to the smaller item.

    Null lang, source or text read as ''. Rows count as often as they come; ids and other columns play no part. A
    language that keeps no term has all pairs at 0 and no terms. An empty table gives no rows.
    """
    counts = stage(term_counts(docs), "divergence-counts")
    used = counts.where("term is not null")
    kept = used.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = kept.where(F.col("docs") >= min_docs).select("lang", "term", "lang_n", F.lit(1).alias("one"))
    numbered = running_sums(kept, [F.col("lang_n").desc(), F.col("term")], {"one": "col"}, "divergence-terms", "lang")
    kept = stage(numbered.drop("one"), "divergence-kept")

    counted = stage(used.join(kept, ["lang", "term"]).select("lang", "source", "term", "col", "n", "lang_n"), "divergence-cells")
    sizes = counted.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    named = counts.where("term is null").select("lang", "source", F.lit(1).alias("one"))
    named = running_sums(named, [F.col("source")], {"one": "row"}, "divergence-groups", "lang").drop("one")
    of_terms = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_size"))
    langs = named.groupBy("lang").agg(F.count("*").alias("sources")).join(of_terms, "lang", "left")
    langs = stage(langs.na.fill(0, ["terms", "lang_size"]), "divergence-langs")
    groups = named.join(sizes, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", "row", (F.coalesce("size", F.lit(0)) + PRIOR * F.col("terms")).alias("total"),
        (F.col("lang_size") + PRIOR * F.col("terms")).alias("lang_total"),
    )
    groups = stage(groups, "divergence-sizes")
    cells = counted.join(groups, ["lang", "source"])

    sums = _tile_pairs(cells, groups, langs).mapInArrow(_walk, "lang string, a long, b long, value long")
    pairs = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), "value"))
    names = groups.select("lang", "source", "row")
    paired = both.join(names.withColumnRenamed("row", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("row").alias("b"), F.col("source").alias("item")), ["lang", "b"]
    ).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    apart = _price("n", "total") - _price("lang_n", "lang_total")
    terms = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart.alias("value"))
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    return paired.select("*", ranked).unionByName(
        terms.where((F.col("value") > 0)).select("*", ranked).where(F.col("rank") <= top)
    )
