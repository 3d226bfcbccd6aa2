"""Topic models over sparse rows: LSA, NMF, LDA. Each gives document vectors and topic components."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.functions import vectors as vx
from textmap.operators import matrix as mx
from textmap.operators.tfidf import DICTIONARY_LIMIT, count_rows, term_counts
from textmap.operators.vocabulary import Vocabulary
from textmap.params import LdaParams, LsaParams, NmfParams
from textmap.session import few_tasks, fits_broadcast, stage

# Up to this many terms the term-by-term product is formed in one pass.
GRAM_TERMS = 2_000
_TINY = 1e-12


@dataclass(frozen=True)
class Reduction:
    """``vectors`` (doc_id, vec); ``components`` (topic_id, term_id, weight); ``attributes`` of the fit."""

    vectors: DataFrame
    components: DataFrame
    n_topics: int
    attributes: dict[str, float | str]


def components_of(spark: SparkSession, by_term: np.ndarray) -> DataFrame:
    """(topic_id, term_id, weight) of a terms x topics matrix."""
    table = mx.matrix_table(spark, by_term)
    return components_from_table(table.select(F.col("feature").alias("row"), F.col("weights").alias("vec")))


def components_from_table(table: DataFrame) -> DataFrame:
    """The same of a (row = term, vec = topics) table."""
    return table.select(F.posexplode("vec").alias("topic_id", "weight"), F.col("row").alias("term_id")).select(
        "topic_id", "term_id", "weight"
    )


def fix_signs(by_term: np.ndarray) -> np.ndarray:
    """Each column's entry of largest magnitude made positive."""
    strongest = np.argmax(np.abs(by_term), axis=0)
    signs = np.sign(by_term[strongest, np.arange(by_term.shape[1])])
    return by_term * np.where(signs == 0, 1.0, signs)


def gram(rows: DataFrame, n_terms: int) -> np.ndarray:
    """transpose(X) X in one pass; term-sized."""
    size = (n_terms, n_terms)
    return mx.collect_matrix(mx.sum_rows(rows, n_terms, size, lambda block: block.T @ block), size)


def _power(rows: DataFrame, shape: tuple[int, int], sent: Broadcast) -> DataFrame:
    return mx.sum_rows(rows, shape[0], shape, lambda block: block.T @ (block @ sent.value))


def power_step(rows: DataFrame, basis: np.ndarray) -> DataFrame:
    """(row, vec): transpose(X) X Q for a terms x l basis Q, in one pass over the rows."""
    return _power(rows, basis.shape, rows.sparkSession.sparkContext.broadcast(basis))


def _ritz(small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a symmetric matrix, largest first."""
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], vectors[:, ::-1]


def _krylov(rows: DataFrame, n_terms: int, k: int, params: LsaParams) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Leading right singular vectors: block Krylov iteration with Rayleigh-Ritz, stopped on the residual.

    Each pass over the rows multiplies only the directions that have not settled yet. The basis is
    cut back to the best ``k`` directions when it has grown to several blocks.
    """
    width = min(k + params.oversample, n_terms)
    block = np.linalg.qr(np.random.default_rng(params.seed).standard_normal((n_terms, width)))[0]
    basis, image = np.zeros((n_terms, 0)), np.zeros((n_terms, 0))
    for step in range(1, params.max_steps + 1):
        basis = np.hstack([basis, block])
        with mx.shared(rows.sparkSession, block) as sent:
            image = np.hstack([image, mx.collect_matrix(_power(rows, block.shape, sent), block.shape)])
        values, turn = _ritz(basis.T @ image)
        lead = basis @ turn[:, :k]
        gap = image @ turn[:, :k] - lead * values[:k]
        size = np.linalg.norm(gap, axis=0) / max(values[0], _TINY)
        settled = size.max() <= params.tolerance or basis.shape[1] == n_terms
        if settled or step == params.max_steps:
            return values[:k], lead, step, bool(settled)
        if basis.shape[1] + k > 6 * width:
            basis, image = lead, image @ turn[:, :k]
        fresh = gap[:, size > params.tolerance / 10]
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        block, scale = np.linalg.qr(fresh)
        sound = np.abs(np.diag(scale)) > _TINY * max(values[0], 1.0)
        block = block[:, sound][:, : n_terms - basis.shape[1]]
        if block.shape[1] == 0:
            return values[:k], lead, step, True
    raise ValueError("max_steps must be positive")


def _subspace_tables(rows: DataFrame, n_terms: int, k: int, params: LsaParams) -> tuple[np.ndarray, DataFrame, int, bool]:
    """Subspace iteration with basis and image as stored tables, for term lists too long to broadcast.

    Only l x l matrices reach the driver: the basis is made orthonormal through its small product.
    """
    spark = rows.sparkSession
    width = min(k + params.oversample, n_terms)
    numbers = spark.range(n_terms).select(F.col("id").cast("int").alias("row"))
    noise = F.array(*[F.xxhash64(F.lit(params.seed), "row", F.lit(j)) / F.lit(2.0**63) for j in range(width)])
    image = numbers.select("row", noise.alias("vec"))
    small = (width, width)

    def product(table: DataFrame) -> np.ndarray:
        return mx.collect_matrix(mx.sum_rows(table, width, small, lambda b: b.T @ b, "row"), small)

    def turned(table: DataFrame, by: np.ndarray) -> DataFrame:
        return mx.multiply(table, by, "row").select(F.col("row").cast("int").alias("row"), "vec")

    for step in range(1, params.max_steps + 1):
        image = stage(image, "lsa-image")
        basis = stage(turned(image, _inverse_root(product(image))), "lsa-basis")
        weights = basis.select(F.col("row").alias("feature"), F.col("vec").alias("weights"))
        projected = stage(mx.multiply_by_blocks(rows, weights, n_terms, width), "lsa-projected")
        image = stage(mx.transpose_product(rows, n_terms, projected, width), "lsa-image")
        pair = basis.select("row", F.col("vec").alias("q")).join(image, "row", "left").select(
            "row", F.concat("q", F.coalesce("vec", F.array_repeat(F.lit(0.0), width))).alias("vec")
        )
        both = mx.collect_matrix(
            mx.sum_rows(pair, 2 * width, (2 * width, 2 * width), lambda b: b.T @ b, "row"), (2 * width, 2 * width)
        )
        inner, energy = both[:width, width:], both[width:, width:]
        values, turn = _ritz(inner)
        # |Z u - theta Q u|^2 = u'Z'Z u - theta^2 for an orthonormal basis
        squared = np.einsum("ij,ik,kj->j", turn[:, :k], energy, turn[:, :k]) - values[:k] ** 2
        worst = np.sqrt(np.maximum(squared, 0.0)).max() / max(values[0], _TINY)
        if worst <= params.tolerance or step == params.max_steps:
            lead = stage(turned(basis, turn[:, :k]), "lsa-basis")
            strongest = components_from_table(lead).groupBy("topic_id").agg(F.max_by("weight", F.abs("weight")).alias("w"))
            signs = np.ones(k)
            for r in strongest.collect():
                signs[r["topic_id"]] = -1.0 if r["w"] < 0 else 1.0
            return values[:k], turned(lead, np.diag(signs)), step, bool(worst <= params.tolerance)
    raise ValueError("max_steps must be positive")


def _inverse_root(square: np.ndarray) -> np.ndarray:
    """A matrix that makes the columns behind the product ``square`` orthonormal."""
    values, vectors = _ritz(square)
    safe = np.where(values > values[0] * 1e-14, values, np.inf)
    return vectors / np.sqrt(safe)


def component_count(wanted: int, n_rows: int, n_terms: int) -> int:
    return max(1, min(wanted, n_rows - 1, n_terms - 1))


def lsa(rows: DataFrame, n_docs: int, n_terms: int, params: LsaParams = LsaParams()) -> Reduction:
    """Rank-k SVD of the rows. Document vectors are U * S scaled to length one; components are V'.

    The attribute ``converged`` tells whether the residual settled within the steps allowed.
    ``rows`` is read once per step: pass a stored table.
    """
    k = component_count(params.n_components, n_docs, n_terms)
    spark = rows.sparkSession
    attributes: dict[str, float | str] = {"n_components": k}
    if n_terms <= GRAM_TERMS:
        values, vectors = _ritz(gram(rows, n_terms))
        values, by_term, steps, settled = values[:k], vectors[:, :k], 1, True
        attributes["algorithm"] = "gram"
    elif fits_broadcast(n_terms * (k + params.oversample) * 8):
        values, by_term, steps, settled = _krylov(rows, n_terms, k, params)
        attributes["algorithm"] = "krylov"
    else:
        values, table, steps, settled = _subspace_tables(rows, n_terms, k, params)
        weights = table.select(F.col("row").alias("feature"), F.col("vec").alias("weights"))
        attributes |= {"algorithm": "subspace-tables", "n_iter": steps, "converged": str(settled).lower()}
        attributes |= {f"singular_value_{i}": float(np.sqrt(max(v, 0.0))) for i, v in enumerate(values)}
        components = components_from_table(table)
        return Reduction(mx.multiply_by_blocks(rows, weights, n_terms, k, unit=True), components, k, attributes)
    by_term = fix_signs(by_term)
    attributes |= {"n_iter": steps, "converged": str(settled).lower()}
    attributes |= {f"singular_value_{i}": float(np.sqrt(max(v, 0.0))) for i, v in enumerate(values)}
    return Reduction(mx.multiply(rows, by_term, unit=True), components_of(spark, by_term), k, attributes)


def fit_weights(product: np.ndarray, square: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative W that lowers |X - W H| for fixed H, from X H' and H H', by multiplicative steps.

    W is found anew from H each time, so no document weights are kept between passes.
    """
    weights = product / (np.diag(square) + _TINY)
    for _ in range(steps):
        weights = weights * product / (weights @ square + _TINY)
    return weights


def update_topics(by_term: np.ndarray, pulled: np.ndarray, square: np.ndarray, steps: int) -> np.ndarray:
    """H' after multiplicative steps with fixed W: rows are terms, so each row moves by itself."""
    for _ in range(steps):
        by_term = by_term * pulled / (by_term @ square + _TINY)
    return by_term


def nmf_sums(rows: DataFrame, by_term: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """transpose(X) W and transpose(W) W, with W fitted to the given topics, in one pass over the rows."""
    n_terms, k = by_term.shape
    shape = (n_terms + k, k)
    with mx.shared(rows.sparkSession, by_term) as sent:
        found = mx.collect_matrix(mx.sum_rows(rows, n_terms, shape, _nmf_work(sent, steps)), shape)
    return found[:n_terms], found[n_terms:]


def nmf(
    rows: DataFrame, n_docs: int, n_terms: int, params: NmfParams = NmfParams(), h_init: np.ndarray | None = None
) -> Reduction:
    """X ~ W H with non-negative factors; ``vectors`` is W, not scaled. One pass over ``rows`` per step.

    ``h_init``: the first topics as a terms x topics matrix, in place of seeded ones. The attribute ``converged``
    tells whether the error settled within the steps allowed.
    """
    k = component_count(params.n_components, n_docs, n_terms) if h_init is None else h_init.shape[1]
    spark = rows.sparkSession
    in_row = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v)
    squares = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v * v)
    sums = rows.agg(F.sum(in_row).alias("s"), F.sum(squares).alias("q")).first()
    scale = np.sqrt((sums["s"] or 0.0) / max(1, n_docs * n_terms) / k)
    total, steps = sums["q"] or 0.0, params.inner_steps
    if not fits_broadcast(n_terms * k * 8):
        return _nmf_tables(rows, n_terms, k, scale, total, params, h_init)
    if h_init is None:
        by_term = mx.collect_matrix(_nmf_start(spark, n_terms, k, scale, params.seed), (n_terms, k))
    else:
        by_term = np.array(h_init, float)
    trace: list[float] = []
    for _ in range(params.max_steps):
        pulled, square = nmf_sums(rows, by_term, steps)
        trace.append(float(total - 2 * (pulled * by_term).sum() + (square * (by_term.T @ by_term)).sum()))
        if _settled(trace, params.tolerance, total):
            break
        by_term = update_topics(by_term, pulled, square, steps)
    final = spark.sparkContext.broadcast(by_term)

    def weigh(block: np.ndarray) -> np.ndarray:
        topics = final.value
        return fit_weights(block @ topics, topics.T @ topics, steps)

    attributes: dict[str, float | str] = {"n_topics": k, "n_iter": len(trace), "converged": str(_settled(trace, params.tolerance, total)).lower()}
    attributes |= {f"error_{i}": e for i, e in enumerate(trace)}
    return Reduction(mx.map_rows(rows, n_terms, weigh), components_of(spark, by_term), k, attributes)


def _nmf_work(sent: Broadcast, steps: int) -> Callable[[np.ndarray], np.ndarray]:
    """Per block, transpose(X) W over transpose(W) W, with W fitted to the topics sent."""

    def work(block: np.ndarray) -> np.ndarray:
        topics = sent.value
        weights = fit_weights(block @ topics, topics.T @ topics, steps)
        return np.concatenate([block.T @ weights, weights.T @ weights])

    return work


def _settled(trace: list[float], tolerance: float, total: float) -> bool:
    return len(trace) > 1 and abs(trace[-2] - trace[-1]) <= tolerance * max(total, _TINY)


def _nmf_start(spark: SparkSession, n_terms: int, k: int, scale: float, seed: int) -> DataFrame:
    """(row, vec): the first topics, the same numbers however the steps are run."""
    start = F.array(*[
        F.lit(float(scale)) * F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(j)), F.lit(1 << 32)) / F.lit(2.0**32)
        for j in range(k)
    ])
    return spark.range(n_terms).select(F.col("id").cast("int").alias("row"), start.alias("vec"))


def _nmf_tables(
    rows: DataFrame, n_terms: int, k: int, scale: float, total: float, params: NmfParams, h_init: np.ndarray | None
) -> Reduction:
    """The same steps with H as a stored table, for term lists too long to broadcast."""
    spark, steps = rows.sparkSession, params.inner_steps
    start = _nmf_start(spark, n_terms, k, scale, params.seed)
    if h_init is not None:
        start = mx.matrix_table(spark, h_init).select(F.col("feature").alias("row"), F.col("weights").alias("vec"))
    topics = stage(start, "nmf-topics")
    small, trace = (k, k), []

    def square_of(table: DataFrame, key: str) -> np.ndarray:
        return mx.collect_matrix(mx.sum_rows(table, k, small, lambda b: b.T @ b, key), small)

    def weights_for(topics: DataFrame, square: np.ndarray) -> DataFrame:
        by_feature = topics.select(F.col("row").alias("feature"), F.col("vec").alias("weights"))
        product = mx.multiply_by_blocks(rows, by_feature, n_terms, k)
        return mx.map_rows(product, k, lambda b: fit_weights(b, square, steps))

    for _ in range(params.max_steps):
        inner = square_of(topics, "row")
        weights = stage(weights_for(topics, inner), "nmf-weights")
        square = square_of(weights, "doc_id")
        pulled = mx.transpose_product(rows, n_terms, weights, k).select("row", F.col("vec").alias("pulled"))
        zero = F.array_repeat(F.lit(0.0), k)
        pair = stage(
            topics.join(pulled, "row", "left").select("row", F.concat("vec", F.coalesce("pulled", zero)).alias("vec")),
            "nmf-pair",
        )
        halves = pair.select(F.slice("vec", 1, k).alias("h"), F.slice("vec", k + 1, k).alias("p"))
        cross = halves.agg(F.sum(vx.dot(F.col("h"), F.col("p"))).alias("c")).first()["c"]
        trace.append(float(total - 2 * cross + (square * inner).sum()))
        if _settled(trace, params.tolerance, total):
            break
        moved = mx.map_rows(
            pair, 2 * k, lambda b: update_topics(b[:, :k], b[:, k:], square, steps), "row"
        ).select(F.col("row").cast("int").alias("row"), "vec")
        topics = stage(moved, "nmf-topics")
    attributes: dict[str, float | str] = {"n_topics": k, "n_iter": len(trace), "converged": str(_settled(trace, params.tolerance, total)).lower()}
    attributes |= {f"error_{i}": e for i, e in enumerate(trace)}
    return Reduction(weights_for(topics, square_of(topics, "row")), components_from_table(topics), k, attributes)


def topic_shares_step(counts: DataFrame, shares: DataFrame, topics: DataFrame, n_terms: int, k: int, params: LdaParams) -> tuple[DataFrame, DataFrame]:
    """One step of LDA by expectation-maximisation: new (doc_id, vec) shares and new (feature, weights) topics, stored.

    Each use of a term is divided among the topics as share x weight; a document's uses by topic give its shares, a
    term's uses by topic its weights, both smoothed. ``topics`` is sent in blocks of terms and both sums are taken
    block by block, so neither the term list nor a hot term bounds the step. ``counts`` are stored sparse rows.
    """
    spark = counts.sparkSession
    joined = stage(counts.join(shares, "doc_id").select("doc_id", "indices", "values", "vec"), "lda-rows")

    def divided(batch: pa.RecordBatch, block: np.ndarray, start: int, stop: int):
        share = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        lists = pa.RecordBatch.from_arrays(batch.columns[:3], ["id", "indices", "values"])
        for number, feature, value in mx._cells(lists, start, stop, k):
            part = share[number] * block[feature]
            yield number, feature, part * (value / np.maximum(part.sum(axis=1), _TINY))[:, None]

    by_doc = by_term = None
    for start, stop in mx.row_blocks(n_terms, k):
        sent = spark.sparkContext.broadcast(mx._block_of(topics, start, stop, k))

        def of_docs(batches, sent=sent, start=start, stop=stop):
            for batch in batches:
                total = np.zeros((batch.num_rows, k))
                for number, _, part in divided(batch, sent.value, start, stop):
                    found, sums = mx.add_by_key(number, part)
                    total[found] += sums
                yield pa.RecordBatch.from_arrays([batch.column(0), mx.list_array(total)], ["doc_id", "vec"])

        def of_terms(batches, sent=sent, start=start, stop=stop):
            total = np.zeros((stop - start, k))
            for batch in batches:
                for _, feature, part in divided(batch, sent.value, start, stop):
                    found, sums = mx.add_by_key(feature, part)
                    total[found] += sums
            hit = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array((start + hit).astype(np.int32)), mx.list_array(total[hit])], ["row", "vec"])

        docs = joined.mapInArrow(of_docs, "doc_id long, vec array<double>")
        terms = mx.merge_partials(few_tasks(joined).mapInArrow(of_terms, "row int, vec array<double>"), "row", k)
        by_doc = docs if by_doc is None else by_doc.unionByName(docs)
        by_term = terms if by_term is None else by_term.unionByName(terms)
    if len(mx.row_blocks(n_terms, k)) > 1:
        by_doc = mx.sum_vectors(by_doc, "doc_id")
    uses = F.aggregate("vec", F.lit(0.0), lambda total, v: total + v)
    alpha, eta = params.share_prior, params.term_prior
    smooth = F.transform("vec", lambda v: (v + F.lit(alpha)) / (F.col("uses") + F.lit(alpha * k)))
    shares = stage(by_doc.withColumn("uses", uses).select("doc_id", smooth.alias("vec")), "lda-shares")
    by_term = stage(by_term, "lda-sums")
    return shares, _moved_topics(topics, by_term, n_terms, k, eta)


def _moved_topics(topics: DataFrame, by_term: DataFrame, n_terms: int, k: int, eta: float) -> DataFrame:
    """New (feature, weights), stored, from the stored sums by term."""
    whole = mx.collect_matrix(mx.sum_rows(by_term.select(F.col("row").alias("doc_id"), "vec"), k, (1, k), lambda b: b.sum(axis=0, keepdims=True)), (1, k))[0]
    mass = F.array(*[F.lit(float(m) + eta * n_terms) for m in whole])
    every = topics.select(F.col("feature").alias("row")).join(by_term, "row", "left")
    sums = F.coalesce("vec", F.array_repeat(F.lit(0.0), k))
    moved = F.zip_with(sums, mass, lambda v, m: (v + F.lit(eta)) / m)
    return stage(every.select(F.col("row").cast("int").alias("feature"), moved.alias("weights")), "lda-topics")


def _shares_in_one_pass(rows: DataFrame, topics: DataFrame, n_terms: int, k: int, params: LdaParams, last: bool) -> tuple[DataFrame, DataFrame]:
    """As ``topic_shares_step``, for stored ``rows`` (doc_id, indices, values, vec) that carry their shares along.

    Gives such rows with the new shares, without their cells after the ``last`` step. A task holds all of ``topics``,
    and as many sums, which it ships behind its rows; no row moves.
    """
    context, stretches = rows.sparkSession.sparkContext, mx.row_blocks(n_terms, k)
    sent = [context.broadcast(np.ascontiguousarray(mx._block_of(topics, start, stop, k))) for start, stop in stretches]
    alpha, slots = params.share_prior, np.arange(k)
    step = max(1, mx.BLOCK_ENTRIES // k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((stop - start) * k) for start, stop in stretches]
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                share = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                uses = np.zeros((batch.num_rows, k))
                for (start, stop), block, total in zip(stretches, sent, totals, strict=True):
                    for number, feature, value in mx._cells(batch, start, stop, k):
                        part = share[number] * block.value[feature]
                        part *= (value / np.maximum(part.sum(axis=1), _TINY))[:, None]
                        found, sums = mx.add_in_order(number, part)
                        uses[found] += sums
                        np.add.at(total, (feature.astype(np.int64)[:, None] * k + slots).ravel(), part.ravel())
                new = mx.list_array((uses + alpha) / (uses.sum(axis=1, keepdims=True) + alpha * k))
                cells = [pa.nulls(batch.num_rows, c.type) for c in batch.columns[1:3]] if last else batch.columns[1:3]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cells, new, pa.array([False] * batch.num_rows)], names)
        for (start, _), total in zip(stretches, totals, strict=True):
            table = total.reshape(-1, k)
            hit = np.flatnonzero(table.any(axis=1))
            for first in range(0, len(hit), step):
                some = hit[first : first + step]
                none = [pa.nulls(len(some), pa.list_(t)) for t in (pa.int32(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(start + some), *none, mx.list_array(table[some]), pa.array([True] * len(some))], names)

    names = ["doc_id", "indices", "values", "vec", "is_term"]
    told = few_tasks(rows).mapInArrow(run, "doc_id long, indices array<int>, values array<double>, vec array<double>, is_term boolean")
    told = stage(told, "lda-step")
    partial = told.where("is_term").select(F.col("doc_id").cast("int").alias("row"), "vec")
    by_term = stage(mx.merge_partials(partial, "row", k), "lda-sums")
    return told.where("not is_term").drop("is_term"), _moved_topics(topics, by_term, n_terms, k, params.term_prior)


def lda_by_blocks(counts: DataFrame, topics: DataFrame, n_terms: int, k: int, params: LdaParams = LdaParams()) -> Reduction:
    """LDA from given topics (feature, weights) over a term list of any length; repeatable, one step per iteration."""
    even = F.array_repeat(F.lit(1.0 / k), k)
    shares = counts.select("doc_id", even.alias("vec"))
    # rows that share an id meet each other in the join of the longer way
    if len(mx.row_blocks(n_terms, k)) <= mx.BLOCKS_AT_ONCE and mx.have_own_ids(counts):
        rows = counts.select(F.col("doc_id").cast("long").alias("doc_id"), "indices", "values", even.alias("vec"))
        for step in range(params.n_iter):
            rows, topics = _shares_in_one_pass(rows, topics, n_terms, k, params, step == params.n_iter - 1)
        shares = rows.select("doc_id", "vec")
    else:
        for _ in range(params.n_iter):
            shares, topics = topic_shares_step(counts, shares, topics, n_terms, k, params)
    components = components_from_table(topics.select(F.col("feature").alias("row"), F.col("weights").alias("vec")))
    return Reduction(shares, components, k, {"n_topics": k, "n_iter": params.n_iter, "algorithm": "em"})


def lda(tokenized: DataFrame, vocabulary: Vocabulary, params: LdaParams = LdaParams()) -> Reduction:
    """Topic shares per document and term weights per topic on counts.

    By Spark's online variational LDA up to the length of a term list that is sent whole, beyond it by
    expectation-maximisation over blocks of terms from seeded topics.
    """
    if vocabulary.n_terms > DICTIONARY_LIMIT:
        start = _nmf_start(tokenized.sparkSession, vocabulary.n_terms, params.n_topics, 1.0, params.seed)
        topics = stage(start.select(F.col("row").alias("feature"), F.col("vec").alias("weights")), "lda-topics")
        return lda_by_blocks(stage(count_rows(tokenized, vocabulary), "lda-counts"), topics, vocabulary.n_terms, params.n_topics, params)
    counts = term_counts(tokenized, vocabulary)
    # every pass takes all documents; Spark's own share is a twentieth
    fit = LDA(k=params.n_topics, maxIter=params.n_iter, seed=params.seed, featuresCol="counts", subsamplingRate=1.0)
    model = fit.fit(counts)
    vectors = model.transform(counts).select("doc_id", vector_to_array("topicDistribution").alias("vec"))
    components = components_of(tokenized.sparkSession, model.topicsMatrix().toArray())
    return Reduction(vectors, components, params.n_topics, {"n_topics": params.n_topics, "n_iter": params.n_iter})
