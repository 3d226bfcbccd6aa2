"""TF-IDF rows: one sparse row per document, (doc_id, indices, values)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmap.functions.common import let
from textmap.operators import matrix as mx
from textmap.operators.vocabulary import Vocabulary
from textmap.session import fits_broadcast

# Longest term list handed to the JVM of every executor. A longer one goes to the Python workers as Arrow arrays, each
# small enough to be sent, while these are few; beyond that, or where ids repeat, the terms are joined as a table.
DICTIONARY_LIMIT = 200_000
LISTS_AT_MOST = 4
# A term with its number and frequency, about.
TERM_BYTES = 40


def idf(df: Column, n_docs: int) -> Column:
    return F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def _numbers(vocabulary: Vocabulary) -> DataFrame:
    """The terms for a join: sent whole while they fit, so that no cell moves for its term and no term is hot."""
    return F.broadcast(vocabulary.terms) if fits_broadcast(vocabulary.n_terms * TERM_BYTES) else vocabulary.terms


def _listed(tokenized: DataFrame, vocabulary: Vocabulary) -> list[tuple[int, pa.Array, np.ndarray]] | None:
    """Terms and document frequencies in term_id order, in lists with the number of their first term; none where the
    lists would be too many or two documents share an id."""
    size = vocabulary.terms.agg(F.sum(F.octet_length("term") + 4).alias("n")).first()["n"]
    if size is None or not fits_broadcast(size // LISTS_AT_MOST) or not mx.have_own_ids(tokenized):
        return None
    found = []
    for start, stop in mx.row_blocks(vocabulary.n_terms, -(-size // (8 * vocabulary.n_terms))):
        own = vocabulary.terms.where(F.col("term_id").between(start, stop - 1)).select("term_id", "term", "df")
        table = own.toArrow().sort_by("term_id").combine_chunks()
        found.append((start, table.column("term").combine_chunks(), table.column("df").to_numpy()))
    return found


def _rows_in_place(
    tokenized: DataFrame, listed: list[tuple[int, pa.Array, np.ndarray]], idf_docs: int | None = None, unit: bool = False
) -> DataFrame:
    """(doc_id, indices, values): each document's counts of the listed terms, times their weight among ``idf_docs``
    documents where given, at length one if ``unit``. No shuffle."""
    context, width = tokenized.sparkSession.sparkContext, sum(len(terms) for _, terms, _ in listed)
    sent = [
        (first, len(terms), context.broadcast((terms, None if idf_docs is None else np.log((1.0 + idf_docs) / (1.0 + dfs)) + 1.0)))
        for first, terms, dfs in listed
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            known = np.full(len(coded.dictionary), -1)
            for first, _, some in sent:
                place = pc.index_in(coded.dictionary, value_set=some.value[0]).fill_null(-1).to_numpy(zero_copy_only=False)
                known = np.where(place >= 0, first + place.astype(np.int64), known)
            term = pa.array(known).take(coded.indices).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            cells, uses = np.unique(row[term >= 0] * width + term[term >= 0], return_counts=True)
            row, term = np.divmod(cells, width)
            value = uses.astype(float)
            for first, size, some in sent if idf_docs is not None else ():
                own = (term >= first) & (term < first + size)
                value[own] *= some.value[1][term[own] - first]
            if unit:
                value = value / np.sqrt(np.bincount(row, value * value, batch.num_rows))[row]
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            indices, values = pa.array(term.astype(np.int32)), pa.array(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, indices), pa.ListArray.from_arrays(offsets, values)],
                ["doc_id", "indices", "values"],
            )

    kind = tokenized.schema["doc_id"].dataType.simpleString()
    return tokenized.select("doc_id", "terms").mapInArrow(run, f"doc_id {kind}, indices array<int>, values array<double>")


def _count(tokenized: DataFrame, texts: list[str]) -> DataFrame:
    if not texts:
        raise ValueError("the vocabulary is empty: widen min_df and max_df")
    counter = CountVectorizerModel.from_vocabulary(texts, inputCol="terms", outputCol="counts")
    return counter.transform(tokenized).select("doc_id", "counts")


def term_counts(tokenized: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, counts): counts of the vocabulary's terms as an ML vector. No shuffle."""
    if vocabulary.n_terms > DICTIONARY_LIMIT:
        raise ValueError(f"{vocabulary.n_terms} terms are over the limit of {DICTIONARY_LIMIT}: raise min_df")
    return _count(tokenized, vocabulary.on_driver()[0])


def count_rows(tokenized: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, indices, values): how often each document uses the vocabulary's terms; rows without one stay, empty."""
    if vocabulary.n_terms <= DICTIONARY_LIMIT:
        vector = F.unwrap_udt(F.col("counts"))
        return _count(tokenized, vocabulary.on_driver()[0]).select("doc_id", vector.alias("v")).select(
            "doc_id", F.col("v.indices").alias("indices"), F.col("v.values").alias("values")
        )
    listed = _listed(tokenized, vocabulary)
    if listed is not None:
        return _rows_in_place(tokenized, listed)
    used = tokenized.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    cells = used.join(_numbers(vocabulary), "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "tf"))).alias("row"))
    return tokenized.select("doc_id").join(cells, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.col("row.term_id"), F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.col("row.tf"), F.array().cast("array<double>")).alias("values"),
    )


def _from_dictionary(tokenized: DataFrame, vocabulary: Vocabulary, norm: str | None) -> DataFrame:
    texts, dfs = vocabulary.on_driver()
    weights = np.log((1.0 + vocabulary.n_docs) / (1.0 + dfs)) + 1.0
    counts = _count(tokenized, texts)
    scale = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="counts", outputCol="weighted")
    rows, out = scale.transform(counts), "weighted"
    if norm == "l2":
        rows, out = Normalizer(p=2.0, inputCol=out, outputCol="unit").transform(rows), "unit"
    vector = F.unwrap_udt(F.col(out))
    return rows.select("doc_id", vector.alias("v")).select(
        "doc_id", F.col("v.indices").alias("indices"), F.col("v.values").alias("values")
    )


def _from_join(tokenized: DataFrame, vocabulary: Vocabulary, norm: str | None) -> DataFrame:
    counted = (
        tokenized.select("doc_id", F.explode("terms").alias("term"))
        .groupBy("doc_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    cells = counted.join(_numbers(vocabulary), "term").select(
        "doc_id", "term_id", (F.col("tf") * idf(F.col("df"), vocabulary.n_docs)).alias("v")
    )
    rows = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "v"))).alias("row"))
    whole = tokenized.select("doc_id").join(rows, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.col("row.term_id"), F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.col("row.v"), F.array().cast("array<double>")).alias("values"),
    )
    if norm != "l2":
        return whole
    length = F.sqrt(F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v * v))
    # a column of its own would be folded into the lambda and taken anew for every value
    scaled = let(length, lambda n: F.transform("values", lambda v: v / n))
    return whole.select("doc_id", "indices", scaled.alias("values"))


def tfidf(tokenized: DataFrame, vocabulary: Vocabulary, norm: str | None = "l2") -> DataFrame:
    """tf * (ln((1 + N) / (1 + df)) + 1), each row scaled to length one unless ``norm`` is None.

    Documents without a known term keep an empty row. While the term list can be sent every row is
    weighted where it lies; beyond the limits the terms are joined as a table.
    """
    if norm not in ("l2", None):
        raise ValueError(f"unknown norm: {norm}")
    if vocabulary.n_terms <= DICTIONARY_LIMIT:
        return _from_dictionary(tokenized, vocabulary, norm)
    listed = _listed(tokenized, vocabulary)
    if listed is not None:
        return _rows_in_place(tokenized, listed, vocabulary.n_docs, norm == "l2")
    return _from_join(tokenized, vocabulary, norm)


def cells(rows: DataFrame) -> DataFrame:
    """Long form (doc_id, term_id, v) of sparse rows. Narrow: no shuffle."""
    return rows.select("doc_id", F.inline(F.arrays_zip("indices", "values"))).toDF("doc_id", "term_id", "v")


def shape(rows: DataFrame) -> DataFrame:
    """One row: documents in the table and distinct terms with a weight."""
    per_term = cells(rows).groupBy("term_id").agg(F.lit(0).alias("docs"))
    per_term = per_term.select(F.lit(1).alias("features"), "docs")
    per_doc = rows.select(F.lit(0).alias("features"), F.lit(1).alias("docs"))
    return per_term.union(per_doc).agg(
        F.sum("docs").alias("corpus_size"), F.sum("features").alias("n_features")
    )
