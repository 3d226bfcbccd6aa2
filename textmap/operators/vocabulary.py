"""Terms of a corpus: document frequencies, term numbers, lookups, stem tables."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmap.functions import text as tx
from textmap.params import TextParams
from textmap.session import stage

_ROW_BITS = 33
# Longest list of words that n-grams are formed from in place, and the words of a block they are formed in.
KEPT_WORDS = 200_000
_WORDS_AT_ONCE = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """``terms`` holds (term, term_id, df), stored; ``n_docs`` counts the documents it was read from."""

    terms: DataFrame
    n_docs: int
    n_terms: int

    def on_driver(self) -> tuple[list[str], np.ndarray]:
        """Terms and document frequencies in term_id order; callers check ``n_terms`` first."""
        table = self.terms.select("term_id", "term", "df").toArrow().sort_by("term_id")
        return table.column("term").to_pylist(), table.column("df").to_numpy()


def tokenize(corpus: DataFrame, params: TextParams = TextParams(), column: str = "body") -> DataFrame:
    """(doc_id, terms): every document with its terms in text order, repeated as they occur; none for a null text."""
    terms = tx.terms(F.coalesce(F.col(column), F.lit("")), params.accents, params.ngram_range)
    return corpus.select("doc_id", terms.alias("terms"))


def ngrams_within(words: DataFrame, kept: list[str], ngram_range: tuple[int, int]) -> DataFrame:
    """(doc_id, terms): the distinct n-grams of each document whose words all belong to ``kept``.

    A document that has an n-gram has each of its words, so with ``kept`` the words of at least some document
    frequency, no n-gram of that frequency is missed.
    """
    listed = pa.array(kept, pa.string())
    sent = words.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(np.diff(whole.column(1).offsets.to_numpy()))
            first = 0
            while first < whole.num_rows:
                # as many documents as hold a bounded number of words, one at least
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + _WORDS_AT_ONCE, "right")))
                yield _grams_of(whole.slice(first, last - first), sent.value, ngram_range)
                first = last

    texts = words.select("doc_id", "terms")
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, terms array<string>")


def _grams_of(batch: pa.RecordBatch, kept: pa.Array, ngram_range: tuple[int, int]) -> pa.RecordBatch:
    lists = batch.column(1)
    known = pc.index_in(lists.flatten(), value_set=kept).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    rows, grams = [], []
    code, at, width = known, np.flatnonzero(known >= 0), len(kept)
    for n in range(1, ngram_range[1] + 1):
        if n > 1:
            # an n-gram is the one that starts there, shorter by a word, and the word behind it
            at = at[at + n - 1 < len(known)]
            at = at[(row[at] == row[at + n - 1]) & (known[at + n - 1] >= 0)]
            longer = np.full(len(known), -1)
            longer[at] = np.unique(code[at] * width + known[at + n - 1], return_inverse=True)[1]
            code = longer
        if n >= ngram_range[0]:
            pick = at[np.unique(row[at] * (code.max(initial=0) + 1) + code[at], return_index=True)[1]]
            parts = [kept.take(pa.array(known[pick + i])) for i in range(n)]
            grams.append(pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0])
            rows.append(row[pick])
    number = np.concatenate(rows)
    order = np.argsort(number, kind="stable")
    offsets = np.searchsorted(number[order], np.arange(batch.num_rows + 1)).astype(np.int32)
    terms = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(grams).take(pa.array(order)))
    return pa.RecordBatch.from_arrays([batch.column(0), terms], ["doc_id", "terms"])


def normalize_tokens(tokenized: DataFrame, stems: DataFrame) -> DataFrame:
    """Replace each term by its stem from ``stems(term, stem)``; a term without one stays.

    The table is joined to the distinct terms of each document and read back in place, so the order
    and the number of the terms are kept and no text is spread over tasks by a frequent term.
    """
    table = stems.groupBy("term").agg(F.min("stem").alias("stem"))
    known = tokenized.select("doc_id", F.explode(F.array_distinct("terms")).alias("term")).join(table, "term")
    per_doc = known.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "stem"))).alias("stems")
    )
    replaced = F.transform("terms", lambda t: F.coalesce(F.try_element_at(F.col("stems"), t), t))
    return tokenized.join(per_doc, "doc_id", "left").select(
        "doc_id", F.when(F.col("stems").isNull(), F.col("terms")).otherwise(replaced).alias("terms")
    )


def document_frequencies(tokenized: DataFrame) -> DataFrame:
    """(term, df). Terms are made distinct inside each row, so one shuffle of partial counts is enough."""
    return (
        tokenized.select(F.explode(F.array_distinct("terms")).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def frequency_bounds(params: TextParams, n_docs: int) -> tuple[float, float]:
    def bound(value: float | int) -> float:
        return value if isinstance(value, int) else value * n_docs

    return bound(params.min_df), bound(params.max_df)


def number_terms(df: DataFrame, column: str = "term") -> tuple[DataFrame, int]:
    """The rows with ``term_id``, the position of ``column`` in sorted order from 0; and their number.

    A range sort gives each task one stretch of the order; the rows are numbered where they lie and
    shifted by the sizes of the stretches before, so no single task holds all terms.
    """
    marked = stage(df.orderBy(column).withColumn("_mark", F.monotonically_increasing_id()), "terms")
    stretch = F.shiftright("_mark", _ROW_BITS).cast("int")
    sizes = {r["s"]: r["n"] for r in marked.groupBy(stretch.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for s in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(s, 0)
    start = F.element_at(F.lit(starts or [0]).cast("array<bigint>"), stretch + 1)
    row = F.col("_mark").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return marked.withColumn("term_id", (start + row).cast(T.IntegerType())).drop("_mark"), total


def fit_vocabulary(
    tokenized: DataFrame, params: TextParams = TextParams(), n_docs: int | None = None
) -> Vocabulary:
    """Terms whose document frequency lies within both bounds, numbered alphabetically."""
    n_docs = tokenized.count() if n_docs is None else n_docs
    low, high = frequency_bounds(params, n_docs)
    kept = document_frequencies(tokenized).where(F.col("df").between(F.lit(low), F.lit(high)))
    # stored first: a range sort reads its rows twice
    numbered, n_terms = number_terms(stage(kept, "kept-terms"))
    return Vocabulary(numbered.select("term", "term_id", "df"), n_docs, n_terms)


def fit_ngram_vocabulary(words: DataFrame, params: TextParams, n_docs: int | None = None) -> Vocabulary:
    """``fit_vocabulary`` of the n-grams of documents given as ``words``, (doc_id, terms) with their single words.

    Only n-grams of words that reach the lower bound themselves are formed and counted; the others can't reach it.
    With a bound that leaves more words than fit a list, all n-grams are counted.
    """
    n_docs = words.count() if n_docs is None else n_docs
    low, _ = frequency_bounds(params, n_docs)
    kept = stage(document_frequencies(words).where(F.col("df") >= F.lit(low)), "kept-words")
    if kept.count() > KEPT_WORDS:
        grams = words.select("doc_id", tx.word_ngrams(F.col("terms"), *params.ngram_range).alias("terms"))
    else:
        grams = ngrams_within(words, [r["term"] for r in kept.select("term").collect()], params.ngram_range)
    return fit_vocabulary(grams, params, n_docs)


def fixed_vocabulary(terms: DataFrame, tokenized: DataFrame) -> Vocabulary:
    """A given term list with its document frequencies in ``tokenized``; unseen terms get zero."""
    wanted = terms.select("term").where(F.col("term").isNotNull()).distinct()
    counted = wanted.join(document_frequencies(tokenized), "term", "left").na.fill(0, ["df"])
    numbered, n_terms = number_terms(counted)
    return Vocabulary(numbered.select("term", "term_id", "df"), tokenized.count(), n_terms)


def with_terms(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add the term text to rows that carry a term_id."""
    return df.join(vocabulary.select("term_id", "term"), "term_id")


def with_term_ids(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return df.join(vocabulary.select("term", "term_id"), "term")
