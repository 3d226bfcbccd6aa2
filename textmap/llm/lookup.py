"""Values of words for whole documents, with a vocabulary of any size.

The commonest words, a bounded number, go to all tasks; every other word of a document is joined as a row and
handed to the document with its value. Both ways give the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.llm.workers import tidy

HEAD = 400_000
HEAD_BYTES = 64  # longer words are never broadcast
BYTES_AT_ONCE = 1 << 22  # of texts that are cut into words together


def common_words(words: DataFrame, limit: int = HEAD) -> DataFrame:
    """The rows of ``words`` (word, n, ...) with at least so many uses that at most ``limit`` remain."""
    short = words.where(F.octet_length("word") <= HEAD_BYTES)
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    steps = short.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.col("step").desc()).collect()
    held = np.cumsum([r["words"] for r in steps])
    fitting = [r["n"] for r, total in zip(steps, held, strict=True) if total <= limit]
    return short.where(F.col("n") >= (min(fitting) if fitting else F.lit(1 << 62)))


def as_arrays(rows: DataFrame, value: str) -> tuple[pa.Array, np.ndarray]:
    """Words and values of a bounded table."""
    table = rows.select("word", value).toArrow().combine_chunks()
    return pa.array(table.column(0).to_pylist(), pa.binary()), table.column(1).to_numpy()


def words_in(texts: pa.Array) -> Iterator[tuple[int, int, pa.DictionaryArray, np.ndarray]]:
    """Some texts at a time: (first text, their number, all their words as coded bytes, the text of each word from 0).

    A-Z are lower-cased; words are what lies between blanks, the bytes 0x20 and 0x09 to 0x0D.
    """
    texts = texts.fill_null("")
    ends, first = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(first, last - first)))
        words, text = lists.flatten(), np.repeat(np.arange(last - first), np.diff(lists.offsets.to_numpy()))
        full = pc.not_equal(pc.binary_length(words), 0)  # blanks at an end leave an empty word
        yield first, last - first, words.filter(full).cast(pa.binary()).dictionary_encode(), text[full.to_numpy(zero_copy_only=False)]
        first = last


def places_in(words: pa.DictionaryArray, listed: pa.Array) -> np.ndarray:
    """The place in ``listed`` of each distinct word, -1 for the others."""
    found = pc.index_in(words.dictionary, value_set=listed).fill_null(-1)
    return found.to_numpy(zero_copy_only=False).astype(np.int64)


def with_values(docs: DataFrame, words: DataFrame, head: Broadcast) -> DataFrame:
    """``docs`` (row, doc_id, text) with the texts packed and the words that ``head`` lacks.

    Columns: row, doc_id, packed (zstd of the text, null stays), rest (array of word, value). ``words`` has
    word (binary) and value; ``head`` is ``as_arrays`` of some of it. Documents without other words get a null rest.
    """

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, coded, text in words_in(batch.column(1)):
                code = coded.indices.to_numpy()
                other = places_in(coded, head.value[0])[code] < 0
                distinct = np.unique(text[other] * len(coded.dictionary) + code[other])
                text, code = np.divmod(distinct, max(1, len(coded.dictionary)))
                yield pa.RecordBatch.from_arrays([pa.array(rows[first + text], pa.int64()), coded.dictionary.take(pa.array(code))], ["row", "word"])

    asked = docs.select("row", "text").mapInArrow(tidy(others), "row long, word binary")
    valued = asked.join(words.select("word", "value"), "word", "left")
    per_row = valued.groupBy("row").agg(F.collect_list(F.struct("word", "value")).alias("rest"))
    return packed_texts(docs).join(per_row, "row", "left")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, packed): the texts by zstd; null stays."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = (t.as_py() for t in batch.column(2))
            packed = [None if t is None else packer.compress(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["row", "doc_id", "packed"])

    return docs.select("row", "doc_id", "text").mapInArrow(tidy(pack), "row long, doc_id long, packed binary")


def unpacked(packed: bytes | None) -> str | None:
    import zstandard

    return None if packed is None else zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")
