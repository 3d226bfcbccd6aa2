"""Token ids in binary files of patched frame-of-reference blocks.

A file holds, for a stretch of documents in id order, blocks of 256 ids:

    minimum u32, width u8, bytes per exception u8, exceptions u16, packed lanes, positions, high parts

A block stores each id less the block's minimum in ``width`` bits, the width that the given percentile of
the ids needs; ids that need more keep their low bits there and their high part in the exception list. Eight
lanes of 32 ids each are packed side by side. The last block is filled up with its last id. After the blocks
follow the start of each block, the documents (id, a flag for null, number of ids) and a trailer with the counts.
All numbers are little-endian.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmap.llm.tokencount import CUT, byte_text, code_points, proven
from textmap.llm.workers import worker_cache
from textmap.session import stage, staging_path

BLOCK, LANES = 256, 8
DEPTH = BLOCK // LANES
HEADER = 8
MAGIC = b"PFOR0001"
TRAILER = "<QQQ8s"  # blocks, documents, ids, mark
TRAILER_SIZE = struct.calcsize(TRAILER)
CHUNK = 2048  # blocks packed or read at once
CACHED_CHUNKS = 1_000_000
CACHED_PIECES = 500_000
END_ID = 0


def pack(ids: np.ndarray, percentile: float = 0.9) -> tuple[bytes, np.ndarray]:
    """Blocks of ``ids`` (a whole number of blocks) as bytes, and the length of each block."""
    table = ids.astype(np.uint32).reshape(-1, BLOCK)
    low = table.min(axis=1)
    rest = table - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # exact: doubles hold 32 bits, and 0 needs none
    place = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(bits, place, axis=1)[:, place].astype(np.int64)
    high = rest.astype(np.uint64) >> width[:, None].astype(np.uint64)
    at_block, at = np.nonzero(high)
    high = high[at_block, at].astype(np.uint32)
    counts = np.bincount(at_block, minlength=len(table))
    most = np.zeros(len(table), np.uint32)
    np.maximum.at(most, at_block, high)
    each = np.where(counts == 0, 0, np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)))
    lengths = HEADER + 32 * width + counts * (1 + each)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(starts[-1], np.uint8)
    head = np.zeros((len(table), HEADER), np.uint8)
    head[:, :4] = low.astype("<u4")[:, None].view(np.uint8)
    head[:, 4], head[:, 5] = width, each
    head[:, 6:] = counts.astype("<u2")[:, None].view(np.uint8)
    out[starts[:-1, None] + np.arange(HEADER)] = head
    for w in np.unique(width):
        if not w:
            continue
        chosen = np.nonzero(width == w)[0]
        mask = np.uint32((1 << int(w)) - 1)
        lanes = (rest[chosen] & mask).reshape(len(chosen), DEPTH, LANES)
        words = np.zeros((len(chosen), int(w), LANES), np.uint32)
        for i in range(DEPTH):
            word, shift = divmod(i * int(w), 32)
            words[:, word] |= lanes[:, i] << np.uint32(shift)
            if shift + w > 32:
                words[:, word + 1] |= lanes[:, i] >> np.uint32(32 - shift)
        packed = words.astype("<u4").reshape(len(chosen), -1).view(np.uint8)
        out[(starts[chosen] + HEADER)[:, None] + np.arange(32 * int(w))] = packed
    if len(at):
        number = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = (starts[:-1] + HEADER + 32 * width)[at_block]
        out[begin + number] = at
        size, first = each[at_block], begin + counts[at_block]
        raw = high.astype("<u4")[:, None].view(np.uint8)
        for k in range(4):
            wide = size > k
            out[first[wide] + number[wide] * size[wide] + k] = raw[wide, k]
    return out.tobytes(), lengths


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(HEADER)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, each = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    counts = np.ascontiguousarray(head[:, 6:]).view("<u2")[:, 0].astype(np.int64)
    rest = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        chosen = np.nonzero(width == w)[0]
        packed = raw[(starts[chosen] + HEADER)[:, None] + np.arange(32 * int(w))]
        words = packed.view("<u4").reshape(len(chosen), int(w), LANES)
        mask = np.uint32((1 << int(w)) - 1)
        lanes = np.empty((len(chosen), DEPTH, LANES), np.uint32)
        for i in range(DEPTH):
            word, shift = divmod(i * int(w), 32)
            value = words[:, word] >> np.uint32(shift)
            if shift + w > 32:
                value = value | (words[:, word + 1] << np.uint32(32 - shift))
            lanes[:, i] = value & mask
        rest[chosen] = lanes.reshape(len(chosen), BLOCK)
    if counts.any():
        block = np.repeat(np.arange(len(starts)), counts)
        number = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = (starts + HEADER + 32 * width)[block]
        first = begin + counts[block]
        high = np.zeros(len(block), np.uint64)
        for k in range(4):
            wide = each[block] > k
            high[wide] |= raw[first[wide] + number[wide] * each[block][wide] + k].astype(np.uint64) << np.uint64(8 * k)
        place = (block, raw[begin + number])
        rest[place] |= (high << width[block].astype(np.uint64)).astype(np.uint32)
    return (rest + low[:, None]).reshape(-1)


def file_system(path: str):
    """The store behind ``path`` and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


class PforWriter:
    """Writes one file; ids are packed as soon as some blocks are full."""

    def __init__(self, stream, percentile: float = 0.9):
        self.stream, self.percentile = stream, percentile
        self.open: list[bytes] = []
        self.held = self.n_ids = self.at = 0
        self.starts, self.doc_ids, self.lengths = array("Q"), array("q"), array("Q")
        self.nulls = bytearray()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids as 32-bit numbers."""
        self.doc_ids.append(doc_id or 0), self.nulls.append(doc_id is None), self.lengths.append(len(ids) // 4)
        self.open.append(ids)
        self.held += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.held >= CHUNK * BLOCK:
            self._write(self.held // BLOCK * BLOCK)

    def _write(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.open), "<u4")
        for i in range(0, n, CHUNK * BLOCK):
            data, lengths = pack(ids[i : min(n, i + CHUNK * BLOCK)], self.percentile)
            self.starts.frombytes((self.at + np.cumsum(lengths) - lengths).astype(np.uint64).tobytes())
            self.at += len(data)
            self.stream.write(data)
        self.open, self.held = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        if self.held:
            short = -self.held % BLOCK
            last = b"".join(self.open)[-4:]
            self.open.append(last * short)
            self.held += short
            self._write(self.held)
        self.starts.append(self.at)
        for part in (self.starts, self.doc_ids, self.nulls, self.lengths):
            self.stream.write(bytes(part) if isinstance(part, bytearray) else part.tobytes())
        self.stream.write(struct.pack(TRAILER, len(self.starts) - 1, len(self.doc_ids), self.n_ids, MAGIC))
        self.stream.close()


def read_documents(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of an open file, in order; holds some blocks at a time."""
    size = source.size()
    source.seek(size - TRAILER_SIZE)
    n_blocks, n_docs, n_ids, magic = struct.unpack(TRAILER, source.read(TRAILER_SIZE))
    if magic != MAGIC:
        raise ValueError("not a file of this format")
    tail = 8 * (n_blocks + 1) + 17 * n_docs
    source.seek(size - TRAILER_SIZE - tail)
    raw = source.read(tail)
    starts = np.frombuffer(raw, "<u8", n_blocks + 1).astype(np.int64)
    at = 8 * (n_blocks + 1)
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
    nulls = np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(raw, "<u8", n_docs, at + 9 * n_docs)
    block, ready, held = 0, [], 0
    for i in range(n_docs):
        need = int(lengths[i])
        while held < need:
            to = min(n_blocks, block + CHUNK)
            source.seek(int(starts[block]))
            data = source.read(int(starts[to] - starts[block]))
            ready.append(unpack(data, starts[block:to] - starts[block]))
            held += len(ready[-1])
            block = to
        ids = np.concatenate(ready) if len(ready) > 1 else (ready[0] if ready else np.empty(0, np.uint32))
        yield (None if nulls[i] else int(doc_ids[i])), ids[:need]
        ready, held = [ids[need:]], held - need


class _Whole(Exception):
    """A stretch that can't be encoded apart from its text."""


class _Pieces(dict):
    """Pre-tokens and their ids, merged by the library when they are first met."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        ids = self[piece] = array("I", [t.id for t in self.merge(byte_text(piece))]).tobytes()
        return ids


class _Stretches(dict):
    """Stretches and their ids, each cut into pre-tokens when it is first met; ``lead`` stands before it."""

    def __init__(self, lead: str, cut, odd, pieces: _Pieces):
        super().__init__()
        self.lead, self.cut, self.odd, self.piece = lead, cut, odd, pieces.__getitem__

    def __missing__(self, stretch: str) -> bytes:
        if stretch.isascii() and stretch.isalpha():
            ids = self.piece(self.lead + stretch)
        # one that is empty or begins or ends in white space stands beside more of it
        elif not stretch or stretch.strip() != stretch or not (stretch.isascii() or not self.odd(stretch)):
            raise _Whole
        elif stretch.isalpha():  # letters alone, of which none is odd
            ids = self.piece(self.lead + stretch)
        else:
            ids = b"".join(map(self.piece, self.cut(self.lead + stretch)))
        if len(self) >= CACHED_CHUNKS:
            self.clear()
        self[stretch] = ids
        return ids


class ChunkEncoder:
    """Encodes texts with the library, each distinct stretch between blanks once, each distinct pre-token once.

    A byte-level pre-tokenizer cuts before every single blank, so a text's ids are those of its first
    stretch and of each further stretch with the blank before it. A new stretch is cut into pre-tokens, which the
    library merges. Texts with longer white space around a blank, or with code points for which our cut is not
    proven (``odd``), are encoded whole.
    """

    def __init__(self, path: str, odd: list[tuple[int, int]]):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        pieces = _Pieces(self.library.model.tokenize)
        cut, odd_in = regex.compile(CUT).findall, regex.compile(code_points(odd)).search
        self.first, self.later = (_Stretches(lead, cut, odd_in, pieces) for lead in ("", " "))

    def encode(self, texts: list[str]) -> list[bytes]:
        first, later = self.first.__getitem__, self.later.__getitem__
        out: list[bytes] = []
        whole: list[int] = []
        for text in texts:
            stretches = text.split(" ")
            try:
                out.append(first(stretches[0]) + b"".join(map(later, stretches[1:])))
            except _Whole:
                whole.append(len(out))
                out.append(b"")
        found = self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
        for i, e in zip(whole, found, strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out


TEXTS_AT_ONCE, CHARACTERS_AT_ONCE = 1500, 1 << 23


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded numbers of texts and of characters; one long text stays whole."""
    ends = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + CHARACTERS_AT_ONCE, side="right")))
        end = min(end, begin + TEXTS_AT_ONCE)
        yield batch.slice(begin, end - begin)
        begin = end


def _writer(folder: str, tokenizer: str, percentile: float):
    odd = proven(tokenizer)[1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = worker_cache("token-encoders")
        encoder = cache.get(tokenizer) or cache.setdefault(tokenizer, ChunkEncoder(tokenizer, odd))
        writer = path = part = None
        end = struct.pack("<I", END_ID)
        for batch in batches:
            for piece in _portions(batch):
                if writer is None:
                    path, part = f"{folder}/{uuid.uuid4().hex}.pfor", piece.column(2)[0].as_py()
                    store, inner = file_system(path)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    writer = PforWriter(store.open_output_stream(inner), percentile)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([path]), pa.array([len(writer.doc_ids)], pa.int64()),
                 pa.array([writer.n_ids], pa.int64())],
                ["part", "path", "n_docs", "n_ids"],
            )

    return write


def write_token_files(
    docs: DataFrame, tokenizer: str, percentile: float = 0.9, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every text, add the end id, store the ids in ascending ``id_col`` order; one row per file.

    Columns: part, path, n_docs, n_ids, start (ids in all files before). Files lie in the shared staging
    folder under names of their own for each attempt; only those of finished tasks are listed, so a lost
    executor leaves at most a file that nobody reads. Null texts are empty; null ids come first. Rows of one
    id are ordered by their text's hash. An empty table gives no file. Other columns play no part.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id().cast("long"))
    ranged = ranged.sortWithinPartitions(*order)
    files = ranged.mapInArrow(
        _writer(staging_path(spark, "token-files"), tokenizer, percentile), "part long, path string, n_docs long, n_ids long"
    )
    files = stage(files, "token-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, inner = file_system(path)
            found: list[list] = [[], [], [], []]
            with store.open_input_file(inner) as source:
                for doc_id, ids in read_documents(source):
                    row = (doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")))
                    start += len(ids)
                    for column, value in zip(found, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], READ.replace(" long", "").split(", "))


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 of its 32-bit ids; a task reads few files."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartitionByRange(n, "part").select("path", "start").mapInArrow(_read, READ)
