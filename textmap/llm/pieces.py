"""Texts as pieces of a SentencePiece vocabulary: a relational lattice and a Viterbi fold.

A text gets a blank in front and is cut into words where no piece of the model can cross: before a blank, around a
line end, between an ASCII mark and a character that touches no such mark in any piece. Each distinct word
of up to 48 characters becomes a lattice: its substrings of bounded length are joined to the piece
table, the matches are its edges, and the lattices of a block of words are folded together, place by place from left
to right. The best path has the largest sum of piece values; of equal sums the one whose last piece starts later. A character that no
piece holds is spelled in bytes. Pieces of a unigram model count by their log-probability; pieces of a model
of merges, whose scores are ranks, by minus the logarithm of the rank. Longer words (texts without blanks,
addresses, divider lines) are folded whole where their text lies, by the same rule, in time linear in their length.

Texts travel in chunks of some megabytes, compressed together. A chunk is cut as one array of bytes, so that Python
only meets its distinct words; the ids of those that are not common come back by their places in the chunk.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.llm.lookup import HEAD_BYTES, common_words
from textmap.llm.workers import tidy
from textmap.session import fits_broadcast, release, short_batches, shuffles_removed, stage

SPACE = "▁"
LONG = 48  # characters of a word that becomes a lattice of rows
SPREAD = 4
BLOCK = 40_000  # edges of words that are folded together
HEAD = 300_000  # so many of the commonest words go to all tasks
FLUSH = 1_000_000  # bytes of text in a chunk, if it has several texts
SENT = 4 << 20  # bytes of rows that reach Python at once
COUNTED = 1_000_000  # words of chunks that are counted together before they leave a task
MANY_WORDS = r"(?s).+"
DECODED = 100_000  # so many ids become text at once, for small buffers
PREFIX = 4  # substrings are tried in the sizes of the pieces that begin with the same four characters
SPELLED = -30.0  # value of a byte; below every piece


def of_several_words(held: list[str]) -> bool:
    return any("\n" in p or " " in p.replace(SPACE, " ").lstrip(" ") for p in held)


def touching_marks(held: list[str]) -> list[str]:
    """The characters that stand beside an ASCII mark in a piece."""
    marks = set(string.punctuation)
    return sorted({x for p in held for a, b in zip(p, p[1:]) for x, y in ((a, b), (b, a)) if y in marks} - marks - {SPACE})


def cuts(held: list[str]) -> str:
    """The pattern of the words of a text. No piece of ``held`` reaches over the end of a match."""
    if of_several_words(held):
        return MANY_WORDS
    mark = re.escape(string.punctuation)
    plain = f"[^ \\n{SPACE}{mark}{re.escape(''.join(touching_marks(held)))}]"
    turn = rf"(?<={plain})(?=[{mark}])|(?<=[{mark}])(?={plain})"
    return rf" *(?:{plain}+(?=[ \n{mark}]|\Z)|[{mark}]+(?=[ \n]|{plain}|\Z)|[^ \n]+?(?:{turn}|(?=[ \n])|\Z))| +|\n"


def splitter(pattern: str) -> Callable[[str | None], list[str]]:
    """A function that cuts a text into words."""
    return lambda text: re.findall(pattern, f" {text}") if text else []


class Stretches:
    """The words of texts by stretches between single blanks, so that a distinct stretch need be cut only once.

    Words never reach over a blank that stands alone, so a text's words are those of its stretches, each with the
    blank before it. Texts with blanks side by side or at an end are one stretch, as are all texts of a model whose
    pieces hold several words.
    """

    def __init__(self, pattern: str):
        self.split, self.whole = splitter(pattern), pattern == MANY_WORDS

    def of(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.whole or "  " in text or text[0] == " " or text[-1] == " ":
            return [text]
        return text.split(" ")


class Cutter:
    """Cuts many texts at once into the words of ``cuts``: whether two characters part depends on their kinds alone.

    Kinds are given to bytes. All bytes of a character are of its kind, and a kind that holds characters of several
    bytes does not part from itself.
    """

    BLANK, LINE, MARK, PLAIN, OTHER = range(5)

    def __init__(self, held: list[str]):
        other = [SPACE, *touching_marks(held)]
        self.kinds = np.full(256, self.PLAIN, np.uint8)
        for kind, members in ((self.OTHER, [x for x in other if x < "\x80"]), (self.MARK, string.punctuation), (self.LINE, "\n"), (self.BLANK, " ")):
            self.kinds[[ord(x) for x in members]] = kind
        self.wide = [x.encode() for x in other if x >= "\x80"]
        self.leads = np.zeros(256, bool)
        self.leads[[x[0] for x in self.wide]] = True
        self.coded = np.unique([int.from_bytes(x, "big") for x in self.wide])
        apart = np.zeros((8, 8), bool)
        if not of_several_words(held):
            apart[:, self.BLANK] = apart[:, self.LINE] = apart[self.LINE] = True
            apart[self.BLANK, self.BLANK] = False
            apart[self.PLAIN, self.MARK] = apart[self.MARK, self.PLAIN] = True
        self.apart = apart.ravel()

    def words(self, texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
        """All words of the texts as bytes, whether each is long, and the words of each text; null is empty."""
        texts = texts.fill_null("")
        fronted = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        bounds = np.frombuffer(fronted.buffers()[1], np.int32)[fronted.offset : fronted.offset + len(fronted) + 1]
        if bounds[0] == bounds[-1]:
            return pa.array([], pa.binary()), np.zeros(0, bool), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(fronted.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        kind = self.kinds[raw]
        for size in {len(x) for x in self.wide}:
            place = np.flatnonzero(self.leads[raw[: len(raw) - size + 1]])
            code = np.zeros(len(place), np.int64)
            for k in range(size):
                code = code << 8 | raw[place + k]
            place = place[np.isin(code, self.coded)]
            for k in range(size):
                kind[place + k] = self.OTHER
        starts = np.empty(len(raw), bool)
        starts[1:] = self.apart[kind[:-1] << 3 | kind[1:]]
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        at = np.flatnonzero(starts)
        sizes = np.diff(np.append(at, len(raw)))
        long = sizes > LONG
        for i in np.flatnonzero(long):  # bytes so far
            long[i] = np.count_nonzero((raw[at[i] : at[i] + sizes[i]] & 0xC0) != 0x80) > LONG
        offsets = np.append(at, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        return words, long, np.diff(np.searchsorted(at, bounds))


class Pieces:
    """The piece table of a model file."""

    def __init__(self, model: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = library.vocab_size()
        plain = [i for i in range(n) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        scores = [library.get_score(i) for i in plain]
        ranked = min(scores) < -1000  # ranks of merges instead of log-probabilities
        self.rows = [
            (library.id_to_piece(i), i, float(-np.log(1.0 - s)) if ranked else float(s)) for i, s in zip(plain, scores, strict=True)
        ]
        self.first_byte = next(i for i in range(n) if library.is_byte(i))
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.cuts = cuts([p for p, _, _ in self.rows])
        self.cutter = Cutter([p for p, _, _ in self.rows])
        self.values = np.full(n, -np.inf)
        self.values[plain] = [value for _, _, value in self.rows]
        self.kind = "<u2" if n <= 1 << 16 else "<u4"  # of ids that travel
        self.bytes = [b""] * n
        for piece, i, _ in self.rows:
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        for b in range(256):
            self.bytes[self.first_byte + b] = bytes([b])

    def spelling(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A function from ids to the bytes that they spell, one after another, and the number of each one's."""
        sizes = np.array([len(b) for b in self.bytes], np.int64)
        starts = np.cumsum(sizes) - sizes
        joined = np.frombuffer(b"".join(self.bytes), np.uint8)

        def bytes_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            steps = [ids[i : i + DECODED] for i in range(0, len(ids), DECODED)]
            found = [slices(joined, starts[part], sizes[part]) for part in steps]
            return np.concatenate([np.zeros(0, np.uint8), *found]), sizes[ids]

        return bytes_of

    def decoder(self) -> Callable[[np.ndarray], str]:
        """A function from ids to the text that they spell, without the blank in front."""
        bytes_of = self.spelling()
        return lambda ids: bytes_of(ids)[0].tobytes()[1:].decode("utf-8", "surrogatepass")

    def table(self, spark: SparkSession) -> DataFrame:
        if not fits_broadcast(sum(len(p) * 4 + 12 for p, _, _ in self.rows)):
            raise ValueError("a piece table is expected to fit into memory")
        return spark.createDataFrame(self.rows, "piece string, id int, score double")

    def prefixes(self) -> dict[str, list[int]]:
        """prefix -> the sizes above 1 of all pieces that can start where it stands."""
        held = {piece for piece, _, _ in self.rows}
        found: dict[str, set[int]] = {}
        for piece in held:
            if len(piece) >= PREFIX:
                found.setdefault(piece[:PREFIX], set()).add(len(piece))
        return {q: sorted(sizes.union(k for k in range(2, PREFIX) if q[:k] in held)) for q, sizes in sorted(found.items())}

    def sizes(self, spark: SparkSession) -> DataFrame:
        """``prefixes`` as rows (prefix, sizes)."""
        return spark.createDataFrame(list(self.prefixes().items()), "prefix string, sizes array<int>")


def slices(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """So many of the values from each start, one after another."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return values[at]


def folder(rows: list[tuple[str, int, float]], sizes: dict[str, list[int]], first_byte: int) -> Callable[[str], bytes]:
    """A function from a word of any length to the ids of its best path, as ``segment`` finds it."""
    known = {piece: (i, value) for piece, i, value in rows}
    short = range(2, PREFIX)

    def ids_of(word: str) -> bytes:
        shape = word.translate({ord(" "): SPACE, ord(SPACE): "\uffff"})
        n = len(shape)
        total, before, code = array("d", [-np.inf]) * (n + 1), array("q", [0]) * (n + 1), array("q", [0]) * (n + 1)
        total[0] = 0.0
        for start in range(n):
            here = total[start]
            i, value = known.get(shape[start]) or (-1, SPELLED * len(word[start].encode("utf-8", "surrogatepass")))
            if here + value >= total[start + 1]:  # of equal sums the later start
                total[start + 1], before[start + 1], code[start + 1] = here + value, start, i
            for size in sizes.get(shape[start : start + PREFIX], short):
                piece = known.get(shape[start : start + size]) if start + size <= n else None
                if piece and here + piece[1] >= total[start + size]:
                    total[start + size], before[start + size], code[start + size] = here + piece[1], start, piece[0]
        found, place = array("I"), n
        while place:
            if code[place] < 0:
                spelled = word[before[place]].encode("utf-8", "surrogatepass")
                found.extend(first_byte + b for b in reversed(spelled))
            else:
                found.append(code[place])
            place = before[place]
        return np.array(found, "<u4")[::-1].tobytes()

    return ids_of


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.Table]:
    """The rows again, as tables of some texts: as many as reach FLUSH bytes, wherever batches end."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        first, gone = 0, 0
        while first < len(ends):
            last = int(np.searchsorted(ends, gone + FLUSH - size)) + 1
            held.append(batch.slice(first, last - first))
            if last > len(ends):
                size += int(ends[-1]) - gone
                break
            yield pa.Table.from_batches(held).combine_chunks()
            held, size, first, gone = [], 0, last, int(ends[last - 1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def texts_in(chunk: pa.Table) -> pa.StringArray:
    return pa.concat_arrays(chunk.column("text").cast(pa.string()).chunks)


def words_of(docs: DataFrame, cutter: Broadcast) -> DataFrame:
    """(word, n): the distinct words of all texts and their uses, without the long ones."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def counted():
            table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.Table.from_arrays([table.column("word").cast(pa.string()), table.column("n_sum")], ["word", "n"]).to_batches()

        for chunk in chunks(batches):
            words, long, _ = cutter.value.words(texts_in(chunk))
            found = words.filter(pa.array(~long)).value_counts()
            held.append(pa.Table.from_arrays([found.field("values"), found.field("counts")], ["word", "n"]))
            rows += len(found)
            if rows >= COUNTED:
                yield from counted()
                held, rows = [], 0
        if held:
            yield from counted()

    return docs.select("text").mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def best_paths(words: list[str], own: np.ndarray, ways: np.ndarray, values: np.ndarray, first_byte: int) -> list[np.ndarray]:
    """The ids of the best path of each word.

    ``ways`` are the edges of all lattices in any order, ((to * (LONG + 1) + from) << 32) + code, and ``own`` the word
    of each. A code below zero is a character that no piece holds, by minus the number of its bytes.
    """
    place = ways + (1 << 31) >> 32
    end, start = np.divmod(place, LONG + 1)
    order = np.argsort((end * len(words) + own) * (LONG + 1) + start)
    word, start, end, code = own[order], start[order], end[order], (ways - (place << 32))[order]
    value = np.where(code < 0, SPELLED * -code, values[np.maximum(code, 0)])
    places = int(end[-1]) + 1
    total, before, taken = np.full((len(words), places), -np.inf), np.zeros((len(words), places), np.int64), np.zeros((len(words), places), np.int64)
    total[:, 0] = 0.0
    bounds = np.searchsorted(end, np.arange(1, places + 1))
    for place, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 1):
        here, from_, taking = word[low:high], start[low:high], code[low:high]
        sums = total[here, from_] + value[low:high]
        heads = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
        best = np.maximum.reduceat(sums, heads)
        equal = sums == np.repeat(best, np.diff(np.append(heads, high - low)))
        last = np.maximum.reduceat(np.where(equal, np.arange(high - low), -1), heads)  # of equal sums the later start
        total[here[heads], place], before[here[heads], place], taken[here[heads], place] = best, from_[last], taking[last]
    lengths = np.zeros(len(words), np.int64)
    np.maximum.at(lengths, word, end)
    left, place = np.arange(len(words)), lengths.copy()
    steps = []
    while len(left):
        steps.append((left, before[left, place], taken[left, place]))
        place = steps[-1][1]
        left, place = left[place > 0], place[place > 0]
    own, from_, codes = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
    order = np.argsort(own, kind="stable")
    own, from_, codes = own[order], from_[order], codes[order]
    paths = np.split(codes, np.cumsum(np.bincount(own, minlength=len(words)))[:-1])
    for w in np.unique(own[codes < 0]):
        spelled = [[c] if c >= 0 else [first_byte + b for b in words[w][f].encode("utf-8", "surrogatepass")] for f, c in zip(from_[own == w], paths[w], strict=True)]
        paths[w] = np.array(sum(spelled, []))
    return paths


def best_values(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``words`` (word, n) with value, the ids of the best path as bytes. ``words`` must be a scan of stored files."""
    spark = words.sparkSession
    table = F.broadcast(pieces.table(spark).select("piece", "id"))  # the fixed vocabulary of the model, checked
    # a word opens into some thirty rows, so tasks take few words; a task's words are numbered as they come
    spread = words.repartition(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    # blanks are the marks of the pieces; a mark in the text itself matches no piece
    shape = F.translate("word", f" {SPACE}", f"{SPACE}\uffff")
    numbered = spread.select(F.monotonically_increasing_id().alias("at"), "word", "n", shape.alias("shape"))
    starts = numbered.select("at", "word", "n", "shape", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    # no more prefixes than pieces, whose table has been checked
    near = starts.withColumn("prefix", F.substring("shape", F.col("start"), F.lit(PREFIX))).join(F.broadcast(pieces.sizes(spark)), "prefix", "left")
    short = F.array(*[F.lit(k) for k in range(2, PREFIX)])
    tried = F.concat(F.array(F.lit(1)), F.coalesce("sizes", short))
    spans = near.select("at", "word", "n", "start", "shape", F.explode(tried).alias("size")).where("start + size - 1 <= length(shape)")
    parts = spans.withColumn("piece", F.substring("shape", F.col("start"), F.col("size")))
    edges = parts.join(table, "piece", "left").where("id is not null or size = 1")
    # a character without a piece: minus the number of its bytes
    code = F.coalesce("id", -F.octet_length(F.substring("word", F.col("start"), F.lit(1))))
    first = (F.col("start") == 1) & (F.col("size") == 1)
    # its end, its start and its code as one number: rows of few columns reach Python sooner
    way = ((F.col("start") + F.col("size") - 1) * (LONG + 1) + F.col("start") - 1).cast("long") * (1 << 32) + code
    lattice = edges.select("at", way.alias("way"), F.when(first, F.col("word")).alias("word"), F.when(first, F.col("n")).alias("n"))
    values, first_byte, kind = pieces.values, pieces.first_byte, pieces.kind

    def folded(block: pa.Table) -> pa.RecordBatch:
        heads = block.filter(pc.is_valid(block.column("word"))).combine_chunks()
        own = np.searchsorted(heads.column("at").to_numpy(), block.column("at").to_numpy())
        paths = best_paths(heads.column("word").to_pylist(), own, block.column("way").to_numpy(), values, first_byte)
        found = pa.array([path.astype(kind).tobytes() for path in paths], pa.binary())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(heads.column(c).chunks) for c in ("word", "n")] + [found], ["word", "n", "value"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, -1
        for batch in batches:
            if not len(batch):
                continue
            at = batch.column("at").to_numpy()
            if at[0] < last or np.any(at[1:] < at[:-1]):
                raise RuntimeError("the edges of a word came apart")
            last = at[-1]
            held.append(batch)
            rows += len(batch)
            if rows >= BLOCK and held[0].column("at")[0].as_py() != last:
                block = pa.Table.from_batches(held)
                whole = int(np.searchsorted(block.column("at").to_numpy(), last))  # the last word may go on
                yield folded(block.slice(0, whole))
                held = block.slice(whole).to_batches()
                rows -= whole
        if held:
            yield folded(pa.Table.from_batches(held))

    return lattice.mapInArrow(tidy(fold), "word string, n long, value binary")


def segment(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``words`` (word, n) with ids, the pieces of the best path. ``words`` must be a scan of stored files."""
    kind = pieces.kind

    def as_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(v, kind).astype(np.int32) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return best_values(words, pieces).mapInArrow(as_ids, "word string, n long, ids array<int>")


class Chunk:
    """The texts of a chunk as numbers: words of ``head`` by their place there, then the others in order, then the long ones."""

    def __init__(self, texts: pa.StringArray, cutter: Cutter, head: dict[bytes, int]):
        words, long, self.n_words = cutter.words(texts)
        coded = words.dictionary_encode()
        codes, listed = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(head.get, listed, repeat(-1)), np.int64, len(listed))
        is_long = np.zeros(len(listed), bool)
        is_long[codes[long]] = True
        others, long_ones = np.flatnonzero((numbers < 0) & ~is_long), np.flatnonzero(is_long)
        ordered = others[pc.array_sort_indices(coded.dictionary.take(pa.array(others))).to_numpy()]
        self.lacking = coded.dictionary.take(pa.array(ordered))
        self.long = [listed[i] for i in long_ones]
        numbers[ordered] = len(head) + np.arange(len(ordered))
        numbers[long_ones] = len(head) + len(ordered) + np.arange(len(long_ones))
        self.numbers = numbers.astype("<u4")[codes]


ENCODED = "doc_id long, n_words long, ids array<int>, decoded string"


def encode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", head: int | None = None,
    then: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], str] | None = None,
) -> DataFrame:
    """(``id_col``, n_words, ids, decoded) of every row; ``decoded`` is made from the ids alone.

    ``then``: a function of these batches and the columns it gives instead, applied in the task that makes them.
    Null texts have null ids and stay null; empty texts have no ids. Any other text decodes to itself. Rows are
    handled each for themselves, so repeated and null ids do no harm; other columns play no part. ``docs``
    must be a scan of stored files, whose rows keep their numbers.
    """
    spark = docs.sparkSession
    pieces = Pieces(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cutter = spark.sparkContext.broadcast(pieces.cutter)
    with shuffles_removed(spark), short_batches(spark, SENT):
        found = stage(words_of(rows, cutter), "piece-found")
        words = stage(best_values(found, pieces), "piece-words")
    release(found)
    common = common_words(words, HEAD if head is None else head).select("word", "n", "value").toArrow()  # short words, a bounded number
    common = common.sort_by([("n", "descending")])
    listed = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(common.column("word").to_pylist())}
    known = spark.sparkContext.broadcast(listed)
    valued = spark.sparkContext.broadcast(_flat(common.column("value").to_pylist(), pieces.kind))
    table = spark.sparkContext.broadcast((pieces.rows, pieces.prefixes(), pieces.first_byte))
    least = pc.min(common.column("n")).as_py()
    rest = words if least is None else words.where((F.col("n") < least) | (F.octet_length("word") > HEAD_BYTES))
    bytes_of, kind = pieces.spelling(), pieces.kind

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts = valued.value
        for batch in batches:
            for row in range(len(batch)):
                doc_ids, n_words, numbers, lacking, long = _unpacked(batch.slice(row, 1))
                rest = [v[4:] for v in sorted(batch.column("rest")[row].as_py() or [])]
                if len(rest) != lacking:
                    raise RuntimeError("a chunk lacks values of words; the input changed between two scans")
                own, more = _flat(rest + long, kind)
                values, begins = np.concatenate([flat, own]), np.concatenate([starts[:-1], len(flat) + more])
                first, sizes = begins[numbers], np.diff(begins)[numbers]
                ids = slices(values, first, sizes).astype(np.int32)
                n_ids = _sums(sizes, _offsets(np.maximum(n_words, 0)))
                raw, n_bytes = bytes_of(ids)
                size = _sums(n_bytes, _offsets(n_ids))
                decoded = np.delete(raw, _offsets(size)[:-1][size > 0])  # without the blank in front
                lists = pa.ListArray.from_arrays(pa.array(_offsets(n_ids), pa.int32()), pa.array(ids), mask=pa.array(n_words < 0))
                offsets = pa.py_buffer(_offsets(size - (size > 0)).astype(np.int32))
                texts = pa.Array.from_buffers(pa.string(), len(n_words), [pa.array(n_words >= 0).buffers()[1], offsets, pa.py_buffer(decoded)])
                columns = [doc_ids, pa.array(np.maximum(n_words, 0), pa.int64()), lists, texts]
                made = pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "ids", "decoded"])
                yield made if then is None else then[0](made)

    packed = _with_rest(rows, rest, cutter, known, table, kind)
    found = packed.mapInArrow(tidy(assemble), ENCODED if then is None else then[1])
    return found.withColumnRenamed("doc_id", id_col)


def _flat(values: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all values one after another, and where each value starts, with the end."""
    return np.frombuffer(b"".join(values), kind), _offsets(np.array([len(v) for v in values], np.int64) // np.dtype(kind).itemsize)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(_offsets(values)[offsets])


def _unpacked(chunk: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, int, list[bytes]]:
    """doc_id and words of the rows of a packed chunk (-1: null text), all numbers, how many words lack values, the long ones' values."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    n_words = chunk.column("n_words").flatten().to_numpy()
    n = int(np.maximum(n_words, 0).sum())
    planes = np.frombuffer(unpacker.decompress(chunk.column("packed")[0].as_py(), max_output_size=4 * n), np.uint8) if n else np.zeros(0, np.uint8)
    numbers = np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()
    long = [unpacker.decompress(x) for x in chunk.column("long")[0].as_py()]
    return chunk.column("doc_ids").flatten(), n_words, numbers, chunk.column("lacking")[0].as_py(), long


def _with_rest(rows: DataFrame, words: DataFrame, cutter: Broadcast, known: Broadcast, table: Broadcast, kind: str) -> DataFrame:
    """Each chunk of texts packed as numbers of its words, and the values of those that ``known`` lacks, each behind its place."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            asked = Chunk(texts_in(chunk), cutter.value, known.value).lacking
            number = pa.array(np.full(len(asked), chunk.column("row")[0].as_py()), pa.int64())
            places = pa.Array.from_buffers(pa.binary(4), len(asked), [None, pa.py_buffer(np.arange(len(asked), dtype=">u4"))])
            yield pa.RecordBatch.from_arrays([number, places.cast(pa.binary()), asked.cast(pa.string())], ["chunk", "place", "word"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        ids_of = folder(*table.value)
        for rows in chunks(batches):
            texts = texts_in(rows)
            chunk = Chunk(texts, cutter.value, known.value)
            n_words = np.where(texts.is_null().to_numpy(zero_copy_only=False), -1, chunk.n_words)
            planes = np.ascontiguousarray(chunk.numbers.view(np.uint8).reshape(-1, 4).T)  # the high bytes are mostly alike
            long = [np.frombuffer(ids_of(w.decode("utf-8", "surrogatepass")), "<u4").astype(kind).tobytes() for w in chunk.long]
            columns = [
                pa.array([rows.column("row")[0].as_py()], pa.int64()), pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([n_words], pa.list_(pa.int64())), pa.array([packer.compress(planes.tobytes())], pa.binary()),
                pa.array([len(chunk.lacking)], pa.int32()), pa.array([[packer.compress(x) for x in long]], pa.list_(pa.binary())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "n_words", "packed", "lacking", "long"])

    asked = rows.select("row", "text").mapInArrow(tidy(ask), "chunk long, place binary, word string")
    valued = asked.join(words.select("word", "value"), "word").select("chunk", F.concat("place", "value").alias("value"))
    per_chunk = valued.groupBy("chunk").agg(F.collect_list("value").alias("rest"))
    packed = rows.mapInArrow(tidy(pack), "chunk long, doc_ids array<long>, n_words array<long>, packed binary, lacking int, long array<binary>")
    return packed.join(per_chunk, "chunk", "left")


DIGEST = "doc_id long, n_words long, n_pieces long, ids_crc32 long, text_crc32 long"


def digested(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Per encoded row: doc_id, n_words, n_pieces, ids_crc32, text_crc32 of the decoded text."""
    lists = batch.column(2)
    held = lists.is_valid().to_pylist()
    bounds = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    cut = [values[a:b] if ok else None for ok, a, b in zip(held, bounds[:-1], bounds[1:], strict=True)]
    sizes = [None if c is None else len(c) for c in cut]
    sums = [None if c is None else zlib.crc32(np.ascontiguousarray(c, "<u4")) for c in cut]
    texts = [None if x is None else zlib.crc32(x) for x in (t.as_py() for t in batch.column(3).cast(pa.binary()))]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (sizes, sums, texts)]],
        ["doc_id", "n_words", "n_pieces", "ids_crc32", "text_crc32"],
    )


def without_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    """An encoded batch without the decoded texts."""
    return batch.select(["doc_id", "n_words", "ids"])
