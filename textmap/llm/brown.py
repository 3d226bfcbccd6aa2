"""Class-based bigram model: exchange clustering, smoothed class transitions, word emissions.

log p(w | before) = log p(class of w | class before) + log p(w | class of w), where the class before is that of the
last known word, or of the end that precedes every text. Emissions are counts plus 1/2 within the class; transitions
fall back on the class shares. One unknown type with half a count, split over the classes by their words
seen once, completes the vocabulary, so all probabilities of a place sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.llm.lookup import BYTES_AT_ONCE, as_arrays, common_words, places_in, unpacked, with_values, words_in
from textmap.llm.workers import tidy
from textmap.session import few_tasks, short_batches, stage

CLASSES = 32
END = CLASSES  # the class of the end token
K = CLASSES + 1
EXCHANGED = 40_000  # at most so many of the commonest words move in rounds; all others are placed once after them
ROUNDS = 6
HALF = 0.5
AT_ONCE = BYTES_AT_ONCE * 7 // 8  # bytes of texts that reach a task together, cut into words at once
FALLBACK = 50.0  # weight of the class shares in a transition


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts; words as bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, coded, _ in words_in(batch.column(0)):
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select("text").mapInArrow(tidy(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ranks(coded: pa.DictionaryArray, text: np.ndarray, n_texts: int, listed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of all words with an end before, between and behind the texts, and where the words stand in it."""
    at = np.arange(len(text)) + text + 1
    ranks = np.full(len(text) + n_texts + 1, len(listed), np.int64)
    ranks[at] = places_in(coded, listed)[coded.indices.to_numpy()]
    return ranks, at


def _pairs(index):
    """Counts of neighbouring words, both exchanged ones or an end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = index.value
        end = len(listed)
        for batch in batches:
            for _, n_texts, coded, text in words_in(batch.column(0)):
                ranks, _ = _ranks(coded, text, n_texts, listed)
                before, after = ranks[:-1], ranks[1:]
                both = (before >= 0) & (after >= 0)
                keys, n = np.unique(before[both] * (end + 1) + after[both], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((keys // (end + 1)).astype(np.int32)), pa.array((keys % (end + 1)).astype(np.int32)), pa.array(n.astype(np.int64))],
                    ["a", "b", "n"],
                )

    return count


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, b and n as bytes, some rows in one, since every round reads them again."""
    for batch in batches:
        columns = [batch.column(i).to_numpy().astype(kind).tobytes() for i, kind in enumerate((np.int32, np.int32, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["a", "b", "n"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield [np.frombuffer(v.as_py(), kind).astype(np.int64) for v, kind in zip(row, (np.int32, np.int32, np.int64), strict=True)]


PER_WORD = "word int, slots array<int>, counts array<long>"


def _by_word(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per word with any count: its slots and their counts."""
    word, slot = np.nonzero(sums.reshape(-1, 2 * K))
    words, starts = np.unique(word, return_index=True)
    offsets = pa.array(np.append(starts, len(word)).astype(np.int32))
    slots = pa.ListArray.from_arrays(offsets, pa.array(slot.astype(np.int32)))
    counts = pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1, 2 * K)[word, slot].astype(np.int64)))
    yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), slots, counts], ["word", "slots", "counts"])


def _sides(classes: np.ndarray):
    """For each word the counts of the classes after (slots 0 to K - 1) and before it (K to 2K - 1), added up in the task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(classes) * 2 * K)
        for a, b, n in _unpacked(batches):
            after, before = classes[b] >= 0, classes[a] >= 0
            np.add.at(sums, a[after] * 2 * K + classes[b[after]], n[after].astype(float))
            np.add.at(sums, b[before] * 2 * K + K + classes[a[before]], n[before].astype(float))
        yield from _by_word(sums)

    return count


def _merged(n_words: int):
    """The rows of ``_sides`` added by word."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_words * 2 * K)
        for batch in batches:
            word = np.repeat(batch.column(0).to_numpy().astype(np.int64), np.diff(batch.column(1).offsets.to_numpy()))
            np.add.at(sums, word * 2 * K + batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(float))
        yield from _by_word(sums)

    return add


def _best_classes(sides: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The class of greatest likelihood for words with these neighbours; a word's own counts are left out of its class."""
    after, before = sides[:, :K], sides[:, K:]
    n = after.sum(axis=1) + before.sum(axis=1)
    m = matrix + 0.1
    size = m.sum(axis=1) + 1.0

    def value(after_, before_, rows, columns, total):
        return (after_ * np.log(rows)).sum(-1) + (before_ * np.log(columns)).sum(-1) - n * np.log(total)

    scores = after @ np.log(m).T + before @ np.log(m) - n[:, None] * np.log(size)[None, :]
    has = np.nonzero((own >= 0) & (own < CLASSES))[0]
    if len(has):
        c = own[has]
        rows = np.maximum(m[c] - after[has], 0.1)
        columns = np.maximum(m[:, c].T - before[has], 0.1)
        n_, n = n, n[has]
        scores[has, c] = value(after[has], before[has], rows, columns, np.maximum(size[c] - after[has].sum(axis=1), 1.0))
        n = n_
    return scores[:, :CLASSES].argmax(axis=1)


def _vectors(slots, counts) -> np.ndarray:
    out = np.zeros((len(slots), 2 * K))
    for i, (s, c) in enumerate(zip(slots, counts, strict=True)):
        np.add.at(out[i], np.asarray(s, np.int64), c)
    return out


def _moves(classes: np.ndarray, matrix: np.ndarray, turn: int):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column(0).to_numpy()
            sides = _vectors(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            best = _best_classes(sides, classes[word], matrix)
            # half of the placed words may move at a time, so that neighbours don't swap for ever
            stay = (classes[word] >= 0) & ((word + turn) % 2 == 0)
            best = np.where(stay, classes[word], best)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(best.astype(np.int32))], ["word", "class"])

    return move


def _after(classes: np.ndarray):
    """The class matrix of the counts that ``_sides`` gave."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((K, K))
        for batch in batches:
            if batch.num_rows:
                own = classes[batch.column(0).to_numpy()]
                sides = _vectors(batch.column(1).to_pylist(), batch.column(2).to_pylist())[:, :K]
                np.add.at(total, own[own >= 0], sides[own >= 0])
        flat = total.reshape(-1)
        at = np.nonzero(flat)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at].astype(np.int64))], ["cell", "n"])

    return count


def exchange(pairs: DataFrame, n_words: int) -> np.ndarray:
    """Classes of the ``n_words`` commonest words (by rank) and, last, of the end."""
    classes = np.full(n_words + 1, -1, np.int64)
    classes[: min(CLASSES, n_words)] = np.arange(min(CLASSES, n_words))
    classes[n_words] = END
    for turn in range(ROUNDS):
        sides = few_tasks(pairs).mapInArrow(tidy(_sides(classes)), PER_WORD).repartition("word")
        per_word = stage(sides.mapInArrow(tidy(_merged(n_words + 1)), PER_WORD), "brown-sides")
        matrix = _matrix(per_word.mapInArrow(_after(classes), "cell int, n long"), K * K).reshape(K, K)
        moves = per_word.where(F.col("word") < n_words).mapInArrow(_moves(classes, matrix, turn), "word int, class int")
        found = moves.toArrow()  # one row per exchanged word
        changed = classes.copy()
        changed[found.column(0).to_numpy()] = found.column(1).to_numpy()
        if (changed == classes).all():
            break
        classes = changed
    classes[classes < 0] = CLASSES - 1  # words that only ever meet words outside the exchange
    return classes


def class_matrix(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K * K)
        for a, b, n in _unpacked(batches):
            a, b = classes[a], classes[b]
            known = (a >= 0) & (b >= 0)
            total += np.bincount(a[known] * K + b[known], n[known], K * K)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["cell", "n"])

    return _matrix(pairs.mapInArrow(count, "cell int, n long"), K * K).reshape(K, K)


def _matrix(cells: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most classes x classes rows
        out[r["cell"]] = r["n"]
    return out


def _rare(index, classes: np.ndarray):
    """(word, cells) of the uses of a word outside the exchange, by some texts; a cell holds the classes before and after a use."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = np.append(classes, K)  # K: a neighbour outside the exchange
        for batch in batches:
            for _, n_texts, coded, text in words_in(batch.column(0)):
                ranks, at = _ranks(coded, text, n_texts, index.value)
                around, rare = lookup[ranks], np.flatnonzero(ranks[at] < 0)
                code = coded.indices.to_numpy()[rare]
                order = np.argsort(code, kind="stable")
                words, starts = np.unique(code[order], return_index=True)
                place = at[rare[order]]
                cells = pa.array((around[place - 1] * (K + 1) + around[place + 1]).astype(np.int16))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)).astype(np.int32)), cells)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(words)), lists], ["word", "cells"])

    return find


def _place(matrix: np.ndarray):
    def placed(words: pa.Array, sides: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        best = _best_classes(sides[:, : 2 * K], np.full(len(sides), -1), matrix)
        return pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(best.astype(np.int32))], ["word", "n", "class"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a word follow each other; the last word of a batch may go on in the next."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            coded, lists = batch.column(0).dictionary_encode(), batch.column(1)
            owner = np.repeat(coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy()))
            cells = lists.flatten().to_numpy().astype(np.int64)
            words, sides = coded.dictionary, np.zeros((len(coded.dictionary), 2 * K + 1))
            before, after = cells // (K + 1), cells % (K + 1)
            np.add.at(sides, (owner[after < K], after[after < K]), 1)
            np.add.at(sides, (owner[before < K], K + before[before < K]), 1)
            n = np.bincount(owner, minlength=len(words)).astype(np.int64)
            if held is not None and held[0][0] == words[0]:
                sides[0] += held[1][0]
                n[0] += held[2][0]
            elif held is not None:
                yield placed(*held)
            held = words[-1:], sides[-1:], n[-1:]
            yield placed(words[:-1], sides[:-1], n[:-1])
        if held is not None:
            yield placed(*held)

    return place


SCORED = "doc_id long, learnt boolean, n_tokens long, n_known long, base_score double, emitted double, cells array<int>, counts array<long>"


def _unpacked_parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Some rows at a time and their texts: packed texts may be much longer than they look."""
    texts, size, begin = [], 0, 0
    for end, packed in enumerate(batch.column(2), 1):
        texts.append(unpacked(packed.as_py()))
        size += len(texts[-1] or "")
        if size >= AT_ONCE or end == batch.num_rows:
            yield batch.slice(begin, end - begin), pa.array(texts, pa.string())
            texts, size, begin = [], 0, end


def _tokens(head, n_train: int, n_types: int, n_ends: int):
    """Per text: counts, the unigram score, the sum of emission numerators, and its transitions."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, values = head.value
        floor = n_train + HALF * (n_types + 1)
        end = n_ends * 64 + END if n_ends else -1
        for part, texts in (found for batch in batches for found in _unpacked_parts(batch)):
            for first, n_texts, coded, text in words_in(texts):
                batch = part.slice(first, n_texts)
                rest = batch.column(3).flatten()
                valued = pc.is_valid(rest.field("value"))
                rest_words, rest_values = rest.field("word").filter(valued), rest.field("value").filter(valued).to_numpy()
                place, other = places_in(coded, listed), places_in(coded, rest_words)
                code = np.full(len(place), -1, np.int64)
                code[other >= 0] = rest_values[other[other >= 0]]
                code[place >= 0] = values[place[place >= 0]]
                # all words in order, and an end behind each text
                size = np.bincount(text, minlength=n_texts) + 1
                starts = np.cumsum(size) - size
                codes = np.full(size.sum(), end, np.int64)
                codes[np.arange(len(text)) + text] = code[coded.indices.to_numpy()]
                known = codes >= 0
                n = np.where(known, codes >> 6, 0)
                to = np.where(known, codes & 63, K)
                # the class before: of the last known word, or of an end
                last = np.maximum.accumulate(np.where(known, np.arange(len(codes)), -1))
                last = np.concatenate([[-1], last[:-1]])
                context = np.where(last >= np.repeat(starts, size), to[last], END)
                width = K * (K + 1)
                owner = np.repeat(np.arange(n_texts), size)
                keys, counts = np.unique(owner * width + context * (K + 1) + to, return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(n_texts + 1) * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(size), pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                        pa.array(np.add.reduceat(np.log10((n + HALF) / floor), starts)),
                        pa.array(np.add.reduceat(np.where(known, np.log10(n + HALF), 0.0), starts)),
                        pa.ListArray.from_arrays(offsets, pa.array((keys % width).astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
                    ],
                    ["doc_id", "learnt", "n_tokens", "n_known", "base_score", "emitted", "cells", "counts"],
                )

    return score


def _log_chances(matrix: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """log10 of transition over the class's emission mass; the last column is the unknown type's whole chance."""
    n, types, single = totals
    unknown = HALF * (single / single.sum() if single.sum() else (n > 0) / max(1, (n > 0).sum()))
    mass = n + HALF * types + unknown
    share = mass / mass.sum()
    moves = (matrix[:, :K] + FALLBACK * share) / (matrix[:, :K].sum(axis=1, keepdims=True) + FALLBACK)
    held = np.where(mass > 0, mass, 1.0)
    with np.errstate(divide="ignore"):
        return np.log10(np.column_stack([moves / held, moves @ (unknown / held)]))


def _summed(chances: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(6)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            each = chances[lists.flatten().to_numpy()] * batch.column(7).flatten().to_numpy()
            score = batch.column(5).to_numpy() + np.bincount(owner, each, len(lists))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(score)], [*batch.schema.names[:5], "score"])

    return add


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(K * (K + 1))
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), len(total))
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["cell", "n"])


def score_texts(docs: DataFrame, learnt, id_col: str = "doc_id", text_col: str = "text", exchanged: int | None = None, head: int | None = None) -> DataFrame:
    """Per row: ``id_col``, learnt, n_tokens, n_known, train_tokens, base_score, score.

    ``learnt`` is the condition of the rows to learn from; all rows are scored. Null texts are empty and consist
    of their end. The commonest words (at most 40,000) are exchanged between the classes in rounds over their
    pair counts; every other word is placed once, by all its uses beside them. Class totals, transitions and the
    unigram model cover all learnt tokens. Without any row to learn from both scores are 0. Repeated rows count
    each for themselves. ``docs`` must be a scan of stored files; other columns play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), learnt.alias("learnt"),
    )
    train = rows.where("learnt").select("text")
    with short_batches(spark, AT_ONCE):
        counts = stage(count_words(train), "brown-counts")
        n_docs = train.count()
        n_words, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        n_train, n_types = n_words + n_docs, n_types + (n_docs > 0)

        common = common_words(counts, exchanged or EXCHANGED).orderBy(F.col("n").desc(), "word").toArrow()
        ranked = common.column(0).to_pylist()
        index = spark.sparkContext.broadcast(pa.array(ranked, pa.binary()))
        pairs = train.mapInArrow(tidy(_pairs(index)), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        pairs = stage(pairs.mapInArrow(_packed, "a binary, b binary, n binary"), "brown-pairs")
        classes = exchange(pairs, len(ranked))
        matrix = class_matrix(pairs, classes)
        uses = train.mapInArrow(tidy(_rare(index, classes)), "word binary, cells array<short>")
        placed = uses.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(_place(matrix)), "word binary, n long, class int")
        first = spark.createDataFrame(
            [(w, n, int(c)) for w, n, c in zip(ranked, common.column(1).to_pylist(), classes[:-1], strict=True)], "word binary, n long, class int"
        )
        words = stage(first.unionByName(placed).withColumn("value", F.col("n") * 64 + F.col("class")), "brown-words")

        per_class = words.groupBy("class").agg(
            F.sum("n").alias("n"), F.count("*").alias("types"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single")
        )
        totals = np.zeros((3, K))
        for r in per_class.collect():
            totals[:, r["class"]] = r["n"], r["types"], r["single"]
        totals[:, END] = n_docs, n_docs > 0, 0
        known = spark.sparkContext.broadcast(as_arrays(common_words(words) if head is None else common_words(words, head), "value"))
        valued = with_values(rows, words, known)
        flags = rows.select("row", "learnt")
        full = valued.join(flags, "row").select("doc_id", "learnt", "packed", "rest")
        told = stage(full.mapInArrow(tidy(_tokens(known, n_train, n_types, n_docs)), SCORED), "brown-told")
        moves = _matrix(told.where("learnt").select("cells", "counts").mapInArrow(_transitions, "cell int, n long"), K * (K + 1))
    if n_train:
        chances = _log_chances(moves.reshape(K, K + 1), totals).reshape(-1)
        done = told.mapInArrow(_summed(chances), SCORED.split(", emitted")[0] + ", score double")
    else:
        done = told.select("doc_id", "learnt", "n_tokens", "n_known", "base_score", F.col("base_score").alias("score"))
    return done.select(
        F.col("doc_id").alias(id_col), "learnt", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score"
    )
