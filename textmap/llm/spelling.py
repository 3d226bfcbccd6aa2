"""Spelling variants: letter counts of words in blocks, multiplied as matrices.

A change of one letter moves the letter counts of a word by a squared distance of 1 (a letter more or less) or 2 (one
for another). So words are dealt into blocks by their counts of letter groups, which also fixes their length; two
near words lie in one block or in two neighbouring ones. For each two such blocks NumPy multiplies the letter-count
matrices (a Gram matrix), which gives all squared distances at once; pairs at most two apart are then compared letter
by letter. Large blocks are cut, and every cut meets every cut of the neighbour.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmap.llm.stretches import stretches
from textmap.session import stage

HELD = 500_000  # words that a task counts before it hands them on
GROUPS = 6
BLOCK = 4096  # words of usual length in a block; longer words count for more
USUAL = 16
SLICE = 1 << 22  # distances held at once
LINKS_HELD = 1 << 16  # links held before they are handed on
EXACT = 1000  # from this length on, counts are multiplied in double precision

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 192 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_ALPHABET = [chr(b) for b in (*range(97, 123), *range(192, 256))]


def _count(least: int, typo_every: int):
    """A counter of runs of letters; where ``typo_every`` divides a run's hash in its document, the run loses a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            held = [(w.decode("latin-1"), n) for w, n in words.items() if len(w) >= least and n]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in stretches(text.as_py().encode("latin-1", "replace").translate(_LETTERS)):
                    runs = part.split()
                    words.update(runs)
                    for run in set(runs):
                        hashed = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
                        if hashed % typo_every == 0:
                            uses, at = runs.count(run), hashed % len(run)
                            words[run] -= uses
                            words[run[:at] + run[at + 1 :]] += uses
                if len(words) > HELD:
                    yield out()
                    words.clear()
        yield out()

    return count


def word_counts(docs: DataFrame, min_length: int = 5, typo_every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all runs of letters with at least ``min_length`` letters; null texts have none, a null id hashes as ''."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    words = rows.where("text is not null").mapInArrow(_count(min_length, typo_every), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def _cell(word: str) -> Column:
    """How many letters of each group a word has."""
    return F.array(*[
        F.length(F.regexp_replace(word, "[^" + "".join(_ALPHABET[g::GROUPS]) + "]", "")) for g in range(GROUPS)
    ])


def _neighbours(cell: str) -> Column:
    """The cell itself, those with one letter moved to a later group, and those with one letter more.

    Every two neighbouring cells are met once, from one of them.
    """
    moves = [(None, None)] + [(i, j) for i in range(GROUPS) for j in range(i + 1, GROUPS)] + [(None, j) for j in range(GROUPS)]
    return F.array(*[
        F.array(*[F.col(cell)[g] + F.lit((g == j) - (g == i)) for g in range(GROUPS)]) for i, j in moves
    ])


def blocks(words: DataFrame) -> DataFrame:
    """(cell, sub, subs, words, counts): each cell's words in blocks of bounded size, sorted."""
    placed = words.withColumn("cell", _cell("word"))
    weight = F.greatest(F.lit(USUAL), F.length("word"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.sum(weight) / F.lit(BLOCK * USUAL)).cast("int").alias("subs"))
    cut = placed.join(sizes, "cell").withColumn("sub", F.expr("cast(pmod(xxhash64(word), subs) as int)"))
    rows = F.array_sort(F.collect_list(F.struct("word", "n")))
    return cut.groupBy("cell", "sub", "subs").agg(rows.alias("rows")).select(
        "cell", "sub", "subs", F.col("rows.word").alias("words"), F.col("rows.n").alias("counts")
    )


def letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length as rows of letters, and how often each has each letter."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    spots = np.arange(len(words))[:, None] * 256 + letters
    return letters, np.bincount(spots.ravel(), minlength=256 * len(words)).reshape(-1, 256)


def near_pairs(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the words of two blocks that differ by exactly one replaced, inserted or deleted letter.

    The words of a block have one length; those of ``right`` are as long or one letter longer.
    """
    (a, counts_a), (b, counts_b) = letter_counts(left), letter_counts(right)
    used = np.nonzero(counts_a.any(axis=0) | counts_b.any(axis=0))[0]
    kind = np.float32 if b.shape[1] < EXACT else np.float64
    x, y = counts_a[:, used].astype(kind), counts_b[:, used].astype(kind)
    # |x - y|^2 as one product: (x, |x|^2, 1) . (-2 y, 1, |y|^2)
    x = np.hstack([x, (x * x).sum(axis=1)[:, None], np.ones((len(x), 1), kind)])
    y = np.hstack([-2 * y, np.ones((len(y), 1), kind), (y * y).sum(axis=1)[:, None]]).T
    found_i, found_j = [], []
    step = max(1, SLICE // max(1, len(right)))
    for first in range(0, len(left), step):
        i, j = np.nonzero(x[first : first + step] @ y < 2.5)
        for at in range(0, len(i), SLICE // 64):
            p, q = i[at : at + SLICE // 64] + first, j[at : at + SLICE // 64]
            near = _one_apart(a[p], b[q])
            found_i.append(p[near])
            found_j.append(q[near])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _one_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: do two words differ in one place, or does the longer one without a letter equal the other?"""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


LINKS = "word string, n_near long, best struct<less: long, form: string>"


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two blocks: how many near words each word has in the other, and the commonest of them."""
    names, numbers, less, forms = [], [], [], []

    def out() -> pa.RecordBatch:
        best = pa.StructArray.from_arrays([pa.array(less, pa.int64()), pa.array(forms, pa.string())], ["less", "form"])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), best], ["word", "n_near", "best"])

    for batch in batches:
        for r in range(batch.num_rows):
            same, left, right = (batch.column(k)[r].as_py() for k in (0, 1, 3))
            n_left, n_right = (batch.column(k)[r].values.to_numpy() for k in (2, 4))
            i, j = near_pairs(left, right)
            if same:
                i, j = i[i < j], j[i < j]
            for own, words, other, n_other, partners in ((i, left, j, n_right, right), (j, right, i, n_left, left)):
                if not len(own):
                    continue
                order = np.lexsort((other, -n_other[other], own))  # blocks are sorted by word
                first = np.nonzero(np.diff(own[order], prepend=-1))[0]
                best = other[order][first]
                names += [words[k] for k in own[order][first].tolist()]
                numbers += np.diff(first, append=len(own)).tolist()
                less += (-n_other[best]).tolist()
                forms += [partners[k] for k in best.tolist()]
            # a batch may hold many pairs of blocks; their links are handed on as they come
            if len(names) >= LINKS_HELD:
                yield out()
                for held in (names, numbers, less, forms):
                    held.clear()
    yield out()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): the number of near words and the commonest, for words of (word, n) with near words."""
    cut = stage(blocks(words), "spelling-blocks")
    sizes = cut.select("cell", "subs").distinct()
    # the right side of a pair is named by cell and cut, so that a crowded cell's cuts are met in different tasks
    asked = cut.select(
        "cell", "sub", F.col("words").alias("left"), F.col("counts").alias("n_left"),
        F.posexplode(_neighbours("cell")).alias("move", "other"),
    ).where("move = 0 or forall(other, x -> x >= 0)")
    asked = asked.join(sizes.select(F.col("cell").alias("other"), F.col("subs").alias("other_subs")), "other")
    asked = asked.withColumn("other_sub", F.explode(F.expr("sequence(0, other_subs - 1)")))
    met = asked.where("move > 0 or sub <= other_sub").join(
        cut.select(F.col("cell").alias("other"), F.col("sub").alias("other_sub"), F.col("words").alias("right"), F.col("counts").alias("n_right")),
        ["other", "other_sub"],
    )
    pairs = met.select((F.expr("move = 0 and sub = other_sub")).alias("same"), "left", "n_left", "right", "n_right")
    links = pairs.mapInArrow(_links, LINKS)
    return links.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of ``forms`` (word, form); a step doubles the way, and no chain has a ring."""
    found = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = stage(further, "spelling-roots")
        if not further.where("moved").head(1):
            return further.drop("moved")
        found = further.drop("moved")


def variants(docs: DataFrame, min_length: int = 5, min_uses: int = 3, typo_every: int = 97) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs`` (doc_id, text) with at least ``min_uses`` uses.

    A word's form is its commonest near word (the smallest of equals) if that comes at least twice as often; its root
    is the end of the chain of forms, or the word itself. Uses grow along a chain, so there are no rings and ties
    are settled alike in every run. Null and empty texts have no words; rows count as often as they come, also
    with one id; other columns play no part. An empty table gives no rows.
    """
    words = stage(word_counts(docs, min_length, typo_every).where(F.col("n") >= min_uses), "spelling-words")
    common = -F.col("best.less") >= 2 * F.col("n")
    told = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(common, F.col("best.form")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"),
    )
    told = stage(told, "spelling-forms")
    roots = _roots(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
