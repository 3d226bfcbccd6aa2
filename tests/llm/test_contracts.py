"""Cases of the operators' contracts that once went wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmap.llm import annsearch, langid, mixing, neardup, quality
from textmap.session import stage

CLASH = "doc_id long, text string, lang string, source string, `a.b` string, row long, copies int, rest string, body string, row__ long, score double, component long"


def clashing(spark, rows):
    return stage(spark.createDataFrame([(*r, "en", "s", "x", 7, 3, "r", "b", 9, 0.5, 1) for r in rows], CLASH), "clashing")


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("text, expected", [
    ("½ ² Ⅳ ① ٣ 42 _", False), (None, False), ("", False), ("½ é", True), ("a", True), ("漢", True), ("ª", True), ("--", False),
])
def test_letters(text, expected):
    assert langid.has_letter(text) is expected


def test_numerals_have_no_language(spark):
    docs = spark.createDataFrame([(1, "½ ② Ⅳ"), (2, "word")], "doc_id long, text string")
    net = langid.ByteNet(["en"])
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, net).collect()}
    assert found[1] == ("und", 0.0) and found[2][0] == "en"


def test_each_group_keeps_one_row(spark):
    w, o = "one two three four five six seven", "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    near = o + " end"
    rows = [(1, w), (2, w), (2, o), (3, near), (4, "alone here"), (4, "alone here"), (5, ""), (5, ""), (6, None), (None, w), (None, "null id only here now")]
    docs = clashing(spark, rows)
    found = neardup.without_near_duplicates(docs)
    assert found.columns == docs.columns
    assert kept(found) == sorted([(1, w), (2, o), (4, "alone here"), (5, ""), (5, ""), (6, None), (None, "null id only here now")], key=str)
    assert found.select("`a.b`", "row", "row__").distinct().count() == 1
    assert neardup.without_near_duplicates(docs.where("false").transform(lambda d: stage(d, "none"))).count() == 0


def test_stages_keep_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "the cat and the dog"), (1, "another text"), (1, "another text"), (None, "x"), (2, None), (3, "½")]
    docs = clashing(spark, rows)
    told = langid.with_known_language(docs, langid.ByteNet(["en"]), 0.0)
    assert told.columns == docs.columns and kept(told) == sorted([r for r in rows if r[1] not in (None, "½")], key=str)
    assert langid.with_known_language(docs, None).count() == 0
    scored = quality.with_good_quality(docs, None)
    assert scored.columns == docs.columns and kept(scored) == sorted(rows, key=str)
    assert quality.with_good_quality(docs, None, 0.6).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and set(kept(mixed)) <= set(rows)
    none = stage(docs.where("false"), "none")
    for stage_of in (lambda d: langid.with_known_language(d, None), lambda d: quality.with_good_quality(d, None), mixing.mixed_documents):
        assert stage_of(none).count() == 0


def test_every_query_gets_all_its_neighbours(spark):
    """A tight cluster and a few rows far from it, whose buckets hold nobody."""
    rng = np.random.default_rng(1)
    centre = np.ones(8)
    vectors = [centre + rng.normal(0, 1e-3, 8) for _ in range(900)] + [-centre * 3, np.eye(8)[0] - 5 * np.eye(8)[3], -5 * np.eye(8)[6]]
    rows = [(50 * i if i >= 897 else i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = stage(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "far")
    found = annsearch.nearest(table, 50, 5).collect()
    asked = [i for i, _ in rows if i % 50 == 0]
    held = {q: sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == q) for q in asked}
    assert all([rank for rank, _ in held[q]] == [1, 2, 3, 4, 5] for q in asked)
    matrix = np.array([v for _, v in rows])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    ids = [i for i, _ in rows]
    for q in (50 * 900, 50 * 901, 50 * 902):
        at = ids.index(q)
        order = sorted((j for j in range(len(ids)) if j != at), key=lambda j: (-round(float(unit[j] @ unit[at]), 12), ids[j]))
        assert held[q][0][1] == ids[order[0]]


def test_few_rows_give_all_candidates(spark):
    table = stage(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [-1.0, 0.0])], "vec_id long, embedding array<double>"), "few")
    found = annsearch.nearest(table, 50, 5).groupBy("query_id").agg(F.count("*").alias("n")).collect()
    assert {r["query_id"]: r["n"] for r in found} == {0: 2, 50: 2}


def test_stretches_have_the_words_of_their_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from textmap.llm import pieces

    table = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts, split = pieces.Stretches(table.cuts), pieces.splitter(table.cuts)
    rng = np.random.default_rng(9)
    signs = ["a", "be", " ", "  ", "\n", ".", "...", "!=", "\"", "é", "汉", pieces.SPACE, "\t", "://", "x" * 60, "😀"]
    odd = ["".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(0, 12))) for _ in range(4000)]
    for text in [None, "", " ", "a b", " a", "a ", "a\n b", *odd]:
        assert [w for s in texts.of(text) for w in texts.split(s)] == split(text)
    several = pieces.Stretches(pieces.MANY_WORDS)
    assert several.of("a b c") == ["a b c"]
