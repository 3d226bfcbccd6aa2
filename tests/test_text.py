import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmap.functions import text as tx
from textmap.operators import tfidf as tf
from textmap.operators import vocabulary as vo
from textmap.params import TextParams
from textmap.sources import corpus as co

TEXTS = [
    "The simple sparse self-organizing map mapper",
    "The algorithm uses the sparse",
    "The cat is playing.",
    "a b c !",
]


def corpus(spark, texts=TEXTS):
    return spark.createDataFrame([(i, f"title {i}", t) for i, t in enumerate(texts)], "doc_id long, title string, body string")


def python_fold(text):
    return unicodedata.normalize("NFKD", text.lower()).encode("ascii", "ignore").decode()


def test_fold_matches_unicode_rule(spark):
    texts = ["é ß œ ﬁ Ａ ñ", "é x", "plain", "½ ㏂ Ⅷ", "", "mark \x03 stays", "Ünïcödé ① x²"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(tx.fold(F.col("t"))).collect()]
    assert got == [python_fold(t) for t in texts]


def test_fold_keeps_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(tx.fold(F.col("t"))).first()[0] is None


def test_tokens_need_two_word_characters(spark):
    df = spark.createDataFrame([("I am a_b 7 42 x-ray",)], "t string")
    assert df.select(tx.tokens(F.col("t"))).first()[0] == ["am", "a_b", "42", "ray"]


def test_unicode_tokens_without_folding(spark):
    df = spark.createDataFrame([("Été à Köln",)], "t string")
    assert df.select(tx.terms(F.col("t"), None)).first()[0] == ["été", "köln"]


@pytest.mark.parametrize("words, expected", [
    ([], []),
    (["a"], ["a"]),
    (["a", "b"], ["a", "b", "a b"]),
    (["a", "b", "c"], ["a", "b", "c", "a b", "b c", "a b c"]),
])
def test_ngrams(spark, words, expected):
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert df.select(tx.word_ngrams(F.col("w"), 1, 3)).first()[0] == expected


def test_ngrams_reject_empty_range(spark):
    with pytest.raises(ValueError):
        tx.word_ngrams(F.col("w"), 2, 1)


def python_tfidf(texts, low, high, norm=True):
    docs = [Counter(re.findall(r"\w\w+", python_fold(t))) for t in texts]
    df = Counter(t for d in docs for t in d)
    terms = sorted(t for t, n in df.items() if low <= n <= high)
    rows = np.zeros((len(texts), len(terms)))
    for i, d in enumerate(docs):
        for j, t in enumerate(terms):
            rows[i, j] = d[t] * (math.log((1 + len(texts)) / (1 + df[t])) + 1)
    if norm:
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = rows / np.where(length > 0, length, 1)
    return terms, rows


def dense(rows, n_docs, n_terms):
    out = np.zeros((n_docs, n_terms))
    for r in rows.collect():
        out[r["doc_id"], r["indices"]] = r["values"]
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
@pytest.mark.parametrize("norm", ["l2", None])
def test_tfidf_by_dictionary_and_by_join(spark, monkeypatch, limit, norm):
    monkeypatch.setattr(tf, "DICTIONARY_LIMIT", limit)
    params = TextParams(min_df=1, max_df=1.0)
    tokenized = vo.tokenize(corpus(spark), params)
    vocab = vo.fit_vocabulary(tokenized, params)
    terms, expected = python_tfidf(TEXTS, 1, len(TEXTS), norm == "l2")
    assert vocab.on_driver()[0] == terms
    rows = tf.tfidf(tokenized, vocab, norm)
    # the document without a known term keeps its row
    assert rows.count() == len(TEXTS)
    assert np.allclose(dense(rows, len(TEXTS), vocab.n_terms), expected)


def test_frequency_bounds_are_inclusive(spark):
    texts = ["aa bb", "aa bb", "aa cc", "aa dd"]
    by_share = vo.fit_vocabulary(vo.tokenize(corpus(spark, texts)), TextParams(min_df=0.5, max_df=0.5))
    by_count = vo.fit_vocabulary(vo.tokenize(corpus(spark, texts)), TextParams(min_df=2, max_df=2))
    assert by_share.on_driver()[0] == by_count.on_driver()[0] == ["bb"]


def test_terms_are_numbered_over_many_partitions(spark):
    words = [f"w{i:04d}" for i in range(997)]
    df = spark.createDataFrame([(w,) for w in reversed(words)], "term string").repartition(7)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        numbered, n_terms = vo.number_terms(df)
        assert n_terms == len(words)
        assert [r["term"] for r in numbered.orderBy("term_id").collect()] == words
        assert sorted(r["term_id"] for r in numbered.collect()) == list(range(len(words)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_empty_vocabulary(spark):
    tokenized = vo.tokenize(corpus(spark))
    vocab = vo.fit_vocabulary(tokenized, TextParams(min_df=99))
    assert vocab.n_terms == 0
    with pytest.raises(ValueError):
        tf.tfidf(tokenized, vocab)


def test_stems_keep_order_and_count(spark):
    tokenized = spark.createDataFrame([(0, ["cats", "dog", "cats"]), (1, ["fish"])], "doc_id long, terms array<string>")
    stems = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "term string, stem string")
    got = {r["doc_id"]: r["terms"] for r in vo.normalize_tokens(tokenized, stems).collect()}
    assert got == {0: ["cat", "dog", "cat"], 1: ["fish"]}


def test_fixed_vocabulary_keeps_unseen_terms(spark):
    tokenized = vo.tokenize(corpus(spark))
    given = spark.createDataFrame([("sparse",), ("absent",), ("sparse",), (None,)], "term string")
    vocab = vo.fixed_vocabulary(given, tokenized)
    assert {r["term"]: r["df"] for r in vocab.terms.collect()} == {"absent": 0, "sparse": 2}


def test_drop_duplicates_keeps_smallest_id_and_nulls(spark):
    rows = [(3, "t", "b"), (1, "t", "b"), (2, "tb", ""), (4, None, "b"), (5, None, "b"), (6, "t", "B")]
    df = spark.createDataFrame(rows, "doc_id long, title string, body string")
    assert sorted(r["doc_id"] for r in co.drop_duplicates(df).collect()) == [1, 2, 4, 6]
    assert sorted(r["doc_id"] for r in co.drop_incomplete(co.drop_duplicates(df)).collect()) == [1, 2, 6]


def test_many_copies_are_reduced_before_the_shuffle(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "'t' AS title", "if(id % 3 = 0, 'same', string(id)) AS body")
    kept = co.drop_duplicates(df)
    assert kept.count() == 1 + 5000 - 1667
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_read_corpus_formats(spark, tmp_path):
    df = corpus(spark)
    for fmt in ("parquet", "json", "orc", "csv"):
        path = str(tmp_path / fmt)
        df.write.format(fmt).option("header", "true").save(path)
        got = co.read_corpus(spark, path, fmt, ["doc_id", "body"], "doc_id long, title string, body string", header="true")
        assert sorted(tuple(r) for r in got.collect()) == [(i, t) for i, t in enumerate(TEXTS)]
    limited = co.read_corpus(spark, str(tmp_path / "parquet"), size_limit=2)
    assert [r["doc_id"] for r in limited.collect()] == [0, 1]
    with pytest.raises(ValueError):
        co.read_corpus(spark, "x", "hdf5")


def test_column_pruning_reaches_the_scan(spark, small):
    plan = co.read_corpus(spark, f"{small}/documents.parquet", columns=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_ngram_vocabulary_forms_only_grams_of_frequent_words(spark, monkeypatch):
    texts = ["aa bb aa bb", "bb aa bb", "aa bb cc", "", None, "dd", "cc aa bb ee aa bb"]
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, body string").coalesce(1)
    formed = []
    count = vo.document_frequencies
    monkeypatch.setattr(vo, "document_frequencies", lambda t: formed.append(t) or count(t))
    for grams in ((1, 3), (2, 3), (1, 1), (2, 2)):
        params = TextParams(ngram_range=grams, min_df=2, max_df=3)
        found = vo.fit_ngram_vocabulary(vo.tokenize(rows), params)
        terms = {t for r in formed[-1].collect() for t in r["terms"]}
        assert not any("dd" in t or "ee" in t for t in terms)
        whole = vo.fit_vocabulary(vo.tokenize(rows, params), params)
        assert sorted(map(tuple, found.terms.collect())) == sorted(map(tuple, whole.terms.collect())) and found.n_docs == whole.n_docs
        monkeypatch.setattr(vo, "_WORDS_AT_ONCE", 4)


def test_length_of_a_joined_row_is_taken_once(spark, monkeypatch):
    monkeypatch.setattr(tf, "DICTIONARY_LIMIT", 0)
    rows = spark.createDataFrame([(0, "aa bb aa"), (1, "bb"), (2, None)], "doc_id long, body string")
    terms = vo.tokenize(rows)
    weighted = tf.tfidf(terms, vo.fit_vocabulary(terms, TextParams(min_df=1, max_df=1.0)))
    assert "/ SQRT(" not in weighted._jdf.queryExecution().optimizedPlan().toString()
    lengths = {r["doc_id"]: sum(v * v for v in r["values"]) for r in weighted.collect()}
    assert abs(lengths[0] - 1) < 1e-12 and abs(lengths[1] - 1) < 1e-12 and lengths[2] == 0


def test_long_term_list_is_counted_in_place(spark, monkeypatch):
    monkeypatch.setattr(tf, "DICTIONARY_LIMIT", 0)
    tokenized = vo.tokenize(corpus(spark), TextParams(min_df=1, max_df=1.0))
    vocab = vo.fit_vocabulary(tokenized, TextParams(min_df=1, max_df=1.0))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = {}
    for limit in (64 << 20, 8):  # sent whole, joined
        monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", limit)
        made = tf.tfidf(tokenized, vocab), tf.tfidf(tokenized, vocab, None), tf.count_rows(tokenized, vocab)
        assert all(("Join" in plan(rows)) == (limit == 8) for rows in made)
        found[limit] = [dense(rows, len(TEXTS), vocab.n_terms) for rows in made]
        assert all(rows.count() == len(TEXTS) for rows in made)
    assert np.allclose(found[8], found[64 << 20])
    twice = spark.createDataFrame([(0, ["aa", "bb"]), (0, ["bb", None]), (1, None)], "doc_id long, terms array<string>")
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", 64 << 20)
    assert "Join" in plan(tf.count_rows(twice, vo.fit_vocabulary(twice, TextParams(min_df=1, max_df=1.0))))
    odd = twice.where("terms is null or size(terms) = 2").withColumn("doc_id", F.monotonically_increasing_id())
    listed = vo.fit_vocabulary(odd, TextParams(min_df=1, max_df=1.0))
    got = sorted(tuple(r["values"]) for r in tf.count_rows(odd, listed).collect())
    assert got == [(), (1.0,), (1.0, 1.0)]


def test_term_list_over_a_broadcast_is_counted_in_place(spark, monkeypatch):
    """The terms go out in several lists; no document is spread over its terms for a join."""
    words = [f"w{i:03d}" for i in range(700)]
    rows = [(d, [words[(d * 37 + i * i) % 700] for i in range(90)] + ["unlisted", None]) for d in range(40)] + [(40, []), (41, None)]
    tokenized = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    vocab = vo.fit_vocabulary(tokenized, TextParams(min_df=2, max_df=39))
    monkeypatch.setattr(tf, "DICTIONARY_LIMIT", 0)
    made = lambda: (tf.tfidf(tokenized, vocab), tf.tfidf(tokenized, vocab, None), tf.count_rows(tokenized, vocab))
    whole = [sorted((r["doc_id"], r["indices"], r["values"]) for r in df.collect()) for df in made()]
    size = vocab.terms.agg(F.sum(F.octet_length("term") + 4)).first()[0]
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", size // 3)
    assert vocab.n_terms > 300 and len(tf._listed(tokenized, vocab)) > 1
    for df, expected in zip(made(), whole, strict=True):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r["doc_id"], r["indices"], r["values"]) for r in df.collect()) == expected
