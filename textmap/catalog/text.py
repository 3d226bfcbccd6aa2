"""Queries on corpora: reading, cleaning, terms and weights."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.catalog import sql as q
from textmap.catalog.tables import articles, documents, table
from textmap.functions import text as tx
from textmap.functions.vectors import rounded
from textmap.operators import summaries as sm
from textmap.operators import tfidf as tf
from textmap.operators import vocabulary as vo
from textmap.params import TextParams
from textmap.session import staging_path
from textmap.sources import corpus as co
from textmap.sources import sinks

ARTICLES_SQL = f"SELECT doc_id, {q.TITLE} AS title, text AS body FROM documents"
LABELLED_SQL = f"SELECT d.doc_id, {q.TITLE} AS title, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)"


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder).join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")


def tokenized(spark: SparkSession, folder: str, params: TextParams = TextParams()) -> DataFrame:
    return vo.tokenize(articles(spark, folder), params)


def weighted(spark: SparkSession, folder: str, norm: str | None = "l2") -> tuple[DataFrame, vo.Vocabulary]:
    """(sparse rows, vocabulary) of the documents. Texts are read twice, which costs less than storing their terms."""
    terms = tokenized(spark, folder)
    vocab = vo.fit_vocabulary(terms)
    return tf.tfidf(terms, vocab, norm), vocab


def s1_read_articles(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder)


def s2_read_limited(spark: SparkSession, folder: str) -> DataFrame:
    return co.read_corpus(spark, f"{folder}/documents.parquet", columns=["doc_id", "text"], size_limit=100)


def _through(spark: SparkSession, folder: str, fmt: str) -> DataFrame:
    path = staging_path(spark, f"corpus-{fmt}")
    sinks.overwrite_table(documents(spark, folder).select("doc_id", "text", "lang"), path, fmt)
    schema = "doc_id long, text string, lang string"
    return co.read_corpus(spark, path, fmt, ["doc_id", "text", "lang"], schema)


def s3_read_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A corpus kept as CSV, whose texts hold line ends, quotes and commas."""
    path, form = staging_path(spark, "corpus-csv"), {"header": "true", "escape": '"'}
    rows = documents(spark, folder).select("doc_id", "text", "lang")
    kept = {"quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows.write.format("csv").options(**form, **kept).save(path)
    return co.read_corpus(spark, path, "csv", schema="doc_id long, text string, lang string", multiLine="true", **form)


def s3_read_json(spark: SparkSession, folder: str) -> DataFrame:
    return _through(spark, folder, "json")


def s3_read_orc(spark: SparkSession, folder: str) -> DataFrame:
    return _through(spark, folder, "orc")


def p1_project(spark: SparkSession, folder: str) -> DataFrame:
    return co.project(articles(spark, folder), ["doc_id", "title"])


def p2_drop_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return co.drop_duplicates(articles(spark, folder))


def p3_drop_incomplete(spark: SparkSession, folder: str) -> DataFrame:
    return co.drop_incomplete(labelled(spark, folder))


def p5_rows_with(spark: SparkSession, folder: str) -> DataFrame:
    return co.rows_with(documents(spark, folder), "lang", "fr").select("doc_id", "source", "n_chars")


def p6_get_document(spark: SparkSession, folder: str) -> DataFrame:
    return co.rows_with(documents(spark, folder), "doc_id", 15).select("doc_id", "lang", tx.excerpt(F.col("text")).alias("excerpt"))


def p7_rows_in(spark: SparkSession, folder: str) -> DataFrame:
    flagged = table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    return co.rows_in(documents(spark, folder).select("doc_id", "lang"), "doc_id", flagged)


def p11_fill_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return co.fill_numbers(labelled(spark, folder)).select("doc_id", "quality")


def t1_fold(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", tx.fold(F.col("text")).alias("folded"))


def t2_tokens(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokenized(spark, folder).select("doc_id", F.explode("terms").alias("term"))
    return counted.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def t3_stems(spark: SparkSession, folder: str) -> DataFrame:
    terms = tokenized(spark, folder)
    words = vo.document_frequencies(terms).where("term LIKE '%s' AND length(term) > 3")
    stems = words.select("term", F.expr("left(term, length(term) - 1)").alias("stem"))
    return vo.document_frequencies(vo.normalize_tokens(terms, stems))


def t4_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    params = TextParams(ngram_range=(1, 3), min_df=0.05, max_df=0.8)
    return vo.fit_ngram_vocabulary(tokenized(spark, folder), params).terms


def t5_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return vo.fit_vocabulary(tokenized(spark, folder)).terms


def t6_lookup(spark: SparkSession, folder: str) -> DataFrame:
    vocab = vo.fit_vocabulary(tokenized(spark, folder)).terms
    ids = vo.with_term_ids(
        tokenized(spark, folder).select("doc_id", F.explode(F.array_distinct("terms")).alias("term")), vocab
    ).groupBy("term_id").agg(F.count(F.lit(1)).alias("docs"))
    return vo.with_terms(ids, vocab).select("term_id", "term", "docs")


def t7_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    return tf.cells(weighted(spark, folder, None)[0]).withColumn("v", rounded(F.col("v")))


def t8_unit_rows(spark: SparkSession, folder: str) -> DataFrame:
    return tf.cells(weighted(spark, folder)[0]).withColumn("v", rounded(F.col("v")))


def t9_shape(spark: SparkSession, folder: str) -> DataFrame:
    return tf.shape(weighted(spark, folder)[0])


def t10_fixed_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    given = vo.tokenize(table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("body")))
    terms = tokenized(spark, folder)
    vocab = vo.fixed_vocabulary(given.select(F.explode("terms").alias("term")), terms)
    return tf.cells(tf.tfidf(terms, vocab)).withColumn("v", rounded(F.col("v")))


def j3_term_names(spark: SparkSession, folder: str) -> DataFrame:
    rows, vocab = weighted(spark, folder)
    named = vo.with_terms(tf.cells(rows), vocab.terms)
    return named.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), rounded(F.sum("v"), 5).alias("weight"))


def top_terms_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Ten terms of largest summed TF-IDF weight per source."""
    rows, vocab = weighted(spark, folder)
    sources = table(spark, folder, "documents").select("doc_id", "source")
    sums = sm.group_sums(rows, sources, "source").withColumnRenamed("s", "weight")
    named = vo.with_terms(sums, vocab.terms)
    return sm.top_per_group(named, "source", sm.by_weight("term"), 10).select(
        "source", "rank", "term", rounded(F.col("weight")).alias("weight")
    )


QUERIES = {
    f.__name__: f
    for f in (
        s1_read_articles, s2_read_limited, s3_read_json, s3_read_orc, s3_read_csv, p1_project, p2_drop_duplicates,
        p3_drop_incomplete, p5_rows_with, p6_get_document, p7_rows_in, p11_fill_numbers, t1_fold, t2_tokens,
        t3_stems, t4_ngrams, t5_vocabulary, t6_lookup, t7_tfidf, t8_unit_rows, t9_shape, t10_fixed_vocabulary,
        j3_term_names, top_terms_by_source,
    )
}

_NGRAMS = f"""grams AS MATERIALIZED (SELECT doc_id, list_concat(terms,
    CASE WHEN len(terms) >= 2 THEN [terms[i] || ' ' || terms[i + 1] for i in range(1, len(terms))] ELSE [] END,
    CASE WHEN len(terms) >= 3 THEN [terms[i] || ' ' || terms[i + 1] || ' ' || terms[i + 2] for i in range(1, len(terms) - 1)] ELSE [] END
    ) AS terms FROM (SELECT doc_id, {q.TOKENS.format('text')} AS terms FROM documents))"""

ORACLES = {
    "s1_read_articles": ARTICLES_SQL,
    "s2_read_limited": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100",
    "s3_read_csv": "SELECT doc_id, text, lang FROM documents",
    "s3_read_json": "SELECT doc_id, text, lang FROM documents",
    "s3_read_orc": "SELECT doc_id, text, lang FROM documents",
    "p1_project": f"SELECT doc_id, {q.TITLE} AS title FROM documents",
    "p2_drop_duplicates": f"SELECT min(doc_id) AS doc_id, title, body FROM ({ARTICLES_SQL}) GROUP BY title, body",
    "p3_drop_incomplete": LABELLED_SQL.replace("l.quality FROM", "text AS body, l.quality FROM") + " WHERE l.quality IS NOT NULL",
    "p5_rows_with": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'fr'",
    "p6_get_document": "SELECT doc_id, lang, substring(text, 1, 150) AS excerpt FROM documents WHERE doc_id = 15",
    "p7_rows_in": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "p11_fill_numbers": f"SELECT doc_id, coalesce(quality, 0) AS quality FROM ({LABELLED_SQL})",
    "t1_fold": f"SELECT doc_id, {q.FOLD.format('text')} AS folded FROM documents",
    "t2_tokens": q.with_(q.tokens_of())
    + "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY ALL",
    "t3_stems": q.with_(q.tokens_of())
    + """SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id,
        CASE WHEN t LIKE '%s' AND length(t) > 3 THEN left(t, length(t) - 1) ELSE t END AS term
        FROM (SELECT doc_id, unnest(terms) AS t FROM tok)) GROUP BY term""",
    "t4_ngrams": q.with_(_NGRAMS, "tok AS (SELECT * FROM grams)", *q.vocabulary("0.05::DOUBLE * n", "0.8::DOUBLE * n"))
    + "SELECT term, term_id, df FROM voc",
    "t5_vocabulary": q.with_(q.tokens_of(), *q.vocabulary()) + "SELECT term, term_id, df FROM voc",
    "t6_lookup": q.with_(q.tokens_of(), *q.vocabulary()) + "SELECT term_id, term, df AS docs FROM voc",
    "t7_tfidf": q.with_(*q.tfidf_ctes()) + "SELECT doc_id, term_id, round(v, 6) AS v FROM raw",
    "t8_unit_rows": q.with_(*q.tfidf_ctes()) + "SELECT doc_id, term_id, round(v, 6) AS v FROM cells",
    "t9_shape": q.with_(*q.tfidf_ctes())
    + "SELECT (SELECT count(*) FROM tok) AS corpus_size, count(DISTINCT term_id) AS n_features FROM cells",
    "t10_fixed_vocabulary": q.with_(
        q.tokens_of(),
        "size AS (SELECT count(*) AS n FROM tok)",
        f"given AS (SELECT DISTINCT unnest({q.TOKENS.format('text')}) AS term FROM benchmark)",
        "freq AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY term)",
        """voc AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, coalesce(df, 0) AS df
            FROM given LEFT JOIN freq USING (term))""",
        q.RAW_CELLS, q.UNIT_CELLS,
    ) + "SELECT doc_id, term_id, round(v, 6) AS v FROM cells",
    "j3_term_names": q.with_(*q.tfidf_ctes())
    + "SELECT term, count(*) AS docs, round(sum(v), 5) AS weight FROM cells JOIN voc USING (term_id) GROUP BY term",
    "top_terms_by_source": q.with_(*q.tfidf_ctes())
    + """SELECT source, CAST(rn - 1 AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(weight, 12) DESC, term) AS rn FROM (
        SELECT source, term, sum(v) AS weight FROM cells JOIN voc USING (term_id) JOIN documents USING (doc_id)
        GROUP BY ALL)) WHERE rn <= 10""",
}
