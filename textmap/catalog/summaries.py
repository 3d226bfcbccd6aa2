"""Queries on a fitted map of the vectors, described by the terms of the documents."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.catalog import maps
from textmap.catalog import sql as q
from textmap.catalog.maps import MAP, N_CLUSTERS
from textmap.catalog.tables import articles, documents, table
from textmap.catalog.text import weighted
from textmap.functions.vectors import rounded
from textmap.operators import matrix as mx
from textmap.operators import reduce as rd
from textmap.operators import regions, som
from textmap.operators import summaries as sm
from textmap.session import stage
from textmap.sources import corpus as co

ASKED = 15


@dataclass(frozen=True)
class Fitted:
    """Tables of a map whose topics are the vector entries, each weighted over terms by the documents."""

    vectors: DataFrame
    codebook: DataFrame
    assigned: DataFrame
    width: int


def fit(spark: SparkSession, folder: str) -> Fitted:
    rows, codebook, assigned = maps.fitted(spark, folder)
    return Fitted(rows.select("doc_id", "vec"), codebook.to_df(spark), assigned, codebook.width)


def clusters(fitted: Fitted) -> DataFrame:
    """Stored, so that Spark knows how small the table is and joins it without a shuffle."""
    return stage(regions.ward_regions(fitted.codebook, MAP.kshape, N_CLUSTERS), "clusters")


def components(spark: SparkSession, folder: str, fitted: Fitted) -> tuple[DataFrame, DataFrame]:
    """(components, terms): each topic's weight over the terms, summed over the documents that have a vector."""
    rows, vocab = weighted(spark, folder)
    product = mx.transpose_product(rows, vocab.n_terms, fitted.vectors, fitted.width)
    return stage(rd.components_from_table(product), "components"), vocab.terms


def k1_topic_top_terms(spark: SparkSession, folder: str) -> DataFrame:
    comps, terms = components(spark, folder, fit(spark, folder))
    return sm.top_terms(comps, terms, 10).withColumn("weight", rounded(F.col("weight")))


def k2_node_top_topics(spark: SparkSession, folder: str) -> DataFrame:
    return sm.top_topics(fit(spark, folder).codebook, 5).withColumn("weight", rounded(F.col("weight")))


def k3_topic_top_documents(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit(spark, folder)
    top = sm.top_documents(fitted.vectors, fitted.width, 5).withColumn("weight", rounded(F.col("weight")))
    return sm.with_titles(top, articles(spark, folder))


def k4_node_features(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit(spark, folder)
    found = sm.node_features(fitted.codebook, fitted.assigned, [ASKED], 20)
    return found.withColumn("weight", rounded(F.col("weight")))


def k6_latest_run(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "events").select("event_id", "ts", "event_type")
    return sm.latest_run(runs, "ts").select("event_id", "event_type")


def k7_first_rows(spark: SparkSession, folder: str) -> DataFrame:
    return co.first_rows(documents(spark, folder).select("doc_id", "lang", "source"), 25)


def k8_term_lines(spark: SparkSession, folder: str) -> DataFrame:
    comps, terms = components(spark, folder, fit(spark, folder))
    return sm.term_lines(sm.top_terms(comps, terms, 10))


def j1_cluster_documents(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit(spark, folder)
    return sm.cluster_documents(fitted.assigned, clusters(fitted), 1)


def j2_node_topics(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit(spark, folder)
    comps, terms = components(spark, folder, fitted)
    flat = sm.node_topics(fitted.codebook, comps, terms, 3, 5)
    return flat.withColumn("weight", rounded(F.col("weight"))).withColumn("topic_weight", rounded(F.col("topic_weight")))


def j5_similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit(spark, folder)
    found = sm.similar_documents(fitted.vectors, fitted.assigned, [ASKED])
    return found.withColumn("similarity", rounded(F.col("similarity")))


def j5_most_similar(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit(spark, folder)
    found = sm.similar_documents(fitted.vectors, fitted.assigned, [ASKED, ASKED + 1], 3)
    return found.withColumn("similarity", rounded(F.col("similarity")))


def j5_all_similar(spark: SparkSession, folder: str) -> DataFrame:
    """The three most similar documents on its node of every document."""
    fitted = fit(spark, folder)
    found = sm.all_similar_documents(fitted.vectors, fitted.assigned, 3)
    return found.withColumn("similarity", rounded(F.col("similarity")))


def c3_document_clusters(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit(spark, folder)
    return regions.document_clusters(fitted.assigned, clusters(fitted)).select("doc_id", "node", "cluster")


def c4_centre_top_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Top nine terms of each cluster centre; the clusters are the languages."""
    rows, vocab = weighted(spark, folder)
    groups = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("topic_id"))
    top = sm.top_terms(sm.group_centres(rows, groups), vocab.terms, 9)
    return top.select(F.col("topic_id").alias("lang"), "rank", "name", rounded(F.col("weight")).alias("weight"))


def a1_node_hits(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit(spark, folder)
    return som.hits(fitted.assigned, MAP.kshape)


def a2_cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit(spark, folder)
    return sm.cluster_sizes(fitted.assigned, clusters(fitted))


def a3_hits_histogram(spark: SparkSession, folder: str) -> DataFrame:
    found = sm.hits_histogram(fit(spark, folder).assigned)
    return found.select("bin", rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"), "nodes")


def _map(spark: SparkSession, folder: str, n_topics: int = 2, n_words: int = 5) -> DataFrame:
    fitted = fit(spark, folder)
    comps, terms = components(spark, folder, fitted)
    return sm.map_table(fitted.codebook, fitted.assigned, clusters(fitted), comps, terms, MAP.kshape, n_topics, n_words)


def a4_map_table(spark: SparkSession, folder: str) -> DataFrame:
    return _map(spark, folder).withColumn("topics", sm.topics_text(F.col("topics")))


def a5_corpus_table(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit(spark, folder)
    comps, terms = components(spark, folder, fitted)
    found = sm.corpus_table(
        articles(spark, folder), fitted.assigned, clusters(fitted), fitted.codebook, comps, terms, MAP.kshape
    )
    return found.withColumn("topics", sm.topics_text(F.col("topics")))


def v1_colours(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit(spark, folder)
    return sm.cluster_colours(clusters(fitted), N_CLUSTERS)


def v2_node_matrix(spark: SparkSession, folder: str) -> DataFrame:
    found = sm.node_matrix(som.hits(fit(spark, folder).assigned, MAP.kshape), MAP.kshape, "hits")
    return found.select("x", F.array_join("row", " ").alias("row"))


def v3_hover_columns(spark: SparkSession, folder: str) -> DataFrame:
    return sm.hover_columns(_map(spark, folder))


def v4_hex_bins(spark: SparkSession, folder: str) -> DataFrame:
    return sm.hex_bins(table(spark, folder, "events"), "user_id", "value", 5.0)


QUERIES = {
    f.__name__: f
    for f in (
        k1_topic_top_terms, k2_node_top_topics, k3_topic_top_documents, k4_node_features, k6_latest_run,
        k7_first_rows, k8_term_lines, j1_cluster_documents, j2_node_topics, j5_similar_documents, j5_most_similar, j5_all_similar,
        c3_document_clusters, c4_centre_top_terms, a1_node_hits, a2_cluster_sizes, a3_hits_histogram, a4_map_table,
        a5_corpus_table, v1_colours, v2_node_matrix, v3_hover_columns, v4_hex_bins,
    )
}

FINAL = maps._final()
WARD = q.ward("kk", MAP, N_CLUSTERS)
COMPONENTS = [
    *q.tfidf_ctes(),
    """comp AS MATERIALIZED (SELECT topic_id, term_id, term AS name, weight FROM (
        SELECT topic_id, term_id, sum(v * w) AS weight FROM cells JOIN (
        SELECT doc_id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS topic_id, unnest(vec) AS w FROM x)
        USING (doc_id) GROUP BY ALL) JOIN voc USING (term_id))""",
]
NODE_WEIGHTS = """nw AS MATERIALIZED (SELECT node, unnest(vec) AS weight, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS topic_id
    FROM kk)"""


def top(table_: str, group: str, tie: str, n: int, weight: str = "weight") -> str:
    return f"""(SELECT *, CAST(rn - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
        PARTITION BY {group} ORDER BY round({weight}, 12) DESC, {tie}) AS rn FROM {table_}) WHERE rn <= {n})"""


def node_words(n_topics: int, n_words: int) -> str:
    return f"""nt AS MATERIALIZED (SELECT t.node, t.rank AS topic_rank, topic_id, t.weight AS topic_weight,
        w.rank AS token_rank, w.name, w.weight
        FROM {top('nw', 'node', 'topic_id', n_topics)} t JOIN {top('comp', 'topic_id', 'name', n_words)} w USING (topic_id))"""


TOPICS_TEXT = """tt AS (SELECT node, string_agg(words, ' | ' ORDER BY topic_rank) AS topics FROM (
    SELECT node, topic_rank, string_agg(name, ' ' ORDER BY token_rank) AS words FROM nt GROUP BY ALL) GROUP BY node)"""
HITS = f"hits AS ({maps._HITS})"
_ALL_SIM = """sim AS MATERIALIZED (SELECT a.doc_id, b.doc_id AS other_id, a.node,
    list_dot_product(p.u, r.u) AS similarity FROM aa a JOIN aa b ON a.node = b.node AND a.doc_id <> b.doc_id
    JOIN xu p ON p.doc_id = a.doc_id JOIN xu r ON r.doc_id = b.doc_id)"""
_SIM = f"""sim AS MATERIALIZED (SELECT a.doc_id, b.doc_id AS other_id, a.node,
    list_dot_product(p.u, r.u) AS similarity FROM aa a JOIN aa b ON a.node = b.node AND a.doc_id <> b.doc_id
    JOIN xu p ON p.doc_id = a.doc_id JOIN xu r ON r.doc_id = b.doc_id WHERE a.doc_id IN ({ASKED}, {ASKED + 1}))"""

ORACLES = {
    "k1_topic_top_terms": q.with_(q.X, *COMPONENTS)
    + f"SELECT topic_id, rank, term_id, name, round(weight, 6) AS weight FROM {top('comp', 'topic_id', 'name', 10)}",
    "k2_node_top_topics": q.with_(*FINAL, NODE_WEIGHTS)
    + f"SELECT node, rank, topic_id, round(weight, 6) + 0.0 AS weight FROM {top('nw', 'node', 'topic_id', 5)}",
    "k3_topic_top_documents": q.with_(
        q.X, """dw AS (SELECT doc_id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS topic_id, unnest(vec) AS weight FROM x)"""
    ) + f"""SELECT topic_id, rank, doc_id, round(weight, 6) + 0.0 AS weight, title FROM {top('dw', 'topic_id', 'doc_id', 5)}
        JOIN (SELECT doc_id, {q.TITLE} AS title FROM documents) USING (doc_id)""",
    "k4_node_features": q.with_(*FINAL, NODE_WEIGHTS)
    + f"""SELECT doc_id, node, rank, topic_id AS feature, round(weight, 6) + 0.0 AS weight
        FROM {top('nw', 'node', 'topic_id', 20)} JOIN aa USING (node) WHERE doc_id = {ASKED}""",
    "k6_latest_run": "SELECT event_id, event_type FROM events ORDER BY ts DESC LIMIT 1",
    "k7_first_rows": "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 25",
    "k8_term_lines": q.with_(q.X, *COMPONENTS)
    + f"SELECT topic_id, rank, printf('%s:' || chr(9) || ' %.4f', name, weight) AS line FROM {top('comp', 'topic_id', 'name', 10)}",
    "j1_cluster_documents": q.with_(*FINAL, *WARD) + "SELECT node, doc_id FROM aa JOIN node_clusters USING (node) WHERE cluster = 1",
    "j2_node_topics": q.with_(*FINAL, *COMPONENTS, NODE_WEIGHTS, node_words(3, 5))
    + """SELECT node, topic_rank, topic_id, round(topic_weight, 6) + 0.0 AS topic_weight, token_rank, name,
        round(weight, 6) + 0.0 AS weight FROM nt""",
    "j5_similar_documents": q.with_(*FINAL, _SIM)
    + f"SELECT doc_id, other_id, node, round(similarity, 6) + 0.0 AS similarity FROM sim WHERE doc_id = {ASKED}",
    "j5_most_similar": q.with_(*FINAL, _SIM)
    + f"""SELECT doc_id, other_id, node, round(similarity, 6) + 0.0 AS similarity, rank
        FROM {top('sim', 'doc_id', 'other_id', 3, 'similarity')}""",
    "j5_all_similar": q.with_(*FINAL, _ALL_SIM)
    + f"""SELECT doc_id, other_id, node, round(similarity, 6) + 0.0 AS similarity, rank
        FROM {top('sim', 'doc_id', 'other_id', 3, 'similarity')}""",
    "c3_document_clusters": q.with_(*FINAL, *WARD) + "SELECT doc_id, node, cluster FROM aa JOIN node_clusters USING (node)",
    "c4_centre_top_terms": q.with_(
        *q.tfidf_ctes(),
        """centre AS (SELECT lang, term AS name, sum(v) / max(n) AS weight FROM cells JOIN voc USING (term_id)
            JOIN documents USING (doc_id) JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang)
            GROUP BY ALL)""",
    ) + f"SELECT lang, rank, name, round(weight, 6) AS weight FROM {top('centre', 'lang', 'name', 9)}",
    "a1_node_hits": q.with_(*FINAL) + "SELECT grid.node, count(aa.node) AS hits FROM grid LEFT JOIN aa USING (node) GROUP BY grid.node",
    "a2_cluster_sizes": q.with_(*FINAL, *WARD)
    + "SELECT cluster, count(*) AS articles FROM aa JOIN node_clusters USING (node) GROUP BY cluster",
    "a3_hits_histogram": q.with_(
        *FINAL, "per AS (SELECT count(*) AS h FROM aa GROUP BY node)",
        "span AS (SELECT min(h) AS lo, max(h) AS hi, (max(h) - min(h)) / 10.0::DOUBLE AS w FROM per)",
    ) + """SELECT CAST(bin AS INTEGER) AS bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, count(h) AS nodes
        FROM (SELECT lo, hi, w, unnest(CASE WHEN hi = lo THEN [0] ELSE range(10) END) AS bin FROM span)
        LEFT JOIN per ON bin = CASE WHEN hi = lo THEN 0 ELSE least(floor((h - lo) / w), 9) END GROUP BY ALL""",
    "a4_map_table": q.with_(*FINAL, *WARD, *COMPONENTS, NODE_WEIGHTS, node_words(2, 5), TOPICS_TEXT, HITS)
    + """SELECT grid.node, gx AS x, gy AS y, cluster, hits, topics FROM grid
        JOIN node_clusters USING (node) JOIN hits USING (node) JOIN tt USING (node)""",
    "a5_corpus_table": q.with_(*FINAL, *WARD, *COMPONENTS, NODE_WEIGHTS, node_words(3, 5), TOPICS_TEXT)
    + f"""SELECT doc_id, title, grid.node, gx AS x, gy AS y, cluster, topics FROM (SELECT doc_id, {q.TITLE} AS title FROM documents)
        LEFT JOIN aa USING (doc_id) LEFT JOIN grid USING (node) LEFT JOIN node_clusters USING (node) LEFT JOIN tt USING (node)""",
    "v1_colours": q.with_(*FINAL, *WARD)
    + f"""SELECT node, cluster, printf('#%02x%02x%02x', CAST(floor(250.0 * (cluster / {N_CLUSTERS}.0::DOUBLE)) AS INTEGER), 100, 100)
        AS color FROM node_clusters""",
    "v2_node_matrix": q.with_(*FINAL, HITS)
    + "SELECT gx AS x, string_agg(hits::VARCHAR, ' ' ORDER BY gy) AS \"row\" FROM grid JOIN hits USING (node) GROUP BY gx",
    "v3_hover_columns": q.with_(*FINAL, *COMPONENTS, NODE_WEIGHTS, node_words(2, 5))
    + """SELECT node, ws[1] AS word_1, ws[2] AS word_2, ws[3] AS word_3 FROM (
        SELECT node, list(name ORDER BY p) AS ws FROM (SELECT node, name, min(topic_rank * 100 + token_rank) AS p FROM nt
        GROUP BY ALL) GROUP BY node)""",
    # the nearest centre among the candidate cells around each point
    "v4_hex_bins": """WITH p AS (SELECT event_id, user_id::DOUBLE AS x, value::DOUBLE AS y FROM events),
        base AS (SELECT *, CAST(floor(y / 7.5::DOUBLE) AS INTEGER) AS r0 FROM p),
        rows_ AS (SELECT *, r0 + d AS r FROM base, (VALUES (-1), (0), (1), (2)) v(d)),
        cells AS (SELECT *, CAST(floor(x / (5.0::DOUBLE * sqrt(3.0)) - r / 2.0::DOUBLE) AS INTEGER) + e AS q
            FROM rows_, (VALUES (0), (1)) w(e)),
        away AS (SELECT event_id, q, r, pow(x - 5.0::DOUBLE * sqrt(3.0) * (q + r / 2.0::DOUBLE), 2) + pow(y - 7.5::DOUBLE * r, 2) AS d
            FROM cells),
        best AS (SELECT event_id, arg_min(struct_pack(q := q, r := r), struct_pack(d := round(d, 6), q := -q)) AS c FROM away GROUP BY event_id)
        SELECT c.q AS hex_x, c.r AS hex_y, count(*) AS n FROM best GROUP BY ALL""",
}
