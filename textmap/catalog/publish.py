"""Queries that write results and read them back, and queries on posts."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.catalog import maps
from textmap.catalog import sql as q
from textmap.catalog import summaries as cs
from textmap.catalog.maps import MAP, N_CLUSTERS
from textmap.catalog.tables import articles, documents, table
from textmap.functions import text as tx
from textmap.functions.vectors import rounded
from textmap.operators import posts as po
from textmap.operators import regions, som
from textmap.operators import summaries as sm
from textmap.operators import vocabulary as vo
from textmap.session import staging_path
from textmap.sources import sinks, versions

RUN, TIME = "run-1", datetime(2024, 1, 1)
NODE = 3


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as posts: kind by language, time from the event of the same number, one comment each."""
    kinds = F.create_map(*[F.lit(v) for v in ("en", "BlogPost", "fr", "Quote", "de", "Video", "es", "Image")])
    times = table(spark, folder, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"))
    title = tx.title_of(F.col("text"))
    return documents(spark, folder).join(times, "doc_id", "left").select(
        "doc_id", F.try_element_at(kinds, F.col("lang")).alias("post_type"), "created_at", title.alias("title"),
        tx.slug_of(title).alias("slug"), F.col("text").alias("body"), F.lit(None).cast("string").alias("embed_code"),
        F.col("source").alias("image_url"), F.col("source").alias("author"),
        F.array(F.struct("created_at", F.lit("").alias("body"), F.col("source").alias("author"))).alias("comments"),
    )


def s5_append_articles(spark: SparkSession, folder: str) -> DataFrame:
    path, rows = staging_path(spark, "articles"), documents(spark, folder).select("doc_id", "lang", "n_chars")
    sinks.append_table(rows.where("lang = 'en'"), path)
    sinks.append_table(rows.where("lang <> 'en'"), path)
    return sinks.read_table(spark, path)


def s7_overwrite_table(spark: SparkSession, folder: str) -> DataFrame:
    path, fitted = staging_path(spark, "words-by-node"), cs.fit(spark, folder)
    hits = som.hits(fitted.assigned, MAP.kshape)
    sinks.overwrite_table(hits.select("node"), path)
    sinks.overwrite_table(hits, path)
    return sinks.read_table(spark, path)


def s8_upsert_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The node table after one epoch, updated by the hits after the whole schedule."""
    rows = maps.vectors(spark, folder)
    first = som.predict(rows, maps.trained(rows, MAP, 1))
    old = regions.with_coordinates(som.hits(first, MAP.kshape), MAP.kshape)
    later = som.predict(rows, maps.trained(rows, MAP))
    return sinks.upsert(old, later.groupBy("node").agg(F.count(F.lit(1)).alias("hits")), ["node"])


def s8_update_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The document table in versions, updated by the labels of some documents; only their buckets are rewritten."""
    path = staging_path(spark, "documents")
    versions.overwrite(documents(spark, folder).select("doc_id", "lang", "n_chars"), path, ["doc_id"], 16)
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    versions.update(labels.where("quality = 1").withColumn("lang", F.lit("??")), path, ["doc_id"])
    return versions.read(spark, path).select("doc_id", "lang", "n_chars", "quality")


def s9_posts_with_nodes(spark: SparkSession, folder: str) -> DataFrame:
    assigned = cs.fit(spark, folder).assigned
    return sinks.posts_with_nodes(articles(spark, folder).select("doc_id", "title"), assigned)


def s9_posts_by_title(spark: SparkSession, folder: str) -> DataFrame:
    titles = articles(spark, folder).select("doc_id", "title")
    titled = titles.join(cs.fit(spark, folder).assigned.select("doc_id", "node"), "doc_id")
    return sinks.posts_with_nodes_by_title(titles, titled).select("doc_id", "node")


def s10_topic_json(spark: SparkSession, folder: str) -> DataFrame:
    comps, terms = cs.components(spark, folder, cs.fit(spark, folder))
    return sm.topic_json(comps, terms)


def _session(spark: SparkSession, folder: str, page_size: int = sm.PAGE_SIZE) -> sinks.SessionTables:
    fitted = cs.fit(spark, folder)
    comps, terms = cs.components(spark, folder, fitted)
    return sinks.session_tables(
        RUN, TIME, fitted.codebook, fitted.assigned, comps, terms, MAP.kshape, N_CLUSTERS, fitted.width,
        page_size=page_size,
    )


def _flat_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "run_id", "id", "coordinates.x_shape", "coordinates.y_shape", "article_hits",
        sm.topics_text(F.col("topics")).alias("topics"),
    )


def s6_append_session(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "semantic")
    sinks.write_session(_session(spark, folder), path)
    return _flat_nodes(sinks.read_table(spark, f"{path}/nodes")).withColumn("run_id", F.col("run_id").cast("string"))


def a6_header(spark: SparkSession, folder: str) -> DataFrame:
    header = _session(spark, folder).header
    return header.select("run_id", "timestamp", "n_clusters", "k_shape.x_shape", "k_shape.y_shape", "n_nodes", "n_topics")


def a6_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _flat_nodes(_session(spark, folder).nodes)


def a6_topics(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _session(spark, folder).topics.select("run_id", "id", F.inline("tokens"))
    return tokens.withColumn("weight", rounded(F.col("weight")))


def a6_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Every (node, document) of the paged article lists; pages of about fifty make several per node."""
    pages = _session(spark, folder, 50).articles
    return pages.select("run_id", "node", F.explode("articles").alias("doc_id"))


def p8_session_node(spark: SparkSession, folder: str) -> DataFrame:
    found = sinks.session_node(sinks.fold_session(_session(spark, folder)), NODE)
    return found.select("run_id", "node.id", "node.article_hits", sm.topics_text(F.col("node.topics")).alias("topics"))


def a7_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """What each step of a run knows of itself: sizes, errors as the last pass measured them, steps, inertia."""
    terms = vo.tokenize(articles(spark, folder))
    vocab, fitted = vo.fit_vocabulary(terms), cs.fit(spark, folder)
    rows = maps.vectors(spark, folder)
    model, means = som.fit(rows, MAP), maps.document_means(spark, folder)
    _, seen = som.place(rows, model.codebook)
    return sinks.attribute_rows(spark, RUN, {
        "tfidf": {"corpus_size": vocab.n_docs, "n_features": vocab.n_terms},
        "som": {
            "n_nodes": MAP.n_nodes, "n_topics": fitted.width, "topology": MAP.topology, "n_iter": model.n_iter,
            "converged": str(model.converged).lower(), "rows": seen["rows"],
            "quant_error": f"{seen['quant_error']:.5f}", "topo_error": f"{seen['topo_error']:.5f}",
        },
        "ward": {"n_clusters": cs.clusters(fitted).select("cluster").distinct().count()},
        "kmeans": {"inertia": f"{means.inertia:.4f}", "converged": str(means.converged).lower()},
    })


def j4_node_posts(spark: SparkSession, folder: str) -> DataFrame:
    return po.node_posts(articles(spark, folder).select("doc_id", "title"), cs.fit(spark, folder).assigned, NODE)


def k5_list_posts(spark: SparkSession, folder: str) -> DataFrame:
    return po.list_posts(posts(spark, folder))


def p12_violations(spark: SparkSession, folder: str) -> DataFrame:
    return po.violations(posts(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        s5_append_articles, s6_append_session, s7_overwrite_table, s8_upsert_nodes, s8_update_documents, s9_posts_with_nodes,
        s9_posts_by_title, s10_topic_json, a6_header, a6_nodes, a6_topics, a6_articles, a7_attributes,
        p8_session_node, j4_node_posts, k5_list_posts, p12_violations,
    )
}

_TITLES = f"(SELECT doc_id, {q.TITLE} AS title FROM documents)"
_NODES_SQL = q.with_(*cs.FINAL, *cs.COMPONENTS, cs.NODE_WEIGHTS, cs.node_words(5, 10), cs.TOPICS_TEXT, cs.HITS) + f"""
    SELECT '{RUN}' AS run_id, grid.node AS id, gx AS x_shape, gy AS y_shape, hits AS article_hits, topics
    FROM grid JOIN hits USING (node) JOIN tt USING (node)"""
_SLUG = "trim(regexp_replace({0}, '[^a-z0-9]+', '-', 'g'), '-')".format(q.FOLD.format("title"))


def _rule(field: str, kinds: str, limit: bool, value: str | None = None) -> str:
    value = f"coalesce(CAST({value or field} AS VARCHAR), '')"
    sql = f"SELECT doc_id, '{field}' AS field, 'required' AS rule FROM posts WHERE {kinds} AND length({value}) = 0"
    if limit:
        sql += f" UNION ALL SELECT doc_id, '{field}', 'max_length' FROM posts WHERE {kinds} AND length({value}) > 255"
    return sql


_POSTS = f"""posts AS MATERIALIZED (SELECT doc_id, title, {_SLUG} AS slug, created_at, lang, text AS body, source, NULL AS embed_code
    FROM (SELECT doc_id, {q.TITLE} AS title, text, lang, source, ts AS created_at FROM documents LEFT JOIN events ON event_id = doc_id))"""

ORACLES = {
    "s5_append_articles": "SELECT doc_id, lang, n_chars FROM documents",
    "s6_append_session": _NODES_SQL,
    "s7_overwrite_table": q.with_(*cs.FINAL) + maps._HITS,
    "s8_upsert_nodes": q.with_(*cs.FINAL)
    + """SELECT grid.node, gx AS x, gy AS y, coalesce(n.c, o.c, 0) AS hits FROM grid
        LEFT JOIN (SELECT node, count(*) AS c FROM aa GROUP BY node) n ON n.node = grid.node
        LEFT JOIN (SELECT node, count(*) AS c FROM a2 GROUP BY node) o ON o.node = grid.node""",
    "s8_update_documents": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE '??' END AS lang, n_chars, quality
        FROM documents d FULL JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id HAVING max(quality) = 1) l ON l.doc_id = d.doc_id""",
    "s9_posts_with_nodes": q.with_(*cs.FINAL) + f"SELECT doc_id, title, node FROM {_TITLES} LEFT JOIN aa USING (doc_id)",
    "s9_posts_by_title": q.with_(*cs.FINAL, f"t AS MATERIALIZED {_TITLES}")
    + """SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY title) THEN last END AS node FROM t LEFT JOIN (
        SELECT title, arg_max(node, doc_id) AS last FROM t JOIN aa USING (doc_id) GROUP BY title) USING (title)""",
    "s10_topic_json": q.with_(q.X, *cs.COMPONENTS)
    + f"""SELECT topic_id, '{{' || string_agg('"' || name || '":"' || printf('%.3f', weight) || '"', ',' ORDER BY rank) || '}}' AS data
        FROM {cs.top('comp', 'topic_id', 'name', 15)} GROUP BY topic_id""",
    "a6_header": f"""SELECT '{RUN}' AS run_id, TIMESTAMP '2024-01-01' AS "timestamp", {N_CLUSTERS} AS n_clusters,
        {MAP.kshape[0]} AS x_shape, {MAP.kshape[1]} AS y_shape, {MAP.n_nodes} AS n_nodes,
        CAST(max(len(embedding)) AS INTEGER) AS n_topics FROM embeddings""",
    "a6_nodes": _NODES_SQL,
    "a6_topics": q.with_(q.X, *cs.COMPONENTS)
    + f"""SELECT '{RUN}' AS run_id, topic_id AS id, rank, name, round(weight, 6) AS weight
        FROM {cs.top('comp', 'topic_id', 'name', 10)}""",
    "a6_articles": q.with_(*cs.FINAL) + f"SELECT '{RUN}' AS run_id, node, doc_id FROM aa",
    "a7_attributes": q.with_(q.tokens_of(), *q.vocabulary(), *maps._final(), maps._NEAR, *maps.lloyd_sql("x", "doc_id"))
    + f"""SELECT '{RUN}' AS run_id, model, key, value::VARCHAR AS value FROM (
        SELECT 'tfidf' AS model, 'corpus_size' AS key, (SELECT count(*) FROM tok)::VARCHAR AS value
        UNION ALL SELECT 'tfidf', 'n_features', (SELECT count(*) FROM voc)::VARCHAR
        UNION ALL SELECT 'som', 'n_nodes', (SELECT count(*) FROM kk)::VARCHAR
        UNION ALL SELECT 'som', 'n_topics', (SELECT max(len(vec)) FROM x)::VARCHAR
        UNION ALL SELECT 'som', 'topology', 'rect' UNION ALL SELECT 'ward', 'n_clusters', '{N_CLUSTERS}'
        UNION ALL SELECT 'som', 'n_iter', '{MAP.n_iter}' UNION ALL SELECT 'som', 'converged', 'true'
        UNION ALL SELECT 'som', 'rows', (SELECT count(*) FROM aa)::VARCHAR
        UNION ALL SELECT 'som', 'quant_error', (SELECT printf('%.5f', avg(qe)) FROM aa)
        UNION ALL SELECT 'som', 'topo_error', (SELECT printf('%.5f', avg(sqrt(pow(p.gx - s.gx, 2) + pow(p.gy - s.gy, 2))))
            FROM near a JOIN near b ON a.doc_id = b.doc_id AND a.rn = 1 AND b.rn = 2 JOIN grid p ON p.node = a.node JOIN grid s ON s.node = b.node)
        UNION ALL SELECT 'kmeans', 'inertia', (SELECT printf('%.4f', sum(d)) FROM cl)
        UNION ALL SELECT 'kmeans', 'converged', (SELECT (max(list_distance(o.vec, n.vec)) < 1e-9)::VARCHAR
            FROM c{maps.LLOYD_STEPS} n JOIN c{maps.LLOYD_STEPS - 1} o USING (node)))""",
    "p8_session_node": f"SELECT run_id, id, article_hits, topics FROM ({_NODES_SQL}) WHERE id = {NODE}",
    "j4_node_posts": q.with_(*cs.FINAL) + f"SELECT doc_id, title FROM {_TITLES} JOIN aa USING (doc_id) WHERE node = {NODE}",
    "k5_list_posts": f"""SELECT doc_id, ts AS created_at, title FROM {_TITLES} LEFT JOIN events ON event_id = doc_id
        ORDER BY ts DESC NULLS LAST, doc_id LIMIT 20""",
    "p12_violations": q.with_(_POSTS) + " UNION ALL ".join([
        _rule("created_at", "true", False), _rule("title", "true", True), _rule("slug", "true", True),
        _rule("body", "lang IN ('en', 'fr')", False), _rule("embed_code", "lang = 'de'", False),
        _rule("image_url", "lang = 'es'", True, "source"), _rule("author", "lang = 'fr'", True, "source"),
        _rule("comments.created_at", "true", False, "created_at"), _rule("comments.body", "true", False, "''"),
        _rule("comments.author", "true", True, "source"),
    ]),
}
