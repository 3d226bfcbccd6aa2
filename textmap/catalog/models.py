"""Queries on topic models and on the whole analysis."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.catalog import sql as q
from textmap.catalog import summaries as cs
from textmap.catalog.maps import _HITS
from textmap.catalog.tables import articles
from textmap.catalog.text import ARTICLES_SQL, tokenized, weighted
from textmap.functions.vectors import rounded
from textmap.operators import matrix as mx
from textmap.operators import reduce as rd
from textmap.operators import som, sparse_som
from textmap.operators import summaries as sm
from textmap.operators import vocabulary as vo
from textmap.operators.tfidf import count_rows, tfidf
from textmap.params import AnalysisParams, LdaParams, LsaParams, NmfParams, SomParams, TextParams, WardParams
from textmap.plans.analysis import Analysis, run_analysis
from textmap.session import shuffles_removed, stage

SEED, WIDTH = 3, 4
POWER_STEPS = 60
NMF_STEPS, NMF_PASSES = 2, 4
LDA_STEPS = 4
PROJECTED_MAP = SomParams(kshape=(3, 4), n_iter=15, learning_rate=0.1, init="first")
PROJECTED_REGIONS = 4
SMALL_MAP = SomParams(kshape=(5, 6), n_iter=15)
LONG_LIST = TextParams(min_df=2, max_df=1.0)
WIDE_MAP = SomParams(kshape=(3, 4), n_iter=6, learning_rate=0.1, min_influence=0.001, seed=5)
TERM_MAP = SomParams(kshape=(3, 4), n_iter=10, learning_rate=0.1, decay="sparse", min_influence=0.001, seed=5)


def stored(spark: SparkSession, folder: str) -> tuple[DataFrame, vo.Vocabulary]:
    """TF-IDF rows as a stored table, since every step of a fit scans them."""
    rows, vocab = weighted(spark, folder)
    return stage(rows, "tfidf"), vocab


def r1_power_step(spark: SparkSession, folder: str) -> DataFrame:
    rows, vocab = weighted(spark, folder)
    step = rd.power_step(rows, _basis(vocab.n_terms)).select(F.col("row").alias("term_id"), F.posexplode("vec").alias("j", "z"))
    return step.withColumn("z", rounded(F.col("z"), 5))


def r1_first_component(spark: SparkSession, folder: str) -> DataFrame:
    rows, vocab = stored(spark, folder)
    found = rd.lsa(rows, vocab.n_docs, vocab.n_terms, LsaParams(n_components=4, tolerance=1e-9))
    return found.components.where("topic_id = 0").select("term_id", rounded(F.col("weight"), 5).alias("weight"))


def r1_lsa(spark: SparkSession, folder: str) -> DataFrame:
    """Ten heaviest terms of each of twenty LSA topics."""
    rows, vocab = stored(spark, folder)
    found = rd.lsa(rows, vocab.n_docs, vocab.n_terms, LsaParams(n_components=20))
    return sm.top_terms(found.components, vocab.terms, 10)


def r1_lsa_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows, vocab = stored(spark, folder)
    found = rd.lsa(rows, vocab.n_docs, vocab.n_terms, LsaParams(n_components=20))
    return found.vectors.select("doc_id", F.posexplode("vec").alias("topic_id", "weight"))


def r2_nmf_step(spark: SparkSession, folder: str) -> DataFrame:
    """Topics after one pass from given topics: weights fitted, sums taken, topics moved."""
    rows, vocab = weighted(spark, folder)
    start = _basis(vocab.n_terms)
    moved = rd.update_topics(start, *rd.nmf_sums(rows, start, NMF_STEPS), NMF_STEPS)
    return rd.components_of(spark, moved).withColumn("weight", rounded(F.col("weight")))


def r2_nmf(spark: SparkSession, folder: str) -> DataFrame:
    rows, vocab = stored(spark, folder)
    found = rd.nmf(rows, vocab.n_docs, vocab.n_terms, NmfParams(n_components=10))
    return sm.top_terms(found.components, vocab.terms, 10)


def r2_nmf_from_start(spark: SparkSession, folder: str) -> DataFrame:
    """Topics after several passes from given ones."""
    rows, vocab = stored(spark, folder)
    params = NmfParams(max_steps=NMF_PASSES, inner_steps=NMF_STEPS, tolerance=0.0)
    found = rd.nmf(rows, vocab.n_docs, vocab.n_terms, params, _basis(vocab.n_terms))
    return found.components.withColumn("weight", rounded(F.col("weight")))


def r4_nmf_map_from_start(spark: SparkSession, folder: str) -> DataFrame:
    """The whole analysis on NMF topics from given ones: map, regions, hits and words."""

    def topics(rows: DataFrame, tokenized: DataFrame, vocab: vo.Vocabulary) -> rd.Reduction:
        params = NmfParams(max_steps=NMF_PASSES, inner_steps=NMF_STEPS, tolerance=0.0)
        return rd.nmf(rows, vocab.n_docs, vocab.n_terms, params, _basis(vocab.n_terms))

    params = AnalysisParams(som=PROJECTED_MAP, ward=WardParams(PROJECTED_REGIONS))
    table = run_analysis(articles(spark, folder), params, reducer=topics).map_table(2, 3)
    return table.withColumn("topics", sm.topics_text(F.col("topics")))


def r3_lda_from_start(spark: SparkSession, folder: str) -> DataFrame:
    """LDA topics over the long term list after several steps from given ones."""
    terms = tokenized(spark, folder)
    vocab = vo.fit_vocabulary(terms, LONG_LIST)
    counts = stage(count_rows(terms, vocab), "counts")
    found = rd.lda_by_blocks(counts, stage(basis_table(spark, vocab.n_terms), "basis"), vocab.n_terms, WIDTH, LdaParams(n_iter=LDA_STEPS))
    return found.components.withColumn("weight", rounded(F.col("weight"), 9))


def r3_lda_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that go with them."""
    terms = tokenized(spark, folder)
    vocab = vo.fit_vocabulary(terms)
    counts = stage(count_rows(terms, vocab), "counts")
    found = rd.lda_by_blocks(counts, stage(basis_table(spark, vocab.n_terms), "basis"), vocab.n_terms, WIDTH, LdaParams(n_iter=LDA_STEPS))
    return found.vectors.select("doc_id", F.posexplode("vec").alias("topic_id", "share")).withColumn("share", rounded(F.col("share")))


def r3_lda(spark: SparkSession, folder: str) -> DataFrame:
    terms = tokenized(spark, folder)
    vocab = vo.fit_vocabulary(terms)
    found = rd.lda(terms, vocab, LdaParams(n_topics=8, n_iter=2))
    return sm.top_terms(found.components, vocab.terms, 10)


def analyse(spark: SparkSession, folder: str, reducer: str = "lsa") -> Analysis:
    params = AnalysisParams(
        lsa=LsaParams(n_components=20), nmf=NmfParams(n_components=10),
        lda=LdaParams(n_topics=8, n_iter=2), som=SMALL_MAP, reducer=reducer,
    )
    return run_analysis(articles(spark, folder), params)


def text_map(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to topics to a map: one row per node with region, hits and top topics."""
    table = analyse(spark, folder).map_table()
    return table.withColumn("topics", sm.topics_text(F.col("topics")))


def _basis(n_terms: int) -> np.ndarray:
    return np.array([[som.random_value(SEED, t, j) for j in range(WIDTH)] for t in range(n_terms)]).reshape(-1, WIDTH)


def r1_project(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the space of given components, scaled to length one."""
    rows, vocab = weighted(spark, folder)
    placed = mx.multiply(rows, _basis(vocab.n_terms) - 0.5, unit=True)
    return placed.select("doc_id", F.posexplode("vec").alias("topic_id", "w")).withColumn("w", rounded(F.col("w")))


def u4_projected_map(spark: SparkSession, folder: str) -> DataFrame:
    """The whole analysis with the caller's own reducer: given components instead of fitted ones."""

    def project(rows: DataFrame, tokenized: DataFrame, vocab: vo.Vocabulary) -> rd.Reduction:
        by_term = _basis(vocab.n_terms) - 0.5
        return rd.Reduction(mx.multiply(rows, by_term, unit=True), rd.components_of(spark, by_term), WIDTH, {})

    params = AnalysisParams(som=PROJECTED_MAP, ward=WardParams(PROJECTED_REGIONS))
    table = run_analysis(articles(spark, folder), params, reducer=project).map_table(2, 3)
    return table.withColumn("topics", sm.topics_text(F.col("topics")))


def r4_nmf_map(spark: SparkSession, folder: str) -> DataFrame:
    table = analyse(spark, folder, "nmf").map_table()
    return table.withColumn("topics", sm.topics_text(F.col("topics")))


def u1_custom_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequencies under a caller's own tokenizer: words between blanks."""
    terms = articles(spark, folder).select("doc_id", F.split(F.lower("body"), r"\s+").alias("terms"))
    return vo.document_frequencies(terms)


def m3_terms_best_unit(spark: SparkSession, folder: str) -> DataFrame:
    """Documents placed by their raw term weights, without a topic model."""
    rows, vocab = weighted(spark, folder)
    found = som.predict(rows, som.random_codebook(TERM_MAP.kshape, vocab.n_terms, TERM_MAP.seed))
    return found.select("doc_id", "node")


def m9_terms_epoch(spark: SparkSession, folder: str) -> DataFrame:
    """One epoch on raw term weights with the codebook as a table."""
    rows, vocab = stored(spark, folder)
    start = sparse_som.random_codebook(spark, TERM_MAP.kshape, vocab.n_terms, TERM_MAP.seed)
    after, _ = sparse_som.run_epoch(rows, start, TERM_MAP, 1)
    return sparse_som.entries(after).withColumn("w", rounded(F.col("w")))


def long_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, vo.Vocabulary]:
    """TF-IDF rows over every term of at least two documents, stored."""
    terms = tokenized(spark, folder)
    with shuffles_removed(spark):
        vocab = vo.fit_vocabulary(terms, LONG_LIST)
        return stage(tfidf(terms, vocab), "tfidf-long"), vocab


def basis_table(spark: SparkSession, n_terms: int) -> DataFrame:
    """``_basis`` as a (feature, weights) table made by the executors."""
    number = lambda j: F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), "id", F.lit(f":{j}"))), 1, 8), 16, 10)
    return spark.range(n_terms).select(
        F.col("id").cast("int").alias("feature"), F.array(*[number(j).cast("double") / F.lit(2.0**32) for j in range(WIDTH)]).alias("weights")
    )


def r1_wide_power_step(spark: SparkSession, folder: str) -> DataFrame:
    """The power step over the long term list, with the basis as a table that is sent in blocks."""
    rows, vocab = long_rows(spark, folder)
    placed = mx.multiply_by_blocks(rows, stage(basis_table(spark, vocab.n_terms), "basis"), vocab.n_terms, WIDTH)
    joined = stage(rows.join(placed, "doc_id").select("indices", "values", "vec"), "joined")
    step = mx.transpose_by_blocks(joined, vocab.n_terms, WIDTH)
    return step.select(F.col("row").alias("term_id"), F.posexplode("vec").alias("j", "z")).withColumn("z", rounded(F.col("z"), 5))


def m10_wide_fit(spark: SparkSession, folder: str) -> DataFrame:
    """All epochs of a map on the long term list, with the codebook as a table."""
    rows, vocab = long_rows(spark, folder)
    model = sparse_som.train(rows, vocab.n_terms, WIDE_MAP)
    return sparse_som.entries(model.codebook).withColumn("w", rounded(F.col("w")))


QUERIES = {
    f.__name__: f
    for f in (
        r1_wide_power_step, m10_wide_fit, m3_terms_best_unit, m9_terms_epoch, r1_project, u4_projected_map, r1_power_step, r1_first_component, r1_lsa, r1_lsa_vectors, r2_nmf_step, r2_nmf, r2_nmf_from_start, r4_nmf_map_from_start, r3_lda, r3_lda_from_start, r3_lda_shares, r4_nmf_map, text_map,
        u1_custom_tokenizer,
    )
}


_BASIS = f"""b AS MATERIALIZED (SELECT term_id, CAST(j AS INTEGER) AS j,
    ('0x' || md5('{SEED}:' || term_id || ':' || j)[1:8])::BIGINT / 4294967296.0::DOUBLE AS w
    FROM voc, range({WIDTH}) t(j))"""


def _nmf_ctes(passes: int) -> list[str]:
    """t0 .. tn: topics (term_id, j, w) after each pass. Multiplicative steps on weights (doc_id, j), then on topics."""
    ctes = ["t0 AS (SELECT * FROM b)"]
    for p in range(passes):
        ctes += [*_nmf_weights(f"t{p}", p), *_nmf_topics(f"t{p}", p)]
    return ctes


def _nmf_weights(topics: str, p: int) -> list[str]:
    """w{p}_n: the weights (doc_id, j, w) that fit given topics."""
    ctes = [
        f"sq{p} AS MATERIALIZED (SELECT l.j AS i, r.j AS j, sum(l.w * r.w) AS s FROM {topics} l JOIN {topics} r USING (term_id) GROUP BY ALL)",
        f"p{p} AS MATERIALIZED (SELECT doc_id, j, sum(v * w) AS p FROM cells JOIN {topics} USING (term_id) GROUP BY ALL)",
        f"w{p}_0 AS MATERIALIZED (SELECT doc_id, m.j AS j, p / (s + 1e-12::DOUBLE) AS w FROM p{p} m JOIN sq{p} s ON s.i = m.j AND s.j = m.j)",
    ]
    for step in range(1, NMF_STEPS + 1):
        ctes.append(f"""w{p}_{step} AS MATERIALIZED (SELECT o.doc_id, o.j, max(o.w) * max(p) / (sum(n.w * s) + 1e-12::DOUBLE) AS w
            FROM w{p}_{step - 1} o JOIN w{p}_{step - 1} n USING (doc_id) JOIN sq{p} s ON s.i = n.j AND s.j = o.j
            JOIN p{p} m ON m.doc_id = o.doc_id AND m.j = o.j GROUP BY o.doc_id, o.j)""")
    return ctes


def _nmf_topics(topics: str, p: int) -> list[str]:
    last = f"w{p}_{NMF_STEPS}"
    ctes = [
        f"a{p}_ AS MATERIALIZED (SELECT term_id, j, sum(v * w) AS a FROM cells JOIN {last} USING (doc_id) GROUP BY ALL)",
        f"ww{p} AS MATERIALIZED (SELECT l.j AS i, r.j AS j, sum(l.w * r.w) AS s FROM {last} l JOIN {last} r USING (doc_id) GROUP BY ALL)",
        f"h{p}_0 AS (SELECT * FROM {topics})",
    ]
    for step in range(1, NMF_STEPS + 1):
        ctes.append(f"""h{p}_{step} AS MATERIALIZED (SELECT o.term_id, o.j, max(o.w) * max(a) / (sum(n.w * s) + 1e-12::DOUBLE) AS w
            FROM h{p}_{step - 1} o JOIN h{p}_{step - 1} n USING (term_id) JOIN ww{p} s ON s.i = n.j AND s.j = o.j
            JOIN a{p}_ m ON m.term_id = o.term_id AND m.j = o.j GROUP BY o.term_id, o.j)""")
    return [*ctes, f"t{p + 1} AS MATERIALIZED (SELECT * FROM h{p}_{NMF_STEPS})"]


def _nmf_sql(passes: int) -> str:
    return q.with_(*q.tfidf_ctes(), _BASIS, *_nmf_ctes(passes)) + f"SELECT j AS topic_id, term_id, round(w, 6) AS weight FROM t{passes}"


def _first_component_sql() -> str:
    ctes = [*q.tfidf_ctes(), "v0 AS (SELECT term_id, 1.0::DOUBLE AS w FROM voc)"]
    for step in range(1, POWER_STEPS + 1):
        ctes += [
            f"y{step} AS MATERIALIZED (SELECT doc_id, sum(v * w) AS y FROM cells JOIN v{step - 1} USING (term_id) GROUP BY doc_id)",
            f"z{step} AS MATERIALIZED (SELECT term_id, sum(v * y) AS z FROM cells JOIN y{step} USING (doc_id) GROUP BY term_id)",
            f"v{step} AS MATERIALIZED (SELECT term_id, z / (SELECT sqrt(sum(z * z)) FROM z{step}) AS w FROM z{step})",
        ]
    return q.with_(*ctes) + f"SELECT term_id, round(w, 5) + 0.0 AS weight FROM v{POWER_STEPS}"


def _lda_ctes(tokens: list[str]) -> list[str]:
    """l0 .. ln: topics (term_id, j, w), d0 .. dn: shares (doc_id, j, s), by expectation-maximisation on counts."""
    priors = LdaParams()
    ctes = [
        *tokens, _BASIS,
        "uses AS MATERIALIZED (SELECT doc_id, term_id, count(*) AS n FROM (SELECT doc_id, unnest(terms) AS term FROM tok) JOIN voc USING (term) GROUP BY ALL)",
        "l0 AS (SELECT * FROM b)",
        f"d0 AS (SELECT doc_id, CAST(j AS INTEGER) AS j, 1.0::DOUBLE / {WIDTH} AS s FROM tok, range({WIDTH}) t(j))",
    ]
    for step in range(1, LDA_STEPS + 1):
        ctes += [
            f"""r{step} AS MATERIALIZED (SELECT doc_id, term_id, j, n * p / greatest(sum(p) OVER (PARTITION BY doc_id, term_id), 1e-12::DOUBLE) AS r
                FROM (SELECT u.doc_id, u.term_id, n, j, s * w AS p FROM uses u JOIN l{step - 1} USING (term_id) JOIN d{step - 1} USING (doc_id, j)))""",
            f"""d{step} AS MATERIALIZED (SELECT doc_id, j, (coalesce(r, 0) + {priors.share_prior}::DOUBLE)
                / (sum(coalesce(r, 0)) OVER (PARTITION BY doc_id) + {priors.share_prior}::DOUBLE * {WIDTH}) AS s
                FROM d0 LEFT JOIN (SELECT doc_id, j, sum(r) AS r FROM r{step} GROUP BY ALL) USING (doc_id, j))""",
            f"""l{step} AS MATERIALIZED (SELECT term_id, j, (coalesce(r, 0) + {priors.term_prior}::DOUBLE)
                / (sum(coalesce(r, 0)) OVER (PARTITION BY j) + {priors.term_prior}::DOUBLE * (SELECT count(*) FROM voc)) AS w
                FROM l0 LEFT JOIN (SELECT term_id, j, sum(r) AS r FROM r{step} GROUP BY ALL) USING (term_id, j))""",
        ]
    return ctes


# Document vectors x(doc_id, vec) in the space of the given components, zero where no term is known.
_PLACED = [
    "y AS MATERIALIZED (SELECT doc_id, j, sum(v * (w - 0.5)) AS y FROM cells JOIN b USING (term_id) GROUP BY doc_id, j)",
    """yl AS MATERIALIZED (SELECT doc_id, list(y / l ORDER BY j) AS vec FROM y JOIN (
        SELECT doc_id, sqrt(sum(y * y)) AS l FROM y GROUP BY doc_id) USING (doc_id) GROUP BY doc_id)""",
    f"""x AS MATERIALIZED (SELECT tok.doc_id, coalesce(vec, [0.0::DOUBLE for i in range({WIDTH})]) AS vec
        FROM tok LEFT JOIN yl ON yl.doc_id = tok.doc_id)""",
]
def _mapped(placed: list[str], components: str) -> list[str]:
    """The whole analysis with given document vectors x and components comp."""
    return [
        f"dedup AS MATERIALIZED (SELECT min(doc_id) AS doc_id, body FROM ({ARTICLES_SQL}) GROUP BY title, body)",
        q.tokens_of("dedup", "doc_id", "body"), *q.tfidf_ctes()[1:], _BASIS, *placed, q.XU, q.grid(PROJECTED_MAP),
        q.first_rows(PROJECTED_MAP.n_nodes), *[part for it in range(1, PROJECTED_MAP.n_iter + 1) for part in q.epoch(PROJECTED_MAP, it)],
        f"kk AS (SELECT * FROM k{PROJECTED_MAP.n_iter})", q.assign("kk", "aa"), *q.ward("kk", PROJECTED_MAP, PROJECTED_REGIONS),
        components, cs.NODE_WEIGHTS, cs.node_words(2, 3), cs.TOPICS_TEXT, f"hits AS ({_HITS})",
    ]


_PROJECTED = _mapped(_PLACED, "comp AS MATERIALIZED (SELECT j AS topic_id, term_id, term AS name, w - 0.5 AS weight FROM b JOIN voc USING (term_id))")
_FACTORED = _mapped(
    [
        *_nmf_ctes(NMF_PASSES), *_nmf_weights(f"t{NMF_PASSES}", NMF_PASSES),
        f"""x AS MATERIALIZED (SELECT tok.doc_id, coalesce(vec, [0.0::DOUBLE for i in range({WIDTH})]) AS vec FROM tok LEFT JOIN (
            SELECT doc_id, list(w ORDER BY j) AS vec FROM w{NMF_PASSES}_{NMF_STEPS} GROUP BY doc_id) m ON m.doc_id = tok.doc_id)""",
    ],
    f"comp AS MATERIALIZED (SELECT j AS topic_id, term_id, term AS name, w AS weight FROM t{NMF_PASSES} JOIN voc USING (term_id))",
)
_MAP_TABLE = """SELECT grid.node, gx AS x, gy AS y, cluster, hits, topics FROM grid
        JOIN node_clusters USING (node) JOIN hits USING (node) JOIN tt USING (node)"""

_LONG = q.tfidf_ctes(low="2", high="n")


def _term_start(params: SomParams) -> str:
    return f"""k0 AS MATERIALIZED (SELECT CAST(n AS INTEGER) AS node, term_id,
        ('0x' || md5('{params.seed}:' || n || ':' || term_id)[1:8])::BIGINT / 4294967296.0::DOUBLE AS w
        FROM voc, range({params.n_nodes}) t(n))"""


def _term_units(it: int) -> list[str]:
    """aa{it}: the best unit of every document on k{it - 1}, a codebook over terms."""
    before = f"k{it - 1}"
    return [
        f"kl{it} AS (SELECT node, sqrt(sum(w * w)) AS l FROM {before} GROUP BY node)",
        f"""dots{it} AS MATERIALIZED (SELECT doc_id, node, sum(v * w) / max(l) AS sim FROM cells JOIN {before} USING (term_id)
        JOIN kl{it} USING (node) GROUP BY doc_id, node)""",
        f"""aa{it} AS MATERIALIZED (SELECT tok.doc_id, coalesce(node, 0) AS node FROM tok LEFT JOIN (SELECT doc_id, node FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 12) DESC, node) AS rn FROM dots{it})
        WHERE rn = 1) u ON u.doc_id = tok.doc_id)""",
    ]


def _term_epoch(params: SomParams, it: int) -> list[str]:
    """k{it} from k{it - 1}."""
    return [
        *_term_units(it), q.kernel(params, it, f"hh{it}"),
        f"hits{it} AS MATERIALIZED (SELECT node, count(*) AS n FROM aa{it} GROUP BY node)",
        f"mass{it} AS MATERIALIZED (SELECT j, sum(h * n) AS m FROM hh{it} JOIN hits{it} ON b = node GROUP BY j)",
        f"sums{it} AS MATERIALIZED (SELECT node, term_id, sum(v) AS s FROM cells JOIN aa{it} USING (doc_id) GROUP BY ALL)",
        f"pull{it} AS MATERIALIZED (SELECT j, term_id, sum(h * s) AS p FROM hh{it} JOIN sums{it} ON b = node GROUP BY ALL)",
        f"""k{it} AS MATERIALIZED (SELECT o.node, o.term_id, CASE WHEN m > 0 THEN coalesce(p, 0) / m ELSE w END AS w
        FROM k{it - 1} o JOIN mass{it} ON mass{it}.j = o.node LEFT JOIN pull{it} x ON x.j = o.node AND x.term_id = o.term_id)""",
    ]


_TERM_UNITS = [*q.tfidf_ctes(), _term_start(TERM_MAP), *_term_units(1)]

ORACLES = {
    "r1_project": q.with_(*q.tfidf_ctes(), _BASIS, *_PLACED)
    + f"""SELECT doc_id, CAST(j AS INTEGER) AS topic_id, round(vec[j + 1], 6) + 0.0 AS w FROM x, range({WIDTH}) t(j)""",
    "u4_projected_map": q.with_(*_PROJECTED) + _MAP_TABLE,
    "r4_nmf_map_from_start": q.with_(*_FACTORED) + _MAP_TABLE,
    "m3_terms_best_unit": q.with_(*_TERM_UNITS) + "SELECT doc_id, node FROM aa1",
    "m9_terms_epoch": q.with_(*q.tfidf_ctes(), _term_start(TERM_MAP), q.grid(TERM_MAP), *_term_epoch(TERM_MAP, 1))
    + "SELECT node, term_id AS feature, round(w, 6) AS w FROM k1",
    "m10_wide_fit": q.with_(
        *_LONG, _term_start(WIDE_MAP), q.grid(WIDE_MAP), *[part for it in range(1, WIDE_MAP.n_iter + 1) for part in _term_epoch(WIDE_MAP, it)]
    ) + f"SELECT node, term_id AS feature, round(w, 6) AS w FROM k{WIDE_MAP.n_iter}",
    "r1_wide_power_step": q.with_(
        *_LONG,
        _BASIS,
        "y AS MATERIALIZED (SELECT doc_id, j, sum(v * w) AS y FROM cells JOIN b USING (term_id) GROUP BY doc_id, j)",
    ) + "SELECT term_id, j, round(sum(v * y), 5) + 0.0 AS z FROM cells JOIN y USING (doc_id) GROUP BY term_id, j",
    "r1_power_step": q.with_(
        *q.tfidf_ctes(),
        _BASIS,
        "y AS MATERIALIZED (SELECT doc_id, j, sum(v * w) AS y FROM cells JOIN b USING (term_id) GROUP BY doc_id, j)",
    ) + "SELECT term_id, j, round(sum(v * y), 5) + 0.0 AS z FROM cells JOIN y USING (doc_id) GROUP BY term_id, j",
    "r3_lda_from_start": q.with_(*_lda_ctes([q.tokens_of(), *q.vocabulary(low="2", high="n")]))
    + f"SELECT j AS topic_id, term_id, round(w, 9) + 0.0 AS weight FROM l{LDA_STEPS}",
    "r3_lda_shares": q.with_(*_lda_ctes([q.tokens_of(), *q.vocabulary()]))
    + f"SELECT doc_id, j AS topic_id, round(s, 6) + 0.0 AS share FROM d{LDA_STEPS}",
    "r2_nmf_step": _nmf_sql(1),
    "r2_nmf_from_start": _nmf_sql(NMF_PASSES),
    "r1_first_component": _first_component_sql(),
    "u1_custom_tokenizer": """SELECT term, count(DISTINCT doc_id) AS df FROM (
        SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM documents) GROUP BY term""",
}
