"""Queries on the self-organizing map, trained on the whole vector table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.catalog import sql as q
from textmap.catalog.tables import table, vectors
from textmap.functions import grid
from textmap.functions.vectors import rounded
from textmap.operators import many_maps, regions, som
from textmap.operators import summaries as sm
from textmap.params import SomParams

MAP = SomParams(kshape=(5, 6), n_iter=15, learning_rate=0.1, init="first")
SUM = SomParams(kshape=(5, 6), n_iter=15, learning_rate=0.001, init="first", update="sum")
SIGMA = SomParams(kshape=(5, 6), n_iter=15, learning_rate=0.1, init="first", decay="sigma")
SPARSE = SomParams(kshape=(5, 6), n_iter=15, learning_rate=0.1, init="first", decay="sparse", min_influence=0.001)
HEX = SomParams(kshape=(5, 6), n_iter=15, learning_rate=0.1, init="first", topology="hex")
TORUS = SomParams(kshape=(5, 6), n_iter=15, learning_rate=0.1, init="first", topology="torus")
LABEL_MAP = SomParams(kshape=(2, 5), n_iter=5, learning_rate=0.1)
LABEL_MAPS = SomParams(kshape=(3, 4), n_iter=10, learning_rate=0.1, init="first")
N_CLUSTERS = 6
LABEL_REGIONS = 4
FEATURES = [0, 3, 5, 7, 63]
SEED = 7


# Codebooks of this session, by what they were trained on; each is as large as its grid.
_trained: dict[tuple, som.Codebook] = {}


def trained(rows: DataFrame, params: SomParams = MAP, epochs: int | None = None) -> som.Codebook:
    """The codebook after the whole schedule, or after its first ``epochs``, without measuring in between.

    Trained once per session and content of the table.
    """
    epochs = params.n_iter if epochs is None else epochs
    content = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("doc_id", "vec"))).first()
    key = (rows.sparkSession.sparkContext.applicationId, params, epochs, *content)
    if key not in _trained:
        codebook = som.initial_codebook(rows, som.mx.width_of(rows), params)
        dist = grid.distance_matrix(params.kshape, params.topology)
        for it in range(1, epochs + 1):
            codebook = som.run_epoch(rows, codebook, params, it, dist).codebook
        _trained[key] = codebook
    return _trained[key]


def entries(codebook: DataFrame) -> DataFrame:
    return codebook.select("node", F.posexplode("vec").alias("feature", "w")).select(
        "node", "feature", rounded(F.col("w")).alias("w")
    )


def fitted(spark: SparkSession, folder: str, params: SomParams = MAP) -> tuple[DataFrame, som.Codebook, DataFrame]:
    """(vectors, codebook, assigned)."""
    rows = vectors(spark, folder)
    codebook = trained(rows, params)
    return rows, codebook, som.predict(rows, codebook)


def m1_random_codebook(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    codebook = som.random_codebook(MAP.kshape, som.mx.width_of(rows), SEED)
    return som.hits(som.predict(rows, codebook), MAP.kshape)


def m2_warm_start(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    means = rows.select("label", F.posexplode("vec").alias("f", "v")).groupBy("label", "f").agg(F.avg("v").alias("m"))
    # one node per label: the labels are the numbers 0 to 9
    k_init = means.groupBy(F.col("label").alias("node")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("f", "m"))), lambda e: e["m"]).alias("vec")
    )
    codebook = som.initial_codebook(rows, som.mx.width_of(rows), LABEL_MAP, k_init)
    dist = grid.distance_matrix(LABEL_MAP.kshape, LABEL_MAP.topology)
    return entries(som.run_epoch(rows, codebook, LABEL_MAP, 1, dist).codebook.to_df(spark))


def m3_best_unit(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    found = som.predict(rows, som.initial_codebook(rows, som.mx.width_of(rows), MAP))
    return found.select("doc_id", "node", rounded(F.col("qe"), 5).alias("qe"))


def m4_topographic_error(spark: SparkSession, folder: str) -> DataFrame:
    rows, codebook, _ = fitted(spark, folder)
    error = som.topographic_error(rows, codebook)
    return error.select(rounded(F.col("topographic_error")).alias("topographic_error"))


def m4_two_nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows, codebook, _ = fitted(spark, folder)
    near = som.two_nearest(rows, codebook)
    return near.select("doc_id", "node", "second", rounded(F.col("d1")).alias("d1"), rounded(F.col("d2")).alias("d2"))


def _density(spark: SparkSession, folder: str, params: SomParams) -> DataFrame:
    _, _, assigned = fitted(spark, folder)
    spread = sm.spread_hits(assigned, params, 3)
    return spread.select("node", rounded(F.col("density")).alias("density"))


def m5_kernel(spark: SparkSession, folder: str) -> DataFrame:
    return _density(spark, folder, MAP)


def m6_kernel_sigma(spark: SparkSession, folder: str) -> DataFrame:
    return _density(spark, folder, SIGMA)


def m7_kernel_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return _density(spark, folder, SPARSE)


def m20_kernel_hex(spark: SparkSession, folder: str) -> DataFrame:
    return _density(spark, folder, HEX)


def m21_kernel_torus(spark: SparkSession, folder: str) -> DataFrame:
    return _density(spark, folder, TORUS)


def m8_unfold_kernel(spark: SparkSession, folder: str) -> DataFrame:
    _, _, assigned = fitted(spark, folder)
    around = sm.unit_influence(assigned, MAP, 3)
    return around.select("node", "other", rounded(F.col("influence"), 9).alias("influence"))


def m9_epoch_sums(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    sums = som.epoch_sums(rows, som.initial_codebook(rows, som.mx.width_of(rows), MAP))
    return sums.select("node", "n", F.posexplode("vec").alias("feature", "s")).withColumn("s", rounded(F.col("s")))


def _epochs(spark: SparkSession, folder: str, params: SomParams, epochs: int | None = None) -> DataFrame:
    return entries(trained(vectors(spark, folder), params, epochs).to_df(spark))


def m9_epoch(spark: SparkSession, folder: str) -> DataFrame:
    return _epochs(spark, folder, MAP, 1)


def m9_epoch_summed(spark: SparkSession, folder: str) -> DataFrame:
    return _epochs(spark, folder, SUM, 1)


def m10_fit(spark: SparkSession, folder: str) -> DataFrame:
    return _epochs(spark, folder, MAP)


def m10_fit_hex(spark: SparkSession, folder: str) -> DataFrame:
    return _epochs(spark, folder, HEX)


def m10_fit_full(spark: SparkSession, folder: str) -> DataFrame:
    """All epochs of the schedule, then hits and U-matrix per node."""
    rows = vectors(spark, folder)
    model = som.fit(rows, MAP)
    u = som.u_matrix(model.codebook.to_df(spark), MAP.kshape)
    return som.hits(som.predict(rows, model.codebook), MAP.kshape).join(u, "node").withColumn("u", rounded(F.col("u"), 5))


def m11_trace(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    three = SomParams(kshape=MAP.kshape, n_iter=3, learning_rate=MAP.learning_rate, init="first")
    trace = som.fit(rows, three).trace_df(spark)
    return trace.select("it", *[rounded(F.col(c), 4).alias(c) for c in trace.columns[1:]])


def m12_predict(spark: SparkSession, folder: str) -> DataFrame:
    _, _, assigned = fitted(spark, folder)
    return assigned.select("doc_id", "node")


def m13_codebook(spark: SparkSession, folder: str) -> DataFrame:
    return entries(fitted(spark, folder)[1].to_df(spark))


def m14_u_matrix(spark: SparkSession, folder: str) -> DataFrame:
    _, codebook, _ = fitted(spark, folder)
    return som.u_matrix(codebook.to_df(spark), MAP.kshape).select("node", rounded(F.col("u")).alias("u"))


def m15_hits(spark: SparkSession, folder: str) -> DataFrame:
    return som.hits(fitted(spark, folder)[2], MAP.kshape)


def m16_projection(spark: SparkSession, folder: str) -> DataFrame:
    _, codebook, _ = fitted(spark, folder)
    return som.projection(codebook.to_df(spark), FEATURES).select("node", rounded(F.col("p")).alias("p"))


def m17_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    _, _, assigned = fitted(spark, folder)
    return regions.with_coordinates(assigned.select("doc_id", "node"), MAP.kshape)


def m18_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return sm.neighbour_hits(fitted(spark, folder)[2], MAP.kshape, 2)


def _points(spark: SparkSession, folder: str) -> DataFrame:
    """Integer points on both sides of zero, from the events."""
    return table(spark, folder, "events").select(
        "event_id", (F.col("user_id") - 25).alias("i"), (F.floor("value") - 10).alias("j")
    )


def m19_hex_frame(spark: SparkSession, folder: str) -> DataFrame:
    hx, hy = grid.to_hex(F.col("i"), F.col("j"))
    framed = _points(spark, folder).select("event_id", hx.alias("hex_x"), hy.alias("hex_y"))
    i, j = grid.from_hex(F.col("hex_x"), F.col("hex_y"))
    return framed.select("event_id", "hex_x", "hex_y", i.alias("i"), j.alias("j"))


def m20_hex_distance(spark: SparkSession, folder: str) -> DataFrame:
    hx, hy = grid.to_hex(F.col("i"), F.col("j"))
    d: Column = grid.hex_distance(hx - 3, hy - 4)
    return _points(spark, folder).select("event_id", d.alias("d"))


def m22_distances(spark: SparkSession, folder: str) -> DataFrame:
    rows, codebook, _ = fitted(spark, folder)
    found = som.node_distances(rows, codebook).select("doc_id", F.posexplode("distances").alias("node", "d"))
    return found.withColumn("d", rounded(F.col("d")))


def m23_subtract(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each vector after taking away its node's vector."""
    rows, codebook, assigned = fitted(spark, folder)
    left = rows.select(F.col("doc_id").alias("row"), F.posexplode("vec").alias("feature", "v"))
    nodes = codebook.to_df(spark).select("node", F.posexplode("vec").alias("feature", "v"))
    right = assigned.select(F.col("doc_id").alias("row"), "node").join(nodes, "node").select("row", "feature", "v")
    return som.subtract(left, right).select("row", "feature", rounded(F.col("v")).alias("v"))


def m24_clip(spark: SparkSession, folder: str) -> DataFrame:
    return entries(som.clip(fitted(spark, folder)[1].to_df(spark)))


def a8_mean_error(spark: SparkSession, folder: str) -> DataFrame:
    _, _, assigned = fitted(spark, folder)
    return assigned.agg(rounded(F.avg("qe"), 5).alias("mean_qe"))


def c1_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    _, codebook, _ = fitted(spark, folder)
    return regions.kmeans(codebook.to_df(spark), N_CLUSTERS)[0]


def c1_kmeans_documents(spark: SparkSession, folder: str) -> DataFrame:
    labels, _, _ = regions.kmeans(vectors(spark, folder), N_CLUSTERS, "doc_id")
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("articles"))


def c1_kmeans_from_start(spark: SparkSession, folder: str) -> DataFrame:
    """k-means of the map's nodes from the first of them, until it settles."""
    _, codebook, _ = fitted(spark, folder)
    found = regions.lloyd(codebook.to_df(spark), codebook.weights[:N_CLUSTERS])
    return found.labels.select(F.col("node").cast("int").alias("node"), "cluster", rounded(F.col("d")).alias("d"))


def document_means(spark: SparkSession, folder: str) -> regions.Clusters:
    rows = vectors(spark, folder)
    return regions.lloyd(rows, som.first_rows_codebook(rows, (N_CLUSTERS, 1)).weights, "doc_id")


def c1_kmeans_documents_from_start(spark: SparkSession, folder: str) -> DataFrame:
    """k-means of all vectors from the first of them, until it settles."""
    return document_means(spark, folder).labels.select("doc_id", "cluster", rounded(F.col("d")).alias("d"))


def c1_lloyd_step(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    centres = som.first_rows_codebook(rows, (N_CLUSTERS, 1)).weights
    moved = regions.lloyd_step(rows, centres, "doc_id")
    return moved.select("cluster", "n", F.posexplode("vec").alias("feature", "v")).withColumn("v", rounded(F.col("v")))


def c2_ward_regions(spark: SparkSession, folder: str) -> DataFrame:
    _, codebook, _ = fitted(spark, folder)
    return regions.ward_regions(codebook.to_df(spark), MAP.kshape, N_CLUSTERS)


def u2_start_function(spark: SparkSession, folder: str) -> DataFrame:
    """A map whose start is a function of the data: the mean of all rows, moved a little for each node."""

    def start(rows: DataFrame) -> DataFrame:
        means = rows.select(F.posexplode("vec").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("m"))
        mean = F.transform(F.array_sort(F.collect_list(F.struct("f", "m"))), lambda e: e["m"]).alias("mean")
        nodes = means.groupBy().agg(mean).withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(MAP.n_nodes - 1))))
        moved = F.transform("mean", lambda m, f: m + F.when((f % MAP.n_nodes) == F.col("node"), 0.1).otherwise(0.0))
        return nodes.select("node", moved.alias("vec"))

    return entries(som.fit(vectors(spark, folder), MAP, k_init=start).codebook.to_df(spark))


def u3_fit_then_predict(spark: SparkSession, folder: str) -> DataFrame:
    """A model fitted on the first labels places the rows of the others; its last error stands beside them."""
    rows = vectors(spark, folder)
    model = som.fit(rows.where(F.col("label") < 5), MAP)
    placed = som.predict(rows.where(F.col("label") >= 5), model.codebook)
    return placed.select("doc_id", "node", rounded(F.lit(model.quantization_error), 5).alias("fit_error"))


def label_maps(spark: SparkSession, folder: str) -> many_maps.Maps:
    """One map for each label, all trained together."""
    return many_maps.fit(vectors(spark, folder), "label", LABEL_MAPS)


def m10_maps_by_label(spark: SparkSession, folder: str) -> DataFrame:
    codebooks = label_maps(spark, folder).codebooks
    return codebooks.select("label", "node", F.posexplode("vec").alias("feature", "w")).withColumn("w", rounded(F.col("w")))


def m11_traces_by_label(spark: SparkSession, folder: str) -> DataFrame:
    trace = label_maps(spark, folder).trace
    return trace.select("label", "it", *[rounded(F.col(c), 4).alias(c) for c in trace.columns[2:]])


def m12_predict_by_label(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    return many_maps.predict(rows, label_maps(spark, folder)).select("label", "doc_id", "node", rounded(F.col("qe"), 5).alias("qe"))


def c2_regions_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """The regions of every label's map; each map is clustered in a task of its own."""
    return regions.ward_regions(label_maps(spark, folder).codebooks, LABEL_MAPS.kshape, LABEL_REGIONS, ["label"])


QUERIES = {
    f.__name__: f
    for f in (
        m1_random_codebook, m2_warm_start, m3_best_unit, m4_topographic_error, m4_two_nearest, m5_kernel,
        m6_kernel_sigma, m7_kernel_sparse, m8_unfold_kernel, m9_epoch_sums, m9_epoch, m9_epoch_summed, m10_fit,
        m10_fit_hex, m10_fit_full, m11_trace, m12_predict, m13_codebook, m14_u_matrix, m15_hits, m16_projection,
        m17_coordinates, m18_neighbours, m19_hex_frame, m20_hex_distance, m20_kernel_hex, m21_kernel_torus,
        m22_distances, m23_subtract, m24_clip, a8_mean_error, c1_kmeans, c1_kmeans_documents, c1_kmeans_from_start, c1_kmeans_documents_from_start, c1_lloyd_step,
        c2_ward_regions, u2_start_function, u3_fit_then_predict, m10_maps_by_label, m11_traces_by_label, m12_predict_by_label, c2_regions_by_label,
    )
}


def _final(params: SomParams = MAP) -> list[str]:
    """Training CTEs, then kk (final codebook) and aa (assignment by it)."""
    return [*q.trained(params, params.n_iter), f"kk AS (SELECT * FROM k{params.n_iter})", q.assign("kk", "aa")]


def _entries(codebook: str, value: str = "w") -> str:
    return f"""SELECT node, f - 1 AS feature, round({value}, 6) + 0.0 AS w FROM (
        SELECT node, unnest(vec) AS w, CAST(generate_subscripts(vec, 1) AS INTEGER) AS f FROM {codebook})"""


def _density_sql(params: SomParams) -> str:
    return q.with_(*_final(), q.kernel(params, 3, "hh", cut=False)) + """SELECT j AS node, round(sum(h * n), 6) + 0.0 AS density
        FROM hh JOIN (SELECT node, count(*) AS n FROM aa GROUP BY node) ON b = node GROUP BY j"""


_HITS = """SELECT grid.node, coalesce(n, 0) AS hits FROM grid
    LEFT JOIN (SELECT node, count(*) AS n FROM aa GROUP BY node) c ON c.node = grid.node"""
_U_MATRIX = f"""SELECT a.node, avg(list_dot_product({q.UNIT.format('k.vec')}, {q.UNIT.format('m.vec')})) AS u
    FROM grid a JOIN grid b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.node <> b.node
    JOIN kk k ON k.node = a.node JOIN kk m ON m.node = b.node GROUP BY a.node"""
_NEAR = """near AS MATERIALIZED (SELECT doc_id, node, d, row_number() OVER (PARTITION BY doc_id ORDER BY round(d, 12), node) AS rn
    FROM (SELECT doc_id, node, list_sum([(a[1] - a[2]) * (a[1] - a[2]) for a in list_zip(x.vec, k.vec)]) AS d FROM x, kk k))"""
_HX, _HY = "(i - sign(j) * floor(abs(j) / 2.0))", "(i + sign(j) * ceil(abs(j) / 2.0))"
_POINTS = "SELECT event_id, user_id - 25 AS i, floor(value) - 10 AS j FROM events"
_LABELS = """k0 AS MATERIALIZED (SELECT node, list(m ORDER BY f) AS vec FROM (
    SELECT label AS node, f, m FROM (
    SELECT label, f, avg(v) AS m FROM (SELECT label, unnest(vec) AS v, generate_subscripts(vec, 1) AS f FROM x)
    GROUP BY ALL)) GROUP BY node)"""
_OF_LABELS = q.trained_by("label", LABEL_MAPS)
_LAST = f"k{LABEL_MAPS.n_iter}"
_ONE = SomParams(kshape=MAP.kshape, n_iter=3, learning_rate=MAP.learning_rate, init="first")


# Steps that settle k-means on the test tables and then repeat themselves.
LLOYD_STEPS = 40


def lloyd_sql(rows: str, key: str, name: str = "c") -> list[str]:
    """{name}0 .. {name}n: centres (node, vec) from the first rows of ``rows``(key, vec), and {name}l: the last labels."""
    near = lambda k: f"""(SELECT {key}, node, d FROM (SELECT {key}, node, d, row_number() OVER (PARTITION BY {key} ORDER BY round(d, 12), node) AS rn
        FROM (SELECT x.{key}, k.node, list_sum([(a[1] - a[2]) * (a[1] - a[2]) for a in list_zip(x.vec, k.vec)]) AS d FROM {rows} x, {name}{k} k)) WHERE rn = 1)"""  # noqa: E731
    parts = [f"""{name}0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY {key}) - 1 AS INTEGER) AS node, vec
        FROM {rows} ORDER BY {key} LIMIT {N_CLUSTERS})"""]
    for step in range(1, LLOYD_STEPS + 1):
        parts.append(f"""{name}{step} AS MATERIALIZED (SELECT o.node, coalesce(m.vec, o.vec) AS vec FROM {name}{step - 1} o LEFT JOIN (
            SELECT node, list(v ORDER BY f) AS vec FROM (SELECT node, f, avg(v) AS v FROM (
            SELECT n.node, unnest(x.vec) AS v, generate_subscripts(x.vec, 1) AS f FROM {near(step - 1)} n JOIN {rows} x ON x.{key} = n.{key})
            GROUP BY ALL) GROUP BY node) m ON m.node = o.node)""")
    return [*parts, f"{name}l AS MATERIALIZED (SELECT * FROM {near(LLOYD_STEPS)})"]


def _trace_sql() -> str:
    parts = []
    for it in (1, 2, 3):
        fade = f"exp(-{it}::DOUBLE / (3 / ln(5::DOUBLE)))"
        square = "sqrt(list_sum([e * e for e in flatten(list(vec))]))"
        gap = "sqrt(sum(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(n.vec, o.vec)])))"
        parts.append(f"""SELECT {it} AS it, round(5 * {fade}, 4) AS radius, round(0.1 * {fade}, 4) AS learning_rate,
            round((SELECT avg(qe) FROM a{it}), 4) AS quantization_error,
            round((SELECT {gap} FROM k{it} n JOIN k{it - 1} o USING (node)), 4) AS unit_deltas_update,
            round((SELECT {square} FROM k{it}), 4) AS codebook_norm""")
    return q.with_(*q.trained(_ONE, 3)) + " UNION ALL ".join(parts)


ORACLES = {
    "m1_random_codebook": q.with_(q.X, q.XU, q.grid(MAP), q.random_rows(MAP.n_nodes, SEED), q.assign("k0", "aa")) + _HITS,
    "m2_warm_start": q.with_(q.X, q.XU, q.grid(LABEL_MAP), _LABELS, *q.epoch(LABEL_MAP, 1)) + _entries("k1"),
    "m3_best_unit": q.with_(q.X, q.XU, q.first_rows(MAP.n_nodes), q.assign("k0", "aa"))
    + "SELECT doc_id, node, round(qe, 5) + 0.0 AS qe FROM aa",
    "m4_two_nearest": q.with_(*_final(), _NEAR)
    + """SELECT a.doc_id, a.node, b.node AS second, round(a.d, 6) AS d1, round(b.d, 6) AS d2
        FROM near a JOIN near b ON a.doc_id = b.doc_id AND a.rn = 1 AND b.rn = 2""",
    "m4_topographic_error": q.with_(*_final(), _NEAR)
    + """SELECT round(avg(sqrt(pow(p.gx - s.gx, 2) + pow(p.gy - s.gy, 2))), 6) AS topographic_error
        FROM near a JOIN near b ON a.doc_id = b.doc_id AND a.rn = 1 AND b.rn = 2
        JOIN grid p ON p.node = a.node JOIN grid s ON s.node = b.node""",
    "m5_kernel": _density_sql(MAP),
    "m6_kernel_sigma": _density_sql(SIGMA),
    "m7_kernel_sparse": _density_sql(SPARSE),
    "m20_kernel_hex": _density_sql(HEX),
    "m21_kernel_torus": _density_sql(TORUS),
    "m8_unfold_kernel": q.with_(*_final(), q.kernel(MAP, 3, "hh", cut=False))
    + "SELECT b AS node, j AS other, round(h, 9) + 0.0 AS influence FROM hh WHERE b IN (SELECT node FROM aa)",
    "m9_epoch_sums": q.with_(*q.trained(MAP, 1))
    + "SELECT node, n, CAST(f - 1 AS INTEGER) AS feature, round(s, 6) + 0.0 AS s FROM s1",
    "m9_epoch": q.with_(*q.trained(MAP, 1)) + _entries("k1"),
    "m9_epoch_summed": q.with_(*q.trained(SUM, 1)) + _entries("k1"),
    "m10_fit": q.with_(*_final()) + _entries("kk"),
    "m10_fit_hex": q.with_(*_final(HEX)) + _entries("kk"),
    "m11_trace": _trace_sql(),
    "m12_predict": q.with_(*_final()) + "SELECT doc_id, node FROM aa",
    "m13_codebook": q.with_(*_final()) + _entries("kk"),
    "m14_u_matrix": q.with_(*_final()) + f"SELECT node, round(u, 6) AS u FROM ({_U_MATRIX})",
    "m15_hits": q.with_(*_final()) + _HITS,
    "m10_fit_full": q.with_(*_final(), f"hits AS ({_HITS})", f"un AS ({_U_MATRIX})")
    + "SELECT node, hits, round(u, 5) AS u FROM hits JOIN un USING (node)",
    "m16_projection": q.with_(*_final())
    + f"""SELECT node, round(avg(v), 6) + 0.0 AS p FROM (SELECT node, unnest({q.UNIT.format('vec')}) AS v,
        generate_subscripts(vec, 1) - 1 AS f FROM kk) WHERE f IN ({', '.join(map(str, FEATURES))}) AND v <> 0 GROUP BY node""",
    "m17_coordinates": q.with_(*_final()) + "SELECT doc_id, aa.node, gx AS x, gy AS y FROM aa JOIN grid ON grid.node = aa.node",
    "m18_neighbours": q.with_(*_final(), f"hits AS ({_HITS})")
    + """SELECT a.node, count(*) AS neighbours, CAST(sum(hits) AS BIGINT) AS hits FROM grid a JOIN grid b
        ON abs(a.gx - b.gx) <= 2 AND abs(a.gy - b.gy) <= 2 AND a.node <> b.node
        JOIN hits ON hits.node = b.node GROUP BY a.node""",
    "m19_hex_frame": f"""SELECT event_id, CAST(hx AS INTEGER) AS hex_x, CAST(hy AS INTEGER) AS hex_y,
        CAST(trunc((hx + hy) / 2.0) AS INTEGER) AS i, CAST(hy - hx AS INTEGER) AS j
        FROM (SELECT event_id, {_HX} AS hx, {_HY} AS hy FROM ({_POINTS}))""",
    "m20_hex_distance": f"""SELECT event_id, CAST(CASE WHEN dx * dy >= 0 THEN greatest(abs(dx), abs(dy))
        ELSE abs(dx) + abs(dy) END AS INTEGER) AS d
        FROM (SELECT event_id, {_HX} - 3 AS dx, {_HY} - 4 AS dy FROM ({_POINTS}))""",
    "m22_distances": q.with_(*_final(), _NEAR) + "SELECT doc_id, node, round(d, 6) AS d FROM near",
    "m23_subtract": q.with_(*_final())
    + """SELECT doc_id AS "row", f - 1 AS feature, round(a - b, 6) + 0.0 AS v FROM (
        SELECT doc_id, CAST(generate_subscripts(x.vec, 1) AS INTEGER) AS f, unnest(x.vec) AS a, unnest(kk.vec) AS b
        FROM x JOIN aa USING (doc_id) JOIN kk ON kk.node = aa.node) WHERE a - b <> 0""",
    "m24_clip": q.with_(*_final()) + _entries("kk", "CASE WHEN w < 1e-4::DOUBLE THEN 0.0 ELSE w END"),
    "a8_mean_error": q.with_(*_final()) + "SELECT round(avg(qe), 5) AS mean_qe FROM aa",
    "c1_kmeans_from_start": q.with_(*_final(), "units AS (SELECT node AS unit, vec FROM kk)", *lloyd_sql("units", "unit"))
    + "SELECT unit AS node, node AS cluster, round(d, 6) + 0.0 AS d FROM cl",
    "c1_kmeans_documents_from_start": q.with_(q.X, *lloyd_sql("x", "doc_id")) + "SELECT doc_id, node AS cluster, round(d, 6) + 0.0 AS d FROM cl",
    "c1_lloyd_step": q.with_(q.X, q.first_rows(N_CLUSTERS, "kk"), _NEAR)
    + """SELECT node AS cluster, count(*) AS n, feature, round(avg(v), 6) + 0.0 AS v FROM (
        SELECT node, unnest(vec) AS v, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS feature
        FROM near JOIN x USING (doc_id) WHERE rn = 1) GROUP BY node, feature""",
    "u2_start_function": q.with_(q.X, q.XU, q.grid(MAP), f"""k0 AS MATERIALIZED (SELECT node, list(m + CASE WHEN (f - 1) % {MAP.n_nodes} = node
        THEN 0.1::DOUBLE ELSE 0.0 END ORDER BY f) AS vec FROM grid, (SELECT f, avg(v) AS m FROM (
        SELECT unnest(vec) AS v, generate_subscripts(vec, 1) AS f FROM x) GROUP BY f) GROUP BY node)""",
        *[part for it in range(1, MAP.n_iter + 1) for part in q.epoch(MAP, it)]) + _entries(f"k{MAP.n_iter}"),
    "u3_fit_then_predict": q.with_(q.X.replace("x AS", "every AS", 1), "x AS MATERIALIZED (SELECT * FROM every WHERE label < 5)", q.XU, q.grid(MAP),
        q.first_rows(MAP.n_nodes), *[part for it in range(1, MAP.n_iter + 1) for part in q.epoch(MAP, it)],
        f"others AS MATERIALIZED (SELECT doc_id, {q.UNIT.format('vec')} AS u FROM every WHERE label >= 5)",
        q.assign(f"k{MAP.n_iter}", "aa", "others")) + f"SELECT doc_id, node, (SELECT round(avg(qe), 5) FROM a{MAP.n_iter}) AS fit_error FROM aa",
    "m10_maps_by_label": q.with_(*_OF_LABELS) + f"""SELECT label, node, CAST(f - 1 AS INTEGER) AS feature, round(w, 6) + 0.0 AS w FROM (
        SELECT label, node, unnest(vec) AS w, generate_subscripts(vec, 1) AS f FROM {_LAST})""",
    "m11_traces_by_label": q.with_(*_OF_LABELS) + " UNION ALL ".join(
        f"""SELECT label, {it} AS it, round(e, 4) AS quantization_error, round(gap, 4) AS unit_deltas_update, round(size, 4) AS codebook_norm
        FROM (SELECT label, avg(qe) AS e FROM a{it} GROUP BY label) JOIN (
            SELECT n.label, sqrt(sum(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(n.vec, o.vec)]))) AS gap,
                sqrt(sum(list_sum([e * e for e in n.vec]))) AS size
            FROM k{it} n JOIN k{it - 1} o ON n.label = o.label AND n.node = o.node GROUP BY n.label) USING (label)"""
        for it in range(1, LABEL_MAPS.n_iter + 1)
    ),
    "m12_predict_by_label": q.with_(*_OF_LABELS, q.assign_by("label", _LAST, "aa"))
    + "SELECT label, doc_id, node, round(qe, 5) + 0.0 AS qe FROM aa",
    "c2_regions_by_label": q.with_(*_OF_LABELS, *q.ward_by("label", _LAST, LABEL_MAPS, LABEL_REGIONS)) + "SELECT label, node, cluster FROM node_clusters",
    "c2_ward_regions": q.with_(*_final(), *q.ward("kk", MAP, N_CLUSTERS)) + "SELECT node, cluster FROM node_clusters",
}
