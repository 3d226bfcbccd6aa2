import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmap.operators import matrix as mx
from textmap.operators import reduce as rd
from textmap.operators import regions
from textmap.params import AnalysisParams, LdaParams, LsaParams, NmfParams, SomParams, TextParams, WardParams
from textmap.plans.analysis import run_analysis
from textmap.session import BROADCAST_LIMIT_BYTES
from textmap.sources import corpus as co


def low_rank(n_docs=80, n_terms=40, seed=0):
    rng = np.random.default_rng(seed)
    mask = rng.random((n_docs, n_terms)) < 0.3
    dense = np.where(mask, rng.random((n_docs, n_terms)), 0.0)
    # three groups of terms that go together, of clearly different strength
    for first, strength in ((0, 4.0), (5, 2.5), (10, 1.5)):
        dense[:, first : first + 5] += strength * rng.random((n_docs, 1)) * (rng.random((n_docs, 1)) < 0.5)
    dense[3] = 0
    return dense


def sparse_table(spark, dense, partitions=3):
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]]) for i, r in enumerate(dense)]
    return spark.createDataFrame(rows, "doc_id long, indices array<int>, values array<double>").repartition(partitions)


def by_term(components, n_terms, k):
    out = np.zeros((n_terms, k))
    for r in components.collect():
        out[r["term_id"], r["topic_id"]] = r["weight"]
    return out


def vectors(reduction, n_docs):
    out = np.zeros((n_docs, reduction.n_topics))
    for r in reduction.vectors.collect():
        out[r["doc_id"]] = r["vec"]
    return out


@pytest.mark.parametrize("gram_terms, limit, tolerance", [
    (2000, BROADCAST_LIMIT_BYTES, 1e-9), (0, BROADCAST_LIMIT_BYTES, 1e-9), (0, 8, 1e-5),
])
def test_lsa_equals_the_svd(spark, monkeypatch, gram_terms, limit, tolerance):
    monkeypatch.setattr(rd, "GRAM_TERMS", gram_terms)
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", limit)
    dense, k = low_rank(), 3
    found = rd.lsa(sparse_table(spark, dense), 80, 40, LsaParams(n_components=k, tolerance=tolerance, oversample=10))
    _, values, right = np.linalg.svd(dense, full_matrices=False)
    got = [found.attributes[f"singular_value_{i}"] for i in range(k)]
    assert np.allclose(got, values[:k], rtol=max(tolerance, 1e-7) * 10)
    v = by_term(found.components, 40, k)
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-6)
    # same subspace: the projection on the true components keeps every length
    assert np.allclose(np.linalg.svd(right[:k] @ v)[1], 1, atol=1e-6)
    docs = vectors(found, 80)
    lengths = np.linalg.norm(docs, axis=1)
    assert lengths[3] == 0 and np.allclose(np.delete(lengths, 3), 1)


def test_lsa_signs_and_partitions(spark):
    dense = low_rank(seed=4)
    one = rd.lsa(sparse_table(spark, dense, 1), 80, 40, LsaParams(n_components=4))
    many = rd.lsa(sparse_table(spark, dense, 8), 80, 40, LsaParams(n_components=4))
    a, b = by_term(one.components, 40, 4), by_term(many.components, 40, 4)
    assert np.allclose(a, b)
    assert (a[np.abs(a).argmax(axis=0), range(4)] > 0).all()


def test_component_count_is_clamped(spark):
    found = rd.lsa(sparse_table(spark, low_rank(6, 40)), 6, 40, LsaParams(n_components=300))
    assert found.n_topics == 5


@pytest.mark.parametrize("limit", [BROADCAST_LIMIT_BYTES, 8])
def test_nmf_is_non_negative_and_improves(spark, monkeypatch, limit):
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", limit)
    dense = low_rank(40, 20, 1)
    found = rd.nmf(sparse_table(spark, dense), 40, 20, NmfParams(n_components=3, max_steps=5, inner_steps=100, tolerance=0))
    w, h = vectors(found, 40), by_term(found.components, 20, 3)
    assert (w >= 0).all() and (h >= 0).all()
    errors = [found.attributes[f"error_{i}"] for i in range(found.attributes["n_iter"])]
    assert all(b <= a * 1.001 for a, b in zip(errors, errors[1:]))
    assert errors[-1] < errors[0]
    assert ((dense - w @ h.T) ** 2).sum() <= errors[-1] * 1.01
    # no rank-3 factors beat the SVD
    assert ((dense - w @ h.T) ** 2).sum() >= (np.linalg.svd(dense)[1][3:] ** 2).sum() - 1e-9


def brute_ward(points, edges, n_clusters):
    groups = [frozenset([i]) for i in range(len(points))]
    while len(groups) > n_clusters:
        best = None
        for a, b in itertools.combinations(sorted(groups, key=min), 2):
            if not any((i in a and j in b) or (i in b and j in a) for i, j in edges):
                continue
            gap = points[list(a)].mean(axis=0) - points[list(b)].mean(axis=0)
            cost = round(len(a) * len(b) / (len(a) + len(b)) * float(gap @ gap), 12)
            if best is None or cost < best[0]:
                best = (cost, a, b)
        groups = [g for g in groups if g not in best[1:]] + [best[1] | best[2]]
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("seed", range(5))
def test_ward_equals_brute_force(seed):
    points = np.random.default_rng(seed).normal(size=(20, 3))
    edges = regions.grid_edges((4, 5))
    labels = regions.ward_labels(points, edges, 6)
    got = sorted(sorted(np.flatnonzero(labels == c).tolist()) for c in range(6))
    assert got == brute_ward(points, edges, 6)


def test_ward_cuts_by_count_after_an_inversion():
    # a corner pair that becomes cheaper to join only after its neighbours merged
    points = np.array([[0.0], [1.0], [0.5], [9.0], [9.1], [5.0], [0.4], [8.8], [0.6]])
    labels = regions.ward_labels(points, regions.grid_edges((3, 3)), 3)
    assert len(set(labels.tolist())) == 3


def connected(cells, kshape):
    left, queue = set(cells), [next(iter(cells))]
    while queue:
        cell = queue.pop()
        if cell not in left:
            continue
        left.remove(cell)
        x, y = divmod(cell, kshape[1])
        queue += [nx * kshape[1] + ny for nx, ny in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1))
                  if 0 <= nx < kshape[0] and 0 <= ny < kshape[1]]
    return not left


def test_ward_regions_of_several_maps(spark):
    rng = np.random.default_rng(1)
    rows = [(m, n, [float(v) for v in rng.normal(size=3)]) for m in ("fr", "en") for n in range(12)]
    codebooks = spark.createDataFrame(rows, "lang string, node int, vec array<double>")
    found = regions.ward_regions(codebooks, (3, 4), 4, ["lang"]).toPandas()
    for _, one in found.groupby("lang"):
        assert sorted(one["cluster"].unique()) == [0, 1, 2, 3]
        assert all(connected(g["node"].tolist(), (3, 4)) for _, g in one.groupby("cluster"))
    single = regions.ward_regions(codebooks.where("lang = 'fr'").drop("lang"), (3, 4), 99).toPandas()
    assert sorted(single["cluster"]) == list(range(12))


def test_kmeans_and_lloyd(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.1, size=(20, 2)) for c in (0, 5, 10)])
    table = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "node long, vec array<double>")
    labels, centres, inertia = regions.kmeans(table, 3, restarts=3)
    assert labels.groupBy("cluster").count().select("count").distinct().first()[0] == 20
    assert inertia == pytest.approx(sum(((p - p.mean(axis=0)) ** 2).sum() for p in np.split(points, 3)), rel=1e-6)
    step = {r["cluster"]: r["vec"] for r in regions.lloyd_step(table, points[[0, 20, 40]]).collect()}
    assert np.allclose([step[i] for i in range(3)], [p.mean(axis=0) for p in np.split(points, 3)])
    assert centres.count() == 3


@pytest.fixture(scope="module")
def articles(spark):
    return co.documents_as_articles(co.read_corpus(spark, "/root/testdata/sf0.001/documents.parquet"))


PARAMS = AnalysisParams(
    text=TextParams(min_df=0.05), lsa=LsaParams(n_components=6), nmf=NmfParams(n_components=4, max_steps=3),
    lda=LdaParams(n_topics=3, n_iter=1), som=SomParams(kshape=(2, 3), n_iter=3), ward=WardParams(2),
)


@pytest.mark.parametrize("reducer, topics", [("lsa", 6), ("nmf", 4), ("lda", 3)])
def test_analysis_with_each_reducer(spark, articles, reducer, topics):
    from dataclasses import replace

    found = run_analysis(articles, replace(PARAMS, reducer=reducer))
    n_docs = found.vocabulary.n_docs
    assert found.reduction.n_topics == topics and found.corpus.count() == n_docs
    assert found.assigned.count() == n_docs
    table = found.map_table(2, 3).collect()
    assert sorted(r["node"] for r in table) == list(range(6))
    assert sum(r["hits"] for r in table) == n_docs
    assert {r["cluster"] for r in table} == {0, 1}
    assert all(len(r["topics"]) == 2 and all(len(t["tokens"]) == 3 for t in r["topics"]) for r in table)
    documents = found.corpus_table(1, 2)
    assert documents.count() == n_docs
    assert documents.where(F.col("x") * 3 + F.col("y") != F.col("node")).count() == 0
    keys = {(r["model"], r["key"]) for r in found.attributes("run").collect()}
    assert {("som", "quant_error"), ("som", "topo_error"), ("tfidf", "corpus_size"), (reducer, "n_topics")} <= keys


def test_analysis_takes_custom_steps(spark, articles):
    def first_letters(body):
        return F.transform(F.split(F.lower(body), r"\s+"), lambda w: F.concat(F.lit("w"), F.substring(w, 1, 1)))

    def reducer(rows, tokenized, vocab):
        return rd.lsa(rows, vocab.n_docs, vocab.n_terms, LsaParams(n_components=2))

    found = run_analysis(articles, PARAMS, tokenizer=first_letters, reducer=reducer)
    assert found.reduction.n_topics == 2
    assert all(t.startswith("w") for t in found.vocabulary.on_driver()[0])
    with pytest.raises(ValueError):
        from dataclasses import replace

        run_analysis(articles, replace(PARAMS, reducer="none"))


def test_fits_of_queries_are_not_cut_short(spark, small, monkeypatch):
    """K-means runs all restarts and steps, NMF until it settles."""
    from textmap.catalog import maps, models

    asked = []

    def restarts(table, n_clusters=6, id_col="node", max_iter=100, restarts=10, seed=0):
        asked.append((max_iter, restarts))
        return [table.selectExpr(f"{id_col} % 6 as cluster")] * 3

    monkeypatch.setattr(maps.regions, "kmeans", restarts)
    maps.c1_kmeans(spark, small), maps.c1_kmeans_documents(spark, small)
    assert asked == [(100, 10), (100, 10)]
    found = []
    fit = models.rd.nmf
    monkeypatch.setattr(models.rd, "nmf", lambda *a: found.append(fit(*a)) or found[-1])
    models.r2_nmf(spark, small)
    trace = [found[0].attributes[f"error_{i}"] for i in range(found[0].attributes["n_iter"])]
    assert len(trace) > 8


def test_lloyd_settles_and_measures_itself(spark):
    points = np.concatenate([np.random.default_rng(i).normal(3 * i, 0.3, (20, 2)) for i in range(3)])
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "node long, vec array<double>")
    start = np.vstack([points[[0, 1, 2]], [[99.0, 99.0]]])
    found = regions.lloyd(rows, start)
    centres, labels = start.copy(), None
    for _ in range(50):
        labels = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[labels == k].mean(axis=0) if (labels == k).any() else centres[k] for k in range(4)])
    assert found.converged and np.allclose(found.centres, centres) and (found.centres[3] == 99).all()
    assert [r["cluster"] for r in found.labels.orderBy("node").collect()] == labels.tolist()
    assert found.inertia == pytest.approx(((points - centres[labels]) ** 2).sum())
    assert not regions.lloyd(rows, start, max_iter=1).converged


def test_nmf_from_given_topics_is_the_same_on_both_routes(spark, monkeypatch):
    dense = low_rank(40, 20, 1)
    start = np.random.default_rng(3).random((20, 3))
    params = NmfParams(max_steps=3, inner_steps=2, tolerance=0.0)
    one = rd.nmf(sparse_table(spark, dense), 40, 20, params, start)
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", 8)
    monkeypatch.setattr("textmap.operators.matrix.LEAST_ROWS", 6)
    two = rd.nmf(sparse_table(spark, dense), 40, 20, params, start)
    assert np.allclose(by_term(one.components, 20, 3), by_term(two.components, 20, 3))
    assert np.allclose(vectors(one, 40), vectors(two, 40))
    assert one.attributes["converged"] == two.attributes["converged"] == "false"


def test_lsa_tells_whether_it_settled(spark, monkeypatch):
    monkeypatch.setattr(rd, "GRAM_TERMS", 0)
    rows = sparse_table(spark, low_rank())
    assert rd.lsa(rows, 80, 40, LsaParams(n_components=3, max_steps=1, oversample=0)).attributes["converged"] == "false"
    assert rd.lsa(rows, 80, 40, LsaParams(n_components=3)).attributes["converged"] == "true"
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", 8)
    monkeypatch.setattr("textmap.operators.matrix.LEAST_ROWS", 15)
    found = rd.lsa(rows, 80, 40, LsaParams(n_components=3, tolerance=1e-5, oversample=10))
    assert found.attributes["converged"] == "true"
    values = np.linalg.svd(low_rank())[1][:3]
    assert np.allclose([found.attributes[f"singular_value_{i}"] for i in range(3)], values, rtol=1e-4)


def em_by_hand(counts, topics, steps, alpha, eta):
    shares = np.full((len(counts), topics.shape[1]), 1 / topics.shape[1])
    for _ in range(steps):
        part = shares[:, None, :] * topics[None, :, :]
        part = counts[:, :, None] * part / np.maximum(part.sum(axis=2, keepdims=True), 1e-12)
        by_doc, by_term = part.sum(axis=1), part.sum(axis=0)
        shares = (by_doc + alpha) / (by_doc.sum(axis=1, keepdims=True) + alpha * topics.shape[1])
        topics = (by_term + eta) / (by_term.sum(axis=0) + eta * len(topics))
    return shares, topics


@pytest.mark.parametrize("least_rows", [256, 5])
def test_lda_by_blocks_of_terms(spark, monkeypatch, least_rows):
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", 8)
    monkeypatch.setattr("textmap.operators.matrix.LEAST_ROWS", least_rows)
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.4, (30, 17)).astype(float)
    counts[4], counts[:, 6] = 0, 0
    start = rng.random((17, 3))
    table = mx.matrix_table(spark, start)
    found = rd.lda_by_blocks(sparse_table(spark, counts), table, 17, 3, LdaParams(n_iter=3))
    shares, topics = em_by_hand(counts, start, 3, 0.1, 0.01)
    assert np.allclose(vectors(found, 30), shares) and np.allclose(by_term(found.components, 17, 3), topics)


def test_lda_over_a_long_term_list(spark, articles, monkeypatch):
    from textmap.operators import tfidf, vocabulary

    terms = vocabulary.tokenize(articles)
    vocab = vocabulary.fit_vocabulary(terms, TextParams(min_df=0.05))
    whole = tfidf.count_rows(terms, vocab).orderBy("doc_id").collect()
    monkeypatch.setattr(tfidf, "DICTIONARY_LIMIT", 5)
    monkeypatch.setattr(rd, "DICTIONARY_LIMIT", 5)
    assert tfidf.count_rows(terms, vocab).orderBy("doc_id").collect() == whole
    found = rd.lda(terms, vocab, LdaParams(n_topics=3, n_iter=2))
    shares = np.array([r["vec"] for r in found.vectors.collect()])
    assert len(shares) == articles.count() and np.allclose(shares.sum(axis=1), 1)
    assert np.allclose(by_term(found.components, vocab.n_terms, 3).sum(axis=0), 1)


def test_similar_documents_of_all(spark):
    from textmap.operators import summaries as sm

    rng = np.random.default_rng(7)
    dense = np.round(rng.random((90, 4)), 1)
    dense[10:14], dense[20] = dense[5], 0.0
    nodes = [0] * 60 + [1] * 29 + [2]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(dense)], "doc_id long, vec array<double>")
    assigned = spark.createDataFrame(list(enumerate(nodes)), "doc_id long, node int")
    unit = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    expected = {}
    for i in range(90):
        others = [(-round(float(unit[i] @ unit[j]), 12), j) for j in range(90) if j != i and nodes[i] == nodes[j]]
        expected[i] = [j for _, j in sorted(others)[:4]]
    for block in (1_000, 7):
        found = sm.all_similar_documents(rows, assigned, 4, block=block).orderBy("doc_id", "rank").collect()
        assert {i: [r["other_id"] for r in found if r["doc_id"] == i] for i in range(90)} == expected
    asked = spark.createDataFrame([(3,), (61,), (61,), (89,)], "doc_id long")
    some = sm.all_similar_documents(rows, assigned, 4, asked, block=7).orderBy("doc_id", "rank").collect()
    assert [r["other_id"] for r in some] == expected[3] + expected[61]


def test_lda_step_reads_the_rows_once(spark, monkeypatch):
    """Rows with ids of their own carry their shares along; rows that share an id still meet in the join."""
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", 8)
    monkeypatch.setattr("textmap.operators.matrix.LEAST_ROWS", 9)
    monkeypatch.setattr("textmap.operators.matrix.BLOCK_ENTRIES", 30)
    rng = np.random.default_rng(6)
    counts, start = rng.poisson(0.4, (30, 17)).astype(float), rng.random((17, 3))
    counts[4], counts[:, 6] = 0, 0
    passes, kept = [], rd.stage
    monkeypatch.setattr(rd, "stage", lambda df, name: passes.append(name) or kept(df, name))
    rows, table = sparse_table(spark, counts), mx.matrix_table(spark, start)
    found = rd.lda_by_blocks(rows, table, 17, 3, LdaParams(n_iter=3))
    shares, topics = em_by_hand(counts, start, 3, 0.1, 0.01)
    assert passes == ["lda-step", "lda-sums", "lda-topics"] * 3
    assert np.allclose(vectors(found, 30), shares) and np.allclose(by_term(found.components, 17, 3), topics)
    passes.clear()
    rd.lda_by_blocks(rows.unionByName(rows.where("doc_id = 3")), table, 17, 3, LdaParams(n_iter=1))
    assert "lda-rows" in passes
