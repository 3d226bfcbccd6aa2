import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmap.functions import grid
from textmap.operators import matrix as mx
from textmap.operators import som, sparse_som
from textmap.params import SomParams
from textmap.session import BROADCAST_LIMIT_BYTES


def vector_table(spark, rows, partitions=2):
    data = [(i, [float(v) for v in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, vec array<double>").repartition(partitions)


def random_rows(n, width, seed=0):
    return np.random.default_rng(seed).normal(size=(n, width))


def test_hex_points(spark):
    points = [(0, 2), (0, 1), (1, 0), (0, 3)]
    hx, hy = grid.to_hex(F.col("i"), F.col("j"))
    got = spark.createDataFrame(points, "i int, j int").select(hx, hy).collect()
    assert [tuple(r) for r in got] == [(-1, 1), (0, 1), (1, 1), (-1, 2)]


def test_hex_round_trip(spark):
    points = [(i, j) for i in range(-4, 5) for j in range(-4, 5)]
    hx, hy = grid.to_hex(F.col("i"), F.col("j"))
    framed = spark.createDataFrame(points, "i int, j int").select("i", "j", hx.alias("a"), hy.alias("b"))
    back = framed.select("i", "j", *grid.from_hex(F.col("a"), F.col("b"))).collect()
    assert all((r[0], r[1]) == (r[2], r[3]) for r in back if r[0] >= 0 and r[1] >= 0)


def test_hex_distance(spark):
    df = spark.createDataFrame([(0, 0), (5, 1)], "x int, y int")
    got = df.select(grid.hex_distance(F.col("x") - 3, F.col("y") - 4).alias("d")).collect()
    assert [r["d"] for r in got] == [4, 5]


@pytest.mark.parametrize("topology", ["rect", "hex", "torus"])
@pytest.mark.parametrize("kshape", [(3, 4), (1, 5), (4, 1)])
def test_distance_matrix_equals_the_pair_table(spark, topology, kshape):
    size = kshape[0] * kshape[1]
    table = np.zeros((size, size))
    for r in grid.node_pairs(spark, kshape, topology).collect():
        table[r["node"], r["other"]] = r["distance"]
    assert np.allclose(table, grid.distance_matrix(kshape, topology))
    assert np.allclose(table, table.T)


@pytest.mark.parametrize("decay", ["default", "sigma", "sparse"])
def test_influence_column_equals_matrix(spark, decay):
    params = SomParams(kshape=(3, 4), n_iter=10, decay=decay, learning_rate=0.3)
    got = np.zeros((12, 12))
    pairs = grid.node_pairs(spark, params.kshape)
    for r in pairs.select("node", "other", grid.influence(F.col("distance"), params, 2).alias("h")).collect():
        got[r["node"], r["other"]] = r["h"]
    assert np.allclose(got, grid.influence_matrix(grid.distance_matrix((3, 4), "rect"), params, 2))


def test_kernel_shift():
    # kernel(x, y) = x + y, centred on (3, 3) of a 10 x 10 map
    x, y = np.divmod(np.arange(100), 10)
    infl = np.abs(x - 3) + np.abs(y - 3)
    dist = grid.distance_matrix((10, 10), "rect")[33]
    assert infl.size == 100 and infl[44] == 2 and infl[55] == 4 and infl[33] == 0
    assert np.allclose(dist, np.hypot(x - 3, y - 3))


def test_flat_map_has_no_decay():
    radius, rate, _, _ = grid.schedule(SomParams(kshape=(1, 6), n_iter=10, learning_rate=0.2), 7)
    assert radius == 1.0 and rate == 0.2


def test_u_matrix(spark):
    cells = [1, 0, 0, 1, 1, 0, 1, 1, 0]
    codebook = spark.createDataFrame([(i, [float(c)]) for i, c in enumerate(cells)], "node int, vec array<double>")
    got = [r["u"] for r in som.u_matrix(codebook, (3, 3)).orderBy("node").collect()]
    assert np.allclose(got, [2 / 3, 0, 0, 4 / 5, 1 / 2, 0, 1, 3 / 5, 0])


def test_projection(spark):
    codebook = spark.createDataFrame([(0, [3.0, 4.0, 0.0]), (1, [0.0, 0.0, 2.0])], "node int, vec array<double>")
    got = {r["node"]: r["p"] for r in som.projection(codebook, [0, 1]).collect()}
    assert got[0] == pytest.approx(0.7) and got[1] is None


def long_rows(spark, values):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values) if v], "row int, feature int, v double")


@pytest.mark.parametrize("x, y, expected", [
    ([2 * i for i in range(10)], list(range(10)), list(range(10))),
    ([0, 2, 0, 6, 8, 0], [1, 0, 4, 7, 10, 0], [-1, 2, -4, -1, -2, 0]),
])
def test_sparse_difference(spark, x, y, expected):
    got = {r["feature"]: r["v"] for r in som.subtract(long_rows(spark, x), long_rows(spark, y)).collect()}
    assert got == {i: float(v) for i, v in enumerate(expected) if v}


def test_initial_map_without_epochs(spark):
    rows = vector_table(spark, np.arange(12).reshape(4, 3))
    model = som.fit(rows, SomParams(kshape=(10, 20), n_iter=0))
    assert model.codebook.weights.shape == (200, 3)
    assert (0 <= model.codebook.weights).all() and (model.codebook.weights < 1).all()


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000))
def test_codebook_row_is_its_own_best_unit(seed):
    weights = np.random.default_rng(seed).random((100, 30))
    node, score, _ = som.best_units(weights, weights, "cosine")
    assert (node == np.arange(100)).all() and np.allclose(score, 1)
    assert (som.best_units(weights, weights, "euclid")[0] == np.arange(100)).all()


def test_ties_and_zero_rows_go_to_the_lowest_node(spark):
    codebook = som.Codebook((1, 3), np.array([[0.0, 1.0], [1.0, 0.0], [2.0, 0.0]]))
    got = {r["doc_id"]: r for r in som.predict(vector_table(spark, [[1, 0], [0, 0]]), codebook).collect()}
    assert got[0]["node"] == 1 and got[0]["qe"] == pytest.approx(1 / 1.0001 - 1)
    assert got[1]["node"] == 0 and got[1]["qe"] == pytest.approx(9999.0)


def loop_epoch(rows, weights, influence):
    """Sum over samples of (x - K) * influence of its best unit, added once."""
    delta = np.zeros_like(weights)
    for x in rows:
        node = som.best_units(x[None], weights, "cosine")[0][0]
        delta += influence[node][:, None] * (x - weights)
    return weights + delta


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000))
def test_epoch_formula_equals_the_loop(seed):
    rng = np.random.default_rng(seed)
    rows, weights = rng.normal(size=(25, 4)), rng.random((6, 4))
    influence = grid.influence_matrix(grid.distance_matrix((2, 3), "rect"), SomParams(kshape=(2, 3), n_iter=5, learning_rate=0.01), 1)
    node = som.best_units(rows, weights, "cosine")[0]
    found, sums = som.mx.add_by_key(node, rows)
    counts, totals = np.bincount(node, minlength=6), np.zeros((6, 4))
    totals[found] = sums
    after = som.apply_epoch(som.Codebook((2, 3), weights), influence, counts, totals, "sum")
    assert np.allclose(after.weights, loop_epoch(rows, weights, influence))


def test_single_deltas(spark):
    # influence 1 everywhere: one sample moves every node by x - K
    weights = np.array([[0.0] * 3, [1.0] * 3, [2.0] * 3])
    for value in (0.0, 1.0, 2.0, 4.0):
        after = som.apply_epoch(
            som.Codebook((1, 3), weights), np.ones((3, 3)), np.array([1.0, 0, 0]),
            np.array([[value] * 3, [0.0] * 3, [0.0] * 3]), "sum",
        )
        assert np.allclose(after.weights - weights, value - weights)


def test_unreached_node_keeps_its_vector():
    weights = np.arange(6.0).reshape(3, 2)
    after = som.apply_epoch(som.Codebook((1, 3), weights), np.eye(3), np.array([2.0, 0, 0]), np.array([[2.0, 4], [0, 0], [0, 0]]), "mean")
    assert np.allclose(after.weights, [[1, 2], [2, 3], [4, 5]])


def test_fit_does_not_depend_on_partitions(spark):
    rows = random_rows(200, 6)
    params = SomParams(kshape=(3, 4), n_iter=6, seed=3)
    one = som.fit(vector_table(spark, rows, 1), params)
    many = som.fit(vector_table(spark, rows, 8), params)
    assert np.allclose(one.codebook.weights, many.codebook.weights)
    assert np.allclose(np.array(one.trace), np.array(many.trace))
    low, high = rows.min(axis=0), rows.max(axis=0)
    assert (one.codebook.weights >= low - 1e-9).all() and (one.codebook.weights <= high + 1e-9).all()
    errors = [t[3] for t in one.trace]
    assert errors[-1] < max(errors)


def test_hot_node_takes_every_row_of_a_cluster(spark):
    rows = np.concatenate([np.tile([1.0, 0.0, 0.0], (3000, 1)), random_rows(50, 3)])
    codebook = som.random_codebook((2, 2), 3, 1)
    sums = {r["node"]: r for r in som.epoch_sums(vector_table(spark, rows, 6), codebook).collect()}
    node = som.best_units(rows, codebook.weights, "cosine")[0]
    assert {n: r["n"] for n, r in sums.items()} == {n: int((node == n).sum()) for n in set(node.tolist())}
    for n, r in sums.items():
        assert np.allclose(r["vec"], rows[node == n].sum(axis=0))


def test_warm_start_needs_a_fitting_map(spark):
    rows = vector_table(spark, random_rows(10, 3))
    params = SomParams(kshape=(2, 2), n_iter=1)
    with pytest.raises(ValueError):
        som.fit(rows, params, k_init=som.random_codebook((2, 3), 3))
    with pytest.raises(ValueError):
        som.fit(rows, params, k_init=spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "node int, vec array<double>"))
    start = som.random_codebook((2, 2), 3, 9)
    by_map, by_table = som.fit(rows, params, k_init=start), som.fit(rows, params, k_init=start.to_df(spark))
    by_function = som.fit(rows, params, k_init=lambda df: start.to_df(df.sparkSession))
    assert np.allclose(by_map.codebook.weights, by_table.codebook.weights)
    assert np.allclose(by_map.codebook.weights, by_function.codebook.weights)


def test_ragged_rows_are_refused(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "doc_id long, vec array<double>")
    with pytest.raises(Exception, match="entries"):
        som.fit(rows, SomParams(kshape=(1, 2), n_iter=1))


def test_tolerance_stops_early_and_clip_zeroes(spark):
    rows = vector_table(spark, np.abs(random_rows(60, 4)))
    model = som.fit(rows, SomParams(kshape=(2, 3), n_iter=50, tolerance=0.5, clip_below=0.9))
    assert len(model.trace) < 50
    assert ((model.codebook.weights == 0) | (model.codebook.weights >= 0.9)).all()


def test_topographic_error(spark):
    codebook = som.Codebook((2, 2), np.array([[0.0, 0], [0, 1], [1, 0], [1, 1]]))
    rows = vector_table(spark, [[0.0, 0.1], [0.1, 0.0]])
    assert som.topographic_error(rows, codebook).first()[0] == pytest.approx(1.0)


def test_hits_cover_the_map(spark):
    assigned = spark.createDataFrame([(0, 1), (1, 1), (2, 3)], "doc_id long, node int")
    got = {r["node"]: r["hits"] for r in som.hits(assigned, (2, 2)).collect()}
    assert got == {0: 0, 1: 2, 2: 0, 3: 1}


def sparse_table(spark, dense):
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]]) for i, r in enumerate(dense)]
    return spark.createDataFrame(rows, "doc_id long, indices array<int>, values array<double>").repartition(3)


def test_table_codebook_trains_like_the_dense_one(spark):
    dense = np.where(np.random.default_rng(2).random((60, 20)) < 0.2, 1.0, 0.0) * np.random.default_rng(3).random((60, 20))
    dense[7] = 0
    params = SomParams(kshape=(2, 3), n_iter=2, seed=4, learning_rate=0.1)
    rows = sparse_table(spark, dense)
    model = som.fit(rows, params, width=20)
    wide, trace = sparse_som.fit(rows, 20, params)
    table = np.zeros((6, 20))
    for r in sparse_som.entries(wide).collect():
        table[r["node"], r["feature"]] = r["w"]
    assert np.allclose(table, model.codebook.weights)
    assert np.allclose(trace, [t[3] for t in model.trace])
    dense_nodes = {r["doc_id"]: r["node"] for r in som.predict(rows, model.codebook).collect()}
    wide_nodes = {r["doc_id"]: r["node"] for r in sparse_som.predict(rows, wide).collect()}
    assert dense_nodes == wide_nodes


@pytest.mark.parametrize("sparse", [False, True])
def test_large_codebook_is_used_in_blocks_of_nodes(spark, monkeypatch, sparse):
    dense = np.round(np.abs(random_rows(80, 5, 3)), 1)
    dense[9:12], dense[20] = dense[3], 0.0
    rows = sparse_table(spark, dense) if sparse else vector_table(spark, dense)
    params = SomParams(kshape=(3, 4), n_iter=3, seed=2)
    # equal nodes in different blocks: the lowest wins
    start = som.random_codebook((3, 4), 5, 2).weights
    start[7], start[11] = start[1], start[1]
    codebook = som.Codebook((3, 4), start)

    def results():
        model = som.fit(rows, params, width=5, k_init=codebook)
        tables = [som.predict(rows, codebook), som.predict(rows, codebook, metric="euclid"), som.two_nearest(rows, codebook), som.node_distances(rows, codebook)]
        return model, [[tuple(r) for r in t.orderBy("doc_id").collect()] for t in tables]

    whole, expected = results()
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", 8)
    monkeypatch.setattr(mx, "LEAST_ROWS", 5)
    monkeypatch.setattr(mx, "BLOCK_ENTRIES", 60)
    blocks, found = results()
    assert np.allclose(blocks.codebook.weights, whole.codebook.weights) and np.allclose(blocks.trace, whole.trace)
    for a, b in zip(found, expected, strict=True):
        assert [r[:3] if len(r) > 4 else r[:2] if isinstance(r[1], int) else r[:1] for r in a] == [
            r[:3] if len(r) > 4 else r[:2] if isinstance(r[1], int) else r[:1] for r in b]
        assert np.allclose([np.hstack(r) for r in a], [np.hstack(r) for r in b])


@pytest.mark.parametrize("start", ["random", "first"])
def test_wide_map_keeps_start_tolerance_clipping_and_trace(spark, monkeypatch, start):
    rng = np.random.default_rng(12)
    dense = np.where(rng.random((50, 23)) < 0.3, rng.random((50, 23)), 0.0)
    params = SomParams(kshape=(2, 3), n_iter=30, seed=4, tolerance=0.05, clip_below=0.02, init=start)
    rows = sparse_table(spark, dense)
    k_init = som.Codebook((2, 3), dense[:6]) if start == "first" else None
    model = som.fit(rows, params, width=23, k_init=k_init)
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", 8)
    monkeypatch.setattr(mx, "LEAST_ROWS", 6)
    monkeypatch.setattr(sparse_som, "NODES_AT_ONCE", 4)
    wide = sparse_som.train(rows, 23, params)
    table = np.zeros((6, 23))
    for r in sparse_som.entries(wide.codebook).collect():
        table[r["node"], r["feature"]] = r["w"]
    assert 1 < len(wide.trace) < 30 and np.allclose(wide.trace, model.trace)
    assert np.allclose(table, model.codebook.weights)


def test_products_leave_cells_in_their_rows(spark, monkeypatch):
    """No exchange of cells: what moves is one product per row and block, or one sum per task and feature."""
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", 8)
    monkeypatch.setattr(mx, "LEAST_ROWS", 4)
    dense = np.where(np.random.default_rng(5).random((30, 12)) < 0.3, 2.0, 0.0)
    by, rows = np.random.default_rng(6).normal(size=(12, 5)), sparse_table(spark, dense)
    product = mx.multiply(rows, by)
    plan = product._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    table = mx.multiply_by_blocks(rows, mx.matrix_table(spark, by), 12, 5)
    for found in (product, table):
        got = np.zeros((30, 5))
        for r in found.collect():
            got[r["doc_id"]] = r["vec"]
        assert np.allclose(got, dense @ by)


@pytest.mark.parametrize("limit", [BROADCAST_LIMIT_BYTES, 8])
def test_products_by_broadcast_and_by_join(spark, monkeypatch, limit):
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", limit)
    dense = np.where(np.random.default_rng(5).random((30, 12)) < 0.3, 2.0, 0.0)
    dense[4] = 0
    by = np.random.default_rng(6).normal(size=(12, 5))
    rows = sparse_table(spark, dense)
    got = np.zeros((30, 5))
    for r in mx.multiply(rows, by).collect():
        got[r["doc_id"]] = r["vec"]
    assert np.allclose(got, dense @ by)
    right = np.random.default_rng(7).normal(size=(30, 5))
    product = mx.transpose_product(rows, 12, vector_table(spark, right), 5)
    assert np.allclose(mx.collect_matrix(product, (12, 5)), dense.T @ right)


def test_long_rows_are_summed_in_pieces(spark, monkeypatch):
    rows = random_rows(50, 23)
    params = SomParams(kshape=(2, 3), n_iter=2, seed=1)
    whole = som.fit(vector_table(spark, rows, 4), params)
    monkeypatch.setattr(mx, "PIECE_ENTRIES", 4)
    pieces = som.fit(vector_table(spark, rows, 4), params)
    assert np.allclose(whole.codebook.weights, pieces.codebook.weights)


def test_hex_distance_of_far_points(spark):
    far = [(90_000, 80_000, 90_000), (-90_000, 80_000, 170_000), (-70_000, -90_000, 90_000), (0, -90_000, 90_000), (None, 3, None)]
    rows = spark.createDataFrame(far, "dx int, dy int, d int")
    found = rows.select("d", grid.hex_distance(F.col("dx"), F.col("dy")).alias("found")).collect()
    assert all(r["d"] == r["found"] for r in found)


def test_wide_epoch_reads_the_rows_once(spark, monkeypatch):
    """Rows with ids of their own are placed and added where they lie; rows that share an id still meet in the join."""
    rng = np.random.default_rng(21)
    dense = np.where(rng.random((40, 17)) < 0.3, rng.random((40, 17)), 0.0)
    dense[5] = 0
    rows, params = sparse_table(spark, dense), SomParams(kshape=(2, 3), n_iter=2, seed=4)
    model = som.fit(rows, params, width=17)
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", 8)
    monkeypatch.setattr(mx, "LEAST_ROWS", 9)
    monkeypatch.setattr(mx, "BLOCK_ENTRIES", 60)
    passes, kept = [], sparse_som.stage
    monkeypatch.setattr(sparse_som, "stage", lambda df, name: passes.append(name) or kept(df, name))
    wide = sparse_som.train(rows, 17, params)
    assert set(passes) == {"codebook", "node-sums"} and np.allclose(wide.trace, model.trace)
    table = np.zeros((6, 17))
    for r in sparse_som.entries(wide.codebook).collect():
        table[r["node"], r["feature"]] = r["w"]
    assert np.allclose(table, model.codebook.weights)
    passes.clear()
    sparse_som.train(rows.unionByName(rows.where("doc_id = 3")), 17, params)
    assert "placed" in passes


def test_wide_epoch_moves_no_row_for_many_blocks(spark, monkeypatch):
    """A codebook of more blocks than a task keeps is read block by block; no copy of the rows is stored for an epoch."""
    rng = np.random.default_rng(22)
    dense = np.where(rng.random((60, 17)) < 0.3, rng.random((60, 17)), 0.0)
    dense[5] = 0
    rows, params = sparse_table(spark, dense), SomParams(kshape=(2, 3), n_iter=3, seed=4)
    model = som.fit(rows, params, width=17)
    start = som.random_codebook((2, 3), 17, 4).weights
    for name, value in (("LEAST_ROWS", 3), ("BLOCK_ENTRIES", 60)):
        monkeypatch.setattr(mx, name, value)
    monkeypatch.setattr("textmap.session.BROADCAST_LIMIT_BYTES", 8)
    monkeypatch.setattr(sparse_som, "HELD_ENTRIES", 100)
    assert len(mx.row_blocks(17, 6)) == 6
    made, kept = [], sparse_som.stage
    monkeypatch.setattr(sparse_som, "stage", lambda df, name: made.append(kept(df, name)) or made[-1])
    own = sparse_som.WideCodebook((2, 3), 17, *[kept(mx.matrix_table(spark, start.T), "given")] * 2)
    for k_init in (None, own):
        made.clear()
        wide = sparse_som.train(rows, 17, params, k_init)
        assert np.allclose(wide.trace, model.trace)
        table = np.zeros((6, 17))
        for r in sparse_som.entries(wide.codebook).collect():
            table[r["node"], r["feature"]] = r["w"]
        assert np.allclose(table, model.codebook.weights)
        names = [os.path.basename(t._staged).split("-")[0] for t in made]
        assert set(names) == {"codebook", "node"}
        # the sums and codebooks of the epochs before are gone, what the caller gave is not
        assert [os.path.exists(t._staged) for t in made] == [False] * (len(made) - 1) + [True]
    assert own.weights.count() == 17
