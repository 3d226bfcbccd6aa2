"""Maps trained side by side against maps trained one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmap.operators import many_maps, regions, som
from textmap.params import SomParams
from textmap.session import stage

PARAMS = SomParams(kshape=(2, 3), n_iter=4, learning_rate=0.1, init="first")
SCHEMA = "doc_id long, vec array<double>, source string, node int, unit int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    sources = ["hot"] * 60 + ["a"] * 9 + [None] * 12 + ["few"] * 2 + ["b b"] * 20
    data = [(i, [float(v) for v in rng.random(5)], s, 1, 2) for i, s in enumerate(sources)]
    return stage(spark.createDataFrame([*data, (900, None, "gone", 1, 2), (901, None, "a", 1, 2)], SCHEMA), "rows")


def by_map(df, *columns):
    found = {}
    for r in df.orderBy(*columns).collect():
        found.setdefault(r["source"], []).append(r)
    return found


@pytest.mark.parametrize("page_bytes", [1 << 20, 500])
def test_maps_equal_those_trained_alone(spark, rows, page_bytes):
    maps = many_maps.fit(rows, "source", PARAMS, page_bytes=page_bytes)
    found, traces = by_map(maps.codebooks, "node"), by_map(maps.trace, "it")
    placed = by_map(many_maps.predict(rows, maps, page_bytes=page_bytes), "doc_id")
    assert set(found) == set(traces) == set(placed) == {"hot", "a", None, "few", "b b"}
    for name in found:
        own = rows.where(F.col("source").eqNullSafe(F.lit(name)) & F.col("vec").isNotNull())
        start = [r["vec"] for r in own.orderBy("doc_id").limit(6).collect()]
        k_init = som.Codebook((2, 3), np.array([start[k % len(start)] for k in range(6)]))
        model = som.fit(own, PARAMS, k_init=k_init)
        assert np.allclose([r["vec"] for r in found[name]], model.codebook.weights, atol=1e-12)
        assert np.allclose([r["quantization_error"] for r in traces[name]], [t[3] for t in model.trace])
        alone = som.predict(own, model.codebook).orderBy("doc_id").collect()
        assert [(r["doc_id"], r["node"]) for r in placed[name]] == [(r["doc_id"], r["node"]) for r in alone]


def test_random_start_tolerance_and_clipping(spark, rows):
    params = SomParams(kshape=(2, 2), n_iter=30, tolerance=0.5, clip_below=0.45, seed=3)
    maps = many_maps.fit(rows, "source", params)
    steps = {r["source"]: r["n"] for r in maps.trace.groupBy("source").agg(F.count("*").alias("n")).collect()}
    own = rows.where("source = 'hot'")
    model = som.fit(own, params)
    assert steps["hot"] == len(model.trace) < 30
    assert np.allclose([r["vec"] for r in by_map(maps.codebooks, "node")["hot"]], model.codebook.weights)


def test_sparse_rows(spark):
    data = [(i, [i % 4, 4 + i % 2], [1.0, 0.5], "x" if i % 3 else "y") for i in range(30)]
    sparse = stage(spark.createDataFrame(data, "doc_id long, indices array<int>, values array<double>, source string"), "sparse")
    params = SomParams(kshape=(1, 3), n_iter=3, seed=2)
    maps = many_maps.fit(sparse, "source", params, width=6)
    for name, found in by_map(maps.codebooks, "node").items():
        model = som.fit(sparse.where(F.col("source") == name), params, width=6)
        assert np.allclose([r["vec"] for r in found], model.codebook.weights)
    assert many_maps.predict(sparse, maps).count() == 30


def test_regions_of_many_maps_run_in_many_tasks(spark, rows):
    maps = many_maps.fit(rows, "source", PARAMS)
    found = regions.ward_regions(maps.codebooks, PARAMS.kshape, 2, ["source"])
    assert found.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    for name, own in by_map(found, "node").items():
        alone = regions.ward_regions(maps.codebooks.where(F.col("source").eqNullSafe(F.lit(name))), PARAMS.kshape, 2)
        assert [r["cluster"] for r in own] == [r["cluster"] for r in alone.orderBy("node").collect()]


def test_no_rows(spark, rows):
    maps = many_maps.fit(rows.where("false"), "source", PARAMS)
    assert maps.codebooks.count() == 0 and maps.trace.count() == 0
    assert many_maps.predict(rows.where("false"), maps).count() == 0
