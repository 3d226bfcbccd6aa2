"""Versioned tables and the streams that keep them."""

import os

import pytest
from pyspark.sql import functions as F

from textmap.operators import som
from textmap.sources import versions
from textmap.streaming import streams as st


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))


def folders_of(spark, path, number):
    return {r["bucket"]: r["folder"] for r in versions._listed(spark, path, number)}


def test_update_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.range(200).selectExpr("id AS k", "id * 2 AS v")
    assert versions.overwrite(table, path, ["k"], 8) == 1
    before = folders_of(spark, path, 1)
    new = spark.createDataFrame([(5, -1), (900, -2)], "k long, v long")
    assert versions.update(new, path, ["k"]) == 2
    after = folders_of(spark, path, 2)
    touched = {r[0] for r in new.select(versions._bucket(["k"], 8)).collect()}
    assert {b for b in before if before[b] != after[b]} == touched and 0 < len(touched) < 8
    assert rows_of(versions.read(spark, path)) == sorted([(k, -1 if k == 5 else 2 * k) for k in range(200)] + [(900, -2)])
    assert rows_of(versions.read(spark, path, 1)) == [(k, 2 * k) for k in range(200)]
    # the same update once more changes nothing
    versions.update(new, path, ["k"])
    assert versions.read(spark, path).count() == 201


def test_only_two_versions_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.overwrite(spark.range(20).selectExpr("id AS k", "0 AS v"), path, ["k"], 2)
    for value in range(1, 5):
        versions.update(spark.createDataFrame([(3, value)], "k long, v int"), path, ["k"])
    assert versions.versions(spark, path) == [4, 5]
    named = {f for n in (4, 5) for f in folders_of(spark, path, n).values()}
    stored = {os.path.join(path, "data", d, b) for d in os.listdir(f"{path}/data") for b in os.listdir(f"{path}/data/{d}") if b.startswith("_bucket=")}
    assert stored == named
    assert dict(rows_of(versions.read(spark, path)))[3] == 4


def test_new_columns_nulls_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.overwrite(spark.createDataFrame([], "k string, v int"), path, ["k"], 4)
    assert versions.read(spark, path).count() == 0
    versions.update(spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"), path, ["k"])
    versions.update(spark.createDataFrame([("a", "x")], "k string, `a b` string"), path, ["k"])
    found = versions.read(spark, path)
    assert found.columns == ["k", "v", "a b"] and rows_of(found) == [(None, 2, None), ("a", 1, "x")]
    versions.update(spark.createDataFrame([], "k string, v int"), path, ["k"])
    assert versions.read(spark, path).count() == 2
    with pytest.raises(ValueError, match="no table"):
        versions.read(spark, str(tmp_path / "none"))


def test_an_interrupted_commit_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.overwrite(spark.range(5).selectExpr("id AS k"), path, ["k"])
    os.makedirs(f"{path}/versions/v=2/_temporary")
    assert versions.versions(spark, path) == [1] and versions.read(spark, path).count() == 5
    assert versions.update(spark.createDataFrame([(9,)], "k long"), path, ["k"]) == 2
    assert versions.read(spark, path).count() == 6


def test_running_hits_go_on_after_a_restart(spark, tmp_path):
    schema = "doc_id long, vec array<double>"
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    codebook = som.random_codebook((1, 3), 3)
    unit = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(i, unit[i % 2]) for i in range(10)]
    for wave in ([rows[:3], rows[3:4]], [rows[4:]]):
        for part in wave:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = st.read_files(spark, source, schema, files_per_trigger=1)
        st.store_running(st.running_hits(st.score_stream(stream, codebook)), ["node"], out, marks).awaitTermination()
    whole = som.predict(spark.createDataFrame(rows, schema), codebook).groupBy("node").agg(F.count("*").alias("hits"))
    assert rows_of(versions.read(spark, out)) == rows_of(whole)
    # nothing new: the table stays as it is
    number = versions.versions(spark, out)[-1]
    stream = st.read_files(spark, source, schema, files_per_trigger=1)
    st.store_running(st.running_hits(st.score_stream(stream, codebook)), ["node"], out, marks).awaitTermination()
    assert rows_of(versions.read(spark, out)) == rows_of(whole) and versions.versions(spark, out)[-1] == number
