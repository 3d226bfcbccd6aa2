"""What operators hold and move: batches of bounded bytes, caches of workers, shuffles of a round."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmap.llm import brown, lookup, neargraph, tokenbin, workers
from textmap.session import short_batches, stage


def test_texts_reach_python_in_bounded_batches(spark, monkeypatch):
    """the texts of a batch were bounded by their number alone."""
    texts = spark.range(0, 3_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word"), "id", F.lit(" ")), 500).alias("text"))
    docs = stage(texts, "long-texts")
    cut = lookup.words_in

    def watched(batch):
        if batch.nbytes > 5 << 20:
            raise MemoryError("too many texts at once")
        return cut(batch)

    monkeypatch.setattr(brown, "words_in", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    rows = brown.score_texts(docs, F.col("doc_id") % 5 != 1).select("doc_id", "n_tokens").collect()
    assert sorted(r.doc_id for r in rows) == list(range(3_000)) and {r.n_tokens for r in rows} == {501}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_short_batches_hold_all_rows(spark):
    rows = spark.range(0, 20_000, 1, 1).select(F.repeat(F.col("id").cast("string"), 100).alias("text"))

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], ["n", "size"])

    with short_batches(spark, 1 << 20):
        found = rows.mapInArrow(size, "n long, size long").collect()
    assert sum(r.n for r in found) == 20_000 and max(r.size for r in found) < 1 << 21


def test_tidy_tasks_leave_no_caches():
    """what earlier stages remembered, and freed, stayed with a worker."""
    workers.worker_cache("tested")["kept"] = 1
    seen = []

    def run(batches):
        seen.append(dict(workers.worker_cache("tested")))
        yield from batches

    assert list(workers.tidy(run)(iter([1, 2]))) == [1, 2] and seen == [{}]


def test_a_round_moves_each_table_once(spark, monkeypatch):
    """a round dealt its edges and members out twice, and read both lists again to compare them."""
    points = np.random.default_rng(5).standard_normal((50, 8))
    codes = spark.createDataFrame(list(enumerate(neargraph._coded(points))), "node long, code binary")
    lists = spark.createDataFrame([(i, (i + k) % 50, 0.1 * k) for i in range(50) for k in range(1, 4)], "node long, other long, near float")
    codes, lists = stage(codes, "codes"), stage(lists, "lists")
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(neargraph, "stage", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = neargraph._lists(lists.unionByName(neargraph._descend(lists, codes, None, None, 4)), None, "t")
        assert plans[-1].count("Exchange ") <= 6
        found, changed = neargraph._next_lists(lists, neargraph._descend(lists, codes, None, None, 4), "t")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(found.collect()) == sorted(after.collect())
    assert changed == found.join(lists, ["node", "other"], "left_anti").count() > 0


@pytest.mark.parametrize("percentile", [0.5, 0.9, 1.0])
def test_widths_are_exact(percentile):
    rng = np.random.default_rng(2)
    edges = np.array([0, 1, 2, 3, 2**31 - 1, 2**31, 2**32 - 1, *(2**k for k in range(32)), *(2**k - 1 for k in range(33))], np.uint32)
    ids = np.concatenate([rng.choice(edges, 256 * 6), rng.integers(0, 50_000, 256 * 6)]).astype(np.uint32)
    data, lengths = tokenbin.pack(ids, percentile)
    starts = np.cumsum(lengths) - lengths
    assert (tokenbin.unpack(data, starts) == ids).all()
    for block, start in zip(ids.reshape(-1, 256), starts, strict=True):
        bits = sorted(int(x).bit_length() for x in block - block.min())
        assert data[start + 4] == bits[int(np.ceil(percentile * 256)) - 1]
