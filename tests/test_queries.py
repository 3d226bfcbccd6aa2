import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
import check

SMALL = "/root/testdata/sf0.001"
# The cheap queries; tools/check.py compares all of them.
CHEAP = [
    "p2_drop_duplicates", "p7_rows_in", "t5_vocabulary", "t8_unit_rows", "m3_best_unit", "m9_epoch", "m14_u_matrix",
    "m22_distances", "c2_ward_regions", "k2_node_top_topics", "a2_cluster_sizes", "v2_node_matrix", "w2_frontier",
    "w6_articles", "p12_violations", "st1_store_articles",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, con, name):
    state, _, note = check.compare(spark, con, SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "ok", note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_the_map(spark):
    assert entry.entry(spark).count() == 30


def test_staging_uses_the_folder_the_session_names(spark):
    from textmap.session import staging_path

    named = spark.conf.get("spark.checkpoint.dir")
    one, two = staging_path(spark, "t"), staging_path(spark, "t")
    assert one.startswith(named.rstrip("/")) and one != two
