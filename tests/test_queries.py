"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from foliospark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    told = duck.sql(registry.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(told.columns) == names
    order = [told.columns.index(c) for c in names]
    assert sorted([plain(r[c]) for c in names] for r in df.collect()) == sorted([plain(r[i]) for i in order] for r in told.fetchall())


def test_registered_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert "ctc_decode" in entry.queries()
    assert entry.entry(spark).columns == ["sample", "text", "token_ids", "confidence", "fallback_count"]


@pytest.mark.parametrize("name", ["ctc_decode", "rec_width_and_batch_plan", "iou_greedy_match"])
def test_partitions_do_not_change_results(spark, name):
    run = lambda: sorted(map(str, registry.queries()[name](spark, SF).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = run()
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert run() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
