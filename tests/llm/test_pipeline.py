import random

import duckdb
import pytest

import corpus_pipeline
from foliospark.llm import registry
from foliospark.llm.shared import written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    told = duck.sql(registry.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(told.columns) == names
    order = [told.columns.index(c) for c in names]
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str([r[i] for i in order]) for r in told.fetchall())


def test_queries_are_named():
    assert [n.split("_")[0] for n in sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]


def test_stages(spark, docs_of, tmp_path):
    """Every stage takes effect on what the one before it kept, and keeps the columns; clean documents stay."""
    rng = random.Random(9)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(80))
    clean = [(k, prose(), f"s{k % 3}") for k in range(30)]
    rows = [*clean, (100, clean[0][1].replace(" ", "  "), "s0"), (101, "too short", "s1"), (102, None, None), (103, clean[5][1], "s9"), (104, clean[6][1].upper(), "s9")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = docs_of(rows), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, str(tmp_path)), name)
        assert after.columns == docs.columns or name == "packing"
        docs = after
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    ids = {r[0] for r in clean}
    assert kept[0] == ids | {100, 103, 104}
    assert kept[1] == (ids - {0}) | {100, 104}  # the longer copy stays
    assert kept[2] == (ids - {0}) | {100}  # equal but for capitals: one fingerprint
    assert kept[3] <= kept[2] and kept[4] == kept[3]


def test_stages_on_an_empty_table(spark, docs_of, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_repeated_ids_and_very_long_texts(spark, docs_of, tmp_path):
    rng = random.Random(10)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    one, long = prose(90), prose(60_000)
    rows = [(1, one), (1, one), (1, prose(90)), (2, long), (3, long), (None, prose(80)), (None, prose(80))]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in placed} <= {1, 2, None} and all(r["length"] <= 1024 for r in placed)
    ends = {}
    for r in placed:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
