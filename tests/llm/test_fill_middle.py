"""The counted pattern against lists of lines, round trips, and the query against DuckDB."""

import hashlib
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import fill_middle
from foliospark.llm.fill_middle import LINE, Markers, fill_in_middle, parts_of, restored


def by_hand(doc_id, text, percent=100, spm_percent=50):
    """(n, form, output) by lists of lines."""
    text = text or ""
    units = re.findall(LINE, text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm_percent else (n, "psm", f"<P>{p}<S>{s}<M>{m}")


def check(docs, rows, **settings_):
    got = fill_in_middle(docs, **settings_).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = [(i, *by_hand(i, t, **settings_), t or "") for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


EDGES = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "a\nb"), (7, "a<P>b\nc"), (8, "<\nS>\n<S\n>"), (9, "$1\n\\2\n"), (10, "é\U0001f600\n x\r\ny\n"),
    (11, "same\ntext\n"), (11, "same\ntext\n"), (11, "other\n"), (None, "no id\nat\nall\n"), (12, "<M>"), (13, "\x00\n\x00"),
]


def test_edges_ties_repeats_and_clashes(docs_of):
    check(docs_of(EDGES), EDGES)


def test_shares(docs_of):
    rows = [(k, f"{k}\nx\ny\nz\n") for k in range(300)]
    check(docs_of(rows), rows, percent=30, spm_percent=80)


def test_very_long_texts(docs_of):
    rows = [(1, "ab\n" * 300_000 + "x" * 500_000), (2, "x" * 3_000_000), (3, "\n" * 500_000)]
    check(docs_of(rows), rows)


def test_empty_table(docs_of):
    made = fill_in_middle(docs_of([]))
    assert made.columns == ["doc_id", "n", "form", "output"] and made.count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab\n\r<PSM>$ é\U0001f600"), max_size=30), min_size=1, max_size=20))
def test_random_texts(docs_of, texts):
    rows = list(enumerate(texts))
    check(docs_of(rows), rows)


def test_other_units_and_markers(spark):
    docs = spark.createDataFrame([(k, "one two  three four") for k in range(20)], "key long, body string")
    marks = Markers("<PRE>", "<SUF>", "<MID>")
    made = fill_in_middle(docs, "key", "body", unit=r"\S+\s*|\s+", markers=marks)
    prefix, middle, suffix = parts_of(F.col("output"), F.col("form"), marks)
    for r in made.select("n", prefix.alias("p"), middle.alias("m"), suffix.alias("s")).collect():
        assert r["n"] == 4 and r["p"] + r["m"] + r["s"] == "one two  three four"
    with pytest.raises(ValueError):
        Markers("<P>", "<P>", "<M>")
    with pytest.raises(ValueError):
        Markers("P", "<S>", "<M>")


def test_query_matches_sql(spark, tmp_path, docs_of):
    docs_of([*EDGES, *((k, "line\n" * (k % 50) + "end") for k in range(100, 300))]).filter("doc_id IS NOT NULL").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = con.sql(fill_middle.ORACLE_SQL["op13_fill_middle"])
    got = fill_middle.op13_fill_middle(spark, str(tmp_path))
    assert got.columns == told.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, told.fetchall()))
