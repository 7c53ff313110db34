import json

from pyspark.sql import functions as F

from foliospark.operators.evaluate import similarity
from foliospark.operators.sinks import json_report, text_report
from foliospark.plans import regions, registry

SF = "/root/testdata/sf0.001"


def test_sinks_write_every_region(spark):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for name in ("results_json", "results_json_all"):
        assert sum(len(json.loads(r["json"])) for r in registry.queries()[name](spark, SF).collect()) == n
    assert sum(r["report"].count("--- Region ") for r in registry.queries()["report_lines"](spark, SF).collect()) == n
    assert sum(len(r["report"].split("\n")) for r in registry.queries()["report_lines_all"](spark, SF).collect()) == n


def test_text_report(spark):
    ring = [(0.0, 1.0), (2.5, 1.0), (2.5, 3.0), (0.0, 1.0)]
    rows = [(1, 2, "b", 0.5, ring[:3]), (1, 10, None, 0.98765, ring), (1, 1, "a", 1.0, ring), (2, 1, None, None, None)]
    df = spark.createDataFrame(rows, "page long, k int, words string, sure double, ring array<struct<x: double, y: double>>")
    got = {r["page"]: r["report"] for r in text_report(df, "page", ["k"], "words", "sure", "ring").collect()}
    shown = "(0.0, 1.0) -> (2.5, 1.0) -> (2.5, 3.0)"
    told = [f"--- Region {i} ---\nText: {t}\nConfidence: {c}\nPolygon: {shown}" for i, t, c in ((1, "a", "1.000"), (2, "b", "0.500"), (3, "", "0.988"))]
    assert got == {1: "\n".join(["Detected 3 text regions:", *told]), 2: "No text regions detected."}
    assert text_report(df.limit(0), "page", ["k"], "words", "sure", "ring").count() == 0


def test_json_report(spark):
    ring = [(2.0, 5.0), (0.0, 5.0), (0.0, 1.0), (2.0, 1.0), (2.0, 5.0)]
    rows = [(1, 2, "b", 0.5, ring[:4]), (1, 10, None, 0.25, ring), (1, 1, "a", 1.0, ring), (2, 1, None, None, None)]
    df = spark.createDataFrame(rows, "page long, k int, words string, sure double, ring array<struct<x: double, y: double>>")
    got = {r["page"]: json.loads(r["json"]) for r in json_report(df, "page", ["k"], "words", "sure", "ring").collect()}
    shape = {"box": [[0.0, 1.0], [2.0, 1.0], [2.0, 5.0], [0.0, 5.0]], "polygon": [list(p) for p in ring[:4]]}
    assert got == {1: [{"text": "a", "confidence": 1.0, **shape}, {"text": "b", "confidence": 0.5, **shape}, {"text": "", "confidence": 0.25, **shape}], 2: []}
    assert json_report(df.limit(0), "page", ["k"], "words", "sure", "ring").count() == 0


def test_similarity_of_texts_beyond_ascii(spark):
    pairs = [("", ""), ("é", "e"), ("日本語", "日本"), ("\U0001f600a", "a"), ("straße", "strasse"), ("same", "same")]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert {(r["a"], r["b"]): round(r["s"], 9) for r in got} == {(a, b): round(1 - edits(a, b) / max(len(a), len(b)), 9) if a or b else 1.0 for a, b in pairs}


def test_reports_shuffle_the_columns_that_rings_are_made_of(spark):
    from foliospark.functions import geometry as g

    rows = [(1, 2, 5.0, "b", 0.5), (1, 1, 7.0, None, 0.25), (2, 1, None, "c", 0.75)]
    df = spark.createDataFrame(rows, "page int, n int, side double, text string, sure double")
    zero = F.lit(0.0)
    ring = lambda r: F.when(r["side"].isNotNull(), g.ring((zero, zero), (r["side"], zero), (r["side"], zero + 1), (zero, zero + 1)))
    order = ["n", "side", "text", "sure"]
    given = df.withColumn("ring", ring({c: F.col(c) for c in order}))
    for report in (text_report, json_report):
        made = report(df, "page", order, "text", "sure", ring)
        assert sorted(made.collect()) == sorted(report(given, "page", order, "text", "sure", "ring").collect())
    for q in (regions.results_json_all, regions.report_lines):
        rows = q(spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        gathers = next(k for k, x in enumerate(rows) if "collect_list" in x)
        assert all("array(" not in x for x in rows[gathers + 1 :])  # what goes into the grouping has no ring in it yet
