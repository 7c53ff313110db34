"""Boxes worked out inside a map's row: components against a flood fill, boxes of pixels with gaps, and what is shuffled."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators.borders import hull_of
from foliospark.operators.detect import box_rows, boxes, grown, hot_runs, labelled_runs, with_components
from foliospark.operators.pixels import as_maps, as_pixels, quad_mean, quad_scores
from foliospark.plans import registry

SF = "/root/testdata/sf0.001"


def flooded(hot: np.ndarray) -> list[set]:
    """Components of touching pixels (y, x) in the order of their first ones."""
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(hot), strict=True)}, []
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        found = set()
        while todo:
            y, x = todo.pop()
            found.add((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(found)
    return out


def test_components_in_a_row_are_those_of_a_flood_fill(spark):
    rng = np.random.default_rng(5)
    maps = [rng.random((9, 7)) * (rng.random((9, 7)) < share) for share in np.linspace(0, 1, 30)]
    spiral = np.zeros((9, 7))
    spiral[0], spiral[:, 6], spiral[8], spiral[2:, 0], spiral[2, :5], spiral[2:7, 4], spiral[6, 2:5] = (0.9,) * 7
    maps += [spiral, np.ones((9, 7)), np.zeros((9, 7))]
    maps[3][2, 3], maps[4][8, 6] = float("nan"), float("nan")  # which Spark holds to be above all
    rows = [(k, m.ravel().tolist()) for k, m in enumerate(maps)] + [(100, None), (101, []), (102, [None, 0.9, None, 0.9]), (103, [0.9] * 8)]
    df = spark.createDataFrame(rows, "image int, values array<double>").coalesce(2)
    got = {r["image"]: r["components"] for r in with_components(df, 0.3, 7).collect()}
    assert sorted(got) == sorted(k for k, _ in rows)
    for k, m in enumerate(maps):
        want = flooded(~(m <= 0.3))
        assert [{(r["y"], x) for r in c["runs"] for x in range(r["x1"], r["x2"] + 1)} for c in got[k]] == want
        assert [[tuple(p) for p in c["hull"]] for c in got[k]] == [hull_of([(x, y) for y, x in c]) for c in want]
    assert got[100] == got[101] == [] and len(got[102]) == 2 and [len(c["runs"]) for c in got[103]] == [2]
    labelled = labelled_runs(hot_runs(as_pixels(df.filter("image < 100"), "image", "values", 7), 0.3)).groupBy("image", "root").agg(F.sum(F.col("x2") - F.col("x1") + 1).alias("n")).collect()
    assert sorted((r["image"], r["n"]) for r in labelled) == sorted((k, len(c)) for k, m in enumerate(maps) for c in flooded(~(m <= 0.3)))


def test_pixels_with_gaps(spark):
    m = np.zeros((12, 12))
    m[1:5, 1:7], m[7:11, 2:9] = 0.9, 0.8
    df = spark.createDataFrame([(1, m.ravel().tolist())], "image int, values array<double>")
    some = as_pixels(df, "image", "values", 12).filter("p > 0 or y = 0")
    whole = as_maps(some, 12).first()["values"]
    assert whole == [float(v) if v > 0 or k < 12 else None for k, v in enumerate(m.ravel())][: len(whole)] and len(whole) == 10 * 12 + 9
    plain = lambda df: sorted((r["image"], r["region"], round(r["score"], 9), [tuple(p) for p in r["quad"]]) for r in df.collect())
    assert plain(boxes(some, 12, 12)) == plain(box_rows(df, 12, 12)) and len(plain(box_rows(df, 12, 12))) == 2


def test_growth_of_a_turned_rectangle(spark):
    quad = [(0.0, 0.0), (3.0, 4.0), (-1.0, 7.0), (-4.0, 3.0)]
    row = spark.createDataFrame([(quad,)], "quad array<struct<x:double,y:double>>").select(grown(F.col("quad"), F.lit(5.0)).alias("g")).first()
    assert [tuple(p) for p in row["g"]] == [pytest.approx(p) for p in [(1.0, -7.0), (10.0, 5.0), (-2.0, 14.0), (-11.0, 2.0)]]


def test_means_in_a_row_are_those_of_joined_pixels(spark):
    rng = np.random.default_rng(6)
    rows = [(k, 0, rng.random(63).tolist(), [tuple(map(float, p)) for p in rng.uniform(-4, 12, (4, 2))]) for k in range(40)]
    rows += [(50, 0, [0.5] * 10, [(0.0, 0.0), (6.0, 0.0), (6.0, 8.0), (0.0, 8.0)]), (51, 0, None, [(0.0, 0.0)] * 4)]  # a short map, and none
    df = spark.createDataFrame(rows, "image int, quad int, values array<double>, ring array<struct<x:double,y:double>>")
    flat = [F.get("ring", F.lit(k))[axis].alias(f"{axis}{k}") for k in range(4) for axis in ("x", "y")]
    want = {r["image"]: (r["n"], r["score"]) for r in quad_scores(as_pixels(df, "image", "values", 7), df.select("image", "quad", *flat), 7, 9).collect()}
    got = {r["image"]: (r["n"], r["score"]) for r in df.select("image", quad_mean(F.col("values"), F.col("ring"), 7, 9).alias("m")).select("image", "m.*").collect()}
    assert set(got) == set(want) and sum(n > 0 for n, _ in want.values()) > 20
    assert all((n or 0, s) == (want[k][0], pytest.approx(want[k][1])) for k, (n, s) in got.items())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["detect_boxes", "score_components", "quad_score"])
def test_only_whole_maps_are_shuffled(spark, name):
    found = registry.queries()[name](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("Aggregate") == plan.count("Window") == 0 and plan.count("RepartitionByExpression") == 1
    assert "embeddings.parquet" in "".join(found.inputFiles())  # the table itself, no table written between the steps
