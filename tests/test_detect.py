"""Boxes of score maps and upright crops, against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators.detect import boxes, hot_runs, labelled_runs, on_page
from foliospark.operators.graph import components
from foliospark.operators.pixels import as_pixels
from foliospark.operators.warp import perspective_crops, warp


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 103), (102, 103), (101, 102)] + [(200, 200 + k) for k in range(1, 9)] + [(5, 3), (3, 5), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in (101, 102, 103)}, **{200 + k: 200 for k in range(1, 9)}}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def maps(spark):
    a, b = np.zeros((12, 12)), np.zeros((12, 12))
    a[1:5, 1:7], a[7:11, 2:9] = 0.9, 0.4
    b[2, 2] = b[3, 3] = b[4, 2] = 0.8  # touch at corners
    b[8, 8:11] = 0.8
    return as_pixels(spark.createDataFrame([(1, a.ravel().tolist()), (2, b.ravel().tolist())], "i int, v array<double>"), "i", "v", 12)


def test_components_touch_at_corners(spark):
    runs = labelled_runs(hot_runs(maps(spark), 0.3))
    sizes = runs.groupBy("image", "root").agg(F.sum(F.col("x2") - F.col("x1") + 1).alias("n")).collect()
    assert sorted((r["image"], r["n"]) for r in sizes) == [(1, 24), (1, 28), (2, 3), (2, 3)]


def test_boxes(spark):
    found = boxes(maps(spark), 12, 12)
    rows = found.collect()
    assert [(r["image"], r["region"]) for r in rows] == [(1, 0)]  # the other blobs are too faint or too thin
    d = 5 * 3 / 16 * 1.5
    want = [(1 - d, 1 - d), (6 + d, 1 - d), (6 + d, 4 + d), (1 - d, 4 + d)]
    assert [tuple(p) for p in rows[0]["quad"]] == [pytest.approx(w) for w in want]
    assert rows[0]["score"] == pytest.approx(0.9)
    page = on_page(found, 10.0, 5.0, 70, 20).first()["quad"]
    assert [tuple(p) for p in page] == [(0, 0), (70, 0), (70, 20), (0, 20)]
    assert boxes(maps(spark), 12, 12, box_threshold=0.3, max_candidates=1).count() == 1
    assert boxes(maps(spark), 12, 12, box_threshold=0.3).count() == 2


def test_warp_of_an_upright_quad_is_a_crop():
    image = np.arange(60.0).reshape(6, 10)
    quad = np.array([(2, 1), (7, 1), (7, 4), (2, 4)], float)
    assert np.allclose(warp(image, quad), image[1:4, 2:7])
    assert np.allclose(warp(image, np.array([(2, 0), (4, 0), (4, 5), (2, 5)], float)), np.rot90(image[:5, 2:4]))  # a column of text is turned
    turned = np.array([(7, 1), (7, 5), (2, 5), (2, 1)], float)
    assert warp(image, turned).shape == (4, 5) or warp(image, turned).shape == (5, 4)
    assert warp(image, np.zeros((4, 2))) is None
    assert warp(image, quad + 100).max() == 0


def test_perspective_crops(spark):
    images = spark.createDataFrame([(1, 4, 6, [float(k) for k in range(24)])], "image int, height int, width int, values array<double>")
    s = math.sqrt(0.5)
    quads = [(1, 0, [(1.0, 1.0), (4.0, 1.0), (4.0, 3.0), (1.0, 3.0)]), (1, 1, [(0.0, 0.0)] * 4), (1, 2, [(2.0, 0.0), (2 + 2 * s, 2 * s), (2.0, 4 * s), (2 - 2 * s, 2 * s)])]
    rows = perspective_crops(images, spark.createDataFrame(quads, "image int, region int, quad array<struct<x:double,y:double>>")).collect()
    got = {r["region"]: r for r in rows}
    assert (got[0]["height"], got[0]["width"], got[0]["values"]) == (2, 3, [pytest.approx(v) for v in (7, 8, 9, 13, 14, 15)])
    assert got[1]["error"] == "no area" and (got[2]["height"], got[2]["width"]) == (2, 2)
