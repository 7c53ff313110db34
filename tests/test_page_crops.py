"""Crops made inside a page's row: every quad of it, in parts, and without a join."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import warp as made
from foliospark.operators.warp import page_crops, perspective_crops, warp
from foliospark.plans import registry

SF = "/root/testdata/sf0.001"
QUADS = "array<struct<region:int,quad:array<struct<x:double,y:double>>>>"


def test_a_page_gives_all_its_crops(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(12):
        h, w = int(rng.integers(2, 9)), int(rng.integers(2, 9))
        image, quads = rng.random((h, w)), [rng.uniform(-2, 10, (4, 2)) for _ in range(k % 5)]
        if k % 4 == 3:
            quads.insert(1, np.zeros((4, 2)))
        rows.append((k, h, w, image.ravel().tolist(), [(9 - n, [tuple(map(float, p)) for p in q]) for n, q in enumerate(quads)]))
        want |= {(k, 9 - n): warp(image, q) for n, q in enumerate(quads)}
    rows += [(20, 2, 2, [1.0] * 4, None), (21, 2, 2, None, [])]
    pages = spark.createDataFrame(rows, f"image int, height int, width int, values array<double>, quads {QUADS}").coalesce(1)
    apart = pages.select("image", F.explode("quads").alias("q")).select("image", "q.*").repartition(3)
    for found in (page_crops(pages), perspective_crops(pages.drop("quads"), apart)):
        got = {(r["image"], r["region"]): r for r in found.collect()}
        assert set(got) == set(want) and sum(v is None for v in want.values()) == 3
        for key, crop in want.items():
            r = got[key]
            if crop is None:
                assert (r["height"], r["width"], r["values"], r["error"]) == (None, None, None, "no area")
            else:
                assert (r["height"], r["width"], r["error"]) == (*crop.shape, None) and r["values"] == crop.ravel().tolist()


def test_many_pixels_are_given_on_in_parts(spark):
    """A page's crops of 3 million pixels leave their task in several batches, and each keeps its own quad."""
    edge = 1200.0
    quads = [(n, [(0.0, 0.0), (edge - n, 0.0), (edge - n, edge / 2), (0.0, edge / 2)]) for n in range(5)]
    pages = spark.createDataFrame([(1, 2, 2, [1.0, 2.0, 3.0, 4.0], quads)], f"image int, height int, width int, values array<double>, quads {QUADS}")
    got = page_crops(pages).select("region", "height", "width", F.size("values").alias("n"), F.get("values", F.lit(1)).alias("second")).collect()
    assert sorted((r["region"], r["height"], r["width"], r["n"], r["second"]) for r in got) == [(n, 600, 1200 - n, 600 * (1200 - n), 2.0) for n in range(5)]


@pytest.mark.parametrize("shape", [(40, 50), (40, 50, 3)])
def test_crops_made_in_steps_are_the_same(monkeypatch, shape):
    rng = np.random.default_rng(9)
    image, quads = rng.random(shape), [rng.uniform(-5, 45, (4, 2)) for _ in range(20)]
    whole = [warp(image, q) for q in quads]
    monkeypatch.setattr(made, "PIXELS_AT_ONCE", 64)
    assert all(np.array_equal(warp(image, q), w) for q, w in zip(quads, whole, strict=True))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_crops_are_made_without_a_join(spark):
    found = registry.queries()["warp_crops"](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("Aggregate") == plan.count("Window") == 0 and plan.count("RepartitionByExpression") == 1
    boxes = {(r["image"], r["region"]) for r in registry.queries()["detect_boxes"](spark, SF).collect()}
    assert {(r["image"], r["region"]) for r in found.collect()} == boxes and len(boxes) > 100
