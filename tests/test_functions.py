"""Sizes, geometry, decoding and matching against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry as g
from foliospark.functions.numbers import fraction
from foliospark.functions.scores import best_class, best_probability
from foliospark.functions.sizes import batch_width, detection_size, recognition_width, valid_steps
from foliospark.operators.decode import decode
from foliospark.operators.dictionary import build, clean_token, duplicates, reverse
from foliospark.operators.evaluate import greedy_matches, overlapping, similarity
from foliospark.operators.pixels import as_pixels, quad_scores, resize
from foliospark.operators.profile import middle_samples
from foliospark.operators.regions import region_error


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("w", "h", "limit", "kind", "cap", "want"),
    [
        (1920, 1080, 960, "max", 4000, (960, 544, 0.5)),
        (1920, 1080, 64, "min", 4000, (1920, 1088, 1.0)),
        (200, 32, 64, "min", 4000, (384, 64, 2.0)),
        (8000, 1000, 64, "min", 4000, (4000, 512, 0.5)),
        (123, 77, 960, "max", 4000, (128, 64, 1.0)),
        (5, 5, 0, "max", 0, (32, 32, 1.0)),
    ],
)
def test_detection_size(spark, w, h, limit, kind, cap, want):
    size = detection_size(F.lit(w), F.lit(h), limit, kind, cap)
    assert tuple(one(spark, size["resized_w"], size["resized_h"], size["ratio"])) == want


def test_recognition_widths(spark):
    sizes = [(1200, 48), (96, 48), (120, 60), (40, 80)]
    assert list(one(spark, *[recognition_width(F.lit(w), F.lit(h)).alias(f"c{k}") for k, (w, h) in enumerate(sizes)])) == [1200, 96, 96, 24]
    assert one(spark, batch_width(F.lit(1200)))[0] == 1216
    assert list(one(spark, *[valid_steps(F.lit(w), F.lit(m), F.lit(40)) for w, m in ((160, 320), (1, 320), (900, 320), (5, 0))])) == [20, 1, 40, 40]


def steps(spark, rows):
    return spark.createDataFrame([(s, t, [float(x) for x in scores]) for s, t, scores in rows], "sample int, t int, scores array<float>")


def test_decode_runs_blanks_and_unknown(spark):
    words = spark.createDataFrame([(1, "a"), (2, "b")], "idx int, token string")
    onehot = lambda k, n=4: [9.0 if j == k else 0.0 for j in range(n)]
    rows = [(0, t, onehot(k)) for t, k in enumerate([1, 1, 0, 1, 2])] + [(1, t, onehot(0)) for t in range(3)] + [(2, 0, onehot(3))]
    rows += [(3, t, [math.log(x) for x in p]) for t, p in enumerate([[0.1, 0.8, 0.05, 0.05], [0.05, 0.05, 0.85, 0.05]])]
    got = {r["sample"]: r for r in decode(steps(spark, rows), words).collect()}
    assert (got[0]["text"], got[0]["token_ids"]) == ("aab", "1,1,2")
    assert (got[1]["text"], got[1]["confidence"], got[1]["fallback_count"]) == ("", 1.0, 0)
    assert (got[2]["text"], got[2]["fallback_count"]) == ("[UNK]", 1)
    assert got[3]["confidence"] == pytest.approx((0.8 + 0.85) / 2, abs=1e-5)


def test_scores(spark):
    nan = float("nan")
    row = one(spark, best_class(F.array(F.lit(nan), F.lit(2.0), F.lit(2.0))).alias("k"), best_probability(F.array(F.lit(0.25), F.lit(0.75))).alias("p"))
    assert (row["k"], row["p"]) == (1, 0.75)


def test_geometry(spark):
    ring = g.ring(*[(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    assert list(one(spark, g.signed_area(ring).alias("a"), g.perimeter(ring).alias("b"), g.unclip_distance(ring, 1.5).alias("c"), g.short_side(ring).alias("d"))) == [12.0, 14.0, pytest.approx(12 / 14 * 1.5), 3.0]
    mixed = g.ring(*[(F.lit(x), F.lit(y)) for x, y in ((9, 9), (0, 1), (8, 0), (1, 8))])
    assert [tuple(p) for p in one(spark, g.ordered_corners(mixed))[0]] == [(0, 1), (8, 0), (9, 9), (1, 8)]
    for angle, want in ((90, (8, 2)), (180, (9, 17)), (270, (3, 18)), (0, (2, 3)), (450, (8, 2))):
        w, h = 11, 20
        x, y = g.unrotated(F.lit(2), F.lit(3), F.lit(angle), F.lit(w), F.lit(h))
        assert tuple(one(spark, x.alias("x"), y.alias("y"))) == want


def test_text_region_stays_inside(spark):
    cases = {(1.2, 2.7, 8.1, 9.9): (1, 2, 8, 8), (-5, -5, -1, -1): (0, 0, 1, 1), (50, 50, 60, 60): (9, 9, 1, 1), (3, 3, 3, 3): (3, 3, 1, 1)}
    for (a, b, c, d), want in cases.items():
        r = one(spark, g.text_region(*[F.lit(float(x)) for x in (a, b, c, d)], F.lit(10), F.lit(10)))[0]
        assert (r["x"], r["y"], r["width"], r["height"]) == want


def test_region_error(spark):
    check = lambda *v: one(spark, region_error(*[F.lit(x) for x in v]))[0]
    big = 2**32 - 1
    assert check(0, 0, big, big, 100, 100) == "out_of_bounds"
    assert check(0, 0, 0, 5, 100, 100) == "empty_region"
    assert check(0, 0, 5, 5, 0, 100) == "empty_image"
    assert check(95, 0, 5, 5, 100, 100) is None


def test_resize_rows(spark):
    image = lambda v: spark.createDataFrame([(1, v)], "i int, v array<int>")
    values = lambda df: [r["v"] for r in df.orderBy("y", "x").collect()]
    assert values(resize(image([0, 200]), "i", "v", (1, 2), (1, 4))) == [0, 50, 150, 200]
    assert values(resize(image([0, 100, 200, 250]), "i", "v", (1, 4), (1, 2))) == [50, 225]


def test_quad_scores(spark):
    pixels = as_pixels(spark.createDataFrame([(1, [0.0] * 5 + [0.9, 0.9] + [0.0] * 2 + [0.9, 0.9] + [0.0] * 5)], "i int, v array<double>"), "i", "v", 4)
    square = [(1.0, 1.0), (2.9, 1.0), (2.9, 2.9), (1.0, 2.9)]
    quads = spark.createDataFrame([(1, 0, *[c for p in square for c in p])], "image int, quad int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    row = quad_scores(pixels, quads, 4, 4).first()
    assert (row["n"], row["score"]) == (4, pytest.approx(0.9))


def test_similarity_and_matches(spark):
    assert one(spark, similarity(F.lit("kitten"), F.lit("sitting")))[0] == pytest.approx(1 - 3 / 7)
    assert one(spark, similarity(F.lit(""), F.lit("")))[0] == 1.0
    boxes = "page int, id int, x1 double, y1 double, x2 double, y2 double"
    left = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1.0, 0.0, 11.0, 10.0)], boxes)
    right = spark.createDataFrame([(1, 7, 1.0, 0.0, 11.0, 10.0), (2, 8, 0.0, 0.0, 10.0, 10.0)], boxes)
    pairs = overlapping(left, right, "page", 3.0, 0.5)
    assert sorted((r["l"], r["r"]) for r in pairs.collect()) == [(1, 7), (2, 7)]
    assert [(r["l"], r["r"], r["iou"]) for r in greedy_matches(pairs).collect()] == [(2, 7, 1.0)]


def test_dictionary(spark):
    lines = spark.createDataFrame([(0, "foo"), (1, "bar"), (2, "foo")], "line int, token string")
    assert [(r["idx"], r["token"]) for r in build(lines, "token", ["line"]).orderBy("idx").collect()] == [(0, "[blank]"), (1, "foo"), (2, "bar"), (3, "foo"), (4, " ")]
    assert [tuple(r) for r in duplicates(lines, "token", "line").collect()] == [("foo", 0, 2)]
    assert {r["token"]: r["idx"] for r in reverse(lines.withColumnRenamed("line", "idx")).collect()} == {"foo": 0, "bar": 1}
    cleaned = [one(spark, clean_token(F.lit(x)))[0] for x in ("a", " c ", "", "　", "﻿b\r\n")]
    assert cleaned == ["a", "c", None, "　", "b"]


def test_fraction(spark):
    assert [one(spark, fraction(F.lit(x)))[0] for x in ("1./255.", "0.5", "1/0", "x", "1/2/3")] == [pytest.approx(1 / 255), 0.5, None, None, None]


def test_middle_samples(spark):
    groups = {"one": [5.0], "two": [1.0, 4.0], "odd": [3.0, 1.0, 2.0], "ties": [7.0] * 9 + [1.0, 9.0, None], "many": [float(k * 7919 % 10007) for k in range(10007)], "even": [float(k % 100) for k in range(5000)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    got = {r["k"]: (r["lower"], r["upper"], r["n"]) for r in middle_samples(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k, vs in groups.items():
        vs = sorted(v for v in vs if v is not None)
        assert got[k] == (vs[(len(vs) - 1) // 2], vs[len(vs) // 2], len(vs))
