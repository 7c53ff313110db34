"""The page flow with stand-in models, and the arrays that models see against values worked out pixel by pixel."""

import os
import sys
import tempfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliospark.config import ConfigError, PageConfig
from foliospark.functions.geometry import smallest_rectangle
from foliospark.operators.decode import decode
from foliospark.operators.detect import boxes, on_page
from foliospark.operators.pages import Classifier, ClassifierInput, best_steps, boxed, line_batches, lined, read_batches, read_images, scored, texts, upright
from foliospark.operators.pixels import as_pixels
from foliospark.operators.quads import hulls, smallest_rectangles
from foliospark.operators.raster import antialiased, bilinear, cut_out, line_batch, quad_mean, scaled_channels, unpacked
from foliospark.operators.standins import BrightCorner, BrightDetector, ColumnReader

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers know no tests
PLAIN = PageConfig(det_mean=(0.0,) * 3, det_std=(1.0,) * 3, det_threshold=0.2, det_box_threshold=0.3, rec_min_width=32)
CORNERS = Classifier(BrightCorner(), ("0", "90", "180", "270"), ClassifierInput(size=(64, 64)))


def page():
    image = np.zeros((96, 128, 3), np.uint8)
    image[:12, :12] = 250
    image[20:40, 20:100], image[20:40, 40:60], image[60:84, 30:110] = 200, 120, 250
    return image


def frame(spark, images):
    rows = [(k, *((x.shape[0], x.shape[1], bytearray(np.ascontiguousarray(x).tobytes())) if isinstance(x, np.ndarray) else x)) for k, x in enumerate(images)]
    return spark.createDataFrame(rows, "image int, height int, width int, pixels binary")


def letters(spark):
    return spark.createDataFrame([(k, chr(96 + k)) for k in range(1, 8)], "idx int, token string")


def lines(rows):
    return {r["image"]: [(x["region"], x["text"], round(x["confidence"], 6)) for x in r["results"]] if r["results"] is not None else r["error"] for r in rows}


def test_four_turns_give_equal_texts_and_boxes(spark):
    rows = sorted(read_images(frame(spark, [np.rot90(page(), -k) for k in range(4)]), letters(spark), BrightDetector(), ColumnReader(), PLAIN, CORNERS).collect())
    assert [r["angle"] for r in rows] == [0, 90, 180, 270] and len({str(x) for x in lines(rows).values()}) == 1 and len(rows[0]["results"]) == 3
    upright_ = [[(p["x"], p["y"]) for p in x["quad"]] for x in rows[0]["results"]]
    turn = {90: lambda x, y: (96 - y, x), 180: lambda x, y: (128 - x, 96 - y), 270: lambda x, y: (y, 128 - x)}
    for r in rows[1:]:
        assert [[(p["x"], p["y"]) for p in x["quad"]] for x in r["results"]] == [[turn[r["angle"]](*p) for p in q] for q in upright_]


def test_batches_errors_and_empty_pages(spark):
    rng = np.random.default_rng(1)
    pages = [page(), np.zeros((40, 40, 3), np.uint8), (4, 4, bytearray(b"xx")), (4, 4, None), (None, None, None), (0, 0, bytearray())]
    for _ in range(3):  # boxes of many widths
        image = np.zeros((160, 160, 3), np.uint8)
        for y in range(10, 150, 28):
            image[y : y + 14, 8 : 8 + rng.integers(20, 140)] = rng.integers(120, 250)
        pages.append(image)
    got = {}
    for size in (1, 3, 100):
        rows = read_images(frame(spark, pages), letters(spark), BrightDetector(), ColumnReader(), PageConfig(**{**PLAIN.__dict__, "rec_batch_size": size})).collect()
        got[size] = lines(rows)
        assert all(r["timings"]["total"] == pytest.approx(sum(r["timings"][k] for k in r["timings"].asDict() if k != "total")) for r in rows)
        assert all((r["timings"]["recognition_inference"] > 0) == bool(r["results"]) for r in rows)
    assert got[1] == got[3] == got[100]
    assert got[1][1] == [] and len(got[1][6]) == 5 and all("pixels" in got[1][k] for k in (2, 3, 4, 5))
    assert read_images(frame(spark, []), letters(spark), BrightDetector(), ColumnReader(), PLAIN).count() == 0


class Counting:
    """A model that notes each image it sees, and breaks on very bright lines."""

    def __init__(self, model, folder, breaks=False):
        self.model, self.folder, self.breaks = model, folder, breaks

    def __call__(self, images):
        for _ in images:
            os.close(tempfile.mkstemp(dir=self.folder)[0])
        if self.breaks and images.max(axis=(1, 2, 3)).max() > 0.95:
            raise RuntimeError("too bright")
        return self.model(images)


def test_a_broken_batch_fails_its_page_alone_and_models_run_once(spark, tmp_path):
    dull = np.minimum(page(), 200)
    (tmp_path / "d").mkdir()
    (tmp_path / "r").mkdir()
    rows = read_images(frame(spark, [dull, page(), dull]), letters(spark), Counting(BrightDetector(), tmp_path / "d"), Counting(ColumnReader(), tmp_path / "r", True), PLAIN).collect()
    found = lines(rows)
    assert len(found[0]) == 3 and found[0] == found[2] and "too bright" in found[1]
    assert len(os.listdir(tmp_path / "d")) == 3 and len(os.listdir(tmp_path / "r")) == 9  # three lines a page


class Wrong:
    def __init__(self, shape):
        self.shape = shape

    def __call__(self, images):
        return np.zeros(self.shape)


def test_shapes_are_checked(spark):
    rows = read_images(frame(spark, [page()]), letters(spark), Wrong((1, 1, 5, 5)), ColumnReader(), PLAIN).collect()
    assert "detection gives (1, 1, 5, 5)" in rows[0]["error"] and rows[0]["results"] is None
    for shape in ((7, 4, 8), (1, 8), (1, 0, 8)):
        assert "recognition gives" in read_images(frame(spark, [page()]), letters(spark), BrightDetector(), Wrong(shape), PLAIN).collect()[0]["error"]
    short = Classifier(BrightCorner(), ("0", "90"), ClassifierInput(size=(64, 64)))
    assert "2 labels" in read_images(frame(spark, [page()]), letters(spark), BrightDetector(), ColumnReader(), PLAIN, short).collect()[0]["error"]
    for labels in (("upright",), ("45",)):
        with pytest.raises(ConfigError):
            Classifier(BrightCorner(), labels, ClassifierInput(size=(64, 64)))
    with pytest.raises(ValueError):
        ClassifierInput()


class Fixed:
    """A classifier that needs its full batch, and turns lines that are brighter on the right."""

    def __call__(self, images):
        if len(images) != 4:
            raise RuntimeError("the batch isn't full")
        w = images.shape[3] // 2
        left, right = images[..., :w].mean(axis=(1, 2, 3)), images[..., w:].mean(axis=(1, 2, 3))
        return np.stack([left, right], 1)


def test_lines_are_turned_in_full_batches(spark):
    image = np.zeros((200, 160, 3), np.uint8)
    for k, y in enumerate(range(10, 190, 30)):
        image[y : y + 16, 8:80], image[y : y + 16, 80:152] = (120, 240) if k % 2 else (240, 120)
    classifier = Classifier(Fixed(), ("0_degree", "180_degree"), ClassifierInput(size=(160, 80)))
    config = PageConfig(**{**PLAIN.__dict__, "rec_batch_size": 4})
    (row,) = read_images(frame(spark, [image]), letters(spark), BrightDetector(), ColumnReader(), config, None, classifier).collect()
    assert len(row["results"]) == 6 and {r["text"][0] for r in row["results"]} == {row["results"][0]["text"][0]} and row["timings"]["orientation"] > 0


def test_boxes_agree_with_those_of_pixel_rows(spark):
    rng = np.random.default_rng(5)
    maps = []
    for _ in range(4):
        image = np.zeros((64, 64, 3), np.uint8)
        for _ in range(5):
            y, x, c = *rng.integers(2, 44, 2), rng.integers(4, 9)
            for d in range(rng.integers(6, 16)):  # turned bars
                image[y + d // 2 : y + d // 2 + c, x + d] = rng.integers(100, 250)
        maps.append(image)
    df = frame(spark, maps).withColumn("error", F.lit(None).cast("string"))
    config = PageConfig(**{**PLAIN.__dict__, "det_limit_side_len": 0})
    got = boxed(scored(upright(df, None), BrightDetector(), config), config).select("image", F.explode("boxes").alias("b")).select("image", "b.*").collect()
    values = spark.createDataFrame([(k, (m.mean(2) / 255).ravel().tolist()) for k, m in enumerate(maps)], "i int, v array<double>")
    want = on_page(boxes(as_pixels(values, "i", "v", 64), 64, 64, 0.2, 0.3), 1.0, 1.0, 64, 64).collect()
    plain = lambda rows: sorted((r["image"], round(r["score"], 5), *[(p["x"], p["y"]) for p in r["quad"]]) for r in rows)
    # borders of holes are candidates too, and only outer ones are in the other way
    assert set(plain(want)) <= set(plain(got)) and len(want) >= 6


def test_batches_are_planned_within_pages(spark):
    image = page()
    df = frame(spark, [image, image]).withColumn("error", F.lit(None).cast("string"))
    config = PageConfig(**{**PLAIN.__dict__, "rec_batch_size": 2})
    pages = lined(boxed(scored(upright(df, None), BrightDetector(), config), config), config)
    batches = line_batches(pages, config)
    rows = sorted((r["image"], r["batch"], [x["region"] for x in r["lines"]], r["batch_width"]) for r in batches.collect())
    assert rows == [(k, b, *x) for k in range(2) for b, x in enumerate([([0, 2], 128), ([1], 128)])]
    read = read_batches(batches, ColumnReader(), config).collect()
    assert {len(x["ks"]) for r in read for x in r["read"] if x["region"] == 0} == {6}


def test_smallest_rectangles_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(x), float(y)) for k in range(40) for x, y in rng.integers(0, 12, (rng.integers(1, 9), 2))]
    hull = hulls(spark.createDataFrame(rows, "key int, x double, y double"), "key", "x", "y")
    whole = hull.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("c"))
    one = whole.select("key", smallest_rectangle(F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("r")).select("key", "r.*").collect()
    want = {r["key"]: r for r in smallest_rectangles(hull).collect()}
    assert len(one) == 40
    for r in one:
        assert r["area"] == pytest.approx(want[r["key"]]["area"]) and np.allclose(r["quad"], want[r["key"]]["quad"])


def resized_by_hand(row, to):
    """One row of pixels by a triangle filter whose window grows with the scale."""
    out = []
    for d in range(to):
        ratio = len(row) / to
        reach, centre = max(ratio, 1.0), (d + 0.5) * ratio
        weights = {s: max(0.0, 1 - abs((s + 0.5 - centre) / reach)) for s in range(len(row)) if centre - reach - 1 < s < centre + reach + 1}
        out.append(sum(w * row[s] for s, w in weights.items()) / sum(weights.values()))
    return out


def test_classifier_images():
    rng = np.random.default_rng(3)
    for h, w, h2, w2 in ((7, 9, 3, 4), (3, 4, 9, 8), (5, 5, 5, 5), (20, 3, 7, 1), (1, 1, 4, 4)):
        image = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        columns = [[resized_by_hand(image[:, x, c].tolist(), h2) for x in range(w)] for c in range(3)]
        want = [[[resized_by_hand([columns[c][x][y] for x in range(w)], w2)[v] for c in range(3)] for v in range(w2)] for y in range(h2)]
        assert np.abs(antialiased(image, h2, w2).astype(float) - np.array(want)).max() <= 0.5 + 1e-9
    image = rng.integers(0, 256, (30, 50, 3)).astype(np.uint8)
    assert ClassifierInput(short=16, crop=12)(image).shape == (12, 12, 3) and ClassifierInput(short=8)(image).shape == (8, 8, 3)
    assert (ClassifierInput(short=16, crop=12)(image) == antialiased(image, 16, 27)[2:14, 7:19]).all()
    assert (ClassifierInput(size=(20, 10))(image) == antialiased(image, 10, 20)).all()
    assert ClassifierInput(short=4, crop=9)(image).shape == (9, 9, 3)  # not below the crop


def test_model_inputs():
    row = np.array([[[0] * 3, [200] * 3]], np.uint8)
    assert bilinear(row, 1, 4)[0, :, 0].tolist() == [0, 50, 150, 200]
    assert bilinear(np.array([[[v] * 3 for v in (0, 100, 200, 250)]], np.uint8), 1, 2)[0, :, 0].tolist() == [50, 225]
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    got = scaled_channels(image, "rgb", (0.5, 0.0, 0.25), (0.5, 0.0, 1.0))
    assert got.shape == (3, 2, 4) and np.allclose(got[0], (image[..., 2] / 255 - 0.5) / 0.5, atol=1e-6) and np.allclose(got[1], image[..., 1] / 255) and np.allclose(got[2], image[..., 0] / 255 - 0.25)
    lines_ = line_batch([image, image[:, :2]], [4, 2], 6, 2, "bgr", (0.5, 0.5, 0.5), (0.5, 0.0, 0.5))
    assert lines_.shape == (2, 3, 2, 6) and (lines_[:, 0, :, 4:] == -1).all() and (lines_[:, 1] == 0).all()
    assert np.allclose(lines_[0, 0, :, :4], (image[..., 0] / 255 - 0.5) / 0.5, atol=1e-6)
    assert unpacked(b"123", 1, 2) is None and unpacked(None, 1, 1) is None and unpacked(b"123", 1, 1).tolist() == [[[49, 50, 51]]]


def test_cut_and_mean():
    image = np.arange(6 * 10 * 3, dtype=np.uint8).reshape(6, 10, 3)
    quad = np.array([(2, 1), (7, 1), (7, 4), (2, 4)], float)
    assert (cut_out(image, quad) == image[1:4, 2:7]).all() and (cut_out(image, quad, upright=True) == image[1:4, 2:7]).all()
    assert cut_out(image, np.full((4, 2), 3.0)).shape == (1, 1, 3)  # no area: the pixel there
    assert cut_out(image, quad + 100, upright=True).shape == (1, 1, 3)
    rng = np.random.default_rng(4)
    for _ in range(50):
        p, q = rng.random((8, 9)), rng.uniform(-3, 12, (4, 2))
        whole = np.trunc(q)
        total = []
        for y in range(8):
            for x in range(9):
                if np.floor(q[:, 0].min()) <= x <= max(np.ceil(q[:, 0].max()), 0) and np.floor(q[:, 1].min()) <= y <= max(np.ceil(q[:, 1].max()), 0):
                    s = [(whole[(k + 1) % 4, 0] - whole[k, 0]) * (y - whole[k, 1]) - (whole[(k + 1) % 4, 1] - whole[k, 1]) * (x - whole[k, 0]) for k in range(4)]
                    total += [p[y, x]] if not (max(s) >= 1e-9 and min(s) <= -1e-9) else []
        if q.min() >= 0 and q[:, 0].max() <= 8 and q[:, 1].max() <= 7:
            assert quad_mean(p, q) == pytest.approx(np.mean(total) if total else 0.0)


def test_texts_agree_with_the_decoder_of_steps(spark):
    """Random scores, probabilities and blanks: the arrays' way against the windows' way."""
    rng = np.random.default_rng(6)
    rows, steps = [], []
    for image in range(30):
        scores = rng.normal(0, 3, (rng.integers(1, 12), 9)).astype(np.float32)
        scores[rng.random(len(scores)) < 0.3] = np.eye(9, dtype=np.float32)[rng.integers(0, 2)]
        if image % 3 == 0:
            scores = np.repeat(scores, 2, 0)
        k, p = best_steps(scores)
        rows.append((image, [(image % 4, k.tolist(), p.tolist())], None))
        steps += [(image, t, s.tolist()) for t, s in enumerate(scores)]
    read = spark.createDataFrame(rows, "image int, read array<struct<region:int,ks:array<int>,ps:array<double>>>, error string")
    got = {r["image"]: (r["text"], round(r["confidence"], 6)) for r in texts(read, letters(spark)).collect()}
    want = decode(spark.createDataFrame(steps, "sample int, t int, scores array<float>"), letters(spark)).collect()
    assert got == {r["sample"]: (r["text"], round(r["confidence"], 6)) for r in want}
    assert any("[UNK]" in t for t, _ in got.values())


def test_pages_of_one_file_are_dealt_to_many_tasks(spark, tmp_path):
    from foliospark.plans.pages import _images

    spark.createDataFrame([(k, [0.2] * 64) for k in range(40)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    dealt = _images(spark, str(tmp_path)).withColumn("part", F.spark_partition_id())
    assert dealt.count() == 40 and dealt.select("part").distinct().count() > 4


def test_no_table_of_the_flow_holds_pixels_or_maps(spark, monkeypatch):
    """A table's reader holds thousands of rows at once: with pixels or maps in them an executor's memory is full."""
    from foliospark.operators import pages as flow

    kept, written = {}, flow.written

    def noted(df, name):
        kept[name] = df.schema.simpleString()
        return written(df, name)

    monkeypatch.setattr(flow, "written", noted)
    dull = np.zeros((40, 40, 3), np.uint8)
    rows = read_images(frame(spark, [page(), dull, (4, 4, None), np.rot90(page())]), letters(spark), BrightDetector(), ColumnReader(), PLAIN, CORNERS).collect()
    found = lines(rows)
    assert len(found[0]) == len(found[3]) == 3 and found[1] == [] and "pixels" in found[2]
    assert kept and not [n for n, s in kept.items() if "binary" in s or "map:" in s]


def test_a_page_keeps_what_was_found_before_its_error(spark):
    turned = np.ascontiguousarray(np.rot90(page(), -1))
    (row,) = read_images(frame(spark, [turned]), letters(spark), Wrong((1, 1, 5, 5)), ColumnReader(), PLAIN, CORNERS).collect()
    assert row["angle"] == 90 and "for a map of 96 by 128" in row["error"]
