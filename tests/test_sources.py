"""Encoded images to pixels, flows over files and bytes, golden results, labels."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.config import PageConfig
from foliospark.functions.scores import label_angle
from foliospark.operators.pages import read_encoded, read_files
from foliospark.operators.pixels import dummy_tensor
from foliospark.operators.profile import stage_medians
from foliospark.operators.sinks import golden_json
from foliospark.operators.standins import BrightDetector, ColumnReader
from foliospark.sources.images import decoded_images, reference_results, three_channels

PLAIN = PageConfig(det_mean=(0.0,) * 3, det_std=(1.0,) * 3, det_threshold=0.2, det_box_threshold=0.3, rec_min_width=32)


def png(image):
    """A PNG of an RGB array, or a grey one."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = image.shape[:2]
    rows = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def page(colour=True):
    image = np.zeros((64, 96, 3), np.uint8)
    image[8:24, 10:80], image[36:52, 20:60] = (250, 240, 230), 200
    return image if colour else image[..., 0].copy()


def letters(spark):
    return spark.createDataFrame([(k, chr(96 + k)) for k in range(1, 8)], "idx int, token string")


def test_bytes_to_pixels_keep_broken_rows(spark):
    rows = [(1, png(page())), (2, b"no image"), (3, None), (4, png(page(False))), (5, png(page())), (6, b"")]
    given = spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in rows], "k int, content binary")
    got = {r["k"]: r for r in decoded_images(given, "k", "content").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and {k: got[k]["error"] for k in (2, 3, 6)} == dict.fromkeys((2, 3, 6), "image_decode")
    assert bytes(got[1]["pixels"]) == page()[..., ::-1].tobytes() == bytes(got[5]["pixels"]) and (got[4]["channels"], got[4]["height"]) == (1, 64)
    three = {r["image"]: r for r in three_channels(decoded_images(given, "k", "content").withColumnRenamed("k", "image")).collect()}
    assert bytes(three[4]["pixels"]) == page(False).repeat(3).tobytes() and three[2]["pixels"] is None
    assert decoded_images(given.limit(0), "k", "content").count() == 0


def test_flow_over_files_and_bytes_and_golden_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(page()))
    (tmp_path / "in" / "b.png").write_bytes(b"broken")
    of_files = {r["image"].rsplit("/", 1)[1]: r for r in read_files(spark, str(tmp_path / "in"), letters(spark), BrightDetector(), ColumnReader(), PLAIN).collect()}
    given = spark.createDataFrame([("a", bytearray(png(page()))), ("b", bytearray(b"broken"))], "name string, data binary")
    read = read_encoded(given, "name", "data", letters(spark), BrightDetector(), ColumnReader(), PLAIN)
    of_bytes = {r["image"]: r for r in read.collect()}
    assert of_files["a.png"]["results"] == of_bytes["a"]["results"] and len(of_bytes["a"]["results"]) == 2
    assert of_files["b.png"]["error"] == of_bytes["b"]["error"] == "image_decode" and of_bytes["b"]["results"] is None
    golden = golden_json(read, "stand-in", "test", {"thresh": 0.2, "box_thresh": 0.3}).collect()
    assert len(golden) == 1 and json.loads(golden[0]["json"])["det_params"] == {"thresh": 0.2, "box_thresh": 0.3}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.json").write_text(golden[0]["json"])
    (tmp_path / "g" / "note.txt").write_text("not json")
    back = sorted((r["region"], r["text"], r["score"], r["quad"]) for r in reference_results(spark, str(tmp_path / "g")).collect())
    assert [b[1] for b in back] == [r["text"] for r in of_bytes["a"]["results"]]
    assert np.allclose([b[3] for b in back], [[(p["x"], p["y"]) for p in r["quad"]] for r in of_bytes["a"]["results"]], atol=0.005)


def test_labels(spark):
    labels = ["0_degree", "180_degree", "90", "270", "45", "upright", "", None, "90.5"]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(labels)], "k int, label string").orderBy("k").select(label_angle(F.col("label"))).collect()]
    assert got == [0, 180, 90, 270, None, None, None, None, 90]


def test_dummy_tensors(spark):
    assert dummy_tensor(spark, "detection").agg(F.count("*"), F.sum(F.abs("v"))).first()[:] == (3 * 320 * 320, 0.0)
    rows = dummy_tensor(spark, "recognition").collect()
    assert len(rows) == 3 * 48 * 320 and len({(r["channel"], r["y"], r["x"]) for r in rows}) == len(rows)
    assert all(abs(r["v"] - math.sin((r["y"] * 320 + r["x"]) / (48 * 320) + 0.1 * r["channel"])) < 1e-6 for r in rows)
    with pytest.raises(ValueError):
        dummy_tensor(spark, "other")


def test_medians_by_stage_keep_null_keys_and_stages(spark):
    rows = [("a", 1.0, None, 5.0), ("a", 3.0, None, 1.0), (None, 2.0, 7.0, 2.0), ("b", None, None, 9.0)]
    told = {r["k"]: r[1:] for r in stage_medians(spark.createDataFrame(rows, "k string, s double, t double, total double"), ["k"], ["s", "t"], ["total"]).select("k", "n", "s", "t", "min_total", "max_total").collect()}
    assert told == {"a": (2, 2.0, None, 1.0, 5.0), None: (1, 2.0, 7.0, 2.0, 2.0), "b": (1, None, None, 9.0, 9.0)}
