"""The page flow with stand-in models, hulls, settings, files and streams."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.config import ConfigError, dictionary_tokens, model_settings, resolve
from foliospark.operators.ocr import BrightnessBackend, ColumnBackend, read_pages
from foliospark.operators.pixels import synthetic_crops, turned_values
from foliospark.operators.quads import hulls, smallest_rectangles
from foliospark.sources.images import dictionary_file, encoded_files, encoded_stream, image_files, reference_results
from foliospark.streaming.images import stream_counts, stream_results


def png(width, height, rgb):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("images")
    (path / "a.png").write_bytes(png(3, 2, (255, 0, 10)))
    (path / "b.png").write_bytes(png(5, 4, (0, 0, 0)))
    (path / "broken.png").write_bytes(b"no image")
    return str(path)


def test_image_files_keep_broken_ones(spark, folder):
    rows = {r["origin"].rsplit("/", 1)[1]: r for r in image_files(spark, folder).collect()}
    assert (rows["a.png"]["width"], rows["a.png"]["height"], bytes(rows["a.png"]["pixels"][:3])) == (3, 2, bytes((10, 0, 255)))
    assert rows["broken.png"]["error"] == "image_decode" and rows["broken.png"]["pixels"] is None
    assert encoded_files(spark, folder, "*.png").count() == 3


def test_stream_of_files(spark, folder, tmp_path):
    files = encoded_stream(spark, folder, "*.png")
    assert files.isStreaming
    stream_results(files, lambda df: df.select("path", F.length("content").alias("n")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    counted = stream_counts(spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.lit("ok").alias("status")), "1 minute", "1 minute")
    assert counted.isStreaming and counted.columns == ["window", "status", "n"]


def test_dictionary_and_golden_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a\n\nb\n c \n# comment\nlast", encoding="utf-8")
    assert [(r["idx"], r["line"], r["token"]) for r in dictionary_file(spark, str(tmp_path / "d.txt")).orderBy("idx").collect()] == [
        (1, 1, "a"), (2, 3, "b"), (3, 4, "c"), (4, 5, "# comment"), (5, 6, "last"),
    ]
    (tmp_path / "g.json").write_text('{"generator": "x", "model": "m", "image": "i", "regions": [{"text": "t", "score": 0.5, "quad": [[1, 2], [3, 4]]}]}')
    assert [(r["region"], r["text"], r["quad"]) for r in reference_results(spark, str(tmp_path / "g.json")).collect()] == [(0, "t", [[1.0, 2.0], [3.0, 4.0]])]


def test_settings():
    text = "PostProcess:\n  thresh: 0.2\n  box_thresh: 0.4\n  character_dict:\n  - '!'\n  - a\n  - a\n"
    assert model_settings(text) == {"det_threshold": 0.2, "det_box_threshold": 0.4}
    assert dictionary_tokens(text) == ["!", "a", "a"]
    got = resolve(text, det_box_threshold=0.5, rec_batch_size=None)
    assert (got.det_threshold, got.det_box_threshold, got.det_unclip_ratio, got.rec_batch_size) == (0.2, 0.5, 1.5, 1)
    for wrong in ({"rec_batch_size": 0}, {"det_threshold": 2.0}, {"det_limit_type": "x"}, {"nothing": 1}):
        with pytest.raises(ConfigError):
            resolve(**wrong)
    with pytest.raises(ConfigError):
        model_settings("a: [1")


def test_read_pages(spark):
    blank = [0.0] * 16
    lines = [0.0] * 4 + [0.9, 0.9, 0.0, 0.0] + [0.0] * 4 + [0.0, 0.5, 0.5, 0.5]
    images = spark.createDataFrame([(1, 4, 4, lines), (2, 4, 4, blank), (3, 4, 4, blank[:5]), (4, 4, 4, None)], "image int, height int, width int, values array<double>")
    letters = spark.createDataFrame([(k, chr(96 + k)) for k in range(1, 8)], "idx int, token string")
    got = {}
    for batch in (1, 8):
        rows = read_pages(images, letters, BrightnessBackend(), ColumnBackend(), batch=batch).collect()
        got[batch] = sorted(((r["image"], r["region"] if r["region"] is not None else -1, r["x1"], r["y2"], r["text"], r["error"]) for r in rows), key=str)
    assert got[1] == got[8] == [(1, 0, 0, 2, "g", None), (1, 1, 1, 4, "d", None), (2, -1, None, None, None, None), (3, -1, None, None, None, "size"), (4, -1, None, None, None, "size")]


def test_turning_back_gives_the_image(spark):
    values = F.array(*[F.lit(k) for k in range(6)])
    for angle, (h, w) in ((90, (3, 2)), (180, (2, 3)), (270, (3, 2)), (0, (2, 3))):
        once = turned_values(values, F.lit(2), F.lit(3), F.lit(angle))
        row = spark.range(1).select(once.alias("a")).select("a", turned_values(F.col("a"), F.lit(h), F.lit(w), F.lit(360 - angle)).alias("b")).first()
        assert row["b"] == list(range(6))
        assert angle == 0 or row["a"] != row["b"]
    assert spark.range(1).select(turned_values(values, F.lit(2), F.lit(3), F.lit(90))).first()[0] == [2, 5, 1, 4, 0, 3]


def test_hulls_and_rectangles(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for key in range(6):
        angle = rng.random()
        ux, uy = (1 - angle * angle) / (1 + angle * angle), 2 * angle / (1 + angle * angle)
        corners = [(0.0, 0.0), (40 * ux, 40 * uy), (40 * ux - 10 * uy, 40 * uy + 10 * ux), (-10 * uy, 10 * ux)]
        inside = [tuple(sum(w * c[j] for w, c in zip(weights, corners, strict=True)) for j in (0, 1)) for weights in ([0.25] * 4, [0.4, 0.1, 0.2, 0.3])]
        rows += [(key, *p) for p in corners + inside + corners]
        want[key] = corners
    rows += [(10, 1.0, 1.0), (11, 0.0, 0.0), (11, 2.0, 3.0), (12, float("nan"), 0.0), (13, 0.0, 0.0), (13, 1.0, 1.0), (13, 2.0, 2.0)]
    found = hulls(spark.createDataFrame(rows, "key int, x double, y double"), "key", "x", "y")
    corners = {}
    for r in found.collect():
        corners.setdefault(r["key"], []).append((r["x"], r["y"]))
    for key, c in want.items():
        assert sorted(corners[key]) == sorted(c)
    assert len(corners[10]) == 1 and len(corners[11]) == 2 and 12 not in corners and len(corners[13]) == 2
    areas = {r["key"]: r["area"] for r in smallest_rectangles(found).collect()}
    assert all(areas[k] == pytest.approx(400) for k in want) and areas[10] == 0 and areas[11] == 6


def test_synthetic_crops(spark):
    got = synthetic_crops(spark, 2).groupBy("image", "v").count().collect()
    assert sum(r["count"] for r in got) == 2 * 320 * 48 and {r["v"] for r in got} == {20, 240}
