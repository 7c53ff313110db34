"""Models' settings files, models from bytes, dictionaries by kind of file."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.config import ConfigError, ModelConfig, dictionary_tokens, model_config, page_config
from foliospark.operators.ocr import OnnxBackend
from foliospark.operators.pages import Classifier
from foliospark.operators.standins import BrightCorner
from foliospark.sources.images import dictionary_path

DET = """Global:
  model_name: tiny_det
Hpi:
  backend_configs:
    shapes: &id001
      x:
      - - 1
        - 3
      - - 1
        - 736
    again: *id001
PostProcess:
  box_thresh: 0.4
  max_candidates: 3000
  name: DBPostProcess
  thresh: 0.2
  unclip_ratio: 1.4
PreProcess:
  transform_ops:
  - DecodeImage:
      channel_first: false
      img_mode: BGR
  - DetLabelEncode: null
  - NormalizeImage:
      mean:
      - 0.485
      - 0.456
      - 0.406
      scale: 1./255.
      std:
      - 0.229
      - 0.224
      - 0.225
  - ToCHWImage: null
"""
REC = """PreProcess:
  transform_ops:
  - DecodeImage:
      img_mode: rgb
  - RecResizeImg:
      image_shape:
      - 3
      - 48
      - 320
PostProcess:
  name: CTCLabelDecode
  character_dict:
  - '!'
  - ''''
  - \\
  - "\\u3000"
  - '- '
  - 'a: b'
  - 'null'
  - 日
"""
CLS = """PreProcess:
  transform_ops:
  - ResizeImage:
      resize_short: 256
  - CropImage:
      size: 224
PostProcess:
  Topk:
    label_list:
    - '0'
    - '90'
    - '180'
    - '270'
"""


def test_all_fields():
    assert model_config(DET) == ModelConfig("tiny_det", "bgr", (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), None, "DBPostProcess", 0.2, 0.4, 1.4, 3000)
    rec = model_config(REC)
    assert (rec.channel_order, rec.rec_image_shape, rec.characters) == ("rgb", (3, 48, 320), ("!", "'", "\\", "　", "- ", "a: b", "null", "日"))
    cls = model_config(CLS)
    assert (cls.cls_short, cls.cls_crop, cls.cls_size, cls.labels) == (256, 224, None, ("0", "90", "180", "270"))
    exact = model_config(CLS.replace("      resize_short: 256\n", "      size:\n      - 160\n      - 80\n"))
    assert (exact.cls_size, exact.cls_short) == ((160, 80), None)
    assert model_config("") == model_config("- a\n- b\n") == ModelConfig()
    assert model_config("PostProcess:\n  thresh: 1./4\n").threshold == 0.25


@pytest.mark.parametrize("text", [
    "PostProcess:\n  character_dict: [a, b]\n", "PostProcess:\n  thresh: much\n", "PostProcess:\n  thresh: 1/0\n", "PostProcess:\n  max_candidates: -3\n", "a: 'open\n",
    "PostProcess:\n  character_dict: a\n", REC.replace("rgb", "GRAY"), REC.replace("      - 320\n", ""), CLS.replace("224", "2.5"), DET.replace("      - 0.406\n", ""),
])
def test_values_that_cannot_be_used(text):
    with pytest.raises(ConfigError):
        model_config(text)


def test_precedence():
    plain = page_config(DET, REC)
    assert (plain.det_threshold, plain.det_box_threshold, plain.det_unclip_ratio, plain.det_max_candidates) == (0.3, 0.6, 1.5, 1000)
    assert (plain.channel_order, plain.rec_channel_order, plain.rec_height, plain.rec_min_width, plain.det_mean) == ("bgr", "rgb", 48, 320, (0.485, 0.456, 0.406))
    got = page_config(DET, REC, postprocess_from_model=True, det_box_threshold=0.5, rec_crop_mode="AXIS_ALIGNED", det_limit_type="MIN")
    assert (got.det_threshold, got.det_box_threshold, got.det_unclip_ratio, got.det_max_candidates, got.rec_crop_mode, got.det_limit_type) == (0.2, 0.5, 1.4, 3000, "axis_aligned", "min")
    for wrong in (lambda: page_config(REC), lambda: page_config(DET, DET), lambda: page_config(rec_text=REC.replace("- 3\n", "- 1\n")), lambda: page_config(nothing=1)):
        with pytest.raises(ConfigError):
            wrong()


def test_classifier_of_a_file():
    made = Classifier.of(BrightCorner(), CLS)
    assert made.angles == [0, 90, 180, 270] and (made.image.short, made.image.crop) == (256, 224)
    image = np.zeros((300, 400, 3), np.uint8)
    image[250:, 330:] = 255
    assert made([image]) == [180]
    for text in (CLS.replace("resize_short", "other"), CLS.replace("label_list", "other"), CLS.replace("'90'", "'45'")):
        with pytest.raises(ConfigError):
            Classifier.of(BrightCorner(), text)


def test_dictionaries_by_kind(spark, tmp_path):
    (tmp_path / "m.YML").write_text(REC, encoding="utf-8")
    (tmp_path / "d.txt").write_text("a\n\nb\n", encoding="utf-8")
    (tmp_path / "e.yaml").write_text("a: b\n")
    assert [(r["idx"], r["token"]) for r in dictionary_path(spark, str(tmp_path / "m.YML")).orderBy("idx").collect()] == list(enumerate(dictionary_tokens(REC), 1))
    assert [(r["idx"], r["token"]) for r in dictionary_path(spark, str(tmp_path / "d.txt")).orderBy("idx").collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(ConfigError):
        dictionary_path(spark, str(tmp_path / "e.yaml"))


def field(number, value):
    """A protobuf field: a number, or bytes with their length."""
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def negating_model():
    """An ONNX model of one node, y = -x, written out by hand."""
    shape = b"".join(field(1, field(2, b"n%d" % k)) for k in range(4))
    info = lambda name: field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))
    graph = field(1, field(1, b"x") + field(2, b"y") + field(4, b"Neg")) + field(2, b"g") + field(11, info(b"x")) + field(12, info(b"y"))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


def test_models_from_bytes_are_loaded_once_per_worker(spark, tmp_path):
    model = negating_model()
    (tmp_path / "m.onnx").write_bytes(model)
    images = np.arange(24, dtype=float).reshape(1, 3, 2, 4)
    assert (OnnxBackend(str(tmp_path / "m.onnx"))(images) == -images).all()
    backend = OnnxBackend.of_bytes(spark, model)

    def run(batches):
        import pyarrow as pa

        from foliospark.operators.ocr import SESSIONS  # the worker's

        for batch in batches:
            before = backend.key in SESSIONS
            out = [float(backend(np.full((1, 3, 1, 1), x))[0, 0, 0, 0]) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array([os.getpid()] * len(out)), pa.array([not before] + [False] * (len(out) - 1))], ["y", "worker", "loaded"])

    rows = spark.range(40, numPartitions=8).select(F.col("id").cast("double")).mapInArrow(run, "y double, worker long, loaded boolean").collect()
    assert sorted(r["y"] for r in rows) == sorted(-float(k) for k in range(40))
    assert sum(r["loaded"] for r in rows) == len({r["worker"] for r in rows})
