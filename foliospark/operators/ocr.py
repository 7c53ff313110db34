"""Pages to text lines as a flow of tables: detect, crop, batch, recognise, decode, assemble.

The models are opaque: a backend turns a batch of arrays into a batch of arrays. Everything around
them is Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators.decode import decode
from foliospark.operators.pixels import above
from foliospark.operators.regions import plan_batches
from foliospark.sources.workspace import written


class Backend(Protocol):
    """A model: a stack of images (n, height, width) of doubles to an array whose first axis is n."""

    def __call__(self, images: np.ndarray) -> np.ndarray: ...


class BrightnessBackend:
    """A stand-in for a detection model: the score of a pixel is its value over the largest possible one."""

    def __init__(self, largest: float = 1.0):
        self.largest = largest

    def __call__(self, images: np.ndarray) -> np.ndarray:
        return np.clip(images / self.largest, 0, 1)


class ColumnBackend:
    """A stand-in for a recognition model: a time step per column, whose best class is its brightness in `classes` steps."""

    def __init__(self, classes: int = 8):
        self.classes = classes

    def __call__(self, images: np.ndarray) -> np.ndarray:
        level = np.clip((images.mean(axis=1) * self.classes).astype(int), 0, self.classes - 1)
        return np.eye(self.classes)[level] * 5.0


#: Sessions of this Python worker, by the path or the digest of their model.
SESSIONS: dict[str, object] = {}


class OnnxBackend:
    """An ONNX model by path, or by its bytes, loaded once per Python worker, with one thread per Spark task.

    Bytes are sent to each executor once, as a broadcast, and not with every task.
    """

    def __init__(self, path: str | None = None, data: Broadcast | None = None, digest: str | None = None):
        self.path, self.data, self.key = path, data, digest or path

    @classmethod
    def of_bytes(cls, spark: SparkSession, model: bytes) -> OnnxBackend:
        return cls(data=spark.sparkContext.broadcast(model), digest=hashlib.sha256(model).hexdigest())

    def __call__(self, images: np.ndarray) -> np.ndarray:
        if self.key not in SESSIONS:
            import onnxruntime as ort

            options = ort.SessionOptions()
            options.intra_op_num_threads = options.inter_op_num_threads = 1
            SESSIONS[self.key] = ort.InferenceSession(self.path if self.data is None else self.data.value, options, providers=["CPUExecutionProvider"])
        session = SESSIONS[self.key]
        return session.run(None, {session.get_inputs()[0].name: images.astype(np.float32)})[0]


def infer(rows: DataFrame, backend: Backend, keys: list[str], height: str, width: str, values: str) -> DataFrame:
    """keys, height, width and the backend's output (out, row-major; steps rows of it where it has two axes).

    Rows of a batch with equal sizes go through the model together. A row whose values don't fit
    its size gets a null and an error: one bad image never fails the others.
    """
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", height int, width int, out array<double>, steps int, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            h, w = (batch.column(len(keys) + j).to_numpy(zero_copy_only=False) for j in (0, 1))
            data = batch.column(len(keys) + 2).to_pylist()
            out, steps, error = [None] * n, [None] * n, [None] * n
            sizes: dict[tuple[int, int], list[int]] = {}
            for k in range(n):
                if data[k] is None or len(data[k]) != h[k] * w[k] or not len(data[k]):
                    error[k] = "size"
                else:
                    sizes.setdefault((int(h[k]), int(w[k])), []).append(k)
            for (hh, ww), members in sizes.items():
                result = backend(np.array([data[k] for k in members], float).reshape(len(members), hh, ww))
                for k, r in zip(members, result, strict=True):
                    out[k], steps[k] = r.ravel().tolist(), int(r.shape[0])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j) for j in range(len(keys) + 2)), pa.array(out, pa.list_(pa.float64())), pa.array(steps, pa.int32()), pa.array(error, pa.string())],
                [*keys, "height", "width", "out", "steps", "error"],
            )

    return rows.select(*keys, F.col(height).cast("int").alias("height"), F.col(width).cast("int").alias("width"), F.col(values).cast("array<double>").alias("values")).mapInArrow(run, schema)


def text_rows(scores: DataFrame, threshold: float, gap: int = 1) -> DataFrame:
    """Regions of score maps (image, height, width, out): bands of rows with hot pixels, and the box around each.

    A band ends where more than `gap` rows have none. Returns image, region (from the top), x1, y1,
    x2, y2 (beyond the last pixel) and score, the mean over the hot pixels.
    """
    hot = scores.filter("error IS NULL").select("image", "width", F.posexplode("out").alias("i", "p")).filter(above(F.col("p"), threshold))
    at = hot.select("image", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), "p")
    rows = at.groupBy("image", "y").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.sum("p").alias("total"), F.count("*").alias("n"))
    order = Window.partitionBy("image").orderBy("y")
    begins = F.coalesce(F.col("y") - F.lag("y").over(order) > gap, F.lit(True)).cast("int")
    banded = rows.withColumn("begins", begins).withColumn("region", F.sum("begins").over(order) - 1)
    return banded.groupBy("image", "region").agg(
        F.min("x1").alias("x1"), F.min("y").alias("y1"), (F.max("x2") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), (F.sum("total") / F.sum("n")).alias("score")
    )


def crops(images: DataFrame, regions: DataFrame) -> DataFrame:
    """The pixels of each region (image, region, height, width, values), cut from its image by index."""
    joined = regions.join(images.select("image", F.col("width").alias("_w"), F.col("values").alias("_v")), "image")
    w = F.col("x2") - F.col("x1")
    rows = F.transform(F.sequence("y1", F.col("y2") - 1), lambda y: F.slice("_v", (y * F.col("_w") + F.col("x1") + 1).cast("int"), w.cast("int")))
    return joined.select("image", "region", "score", "x1", "y1", "x2", "y2", (F.col("y2") - F.col("y1")).alias("height"), w.cast("int").alias("width"), F.flatten(rows).alias("values"))


def read_pages(images: DataFrame, dictionary: DataFrame, detect: Backend, recognise: Backend, threshold: float = 0.3, least_score: float = 0.0, batch: int = 8) -> DataFrame:
    """Every page's regions with text: image, region, box, score, text, confidence, batch, error.

    images has image, height, width, values. Each page keeps a row: one without regions, or whose
    pixels don't fit its size, has null regions and the error, if any. Rows come back by image and
    region, whatever the batches were.
    """
    # written, as several branches read it and the model would run for each
    scores = written(infer(images, detect, ["image"], "height", "width", "values"), "scores")
    found = text_rows(scores, threshold).filter(F.col("score") >= least_score)
    cut = crops(images, found)
    planned = plan_batches(cut, "image", ["region"], "width", "height", batch).select("image", "region", "batch")
    read = written(infer(cut, recognise, ["image", "region"], "height", "width", "values"), "read")
    size = F.col("steps")
    step = read.filter("error IS NULL").select(
        F.struct("image", "region").alias("sample"), size.alias("n"), F.col("out"), F.explode(F.sequence(F.lit(0), size - 1)).alias("t")
    ).select("sample", "t", F.slice("out", (F.col("t") * (F.size("out") / F.col("n")) + 1).cast("int"), (F.size("out") / F.col("n")).cast("int")).cast("array<float>").alias("scores"))
    text = decode(step, dictionary).select("sample.image", "sample.region", "text", "confidence")
    failed = read.select("image", "region", F.col("error").alias("_line_error"))
    lines = cut.drop("height", "width", "values").join(text, ["image", "region"], "left").join(planned, ["image", "region"]).join(failed, ["image", "region"], "left")
    found = scores.select("image", "error").join(lines, "image", "left")
    return found.withColumn("error", F.coalesce("error", "_line_error")).drop("_line_error")
