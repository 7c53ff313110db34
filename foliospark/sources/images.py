"""Images and dictionaries as DataFrames, in batch and as streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.config import ConfigError, dictionary_tokens
from foliospark.operators.dictionary import clean_token
from foliospark.sources.workspace import workspace

_PIXELS = {"height": "int", "width": "int", "channels": "int", "pixels": "binary", "error": "string"}


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images under a path: image, origin, height, width, pixels (packed, BGR rows) and error.

    A file that can't be decoded keeps its row, with an error instead of pixels.
    """
    decoded = spark.read.format("image").load(path).select("image.*")
    bad = F.col("height") <= 0
    return decoded.select(
        F.xxhash64("origin").alias("image"), "origin", F.when(~bad, F.col("height")).alias("height"), F.when(~bad, F.col("width")).alias("width"),
        F.when(~bad, F.col("nChannels")).alias("channels"), F.when(~bad, F.col("data")).alias("pixels"), F.when(bad, "image_decode").alias("error"),
    )


def decoded_images(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Encoded images in a binary column as pixels: key, height, width, channels, pixels (packed, BGR rows), error.

    Spark decodes files, so each distinct image is written once to the shared folder, by its digest, and read
    from there. A row with bytes that aren't an image, or null, keeps its place with an error.
    """
    spark = rows.sparkSession
    root = f"{workspace(spark)}/foliospark/images-{uuid.uuid4().hex}"
    named = rows.select(F.col(key).alias("_key"), F.sha2(F.coalesce(content, F.lit(b"")), 256).alias("_digest"), F.col(content).alias("_content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}" if not root.startswith("file:") else root)
        folder.create_dir(base, recursive=True)
        for batch in batches:
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # under another name first, so that a task that is run again leaves whole files
                draft = f"{base}/_{digest}-{uuid.uuid4().hex}"
                with folder.open_output_stream(draft) as out:
                    out.write(data or b"")
                folder.move(draft, f"{base}/{digest}")
            yield batch.select([0])

    once = named.select("_digest", "_content").dropDuplicates(["_digest"])
    if not once.mapInArrow(write, "_digest string").count():
        return named.select(F.col("_key").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in _PIXELS.items()])  # no rows
    files = image_files(spark, root).withColumn("_digest", F.regexp_extract("origin", "([0-9a-f]{64})$", 1)).select("_digest", *_PIXELS)
    joined = named.select(F.col("_key").alias(key), "_digest").join(files, "_digest", "left").drop("_digest")  # empty files aren't read
    return joined.withColumn("error", F.when(F.col("pixels").isNull(), F.coalesce("error", F.lit("image_decode"))))


def three_channels(images: DataFrame) -> DataFrame:
    """images (image, height, width, channels, pixels, error) with three channels each: grey ones repeated, a fourth left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for n, data in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if data is not None and n in (1, 4):
                    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
                    data = np.ascontiguousarray(planes[:, :3] if n == 4 else planes.repeat(3, 1)).tobytes()
                made.append(data)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(made, pa.binary()), batch.column(5)], ["image", "height", "width", "pixels", "error"])

    kind = images.schema["image"].dataType.simpleString()
    return images.select("image", "height", "width", "channels", "pixels", "error").mapInArrow(run, f"image {kind}, height int, width int, pixels binary, error string")


def encoded_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as bytes with their path and SHA-256; without the content column, nothing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"), "content")


def encoded_stream(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """New files under a path as a stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)


def dictionary_file(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary's tokens and line numbers from a text file of a token a line.

    The lines need one order, so the file is read as one piece: a vocabulary of thousands of lines.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    return lines.select((F.col("line") + 1).alias("line"), clean_token(F.col("raw")).alias("token")).filter(F.col("token").isNotNull()).withColumn(
        "idx", F.row_number().over(Window.orderBy("line"))
    )


def dictionary_model(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary's tokens from the settings file of a recognition model: line and idx are its place in the list; repeated tokens are kept."""
    (text,) = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]  # a model's settings file
    tokens = dictionary_tokens(text)
    if not tokens:
        raise ConfigError(f"no PostProcess.character_dict in {path}")
    return spark.createDataFrame([(k, t, k) for k, t in enumerate(tokens, 1)], "line int, token string, idx int")


def dictionary_path(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary by the kind of its file: .yml and .yaml, in any case, are a model's settings, all others a token a line."""
    return dictionary_model(spark, path) if path.lower().endswith((".yml", ".yaml")) else dictionary_file(spark, path)


def reference_results(spark: SparkSession, path: str) -> DataFrame:
    """Golden results, a JSON object a file (*.json): model, image, region, text, score and quad, a row per region; other files aren't read."""
    region = "struct<text:string,score:double,quad:array<array<double>>>"
    golden = spark.read.schema(f"generator string, model string, image string, regions array<{region}>").json(path, multiLine=True, pathGlobFilter="*.json")
    return golden.select("model", "image", F.posexplode("regions").alias("region", "r")).select("model", "image", "region", "r.*")
