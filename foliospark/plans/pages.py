"""Queries about whole pages: an embedding says which cells of a page are bright, an order how large an image is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.config import PageConfig
from foliospark.functions.numbers import rounded
from foliospark.operators.groups import memory_groups, output_hashes
from foliospark.operators.pages import Classifier, ClassifierInput, classifier_images, read_images
from foliospark.operators.standins import BrightCorner, BrightDetector, ColumnReader
from foliospark.plans.tables import table


def _pixels(cells: Column, value, down: int, across: int) -> Column:
    """Packed BGR rows of a page of 8 by 8 cells, each of down by across pixels of one grey value."""
    shade = lambda v: F.repeat(F.lpad(F.hex(value(v).cast("long")), 2, "0"), F.lit(3 * across))
    row = lambda r: F.repeat(F.array_join(F.transform(F.slice(cells, r * 8 + 1, 8), shade), ""), F.lit(down))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), row), ""))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 64 by 96 pixels; every 50th is short of some."""
    bright = lambda v: F.when(v > 0.1, F.least(F.lit(130) + F.floor(v * 400), F.lit(250))).otherwise(10)
    pixels = _pixels(F.col("embedding"), bright, 8, 12)
    whole = F.when(F.col("vec_id") % 50 == 0, F.substring(pixels, 1, 1000)).otherwise(pixels)
    # dealt out while a page is still small: a file of few row groups would be read, and turned, scored and traced, by as few tasks
    cells = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")
    return cells.select(F.col("vec_id").alias("image"), F.lit(64).alias("height"), F.lit(96).alias("width"), whole.alias("pixels"))


def page_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page flow with its real steps and stand-ins for the models, a row per line: turned pages, boxes, lines read in batches of six."""
    letters = spark.createDataFrame([(k, chr(96 + k)) for k in range(1, 8)], "idx int, token string")
    config = PageConfig(det_mean=(0.0,) * 3, det_std=(1.0,) * 3, det_box_threshold=0.4, rec_batch_size=6, rec_min_width=64)
    corners = Classifier(BrightCorner(), ("0", "90", "180", "270"), ClassifierInput(size=(32, 32)))
    read = read_images(_images(spark, sf_dir), letters, BrightDetector(), ColumnReader(), config, corners)
    rows = read.select("image", "error", "angle", F.explode_outer("results").alias("r"))
    cells = [F.get("r.quad", F.lit(k // 2))["xy"[k % 2]].alias(f"{'xy'[k % 2]}{k // 2}") for k in range(8)]
    return rows.select("image", "error", "angle", "r.region", "r.text", rounded("r.confidence", 5).alias("confidence"), rounded("r.score", 5).alias("score"), *cells)


def classifier_input_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 8 by 8 grey pixels for a classifier: the short side made 6 by triangle filters, the middle 5 by 5 of it."""
    grey = lambda v: F.least(F.floor(F.abs(v) * 600), F.lit(255))
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.lit(8).alias("height"), F.lit(8).alias("width"), _pixels(F.col("embedding"), grey, 1, 1).alias("pixels"))
    made = classifier_images(images, ClassifierInput(short=6, crop=5))
    return made.select("image", F.posexplode("made").alias("i", "v")).groupBy("image").agg(
        F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("i") + 1)).alias("weighted"), F.max("v").alias("most"), F.count("*").alias("n")
    )


def image_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images of so many thousands of pixels, in groups of a million at most: their number and sum."""
    images = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 97 == 0, 6).otherwise(1) / 1000).alias("weight"))
    return memory_groups(images, ["o_orderkey", "weight"], F.col("weight"), 1000).groupBy("group").agg(
        F.count("*").alias("images"), F.sum("weight").alias("weight"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")
    )


def output_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each vector as a model's output."""
    return output_hashes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "output_hash")


QUERIES = {f.__name__: f for f in (page_flow, classifier_input_small, image_groups, output_digest)}

ORACLE_SQL = {
    "classifier_input_small": """WITH w AS (SELECT d, s, greatest(1 - abs(((s + 0.5::DOUBLE) - (d + 0.5::DOUBLE) * (8 / 6.0::DOUBLE)) / (8 / 6.0::DOUBLE)), 0) AS w FROM range(0, 6) a(d), range(0, 8) b(s)),
      n AS (SELECT d, s, w / sum(w) OVER (PARTITION BY d) AS w FROM w),
      p AS (SELECT vec_id AS image, (i - 1) // 8 AS y, (i - 1) % 8 AS x, least(floor(abs(embedding[i]::DOUBLE) * 600), 255) AS v FROM embeddings, range(1, 65) t(i)),
      r AS (SELECT image, a.d AS y, x, sum(a.w * v) AS v FROM p JOIN n a ON a.s = y GROUP BY ALL),
      o AS (SELECT image, y, b.d AS x, floor(round(sum(b.w * v), 6) + 0.5) AS v FROM r JOIN n b ON b.s = x GROUP BY ALL)
      SELECT image, sum(v)::BIGINT AS total, sum(v * (y * 5 + x + 1))::BIGINT AS weighted, max(v)::INT AS most, count(*) AS n FROM o WHERE y < 5 AND x < 5 GROUP BY image""",
    "image_groups": """WITH o AS (SELECT o_orderkey, floor(o_totalprice * CASE WHEN o_orderkey % 97 = 0 THEN 6 ELSE 1 END / 1000)::BIGINT AS weight FROM orders),
      t AS (SELECT *, coalesce(sum(CASE WHEN weight * 2 <= 1000 THEN weight ELSE 0 END) OVER w, 0) AS light, coalesce(sum((weight * 2 > 1000)::INT) OVER w, 0) AS heavies
        FROM o WINDOW w AS (ORDER BY o_orderkey, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT CASE WHEN weight * 2 > 1000 THEN -1 - heavies ELSE floor(light * 2 / 1000.0) END::BIGINT AS "group", count(*) AS images, sum(weight)::BIGINT AS weight, min(o_orderkey) AS first, max(o_orderkey) AS last FROM t GROUP BY 1""",
}
