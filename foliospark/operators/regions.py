"""Detected regions: limits, validation, batches by width, pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.sizes import batch_width, recognition_width


def first_candidates(regions: DataFrame, image: str, order: list[str], limit: int) -> DataFrame:
    """The first `limit` regions of each image in detection order; 0 for no limit."""
    if limit == 0:
        return regions
    rank = F.row_number().over(Window.partitionBy(image).orderBy(*order))
    return regions.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def largest_candidates(regions: DataFrame, image: str, area: str, order: list[str], limit: int) -> DataFrame:
    """The `limit` regions of each image with the largest area, earlier ones first where they're equal; 0 for no limit."""
    if limit == 0:
        return regions
    rank = F.row_number().over(Window.partitionBy(image).orderBy(F.desc(area), *order))
    return regions.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def region_error(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """What is wrong with a region of an image, or null. Compared as longs, so nothing overflows."""
    x, y, w, h, width, height = (c.cast("long") for c in (x, y, w, h, width, height))
    return (
        F.when((width <= 0) | (height <= 0), "empty_image")
        .when((w == 0) | (h == 0), "empty_region")
        .when((x >= width) | (y >= height) | (w > width - x) | (h > height - y), "out_of_bounds")
    )


def plan_batches(crops: DataFrame, image: str, order: list[str], width: str, height: str, size: int) -> DataFrame:
    """Batches of crops with similar aspect: rank and batch in the image, widths, and the batch's width.

    Crops are sorted by aspect ratio within their image, ties by `order`, and cut into batches of
    `size`. Both windows partition by image, so one shuffle serves them.
    """
    aspect = F.col(width).cast("double") / F.greatest(F.col(height).cast("double"), F.lit(1.0))
    ranked = crops.withColumn("aspect", aspect).withColumn("rank", F.row_number().over(Window.partitionBy(image).orderBy("aspect", *order)) - 1)
    ranked = ranked.withColumn("batch", F.floor(F.col("rank") / size).cast("int"))
    ranked = ranked.withColumn("width", recognition_width(F.col(width), F.greatest(F.col(height), F.lit(1))))
    widest = F.max("width").over(Window.partitionBy(image, "batch"))
    ranked = ranked.withColumn("batch_width", batch_width(widest))
    return ranked.withColumn("valid_ratio", F.least(F.col("width") / F.col("batch_width"), F.lit(1.0)))


def paired(boxes: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes with their texts, one to one by key; rows without a partner have matched = false."""
    return boxes.withColumn("_box", F.lit(True)).join(texts.withColumn("_text", F.lit(True)), keys, "full").withColumn(
        "matched", F.coalesce(F.col("_box") & F.col("_text"), F.lit(False))
    ).drop("_box", "_text")


def largest_of(rows: DataFrame, key: str, area: str, order: list[str]) -> DataFrame:
    """The row of the largest area of each key, the last of equal ones by `order`, and n, how many there were."""
    best = F.max(F.struct(area, *order)).alias("_best")
    return rows.groupBy(key).agg(best, F.count("*").alias("n")).select(key, "n", "_best.*")
