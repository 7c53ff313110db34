"""Comparing results with references: overlap joins, one-to-one matches, text similarity, totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import iou


def overlapping(left: DataFrame, right: DataFrame, image: str, cell: float, least: float) -> DataFrame:
    """Pairs of boxes of one image whose IoU is `least` or more: (image, l, r, iou).

    Boxes are rows of (image, id, x1, y1, x2, y2). Each is put into every grid cell of side `cell`
    that it touches, and pairs meet on image and cell: an equi-join, where a comparison of ranges
    would be a nested loop. A pair is kept in the cell that holds the corner of its intersection
    alone, so that nothing has to be made distinct.
    """

    def in_cells(boxes: DataFrame, side: str) -> DataFrame:
        named = boxes.select(F.col(image).alias("image"), *[F.col(c).alias(f"{side}_{c}") for c in ("id", "x1", "y1", "x2", "y2")])
        cells = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
        return named.withColumn("cx", F.explode(cells(f"{side}_x1", f"{side}_x2"))).withColumn("cy", F.explode(cells(f"{side}_y1", f"{side}_y2")))

    pairs = in_cells(left, "l").join(in_cells(right, "r"), ["image", "cx", "cy"])
    corner = [F.floor(F.greatest(f"l_{c}1", f"r_{c}1") / cell) for c in "xy"]
    overlap = iou(tuple(F.col(f"l_{c}") for c in ("x1", "y1", "x2", "y2")), tuple(F.col(f"r_{c}") for c in ("x1", "y1", "x2", "y2")))
    found = pairs.filter((F.col("cx") == corner[0]) & (F.col("cy") == corner[1])).withColumn("iou", overlap)
    return found.filter(F.col("iou") >= least).select("image", F.col("l_id").alias("l"), F.col("r_id").alias("r"), "iou")


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of (image, l, r, iou): the best pair first, and no box twice.

    Ties go to the smaller ids. Spark deals the pairs by image and sorts them; one pass over a
    partition then keeps only the boxes taken in the image it is at.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left, right = None, set(), set()
        for batch in batches:
            keep = []
            for image, a, b in zip(batch["image"], batch["l"], batch["r"], strict=True):
                if image != at:
                    at, left, right = image, set(), set()
                keep.append(a not in left and b not in right)
                if keep[-1]:
                    left.add(a)
                    right.add(b)
            yield batch[keep]

    dealt = pairs.select("image", "l", "r", "iou").repartition("image").sortWithinPartitions("image", F.desc("iou"), "l", "r")
    return dealt.mapInPandas(match, dealt.schema)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer text's characters; 1 for two empty texts."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def detection_report(matched: Column, predicted: Column, reference: Column) -> dict[str, Column]:
    """Precision, recall and F1 from counts; empty denominators count as 1."""
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    p, r = share(matched, predicted), share(matched, reference)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}
