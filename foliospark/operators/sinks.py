"""Page results as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import let, smallest_rectangle
from foliospark.functions.numbers import rounded


#: A column, or how to make it of a region's struct of columns.
Made = str | Callable[[Column], Column]


def gathered(regions: DataFrame, page: str, order: list[str], named: dict[str, Made | None], present: Made) -> DataFrame:
    """page and _regions: each page's regions in the order of the columns in `order`, without those where `present` is null.

    Only the columns in `order`, and named ones beside them, go through the grouping, each once; what is made of them is made after it.
    """
    made = {n: m for n, m in named.items() if m is not None}
    beside = list(dict.fromkeys(m for m in made.values() if isinstance(m, str) and m not in order))
    row = F.struct(*order, *[c for c in beside])
    there = F.col(present).isNotNull() if isinstance(present, str) else let(row, lambda r: present(r).isNotNull())
    found = regions.groupBy(page).agg(F.array_sort(F.collect_list(F.when(there, row))).alias("_rows"))
    pick = lambda r: F.struct(*[(r[m] if isinstance(m, str) else m(r)).alias(n) for n, m in made.items()])
    return found.select(page, F.transform("_rows", pick).alias("_regions"))


def text_report(regions: DataFrame, page: str, order: list[str], text: str, confidence: str, ring: Made) -> DataFrame:
    """One row per page: page and report, with every region's text, confidence and polygon.

    Regions are numbered from 1 in the order of the columns in `order`. A page whose only rows have
    a null ring has no regions and says so; a null text is empty; the point that closes a ring isn't
    repeated. A page's regions meet in one row, as they have to in one report. The ring is a column, or
    made of a region's columns in `order` after the grouping, so that it isn't shuffled.
    """

    def line(r, i):
        closed = (F.size(r["_ring"]) >= 2) & (F.get(r["_ring"], F.lit(0)) == F.element_at(r["_ring"], -1))
        points = F.slice(r["_ring"], F.lit(1), F.size(r["_ring"]) - F.when(closed, 1).otherwise(0))
        shown = F.array_join(F.transform(points, lambda p: F.format_string("(%.1f, %.1f)", p["x"], p["y"])), " -> ")
        confidence_ = F.format_string("%.3f", r["_confidence"].cast("double"))
        return F.concat(F.lit("--- Region "), (i + 1).cast("string"), F.lit(" ---\nText: "), F.coalesce(r["_text"], F.lit("")), F.lit("\nConfidence: "), confidence_, F.lit("\nPolygon: "), shown)

    found = gathered(regions, page, order, {"_text": text, "_confidence": confidence, "_ring": ring}, ring)
    n = F.size("_regions")
    some = F.concat(F.lit("Detected "), n.cast("string"), F.lit(" text regions:\n"), F.array_join(F.transform("_regions", line), "\n"))
    return found.select(page, F.when(n == 0, F.lit("No text regions detected.")).otherwise(some).alias("report"))


def json_report(regions: DataFrame, page: str, order: list[str], text: str, confidence: str, ring: Made, box: Made | None = None) -> DataFrame:
    """One row per page: page and json, a list of objects with text, confidence, box and polygon, in the order of the columns in `order`.

    The polygon is the ring without a repeated last point, and the box the column of that name, or the smallest
    rectangle around the ring, from its top left corner on; rings are convex, as detection's are. A page whose only rows
    have a null ring has an empty list. A page's regions meet in one row, as they have to in one document.
    Ring and box are columns, or made of a region's columns in `order` after the grouping, so that they aren't shuffled.
    """
    pairs = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))

    def told(r: Column) -> Column:
        closed = (F.size(r["_ring"]) >= 2) & (F.get(r["_ring"], F.lit(0)) == F.element_at(r["_ring"], -1))
        points = F.slice(r["_ring"], F.lit(1), F.size(r["_ring"]) - F.when(closed, 1).otherwise(0))
        both = lambda p: F.struct(
            F.coalesce(r["_text"], F.lit("")).alias("text"), r["_confidence"].cast("double").alias("confidence"),
            pairs(r["_box"] if box else smallest_rectangle(p)["quad"]).alias("box"), pairs(p).alias("polygon"),
        )
        return let(points, both)

    found = gathered(regions, page, order, {"_text": text, "_confidence": confidence, "_ring": ring, "_box": box}, ring)
    return found.select(page, F.to_json(F.transform("_regions", told)).alias("json"))


def golden_json(results: DataFrame, model: str, generator: str, settings: dict) -> DataFrame:
    """Results of read_images as golden results: image and json, an object with generator, model, image, det_params and regions.

    Scores have six digits and corners two. Pages with an error are left out.
    """
    two = lambda x: rounded(x, 2)
    regions = F.transform("results", lambda r: F.struct(
        r["text"].alias("text"), rounded(r["confidence"], 6).alias("score"), F.transform(r["quad"], lambda p: F.array(two(p["x"]), two(p["y"]))).alias("quad")
    ))
    given = F.struct(*[F.lit(v).alias(k) for k, v in settings.items()])
    whole = F.struct(F.lit(generator).alias("generator"), F.lit(model).alias("model"), F.col("image").cast("string").alias("image"), given.alias("det_params"), regions.alias("regions"))
    return results.filter("error IS NULL").select("image", F.to_json(whole).alias("json"))
