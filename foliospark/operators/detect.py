"""Score maps to boxes: hot pixels, their components, smallest rectangles, scores, growth; a map stays in its row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.geometry import distance, let, point, rescaled, short_side, smallest_rectangle, unclip_distance
from foliospark.operators.borders import hull_of
from foliospark.operators.pixels import above, as_maps, quad_mean

COMPONENT = "struct<runs:array<struct<y:int,x1:int,x2:int>>,hull:array<struct<x:double,y:double>>>"


def hot_runs(pixels: DataFrame, threshold: float) -> DataFrame:
    """Runs of neighbouring hot pixels in a row: image, y, x1, x2, node."""
    hot = pixels.filter(above(F.col("p"), threshold)).select("image", "y", "x")
    island = F.col("x") - F.row_number().over(Window.partitionBy("image", "y").orderBy("x"))
    runs = hot.withColumn("island", island).groupBy("image", "y", "island").agg(F.min("x").alias("x1"), F.max("x").alias("x2"))
    return runs.select("image", "y", "x1", "x2", F.concat_ws(":", "image", F.lpad(F.col("y").cast("string"), 6, "0"), F.lpad(F.col("x1").cast("string"), 6, "0")).alias("node"))


def joined(row: np.ndarray, y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """The first run of each run's component; runs touch in neighbouring lines of a row, corners included.

    Runs are sorted by row, y and x1. A run meets one stretch of the next line's runs.
    """
    if not len(row):
        return np.empty(0, np.int64)
    # lines are numbered so that only neighbours of one row follow each other
    line = np.cumsum(np.r_[0, np.where(row[1:] == row[:-1], np.minimum(y[1:] - y[:-1], 2), 2)])
    low, wide = int(x1.min()), int(x2.max()) - int(x1.min()) + 3
    first = np.searchsorted(line * wide + x2 - low, (line + 1) * wide + x1 - low - 1)
    count = np.searchsorted(line * wide + x1 - low, (line + 1) * wide + x2 - low + 1, side="right") - first
    upper = np.repeat(np.arange(len(line)), count)
    under = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(upper))
    root = list(range(len(line)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for k, m in zip(upper.tolist(), under.tolist(), strict=True):
        k, m = top(k), top(m)
        root[max(k, m)] = min(k, m)
    for k in range(len(root)):  # roots come before what hangs on them
        root[k] = root[root[k]]
    return np.array(root)


def _listed(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _struct(**columns: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def with_components(maps: DataFrame, threshold: float, width: int, values: str = "values") -> DataFrame:
    """maps plus components: the runs of touching hot pixels (corners included) and the convex hull of each, in the order of their first pixels.

    values is row-major with lines of so many pixels. Nothing of a map leaves its row; the runs of a whole batch are found and joined at once.
    """
    names = maps.columns
    at = names.index(values)
    limit = min(max(threshold, 0.0), 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = given.flatten()
            # as Spark compares: a null isn't hot, a NaN is above all
            hot = np.array(flat.is_valid()) & ~(flat.to_numpy(zero_copy_only=False).astype(float) <= limit)
            row = np.repeat(np.arange(len(sizes)), sizes)
            i = np.arange(len(hot)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            begins = i % width == 0
            start = np.flatnonzero(hot & (begins | ~np.r_[False, hot[:-1]])) if len(hot) else np.empty(0, np.int64)
            stop = np.flatnonzero(hot & np.r_[begins[1:] | ~hot[1:], True]) if len(hot) else start
            row, y, x1, x2 = row[start], i[start] // width, i[start] % width, i[stop] % width
            root = joined(row, y, x1, x2)
            order = np.argsort(root, kind="stable")
            roots, runs = np.unique(root, return_counts=True)
            ends = np.cumsum(runs)
            hulls, (cy, cx1, cx2) = [], (c[order] for c in (y, x1, x2))
            points = list(zip(cx1.tolist(), cx2.tolist(), cy.tolist(), strict=True))
            for k, n in zip(ends.tolist(), runs.tolist(), strict=True):
                hulls.append(hull_of([(x, p[2]) for p in points[k - n : k] for x in p[:2]]))
            corners = np.array([c for h in hulls for c in h], float).reshape(-1, 2)
            each = pa.StructArray.from_arrays([
                _listed(runs, _struct(y=cy.astype(np.int32), x1=cx1.astype(np.int32), x2=cx2.astype(np.int32))),
                _listed(np.array([len(h) for h in hulls], np.int64), _struct(x=corners[:, 0], y=corners[:, 1])),
            ], ["runs", "hull"])
            yield pa.RecordBatch.from_arrays([*batch.columns, _listed(np.bincount(row[roots], minlength=len(sizes)), each)], [*names, "components"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in maps.schema)
    return maps.mapInArrow(run, f"{schema}, components array<{COMPONENT}>")


def labelled_runs(runs: DataFrame) -> DataFrame:
    """runs plus root, the number within the image of the first run of the component of pixels that touch, corners included.

    An image's runs are gathered in one row and joined there.
    """
    gathered = runs.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("y", "x1", "x2"))).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1)
            sizes = pc.list_value_length(given).to_numpy(zero_copy_only=False)
            row, flat = np.repeat(np.arange(len(sizes)), sizes), given.flatten()
            root = joined(row, *(flat.field(c).to_numpy().astype(np.int64) for c in ("y", "x1", "x2")))
            roots = root - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, _listed(sizes, pa.array(roots.astype(np.int32)))], ["image", "runs", "roots"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in gathered.schema)
    whole = gathered.mapInArrow(run, f"{kinds}, roots array<int>")
    return whole.select("image", F.explode(F.arrays_zip("runs", "roots")).alias("r")).select("image", "r.runs.*", F.col("r.roots").alias("root"))


def grown(quad: Column, by: Column) -> Column:
    """A rectangle (tl, tr, br, bl) moved out by a distance on every side."""
    c = [F.get(quad, F.lit(k)) for k in range(4)]

    def along(a: dict | Column, b: dict | Column, by: Column) -> Column:
        return let(F.greatest(distance(a, b), F.lit(1e-12)), lambda size: point((b["x"] - a["x"]) / size * by, (b["y"] - a["y"]) / size * by))

    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    moves = let(by, lambda d: F.struct(along(c[0], c[1], d).alias("u"), along(c[0], c[3], d).alias("v")))
    return let(moves, lambda m: F.array(*[point(p["x"] + s * m["u"]["x"] + t * m["v"]["x"], p["y"] + s * m["u"]["y"] + t * m["v"]["y"]) for p, (s, t) in zip(c, signs, strict=True)]))


def found_boxes(
    width: int, height: int, box_threshold: float = 0.6, unclip_ratio: float = 1.5, max_candidates: int = 1000, least_side: float = 3.0, least_grown: float = 5.0
) -> Column:
    """The boxes of a map's row (values, components): an array of (region, score, quad).

    Each component's smallest rectangle is dropped if its short side is under least_side or the
    mean score inside it under box_threshold, grown by its unclip distance, and dropped if it is
    still under least_grown. Components are taken in the order of their first pixels, up to
    max_candidates per map (0: all). The growth is in closed form: a rectangle moved out by the
    distance is the smallest one around its rounded outline.
    """
    kept = F.slice("components", 1, max_candidates) if max_candidates else F.col("components")
    hulls = F.transform(kept, lambda c, k: F.struct(k.alias("region"), c["hull"].alias("hull")))
    if least_side > 0:  # the rectangle of a pixel has no sides
        hulls = F.filter(hulls, lambda b: F.size(b["hull"]) > 1)
    quads = F.transform(hulls, lambda b: F.struct(b["region"].alias("region"), smallest_rectangle(b["hull"])["quad"].alias("quad")))
    quads = F.filter(quads, lambda b: short_side(b["quad"]) >= least_side)
    scored = F.transform(quads, lambda b: F.struct(b["region"].alias("region"), quad_mean(F.col("values"), b["quad"], width, height)["score"].alias("score"), b["quad"].alias("quad")))
    good = F.filter(scored, lambda b: b["score"] >= box_threshold)
    large = F.transform(good, lambda b: F.struct(b["region"].alias("region"), b["score"].alias("score"), grown(b["quad"], unclip_distance(b["quad"], unclip_ratio)).alias("quad")))
    return F.filter(large, lambda b: short_side(b["quad"]) >= least_grown)


def with_boxes(maps: DataFrame, width: int, height: int, threshold: float = 0.3, **limits: float) -> DataFrame:
    """maps plus boxes, by the rules of found_boxes; for a step that takes whole rows."""
    return with_components(maps, threshold, width).select(*maps.columns, found_boxes(width, height, **limits).alias("boxes"))


def box_rows(maps: DataFrame, width: int, height: int, threshold: float = 0.3, **limits: float) -> DataFrame:
    """The boxes of maps (image, values) of one size, a row each: image, region, quad, score."""
    # exploded as they are worked out: of an array column the optimizer would ask the size first, and so work it out twice
    found = with_components(maps.select("image", "values"), threshold, width).select("image", F.explode(found_boxes(width, height, **limits)).alias("b"))
    return found.select("image", "b.region", "b.quad", "b.score")


def boxes(
    pixels: DataFrame, width: int, height: int, threshold: float = 0.3, box_threshold: float = 0.6, unclip_ratio: float = 1.5, max_candidates: int = 1000,
    least_side: float = 3.0, least_grown: float = 5.0,
) -> DataFrame:
    """Boxes of score maps of one size, given as pixels (image, y, x, p): image, region, quad, score.

    The pixels of a map are gathered in one row; found_boxes has the rules.
    """
    return box_rows(
        as_maps(pixels, width), width, height, threshold=threshold, box_threshold=box_threshold, unclip_ratio=unclip_ratio, max_candidates=max_candidates,
        least_side=least_side, least_grown=least_grown,
    )


def on_page(quads: DataFrame, scale_x: float, scale_y: float, width: int, height: int) -> DataFrame:
    """Boxes of a score map on the page it was made from: whole pixels, the page's edges included."""
    move = lambda p: point(rescaled(p["x"], F.lit(scale_x), F.lit(width)), rescaled(p["y"], F.lit(scale_y), F.lit(height)))
    return quads.withColumn("quad", F.transform("quad", move))
