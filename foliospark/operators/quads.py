"""Convex hulls and smallest rectangles of point sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.geometry import ordered_corners, point


def extremes(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The points of each key that can be on its hull: the lowest and the highest of every x.

    A grouping with partial sums: what goes on is a point or two per distinct x, however many
    points there are. Points that aren't finite are left out.
    """
    finite = points.filter(~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    ends = finite.groupBy(F.col(key).alias("key"), F.col(x).alias("x")).agg(F.min(y).alias("low"), F.max(y).alias("high"))
    return ends.select("key", "x", F.explode(F.array_distinct(F.array("low", "high"))).alias("y"))


def _turn(a: tuple, b: tuple, c: tuple) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def chain(points: list[tuple]) -> list[tuple]:
    """The hull's side along points in order, without those in line with their neighbours."""
    kept: list[tuple] = []
    for p in points:
        while len(kept) > 1 and _turn(kept[-2], kept[-1], p) <= 0:
            kept.pop()
        kept.append(p)
    return kept


def hulls(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The corners of each key's convex hull in turning order from the leftmost: key, i, x, y.

    Spark deals the extremes by key and sorts them; one pass over a partition closes each key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def closed() -> list[tuple]:
            corners = held if len(held) < 3 else chain(held)[:-1] + chain(held[::-1])[:-1]
            return [(at, i, *p) for i, p in enumerate(corners)]

        for batch in batches:
            rows = []
            for k, px, py in zip(batch["key"], batch["x"], batch["y"], strict=True):
                if k != at:
                    rows += closed()
                    at, held = k, []
                held.append((px, py))
            yield pd.DataFrame(rows, columns=["key", "i", "x", "y"])
        yield pd.DataFrame(closed(), columns=["key", "i", "x", "y"])

    kind = points.schema[key].dataType.simpleString()
    dealt = extremes(points, key, x, y).select("key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return dealt.repartition("key").sortWithinPartitions("key", "x", "y").mapInPandas(run, f"key {kind}, i int, x double, y double")


def smallest_rectangles(hull: DataFrame) -> DataFrame:
    """The rectangle of least area around each hull (key, i, x, y): key, area and quad (tl, tr, br, bl).

    One side lies along an edge of the hull. Every edge gives a direction, all corners are measured
    in it, and of equal areas the first edge's rectangle is taken. Hulls of one or two points give
    the upright rectangle around them.
    """
    whole = hull.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("c"))
    n = F.size("c")

    def rectangle(a: Column, ux: Column, uy: Column) -> Column:
        du = F.transform("c", lambda p: (p["x"] - a["x"]) * ux + (p["y"] - a["y"]) * uy)
        dv = F.transform("c", lambda p: (p["y"] - a["y"]) * ux - (p["x"] - a["x"]) * uy)
        return F.struct(
            F.array_min(du).alias("u0"), F.array_max(du).alias("u1"), F.array_min(dv).alias("v0"), F.array_max(dv).alias("v1"),
            ux.alias("ux"), uy.alias("uy"), a["x"].alias("ax"), a["y"].alias("ay"),
        )

    edges = whole.select("key", "c", F.posexplode("c").alias("k", "a"))
    b = F.get("c", (F.col("k") + 1) % n)
    dx, dy = b["x"] - F.col("a.x"), b["y"] - F.col("a.y")
    length = F.sqrt(dx * dx + dy * dy)
    few = n < 3
    edges = edges.select("key", "c", "k", "a", F.when(few, 1.0).otherwise(F.try_divide(dx, length)).alias("ux"), F.when(few, 0.0).otherwise(F.try_divide(dy, length)).alias("uy"))
    edges = edges.filter((F.col("ux").isNotNull()) & (~few | (F.col("k") == 0)))
    at = edges.select("key", "k", rectangle(F.col("a"), F.col("ux"), F.col("uy")).alias("r"))
    area = (F.col("r.u1") - F.col("r.u0")) * (F.col("r.v1") - F.col("r.v0"))
    best = at.withColumn("area", area).withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("area", "k"))).filter("rank = 1")
    corner = lambda u, v: point(F.col("r.ax") + F.col("r.ux") * F.col(f"r.{u}") - F.col("r.uy") * F.col(f"r.{v}"), F.col("r.ay") + F.col("r.uy") * F.col(f"r.{u}") + F.col("r.ux") * F.col(f"r.{v}"))
    quad = F.array(corner("u0", "v0"), corner("u1", "v0"), corner("u1", "v1"), corner("u0", "v1"))
    return best.select("key", "area", ordered_corners(quad).alias("quad"))
