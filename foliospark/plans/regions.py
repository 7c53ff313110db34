"""Queries about regions: line items stand for the regions of an order's page, their numbers for coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import geometry as g
from foliospark.functions.numbers import rounded
from foliospark.functions.sizes import detection_size, recognition_width, valid_steps
from foliospark.operators.quads import hulls, smallest_rectangles
from foliospark.operators.regions import first_candidates, largest_candidates, largest_of, paired, plan_batches, region_error
from foliospark.operators.sinks import json_report, text_report
from foliospark.plans.tables import table

#: The line items' key repeats, so an order over them needs all columns.
ALL = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ALL = ", ".join(ALL)


def _sizes(spark: SparkSession, sf_dir: str, limit: int, kind: str, cap: int) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 1).alias("w"), (F.col("l_suppkey") + 1).alias("h")).distinct()
    size = detection_size(F.col("w"), F.col("h"), limit, kind, cap)
    return pairs.select("w", "h", *[(rounded(c, 5) if k in ("ratio", "scale_x", "scale_y") else c).alias(k) for k, c in size.items()])


def det_resize_dims_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir, 960, "max", 4000)


def det_resize_dims_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir, 64, "min", 1200)


def _sizes_sql(limit: int, kind: str, cap: int) -> str:
    side, test = ("greatest(w, h)", ">") if kind == "max" else ("least(w, h)", "<")
    return f"""
WITH pairs AS (SELECT DISTINCT l_partkey + 1 AS w, l_suppkey + 1 AS h FROM lineitem),
a AS (SELECT w, h, CASE WHEN {side} {test} {limit} THEN {limit}::DOUBLE / {side} ELSE 1.0::DOUBLE END AS r FROM pairs),
b AS (SELECT w, h, r, trunc(w * r) AS rw, trunc(h * r) AS rh FROM a),
c AS (SELECT *, CASE WHEN greatest(rw, rh) > {cap} THEN {cap}::DOUBLE / greatest(rw, rh) ELSE 1.0::DOUBLE END AS again FROM b),
d AS (SELECT w, h, r * again AS ratio, greatest(round_even(trunc(rw * again) / 32, 0) * 32, 32)::INT AS resized_w,
             greatest(round_even(trunc(rh * again) / 32, 0) * 32, 32)::INT AS resized_h FROM c)
SELECT w, h, resized_w, resized_h, round_even(ratio * 100000, 0) / 100000 AS ratio, round_even(w::DOUBLE / resized_w * 100000, 0) / 100000 AS scale_x,
       round_even(h::DOUBLE / resized_h * 100000, 0) / 100000 AS scale_y FROM d
"""


def rec_width_and_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = table(spark, sf_dir, "lineitem")
    planned = plan_batches(crops, "l_orderkey", ALL, "l_extendedprice", "l_quantity", 3)
    steps = valid_steps(F.least("width", "batch_width"), F.col("batch_width"), F.lit(80))
    return planned.select(
        "l_orderkey", "rank", "batch", rounded("aspect", 4).alias("aspect"), "width", "batch_width", rounded("valid_ratio", 5).alias("valid_ratio"),
        steps.alias("valid_steps"),
    )


def restore_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions numbered in reading order, dealt to batches by width, and put back: per page, the order it comes out in."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *ALL)
    planned = plan_batches(lines, "l_orderkey", ALL, "l_extendedprice", "l_quantity", 4)
    back = F.array_sort(F.collect_list(F.struct(*ALL, "batch")))
    return planned.groupBy("l_orderkey").agg(
        F.array_join(F.transform(back, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["batch"].cast("string"))), " ").alias("restored"),
        F.count("*").alias("n"),
    )


def candidate_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_candidates(table(spark, sf_dir, "lineitem"), "l_orderkey", ALL, 3).select("l_orderkey", *ALL)


def candidate_largest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("area", F.col("l_quantity") * F.col("l_extendedprice"))
    return largest_candidates(lines, "l_orderkey", "area", ALL, 2).select("l_orderkey", *ALL)


def region_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 60,000 by 40 (none for orders that divide by 97); the region is what a line item's numbers say."""
    w = F.when(F.col("l_orderkey") % 97 == 0, 0).otherwise(60_000)
    error = region_error(F.floor("l_extendedprice"), F.floor("l_quantity"), F.col("l_partkey") * 10, F.col("l_linenumber") - 1, w, F.lit(40))
    return table(spark, sf_dir, "lineitem").groupBy(F.coalesce(error, F.lit("ok")).alias("status")).agg(
        F.count("*").alias("regions"), F.countDistinct("l_orderkey").alias("pages")
    )


def polygon_to_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_extendedprice") / 20 - 30, F.col("l_quantity") * 11.5 - 20
    region = g.text_region(x, y, x + F.col("l_discount") * 900, y + F.col("l_tax") * 700, F.lit(2500), F.lit(500))
    return lines.select("l_orderkey", *ALL, region.alias("r")).select("l_orderkey", *ALL, "r.x", "r.y", "r.width", "r.height")


def box_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = g.rescaled(F.col("l_quantity"), F.col("l_partkey") / 64.0, F.lit(900)), g.rescaled(F.col("l_discount") * 100, F.col("l_suppkey") / 32.0, F.lit(25))
    return table(spark, sf_dir, "lineitem").select(scaled[0].alias("x"), scaled[1].alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))


def unrotate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = (F.col("l_linenumber") % 4) * 90
    x, y = g.unrotated(F.col("l_extendedprice"), F.col("l_quantity"), angle, F.lit(105_000.0), F.lit(60.0))
    return table(spark, sf_dir, "lineitem").select(angle.cast("int").alias("angle"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y")).groupBy("angle").agg(
        F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )


def _quad() -> list[tuple]:
    """A turned rectangle from a line item: a corner, and two sides at a right angle."""
    x, y = F.col("l_extendedprice") / 100, F.col("l_quantity") * 4
    ux, uy = F.col("l_discount") * 200 + 5, F.col("l_tax") * 300
    vx, vy = -uy * 0.5, ux * 0.5
    return [(x, y), (x + ux, y + uy), (x + ux + vx, y + uy + vy), (x + vx, y + vy)]


def corner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    (a, b, c, d) = _quad()
    ordered = lines.select("l_orderkey", *ALL, g.ordered_corners(g.ring(c, a, d, b)).alias("q"))
    cells = [rounded(F.get("q", F.lit(k))[axis], 3).alias(f"{name}_{axis}") for k, name in enumerate(("tl", "tr", "br", "bl")) for axis in ("x", "y")]
    return ordered.select("l_orderkey", *ALL, *cells)


def quad_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    q = lines.select("l_orderkey", *ALL, g.ring(*_quad()).alias("q"))
    return q.select(
        "l_orderkey", *ALL, F.round(g.signed_area(F.col("q")), 3).alias("signed_area"), F.round(g.perimeter(F.col("q")), 3).alias("perimeter"),
        F.round(g.short_side(F.col("q")), 3).alias("short_side"),
    )


def unclip_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upright rectangle grown by its unclip distance on every side, where both sides reach 3 before and 5 after."""
    lines = table(spark, sf_dir, "lineitem")
    w, h = F.col("l_extendedprice") / 1000, F.col("l_quantity") / 2
    zero = F.lit(0.0)
    sides = F.struct(w.alias("w"), h.alias("h"))

    def grown(s: Column) -> Column:
        by = g.unclip_distance([(zero, zero), (s["w"], zero), (s["w"], s["h"]), (zero, s["h"])], 1.5)
        return g.let(by, lambda d: F.struct(d.alias("d"), (s["w"] + 2 * d).alias("gw"), (s["h"] + 2 * d).alias("gh")))

    # an array's rows, as a filter on the distance would have it derived once more for each of its uses
    kept = F.filter(F.array(g.let(sides, grown)), lambda r: F.least(r["gw"], r["gh"]) >= 5)
    large = lines.filter(F.least(w, h) >= 3).select("l_orderkey", *ALL, F.explode(kept).alias("r"))
    return large.select("l_orderkey", *ALL, F.round("r.d", 4).alias("d"), F.round("r.gw", 4).alias("gw"), F.round("r.gh", 4).alias("gh"))


def zip_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a box count and pages with texts, one to one: totals of both where they match."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return paired(orders, lines, ["key"]).filter("matched").select("key", "o_orderpriority", "n", "price", "o_totalprice")


def missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit(1).alias("line")).distinct()
    return paired(orders, lines, ["key"]).groupBy("matched", F.col("cust").isNull().alias("no_box")).agg(F.count("*").alias("pages"))


def _ring(r: Column) -> Column:
    x, y, side = r["l_partkey"], r["l_suppkey"], r["l_quantity"]
    return g.ring((x, y), (x + side, y), (x + side, y + 10), (x, y + 10), (x, y))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report of each page: every region's text, confidence and polygon."""
    return text_report(table(spark, sf_dir, "lineitem"), "l_orderkey", ALL, "l_returnflag", "l_discount", _ring)


def report_lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per region: number, text, confidence in per cent and box."""
    return _report(table(spark, sf_dir, "lineitem"))


def _report(lines: DataFrame) -> DataFrame:
    line = F.format_string("[%d] %s (%.1f%%) at %.2f", "l_linenumber", "l_returnflag", F.floor(F.col("l_discount") * 100).cast("double"), "l_extendedprice")
    told = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), line.alias("line"))))
    return lines.groupBy("l_orderkey").agg(F.array_join(F.transform(told, lambda x: x["line"]), "\n").alias("report"))


def polygon_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings at half scale, doubled, kept inside 2,048 by 256 and rounded."""
    q = table(spark, sf_dir, "lineitem").select("l_orderkey", *ALL, g.scaled_ring(g.ring(*_quad()), 0.5, 2048, 256).alias("q"))
    cells = [F.get("q", F.lit(k))[axis].alias(f"{axis}{k}") for k in (0, 2) for axis in ("x", "y")]
    return q.select("l_orderkey", *ALL, *cells)


def ring_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that turn either way, closed and set to turn counter-clockwise: where they begin, and how they turned."""
    (a, b, c, d) = _quad()
    back = F.col("l_linenumber") % 2 == 0
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *ALL, F.when(back, g.ring(d, c, b, a)).otherwise(g.ring(a, b, c, d)).alias("r"))
    whole = lines.select("l_orderkey", *ALL, (g.signed_area(F.col("r")) < 0).alias("clockwise"), g.closed(g.turned(F.col("r"))).alias("q"))
    return whole.select(
        "l_orderkey", *ALL, "clockwise", rounded(F.get("q", F.lit(1))["x"], 3).alias("second_x"), rounded(F.element_at("q", -1)["y"], 3).alias("last_y"), F.size("q").alias("points")
    )


def largest_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, the region of the largest area, the last of equal ones: what a grown outline keeps."""
    lines = table(spark, sf_dir, "lineitem").withColumn("area", F.col("l_quantity") * F.floor(F.col("l_discount") * 100))
    return largest_of(lines, "l_orderkey", "area", ALL)


def legacy_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older chain of limits: area of 10, score clamped to 1 and compared (0 keeps all), the 2 largest, grown area of 25."""
    lines = table(spark, sf_dir, "lineitem").withColumn("area", F.col("l_quantity") * F.col("l_linenumber"))
    kept = lines.filter((F.col("area") >= 10) & (F.least(F.col("l_discount") * 12, F.lit(1.0)) >= 0.6))
    kept = largest_candidates(kept, "l_orderkey", "area", ALL, 2).withColumn("grown", F.col("area") * (1 + F.col("l_tax") * 10)).filter("grown >= 25")
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("regions"), rounded(F.sum("grown"), 3).alias("grown"))


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' regions by place: how many agree in text and in box, and how many are missing in one."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("text"), F.min("l_quantity").alias("box"))
    second = table(spark, sf_dir, "lineitem").filter("l_suppkey % 5 <> 0").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("text2"), F.max("l_quantity").alias("box2"))
    both = paired(first, second, ["l_orderkey", "l_linenumber"])
    return both.groupBy("l_linenumber").agg(
        F.count_if(F.col("text") == F.col("text2")).alias("same_text"), F.count_if(F.col("box") == F.col("box2")).alias("same_box"), F.count_if(~F.col("matched")).alias("missing"), F.count("*").alias("n")
    )


def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's regions as one JSON document."""
    return _json(table(spark, sf_dir, "lineitem"))


def results_json_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of each page with its text, confidence, smallest box and polygon, as one JSON document."""
    # detection's rings are rectangles, so their boxes are their corners in order
    box = lambda r: g.ordered_corners(F.slice(_ring(r), 1, 4))
    return json_report(table(spark, sf_dir, "lineitem"), "l_orderkey", ALL, "l_returnflag", "l_discount", _ring, box)


def _json(lines: DataFrame) -> DataFrame:
    region = F.struct(F.col("l_linenumber").alias("region"), F.col("l_returnflag").alias("text"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(region)).alias("r")).select("l_orderkey", F.to_json("r").alias("json"))


def benchmark_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings as lines of key and value, six digits each."""
    told = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum((F.col("value") * 1000).cast("long")).alias("ms"))
    return told.select("event_type", F.format_string("[INFO] benchmark.%s=%.6f", "event_type", F.col("ms") / 1000).alias("line"))


def rec_target_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("w"), F.col("l_quantity").alias("h")).distinct()
    return pairs.select("w", "h", recognition_width(F.col("w"), F.col("h")).alias("width"))


def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part, the hull of its line items' quantity and price: corners, and which they are."""
    h = hulls(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", "l_extendedprice")
    return h.groupBy("key").agg(F.count("*").alias("corners"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def hull_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hulls(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice")


def min_area_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part, the smallest rectangle around its line items' quantity and price in thousands."""
    scaled = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    r = smallest_rectangles(hulls(scaled, "l_partkey", "l_quantity", "price"))
    names = [f"{c}_{axis}" for c in ("tl", "tr", "br", "bl") for axis in "xy"]
    return r.select("key", rounded("area", 3).alias("area"), *[rounded(F.get("quad", F.lit(k // 2))["xy"[k % 2]], 3).alias(n) for k, n in enumerate(names)])


QUERIES = {
    f.__name__: f
    for f in (
        convex_hull, hull_corners, min_area_quad,
        det_resize_dims_max, det_resize_dims_min, rec_width_and_batch_plan, restore_order, candidate_first_n, candidate_largest_n, region_validation,
        polygon_to_region, box_rescale, unrotate_points, corner_order, quad_metrics, unclip_rect, zip_assemble, missing_pairs, report_lines, rec_target_width,
        polygon_scale, ring_orientation, largest_polygon, legacy_regions, compare_runs, results_json, benchmark_lines, report_lines_all, results_json_all,
    )
}

_REC_WIDTH = "greatest(CASE WHEN {w}::DOUBLE / {h} > 320.0::DOUBLE / 48 THEN floor({w}::DOUBLE / {h} * 48) ELSE ceil({w}::DOUBLE / {h} * 48) END, 1)::INT"
_PLANNED = f"""
ranked AS (
  SELECT l_orderkey, {_ALL}, l_extendedprice / greatest(l_quantity, 1) AS aspect,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice / greatest(l_quantity, 1), {_ALL}) - 1 AS rank,
         {_REC_WIDTH.format(w="l_extendedprice", h="greatest(l_quantity, 1)")} AS width
  FROM lineitem
), batched AS (SELECT *, (rank // {{size}})::INT AS batch FROM ranked),
planned AS (
  SELECT *, (ceil(least(greatest(max(width) OVER (PARTITION BY l_orderkey, batch), 320), 3200) / 32.0) * 32)::INT AS batch_width FROM batched
)"""
_QUAD = """
c AS (SELECT l_orderkey, {all}, l_extendedprice / 100 AS x, l_quantity * 4 AS y, l_discount * 200 + 5 AS ux, l_tax * 300 AS uy FROM lineitem),
v AS (SELECT *, -uy * 0.5 AS vx, ux * 0.5 AS vy FROM c)""".format(all=_ALL)
_CORNERS = "[{i: %d, x: %s, y: %s}, {i: %d, x: %s, y: %s}, {i: %d, x: %s, y: %s}, {i: %d, x: %s, y: %s}]" % (
    0, "x + ux + vx", "y + uy + vy", 1, "x", "y", 2, "x + vx", "y + vy", 3, "x + ux", "y + uy",
)

#: Hulls of line items by a key, as hull (key, i, x, y).
_HULL = """e AS (SELECT {key} AS key, l_quantity AS x, min({y}) AS low, max({y}) AS high FROM lineitem GROUP BY ALL),
      under AS (SELECT key, x, low AS y FROM e WHERE NOT EXISTS (SELECT 1 FROM e a JOIN e b ON a.key = b.key AND a.key = e.key AND a.x < e.x AND b.x > e.x
        WHERE (b.x - a.x) * (e.low - a.low) - (b.low - a.low) * (e.x - a.x) >= 0)),
      over AS (SELECT key, x, high AS y FROM e WHERE NOT EXISTS (SELECT 1 FROM e a JOIN e b ON a.key = b.key AND a.key = e.key AND a.x < e.x AND b.x > e.x
        WHERE (b.x - a.x) * (e.high - a.high) - (b.high - a.high) * (e.x - a.x) <= 0)),
      turn AS (SELECT key, x, y, 0 AS side, x AS along, y AS up FROM under
        UNION ALL SELECT key, x, y, 1, -x, -y FROM over o WHERE NOT EXISTS (SELECT 1 FROM under u WHERE u.key = o.key AND u.x = o.x AND u.y = o.y)),
      hull AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY side, along, up) - 1)::INT AS i, x, y FROM turn)"""

ORACLE_SQL = {
    # a point is a corner unless it lies in a triangle or on a line of others: of the highest and lowest
    # of each x, those that no pair of points around them is level with or beyond
    "hull_corners": f"WITH {_HULL.format(key='l_suppkey', y='l_extendedprice')} SELECT * FROM hull",
    "convex_hull": f"""WITH {_HULL.format(key="l_partkey", y="l_extendedprice")}
      SELECT key, count(*) AS corners, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM hull GROUP BY key""",
    # every edge's rectangle, with the same operations in the same order as equal areas are common
    "min_area_quad": f"""WITH {_HULL.format(key="l_partkey", y="(l_extendedprice / 1000)")},
      n AS (SELECT key, count(*) AS n FROM hull GROUP BY key),
      g AS (SELECT a.key, a.i, n, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM hull a JOIN n ON n.key = a.key JOIN hull b ON b.key = a.key AND b.i = (a.i + 1) % n),
      d AS (SELECT *, CASE WHEN n < 3 THEN 1.0 ELSE dx / sqrt(dx * dx + dy * dy) END AS ux, CASE WHEN n < 3 THEN 0.0 ELSE dy / sqrt(dx * dx + dy * dy) END AS uy FROM g WHERE n >= 3 OR i = 0),
      m AS (SELECT d.key, d.i, ax, ay, ux, uy, min((p.x - ax) * ux + (p.y - ay) * uy) AS u0, max((p.x - ax) * ux + (p.y - ay) * uy) AS u1,
        min((p.y - ay) * ux - (p.x - ax) * uy) AS v0, max((p.y - ay) * ux - (p.x - ax) * uy) AS v1 FROM d JOIN hull p ON p.key = d.key GROUP BY ALL),
      r AS (SELECT *, (u1 - u0) * (v1 - v0) AS area FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY (u1 - u0) * (v1 - v0), i) = 1),
      l AS (SELECT key, area, list_sort([{", ".join(f"{{x: ax + ux * {u} - uy * {v}, i: {k}, y: ay + uy * {u} + ux * {v}}}" for k, (u, v) in enumerate((("u0", "v0"), ("u1", "v0"), ("u1", "v1"), ("u0", "v1"))))}]) AS q FROM r)
      SELECT key, round_even(area * 1000, 0) / 1000 AS area, {", ".join(
        f"round_even(CASE WHEN q[{b}].y > q[{a}].y THEN q[{a if up else b}].{axis} ELSE q[{b if up else a}].{axis} END * 1000, 0) / 1000 AS {name}_{axis}"
        for name, a, b, up in (("tl", 1, 2, True), ("tr", 3, 4, True), ("br", 3, 4, False), ("bl", 1, 2, False)) for axis in ("x", "y"))} FROM l""",
    "det_resize_dims_max": _sizes_sql(960, "max", 4000),
    "det_resize_dims_min": _sizes_sql(64, "min", 1200),
    "rec_width_and_batch_plan": f"""WITH {_PLANNED.format(size=3)}
      SELECT l_orderkey, rank::INT AS rank, batch, round_even(aspect * 10000, 0) / 10000 AS aspect, width, batch_width, round_even(least(width::DOUBLE / batch_width, 1) * 100000, 0) / 100000 AS valid_ratio,
      least(greatest(round(((80::FLOAT / batch_width::FLOAT) * least(width, batch_width)::FLOAT)::DOUBLE), 1), 80)::INT AS valid_steps FROM planned""",
    "restore_order": f"""WITH {_PLANNED.format(size=4)}
      SELECT l_orderkey, string_agg(l_linenumber || ':' || batch, ' ' ORDER BY {_ALL}, batch) AS restored, count(*) AS n FROM planned GROUP BY l_orderkey""",
    "candidate_first_n": f"SELECT l_orderkey, {_ALL} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ALL}) <= 3",
    "candidate_largest_n": f"""SELECT l_orderkey, {_ALL} FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * l_extendedprice DESC, {_ALL}) <= 2""",
    "region_validation": """WITH r AS (SELECT l_orderkey, CASE WHEN l_orderkey % 97 = 0 THEN 0 ELSE 60000 END AS width, floor(l_extendedprice)::BIGINT AS x,
      floor(l_quantity)::BIGINT AS y, l_partkey * 10 AS w, l_linenumber - 1 AS h FROM lineitem)
      SELECT CASE WHEN width <= 0 THEN 'empty_image' WHEN w = 0 OR h = 0 THEN 'empty_region'
        WHEN x >= width OR y >= 40 OR x + w > width OR y + h > 40 THEN 'out_of_bounds' ELSE 'ok' END AS status,
      count(*) AS regions, count(DISTINCT l_orderkey) AS pages FROM r GROUP BY 1""",
    "polygon_to_region": f"""WITH c AS (SELECT l_orderkey, {_ALL}, l_extendedprice / 20 - 30 AS x, l_quantity * 11.5 - 20 AS y FROM lineitem),
      a AS (SELECT *, greatest(floor(x), 0) AS x1, greatest(floor(y), 0) AS y1, least(ceil(x + l_discount * 900), 2500) AS x2,
        least(ceil(y + l_tax * 700), 500) AS y2 FROM c),
      b AS (SELECT *, CASE WHEN x2 <= x1 THEN least(x1 + 1, 2500) ELSE x2 END AS x3, CASE WHEN y2 <= y1 THEN least(y1 + 1, 500) ELSE y2 END AS y3 FROM a),
      d AS (SELECT *, CASE WHEN x3 <= x1 THEN 2499 ELSE x1 END AS xa, CASE WHEN x3 <= x1 THEN 2500 ELSE x3 END AS xb,
        CASE WHEN y3 <= y1 THEN 499 ELSE y1 END AS ya, CASE WHEN y3 <= y1 THEN 500 ELSE y3 END AS yb FROM b)
      SELECT l_orderkey, {_ALL}, least(xa, 2499)::INT AS x, least(ya, 499)::INT AS y,
        greatest(least(greatest(xb - xa, 1), 2500 - least(xa, 2499)), 1)::INT AS width, greatest(least(greatest(yb - ya, 1), 500 - least(ya, 499)), 1)::INT AS height FROM d""",
    "box_rescale": """SELECT least(greatest(round(l_quantity * (l_partkey / 64.0::DOUBLE)), 0), 900)::DOUBLE AS x,
      least(greatest(round(l_discount * 100 * (l_suppkey / 32.0::DOUBLE)), 0), 25)::DOUBLE AS y, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "unrotate_points": """WITH p AS (SELECT (l_linenumber % 4) * 90 AS angle, l_extendedprice AS x, l_quantity AS y FROM lineitem),
      q AS (SELECT angle, round(CASE angle WHEN 90 THEN 105000 - y WHEN 180 THEN 105000 - x WHEN 270 THEN y ELSE x END, 3) AS x,
        round(CASE angle WHEN 90 THEN x WHEN 180 THEN 60 - y WHEN 270 THEN 60 - x ELSE y END, 3) AS y FROM p)
      SELECT angle, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM q GROUP BY angle""",
    "corner_order": f"""WITH {_QUAD}, l AS (SELECT *, list_sort(list_transform({_CORNERS}, lambda p: {{x: p.x, i: p.i, y: p.y}})) AS q FROM v)
      SELECT l_orderkey, {_ALL}, {", ".join(
        f"round_even(CASE WHEN q[{b}].y > q[{a}].y THEN q[{a if up else b}].{axis} ELSE q[{b if up else a}].{axis} END * 1000, 0) / 1000 AS {name}_{axis}"
        for name, a, b, up in (("tl", 1, 2, True), ("tr", 3, 4, True), ("br", 3, 4, False), ("bl", 1, 2, False)) for axis in ("x", "y"))} FROM l""",
    "quad_metrics": f"""WITH {_QUAD}, s AS (SELECT *, [x, x + ux, x + ux + vx, x + vx] AS px, [y, y + uy, y + uy + vy, y + vy] AS py FROM v),
      e AS (SELECT *, list_transform([1, 2, 3, 4], lambda i: px[i] * py[i % 4 + 1] - px[i % 4 + 1] * py[i]) AS c,
        list_transform([1, 2, 3, 4], lambda i: sqrt((px[i % 4 + 1] - px[i]) ** 2 + (py[i % 4 + 1] - py[i]) ** 2)) AS d FROM s)
      SELECT l_orderkey, {_ALL}, round((c[1] + c[2] + c[3] + c[4]) / 2, 3) AS signed_area, round(d[1] + d[2] + d[3] + d[4], 3) AS perimeter,
        round(least(d[1], d[2]), 3) AS short_side FROM e""",
    "unclip_rect": f"""WITH s AS (SELECT l_orderkey, {_ALL}, l_extendedprice / 1000 AS w, l_quantity / 2 AS h FROM lineitem),
      g AS (SELECT *, w * h / (2 * w + 2 * h) * 1.5 AS d FROM s WHERE least(w, h) >= 3)
      SELECT l_orderkey, {_ALL}, round(d, 4) AS d, round(w + 2 * d, 4) AS gw, round(h + 2 * d, 4) AS gh FROM g WHERE least(w + 2 * d, h + 2 * d) >= 5""",
    "zip_assemble": """WITH l AS (SELECT l_orderkey AS key, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1)
      SELECT key, o_orderpriority, n, price, o_totalprice FROM orders JOIN l ON o_orderkey = key""",
    "missing_pairs": """WITH l AS (SELECT DISTINCT l_orderkey AS key FROM lineitem)
      SELECT o_orderkey IS NOT NULL AND key IS NOT NULL AS matched, o_orderkey IS NULL AS no_box, count(*) AS pages
      FROM orders FULL JOIN l ON o_orderkey = key GROUP BY ALL""",
    "report_lines": f"""WITH f AS (SELECT l_orderkey, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_orderkey) AS n,
        format('--- Region {{}} ---\nText: {{}}\nConfidence: {{:.3f}}\nPolygon: ({{:.1f}}, {{:.1f}}) -> ({{:.1f}}, {{:.1f}}) -> ({{:.1f}}, {{:.1f}}) -> ({{:.1f}}, {{:.1f}})', row_number() OVER w,
          l_returnflag, l_discount, {", ".join(f"({e})::DOUBLE" for e in ("l_partkey", "l_suppkey", "l_partkey + l_quantity", "l_suppkey", "l_partkey + l_quantity", "l_suppkey + 10", "l_partkey", "l_suppkey + 10"))}) AS line
      FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ALL}))
      SELECT l_orderkey, 'Detected ' || any_value(n) || ' text regions:' || chr(10) || string_agg(line, chr(10) ORDER BY k) AS report FROM f GROUP BY l_orderkey""",
    "report_lines_all": """WITH f AS (SELECT l_orderkey, l_linenumber, format('[{}] {} ({:.1f}%) at {:.2f}', l_linenumber, l_returnflag, floor(l_discount * 100), l_extendedprice) AS line FROM lineitem)
      SELECT l_orderkey, string_agg(line, chr(10) ORDER BY l_linenumber, line) AS report FROM f GROUP BY l_orderkey""",
    "results_json_all": f"""WITH f AS (SELECT l_orderkey, row_number() OVER w AS k, to_json({{text: l_returnflag, confidence: l_discount,
        box: [[l_partkey::DOUBLE, l_suppkey::DOUBLE], [l_partkey + l_quantity, l_suppkey::DOUBLE], [l_partkey + l_quantity, l_suppkey + 10.0::DOUBLE], [l_partkey::DOUBLE, l_suppkey + 10.0::DOUBLE]],
        polygon: [[l_partkey::DOUBLE, l_suppkey::DOUBLE], [l_partkey + l_quantity, l_suppkey::DOUBLE], [l_partkey + l_quantity, l_suppkey + 10.0::DOUBLE], [l_partkey::DOUBLE, l_suppkey + 10.0::DOUBLE]]}})::VARCHAR AS line
      FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ALL}))
      SELECT l_orderkey, '[' || string_agg(line, ',' ORDER BY k) || ']' AS json FROM f GROUP BY l_orderkey""",
    "polygon_scale": f"""WITH {_QUAD}, s AS (SELECT *, x + ux + vx AS x2, y + uy + vy AS y2 FROM v)
      SELECT l_orderkey, {_ALL}, {", ".join(f"round_even(least(greatest({e} / 0.5::DOUBLE, 0), {m}) * 100, 0) / 100 AS {n}" for n, e, m in (("x0", "x", 2048), ("y0", "y", 256), ("x2", "x2", 2048), ("y2", "y2", 256)))} FROM s""",
    "ring_orientation": f"""WITH {_QUAD}, s AS (SELECT *, l_linenumber % 2 = 0 AS back, ux * vy - uy * vx AS turn FROM v),
      o AS (SELECT *, CASE WHEN back THEN turn > 0 ELSE turn < 0 END AS clockwise FROM s)
      SELECT l_orderkey, {_ALL}, clockwise, round_even(CASE WHEN back AND NOT clockwise THEN x + ux + vx WHEN back THEN x + ux WHEN clockwise THEN x + ux + vx ELSE x + ux END * 1000, 0) / 1000 AS second_x,
        round_even(CASE WHEN back AND NOT clockwise THEN y + vy WHEN back THEN y WHEN clockwise THEN y + vy ELSE y END * 1000, 0) / 1000 AS last_y, 5 AS points FROM o""",
    "largest_polygon": f"""WITH r AS (SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity * floor(l_discount * 100) AS area, {_ALL} FROM lineitem)
      SELECT l_orderkey, n, area, {_ALL} FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC, {", ".join(c + " DESC" for c in ALL)}) = 1""",
    "legacy_regions": f"""WITH r AS (SELECT *, l_quantity * l_linenumber AS area FROM lineitem WHERE l_quantity * l_linenumber >= 10 AND least(l_discount * 12, 1) >= 0.6),
      k AS (SELECT l_orderkey, area * (1 + l_tax * 10) AS grown FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC, {_ALL}) <= 2)
      SELECT l_orderkey, count(*) AS regions, round_even(sum(grown) * 1000, 0) / 1000 AS grown FROM k WHERE grown >= 25 GROUP BY l_orderkey""",
    "compare_runs": """WITH a AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS text, min(l_quantity) AS box FROM lineitem GROUP BY 1, 2),
      b AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS text2, max(l_quantity) AS box2 FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2)
      SELECT l_linenumber, count(*) FILTER (text = text2) AS same_text, count(*) FILTER (box = box2) AS same_box, count(*) FILTER (text IS NULL OR text2 IS NULL) AS missing, count(*) AS n
      FROM a FULL JOIN b USING (l_orderkey, l_linenumber) GROUP BY l_linenumber""",
    "results_json": """SELECT l_orderkey, '[' || string_agg('{"region":' || l_linenumber || ',"text":"' || l_returnflag || '","x":' || l_partkey || ',"y":' || l_suppkey || '}',
      ',' ORDER BY l_linenumber, l_returnflag, l_partkey, l_suppkey) || ']' AS json FROM lineitem GROUP BY l_orderkey""",
    "benchmark_lines": """SELECT event_type, format('[INFO] benchmark.{}={:.6f}', event_type, sum(trunc(value * 1000)::BIGINT) / 1000.0::DOUBLE) AS line FROM events GROUP BY event_type""",
    "rec_target_width": f"""SELECT DISTINCT l_partkey AS w, l_quantity AS h, {_REC_WIDTH.format(w="l_partkey", h="l_quantity")} AS width FROM lineitem""",
}
