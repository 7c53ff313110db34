"""Polygons and boxes as Column expressions; a point is a struct of x and y, a ring an array of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.numbers import clamp, rounded


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edge_sum(points: Column | list[tuple[Column, Column]], term) -> Column:
    """The sum of term(a, b) over the edges of a ring, the closing one included.

    A ring whose corners are known one by one may be given as a list of them: its sum is plain arithmetic then.
    """
    if isinstance(points, list):
        at = [{"x": x.cast("double"), "y": y.cast("double")} for x, y in points]
        return sum((term(a, b) for a, b in zip(at, at[1:] + at[:1], strict=True)), F.lit(0.0))

    def whole(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda a, i: term(a, F.get(p, F.pmod(i + 1, F.size(p))))), F.lit(0.0), lambda total, x: total + x)

    # the optimizer puts a ring's derivation wherever it is named: in each step over each corner, were it not bound
    return let(points, whole)


def signed_area(points: Column | list[tuple[Column, Column]]) -> Column:
    """Half the shoelace sum: positive where the ring turns from x to y."""
    return edge_sum(points, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def area(points: Column | list[tuple[Column, Column]]) -> Column:
    return F.abs(signed_area(points))


def perimeter(points: Column | list[tuple[Column, Column]]) -> Column:
    return edge_sum(points, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))


def unclip_distance(points: Column | list[tuple[Column, Column]], ratio: float) -> Column:
    """How far to grow a ring: area / perimeter * ratio, 0 for a ratio or perimeter of 0."""

    def by(size: Column, around: Column) -> Column:
        return F.when((around > 1e-12) & (F.lit(ratio) > 0), size / around * ratio).otherwise(0.0)

    if isinstance(points, list):
        return let(perimeter(points), lambda around: by(area(points), around))
    return let(points, lambda p: let(perimeter(p), lambda around: by(area(p), around)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def short_side(quad: Column) -> Column:
    """The shorter of a quad's first two sides."""
    corner = lambda q, k: F.get(q, F.lit(k))
    return let(quad, lambda q: F.least(distance(corner(q, 0), corner(q, 1)), distance(corner(q, 1), corner(q, 2))))


def ordered_corners(quad: Column) -> Column:
    """Four corners as top left, top right, bottom right, bottom left.

    They're sorted by x (ties keep their order); of the left pair, and of the right pair, the one
    with the smaller y is on top, the second of the pair if they're level.
    """
    at = F.transform(F.array_sort(F.transform(quad, lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y")))), lambda p: point(p["x"], p["y"]))

    def pair(a: Column, b: Column) -> tuple[Column, Column]:
        lower = b["y"] > a["y"]
        return F.when(lower, a).otherwise(b), F.when(lower, b).otherwise(a)

    def ordered(p: Column) -> Column:
        c = [F.get(p, F.lit(k)) for k in range(4)]
        (tl, bl), (tr, br) = pair(c[0], c[1]), pair(c[2], c[3])
        return F.array(tl, tr, br, bl)

    return let(at, ordered)


def smallest_rectangle(hull: Column) -> Column:
    """The rectangle of least area around a convex hull in turning order: a struct of area and quad (tl, tr, br, bl).

    One side lies along an edge of the hull; of equal areas the first edge's rectangle is taken.
    Hulls of one or two points give the upright rectangle around them.
    """
    return let(hull, _smallest_rectangle)


def _smallest_rectangle(hull: Column) -> Column:
    n = F.size(hull)

    def measured(a: Column, k: Column) -> Column:
        def along(b: Column) -> Column:
            length = distance(a, b)
            return point(F.when(n < 3, 1.0).otherwise(F.try_divide(b["x"] - a["x"], length)), F.when(n < 3, 0.0).otherwise(F.try_divide(b["y"] - a["y"], length)))

        def sides(d: Column) -> Column:
            du = F.transform(hull, lambda p: (p["x"] - a["x"]) * d["x"] + (p["y"] - a["y"]) * d["y"])
            dv = F.transform(hull, lambda p: (p["y"] - a["y"]) * d["x"] - (p["x"] - a["x"]) * d["y"])
            ends = F.struct(F.array_min(du).alias("u0"), F.array_max(du).alias("u1"), F.array_min(dv).alias("v0"), F.array_max(dv).alias("v1"))
            return let(ends, lambda e: F.struct(
                ((e["u1"] - e["u0"]) * (e["v1"] - e["v0"])).alias("area"), k.alias("k"), e.alias("e"), d.alias("d"), point(a["x"], a["y"]).alias("a")
            ))

        return let(let(F.get(hull, F.pmod(k + 1, n)), along), sides)

    def quad(r: Column) -> Column:
        corner = lambda u, v: point(
            r["a"]["x"] + r["d"]["x"] * r["e"][u] - r["d"]["y"] * r["e"][v], r["a"]["y"] + r["d"]["y"] * r["e"][u] + r["d"]["x"] * r["e"][v]
        )
        corners = F.array(corner("u0", "v0"), corner("u1", "v0"), corner("u1", "v1"), corner("u0", "v1"))
        return F.struct(r["area"].alias("area"), let(corners, ordered_corners).alias("quad"))

    return let(F.array_min(F.filter(F.transform(hull, measured), lambda r: r["area"].isNotNull())), quad)


def crosses(px: Column, py: Column, corners: list[tuple[Column, Column]]) -> list[Column]:
    """The cross products of a point with the edges of a closed list of corners."""
    found = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        found.append((bx - ax) * (py - ay) - (by - ay) * (px - ax))
    return found


def in_quad(px: Column, py: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Whether a point is on one side of all edges of a convex quad; on an edge counts as inside."""
    found = crosses(px, py, corners)
    left, right = F.lit(False), F.lit(False)
    for c in found:
        left = left | (c >= 1e-9)
        right = right | (c <= -1e-9)
    return ~(left & right)


def text_region(min_x: Column, min_y: Column, max_x: Column, max_y: Column, width: Column, height: Column) -> Column:
    """The whole pixels of a box inside an image, one pixel at least: x, y, width, height."""

    def span(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
        limit = F.greatest(size, F.lit(1)).cast("double")
        a, b = F.greatest(F.floor(low).cast("double"), F.lit(0.0)), F.least(F.ceil(high).cast("double"), limit)
        b = F.when(b <= a, F.least(a + 1, limit)).otherwise(b)
        outside = b <= a
        a, b = F.when(outside, F.greatest(limit - 1, F.lit(0.0))).otherwise(a), F.when(outside, limit).otherwise(b)
        start = F.least(a, limit - 1)
        return start.cast("int"), F.greatest(F.least(F.greatest(b - a, F.lit(1.0)), limit - start), F.lit(1.0)).cast("int")

    (x, w), (y, h) = span(min_x, max_x, width), span(min_y, max_y, height)
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def rescaled(x: Column, scale: Column, size: Column) -> Column:
    """A coordinate times a scale, rounded half away from zero, within an image and its far edge."""
    return clamp(F.round(x * scale), 0.0, size.cast("double"))


def unrotated(x: Column, y: Column, angle: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point of a page turned counter-clockwise by angle, on the page as it was (width x height)."""
    turn = F.pmod(angle, F.lit(360))
    pick = lambda a, b, c, d: F.when(turn == 90, a).when(turn == 180, b).when(turn == 270, c).otherwise(d)
    return pick(width - y, width - x, y, x), pick(x, height - y, height - x, y)


def unrotated_ring(points: Column, angle: Column, width: Column, height: Column) -> Column:
    """A ring of a page turned counter-clockwise by angle, on the page as it was (width x height)."""
    return F.transform(points, lambda p: point(*unrotated(p["x"], p["y"], angle, width, height)))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where both are empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = size(a) + size(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def scaled_ring(points: Column, scale: float, width: float | None = None, height: float | None = None, digits: int = 2) -> Column:
    """A ring divided by a uniform scale, kept inside an image if its size is given, to so many digits."""

    def side(v: Column, size: float | None) -> Column:
        v = v / scale
        return rounded(v if size is None else clamp(v, 0.0, float(size)), digits)

    return F.transform(points, lambda p: point(side(p["x"], width), side(p["y"], height)))


def closed(points: Column) -> Column:
    """A ring with its first point at the end too; null for fewer than three points."""
    first, last = F.get(points, F.lit(0)), F.element_at(points, -1)
    same = (first["x"] == last["x"]) & (first["y"] == last["y"])
    return F.when(F.size(points) >= 3, F.when(same, points).otherwise(F.concat(points, F.array(first))))


def turned(points: Column, counter_clockwise: bool = True) -> Column:
    """A ring in the order that gives its signed area the wanted sign; a ring without area stays."""
    wrong = signed_area(points) < 0 if counter_clockwise else signed_area(points) > 0
    return F.when(wrong, F.reverse(points)).otherwise(points)
