"""The older detection flow: outer borders of score maps, their mean scores by scan lines, and their growth by offset curves."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import area, unclip_distance
from foliospark.operators.borders import border_rows, traced
from foliospark.operators.regions import largest_candidates

RINGS = "array<struct<ring:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>>"
_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
#: Places closer than this share of a ring's extent are one.
NEAR = 1e-9
#: Pairs of edges that are looked at in one step.
PAIRS_AT_ONCE = 1 << 21
#: Points of rings that are moved out in one step.
POINTS_AT_ONCE = 1 << 16


def filled(points: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The pixels inside a ring of whole points (n, 2) and on its points, in the box around it: mask, x, y of its corner.

    An edge crosses the rows from its upper end to above its lower one. The crossings of a row are sorted,
    and the pixels between the first and the second, the third and the fourth and so on are inside.
    """
    low, high = points.min(0), points.max(0)
    w, h = high - low + 1
    a = points - low
    b = np.roll(a, -1, 0)
    mask = np.zeros((h, w), bool)
    up = np.where((a[:, 1] < b[:, 1])[:, None], a, b), np.where((a[:, 1] < b[:, 1])[:, None], b, a)
    rows = up[1][:, 1] - up[0][:, 1]  # the edge table: how many rows each edge crosses, from its upper end on
    edge = np.repeat(np.arange(len(a)), rows)
    y = up[0][edge, 1] + np.arange(len(edge)) - np.repeat(np.cumsum(rows) - rows, rows)
    t = (y - a[edge, 1]) / np.where(b[edge, 1] == a[edge, 1], 1, b[edge, 1] - a[edge, 1])
    x = a[edge, 0] + t * (b[edge, 0] - a[edge, 0])
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    start, stop = np.maximum(np.ceil(x[::2]).astype(int), 0), np.minimum(np.floor(x[1::2]).astype(int), w - 1)
    some = start <= stop
    steps = np.zeros((h, w + 1), int)
    np.add.at(steps, (y[::2][some], start[some]), 1)
    np.add.at(steps, (y[::2][some], stop[some] + 1), -1)
    mask |= np.cumsum(steps, 1)[:, :w] > 0
    mask[a[:, 1], a[:, 0]] = True
    return mask, int(low[0]), int(low[1])


def mean_inside(p: np.ndarray, points: np.ndarray) -> float:
    """The mean of a map, held within 0 and 1, over a ring's pixels; points beyond the map count at its edge. 0.0 without points."""
    if not len(points) or not p.size:
        return 0.0
    mask, x, y = filled(np.clip(points, 0, np.array(p.shape[::-1]) - 1))
    part = np.clip(p[y : y + mask.shape[0], x : x + mask.shape[1]].astype(float), 0, 1)
    return float(part[mask].mean())


def contour_scores(pages: DataFrame, values: str = "values") -> DataFrame:
    """Traced pages plus scores, the mean inside each of their borders."""
    names = pages.columns
    at = [names.index(n) for n in ("height", "width", values, "borders")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, w, v, borders in zip(*(batch.column(k) for k in at), strict=True):
                if not borders.is_valid:
                    rows.append(None)
                    continue
                p = v.values.to_numpy(zero_copy_only=False).reshape(h.as_py(), w.as_py())
                points = borders.values.field("points")
                rows.append([mean_inside(p, np.stack([r.values.field(c).to_numpy() for c in "xy"], 1).astype(int)) for r in points])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*names, "scores"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{schema}, scores array<double>")


def without_repeats(points: np.ndarray) -> np.ndarray:
    """A ring without points equal to the one before, turning from x to y."""
    return Rings(points, np.array([len(points)])).cleaned().points


class Rings:
    """Rings of any sizes one after another, so that one step of arrays does for all of them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = np.asarray(points, float).reshape(-1, 2), np.asarray(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        some = self.sizes > 0
        first, last = (self.ends - self.sizes)[some], self.ends[some] - 1
        at = np.arange(len(self.points))
        self.after, self.before = at + 1, at - 1
        self.after[last], self.before[first] = first, last
        self.ring = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over the points of each ring."""
        return np.bincount(self.ring, values, len(self.sizes))

    def of(self, k: int) -> np.ndarray:
        return self.points[self.ends[k] - self.sizes[k] : self.ends[k]]

    def cleaned(self) -> Rings:
        """The rings without points equal to the one before, turning from x to y."""
        kept = (self.points != self.points[self.before]).any(1)
        rings = Rings(self.points[kept], np.bincount(self.ring[kept], minlength=len(self.sizes)))
        x, y = rings.points.T
        back = (rings.sums(x * y[rings.after] - x[rings.after] * y) < 0)[rings.ring]
        ends = rings.ends[rings.ring]
        at = np.arange(len(x))
        return Rings(rings.points[np.where(back, 2 * ends - rings.sizes[rings.ring] - 1 - at, at)], rings.sizes)

    def convex(self) -> np.ndarray:
        """Whether each ring without repeats turns once around, never back."""
        d = self.points[self.after] - self.points
        e = d[self.after]
        turn = np.arctan2(d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0], (d * e).sum(1))
        return (self.sums(~((turn >= 0) & (turn < pi - 1e-9))) == 0) & (np.abs(self.sums(turn) - 2 * pi) < 1e-6)

    def moved_out(self, distance: np.ndarray, join: str, step: float) -> Rings:
        """The rings moved out by their distances, with their corners joined; they cross themselves where they turn inwards.

        With arcs each is the sum of the ring and a circle: it turns around a place as many times as the
        circle about that place has parts in common with what the ring encloses.

        join is round (an arc in steps of `step` radians at most), bevel (a straight line), or miter
        (the sides are prolonged, unless they meet at an angle below `step`).
        """
        u = self.points[self.after] - self.points
        u = u / np.hypot(*u.T)[:, None]
        n1 = np.stack([u[:, 1], -u[:, 0]], 1)
        n0 = n1[self.before]
        cross, dot = n0[:, 0] * n1[:, 1] - n0[:, 1] * n1[:, 0], (n0 * n1).sum(1)
        turn = np.arctan2(cross, dot)
        straight = (np.abs(cross) < 1e-12) & (dot > 0)
        inwards = (-pi + 1e-9 < turn) & (turn < 0)
        turn = np.where(inwards, turn, np.abs(turn))
        # inwards the arc is passed backwards: the loop there never ends up outside
        arc = ~straight & (inwards | (join == "round"))
        pointed = ~straight & ~arc & (join == "miter") & (pi - turn >= step)
        parts = np.where(arc, np.maximum(np.ceil(np.abs(turn) / step), 1), 1).astype(np.int64)
        count = np.where(straight | pointed, 1, parts + 1)
        corner = np.repeat(np.arange(len(count)), count)
        k = np.arange(len(corner)) - np.repeat(np.cumsum(count) - count, count)
        way = np.where((straight[corner] | (k > 0))[:, None], n1[corner], n0[corner])  # of a bevel: the ends of both sides
        some = np.flatnonzero(arc[corner])
        at = corner[some]
        angle = np.arctan2(n0[at, 1], n0[at, 0]) + turn[at] * k[some] / parts[at]
        way[some] = np.stack([np.cos(angle), np.sin(angle)], 1)
        tips = np.flatnonzero(pointed[corner])
        way[tips] = (n0[corner[tips]] + n1[corner[tips]]) / (1 + dot[corner[tips]])[:, None]
        return Rings(self.points[corner] + distance[self.ring[corner]][:, None] * way, np.bincount(self.ring[corner], minlength=len(self.sizes)))


def cut_edges(ring: np.ndarray) -> np.ndarray:
    """The edges of a ring cut wherever they meet: (m, 4) as x, y, x, y."""
    a, b = ring, np.roll(ring, -1, 0)
    n, d = len(ring), b - a
    near = NEAR * max(float(np.ptp(ring, 0).max()), 1.0)
    low, high = np.minimum(a, b) - near, np.maximum(a, b) + near
    cuts: list[list[np.ndarray]] = [[np.array([0.0, 1.0])] for _ in range(n)]
    rows = max(PAIRS_AT_ONCE // n, 1)
    for first in range(0, n, rows):
        s = slice(first, min(first + rows, n))
        meet = (low[s, None] <= high[None]).all(2) & (high[s, None] >= low[None]).all(2)
        i, j = np.nonzero(meet)
        i += first
        i, j = i[i < j], j[i < j]
        cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        gap = a[j] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, r = (gap[:, 0] * d[j, 1] - gap[:, 1] * d[j, 0]) / cross, (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / cross
        real = (np.abs(cross) > 1e-14) & (t > -NEAR) & (t < 1 + NEAR) & (r > -NEAR) & (r < 1 + NEAR)
        for x, at in ((i, t), (j, r)):  # an edge isn't cut at its own ends
            for k in np.flatnonzero(real & (at > NEAR) & (at < 1 - NEAR)):
                cuts[x[k]].append(at[k : k + 1])
        for x, y in ((i, j), (j, i)):  # ends that lie on another edge, along which no crossing is found
            size = (d[x] ** 2).sum(1)
            for end in (a, b):
                rel = end[y] - a[x]
                along = (rel * d[x]).sum(1) / size
                off = np.abs(rel[:, 0] * d[x, 1] - rel[:, 1] * d[x, 0]) / np.sqrt(size)
                for k in np.flatnonzero((off < near) & (along > 0) & (along < 1)):
                    cuts[x[k]].append(along[k : k + 1])
    whole = np.array([len(c) == 1 for c in cuts])
    parts = [np.concatenate([a[whole], b[whole]], 1)]
    for k in np.flatnonzero(~whole):
        at = np.unique(np.clip(np.concatenate(cuts[k]), 0, 1))
        p = a[k] + at[:, None] * d[k]
        parts.append(np.concatenate([p[:-1], p[1:]], 1))
    edges = np.concatenate(parts)
    return edges[np.hypot(edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]) > near]


def turns_around(at: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """How often a ring turns around each place: its winding numbers."""
    a, b = ring, np.roll(ring, -1, 0)
    out = np.zeros(len(at), int)
    rows = max(PAIRS_AT_ONCE // len(ring), 1)
    for first in range(0, len(at), rows):
        x, y = at[first : first + rows, :1], at[first : first + rows, 1:]
        side = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
        out[first : first + rows] = ((a[:, 1] <= y) & (b[:, 1] > y) & (side > 0)).sum(1) - ((a[:, 1] > y) & (b[:, 1] <= y) & (side < 0)).sum(1)
    return out


def outlines(ring: np.ndarray) -> list[np.ndarray]:
    """The borders of what a ring turns around a positive number of times: outer ones with positive area, holes with negative."""
    edges = cut_edges(ring)
    scale = max(float(np.ptp(ring, 0).max()), 1.0)
    d = edges[:, 2:] - edges[:, :2]
    beside = np.stack([-d[:, 1], d[:, 0]], 1) / np.hypot(*d.T)[:, None] * scale * 1e-7
    middle = (edges[:, :2] + edges[:, 2:]) / 2
    edges = edges[(turns_around(middle + beside, ring) > 0) & (turns_around(middle - beside, ring) <= 0)]
    key = np.rint(edges / (scale * 1e-6)).astype(np.int64)
    _, first = np.unique(key, axis=0, return_index=True)
    edges, key = edges[np.sort(first)], key[np.sort(first)]
    leaving: dict[tuple[int, int], list[int]] = {}
    for k, e in enumerate(key):
        leaving.setdefault((e[0], e[1]), []).append(k)
    rings, open_ = [], np.ones(len(edges), bool)
    for k in range(len(edges)):
        chain, at = [], k
        while open_[at]:
            open_[at] = False
            chain.append(edges[at, :2])
            came = edges[at, 2:] - edges[at, :2]
            on = [j for j in leaving.get((key[at, 2], key[at, 3]), []) if open_[j]]
            if not on:
                break
            # where several leave, the one furthest to the right, so that borders that touch stay apart
            turn = [np.arctan2(came[0] * e[1] - came[1] * e[0], came @ e) for e in (edges[j, 2:] - edges[j, :2] for j in on)]
            at = on[int(np.argmin(turn))]
        if len(chain) > 2:
            rings.append(np.array(chain))
    return rings


def ring_area(ring: np.ndarray) -> float:
    x, y = ring.T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def grown_ring(points: np.ndarray, distance: float, join: str = "round", step: float = 0.1) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """What lies inside a ring or within a distance of it, as outer rings with the holes left in each.

    Without a distance, or with fewer than three points, the ring stays as it is.
    """
    points = np.asarray(points, float).reshape(-1, 2)
    return grown_all(points, np.array([len(points)]), np.array([float(distance)]), join, step)[0]


def grown_all(points: np.ndarray, sizes: np.ndarray, distance: np.ndarray, join: str, step: float) -> list[list[tuple[np.ndarray, list[np.ndarray]]]]:
    """grown_ring of rings of so many points each, one after another: all are moved out at once, and those that turn back are looked through one by one."""
    given = Rings(points, sizes)
    rings = given.cleaned()
    stays = (distance <= 1e-12) | (rings.sizes < 3)
    rings = Rings(rings.points[~stays[rings.ring]], rings.sizes[~stays])
    curves, convex = rings.moved_out(distance[~stays], join, max(step, 0.01)), rings.convex()
    at = np.cumsum(~stays) - 1
    out = []
    for k in range(len(sizes)):
        if stays[k]:
            out.append([(given.of(k), [])])
        elif convex[at[k]]:
            out.append([(curves.of(at[k]), [])])  # which never crosses itself
        else:
            out.append(uncrossed(curves.of(at[k])))
    return out


def uncrossed(curve: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """The outer rings of what a ring moved out encloses, with the holes in each."""
    found = outlines(curve)
    outer = sorted((r for r in found if ring_area(r) > 0), key=ring_area)
    grown = [(r, []) for r in outer]
    for hole in (r for r in found if ring_area(r) < 0):
        for r, holes in grown:  # from the smallest on
            if turns_around(hole[:1], r)[0] > 0:
                holes.append(hole)
                break
    return grown


def grown_rings(rows: DataFrame, ring: str, distance: Column, join: str = "round", step: float = 0.1) -> DataFrame:
    """rows plus grown: the outlines of each ring moved out by a distance, with round, bevelled or mitred corners."""
    if join not in ("round", "bevel", "miter"):
        raise ValueError(f"join is {join!r}, not round, bevel or miter")
    names = rows.columns
    given = rows.withColumn("_distance", distance.cast("double"))
    at = names.index(ring)

    def nested(rings: list[np.ndarray]) -> pa.Array:
        """Rings as an array of lists of points."""
        flat = np.concatenate([np.empty((0, 2)), *rings])
        points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(_RING.value_type))
        return pa.ListArray.from_arrays(pa.array(ends([len(r) for r in rings])), points)

    def ends(sizes: list[int]) -> np.ndarray:
        return np.cumsum([0, *sizes], dtype=np.int32)

    def told(found: list[list], missing: np.ndarray) -> pa.Array:
        polygons = [p for row in found for p in row]
        holes = pa.ListArray.from_arrays(pa.array(ends([len(h) for _, h in polygons])), nested([h for _, holes in polygons for h in holes]))
        each = pa.StructArray.from_arrays([nested([r for r, _ in polygons]), holes], ["ring", "holes"])
        return pa.ListArray.from_arrays(pa.array(ends([len(row) for row in found])), each, mask=pa.array(missing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            while first < batch.num_rows:  # as many rows as have POINTS_AT_ONCE points, one at least
                sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)[first:]
                n = max(int(np.searchsorted(np.cumsum(sizes), POINTS_AT_ONCE, side="right")), 1)
                part, sizes = batch.slice(first, n), sizes[:n]
                first += n
                points = part.column(at).flatten()
                missing = np.array(part.column(at).is_null()) | np.array(part.column(len(names)).is_null())
                flat = np.stack([pc.struct_field(points, c).to_numpy(zero_copy_only=False) for c in "xy"], 1).astype(float)
                by = pc.fill_null(part.column(len(names)), 0.0).to_numpy(zero_copy_only=False)
                found = grown_all(flat, sizes, by, join, step)
                found = [[] if m else f for f, m in zip(found, missing, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], told(found, missing)], [*names, "grown"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return given.mapInArrow(run, f"{schema}, grown {RINGS}")


def polygon_area(polygon: Column) -> Column:
    """The area of an outer ring less its holes."""
    return area(polygon["ring"]) - F.aggregate(polygon["holes"], F.lit(0.0), lambda total, h: total + area(h))


def contour_regions(
    maps: DataFrame, image: str = "image", threshold: float = 0.3, min_area: float = 10.0, box_threshold: float = 0.6, max_candidates: int = 1000,
    unclip_ratio: float = 1.5, min_result_area: float = 25.0, join: str = "round", step: float = 0.1,
) -> DataFrame:
    """Text regions of score maps by the older rules: image, region, score, area, polygon (ring and holes), error.

    Outer borders of pixels at the threshold or above, of three points and min_area at least; of
    these the max_candidates largest of a page (0: all), with a mean score of box_threshold; grown
    by area / perimeter * unclip_ratio, and dropped below min_result_area. A page with an error, or
    without regions, keeps a row of nulls.
    """
    pages = contour_scores(traced(maps.select(image, "height", "width", "values"), threshold, inclusive=True)).withColumnRenamed(image, "image")
    rows = border_rows(pages.withColumn("borders", F.arrays_zip("borders", "scores")), "image")
    rows = rows.select("image", "border", "scores", "borders.*").withColumnRenamed("scores", "score")
    whole = area(F.col("points"))
    found = rows.filter(~F.col("hole") & (F.size("points") >= 3)).withColumn("area", whole).filter(F.col("area") >= max(min_area, 0.0))
    found = largest_candidates(found, "image", "area", ["border"], max_candidates)
    limit = min(max(box_threshold, 0.0), 1.0)
    if limit > 0:
        found = found.filter(F.col("score") >= limit)
    grown = grown_rings(found.select("image", F.col("border").alias("region"), "score", "area", "points"), "points", unclip_distance(F.col("points"), max(unclip_ratio, 0.0)), join, step)
    polygons = grown.select("image", "region", "score", "area", F.explode("grown").alias("polygon")).filter(polygon_area(F.col("polygon")) >= min_result_area)
    return pages.select("image", F.col("border_error").alias("error")).join(polygons, "image", "left")
