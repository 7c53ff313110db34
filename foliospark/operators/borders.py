"""Borders of score maps by border following, a page in a row: outer borders and borders of holes, with their parents."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.quads import chain

#: The eight neighbours of a pixel, clockwise from the right where y grows downwards.
AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
BORDER = "struct<hole:boolean,parent:int,points:array<struct<x:int,y:int>>,hull:array<struct<x:double,y:double>>>"
_POINT = pa.struct([("x", pa.int32()), ("y", pa.int32())])
_CORNER = pa.struct([("x", pa.float64()), ("y", pa.float64())])


class Border(NamedTuple):
    """A closed border: whether it is a hole's, the border around it (-1: none), and its pixels (x, y) in order."""

    hole: bool
    parent: int
    points: list[tuple[int, int]]


def trace(hot: np.ndarray) -> list[Border]:
    """All borders of a mask's components of touching pixels (corners included), by Suzuki and Abe's border following.

    Borders come in the order in which a scan by rows meets their first pixels. Beyond the mask
    everything is background. Pixels are visited along borders only.
    """
    edged = np.zeros((hot.shape[0] + 2, hot.shape[1] + 2), bool)
    edged[1:-1, 1:-1] = hot
    width = edged.shape[1]
    beside = np.zeros_like(edged)
    beside[:, 1:-1] = ~(edged[:, :-2] & edged[:, 2:])
    marks = edged.astype(np.uint8).ravel().tolist()  # as one list, whose places are read far faster than an array's
    around = Around(width)
    found: list[Border] = []
    # marks never become 0 or leave it, so where borders can begin is known before
    for at in np.flatnonzero(edged & beside).tolist():
        mark = marks[at]
        if mark == 1 and marks[at - 1] == 0:
            hole, side = False, 4
        elif mark >= 1 and marks[at + 1] == 0:
            hole, side = True, 0
        else:
            continue
        # the border last met in the row: its own kind shares the parent, the other kind is the parent
        seen, begin = at, at - at % width
        while seen > begin and -2 < marks[seen] < 2:
            seen -= 1
        last = max(abs(marks[seen]) - 2, -1)
        parent = last if last < 0 or found[last].hole != hole else found[last].parent
        found.append(Border(hole, parent, [(p % width - 1, p // width - 1) for p in follow(marks, around, at, side, len(found) + 2)]))
    return found


class Around:
    """The neighbours of a place in a list of rows of one width."""

    def __init__(self, width: int):
        self.steps = [dy * width + dx for dy, dx in AROUND]
        #: By the step to the pixel before: the steps counter-clockwise from it, and whether each is to the right.
        self.after = {step: [(self.steps[(k - d) % 8], (k - d) % 8 == 0) for d in range(1, 9)] for k, step in enumerate(self.steps)}


def follow(marks: list[int], around: Around, start: int, side: int, number: int) -> list[int]:
    """The places of the border at `start`, beside the background at neighbour `side`; marks them with the border's number.

    The number is negative where the pixel to the right is background that was passed.
    """
    for k in range(8):  # clockwise to the first pixel of the component
        before = start + around.steps[(side + k) % 8]
        if marks[before]:
            break
    else:
        marks[start] = -number
        return [start]
    first, at, points = before, start, []
    while True:
        points.append(at)
        passed = False
        for step, right in around.after[before - at]:
            after = at + step
            if marks[after]:
                break
            passed = passed or right
        if passed:
            marks[at] = -number
        elif marks[at] == 1:
            marks[at] = number
        if after == start and at == first:
            return points
        before, at = at, after


def hull_of(points: list[tuple[int, int]]) -> list[tuple[float, float]]:
    """The corners of the convex hull in turning order from the leftmost."""
    ends: dict[int, tuple[int, int]] = {}  # a corner is the first or the last of its line
    for x, y in points:
        low, high = ends.get(y, (x, x))
        ends[y] = (x, high) if x < low else (low, x) if x > high else (low, high)
    ordered = sorted({(float(x), float(y)) for y, both in ends.items() for x in both})
    return ordered if len(ordered) < 3 else chain(ordered)[:-1] + chain(ordered[::-1])[:-1]


def map_error(values: pa.Scalar, height: int | None, width: int | None) -> str | None:
    """What is wrong with a map, or None: no pixels, or values that don't fit its size."""
    if not height or not width or height < 0 or width < 0:
        return "empty_map"
    return None if values.is_valid and len(values.values) == height * width else "size"


def traced(maps: DataFrame, threshold: float, inclusive: bool = False, values: str = "values") -> DataFrame:
    """maps plus borders (an array of BORDER in scan order) and border_error.

    maps has height, width and row-major values. A pixel is hot above the threshold, which is held
    within 0 and 1; with `inclusive` (the older rule) at the threshold too. A map without pixels,
    or whose values don't fit its size, keeps its row with an error and null borders.
    """
    names = maps.columns
    at = [names.index(n) for n in ("height", "width", values)]
    limit = min(max(threshold, 0.0), 1.0)
    kind = pa.list_(pa.struct([("hole", pa.bool_()), ("parent", pa.int32()), ("points", pa.list_(_POINT)), ("hull", pa.list_(_CORNER))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            for h, w, v in zip(*(batch.column(k) for k in at), strict=True):
                h, w = h.as_py(), w.as_py()
                errors.append(map_error(v, h, w))
                if errors[-1]:
                    rows.append(None)
                    continue
                p = v.values.to_numpy(zero_copy_only=False).reshape(h, w)
                hot = np.clip(p, 0, 1) >= limit if inclusive else p > limit
                rows.append([
                    {"hole": b.hole, "parent": b.parent, "points": [{"x": x, "y": y} for x, y in b.points], "hull": [{"x": x, "y": y} for x, y in hull_of(b.points)]} for b in trace(hot)
                ])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind), pa.array(errors, pa.string())], [*names, "borders", "border_error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in maps.schema)
    return maps.mapInArrow(run, f"{schema}, borders array<{BORDER}>, border_error string")


def border_rows(pages: DataFrame, *keys: str) -> DataFrame:
    """A row per border of traced pages: keys, border (its number), hole, parent, points, hull."""
    return pages.select(*keys, F.posexplode("borders").alias("border", "_b")).select(*keys, "border", "_b.*")
