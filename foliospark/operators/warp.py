"""Upright crops of turned boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From this ratio of height to width on, a crop is a column of text and is turned.
UPRIGHT_RATIO = 1.5
#: Pixels of a crop that are made in one step, and pixels of crops that are given on at once.
PIXELS_AT_ONCE, GIVEN_AT_ONCE = 1 << 15, 1 << 20


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The projective map that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def cubic_weights(f: np.ndarray) -> np.ndarray:
    """The four weights of Catmull-Rom's cubic at a fraction."""
    return np.stack([((-0.5 * f + 1) * f - 0.5) * f, (1.5 * f - 2.5) * f * f + 1, ((-1.5 * f + 2) * f + 0.5) * f, (0.5 * f - 0.5) * f * f])


def _places(quad: np.ndarray) -> np.ndarray | None:
    """Where on the image the pixels of a quad's content are: (2, height, width); None where the quad has no area."""
    side = lambda a, b: np.hypot(*(quad[a] - quad[b]))
    w, h = max(int(max(side(0, 1), side(3, 2))), 1), max(int(max(side(0, 3), side(1, 2))), 1)
    try:
        m = homography(np.array([(0, 0), (w, 0), (w, h), (0, h)], float), quad)
    except np.linalg.LinAlgError:
        return None
    at = np.ones((3, h, w))
    at[0], at[1] = np.arange(w), np.arange(h)[:, None]
    at = np.dot(m, at.reshape(3, h * w))
    at[2][np.abs(at[2]) < 1e-12] = 1e-12
    return (at[:2] / at[2]).reshape(2, h, w)


def warps(image: np.ndarray, quads: np.ndarray | list[np.ndarray]) -> Iterator[np.ndarray | None]:
    """The content of each quad as an upright image, bicubic and 0 outside; None where a quad has no area. The image may have channels.

    Small quads are made together.
    """
    # with margins, whose values are 0, a pixel far outside has neighbours as well
    edge = 4
    wide = np.zeros((image.shape[0] + 2 * edge, image.shape[1] + 2 * edge, *image.shape[2:]), image.dtype)
    wide[edge:-edge, edge:-edge] = image
    flat, line = np.ascontiguousarray(wide.reshape(wide.shape[0] * wide.shape[1], -1).T), wide.shape[1]  # a channel at a time is the faster way

    def made(places: list[np.ndarray | None]) -> Iterator[np.ndarray | None]:
        us, vs = (np.concatenate([np.empty(0), *(p[k].ravel() for p in places if p is not None)]) for k in (0, 1))
        out = np.zeros((len(flat), len(us)))
        for first in range(0, len(us), PIXELS_AT_ONCE):
            s = slice(first, first + PIXELS_AT_ONCE)
            x0, y0 = np.floor(us[s]).astype(int), np.floor(vs[s]).astype(int)
            wx, wy = cubic_weights(us[s] - x0), cubic_weights(vs[s] - y0)
            at = (np.clip(y0, 1 - edge, image.shape[0] + 1) + edge - 1) * line + np.clip(x0, 1 - edge, image.shape[1] + 1) + edge - 1
            part = out[:, s]
            for j in range(4):
                for i in range(4):
                    part += flat.take(at + (j * line + i), 1) * wx[i] * wy[j]
        done = 0
        for p in places:
            if p is None:
                yield None
                continue
            h, w = p.shape[1:]
            crop = out[:, done : done + h * w].T.reshape(h, w, *image.shape[2:])
            done += h * w
            yield np.rot90(crop) if h / w >= UPRIGHT_RATIO else crop

    held, pixels = [], 0
    for quad in quads:
        held.append(_places(quad))
        pixels += 0 if held[-1] is None else held[-1][0].size
        if pixels >= PIXELS_AT_ONCE:
            yield from made(held)
            held, pixels = [], 0
    yield from made(held)


def warp(image: np.ndarray, quad: np.ndarray) -> np.ndarray | None:
    """One quad's content, as by warps."""
    (made,) = warps(image, [quad])
    return made


def page_crops(pages: DataFrame) -> DataFrame:
    """A crop per quad of pages (image, height, width, values, quads: an array with region and quad, of four points): image, region, height, width, values, error.

    A page comes to its task once, with all its quads. A quad without area gives an error instead of a crop.
    """
    given = pages.select(
        "image", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "values", F.transform("quads", lambda b: b["region"]).alias("regions"),
        F.flatten(F.transform("quads", lambda b: F.flatten(F.transform(b["quad"], lambda p: F.array(p["x"], p["y"]))))).alias("corners"),
    )
    kinds = {k: given.schema[k].dataType for k in ("image", "regions")}

    def told(images: pa.Array, regions: pa.Array, crops: list[np.ndarray | None]) -> pa.RecordBatch:
        missing = np.array([c is None for c in crops])
        side = lambda k: pa.array([None if c is None else c.shape[k] for c in crops], pa.int32())
        ends = np.cumsum([0, *(0 if c is None else c.size for c in crops)]).astype(np.int32)
        flat = np.concatenate([np.empty(0), *(c.ravel() for c in crops if c is not None)])
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(missing))
        errors = pa.array(np.where(missing, "no area", None).tolist(), pa.string())
        return pa.RecordBatch.from_arrays([images, regions, side(0), side(1), values, errors], ["image", "region", "height", "width", "values", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images, regions = batch.column(0), batch.column(4)
            count = pc.fill_null(pc.list_value_length(regions), 0).to_numpy(zero_copy_only=False)
            region, corners = regions.flatten(), batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 2)
            rows, crops, pixels, done = [], [], 0, 0
            for k in np.flatnonzero(count).tolist():
                h, w, v = (batch.column(c)[k] for c in (1, 2, 3))
                image = v.values.to_numpy(zero_copy_only=False).astype(float).reshape(h.as_py(), w.as_py())
                at = done + len(rows)
                for crop in warps(image, corners[at : at + count[k]]):
                    crops.append(crop)
                    rows.append(k)
                    pixels += 0 if crops[-1] is None else crops[-1].size
                    if pixels >= GIVEN_AT_ONCE:
                        yield told(images.take(pa.array(rows)), region[done : done + len(rows)], crops)
                        done += len(rows)
                        rows, crops, pixels = [], [], 0
            if rows:
                yield told(images.take(pa.array(rows)), region[done:], crops)

    return given.mapInArrow(run, f"image {kinds['image'].simpleString()}, region {kinds['regions'].elementType.simpleString()}, height int, width int, values array<double>, error string")


def perspective_crops(images: DataFrame, quads: DataFrame) -> DataFrame:
    """A crop per quad: image, region, height, width, values, error.

    images has image, height, width, values; quads has image, region, quad (four points). An
    image's quads are gathered and joined to it once; page_crops makes the crops.
    """
    gathered = quads.groupBy("image").agg(F.collect_list(F.struct("region", "quad")).alias("quads"))
    return page_crops(images.select("image", "height", "width", "values").join(gathered, "image"))
