"""Whole images as arrays inside a task: resizing, normalising and cutting what the models see."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from foliospark.operators.warp import warps


def unpacked(pixels: bytes | None, height: int | None, width: int | None) -> np.ndarray | None:
    """Packed rows of BGR bytes as (height, width, 3); None where they don't fit the size."""
    if pixels is None or not height or not width or height < 0 or width < 0 or len(pixels) != 3 * height * width:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 3)


@lru_cache(1024)
def taps(to: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two source places of each place and the second one's weight, for pixel centres and repeated borders."""
    s = (np.arange(to) + 0.5) * (size / to) - 0.5
    low = np.floor(s).astype(int)
    first = np.clip(low, 0, size - 1)
    return first, np.minimum(first + 1, size - 1), np.where((low >= 0) & (low < size - 1), s - low, 0.0)


def bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize to bytes, halves rounded up; what detection and recognition see."""
    if (height, width) == image.shape[:2]:
        return image
    (y0, y1, fy), (x0, x1, fx) = taps(height, image.shape[0]), taps(width, image.shape[1])
    planes, fy = np.ascontiguousarray(image.transpose(2, 0, 1)), fy[:, None]
    along = planes[:, :, x0] * (1 - fx) + planes[:, :, x1] * fx
    return np.clip(np.floor(along[:, y0] * (1 - fy) + along[:, y1] * fy + 0.5), 0, 255).astype(np.uint8).transpose(1, 2, 0)


@lru_cache(256)
def triangle_weights(size: int, to: int) -> np.ndarray:
    """The weights (to, size) of a triangle filter whose window grows with the scale when an image shrinks."""
    ratio = size / to
    reach = max(ratio, 1.0)
    centre = (np.arange(to) + 0.5) * ratio
    first = np.clip(np.floor(centre - reach), 0, size - 1)
    last = np.clip(np.ceil(centre + reach), first + 1, size)
    at = np.arange(size)
    weights = np.maximum(1 - np.abs(at[None] - (centre[:, None] - 0.5)) / reach, 0)
    weights[(at[None] < first[:, None]) | (at[None] >= last[:, None])] = 0
    return weights / weights.sum(1, keepdims=True)


def antialiased(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize by triangle filters along the columns and then the rows; what classifiers see."""
    rows = np.tensordot(triangle_weights(image.shape[0], height), image.astype(float), 1)
    both = np.matmul(triangle_weights(image.shape[1], width), rows)
    return np.clip(np.floor(np.round(both, 6) + 0.5), 0, 255).astype(np.uint8)  # halves are common, and sums differ in their last bits


@dataclass(frozen=True)
class ClassifierInput:
    """How a classifier's images are made: exactly `size` (width, height), or the short side at `short` and the middle cut out."""

    size: tuple[int, int] | None = None
    short: int | None = None
    crop: int | None = None

    def __post_init__(self) -> None:
        if self.size is None and self.short is None:
            raise ValueError("a classifier needs a size or a short side")

    def __call__(self, image: np.ndarray) -> np.ndarray:
        if self.size is not None:
            return antialiased(image, self.size[1], self.size[0])
        height, width = image.shape[:2]
        crop = self.crop or self.short
        scale = self.short / max(min(height, width), 1)
        side = lambda n: max(int(n * scale + 0.5), crop)
        resized = antialiased(image, side(height), side(width))
        y, x = (resized.shape[0] - crop) // 2, (resized.shape[1] - crop) // 2
        return resized[y : y + crop, x : x + crop]


@lru_cache(256)
def scaled_levels(mean: float, std: float) -> np.ndarray:
    """Each value of a byte, less the mean by the deviation; near 0 that counts as 1."""
    by = 1.0 if abs(std) <= 1.1920929e-07 else std
    return (np.arange(256) * (1.0 / (255.0 * by)) - mean / by).astype(np.float32)


@lru_cache(256)
def line_levels(mean: float, std: float) -> np.ndarray:
    """Each value of a byte as a recogniser sees it; a deviation of 0 gives 0."""
    v = np.arange(256.0)
    return ((v / 255.0 - mean) / std if std else 0.0 * v).astype(np.float32)


def scaled_channels(image: np.ndarray, order: str, mean: tuple[float, ...], std: tuple[float, ...]) -> np.ndarray:
    """A BGR image as (3, height, width) in an order of channels, each less its mean by its deviation; near 0 that counts as 1."""
    planes = image if order == "bgr" else image[..., ::-1]
    out = np.empty((3, *image.shape[:2]), np.float32)
    for c in range(3):
        out[c] = scaled_levels(mean[c], std[c])[planes[..., c]]
    return out


def line_batch(crops: list[np.ndarray], widths: list[int], width: int, height: int, order: str, mean: tuple[float, ...], std: tuple[float, ...]) -> np.ndarray:
    """Crops at one height and their own widths, padded on the right to one tensor; padding is normalised like a black pixel, and a deviation of 0 gives 0."""
    out = np.empty((len(crops), 3, height, width), np.float32)
    levels = [line_levels(mean[c], std[c]) for c in range(3)]
    for c in range(3):
        out[:, c] = levels[c][0]
    for k, (crop, w) in enumerate(zip(crops, widths, strict=True)):
        planes = bilinear(crop, height, w)
        planes = planes if order == "bgr" else planes[..., ::-1]
        for c in range(3):
            out[k, c, :, :w] = levels[c][planes[..., c]]
    return out


def cuts(image: np.ndarray, quads: list[np.ndarray], upright: bool = False) -> list[np.ndarray]:
    """The content of each quad made upright; `upright`, and a quad without area, give the whole pixels of the box around it."""
    made = [None] * len(quads) if upright else warps(image, quads)
    return [boxed_pixels(image, q) if m is None else np.clip(np.floor(m + 0.5), 0, 255).astype(np.uint8) for q, m in zip(quads, made, strict=True)]


def boxed_pixels(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The whole pixels of the box around a quad."""
    (h, w), low, high = image.shape[:2], np.floor(quad.min(0)), np.ceil(quad.max(0))
    x, y = (int(min(max(v, 0), n - 1)) for v, n in zip(low, (w, h), strict=True))
    x2, y2 = (int(min(max(v, a + 1), n)) for v, a, n in zip(high, (x, y), (w, h), strict=True))
    return image[y:y2, x:x2]


def cut_out(image: np.ndarray, quad: np.ndarray, upright: bool = False) -> np.ndarray:
    """One quad's content, as by cuts."""
    return cuts(image, [quad], upright)[0]


def quad_mean(p: np.ndarray, quad: np.ndarray) -> float:
    """The mean of a map over the pixels inside a quad, whose corners are cut to whole pixels; edges are inside. 0.0 if there is none."""
    h, w = p.shape
    x0, x1 = (int(min(max(v, 0), w - 1)) for v in (np.floor(quad[:, 0].min()), np.ceil(quad[:, 0].max())))
    y0, y1 = (int(min(max(v, 0), h - 1)) for v in (np.floor(quad[:, 1].min()), np.ceil(quad[:, 1].max())))
    ys, xs = np.arange(y0, y1 + 1)[:, None], np.arange(x0, x1 + 1)
    a = np.trunc(quad)
    d, a = (np.roll(a, -1, 0) - a)[..., None, None], a[..., None, None]
    side = d[:, 0] * (ys - a[:, 1]) - d[:, 1] * (xs - a[:, 0])
    inside = ~((side.max(0) >= 1e-9) & (side.min(0) <= -1e-9))
    return float(p[y0 : y1 + 1, x0 : x1 + 1][inside].astype(float).mean()) if inside.any() else 0.0
