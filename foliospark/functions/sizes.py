"""Sizes of images, crops and time axes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.numbers import clamp, toward_zero, up_to_multiple


def detection_size(width: Column, height: Column, limit: int = 960, limit_type: str = "max", cap: int = 4000) -> dict[str, Column]:
    """The size an image is detected at: its long ("max") or short ("min") side at the limit, capped, in multiples of 32.

    Halves go to even. Returns width, height, ratio, and the scales back to the image.
    """
    w, h = width.cast("double"), height.cast("double")
    if limit == 0:
        ratio = F.lit(1.0)
    elif limit_type == "max":
        ratio = F.when(F.greatest(w, h) > limit, F.lit(float(limit)) / F.greatest(w, h)).otherwise(1.0)
    else:
        ratio = F.when(F.least(w, h) < limit, F.lit(float(limit)) / F.least(w, h)).otherwise(1.0)
    rw, rh = toward_zero(w * ratio), toward_zero(h * ratio)
    if cap > 0:
        again = F.when(F.greatest(rw, rh) > cap, F.lit(float(cap)) / F.greatest(rw, rh)).otherwise(1.0)
        rw, rh, ratio = toward_zero(rw * again), toward_zero(rh * again), ratio * again
    side = lambda v: F.greatest(F.rint(v / 32) * 32, F.lit(32.0)).cast("int")
    rw, rh = side(rw), side(rh)
    return {"resized_w": rw, "resized_h": rh, "ratio": ratio, "scale_x": w / rw, "scale_y": h / rh}


def recognition_width(width: Column, height: Column, target_height: int = 48, min_width: int = 320) -> Column:
    """A crop's width at the target height: cut where it is wider than the batch's least width, else rounded up."""
    aspect = width.cast("double") / height.cast("double")
    scaled = aspect * target_height
    return F.greatest(F.when(aspect > min_width / target_height, F.floor(scaled)).otherwise(F.ceil(scaled)), F.lit(1)).cast("int")


def batch_width(widest: Column, min_width: int = 320, max_width: int = 3200, alignment: int = 32) -> Column:
    """A batch's width for its widest crop."""
    return up_to_multiple(clamp(widest, min_width, max(max_width, min_width)), max(alignment, 1)).cast("int")


def valid_steps(width: Column, max_width: Column, steps: Column) -> Column:
    """How many time steps belong to a crop of `width` in a batch of `max_width`; in single precision."""
    scale = steps.cast("float") / max_width.cast("float")
    exact = F.round((scale * width.cast("float")).cast("double")).cast("int")
    return F.when(max_width <= 0, steps).otherwise(clamp(exact, 1, steps)).cast("int")


def resize_taps(dst: Column, dst_len: int, src_len: int) -> tuple[Column, Column, Column]:
    """The two source pixels of a destination pixel and the second one's weight, for pixel centres and repeated borders."""
    s = (dst + 0.5) * (src_len / dst_len) - 0.5
    low = F.floor(s)
    inside = (low >= 0) & (low < src_len - 1)
    first = clamp(low, 0, src_len - 1).cast("int")
    return first, F.least(first + 1, F.lit(src_len - 1)), F.when(inside, s - low).otherwise(0.0)
