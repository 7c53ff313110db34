"""Pixel work as joins and groupings over (image, y, x, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.geometry import in_quad, let
from foliospark.functions.sizes import resize_taps


def as_pixels(images: DataFrame, image: str, values: str, width: int) -> DataFrame:
    """One row per pixel of images kept as row-major arrays: image, y, x, p."""
    exploded = images.select(F.col(image).alias("image"), F.posexplode(values).alias("i", "p"))
    return exploded.select("image", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), "p")


def as_maps(pixels: DataFrame, width: int) -> DataFrame:
    """Pixels (image, y, x, p) gathered to a row per image: image, values (row-major); places without a pixel are null."""
    place = (F.col("y") * width + F.col("x")).alias("i")
    rows = pixels.groupBy("image").agg(F.array_sort(F.collect_list(F.struct(place, F.col("p").cast("double").alias("p")))).alias("c"))
    gap = lambda e, k: e["i"] - F.coalesce(F.get("c", k - 1)["i"], F.lit(-1)) - 1
    filled = F.transform("c", lambda e, k: F.concat(F.array_repeat(F.lit(None).cast("double"), gap(e, k).cast("int")), F.array(e["p"])))
    return rows.select("image", F.flatten(filled).alias("values"))


def above(p: Column, threshold: float) -> Column:
    """Strictly above a threshold within 0 and 1: what detection uses."""
    return p > min(max(threshold, 0.0), 1.0)


def reaches(p: Column, threshold: float) -> Column:
    """The older rule: the value within 0 and 1 at the threshold or above."""
    return F.least(F.greatest(p.cast("double"), F.lit(0.0)), F.lit(1.0)) >= threshold


def resize(images: DataFrame, image: str, values: str, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Bilinear resize of images kept as row-major arrays, to one row per pixel: image, y, x, v.

    The four source pixels of a destination pixel come from the array by index, so that nothing is
    joined or shuffled; halves are rounded up, and values stay within 0 and 255. Sizes are
    (height, width).
    """
    (sh, sw), (dh, dw) = src, dst
    cells = F.explode(F.sequence(F.lit(0), F.lit(dh * dw - 1)))
    at = images.select(F.col(image).alias("image"), F.col(values).alias("a"), cells.alias("i"))
    at = at.select("image", "a", F.floor(F.col("i") / dw).cast("int").alias("y"), (F.col("i") % dw).alias("x"))
    (y0, y1, fy), (x0, x1, fx) = resize_taps(F.col("y"), dh, sh), resize_taps(F.col("x"), dw, sw)
    pick = lambda y, x: F.get("a", (y * sw + x).cast("int")).cast("double")
    top = pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx
    bottom = pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx
    v = F.floor(top * (1 - fy) + bottom * fy + 0.5)
    return at.select("image", "y", "x", F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("int").alias("v"))


def normalised(v: Column, mean: float, std: float) -> Column:
    """A pixel scaled to 1, less the mean, by the deviation; a deviation near 0 counts as 1."""
    std = 1.0 if abs(std) <= 1.1920929e-07 else std
    return v.cast("double") * (1.0 / (255.0 * std)) - mean / std


def padded_line(values: Column, width: int, mean: float, std: float) -> Column:
    """A line of pixels padded with black to a width, each less the mean by the deviation; a deviation of 0 gives 0."""
    padded = F.concat(values, F.array_repeat(F.lit(0).cast("long"), F.greatest(width - F.size(values), F.lit(0))))
    return F.transform(padded, lambda v: F.lit(0.0) if std == 0 else (v / 255.0 - mean) / std)


def channel(c: Column, order: str) -> Column:
    """The source channel of channel c in "rgb" or "bgr" order."""
    return 2 - c if order == "bgr" else c


def hot_box(pixels: DataFrame, threshold: float) -> DataFrame:
    """Per image of pixels (image, y, x, p) the box around those above the threshold, how many they are, and the mean and size of the whole box."""
    hot = pixels.filter(above(F.col("p").cast("double"), threshold))
    box = hot.groupBy("image").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")], F.count("*").alias("hot"))
    inside = pixels.join(box, "image").filter(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")))
    return inside.groupBy("image", "min_x", "max_x", "min_y", "max_y", "hot").agg(F.avg(F.col("p").cast("double")).alias("score"), F.count("*").alias("area"))


def quad_scores(pixels: DataFrame, quads: DataFrame, width: int, height: int) -> DataFrame:
    """The mean value of the pixels inside each quad (image, quad, x0..x3, y0..y3), 0.0 if there is none.

    Corners are cut to whole pixels and the box around them to the image, whose pixels are
    enumerated per quad; the pixel values come by an equi-join on image, y and x. A pixel on an
    edge counts as inside.
    """
    corners = [(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(4)]
    whole = [(x.cast("long").cast("double"), y.cast("long").cast("double")) for x, y in corners]
    span = lambda cells, size: F.sequence(
        F.least(F.greatest(F.floor(F.least(*cells)), F.lit(0)), F.lit(size - 1)), F.least(F.greatest(F.ceil(F.greatest(*cells)), F.lit(0)), F.lit(size - 1))
    )
    rows = quads.withColumn("y", F.explode(span([y for _, y in corners], height))).withColumn("x", F.explode(span([x for x, _ in corners], width)))
    inside = rows.filter(in_quad(F.col("x").cast("double"), F.col("y").cast("double"), whole)).select("image", "quad", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    scored = inside.join(pixels, ["image", "y", "x"]).groupBy("image", "quad").agg(F.avg(F.col("p").cast("double")).alias("score"), F.count("*").alias("n"))
    return quads.select("image", "quad").join(scored, ["image", "quad"], "left").select("image", "quad", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n", F.lit(0)).alias("n"))


def quad_mean(values: Column, quad: Column, width: int, height: int) -> Column:
    """The mean (score, 0.0 without pixels) and the number (n) of a row-major map's pixels inside a quad, by the rules of quad_scores and inside the map's row."""

    def ends(q: Column, axis: str, size: int) -> Column:
        cells = [F.get(q, F.lit(k))[axis] for k in range(4)]
        return F.sequence(
            F.least(F.greatest(F.floor(F.least(*cells)), F.lit(0)), F.lit(size - 1)).cast("int"), F.least(F.greatest(F.ceil(F.greatest(*cells)), F.lit(0)), F.lit(size - 1)).cast("int")
        )

    def inside(q: Column) -> Column:
        whole = F.struct(*[F.get(q, F.lit(k))[axis].cast("long").cast("double").alias(f"{axis}{k}") for k in range(4) for axis in ("x", "y")])
        corners = lambda c: [(c[f"x{k}"], c[f"y{k}"]) for k in range(4)]
        line = lambda c, xs, y: F.transform(
            F.filter(xs, lambda x: in_quad(x.cast("double"), y.cast("double"), corners(c)) & (y * width + x < F.size(values))), lambda x: F.get(values, y * width + x).cast("double")
        )
        return let(whole, lambda c: let(ends(q, "x", width), lambda xs: F.flatten(F.transform(ends(q, "y", height), lambda y: line(c, xs, y)))))

    def told(found: Column) -> Column:
        mean = let(F.array_compact(found), lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, p: s + p) / F.size(v)).otherwise(0.0))
        return F.struct(mean.alias("score"), F.size(found).cast("long").alias("n"))

    return let(let(quad, inside), told)


def turned_values(values: Column, height: Column, width: Column, angle: Column) -> Column:
    """Row-major pixels turned counter-clockwise by a multiple of 90 degrees; other angles leave them.

    A turn by 90 or 270 degrees swaps height and width.
    """
    turn = F.pmod(angle, F.lit(360))
    swapped = turn.isin(90, 270)
    w = F.when(swapped, height).otherwise(width)

    def source(i: Column) -> Column:
        y, x = F.floor(i / w).cast("int"), (i % w).cast("int")
        return (
            F.when(turn == 90, x * width + (width - 1 - y)).when(turn == 180, (height - 1 - y) * width + (width - 1 - x))
            .when(turn == 270, (height - 1 - x) * width + y).otherwise(i)
        )

    return F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.get(values, source(i).cast("int")))


def synthetic_crops(spark: SparkSession, n: int, width: int = 320, height: int = 48) -> DataFrame:
    """n line images with a dark pattern on light ground, for warming up and timing models: image, y, x, v."""
    cells = spark.range(n * width * height)
    i, at = F.floor(F.col("id") / (width * height)), F.col("id") % (width * height)
    y, x = F.floor(at / width), at % width
    dark = ((F.floor(x / 6) + F.floor(y / 8) + i) % 3 == 0) & (y >= 8) & (y < 40)
    return cells.select(i.cast("int").alias("image"), y.cast("int").alias("y"), x.cast("int").alias("x"), F.when(dark, 20).otherwise(240).alias("v"))


def dummy_tensor(spark: SparkSession, kind: str) -> DataFrame:
    """The input that a model is tried with: channel, y, x, v. Zeros of 3 by 320 by 320 for "detection"; slanted waves of 3 by 48 by 320 for "recognition"."""
    if kind not in ("detection", "recognition"):
        raise ValueError(f"kind is {kind!r}, not detection or recognition")
    height, width = (320, 320) if kind == "detection" else (48, 320)
    at = spark.range(3 * height * width).select(
        F.floor(F.col("id") / (height * width)).cast("int").alias("channel"), F.floor(F.col("id") % (height * width) / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x")
    )
    wave = F.sin((F.col("y") * width + F.col("x")) / F.lit(float(height * width)) + F.col("channel") * 0.1)
    return at.withColumn("v", (F.lit(0.0) if kind == "detection" else wave).cast("float"))
