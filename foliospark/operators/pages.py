"""Page images to text: turned upright, detected, cut into lines, read in batches, put together. A page is a row throughout.

Models see what they were trained on: resized, normalised arrays (n, 3, height, width). Each model runs
once per page or batch, as all that comes of it is written before it is read by more than one other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from time import perf_counter
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliospark.config import ConfigError, PageConfig, model_config
from foliospark.functions.geometry import let, point, rescaled, short_side, smallest_rectangle, unclip_distance, unrotated_ring
from foliospark.functions.sizes import batch_width, detection_size, recognition_width
from foliospark.operators.borders import hull_of, trace
from foliospark.operators.decode import UNKNOWN, token_text
from foliospark.operators.detect import grown
from foliospark.operators.raster import ClassifierInput, bilinear, cuts, line_batch, quad_mean, scaled_channels, unpacked
from foliospark.sources.images import decoded_images, image_files, three_channels
from foliospark.sources.workspace import written

IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
#: The short sides that a box must have on the score map, before and after it is grown.
LEAST_SIDE, LEAST_GROWN = 3.0, 5.0
QUAD = "array<struct<x:double,y:double>>"
#: Bytes of rows that a task's Python gives on at once.
GIVEN_AT_ONCE = 1 << 22
TIMES = ("orientation", "detection_preprocess", "detection_inference", "detection_postprocess", "recognition_preprocess", "recognition_inference", "recognition_postprocess")


class Model(Protocol):
    """A stack of images (n, 3, height, width) of floats to an array whose first axis is n."""

    def __call__(self, images: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class Classifier:
    """An orientation model with its labels (such as 90 or 180_degree) in the order of its outputs."""

    model: Model
    labels: tuple[str, ...]
    image: ClassifierInput
    mean: tuple[float, ...] = IMAGENET[0]
    std: tuple[float, ...] = IMAGENET[1]

    def __post_init__(self) -> None:
        self.angles  # noqa: B018  fails on labels without an angle

    @classmethod
    def of(cls, model: Model, settings: str) -> Classifier:
        """A classifier whose sizes, labels and normalisation are those of its model's file."""
        m = model_config(settings)
        if m.labels is None:
            raise ConfigError("the classifier's file has no PostProcess.Topk.label_list")
        if m.cls_size is None and m.cls_short is None:
            raise ConfigError("the classifier's file has no PreProcess ResizeImage")
        return cls(model, m.labels, ClassifierInput(m.cls_size, m.cls_short, m.cls_crop), m.mean or IMAGENET[0], m.std or IMAGENET[1])

    @property
    def angles(self) -> list[int]:
        found = []
        for label in self.labels:
            digits = label[: len(label) - len(label.lstrip("0123456789"))]
            if digits not in ("0", "90", "180", "270"):
                raise ConfigError(f"label {label!r} isn't an orientation")
            found.append(int(digits))
        return found

    def __call__(self, images: list[np.ndarray]) -> list[int]:
        """The angle of each image; all go through the model at once."""
        std = tuple(s or 1.0 for s in self.std)
        scores = np.asarray(self.model(np.stack([scaled_channels(self.image(x), "rgb", self.mean, std) for x in images])))
        if scores.ndim != 2 or scores.shape != (len(images), len(self.labels)):
            raise ValueError(f"classifier gives {scores.shape} for {len(images)} images and {len(self.labels)} labels")
        return [self.angles[int(np.argmax(np.where(np.isnan(row), -np.inf, row)))] for row in scores]


def _bytes(value) -> int:
    """About how much memory a value takes that a row is given."""
    if isinstance(value, np.ndarray):
        return value.nbytes
    if isinstance(value, (list, dict)):
        return sum(map(_bytes, value.values() if isinstance(value, dict) else value))
    return len(value) if isinstance(value, bytes) else 8


def _stage(rows: DataFrame, added: str, *works, replaced: tuple[str, ...] = ()) -> DataFrame:
    """rows with more columns (or other values in some) that `works` make of a row given as a dict; an exception becomes the row's error.

    Works follow each other within the row: each sees what those before it made, and that stays when one fails.
    Rows that have an error already pass through. added names the columns and types that works return.
    Rows are given on as soon as they are GIVEN_AT_ONCE bytes together, one at least, whatever the size of the batch they came in.
    """
    names, more = rows.columns, [x.strip().split(" ", 1)[0] for x in added.split(";")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(x.strip() for x in added.split(";"))])
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def told(given: pa.RecordBatch, made: list[dict]) -> pa.RecordBatch:
        arrays = []
        for n, c in zip(names, given.columns, strict=True):
            if n == "error" or n in replaced:
                c = pa.array([out[n] if n in out else c[k].as_py() for k, out in enumerate(made)], kinds.field(n).type)
            arrays.append(c)
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array([out.get(n) for out in made], kinds.field(n).type) for n in more)], [*names, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, made, size = 0, [], 0
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = dict(zip(names, (c[0] for c in one.columns), strict=True))
                out = {}
                error = row["error"].as_py()
                if error is None:
                    try:
                        for work in works:
                            out |= work(row | out)
                    except Exception as e:  # one bad page never fails the others
                        error = f"{type(e).__name__}: {e}"
                out["error"] = error
                made.append(out)
                size += one.nbytes + _bytes(out)
                if size >= GIVEN_AT_ONCE:
                    yield told(batch.slice(first, len(made)), made)
                    first, made, size = k + 1, [], 0
            if made:
                yield told(batch.slice(first, len(made)), made)

    return rows.mapInArrow(run, schema)


def _plain(value):
    return value.as_py() if isinstance(value, pa.Scalar) else value


def _image(row: dict) -> np.ndarray:
    image = unpacked(_plain(row["pixels"]), _plain(row["height"]), _plain(row["width"]))
    if image is None:
        raise ValueError("pixels don't fit the size")
    return image


def classifier_images(images: DataFrame, image: ClassifierInput) -> DataFrame:
    """images (image, height, width, pixels) as a classifier sees them: image, made (the first channel, row-major), error."""
    given = images.select("image", "height", "width", "pixels", F.lit(None).cast("string").alias("error"))
    return _stage(given, "made array<int>", lambda row: {"made": image(_image(row))[..., 0].ravel().astype(int)}).select("image", "made", "error")


_TURNED = ("pixels", "height", "width")
_UPRIGHT = "angle int; orientation double"
_SCORED = "map array<double>; detection_preprocess double; detection_inference double"
_BORDERED = f"hulls array<{QUAD}>"


def _turning(classifier: Classifier | None):
    def work(row: dict) -> dict:
        image, began = _image(row), perf_counter()
        angle = classifier([image])[0] if classifier else 0
        out = {"angle": angle, "orientation": perf_counter() - began if classifier else 0.0}
        if angle:
            turned = np.rot90(image, angle // 90)
            out |= {"pixels": np.ascontiguousarray(turned).tobytes(), "height": turned.shape[0], "width": turned.shape[1]}
        return out

    return work


def _scoring(detector: Model, config: PageConfig):
    def work(row: dict) -> dict:
        began = perf_counter()
        h, w = _plain(row["map_height"]), _plain(row["map_width"])
        batch = scaled_channels(bilinear(_image(row), h, w), config.channel_order, config.det_mean, config.det_std)[None]
        made = perf_counter()
        out = np.asarray(detector(batch))
        if out.shape != (1, 1, h, w):
            raise ValueError(f"detection gives {out.shape} for a map of {h} by {w}")
        return {"map": out.ravel().astype(float), "detection_preprocess": made - began, "detection_inference": perf_counter() - made}

    return work


def _map(row: dict) -> np.ndarray:
    values = row["map"]
    return (values.values.to_numpy() if isinstance(values, pa.Scalar) else values).reshape(_plain(row["map_height"]), _plain(row["map_width"]))


def _bordering(config: PageConfig):
    limit = min(max(config.det_threshold, 0.0), 1.0)

    def work(row: dict) -> dict:
        borders = trace(_map(row) > limit)[: config.det_max_candidates or None]
        return {"hulls": [[{"x": x, "y": y} for x, y in hull_of(b.points)] for b in borders]}

    return work


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("image", "height", "width", "pixels", "error", F.col("height").alias("page_height"), F.col("width").alias("page_width"))


def _sized(pages: DataFrame, config: PageConfig) -> DataFrame:
    size = detection_size(F.col("width"), F.col("height"), config.det_limit_side_len, config.det_limit_type, config.det_max_side_limit)
    return pages.withColumns({"map_height": size["resized_h"], "map_width": size["resized_w"]})


def upright(pages: DataFrame, classifier: Classifier | None) -> DataFrame:
    """pages (image, height, width, pixels, error) plus page_height, page_width, angle and orientation: each page turned counter-clockwise by the angle of its class."""
    return _stage(_pages(pages), _UPRIGHT, _turning(classifier), replaced=_TURNED)


def scored(pages: DataFrame, detector: Model, config: PageConfig) -> DataFrame:
    """pages plus their score maps (map_height, map_width, map) and the times to make them: resized to multiples of 32, normalised, through the model."""
    return _stage(_sized(pages, config), _SCORED, _scoring(detector, config))


def bordered(pages: DataFrame, classifier: Classifier | None, detector: Model, config: PageConfig) -> DataFrame:
    """pages upright and scored, with hulls, the convex hull of each border; all in one pass of a page through Python."""

    def turned_size(row: dict) -> dict:  # a page on its side has its map's sides the other way round
        h, w = _plain(row["map_height"]), _plain(row["map_width"])
        return {"map_height": w, "map_width": h} if row["angle"] % 180 else {}

    works = _turning(classifier), turned_size, _scoring(detector, config), _bordering(config)
    return _stage(_sized(_pages(pages), config), f"{_UPRIGHT}; {_SCORED}; {_BORDERED}", *works, replaced=(*_TURNED, "map_height", "map_width"))


def boxed(pages: DataFrame, config: PageConfig) -> DataFrame:
    """Scored pages plus boxes, an array of (region, score, quad) in the page's pixels, in scan order of their borders; the map is left out.

    Of each border (holes too, up to det_max_candidates): the smallest rectangle, if its short side is LEAST_SIDE and its mean
    score det_box_threshold at least, grown by its unclip distance, if it then is LEAST_GROWN.
    """
    return hulls_boxed(_stage(pages, _BORDERED, _bordering(config)), config)


def hulls_boxed(pages: DataFrame, config: PageConfig) -> DataFrame:
    """Scored pages with hulls plus boxes, by the rules of boxed; map and hulls are left out."""
    names = [c for c in pages.columns if c not in ("map", "map_height", "map_width", "hulls")]
    quads = F.transform("hulls", lambda hull, k: F.struct(k.alias("region"), smallest_rectangle(hull)["quad"].alias("quad")))
    quads = F.filter(quads, lambda b: short_side(b["quad"]) >= LEAST_SIDE)
    found = pages.select(*names, "map_height", "map_width", "map", quads.alias("quads"))

    def work(row: dict) -> dict:
        began = perf_counter()
        p = _map(row)
        means = [quad_mean(p, np.array([(c["x"], c["y"]) for c in q["quad"]])) for q in row["quads"].as_py() or []]
        return {"means": means, "detection_postprocess": perf_counter() - began}

    scores = _stage(found, "means array<double>; detection_postprocess double", work)
    joined = F.transform("quads", lambda q, k: F.struct(q["region"].alias("region"), F.get("means", k).alias("score"), q["quad"].alias("quad")))
    good = F.filter(joined, lambda b: b["score"] >= config.det_box_threshold)
    large = F.transform(good, lambda b: F.struct(b["region"].alias("region"), b["score"].alias("score"), grown(b["quad"], unclip_distance(b["quad"], config.det_unclip_ratio)).alias("quad")))
    large = F.filter(large, lambda b: short_side(b["quad"]) >= LEAST_GROWN)
    sx, sy = F.col("width") / F.col("map_width"), F.col("height") / F.col("map_height")
    on_page = F.transform(large, lambda b: F.struct(
        b["region"].alias("region"), b["score"].alias("score"),
        F.transform(b["quad"], lambda p: point(rescaled(p["x"], sx, F.col("width")), rescaled(p["y"], sy, F.col("height")))).alias("quad"),
    ))
    return scores.select(*names, "detection_postprocess", on_page.alias("boxes"))


def lined(pages: DataFrame, config: PageConfig, classifier: Classifier | None = None) -> DataFrame:
    """Boxed pages with lines instead of pixels: an array of (region, height, width, pixels), turned by 180 degrees where the classifier says so.

    The classifier sees rec_batch_size lines at a time; the last ones are filled up with copies of the last line.
    """
    size = config.rec_batch_size

    def work(row: dict) -> dict:
        image, began = _image(row), perf_counter()
        boxes = row["boxes"].as_py() or []
        crops = cuts(image, [np.array([(c["x"], c["y"]) for c in b["quad"]]) for b in boxes], config.rec_crop_mode == "axis_aligned")
        cut = perf_counter()
        for at in range(0, len(crops) if classifier else 0, size):
            some = crops[at : at + size]
            for k, angle in enumerate(classifier(some + some[-1:] * (size - len(some)))[: len(some)]):
                if angle == 180:
                    crops[at + k] = crops[at + k][::-1, ::-1]
        lines = [{"region": b["region"], "height": c.shape[0], "width": c.shape[1], "pixels": np.ascontiguousarray(c).tobytes()} for b, c in zip(boxes, crops, strict=True)]
        return {"lines": lines, "cutting": cut - began, "turning": perf_counter() - cut if classifier else 0.0}

    out = _stage(pages, "lines array<struct<region:int,height:int,width:int,pixels:binary>>; cutting double; turning double", work)
    return out.withColumn("orientation", F.col("orientation") + F.col("turning")).drop("pixels", "turning")


def line_batches(pages: DataFrame, config: PageConfig, kept: tuple[str, ...] = ()) -> DataFrame:
    """A row per batch of lines: image, batch, lines and the batch's width.

    A page's lines are sorted by aspect ratio within the page's row and cut into batches; batches
    of all pages are then dealt to tasks, so that a page with very many lines is read by many.
    With `kept`, columns of a page that are to stay with it, its first batch has them too, as page;
    a page without lines then has a row without a batch.
    """
    target = lambda x: recognition_width(x["width"], x["height"], config.rec_height, config.rec_min_width)
    ranked = F.array_sort(F.transform("lines", lambda x: F.struct(
        (x["width"] / x["height"]).alias("aspect"), x["region"].alias("region"), x["height"].alias("height"), x["width"].alias("width"), target(x).alias("target"), x["pixels"].alias("pixels")
    )))
    count, size = F.size("lines"), config.rec_batch_size
    parts = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / size).cast("int")), lambda b: F.struct(b.alias("batch"), F.slice("_ranked", b * size + 1, size).alias("lines")))
    if kept:
        given = pages.select("image", F.struct(*kept).alias("_page"), F.when(count > 0, ranked).alias("_ranked"), "lines")
        rows = given.select("image", "_page", F.explode_outer(F.when(count > 0, parts)).alias("b")).select(
            "image", F.when(F.coalesce("b.batch", F.lit(0)) == 0, F.col("_page")).alias("page"), "b.batch", "b.lines"
        )
    else:
        rows = pages.filter(count > 0).select("image", ranked.alias("_ranked"), "lines").select("image", F.explode(parts).alias("b")).select("image", "b.*")
    widest = batch_width(F.array_max(F.transform("lines", lambda x: x["target"])), config.rec_min_width, config.rec_max_width, config.rec_width_alignment)
    return rows.withColumn("batch_width", widest).repartition("image", "batch")


def read_batches(batches: DataFrame, recogniser: Model, config: PageConfig) -> DataFrame:
    """Every line of the batches: image, region, ks and ps (best class and probability of its valid steps), or the batch's error; and its batch's times.

    A batch is one padded tensor. Steps of the padding are cut off by each line's share of the width. A row without lines has nothing read.
    """
    widths = F.transform("lines", lambda x: F.least(F.greatest(x["target"], F.lit(1)), F.col("batch_width"), F.lit(max(config.rec_max_width, config.rec_min_width))))
    given = batches.withColumns({"widths": widths, "error": F.lit(None).cast("string")})

    def work(row: dict) -> dict:
        if not row["lines"].is_valid:
            return {}
        began = perf_counter()
        lines, width = row["lines"].as_py(), row["batch_width"].as_py()
        own = row["widths"].as_py()
        crops = [unpacked(x["pixels"], x["height"], x["width"]) for x in lines]
        if any(c is None for c in crops):
            raise ValueError("pixels don't fit the size")
        tensor = line_batch(crops, own, width, config.rec_height, config.rec_channel_order, config.rec_mean, config.rec_std)
        made = perf_counter()
        out = np.asarray(recogniser(tensor))
        read = perf_counter()
        if out.ndim != 3 or out.shape[0] != len(lines) or not out.shape[1] or not out.shape[2]:
            raise ValueError(f"recognition gives {out.shape} for {len(lines)} lines")
        steps = out.shape[1]
        scale = np.float32(steps) / np.float32(width)
        valid = [int(min(max(np.floor(np.float64(scale * np.float32(w)) + 0.5), 1), steps)) for w in own]
        found = [x.tolist() for x in best_steps(np.concatenate([out[k, :n] for k, n in enumerate(valid)]))]
        ends = np.cumsum(valid).tolist()
        told = [{"region": x["region"]} | {c: f[e - n : e] for c, f in zip(("ks", "ps"), found, strict=True)} for x, n, e in zip(lines, valid, ends, strict=True)]
        return {"read": told, "recognition_preprocess": made - began, "recognition_inference": read - made, "recognition_postprocess": perf_counter() - read}

    return _stage(
        given, "read array<struct<region:int,ks:array<int>,ps:array<double>>>; recognition_preprocess double; recognition_inference double; recognition_postprocess double", work
    ).drop("lines", "widths")


def best_steps(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first best class of each row and its probability: the score itself in a distribution, else by softmax."""
    s = np.where(np.isnan(scores), -np.inf, scores).astype(float)
    k = s.argmax(1)
    top = s[np.arange(len(s)), k]
    with np.errstate(invalid="ignore", over="ignore"):
        weight = np.exp(scores.astype(float) - top[:, None]).sum(1)
        soft = np.where((weight > 0) & np.isfinite(weight), 1 / np.where(weight > 0, weight, 1), 0.0)
        known = (scores.min(1) >= -1e-4) & (scores.max(1) <= 1 + 1e-4) & (np.abs(scores.astype(float).sum(1) - 1) <= 1e-3)
    return k, np.where(known, np.clip(top, 0, 1), soft)


def texts(read: DataFrame, dictionary: DataFrame) -> DataFrame:
    """image, region, text, confidence of the read lines: repeats and blanks (class 0) left out, classes beyond the dictionary (idx, token) as [UNK]."""
    lines = read.filter("error IS NULL").select("image", F.explode("read").alias("r")).select("image", "r.*")
    steps = F.transform("ks", lambda k, t: F.struct(t.alias("t"), k.alias("k"), F.get("ps", t).alias("p"), F.when(t > 0, F.get("ks", t - 1)).alias("before")))
    emitted = lines.select("image", "region", F.explode(F.filter(steps, lambda s: (s["k"] != 0) & ~s["k"].eqNullSafe(s["before"]))).alias("s")).select("image", "region", "s.t", "s.k", "s.p")
    ordered = F.array_sort(F.collect_list(F.struct("t", "token")))
    decoded = token_text(emitted, dictionary).groupBy("image", "region").agg(ordered.alias("run"), F.avg("p").alias("confidence"))
    decoded = decoded.select("image", "region", F.array_join(F.transform("run", lambda x: x["token"]), "").alias("text"), "confidence")
    return lines.select("image", "region").join(decoded, ["image", "region"], "left").select("image", "region", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def read_images(
    images: DataFrame, dictionary: DataFrame, detector: Model, recogniser: Model, config: PageConfig = PageConfig(),
    page_classifier: Classifier | None = None, line_classifier: Classifier | None = None,
) -> DataFrame:
    """One row per page: image, error, angle, results (region, text, confidence, score, quad) in detection order, and timings in seconds.

    images has image (unique), height, width, pixels (packed BGR rows) and may have error, as from
    image_files. Quads are in the pixels of the page as given, whatever way it was turned. A page that
    can't be read keeps its row with an error and null results; an error in one of its batches fails
    that page alone. A page without text has no results. Timings are those of the page's own
    work, and of its batches; their sum is total.
    """
    given = images if "error" in images.columns else images.withColumn("error", F.lit(None).cast("string"))
    given = given.select("image", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "pixels", "error")
    # pixels and maps pass from step to step by rows and are never in a table: a table's reader holds thousands of rows at once, whatever their size
    cut = lined(hulls_boxed(bordered(given, page_classifier, detector, config), config), config, line_classifier)
    kept = tuple(c for c in cut.columns if c not in ("image", "lines", "height", "width"))
    read = written(read_batches(line_batches(cut, config, kept), recogniser, config), "read-batches")
    pages = read.filter("page IS NOT NULL").select("image", "page.*")
    spent = [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"_{c}") for c in TIMES[4:]]
    of_page = read.groupBy("image").agg(F.min("error").alias("_batch_error"), *spent)
    # a hot page has as many rows here as it has lines, and they are its result
    told = texts(read, dictionary).groupBy("image").agg(F.collect_list(F.struct("region", "text", "confidence")).alias("_texts"))
    both = pages.join(of_page, "image", "left").join(told, "image", "left")
    both = both.withColumn("_texts", F.map_from_entries(F.transform("_texts", lambda t: F.struct(t["region"], F.struct(t["text"].alias("text"), t["confidence"].alias("confidence"))))))
    results = F.transform("boxes", lambda b: F.struct(
        b["region"].alias("region"), F.try_element_at("_texts", b["region"])["text"].alias("text"), F.try_element_at("_texts", b["region"])["confidence"].alias("confidence"),
        b["score"].alias("score"), unrotated_ring(b["quad"], F.col("angle"), F.col("page_width"), F.col("page_height")).alias("quad"),
    ))
    lost = F.exists(results, lambda r: r["text"].isNull())
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    times = {c: zero(F.col(c)) for c in TIMES[:4]} | {c: zero(F.col(f"_{c}")) for c in TIMES[4:]}
    times["recognition_preprocess"] = times["recognition_preprocess"] + zero(F.col("cutting"))
    error = F.coalesce("error", "_batch_error", F.when(lost, F.lit("lines without text")))
    return both.select(
        "image", error.alias("error"), "angle", F.when(error.isNull(), results).alias("results"), F.struct(*[v.alias(k) for k, v in times.items()], sum(times.values()).alias("total")).alias("timings")
    )


def read_files(spark: SparkSession, path: str, *args, **settings) -> DataFrame:
    """read_images over the image files under a path; image is the file's path. Files that can't be decoded keep a row with an error."""
    files = image_files(spark, path)
    return read_images(three_channels(files.withColumn("image", F.col("origin"))), *args, **settings)


def read_encoded(rows: DataFrame, key: str, content: str, *args, **settings) -> DataFrame:
    """read_images over encoded images in a binary column; image is the row's key."""
    return read_images(three_channels(decoded_images(rows, key, content).withColumnRenamed(key, "image")), *args, **settings)


__all__ = ["Classifier", "ClassifierInput", "Model", "UNKNOWN", "bordered", "boxed", "hulls_boxed", "line_batches", "lined", "read_batches", "read_encoded", "read_files", "read_images", "scored", "texts", "upright"]
