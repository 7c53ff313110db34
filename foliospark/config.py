"""Settings of the page flow: defaults, then the model's own file, then what is set by hand."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path


class ConfigError(ValueError):
    """A setting that can't be used."""


#: Settings that are words, in any case.
MODES = ("det_limit_type", "rec_crop_mode", "channel_order", "rec_channel_order")


@dataclass(frozen=True)
class PageConfig:
    """Everything that the flow's operators take as parameters."""

    det_limit_side_len: int = 960
    det_limit_type: str = "max"
    det_max_side_limit: int = 4000
    det_threshold: float = 0.3
    det_box_threshold: float = 0.6
    det_unclip_ratio: float = 1.5
    det_max_candidates: int = 1000
    rec_height: int = 48
    rec_min_width: int = 320
    rec_max_width: int = 3200
    rec_width_alignment: int = 32
    rec_batch_size: int = 1
    rec_use_space_char: bool = True
    rec_crop_mode: str = "rotated"
    channel_order: str = "bgr"
    rec_channel_order: str = "bgr"
    det_mean: tuple[float, ...] = (0.485, 0.456, 0.406)
    det_std: tuple[float, ...] = (0.229, 0.224, 0.225)
    rec_mean: tuple[float, ...] = (0.5, 0.5, 0.5)
    rec_std: tuple[float, ...] = (0.5, 0.5, 0.5)

    def __post_init__(self) -> None:
        if self.det_limit_type not in ("max", "min"):
            raise ConfigError(f"det_limit_type is {self.det_limit_type!r}, not max or min")
        for name in ("channel_order", "rec_channel_order"):
            if getattr(self, name) not in ("bgr", "rgb"):
                raise ConfigError(f"{name} is {getattr(self, name)!r}, not bgr or rgb")
        if self.rec_crop_mode not in ("rotated", "axis_aligned"):
            raise ConfigError(f"rec_crop_mode is {self.rec_crop_mode!r}, not rotated or axis_aligned")
        if min(self.rec_height, self.rec_min_width) < 1:
            raise ConfigError("lines need a height and a width")
        if self.rec_batch_size < 1:
            raise ConfigError("rec_batch_size is below 1")
        for name in ("det_threshold", "det_box_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ConfigError(f"{name} isn't within 0 and 1")


@dataclass(frozen=True)
class ModelConfig:
    """What a model's own file (inference.yml) says; None where it says nothing, as each kind of model has its own sections."""

    model_name: str | None = None
    channel_order: str | None = None
    mean: tuple[float, ...] | None = None
    std: tuple[float, ...] | None = None
    rec_image_shape: tuple[int, ...] | None = None
    post_process: str | None = None
    threshold: float | None = None
    box_threshold: float | None = None
    unclip_ratio: float | None = None
    max_candidates: int | None = None
    characters: tuple[str, ...] | None = None
    cls_size: tuple[int, ...] | None = None
    cls_short: int | None = None
    cls_crop: int | None = None
    labels: tuple[str, ...] | None = None


def number(raw: str, key: str) -> float:
    """A number, or a quotient such as 1./255."""
    try:
        parts = [float(x) for x in raw.split("/")]
        found = parts[0]
        for x in parts[1:]:
            found /= x
        return found
    except (ValueError, ZeroDivisionError) as e:
        raise ConfigError(f"{key}: {raw!r} is not a number") from e


def whole(raw: str, key: str) -> int:
    if not raw.isascii() or not raw.isdigit():
        raise ConfigError(f"{key}: {raw!r} is not an unsigned integer")
    return int(raw)


def _tree(text: str) -> dict:
    """The file's tree with every value as a string, so that 1./255. and null stay what they say. Lists and maps in brackets aren't allowed."""
    import yaml  # only where such a file is read

    try:
        for event in yaml.parse(text, yaml.BaseLoader):
            if getattr(event, "flow_style", False) and isinstance(event, yaml.CollectionStartEvent):
                raise ConfigError(f"line {event.start_mark.line + 1}: lists and maps in brackets aren't supported")
        found = yaml.load(text, yaml.BaseLoader)
    except yaml.YAMLError as e:
        raise ConfigError(f"broken YAML: {e}") from e
    return found if isinstance(found, dict) else {}


def _values(node, key: str, kind, size: int | None = None) -> tuple | None:
    """A list of scalars, of a given length if there is one."""
    if node in (None, ""):
        return None
    if not isinstance(node, list) or not all(isinstance(x, str) for x in node):
        raise ConfigError(f"{key}: expected a list of values")
    if size is not None and len(node) != size:
        raise ConfigError(f"{key}: expected {size} values, found {len(node)}")
    return tuple(kind(x, key) for x in node)


def _value(node, key: str, kind):
    return None if not isinstance(node, str) or node == "" else kind(node, key)


def model_config(text: str) -> ModelConfig:
    """The settings in a model's file. A known key with a value that can't be used is an error; unknown keys are passed over."""
    tree = _tree(text)
    section = lambda node, key: found if isinstance(node, dict) and isinstance(found := node.get(key), dict) else {}
    steps: dict[str, dict] = {}
    pre = section(tree, "PreProcess").get("transform_ops")
    for step in pre if isinstance(pre, list) else []:
        if isinstance(step, dict):
            steps |= {k: v if isinstance(v, dict) else {} for k, v in step.items()}
    at = lambda step, key: steps.get(step, {}).get(key)
    post = section(tree, "PostProcess")
    mode = _value(at("DecodeImage", "img_mode"), "DecodeImage.img_mode", lambda x, _: x.lower())
    if mode not in (None, "bgr", "rgb"):
        raise ConfigError(f"DecodeImage.img_mode: unsupported image mode {mode.upper()!r}")
    string = lambda x, _: x
    return ModelConfig(
        model_name=_value(section(tree, "Global").get("model_name"), "Global.model_name", string), channel_order=mode,
        mean=_values(at("NormalizeImage", "mean"), "NormalizeImage.mean", number, 3), std=_values(at("NormalizeImage", "std"), "NormalizeImage.std", number, 3),
        rec_image_shape=_values(at("RecResizeImg", "image_shape"), "RecResizeImg.image_shape", whole, 3),
        post_process=_value(post.get("name"), "PostProcess.name", string),
        threshold=_value(post.get("thresh"), "PostProcess.thresh", number), box_threshold=_value(post.get("box_thresh"), "PostProcess.box_thresh", number),
        unclip_ratio=_value(post.get("unclip_ratio"), "PostProcess.unclip_ratio", number), max_candidates=_value(post.get("max_candidates"), "PostProcess.max_candidates", whole),
        characters=_values(post.get("character_dict"), "PostProcess.character_dict", string),
        cls_size=_values(at("ResizeImage", "size"), "ResizeImage.size", whole, 2), cls_short=_value(at("ResizeImage", "resize_short"), "ResizeImage.resize_short", whole),
        cls_crop=_value(at("CropImage", "size"), "CropImage.size", whole), labels=_values(section(post, "Topk").get("label_list"), "Topk.label_list", string),
    )


def _given(settings: dict) -> dict:
    return {k: v for k, v in settings.items() if v is not None}


def model_settings(text: str) -> dict:
    """The detection settings in a model's file, by the names that PageConfig gives them."""
    m = model_config(text)
    return _given({"det_threshold": m.threshold, "det_box_threshold": m.box_threshold, "det_unclip_ratio": m.unclip_ratio, "det_max_candidates": m.max_candidates})


def page_config(det_text: str | None = None, rec_text: str | None = None, postprocess_from_model: bool = False, **by_hand) -> PageConfig:
    """Defaults, then what the models' files say about their images, then what is set by hand.

    The detection file's thresholds count only if asked for. A file of the wrong kind of model is an error.
    """
    det, rec = model_config(det_text) if det_text else ModelConfig(), model_config(rec_text) if rec_text else ModelConfig()
    for m, name, kind in ((det, "DBPostProcess", "detection"), (rec, "CTCLabelDecode", "recognition")):
        if m.post_process not in (None, name):
            raise ConfigError(f"the {kind} model's file has post-process {m.post_process!r}, not {name}")
    found = _given({"channel_order": det.channel_order, "det_mean": det.mean, "det_std": det.std, "rec_channel_order": rec.channel_order})
    if rec.rec_image_shape:
        channels, height, width = rec.rec_image_shape
        if channels != 3 or not height or not width:
            raise ConfigError(f"unsupported line shape {list(rec.rec_image_shape)}")
        found |= {"rec_height": height, "rec_min_width": width}
    if postprocess_from_model and det_text:
        found |= model_settings(det_text)
    return _by_hand(found, by_hand)


def dictionary_tokens(text: str) -> list[str]:
    """The tokens in a model's YAML file, by place; repeated ones are kept."""
    return list(model_config(text).characters or [])


def model_directory(path: str) -> tuple[str, str | None]:
    """The model in a directory, and its settings file if there is one."""
    model, settings = Path(path, "inference.onnx"), Path(path, "inference.yml")
    if not model.exists():
        raise ConfigError(f"no inference.onnx in {path}")
    return str(model), str(settings) if settings.exists() else None


def _by_hand(found: dict, by_hand: dict) -> PageConfig:
    unknown = set(by_hand) - {f.name for f in fields(PageConfig)}
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    given = {k: v.lower() if k in MODES and isinstance(v, str) else v for k, v in by_hand.items() if v is not None}
    return replace(PageConfig(), **{**found, **given})


def resolve(model_text: str | None = None, **by_hand) -> PageConfig:
    """Defaults, overridden by the model's file, overridden by hand; None leaves a setting alone."""
    return _by_hand(model_settings(model_text) if model_text else {}, by_hand)
