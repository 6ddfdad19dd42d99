"""Configuration: a small YAML reader, defaults, and range rules."""

from __future__ import annotations

import copy
import importlib.util
import math
import os
import re
from collections.abc import Iterator
from typing import Any


class ConfigError(ValueError):
    """A configuration that breaks a rule."""


#: Words for no value and for truth (fixed values), and plain numbers; anything else is text.
WORDS = {x: None for x in ("", "~", "null", "Null", "NULL")} | {x: True for x in ("true", "True", "TRUE")} | {x: False for x in ("false", "False", "FALSE")}
WHOLE, DECIMAL = re.compile(r"[+-]?[0-9]+"), re.compile(r"[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


def _scalar(text: str) -> Any:
    text = text.strip()
    if text in WORDS:
        return WORDS[text]
    if text[0] == "[" and text[-1] == "]":
        return [_scalar(x) for x in text[1:-1].split(",")] if text[1:-1].strip() else []
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    return int(text) if WHOLE.fullmatch(text) else float(text) if DECIMAL.fullmatch(text) else text


def _uncommented(line: str) -> str:
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (k == 0 or line[k - 1].isspace()):
            return line[:k].rstrip()
    return line.rstrip()


def _entries(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(line, indent, key, value) of each line that says something."""
    for number, raw in enumerate(text.splitlines(), 1):
        line = _uncommented(raw)
        bare = line.lstrip()
        if not bare:
            continue
        if "\t" in line[: len(line) - len(bare)]:
            raise ConfigError(f"line {number}: tabs can't indent")
        key, colon, value = bare.partition(":")
        if not colon or not key.strip():
            raise ConfigError(f"line {number}: no key")
        yield number, len(line) - len(bare), key.strip(), value.strip()


def _mapping(entries: list[tuple[int, int, str, str]]) -> dict:
    """The map whose keys stand at the first entry's indent; what stands deeper after a key without a value is that key's map."""
    out: dict = {}
    at = 0
    while at < len(entries):
        number, indent, key, value = entries[at]
        if indent != entries[0][1]:
            raise ConfigError(f"line {number}: an indent that fits no key above")
        end = next((k for k in range(at + 1, len(entries)) if entries[k][1] <= indent), len(entries))
        if value and end > at + 1:
            raise ConfigError(f"line {entries[at + 1][0]}: an indent below a value")
        out[key] = _scalar(value) if value else _mapping(entries[at + 1 : end])
        at = end
    return out


def parse_yaml(text: str) -> dict:
    """Nested maps, scalars, inline lists and comments; tabs in the indentation, lines without a key and indents that fit none are errors."""
    return _mapping(list(_entries(text)))


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return validate(parse_yaml(file.read()))


def merge(base: dict, over: dict) -> dict:
    """base with over's values, maps merged at every depth; both stay as they are."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def with_value(config: dict, path: str, value: Any) -> dict:
    nested: Any = value
    for part in reversed(path.split(".")):
        nested = {part: nested}
    return merge(config, nested)


def shown_path(path: str, root: str) -> str:
    """path relative to root where it lies inside, else absolute."""
    full, base = os.path.abspath(path), os.path.abspath(root)
    return os.path.relpath(full, base).replace(os.sep, "/") if os.path.commonpath([full, base]) == base else full.replace(os.sep, "/")


#: Defaults (fixed values).
DEFAULTS: dict = {
    "paths": {"data_root": "data", "output_root": "outputs", "colmap_executable": "colmap", "gaussian_splatting_path": None},
    "dataset": {"name": "mipnerf360", "scene": "bonsai"},
    "video": {"frame_interval": 10, "time_interval": None, "target_frames": None},
    "quality": {"blur_threshold": 100.0, "min_brightness": 30.0, "max_brightness": 225.0, "dark_intensity_cutoff": 30, "bright_intensity_cutoff": 225, "max_dark_pixel_ratio": 0.45, "max_bright_pixel_ratio": 0.45, "minimum_feature_count": 40},
    "frame_selection": {"method": "automatic", "feature_detector": "orb", "maximum_features": 3000, "redundancy_threshold": 0.85, "minimum_matches": 50, "lowe_ratio": 0.75, "use_geometric_check": True, "ransac_reprojection_threshold": 3.0, "max_redundant_motion": 0.015},
    "preprocessing": {"max_width": 1600, "max_height": 1200, "jpeg_quality": 95},
    "colmap": {"backend": "auto", "matcher": "auto", "dataset_matcher": "exhaustive", "video_matcher": "sequential", "camera_model": "PINHOLE", "image_subdir": "images_4", "single_camera": True, "sequential_overlap": 10},
    "gaussian": {"iterations": 30000, "lambda_ssim": 0.2, "device": "cuda", "checkpoint_interval": 7000},
    "phase5": {"iterations": 30000, "split": {"holdout_interval": 8, "holdout_offset": 0}, "experiments": {"fixed_budgets": [30, 60, 100], "automatic_budget": 60, "include_full": False}, "scene_preparation": {"link_mode": "hardlink"}, "evaluation": {"lpips_network": "alex"}},
    "evaluation": {"psnr": True, "ssim": True, "lpips": True},
    "reproducibility": {"random_seed": 42},
}

#: (key, lowest, highest, lowest excluded, highest excluded); None: unbounded.
RANGES = (
    ("video.frame_interval", 0, None, True, False),
    ("video.time_interval", 0, None, True, False),
    ("video.target_frames", 0, None, True, False),
    ("quality.blur_threshold", 0, None, False, False),
    ("quality.dark_intensity_cutoff", 0, 255, False, False),
    ("quality.bright_intensity_cutoff", 0, 255, False, False),
    ("quality.max_dark_pixel_ratio", 0, 1, False, False),
    ("quality.max_bright_pixel_ratio", 0, 1, False, False),
    ("quality.minimum_feature_count", 0, None, False, False),
    ("frame_selection.maximum_features", 0, None, True, False),
    ("frame_selection.redundancy_threshold", 0, 1, False, False),
    ("frame_selection.minimum_matches", 0, None, False, False),
    ("frame_selection.lowe_ratio", 0, 1, True, True),
    ("frame_selection.ransac_reprojection_threshold", 0, None, True, False),
    ("frame_selection.max_redundant_motion", 0, 1, False, False),
    ("preprocessing.max_width", 0, None, True, False),
    ("preprocessing.max_height", 0, None, True, False),
    ("preprocessing.jpeg_quality", 1, 100, False, False),
    ("gaussian.iterations", 0, None, True, False),
    ("gaussian.checkpoint_interval", 0, None, True, False),
    ("gaussian.smoke_test.iterations", 0, None, True, False),
    ("phase5.iterations", 0, None, True, False),
    ("phase5.split.holdout_interval", 1, None, True, False),
    ("phase5.experiments.automatic_budget", 0, None, True, False),
    ("colmap.sequential_overlap", 0, None, True, False),
)
CHOICES = {
    "frame_selection.feature_detector": ("orb", "sift"),
    "phase5.scene_preparation.link_mode": ("hardlink", "symlink", "copy"),
    "colmap.backend": ("auto", "pycolmap", "cli"),
    "colmap.matcher": ("auto", "exhaustive", "sequential"),
    "colmap.dataset_matcher": ("exhaustive", "sequential"),
    "colmap.video_matcher": ("exhaustive", "sequential"),
}
#: Texts that must not be empty where their section is given.
FILLED = ("gaussian.implementation.name", "gaussian.implementation.repository_url", "gaussian.implementation.commit", "gaussian.implementation.license", "gaussian.smoke_test.images_subdir", "gaussian.smoke_test.output_subdir")
OPTIONAL = ("phase5", "gaussian.implementation", "gaussian.smoke_test")


def defaults() -> dict:
    return copy.deepcopy(DEFAULTS)


def value_at(config: dict, path: str) -> Any:
    here: Any = config
    for part in path.split("."):
        if not isinstance(here, dict):
            raise ConfigError(f"{path.rsplit('.', 1)[0]} must be a mapping")
        here = here.get(part)
        if here is None:
            return None
    return here


def validate(config: dict) -> dict:
    """config, if it has every section and key and keeps the rules."""
    missing = []
    for section, keys in DEFAULTS.items():
        if section == "phase5":
            continue
        found = config.get(section)
        missing += [section] if not isinstance(found, dict) else [f"{section}.{k}" for k in sorted(keys) if k not in found]
    if missing:
        raise ConfigError(f"missing: {', '.join(missing)}")
    if sum(config["video"][k] is not None for k in ("frame_interval", "time_interval", "target_frames")) != 1:
        raise ConfigError("exactly one of video.frame_interval, video.time_interval and video.target_frames must be set")
    for section in OPTIONAL:
        if (found := value_at(config, section)) is not None and not isinstance(found, dict):
            raise ConfigError(f"{section} must be a mapping")
    for path, low, high, above, below in RANGES:
        if (found := value_at(config, path)) is None:
            continue
        try:
            number = float(found)
        except (TypeError, ValueError) as error:
            raise ConfigError(f"{path} must be a number") from error
        if not math.isfinite(number) or number < low or (above and number == low) or (high is not None and (number > high or (below and number == high))):
            raise ConfigError(f"{path} is out of its range: {found}")
    for path, allowed in CHOICES.items():
        if (found := value_at(config, path)) is not None and str(found).lower() not in allowed:
            raise ConfigError(f"{path} must be one of {', '.join(allowed)}")
    for path in FILLED:
        if value_at(config, path.rsplit(".", 1)[0]) is not None and not value_at(config, path):
            raise ConfigError(f"{path} must be set")
    if value_at(config, "gaussian.smoke_test") is not None and not value_at(config, "gaussian.smoke_test.iterations"):
        raise ConfigError("gaussian.smoke_test.iterations must be set")
    interval, offset = value_at(config, "phase5.split.holdout_interval") or 8, value_at(config, "phase5.split.holdout_offset") or 0
    if not 0 <= offset < interval:
        raise ConfigError("phase5.split.holdout_offset must lie in [0, holdout_interval)")
    budgets = value_at(config, "phase5.experiments.fixed_budgets")
    if budgets is not None and (not isinstance(budgets, list) or not budgets or any(int(b) <= 0 for b in budgets)):
        raise ConfigError("phase5.experiments.fixed_budgets must be positive numbers")
    if value_at(config, "phase5.evaluation") is not None and value_at(config, "phase5.evaluation.lpips_network") == "":
        raise ConfigError("phase5.evaluation.lpips_network must be set")
    return config


def sampling_strategy(config: dict) -> dict:
    """The one strategy of the video section, as select_frames takes it."""
    video = config["video"]
    return {"interval": video["frame_interval"], "seconds": video["time_interval"], "target": video["target_frames"]}


def matcher(config: dict, source: str) -> str:
    """The matcher for a dataset or video, where the choice is auto."""
    if source not in ("dataset", "video"):
        raise ConfigError(f"unknown kind of input: {source}")
    chosen = str(config["colmap"]["matcher"]).lower()
    return chosen if chosen != "auto" else str(config["colmap"][f"{source}_matcher"]).lower()


def backend(config: dict, importable: bool | None = None) -> str:
    """The reconstruction backend: auto takes the Python module where it can be imported, else the command line; the module by name must be there."""
    chosen = str(config["colmap"]["backend"]).lower()
    if chosen not in CHOICES["colmap.backend"]:
        raise ConfigError(f"colmap.backend must be one of {', '.join(CHOICES['colmap.backend'])}")
    there = importlib.util.find_spec("pycolmap") is not None if importable is None else importable
    if chosen == "pycolmap" and not there:
        raise ConfigError("colmap.backend is pycolmap, which can't be imported")
    return ("pycolmap" if there else "cli") if chosen == "auto" else chosen


def reconstruction_commands(config: dict, images: str, database: str, output: str, source: str = "dataset") -> list[list[str]]:
    """Command lines of the external reconstruction's three stages; they are built here and run elsewhere."""
    c = config["colmap"]
    tool = str(config["paths"]["colmap_executable"])
    kind = matcher(config, source)
    match = [tool, f"{kind}_matcher", "--database_path", database]
    if kind == "sequential":
        match += ["--SequentialMatching.overlap", str(c["sequential_overlap"])]
    single = "1" if c["single_camera"] else "0"
    return [
        [tool, "feature_extractor", "--database_path", database, "--image_path", images, "--ImageReader.camera_model", str(c["camera_model"]), "--ImageReader.single_camera", single],
        match,
        [tool, "mapper", "--database_path", database, "--image_path", images, "--output_path", output],
    ]
