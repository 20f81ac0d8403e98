"""Settings of a run: defaults, YAML files with inheritance, and what the command line overrides.

Precedence: command line, then the file, then what the file includes (in order, the base last), then defaults.
"""

from __future__ import annotations

import dataclasses
import os
import warnings
from dataclasses import dataclass
from typing import Any

from frametide.functions.text import POLICIES
from frametide.operators.telemetry import MAX_IN_FLIGHT


@dataclass
class Settings:
    """The defaults of the published operating point."""

    patch_size: int = 1280
    min_overlap: int = 128
    conf: float = 0.2
    iou: float = 0.45
    batch_size: int = 8
    global_context: bool = False
    global_size: int | None = None
    classes: list[int] | None = None
    resize: tuple[int, int] | None = None
    stride: int = 1
    offset: int = 0
    num_frames: int | None = None
    per_class: bool = False
    save: bool = False
    save_json: bool = False
    plot_fps: bool = False
    augment: bool = False
    bounded_latency: bool = False
    max_in_flight: int = MAX_IN_FLIGHT
    drop_policy: str = "drop_oldest"
    input_fps_cap: float | None = None
    device: str = "0,1"
    workers_per_gpu: int = 2
    model: str | None = None
    input: str | None = None
    output: str | None = None
    mode: str | None = None

    @property
    def context_size(self) -> int:
        return self.global_size if self.global_size is not None else self.patch_size


def read_yaml(path: str) -> dict[str, Any]:
    """Flat settings of a file and all that it inherits; a missing file warns and is empty."""
    import yaml

    if not os.path.exists(path):
        warnings.warn(f"no such settings file: {path}", stacklevel=2)
        return {}
    with open(path, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    parents = own.pop("__include__", [])
    parents = [*(parents if isinstance(parents, list) else [parents]), *([own.pop("__base__")] if "__base__" in own else [])]
    merged: dict[str, Any] = {}
    for parent in parents:
        merged |= read_yaml(os.path.join(os.path.dirname(path), parent))
    return merged | dict(_leaves(own))


def _leaves(tree: dict[str, Any]):
    for key, value in tree.items():
        if isinstance(value, dict):
            yield from _leaves(value)
        else:
            yield key, value


def parse_size(value: str | None) -> tuple[int, int] | None:
    """``"W,H"``."""
    if not value:
        return None
    parts = value.split(",")
    if len(parts) != 2 or not all(p.strip().lstrip("-").isdigit() for p in parts):
        raise ValueError("a size is written W,H, such as 2560,1440")
    return int(parts[0]), int(parts[1])


def parse_classes(value: str | list | None) -> list[int] | None:
    if value is None or value == "":
        return None
    return [int(x) for x in (value.split(",") if isinstance(value, str) else value)]


def parse_devices(value: str | None, available: int) -> list:
    """Device numbers that exist; ``cpu`` where there are none, 0 where the text can't be read."""
    if available < 1:
        return ["cpu"]
    if value is None or str(value).lower() == "all":
        return list(range(available))
    try:
        asked = [int(x) for x in str(value).split(",")]
    except ValueError:
        asked = [0]
    return [d for d in asked if d < available]


def normalize_controls(max_in_flight: int | None, drop_policy: Any, input_fps_cap: Any, default: int = MAX_IN_FLIGHT) -> tuple[int, str, float | None]:
    """The controls as a run uses them; :func:`frametide.operators.telemetry.normalized_controls` does so for a table."""
    policy = str(drop_policy).strip().lower()
    policy = policy if policy in POLICIES else "drop_oldest"
    limit = 1 if policy == "latest_only" else max_in_flight if max_in_flight and max_in_flight >= 1 else default
    try:
        cap = None if input_fps_cap is None else float(input_fps_cap)
    except (TypeError, ValueError):
        cap = None
    return limit, policy, cap if cap and cap > 0 else None


def settle(file: dict[str, Any], given: dict[str, Any]) -> Settings:
    """Settings from a file's values and those given on the command line; unknown names are ignored."""
    names = {f.name for f in dataclasses.fields(Settings)}
    values = {k.replace("-", "_"): v for k, v in {**file, **given}.items() if v is not None}
    values = {k: v for k, v in values.items() if k in names}
    if "classes" in values:
        values["classes"] = parse_classes(values["classes"])
    if isinstance(values.get("resize"), str):
        values["resize"] = parse_size(values["resize"])
    out = Settings(**values)
    out.max_in_flight, out.drop_policy, out.input_fps_cap = normalize_controls(out.max_in_flight, out.drop_policy, out.input_fps_cap)
    return out
