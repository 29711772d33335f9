"""Typed parameters: defaults, then a document, then dotted overrides; unknown keys are refused with suggestions."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from difflib import get_close_matches
from typing import Any


#: Defaults and names are those that runs elsewhere use.
@dataclasses.dataclass(frozen=True)
class Quality:
    area_min: float = 0.03
    area_max: float = 0.70
    iou_min: float = 0.55
    blob_min: float = 0.05
    transient_min_run: int = 4
    area_median_window: int = 49
    area_drop_min: float = 0.63


@dataclasses.dataclass(frozen=True)
class Temporal:
    mask_ema_alpha: float = 0.7
    boil_preserve: float = 0.3
    qc_fail_weight: float = 0.1
    cut_diff: float = 0.06


@dataclasses.dataclass(frozen=True)
class TargetMask:
    r_keep: float = 0.9
    r_drop: float = 0.1
    dilate_px: int = 4
    piece_min_px: int = 30


@dataclasses.dataclass(frozen=True)
class Pipeline:
    quality: Quality = Quality()
    temporal: Temporal = Temporal()
    target_mask: TargetMask = TargetMask()
    island_min_px: int = 30
    mode_k: int = 3


def flatten(doc: dict, prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in doc.items():
        out.update(flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {prefix + k: v})
    return out


def _no_repeats(pairs: list[tuple[str, Any]]) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError(f"repeated key in {[k for k, _ in pairs]}")
    return dict(pairs)


def _fits(value: Any, default: Any) -> bool:
    """Numbers for numbers, whole ones for whole ones, truth values for truth values, lists of like things for lists."""
    if isinstance(default, tuple):
        return isinstance(value, (list, tuple)) and all(isinstance(v, int) and not isinstance(v, bool) for v in value)
    if isinstance(default, bool) or isinstance(value, bool):
        return isinstance(default, bool) and isinstance(value, bool)
    return isinstance(value, int if isinstance(default, int) else (int, float))


def typed(defaults: Any, text: str = "{}", overrides: dict[str, Any] | None = None) -> Any:
    """Any parameters (a data class, perhaps with data classes in it) from a JSON document and dotted overrides."""
    known = flatten(dataclasses.asdict(defaults))
    values = flatten(json.loads(text, object_pairs_hook=_no_repeats)) | (overrides or {})
    for k, v in values.items():
        if k not in known:
            raise ValueError(f"unknown key {k}; similar: {get_close_matches(k, known, 3, 0.6)}")
        if not _fits(v, known[k]):
            raise ValueError(f"{k} must be {'a truth value' if isinstance(known[k], bool) else 'a list of whole numbers' if isinstance(known[k], tuple) else 'a number'} like {known[k]}")

    def build(part: Any, prefix: str) -> Any:
        new = {}
        for f in dataclasses.fields(part):
            default = getattr(part, f.name)
            if dataclasses.is_dataclass(default):
                new[f.name] = build(default, f"{prefix}{f.name}.")
            else:
                value = values.get(prefix + f.name, default)
                new[f.name] = tuple(value) if isinstance(default, tuple) else value
        return type(part)(**new)

    return build(defaults, "")


def load(text: str = "{}", overrides: dict[str, Any] | None = None) -> Pipeline:
    """Parameters of the pipeline from a JSON document and overrides such as ``{"quality.iou_min": 0.5}``, checked against each other."""
    out = typed(Pipeline(), text, overrides)
    q, t, m = out.quality, out.temporal, out.target_mask
    for ok, what in (
        (0 <= q.area_min < q.area_max <= 1, "0 <= quality.area_min < quality.area_max <= 1"),
        (q.area_median_window % 2 == 1 and out.mode_k % 2 == 1, "windows are odd"),
        (0 < t.mask_ema_alpha <= 1 and 0 <= t.boil_preserve <= 1, "temporal weights lie in 0..1"),
        (m.r_drop < m.r_keep, "target_mask.r_drop < target_mask.r_keep"),
    ):
        if not ok:
            raise ValueError(f"expected {what}")
    return out


def params_hash(params: Any) -> str:
    """Identity of parameters: the hash of their canonical JSON."""
    doc = dataclasses.asdict(params) if dataclasses.is_dataclass(params) else params
    return hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
