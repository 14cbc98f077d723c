"""Typed operator settings, validated on the driver before any job is built."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, replace


class SettingsError(ValueError):
    """A setting is outside its documented domain."""


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise SettingsError(message)


class _Settings:
    def updated(self, **values):
        return replace(self, **values)

    @property
    def settings_hash(self) -> str:
        """Short stable digest; outputs made under different settings must not be mixed."""
        text = json.dumps([type(self).__name__, asdict(self)], sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class DetectorSettings(_Settings):
    # Fixed default values of the detection stage.
    processing_scale: float = 0.5
    blur_kernel: int = 5
    threshold: int = 22
    close_kernel: int = 5
    close_iterations: int = 1
    open_kernel: int = 3
    open_iterations: int = 1
    dilate_kernel: int = 3
    dilate_iterations: int = 0
    min_area_px: int = 2_000
    max_area_px: int = 40_000
    min_width_px: int = 50
    max_width_px: int = 260
    min_height_px: int = 50
    max_height_px: int = 260
    min_solidity: float = 0.55

    def __post_init__(self):
        _require(0.25 <= self.processing_scale <= 1.0, "processing_scale must lie in 0.25..1.0")
        for stage in ("blur", "close", "open", "dilate"):
            size = getattr(self, f"{stage}_kernel")
            _require(size >= 1 and size % 2 == 1, f"{stage}_kernel must be odd and positive")
        _require(0 <= self.threshold <= 255, "threshold must lie in 0..255")
        for stage in ("close", "open", "dilate"):
            _require(
                0 <= getattr(self, f"{stage}_iterations") <= 10,
                f"{stage}_iterations must lie in 0..10",
            )
        for what in ("area", "width", "height"):
            low, high = getattr(self, f"min_{what}_px"), getattr(self, f"max_{what}_px")
            _require(0 < low < high, f"{what} limits must be positive and increasing")
        _require(0.0 <= self.min_solidity <= 1.0, "min_solidity must lie in 0..1")


@dataclass(frozen=True)
class TrackerSettings(_Settings):
    # Fixed default values of the tracker.
    gravity_mm_s2: float = 9_810.0
    process_acceleration_sigma_mm_s2: float = 2_500.0
    measurement_sigma_mm: float = 0.22
    association_gate_sigma: float = 5.0
    appearance_weight: float = 0.18
    confirmation_hits: int = 2
    maximum_missed_frames: int = 2
    birth_zone_depth_mm: float = 26.0
    release_height_above_fov_mm: float = 20.0
    exit_margin_mm: float = 8.0
    left_birth_margin_px: int = 50
    right_birth_margin_px: int = 50
    require_top_birth: bool = True

    def __post_init__(self):
        for name in (
            "gravity_mm_s2",
            "process_acceleration_sigma_mm_s2",
            "measurement_sigma_mm",
            "association_gate_sigma",
            "birth_zone_depth_mm",
            "exit_margin_mm",
        ):
            value = getattr(self, name)
            _require(math.isfinite(value) and value > 0, f"{name} must be finite and positive")
        _require(self.confirmation_hits >= 1, "confirmation_hits must be at least 1")
        _require(self.maximum_missed_frames >= 0, "maximum_missed_frames cannot be negative")
        _require(self.appearance_weight >= 0, "appearance_weight cannot be negative")
        _require(
            self.left_birth_margin_px >= 0 and self.right_birth_margin_px >= 0,
            "a birth margin is below zero",
        )


@dataclass(frozen=True)
class FieldOfView(_Settings):
    """Metric bounds and pixel width a tracker works in."""

    top_y_mm: float
    bottom_y_mm: float
    image_width_px: int = 1456

    def __post_init__(self):
        _require(self.bottom_y_mm > self.top_y_mm, "bottom_y_mm is not below top_y_mm")
        _require(self.image_width_px > 0, "image width must be positive")

    def check_margins(self, settings: TrackerSettings) -> None:
        used = settings.left_birth_margin_px + settings.right_birth_margin_px
        _require(used < self.image_width_px, "birth margins cover the whole image")


@dataclass(frozen=True)
class GateLayout(_Settings):
    # Fixed default values of the gate bank.
    line_y_mm: float
    gate_width_mm: float = 5.0
    gate_count: int = 21
    centre_x_mm: float = 0.0
    actuation_probability_threshold: float = 0.35

    def __post_init__(self):
        _require(self.gate_width_mm > 0, "gate_width_mm is not above zero")
        _require(self.gate_count > 0 and self.gate_count % 2 == 1, "gate_count is not an odd number above zero")
        _require(
            0.0 <= self.actuation_probability_threshold <= 1.0,
            "gate probability threshold must lie in 0..1",
        )


def sorting_line_y(bottom_y_mm: float, offset_below_fov_mm: float = 30.0) -> float:
    """Sorting line position for a known field-of-view bottom; 30 mm is a fixed value."""
    _require(offset_below_fov_mm > 0, "the offset is not above zero")
    return bottom_y_mm + offset_below_fov_mm
