"""Configurations. Plain values on the driver, with a canonical fingerprint.

What a setting may be is data beside its default (its range, whether it is odd, its choices); rules
between settings are a table per configuration. Both are checked whenever one is made.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from typing import Any, ClassVar

from sutur.errors import ConfigurationError
from sutur.functions.fingerprints import canonical_fingerprint


def setting(default: Any, low: float | None = None, high: float | None = None, above: float | None = None, odd: bool = False, choices: tuple[str, ...] = ()) -> Any:
    """A field whose values lie in low..high (``above`` is a lower bound that is not taken itself)."""
    return field(default=default, metadata={"low": low, "high": high, "above": above, "odd": odd, "choices": choices})


@dataclass(frozen=True)
class Config:
    #: Rules between settings: what must hold, and its name in the error.
    RULES: ClassVar[tuple[tuple[Callable[[Any], bool], str], ...]] = ()

    def __post_init__(self) -> None:
        for f in fields(self):
            if broken := _broken(getattr(self, f.name), type(f.default), f.metadata):
                raise ConfigurationError(f"{f.name} must be {broken}")
        for holds, name in self.RULES:
            if not holds(self):
                raise ConfigurationError(f"settings do not fit together: {name}")

    @classmethod
    def from_mapping(cls, values: dict[str, Any]) -> Config:
        """Strict construction: unknown names, wrong kinds and values out of range fail."""
        if not isinstance(values, dict):
            raise ConfigurationError("a configuration is a mapping")
        if unknown := sorted(set(values) - {f.name for f in fields(cls)}, key=str):
            raise ConfigurationError(f"unknown settings: {unknown}")
        return cls(**values)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @property
    def fingerprint(self) -> str:
        """SHA-256 of the canonical JSON of the settings, without an end of line."""
        return canonical_fingerprint(asdict(self), newline=False)


def _broken(value: Any, kind: type, limits: Any) -> str | None:
    """What the value should have been, or None if it is sound. Booleans are no numbers, NaN and infinities no settings."""
    allowed = (int, float) if kind is float else kind
    if isinstance(value, bool) != (kind is bool) or not isinstance(value, allowed):
        return f"of kind {kind.__name__}"
    if kind in (int, float) and not math.isfinite(value):
        return "finite"
    low, high, above = (limits.get(n) for n in ("low", "high", "above"))
    if (low is not None and value < low) or (above is not None and value <= above) or (high is not None and value > high):
        return f"in {'above ' + str(above) if above is not None else low}..{high}"
    if limits.get("odd") and value % 2 == 0:
        return "odd"
    if limits.get("choices") and value not in limits["choices"]:
        return f"one of {limits['choices']}"
    return None


# Fixed values from here on: names, defaults and ranges of the settings. A fraction is above 0 and at most 1.
@dataclass(frozen=True)
class SegmentationConfig(Config):
    """Line grouping and layout relative to the text scale."""

    component_min_area_fraction: float = setting(0.000001, above=0, high=1)
    component_min_area_pixels: int = setting(2, low=1)
    line_min_area_fraction: float = setting(0.00001, above=0, high=1)
    scale_max_component_area_fraction: float = setting(0.05, above=0, high=1)
    core_min_height_scale: float = setting(0.4, above=0, high=1)
    horizontal_grouping_gap_scale: float = setting(4.0, above=0, high=20)
    vertical_grouping_tolerance_scale: float = setting(0.65, above=0, high=3)
    mark_attachment_distance_scale: float = setting(1.25, above=0, high=5)
    line_merge_gap_scale: float = setting(8.0, above=0, high=30)
    padding_scale: float = setting(0.2, low=0, high=1)
    spanning_width_fraction: float = setting(0.65, low=0.5, high=1)
    spanning_center_tolerance_fraction: float = setting(0.15, above=0, high=0.5)
    gutter_min_width_fraction: float = setting(0.06, above=0, high=0.5)
    gutter_min_width_scale: float = setting(2.0, above=0, high=20)
    minimum_column_lines: int = setting(2, low=2)
    minimum_paired_lines: int = setting(2, low=1)
    minimum_column_vertical_overlap: float = setting(0.35, above=0, high=1)
    y_order_tolerance_scale: float = setting(0.25, low=0, high=1)

    RULES = (
        (lambda c: c.line_min_area_fraction >= c.component_min_area_fraction, "a line is no smaller than a component"),
        (lambda c: c.scale_max_component_area_fraction > c.line_min_area_fraction, "the scale takes components larger than the least line"),
        (lambda c: c.line_merge_gap_scale >= c.horizontal_grouping_gap_scale, "fragments merge over no smaller gaps than components"),
    )

    # Values that the policy fixes without naming them as settings; no part of the fingerprint.
    component_overlap: ClassVar[float] = 0.25
    fragment_overlap: ClassVar[float] = 0.55
    fragment_center_scale: ClassVar[float] = 0.35
    core_area_scale: ClassVar[float] = 0.5
    pair_distance_scale: ClassVar[float] = 1.5
    gutter_search_fraction: ClassVar[float] = 0.5


@dataclass(frozen=True)
class PreprocessingConfig(Config):
    """From grey pixels to a foreground mask."""

    threshold_method: str = setting("otsu", choices=("otsu", "sauvola"))
    contrast_enabled: bool = False
    clahe_clip_limit: float = setting(2.0, above=0)
    clahe_grid_size: int = setting(8, low=2, high=64)
    denoise_enabled: bool = False
    median_kernel_size: int = setting(3, low=3, high=5, odd=True)
    morphology_operation: str = setting("none", choices=("none", "open", "close"))
    morphology_kernel_size: int = setting(3, low=3, high=5, odd=True)
    sauvola_window_size: int = setting(31, low=3, high=255, odd=True)
    sauvola_k: float = setting(0.2, above=0, high=1)
    sauvola_r: float = setting(128.0, above=0, high=255)
    blank_max_foreground_fraction: float = setting(0.001, above=0, high=1)
    blank_max_intensity_std: float = setting(3.0, above=0)
    meaningful_component_min_fraction: float = setting(0.00001, above=0, high=1)
    meaningful_component_min_pixels: int = setting(2, low=1)
    deskew_enabled: bool = False
    deskew_max_angle_degrees: float = setting(5.0, above=0, high=5)
    deskew_angle_step_degrees: float = setting(0.25, low=0.05)
    deskew_min_confidence: float = setting(0.01, low=0, high=1)

    RULES = ((lambda c: c.deskew_angle_step_degrees <= c.deskew_max_angle_degrees, "a step is no larger than the largest angle"),)

    border_fraction: ClassVar[float] = 0.05
    polarity_delta: ClassVar[float] = 1.0


@dataclass(frozen=True)
class InputLimitsConfig(Config):
    """Limits that hold before anything is decoded, and PDF resolutions."""

    max_input_bytes: int = setting(100 * 1024 * 1024, low=1)
    max_pages: int = setting(100, low=1)
    max_pixels_per_page: int = setting(50_000_000, low=1)
    max_document_pixels: int = setting(500_000_000, low=1)
    default_pdf_dpi: int = setting(200, low=1)
    min_pdf_dpi: int = setting(72, low=1)
    max_pdf_dpi: int = setting(400, low=1)

    RULES = (
        (lambda c: c.max_document_pixels >= c.max_pixels_per_page, "a document may hold one page of the largest size"),
        (lambda c: c.min_pdf_dpi <= c.default_pdf_dpi <= c.max_pdf_dpi, "the default resolution lies within its bounds"),
    )


@dataclass(frozen=True)
class DatasetSplitConfig(Config):
    """Ratios and seed of the greedy document split."""

    train_ratio: float = setting(0.80, low=0, high=1)
    validation_ratio: float = setting(0.10, low=0, high=1)
    test_ratio: float = setting(0.10, low=0, high=1)
    seed: int = setting(1337, low=0)

    RULES = ((lambda c: abs(c.train_ratio + c.validation_ratio + c.test_ratio - 1.0) <= 1e-12, "the ratios sum to 1"),)


@dataclass(frozen=True)
class RecognizerConfig(Config):
    """Size of line images and the blank class."""

    normalized_height: int = setting(64, low=64, high=64)
    max_width: int = setting(2048, low=64, high=2048)
    blank_index: int = setting(0, low=0, high=0)


@dataclass(frozen=True)
class InferenceConfig(Config):
    """Lines per batch."""

    batch_size: int = setting(16, low=1)


@dataclass(frozen=True)
class SyntheticDataConfig(Config):
    """Generated lines and pages."""

    seed: int = setting(240_817, low=0)
    font_size_min: int = setting(40, low=16)
    font_size_max: int = setting(54, low=0, high=96)
    horizontal_padding_min: int = setting(12, low=0)
    horizontal_padding_max: int = setting(28, low=0)
    vertical_padding_min: int = setting(8, low=0)
    vertical_padding_max: int = setting(16, low=0)
    background_intensity_min: int = setting(246, low=0, high=255)
    background_intensity_max: int = setting(255, low=0, high=255)
    text_intensity_min: int = setting(8, low=0, high=255)
    text_intensity_max: int = setting(48, low=0, high=255)
    blur_probability: float = setting(0.35, low=0, high=1)
    blur_sigma_min: float = setting(0.20, low=0)
    blur_sigma_max: float = setting(0.65, low=0)
    noise_probability: float = setting(0.40, low=0, high=1)
    noise_std_min: float = setting(0.40, low=0)
    noise_std_max: float = setting(1.80, low=0)
    skew_probability: float = setting(0.30, low=0, high=1)
    skew_max_abs_degrees: float = setting(2.50, low=0, high=5)
    max_line_width: int = setting(1_800, low=64)
    page_width: int = setting(1_000, low=800)
    page_height: int = setting(1_200, low=1_100)
    page_margin: int = setting(64, low=0)
    column_gutter: int = setting(100, low=0)

    RULES = (
        *(
            (lambda c, n=n: getattr(c, f"{n}_min") <= getattr(c, f"{n}_max"), f"{n} is ordered")
            for n in ("font_size", "horizontal_padding", "vertical_padding", "background_intensity", "text_intensity", "blur_sigma", "noise_std")
        ),
        (lambda c: c.text_intensity_max + 64 <= c.background_intensity_min, "text stands out by 64 at least"),
        (lambda c: 2 * c.page_margin + c.column_gutter < c.page_width, "margins and gutter leave room for columns"),
    )
