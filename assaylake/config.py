"""Thresholds of the operators, validated when they are built."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .fixed_values import TRIGGER_FRACTIONS, TRIGGER_PATCH_SIZES, TRIGGER_PATTERNS


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def _shares(config, *names: str) -> None:
    for name in names:
        _check(0 <= getattr(config, name) <= 1, f"{name} must be in [0, 1]")


@dataclass(frozen=True)
class ContributorConfig:
    volume_factor: float = 3.0
    concentration_min_images: int = 5
    concentration_ratio: float = 0.90
    elevated_rate: float = 0.25
    high_rate: float = 0.50
    entropy_min_contributors: int = 3
    entropy_factor: float = 0.25
    high_score: float = 50.0
    medium_score: float = 25.0

    def __post_init__(self):
        _check(self.volume_factor > 0, "volume_factor must be positive")
        _check(self.concentration_min_images >= 1, "concentration_min_images must be >= 1")
        _shares(self, "concentration_ratio", "elevated_rate", "high_rate", "entropy_factor")
        _check(self.elevated_rate <= self.high_rate, "elevated_rate must not exceed high_rate")
        _check(self.entropy_min_contributors >= 1, "entropy_min_contributors must be >= 1")
        _check(0 <= self.medium_score <= self.high_score, "scores must rise from medium to high")


@dataclass(frozen=True)
class MetadataConfig:
    min_contributor_images: int = 3
    elevated_divergence: float = 0.5
    high_divergence: float = 0.8
    rare_resolution_fraction: float = 0.05
    rare_resolution_min_dataset: int = 20
    time_outlier_days: float = 365.0
    min_timestamps_for_outlier: int = 5

    def __post_init__(self):
        _shares(self, "elevated_divergence", "high_divergence", "rare_resolution_fraction")
        _check(self.elevated_divergence <= self.high_divergence, "elevated_divergence must not exceed high_divergence")
        _check(self.time_outlier_days > 0, "time_outlier_days must be positive")
        _check(min(self.min_contributor_images, self.rare_resolution_min_dataset, self.min_timestamps_for_outlier) >= 1, "minimum counts must be >= 1")


@dataclass(frozen=True)
class PatternConfig:
    hamming_tolerance: int = 6
    min_pattern_images: int = 3
    spatial_tolerance: float = 0.08
    spatial_min_fraction: float = 0.75
    class_min_share: float = 0.8
    class_max_p: float = 0.01
    majority_support: float = 0.5
    high_count: int = 5

    def __post_init__(self):
        _check(0 <= self.hamming_tolerance <= 64, "hamming_tolerance must be in [0, 64]")
        _check(self.min_pattern_images >= 2, "min_pattern_images must be >= 2")
        _shares(self, "spatial_tolerance", "spatial_min_fraction", "class_min_share", "class_max_p", "majority_support")
        _check(self.high_count >= 1, "high_count must be >= 1")


@dataclass(frozen=True)
class ShiftConfig:
    histogram_bins: int = 16
    brightness_threshold: float = 0.08
    contrast_threshold: float = 0.08
    saturation_threshold: float = 0.08
    edge_density_threshold: float = 0.08
    overall_shift_threshold: float = 0.20
    image_anomaly_z: float = 3.0
    many_anomalies: int = 5

    def __post_init__(self):
        _check(self.histogram_bins >= 1, "histogram_bins must be >= 1")
        _check(self.image_anomaly_z > 0, "image_anomaly_z must be positive")

    def threshold(self, feature: str) -> float:
        return getattr(self, f"{feature}_threshold")


@dataclass(frozen=True)
class FingerprintThresholds:
    prediction_agreement: float = 0.05
    mean_confidence: float = 0.05
    mean_entropy: float = 0.10
    prediction_distribution_tv: float = 0.10
    mean_probability_js: float = 0.05

    def __post_init__(self):
        for item in fields(self):
            _check(getattr(self, item.name) >= 0, f"{item.name} must be non-negative")


@dataclass(frozen=True)
class TensorThresholds:
    count_rel_diff: float = 0.0
    param_mean_norm_diff: float = 0.05
    param_std_rel_diff: float = 0.05
    param_zero_fraction_abs_diff: float = 0.01
    param_extreme_norm_diff: float = 0.25
    activation_mean_norm_diff: float = 0.10
    activation_std_rel_diff: float = 0.10
    activation_zero_fraction_abs_diff: float = 0.05
    activation_extreme_norm_diff: float = 0.25
    activation_percentile_norm_diff: float = 0.25
    non_finite_count_abs_diff: float = 0.0
    eps: float = 1e-12

    def __post_init__(self):
        for item in fields(self):
            _check(getattr(self, item.name) >= 0, f"{item.name} must be non-negative")
        _check(self.eps > 0, "eps must be > 0")


@dataclass(frozen=True)
class TriggerConfig:
    patch_sizes: tuple = TRIGGER_PATCH_SIZES
    grid_fractions: tuple = TRIGGER_FRACTIONS
    patterns: tuple = TRIGGER_PATTERNS
    min_prediction_change_rate: float = 0.60
    min_confidence_gain: float = 0.05
    min_probability_l1_change: float = 1.0
    min_samples: int = 3

    def __post_init__(self):
        _check(bool(self.patch_sizes) and all(s > 0 for s in self.patch_sizes), "patch sizes must be positive")
        _check(bool(self.grid_fractions) and all(0 <= f <= 1 for f in self.grid_fractions),
               "grid fractions must be in [0, 1]")
        _check(not set(self.patterns) - set(TRIGGER_PATTERNS), "unsupported trigger pattern")
        _check(0 <= self.min_prediction_change_rate <= 1, "min_prediction_change_rate must be in [0, 1]")
        _check(self.min_confidence_gain >= 0, "min_confidence_gain must be non-negative")
        _check(self.min_probability_l1_change >= 0, "min_probability_l1_change must be non-negative")
        _check(self.min_samples >= 1, "min_samples must be >= 1")
