"""Thresholds out of range are refused when they are built."""

import pytest

from assaylake import config

WRONG = [
    (config.ContributorConfig, {"elevated_rate": 0.9, "high_rate": 0.5}), (config.ContributorConfig, {"concentration_ratio": 1.5}),
    (config.MetadataConfig, {"high_divergence": -0.1}), (config.MetadataConfig, {"time_outlier_days": 0}), (config.PatternConfig, {"hamming_tolerance": 65}),
    (config.PatternConfig, {"min_pattern_images": 1}), (config.ShiftConfig, {"histogram_bins": 0}),
    (config.FingerprintThresholds, {"mean_entropy": -1}), (config.TensorThresholds, {"eps": 0}), (config.TriggerConfig, {"patterns": ("striped",)}),
]


@pytest.mark.parametrize("kind,values", WRONG)
def test_refused(kind, values):
    kind()
    with pytest.raises(ValueError):
        kind(**values)
