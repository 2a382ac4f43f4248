"""Thresholds and defaults, kept as frozen dataclasses on the driver.

Fixed values that must equal the reference's defaults for the same
decisions (profile thresholds, correlation thresholds, feature budget,
split sizes, reward rules).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ProfileConfig:
    # fixed values: skew 3.0 (strict >), std ratio 1000.0 (strict >),
    # minority ratio 0.15 (strict <), outlier fence 3.0 * IQR, at least
    # 1 outlier, IQR floor 1e-5, seed 42, classification when at most 10
    # distinct target values, 20 % test rows, 40 histogram bins.
    skew_threshold: float = 3.0
    scale_ratio: float = 1000.0
    imbalance_threshold: float = 0.15
    outlier_iqr_factor: float = 3.0
    outlier_min_count: int = 1
    iqr_floor: float = 1e-5
    random_state: int = 42
    max_classes: int = 10
    test_size: float = 0.2
    histogram_bins: int = 40
    # exact quantiles: rank accuracy of the approximate bracket pass and the
    # largest bracket gathered per column before it is narrowed again
    quantile_accuracy: int = 10000
    quantile_max_bracket: int = 200000


@dataclass(frozen=True)
class CorrelationConfig:
    # fixed values: drop a feature when |corr(feature, target)| < 0.1;
    # a pair is redundant when |corr(a, b)| > 0.9
    target_corr_threshold: float = 0.1
    feature_corr_threshold: float = 0.9


@dataclass(frozen=True)
class FeatureConfig:
    # fixed values: budget max(1, int(0.5 * n_features)); stop after 5
    # non-improving candidates in a row
    max_feature_ratio: float = 0.5
    early_stop_patience: int = 5


@dataclass(frozen=True)
class RewardConfig:
    # fixed values: accuracy gain of at least 0.15 for the scaling check;
    # RMSLE below 0.5 x baseline for the log-target check; clip outliers at
    # 1.5 x IQR in the repair plan
    improvement_threshold: float = 0.15
    rmse_improvement_factor: float = 0.5
    clip_iqr_factor: float = 1.5


DEFAULT_PROFILE = ProfileConfig()
DEFAULT_CORR = CorrelationConfig()
DEFAULT_FEATURES = FeatureConfig()
DEFAULT_REWARD = RewardConfig()
