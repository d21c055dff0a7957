"""Settings of the estimator and their defaults."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum


class Metric(IntEnum):
    ABSOLUTE = 0
    RELATIVE = 1
    QUADRATIC = 2
    SQUARED_Q = 3
    SQUARED_RELATIVE = 4


class Online(IntEnum):
    VSGD_FD = 0
    RMSPROP = 1


@dataclass
class Config:
    kde_enable: bool = False
    kde_samplesize: int = 4300
    kde_error_metric: Metric = Metric.RELATIVE
    kde_bandwidth_representation: str = "plain"  # or log
    kde_collect_feedback: bool = False
    kde_enable_bandwidth_optimization: bool = False
    kde_optimization_feedback_window: int = -1
    kde_enable_adaptive_bandwidth: bool = False
    kde_minibatch_size: int = 5
    kde_online_optimization_algorithm: Online = Online.RMSPROP
    kde_sample_maintenance: str = "car"  # tkr, tkrp, pkr, prr or none
    kde_sample_maintenance_karma_limit: float = 4.0
    kde_sample_maintenance_karma_threshold: float = -2.0
    kde_sample_maintenance_period: int = 1
    stholes_enable: bool = False
    stholes_hole_limit: int = 2150
    statistics_target: int = 100
