"""tierlift: matched-cohort experiment analytics for tiered loyalty schemes on Spark.

Select eligible users from a pre-launch purchase window, split members
(treatment) from non-members (control) by tier, downsample both sides to equal,
reproducible per-tier cohorts, and report segmentation, repeat purchase, order
value, coupon mix, discount cost, net uplift and rollout projections - all as
lazy DataFrame plans driven by one :class:`ExperimentConfig`.
"""

from .config import DEFAULT_CONFIG, ExperimentConfig, Scenario, Tier
from .plans.experiment import Experiment

__all__ = ["DEFAULT_CONFIG", "Experiment", "ExperimentConfig", "Scenario", "Tier"]
