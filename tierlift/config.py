"""Experiment configuration: one frozen object drives every operator.

The analyses are parameterised by date windows, the tier ladder, labels and
finance assumptions.  Nothing below is read from the data; everything that the
original scripts hard-coded lives here instead.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, replace
from decimal import Decimal


#: Digits after the point that rates, multipliers and increments may have.
RATE_DIGITS = 8


def exact(value: float | int | str | Decimal, digits: int) -> str:
    """``value`` as the decimal number it was written as; an error if that has
    more than ``digits`` digits after the point (nothing is rounded)."""
    number = Decimal(str(value))
    if not number.is_finite() or -number.normalize().as_tuple().exponent > digits:
        raise ValueError(f"{value} needs more than {digits} digits after the point")
    return f"{number:f}"


@dataclass(frozen=True)
class Tier:
    """One rung of the loyalty ladder.

    ``min_orders``/``max_orders`` bound the distinct pre-window order count that
    places a non-member in this tier (``max_orders=None`` = open ended).
    """

    name: str
    control_label: str
    min_orders: int
    max_orders: int | None
    discount_rate: float
    sort_order: int


@dataclass(frozen=True)
class Scenario:
    """A what-if applied to the projected net position (gross × mult + inc)."""

    name: str
    gross_multiplier: float = 1.0
    gross_increment: float = 0.0
    cost_multiplier: float = 1.0
    sort_order: int = 0


# --- fixed values: tier ladder, labels and rates of the loyalty scheme -------
# Tier names, control labels, purchase thresholds (1, 2, 3, 4+) and discount
# rates (5 %, 10 %, 15 %, 20 %) must equal the scheme under analysis.
DEFAULT_TIERS: tuple[Tier, ...] = (
    Tier("Bronze", "bronze_control", 1, 1, 0.05, 1),
    Tier("Silver", "silver_control", 2, 2, 0.10, 2),
    Tier("Gold", "gold_control", 3, 3, 0.15, 3),
    Tier("Platinum", "platinum_control", 4, None, 0.20, 4),
)
# Group labels, the unknown-gender value, the remainder bucket, coupon classes.
TREATMENT = "Treatment"
CONTROL = "Control"
UNKNOWN_GENDER = "Unknown"
OTHER_CITY = "Other"
NO_COUPON = "No Coupon"
OTHER_COUPON = "Other Coupon"
TOTAL_LABEL = "Total"
# Scenarios of the financial impact section (pessimistic: half the gross,
# optimistic: base plus a referral increment of 18,932).
DEFAULT_SCENARIOS: tuple[Scenario, ...] = (
    Scenario("Pessimistic", 0.5, 0.0, 1.0, 1),
    Scenario("Base Case", 1.0, 0.0, 1.0, 2),
    Scenario("Optimistic", 1.0, 18932.0, 1.0, 3),
)
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class ExperimentConfig:
    """Dates, tiers and labels of one matched-cohort experiment.

    Windows are closed on both ends (``BETWEEN``).  ``launch`` is the exclusive
    upper bound on registration dates.  Defaults are the windows of the driver
    fixture (orders cover 1995-2001), shifted from the original 2022-2024.
    """

    pre_start: _dt.date = _dt.date(1996, 1, 1)
    pre_end: _dt.date = _dt.date(1997, 12, 31)
    launch: _dt.date = _dt.date(1998, 1, 1)
    post_start: _dt.date = _dt.date(1998, 1, 1)
    post_end: _dt.date = _dt.date(1998, 12, 31)
    tiers: tuple[Tier, ...] = DEFAULT_TIERS
    coupon_prefix: str = "FRIEND-"
    referral_label: str = "FRIEND"
    top_n_cities: int = 3
    scenarios: tuple[Scenario, ...] = DEFAULT_SCENARIOS
    # Cutoff balancing: id-range buckets per (tier, side) group and selection level.
    balance_buckets: int = 1024
    # Id filters hold 2^filter_bits slots: what they broadcast has at most
    # 2^filter_bits / 8 bytes.  Ids below 2^filter_bits are filtered exactly.
    filter_bits: int = 27
    # Repricing what-if used by the projection (tier -> new discount rate).
    repricing: tuple[tuple[str, float], ...] = (("Platinum", 0.15),)
    min_referrals: int = 3

    def __post_init__(self):
        if not self.tiers:
            raise ValueError("at least one tier is required")
        names = [t.name for t in self.tiers]
        labels = [t.control_label for t in self.tiers]
        if len(set(names)) != len(names) or len(set(labels)) != len(labels):
            raise ValueError("tier names and control labels must be unique")
        # The tier relation is broadcast everywhere: keep its size provably small.
        if len(self.tiers) > 64:
            raise ValueError("tier ladder larger than 64 rungs is not supported")
        if not 2 <= self.balance_buckets <= 65536:
            raise ValueError("balance_buckets must be in [2, 65536]")
        if not 15 <= self.filter_bits <= 31:
            raise ValueError("filter_bits must be in [15, 31]")
        if any(not 0 <= r < 1 for r in [*(t.discount_rate for t in self.tiers), *(r for _, r in self.repricing)]):
            raise ValueError("discount rates must be in [0, 1)")
        for t in self.tiers:
            exact(t.discount_rate, RATE_DIGITS)
        for _, rate in self.repricing:
            exact(rate, RATE_DIGITS)
        for s in self.scenarios:
            for number in (s.gross_multiplier, s.gross_increment, s.cost_multiplier):
                exact(number, RATE_DIGITS)
        if self.pre_start > self.pre_end or self.post_start > self.post_end:
            raise ValueError("empty date window")

    @property
    def tier_names(self) -> list[str]:
        return [t.name for t in self.tiers]

    def tier(self, name: str) -> Tier:
        for t in self.tiers:
            if t.name == name:
                return t
        raise KeyError(name)

    def with_(self, **kw) -> "ExperimentConfig":
        return replace(self, **kw)


DEFAULT_CONFIG = ExperimentConfig()
