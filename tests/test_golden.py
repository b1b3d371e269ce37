"""Finance operators reproduce the published figures from the published
per-tier results (inputs embedded from FIXTURES.md §3)."""

from __future__ import annotations

from decimal import Decimal

import pytest

from tierlift.config import DEFAULT_CONFIG
from tierlift.plans import finance as M
from tierlift.plans import reports as R

# Published per-tier results: (group, tier, users, buyers, revenue, rev/buyer, discount, net).
PUBLISHED_PROFIT = [
    ("Treatment", "Bronze", 7512, 2397, "129411.32", "53.99", "6811.12", "122600.20"),
    ("Control", "Bronze", 7512, 1411, "87102.60", "61.73", "0", "87102.60"),
    ("Treatment", "Silver", 2192, 954, "65378.56", "68.53", "7264.28", "58114.28"),
    ("Control", "Silver", 2192, 637, "45324.86", "71.15", "0", "45324.86"),
    ("Treatment", "Gold", 797, 420, "33420.65", "79.57", "5897.76", "27522.89"),
    ("Control", "Gold", 797, 278, "23911.30", "86.01", "0", "23911.30"),
    ("Treatment", "Platinum", 818, 549, "61068.40", "111.24", "15267.10", "45801.30"),
    ("Control", "Platinum", 818, 370, "49700.13", "134.32", "0", "49700.13"),
]
RATES = {"Bronze": "0.0500", "Silver": "0.1000", "Gold": "0.1500", "Platinum": "0.2000"}
# (tier, all eligible, eligible non-members)
PUBLISHED_FULL = [("Bronze", 15492, 7980), ("Silver", 4499, 2192), ("Gold", 1671, 797), ("Platinum", 1830, 818)]


@pytest.fixture(scope="module")
def profit(spark):
    rows = [(g, t, u, b, Decimal(rev), Decimal(rpb), Decimal(RATES[t] if g == "Treatment" else "0"),
             Decimal(d), Decimal(n)) for g, t, u, b, rev, rpb, d, n in PUBLISHED_PROFIT]
    return spark.createDataFrame(rows, "group_type string, tier string, total_users bigint, "
                                       "users_who_purchased bigint, total_revenue decimal(38,2), "
                                       "avg_revenue_per_user decimal(38,2), discount_rate decimal(10,4), "
                                       "estimated_discount_cost decimal(38,2), net_revenue decimal(38,2)")


@pytest.fixture(scope="module")
def full(spark):
    return spark.createDataFrame(PUBLISHED_FULL, "tier string, eligible_users bigint, non_members bigint")


def _by_tier(df):
    return {r["tier"]: r for r in df.collect()}


def test_uplift_totals(profit):
    t = _by_tier(M.uplift_summary(profit, DEFAULT_CONFIG))["Total"]
    assert (t["gross_uplift"], t["discount_cost"], t["net_uplift"]) == (83240.04, 35240.26, 47999.78)


def test_rollout_projection_all_eligible(profit, full):
    got = _by_tier(R.rollout_projection(profit, full, DEFAULT_CONFIG))
    assert [(got[t]["ab_net_uplift"], got[t]["net_uplift_per_user"], got[t]["projected_net_uplift"])
            for t in ("Bronze", "Silver", "Gold", "Platinum")] == [
        (35498.0, 4.73, 73207.0), (12789.0, 5.83, 26250.0), (3612.0, 4.53, 7572.0), (-3899.0, -4.77, -8722.0)]


def test_rollout_non_members(profit, full):
    got = _by_tier(M.rollout_non_members(profit, full, DEFAULT_CONFIG))
    assert [got[t]["projected_net_uplift"] for t in ("Bronze", "Silver", "Gold", "Platinum", "Total")] == [
        37709.0, 12789.0, 3612.0, -3899.0, 50211.0]
    assert got["Bronze"]["net_uplift_per_user"] == 4.7255


def test_projection_base_case_and_payback(profit, full):
    t = _by_tier(M.projected_net_position(profit, full, DEFAULT_CONFIG))["Total"]
    assert (t["projected_gross_uplift"], t["projected_discount_cost"], t["projected_net_uplift"]) == (
        85875.89, 31847.82, 54028.07)
    assert t["payback_months"] == 4.45


def test_per_user_economics(profit):
    got = _by_tier(M.per_user_economics(profit, DEFAULT_CONFIG))
    assert (got["Bronze"]["gross_uplift_per_user"], got["Bronze"]["discount_per_user"]) == (5.6322, 0.9067)
    assert got["Platinum"]["discount_per_user"] == 18.6639


def test_scenarios(profit, full):
    got = {r["scenario"]: r for r in M.scenario_table(profit, full, DEFAULT_CONFIG).collect()}
    assert got["Pessimistic"]["net_position"] == 11090.12
    assert got["Base Case"]["net_position"] == 54028.07
    assert got["Optimistic"]["gross_uplift"] == 104807.89


def test_platinum_repricing_inverse_rate(profit):
    got = _by_tier(M.tier_repricing(profit, DEFAULT_CONFIG))["Platinum"]
    assert (got["repriced_discount_cost"], got["repriced_net_uplift"]) == (10776.78, 591.49)
    assert got["net_uplift"] == -3898.83


def test_platinum_repricing_linear(profit):
    got = _by_tier(M.tier_repricing(profit, DEFAULT_CONFIG, method="linear"))["Platinum"]
    assert got["repriced_discount_cost"] == 11450.33
