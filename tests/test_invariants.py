"""Published relations as invariants on fixture output, and
report ordering (the driver compares results order-insensitively)."""

from __future__ import annotations

import pytest

from tierlift.config import DEFAULT_CONFIG as CFG
from tierlift.plans.experiment import Experiment

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def reports(spark):
    ex = Experiment.from_tpch(spark, SF, CFG, materialize=True)
    return {k: [r.asDict() for r in v.collect()] for k, v in ex.reports().items()}


def _label_map():
    return {t.control_label: t.name for t in CFG.tiers}


def test_g1_balanced_is_min_of_sides(spark, reports):
    # Published data: balanced = min(raw treatment, raw control).  The fixture
    # also has NULL-membership users, who count as raw control (S3) but never
    # enter the cohort, so the control side here is the IS FALSE count.
    from tierlift.operators.cohort import target_counts
    ex = Experiment.from_tpch(spark, SF, CFG, materialize=False)
    sides = {r["tier"]: r for r in target_counts(ex.eligible, CFG).collect()}
    raw = {r["tier_label"]: r["count_users"] for r in reports["tier_counts_raw"]}
    bal = {r["tier_label"]: r["user_count"] for r in reports["balanced_group_sizes"]}
    for t in CFG.tiers:
        s = sides[t.name]
        assert bal[t.name] == bal[t.control_label] == min(s["treatment_n"], s["control_n"])
        assert raw[t.control_label] >= s["control_n"] and raw[t.name] == s["treatment_n"]


def test_g2_full_eligible_is_raw_sum(reports):
    raw = {r["tier_label"]: r["count_users"] for r in reports["tier_counts_raw"]}
    full = {r["tier"]: r["full_eligible_users"] for r in reports["rollout_projection"]}
    for t in CFG.tiers:
        assert full[t.name] == raw[t.name] + raw[t.control_label]


def test_g3_g4_g6_engagement_consistency(reports):
    bal = {r["tier_label"]: r["user_count"] for r in reports["balanced_group_sizes"]}
    prof = {(r["group_type"], r["tier"]): r for r in reports["tier_profitability"]}
    for r in reports["engagement"]:
        assert r["total_users"] == bal[r["tier"]]
        assert r["repeat_purchase_rate_pct"] == round(100 * r["users_who_purchased"] / r["total_users"] + 1e-9, 1)
        p = prof[(r["group_type"], r["tier"])]
        assert p["users_who_purchased"] == r["users_who_purchased"]
        assert p["avg_revenue_per_user"] == r["avg_revenue_per_user"]


def test_g5_discount_and_net(reports):
    for r in reports["tier_profitability"]:
        rate = CFG.tier(r["tier"]).discount_rate if r["group_type"] == "Treatment" else 0.0
        cost = r["total_revenue"] * rate / (1 - rate)
        assert abs(r["estimated_discount_cost"] - cost) <= 0.006
        assert abs(r["net_revenue"] - (r["total_revenue"] - cost)) <= 0.006


def test_g7_g8_shares_sum_to_100(reports):
    for key, group, digits in (("coupon_usage", "tier", 2), ("gender_split", "group_type", 1),
                               ("city_split", "group_type", 1)):
        sums = {}
        for r in reports[key]:
            col = "pct_of_transactions" if key == "coupon_usage" else "pct_of_group"
            sums[r[group]] = sums.get(r[group], 0) + r[col]
        for v in sums.values():
            assert abs(v - 100) <= 0.5 * 10 ** (-digits) * 4


def test_city_groups_cover_each_side(reports):
    bal = {r["tier_label"]: r["user_count"] for r in reports["balanced_group_sizes"]}
    side = sum(bal[t.name] for t in CFG.tiers)
    for g in ("Treatment", "Control"):
        assert sum(r["user_count"] for r in reports["city_split"] if r["group_type"] == g) == side


def test_report_ordering(reports):
    order = {t.name: t.sort_order for t in CFG.tiers}
    eng = [(order[r["tier"]], r["group_type"]) for r in reports["engagement"]]
    assert eng == sorted(eng, key=lambda x: (x[0], x[1] != "Treatment"))
    labels = [r["tier_label"] for r in reports["balanced_group_sizes"]]
    assert labels == [x for t in CFG.tiers for x in (t.name, t.control_label)]
    raw = [r["count_users"] for r in reports["tier_counts_raw"]]
    assert raw == sorted(raw)
    cities = [(r["group_type"], r["user_count"]) for r in reports["city_split"]]
    assert cities == sorted(cities, key=lambda x: (x[0] != "Treatment", -x[1]))
    cu = [(order[r["tier"]], r["coupon_type"]) for r in reports["coupon_usage"]]
    assert cu == sorted(cu)


def test_write_reports(spark, tmp_path):
    ex = Experiment.from_tpch(spark, "/root/testdata/sf0.001", CFG, materialize=True)
    paths = ex.write_reports(str(tmp_path))
    assert set(paths) == {*Experiment.REPORTS, *Experiment.FINANCE}
    text = (tmp_path / "engagement.csv").read_text().splitlines()
    assert text[0] == ("group_type,tier,total_users,users_who_purchased,repeat_purchase_rate_pct,"
                       "avg_order_value,avg_revenue_per_user") and len(text) == 9
