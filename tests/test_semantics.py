"""Micro-frame tests, one per population / metric rule of the analyses."""

from __future__ import annotations

import datetime as dt

import pytest

from tierlift.operators import cohort as C
from tierlift.operators import facts as FX
from tierlift.operators import segments as S
from tierlift.operators.windowing import window_txn_counts
from tierlift.plans import reports as R
from tierlift.plans.experiment import Experiment

from helpers import CFG, POST, orders, tx_df, txn, user, users_df

METHODS = ["window", "cutoff", "branches"]


def _ex(spark, users, txs, method="cutoff"):
    return Experiment(users_df(spark, users), tx_df(spark, txs), CFG, balance_method=method,
                      materialize=False)


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((v is None, v if v is not None else 0) for v in t))


def test_null_membership_raw_but_not_balanced(spark):
    users = [user(1, True, "Silver"), user(2, None), user(3, False)]
    txs = orders(1, 2, 100) + orders(2, 2, 200) + orders(3, 2, 300)
    ex = _ex(spark, users, txs)
    assert _rows(ex.tier_counts_raw(), "tier_label", "count_users") == [("Silver", 1), ("silver_control", 2)]
    assert _rows(ex.cohort, "user_id", "group_type") == [(1, "Treatment"), (3, "Control")]
    assert _rows(ex.full, "tier", "eligible_users", "non_members") == [("Silver", 3, 2)]


def test_stored_tier_wins_for_members(spark):
    users = [user(1, True, "Platinum"), user(2, False)]
    txs = orders(1, 1, 100) + orders(2, 4, 200)
    ex = _ex(spark, users, txs)
    assert _rows(ex.cohort, "user_id", "tier", "tier_label") == [(1, "Platinum", "Platinum"),
                                                                 (2, "Platinum", "platinum_control")]


def test_null_stored_tier_in_raw_counts_only(spark):
    users = [user(1, True, None), user(2, False), user(3, True, "Bronze")]
    txs = orders(1, 1, 100) + orders(2, 1, 200) + orders(3, 1, 300)
    ex = _ex(spark, users, txs)
    assert (None, 1) in _rows(ex.tier_counts_raw(), "tier_label", "count_users")
    assert _rows(ex.cohort, "user_id") == [(2,), (3,)]


def test_one_sided_tier_disappears(spark):
    users = [user(i, True, "Gold") for i in (1, 2, 3)] + [user(4, True, "Bronze"), user(5, False)]
    txs = [t for i in (1, 2, 3) for t in orders(i, 3, 100 * i)] + orders(4, 1, 400) + orders(5, 1, 500)
    ex = _ex(spark, users, txs)
    assert _rows(C.target_counts(ex.eligible, CFG), "tier", "target_n") == [("Bronze", 1)]
    assert {r["tier"] for r in ex.cohort.collect()} == {"Bronze"}


@pytest.mark.parametrize("method", METHODS)
def test_numeric_id_order_keeps_smallest(spark, method):
    users = [user(2, True, "Bronze"), user(10, True, "Bronze"), user(9, True, "Bronze"),
             user(100, False), user(101, False)]
    txs = [t for u in (2, 10, 9, 100, 101) for t in orders(u, 1, 1000 * u)]
    ex = _ex(spark, users, txs, method)
    assert _rows(ex.cohort, "user_id") == [(2,), (9,), (100,), (101,)]


def test_repeated_order_id_and_null_id_rows(spark):
    users = [user(1, True, "Bronze"), user(2, False), user(3, True, "Bronze"), user(4, False)]
    txs = (orders(1, 1, 10) + orders(2, 1, 20) + orders(3, 1, 30) + orders(4, 1, 40)
           + [txn(1, 7, POST, "1.00"), txn(1, 7, POST, "1.00"), txn(1, 7, POST, "4.00")]
           + [txn(2, None, POST, "5.00")])
    ex = _ex(spark, users, txs)
    post = {r["user_id"]: r for r in ex.post.collect()}
    assert post[1]["n_orders"] == 1 and float(post[1]["revenue"]) == 6.0 and float(post[1]["aov"]) == 2.0
    assert post[2]["n_orders"] == 0 and float(post[2]["revenue"]) == 5.0
    prof = {(r["group_type"], r["tier"]): r for r in ex.tier_profitability().collect()}
    assert prof[("Control", "Bronze")]["users_who_purchased"] == 0
    assert prof[("Control", "Bronze")]["total_revenue"] == 0.0


def test_mean_of_means_and_half_cent(spark):
    users = [user(1, True, "Bronze"), user(2, True, "Bronze"), user(3, False), user(4, False),
             user(5, True, "Silver"), user(6, False)]
    txs = ([t for u in (1, 2, 3, 4) for t in orders(u, 1, 100 * u)] + orders(5, 2, 500) + orders(6, 2, 600)
           + [txn(1, 11, POST, "10.00"), txn(1, 12, POST, "10.00"), txn(1, 13, POST, "10.00"),
              txn(2, 21, POST, "40.00"),
              txn(5, 51, POST, "1.00"), txn(5, 52, POST, "1.01")])
    ex = _ex(spark, users, txs)
    eng = {(r["group_type"], r["tier"]): r for r in ex.engagement().collect()}
    assert eng[("Treatment", "Bronze")]["avg_order_value"] == 25.0  # not 70 / 4 = 17.5
    assert eng[("Treatment", "Bronze")]["repeat_purchase_rate_pct"] == 100.0
    assert eng[("Treatment", "Silver")]["avg_order_value"] == 1.01  # mean 1.005, half up


def test_gender_excludes_unknown_and_null(spark):
    rows = [("Treatment", g) for g in ("M", "F", "Unknown", None)]
    cohort = spark.createDataFrame(rows, "group_type string, gender string")
    out = R.gender_split(cohort, CFG)
    assert _rows(out, "gender", "user_count", "pct_of_group") == [("F", 1, 50.0), ("M", 1, 50.0)]


def _city_groups(spark, cities):
    cohort = spark.createDataFrame([("Treatment", c) for c in cities], "group_type string, city string")
    out = R.city_split(cohort, CFG)
    return _rows(out, "city_grouped", "user_count")


def test_city_rank_ties_name_more_than_n(spark):
    got = _city_groups(spark, ["A"] * 3 + ["B"] * 2 + ["C", "D"])
    assert got == [("A", 3), ("B", 2), ("C", 1), ("D", 1)]


def test_null_city_takes_a_rank_but_falls_to_other(spark):
    got = _city_groups(spark, [None] * 4 + ["A"] * 3 + ["B"] * 2 + ["C"])
    assert got == [("A", 3), ("B", 2), ("Other", 5)]


def test_value_ranks_match_rank_semantics(spark):
    counts = spark.createDataFrame([("g", c, n) for c, n in [("a", 5), ("b", 5), ("c", 3), ("d", 1), (None, 3)]],
                                   "g string, k string, n bigint")
    got = _rows(S.value_ranks(counts, "k", "n", "rank"), "k", "rank")
    assert got == [("a", 1), ("b", 1), ("c", 3), ("d", 5), (None, 3)]


def test_coupon_classes(spark):
    codes = ["PFX-1", "pfx-1", "", None, "SAVE"]
    tx = tx_df(spark, [txn(1, i, POST, "1.00", c) for i, c in enumerate(codes)])
    got = dict(_rows(FX.classified_transactions(tx, CFG), "txn_id", "coupon_type"))
    assert [got[i] for i in range(5)] == ["PFX", "Other Coupon", "No Coupon", "No Coupon", "Other Coupon"]


def test_multi_class_order_counts_in_each_class(spark):
    users = [user(1, True, "Bronze"), user(2, False)]
    txs = (orders(1, 1, 10) + orders(2, 1, 20)
           + [txn(1, 5, POST, "1.00", "PFX-1"), txn(1, 5, POST, "1.00", None)])
    ex = _ex(spark, users, txs)
    got = _rows(ex.coupon_usage(), "coupon_type", "transactions", "pct_of_transactions")
    assert got == [("No Coupon", 1, 50.0), ("PFX", 1, 50.0)]


def test_window_edges_closed(spark):
    days = [dt.date(2021, 12, 31), dt.date(2022, 1, 1), dt.date(2023, 12, 31), dt.date(2024, 1, 1)]
    tx = tx_df(spark, [txn(1, i, d) for i, d in enumerate(days)])
    assert _rows(window_txn_counts(tx, CFG.pre_start, CFG.pre_end), "user_id", "n_orders") == [(1, 2)]


def test_anonymous_rows_never_counted(spark):
    tx = tx_df(spark, [txn(None, 1), txn(None, 2), txn(3, 3)])
    assert _rows(window_txn_counts(tx, CFG.pre_start, CFG.pre_end), "user_id", "n_orders") == [(3, 1)]


def test_ineligible_filters(spark):
    users = [user(1, True, "Bronze", reg=dt.date(2024, 1, 1)), user(2, True, "Bronze", opt_in=None),
             user(3, True, "Bronze", opt_in=False), user(4, True, "Bronze")]
    txs = [t for u in (1, 2, 3, 4) for t in orders(u, 1, 10 * u)] + [txn(5, 99)]
    ex = _ex(spark, users, txs)
    assert _rows(ex.eligible, "user_id") == [(4,)]


def test_discount_cost_inverse_rate(spark):
    users = [user(1, True, "Bronze"), user(2, False)]
    txs = orders(1, 1, 10) + orders(2, 1, 20) + [txn(1, 30, POST, "95.00"), txn(2, 40, POST, "50.00")]
    ex = _ex(spark, users, txs)
    prof = {r["group_type"]: r for r in ex.tier_profitability().collect()}
    assert prof["Treatment"]["estimated_discount_cost"] == 5.0
    assert prof["Treatment"]["net_revenue"] == 90.0
    assert prof["Control"]["estimated_discount_cost"] == 0.0


def test_string_key_join_equals_native(spark):
    users = [user(i, i % 2 == 0, "Bronze" if i % 2 == 0 else None) for i in range(1, 9)]
    txs = [t for i in range(1, 9) for t in orders(i, 1, 10 * i)] + [txn(i, 100 + i, POST, "3.00") for i in range(1, 9, 3)]
    ex = _ex(spark, users, txs)
    a = _rows(ex.post, "user_id", "n_orders", "revenue")
    b = _rows(FX.user_post_launch_string_keys(ex.cohort, ex.tx, CFG), "user_id", "n_orders", "revenue")
    assert a == b


def test_canonical_ids_from_float_strings(spark):
    from tierlift.sources.readers import canonicalize
    from tierlift.sources.schemas import TRANSACTIONS
    raw = spark.createDataFrame([("2024-03-01", "123.0", "7", 7.0, "1.5")],
                                "txn_date string, user_id string, txn_id string, n double, revenue string")
    got = canonicalize(raw, TRANSACTIONS).collect()[0]
    assert got["user_id"] == 123 and got["txn_date"] == dt.date(2024, 3, 1)
    assert got["txn_id"] == "7"  # text order ids stay text, others become BIGINT
    assert canonicalize(raw.drop("txn_id").withColumnRenamed("n", "txn_id"), TRANSACTIONS).collect()[0]["txn_id"] == 7


def test_csv_roundtrip_reader(spark, tmp_path):
    from tierlift.sources.readers import read_users
    p = tmp_path / "users.csv"
    p.write_text("user_id,city,gender,registration_date,opt_in,is_member,member_tier\n"
                 "5.0,London,F,2021-02-03,true,true,Gold\n")
    u = read_users(spark, str(p), fmt="csv").collect()[0]
    assert u["user_id"] == 5 and u["is_member"] is True and u["registration_date"] == dt.date(2021, 2, 3)


def test_report_csv_sink(spark, tmp_path):
    from tierlift.sources.sinks import write_report_csv
    df = spark.createDataFrame([("Bronze", 3)], "tier string, n bigint")
    write_report_csv(df, str(tmp_path / "out"))
    parts = list((tmp_path / "out").glob("part-*.csv"))
    assert len(parts) == 1 and parts[0].read_text().splitlines() == ["tier,n", "Bronze,3"]


def test_referrals_exclude_self_and_parse(spark):
    from tierlift.plans.finance import referrals_by_referrer
    users = users_df(spark, [user(42, True, "Gold")])
    txs = [txn(u, 100 + u, POST, "1.00", "PFX-42") for u in (1, 2, 3)] + [txn(42, 500, POST, "1.00", "PFX-42"),
                                                                           txn(7, 600, POST, "1.00", "PFX-x")]
    out = referrals_by_referrer(tx_df(spark, txs), users, CFG, min_referrals=3).collect()
    assert [(r["referrer_id"], r["referrer_is_member"], r["referred_users"]) for r in out] == [(42, True, 3)]


def test_cutoff_with_observed_ranges_matches_window(spark):
    from tierlift.sources.fixtures import TpchFixture
    from tierlift.config import DEFAULT_CONFIG
    fx = TpchFixture(spark, "/root/testdata/sf0.01", DEFAULT_CONFIG)
    ex = Experiment(fx.users(), fx.transactions(), DEFAULT_CONFIG.with_(balance_buckets=7),
                    balance_method="cutoff", materialize="eligible")
    got = {(r.user_id, r.group_type) for r in ex.cohort.collect()}
    assert ex._side_counts is not None and "t0_lo" in ex._side_counts
    ref = Experiment(fx.users(), fx.transactions(), DEFAULT_CONFIG, balance_method="window", materialize=False)
    assert got == {(r.user_id, r.group_type) for r in ref.cohort.collect()}


def test_date_partitioned_transactions_prune(spark, tmp_path):
    from tierlift.sources import read_transactions, write_transactions
    days = [dt.date(2021, 12, 31), dt.date(2022, 1, 1), dt.date(2023, 12, 31), dt.date(2024, 1, 1)]
    write_transactions(tx_df(spark, [txn(1, i, d) for i, d in enumerate(days)]), str(tmp_path / "tx"))
    tx = read_transactions(spark, str(tmp_path / "tx"))
    counts = window_txn_counts(tx, CFG.pre_start, CFG.pre_end)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_date" in plan
    assert _rows(counts, "user_id", "n_orders") == [(1, 2)]


def test_column_map_renames_source_columns(spark, tmp_path):
    from tierlift.sources import read_users
    p = tmp_path / "u.csv"
    p.write_text("customer_key,member_flag,segment_tier,reg,opt_in\n7,false,,2020-05-06,true\n")
    u = read_users(spark, str(p), fmt="csv", column_map={"customer_key": "user_id", "member_flag": "is_member",
                                                         "segment_tier": "member_tier", "reg": "registration_date"})
    r = u.collect()[0]
    assert (r.user_id, r.is_member, r.member_tier, r.registration_date) == (7, False, None, dt.date(2020, 5, 6))


def test_city_rank_over_both_groups_shares_per_group(spark):
    rows = ([("Treatment", "A")] * 3 + [("Treatment", "B")] + [("Control", "B")] * 3 + [("Control", "C")])
    cohort = spark.createDataFrame(rows, "group_type string, city string")
    out = R.city_split(cohort, CFG.with_(top_n_cities=1))
    got = _rows(out, "group_type", "city_grouped", "user_count", "pct_of_group")
    # B (4 users over both groups) is rank 1 although A leads inside Treatment.
    assert got == [("Control", "B", 3, 75.0), ("Control", "Other", 1, 25.0),
                   ("Treatment", "B", 1, 25.0), ("Treatment", "Other", 3, 75.0)]


def test_unlisted_stored_tier_raw_only(spark):
    users = [user(1, True, "Diamond"), user(2, True, "Bronze"), user(3, False)]
    txs = orders(1, 1, 100) + orders(2, 1, 200) + orders(3, 1, 300)
    ex = _ex(spark, users, txs)
    assert ("Diamond", 1) in _rows(ex.tier_counts_raw(), "tier_label", "count_users")
    assert _rows(ex.cohort, "user_id") == [(2,), (3,)]
    assert ("Diamond", 1, 0) in _rows(ex.full, "tier", "eligible_users", "non_members")


def test_duplicate_user_ids_are_reported(spark):
    users = [user(1, True, "Bronze"), user(1, False), user(2, False)]
    with pytest.raises(ValueError, match="user_id 1 occurs 2 times"):
        Experiment(users_df(spark, users), tx_df(spark, orders(1, 1, 10)), CFG, check_unique_ids=True)
    ok = Experiment(users_df(spark, users[1:]), tx_df(spark, orders(1, 1, 10)), CFG, check_unique_ids=True)
    assert ok.cfg is CFG
