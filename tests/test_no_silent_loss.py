"""Inputs and settings that must not be dropped, rounded or renamed without a word."""

from __future__ import annotations

import pytest
from helpers import CFG, POST, PRE, orders, tx_df, txn, user, users_df
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tierlift.config import ExperimentConfig, Scenario, Tier
from tierlift.functions import labels as L
from tierlift.operators.segments import pct_of_counts, top_n_with_other, value_ranks
from tierlift.plans import finance as M
from tierlift.plans import reports as R
from tierlift.plans.experiment import Experiment
from tierlift.sources import TRANSACTIONS, USERS, canonicalize, write_transactions


def test_absent_required_column_is_an_error(spark):
    with pytest.raises(ValueError, match="user_id"):
        canonicalize(spark.createDataFrame([(1, True)], "user_crm_id long, opt_in_status boolean"), USERS)
    ok = canonicalize(spark.createDataFrame([("1.0", "2020-01-01", "true", "false", None)],
                                            "user_id string, registration_date string, opt_in string, is_member string, "
                                            "member_tier string"), USERS).first()
    assert ok["user_id"] == 1 and ok["city"] is None


def test_ids_are_not_rounded_and_order_ids_may_be_text(spark):
    schema = "txn_date date, user_id double, txn_id string, revenue double"
    rows = [(PRE, 123.0, "T-1001", 1.0), (PRE, None, "T-1002", 2.0)]
    got = canonicalize(spark.createDataFrame(rows, schema), TRANSACTIONS).collect()
    assert [(r["user_id"], r["txn_id"]) for r in got] == [(123, "T-1001"), (None, "T-1002")]
    with pytest.raises(PySparkException, match="not an integer"):
        canonicalize(spark.createDataFrame([(PRE, 123.7, "T", 1.0)], schema), TRANSACTIONS).collect()


def test_rates_and_scenarios_are_exact(spark):
    cfg = ExperimentConfig(tiers=(Tier("T", "t_ctl", 1, None, 0.12345, 1),), repricing=(),
                           scenarios=(Scenario("S", 1.00000125, 0.125, 1.0, 1),))
    assert str(spark.range(1).select(F.lit("T").alias("t")).select(L.discount_rate("t", cfg)).first()[0]) == "0.12345000"
    profit = spark.createDataFrame([("Treatment", "T", 10, 1000.0, 0.0), ("Control", "T", 10, 0.0, 0.0)],
                                   "group_type string, tier string, total_users long, r double, c double").selectExpr(
        "group_type", "tier", "total_users", "CAST(r AS DECIMAL(38,6)) AS total_revenue",
        "CAST(c AS DECIMAL(38,6)) AS estimated_discount_cost", "CAST(0 AS DECIMAL(10,8)) AS discount_rate",
        "CAST(r AS DECIMAL(38,6)) AS net_revenue")
    full = spark.createDataFrame([("T", 1_000_000, 1_000_000)], "tier string, eligible_users long, non_members long")
    # gross 100 per user x 10^6 = 10^8; x 1.00000125 + 0.125 = 100000125.125
    assert M.scenario_table(profit, full, cfg).first()["gross_uplift"] == 100000125.13
    with pytest.raises(ValueError, match="digits"):
        ExperimentConfig(tiers=(Tier("T", "t_ctl", 1, None, 0.123456789, 1),), repricing=())


def test_any_bigint_is_a_referrer(spark):
    users = users_df(spark, [user(i) for i in range(1, 6)])
    big = 1234567890123456789
    tx = tx_df(spark, [txn(i, i, POST, coupon=f"PFX-{big}") for i in range(1, 5)]
               + [txn(i, 10 + i, POST, coupon="PFX-99999999999999999999") for i in range(1, 5)])
    got = M.referrals_by_referrer(tx, users, CFG).collect()
    assert [(r["referrer_id"], r["referred_users"]) for r in got] == [(big, 4)]


def test_null_groups_keep_their_share(spark):
    counts = spark.createDataFrame([(None, "x", 3), (None, "y", 1), ("g", "x", 2)], "g string, k string, n long")
    got = {(r["g"], r["k"]): r["pct_of_group"] for r in pct_of_counts(counts, "g", "n", 1).collect()}
    assert got == {(None, "x"): 75.0, (None, "y"): 25.0, ("g", "x"): 100.0}


def test_ranks_and_top_n_with_ties_and_nulls(spark):
    counts = spark.createDataFrame([("g", k, n) for k, n in [("a", 5), ("b", 5), ("c", 3), ("d", 3), (None, 9), ("e", 1)]],
                                   "g string, k string, n long")
    ranks = {r["k"]: r["rank"] for r in value_ranks(counts, "k", "n").collect()}
    assert ranks == {None: 1, "a": 2, "b": 2, "c": 4, "d": 4, "e": 6}
    got = {r["city"]: r["n"] for r in top_n_with_other(counts, "g", "k", "n", 2, "Other", "city").collect()}
    assert got == {"a": 5, "b": 5, "Other": 16}


@pytest.mark.parametrize("method", ["cutoff", "branches", "window"])
def test_repeated_user_ids_do_not_unbalance_the_sides(spark, method):
    users = users_df(spark, [user(10, True, "Bronze")] * 3 + [user(9, True, "Bronze")] + [user(11)] * 7)
    tx = tx_df(spark, orders(10, 1, 1) + orders(9, 1, 2) + orders(11, 1, 3))
    ex = Experiment(users, tx, CFG, balance_method=method)
    sizes = {r["tier_label"]: r["user_count"] for r in R.balanced_group_sizes(ex.cohort, CFG).collect()}
    assert sizes == {"Bronze": 4, "bronze_control": 4}


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    tx = tx_df(spark, [txn(i, i, PRE) for i in range(2_000)]).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the day is tiny here
    try:
        write_transactions(tx, str(tmp_path / "tx"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "tx" / f"txn_date={PRE}").glob("part-*"))) > 1
    assert spark.read.parquet(str(tmp_path / "tx")).count() == 2_000


def test_the_written_population_is_narrow(spark):
    ex = Experiment(users_df(spark, [user(1, True, "Bronze"), user(2)]), tx_df(spark, orders(1, 1, 1) + orders(2, 1, 2)), CFG)
    plan = R.balanced_group_sizes(ex.cohort, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "registration_date" not in plan and "city" not in plan
