"""The bitmap filter on user ids and the plan of the coupon analysis."""

from __future__ import annotations

import random

import pytest
from helpers import CFG, POST, tx_df, txn, user, users_df

from tierlift.operators.facts import treatment_orders_by_class
from tierlift.operators.idfilter import only_users, user_bitmaps
from tierlift.plans.experiment import Experiment


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("bits", [15, 20])
def test_only_users_loses_no_row(spark, kind, bits):
    rng = random.Random(bits)
    ids = [0, 1, 7, 8, 32_767, 32_768, -1, -(1 << 63), (1 << 63) - 1] + [rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)]
    ids += list(range(40_000, 40_400))
    chosen = set(ids[::2])
    as_kind = (lambda i: f"C-{i}") if kind == "string" else (lambda i: i)
    rows = spark.createDataFrame([(as_kind(i), k) for i in ids for k in range(2)] + [(None, 9)], f"user_id {kind}, k int")
    users = spark.createDataFrame([(as_kind(i),) for i in chosen] + [(None,)], f"user_id {kind}")
    got = only_users(rows, users, bits=bits)
    assert got.columns == rows.columns
    kept = {r["user_id"] for r in got.collect()}
    assert {as_kind(i) for i in chosen} <= kept and None not in kept
    assert got.where(got["user_id"].isin([as_kind(i) for i in chosen])).count() == 2 * len(chosen)
    # ids of slots of their own are filtered exactly
    if kind == "long":
        small = {i for i in ids if 0 <= i < 1 << bits}
        alone = only_users(rows.where(f"user_id >= 0 AND user_id < {1 << bits}"), users.where(f"user_id >= 0 AND user_id < {1 << bits}"), bits=bits)
        assert {r["user_id"] for r in alone.collect()} == small & chosen
    assert user_bitmaps(users, bits=bits).count() <= (1 << bits) // 32_768
    assert only_users(rows, users.limit(0), bits=bits).collect() == []


def test_bits_are_bounded(spark):
    with pytest.raises(ValueError):
        user_bitmaps(spark.range(3).withColumnRenamed("id", "user_id"), bits=32)
    with pytest.raises(ValueError):
        CFG.with_(filter_bits=14)


def _experiment(spark, cfg):
    users = users_df(spark, [user(i, i % 2 == 0, "Bronze" if i % 2 == 0 else None) for i in range(1, 201)])
    pre = [txn(i, i) for i in range(1, 201)]
    post = [txn(i, 1_000 + i + k, POST, coupon=["PFX-1", "SALE", None][(i + k) % 3]) for i in range(1, 201) for k in range(3) for _ in range(2)]
    return Experiment(users, tx_df(spark, pre + post), cfg)


def test_the_first_exchange_carries_distinct_triples_of_treatment_users(spark):
    """Without broadcasts by size, the exchange above the transactions scan is
    below the filter and the map-side distinct, and above both."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ex = _experiment(spark, CFG)
        df = treatment_orders_by_class(ex.cohort, ex.tx, CFG)
        want = {(r["tier"], r["coupon_type"], r["transactions"]) for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "hashpartitioning(user_id" in x and "txn_id" in x and "_cls" in x)
    below = lines[at + 1:]
    aggregate = next(i for i, x in enumerate(below) if "HashAggregate(keys=[user_id" in x and "functions=[]" in x)
    bitmap = next(i for i, x in enumerate(below) if "BroadcastHashJoin" in x and "_bucket" in x)
    assert aggregate < bitmap  # printed top down: exchange, distinct, bitmap filter
    assert not any("Exchange hashpartitioning" in x for x in below[:bitmap])
    # the same rows where ids share slots and the join alone is exact
    ex = _experiment(spark, CFG.with_(filter_bits=15))
    assert {(r["tier"], r["coupon_type"], r["transactions"]) for r in treatment_orders_by_class(ex.cohort, ex.tx, ex.cfg).collect()} == want and want
