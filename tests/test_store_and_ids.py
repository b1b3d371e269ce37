"""The co-located store, text user ids and the sketched balancing cut."""

from __future__ import annotations

import random

import pytest
from helpers import CFG, POST, PRE, tx_df, txn, user, users_df
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tierlift.operators import cohort as C
from tierlift.operators import ranking
from tierlift.operators.ranking import k_smallest_per_group, kth_smallest_per_group
from tierlift.operators.windowing import window_txn_counts
from tierlift.plans.experiment import Experiment
from tierlift.sources import open_store, write_store

REPORTS = (*Experiment.REPORTS, *Experiment.FINANCE)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _tables(spark, n=160):
    rng = random.Random(3)
    users = [user(i, [True, False, None][i % 7 % 3], ["Bronze", "Silver", "Gold", "Platinum"][i % 4], city="ABCDE"[i % 5],
                  gender=["F", "M", "Unknown", None][i % 4]) for i in range(1, n + 1)]
    tx, k = [], 0
    for i in range(1, n + 1):
        for date, count in ((PRE, 1 + i % 5), (POST, i % 4)):
            for _ in range(count):
                k += 1
                tx += [txn(i, k, date, f"{rng.randrange(1, 90)}.25", ["PFX-7", "PFX-9", "SALE", "", None][k % 5])] * (1 + k % 2)
    tx += [txn(None, 9_000 + i, PRE) for i in range(200)] + [txn(5, 20_000 + i, POST, "3.10", "PFX-8") for i in range(1_500)]
    return users_df(spark, users), tx_df(spark, tx)


@pytest.fixture(scope="module")
def tables(spark):
    users, tx = _tables(spark)
    return users.persist(), tx.persist()


@pytest.fixture(scope="module")
def store(spark, tables, tmp_path_factory):
    opened = write_store(*tables, str(tmp_path_factory.mktemp("store") / "s"), buckets=8)
    yield opened
    opened.forget()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- store ---------------------------------------------------------------------
def test_no_exchange_between_scan_and_per_user_aggregate(spark, store):
    counts = window_txn_counts(store.cold, CFG.pre_start, CFG.pre_end)
    counts.collect()
    plan = _plan(counts)
    assert "Exchange" not in plan and "HashAggregate" in plan and "Bucketed: true" in plan
    assert "PartitionFilters: [isnotnull(txn_month" in plan and "txn_month#" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        eligible = C.eligible_of(store.users, counts, CFG)
        eligible.collect()
        plan = _plan(eligible)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_hot_and_anonymous_rows_are_not_in_a_bucket(store, tables):
    assert {r["user_id"] for r in store.hot.select("user_id").distinct().collect()} == {None, 5}
    assert rows(store.transactions.drop("txn_month")) == rows(tables[1]) and rows(store.users) == rows(tables[0])


def test_reports_over_the_store(spark, store, tables):
    plain, stored = Experiment(*tables, CFG, materialize=True), Experiment.from_store(store, CFG, materialize=True)
    for name in REPORTS:
        assert rows(getattr(stored, name)()) == rows(getattr(plain, name)()), name


def test_a_store_is_opened_by_its_path(spark, tables, tmp_path):
    first = write_store(*tables, str(tmp_path / "s"), buckets=3)
    first.forget()
    again = open_store(spark, str(tmp_path / "s"))
    assert again.buckets == 3 and rows(again.transactions.drop("txn_month")) == rows(tables[1])
    again.forget()
    assert not [t.name for t in spark.catalog.listTables() if t.name in again.tables]
    empty = write_store(tables[0].limit(0), tables[1].limit(0), str(tmp_path / "e"), buckets=2)
    assert empty.transactions.collect() == [] and empty.users.collect() == []
    empty.forget()


# --- text ids --------------------------------------------------------------------
def test_all_reports_are_equal_on_text_ids(spark, tables):
    named = lambda df: df.withColumn("user_id", F.concat(F.lit("C-"), F.lpad(F.col("user_id").cast("string"), 6, "0")))
    codes = lambda df: df.withColumn("coupon", F.when(F.col("coupon").startswith("PFX-"), F.concat(
        F.lit("PFX-C-"), F.lpad(F.substring("coupon", 5, 9), 6, "0"))).otherwise(F.col("coupon")))
    plain, text = Experiment(*tables, CFG, materialize=True), Experiment(named(tables[0]), codes(named(tables[1])), CFG, materialize=True)
    for name in REPORTS:
        want = getattr(plain, name)()
        if "referrer_id" in want.columns:
            want = want.withColumn("referrer_id", F.concat(F.lit("C-"), F.lpad(F.col("referrer_id").cast("string"), 6, "0")))
        got, want = rows(getattr(text, name)()), rows(want)
        assert got == want and want, name
    assert rows(named(plain.cohort.select("user_id", "tier"))) == rows(text.cohort.select("user_id", "tier"))


@pytest.mark.parametrize("limit", [0, 3, 10_000])
def test_kth_text(spark, monkeypatch, limit):
    """Prefixes, repeated, empty and long texts, NUL bytes and letters outside ASCII."""
    monkeypatch.setattr(ranking, "IN_PLAY", limit)
    rng = random.Random(limit)
    ids = ["", "a", "a\0", "a\0\0", "aaaaaaa", "aaaaaaab", "aaaaaaa\0", "é", "ÿ", "z" * 30, "z" * 30 + "!", "C-000001", "C-000002", "C-000010"]
    ids += ["".join(rng.choice("ab\0é") for _ in range(rng.randrange(0, 20))) for _ in range(120)] + ["same text id"] * 9
    df = spark.createDataFrame([("x", i % 2 == 0, v) for i, v in enumerate(ids)] + [("y", True, "q")], "g string, s boolean, id string").persist()
    for k in (1, 2, 7, 40, 70):
        asked = {("x", True): k, ("x", False): k + 1, ("y", True): 2, ("none", True): 1, ("y", False): 0}
        got = kth_smallest_per_group(df, ["g", "s"], "id", asked, 16)
        for flag, need in ((True, k), (False, k + 1)):
            own = sorted((v for i, v in enumerate(ids) if (i % 2 == 0) == flag), key=str.encode)
            value, below, equal = got[("x", flag)]
            assert value == own[need - 1] and below == sum(v.encode() < value.encode() for v in own) and equal == own.count(value)
        assert got[("y", True)] is None and ("none", True) not in got and ("y", False) not in got
    limits = spark.createDataFrame([("x", True, 50)], "g string, s boolean, k bigint")
    kept = sorted((r.id for r in k_smallest_per_group(df, ["g", "s"], "id", limits, "k", 16).collect()), key=str.encode)
    assert kept == sorted((v for i, v in enumerate(ids) if i % 2 == 0), key=str.encode)[:50]
    df.unpersist()


# --- brackets --------------------------------------------------------------------
def _jobs(spark, run):
    """Collects that ``run`` makes over the frame it is given."""
    from pyspark.sql import DataFrame
    seen, collect = [], DataFrame.collect
    kind = type(spark.range(1))
    original = kind.collect
    kind.collect = lambda self: seen.append(1) or original(self)
    try:
        return run(), len(seen)
    finally:
        kind.collect = original


def test_two_aggregates_find_the_cut_among_sparse_ids(spark):
    """Ids of 64 random bits; the sketches come from the pass that writes."""
    from tierlift.session import materialize
    n = 400_000
    base = spark.range(0, n, 1, 8).select(F.xxhash64("id").alias("user_id"), F.lit("Bronze").alias("tier"),
                                          (F.col("id") % 4 == 0).alias("is_member"))
    obs = Observation()
    eligible = materialize(base.observe(obs, *C.side_count_metrics(CFG)))
    metrics = obs.get
    brackets = C.id_brackets(spark, metrics, CFG)
    assert set(brackets) == {("Bronze", True), ("Bronze", False)}
    asked = {("Bronze", True): n // 4, ("Bronze", False): n // 4}
    got, collects = _jobs(spark, lambda: kth_smallest_per_group(eligible, C.COHORT_KEYS, "user_id", asked, 1024, brackets=brackets))
    assert collects <= 2
    ids = sorted(r[0] for r in eligible.where("NOT is_member").select("user_id").collect())
    assert got[("Bronze", False)] == (ids[n // 4 - 1], n // 4 - 1, 1)
    # a bracket beside the id is noticed
    wrong = {("Bronze", True): brackets[("Bronze", True)], ("Bronze", False): (ids[0], ids[10])}
    assert kth_smallest_per_group(eligible, C.COHORT_KEYS, "user_id", asked, 1024, brackets=wrong) == got
    wrong[("Bronze", False)] = (ids[-10], ids[-1])
    assert kth_smallest_per_group(eligible, C.COHORT_KEYS, "user_id", asked, 1024, brackets=wrong) == got
    assert C.balanced_users(eligible, CFG, side_counts=metrics).count() == n // 2


# --- plans and columns -------------------------------------------------------------
def test_referrals_expand_no_rows(spark, tables):
    df = Experiment(*tables, CFG).referrals_by_referrer()
    assert df.count() and "Expand" not in _plan(df)
    df.collect()
    assert "Expand" not in _plan(df) and "count(distinct" not in _plan(df)


def test_reports_name_the_column_they_lack(spark, tables):
    from tierlift.sources import TRANSACTIONS, USERS, canonicalize
    users = canonicalize(tables[0].drop("city"), USERS)
    tx = canonicalize(tables[1].drop("coupon"), TRANSACTIONS)
    ex = Experiment(users, tx, CFG)
    for name in ("city_split", "coupon_usage", "coupon_mix_pivot", "referrals_by_referrer"):
        with pytest.raises(ValueError, match=name):
            getattr(ex, name)()
    with pytest.raises(ValueError, match="city_split needs 'city'"):
        ex.reports()
    assert ex.gender_split().count() and ex.engagement().count()
    assert set(ex.reports(("gender_split", "engagement"))) == {"gender_split", "engagement"}
    with pytest.raises(ValueError, match="no reports"):
        ex.reports(("nothing",))
    with pytest.raises(ValueError, match="gender"):
        Experiment(tables[0].drop("gender"), tables[1], CFG).gender_split()
