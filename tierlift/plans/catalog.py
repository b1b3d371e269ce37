"""Registry of every public operator/report as ``(spark, sf_dir) -> DataFrame``.

Each entry binds the operator to the driver's star-schema tables through the
fixture relabelling (``sources.fixtures``) and reads whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG
from ..operators import cohort as C
from ..operators import facts as FX
from ..operators import segments as S
from ..operators.dimension import tier_dimension
from ..operators.windowing import txn_window_scan, window_txn_counts
from ..session import ensure_checkpoint_dir, materialize
from ..sources.fixtures import TpchFixture
from ..sources.readers import read_transactions, read_users
from ..sources.sinks import write_report_csv
from ..sources.store import write_store
from . import finance as M
from . import reports as R
from .experiment import Experiment

CFG = DEFAULT_CONFIG

ELIGIBLE_COLS = ["user_id", "city", "gender", "registration_date", "opt_in", "is_member",
                 "member_tier", "n_orders", "tier_label", "tier"]
POST_COLS = ["user_id", "group_type", "tier", "n_orders", "revenue", "aov", "last_purchase"]


def _ex(spark: SparkSession, sf_dir: str, **kw) -> Experiment:
    return Experiment.from_tpch(spark, sf_dir, CFG, **kw)


def _post_out(df: DataFrame) -> DataFrame:
    return df.select("user_id", "group_type", "tier", "n_orders",
                     F.col("revenue").cast("double").alias("revenue"),
                     F.col("aov").cast("double").alias("aov"), "last_purchase")


# --- sources / scans ---------------------------------------------------------
def q_src_users(spark, sf_dir):
    return TpchFixture(spark, sf_dir, CFG).users().select(
        "user_id", "city", "gender", "registration_date", "opt_in", "is_member", "member_tier")


def q_src_transactions(spark, sf_dir):
    return TpchFixture(spark, sf_dir, CFG).transactions().select(
        "txn_date", "user_id", "txn_id", "coupon", F.col("revenue").cast("double").alias("revenue"))


def _reread(frame: DataFrame, read, fmt: str, names: dict[str, str]) -> DataFrame:
    """``frame`` written to the shared folder with other column names, and read
    back by the library's reader with the map of those names."""
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/source-{uuid.uuid4().hex}"
    w = frame.withColumnsRenamed({v: k for k, v in names.items()}).write
    if fmt == "parquet":
        w.parquet(path)
        return read(spark, path, fmt, names)
    # A marker of its own for NULL keeps empty strings apart from it.
    w.option("header", True).option("nullValue", "\\N").csv(path)
    return read(spark, path, fmt, names, nullValue="\\N")


USER_NAMES = {"customer_no": "user_id", "signed_up": "registration_date", "member": "is_member"}
TXN_NAMES = {"day": "txn_date", "customer_no": "user_id", "order_no": "txn_id"}


def _users(spark, sf_dir):
    return TpchFixture(spark, sf_dir, CFG).users()


def q_read_users(fmt):
    def run(spark, sf_dir):
        return _reread(_users(spark, sf_dir), read_users, fmt, USER_NAMES).select(
            "user_id", "city", "gender", "registration_date", "opt_in", "is_member", "member_tier")
    return run


def q_read_transactions(fmt):
    def run(spark, sf_dir):
        tx = TpchFixture(spark, sf_dir, CFG).transactions()
        return _reread(tx, read_transactions, fmt, TXN_NAMES).select(
            "txn_date", "user_id", F.col("txn_id").cast("bigint").alias("txn_id"), "coupon", F.col("revenue").cast("double").alias("revenue"))
    return run


def q_rejected_rows(spark, sf_dir):
    """``field, rows``: transactions exported with broken values in some rows,
    read with a table of rejects; the rows by what was wrong with them, and
    (null) those that were read."""
    tx = TpchFixture(spark, sf_dir, CFG).transactions()
    broken = tx.select(*[F.col(c).cast("string").alias(c) for c in tx.columns]).withColumns({
        "txn_date": F.when(F.col("txn_id").cast("bigint") % 50 == 0, "n/a").otherwise(F.col("txn_date")),
        "revenue": F.when(F.col("txn_id").cast("bigint") % 50 == 1, F.concat("revenue", F.lit(" EUR"))).otherwise(F.col("revenue")),
        "user_id": F.when(F.col("txn_id").cast("bigint") % 50 == 2, F.concat(F.lit("C-"), "user_id")).otherwise(F.col("user_id"))})
    scratch = f"{ensure_checkpoint_dir(spark)}/rejects-{uuid.uuid4().hex}"
    broken.write.option("header", True).option("nullValue", "\\N").csv(f"{scratch}/source")
    read = read_transactions(spark, f"{scratch}/source", "csv", rejects=f"{scratch}/rejects", nullValue="\\N")
    found = spark.read.parquet(f"{scratch}/rejects").select(F.split("problem", " ", 2)[0].alias("field"))
    return found.unionByName(read.select(F.lit(None).cast("string").alias("field"))).groupBy("field").agg(F.count(F.lit(1)).alias("rows"))


def q_report_csv(spark, sf_dir):
    """A report through its sink: written as headed CSV and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    write_report_csv(_ex(spark, sf_dir).tier_profitability(), path)
    return spark.read.option("header", True).schema(
        "group_type STRING, tier STRING, total_users BIGINT, users_who_purchased BIGINT, total_revenue DOUBLE, "
        "avg_revenue_per_user DOUBLE, estimated_discount_cost DOUBLE, net_revenue DOUBLE").csv(path)


def q_txn_window_scan(spark, sf_dir):
    tx = TpchFixture(spark, sf_dir, CFG).transactions()
    return txn_window_scan(tx, CFG.pre_start, CFG.pre_end).select(
        "txn_date", "user_id", "txn_id", "coupon", F.col("revenue").cast("double").alias("revenue"))


def q_window_txn_counts(spark, sf_dir):
    return window_txn_counts(TpchFixture(spark, sf_dir, CFG).transactions(), CFG.pre_start, CFG.pre_end)


def q_tier_dimension(spark, sf_dir):
    ex = _ex(spark, sf_dir)
    return tier_dimension(spark, CFG).join(ex.full.select("tier", "eligible_users"), on="tier", how="left") \
        .select("tier", "control_label", "min_orders", "max_orders", "discount_rate", "sort_order",
                F.coalesce(F.col("eligible_users"), F.lit(0)).cast("bigint").alias("eligible_users"))


# --- the co-located store ------------------------------------------------------
def _over_store(query):
    """``query(store)`` over both tables, written to the shared folder as a
    store; its result is written before the tables are forgotten."""
    def run(spark, sf_dir):
        fx = TpchFixture(spark, sf_dir, CFG)
        store = write_store(fx.users(), fx.transactions(), f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
        try:
            return materialize(query(store))
        finally:
            store.forget()
    return run


def _store_counts(store):
    return store.per_user(lambda tx: window_txn_counts(tx, CFG.pre_start, CFG.pre_end))


def _store_eligible(store):
    return Experiment.from_store(store, CFG)._eligible_once().select(*ELIGIBLE_COLS)


def _store_post(store):
    return _post_out(Experiment.from_store(store, CFG).post)


# --- text user ids ---------------------------------------------------------------
def _text_ids(spark, sf_dir) -> Experiment:
    """The experiment over ids like ``C-0000000123``."""
    fx = TpchFixture(spark, sf_dir, CFG)
    named = lambda df: df.withColumn("user_id", F.concat(F.lit("C-"), F.lpad(F.col("user_id").cast("string"), 10, "0")))
    return Experiment(named(fx.users()), named(fx.transactions()), CFG)


def q_text_id_cohort(spark, sf_dir):
    return _text_ids(spark, sf_dir).cohort.select("user_id", "group_type", "tier", "tier_label")


def q_text_id_coupon_usage(spark, sf_dir):
    return _text_ids(spark, sf_dir).coupon_usage()


# --- cohort operators ----------------------------------------------------------
def q_eligible_users(spark, sf_dir):
    return _ex(spark, sf_dir)._eligible_once().select(*ELIGIBLE_COLS)


def q_status_split(spark, sf_dir):
    return C.status_split(_ex(spark, sf_dir)._eligible_once())


def q_target_counts(spark, sf_dir):
    return C.target_counts(_ex(spark, sf_dir)._eligible_once(), CFG)


def q_control_counts(spark, sf_dir):
    return C.control_counts(_ex(spark, sf_dir)._eligible_once(), CFG)


def q_ranked_users(spark, sf_dir):
    return C.ranked_users(_ex(spark, sf_dir).eligible, CFG)


def q_balanced_users(spark, sf_dir):
    return _ex(spark, sf_dir).cohort.select(
        "user_id", "group_type", "tier", "tier_label")


def q_union_groups(spark, sf_dir):
    return _ex(spark, sf_dir, balance_method="branches").cohort.select(
        "user_id", "group_type", "tier", "tier_label")


def q_full_eligible(spark, sf_dir):
    return _ex(spark, sf_dir).full


# --- facts / segments ----------------------------------------------------------
def q_user_post_launch(spark, sf_dir):
    return _post_out(_ex(spark, sf_dir).post)


def q_string_key_join(spark, sf_dir):
    ex = _ex(spark, sf_dir)
    return _post_out(FX.user_post_launch_string_keys(ex.cohort, ex.tx, CFG))


def q_coupon_class(spark, sf_dir):
    return FX.classified_transactions(TpchFixture(spark, sf_dir, CFG).transactions(), CFG)


def q_city_ranks(spark, sf_dir):
    counts = S.counts_by(_ex(spark, sf_dir).cohort, "group_type", "city")
    return S.value_ranks(counts, "city", "user_count", "city_rank")


def q_pct_of_group(spark, sf_dir):
    return S.pct_of_group(_ex(spark, sf_dir).cohort, "group_type", "tier", 1)


def q_ab_test_results(spark, sf_dir):
    return R.ab_test_results(_ex(spark, sf_dir).profit).select(
        "tier", "test_users", F.col("net_uplift").cast("double").alias("net_uplift"))


# --- the eight analyses ---------------------------------------------------------
def _report(name, **kw):
    def run(spark, sf_dir):
        return getattr(_ex(spark, sf_dir, **kw), name)()
    run.__name__ = f"q_{name}"
    return run


def _ordered(name):
    """The report with its order as a column."""
    def run(spark, sf_dir):
        return R.with_position(getattr(_ex(spark, sf_dir), name)())
    return run


def q_rollout_projection(spark, sf_dir):
    return _ex(spark, sf_dir).rollout_projection("eligible_users")


# --- finance --------------------------------------------------------------------
def q_unknown_attribute_count(spark, sf_dir):
    return M.unknown_attribute_count(_ex(spark, sf_dir).cohort)


def q_purchase_rate_lift(spark, sf_dir):
    return M.purchase_rate_lift(_ex(spark, sf_dir).post, CFG)


def q_group_size_pivot(spark, sf_dir):
    return M.group_size_pivot(_ex(spark, sf_dir).cohort, CFG)


def q_uplift_summary(spark, sf_dir):
    return M.uplift_summary(_ex(spark, sf_dir).profit, CFG)


def q_coupon_mix_pivot(spark, sf_dir):
    return M.coupon_mix_pivot(_ex(spark, sf_dir).coupon_usage(), CFG)


def q_rollout_non_members(spark, sf_dir):
    ex = _ex(spark, sf_dir)
    return M.rollout_non_members(ex.profit, ex.full, CFG)


def q_per_user_economics(spark, sf_dir):
    return M.per_user_economics(_ex(spark, sf_dir).profit, CFG)


def q_projected_discount_cost(spark, sf_dir):
    ex = _ex(spark, sf_dir)
    return M.projected_discount_cost(ex.profit, ex.full, CFG)


def q_projected_net_position(spark, sf_dir):
    ex = _ex(spark, sf_dir)
    return M.projected_net_position(ex.profit, ex.full, CFG)


def q_payback_period(spark, sf_dir):
    ex = _ex(spark, sf_dir)
    return M.payback_period(ex.profit, ex.full, CFG)


def q_scenario_table(spark, sf_dir):
    ex = _ex(spark, sf_dir)
    return M.scenario_table(ex.profit, ex.full, CFG)


def q_referrals_by_referrer(spark, sf_dir):
    fx = TpchFixture(spark, sf_dir, CFG)
    return M.referrals_by_referrer(fx.transactions(), fx.users(), CFG)


def q_tier_repricing(spark, sf_dir):
    return M.tier_repricing(_ex(spark, sf_dir).profit, CFG)


def q_raw_group_imbalance(spark, sf_dir):
    return M.raw_group_imbalance(_ex(spark, sf_dir)._eligible_once(), CFG)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "src_users": q_src_users,
    "src_transactions": q_src_transactions,
    "read_users_parquet": q_read_users("parquet"),
    "read_users_csv": q_read_users("csv"),
    "read_transactions_parquet": q_read_transactions("parquet"),
    "read_transactions_csv": q_read_transactions("csv"),
    "report_csv": q_report_csv,
    "txn_window_scan": q_txn_window_scan,
    "window_txn_counts": q_window_txn_counts,
    "tier_dimension": q_tier_dimension,
    "eligible_users": q_eligible_users,
    "status_split": q_status_split,
    "target_counts": q_target_counts,
    "control_counts": q_control_counts,
    "ranked_users": q_ranked_users,
    "balanced_users": q_balanced_users,
    "union_groups": q_union_groups,
    "full_eligible": q_full_eligible,
    "user_post_launch": q_user_post_launch,
    "string_key_join": q_string_key_join,
    "coupon_class": q_coupon_class,
    "city_ranks": q_city_ranks,
    "pct_of_group": q_pct_of_group,
    "ab_test_results": q_ab_test_results,
    "rejected_rows": q_rejected_rows,
    "store_txn_counts": _over_store(_store_counts),
    "store_eligible_users": _over_store(_store_eligible),
    "store_post_launch": _over_store(_store_post),
    "text_id_cohort": q_text_id_cohort,
    "text_id_coupon_usage": q_text_id_coupon_usage,
    "tier_counts_ordered": _ordered("tier_counts_raw"),
    "group_sizes_ordered": _ordered("balanced_group_sizes"),
    "gender_split_ordered": _ordered("gender_split"),
    "tier_counts_raw": _report("tier_counts_raw"),
    "balanced_group_sizes": _report("balanced_group_sizes"),
    "gender_split": _report("gender_split"),
    "city_split": _report("city_split"),
    "engagement": _report("engagement"),
    "coupon_usage": _report("coupon_usage"),
    "tier_profitability": _report("tier_profitability"),
    "rollout_projection": q_rollout_projection,
    "engagement_line": _report("engagement", grain="line"),
    "coupon_usage_line": _report("coupon_usage", grain="line"),
    "tier_profitability_line": _report("tier_profitability", grain="line"),
    "unknown_attribute_count": q_unknown_attribute_count,
    "purchase_rate_lift": q_purchase_rate_lift,
    "group_size_pivot": q_group_size_pivot,
    "uplift_summary": q_uplift_summary,
    "coupon_mix_pivot": q_coupon_mix_pivot,
    "rollout_non_members": q_rollout_non_members,
    "per_user_economics": q_per_user_economics,
    "projected_discount_cost": q_projected_discount_cost,
    "projected_net_position": q_projected_net_position,
    "payback_period": q_payback_period,
    "scenario_table": q_scenario_table,
    "referrals_by_referrer": q_referrals_by_referrer,
    "tier_repricing": q_tier_repricing,
    "raw_group_imbalance": q_raw_group_imbalance,
}
