"""Post-launch facts joined to the cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, ExperimentConfig
from ..functions import labels as L
from ..functions.rounding import round_decimal
from .idfilter import only_users
from .windowing import txn_window_scan


def per_user_facts(tx: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``user_id, n_orders, revenue, aov, last_purchase`` over the post window.

    Aggregated *before* the cohort join: the distinct-order count is a
    two-phase aggregate and sums/averages/max combine map-side, so a user who
    owns a third of all rows is reduced in every task before any shuffle, and
    the later cohort join is one row per user on each side (no skew).
    Revenue is per row (repeated order ids add up), orders per distinct id;
    rows with a NULL order id bring revenue but no order."""
    post = txn_window_scan(tx, cfg.post_start, cfg.post_end).where(F.col("user_id").isNotNull())
    return (post.groupBy("user_id")
                .agg(F.countDistinct("txn_id").cast("bigint").alias("n_orders"),
                     round_decimal(F.sum("revenue"), 2).alias("revenue"),
                     round_decimal(F.avg("revenue"), 2).alias("aov"),
                     F.max("txn_date").alias("last_purchase")))


def user_post_launch(cohort: DataFrame, tx: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG,
                     facts: DataFrame | None = None) -> DataFrame:
    """``user_id, group_type, tier, n_orders, revenue, aov, last_purchase`` for
    every cohort user; users without post-window rows keep ``n_orders = 0``
    and NULL money (left join)."""
    f = facts if facts is not None else per_user_facts(tx, cfg)
    c = cohort.select("user_id", "group_type", "tier")
    return (c.join(f, on="user_id", how="left")
             .select("user_id", "group_type", "tier",
                     F.coalesce(F.col("n_orders"), F.lit(0).cast("bigint")).alias("n_orders"),
                     "revenue", "aov", "last_purchase"))


def user_post_launch_string_keys(cohort: DataFrame, tx: DataFrame,
                                 cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """Same result as :func:`user_post_launch`, joined on ``CAST(id AS
    STRING)`` on both sides as the analysed scripts do.  Kept to show that the
    canonical BIGINT ids make the cast a no-op for the result; it costs a cast
    per row and a string-keyed shuffle, so the BIGINT join is the default."""
    f = per_user_facts(tx, cfg).withColumn("_sid", F.col("user_id").cast("string")).drop("user_id")
    c = cohort.select("user_id", "group_type", "tier").withColumn("_sid", F.col("user_id").cast("string"))
    return (c.join(f, on="_sid", how="left")
             .select("user_id", "group_type", "tier",
                     F.coalesce(F.col("n_orders"), F.lit(0).cast("bigint")).alias("n_orders"),
                     "revenue", "aov", "last_purchase"))


def classified_transactions(tx: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """Post-window rows as ``user_id, txn_id, coupon_type`` (referral prefix,
    other non-empty code, none).  The prefix test is a ``startswith`` that
    Parquet can evaluate as a string-prefix filter."""
    return (txn_window_scan(tx, cfg.post_start, cfg.post_end)
            .where(F.col("user_id").isNotNull())
            .select("user_id", "txn_id", L.coupon_class("coupon", cfg).alias("coupon_type")))


def treatment_orders_by_class(cohort: DataFrame, tx: DataFrame,
                              cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``tier, coupon_type, transactions``: distinct orders of treatment users
    per class.  An order whose rows carry different classes counts once in
    each class.

    Rows of other users are dropped by a bitmap of the treatment ids above the
    scan, and what is left is reduced to distinct (user, order, class) in every
    task, so the first exchange carries those triples alone, with a one-byte
    class code.  The join on ``user_id`` brings the tier (and makes the filter
    exact); the distinct count is keyed on (tier, class, order), so no single
    key is hot after it.  Labels are attached after the aggregate."""
    treat = cohort.where(L.is_treatment("is_member")).select("user_id", "tier")
    post = (txn_window_scan(tx, cfg.post_start, cfg.post_end)
            .select("user_id", "txn_id", L.coupon_class_code("coupon", cfg).alias("_cls")))
    triples = only_users(post, treat, bits=cfg.filter_bits).distinct()
    j = triples.join(treat, on="user_id", how="inner")
    return (j.groupBy("tier", "_cls")
             .agg(F.countDistinct("txn_id").cast("bigint").alias("transactions"))
             .select("tier", L.coupon_class_label("_cls", cfg).alias("coupon_type"), "transactions"))
