"""The eight analyses as DataFrame plans (K1-K8).

Reports over a configuration-bounded key set (tiers x groups x classes) end in
one small sorting task (``sort_small``); those keyed by values of the data
(stored tier texts, genders, cities) in ``orderBy``.  Money stays DECIMAL until
the output edge; rounding follows ``functions.rounding``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (CONTROL, DEFAULT_CONFIG, OTHER_CITY, TREATMENT, UNKNOWN_GENDER,
                      ExperimentConfig)
from ..functions import labels as L
from ..functions.rounding import exact_round, pct, round_decimal
from ..operators.facts import treatment_orders_by_class
from ..operators.segments import counts_by, pct_of_counts, top_n_with_other


def sort_small(df: DataFrame, *cols) -> DataFrame:
    """Total order for a report whose row count is bounded by configuration
    (tiers x groups x classes): one task sorts it, no range-partitioning
    sample job.  Not for data-sized outputs (use ``orderBy`` there)."""
    return df.coalesce(1).sortWithinPartitions(*cols)


def with_position(report: DataFrame) -> DataFrame:
    """A report (an aggregate of few rows) with its order as a column:
    ``position`` from 1.  The sorted partitions are read in turn by one task."""
    return report.coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)


def _by_tier(df: DataFrame, cfg: ExperimentConfig, *more) -> DataFrame:
    return sort_small(df, L.tier_sort_order("tier", cfg).asc_nulls_last(), *more)


def _label_order(cfg: ExperimentConfig):
    """Treatment tier then its control label, ladder order."""
    order = {}
    for i, t in enumerate(cfg.tiers):
        order[t.name] = 2 * i + 1
        order[t.control_label] = 2 * i + 2
    return L.tier_case("tier_label", order)


def tier_counts_raw(eligible: DataFrame) -> DataFrame:
    """K1 ``tier_label, count_users`` over the whole eligible population
    (NULL membership counted under its control label)."""
    return (eligible.groupBy("tier_label").agg(F.count(F.lit(1)).alias("count_users"))
                    .orderBy("count_users", F.col("tier_label").asc_nulls_first()))


def balanced_group_sizes(cohort: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """K2 ``tier_label, user_count`` of the matched cohort."""
    return (cohort.groupBy("tier_label").agg(F.count(F.lit(1)).alias("user_count"))
                  .transform(lambda d: sort_small(d, _label_order(cfg).asc_nulls_last())))


def gender_split(cohort: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """K3 ``group_type, gender, user_count, pct_of_group``; 'Unknown' and NULL
    gender are out of numerator and denominator."""
    known = cohort.where(F.col("gender") != F.lit(UNKNOWN_GENDER))
    out = pct_of_counts(counts_by(known, "group_type", "gender"), "group_type", "user_count", 1)
    return out.orderBy(F.desc("group_type"), F.desc("user_count"), "gender")


def city_counts(cohort: DataFrame) -> DataFrame:
    """``group_type, city, user_count``: the only pass over the cohort K4 needs."""
    return counts_by(cohort, "group_type", "city")


def city_split(cohort: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG,
               counts: DataFrame | None = None) -> DataFrame:
    """K4 ``group_type, city_grouped, user_count, pct_of_group``: cities ranked
    over both groups together (``RANK``, ties kept), the rest in 'Other'.
    ``counts`` may be a materialised :func:`city_counts` (the rank join and
    the share join both read it)."""
    counts = city_counts(cohort) if counts is None else counts
    grouped = top_n_with_other(counts, "group_type", "city", "user_count", cfg.top_n_cities,
                               OTHER_CITY, "city_grouped")
    out = pct_of_counts(grouped, "group_type", "user_count", 1)
    return out.orderBy(F.desc("group_type"), F.desc("user_count"), "city_grouped")


def engagement(post: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """K5 repeat purchase rate over all users; AOV and revenue per purchaser as
    a mean of per-user rounded means (two-stage, not total / total)."""
    buyer = F.col("n_orders") > 0
    out = (post.groupBy("group_type", "tier")
               .agg(F.count(F.lit(1)).alias("total_users"),
                    F.count_if(buyer).cast("bigint").alias("users_who_purchased"),
                    F.avg(F.when(buyer, F.col("aov"))).alias("_aov"),
                    F.avg(F.when(buyer, F.col("revenue"))).alias("_rpu"))
               .select("group_type", "tier", "total_users", "users_who_purchased",
                       pct(F.col("users_who_purchased"), F.col("total_users"), 1)
                       .alias("repeat_purchase_rate_pct"),
                       exact_round(F.col("_aov"), 2).alias("avg_order_value"),
                       exact_round(F.col("_rpu"), 2).alias("avg_revenue_per_user")))
    return _by_tier(out, cfg, F.desc("group_type"))


def coupon_usage(cohort: DataFrame, tx: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """K6 ``tier, coupon_type, transactions, pct_of_transactions`` for the
    treatment group (shares of the per-tier sum over classes, 2 dp)."""
    counts = treatment_orders_by_class(cohort, tx, cfg)
    out = pct_of_counts(counts, "tier", "transactions", 2, "pct_of_transactions")
    return _by_tier(out, cfg, "coupon_type")


def profitability_decimal(post: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG,
                          rate_overrides: dict | None = None) -> DataFrame:
    """K7 with exact DECIMAL money (input of the finance operators).

    Discount cost is the inverse-rate estimate ``rev * r / (1 - r)`` on the
    treatment side only; net = revenue - cost (rounded once, from the
    unrounded cost)."""
    buyer = F.col("n_orders") > 0
    g = (post.groupBy("group_type", "tier")
             .agg(F.count(F.lit(1)).alias("total_users"),
                  F.count_if(buyer).cast("bigint").alias("users_who_purchased"),
                  round_decimal(F.sum(F.when(buyer, F.col("revenue")).otherwise(F.lit(0))), 2)
                  .alias("total_revenue"),
                  round_decimal(F.avg(F.when(buyer, F.col("revenue"))), 2).alias("avg_revenue_per_user")))
    treat = F.col("group_type") == F.lit(TREATMENT)
    rate = F.when(treat, L.discount_rate("tier", cfg, rate_overrides)) \
            .otherwise(F.lit(0).cast(L.RATE))
    cost = F.try_divide(F.col("total_revenue") * rate, F.lit(1).cast(L.RATE) - rate)
    return g.select("group_type", "tier", "total_users", "users_who_purchased", "total_revenue",
                    "avg_revenue_per_user", rate.alias("discount_rate"),
                    round_decimal(cost, 2).alias("estimated_discount_cost"),
                    round_decimal(F.col("total_revenue") - cost, 2).alias("net_revenue"))


def tier_profitability(post: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """K7 ``group_type, tier, total_users, users_who_purchased, total_revenue,
    avg_revenue_per_user, estimated_discount_cost, net_revenue``."""
    p = profitability_decimal(post, cfg)
    out = p.select("group_type", "tier", "total_users", "users_who_purchased",
                   *[F.col(c).cast("double").alias(c) for c in
                     ("total_revenue", "avg_revenue_per_user", "estimated_discount_cost", "net_revenue")])
    return _by_tier(out, cfg, F.desc("group_type"))


def ab_test_results(profit: DataFrame) -> DataFrame:
    """``tier, test_users, net_uplift`` (DECIMAL): treatment users and
    treatment net minus control net per tier, derived from K7 instead of being
    typed in by hand."""
    t = F.col("group_type") == F.lit(TREATMENT)
    c = F.col("group_type") == F.lit(CONTROL)
    return (profit.groupBy("tier")
                  .agg(F.sum(F.when(t, F.col("total_users"))).cast("bigint").alias("test_users"),
                       F.sum(F.when(t, F.col("net_revenue"))).alias("_t_net"),
                       F.sum(F.when(c, F.col("net_revenue"))).alias("_c_net"))
                  .where(F.col("test_users") > 0)
                  .select("tier", "test_users", (F.col("_t_net") - F.col("_c_net")).alias("net_uplift")))


def rollout_projection(profit: DataFrame, full: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG,
                       population: str = "eligible_users",
                       population_alias: str = "full_eligible_users") -> DataFrame:
    """K8 / M6: per-user net uplift of the test times a population per tier.
    ``population='eligible_users'`` projects onto everyone eligible (K8),
    ``'non_members'`` onto eligible users not yet enrolled (M6)."""
    ab = ab_test_results(profit)
    j = ab.join(full.select("tier", F.col(population).alias("_pop")), on="tier", how="inner")
    out = j.select(
        "tier",
        F.col("_pop").cast("bigint").alias(population_alias),
        exact_round(F.col("net_uplift"), 0).alias("ab_net_uplift"),
        exact_round(F.try_divide(F.col("net_uplift"), F.col("test_users").cast("decimal(20,0)")), 2)
        .alias("net_uplift_per_user"),
        exact_round(F.try_divide(F.col("net_uplift") * F.col("_pop").cast("decimal(20,0)"),
                                 F.col("test_users").cast("decimal(20,0)")), 0)
        .alias("projected_net_uplift"))
    return _by_tier(out, cfg)
