"""Finance and projection tables derived from the reports (M1-M14).

These were hand arithmetic in the analysed write-up; here they are DataFrame
operators downstream of the heavy plan (scan, balance, per-user aggregate), so
they always agree with the data they are computed from.  All inputs are small
aggregates keyed by tier / group / scenario (configuration-bounded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (CONTROL, DEFAULT_CONFIG, NO_COUPON, OTHER_COUPON, RATE_DIGITS, TOTAL_LABEL, TREATMENT,
                      UNKNOWN_GENDER, ExperimentConfig, exact)
from ..functions import labels as L
from ..functions.rounding import exact_round, pct
from ..operators.windowing import txn_window_scan
from .reports import ab_test_results, profitability_decimal, sort_small

_D0 = "decimal(20,0)"


def _tier_order(df: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    return sort_small(df, L.tier_sort_order("tier", cfg).asc_nulls_last(), F.col("tier").asc_nulls_last())


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("decimal(38,6)"), b.cast("decimal(38,6)"))


# --- M1 -------------------------------------------------------------------------
def unknown_attribute_count(cohort: DataFrame) -> DataFrame:
    """``group_type, total_users, known_gender_users, unknown_gender_users``:
    users left out of the gender shares ('Unknown' or NULL)."""
    known = F.col("gender") != F.lit(UNKNOWN_GENDER)
    return (cohort.groupBy("group_type")
                  .agg(F.count(F.lit(1)).alias("total_users"),
                       F.count_if(known).cast("bigint").alias("known_gender_users"))
                  .withColumn("unknown_gender_users", F.col("total_users") - F.col("known_gender_users"))
                  .transform(lambda d: sort_small(d, F.desc("group_type"))))


# --- M2 -------------------------------------------------------------------------
def purchase_rate_lift(post: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``tier, treatment_rate_pct, control_rate_pct, rate_lift``: relative
    purchase-rate lift (treatment rate / control rate, 2 dp) from exact rates."""
    buyer = F.col("n_orders") > 0
    t = F.col("group_type") == F.lit(TREATMENT)
    c = F.col("group_type") == F.lit(CONTROL)
    g = (post.groupBy("tier")
             .agg(F.count_if(t).cast("bigint").alias("_tn"), F.count_if(t & buyer).cast("bigint").alias("_tb"),
                  F.count_if(c).cast("bigint").alias("_cn"), F.count_if(c & buyer).cast("bigint").alias("_cb")))
    out = g.select("tier",
                   pct(F.col("_tb"), F.col("_tn"), 1).alias("treatment_rate_pct"),
                   pct(F.col("_cb"), F.col("_cn"), 1).alias("control_rate_pct"),
                   exact_round(F.try_divide((F.col("_tb") * F.col("_cn")).cast(_D0),
                                            (F.col("_tn") * F.col("_cb")).cast(_D0)), 2).alias("rate_lift"))
    return _tier_order(out, cfg)


# --- M3 -------------------------------------------------------------------------
def group_size_pivot(cohort: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``tier, treatment_users, control_users, total_users`` plus a 'Total' row:
    the sum of the per-tier rows, which exists (with zeros) for an empty cohort
    too, as the grand-total grouping set of a ``ROLLUP`` does in SQL."""
    t = F.col("group_type") == F.lit(TREATMENT)
    aggs = [F.count_if(t).cast("bigint").alias("treatment_users"),
            F.count_if(~t).cast("bigint").alias("control_users"),
            F.count(F.lit(1)).alias("total_users")]
    per = cohort.groupBy("tier").agg(*aggs)
    total = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                      for c in ("treatment_users", "control_users", "total_users")])
    return _tier_order(_with_total(per, total), cfg)


def _with_total(per_tier: DataFrame, total: DataFrame) -> DataFrame:
    """Per-tier rows plus one 'Total' row from a global aggregate."""
    return per_tier.unionByName(total.withColumn("tier", F.lit(TOTAL_LABEL)))


# --- M4 -------------------------------------------------------------------------
def uplift_summary(profit: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``tier, treatment_revenue, control_revenue, gross_uplift, discount_cost,
    net_uplift`` per tier plus a 'Total' row: gross = treatment - control
    revenue, net = gross - treatment discount cost."""
    t = F.col("group_type") == F.lit(TREATMENT)
    c = F.col("group_type") == F.lit(CONTROL)
    per = (profit.groupBy("tier")
                 .agg(F.sum(F.when(t, F.col("total_revenue"))).alias("tr"),
                      F.sum(F.when(c, F.col("total_revenue"))).alias("cr"),
                      F.sum(F.when(t, F.col("estimated_discount_cost"))).alias("dc")))
    sums = [F.sum("tr").alias("tr"), F.sum("cr").alias("cr"), F.sum("dc").alias("dc")]
    r = _with_total(per, per.agg(*sums))
    out = r.select("tier",
                   exact_round(F.col("tr"), 2).alias("treatment_revenue"),
                   exact_round(F.col("cr"), 2).alias("control_revenue"),
                   exact_round(F.col("tr") - F.col("cr"), 2).alias("gross_uplift"),
                   exact_round(F.col("dc"), 2).alias("discount_cost"),
                   exact_round(F.col("tr") - F.col("cr") - F.col("dc"), 2).alias("net_uplift"))
    return _tier_order(out, cfg)


# --- M5 -------------------------------------------------------------------------
def coupon_mix_pivot(usage: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``tier, no_coupon_pct, referral_pct, other_coupon_pct``: the coupon
    report pivoted by class (explicit pivot values: no extra distinct job)."""
    classes = [NO_COUPON, cfg.referral_label, OTHER_COUPON]
    p = usage.groupBy("tier").pivot("coupon_type", classes).agg(F.max("pct_of_transactions"))
    out = p.select("tier", F.col(f"`{NO_COUPON}`").alias("no_coupon_pct"),
                   F.col(f"`{cfg.referral_label}`").alias("referral_pct"),
                   F.col(f"`{OTHER_COUPON}`").alias("other_coupon_pct"))
    return _tier_order(out, cfg)


# --- M6 -------------------------------------------------------------------------
def rollout_non_members(profit: DataFrame, full: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``tier, non_member_users, net_uplift_per_user, projected_net_uplift``
    per tier and a 'Total' row: the test's per-user net uplift applied to
    the eligible users who are not members."""
    ab = ab_test_results(profit)
    j = ab.join(full.select("tier", "non_members"), on="tier", how="inner")
    per = j.select("tier", F.col("non_members").cast("bigint").alias("non_member_users"),
                   _div(F.col("net_uplift"), F.col("test_users")).alias("_pu"),
                   F.try_divide(F.col("net_uplift") * F.col("non_members").cast(_D0),
                                F.col("test_users").cast(_D0)).alias("_proj"))
    tiers = per.select("tier", "non_member_users", exact_round(F.col("_pu"), 4).alias("net_uplift_per_user"),
                       exact_round(F.col("_proj"), 0).alias("projected_net_uplift"))
    total = per.agg(F.sum("non_member_users").cast("bigint").alias("non_member_users"),
                    exact_round(F.sum("_proj"), 0).alias("projected_net_uplift")) \
               .select(F.lit(TOTAL_LABEL).alias("tier"), "non_member_users",
                       F.lit(None).cast("double").alias("net_uplift_per_user"), "projected_net_uplift")
    return _tier_order(tiers.unionByName(total), cfg)


# --- M7 -------------------------------------------------------------------------
def per_user_economics(profit: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``tier, treatment_users, gross_uplift_per_user, discount_per_user,
    net_uplift_per_user`` (4 dp) per treatment user of the test."""
    e = _economics(profit)
    out = e.select("tier", "treatment_users",
                   exact_round(_div(F.col("gross"), F.col("treatment_users")), 4).alias("gross_uplift_per_user"),
                   exact_round(_div(F.col("cost"), F.col("treatment_users")), 4).alias("discount_per_user"),
                   exact_round(_div(F.col("gross") - F.col("cost"), F.col("treatment_users")), 4)
                   .alias("net_uplift_per_user"))
    return _tier_order(out, cfg)


def _economics(profit: DataFrame) -> DataFrame:
    """``tier, treatment_users, treatment_revenue, gross, cost`` (DECIMAL)."""
    t = F.col("group_type") == F.lit(TREATMENT)
    c = F.col("group_type") == F.lit(CONTROL)
    return (profit.groupBy("tier")
                  .agg(F.sum(F.when(t, F.col("total_users"))).cast("bigint").alias("treatment_users"),
                       F.sum(F.when(t, F.col("total_revenue"))).alias("treatment_revenue"),
                       F.sum(F.when(t, F.col("total_revenue"))).alias("_tr"),
                       F.sum(F.when(c, F.col("total_revenue"))).alias("_cr"),
                       F.sum(F.when(t, F.col("estimated_discount_cost"))).alias("cost"),
                       F.max(F.when(t, F.col("discount_rate"))).alias("rate"))
                  .where(F.col("treatment_users") > 0)
                  .withColumn("gross", F.col("_tr") - F.col("_cr"))
                  .drop("_tr", "_cr"))


# --- M8 / M9 / M10 ---------------------------------------------------------------
def _repriced_cost(e: DataFrame, cfg: ExperimentConfig, overrides: dict, method: str) -> Column:
    """Treatment discount cost under a new rate for the overridden tiers.
    ``inverse_rate``: recompute ``revenue * r' / (1 - r')``; ``linear``: scale
    the observed cost by ``r' / r``."""
    if method not in ("inverse_rate", "linear"):
        raise ValueError("method must be 'inverse_rate' or 'linear'")
    new_rate = L.discount_rate("tier", cfg, overrides)
    if method == "inverse_rate":
        repriced = F.try_divide(F.col("treatment_revenue") * new_rate, F.lit(1).cast(L.RATE) - new_rate)
    else:
        repriced = F.try_divide(F.col("cost") * new_rate, F.col("rate"))
    # Both branches explicitly DECIMAL(38,6): CASE over DECIMAL(38,6) and
    # DECIMAL(38,2) would widen to scale 2 and round the repriced cost.
    return (F.when(F.col("tier").isin(list(overrides)), repriced.cast("decimal(38,6)"))
             .otherwise(F.col("cost").cast("decimal(38,6)")))


def projected_position(profit: DataFrame, full: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG,
                       overrides: dict | None = None, method: str = "linear") -> DataFrame:
    """Per tier (DECIMAL): non-members, per-user gross uplift and discount cost
    from the test (cost repriced for overridden tiers), projected gross, cost
    and net over the non-members."""
    ov = dict(cfg.repricing) if overrides is None else overrides
    e = _economics(profit)
    e = e.withColumn("_cost", _repriced_cost(e, cfg, ov, method))
    j = e.join(full.select("tier", "non_members"), on="tier", how="inner")
    return j.select("tier", F.col("non_members").cast("bigint").alias("non_member_users"),
                    _div(F.col("gross"), F.col("treatment_users")).alias("gross_per_user"),
                    _div(F.col("_cost"), F.col("treatment_users")).alias("cost_per_user"),
                    F.try_divide(F.col("gross") * F.col("non_members").cast(_D0),
                                 F.col("treatment_users").cast(_D0)).alias("projected_gross"),
                    F.try_divide(F.col("_cost") * F.col("non_members").cast(_D0),
                                 F.col("treatment_users").cast(_D0)).alias("projected_cost"))


def projected_discount_cost(profit: DataFrame, full: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG,
                            overrides: dict | None = None, method: str = "linear") -> DataFrame:
    """M8 ``tier, non_member_users, discount_per_user, projected_discount_cost``
    plus 'Total'."""
    p = projected_position(profit, full, cfg, overrides, method)
    tiers = p.select("tier", "non_member_users", exact_round(F.col("cost_per_user"), 4).alias("discount_per_user"),
                     exact_round(F.col("projected_cost"), 2).alias("projected_discount_cost"))
    total = p.agg(F.sum("non_member_users").cast("bigint").alias("non_member_users"),
                  exact_round(F.sum("projected_cost"), 2).alias("projected_discount_cost")) \
             .select(F.lit(TOTAL_LABEL).alias("tier"), "non_member_users",
                     F.lit(None).cast("double").alias("discount_per_user"), "projected_discount_cost")
    return _tier_order(tiers.unionByName(total), cfg)


def projected_net_position(profit: DataFrame, full: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG,
                           overrides: dict | None = None, method: str = "linear") -> DataFrame:
    """M9 ``tier, projected_gross_uplift, projected_discount_cost,
    projected_net_uplift, payback_months`` per tier and 'Total'."""
    p = projected_position(profit, full, cfg, overrides, method)
    sums = [F.sum("projected_gross").alias("g"), F.sum("projected_cost").alias("c")]
    rolled = _with_total(p.groupBy("tier").agg(*sums), p.agg(*sums))
    out = rolled.select(
        "tier",
        exact_round(F.col("g"), 2).alias("projected_gross_uplift"),
        exact_round(F.col("c"), 2).alias("projected_discount_cost"),
        exact_round(F.col("g") - F.col("c"), 2).alias("projected_net_uplift"),
        exact_round(F.try_divide(F.col("c") * F.lit(12), F.col("g")), 2).alias("payback_months"))
    return _tier_order(out, cfg)


def payback_period(profit: DataFrame, full: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG,
                   overrides: dict | None = None, method: str = "linear") -> DataFrame:
    """M10 one row: ``projected_gross_uplift, projected_discount_cost,
    payback_months`` (= cost / gross x 12) of the whole rollout."""
    p = projected_position(profit, full, cfg, overrides, method)
    t = p.agg(F.sum("projected_gross").alias("g"), F.sum("projected_cost").alias("c"))
    return t.select(exact_round(F.col("g"), 2).alias("projected_gross_uplift"),
                    exact_round(F.col("c"), 2).alias("projected_discount_cost"),
                    exact_round(F.try_divide(F.col("c") * F.lit(12), F.col("g")), 2).alias("payback_months"))


# --- M11 ------------------------------------------------------------------------
def scenario_table(profit: DataFrame, full: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG,
                   overrides: dict | None = None, method: str = "linear") -> DataFrame:
    """``scenario, gross_uplift, discount_cost, net_position, payback_months``:
    the projected totals under each configured scenario (gross x multiplier +
    increment, cost x multiplier).  The single totals row is exploded into one
    row per scenario: one pass over the plan below."""
    p = projected_position(profit, full, cfg, overrides, method)
    t = p.agg(F.sum("projected_gross").alias("g"), F.sum("projected_cost").alias("c"))
    number = f"decimal({RATE_DIGITS + 12},{RATE_DIGITS})"
    value = lambda x: F.lit(exact(x, RATE_DIGITS)).cast(number)
    cases = F.array(*[F.struct(F.lit(s.name).alias("scenario"), F.lit(s.sort_order).alias("o"),
                               value(s.gross_multiplier).alias("gm"), value(s.gross_increment).alias("gi"),
                               value(s.cost_multiplier).alias("cm")) for s in cfg.scenarios])
    u = (t.select("g", "c", F.explode(cases).alias("s"))
          .select("s.scenario", F.col("s.o").alias("_o"), (F.col("g") * F.col("s.gm") + F.col("s.gi")).alias("_gs"),
                  (F.col("c") * F.col("s.cm")).alias("_cs")))
    return u.select("scenario", exact_round(F.col("_gs"), 2).alias("gross_uplift"),
                    exact_round(F.col("_cs"), 2).alias("discount_cost"),
                    exact_round(F.col("_gs") - F.col("_cs"), 2).alias("net_position"),
                    exact_round(F.try_divide(F.col("_cs") * F.lit(12), F.col("_gs")), 2).alias("payback_months"),
                    "_o").transform(lambda d: sort_small(d, "_o")).drop("_o")


# --- M12 ------------------------------------------------------------------------
def referrals_by_referrer(tx: DataFrame, users: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG,
                          min_referrals: int | None = None) -> DataFrame:
    """``referrer_id, referrer_is_member, referred_users, referral_orders`` for
    referrers with at least ``min_referrals`` distinct referred users in the
    post window.  The referrer is parsed from ``<prefix><id>``; using one's
    own code is not a referral.

    Rows are reduced to distinct (referrer, user, order) once, map-side first;
    users and orders of a referrer are then counted from that exchange, each
    by distinct pairs and partial counts, so no row is expanded per distinct
    count and no task holds a hot referrer."""
    k = cfg.min_referrals if min_referrals is None else min_referrals
    text = isinstance(tx.schema["user_id"].dataType, T.StringType)
    post = txn_window_scan(tx, cfg.post_start, cfg.post_end) \
        .where(F.col("user_id").isNotNull() & F.col("coupon").startswith(cfg.coupon_prefix))
    triples = (post.select("user_id", "txn_id", L.referrer_id("coupon", cfg, text).alias("referrer_id"))
                   .where(F.col("referrer_id").isNotNull() & (F.col("referrer_id") != F.col("user_id")))
                   .distinct())
    referred = (triples.select("referrer_id", "user_id").distinct()
                       .groupBy("referrer_id").agg(F.count(F.lit(1)).alias("referred_users"))
                       .where(F.col("referred_users") >= k))
    orders = (triples.select("referrer_id", "txn_id").distinct()
                     .groupBy("referrer_id").agg(F.count("txn_id").alias("referral_orders")))
    agg = referred.join(orders, on="referrer_id", how="inner")
    members = users.select(F.col("user_id").alias("referrer_id"), F.col("is_member"))
    return (agg.join(members, on="referrer_id", how="left")
               .select("referrer_id", L.is_treatment("is_member").alias("referrer_is_member"),
                       "referred_users", "referral_orders")
               .orderBy(F.desc("referred_users"), "referrer_id"))


# --- M13 ------------------------------------------------------------------------
def tier_repricing(profit: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG,
                   overrides: dict | None = None, method: str = "inverse_rate") -> DataFrame:
    """``tier, discount_rate, new_discount_rate, discount_cost,
    repriced_discount_cost, net_uplift, repriced_net_uplift``: the uplift
    table recomputed with a different rate for some tiers."""
    ov = dict(cfg.repricing) if overrides is None else overrides
    e = _economics(profit)
    new_cost = _repriced_cost(e, cfg, ov, method)
    out = e.select("tier", F.col("rate").cast("double").alias("discount_rate"),
                   L.discount_rate("tier", cfg, ov).cast("double").alias("new_discount_rate"),
                   exact_round(F.col("cost"), 2).alias("discount_cost"),
                   exact_round(new_cost, 2).alias("repriced_discount_cost"),
                   exact_round(F.col("gross") - F.col("cost"), 2).alias("net_uplift"),
                   exact_round(F.col("gross") - new_cost, 2).alias("repriced_net_uplift"))
    return _tier_order(out, cfg)


# --- M14 ------------------------------------------------------------------------
def raw_group_imbalance(eligible: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``tier, treatment_users, control_users, difference, smaller_side``
    before balancing (raw counts: NULL membership counts as control)."""
    t = L.is_treatment("is_member")
    g = (eligible.where(F.col("tier").isin(cfg.tier_names))
                 .groupBy("tier")
                 .agg(F.count_if(t).cast("bigint").alias("treatment_users"),
                      F.count_if(~t).cast("bigint").alias("control_users")))
    out = g.select("tier", "treatment_users", "control_users",
                   (F.col("treatment_users") - F.col("control_users")).alias("difference"),
                   F.when(F.col("treatment_users") < F.col("control_users"), F.lit(TREATMENT))
                    .when(F.col("treatment_users") > F.col("control_users"), F.lit(CONTROL))
                    .otherwise(F.lit("Equal")).alias("smaller_side"))
    return _tier_order(out, cfg)


__all__ = ["unknown_attribute_count", "purchase_rate_lift", "group_size_pivot", "uplift_summary",
           "coupon_mix_pivot", "rollout_non_members", "per_user_economics", "projected_position",
           "projected_discount_cost", "projected_net_position", "payback_period", "scenario_table",
           "referrals_by_referrer", "tier_repricing", "raw_group_imbalance", "profitability_decimal"]
