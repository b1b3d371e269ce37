"""Cohort construction: eligibility, treatment/control split, matched downsampling.

Population rules (semantics kept from the analysed scripts):

* eligible = registered before launch, opted in (NULL is not TRUE), at least
  one distinct order in the pre-window;
* members (``is_member IS TRUE``) keep their *stored* tier, everyone else gets
  the control label of the ladder rung of their pre-window order count;
* raw counts and the eligible population include NULL-membership users (as
  control), every balanced analysis excludes them (``IS FALSE``);
* members with a NULL or unlisted tier, and tiers present on one side only,
  drop out of the balanced cohort;
* per tier both sides are cut to the smaller side's size, keeping the lowest
  user ids (reproducible, no random sampling).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_CONFIG, ExperimentConfig
from ..functions import labels as L
from .ranking import IN_PLAY, bucketed_row_number, k_smallest_per_group
from .windowing import window_txn_counts

COHORT_KEYS = ["tier", "is_member"]


def eligible_users(users: DataFrame, tx: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """Users columns + ``n_orders``, ``tier_label`` (stored tier or control
    label) and ``tier`` (display tier: stored tier or mapped control tier).

    The registration / opt-in predicates sit directly above the users scan
    (pushed to Parquet); the count side is already hash-partitioned on
    ``user_id`` by its aggregate, so the join shuffles only the users side (or
    AQE turns it into a broadcast when the users side is small)."""
    return eligible_of(users, window_txn_counts(tx, cfg.pre_start, cfg.pre_end), cfg)


def eligible_of(users: DataFrame, counts: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """:func:`eligible_users` from known pre-window order counts per user."""
    counts = counts.where(F.col("n_orders") > 0)
    u = users.where(F.col("registration_date") < F.lit(cfg.launch)).where("opt_in = TRUE")
    e = u.join(counts, on="user_id", how="inner")
    cols = [c for c in e.columns if c != "n_orders"]
    return e.selectExpr(
        *[L.q(c) for c in cols], "CAST(n_orders AS BIGINT) AS n_orders",
        f"CASE WHEN is_member IS TRUE THEN member_tier ELSE {L.ladder_sql('n_orders', cfg, 'control_label')} END"
        " AS tier_label",
        f"CASE WHEN is_member IS TRUE THEN member_tier ELSE {L.ladder_sql('n_orders', cfg, 'name')} END AS tier")


def duplicate_user_ids(users: DataFrame) -> DataFrame:
    """``user_id, copies`` for ids that occur more than once.  Balancing keeps
    the lowest ids per group, which is only reproducible (and, for the
    threshold cut, only exact in size) when ids are unique.  A partial/final
    aggregate: a hot duplicated id is combined map-side."""
    return (users.groupBy("user_id").agg(F.count(F.lit(1)).alias("copies"))
                 .where(F.col("copies") > 1))


def status_split(eligible: DataFrame) -> DataFrame:
    """``user_id, group_type`` with NULL membership removed."""
    return (eligible.where(F.col("is_member").isNotNull())
                    .select("user_id", L.group_type("is_member").alias("group_type")))


def _sampleable(eligible: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Rows that can enter the cohort: known membership and a listed tier.
    The tier filter bounds the group count by the ladder size."""
    return eligible.where(F.col("is_member").isNotNull() & F.col("tier").isin(cfg.tier_names))


def target_counts(eligible: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``tier, treatment_n, control_n, target_n``; tiers with an empty side are
    absent.  One conditional aggregate replaces the two counts + join."""
    return (_sampleable(eligible, cfg)
            .groupBy("tier")
            .agg(F.count_if(F.col("is_member")).cast("bigint").alias("treatment_n"),
                 F.count_if(~F.col("is_member")).cast("bigint").alias("control_n"))
            .where((F.col("treatment_n") > 0) & (F.col("control_n") > 0))
            .withColumn("target_n", F.least("treatment_n", "control_n")))


def control_counts(eligible: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``tier, control_label, control_n``: non-members per mapped tier."""
    labels = {t.name: t.control_label for t in cfg.tiers}
    return (eligible.where(L.is_control("is_member") & F.col("tier").isin(cfg.tier_names))
                    .groupBy("tier").agg(F.count(F.lit(1)).alias("control_n"))
                    .select("tier", L.tier_case("tier", labels).alias("control_label"),
                            "control_n"))


def ranked_users(eligible: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``user_id, group_type, tier, rn``: position by user id inside (tier,
    side), for every user that can be sampled.  Exact ``ROW_NUMBER`` computed
    over equi-depth id ranges with broadcast offsets (no single-task sort of
    a whole tier)."""
    base = _sampleable(eligible, cfg).select("user_id", "tier", "is_member")
    r = bucketed_row_number(base, COHORT_KEYS, "user_id")
    return r.select("user_id", L.group_type("is_member").alias("group_type"), "tier", "rn")


#: Size of the quantile sketches; the error of a rank is below ``SKETCH_MARGIN``
#: of the rows but for odd cases, which the selection notices.
SKETCH_K, SKETCH_MARGIN = 4_096, 0.003


def _sides(cfg: ExperimentConfig):
    for i, t in enumerate(cfg.tiers):
        for side, flag in (("t", True), ("c", False)):
            yield f"{side}{i}", t.name, flag


def side_count_metrics(cfg: ExperimentConfig = DEFAULT_CONFIG, text_ids: bool = False) -> list:
    """Aggregate expressions over eligible users per (tier, side), for
    ``DataFrame.observe``: they are gathered during an action that runs anyway
    (the eligible checkpoint), without a job of their own.  The number of users
    and, of integral ids, their range and a quantile sketch."""
    out = []
    for name, tier, flag in _sides(cfg):
        cond = f"is_member IS {str(flag).upper()} AND tier = {L.lit(tier)}"
        out.append(F.expr(f"count_if({cond})").alias(name))
        if not text_ids:
            mine = f"CASE WHEN {cond} THEN user_id END"
            out += [F.expr(f"min({mine})").alias(f"{name}_lo"), F.expr(f"max({mine})").alias(f"{name}_hi"),
                    F.expr(f"kll_sketch_agg_bigint({mine}, {SKETCH_K})").alias(f"{name}_ids")]
    return out


def group_ranges_from_side_counts(metrics: dict, cfg: ExperimentConfig = DEFAULT_CONFIG) -> list[tuple]:
    """``(tier, is_member, lo, hi)`` per non-empty group from observed metrics
    (none for text ids)."""
    return [(tier, flag, int(metrics[f"{name}_lo"]), int(metrics[f"{name}_hi"])) for name, tier, flag in _sides(cfg)
            if metrics.get(f"{name}_lo") is not None and metrics.get(f"{name}_hi") is not None]


def id_brackets(spark: SparkSession, metrics: dict, cfg: ExperimentConfig = DEFAULT_CONFIG) -> dict:
    """``{(tier, is_member): (lo, hi)}``: where the sketches place the id at the
    cut of each group that is refined at all (more than ``IN_PLAY`` rows)."""
    targets = {r[0]: r[3] for r in targets_from_side_counts(metrics, cfg)}
    found = {}
    for name, tier, flag in _sides(cfg):
        n, sketch = int(metrics[name]), metrics.get(f"{name}_ids")
        if tier in targets and n > IN_PLAY and sketch is not None:
            rank = targets[tier] / n
            # Constants: Spark evaluates them while it plans.
            found[tier, flag] = [F.kll_sketch_get_quantile_bigint(F.lit(bytes(sketch)), F.lit(min(1.0, max(0.0, rank + margin))))
                                 for margin in (-SKETCH_MARGIN, SKETCH_MARGIN)]
    if not found:
        return {}
    values = iter(spark.range(1).select(*[c for pair in found.values() for c in pair]).first())
    return {group: (next(values), next(values)) for group in found}


def targets_from_side_counts(metrics: dict, cfg: ExperimentConfig = DEFAULT_CONFIG) -> list[tuple]:
    """``(tier, treatment_n, control_n, target_n)`` rows from observed metrics,
    dropping tiers with an empty side (same rows as :func:`target_counts`)."""
    rows = []
    for i, t in enumerate(cfg.tiers):
        tn, cn = int(metrics[f"t{i}"]), int(metrics[f"c{i}"])
        if tn > 0 and cn > 0:
            rows.append((t.name, tn, cn, min(tn, cn)))
    return rows


def balanced_users(eligible: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG,
                   method: str = "cutoff", side_counts: dict | None = None) -> DataFrame:
    """Eligible columns + ``group_type`` for the matched cohort: per (tier,
    side) exactly ``target_n`` rows, those with the lowest ids.

    ``method='cutoff'`` (the one every report uses): distributed selection of
    each group's k-th smallest id, then a narrow filter at those ids.  ``method='branches'``: the same cut on each side by itself,
    then ``UNION ALL`` of both, the shape of the analysed scripts.
    ``method='window'``: one ``ROW_NUMBER`` window over (tier, side), a
    reference for tests; a whole group is one window task.

    ``side_counts`` are the per-(tier, side) counts and id ranges observed while
    the eligible frame was written; without them they are aggregated here."""
    base = _sampleable(eligible, cfg)
    spark = eligible.sparkSession
    if side_counts is not None:
        targets = {r[0]: r[3] for r in targets_from_side_counts(side_counts, cfg)}
    else:
        targets = {r["tier"]: r["target_n"] for r in target_counts(eligible, cfg).collect()}  # <= tiers rows
    if method in ("cutoff", "branches"):
        ranges = brackets = sizes = None
        if side_counts is not None:
            sizes = {(tier, flag): int(side_counts[name]) for name, tier, flag in _sides(cfg)}
            if not isinstance(base.schema["user_id"].dataType, T.StringType):
                ranges = {(tier, flag): (lo, hi) for tier, flag, lo, hi in group_ranges_from_side_counts(side_counts, cfg)}
                brackets = id_brackets(spark, side_counts, cfg)

        def cut(side: DataFrame, flags: tuple[bool, ...]) -> DataFrame:
            limits = {(tier, flag): n for tier, n in targets.items() for flag in flags}
            return k_smallest_per_group(side, COHORT_KEYS, "user_id", limits, buckets=cfg.balance_buckets, ranges=ranges,
                                        brackets=brackets, sizes=sizes)

        if method == "cutoff":
            kept = cut(base, (True, False))
        else:
            kept = cut(base.where("is_member"), (True,)).unionByName(cut(base.where("NOT is_member"), (False,)))
    elif method == "window":
        w = Window.partitionBy(*COHORT_KEYS).orderBy("user_id")
        rows = spark.createDataFrame(list(targets.items()), "tier string, target_n bigint")
        kept = (base.join(F.broadcast(rows), on="tier", how="inner")
                    .withColumn("_rn", F.row_number().over(w))
                    .where(F.col("_rn") <= F.col("target_n"))
                    .drop("_rn", "target_n"))
    else:
        raise ValueError(f"unknown balancing method {method!r}")
    return kept.withColumn("group_type", L.group_type("is_member"))


def full_eligible(eligible: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """``tier, eligible_users, non_members``: whole eligible population per
    display tier (members by stored tier, all others by mapped tier, NULL
    membership included), and the part that is not enrolled."""
    return (eligible.groupBy("tier")
                    .agg(F.count(F.lit(1)).alias("eligible_users"),
                         F.count_if(~L.is_treatment("is_member")).cast("bigint").alias("non_members")))
