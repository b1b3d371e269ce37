"""One experiment = one config bound to a users and a transactions table.

Frames are memoised per instance, so every report of one ``Experiment`` shares
the same sub-plans.  Building a report of the cohort runs jobs: the eligible
population is written once to the shared checkpoint folder and the balancing
cut is found by a few aggregates over it.  The report itself is a lazy frame on
top.  With ``materialize=True`` (report batches) the cohort and the per-user
facts are written too, so the heavy part (scan, count, balance, per-user
aggregate) runs once for all reports.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from ..config import DEFAULT_CONFIG, ExperimentConfig
from ..operators import cohort as C
from ..operators import facts as FX
from ..operators.windowing import window_txn_counts
from ..session import materialize
from ..sources.fixtures import TpchFixture
from ..sources.readers import absent_columns
from ..sources.sinks import write_named_csv
from ..sources.store import UserStore
from . import finance as M
from . import reports as R


#: Columns of the eligible population that some report reads.
ELIGIBLE_COLUMNS = ["user_id", "city", "gender", "is_member", "n_orders", "tier_label", "tier"]
#: Optional columns without which a report would be empty or wrong.
NEEDS = {"gender_split": "gender", "unknown_attribute_count": "gender", "city_split": "city", "coupon_usage": "coupon",
         "coupon_mix_pivot": "coupon", "referrals_by_referrer": "coupon"}


class Experiment:
    def __init__(self, users: DataFrame, transactions: DataFrame,
                 cfg: ExperimentConfig = DEFAULT_CONFIG, balance_method: str = "cutoff",
                 materialize: bool | str = "eligible", check_unique_ids: bool = False):
        """``materialize``: ``"eligible"`` (default) writes the eligible
        population, the seven columns that reports read, once to the shared
        checkpoint folder when a report first needs the cohort (the balancing
        reads it several times: selection histograms and final cut);
        ``True`` also writes the cohort and the per-user post-launch rows,
        for batches that run many reports over one experiment; ``False``
        writes nothing.
        ``check_unique_ids`` runs one aggregate over ``users`` first and fails
        on a repeated id."""
        self.users, self.tx, self.cfg = users, transactions, cfg
        if check_unique_ids:
            dup = C.duplicate_user_ids(users).limit(1).collect()
            if dup:
                raise ValueError(f"user_id {dup[0]['user_id']} occurs {dup[0]['copies']} times in users")
        self.balance_method, self._materialize = balance_method, materialize
        self._store: UserStore | None = None
        self._side_counts: dict | None = None

    @classmethod
    def from_tpch(cls, spark: SparkSession, sf_dir: str, cfg: ExperimentConfig = DEFAULT_CONFIG,
                  grain: str = "order", **kw) -> "Experiment":
        fx = TpchFixture(spark, sf_dir, cfg, grain)
        return cls(fx.users(), fx.transactions(), cfg, **kw)

    @classmethod
    def from_store(cls, store: UserStore, cfg: ExperimentConfig = DEFAULT_CONFIG, **kw) -> "Experiment":
        """Over a co-located store: what is counted per user is not shuffled."""
        ex = cls(store.users, store.transactions, cfg, **kw)
        ex._store = store
        return ex

    def _keep(self, df: DataFrame, what: str = "all") -> DataFrame:
        on = self._materialize is True or (self._materialize == "eligible" and what == "eligible")
        return materialize(df) if on else df

    # --- shared sub-plans ---------------------------------------------------
    def _eligible_plan(self) -> DataFrame:
        if self._store:
            return self._store.with_users(lambda users, counts: C.eligible_of(users, counts, self.cfg),
                                          lambda tx: window_txn_counts(tx, self.cfg.pre_start, self.cfg.pre_end))
        return C.eligible_users(self.users, self.tx, self.cfg)

    @cached_property
    def eligible(self) -> DataFrame:
        e = self._eligible_plan()
        e = e.select(*[c for c in ELIGIBLE_COLUMNS if c in e.columns])
        if self._materialize in (True, "eligible"):
            # Per-(tier, side) sizes ride along with the writing job.
            obs = Observation("tierlift_side_counts")
            text = isinstance(e.schema["user_id"].dataType, T.StringType)
            e = materialize(e.observe(obs, *C.side_count_metrics(self.cfg, text)))
            self._side_counts = obs.get
        return e

    @cached_property
    def cohort(self) -> DataFrame:
        _ = self.eligible
        return self._keep(C.balanced_users(self.eligible, self.cfg, self.balance_method,
                                           side_counts=self._side_counts))

    @cached_property
    def facts(self) -> DataFrame:
        per_user = lambda tx: FX.per_user_facts(tx, self.cfg)
        return self._store.per_user(per_user) if self._store else per_user(self.tx)

    @cached_property
    def post(self) -> DataFrame:
        return self._keep(FX.user_post_launch(self.cohort, self.tx, self.cfg, facts=self.facts))

    def _eligible_once(self) -> DataFrame:
        """Eligible frame for a single-use consumer: the materialised one if it
        already exists, otherwise the lazy plan (nothing is written for it)."""
        if "eligible" in self.__dict__:
            return self.__dict__["eligible"]
        return self._eligible_plan()

    @cached_property
    def full(self) -> DataFrame:
        return C.full_eligible(self._eligible_once(), self.cfg)

    @cached_property
    def profit(self) -> DataFrame:
        # 2 x tiers rows, read two to four times by every finance operator:
        # materialised once so their self-joins do not replay the cohort plan.
        p = R.profitability_decimal(self.post, self.cfg)
        return materialize(p) if self._materialize else p

    # --- the eight analyses -------------------------------------------------
    def tier_counts_raw(self) -> DataFrame:
        return R.tier_counts_raw(self._eligible_once())

    def balanced_group_sizes(self) -> DataFrame:
        return R.balanced_group_sizes(self.cohort, self.cfg)

    def gender_split(self) -> DataFrame:
        self.check("gender_split")
        return R.gender_split(self.cohort, self.cfg)

    def city_split(self) -> DataFrame:
        self.check("city_split")
        counts = R.city_counts(self.cohort)  # group types x cities rows, read by two joins
        return R.city_split(self.cohort, self.cfg, materialize(counts) if self._materialize else counts)

    def engagement(self) -> DataFrame:
        return R.engagement(self.post, self.cfg)

    def coupon_usage(self) -> DataFrame:
        self.check("coupon_usage")
        return R.coupon_usage(self.cohort, self.tx, self.cfg)

    def tier_profitability(self) -> DataFrame:
        return R.tier_profitability(self.post, self.cfg)

    def rollout_projection(self, population: str = "eligible_users") -> DataFrame:
        alias = "full_eligible_users" if population == "eligible_users" else "non_member_users"
        profit = self.profit  # materialises the eligible frame first, ``full`` then reuses it
        return R.rollout_projection(profit, self.full, self.cfg, population, alias)

    # --- finance tables -----------------------------------------------------
    def unknown_attribute_count(self) -> DataFrame:
        self.check("unknown_attribute_count")
        return M.unknown_attribute_count(self.cohort)

    def purchase_rate_lift(self) -> DataFrame:
        return M.purchase_rate_lift(self.post, self.cfg)

    def group_size_pivot(self) -> DataFrame:
        return M.group_size_pivot(self.cohort, self.cfg)

    def uplift_summary(self) -> DataFrame:
        return M.uplift_summary(self.profit, self.cfg)

    def coupon_mix_pivot(self) -> DataFrame:
        self.check("coupon_mix_pivot")
        return M.coupon_mix_pivot(self.coupon_usage(), self.cfg)

    def rollout_non_members(self) -> DataFrame:
        profit = self.profit
        return M.rollout_non_members(profit, self.full, self.cfg)

    def per_user_economics(self) -> DataFrame:
        return M.per_user_economics(self.profit, self.cfg)

    def projected_discount_cost(self) -> DataFrame:
        profit = self.profit
        return M.projected_discount_cost(profit, self.full, self.cfg)

    def projected_net_position(self) -> DataFrame:
        profit = self.profit
        return M.projected_net_position(profit, self.full, self.cfg)

    def payback_period(self) -> DataFrame:
        profit = self.profit
        return M.payback_period(profit, self.full, self.cfg)

    def scenario_table(self) -> DataFrame:
        profit = self.profit
        return M.scenario_table(profit, self.full, self.cfg)

    def referrals_by_referrer(self) -> DataFrame:
        self.check("referrals_by_referrer")
        return M.referrals_by_referrer(self.tx, self.users, self.cfg)

    def tier_repricing(self) -> DataFrame:
        return M.tier_repricing(self.profit, self.cfg)

    def raw_group_imbalance(self) -> DataFrame:
        return M.raw_group_imbalance(self._eligible_once(), self.cfg)

    # --- batch ------------------------------------------------------------------
    REPORTS = ("tier_counts_raw", "balanced_group_sizes", "gender_split", "city_split",
               "engagement", "coupon_usage", "tier_profitability", "rollout_projection")
    FINANCE = ("unknown_attribute_count", "purchase_rate_lift", "group_size_pivot", "uplift_summary", "coupon_mix_pivot",
               "rollout_non_members", "per_user_economics", "projected_discount_cost", "projected_net_position",
               "payback_period", "scenario_table", "referrals_by_referrer", "tier_repricing", "raw_group_imbalance")

    def check(self, *names: str) -> None:
        """Fail if a report needs a column that the tables do not have."""
        have = ({*self.users.columns, *self.tx.columns} - absent_columns(self.users)) - absent_columns(self.tx)
        lacking = [f"{name} needs {NEEDS[name]!r}" for name in names if NEEDS.get(name, "user_id") not in have]
        if lacking:
            raise ValueError(f"{'; '.join(lacking)}: the input has no such column")

    def reports(self, names: tuple[str, ...] = REPORTS) -> dict[str, DataFrame]:
        """The named reports (the eight analyses) over one shared cohort (lazy frames)."""
        unknown = sorted(set(names) - {*self.REPORTS, *self.FINANCE})
        if unknown:
            raise ValueError(f"no reports {unknown}; there are {[*self.REPORTS, *self.FINANCE]}")
        self.check(*names)
        return {name: getattr(self, name)() for name in names}

    def write_reports(self, out_dir: str, names: tuple[str, ...] = (*REPORTS, *FINANCE)) -> dict[str, str]:
        """Write every report as one headed CSV file, ``<out_dir>/<report>.csv``.
        Use ``materialize=True`` so the heavy part runs once for all reports."""
        paths = {}
        for name, df in self.reports(names).items():
            paths[name] = f"{out_dir.rstrip('/')}/{name}.csv"
            write_named_csv(df, paths[name])
        return paths
