"""A different ladder (gaps between rungs, other names, rates and windows)
gives the same answers in Spark and in the config-generated oracle."""

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def custom():
    from tierlift.config import ExperimentConfig, Tier
    tiers = (Tier("Basic", "basic_ctl", 1, 1, 0.02, 1),
             Tier("Plus", "plus_ctl", 3, 4, 0.08, 2),     # 2 orders: no rung
             Tier("Elite", "elite_ctl", 6, None, 0.25, 3))  # 5 orders: no rung
    return ExperimentConfig(pre_start=dt.date(1995, 1, 1), pre_end=dt.date(1997, 6, 30),
                            launch=dt.date(1997, 7, 1), post_start=dt.date(1997, 7, 1),
                            post_end=dt.date(1998, 12, 31), tiers=tiers, top_n_cities=5,
                            repricing=(("Elite", 0.2),))


@pytest.mark.parametrize("method", ["branches", "cutoff"])
def test_reports_match_oracle_with_custom_ladder(spark, custom, method):
    import oracle_check as OC
    from oracle_queries import oracle_sql
    from tierlift.plans import finance as M
    from tierlift.plans.experiment import Experiment
    sqls = oracle_sql(custom)
    con = OC.duck(SF)

    def exp():
        return Experiment.from_tpch(spark, SF, custom, balance_method=method)

    cases = {name: (lambda s, d, n=name: getattr(exp(), n)()) for name in Experiment.REPORTS}
    cases["uplift_summary"] = lambda s, d: M.uplift_summary(exp().profit, custom)
    cases["tier_repricing"] = lambda s, d: M.tier_repricing(exp().profit, custom)
    cases["raw_group_imbalance"] = lambda s, d: M.raw_group_imbalance(exp().eligible, custom)
    failures = {}
    for name, fn in cases.items():
        problems, n, _ = OC.compare(spark, con, name, fn, sqls[name], SF)
        if problems:
            failures[name] = problems
    assert not failures, failures
