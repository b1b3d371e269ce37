"""Randomised differential test: every registered query against its DuckDB
oracle on small random star-schema tables (sparse keys, random dates and
prices, 1-4 lines per order, orders of unknown customers)."""

from __future__ import annotations

import datetime as dt
import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SEGMENTS = ["MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]
START = dt.datetime(1995, 6, 1)


@st.composite
def star_schema(draw):
    n_cust = draw(st.integers(30, 150))
    custkeys = sorted(draw(st.sets(st.integers(0, 10**6), min_size=n_cust, max_size=n_cust)))
    cust = {
        "c_custkey": custkeys,
        "c_nationkey": [draw(st.integers(0, 4)) for _ in custkeys],
        "c_mktsegment": [draw(st.sampled_from(SEGMENTS)) for _ in custkeys],
    }
    n_ord = draw(st.integers(100, 400))
    okeys = sorted(draw(st.sets(st.integers(1, 10**7), min_size=n_ord, max_size=n_ord)))
    # a few orders of customers that do not exist
    owners = custkeys + [10**6 + 1, 10**6 + 2]
    orders = {
        "o_orderkey": okeys,
        "o_custkey": [draw(st.sampled_from(owners)) for _ in okeys],
        "o_totalprice": [draw(st.integers(100, 10**7)) / 100 for _ in okeys],
        "o_orderdate": [START + dt.timedelta(days=draw(st.integers(0, 1700))) for _ in okeys],
    }
    lines = {"l_orderkey": [], "l_linenumber": [], "l_extendedprice": []}
    for k in okeys:
        for ln in range(1, draw(st.integers(1, 4)) + 1):
            lines["l_orderkey"].append(k)
            lines["l_linenumber"].append(ln)
            lines["l_extendedprice"].append(draw(st.integers(100, 10**6)) / 100)
    return cust, orders, lines


def _write(tmp, cust, orders, lines):
    d = str(tmp)
    pq.write_table(pa.table({"c_custkey": pa.array(cust["c_custkey"], pa.int64()),
                             "c_nationkey": pa.array(cust["c_nationkey"], pa.int32()),
                             "c_mktsegment": pa.array(cust["c_mktsegment"], pa.string())}), f"{d}/customer.parquet")
    pq.write_table(pa.table({"n_nationkey": pa.array(range(5), pa.int32()),
                             "n_name": pa.array([f"N{i}" for i in range(5)], pa.string())}), f"{d}/nation.parquet")
    pq.write_table(pa.table({"o_orderkey": pa.array(orders["o_orderkey"], pa.int64()),
                             "o_custkey": pa.array(orders["o_custkey"], pa.int64()),
                             "o_totalprice": pa.array(orders["o_totalprice"], pa.float64()),
                             "o_orderdate": pa.array(orders["o_orderdate"], pa.timestamp("us"))}),
                   f"{d}/orders.parquet")
    pq.write_table(pa.table({"l_orderkey": pa.array(lines["l_orderkey"], pa.int64()),
                             "l_linenumber": pa.array(lines["l_linenumber"], pa.int32()),
                             "l_extendedprice": pa.array(lines["l_extendedprice"], pa.float64())}),
                   f"{d}/lineitem.parquet")
    return d


@settings(max_examples=int(os.environ.get("DIFFERENTIAL_EXAMPLES", "2")), deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate],
          suppress_health_check=[HealthCheck.function_scoped_fixture,
                                                                 HealthCheck.too_slow,
                                                                 HealthCheck.data_too_large])
@given(data=star_schema())
def test_all_queries_match_oracle_on_random_tables(spark, tmp_path_factory, data):
    import oracle_check as OC
    import __spark_entry__ as E
    from tierlift.plans.catalog import QUERIES
    d = _write(tmp_path_factory.mktemp("star"), *data)
    con = OC.duck(d)
    sqls = E.oracle_sql()
    failures = {}
    for name, fn in QUERIES.items():
        problems, _, _ = OC.compare(spark, con, name, fn, sqls[name], d)
        if problems:
            failures[name] = problems
    assert not failures, {k: v[0][:300] for k, v in failures.items()}


people = st.lists(st.tuples(st.integers(1, 12), st.booleans(), st.sampled_from(["Bronze", "Silver", None])),
                  min_size=1, max_size=40)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=people, counts=st.lists(st.integers(0, 3), min_size=12, max_size=12))
def test_cutoff_equals_window_with_repeated_ids(spark, rows, counts):
    """The balanced cohort keeps the same ids per tier and side, and the same
    number on both sides, whatever ids repeat."""
    from helpers import CFG, orders, tx_df, user, users_df

    from tierlift.operators.cohort import balanced_users, eligible_users
    users = users_df(spark, [user(i, member, tier if member else None) for i, member, tier in rows])
    tx = tx_df(spark, [t for i, n in enumerate(counts, 1) for t in orders(i, n, 100 * i)])
    eligible = eligible_users(users, tx, CFG)
    kept = {}
    for method in ("window", "cutoff", "branches"):
        got = balanced_users(eligible, CFG, method).select("tier", "group_type", "user_id").collect()
        kept[method] = sorted(map(tuple, got))
    assert kept["cutoff"] == kept["window"] == kept["branches"]
    sides = {}
    for tier, side, _ in kept["cutoff"]:
        sides.setdefault(tier, {"Treatment": 0, "Control": 0})[side] += 1
    assert all(s["Treatment"] == s["Control"] for s in sides.values())
