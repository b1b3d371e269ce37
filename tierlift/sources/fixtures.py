"""Derive the experiment's ``users`` and ``transactions`` from the star-schema
test tables (``customer``, ``nation``, ``orders``, ``lineitem``).

The source project ships no input data, so the inputs are a deterministic
relabelling of the driver's tables (see FIXTURES.md §2).  Every column is an
arithmetic rule on keys, so the derivation is a narrow projection: it runs in
whole-stage codegen and scales with the input tables.  The only wide step is
the pre-window order count that decides the stored tier of members, which is
the same aggregate the eligibility step computes (Spark reuses the exchange).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, ExperimentConfig
from ..functions.labels import ladder_sql, lit
from .schemas import TRANSACTIONS, USERS

# --- fixed values: fixture relabelling rules (FIXTURES.md §2) ---------------
# users:  city NULL if id % 113 = 0; gender NULL if % 127 = 0, 'Unknown' if
#         % 10 = 9, 'F' if % 10 < 5, else 'M'; registration = 1994-01-01 +
#         (id * 37) % 1800 days; opt-in NULL if % 97 = 0, else segment is not
#         'MACHINERY'; membership NULL if % 41 = 0, else id is even; stored
#         tier NULL for odd ids and % 59 = 0, 'Platinum' if % 53 = 0.
# orders: user NULL if orderkey % 29 = 0; txn id NULL if % 211 = 0; coupon by
#         k = key % 10: 0,1 -> prefix || (custkey + 7) % 150, 2 -> 'SAVE10',
#         3 -> '', else NULL (line grain: k = (key + linenumber) % 10).
CITY_NULL_MOD = 113
GENDER_NULL_MOD = 127
REG_BASE = _dt.date(1994, 1, 1)
REG_MULT = 37
REG_SPAN_DAYS = 1800
OPT_IN_NULL_MOD = 97
OPT_OUT_SEGMENT = "MACHINERY"
MEMBER_NULL_MOD = 41
TIER_NULL_MOD = 59
TIER_FORCED_MOD = 53
TIER_FORCED = "Platinum"
USER_NULL_MOD = 29
TXN_NULL_MOD = 211
REFERRER_OFFSET = 7
REFERRER_SPACE = 150
OTHER_COUPON_CODE = "SAVE10"
# --- end of fixed values ----------------------------------------------------


def _typed(exprs: dict, schema) -> list[str]:
    """Projection text in schema order; unset columns become typed NULLs."""
    return [f"CAST({exprs.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in schema.fields]


def _tx_exprs(key: str, cust: str, k: str, price: str, cfg: ExperimentConfig) -> list[str]:
    """The TRANSACTIONS schema as one projection (SQL text, parsed once)."""
    return _typed({
        "txn_date": "CAST(o_orderdate AS DATE)",
        "user_id": f"CASE WHEN {key} % {USER_NULL_MOD} = 0 THEN NULL ELSE {cust} END",
        "txn_id": f"CASE WHEN {key} % {TXN_NULL_MOD} = 0 THEN NULL ELSE {key} END",
        "coupon": (f"CASE WHEN {k} IN (0, 1) THEN concat({lit(cfg.coupon_prefix)}, "
                   f"CAST(({cust} + {REFERRER_OFFSET}) % {REFERRER_SPACE} AS STRING)) "
                   f"WHEN {k} = 2 THEN {lit(OTHER_COUPON_CODE)} WHEN {k} = 3 THEN '' END"),
        "revenue": f"CAST({price} AS DECIMAL(18,2))",
    }, TRANSACTIONS)


def transactions_from_orders(orders: DataFrame, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """Order grain: one transaction row per order."""
    return orders.selectExpr(*_tx_exprs("o_orderkey", "o_custkey", "o_orderkey % 10", "o_totalprice", cfg))


def transactions_from_lineitems(orders: DataFrame, lineitem: DataFrame,
                                cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """Line grain: one row per order line, so order ids repeat and one order can
    carry several coupon classes.  ``lineitem`` is the fact table here; the
    join to ``orders`` is a key/foreign-key equi-join (shuffle on the order key,
    AQE picks broadcast when ``orders`` is small)."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    li = lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
    return j.selectExpr(*_tx_exprs("o_orderkey", "o_custkey", "(o_orderkey + l_linenumber) % 10",
                                   "l_extendedprice", cfg))


def _stored_tier_sql(n: str, cfg: ExperimentConfig) -> str:
    """Tier a member holds in the fixture: the ladder rung of the pre-window
    order count, where 0 orders also count as the lowest rung."""
    low = cfg.tiers[0]
    return (f"CASE WHEN coalesce({n}, 0) <= {low.min_orders} THEN {lit(low.name)} ELSE "
            + ladder_sql(n, cfg, "name") + " END")


def users_from_customers(customer: DataFrame, nation: DataFrame, transactions: DataFrame,
                         cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """One user per customer; city is the nation name."""
    from ..operators.windowing import window_txn_counts  # local: avoid cycle

    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation is a 25-row dimension of fixed size: broadcasting it is safe.
    n = F.broadcast(nation.select("n_nationkey", "n_name"))
    pre = window_txn_counts(transactions, cfg.pre_start, cfg.pre_end)
    j = (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
          .join(pre, F.col("c_custkey") == F.col("user_id"), "left"))
    cid = "c_custkey"
    return j.selectExpr(*_typed({
        "user_id": cid,
        "city": f"CASE WHEN {cid} % {CITY_NULL_MOD} = 0 THEN NULL ELSE n_name END",
        "gender": (f"CASE WHEN {cid} % {GENDER_NULL_MOD} = 0 THEN NULL WHEN {cid} % 10 = 9 THEN 'Unknown' "
                   f"WHEN {cid} % 10 < 5 THEN 'F' ELSE 'M' END"),
        "registration_date": (f"date_add(DATE'{REG_BASE.isoformat()}', "
                              f"CAST(({cid} * {REG_MULT}) % {REG_SPAN_DAYS} AS INT))"),
        "opt_in": (f"CASE WHEN {cid} % {OPT_IN_NULL_MOD} = 0 THEN NULL "
                   f"ELSE c_mktsegment != {lit(OPT_OUT_SEGMENT)} END"),
        "is_member": f"CASE WHEN {cid} % {MEMBER_NULL_MOD} = 0 THEN NULL ELSE {cid} % 2 = 0 END",
        "member_tier": (f"CASE WHEN {cid} % 2 = 1 OR {cid} % {TIER_NULL_MOD} = 0 THEN NULL "
                        f"WHEN {cid} % {TIER_FORCED_MOD} = 0 THEN {lit(TIER_FORCED)} "
                        f"ELSE {_stored_tier_sql('n_orders', cfg)} END"),
    }, USERS))


# Columns of the star-schema tables the relabelling reads.  Declaring them
# skips footer-based schema inference and prunes every other column at the
# scan (names and types of the driver's Parquet files).
TPCH_READ_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE",
}


class TpchFixture:
    """Lazily bound users/transactions of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str,
                 cfg: ExperimentConfig = DEFAULT_CONFIG, grain: str = "order"):
        if grain not in ("order", "line"):
            raise ValueError("grain must be 'order' or 'line'")
        self.spark, self.sf_dir, self.cfg, self.grain = spark, sf_dir.rstrip("/"), cfg, grain
        self._tables: dict[str, DataFrame] = {}
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read
            if name in TPCH_READ_SCHEMAS:
                reader = reader.schema(TPCH_READ_SCHEMAS[name])
            self._tables[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def _order_tx(self) -> DataFrame:
        if "order_tx" not in self._frames:
            self._frames["order_tx"] = transactions_from_orders(self.table("orders"), self.cfg)
        return self._frames["order_tx"]

    def transactions(self) -> DataFrame:
        if self.grain == "line":
            if "line_tx" not in self._frames:
                self._frames["line_tx"] = transactions_from_lineitems(
                    self.table("orders"), self.table("lineitem"), self.cfg)
            return self._frames["line_tx"]
        return self._order_tx()

    def users(self) -> DataFrame:
        # Stored tiers always come from order-grain counts, so both grains
        # describe the same population.
        if "users" not in self._frames:
            self._frames["users"] = users_from_customers(self.table("customer"), self.table("nation"),
                                                         self._order_tx(), self.cfg)
        return self._frames["users"]
