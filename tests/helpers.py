"""Micro-frame builders for unit tests (original 2022-2024 windows)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tierlift.config import ExperimentConfig
from tierlift.sources.schemas import TRANSACTIONS, USERS

CFG = ExperimentConfig(pre_start=dt.date(2022, 1, 1), pre_end=dt.date(2023, 12, 31),
                       launch=dt.date(2024, 1, 1), post_start=dt.date(2024, 1, 1),
                       post_end=dt.date(2024, 12, 31), coupon_prefix="PFX-", referral_label="PFX")
PRE = dt.date(2023, 6, 1)
POST = dt.date(2024, 6, 1)
REG = dt.date(2020, 1, 1)


def user(uid, member=False, tier=None, city="A", gender="M", opt_in=True, reg=REG):
    return {"user_id": uid, "city": city, "gender": gender, "registration_date": reg, "opt_in": opt_in,
            "is_member": member, "member_tier": tier}


def txn(uid, tid, date=PRE, revenue="10.00", coupon=None):
    return {"txn_date": date, "user_id": uid, "txn_id": tid, "coupon": coupon,
            "revenue": None if revenue is None else Decimal(revenue)}


def frame(spark, rows, schema):
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def users_df(spark, rows):
    return frame(spark, rows, USERS)


def tx_df(spark, rows):
    return frame(spark, rows, TRANSACTIONS)


def orders(uid, n, start_tid, date=PRE, revenue="10.00"):
    return [txn(uid, start_tid + i, date, revenue) for i in range(n)]
