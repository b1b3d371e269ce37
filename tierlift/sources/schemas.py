"""Canonical schemas of the two input tables.

Files keep their own column types; the readers match columns by name and cast
them to these.  ``REQUIRED`` columns must be there (the analyses would be empty
without them); the others are carried along and are NULL where absent.  An
order id may also be text: it is only counted."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

USERS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("city", T.StringType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("registration_date", T.DateType(), True),
    T.StructField("latest_login_date", T.DateType(), True),
    T.StructField("first_purchase_date", T.DateType(), True),
    T.StructField("latest_purchase_date", T.DateType(), True),
    T.StructField("opt_in", T.BooleanType(), True),
    T.StructField("transaction_count", T.LongType(), True),
    T.StructField("total_revenue", MONEY, True),
    T.StructField("is_member", T.BooleanType(), True),
    T.StructField("member_tier", T.StringType(), True),
])

TRANSACTIONS = T.StructType([
    T.StructField("txn_date", T.DateType(), False),
    T.StructField("cookie_id", T.StringType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("session_id", T.StringType(), True),
    T.StructField("txn_id", T.LongType(), True),
    T.StructField("coupon", T.StringType(), True),
    T.StructField("revenue", MONEY, True),
    T.StructField("shipping", MONEY, True),
    T.StructField("total", MONEY, True),
])

USER_COLUMNS = [f.name for f in USERS.fields]
TRANSACTION_COLUMNS = [f.name for f in TRANSACTIONS.fields]
REQUIRED = frozenset({"user_id", "registration_date", "opt_in", "is_member", "member_tier",
                      "txn_date", "txn_id", "revenue"})
#: Ids that keep their text if they are not integers.
TEXT_IDS = frozenset({"txn_id"})
