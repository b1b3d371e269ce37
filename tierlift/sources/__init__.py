"""Input tables: explicit schemas, canonicalising readers, fixture derivation, sinks."""

from .fixtures import TpchFixture, transactions_from_lineitems, transactions_from_orders, users_from_customers
from .readers import absent_columns, canonicalize, read_table, read_transactions, read_users, rejected
from .schemas import MONEY, TRANSACTIONS, USERS
from .store import UserStore, open_store, write_store
from .sinks import write_named_csv, write_parquet, write_report_csv, write_transactions

__all__ = ["TpchFixture", "transactions_from_lineitems", "transactions_from_orders",
           "users_from_customers", "canonicalize", "read_table", "read_transactions", "read_users",
           "MONEY", "TRANSACTIONS", "USERS", "write_parquet", "write_report_csv", "write_named_csv", "write_transactions",
           "absent_columns", "rejected", "UserStore", "open_store", "write_store"]
