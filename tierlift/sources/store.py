"""A co-located store: both tables bucketed by user, so that nothing that is
counted per user is shuffled.

``write_store`` lays ``users`` and ``transactions`` out as Parquet tables with the
same number of buckets of ``user_id``, sorted by it; transactions are also
partitioned by month, so date windows prune folders.  Spark then plans the
per-user aggregates and their join with ``users`` on top of the scans, without
an exchange (a storage-partitioned join).

A bucket is one task, and a user's rows are one bucket.  Users with more than
``HOT`` times a bucket's fair share of the rows, of whom there are fewer than
``buckets / HOT``, and the rows without a user, are therefore kept in a second
table that is not bucketed; their aggregates go through an exchange after
map-side combine.  The two parts have no user in common.

The tables are registered in the session's catalog under names of their own;
the files stay where ``path`` says and are registered again by ``open_store``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.windowing import MONTH

#: A user is hot from so many times the rows that a bucket would have on average.
HOT = 4


@dataclass(frozen=True)
class UserStore:
    users: DataFrame
    #: Transactions of all but the hot users, bucketed by user.
    cold: DataFrame
    #: Transactions of hot users and those without a user.
    hot: DataFrame
    buckets: int
    tables: tuple[str, ...]

    @property
    def transactions(self) -> DataFrame:
        return self.cold.unionByName(self.hot)

    def per_user(self, aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``aggregate`` (transactions -> one row per user) over all users."""
        return aggregate(self.cold).unionByName(aggregate(self.hot))

    def with_users(self, join: Callable[[DataFrame, DataFrame], DataFrame],
                   aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``join(users, rows per user)``, an inner join on ``user_id``, over all
        users.  The rows of hot users are fewer than ``buckets / HOT``, so they
        are broadcast; those of the others are where the users are."""
        return join(self.users, aggregate(self.cold)).unionByName(join(self.users, F.broadcast(aggregate(self.hot))))

    def forget(self) -> None:
        """Take the tables out of the session's catalog; their files stay."""
        for name in self.tables:
            self.users.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def write_store(users: DataFrame, transactions: DataFrame, path: str, buckets: int | None = None) -> UserStore:
    """Write both tables below ``path`` (a new folder) and open them."""
    spark = users.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n < 1:
        raise ValueError("at least one bucket is required")
    root = path.rstrip("/")
    per_user = transactions.where("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
    total = transactions.where("user_id IS NOT NULL").count()
    hot = F.broadcast(per_user.where(F.col("rows") > F.lit(-(-HOT * total // n))).select("user_id"))  # fewer than n / HOT rows
    rows = transactions.withColumn(MONTH, F.trunc("txn_date", "month"))
    cold = rows.where("user_id IS NOT NULL").join(hot, "user_id", "left_anti").select(rows.columns)
    rest = rows.join(hot, "user_id", "left_semi").select(rows.columns).unionByName(rows.where("user_id IS NULL"))

    name = f"store_{uuid.uuid4().hex}"
    (users.repartition(n, "user_id").write.bucketBy(n, "user_id").sortBy("user_id")
          .option("path", f"{root}/users").saveAsTable(f"{name}_users"))
    (cold.repartition(n, "user_id").write.partitionBy(MONTH).bucketBy(n, "user_id").sortBy("user_id")
         .option("path", f"{root}/transactions").saveAsTable(f"{name}_transactions"))
    rest.repartitionByRange("txn_date", "txn_id").write.partitionBy(MONTH).parquet(f"{root}/hot")
    (spark.createDataFrame([(n, cold.schema.json(), users.schema.json())], "buckets int, transactions string, users string")
          .coalesce(1).write.parquet(f"{root}/layout"))
    for table in ("users", "transactions"):
        spark.sql(f"DROP TABLE {name}_{table}")  # registered under the names of the store that is opened
    return open_store(spark, root)


def open_store(spark: SparkSession, path: str) -> UserStore:
    """The store that was written to ``path``, also by another session."""
    root = path.rstrip("/")
    layout = spark.read.parquet(f"{root}/layout").first()
    n, name = layout["buckets"], f"store_{uuid.uuid4().hex}"
    frames = []
    for table in ("users", "transactions"):
        schema = StructType.fromJson(json.loads(layout[table]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        month = f"PARTITIONED BY ({MONTH})" if table == "transactions" else ""
        spark.sql(f"CREATE TABLE {name}_{table} ({columns}) USING parquet {month} CLUSTERED BY (user_id) SORTED BY (user_id) "
                  f"INTO {n} BUCKETS LOCATION '{root}/{table}'")
        if month:
            spark.sql(f"MSCK REPAIR TABLE {name}_{table}")
        frames.append(spark.table(f"{name}_{table}").select([f.name for f in schema.fields]))
    hot = spark.read.schema(frames[1].schema).parquet(f"{root}/hot").select(frames[1].columns)
    return UserStore(frames[0], frames[1], hot, n, (f"{name}_users", f"{name}_transactions"))
