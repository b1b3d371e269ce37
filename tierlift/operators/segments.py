"""Shares of a group, rank-based top-N with a remainder bucket.

All of them aggregate *before* anything is joined or ranked: the cohort is
first reduced map-side to counts per (group, attribute), so a hot attribute
value (one city with 40 % of the users) is pre-aggregated in every task and
never lands whole in one partition.  Everything downstream of that first
aggregate works on at most (#groups x #attribute values) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import pct


def counts_by(df: DataFrame, group: str, by: str, out: str = "user_count") -> DataFrame:
    return df.groupBy(group, by).agg(F.count(F.lit(1)).alias(out))


def pct_of_counts(counts: DataFrame, group: str, count_col: str, digits: int,
                  out: str = "pct_of_group") -> DataFrame:
    """Share of each row's count within its ``group`` (= ``SUM(n) OVER
    (PARTITION BY group)``; a NULL group is a group).  The totals are joined
    back null-safely; Spark broadcasts them where they are small, and splits a
    large group where they are not."""
    totals = counts.groupBy(F.col(group).alias("_group_key")).agg(F.sum(count_col).alias("_group_total"))
    return (counts.join(totals, F.col(group).eqNullSafe(F.col("_group_key")))
                  .withColumn(out, pct(F.col(count_col), F.col("_group_total"), digits))
                  .drop("_group_key", "_group_total"))


def pct_of_group(df: DataFrame, group: str, by: str, digits: int = 1,
                 count_col: str = "user_count", out: str = "pct_of_group") -> DataFrame:
    """``group, by, user_count, pct_of_group`` over the rows of ``df``."""
    return pct_of_counts(counts_by(df, group, by, count_col), group, count_col, digits, out)


def value_ranks(counts: DataFrame, key: str, count_col: str, out: str = "rank", n: int | None = None) -> DataFrame:
    """``key, <count>, rank``: ``RANK() OVER (ORDER BY count DESC)`` for every
    distinct key (NULL included as its own key), or only those ranked ``<= n``.

    A rank is 1 + the number of keys with a strictly larger count, so it only
    depends on the *distinct count values*.  Those are ranked in one small
    window: k distinct values need at least k(k+1)/2 rows, so there are fewer
    than sqrt(2 * rows) of them (1.5 million for 10^12 rows), and at most ``n``
    with a rank of ``n`` or less.  That bound allows to broadcast them, so the
    keys are not shuffled by count, where ``count = 1`` would be a hot key."""
    totals = counts.groupBy(key).agg(F.sum(count_col).alias(count_col))
    levels = totals.groupBy(count_col).agg(F.count(F.lit(1)).alias("_keys"))
    w = Window.orderBy(F.desc(count_col)).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn(out, (F.coalesce(F.sum("_keys").over(w), F.lit(0)) + 1).cast("bigint"))
    if n is not None:
        levels = levels.where(F.col(out) <= n)
    return totals.join(F.broadcast(levels.select(count_col, out)), on=count_col, how="inner").select(key, count_col, out)


def top_n_with_other(counts: DataFrame, group: str, key: str, count_col: str, n: int,
                     other: str, out: str) -> DataFrame:
    """Regroup per-``(group, key)`` counts so that keys ranked ``<= n`` over all
    groups keep their value and everything else (including NULL, which takes
    a rank slot but never matches in the equi-join) becomes ``other``.
    ``RANK`` semantics: ties at the cut name more than ``n`` keys."""
    named = value_ranks(counts, key, count_col, "_rank", n).select(F.col(key).alias("_named"))
    # Plain equi-join with the named keys alone: a NULL key matches none.
    regrouped = (counts.join(named, F.col(key) == F.col("_named"), "left")
                 .withColumn(out, F.coalesce("_named", F.lit(other))))
    return regrouped.groupBy(group, out).agg(F.sum(count_col).cast("bigint").alias(count_col))
