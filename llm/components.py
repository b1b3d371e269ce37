"""Connected components of an edge table by alternating star steps.

Edges never reach the driver; each round is written to the shared folder, so a
lost executor costs one round.  A node with very many neighbours is reduced by
map-side minima, and its edges are joined back in a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the smallest of all its neighbours
    and itself, which is found among the smaller ones.  ``edges`` have ``v < u``
    here and below; there are no more of them afterwards, some repeated."""
    low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them: the
    edge to that one stays, of others the smaller end is linked."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    return edges.join(low, "u").select(F.when(v == m, u).otherwise(v).alias("u"), m.alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: every node that is not the smallest of its component."""
    u, v = F.col(a), F.col(b)
    now, mark = _round(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    seen = None
    while mark != seen and mark[0]:
        seen = mark
        now, mark = _round(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` written, and their number and sum of hashes, taken by the same job."""
    mark = Observation()
    now = written(edges.observe(mark, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return now, (mark.get["n"], mark.get["sum"])
