"""Config relations: the tier ladder as a typed, broadcastable DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_CONFIG, ExperimentConfig

TIER_SCHEMA = T.StructType([
    T.StructField("tier", T.StringType(), False),
    T.StructField("control_label", T.StringType(), False),
    T.StructField("min_orders", T.LongType(), False),
    T.StructField("max_orders", T.LongType(), True),
    T.StructField("discount_rate", T.DoubleType(), False),
    T.StructField("sort_order", T.LongType(), False),
])


def tier_dimension(spark: SparkSession, cfg: ExperimentConfig = DEFAULT_CONFIG) -> DataFrame:
    """One row per tier; size fixed by configuration (<= 64 rows), so every
    join against it is an explicit broadcast."""
    rows = [(t.name, t.control_label, t.min_orders, t.max_orders, float(t.discount_rate), t.sort_order)
            for t in cfg.tiers]
    return F.broadcast(spark.createDataFrame(rows, TIER_SCHEMA))
