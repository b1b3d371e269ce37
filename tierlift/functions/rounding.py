"""Exact decimal rounding shared by every report column.

Rounding a DOUBLE is engine dependent (``round(1.005, 2)``), so every rounded
output follows one recipe: bring the value to DECIMAL(38,6), round half away
from zero to ``digits``, and only then convert to DOUBLE for the output edge.
Money stays DECIMAL(18,2) upstream, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORK_DECIMAL = "decimal(38,6)"


def exact_round(c: Column, digits: int) -> Column:
    """``ROUND(CAST(c AS DECIMAL(38,6)), digits)`` as DOUBLE."""
    return F.round(c.cast(WORK_DECIMAL), digits).cast("double")


def round_decimal(c: Column, digits: int) -> Column:
    """Same rounding, but keep the exact decimal (for further arithmetic)."""
    return F.round(c.cast(WORK_DECIMAL), digits)


def pct(part: Column, whole: Column, digits: int) -> Column:
    """``round(100 * part / whole, digits)``; NULL when ``whole`` is 0."""
    return exact_round(F.try_divide(part.cast("decimal(38,0)") * F.lit(100), whole.cast("decimal(38,0)")),
                       digits)
