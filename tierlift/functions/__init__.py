"""Column-level helpers (built-in Spark expressions only, no UDFs)."""

from . import labels, rounding
from .rounding import exact_round, pct, round_decimal

__all__ = ["labels", "rounding", "exact_round", "pct", "ratio", "round_decimal"]
