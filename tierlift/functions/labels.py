"""Column expressions for labels, classes and parsed codes (all JVM-side).

CASE ladders are generated as SQL expression text and parsed once by Catalyst
(``F.expr``): the same expression tree as chained ``F.when`` calls, built with
one driver-to-JVM call instead of dozens.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (CONTROL, NO_COUPON, OTHER_COUPON, RATE_DIGITS, TREATMENT, ExperimentConfig, exact)

#: Type of discount rates.
RATE = f"decimal({RATE_DIGITS + 2},{RATE_DIGITS})"


def q(name: str) -> str:
    """Quote a column name for SQL expression text."""
    return "`" + name.replace("`", "``") + "`"


def lit(v) -> str:
    """SQL literal text for a Python value."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def ladder_sql(n: str, cfg: ExperimentConfig, attr: str) -> str:
    """``CASE WHEN n in rung 1 THEN <attr of rung 1> ... END`` (NULL below)."""
    whens = []
    for t in cfg.tiers:
        cond = f"{n} >= {t.min_orders}" + ("" if t.max_orders is None else f" AND {n} <= {t.max_orders}")
        whens.append(f"WHEN {cond} THEN {lit(getattr(t, attr))}")
    return "CASE " + " ".join(whens) + " END"


def case_sql(col: str, mapping: dict, default: str = "NULL") -> str:
    """Simple CASE text: value -> literal (``default`` is SQL text)."""
    whens = " ".join(f"WHEN {col} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


def group_type(is_member: str = "is_member") -> Column:
    """'Treatment' for ``IS TRUE``, 'Control' otherwise (three-valued)."""
    return F.expr(f"CASE WHEN {q(is_member)} IS TRUE THEN {lit(TREATMENT)} ELSE {lit(CONTROL)} END")


def is_treatment(is_member: str = "is_member") -> Column:
    return F.expr(f"{q(is_member)} IS TRUE")


def is_control(is_member: str = "is_member") -> Column:
    return F.expr(f"{q(is_member)} IS FALSE")


def tier_case(col: str, mapping: dict, default=None) -> Column:
    """Simple CASE: value -> literal, unlisted -> ``default`` (NULL)."""
    return F.expr(case_sql(q(col), mapping, lit(default)))


def tier_sort_order(tier: str, cfg: ExperimentConfig) -> Column:
    return tier_case(tier, {t.name: t.sort_order for t in cfg.tiers})


def discount_rate_sql(tier: str, cfg: ExperimentConfig, overrides: dict | None = None) -> str:
    rates = {t.name: t.discount_rate for t in cfg.tiers}
    rates.update(overrides or {})
    whens = " ".join(f"WHEN {q(tier)} = {lit(k)} THEN {exact(v, RATE_DIGITS)}BD" for k, v in rates.items())
    return f"CAST(CASE {whens} ELSE 0BD END AS {RATE})"


def discount_rate(tier: str, cfg: ExperimentConfig, overrides: dict | None = None) -> Column:
    """Rate per display tier, exactly as configured; 0 for unlisted tiers."""
    return F.expr(discount_rate_sql(tier, cfg, overrides))


def coupon_class(coupon: str, cfg: ExperimentConfig) -> Column:
    """Referral prefix (case sensitive) / other non-empty code / none."""
    c = q(coupon)
    return F.expr(f"CASE WHEN startswith({c}, {lit(cfg.coupon_prefix)}) THEN {lit(cfg.referral_label)} "
                  f"WHEN {c} IS NOT NULL AND {c} != '' THEN {lit(OTHER_COUPON)} ELSE {lit(NO_COUPON)} END")


# Coupon classes as small codes: shuffled instead of the label strings.
COUPON_NONE, COUPON_OTHER, COUPON_REFERRAL = 0, 1, 2


def coupon_class_code(coupon: str, cfg: ExperimentConfig) -> Column:
    """TINYINT class code (2 referral, 1 other code, 0 none)."""
    c = q(coupon)
    return F.expr(f"CAST(CASE WHEN startswith({c}, {lit(cfg.coupon_prefix)}) THEN {COUPON_REFERRAL} "
                  f"WHEN {c} IS NOT NULL AND {c} != '' THEN {COUPON_OTHER} ELSE {COUPON_NONE} END AS TINYINT)")


def coupon_class_label(code: str, cfg: ExperimentConfig) -> Column:
    return F.expr(f"CASE {q(code)} WHEN {COUPON_REFERRAL} THEN {lit(cfg.referral_label)} "
                  f"WHEN {COUPON_OTHER} THEN {lit(OTHER_COUPON)} ELSE {lit(NO_COUPON)} END")


def referrer_id(coupon: str, cfg: ExperimentConfig, text_ids: bool = False) -> Column:
    """Referrer id parsed from ``<prefix><digits>`` (text ids: ``<prefix><id>``);
    NULL when malformed."""
    prefix = "^" + re.escape(cfg.coupon_prefix)
    if text_ids:
        return F.nullif(F.regexp_extract(F.col(coupon), prefix + r"([\s\S]+)$", 1), F.lit(""))
    # No digits, or more than a BIGINT holds: NULL.
    return F.regexp_extract(F.col(coupon), prefix + r"([0-9]+)$", 1).try_cast("bigint")
