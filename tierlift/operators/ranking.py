"""Exact ``ROW_NUMBER`` and "k smallest per group" without hot window partitions.

``row_number() over (partition by g order by id)`` puts every row of a group in
one task.  With a handful of groups (tiers x sides) and one group holding a
third of all users, that is a single-task sort of a third of the table.  Both
operators below give the same answer while sorting only small slices.

``k_smallest_per_group`` (the balancing cut) is a distributed selection of each
group's k-th smallest id:

1. ids are bucketed by their high bits, ``id >> shift``: monotone over the whole
   BIGINT range, with no overflow;
2. a histogram ``count(*)`` per (group, bucket) is an ordinary partial/final
   aggregate, from which the driver reads the bucket holding the k-th id;
3. that bucket alone stays in play, ``2 ** bits`` times finer, until it is one id
   or holds at most ``IN_PLAY`` rows, whose ids are then read: the threshold
   ``t``, together with the number of rows below it;
4. rows with ``id < t`` are kept by a filter whose thresholds are constants of
   the plan.  Of the rows with ``id = t`` (one, where ids are a key) as many are
   kept as are still needed.

Quantile sketches, where the caller has them, bracket the k-th id before the
first level, so that one histogram inside the bracket and the ids of one bucket
are enough whatever the layout of the ids; the histogram also counts what lies
below, so a bracket that missed the id is noticed and the search starts anew.

Text ids are selected seven bytes at a time (:func:`text_chunk`): each chunk is
a BIGINT in the order of the text, found as above among the rows that share the
chunks before it.

``bucketed_row_number`` must rank *every* row, so it uses equi-depth ranges.
Their bounds are approximate quantiles of each group, read once and then
constants of the plan: every reading of the rows assigns the same ranges, and
nothing is written.  The rows of each (group, range) are counted exactly, so a
window partitioned by (group, range) plus a broadcast of per-range offsets
(``<= P + groups`` rows) gives the global rank.  Text ids have no quantile
aggregate: their ranges come from ``repartitionByRange``, whose sampled bounds
change when it runs again, so those rows are written with their range.

Callers bound ``groups`` by the configured tier ladder.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import q
from ..session import materialize

#: Rows of a bucket whose ids the driver reads instead of refining it further.
IN_PLAY = 10_000
#: Bytes of a text in one chunk.
CHUNK = 7
#: Most ranges by default: a billion rows are then 250 thousand a range.
MAX_RANGES = 4_096

_B, _CNT, _OFF = "_rk_bucket", "_rk_cnt", "_rk_off"


def _is(groups: list[str], values: tuple) -> Column:
    cond = F.lit(True)
    for col, val in zip(groups, values):
        cond = cond & F.col(col).eqNullSafe(F.lit(val))
    return cond


def text_chunk(col: str, level: int) -> Column:
    """Bytes ``[7 * level, 7 * level + 7)`` of a text as a BIGINT that orders
    texts with equal earlier chunks: the bytes, highest first, then how many
    there are (an ended text comes before its continuations)."""
    part = f"substring(CAST({q(col)} AS BINARY), {CHUNK * level + 1}, {CHUNK})"
    return F.expr(f"CAST(conv(rpad(hex({part}), {2 * CHUNK}, '0'), 16, 10) AS BIGINT) * 8 + octet_length({part})")


def _pick(counts: list[tuple], need: int, key=None) -> tuple | None:
    """``(value, rows before it, its rows)`` where the ``need``-th row is; ``None``
    if there are fewer."""
    seen = 0
    for value, n in sorted(counts, key=lambda c: key(c[0]) if key else c[0]):
        if seen + n >= need:
            return value, seen, n
        seen += n
    return None


def _read_ids(df: DataFrame, groups: list[str], col: str, plays: dict[tuple, Column], key_of) -> dict[tuple, list[tuple]]:
    """Counts of the ids of each group that are in play."""
    if not plays:
        return {}
    cond = F.lit(False)
    for g, mine in plays.items():
        cond = cond | (_is(groups, g) & mine)
    out: dict = {g: [] for g in plays}
    for r in df.where(cond).groupBy(*groups, col).agg(F.count(F.lit(1)).alias(_CNT)).collect():
        out[key_of(r)].append((r[col], r[_CNT]))
    return out


def kth_smallest_per_group(df: DataFrame, groups: list[str], order_col: str, k: dict,
                           buckets: int = 1024, ranges: dict | None = None, brackets: dict | None = None,
                           sizes: dict | None = None) -> dict:
    """Per group ``(value, below, equal)``: the ``k[group]``-th smallest value of
    ``order_col`` (integral or text), the number of rows below it and equal to it.

    Keys of ``k``, ``ranges`` and ``brackets`` are tuples of group values;
    ``ranges`` maps a group to known ``(lo, hi)`` (else one min/max aggregate),
    ``brackets`` to a ``(lo, hi)`` that probably holds the value, ``sizes`` to
    its number of rows (as in every bucket, ids of at most ``IN_PLAY`` rows are
    read without refining).  Groups with
    ``k`` above their size map to ``None`` (keep all); groups with ``k <= 0``
    or without rows are absent (keep none).  Every level is one aggregate; at
    most ``groups x (buckets + 2)`` counts, or ``groups x IN_PLAY`` ids, reach
    the driver."""
    if not groups:
        raise ValueError("at least one grouping column is required")
    key_of = lambda r: tuple(r[g] for g in groups)
    if isinstance(df.schema[order_col].dataType, T.StringType):
        return _kth_text(df, groups, order_col, k, buckets, key_of, sizes)
    result = _of_small_groups(df, groups, order_col, k, key_of, sizes)
    k = {g: need for g, need in k.items() if g not in result}
    if not k:
        return {g: v for g, v in result.items() if v != ()}
    known = dict(brackets or {})
    if ranges is None and any(g not in known for g in k):
        ranges = {key_of(r): (r["lo"], r["hi"]) for r in
                  df.groupBy(*groups).agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).collect()}
    bits = max(1, buckets.bit_length() - 1)
    level = lambda lo, hi: max(0, (int(hi) - int(lo)).bit_length() - bits)
    # group -> (shift, still needed, rows below, lowest and highest id in play, bracket of the first level)
    state: dict = {}
    for g, need in k.items():
        lo, hi = known.get(g) or (ranges or {}).get(g) or (None, None)
        if need is not None and need > 0 and lo is not None:
            state[g] = (level(lo, hi), int(need), 0, int(lo), int(hi), g in known)
    while state:
        shift, cond, low = F.lit(None).cast("int"), F.lit(False), F.lit(None).cast("bigint")
        for g, (s, _, _, lo, hi, bracket) in state.items():
            mine = _is(groups, g)
            shift = F.when(mine, F.lit(s)).otherwise(shift)
            low = F.when(mine, F.lit(lo)).otherwise(low)
            # Rows below a bracket are counted as well, in a bucket of their own.
            cond = cond | (mine & (F.col(order_col) <= hi) & (F.lit(True) if bracket else F.col(order_col) >= lo))
        bucket = F.when(F.col(order_col) >= low, F.call_function("shiftright", F.col(order_col), shift))
        hist = df.where(cond).select(*groups, bucket.alias(_B)).groupBy(*groups, _B).agg(F.count(F.lit(1)).alias(_CNT)).collect()
        per_group: dict = {}
        for r in hist:
            per_group.setdefault(key_of(r), []).append((r[_B], r[_CNT]))
        following, plays, anew = {}, {}, {}
        for g, (s, need, below, lo, hi, bracket) in state.items():
            counts = per_group.get(g, [])
            under = sum(n for b, n in counts if b is None)
            got = _pick([c for c in counts if c[0] is not None], need - under) if need > under else None
            if got is None:
                if bracket:  # the id lies outside
                    anew[g] = need
                else:  # fewer rows than asked: keep the whole group
                    result[g] = None
                continue
            b, seen, n = got
            seen += under
            if s == 0:
                result[g] = (b, below + seen, n)
                continue
            first, last = max(lo, b << s), min(hi, ((b + 1) << s) - 1)
            following[g] = (level(first, last), need - seen, below + seen, first, last, False)
            if n <= IN_PLAY:
                plays[g] = F.col(order_col).between(F.lit(first), F.lit(last))
        if plays:
            for g, ids in _read_ids(df, groups, order_col, plays, key_of).items():
                _, need, below, *_ = following.pop(g)
                value, seen, n = _pick(ids, need)
                result[g] = (value, below + seen, n)
        if anew:
            result.update(kth_smallest_per_group(df, groups, order_col, anew, buckets))
        state = following
    return {g: v for g, v in result.items() if v != ()}


def _of_small_groups(df: DataFrame, groups: list[str], col: str, k: dict, key_of, sizes: dict | None) -> dict:
    """The groups that are known to have at most ``IN_PLAY`` rows, by their ids;
    ``()`` for those that keep none."""
    small = [g for g in k if (sizes or {}).get(g, IN_PLAY + 1) <= IN_PLAY]
    if not small:
        return {}
    found = _read_ids(df, groups, col, {g: F.col(col).isNotNull() for g in small if k[g] is not None and k[g] > 0}, key_of)
    order = (lambda t: t.encode()) if isinstance(df.schema[col].dataType, T.StringType) else None
    return {g: _pick(found[g], k[g], order) if found.get(g) else () for g in small}


def _kth_text(df: DataFrame, groups: list[str], col: str, k: dict, buckets: int, key_of, sizes: dict | None) -> dict:
    """:func:`kth_smallest_per_group` for a text column, chunk by chunk."""
    result = _of_small_groups(df, groups, col, k, key_of, sizes)
    k = {g: need for g, need in k.items() if g not in result}
    state = {g: (int(need), 0, F.col(col).isNotNull()) for g, need in k.items() if need is not None and need > 0}
    depth = 0
    while state:
        cond = F.lit(False)
        for g, (_, _, mine) in state.items():
            cond = cond | (_is(groups, g) & mine)
        chunk = text_chunk(col, depth)
        part = df.where(cond).select(*groups, chunk.alias("_rk_chunk"))
        found = kth_smallest_per_group(part, groups, "_rk_chunk", {g: need for g, (need, _, _) in state.items()}, buckets)
        following, plays = {}, {}
        for g, (need, below, mine) in state.items():
            if g not in found:
                continue  # no rows
            if found[g] is None:
                result[g] = None
                continue
            value, seen, n = found[g]
            step = (need - seen, below + seen, mine & (chunk == F.lit(value)))
            following[g] = step
            # an ended text is one id, whatever its rows
            if n <= IN_PLAY or value % 8 < CHUNK:
                plays[g] = step[2]
        if plays:
            for g, ids in _read_ids(df, groups, col, plays, key_of).items():
                need, below, _ = following.pop(g)
                value, seen, n = _pick(ids, need, lambda t: t.encode())
                result[g] = (value, below + seen, n)
        state, depth = following, depth + 1
    return {g: v for g, v in result.items() if v != ()}


def k_smallest_per_group(df: DataFrame, groups: list[str], order_col: str, limits: DataFrame | dict, limit_col: str = "",
                         buckets: int = 1024, ranges: dict | None = None, brackets: dict | None = None,
                         sizes: dict | None = None) -> DataFrame:
    """Rows of ``df`` whose ``row_number()`` by ``order_col`` inside their group
    is at most the limit of that group (groups without one are dropped); exactly
    that many rows, also where ids repeat.

    The result is a narrow filter: the thresholds, at most one per group, are
    constants of the plan.  No row is sorted or shuffled; only if a threshold
    id has more rows than are needed are the rows of that one id numbered.
    ``limits`` is a dict from tuples of group values, or a small relation with
    ``limit_col`` that is collected; ``ranges``, ``brackets`` and ``sizes`` as in
    :func:`kth_smallest_per_group`."""
    k = limits if isinstance(limits, dict) else {tuple(r[g] for g in groups): r[limit_col] for r in limits.collect()}
    cut = kth_smallest_per_group(df, groups, order_col, k, buckets, ranges, brackets, sizes)
    under, tied = F.lit(False), []
    for g, found in cut.items():
        mine = _is(groups, g)
        if found is None:  # the whole group
            under = under | mine
            continue
        value, below, equal = found
        if k[g] - below >= equal:
            under = under | (mine & (F.col(order_col) <= F.lit(value)))
        else:
            under = under | (mine & (F.col(order_col) < F.lit(value)))
            tied.append((mine & (F.col(order_col) == F.lit(value)), k[g] - below))
    kept = df.where(under)
    if tied:
        need = F.lit(0)
        for mine, n in tied:
            need = F.when(mine, F.lit(n)).otherwise(need)
        w = Window.partitionBy(*groups).orderBy(order_col)
        first = (df.withColumn("_rk_need", need).where(F.col("_rk_need") > 0).withColumn("_rk_rn", F.row_number().over(w))
                   .where(F.col("_rk_rn") <= F.col("_rk_need")).drop("_rk_rn", "_rk_need"))
        kept = kept.unionByName(first)
    return kept


def _with_ranges(df: DataFrame, groups: list[str], order_col: str, buckets: int) -> DataFrame:
    """``df`` with the range of each row inside its group, at bounds that are
    constants of the plan; rows without an id come first.  Ids are compared as
    DOUBLE, which keeps their order and sends equal ids to one range."""
    at = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    found = [] if buckets < 2 else df.groupBy(*groups).agg(
        F.count(order_col).alias(_CNT),
        F.expr(f"percentile_approx({q(order_col)}, array({at}), {max(10_000, 4 * buckets)})").alias(_B)).collect()
    total = sum(r[_CNT] for r in found)
    ids, splits = [], []
    for r in found:
        own = max(1, round(buckets * r[_CNT] / total)) if total else 1
        # every (buckets / own)-th quantile: the ranges of all groups hold about as many rows
        bounds = sorted({float(r[_B][buckets * i // own - 1]) for i in range(1, own)})
        if bounds:
            ids.append(F.when(_is(groups, tuple(r[g] for g in groups)), F.col(order_col).cast("double")))
            splits.append([float("-inf"), *bounds, float("inf")])
    if not splits:
        return df.withColumn(_B, F.lit(0))
    given, made = [[f"_rk_{kind}{i}" for i in range(len(splits))] for kind in ("id", "range")]
    cut = Bucketizer(inputCols=given, outputCols=made, splitsArray=splits).setHandleInvalid("keep")
    rank = F.when(F.col(order_col).isNull(), F.lit(-1)).otherwise(F.coalesce(*made, F.lit(0)))
    return cut.transform(df.withColumns(dict(zip(given, ids)))).withColumn(_B, rank.cast("int")).drop(*given, *made)


def bucketed_row_number(df: DataFrame, groups: list[str], order_col: str,
                        buckets: int | None = None, out: str = "rn") -> DataFrame:
    """``df`` plus ``out`` = ``row_number() over (partition by groups order by
    order_col)`` (BIGINT), computed as range offset + rank inside the range.

    Ranges are equi-depth (about ``P = buckets`` in all; by default as many as
    ``spark.sql.shuffle.partitions``, at most ``MAX_RANGES``), so no window task
    holds more than about ``rows / P`` rows.  ``df`` is read three times (bounds,
    counts, ranks): hand over a stored relation.  With repeated ids the tie
    order is as arbitrary as in the plain window."""
    if not groups:
        raise ValueError("at least one grouping column is required")
    p = buckets or min(MAX_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if isinstance(df.schema[order_col].dataType, T.NumericType):
        ranged = _with_ranges(df, groups, order_col, p)
    else:
        ranged = materialize(df.repartitionByRange(p, *groups, order_col).withColumn(_B, F.spark_partition_id()))
    w = Window.partitionBy(*groups).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    hist = (ranged.groupBy(*groups, _B).agg(F.count(F.lit(1)).alias(_CNT))
            .withColumn(_OFF, F.coalesce(F.sum(_CNT).over(w), F.lit(0))).drop(_CNT)
            .withColumnsRenamed({c: f"_rk_{c}" for c in [*groups, _B]}))
    cond = F.col(_B) == F.col(f"_rk_{_B}")
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_rk_{g}"))
    inner = Window.partitionBy(*groups, _B).orderBy(order_col)
    # hist has <= P + groups rows: safe to broadcast.
    return (ranged.join(F.broadcast(hist), cond)
                  .withColumn(out, (F.col(_OFF) + F.row_number().over(inner)).cast("bigint"))
                  .select(*df.columns, out))
