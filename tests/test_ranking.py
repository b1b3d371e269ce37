"""Bucketed ranking equals the plain window, whatever the id layout."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tierlift.operators.ranking import bucketed_row_number, k_smallest_per_group

SCHEMA = "g string, s boolean, id bigint"

ids = st.lists(st.integers(min_value=-10**12, max_value=10**12), min_size=1, max_size=60, unique=True)


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _layout(values, flags):
    rows = []
    for i, v in enumerate(values):
        rows.append(("abc"[i % 3], flags[i % len(flags)], v))
    return rows


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=ids, flags=st.lists(st.booleans(), min_size=1, max_size=4), buckets=st.integers(2, 9))
def test_bucketed_row_number_equals_window(spark, values, flags, buckets):
    df = _frame(spark, _layout(values, flags))
    w = Window.partitionBy("g", "s").orderBy("id")
    want = {(r.g, r.s, r.id, r.rn) for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    got = {(r.g, r.s, r.id, r.rn) for r in bucketed_row_number(df, ["g", "s"], "id", buckets).collect()}
    assert got == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=ids, flags=st.lists(st.booleans(), min_size=1, max_size=4), buckets=st.integers(2, 9),
       ks=st.lists(st.integers(0, 25), min_size=6, max_size=6))
def test_k_smallest_equals_window_cut(spark, values, flags, buckets, ks):
    df = _frame(spark, _layout(values, flags))
    keys = [(g, s) for g in "abc" for s in (True, False)]
    limits = spark.createDataFrame([(g, s, k) for (g, s), k in zip(keys, ks)], "g string, s boolean, k bigint")
    w = Window.partitionBy("g", "s").orderBy("id")
    want = {(r.g, r.s, r.id) for r in df.withColumn("rn", F.row_number().over(w))
            .join(limits, ["g", "s"]).where("rn <= k").collect()}
    got = {(r.g, r.s, r.id) for r in k_smallest_per_group(df, ["g", "s"], "id", limits, "k", buckets).collect()}
    assert got == want


def test_dense_and_sparse_ids_one_group(spark):
    # A third of the rows packed in a narrow id range, the rest spread wide.
    vals = list(range(1000, 1400)) + [10**9 + 7919 * i for i in range(800)]
    df = spark.createDataFrame([("x", True, v) for v in vals], SCHEMA)
    limits = spark.createDataFrame([("x", True, 650)], "g string, s boolean, k bigint")
    got = sorted(r.id for r in k_smallest_per_group(df, ["g", "s"], "id", limits, "k", 16).collect())
    assert got == sorted(vals)[:650]


def test_extreme_id_range_no_overflow(spark):
    big = 2**63 - 1
    vals = [-big, -big + 5, -3, 0, 7, 10**18, big - 1, big]
    df = spark.createDataFrame([("x", True, v) for v in vals], SCHEMA)
    got = sorted((r.id, r.rn) for r in bucketed_row_number(df, ["g", "s"], "id", 4).collect())
    assert got == [(v, i + 1) for i, v in enumerate(sorted(vals))]
    limits = spark.createDataFrame([("x", True, 5)], "g string, s boolean, k bigint")
    kept = sorted(r.id for r in k_smallest_per_group(df, ["g", "s"], "id", limits, "k", 4).collect())
    assert kept == sorted(vals)[:5]


def test_dense_cluster_is_split_by_levels(spark):
    # A third of the rows in one dense id block, the rest spread over a huge
    # span: level 1 puts the block in one bucket, deeper levels split it.
    from tierlift.operators.ranking import kth_smallest_per_group
    vals = list(range(5_000, 5_300)) + [10**15 + 10**12 * i for i in range(600)]
    df = spark.createDataFrame([("x", True, v) for v in vals], SCHEMA)
    assert kth_smallest_per_group(df, ["g", "s"], "id", {("x", True): 150}, 8) == {
        ("x", True): (sorted(vals)[149], 149, 1)}
    limits = spark.createDataFrame([("x", True, 150)], "g string, s boolean, k bigint")
    got = sorted(r.id for r in k_smallest_per_group(df, ["g", "s"], "id", limits, "k", 8).collect())
    assert got == sorted(vals)[:150]


def test_row_number_equi_depth_with_clustered_ids(spark):
    vals = list(range(5_000, 5_300)) + [10**15 + 10**12 * i for i in range(600)]
    df = spark.createDataFrame([("x", i % 2 == 0, v) for i, v in enumerate(vals)], SCHEMA)
    got = {(r.s, r.id, r.rn) for r in bucketed_row_number(df, ["g", "s"], "id", 16).collect()}
    want = set()
    for flag in (True, False):
        ids_ = sorted(v for i, v in enumerate(vals) if (i % 2 == 0) == flag)
        want |= {(flag, v, k + 1) for k, v in enumerate(ids_)}
    assert got == want


repeated = st.lists(st.integers(min_value=-4, max_value=6), min_size=1, max_size=80)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=repeated, flags=st.lists(st.sampled_from([True, False, None]), min_size=1, max_size=4),
       buckets=st.integers(2, 9), k=st.integers(0, 40))
def test_repeated_ids_give_exactly_k_rows(spark, values, flags, buckets, k):
    df = _frame(spark, _layout(values, flags)).where("s IS NOT NULL")
    limits = df.select("g", "s").distinct().selectExpr("g", "s", f"CAST({k} AS BIGINT) AS k")
    w = Window.partitionBy("g", "s").orderBy("id")
    want = sorted((r.g, r.s, r.id) for r in df.withColumn("rn", F.row_number().over(w)).where(f"rn <= {k}").collect())
    got = sorted((r.g, r.s, r.id) for r in k_smallest_per_group(df, ["g", "s"], "id", limits, "k", buckets).collect())
    assert got == want


def test_null_groups_are_groups(spark):
    rows = [(None, None, v) for v in range(50)] + [("a", None, v) for v in range(30)] + [(None, True, 5)]
    df = _frame(spark, rows)
    got = {(r.g, r.s, r.id): r.rn for r in bucketed_row_number(df, ["g", "s"], "id", 6).collect()}
    assert got == {(g, s, v): (1 if s else v + 1) for g, s, v in rows}
    limits = spark.createDataFrame([(None, None, 3), ("a", None, 2)], "g string, s boolean, k bigint")
    kept = sorted((r.g or "", r.id) for r in k_smallest_per_group(df, ["g", "s"], "id", limits, "k", 4).collect())
    assert kept == [("", 0), ("", 1), ("", 2), ("a", 0), ("a", 1)]


def test_row_number_of_a_million_rows_with_payload(spark):
    """Range bounds are sampled: the ranges must be assigned once, with an extra
    column kept and without the exchange being reused."""
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = (spark.range(0, 1_000_000, 1, 8).selectExpr(
            "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 < 3 THEN 'a' ELSE 'b' END AS g", "id % 2 = 0 AS s",
            "(id * 7919) % 1000003 AS id", "concat('payload ', id) AS payload"))
        w = Window.partitionBy("g", "s").orderBy("id")
        want = df.withColumn("rn", F.row_number().over(w).cast("bigint"))
        got = bucketed_row_number(df, ["g", "s"], "id", 16)
        assert got.columns == [*df.columns, "rn"] and got.count() == 1_000_000
        mark = lambda d: d.agg(F.sum(F.xxhash64("g", "s", "id", "payload", "rn").cast("decimal(38,0)"))).first()[0]
        assert mark(got) == mark(want)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_row_number_reads_its_rows_and_writes_nothing(spark, tmp_path):
    """Ranges are constants of the plan: one exchange of the rows, no table
    written, about equal ranges whatever the layout of the ids."""
    path = str(tmp_path / "users")
    (spark.range(0, 60_000, 1, 4).selectExpr("CASE WHEN id % 10 < 7 THEN 'a' ELSE 'b' END AS g", "true AS s",
                                             "CASE WHEN id < 30000 THEN id ELSE id * 1000003 END AS id").write.parquet(path))
    df = spark.read.parquet(path)
    got = bucketed_row_number(df, ["g", "s"], "id", 16)
    assert set(got.inputFiles()) == set(df.inputFiles())
    from tierlift.operators.ranking import _with_ranges
    sizes = [r["count"] for r in _with_ranges(df, ["g", "s"], "id", 16).groupBy("g", "s", "_rk_bucket").count().collect()]
    assert sum(sizes) == 60_000 and 15 <= len(sizes) <= 18 and max(sizes) < 2 * 60_000 / 16
    w = Window.partitionBy("g", "s").orderBy("id")
    assert got.exceptAll(df.withColumn("rn", F.row_number().over(w).cast("bigint"))).count() == 0


def test_row_number_of_rows_without_id_and_of_text_ids(spark):
    rows = [("x", True, v) for v in [None, 5, 2, 9, 2**62, 2**62 + 1]]
    got = {r.rn: r.id for r in bucketed_row_number(_frame(spark, rows), ["g", "s"], "id", 3).collect()}
    assert got == dict(enumerate([None, 2, 5, 9, 2**62, 2**62 + 1], 1))
    texts = _frame(spark, [("x", True, v) for v in range(90, 120)]).withColumn("id", F.concat(F.lit("C-"), F.col("id")))
    got = [r.id for r in bucketed_row_number(texts, ["g", "s"], "id", 3).orderBy("rn").collect()]
    assert got == sorted(f"C-{v}" for v in range(90, 120))
    assert bucketed_row_number(_frame(spark, []), ["g", "s"], "id", 3).count() == 0
