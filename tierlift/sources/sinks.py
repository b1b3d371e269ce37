"""Report sinks: one CSV with header per analysis; large frames stay Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_report_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a report, an aggregate of few rows, as one headed CSV file
    (``part-*.csv`` in ``path``); larger frames go through ``write_parquet``."""
    (df.coalesce(1).write.mode(mode).option("header", True).csv(path))


def write_named_csv(df: DataFrame, path: str) -> None:
    """Write a report as one headed CSV file called ``path``, on whatever file
    system the path names; a file that is there is replaced once the new one is
    complete."""
    spark = df.sparkSession
    parts = f"{path}.{uuid.uuid4().hex}"
    write_report_csv(df, parts, "errorifexists")
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, target = hadoop.Path(parts), hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{part} could not be renamed to {path}")
    fs.delete(folder, True)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_transactions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store transactions partitioned by ``txn_date``.

    The closed date windows of every analysis are then resolved by partition
    pruning (``PartitionFilters``) before any file is opened, on top of the
    Parquet row-group skipping.  Rows are dealt to tasks by ranges of date and
    user: a task writes few dates, and a day with very many rows is written by
    many tasks."""
    (df.repartitionByRange("txn_date", "user_id").write.mode(mode).partitionBy("txn_date").parquet(path))
