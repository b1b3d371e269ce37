"""Session helpers: build a local session for tests/bench, respect cluster settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  ANSI mode stays on (Spark 4 default): the
# operators use typed columns and ``try_divide`` where a zero divisor can occur.
_SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # PySpark 4 records the Python call site of every Column function for
    # error messages (two JVM round trips each); plan construction is ~2x
    # faster without it.  Errors still carry the JVM-side context.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tierlift", extra: dict | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("TIERLIFT_DRIVER_MEMORY", "8g")))
    for k, v in {**_SESSION_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...);
    it is read from the session and used as is.  Only when nothing is
    configured (tests, local runs) a fresh scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master.split("[")[0] == "local":  # not local-cluster: its executors have folders of their own
            conf_dir = tempfile.mkdtemp(prefix="tierlift-ckpt-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_scopes: list[list[str]] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder.  It stays there, for
    frames that are read later, unless a :func:`scratch_scope` is open."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the scratch folders that are made inside.  Frames over
    them cannot be read afterwards: write results elsewhere before."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read
    back: lineage is cut (a lost executor reads the files again), later readers
    scan only the columns they need."""
    spark = df.sparkSession
    path = scratch_folder(spark, "frame")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def recommended_conf(transactions_bytes: int, total_cores: int,
                     target_partition_bytes: int = 192 << 20) -> dict[str, str]:
    """Cluster settings sized for the input (spill-aware starting point).

    The largest shuffle is the post/pre-window transaction rows reduced to a
    few columns, roughly 40 % of the compressed transaction bytes.  Each
    shuffle partition should hold about ``target_partition_bytes`` so a task
    fits executor memory without spilling; AQE then coalesces small ones and
    splits skewed ones.  Scan splits of 256 MB keep a 100 TB scan around
    400k tasks.
    """
    shuffle_bytes = int(transactions_bytes * 0.4)
    partitions = max(total_cores * 3, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
    }
