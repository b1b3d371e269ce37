"""Helpers the operators share: written intermediates, word rules, hashing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tierlift.session import ensure_checkpoint_dir

#: Rows without an id count as one document that comes after all others.
NO_ID = (1 << 63) - 1
#: ``[\x20\x09-\x0D]``, the white space of every rule here; ``bytes.split()``
#: and ``bytes.strip()`` without arguments use exactly these six.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, when
    it is not installed for them (:envvar:`PYTHONPATH` of their processes)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


#: Rows a worker turns into Python objects at a time.
SLICE = 512


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, any
    executor can read it, and later readers prune its columns."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def doc_key(column: str = "doc_id") -> Column:
    """``doc_id`` as BIGINT with :data:`NO_ID` for null."""
    return F.coalesce(F.col(column).cast(LongType()), F.lit(NO_ID))


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it
    (Spark compares names without case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``df.mapInArrow`` with one output batch (or none) per slice of the input:
    what a worker holds at a time is bounded by ``SLICE`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                out = fn(batch.slice(start, SLICE))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def signed(value: int) -> int:
    """An unsigned 64-bit number as the BIGINT with the same bits."""
    return value - (1 << 64) if value >= 1 << 63 else value


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to ``limit`` distinct words
    (the memory is bounded; a forgotten word is hashed again)."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
