"""Line dedup over levelled sorted runs of line hashes.

The index of the lines seen so far is a list of *runs*: tables bucketed and
sorted by line hash, each hash with the first document that holds it.  A batch
of documents is deduplicated in one pass:

1. its distinct (document, line hash) rows are reduced to one row per hash
   (map-side combine: a line in a third of all documents is no hot key);
2. those rows are merge-anti-joined with every run, which is already hashed
   and sorted that way, so only the batch is shuffled;
3. hashes no run knows become a new run of level 0; when a level holds
   ``fanout`` runs they are compacted into one run of the next level, so a
   hash is rewritten once per level and a batch meets few runs (of four
   batches, with a fanout of 2, the third and fourth join a compacted run).

Batches are taken in order of document id, hence the first holder of a line is
the smallest id that has it.

Defined cases: a null or empty text is one empty line; rows without an id are
one document after all others; rows that repeat an id are one document, none
of them loses a line to the other; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, free_name, map_batches, scratch_path, signed, texts, written

KEY = ["h1", "h2"]
#: A line is very common if it is in more than one row of so many.
COMMON = 1_000


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def key_hash(key: bytes) -> tuple[int, int]:
    """128-bit hash of a line key as two BIGINTs."""
    value = xxhash.xxh3_128_intdigest(key)
    return signed(value >> 64), signed(value & ((1 << 64) - 1))


def _line_keys(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """``d, h1, h2``: the distinct keys of at least ``min_chars`` code points of each row."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, int, int]] = []
        for d, body in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            found = {line_key(line) for line in body.split(b"\n")}
            out += [(d, *key_hash(k)) for k in found
                    if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))],
                                          names=["d", *KEY])

    return map_batches(docs.select(doc_key(doc_id).alias("d"), F.col(text).cast("string").alias("t")), keys,
                       "d long, h1 long, h2 long")


class LineRuns:
    """The levelled runs.  ``add`` takes one batch of (d, h1, h2) rows, whose
    ids are not below those of earlier batches, and returns the rows whose
    line has an earlier holder."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark = spark
        self.fanout = fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.tables: list[str] = []

    def _run(self, rows: DataFrame) -> DataFrame:
        """``rows`` written as a table bucketed and sorted by line hash."""
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
             .option("path", scratch_path(self.spark, "line-run")).option("compression", "zstd")
             .saveAsTable(name))
        self.tables.append(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def forget(self) -> None:
        """Take the tables of all runs out of the session's catalog."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self.tables = [], []

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.unionByName(other)
            self.levels[level] = []
            self._push(level + 1, self._run(merged))

    def add(self, rows: DataFrame, last: bool = False) -> DataFrame:
        """The rows of the batch whose line has an earlier holder, written.  The
        ``last`` batch leaves no run: nothing will join it."""
        firsts = rows.groupBy(*KEY).agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n"))
        fresh = firsts
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), KEY, "left_anti")
        known = self.runs()
        run = self._run(fresh)
        # Hashes of this batch that some row must lose: first held by an
        # earlier batch, or by a smaller id of this one.
        again = run.where(F.col("first") < F.col("last")).select(*KEY, "first", "n")
        for old in known:
            again = again.unionByName(firsts.select(*KEY, "n").join(old.select(*KEY, "first"), KEY)
                                      .select(*KEY, "first", "n"))
        again = written(again, "line-again")
        if not last:
            self._push(0, run)
        # Lines in more than a thousandth of the rows: fewer than a thousand of
        # them, whatever the batch, so they are broadcast and no task gets all
        # rows of one.  The others meet their rows by hash.
        often = F.col("n") * COMMON > rows.count()
        heavy, light = F.broadcast(again.where(often)), again.where(~often)
        lost = rows.join(heavy, KEY).unionByName(
            rows.join(heavy.select(*KEY), KEY, "left_anti").join(light, KEY))
        return written(lost.where(F.col("d") > F.col("first")).select("d", *KEY), "line-lost")


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10,
                   batches: int = 4, fanout: int = 2) -> DataFrame:
    """``d, drop``: per document (:func:`doc_key`) the hashes of its lines that
    a smaller document holds too; documents that lose nothing are absent."""
    spark = docs.sparkSession
    keys = written(_line_keys(docs, text, doc_id, min_chars), "line-keys")
    # Bounds of about equally large id ranges; any bounds give the same result.
    cuts = sorted(set(keys.agg(F.percentile_approx("d", [i / batches for i in range(batches + 1)], 1_000)).first()[0] or [])
                  )[1:-1]
    runs, dropped = LineRuns(spark, fanout), None
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        part = keys
        if low is not None:
            part = part.where(F.col("d") > low)
        if high is not None:
            part = part.where(F.col("d") <= high)
        lost = runs.add(part, last=high is None)
        dropped = lost if dropped is None else dropped.unionByName(lost)
    runs.forget()
    return dropped.groupBy("d").agg(F.collect_set(F.struct(*KEY)).alias("drop"))


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10,
                        batches: int = 4, fanout: int = 2, out: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped"),
                        ) -> DataFrame:
    """All columns of ``docs`` and, named by ``out``, the text that is left
    (kept lines joined by ``\\n``), the number of lines and of dropped lines.
    A column of ``docs`` with a name of ``out`` is replaced."""
    lost = repeated_lines(docs, text, doc_id, min_chars, batches, fanout)
    cols = [c for c in docs.columns if c.lower() not in {o.lower() for o in out}]
    key, drop = free_name(cols, "d"), free_name(cols, "drop")
    both = docs.withColumn(key, doc_key(doc_id)).join(
        lost.select(F.col("d").alias(key), F.col("drop").alias(drop)), key, "left")
    schema = docs.select(*[F.col(f"`{c}`") for c in cols]).schema
    result = schema.add(out[0], "string").add(out[1], "long").add(out[2], "long")

    def rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, total, gone = [], [], []
        for body, hashes in zip(texts(batch.column(text)), batch.column(drop).to_pylist()):
            lines = body.split(b"\n")
            left = lines
            if hashes:
                bad = {(h["h1"], h["h2"]) for h in hashes}
                left = [x for x in lines if key_hash(line_key(x)) not in bad]
            kept.append(b"\n".join(left).decode("utf-8", "replace"))
            total.append(len(lines))
            gone.append(len(lines) - len(left))
        arrays = [batch.column(c) for c in cols]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.string()), pa.array(total, pa.int64()),
                                           pa.array(gone, pa.int64())], names=[*cols, *out])

    return map_batches(both.select(*[F.col(f"`{c}`") for c in cols], drop), rebuild, result)
