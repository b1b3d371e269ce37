"""Suffix-array dedup of byte strings by bucket-pointer refinement.

Every ``window``-byte string that starts at two places, in one document or in
two, is removed wherever it lies.  Anchors (see :mod:`llm.anchors`) route the
parts of documents that may hold equal strings to shards.  In a shard the
suffixes are bucketed by their first ``Q`` bytes; every position points to its
bucket.  Buckets with several suffixes are refined by sorting on the buckets
that the positions ``depth`` further on point to; since refined pointers are
written back, the next round compares twice the depth.  Singleton buckets are
final.  At ``window`` bytes, the suffixes left in one bucket start with equal
strings.

Equal segments are collapsed before, with their number: all windows of a
segment that occurs twice are repeated.  A segment that occurs once may still
repeat a window within itself, if its text is periodic.

Defined cases: a null or empty text has no bytes; every row is a document of
its own, also without an id or with a repeated one, so repeated rows remove
each other; an empty table gives an empty result.  Removal may cut inside a
character: the kept bytes are binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import NO_ID, map_batches

GRAM = 24
Q = 8
#: Bytes of the segments of one anchor that may meet in one shard.
GROUP_LIMIT = 3_000_000
#: Bytes whose suffixes are sorted together, unless one group has more.
PART = 250_000


def _groups(order_keys: np.ndarray) -> np.ndarray:
    """The number of the group of equal keys that each belongs to, in key order."""
    ranked = np.sort(order_keys)
    ranked = ranked[np.concatenate(([True], ranked[1:] != ranked[:-1]))] if len(ranked) else ranked
    out = np.empty(len(order_keys), dtype=np.int32)
    for low in range(0, len(out), PART):
        out[low:low + PART] = np.searchsorted(ranked, order_keys[low:low + PART])
    return out


def refine_buckets(data: np.ndarray, left: np.ndarray, window: int) -> np.ndarray:
    """Bucket pointers of depth ``window``: positions with equal pointers start
    with equal strings.  ``left`` is how many bytes of its own string a position
    has before it; positions with fewer than ``window`` get pointer -1."""
    n = len(data)
    depth = min(Q, window)
    # Initial buckets: the first bytes themselves, as a number.
    padded = np.concatenate((data, np.zeros(depth, np.uint8)))
    key = np.zeros(n, np.uint64)
    for i in range(depth):
        key <<= np.uint64(8)
        key |= padded[i:n + i]
    pointer = np.full(n, -1, dtype=np.int32)
    active = np.flatnonzero(left >= depth).astype(np.int32)
    key = key[active]
    group = _groups(key)
    del key, padded
    pointer[active] = group
    while depth < window:
        # Several suffixes share a bucket: sort them by the bucket of the rest.
        several = (np.bincount(group) > 1)[group]
        step = min(depth, window - depth)
        # A position too short for the new depth can never reach the window; its
        # pointer is read once more, by positions before it.
        enough = left[active] >= depth + step
        ended = active[~enough]
        active = active[several & enough]
        key = pointer[active].astype(np.uint64)
        key <<= np.uint64(32)
        key |= pointer[active + step].astype(np.uint32)
        group = _groups(key)
        del key
        pointer[ended] = -1
        # Numbers of buckets stay small enough: each round adds no more than the
        # suffixes that are left.
        pointer[active] = int(pointer.max(initial=0)) + 1 + group
        depth += step
    return pointer


def refinement_method(window: int) -> A.Method:
    """Groups of segments -> spans whose windows occur more than once."""

    def run(rows: list[tuple[int, int, int, int, int, bytes]]) -> list:
        return [found for part in _parts(rows) for found in one(part)]

    def one(rows: list[tuple[int, int, int, int, int, bytes]]) -> list:
        sizes = np.array([len(r[5]) for r in rows], dtype=np.int32)
        data = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint8)
        ends = np.cumsum(sizes, dtype=np.int32)
        left = np.repeat(ends, sizes)
        left -= np.arange(len(data), dtype=np.int32)
        pointer = refine_buckets(data, left, window)
        del left
        whole = np.flatnonzero(pointer >= 0).astype(np.int32)
        # Only whether a string is there once matters, so two copies stand for more.
        copies = np.repeat(np.array([min(r[2], 2) for r in rows], dtype=np.uint8), sizes)[whole]
        _, number = np.unique(pointer[whole], return_inverse=True)
        again = np.zeros(len(data), dtype=bool)
        again[whole] = (np.bincount(number, weights=copies) > 1)[number]
        return [(r[0], r[1], A.span_runs(np.where(again[start:end - window + 1], A.ANY, np.iinfo(np.int64).max), window))
                for r, start, end in zip(rows, ends - sizes, ends)]

    return run


def _parts(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Whole groups, of up to ``PART`` bytes together: equal strings pick equal
    anchors, so groups of different anchors share none."""
    part, size = [], 0
    for _, group in groupby(rows, key=lambda r: r[0]):
        group = list(group)
        more = sum(len(r[5]) for r in group)
        if part and size + more > PART:
            yield part
            part, size = [], 0
        part, size = part + group, size + more
    if part:
        yield part


def drop_repeated_strings(docs: DataFrame, window: int = 200, text: str = "text", doc_id: str = "doc_id",
                          gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) per row of ``docs``."""
    symbols = A.Symbols(words=False)
    gram = min(gram, window)
    shared, distinct = A.shared_segments(A.anchor_rows(docs, symbols, window, gram, text, doc_id), across=False)
    packed = A.packed(docs, text, doc_id)
    twice = distinct.where("rows > 1").select("h", "sh", F.array(F.struct(
        F.lit(0).alias("s"), F.col("ex.n").alias("e"), F.lit(A.ANY).alias("holder"))).alias("spans"))
    several = A.with_content(distinct.where("fewest = 1 AND (variants > 1 OR t = 1)"), packed, symbols)
    decided = twice.unionByName(A.compare(several, symbols, window, refinement_method(window), group_limit, across=False))
    gone = A.spans_by_document(shared, decided)

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(5)]
        for d, z, spans in zip(*(batch.column(c).to_pylist() for c in ("d", "z", "gone"))):
            body = A.unpack(z)
            out = A.covered(spans, len(body))
            runs = int(np.count_nonzero(np.diff(np.concatenate(([0], out.astype(np.int8)))) == 1))
            kept = np.frombuffer(body, dtype=np.uint8)[~out].tobytes() if runs else body
            for c, v in zip(cols, (None if d == NO_ID else d, len(body), int(out.sum()), runs, kept)):
                c.append(v)
        types = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_batches(packed.join(gone, ["d", "f"], "left").select("d", "z", "gone"), remove,
                       "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
