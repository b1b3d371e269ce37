"""Approximate nearest neighbours by inner product with an inverted multi-index.

Vectors are cut in two halves, each with a codebook of its own; a pair of
centroids is a cell.  A query visits cells by the sum of its two half
distances, smallest first (a heap over the sorted lists of both halves), until
the cells hold ``share`` of all vectors and ten times ``k``; the entries of those cells are
reranked by their exact inner product.

Codebooks and ``share`` are fitted on at most ``FIT_ROWS`` vectors (the
smallest hashes of the id): ``share`` is what ``TARGET_RECALL`` takes on that
sample, so it is small where vectors form clusters and large where they do not.
Every vector is indexed.

Cells are dealt to blocks of about ``BLOCK`` vectors: small cells share one,
large cells are split over several by a hash of the id.  The queries that visit
a block are counted and dealt to chunks of about ``CHUNK``; a (block, chunk)
pair is one group, so neither a crowded cell nor many queries end up in one
task.  A vector is sent once per chunk of its own block and not at all if no
query visits it: rows sent are at most the vectors plus a ``CHUNK``-th of the
inner products.  Only a query's best ``k`` of a block leave it.

Defined cases: rows without an id, and vectors that are null, empty, zero, or
hold a null or non-finite component take no part, nor do those whose dimension
is not the most frequent one of the sample; equal rows are one; a query whose
id has several vectors uses the smallest; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written

#: Bound of the fit: vectors in the sample, and queries among them.
FIT_ROWS = 20_000
FIT_QUERIES = 200
TARGET_RECALL = 0.97
#: A query visits cells until they hold this many times ``k`` vectors at least.
LEAST = 10
BLOCK = 4_096
CHUNK = 4_096


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products that depend on the two vectors alone (matrix products may
    round the same pair differently in different places)."""
    return np.add.reduce(rows * query, axis=1)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)[None]


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 9) -> np.ndarray:
    x = np.unique(x, axis=0)
    centroids = x[np.random.Generator(np.random.PCG64(seed)).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _distances(x, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=len(centroids))
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells ``i * len(d2) + j`` by ``d1[i] + d2[j]`` until they hold ``wanted`` vectors."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, i1, i2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    heap, out, held, width = [(s1[0] + s2[0], 0, 0)], [], 0, len(d2)
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = i1[i] * width + i2[j]
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of both halves and the share of vectors a query visits."""

    first: np.ndarray
    second: np.ndarray
    share: float
    dim: int

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.dim // 2
        return _distances(x[:, :cut], self.first), _distances(x[:, cut:], self.second)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.halves(x)
        return d1.argmin(axis=1) * len(self.second) + d2.argmin(axis=1)


def build(sample: np.ndarray, k: int, rows: int, target: float = TARGET_RECALL) -> MultiIndex:
    """Codebooks from ``sample`` and the share that reaches ``target`` on it."""
    dim, cut = sample.shape[1], sample.shape[1] // 2
    size = int(np.clip(2 * rows ** 0.25, 8, 512))
    index = MultiIndex(_kmeans(sample[:, :cut], size), _kmeans(sample[:, cut:], size), 1.0, dim)
    cell = index.cell_of(sample)
    counts = np.bincount(cell, minlength=index.cells)
    queries = sample[:FIT_QUERIES]
    d1, d2 = index.halves(queries)
    needed = []
    for i, q in enumerate(queries):
        score = inner(sample, q)
        score[i] = -np.inf
        best = np.argsort(-score, kind="stable")[:min(k, len(sample) - 1)]
        order = traverse(d1[i], d2[i], counts, len(sample))
        before = np.zeros(index.cells, dtype=np.int64)
        before[order] = np.cumsum(counts[order]) - counts[order]
        needed.append(before[cell[best]] / len(sample))
    shares = np.sort(np.concatenate(needed)) if needed else np.ones(1)
    at = min(len(shares) - 1, int(np.ceil(target * len(shares)))) if len(shares) else 0
    share = float(shares[at]) + 1 / max(1, len(sample)) if len(shares) else 1.0
    return MultiIndex(index.first, index.second, min(1.0, share), dim)


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``id, v`` (array of doubles) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where("id IS NOT NULL AND v IS NOT NULL").where(
        ~F.exists("v", bad) & F.exists("v", lambda x: x != 0.0)).dropDuplicates()


def _as_bytes(rows: DataFrame) -> DataFrame:
    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [np.asarray(v, dtype="<f8").tobytes() for v in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["id", "v"])

    return map_batches(rows, pack, "id long, v binary")


def _deal(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per cell its first block and the number of blocks it is split over."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    block = held = 0
    for cell, n in enumerate(counts.tolist()):
        if n > BLOCK:
            block += held > 0
            first[cell], parts[cell] = block, -(-n // BLOCK)
            block, held = block + int(parts[cell]), 0
        else:
            if held + n > BLOCK:
                block, held = block + 1, 0
            first[cell], held = block, held + n
    return first, parts


def _spread(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A part below ``parts`` by a hash of the id."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts


def _chunks(routes: DataFrame, first: np.ndarray) -> np.ndarray:
    """Per cell the number of chunks of the queries that visit its blocks.  The
    driver gets one number per block that is some cell's first."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        met = [np.unique(first[np.frombuffer(c, dtype="<i4")]) for c in batch.column("cells").to_pylist()]
        block, n = np.unique(np.concatenate(met), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(n)], names=["block", "n"])

    visits = np.zeros(int(first.max()) + 1, dtype=np.int64)
    for r in map_batches(routes.select("cells"), count, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():
        visits[r["block"]] = r["n"]
    return -(-visits[first] // CHUNK)


def _sent(rows: DataFrame, first: np.ndarray, parts: np.ndarray, chunks: np.ndarray) -> DataFrame:
    """``block, chunk, id, v, cell``: every vector once per chunk of its block."""
    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "cell"))
        return pa.RecordBatch.from_arrays([pa.array(first[cell] + _spread(ids, parts[cell])), pa.array(chunks[cell]),
                                           *(batch.column(c) for c in ("id", "v", "cell"))],
                                          names=["block", "chunks", "id", "v", "cell"])

    return (map_batches(rows, place, "block long, chunks long, id long, v binary, cell long").where("chunks > 0")
            .select("block", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), "id", "v", "cell"))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
            target: float = TARGET_RECALL, share: float | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each row
    for which ``queries`` (over ``id``) holds, by inner product, ties to the
    smaller id.  ``share`` overrides the fitted share of vectors to visit."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    base = written(_as_bytes(_usable(vectors, vec_id, embedding)), "vectors")
    total = base.count()
    sample = base.orderBy(F.xxhash64("id"), "id", "v").limit(FIT_ROWS).toArrow()
    if not total:
        return spark.createDataFrame([], out)
    widths = Counter(map(len, sample["v"].to_pylist()))
    dim = max(widths, key=lambda w: (widths[w], -w)) // 8
    model = build(matrix(pa.array([v for v in sample["v"].to_pylist() if len(v) == 8 * dim]), dim), k, total, target)
    wanted = max((model.share if share is None else share) * total, LEAST * k + 1)
    base = base.where(F.octet_length("v") == 8 * dim)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = model.cell_of(matrix(batch.column("v"), dim))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell)], names=["id", "v", "cell"])

    rows = written(map_batches(base, place, "id long, v binary, cell long"), "cells")
    counts = np.zeros(model.cells, dtype=np.int64)  # one number per cell
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["cell"]] = r["n"]
    first, parts = _deal(counts)
    asked = base.where(queries).groupBy("id").agg(F.min("v").alias("v"))

    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        d1, d2 = model.halves(matrix(batch.column("v"), dim))
        cells = [np.array(traverse(d1[i], d2[i], counts, wanted), dtype="<i4").tobytes() for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cells, pa.binary())],
                                          names=["id", "v", "cells"])

    routes = written(map_batches(asked, visit, "id long, v binary, cells binary"), "routes")
    chunks = _chunks(routes, first)

    def ask(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for q, v, cells in zip(*(batch.column(c).to_pylist() for c in ("id", "v", "cells"))):
            by_block: dict[int, list[int]] = {}
            for cell in np.frombuffer(cells, dtype="<i4").tolist():
                for block in range(first[cell], first[cell] + parts[cell]):
                    by_block.setdefault(block, []).append(cell)
            for block, own in by_block.items():
                chunk = int(_spread(np.array([q]), chunks[own[0]])[0])
                for c, x in zip(out, (block, chunk, q, v, np.array(own, dtype="<i4").tobytes())):
                    c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 3, *[pa.binary()] * 2))],
                                          names=["block", "chunk", "id", "v", "cells"])

    def rerank(queries_: pa.Table, rows_: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if queries_.num_rows and rows_.num_rows:
            ids, cell = rows_["id"].to_numpy(), rows_["cell"].to_numpy()
            x = matrix(rows_["v"].combine_chunks(), dim)
            for q, v, cells in zip(*(queries_[c].to_pylist() for c in ("id", "v", "cells"))):
                at = np.flatnonzero(np.isin(cell, np.frombuffer(cells, dtype="<i4")) & (ids != q))
                if len(at):
                    score = inner(x[at], np.frombuffer(v, dtype="<f8"))
                    if len(at) > k:
                        close = np.flatnonzero(score >= np.partition(score, len(at) - k)[len(at) - k])
                        at, score = at[close], score[close]
                    best = _best(score, ids[at], k)
                    for c, y in zip(found, (np.full(len(best), q), ids[at[best]], score[best])):
                        c.append(y)
        cols = [np.concatenate(c) if c else np.empty(0) for c in found]
        return pa.table([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int64, np.float64))],
                        names=["query_id", "vec_id", "score"])

    left = map_batches(routes, ask, "block long, chunk long, id long, v binary, cells binary")
    right = _sent(rows, first, parts, chunks)
    tiles = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(
        rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
