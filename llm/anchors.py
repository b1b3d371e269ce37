"""Content-defined anchors: which parts of documents may hold equal windows.

Texts are sequences of 64-bit symbols (words or bytes).  Every window of
``window`` symbols picks its *anchor*, the ``gram`` inside it with the smallest
hash.  Equal windows pick equal anchors, so windows need comparing only where
their documents share an anchor: one row per anchor is shuffled instead of one
per window.  Consecutive windows that pick equal anchors form a *segment*; text
that repeats itself is one long segment.

``shared_segments`` finds the anchors that occur more than once and collapses
equal segments; ``compare`` hands groups of different segments around one
anchor to an operator's own method, in bounded shards.  Groups beyond the bound
(a passage that a third of all documents quote, each in other words) are never
gathered: their windows are grouped by Spark instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, doc_key, map_batches, texts, written
from .shingles import mix64

_U = np.uint64
_POSITION_BITS = 26
#: Texts are worked through in overlapping pieces of at most so many symbols.
PIECE = 1 << 25
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: The holder of spans that every document must give up.
ANY = -(1 << 63)
SPANS = "array<struct<s:int,e:int,holder:long>>"
#: What one task gathers of segments to compare.
SHARD_SYMBOLS = 1_000_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base and of its inverse mod 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 12)
            self.up, self.down = _powers(self.base, self.size), _powers(self.inverse, self.size)
        return self.up[:n], self.down[:n]


_P1, _P2 = _Powers(_B1), _Powers(_B2)


def range_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hashes of ``x[s:e]`` that do not depend on the place."""
    up, down = powers.get(len(x) + 1)
    total = np.concatenate(([_U(0)], np.cumsum(x * up[:len(x)], dtype=np.uint64)))
    return mix64((total[ends] - total[starts]) * down[starts])


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = v
    blocks = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def segments(x: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """``h, sh, start, n, t`` per segment: hashes of its anchor and of itself,
    where it starts, its length, and 1 if its anchor has several places (only
    then can a window be found twice within the segment)."""
    parts = []
    for low in range(0, max(len(x) - window + 1, 0), PIECE - window + 1):
        part = x[low:low + PIECE]
        at = np.arange(len(part) - gram + 1)
        g = range_hashes(part, at, at + gram, _P1)
        order = (g >> _U(_POSITION_BITS) << _U(_POSITION_BITS)) | at.astype(np.uint64)
        place = (_sliding_min(order, window - gram + 1) & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)
        picked = g[place]
        first = np.flatnonzero(np.concatenate(([True], picked[1:] != picked[:-1])))
        after = np.concatenate((first[1:], [len(place)]))
        n = after - first - 1 + window
        sh = mix64(range_hashes(part, first, first + n, _P2) + n.astype(np.uint64) * _U(_B1))
        parts.append((picked[first], sh, first + low, n, place[after - 1] != place[first]))
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 3


@dataclass(frozen=True)
class Symbols:
    """How a text becomes symbols: of words or of bytes."""

    words: bool

    def split(self, body: bytes):
        return body.split() if self.words else body

    def join(self, part) -> bytes:
        return b" ".join(part) if self.words else bytes(part)

    def hashes(self, memory: WordHashes, items) -> np.ndarray:
        if self.words:
            return memory.of(items)
        return _BYTE_HASHES[np.frombuffer(items, dtype=np.uint8)]


_BYTE_HASHES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(_B1))


def packed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``d, f, z``: document key, a fingerprint that tells rows of one id apart
    by their text, and the compressed text (texts are shuffled that way)."""
    def pack(batches):
        compress = zstd.ZstdCompressor(level=1).compress
        for batch in batches:
            bodies = texts(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fingerprint(b) for b in bodies], pa.int32()),
                 pa.array([compress(b) for b in bodies], pa.binary())], names=["d", "f", "z"])

    return docs.select(doc_key(doc_id).alias("d"), F.col(text).cast("string")).mapInArrow(pack, "d long, f int, z binary")


def fingerprint(body: bytes) -> int:
    value = xxhash.xxh32_intdigest(body)
    return value - (1 << 32) if value >= 1 << 31 else value


def unpack(data: bytes | None) -> bytes:
    return zstd.ZstdDecompressor().decompress(data) if data else b""


def anchor_rows(docs: DataFrame, symbols: Symbols, window: int, gram: int, text: str, doc_id: str) -> DataFrame:
    """``h, sh, d, f, start, n, t``: one row per segment of every text, written."""
    memory = WordHashes()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ds, fs, found = [], [], []
        for d, body in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            got = segments(symbols.hashes(memory, symbols.split(body)), window, gram)
            if len(got[0]):
                found.append(got)
                ds.append(np.full(len(got[0]), d, dtype=np.int64))
                fs.append(np.full(len(got[0]), fingerprint(body), dtype=np.int32))
        if not found:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(),) * 3 + (pa.int32(),) * 4], names=names)
        h, sh, start, n, t = (np.concatenate(c) for c in zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(np.concatenate(ds)),
             pa.array(np.concatenate(fs)), *(pa.array(v.astype(np.int32)) for v in (start, n, t))], names=names)

    names = ["h", "sh", "d", "f", "start", "n", "t"]
    return written(map_batches(docs.select(doc_key(doc_id).alias("d"), F.col(text).cast("string")), rows,
                               "h long, sh long, d long, f int, start int, n int, t int"), "anchors")


def shared_segments(rows: DataFrame, across: bool) -> tuple[DataFrame, DataFrame]:
    """The rows whose anchor may hold a window twice (``across``: in more than
    one document), and the distinct segments among them: ``h, sh, rows, low,
    high`` (smallest and largest document), ``t``, ``ex`` (one place) and
    ``variants``, the number of distinct segments of the anchor, and ``size``,
    their symbols."""
    per_anchor = rows.groupBy("h").agg(*([F.min("d").alias("low"), F.max("d").alias("high")] if across
                                         else [F.count(F.lit(1)).alias("rows"), F.max("t").alias("t")]))
    # Written: both sides of the joins below are then plain exchanges, which
    # Spark may split where an anchor is very common.
    again = written(per_anchor.where("low < high" if across else "rows > 1 OR t = 1").select("h"), "anchors-again")
    shared = written(rows.join(again, "h", "left_semi"), "shared")
    distinct = written(shared.groupBy("h", "sh").agg(
        F.count(F.lit(1)).alias("rows"), F.min("d").alias("low"), F.max("d").alias("high"), F.max("t").alias("t"),
        F.min(F.struct("d", "f", "start", "n")).alias("ex")), "segments")
    variants = written(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("variants"), F.min("rows").alias("fewest"),
                                              F.sum("ex.n").alias("size")), "variants")
    return shared, distinct.join(variants, "h")


def with_content(chosen: DataFrame, texts_of: DataFrame, symbols: Symbols) -> DataFrame:
    """``chosen`` segments with the ``content`` at their example place."""
    places = chosen.groupBy(F.col("ex.d").alias("d"), F.col("ex.f").alias("f")).agg(F.collect_list(F.struct(
        "h", "sh", "rows", "low", "high", "size", F.col("ex.start").alias("start"), F.col("ex.n").alias("n"))).alias("at"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for z, at in zip(batch.column("z").to_pylist(), batch.column("at").to_pylist()):
            items = symbols.split(unpack(z))
            out += [(p["h"], p["sh"], p["rows"], p["low"], p["high"], p["size"],
                     symbols.join(items[p["start"]:p["start"] + p["n"]])) for p in at]
        types = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                          names=["h", "sh", "rows", "low", "high", "size", "content"])

    # Rows that repeat an id and a text give their segments again, which changes
    # nothing: those segments occur more than once anyway.
    return map_batches(texts_of.join(places, ["d", "f"]).select("z", "at"), cut,
                       "h long, sh long, rows long, low long, high long, size long, content binary")


def span_runs(values: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Runs of equal holders over consecutive windows as spans of symbols;
    windows whose holder is the largest BIGINT have none."""
    if not len(values):
        return []
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    return [(int(s), int(e) - 1 + window, int(values[s])) for s, e in zip(edges[:-1], edges[1:])
            if values[s] != np.iinfo(np.int64).max]


Method = Callable[[list[tuple[int, int, int, int, int, bytes]]], list[tuple[int, int, list[tuple[int, int, int]]]]]


def compare(segments_: DataFrame, symbols: Symbols, window: int, method: Method, group_limit: int,
            across: bool) -> DataFrame:
    """``h, sh, spans``: for different segments around one anchor, the spans
    whose windows are held elsewhere too, with the holder.

    ``method`` gets ``(h, sh, rows, low, high, content)`` of whole groups, a
    shard at a time.  Groups of more than ``group_limit`` symbols go through
    :func:`_by_window`, with the same result."""
    got = written(segments_, "contents")
    size = got.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_SYMBOLS))

    def shard(data: pa.Table) -> pa.Table:
        rows = list(zip(*(data.column(c).to_pylist() for c in ("h", "sh", "rows", "low", "high", "content"))))
        return pa.Table.from_pylist([{"h": h, "sh": sh, "spans": [{"s": s, "e": e, "holder": o} for s, e, o in spans]}
                                     for h, sh, spans in method(sorted(rows)) if spans], schema=schema)

    schema = pa.schema([("h", pa.int64()), ("sh", pa.int64()), ("spans", pa.list_(pa.struct(
        [("s", pa.int32()), ("e", pa.int32()), ("holder", pa.int64())])))])
    small = (got.where(F.col("size") <= group_limit)
             .groupBy(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
             .applyInArrow(shard, f"h long, sh long, spans {SPANS}"))
    return small.unionByName(_by_window(got.where(F.col("size") > group_limit), symbols, window, across))


def _by_window(segments_: DataFrame, symbols: Symbols, window: int, across: bool) -> DataFrame:
    """As :func:`compare`, one row per window: grouped with map-side combine,
    joined back in a join that Spark may split."""
    memory = WordHashes()

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep: list[list] = [[] for _ in range(8)]
        for h, sh, rows, low, high, content in zip(*(batch.column(c).to_pylist() for c in
                                                     ("h", "sh", "rows", "low", "high", "content"))):
            x = symbols.hashes(memory, symbols.split(content))
            at = np.arange(len(x) - window + 1)
            w1, w2 = (range_hashes(x, at, at + window, p).view(np.int64) for p in (_P1, _P2))
            for c, v in zip(keep, (h, sh, rows, low, high)):
                c.append(np.full(len(at), v, dtype=np.int64))
            for c, v in zip(keep[5:], (w1, w2, at)):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in keep],
                                          names=["h", "sh", "rows", "low", "high", "w1", "w2", "o"])

    rows = map_batches(segments_, windows, "h long, sh long, rows long, low long, high long, w1 long, w2 long, o long")
    held = rows.groupBy("w1", "w2").agg(F.sum("rows").alias("all"), F.min("low").alias("first"), F.max("high").alias("last"))
    held = (held.where("first < last").select("w1", "w2", F.col("first").alias("holder")) if across
            else held.where("all > 1").select("w1", "w2", F.lit(ANY).alias("holder")))
    return (rows.select("h", "sh", "o", "w1", "w2").join(held, ["w1", "w2"])
            .groupBy("h", "sh").agg(F.collect_list(F.struct(
                F.col("o").cast("int").alias("s"), (F.col("o") + window).cast("int").alias("e"), "holder")).alias("spans")))


def spans_by_document(shared: DataFrame, decided: DataFrame) -> DataFrame:
    """``d, f, gone``: merged spans ``[s, e)`` of each text that has any, where
    the holder comes before the document."""
    spans = (shared.join(decided, ["h", "sh"]).select("d", "f", "start", F.explode("spans").alias("x"))
             .where((F.col("x.holder") < F.col("d")) | (F.col("x.holder") == F.lit(ANY)))
             .select("d", "f", F.struct((F.col("start") + F.col("x.s")).alias("s"),
                                        (F.col("start") + F.col("x.e")).alias("e")).alias("x")))
    return spans.groupBy("d", "f").agg(F.collect_set("x").alias("gone"))


def covered(spans: list[dict], n: int) -> np.ndarray:
    """Which of ``n`` symbols the spans cover."""
    if not spans:
        return np.zeros(n, dtype=bool)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, [x["s"] for x in spans], 1)
    np.add.at(edges, [x["e"] for x in spans], -1)
    return np.cumsum(edges[:n]) > 0
