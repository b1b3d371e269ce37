"""Sequence packing: shortest-pack-first over the length histogram.

A document becomes token ids plus an end id and is cut into pieces of at most
``max_len`` tokens: whole sequences and one remainder.  Packing works on the
histogram of the piece lengths, whose size is fixed by ``max_len``, however
many documents there are: lengths are taken longest first, and all pieces of a
length go to the packs that are shortest so far (those with the largest gap),
by updating the counts of packing *patterns* (lists of lengths).  The patterns
are then joined back to the pieces by their rank within their length.

Ranks need no window over a whole length: the pieces of a length are dealt by a
hash to as many slices of about ``SLICE`` as their number takes, the counts per
slice give each its first rank, and only slices are numbered.

Defined cases: a null or empty text is the end id alone; rows without an id
and rows that repeat an id are documents of their own; an empty table gives an
empty result; a text of any length is cut, never shortened.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

END_ID = 1
#: Pieces that are numbered in one task, on average.
SLICE = 50_000


def default_vocabulary() -> str:
    """Byte-level BPE ranks; the same ids as ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def _encoding(vocabulary: str):
    """One encoder per vocabulary and Python worker.  Strings of special
    tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_pieces(docs: DataFrame, vocabulary: str, max_len: int = 2048, text: str = "text",
               doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, salt`` (and ``ids``): the
    pieces; ``salt`` tells equal pieces of a task apart."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
    if with_ids:
        schema += ", ids array<int>"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt = _encoding(vocabulary).encode_ordinary, 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(7 if with_ids else 6)]
            for d, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(body.as_py() or "") + [END_ID], dtype="<u4")
                for start in range(0, len(ids), max_len):
                    part = ids[start:start + max_len]
                    row = (d, start, len(part), zlib.crc32(part.tobytes()), len(ids), salt)
                    for c, v in zip(cols, (*row, part.astype(np.int32)) if with_ids else row):
                        c.append(v)
                    salt += 1
            types = [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(pieces, schema)


def pack_histogram(counts: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: ``(pattern, number of packs)`` for the pieces in
    ``counts`` (length -> number).  Every step uses up a length or all packs
    of one pattern, so the number of patterns depends on ``max_len`` only."""
    open_packs: dict[int, list[list]] = defaultdict(list)  # gap -> [[pattern, packs]]
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], packs: int, gap: int) -> None:
        if gap:
            open_packs[gap].append([pattern, packs])
        else:
            done.append((pattern, packs))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        # The gaps as they are now: a pack that got a piece of this length may
        # take another only when no other pack has room.
        while left:
            gap = max((g for g, packs in open_packs.items() if packs and g >= length), default=None)
            if gap is None:
                per_pack = max_len // length if left >= max_len // length else left
                packs = left // per_pack
                put((length,) * per_pack, packs, max_len - length * per_pack)
                left -= packs * per_pack
                continue
            entry = open_packs[gap][-1]
            take = min(left, entry[1])
            entry[1] -= take
            if not entry[1]:
                open_packs[gap].pop()
            put(entry[0] + (length,), take, gap - length)
            left -= take
    return done + [(p, n) for packs in open_packs.values() for p, n in packs]


def _sliced(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``pieces`` with ``slice`` instead of ``salt``; ``counts`` has at most ``max_len`` lengths."""
    slices = pieces.sparkSession.createDataFrame([(x, -(-n // SLICE)) for x, n in counts.items()], "length long, slices long")
    return (pieces.join(F.broadcast(slices), "length")
            .withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), "slices")).drop("salt", "slices"))


def pack(pieces: DataFrame, max_len: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, without ``salt``; they are
    read three times, so hand over a stored table."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, sequence = [], 0
    used: dict[int, int] = defaultdict(int)
    for pattern, packs in pack_histogram(counts, max_len):
        offset = 0
        for length in pattern:
            slots.append((length, used[length], used[length] + packs, sequence, offset))
            used[length] += packs
            offset += length
        sequence += packs
    # Bounded by max_len, not by the documents.
    slot = pieces.sparkSession.createDataFrame(slots, "length long, low long, high long, sequence long, offset long")
    sliced = _sliced(pieces, counts)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = (sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
             .select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (sliced.withColumn("rank", F.row_number().over(order) - 1).join(first, ["length", "slice"])
              .withColumn("rank", F.col("rank") + F.col("first")).drop("first", "slice"))
    return (ranked.join(F.broadcast(slot), "length")
            .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
            .withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("low"))
            .drop("rank", "low", "high", "sequence"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, max_len: int = 2048, text: str = "text",
                   doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, on request, the token ``ids``."""
    pieces = written(cut_pieces(docs, vocabulary or default_vocabulary(), max_len, text, doc_id, with_ids), "pieces")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pack(pieces, max_len).select(*cols, *["ids"] * with_ids)
