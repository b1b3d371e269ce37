"""Words of many texts at once, as 64-bit hashes with their places.

Texts are joined to a block; its bytes are classed by a table, and words are
maximal runs of bytes of class ``WORD``.  All rules here separate words by ASCII
bytes, so the bytes of a UTF-8 text can be taken one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .anchors import _BYTE_HASHES, _P1, range_hashes
from .common import texts
from .shingles import mix64

WORD, BLANK, BREAK = 0, 1, 2
#: Bytes that are hashed together (cut at the next byte that ends a word).
_RUN = 1 << 16
#: Bytes of the texts of a block.  A longer text is a block of its own.
BLOCK_BYTES = 4 << 20
_U = np.uint64


def classes(word: Iterable[int], breaks: Iterable[int] = ()) -> np.ndarray:
    """The class of each byte: those of ``word``, of ``breaks``, all others."""
    table = np.full(256, BLANK, dtype=np.int8)
    table[list(word)] = WORD
    table[list(breaks)] = BREAK
    return table


def words_of(block: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hashes, starts, ends`` of the words of a block, in order."""
    found, low = [], 0
    data = np.frombuffer(block, dtype=np.uint8)
    while low < len(data):
        high = min(low + _RUN, len(data))
        while high < len(data):  # on to the next byte outside words
            out = np.flatnonzero(table[data[high:high + _RUN]] != WORD)
            if len(out):
                high += int(out[0])
                break
            high = min(high + _RUN, len(data))
        part = data[low:high]
        inside = np.concatenate(([False], table[part] == WORD, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        found.append((range_hashes(_BYTE_HASHES[part], starts, ends, _P1), starts + low, ends + low))
        low = high
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[list[bytes], pa.Table]]:
    """Texts (null as empty) of about ``limit`` bytes at a time, with their rows
    without the texts.  A task holds one block."""
    bodies: list[bytes] = []
    rows: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        others = batch.select([n for n in batch.schema.names if n != text])
        low = 0
        while low < batch.num_rows:
            part = texts(batch.column(text).slice(low, 256))
            size = 0
            for i, body in enumerate(part):
                size += len(body) + 1
                if held + size >= limit:
                    part = part[:i + 1]
                    break
            bodies += part
            rows.append(others.slice(low, len(part)))
            held += size
            low += len(part)
            if held >= limit:
                yield bodies, pa.Table.from_batches(rows)
                bodies, rows, held = [], [], 0
    if bodies:
        yield bodies, pa.Table.from_batches(rows)


def grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows of the unsigned ``columns`` together, places
    of a row ascending where there is one column, and where each group starts."""
    n = len(columns[0])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = columns[0]
    for c in columns[1:]:
        key = mix64(key * _U(0x9E3779B97F4A7C15) + c)
    bits = _U(max(1, int(n - 1).bit_length()))
    order = None
    if bits <= 24:  # sorting numbers is several times as fast as sorting places
        mixed = np.sort((key >> bits << bits) | np.arange(n, dtype=np.uint64))
        order = (mixed & ((_U(1) << bits) - _U(1))).astype(np.int64)
        near = (mixed[1:] >> bits) == (mixed[:-1] >> bits)
        if any((near & (c[order][1:] != c[order][:-1])).any() for c in columns):
            order = None  # different rows with one shortened key
    if order is None:
        order = np.lexsort(columns)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        ranked = c[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new)
