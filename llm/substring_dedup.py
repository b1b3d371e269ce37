"""Substring dedup of word sequences with suffix automata.

A window of ``window`` words is removed from a document if the same words also
start in a document with a smaller id.  Anchors (see :mod:`llm.anchors`) route
the passages that documents may share to shards; a shard's passages are the
reference.  Each group's reference is one suffix automaton whose states carry
the smallest document that holds their strings; the passages of the documents
are streamed through it for matching statistics, cut to the window length: the
state of the last ``window`` words names the first holder of that window.
Maximal runs of matched windows are the spans to remove.

The reference is the corpus itself, so its automata are not broadcast to every
task (that would be as many passes over the corpus as it has shards): a shard's
automata are built where the passages that can match it are gathered.  Equal
passages are collapsed before, and an anchor with one passage needs no
automaton: all its windows are held by its smallest document.

Defined cases: a null or empty text has no words; rows without an id are one
document after all others; rows that repeat an id are one document, they do not
remove each other's words; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import NO_ID, WordHashes, map_batches

GRAM = 8
#: Words of the segments of one anchor that may meet in one task.
GROUP_LIMIT = 1_000_000


class SuffixAutomaton:
    """Generalised suffix automaton over non-negative integers.  ``first[state]``
    is the smallest owner of a string that ends in the state (after ``settle``).

    Nearly all states have one successor, which is kept in two flat arrays;
    only the others have a dictionary."""

    def __init__(self) -> None:
        self.symbol, self.target = array("q", [-1]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length, self.first = array("q", [-1]), array("q", [0]), array("q", [NO_ID])

    def step(self, state: int, c: int) -> int:
        """The state after ``c``, -1 if there is none."""
        if self.symbol[state] == c:
            return self.target[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(c, -1)

    def _set(self, state: int, c: int, target: int) -> None:
        if self.symbol[state] in (-1, c):
            self.symbol[state], self.target[state] = c, target
        else:
            self.more.setdefault(state, {})[c] = target

    def _state(self, length: int, like: int = -1) -> int:
        """A new state, with the successors and the link of ``like``."""
        state = len(self.link)
        self.symbol.append(-1 if like < 0 else self.symbol[like])
        self.target.append(-1 if like < 0 else self.target[like])
        self.link.append(0 if like < 0 else self.link[like])
        self.length.append(length)
        self.first.append(NO_ID)
        if like in self.more:
            self.more[state] = dict(self.more[like])
        return state

    def _clone(self, p: int, q: int, c: int) -> int:
        """The state for the strings of ``q`` no longer than those of ``p`` plus ``c``."""
        clone = self._state(self.length[p] + 1, q)
        while p >= 0 and self.step(p, c) == q:
            self._set(p, c, clone)
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, symbols: Sequence[int], owner: int) -> None:
        link, length, first = self.link, self.length, self.first
        last = 0
        for c in symbols:
            q = self.step(last, c)
            if q >= 0:  # an earlier string has this one already
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
            else:
                p, last = last, self._state(length[last] + 1)
                while p >= 0:
                    q = self.step(p, c)
                    if q >= 0:
                        link[last] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                        break
                    self._set(p, c, last)
                    p = link[p]
            if owner < first[last]:
                first[last] = owner

    def settle(self) -> None:
        """Pass owners down to suffixes, longest strings first."""
        first, link = self.first, self.link
        for state in np.argsort(-np.frombuffer(self.length, dtype=np.int64), kind="stable").tolist():
            up = link[state]
            if up > 0 and first[state] < first[up]:
                first[up] = first[state]

    def holders(self, symbols: Sequence[int], window: int) -> list[int]:
        """Matching statistics cut to ``window``: per window of ``symbols`` the
        smallest owner of an equal one, ``NO_ID`` where there is none."""
        link, length, first = self.link, self.length, self.first
        state, matched, out = 0, 0, []
        for i, c in enumerate(symbols):
            following = self.step(state, c)
            while state and following < 0:
                state = link[state]
                matched = length[state]
                following = self.step(state, c)
            if following >= 0:
                state = following
                matched += 1
            while state and length[link[state]] >= window:
                state = link[state]
            matched = min(matched, window)
            if i >= window - 1:
                out.append(first[state] if matched == window else NO_ID)
        return out


def _stretches(parts: list[np.ndarray], low: np.ndarray, high: np.ndarray, window: int, gram: int) -> list[tuple[int, int, int]]:
    """``member, start, end`` of the maximal runs of windows all of whose grams
    occur in documents with different ids: no other window can be shared."""
    x, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    at = np.arange(len(x) - gram + 1)
    hashes = A.range_hashes(x, at, at + gram, A._P1)
    member = np.repeat(np.arange(len(parts)), sizes)[:len(at)]
    inside = at + gram <= ends[member]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    # Grams across two members take the values that leave others as they are.
    first = np.minimum.reduceat(np.where(inside, low[member], NO_ID)[order], starts)
    last = np.maximum.reduceat(np.where(inside, high[member], A.ANY)[order], starts)
    useful = np.empty(len(at), dtype=bool)
    useful[order] = np.repeat(first < last, np.diff(np.concatenate((starts, [len(at)]))))
    useful &= inside
    span = window - gram + 1
    bad = np.concatenate(([0], np.cumsum(~useful)))
    good = np.zeros(len(at) + 1, dtype=np.int8)
    good[:len(at) - span + 1] = bad[span:] == bad[:len(at) - span + 1]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], good))))
    out = []
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
        m = int(member[s])
        begin = int(ends[m] - sizes[m])
        out.append((m, s - begin, e - 1 + window - begin))
    return out


def automaton_method(window: int, gram: int) -> A.Method:
    """Groups of segments -> spans with the first holder.

    Stretches that can be shared are cut out first and equal ones collapsed, so
    the automaton grows with the distinct shared text of a group only."""
    memory = WordHashes()

    def run(rows: list[tuple[int, int, int, int, int, bytes]]) -> list:
        out = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            members = list(group)
            parts = [memory.of(r[5].split()) for r in members]
            found: dict[bytes, list] = {}
            low, high = (np.array([r[i] for r in members], dtype=np.int64) for i in (3, 4))
            for m, start, end in _stretches(parts, low, high, window, gram):
                entry = found.setdefault(parts[m][start:end].tobytes(), [NO_ID, []])
                entry[0] = min(entry[0], members[m][3])
                entry[1].append((m, start))
            automaton = SuffixAutomaton()
            number: dict[int, int] = {}
            texts = [array("q", [number.setdefault(w, len(number)) for w in np.frombuffer(content, dtype=np.uint64).tolist()])
                     for content in found]
            for symbols, (owner, _) in zip(texts, found.values()):
                automaton.add(symbols, owner)
            automaton.settle()
            spans: list[list] = [[] for _ in members]
            for symbols, (_, places) in zip(texts, found.values()):
                held = np.array(automaton.holders(symbols, window), dtype=np.int64)
                held[held == NO_ID] = np.iinfo(np.int64).max
                runs = A.span_runs(held, window)
                for m, start in places:
                    spans[m] += [(s + start, e + start, o) for s, e, o in runs if o < members[m][4]]
            out += [(r[0], r[1], x) for r, x in zip(members, spans)]
        return out

    return run


def drop_shared_passages(docs: DataFrame, window: int = 50, text: str = "text", doc_id: str = "doc_id",
                         gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, removed`` (maximal runs of
    removed words ``[s, e)``) per row of ``docs``; kept words are joined by one space."""
    symbols = A.Symbols(words=True)
    gram = min(gram, window)
    shared, distinct = A.shared_segments(A.anchor_rows(docs, symbols, window, gram, text, doc_id), across=True)
    packed = A.packed(docs, text, doc_id)
    single = distinct.where("variants = 1").select("h", "sh", F.array(F.struct(
        F.lit(0).alias("s"), F.col("ex.n").alias("e"), F.col("low").alias("holder"))).alias("spans"))
    several = A.with_content(distinct.where("variants > 1"), packed, symbols)
    decided = single.unionByName(A.compare(several, symbols, window, automaton_method(window, gram), group_limit, across=True))
    gone = A.spans_by_document(shared, decided)

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, total, lost, kept, runs = [], [], [], [], []
        for d, z, spans in zip(*(batch.column(c).to_pylist() for c in ("d", "z", "gone"))):
            words = A.unpack(z).split()
            out = A.covered(spans, len(words))
            ids.append(None if d == NO_ID else d)
            total.append(len(words))
            lost.append(int(out.sum()))
            kept.append(b" ".join(w for w, x in zip(words, out) if not x).decode("utf-8", "replace") if lost[-1]
                        else b" ".join(words).decode("utf-8", "replace"))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
            runs.append([{"s": int(s), "e": int(e)} for s, e in zip(edges[::2], edges[1::2])])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string()),
             pa.array(runs, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
            names=["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return map_batches(packed.join(gone, ["d", "f"], "left").select("d", "z", "gone"), remove,
                       "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<s:long,e:long>>")
