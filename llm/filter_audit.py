"""How filters of a corpus act together, for every order of applying them.

A document fails a subset of the filters (its *mask*).  The subsets of filters
that have been applied are the states of a lattice, and applying one more
filter is an edge; an order of all filters is a path from the empty subset to
the full one.  What a filter removes depends on the edge alone: the documents
that fail it and none of those applied before.  So

* the documents are read once and counted per part and mask (at most ``2^n``
  counts per part, combined map-side);
* every edge sums its removals over the masks;
* a forward pass counts the orders that reach a state, a backward pass those
  that lead from it to the end; their product over an edge is the number of
  orders that take it, the weight of its removals in the Shapley sum;
* each step of each order is read from the edge it takes.

``before`` names pairs of filters of which the first must come earlier; only the
orders that respect them are then counted and returned.

Defined cases: null texts are empty; a null part is the empty string; rows
without an id come after all others and rows that repeat an id do not precede
each other; marks of an id that repeat are joined by OR, marks without an id or
without a document are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_key, free_name, map_batches, signed, texts, written

#: Orders are listed one by one: ``n! * n`` rows are broadcast, so ``n`` is bounded.
MAX_FILTERS = 7
_UPPER = frozenset(range(0x41, 0x5B))
_SYMBOLS = frozenset(b"#$%&*|")
_NOT_UPPER, _NOT_SYMBOL = (bytes(c for c in range(256) if c not in own) for own in (_UPPER, _SYMBOLS))
STATISTICS = "n_words long, n_distinct long, n_upper long, n_points long, n_symbols long, h1 long, h2 long"


def statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", others: Iterable[str] = ()) -> DataFrame:
    """``d``, the columns ``others``, and per text its words, distinct words,
    characters ``[A-Z]``, code points, characters ``[#$%&*|]`` and 128-bit hash."""
    others = list(others)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list[int]] = [[] for _ in range(6)]
        body_column = batch.column("t")
        for body in texts(body_column):
            words = body.split()
            digest = xxhash.xxh3_128_intdigest(body)
            for c, v in zip(cols, (len(words), len(set(words)), len(body.translate(None, _NOT_UPPER)),
                                   len(body.translate(None, _NOT_SYMBOL)), signed(digest >> 64),
                                   signed(digest & ((1 << 64) - 1)))):
                c.append(v)
        points = pc.fill_null(pc.utf8_length(body_column), 0).cast(pa.int64())
        numbers = [pa.array(c, pa.int64()) for c in cols]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["d", *others]), *numbers[:3], points, *numbers[3:]],
                                          names=["d", *others, *(c.split()[0] for c in STATISTICS.split(", "))])

    rows = docs.select(doc_key(doc_id).alias("d"), *[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string").alias("t"))
    schema = rows.drop("t").schema
    for field in STATISTICS.split(", "):
        schema = schema.add(*field.split())
    return map_batches(rows, measure, schema)


def with_copies(rows: DataFrame, out: str = "is_copy") -> DataFrame:
    """``rows`` (:func:`statistics`) and whether a smaller id has the same text.
    Texts of one document alone are no part of the join; a text that a third
    of all documents share is reduced map-side, and its rows are joined back
    in a join that Spark may split."""
    copied = (rows.groupBy("h1", "h2").agg(F.min("d").alias("_first"), F.max("d").alias("_last"))
              .where("_first < _last").select("h1", "h2", "_first"))
    return (rows.join(copied, ["h1", "h2"], "left")
            .withColumn(out, F.coalesce(F.col("d") > F.col("_first"), F.lit(False))).drop("_first"))


class Lattice:
    """Subsets of ``n`` filters as bit masks, and the orders through them."""

    def __init__(self, n: int, before: Iterable[tuple[int, int]] = ()):
        if not 1 <= n <= MAX_FILTERS:
            raise ValueError(f"between 1 and {MAX_FILTERS} filters can be audited")
        self.n, self.needs = n, [0] * n
        for first, then in before:
            self.needs[then] |= 1 << first
        full = (1 << n) - 1
        self.reaching, self.leaving = [0] * (full + 1), [0] * (full + 1)
        self.reaching[0] = self.leaving[full] = 1
        for state in range(full + 1):  # a subset is a smaller number than what it is part of
            for f in self.following(state):
                self.reaching[state | 1 << f] += self.reaching[state]
        for state in range(full, -1, -1):
            for f in self.following(state):
                self.leaving[state] += self.leaving[state | 1 << f]
        if not self.leaving[0]:
            raise ValueError("no order respects 'before'")

    def following(self, state: int) -> list[int]:
        """Filters that may come next."""
        return [f for f in range(self.n) if not state >> f & 1 and self.needs[f] & state == self.needs[f]]

    def edges(self) -> list[tuple[int, int, int]]:
        """``state, filter, paths``: the edges that orders take, and how many do."""
        return [(s, f, paths) for s in range(1 << self.n) for f in self.following(s)
                if (paths := self.reaching[s] * self.leaving[s | 1 << f])]

    def orders(self) -> list[tuple[tuple[int, ...], int, int, int]]:
        """``order, step (from 1), state, filter`` of every step of every order."""
        out = []
        for order in permutations(range(self.n)):
            state, steps = 0, []
            for step, f in enumerate(order, 1):
                if f not in self.following(state):
                    break
                steps.append((order, step, state, f))
                state |= 1 << f
            else:
                out += steps
        return out


def audit(docs: DataFrame, fails: Mapping[str, Column], part: Column, marks: Mapping[str, Column] | None = None,
          before: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails``, a
    column ``<mark>_lost`` for each of ``marks``, and ``shapley``: one row per
    part, order (names of ``fails`` joined) and step.

    ``fails`` and ``marks`` are conditions over ``docs``, null as false."""
    names, marks = list(fails), dict(marks or {})
    lattice = Lattice(len(names), [(names.index(a), names.index(b)) for a, b in before])
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    mask = sum((bit(c) * F.lit(1 << i) for i, c in enumerate(fails.values())), F.lit(0))
    counts = written(docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"),
                                 *[bit(c).alias(f"m{i}") for i, c in enumerate(marks.values())])
                     .groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(len(marks))]),
                     "masks")

    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(1 << f).alias("f"), F.lit(paths).cast("long").alias("paths"))
                               for s, f, paths in lattice.edges()]))
    flows = counts.withColumn("e", edge).select("*", "e.*").drop("e")
    now, earlier = F.col("mask").bitwiseAND(F.col("f")) != 0, F.col("mask").bitwiseAND(F.col("state")) != 0
    total = lambda where, of="n": F.sum(F.when(where, F.col(of)).otherwise(0))
    flows = flows.groupBy("part", "state", "f", "paths").agg(
        total(~now & ~earlier).alias("kept"), total(now & ~earlier).alias("removed"), total(now & earlier).alias("redundant"),
        total(F.col("mask") == F.col("f")).alias("unique_fails"),
        *[total(now & ~earlier, f"m{i}").alias(f"{name}_lost") for i, name in enumerate(marks)])
    shapley = flows.groupBy("part", "f").agg(F.sum(F.col("paths") * F.col("removed")).alias("shapley"))
    joint = "" if all(len(name) == 1 for name in names) else ","
    steps = docs.sparkSession.createDataFrame(
        [(joint.join(names[i] for i in order), step, state, 1 << f) for order, step, state, f in lattice.orders()],
        "filter_order string, step int, state int, f int")
    return (flows.join(shapley, ["part", "f"]).join(F.broadcast(steps), ["state", "f"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                    *[f"{name}_lost" for name in marks], "shapley"))


def audit_texts(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """:func:`audit` of five filters on texts: A few words, B repeated words, C
    capitals, D symbols, E copies; what is marked good or toxic is followed."""
    marked = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("d"))
              .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    name = free_name(["d", *(c.split()[0] for c in STATISTICS.split(", "))], "part")
    rows = statistics(docs.select(doc_id, text, F.col(f"`{part}`").cast("string").alias(name)), text, doc_id, [name])
    rows = with_copies(written(rows, "text-statistics")).join(marked, "d", "left")
    fails = {"A": F.col("n_words") < 50, "B": 100 * F.col("n_distinct") < 65 * F.col("n_words"),
             "C": 100 * F.col("n_upper") > 5 * F.col("n_points"), "D": F.col("n_symbols") > 0, "E": F.col("is_copy")}
    return audit(rows, fails, F.col(name), {"good": F.col("good"), "toxic": F.col("toxic")})
