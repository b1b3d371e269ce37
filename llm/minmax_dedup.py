"""Near-duplicate documents by min-max hashing.

1. A document's set of word shingles is permuted by ``n_perm`` multipliers; of
   each permutation both the smallest and the largest image are kept, so half
   the hash evaluations give as many signature values.  Bands of ``rows``
   values (half minima, half maxima) become bucket keys.
2. Documents with equal sets are one class; classes that share a bucket are
   candidates.  In a bucket every class is compared with that of the smallest
   id, on the full sets, and what is linked is joined to components.  Classes carry
   numbers of their own, so texts under one id stay apart; the smallest id of a
   component is looked up at the end.
3. A bucket that still spans several components may hide links between other
   members.  Their classes are joined by an exact prefix filter: with shingles
   ordered by rarity, two sets that are similar enough share one of their
   rarest.  Only members of different components meet, and of a shingle's rows
   only those outside its largest component are paired with the others.  The
   rows of a frequent shingle meet by size band, the smaller set in its own and
   the larger in at most five: what sizes and positions rule out (texts of one
   template that stay below the threshold) is not compared.
   Every pair is confirmed on the full sets.

No step emits all pairs of a bucket, and no class is limited in partners.

At ``threshold`` 0.85, 32 bands of 6 miss a pair with probability below 3e-7.

Defined cases: texts without words have an empty set and are linked with
nothing; rows without an id count as one document after all others, with a null
component if they reach no id; rows that repeat an id are each linked through
their own text; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, WordHashes, doc_key, free_name, map_batches, signed, texts, written
from .components import components
from .shingles import band_keys, min_max, mix64, permutations, shingle_set

#: Counters of the rarity sketch: a bound on what is broadcast.
SKETCH_BITS = 20
#: Rows from which a shingle's rows meet by size band, and the width of the
#: narrowest band: neither changes a result.
MANY, BAND = 64, 0.01


def signatures(docs: DataFrame, text: str, doc_id: str, shingle: int, n_perm: int, rows: int) -> DataFrame:
    """``d, f`` (fingerprint of the text), ``n_shingles, s1, s2`` (hash of the
    set) and ``bands`` per row."""
    factors = permutations(n_perm)
    hashes = WordHashes()

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, s1, s2, bands = [], [], [], []
        for body in texts(batch.column(2)):
            s = shingle_set(body.lower().split(), hashes, shingle)
            digest = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            s1.append(signed(digest >> 64))
            s2.append(signed(digest & ((1 << 64) - 1)))
            bands.append(band_keys(*min_max(s, factors), rows).view(np.int64) if len(s) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
             pa.array(bands, pa.list_(pa.int64()))], names=["d", "f", "n_shingles", "s1", "s2", "bands"])

    return map_batches(docs.select(doc_key(doc_id).alias("d"), _fingerprint(text).alias("f"), F.col(text).cast("string")), sign,
                       "d long, f long, n_shingles long, s1 long, s2 long, bands array<long>")


def _fingerprint(text: str) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def _confirm(pairs: DataFrame, bodies: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The ``a, b`` whose full sets are similar enough, written."""
    hashes = WordHashes()

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, last = batch.column("a").to_pylist(), batch.column("b").to_pylist(), (None, None)
        keep = []
        for i, (ta, tb) in enumerate(zip(texts(batch.column("ta")), texts(batch.column("tb")))):
            if last[0] != ta:  # rows of one smallest class follow each other
                last = (ta, shingle_set(ta.lower().split(), hashes, shingle))
            x, y = last[1], shingle_set(tb.lower().split(), hashes, shingle)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        return pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()),
                                           pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    rows = (pairs.join(bodies.select(F.col("class").alias("a"), F.col("t").alias("ta")), "a")
                 .join(bodies.select(F.col("class").alias("b"), F.col("t").alias("tb")), "b"))
    return written(map_batches(rows.select("a", "b", "ta", "tb"), check, "a long, b long").distinct(), "links")


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (mix64(shingles) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(open_bodies: DataFrame, shingle: int) -> DataFrame:
    """``slot, n``, 32 bits each: the slots with two shingles or more."""
    hashes = WordHashes()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for body in texts(batch.column("t")):
            np.add.at(total, _slots(shingle_set(body.lower().split(), hashes, shingle)), 1)
        slots = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], names=["slot", "n"])

    return (map_batches(open_bodies.select("t"), count, "slot long, n long")
            .groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
            .select(F.col("slot").cast("int"), F.least("n", F.lit(np.iinfo(np.int32).max)).cast("int").alias("n")))


def _rarity(open_bodies: DataFrame, shingle: int) -> np.ndarray:
    """Counts of shingles by hash slot, at least 1: at most 2^SKETCH_BITS numbers reach the driver."""
    table = _sketch(open_bodies, shingle).toArrow()
    out = np.ones(1 << SKETCH_BITS, dtype=np.int32)
    out[table["slot"].to_numpy()] = table["n"].to_numpy()
    return out


def _prefixes(open_bodies: DataFrame, rarity: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """``tok, class, root, n, pos``: the rarest shingles of a set, as many as it
    takes for two similar sets to share one."""
    hashes = WordHashes()

    def prefix(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for name, root, body in zip(*(batch.column(c).to_pylist() for c in ("class", "root")), texts(batch.column("t"))):
            s = shingle_set(body.lower().split(), hashes, shingle)
            size = len(s) - -(-percent * len(s) // 100) + 1
            order = np.lexsort((s, rarity[_slots(s)]))[:size]
            for c, v in zip(cols, (s[order].view(np.int64), np.full(size, name), np.full(size, root),
                                   np.full(size, len(s)), np.arange(size))):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols],
                                          names=["tok", "class", "root", "n", "pos"])

    return map_batches(open_bodies.select("class", "root", "t"), prefix, "tok long, class long, root long, n long, pos long")


def _band(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(1 + BAND)))


def _need(n: Column, other: Column, percent: int) -> Column:
    """The shingles that similar sets of these sizes have in common, at least."""
    return F.ceil(F.lit(percent) * (n + other) / F.lit(100 + percent))


def _sizes(first: Column, last: Column) -> tuple[Column, Column]:
    """How many bands count as one (1, 4 or 16, so that few cover the range), and
    the range ``first`` to ``last`` in such bands."""
    low, high = _band(first), _band(last)
    step = F.when(high - low < 4, 1).when(high - low < 16, 4).otherwise(16)
    return step, F.sequence(F.floor(low / step), F.floor(high / step))


def _banded(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with ``step, band``: the size bands of the smaller sets that a row
    may meet.  How many shingles follow the row's bounds them from above; at most
    five rows come of one."""
    n = F.col("n")
    # Inverse of _need: the largest set that the rest of this one allows.
    most = F.floor((n - F.col("pos")) * F.lit(100 + percent) / F.lit(percent)) - n
    step, bands = _sizes(F.ceil(F.lit(percent) * n / 100), F.least(n, most))
    return (rows.withColumns({"step": step, "bands": bands})
                .select(*rows.columns, "step", F.explode("bands").alias("band")))


def _own_bands(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with ``step, band``: the band of a row's own size at every step, if
    enough shingles follow for a set of at least that size."""
    own = _band(F.col("n"))
    steps = F.array(*[F.struct(F.lit(s).alias("step"), F.floor(own / s).alias("band")) for s in (1, 4, 16)])
    return (rows.where(F.col("n") - F.col("pos") >= _need(F.col("n"), F.col("n"), percent))
                .select(*rows.columns, F.explode(steps).alias("x")).select(*rows.columns, "x.step", "x.band"))


def _meetings(prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs of rows of different components that share a prefix shingle.
    Those of a shingle with many rows meet by size band, so that sizes and
    positions that rule a pair out keep it from being compared at all."""
    per_root = prefixes.groupBy("tok", "root").agg(F.count(F.lit(1)).alias("rows"))
    main = (per_root.groupBy("tok").agg(F.count(F.lit(1)).alias("roots"), F.sum("rows").alias("rows"),
                                        F.max(F.struct("rows", "root")).alias("x"))
            .where("roots > 1").select("tok", F.col("x.root").alias("main"), (F.col("rows") > MANY).alias("many")))
    met = written(prefixes.join(main, "tok"), "prefixes")
    sides = [[f"{c}{side}" for c in ("class", "root", "n", "pos")] for side in ("", "2")]
    second = lambda df, *keys: df.select(*keys, *[F.col(c).alias(c2) for c, c2 in zip(*sides)])
    pairs = lambda one, two, *keys: one.join(second(two, *keys), [*keys]).select("tok", *sides[0], *sides[1])
    other, frequent, few = met.where("NOT many"), met.where("many"), "root <> main"
    small, large, by = _own_bands(frequent, percent), _banded(frequent, percent), ("tok", "step", "band")
    return (pairs(other, other.where(few), "tok")
            .unionByName(pairs(small.where(few), large, *by).where("n <= n2"))
            .unionByName(pairs(small.where("root = main"), large.where(few), *by).where("n <= n2"))
            .where("root <> root2"))


def _hidden_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of different components that share a prefix shingle and whose
    sizes and positions allow the similarity."""
    return (_meetings(prefixes, percent)
            .where(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
            .where(F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= _need(F.col("n"), F.col("n2"), percent))
            .select(F.least("class", "class2").alias("a"), F.greatest("class", "class2").alias("b")).distinct())


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, percent: int = 85,
                    n_perm: int = 96, rows: int = 6) -> DataFrame:
    """``d, f, n_shingles, s1, s2, component``, one row per row of ``docs``;
    ``d`` and ``component`` are document keys (:data:`~llm.common.NO_ID` for null)."""
    if rows % 2 or n_perm % (rows // 2):
        raise ValueError("bands take equally many minima and maxima")
    sig = written(signatures(docs, text, doc_id, shingle, n_perm, rows), "signatures")
    classes = sig.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(F.struct("d", "f")).alias("x"), F.first("bands").alias("bands"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("class"), "s1", "s2", "x.d", "x.f", "bands"), "classes")
    banded = classes.select("class", "d", F.explode("bands").alias("bucket"))
    smallest = (banded.groupBy("bucket").agg(F.min_by("class", "d").alias("a"), F.min("class").alias("low"),
                                             F.max("class").alias("last"))
                .where("low < last").select("bucket", "a"))
    shared = written(banded.drop("d").join(smallest, "bucket"), "buckets")
    chosen = classes.select("class", "d", "f").join(shared.select("class").distinct(), "class", "left_semi")
    bodies = written(docs.select(doc_key(doc_id).alias("d"), _fingerprint(text).alias("f"), F.col(text).cast("string").alias("t"))
                     .join(chosen, ["d", "f"]).select("class", "t").distinct(), "bodies")
    links = _confirm(shared.where("class <> a").select("a", F.col("class").alias("b")).distinct(), bodies, shingle, percent)
    roots = components(links)

    rooted = (shared.join(roots, shared["class"] == roots["node"], "left")
              .select("bucket", "class", F.coalesce("root", "class").alias("root")))
    unsettled = (rooted.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
                 .where("r1 <> r2").select("bucket"))
    doubtful = written(rooted.join(unsettled, "bucket", "left_semi").select("class", "root").distinct(), "doubtful")
    open_bodies = written(bodies.join(doubtful, "class"), "open-bodies")
    rarity = _rarity(open_bodies, shingle)
    hidden = _hidden_pairs(_prefixes(open_bodies, rarity, shingle, percent), percent)
    more = _confirm(hidden, bodies, shingle, percent)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    members = roots.select(F.col("node").alias("class"), "root").unionByName(roots.select(F.col("root").alias("class"), "root").distinct())
    lowest = members.join(classes.select("class", "d"), "class").groupBy("root").agg(F.min("d").alias("low"))
    owners = (classes.select("s1", "s2", "class", "d").join(members.join(lowest, "root"), "class", "left")
              .select("s1", "s2", F.coalesce("low", "d").alias("component")))
    return (sig.select("d", "f", "n_shingles", "s1", "s2").join(owners, ["s1", "s2"], "left")
            .withColumn("component", F.coalesce("component", "d")))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80,
          n_perm: int = 150, rows: int = 6) -> DataFrame:
    """The rows of ``docs`` that stay: of every component those with its
    smallest id.  Five-word shingles and similarity 0.8 (50 bands of 6: a pair
    is missed with probability below 3e-7)."""
    found = near_duplicates(docs, text, doc_id, shingle, percent, n_perm, rows)
    d, f = free_name(docs.columns, "d"), free_name(docs.columns, "f")
    lost = found.where("d <> component").select(F.col("d").alias(d), F.col("f").alias(f)).distinct()
    return (docs.withColumns({d: doc_key(doc_id), f: _fingerprint(text)})
            .join(lost, [d, f], "left_anti").select(*[f"`{c}`" for c in docs.columns]))


def components_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row."""
    found = near_duplicates(docs, text, doc_id, **options)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(real("d").alias("doc_id"), "n_shingles", real("component").alias("component_id"),
                        (F.col("d") == F.col("component")).alias("kept"))
