"""Language-model scores by context-tree weighting over bytes.

A text, A-Z lower-cased, is a sequence of bytes and one end.  A symbol is decided bit by bit:
whether the text ends, then the eight bits of the byte.  The tree has a node
for every context of up to ``depth`` bytes and every bit prefix.  A node's own
estimate is Krichevsky-Trofimov's, ``(n_bit + 1/2) / (n + 1)``; its weighted
probability mixes its own block probability with the product of its children's,
one half each, from the longest contexts up.  The probability of a bit is the
resulting mixture over the contexts of all depths; contexts that training never
saw take the estimate of the longest one it did.  Probabilities of all texts
add up to one.

How it runs on a cluster:

* texts are dealt to chunks of about ``CHUNK_BYTES``; a chunk gives one row per
  distinct symbol-in-context (and per distinct word) with its training count;
* those rows are written once as a table bucketed by key, so that adding up
  the counts of all chunks, and sending results back to the chunks that need
  them, takes no further shuffle of the large side;
* nodes with two bytes of context or more only meet nodes with the same last
  two bytes: the tree is worked out in buckets of those.  What is above has at
  most 257 * 511 nodes, whatever the corpus, and is worked out on the driver;
* each chunk gets the probabilities of its own symbols-in-context and adds
  them up per text.  No table of the model is broadcast.

Defined cases: a null or empty text is its end alone; rows without an id, or
with a repeated one, are texts of their own; without training texts every bit
has probability one half and the base score is 0; an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import _BYTE_HASHES, _P1, range_hashes
from .common import scratch_path, texts, written

DEPTH = 5
CHUNK_BYTES = 24 << 20
#: The tree is dealt to so many parts by last two bytes, and to more where a
#: part would hold more than so many counts.
SUBTREES, SUBTREE_KEYS = 64, 2_000_000
END = 256
_U = np.uint64
#: Texts that are unpacked together, and bytes whose words are hashed together.
_TEXTS, _RUN = 128, 1 << 16
#: The hash of the end token.
_END_TOKEN = _U(0xE7037ED1A0B428DB)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)


class _Sums:
    """Sums by key of many small arrays; merges once what is new outweighs the rest."""

    def __init__(self):
        self.parts, self.new, self.held = [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.new += len(keys)
        if self.new > max(1 << 20, self.held):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        merged = _summed(*(np.concatenate(c) for c in zip(*self.parts)))
        self.parts, self.new, self.held = [merged], 0, len(merged[0])
        return merged


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    if not len(values):
        return values, np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[starts], np.diff(np.concatenate((starts, [len(values)])))


def contexts(bodies: list[bytes], depth: int) -> np.ndarray:
    """One key per symbol of the texts: the ``depth`` bytes before it (zeros
    before the text), the last byte highest, then nine bits for the symbol."""
    out = []
    for body in bodies:
        x = np.empty(depth + len(body) + 1, dtype=np.uint64)
        x[:depth] = 0
        x[depth:-1] = np.frombuffer(body, dtype=np.uint8)
        x[-1] = END
        n = len(body) + 1
        key = np.zeros(n, dtype=np.uint64)
        for back in range(1, depth + 1):
            key = (key << _U(8)) | x[depth - back:depth - back + n]
        out.append((key << _U(9)) | x[depth:])
    return np.concatenate(out)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after a shift by 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8.0
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the block probability of ``a`` zeros and ``b`` ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


class Nodes:
    """Nodes of one depth and bit level: sorted keys ``context << j | prefix``,
    counts, and (once weighed) ``log_beta``, own against children."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.keys, self.a, self.b = keys, a.astype(np.float64), b.astype(np.float64)
        self.log_beta: np.ndarray | None = None

    def weigh(self, below: np.ndarray | None) -> np.ndarray:
        """Log of the weighted probability; ``below`` is that of the children together."""
        own = log_kt(self.a, self.b)
        if below is None:
            return own
        self.log_beta = own - below
        return np.logaddexp(own, below) - np.log(2.0)

    def mix(self, keys: np.ndarray, bits: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of ``bits``: ``deeper`` (NaN where no longer context is
        known) mixed with the estimates of these nodes."""
        if not len(self.keys):
            return deeper
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        own = np.where(bits == 1, self.b[at], self.a[at]) + 0.5
        own /= self.a[at] + self.b[at] + 1.0
        if self.log_beta is None:
            mixed = own
        else:
            w = 1.0 / (1.0 + np.exp(-np.clip(self.log_beta[at], -700, 700)))
            mixed = np.where(np.isnan(deeper), own, w * own + (1.0 - w) * deeper)
        return np.where(self.keys[at] == keys, mixed, deeper)


def _level(keys: np.ndarray, counts: np.ndarray, j: int) -> Nodes:
    """Nodes of bit level ``j`` from sorted ``context << 9 | symbol`` keys."""
    if j:
        byte = (keys & _U(511)) < END
        keys, counts = keys[byte], counts[byte]
    if not len(keys):
        return Nodes(keys, counts, counts)
    prefix = keys >> _U(9 - j)
    ones = counts * ((keys >> _U(8 - j)) & _U(1)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
    total, b = np.add.reduceat(counts, starts), np.add.reduceat(ones, starts)
    return Nodes(prefix[starts], total - b, b)


def _parents(keys: np.ndarray, j: int) -> np.ndarray:
    """Keys of the nodes with one byte of context less."""
    return (keys >> _U(j + 8) << _U(j)) | (keys & _U((1 << j) - 1))


def _below(parent: Nodes, child: Nodes, weighted: np.ndarray, j: int) -> np.ndarray:
    at = np.searchsorted(parent.keys, _parents(child.keys, j))
    return np.bincount(at, weights=weighted, minlength=len(parent.keys))


class Subtrees:
    """All nodes with ``top`` bytes of context or more of some training keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        self.nodes: dict[tuple[int, int], Nodes] = {}
        self.weighted: list[np.ndarray] = []
        for d in range(depth, top - 1, -1):
            shorter = (keys >> _U(9 + 8 * (depth - d)) << _U(9)) | (keys & _U(511))
            kd, cd = _summed(shorter, counts)
            for j in range(9):
                self.nodes[d, j] = _level(kd, cd, j)
        for j in range(9):
            weighted = self.nodes[depth, j].weigh(None)
            for d in range(depth - 1, top - 1, -1):
                node = self.nodes[d, j]
                weighted = node.weigh(_below(node, self.nodes[d + 1, j], weighted, j))
            self.weighted.append(weighted)

    def mix(self, keys: np.ndarray, j: int, deeper: np.ndarray, low: int = 0) -> np.ndarray:
        bits = (keys >> _U(8 - j)) & _U(1)
        for d in range(self.depth, max(self.top, low) - 1, -1):
            node = (keys >> _U(9 + 8 * (self.depth - d)) << _U(j)) | ((keys & _U(511)) >> _U(9 - j))
            deeper = self.nodes[d, j].mix(node, bits, deeper)
        return deeper


class Top:
    """Nodes with one byte of context or none, from sums over all subtrees.
    ``rows``: ``j, node, a, b, below`` for one byte of context."""

    def __init__(self, j: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray):
        self.nodes: dict[tuple[int, int], Nodes] = {}
        for level in range(9):
            at = np.flatnonzero(j == level)
            at = at[np.argsort(node[at], kind="stable")]
            one = Nodes(node[at].astype(np.uint64), a[at], b[at])
            weighted = one.weigh(below[at])
            roots, inverse = np.unique(_parents(one.keys, level), return_inverse=True)
            root = Nodes(roots, np.bincount(inverse, weights=one.a, minlength=len(roots)),
                         np.bincount(inverse, weights=one.b, minlength=len(roots)))
            root.weigh(np.bincount(inverse, weights=weighted, minlength=len(roots)))
            self.nodes[1, level], self.nodes[0, level] = one, root

    def mix(self, keys: np.ndarray, j: int, deeper: np.ndarray, depth: int) -> np.ndarray:
        bits = (keys >> _U(8 - j)) & _U(1)
        prefix = (keys & _U(511)) >> _U(9 - j)
        for d in (1, 0):
            context = keys >> _U(9 + 8 * (depth - 1)) if d else np.zeros(len(keys), np.uint64)
            deeper = self.nodes[d, j].mix((context << _U(j)) | prefix, bits, deeper)
        return np.where(np.isnan(deeper), 0.5, deeper)


def log10_probabilities(keys: np.ndarray, subtrees: Subtrees, top: Top) -> np.ndarray:
    out = np.zeros(len(keys))
    byte = (keys & _U(511)) < END
    for j in range(9):
        k = keys if j == 0 else keys[byte]
        p = np.log10(top.mix(k, j, subtrees.mix(k, j, np.full(len(k), np.nan)), subtrees.depth))
        if j == 0:
            out += p
        else:
            out[byte] += p
    return out


def _word_key(hashes: np.ndarray) -> np.ndarray:
    return hashes << _U(1)


def _symbol_key(keys: np.ndarray) -> np.ndarray:
    return (keys << _U(1)) | _U(1)


def _unpacked(frames: pa.ChunkedArray):
    """``ids, train, texts`` (A-Z lower-cased) of a chunk, a few hundred texts at a time."""
    for column in frames.chunks:
        for frame in column:
            table = pa.ipc.open_stream(zstd.ZstdDecompressor().decompress(frame.as_py())).read_all()
            for start in range(0, table.num_rows, _TEXTS):
                part = table.slice(start, _TEXTS).combine_chunks()
                yield (part["id"], part["train"].to_numpy(zero_copy_only=False),
                       [body.lower() for body in texts(part["t"].combine_chunks())])


def _word_keys(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts (words, then one end each), and how many each has."""
    keys, sizes, at = [], [], 0
    while at < len(bodies):
        held, run = 0, []
        while at < len(bodies) and (not run or held + len(bodies[at]) < _RUN):
            run.append(bodies[at])
            held += len(bodies[at]) + 1
            at += 1
        data = np.frombuffer(b"\n".join(run).lower() + b"\n", dtype=np.uint8)
        space = _IS_SPACE[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        hashes = range_hashes(_BYTE_HASHES[data], starts, ends, _P1)
        # Words before the end of each text; the ends go in there.
        upto = np.searchsorted(starts, np.cumsum([len(b) + 1 for b in run]))
        keys.append(np.insert(hashes, upto, _END_TOKEN))
        sizes.append(np.diff(np.concatenate(([0], upto))) + 1)
    return (_word_key(np.concatenate(keys)), np.concatenate(sizes)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


def chunked(docs: DataFrame, train: Column, text: str, doc_id: str, chunk_bytes: int) -> DataFrame:
    """``chunk, docs``: frames of compressed texts with their ids and whether
    they are for training.  What a task reads of a chunk is compressed together."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))

    def pack(batches):
        compress = zstd.ZstdCompressor(level=3).compress
        for batch in batches:
            chunk = batch.column("chunk").to_numpy(zero_copy_only=False)
            order = np.argsort(chunk, kind="stable")
            firsts = np.flatnonzero(np.concatenate(([True], np.diff(chunk[order]) != 0))) if len(chunk) else []
            rows = batch.select(["id", "train", "t"])
            for part in np.split(order, firsts[1:]) if len(chunk) else ():
                sink = pa.BufferOutputStream()
                own = rows.take(pa.array(part))
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_batch(own)
                yield pa.RecordBatch.from_arrays([pa.array([int(chunk[part[0]])], pa.int64()),
                                                  pa.array([compress(sink.getvalue())], pa.binary())], names=["chunk", "docs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"),
                       F.col(text).cast("string").alias("t"),
                       F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")), F.lit(chunks)).alias("chunk"))
    return rows.mapInArrow(pack, "chunk long, docs binary")


def chunk_counts(rows: DataFrame, depth: int) -> str:
    """Name of a table ``key, chunk, n``, bucketed by key: per chunk and distinct
    word or symbol-in-context its training count."""
    spark = rows.sparkSession

    def count(data: pa.Table) -> pa.Table:
        chunk, sums = data["chunk"][0].as_py(), _Sums()
        for _, learn, bodies in _unpacked(data["docs"]):
            for flag in (True, False):
                own = [b for b, t in zip(bodies, learn) if t == flag]
                for keys in (_word_keys(own)[0], _symbol_key(contexts(own, depth))) if own else ():
                    keys, n = _counted(keys)
                    sums.add(keys, n if flag else np.zeros(len(keys), np.int64))
        keys, n = sums.total()
        return pa.table([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), chunk)), pa.array(n)],
                        names=["key", "chunk", "n"])

    counted = rows.groupBy("chunk").applyInArrow(count, "key long, chunk long, n long")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"context_counts_{uuid.uuid4().hex}"
    (counted.repartition(buckets, "key").write.bucketBy(buckets, "key").option("path", scratch_path(spark, "context-counts"))
            .option("compression", "zstd").saveAsTable(name))
    return name


def probabilities(symbols: DataFrame, depth: int, parts: int = SUBTREES) -> DataFrame:
    """``key, value``: log10 probability of every symbol-in-context of
    ``symbols`` (``key, n``; ``n`` 0 where only other texts have it), worked out
    in ``parts`` parts of the tree."""
    spec = "key long, value float"  # seven digits: half of what is sent

    def arrays(data: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = data["key"].to_numpy().view(np.uint64) >> _U(1)
        order = np.argsort(keys)
        return keys[order], data["n"].to_numpy()[order]

    def tree(data: pa.Table) -> Subtrees:
        keys, n = arrays(data)
        return Subtrees(keys[n > 0], n[n > 0], depth, 2)

    def summits(data: pa.Table) -> pa.Table:
        built, cols = tree(data), [[], [], [], [], []]
        for j in range(9):
            two = built.nodes[2, j]
            parent, inverse = np.unique(_parents(two.keys, j), return_inverse=True)
            for c, v in zip(cols, (np.full(len(parent), j, np.int64), parent.view(np.int64),
                                   *(np.bincount(inverse, weights=w, minlength=len(parent)).astype(np.float64)
                                     for w in (two.a, two.b, built.weighted[j])))):
                c.append(v)
        return pa.table([pa.array(np.concatenate(c)) for c in cols], names=["j", "node", "a", "b", "below"])

    last_two = F.shiftrightunsigned("key", 1 + 9 + 8 * (depth - 2))
    dealt = symbols.groupBy(F.pmod(F.xxhash64(last_two), F.lit(parts)).alias("part"))
    ones = (dealt.applyInArrow(summits, "j long, node long, a double, b double, below double")
            .groupBy("j", "node").agg(*[F.sum(c).alias(c) for c in ("a", "b", "below")]).toArrow())
    top = Top(*(ones[c].to_numpy() for c in ("j", "node", "a", "b", "below")))

    def solve(data: pa.Table) -> pa.Table:
        built, (keys, _) = tree(data), arrays(data)
        return pa.table([pa.array(_symbol_key(keys).view(np.int64)), pa.array(log10_probabilities(keys, built, top).astype(np.float32))],
                        names=["key", "value"])

    return dealt.applyInArrow(solve, spec)


def _sums(keys: np.ndarray, sizes: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Per text the sum of the values of its keys; looks every distinct key up once."""
    order = np.argsort(keys)
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    at = np.searchsorted(known, ranked[starts])
    if len(known) == 0 or at.max() >= len(known) or (known[at] != ranked[starts]).any():
        raise ValueError("a chunk lacks probabilities of its own symbols")
    out = np.empty(len(keys))
    out[order] = np.repeat(values[at], np.diff(np.concatenate((starts, [len(keys)]))))
    return np.add.reduceat(out, np.concatenate(([0], np.cumsum(sizes)[:-1])))


def score(docs: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH,
          chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte`` per row; learns from the rows for which ``train`` holds."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be between 2 and 6")
    rows = chunked(docs, train, text, doc_id, chunk_bytes)
    name = chunk_counts(rows, depth)
    counts = docs.sparkSession.table(name)
    is_symbol = F.col("key").bitwiseAND(F.lit(1)) == 1
    per_key = counts.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("chunks"))
    n_train, n_distinct = (per_key.where(~is_symbol).agg(F.sum("n"), F.count_if(F.col("n") > 0)).first())
    n_train, n_distinct = n_train or 0, n_distinct or 0
    parts = max(SUBTREES, -(-counts.count() // SUBTREE_KEYS))  # rows of the table, read from its footers
    solved = probabilities(per_key.where(is_symbol).select("key", "n"), depth, parts)
    # A word of one chunk alone needs no answer: the chunk has its count.
    # (Counts travel as they are, probabilities as floats.)
    answers = solved.withColumn("n", F.lit(None).cast("long")).unionByName(
        per_key.where(~is_symbol).where("chunks > 1").select("key", F.lit(None).cast("float").alias("value"), "n"))
    sent = counts.select("key", "chunk").join(answers, "key")

    def add_up(data: pa.Table, got: pa.Table) -> pa.Table:
        if not data.num_rows:
            return schema.empty_table()
        keys = got["key"].to_numpy().view(np.uint64)
        symbol = (keys & _U(1)) == 1
        known = []
        for own, column in ((symbol, "value"), (~symbol, "n")):
            values = got[column].filter(pa.array(own)).to_numpy()
            order = np.argsort(keys[own])
            known.append((keys[own][order], values[order].astype(np.float64)))
        del got, keys, symbol
        local = _Sums()  # training counts of this chunk
        for _, learn, bodies in _unpacked(data["docs"]):
            own = [b for b, t in zip(bodies, learn) if t]
            if own:
                local.add(*_counted(_word_keys(own)[0]))
        local = local.total()
        out = []
        for ids, learn, bodies in _unpacked(data["docs"]):
            words, sizes = _word_keys(bodies)
            lengths = np.array([len(b) + 1 for b in bodies], dtype=np.int64)
            scored = _sums(_symbol_key(contexts(bodies, depth)), lengths, *known[0])
            shared = _looked_up(words, *known[1], missing=-1)
            total = np.where(shared >= 0, shared, _looked_up(words, *local))
            firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            base = np.add.reduceat(np.log10((total + 1) / (n_train + n_distinct + 1)), firsts)
            seen = np.add.reduceat((total > 0).astype(np.int64), firsts)
            out.append(pa.table([ids, pa.array(learn), pa.array(sizes.astype(np.int64)), pa.array(seen),
                                 pa.array(np.full(len(sizes), n_train)), pa.array(base), pa.array(scored),
                                 pa.array(-scored / np.log10(2) / np.maximum(lengths - 1, 1))], schema=schema))
        return pa.concat_tables(out)

    schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                        ("bits_per_byte", pa.float64())])
    scores = written(rows.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(
        add_up, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                "score double, bits_per_byte double"), "scores")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return scores


def _looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, missing: float = 0.0) -> np.ndarray:
    if not len(known):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], missing).astype(np.float64)
