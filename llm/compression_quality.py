"""Quality by compression: which of two dictionaries makes the text smaller?

One zstandard dictionary is built from texts labelled good and one from texts
labelled bad.  A text is compressed with both, in blocks of ``BLOCK`` bytes, so
that the dictionary and not the text's own past decides, however long the text
is.  The normalised size difference ``(bad - good) / (bad + good)`` goes through
a logistic curve fitted on labelled texts that are in neither dictionary.

The fit reads a bounded sample (``FIT_DOCS`` texts per class, the smallest
hashes of the id, texts of at most ``FIT_BYTES`` bytes); every text is scored
whole.  Only the text is an input of a score.

Defined cases: a null or empty text has difference 0; without labels of both
classes every score is the share of good labels (0.5 if there are none);
labels that contradict each other for one id, or are neither 0 nor 1, are
left out; rows that repeat an id get the same score for the same text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

#: Bounds of the fit: labelled texts per class, and bytes of each.
FIT_DOCS = 2_000
FIT_BYTES = 1 << 16
DICT_BYTES = 1 << 16
BLOCK = 256
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the logistic curve; a few hundred KB at most."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def compressors(self) -> list[zstd.ZstdCompressor]:
        return [_compressor(d) for d in (self.good, self.bad)]

    def score(self, diff: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * diff + self.intercept, -500, 500)))


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not content:
        return zstd.ZstdCompressor(**params)
    data = zstd.ZstdCompressionDict(content)
    data.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(dict_data=data, **params)


def _dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or the texts themselves when they are too few to train one."""
    blocks = [s[i:i + BLOCK] for s in samples for i in range(0, len(s), BLOCK)]
    try:
        return zstd.train_dictionary(size, blocks, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(samples)[-size:]


def difference(body: bytes, good: zstd.ZstdCompressor, bad: zstd.ZstdCompressor) -> float:
    """Normalised compressed-size difference; positive if the good dictionary fits better."""
    g = b = 0
    for i in range(0, len(body), BLOCK):
        part = body[i:i + BLOCK]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - g) / (b + g) if body else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """One-dimensional weighted logistic regression by Newton steps, lightly regularised."""
    scale = float(x.std()) or 1.0
    z, a, b = x / scale, 0.0, 0.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(weight * z * (p - y)).sum() + 1e-2 * a, (weight * (p - y)).sum()])
        hessian = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-9:
            break
    return a / scale, b


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, text: str = "text",
        doc_id: str = "doc_id", label: str = "quality", fit_docs: int = FIT_DOCS) -> CompressionModel:
    """Build the model from the labelled rows for which ``use`` (over ``id``) holds."""
    known = (labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
             .where("id IS NOT NULL AND y IN (0, 1)").groupBy("id")
             .agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2"))
    if use is not None:
        known = known.where(use)
    share = known.agg(F.avg("y")).first()[0]
    # Two limits of fit_docs rows: the sample is bounded before texts are read.
    ranked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(fit_docs) for y in (0, 1)]
    sample = ranked[0].unionByName(ranked[1])
    bodies = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).where(
        F.octet_length("t").between(1, FIT_BYTES))
    rows = (bodies.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("t").alias("t"), F.min("y").alias("y"))
            .orderBy(F.xxhash64("id"), "id").collect())
    return build([(r["t"].encode(), r["y"]) for r in rows], share)


def build(rows: list[tuple[bytes, int]], share: float | None = None) -> CompressionModel:
    """The model of labelled texts: two thirds of a class make its dictionary,
    the rest the curve (all of it, where a class has fewer than three texts).
    ``share`` is that of good labels among all labels; the sample holds as many
    texts of either class as it may, the curve weighs them back."""
    by = {y: [t for t, v in rows if v == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        share = (len(by[1]) + 1) / (len(rows) + 2)  # at one class or none
        return CompressionModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    parts = {y: (t[:-(len(t) // 3)], t[-(len(t) // 3):]) if len(t) >= 3 else (t, t) for y, t in by.items()}
    model = CompressionModel(_dictionary(parts[1][0]), _dictionary(parts[0][0]), 0.0, 0.0)
    pair = model.compressors()
    x = np.array([difference(t, *pair) for y in (0, 1) for t in parts[y][1]])
    y = np.repeat([0.0, 1.0], [len(parts[0][1]), len(parts[1][1])])
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    slope, intercept = _logistic(x, y, weight)
    return CompressionModel(model.good, model.bad, slope, intercept)


def score(docs: DataFrame, model: CompressionModel, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score; one with the name of the score is replaced."""
    cols = [c for c in docs.columns if c.lower() != column.lower()]
    schema = docs.select(*[F.col(f"`{c}`") for c in cols]).schema.add(column, "double")
    state: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.extend(model.compressors())
        diffs = np.array([difference(t, *state) for t in texts(batch.column(text))], dtype=np.float64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(model.score(diffs))],
                                          names=[*cols, column])

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in cols]), run, schema)
