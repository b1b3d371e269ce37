"""Phrases whose words belong together, mined by Toivonen's method.

A phrase of ``k`` words can only be frequent if the two phrases of ``k - 1``
words inside it are.  A sample of the documents proposes frequent phrases; its
*negative border* are the phrases that are not among them although all their
parts are (every word is in it, having no parts).

1. The sample is counted and phrases seen ``lowered`` times in it are proposed.
2. A pass over all documents counts exactly what is proposed and what is in the
   border: all words, and every longer phrase whose parts are proposed.
3. Border phrases that turn out frequent are *failures*: they are added to the
   proposal, which widens the border, and another pass counts what is new in
   it.  Without failures the frequent phrases are complete.  Each failure
   makes phrases longer by a word countable, so there are at most
   ``max_words`` passes, whatever the sample was.

The proposals travel as one bitmap of ``2^sketch_bits`` bits per length: what is
broadcast is bounded, whatever the corpus.  Other phrases with the bit of a
proposed one count as proposed; they are counted as exactly as all others, so
this costs work and changes no result.  A phrase is counted in one pass: the
first whose bitmaps let it be.

Words are told apart by 64-bit hashes that include the language.  Counts are
combined in blocks of about 4 MB of text before they are shuffled by phrase, so
a phrase has at most one row per block and no task gets a language.

Defined cases: null texts are empty; a null language is ``und``; rows without an
id or with a repeated one are texts of their own; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .shingles import mix64
from .tokens import BREAK, WORD, blocks, classes, grouped, words_of

_U = np.uint64
#: Pieces end at ``[.,;:!?\x0A-\x0D]``, words at a space or a tab.
_BREAKS = frozenset(b".,;:!?\x0a\x0b\x0c\x0d")
_TABLE = classes((c for c in range(256) if c not in _BREAKS and c not in b" \t"), _BREAKS)
UNKNOWN = "und"
#: Rows that are handed to Spark together.
_ROWS = 1 << 15


@dataclass(frozen=True)
class Proposal:
    """Per length below ``max_words`` the bitmap of proposed phrases."""

    maps: tuple[np.ndarray, ...]
    bits: int

    def has(self, length: int, slots: np.ndarray) -> np.ndarray:
        at = (slots >> _U(64 - self.bits)).astype(np.int64)
        return (self.maps[length - 1][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def __or__(self, other: Proposal) -> Proposal:
        return Proposal(tuple(a | b for a, b in zip(self.maps, other.maps)), self.bits)

    def covers(self, other: Proposal) -> bool:
        return all(not (b & ~a).any() for a, b in zip(self.maps, other.maps))


def _rotation(i: int) -> int:
    return 21 * i % 64


def _slots(words: list[np.ndarray]) -> np.ndarray:
    """The number whose highest bits are a phrase's place in the bitmap; as :func:`_slot`."""
    out = words[0].copy()
    for i, w in enumerate(words[1:], 1):
        r = _rotation(i)
        out ^= (w << _U(r)) | (w >> _U((64 - r) % 64)) if r else w
    return out


def _slot(length: int) -> Column:
    out = F.col("w1")
    for i in range(1, length):
        w, r = F.col(f"w{i + 1}"), _rotation(i)
        out = out.bitwiseXOR(F.shiftleft(w, r).bitwiseOR(F.shiftrightunsigned(w, 64 - r)) if r else w)
    return out


def _names(max_words: int) -> list[str]:
    return [f"w{i}" for i in range(1, max_words + 1)]


def _counted(texts_of: DataFrame, max_words: int, now: Proposal | None, before: Proposal | None) -> DataFrame:
    """``k, w1.., lang, word, n`` by block: of the phrases of ``k`` words that
    ``now`` lets be counted and ``before`` did not.  Without ``now`` all
    phrases.  Without ``before`` also all words (``k`` 1, with ``lang`` and
    ``word``) and the words of each language (``k`` 0)."""
    names = _names(max_words)

    def rows_of(k: int, words: list[np.ndarray], n: np.ndarray, lang=None, word=None) -> Iterator[pa.RecordBatch]:
        """The rows of a block, some at a time: Spark holds a batch and not all of them."""
        size = len(n)
        zero = np.zeros(size, dtype=np.int64)
        columns = [w.view(np.int64) for w in words] + [zero] * (max_words - len(words))
        strings = [pa.nulls(size, pa.string()) if x is None else pa.array(x, pa.string()) for x in (lang, word)]
        whole = pa.RecordBatch.from_arrays([pa.array(np.full(size, k, np.int32)), *map(pa.array, columns), *strings, pa.array(n.astype(np.int64))],
                                           names=["k", *names, "lang", "word", "n"])
        yield from (whole.slice(low, _ROWS) for low in range(0, size, _ROWS))

    def eligible(k: int, words: np.ndarray, joined: np.ndarray, proposal: Proposal | None) -> np.ndarray:
        """Places where the two parts of a phrase of ``k`` words are proposed; a
        place is that of the first word, ``joined`` the places whose word has
        a successor in its piece."""
        size = len(words) - k + 1
        inside = np.ones(size, dtype=bool)
        for i in range(k - 1):
            inside &= joined[i:i + size]
        if proposal is not None:
            parts = proposal.has(k - 1, _slots([words[i:i + size + 1] for i in range(k - 1)]))
            inside &= parts[:-1] & parts[1:]
        return inside

    def run(batches):
        for bodies, rows in blocks(batches, "t"):
            languages = rows["lang"].to_pylist()
            for lang in sorted(set(languages)):
                block = b"\n".join(b for b, x in zip(bodies, languages) if x == lang).lower()
                words, starts, ends = words_of(block, _TABLE)
                if not len(words):
                    continue
                words = mix64(words ^ _U(xxhash.xxh3_64_intdigest(lang.encode())))
                breaks = np.cumsum(_TABLE[np.frombuffer(block, dtype=np.uint8)] == BREAK, dtype=np.int32)
                joined = breaks[starts[1:]] == breaks[starts[:-1]]
                if before is None:
                    order, first = grouped([words])
                    at, n = order[first], np.diff(np.concatenate((first, [len(order)])))
                    spelled = [block[s:e].decode("utf-8", "replace") for s, e in zip(starts[at].tolist(), ends[at].tolist())]
                    yield from rows_of(1, [words[at]], n, [lang] * len(at), spelled)
                    yield from rows_of(0, [], np.array([len(words)]), [lang], [""])
                for k in range(2, max_words + 1):
                    if len(words) < k:
                        break
                    new = eligible(k, words, joined, now)
                    if before is not None:
                        new &= ~eligible(k, words, joined, before)
                    places = np.flatnonzero(new)
                    if len(places):
                        parts = [words[places + i] for i in range(k)]
                        order, first = grouped(parts)
                        at, n = order[first], np.diff(np.concatenate((first, [len(order)])))
                        yield from rows_of(k, [p[at] for p in parts], n)

    columns = ", ".join(f"{c} long" for c in names)
    rows = texts_of.mapInArrow(run, f"k int, {columns}, lang string, word string, n long")
    key = ["k", *names, "lang", "word"]
    # The blocks are the map-side combine: most phrases of a block are in no
    # other block of the task, and a second table of them would only fill memory.
    return rows.repartition(*key).groupBy(*key).agg(F.sum("n").alias("n"))


def _proposal(frequent: DataFrame, max_words: int, bits: int) -> Proposal:
    """The bitmaps of the rows of ``frequent``: ``max_words - 1`` times
    ``2^bits`` bits reach the driver, whatever the number of rows."""
    maps = []
    for k in range(1, max_words):
        slot = F.shiftrightunsigned(_slot(k), 64 - bits)
        out = np.zeros(1 << bits >> 3, dtype=np.uint8)
        # bitmap functions number buckets from 1 and positions from 1
        got = (frequent.where(F.col("k") == k).select((slot + 1).alias("slot"))
               .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("map")).toArrow())
        for bucket, data in zip(got["bucket"].to_pylist(), got["map"]):
            part = np.frombuffer(data.as_buffer(), dtype=np.uint8)
            low = (bucket - 1) * len(part)
            out[low:low + len(part)] = part[:len(out) - low]
        maps.append(out)
    return Proposal(tuple(maps), bits)


def frequent_phrases(docs: DataFrame, support: int = 10, max_words: int = 3, text: str = "text", lang: str = "lang",
                     doc_id: str = "doc_id", sample: int = 16, lowered: int = 2, sketch_bits: int = 26) -> DataFrame:
    """``k, w1.., lang, word, n``: every phrase of 1 to ``max_words`` words with
    at least ``support`` occurrences in its language, exactly counted (``lang``
    and ``word`` for single words, unused places 0), and with ``k`` 0 the number
    of words of each language.  The sample is one document in ``sample``."""
    if max_words < 2 or not 16 <= sketch_bits <= 32:
        raise ValueError("phrases have two words or more, bitmaps 2^16 to 2^32 bits")
    texts_of = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                           F.col(f"`{text}`").cast("string").alias("t"),
                           (F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")), F.lit(sample)) == 0).alias("drawn"))
    drawn = _counted(texts_of.where("drawn").drop("drawn"), max_words, None, None)
    now = _proposal(written(drawn.where((F.col("k") > 0) & (F.col("k") < max_words) & (F.col("n") >= lowered)), "proposed"),
                    max_words, sketch_bits)
    everything, before, found = texts_of.drop("drawn"), None, None
    while True:
        counted = written(_counted(everything, max_words, now, before).where((F.col("k") == 0) | (F.col("n") >= support)), "phrases")
        found = counted if found is None else found.unionByName(counted)
        frequent = _proposal(found, max_words, sketch_bits)
        if now.covers(frequent):
            return found
        before, now = now, now | frequent


def _reaching(scored: DataFrame, levels: list[str], top: int) -> DataFrame:
    """Rows that fewer than ``top`` rows of their language are above, by
    ``levels`` descending.  Only the counts of distinct values are ranked: at
    most 10^6 + 1 scores per language, then those and the counts left of them."""
    above = Window.partitionBy("lang").orderBy(*[F.desc(c) for c in levels]).rowsBetween(Window.unboundedPreceding, -1)
    near = (scored.groupBy("lang", *levels).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("above", F.coalesce(F.sum("rows").over(above), F.lit(0))).where(F.col("above") < top))
    return scored.join(near.select("lang", *levels), ["lang", *levels], "left_semi")


def collocations(docs: DataFrame, top: int = 2_000, support: int = 10, max_words: int = 3, absorbed: int = 50, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: per language the ``top``
    phrases by the score of their weakest cut.

    ``a``, ``l`` and ``r`` count the phrase and the two sides of the cut, the
    score is ``floor(10^6 * a * a / (l * r))``, in exact decimals.  A phrase
    within a longer one that has at least ``absorbed`` percent of its count is
    left out."""
    found = frequent_phrases(docs, support, max_words, **options)
    names = _names(max_words)
    words = found.where("k = 1").select(F.col("w1").alias("w"), "lang", "word")
    counts = found.where("k > 0").select("k", *names, "n")
    phrases = counts.where("k > 1")

    def part(low: int, high: int) -> Column:
        """Words ``[low, high)`` of a phrase as columns of a phrase of their own."""
        return F.struct(F.lit(high - low).alias("k"), *[(F.col(f"w{low + i + 1}") if low + i < high else F.lit(0).cast("long")).alias(names[i])
                                                        for i in range(max_words)])

    cuts, inner = [], []
    for k in range(2, max_words + 1):
        here = phrases.where(F.col("k") == k)
        cuts.append(here.withColumn("cut", F.explode(F.array(*[
            F.struct(F.lit(j).alias("at"), part(0, j).alias("left"), part(j, k).alias("right")) for j in range(1, k)]))))
        spans = [(s, e) for s in range(k) for e in range(s + 2, k + 1) if e - s < k]
        if spans:
            inner.append(here.select(F.explode(F.array(*[part(s, e) for s, e in spans])).alias("x"), "n").select("x.*", "n"))
    key = ["k", *names]

    def side(name: str) -> DataFrame:
        return counts.select(*[F.col(c).alias(f"{name}_{c}") for c in key], F.col("n").alias(name[0]))

    cut = cuts[0]
    for other in cuts[1:]:
        cut = cut.unionByName(other)
    cut = cut.select(*key, F.col("n").alias("a"), F.col("cut.at").alias("at"),
                     *[F.col(f"cut.{s}.{c}").alias(f"{s}_{c}") for s in ("left", "right") for c in key])
    for s in ("left", "right"):
        cut = cut.join(side(s), [f"{s}_{c}" for c in key])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumn("square", (exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"))).withColumn("sides", exact("l") * exact("r"))
    scored = (cut.select(*key, "a", F.struct(F.expr("square div sides").cast("long").alias("score"), "at", "l", "r").alias("cut"))
              .groupBy(*key, "a").agg(F.min("cut").alias("cut")).select(*key, "a", "cut.score", "cut.l", "cut.r"))
    if inner:
        longer = inner[0]
        for other in inner[1:]:
            longer = longer.unionByName(other)
        longer = longer.groupBy(*key).agg(F.max("n").alias("longer"))
        scored = (scored.join(longer, key, "left")
                  .where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))).drop("longer"))
    scored = scored.join(words.select(F.col("w").alias("w1"), "lang"), "w1")

    likely = written(scored, "scores")
    for levels in (["score"], ["score", "a"]):  # ties at the end of the list are decided by spelling: they stay
        likely = _reaching(likely, levels, top)
    for name in names:
        likely = likely.join(words.select(F.col("w").alias(name), F.col("word").alias(f"{name}_word")), name, "left")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    listed = (likely.withColumn("phrase", F.concat_ws(" ", *[f"{name}_word" for name in names]))
              .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
    totals = found.where("k = 0").select("lang", F.col("n").alias("total"))
    return (listed.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                               F.col("total").alias("n"), "score"))
