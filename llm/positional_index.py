"""Benchmark decontamination with a positional inverted index of the corpus.

``PositionalIndex.build`` stores, for every block of documents (about 4 MB of
text) and every term in it, the sorted list of the term's positions, and for
every document its place in its block.  A position is ``slot << 32 | word``:
the document's number in the block and the word's in the document, so a phrase
never reaches into the next document.

Phrases are looked up by intersecting lists:

1. the lists of the terms that phrases name are picked once; what the corpus
   lacks a term of is out;
2. each phrase starts from its rarest term: its positions, less the term's
   offset in the phrase, are where the phrase may start;
3. those starts, moved by the offset of the second rarest term, are intersected
   with that term's list of the same block; then the same with all others.

An intersection is keyed by term and block, so no term of the corpus, however
frequent, is in one task, and a list is read once however many phrases ask for
it.  ``near`` finds stretches that hold all words of a phrase in any order.

Defined cases: null and empty texts have no words; items without words have no
windows and items of one id are one item, a null id is the empty string; each
row of the corpus has a result of its own; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, texts, written
from .tokens import blocks, classes, grouped, words_of

#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
_TABLE = classes([*b"0123456789", *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)])
_WORD = (1 << 32) - 1


def term_hashes(body: bytes) -> np.ndarray:
    return words_of(body.lower(), _TABLE)[0]


@dataclass(frozen=True)
class PositionalIndex:
    """``postings``: ``term, block, n, at`` (sorted positions); ``documents``:
    ``block, slot, doc_id, n_words``, one row per row of the corpus."""

    postings: DataFrame
    documents: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> PositionalIndex:
        types = {"block": pa.int64(), "term": pa.int64(), "n": pa.int32(), "at": pa.list_(pa.int64()), "slot": pa.int32(),
                 "doc_id": pa.int64(), "n_words": pa.int64()}

        def rows(block: int, size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, block)) if c == "block" else columns.get(c, pa.nulls(size, t)) for c, t in types.items()],
                names=list(types))

        def index(batches):
            for number, (bodies, own) in enumerate(blocks(batches, "t")):
                block = TaskContext.get().partitionId() << 32 | number
                whole = b"\n".join(bodies).lower()
                terms, starts, _ = words_of(whole, _TABLE)
                ends = np.cumsum([len(b) + 1 for b in bodies])
                upto = np.searchsorted(starts, ends)  # words before the end of each text
                sizes = np.diff(upto, prepend=0)
                slots = np.arange(len(bodies))
                if len(terms):
                    places = (np.repeat(slots, sizes) << 32) | (np.arange(len(terms)) - np.repeat(upto - sizes, sizes))
                    order, first = grouped([terms])
                    n = np.diff(np.concatenate((first, [len(order)])))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate((first, [len(order)])).astype(np.int32)), pa.array(places[order]))
                    yield rows(block, len(first), term=pa.array(terms[order[first]].view(np.int64)), n=pa.array(n.astype(np.int32)), at=lists)
                yield rows(block, len(bodies), slot=pa.array(slots.astype(np.int32)), n_words=pa.array(sizes.astype(np.int64)),
                           doc_id=own["doc_id"].combine_chunks())

        stored = written(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
                         .mapInArrow(index, "block long, term long, n int, at array<long>, slot int, doc_id long, n_words long"), "index")
        return cls(stored.where("term IS NOT NULL").select("term", "block", "n", "at"),
                   stored.where("term IS NULL").select("block", "slot", "doc_id", "n_words"))

    def _lists(self, words: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The lists of the terms of ``words``, and ``term, total``: how often
        the corpus has each of them."""
        lists = written(self.postings.join(words.select("term").distinct(), "term"), "lists")
        return lists, lists.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("total"))

    def phrases(self, wanted: DataFrame) -> DataFrame:
        """``phrase, block, start``: where each row of ``wanted`` (``phrase``,
        distinct; ``terms``, its words as :func:`term_hashes`) occurs."""
        words = wanted.select("phrase", F.posexplode("terms").alias("off", "term"))
        lists, totals = self._lists(words)
        plans = written(words.join(totals, "term").groupBy("phrase")
                        .agg(F.sort_array(F.collect_list(F.struct("total", "off", "term"))).alias("plan"))
                        .join(wanted.select("phrase", F.size("terms").alias("size")), "phrase")
                        .where(F.size("plan") == F.col("size")), "plans")

        term = lambda i: F.get("plan", F.lit(i))
        seeds = plans.select("phrase", term(0)["term"].alias("term"), term(0)["off"].alias("off"),
                             term(1)["term"].alias("term2"), term(1)["off"].alias("off2"))
        found = (lists.join(seeds, "term").select("phrase", "block", F.explode("at").alias("p"), "off", "term2", "off2")
                 .where(F.col("p").bitwiseAND(F.lit(_WORD)) >= F.col("off"))
                 .select("phrase", "block", (F.col("p") - F.col("off")).alias("start"), "term2", "off2"))
        single = found.where("term2 IS NULL").select("phrase", "block", "start")
        pairs = written(self._at(lists, found.where("term2 IS NOT NULL")
                                 .select("phrase", "block", "start", F.col("term2").alias("term"), (F.col("start") + F.col("off2")).alias("p")))
                        .select("phrase", "block", "start"), "pairs")
        rest = (pairs.join(plans.where("size > 2"), "phrase")
                .select("phrase", "block", "start", "size", F.explode(F.slice("plan", F.lit(3), F.col("size"))).alias("x"))
                .select("phrase", "block", "start", "size", "x.term", (F.col("start") + F.col("x.off")).alias("p")))
        whole = (self._at(lists, rest).groupBy("phrase", "block", "start", "size").agg(F.count(F.lit(1)).alias("met"))
                 .where(F.col("met") == F.col("size") - 2).select("phrase", "block", "start"))
        two = pairs.join(plans.where("size = 2").select("phrase"), "phrase", "left_semi")
        return single.unionByName(two).unionByName(whole)

    @staticmethod
    def _at(lists: DataFrame, asked: DataFrame) -> DataFrame:
        """The rows of ``asked`` (with ``term, block, p``) whose term is at ``p``."""
        wanted = asked.groupBy("term", "block").agg(F.collect_set("p").alias("wanted"))
        there = (lists.join(wanted, ["term", "block"])
                 .select("term", "block", F.explode(F.array_intersect("wanted", "at")).alias("p")))
        return asked.join(there, ["term", "block", "p"], "left_semi")

    def near(self, wanted: DataFrame, slop: int) -> DataFrame:
        """``phrase, block, slot, start, end``: the shortest stretches ``[start,
        end)`` of at most ``size + slop`` words that hold every distinct word of
        a phrase of ``size`` words, in any order."""
        words = wanted.select("phrase", F.size("terms").alias("size"), F.explode(F.array_distinct("terms")).alias("term"))
        lists, totals = self._lists(words)
        plans = written(words.join(totals, "term").groupBy("phrase", "size")
                        .agg(F.sort_array(F.collect_list(F.struct("total", "term"))).alias("plan"))
                        .join(wanted.select("phrase", F.size(F.array_distinct("terms")).alias("distinct")), "phrase")
                        .where(F.size("plan") == F.col("distinct")), "plans")
        first = (lists.join(plans.select("phrase", "size", "distinct", F.get("plan", F.lit(0))["term"].alias("term")), "term")
                 .select("phrase", "size", "distinct", "block", F.explode("at").alias("p")))
        reach = F.col("size") + F.lit(slop - 1)
        alone = first.where("distinct = 1").select("phrase", "size", "distinct", "block", "p", F.array("p").alias("at"))
        others = (first.where("distinct > 1").join(plans.select("phrase", F.explode(F.slice("plan", 2, 1 << 30)).alias("x")), "phrase")
                  .select("phrase", "size", "distinct", "block", "p", "x.term"))
        # Positions of other documents of the block are 2^32 away.
        met = (others.join(lists.select("term", "block", "at"), ["term", "block"])
               .withColumn("at", F.filter("at", lambda x: F.abs(x - F.col("p")) <= reach)).where(F.size("at") > 0))
        met = (met.groupBy("phrase", "size", "distinct", "block", "p").agg(F.collect_list("at").alias("lists"))
               .where(F.size("lists") == F.col("distinct") - 1)
               .select("phrase", "size", "block", "p", "lists"))
        met = met.unionByName(alone.select("phrase", "size", "block", "p", F.array("at").alias("lists")))

        def shortest(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for phrase, size, block, p, near_by in zip(*(batch.column(c).to_pylist() for c in ("phrase", "size", "block", "p", "lists"))):
                for low in sorted({x for at in near_by for x in at if x <= p} | {p}):
                    # the stretch from low on: of each word its next place (p itself is the rarest word's)
                    following = [min((x for x in at if x >= low), default=None) for at in near_by]
                    if None in following:
                        continue
                    high = max(p, *following)
                    if high - low < size + slop:
                        out.append((phrase, block, low >> 32, low & _WORD, (high & _WORD) + 1))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)],
                                              names=["phrase", "block", "slot", "start", "end"])

        spans = map_batches(met, shortest, "phrase long, block long, slot long, start long, end long").distinct()
        # A stretch is left out if one inside it holds the words too: one that
        # starts no earlier and ends no later.
        later = Window.partitionBy("phrase", "block", "slot").orderBy(F.desc("start"), "end").rowsBetween(Window.unboundedPreceding, -1)
        return (spans.withColumn("inner", F.min("end").over(later))
                .where(F.col("inner").isNull() | (F.col("end") < F.col("inner"))).drop("inner"))


def windows(items: DataFrame, size: int = 10, text: str = "text", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """``phrase, terms`` (distinct) and ``phrase, item``: all ``size`` consecutive
    words of an item, or all its words if it has fewer."""
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, lists = [], []
        for item, body in zip(batch.column("item").to_pylist(), texts(batch.column("t"))):
            terms = term_hashes(body).view(np.int64)
            k = min(size, len(terms))
            if k:
                seen = np.unique(np.lib.stride_tricks.sliding_window_view(terms, k), axis=0)
                ids += [item] * len(seen)
                lists += seen.tolist()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lists, pa.list_(pa.int64()))], names=["item", "terms"])

    rows = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("string").alias("t"))
    every = written(map_batches(rows, cut, "item string, terms array<long>").distinct(), "windows")
    distinct = written(every.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    return distinct, every.join(distinct, "terms").select("phrase", "item").distinct()


def _covered(matches: DataFrame, size: Column) -> DataFrame:
    """``block, slot, n_hit``: words of each document in any of its matches."""
    rows = (matches.select("block", F.shiftright("start", 32).cast("int").alias("slot"), F.col("start").bitwiseAND(F.lit(_WORD)).alias("s"), size.alias("size"))
            .groupBy("block", "slot", "s").agg(F.max("size").alias("size")))
    before = Window.partitionBy("block", "slot").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("s") + F.col("size")
    return (rows.withColumn("upto", F.greatest("s", F.coalesce(F.max(end).over(before), F.lit(0))))
            .groupBy("block", "slot").agg(F.sum(F.greatest(end - F.col("upto"), F.lit(0))).alias("n_hit")))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", doc_id: str = "doc_id",
                  item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per row
    of ``docs``: its words inside any occurrence of ``size`` consecutive words
    of an item (or of a whole shorter item), and the items that occur."""
    index = PositionalIndex.build(docs, text, doc_id)
    wanted, owners = windows(items, size, item_text, item_id)
    matches = written(index.phrases(wanted).join(wanted.select("phrase", F.size("terms").alias("size")), "phrase"), "matches")
    hit = _covered(matches, F.col("size"))
    there = (matches.select("phrase", "block", F.shiftright("start", 32).cast("int").alias("slot")).distinct()
             .join(owners, "phrase").groupBy("block", "slot").agg(F.sort_array(F.collect_set("item")).alias("items")))
    ids = F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",")
    return (index.documents.join(hit, ["block", "slot"], "left").join(there, ["block", "slot"], "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
