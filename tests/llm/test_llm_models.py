"""Language model, classifier, rules and search: against brute force, held-out accuracy and recall."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import SCHEMA, clashing, corpus, documents, edge_rows, lower, sentence, statistics, words
from pyspark.sql import functions as F

from llm import compression_quality, context_tree, multi_index, quality_rules
from llm.catalog import held_out

CORPUS = list(enumerate(corpus(60, 4)))
EDGES = [(r[0], r[1]) for r in edge_rows(800)]


# --- context-tree weighting ----------------------------------------------------------
def brute_tree(train, texts, depth):
    """Bit by bit, with dictionaries: log10 probability of each text."""
    counts = {}

    def steps(text):
        padded = [0] * depth + list(text) + [256]
        for i in range(depth, len(padded)):
            context, symbol = tuple(padded[i - depth:i][::-1]), padded[i]
            for j in range(1 if symbol == 256 else 9):
                yield context, j, symbol >> (9 - j), (symbol >> (8 - j)) & 1

    for text in train:
        for context, j, prefix, bit in steps(text):
            for d in range(depth + 1):
                counts.setdefault((context[:d], j, prefix), [0, 0])[bit] += 1
    kt = lambda n: math.lgamma(n[0] + .5) + math.lgamma(n[1] + .5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    weighted, beta = {}, {}
    children = {}
    for node in sorted(counts, key=lambda n: -len(n[0])):
        own = kt(counts[node])
        if len(node[0]) == depth:
            weighted[node] = own
        else:
            below = children[node]
            beta[node] = own - below
            weighted[node] = np.logaddexp(own, below) - math.log(2)
        if node[0]:
            parent = (node[0][:-1], *node[1:])
            children[parent] = children.get(parent, 0.0) + weighted[node]
    out = []
    for text in texts:
        total = 0.0
        for context, j, prefix, bit in steps(text):
            p = None
            for d in range(depth, -1, -1):
                node = (context[:d], j, prefix)
                if node in counts:
                    own = (counts[node][bit] + .5) / (sum(counts[node]) + 1)
                    if p is None or node not in beta:
                        p = own
                    else:
                        w = 1 / (1 + math.exp(-beta[node])) if beta[node] > -700 else 0.0
                        p = w * own + (1 - w) * p
            total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


@pytest.mark.parametrize("rows", [CORPUS[:25], EDGES])
def test_context_tree(spark, rows):
    learn = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 != 2 or d is None
    bodies = [lower((t or "").encode()) for _, t in rows]
    train = [b for (d, _), b in zip(rows, bodies) if learn(d)]
    tokens = [words(b.decode()) + [None] for b in bodies]
    count = Counter(w for (d, _), ws in zip(rows, tokens) if learn(d) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((d is None, d or 0, len(ws), sum(count[w] > 0 for w in ws), n,
                   sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), s)
                  for (d, _), ws, s in zip(rows, tokens, brute_tree(train, bodies, 3)))
    got = context_tree.score(clashing(documents(spark, rows)), ~held_out("doc_id", 7), depth=3, chunk_bytes=6_000).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"],
                  r["score"]) for r in got)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-6)  # probabilities travel as floats


def test_capitals_change_no_score_and_no_table_is_left(spark):
    texts = ["Hello world, HELLO WORLD again. " * 20, "ÄPFEL and Äpfel"]
    rows = [(i, t) for i, t in enumerate([*texts, *map(str.lower, texts)] * 3)] + [(100, "HELLO WORLD AGAIN"), (101, "hello world again")]
    before = {t.name for t in spark.catalog.listTables()}
    got = {r["doc_id"]: r for r in context_tree.score(documents(spark, rows), F.col("doc_id") < 100).collect()}
    assert got[100]["score"] == got[101]["score"] and got[100]["base_score"] == got[101]["base_score"] and got[100]["score"] > -20
    assert {t.name for t in spark.catalog.listTables()} == before


def test_parts_of_the_tree_change_no_score(spark, monkeypatch):
    docs = documents(spark, CORPUS[:12])
    scores = lambda: sorted((r["doc_id"], r["score"]) for r in context_tree.score(docs, ~held_out("doc_id", 7), depth=3).collect())
    want = scores()
    monkeypatch.setattr(context_tree, "SUBTREE_KEYS", 50)
    assert np.allclose(want, scores(), rtol=1e-6)


def test_context_tree_probabilities_add_up():
    rng = np.random.Generator(np.random.PCG64(1))
    keys, n = context_tree._counted(context_tree.contexts([bytes(rng.integers(97, 101, 200).tolist()) for _ in range(5)], 3))
    tree = context_tree.Subtrees(keys, n, 3, 0)
    for context in (b"abc", b"zzz", b"aaz"):
        start = int(context_tree.contexts([context], 3)[-1]) & ~511
        all_symbols = np.array([start | s for s in range(257)], dtype=np.uint64)
        total = np.zeros(257)
        for j in range(9):
            at = all_symbols if j == 0 else all_symbols[:256]
            p = tree.mix(at, j, np.full(len(at), np.nan))
            total[:len(at)] += np.log(np.where(np.isnan(p), 0.5, p))
        assert abs(np.exp(total).sum() - 1) < 1e-9


def test_context_tree_learns(spark):
    docs = documents(spark, [(i, sentence(random.Random(i), 200, 8)) for i in range(60)])
    got = context_tree.score(docs, ~held_out("doc_id", 7)).where("NOT train").collect()
    assert got and np.mean([r["bits_per_byte"] for r in got]) < 4


def test_context_tree_without_training(spark):
    got = context_tree.score(documents(spark, [(1, "ab"), (2, None)]), F.lit(False)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(2, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert np.allclose([r["score"] for r in got], [19 * math.log10(.5), math.log10(.5)])
    assert context_tree.score(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 100.5, 1e6])
    assert np.allclose(context_tree.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


# --- quality ---------------------------------------------------------------------------
def labelled(n=400, seed=3):
    rng = np.random.Generator(np.random.PCG64(seed))
    rows, labels = [], []
    for i in range(n):
        good = bool(rng.random() < 0.8)
        text = sentence(random.Random(i), 80)
        if not good:
            text = (" ".join(w + "%%%" for w in text.split()) if i % 2 else " | ".join(text.split()))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_rules_statistics_are_brute_force(spark):
    rows = CORPUS + EDGES
    got = quality_rules.judge(clashing(documents(spark, rows)), []).collect()
    by = lambda xs: sorted(xs, key=repr)
    failed = lambda s: s[0] < 50 or 100 * s[4] > 50 * s[0]
    want = [(d, *statistics(t), failed(statistics(t)), not failed(statistics(t))) for d, t in rows]
    assert by(tuple(r[c] for c in ("doc_id", *quality_rules.BASE, "base_failed", "kept")) for r in got) == by(want)


def test_rules_are_learned_and_keep_clean_texts(spark):
    rows, labels = labelled()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(docs, marks)
    assert rules
    fresh, truth = labelled(300, 77)
    fresh = [(i, t.replace("a1", "q")) for i, t in fresh]
    kept = {r["doc_id"] for r in quality_rules.keep_good(documents(spark, fresh), rules).collect()}
    assert kept == {i for i, good, _ in truth if good}
    docs = clashing(documents(spark, fresh))
    assert quality_rules.keep_good(docs, rules).columns == docs.columns


def test_rules_without_usable_labels(spark):
    rows, _ = labelled(30)
    docs = documents(spark, rows)
    for marks in ([], [(1, 1, 0), (1, 0, 0), (None, 0, 0), (2, None, 0), (3, 5, 0)], [(i, 1, 0) for i in range(30)]):
        assert quality_rules.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")) == []
    assert quality_rules.judge(spark.createDataFrame([], SCHEMA), []).collect() == []


def test_classifier_held_out(spark):
    rows, labels = labelled()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = compression_quality.fit(docs, marks, ~held_out("id", 4))
    got = {r["doc_id"]: r["score"] for r in compression_quality.score(clashing(docs), model).collect()}
    test = [(got[i], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.7) == bool(y) for s, y in test]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())


def test_scores_by_the_plain_two_dictionary_loop(spark):
    """Every score again: block by block with both dictionaries, then the curve."""
    import zstandard as zstd
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["click", "buy", "now", "free!!"] if i % 2 else ["the", "river", "ran", "past", "stone"]) for _ in range(rng.randrange(1, 300))))
            for i in range(120)] + EDGES
    docs = documents(spark, rows)
    marks = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(0, 120, 2)] + [(i, 0, 0) for i in range(1, 90, 3)], "doc_id long, quality int, toxic int")
    model = compression_quality.fit(docs, marks.where("doc_id > 20"))

    def size(body, content):
        options = dict(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        box = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content), **options)
        return sum(len(box.compress(body[i:i + 256])) for i in range(0, len(body), 256))

    def plain(text):
        body = (text or "").encode()
        good, bad = size(body, model.good), size(body, model.bad)
        x = (bad - good) / (bad + good) if body else 0.0
        return 1 / (1 + math.exp(-(model.slope * x + model.intercept)))

    got = compression_quality.score(docs, model).select("text", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(plain(r["text"]), abs=1e-12)


def test_classifier_edge_cases(spark):
    docs = clashing(documents(spark, EDGES))
    marks = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, 1, 0), (8, 0, 0), (None, 1, 0), (3, None, 0)],
                                  "doc_id long, quality int, toxic int")
    for labels in (marks, marks.where("false"), marks.where("quality = 1")):
        got = compression_quality.score(docs, compression_quality.fit(docs, labels)).select("doc_id", "text", "score").collect()
        assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if not r["text"]}) == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert compression_quality.score(empty, compression_quality.fit(empty, marks)).collect() == []


# --- the verdict of learned rules ------------------------------------------------------
def test_learned_verdicts_by_hand(spark):
    """The learned list applied text by text, with statistics taken anew."""
    rng = random.Random(14)
    good = [(i, sentence(rng, rng.randrange(60, 140)) + rng.choice(["", "!", " A Few Capitals"])) for i in range(160)]
    bad = [(1_000 + i, " ".join(w + rng.choice(["###", "$", "|"]) for w in sentence(rng, 80).split())) for i in range(60)]
    bad += [(2_000 + i, (sentence(rng, 70)).upper() + "!!! " * 20) for i in range(60)]
    docs = documents(spark, good + bad)
    rules = quality_rules.fit(docs, spark.createDataFrame([(d, int(d < 1_000), 0) for d, _ in good + bad], "doc_id long, quality int, toxic int"))
    assert rules
    rows = good + bad + EDGES

    def features(t):
        t = t or ""
        n, chars, symbols, dup, repeat = statistics(t)
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        upper, marks = sum("A" <= c <= "Z" for c in t), sum(c in "!?" for c in t)
        per = max(n, 1)
        return (n < 50 or 100 * repeat > 50 * n), {
            "symbols_per_word": symbols / per, "mean_word_chars": chars / per, "dup_line_share": dup / max(len(lines), 1),
            "repeat_share": repeat / per, "upper_share": upper / max(chars, 1), "marks_per_word": marks / per,
            "distinct_share": len(set(w)) / per, "words": float(n)}

    def verdict(t):
        failed, f = features(t)
        rejected = any(all((f[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)
        return not failed and not rejected

    got = quality_rules.judge(documents(spark, rows), rules).select("doc_id", "kept").collect()
    order = lambda x: sorted(x, key=repr)
    assert order(map(tuple, got)) == order((d, verdict(t)) for d, t in rows)
    assert {verdict(t) for _, t in good} == {True} and not any(verdict(t) for _, t in bad)


# --- multi-index -----------------------------------------------------------------------
def brute_nearest(rows, k):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-float(np.add.reduce(np.array(v, float) * np.array(u, float))), i) for i, u in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_recall_on_clusters_and_ties(spark):
    rng = np.random.Generator(np.random.PCG64(9))
    centres = rng.normal(size=(12, 16))
    unit = lambda v: (v / np.linalg.norm(v)).astype(np.float32).tolist()
    rows = [(i, unit(centres[i % 12] + 0.3 * rng.normal(size=16))) for i in range(900)]
    rows += [(900 + i, rows[40][1]) for i in range(60)]  # many equal vectors
    got = {}
    for r in multi_index.nearest(vectors(spark, [(*r, 0) for r in rows]), F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute_nearest(rows, 20)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [i for i, _ in (got[40][r] for r in range(1, 21))] == list(range(900, 920))
    full = multi_index.nearest(vectors(spark, [(*r, 0) for r in rows]), F.col("id") % 20 == 0, share=1.0).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in full} == {
        (q, n): pair for q, pairs in want.items() for n, pair in enumerate(pairs, 1)}


def test_split_blocks_and_chunks_give_the_same(spark, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(2))
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    monkeypatch.setattr(multi_index, "BLOCK", 7)
    monkeypatch.setattr(multi_index, "CHUNK", 4)
    got = multi_index.nearest(vectors(spark, [(*r, 0) for r in rows]), F.col("id") % 20 == 0, k=5, share=1.0).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == {
        (q, n): pair for q, pairs in brute_nearest(rows, 5).items() for n, pair in enumerate(pairs, 1)}


def test_vectors_are_sent_to_the_chunks_that_visit_them(spark, monkeypatch):
    """Rows sent follow the inner products, not vectors times queries."""
    rng = np.random.Generator(np.random.PCG64(12))
    centres = 4 * rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + 0.1 * rng.normal(size=8)).tolist(), 0) for i in range(4_000)]
    sent, inner = [], multi_index._sent

    def noted(*args):
        out = inner(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(multi_index, "_sent", noted)
    monkeypatch.setattr(multi_index, "BLOCK", 50)
    monkeypatch.setattr(multi_index, "CHUNK", 4)
    got = multi_index.nearest(vectors(spark, rows), F.col("id") % 20 == 0, share=0.02).collect()
    assert len(got) == 200 * 20
    # 200 queries make 50 chunks; a query visits at least 201 vectors, in blocks of about 50
    assert sent[0] <= 4_000 + 200 * 600 / 4


def test_recall_on_the_registered_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in table.select("vec_id", "embedding").collect()]
    want = brute_nearest(rows, 20)
    got = {}
    for r in multi_index.nearest(table, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len({i for i, _ in want[q]} & got[q]) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_few_vectors_are_all_candidates(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(35)]
    got = multi_index.nearest(vectors(spark, [(*r, 0) for r in rows]), F.col("id") % 20 == 0).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == {
        (q, n): pair for q, pairs in brute_nearest(rows, 20).items() for n, pair in enumerate(pairs, 1)}


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [None, 1.0]), (None, [1.0, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (1, [0.5, 0.5]), (20, [0.0, 0.0]), (40, None)]
    got = multi_index.nearest(clashing(vectors(spark, [(*r, 0) for r in rows])), F.col("id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.5)]
    assert multi_index.nearest(vectors(spark, [(0, None, 0)]), F.col("id") % 20 == 0).collect() == []


def test_traversal_is_in_order():
    rng = np.random.Generator(np.random.PCG64(4))
    d1, d2 = rng.random(6), rng.random(7)
    order = multi_index.traverse(d1, d2, np.ones(42, dtype=int), 42)
    sums = [d1[c // 7] + d2[c % 7] for c in order]
    assert sorted(order) == list(range(42)) and sums == sorted(sums)
    assert list(itertools.accumulate(sums, max)) == sums
