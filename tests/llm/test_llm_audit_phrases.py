"""Filter audit, phrase mining and decontamination against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from llm_helpers import NO_ID, SCHEMA, clashing, corpus, documents, edge_rows, key, lower, sentence, sha, words
from pyspark.sql import functions as F

from llm import collocations as C
from llm import filter_audit as A
from llm import positional_index as P
from llm.tokens import blocks, grouped, words_of

LABELS = "doc_id long, quality int, toxic int"


def mixed_rows():
    rng = random.Random(4)
    rows = [(100 + i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 7 else None, 0) for i, t in enumerate(corpus(70, 5))]
    rows += [(300 + i, "SHOUT " * 60 + "#", "de", "", 0) for i in range(5)]
    rows += [(400 + i, sentence(rng, 80) + "; #1 % of it", "en", "src1", 0) for i in range(9)]
    return rows + edge_rows(600)


ROWS = mixed_rows()
MARKS = [(r[0], i % 2, int(i % 5 == 0)) for i, r in enumerate(ROWS) if i % 3] + [(1, 1, None), (1, None, 1), (None, 1, 1), (99_999, 1, 1)]


# --- filter audit --------------------------------------------------------------
def brute_audit(rows, marks, orders):
    first = {}
    for d, t, *_ in rows:
        first[t or ""] = min(first.get(t or "", NO_ID), key(d))
    good = {d for d, q, _ in marks if q == 1 and d is not None}
    toxic = {d for d, _, x in marks if x == 1 and d is not None}
    docs = []
    for d, t, _, s, _ in rows:
        t, w = t or "", words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": key(d) > first[t]}
        docs.append((s or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out, shapley = [], Counter()
    for part in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == part]
        for order in orders:
            for step, f in enumerate(order, 1):
                earlier = set(order[:step - 1])
                removed = [x for x in own if f in x[1] and not x[1] & earlier]
                shapley[part, f] += len(removed)
                out.append((part, order, step, sum(not x[1] & (earlier | {f}) for x in own), len(removed),
                            sum(f in x[1] and bool(x[1] & earlier) for x in own), sum(x[1] == {f} for x in own),
                            sum(x[2] for x in removed), sum(x[3] for x in removed)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit(spark):
    labels = spark.createDataFrame(MARKS, LABELS)
    got = A.audit_texts(clashing(documents(spark, ROWS)), labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    orders = ["".join(p) for p in permutations("ABCDE")]
    assert sorted(map(tuple, got.collect())) == brute_audit(ROWS, MARKS, orders)
    empty = spark.createDataFrame([], SCHEMA)
    assert A.audit_texts(empty, labels).collect() == []
    assert A.audit_texts(documents(spark, ROWS[:3]), labels.limit(0)).count() == 600 * len({r[3] or "" for r in ROWS[:3]})


def test_audit_of_some_orders(spark):
    """Orders bound by ``before``; a clashing part column; a mark that is null."""
    df = spark.createDataFrame([(i % 3 == 0, i % 2 == 0, i % 5 == 0, "p" if i % 4 else None) for i in range(60)], "x boolean, y boolean, z boolean, mask string")
    got = A.audit(df, {"one": F.col("x"), "two": F.col("y"), "three": F.when(F.col("z"), True)}, F.col("mask"), before=[("one", "two")])
    orders = [o for o in permutations(["one", "two", "three"]) if o.index("one") < o.index("two")]
    assert {r["filter_order"] for r in got.collect()} == {",".join(o) for o in orders}
    rows = [({n for n, v in zip(("one", "two", "three"), r) if v}, r["mask"] or "") for r in df.collect()]
    total = sum(bool("two" in s and not s & set(o[:o.index("two")])) for o in orders for s, p in rows if p == "p")
    assert {r["shapley"] for r in got.where("part = 'p'").collect() if r["filter_order"].split(",")[r["step"] - 1] == "two"} == {total}


def test_lattice_counts_paths():
    for n, before in ((1, ()), (4, ()), (5, [(0, 3), (3, 1)]), (6, [(5, 0)])):
        lattice = A.Lattice(n, before)
        orders = [o for o in permutations(range(n)) if all(o.index(a) < o.index(b) for a, b in before)]
        taken = Counter((sum(1 << f for f in o[:i]), f) for o in orders for i, f in enumerate(o))
        assert {(s, f): k for s, f, k in lattice.edges()} == taken
        assert len(lattice.orders()) == n * len(orders)
    with pytest.raises(ValueError):
        A.Lattice(3, [(0, 1), (1, 0)])
    with pytest.raises(ValueError):
        A.Lattice(8)


# --- phrases -------------------------------------------------------------------
def phrase_counts(rows, longest):
    counts = defaultdict(Counter)
    for _, t, lang, *_ in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", lower((t or "").encode())):
            w = re.findall(rb"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return counts


def brute_collocations(rows, support=10, longest=3, top=2000, absorbed=50):
    out = []
    for lang, f in phrase_counts(rows, longest).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        frequent = {g: a for g, a in f.items() if len(g) > 1 and a >= support}
        listed = []
        for g, a in frequent.items():
            score, _, l, r = min((1_000_000 * a * a // (f[g[:j]] * f[g[j:]]), j, f[g[:j]], f[g[j:]]) for j in range(1, len(g)))
            inside = any(100 * b >= absorbed * a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))
                         for h, b in frequent.items() if len(h) > len(g))
            if not inside:
                listed.append((-score, -a, b" ".join(g), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(listed)[:top], 1)]
    return sorted(out)


def prose(n=120, seed=11):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    idioms = ["in spite of", "New York City", "très bien sûr", "a b a b a", "kick the bucket now"]
    rows = []
    for i in range(n):
        parts = [rng.choice(idioms) if rng.random() < 0.2 else rng.choice(vocabulary[:10] if rng.random() < 0.6 else vocabulary) for _ in range(60)]
        rows.append((i, "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for p in parts), ["en", "de", None, "und"][i % 4 % (1 + i % 4)], "s", 0))
    return rows


@pytest.mark.parametrize("options", [{}, {"sample": 1}, {"sample": 1_000_000_007}, {"sample": 3, "lowered": 6, "sketch_bits": 16}])
def test_collocations(spark, options):
    rows = prose() + ROWS
    got = C.collocations(clashing(documents(spark, rows)), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows)


def test_longer_phrases_and_short_lists(spark):
    rows = prose(80, 12)
    got = C.collocations(documents(spark, rows), top=15, support=4, max_words=5, absorbed=80, sample=4)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 4, 5, 15, 80)


def test_phrases_of_nothing(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(documents(spark, [(1, None), (2, ""), (3, " . ,\n")])).collect() == []


def test_every_phrase_is_counted_once(spark):
    """Failures of the border bring further passes; each counts only what is new."""
    rows = prose(60, 13)
    found = C.frequent_phrases(documents(spark, rows), support=5, sample=1_000_000_007, sketch_bits=16).where("k > 0")
    assert found.count() == found.select("k", "w1", "w2", "w3").distinct().count()
    got = Counter(r["k"] for r in found.collect())
    want = Counter(len(g) for f in phrase_counts([(*r[:2], "en" if r[2] == "en" else r[2], *r[3:]) for r in rows], 3).values() for g, c in f.items() if c >= 5)
    assert got == want


# --- positional index -----------------------------------------------------------
TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return TOKEN.findall(lower((t or "").encode()))


def brute_leaks(rows, items, size=10):
    wanted = defaultdict(set)
    for item, t in items:
        w = tokens(t)
        k = min(size, len(w))
        for i in range(len(w) - k + 1) if k else ():
            wanted[tuple(w[i:i + k])].add("" if item is None else str(item))
    out = []
    for d, t, *_ in rows:
        w, hit, ids = tokens(t), set(), set()
        for k in {len(x) for x in wanted}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in wanted:
                    hit.update(range(i, i + k))
                    ids |= wanted[tuple(w[i:i + k])]
        out.append((d, len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit)))
    return sorted(out, key=repr)


def leaky():
    rng = random.Random(21)
    items = [(i, sentence(rng, 30)) for i in range(12)] + [(2, "two Words"), (50, "lonely"), (51, None), (52, " ?! "), (None, "x1 x2 x3"),
             (53, "the " * 14), (54, sentence(rng, 9)), (55, "Äpfel ßind güt"), (56, "a b a b a b a b a b a b")]
    rows = []
    for i in range(60):
        body = sentence(rng, rng.randrange(5, 90), 60)
        t = items[i % 12][1].split(" ")
        if i % 3 == 0:
            body += " -- " + ", ".join(t[rng.randrange(0, 10):rng.randrange(12, 31)]).upper() + " " + sentence(rng, 5)
        if i % 11 == 0:
            body = "the the " * rng.randrange(1, 30) + body + " lonely two, words: TWO words"
        rows.append((i, body))
    rows += [(100 + i, "a b " * (4 + i)) for i in range(4)] + [(r[0], r[1]) for r in edge_rows(900)] + [(None, items[3][1]), (7, items[3][1])]
    return rows, items


def test_decontamination(spark):
    rows, items = leaky()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1)).withColumn("terms", F.lit("z"))
    got = P.decontaminate(clashing(documents(spark, rows)), bench)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_leaks(rows, items)
    assert P.decontaminate(spark.createDataFrame([], SCHEMA), bench).collect() == []
    clean = P.decontaminate(documents(spark, rows), bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["contaminated"] or r["n_hit"] for r in clean)


@pytest.mark.parametrize("slop", [0, 3])
def test_near(spark, slop):
    rng = random.Random(31)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 40)))) for i in range(40)]
    phrases = [["a"], ["a", "b"], ["c", "a", "c"], ["d", "e", "f", "g"], ["a", "zzz"]]
    wanted = spark.createDataFrame([(i, P.term_hashes(" ".join(p).encode()).view(np.int64).tolist()) for i, p in enumerate(phrases)], "phrase long, terms array<long>")
    index = P.PositionalIndex.build(documents(spark, rows))
    got = index.near(wanted, slop).join(index.documents, ["block", "slot"])
    want = set()
    for d, t in rows:
        w = tokens(t)
        for i, p in enumerate(phrases):
            need = {x.encode() for x in p}
            spans = [(s, e) for s in range(len(w)) for e in range(s + 1, min(len(w), s + len(p) + slop) + 1) if need <= set(w[s:e])]
            want |= {(i, d, s, e) for s, e in spans if not any((a, b) != (s, e) and s <= a and b <= e for a, b in spans)}
    assert {(r["phrase"], r["doc_id"], r["start"], r["end"]) for r in got.collect()} == want


def test_blocks_and_words():
    import pyarrow as pa
    from llm import tokens as T
    table = T.classes(b"abcdefghijklmnopqrstuvwxyz")
    long = b" ".join([b"ab", b"c" * 70_000, b"de"] * 3 + [b"x"] * 50_000)
    h, s, e = words_of(long, table)
    assert [long[a:b] for a, b in zip(s, e)] == long.split() and len({*h.tolist()}) == 4 and len(words_of(b" ", table)[0]) == 0
    batch = pa.record_batch({"t": ["ab", None, "", "c" * 50, "d"] * 200, "i": list(range(1_000))})
    got = [(bodies, rows) for bodies, rows in blocks([batch, batch], "t", 300)]
    assert [x for b, _ in got for x in b] == [b"ab", b"", b"", b"c" * 50, b"d"] * 400
    assert [x for _, r in got for x in r["i"].to_pylist()] == [*range(1_000)] * 2 and max(sum(map(len, b)) for b, _ in got) < 400
    rng = np.random.Generator(np.random.PCG64(1))
    cols = [rng.integers(0, 9, 500).astype(np.uint64) for _ in range(2)]
    order, first = grouped(cols)
    n = np.diff(np.append(first, 500))
    assert Counter(zip(*(c.tolist() for c in cols))) == {tuple(int(c[order[f]]) for c in cols): int(k) for f, k in zip(first, n)}
