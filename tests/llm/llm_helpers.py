"""Fixtures and brute-force versions for the tests of the training-data operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

NO_ID = (1 << 63) - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").encode())


def lower(b: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def sentence(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdeXYZé')}{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(n=60, seed=1):
    """Texts with shared passages, near and exact copies, repeated lines and periodic stretches."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 75), "The same line, again and again"
    out = []
    for i in range(n):
        kind = rng.randrange(7)
        body = sentence(rng, rng.randrange(20, 160))
        if kind == 0 and out:
            body = rng.choice(out)
        elif kind == 1 and out:
            parts = rng.choice(out).split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            body = " ".join(parts)
        elif kind == 2:
            body = body + "\n" + passage + " " + sentence(rng, 30)
        elif kind == 3:
            body = f"{line}\n{body}\n  {line.upper()}\t\n{line}"
        elif kind == 4:
            body = " ".join(["la", "lu"] * rng.randrange(30, 90)) + " " + body
        elif kind == 5:
            body = body + " " + passage[:rng.randrange(150, 400)]
        out.append(body)
    return out


#: Null and empty texts, white space alone, a null id, repeated rows, one id
#: with two texts, ties and a long text.
def edge_rows(long_words=4_000, seed=2):
    rng = random.Random(seed)
    shared = sentence(rng, 120)
    long_text = sentence(rng, long_words)
    rows = [(1, shared), (2, None), (3, ""), (4, " \t\n\x0b "), (5, shared), (5, shared), (None, shared), (None, "only " + shared),
            (7, "one"), (8, "two words"), (9, "two words"), (10, long_text), (11, long_text + " end"), (12, "Äpfel ßind güt " * 40),
            (13, "first text of an id " * 12), (13, "second text of an id " * 12), (-3, shared + " negative"), (14, "x" * 5000),
            (15, "a b " * 300)]
    return [(d, t, "en", f"src{i % 5}", None if t is None else len(t)) for i, (d, t) in enumerate(rows)]


def documents(spark, rows):
    rows = [r if len(r) == 5 else (r[0], r[1], "en", f"src{i % 7}", len(r[1] or "")) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clashing(df):
    """``df`` with extra columns that are named as columns inside the operators."""
    for name in ("d", "f", "h", "sh", "z", "n_words", "n_lines", "kept", "score", "rank", "drop", "Kept_Text", "train", "chunk",
                 "k1", "epoch", "component", "word_stats", "_d", "_mix_d", "bands"):
        df = df.withColumn(name, F.lit("x"))
    return df


def key(d):
    return NO_ID if d is None else d


# --- brute force -------------------------------------------------------------------
def passages(rows, window=50):
    first = {}
    for d, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            first[k] = min(first.get(k, NO_ID), key(d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < key(d):
                gone[p:p + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def strings(rows, window=200):
    seen = Counter()
    bodies = [(d, (t or "").encode()) for d, t in rows]
    for _, b in bodies:
        seen.update(b[p:p + window] for p in range(len(b) - window + 1))
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if seen[b[p:p + window]] > 1:
                gone[p:p + window] = b"\1" * window
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def lines(rows, least=10):
    held = defaultdict(set)
    split = [(d, (t or "").encode().split(b"\n")) for d, t in rows]
    norm = lambda x: lower(x.strip(b" \t\n\x0b\x0c\r"))
    for d, ls in split:
        for x in ls:
            if len(norm(x).decode()) >= least:
                held[norm(x)].add(key(d))
    out = []
    for d, ls in split:
        left = [x for x in ls if len(held.get(norm(x), ())) < 2 or min(held[norm(x)]) == key(d)]
        out.append((d, len(ls), len(ls) - len(left), sha(b"\n".join(left))))
    return out


def shingles(t, k=3):
    w = lower((t or "").encode()).split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(rows, k=3, percent=85):
    """Per row: set size and the smallest id of its component (rows linked by their own texts)."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), NO_ID), key(d))
    return [(d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)]


def statistics(t):
    t = t or ""
    w = [x.decode() for x in words(t)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    ls = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered)


def same(got, want):
    """Equal as multisets, nulls included."""
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got) == order(want)
