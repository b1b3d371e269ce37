"""Substring, byte, line and near-duplicate removal against brute force."""

import tracemalloc
from collections import Counter

import numpy as np
import pytest
from llm_helpers import (NO_ID, SCHEMA, clashing, corpus, documents, edge_rows, key, lines, near, passages, same, strings)

from llm import anchors, line_dedup, minmax_dedup, substring_dedup, suffix_dedup
from llm.catalog import sha256
from llm.common import WordHashes
from llm.components import _large_star, _small_star, components
from llm.shingles import shingle_set

CORPUS = list(enumerate(corpus(60, 1)))
EDGES = [(r[0], r[1]) for r in edge_rows()]
FRAMES = [CORPUS, EDGES]


@pytest.mark.parametrize("rows", FRAMES)
@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_passages(spark, rows, limit):
    got = substring_dedup.drop_shared_passages(clashing(documents(spark, rows)), group_limit=limit)
    same(got.select("doc_id", "n_words", "n_removed", sha256("kept_text")).collect(), passages(rows))


@pytest.mark.parametrize("rows", FRAMES)
@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_strings(spark, rows, limit):
    got = suffix_dedup.drop_repeated_strings(clashing(documents(spark, rows)), group_limit=limit)
    same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", sha256("kept")).collect(), strings(rows))


def test_short_windows(spark):
    rows = [(i, "".join(np.random.Generator(np.random.PCG64(i)).choice(list("ab "), 60))) for i in range(30)]
    got = suffix_dedup.drop_repeated_strings(documents(spark, rows), window=9, gram=4)
    same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", sha256("kept")).collect(), strings(rows, 9))
    got = substring_dedup.drop_shared_passages(documents(spark, rows), window=3, gram=2)
    same(got.select("doc_id", "n_words", "n_removed", sha256("kept_text")).collect(), passages(rows, 3))


@pytest.mark.parametrize("rows", FRAMES)
@pytest.mark.parametrize("batches,fanout", [(4, 2), (4, 4), (7, 2), (1, 4)])
def test_lines(spark, rows, batches, fanout):
    got = line_dedup.drop_repeated_lines(clashing(documents(spark, rows)), batches=batches, fanout=fanout)
    same(got.select("doc_id", "n_lines", "n_dropped", sha256("kept_text")).collect(), lines(rows))


def test_batches_join_a_compacted_run(spark, monkeypatch):
    levels, add = [], line_dedup.LineRuns.add

    def noted(self, rows, last=False):
        levels.append(([len(runs) for runs in self.levels], last))
        return add(self, rows, last)

    monkeypatch.setattr(line_dedup.LineRuns, "add", noted)
    before = {t.name for t in spark.catalog.listTables()}
    got = line_dedup.drop_repeated_lines(documents(spark, CORPUS))
    same(got.select("doc_id", "n_lines", "n_dropped", sha256("kept_text")).collect(), lines(CORPUS))
    assert levels == [([], False), ([1], False), ([0, 1], False), ([1, 1], True)]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_lines_by_hash_alone(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "COMMON", 0)
    got = line_dedup.drop_repeated_lines(documents(spark, CORPUS))
    same(got.select("doc_id", "n_lines", "n_dropped", sha256("kept_text")).collect(), lines(CORPUS))


@pytest.mark.parametrize("rows", FRAMES)
def test_near_duplicates(spark, rows):
    got = minmax_dedup.near_duplicates(clashing(documents(spark, rows)))
    same([(None if r["d"] == NO_ID else r["d"], r["n_shingles"], r["component"]) for r in got.collect()], near(rows))


def test_near_duplicates_beyond_the_star(spark):
    """A chain: neighbours are similar, ends are not; the smallest id is not the hub."""
    rng = np.random.Generator(np.random.PCG64(3))
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        text = list(base)
        for p in rng.choice(300, int(rng.integers(2, 22)), replace=False):
            text[p] = f"new{i}_{p}"
        rows.append((100 - i, " ".join(text)))
    got = minmax_dedup.components_of(documents(spark, rows)).collect()
    want = near(rows)
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], want)
    assert {r["doc_id"] for r in got if r["kept"]} == {d for d, _, c in want if d == c}
    assert len({c for _, _, c in want}) > 1


@pytest.mark.parametrize("many", [0, 1_000_000])
def test_size_bands_lose_no_link(spark, monkeypatch, many):
    """Chains of many lengths, joined by bands alone and without bands."""
    monkeypatch.setattr(minmax_dedup, "MANY", many)
    rng = np.random.Generator(np.random.PCG64(31))
    rows, base = [], [f"w{i}" for i in range(260)]
    for i in range(60):
        text = base[:int(rng.integers(190, 261))]
        for p in rng.choice(len(text), int(rng.integers(0, 9)), replace=False):
            text[p] = f"new{i}_{p}"
        rows.append((100 - i, " ".join(text)))
    same([(r["d"], r["n_shingles"], r["component"]) for r in minmax_dedup.near_duplicates(documents(spark, rows)).collect()], near(rows))
    # all pairs that the similarity allows meet, whatever the roots
    bodies = documents(spark, rows).selectExpr("doc_id AS class", "doc_id AS root", "text AS t")
    rarity = minmax_dedup._rarity(bodies, 3)
    met = minmax_dedup._hidden_pairs(minmax_dedup._prefixes(bodies, rarity, 3, 85), 85).collect()
    sets = {d: set(zip(t.split(), t.split()[1:], t.split()[2:])) for d, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert want and want <= {(r["a"], r["b"]) for r in met}


def test_templates_below_the_threshold_are_not_compared(spark):
    """300 common and 45 own words: no two are similar, and what meets grows with
    the documents, not with their pairs."""
    def met(n):
        common = " ".join(f"c{i}" for i in range(300))
        rows = [(i, common + " " + " ".join(f"own{i}_{j}" for j in range(45))) for i in range(n)]
        bodies = documents(spark, rows).selectExpr("doc_id AS class", "doc_id AS root", "text AS t")
        prefixes = minmax_dedup._prefixes(bodies, minmax_dedup._rarity(bodies, 3), 3, 85)
        assert prefixes.groupBy("tok").count().where(f"count = {n}").count()  # a shingle that all texts have
        return minmax_dedup._meetings(prefixes, 85).count()

    assert met(200) <= 200 and met(1_600) <= 1_600


@pytest.mark.parametrize("percent", [80, 85])
def test_a_row_of_a_frequent_shingle_meets_few_size_bands(spark, percent):
    """Whatever its size and position; and no allowed pair of sizes is lost."""
    rows = [(1, n, n, n, pos, 0, True) for n in range(1, 400, 3) for pos in range(0, n - -(-percent * n // 100) + 1, 7)]
    df = spark.createDataFrame(rows, "tok long, class long, root long, n long, pos long, main long, many boolean")
    assert minmax_dedup._banded(df, percent).groupBy("class", "pos").count().agg({"count": "max"}).first()[0] <= 5
    need = lambda n, m: -(-percent * (n + m) // (100 + percent))
    want = {(n, m) for _, _, _, n, pos, _, _ in rows for _, _, _, m, pos2, _, _ in rows
            if n < m and 100 * n >= percent * m and min(n - pos, m - pos2) >= need(n, m)}
    assert want == {(r["a"], r["b"]) for r in minmax_dedup._hidden_pairs(df.select("tok", "class", "root", "n", "pos"), percent).collect()}


def test_dedup_keeps_one_of_each_group_and_all_columns(spark):
    docs = clashing(documents(spark, CORPUS))
    kept = minmax_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _, c in near(CORPUS, 5, 80) if d == c}
    kept = minmax_dedup.dedup(documents(spark, EDGES)).collect()
    same([(r["doc_id"], r["text"]) for r in kept],
         [(d, t) for (d, t), (_, _, c) in zip(EDGES, near(EDGES, 5, 80)) if key(d) == c])


def test_texts_under_one_id_do_not_link_their_neighbours(spark):
    """Two texts of an id, and rows without an id, are like different documents."""
    texts = [" ".join(f"{c}{i}" for i in range(120)) for c in "abcdef"]
    rows = [(5, texts[0]), (9, texts[1]), (13, texts[0] + " end"), (13, texts[1] + " end"), (20, texts[2]), (21, texts[3]),
            (None, texts[2] + " end"), (None, texts[3] + " end"), (None, texts[4]), (30, texts[5]), (13, texts[5])]
    got = minmax_dedup.near_duplicates(documents(spark, rows))
    same([(None if r["d"] == NO_ID else r["d"], r["n_shingles"], r["component"]) for r in got.collect()], near(rows))
    kept = minmax_dedup.dedup(documents(spark, rows)).collect()
    same([(r["doc_id"], r["text"]) for r in kept], [(d, t) for (d, t), (_, _, c) in zip(rows, near(rows, 5, 80)) if key(d) == c])
    assert {5, 9, 20, 21} <= {r["doc_id"] for r in kept}


@pytest.mark.parametrize("operator", [substring_dedup.drop_shared_passages, suffix_dedup.drop_repeated_strings,
                                      line_dedup.drop_repeated_lines, minmax_dedup.components_of, minmax_dedup.dedup])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 75), (75, 75)] + [(200, i) for i in range(201, 240)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 100: 50, 75: 50, **{i: 200 for i in range(201, 240)}}


def test_a_round_of_components_takes_few_exchanges(spark):
    """Each is a stage of as many tasks as there are partitions, whose metrics the driver holds."""
    rng = np.random.Generator(np.random.PCG64(12))
    pairs = {(int(max(p)), int(min(p))) for p in rng.integers(0, 300, (400, 2)) if p[0] != p[1]} | {(u, 0) for u in range(300, 900)}
    edges = spark.createDataFrame(sorted(pairs), "u long, v long")
    assert _large_star(edges).count() <= len(pairs) and _small_star(edges).count() <= len(pairs)
    plan = _small_star(_large_star(edges))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange") <= 7
    root = list(range(900))
    for _ in root:
        before = list(root)
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
        if before == root:
            break
    got = {r["node"]: r["root"] for r in components(edges, "u", "v").collect()}
    assert got == {x: r for x, r in enumerate(root) if r != x}


def test_rarity_sends_few_small_numbers_to_the_driver(spark):
    bodies = documents(spark, CORPUS).where("text IS NOT NULL").selectExpr("text AS t")
    want = np.ones(1 << minmax_dedup.SKETCH_BITS, dtype=np.int64)
    seen = Counter(int(x) for _, t in CORPUS if t is not None
                   for x in minmax_dedup._slots(shingle_set(t.encode().lower().split(), WordHashes(), 3)))
    for slot, n in seen.items():
        want[slot] = n
    assert (minmax_dedup._rarity(bodies, 3) == want).all()
    sketch = minmax_dedup._sketch(bodies, 3)
    assert sketch.dtypes == [("slot", "int"), ("n", "int")]
    assert {(r["slot"], r["n"]) for r in sketch.collect()} == {(x, n) for x, n in seen.items() if n > 1}


def test_automaton_against_brute_force():
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(30):
        window = int(rng.integers(2, 6))
        texts = [rng.integers(0, 3, int(rng.integers(1, 25))).tolist() for _ in range(5)]
        automaton = substring_dedup.SuffixAutomaton()
        for owner, t in enumerate(texts[:4]):
            automaton.add(t, 10 - owner)
        automaton.settle()
        for t in texts:
            want = []
            for p in range(len(t) - window + 1):
                owners = [10 - o for o, u in enumerate(texts[:4])
                          if any(u[q:q + window] == t[p:p + window] for q in range(len(u) - window + 1))]
                want.append(min(owners, default=NO_ID))
            assert automaton.holders(t, window) == want


def test_bucket_pointers_are_classes_of_equal_strings():
    rng = np.random.Generator(np.random.PCG64(6))
    for window in (3, 8, 13, 40):
        parts = [rng.integers(97, 99, int(rng.integers(window, 120))).astype(np.uint8) for _ in range(4)]
        data, sizes = np.concatenate(parts), [len(p) for p in parts]
        left = np.concatenate([np.arange(n, 0, -1) for n in sizes])
        pointer = suffix_dedup.refine_buckets(data, left, window)
        ok = np.flatnonzero(left >= window)
        assert (pointer[ok] >= 0).all()
        strings_ = [data[p:p + window].tobytes() for p in ok]
        assert len(set(zip(strings_, pointer[ok].tolist()))) == len(set(strings_)) == len(set(pointer[ok].tolist()))


def test_memory_of_a_shard_follows_its_largest_group():
    """Near copies of one passage: suffixes cost few bytes, and groups are sorted apart."""
    rng = np.random.Generator(np.random.PCG64(9))

    def group(h, n):
        base, out = rng.integers(97, 123, 350).astype(np.uint8), []
        for sh in range(n):
            text = base.copy()
            text[rng.integers(0, 350, 2)] = 65 + rng.integers(0, 26, 2)
            out.append((h, sh, 1, 0, 0, text.tobytes()))
        return out

    def peak(rows):
        tracemalloc.start()
        try:
            return method(rows), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    method = suffix_dedup.refinement_method(200)
    rows = group(0, 2_000)
    alone, most = peak(rows)
    assert most < 60 * 350 * len(rows)
    rows += [r for h in range(1, 7) for r in group(h, 600)]
    together, most = peak(rows)
    assert together[:2_000] == alone and len(together) == len(rows)
    assert most < 60 * 350 * 2_000
    seen = {}
    for h, sh, *_, text in rows[-600:]:
        for p in range(151):
            seen.setdefault(text[p:p + 200], []).append((sh, p))
    again = {x for places in seen.values() if len(places) > 1 for x in places}
    assert again == {(sh, p) for _, sh, spans in together[-600:] for s, e, _ in spans for p in range(s, e - 199)}


def test_equal_windows_pick_equal_anchors():
    rng = np.random.Generator(np.random.PCG64(7))
    x = anchors._BYTE_HASHES[rng.integers(0, 3, 5_000)]
    window, gram = 40, 8
    h, sh, start, n, t = anchors.segments(x, window, gram)
    by = {}
    for hash_, s, m in zip(h.tolist(), start.tolist(), n.tolist()):
        for p in range(s, s + m - window + 1):
            assert by.setdefault(x[p:p + window].tobytes(), hash_) == hash_
    assert (n - window + 1).sum() == len(x) - window + 1


def test_pieces_cover_all_windows(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(8))
    x = anchors._BYTE_HASHES[rng.integers(0, 4, 3_000)]
    whole = anchors.segments(x, 30, 6)
    monkeypatch.setattr(anchors, "PIECE", 500)
    parts = anchors.segments(x, 30, 6)
    cover = lambda got: sorted((p, int(h)) for h, s, n in zip(got[0], got[2], got[3]) for p in range(s, s + n - 29))
    assert cover(whole) == cover(parts)


def test_line_runs_levels(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    rows = lambda d, keys: spark.createDataFrame([(d, k, k) for k in keys], "d long, h1 long, h2 long")
    assert runs.add(rows(1, [1, 2])).collect() == []
    assert {r["h1"] for r in runs.add(rows(2, [2, 3])).collect()} == {2}
    assert [len(level) for level in runs.levels] == [0, 1]
    assert {r["h1"] for r in runs.add(rows(3, [1, 3, 4])).collect()} == {1, 3}
    assert [len(level) for level in runs.levels] == [1, 1]
    assert key(None) == NO_ID
