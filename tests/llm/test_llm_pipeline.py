"""The pipeline stage by stage, each against brute force on what its predecessor kept."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import SCHEMA, clashing, corpus, documents, edge_rows, key, lines, near, sentence, sha, statistics, words

import corpus_pipeline
from llm import catalog, packing
from llm.mixing import TARGETS, word_count

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents (edge cases included) and labels."""
    rng, path = random.Random(9), str(tmp_path_factory.mktemp("tables"))
    rows = [(100 + i, t, "en" if i % 3 else "de", f"src{i % 9}", len(t)) for i, t in enumerate(corpus(120, 3))]
    rows += [(1_000 + i, " ".join(w + "$$$" for w in sentence(rng, 70).split()), "en", "src1", 0) for i in range(40)]
    rows += [(d, t, "en", s, n) for d, t, _, s, n in edge_rows(600)]
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    marks = [(r[0], int(r[0] < 1_000), 0) for r in rows if r[0] is not None and r[0] >= 100]
    spark.createDataFrame(marks + [(None, 1, 0), (101, None, 0)], LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, before, tables), name)
        assert docs.columns == columns and docs.schema == before.schema
        kept[name] = (rows_of(before), rows_of(docs))

    before, after = kept["quality_rules"]
    stats = [(d, t, statistics(t)) for d, t in before]
    fine = [(d, t) for d, t, s in stats if s[0] >= 50 and 100 * s[4] <= 50 * s[0] and s[2] < s[0]]
    assert Counter(after) == Counter(fine)

    before, after = kept["line_dedup"]
    gone = {sha(b" " * n) for n in range(9)} | {sha(b"\n" * n) for n in range(9)}  # what is left of copies
    want = Counter((d, digest) for d, _, dropped, digest in lines(before) if not (dropped and digest in gone))
    assert Counter((d, sha((t or "").encode())) for d, t in after) == want
    assert len(after) < len(before) and all(words(t) for _, t in after)

    before, after = kept["near_duplicates"]
    stay = [(d, t) for (d, t), (_, _, root) in zip(before, near(before, 5, 80)) if root == key(d)]
    assert Counter(after) == Counter(stay)

    before, after = kept["mixing"]
    assert set(after) <= set(before) and max(Counter(after).values()) <= 2 * max(Counter(before).values())
    tokens = lambda rows: sum(len((t or "").split()) for _, t in rows)
    assert 0.5 * tokens(before) < tokens(after) <= tokens(before) + 1

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    encode = packing._encoding(packing.default_vocabulary()).encode_ordinary
    want = Counter()
    for d, t in after:
        ids = [*encode(t or ""), 1]
        for s in range(0, len(ids), 2_048):
            want[d, s, zlib.crc32(np.array(ids[s:s + 2_048], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in pieces) == want


def test_run_is_the_stages(spark, tables):
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, tables), name)
    whole = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in df.collect())
    assert whole(corpus_pipeline.run(spark, tables)) == whole(docs)


def test_clashing_columns_and_empty_tables(spark, tables):
    empty = spark.createDataFrame([], SCHEMA)
    odd = clashing(documents(spark, edge_rows(300)))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables).collect() == [], name
        got = stage(spark, odd, tables)
        assert got.collect() is not None
        if name != "packing":
            assert got.columns == odd.columns, name


def test_every_numbered_query_is_registered(spark):
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(catalog.QUERIES) == set(names) and len(TARGETS) == 3 and word_count("text") is not None


def test_queries_run_on_the_smallest_tables(spark):
    for name, query in catalog.QUERIES.items():
        got = query(spark, "/root/testdata/sf0.001").collect()
        assert got, name
