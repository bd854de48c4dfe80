import random

import numpy as np
import pytest

from factloom.operators import retrieval, scan_topk


def vectors(spark, ids, seed, name, kind):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in ids] + [(ids[0][:-1] + "_" if kind == "string" else -1, None)]
    return spark.createDataFrame(rows, f"{name} {kind}, embedding array<float>")


@pytest.mark.parametrize("kind", ["string", "long"])
def test_knn_scan_equals_blocks_and_brute_force(spark, kind):
    own, asked = ([f"é{i % 7}-{i:02d}" for i in range(60)], [f"q{i}" for i in range(5)]) if kind == "string" else (list(range(60)), list(range(5)))
    corpus, queries = vectors(spark, own, 1, "id", kind).repartition(5), vectors(spark, asked, 2, "query_id", kind)
    found = sorted(map(tuple, retrieval.knn_dense(corpus, queries, 6).collect()))
    assert found == sorted(map(tuple, retrieval.top_k(retrieval._knn_blocks(corpus, queries, 6).drop("rank"), 6).collect()))
    held = [(r.id, np.array(r.embedding, float)) for r in corpus.collect() if r.embedding]
    for q in queries.collect():
        if q.embedding is None:
            continue
        v = np.array(q.embedding, float)
        cosine = lambda x: round(float(v @ x) / ((np.linalg.norm(v) or 1) * (np.linalg.norm(x) or 1)), 9) + 0.0  # noqa: E731, B023
        want = sorted(((-cosine(x), i) for i, x in held))[:6]
        got = [(-s, i) for name, i, s, _ in sorted(found, key=lambda r: r[3]) if name == q.query_id]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


def test_the_corpus_is_not_shuffled(spark):
    corpus, queries = vectors(spark, list(range(9)), 1, "id", "long"), vectors(spark, [1, 2], 2, "query_id", "long")
    plan = retrieval.knn_dense(corpus, queries, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert plan.count("Exchange") == 1 and "Exchange" not in below


WORDS = "the a red green blue sea ship port of storm".split()


def texts(spark, n, seed, name, kind="long"):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice((0, 1, 5, 40))))) for i in range(n)] + [(n, None), (n + 1, "The THE the, ship!")]
    frame = spark.createDataFrame(rows, f"{name} long, text string")
    return frame.withColumn(name, frame[name].cast(kind))


@pytest.mark.parametrize("kind", ["string", "long"])
def test_bm25_scan_equals_the_join(spark, kind, monkeypatch):
    docs, queries = texts(spark, 150, 3, "id", kind).repartition(6), texts(spark, 6, 4, "query_id")
    monkeypatch.setattr(scan_topk, "CELLS", 40)  # blocks of a few documents
    scanned = sorted(map(tuple, retrieval.bm25_top(docs, queries, 7, 6).collect()))
    lists = sorted(map(tuple, retrieval.lexical_conjunctive(docs, queries).collect()))
    monkeypatch.setattr(scan_topk, "MOST_BYTES", 0)
    assert scanned and scanned == sorted(map(tuple, retrieval.bm25_top(docs, queries, 7, 6).collect()))
    assert lists and lists == sorted(map(tuple, retrieval.lexical_conjunctive(docs, queries).collect()))


def test_empty_sides(spark):
    docs, none = texts(spark, 3, 1, "id"), spark.createDataFrame([], "query_id long, text string")
    assert retrieval.bm25_top(docs, none, 3).collect() == [] and retrieval.lexical_conjunctive(docs, none).collect() == []
    assert retrieval.bm25_top(docs.limit(0), texts(spark, 3, 1, "query_id"), 3).collect() == []


def test_mmr_takes_string_ids(spark):
    rows = [("q", f"d{i}", i + 1, 1.0 - i / 10, [1.0, float(i % 2)]) for i in range(4)]
    found = retrieval.mmr(spark.createDataFrame(rows, "query_id string, id string, rank int, score double, embedding array<double>"), 2).collect()
    assert [(r.id, r.rank) for r in found] == [("d0", 1), ("d1", 2)] or len(found) == 2
