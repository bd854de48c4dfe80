"""More questions than a table of terms by questions holds are still asked in scans of the corpus."""

import random

import pytest

from factloom.operators import retrieval, scan_topk


def texts(spark, n, seed, name, kind="long", size=12):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 700}" for _ in range(rng.choice((0, 1, size))))) for i in range(n)] + [(n, None)]
    frame = spark.createDataFrame(rows, f"{name} long, text string")
    return frame.withColumn(name, frame[name].cast(kind))


@pytest.mark.parametrize("kind", ["string", "long"])
@pytest.mark.parametrize("bytes_at_once", [1 << 14, 3000])
def test_bm25_of_many_questions_is_scanned(spark, monkeypatch, kind, bytes_at_once):
    """90 questions with some hundred terms: a table of these is too large, what they ask for is not; 3000 bytes take several scans."""
    docs, queries = texts(spark, 200, 1, "id", kind, 40).repartition(5), texts(spark, 90, 2, "query_id")
    monkeypatch.setattr(scan_topk, "MOST_BYTES", bytes_at_once)
    monkeypatch.setattr(scan_topk, "CELLS", 900)
    scanned = scan_topk.bm25(docs, queries, 5, retrieval.K1, retrieval.B, 6)
    assert scanned is not None
    found = sorted(map(tuple, retrieval.bm25_top(docs, queries, 5, 6).collect()))
    monkeypatch.setattr(scan_topk, "MOST_BYTES", 0)
    assert len(found) > 200 and found == sorted(map(tuple, retrieval.bm25_top(docs, queries, 5, 6).collect()))


@pytest.mark.parametrize("kind", ["string", "long"])
@pytest.mark.parametrize("bytes_at_once", [1 << 14, 3000])
def test_conjunctive_search_of_many_questions_is_scanned(spark, monkeypatch, kind, bytes_at_once):
    docs, queries = texts(spark, 200, 1, "id", kind, 40).repartition(5), texts(spark, 90, 2, "query_id", "long", 4)
    queries = queries.unionByName(docs.selectExpr("cast(id as long) + 1000 as query_id", "text").where("text <> ''"))  # all words of a document
    monkeypatch.setattr(scan_topk, "MOST_BYTES", bytes_at_once * 8)
    monkeypatch.setattr(scan_topk, "CELLS", 700)
    assert scan_topk.holding_all(docs, queries) is not None
    pairs = sorted(map(tuple, retrieval.lexical_conjunctive(docs, queries).collect()))
    counts = sorted(map(tuple, retrieval.conjunctive_counts(docs, queries).collect()))
    monkeypatch.setattr(scan_topk, "MOST_BYTES", 0)
    assert len(pairs) > 100 and pairs == sorted(map(tuple, retrieval.lexical_conjunctive(docs, queries).collect()))
    assert counts == sorted(map(tuple, retrieval.conjunctive_counts(docs, queries).collect()))
    by_query = {}
    for query, doc in pairs:
        by_query.setdefault(query, []).append(doc)
    assert counts == sorted((q, len(d), min(d)) for q, d in by_query.items())


def test_a_word_that_all_questions_and_documents_share(spark, monkeypatch):
    """As in ``recall_findings``: the pairs are found from the number that each question asks for and not from the word order."""
    docs = spark.range(900).selectExpr("concat('d', id) as id", "concat('what is known of order ', id div 2) as text").repartition(3)
    queries = spark.range(400).selectExpr("id as query_id", "concat('order ', id) as text")
    monkeypatch.setattr(scan_topk, "MOST_BYTES", 1 << 16)
    found = scan_topk.holding_all(docs, queries)
    assert found is not None
    assert sorted(map(tuple, found.collect())) == sorted((i, f"d{2 * i + j}") for i in range(400) for j in (0, 1))
