"""Retrieval for batches of questions: dense, lexical, fused, diversified, and its metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import groups
from ..functions.checkpoints import materialize
from ..functions.scalars import cosine, snippet, tokens
from . import scan_topk
from .audit import hit_contradictions

K1, B, RRF = 1.5, 0.75, 60
#: Most hits whose ids go to every task.
MOST_HITS = 1 << 21
BLOCK = 2048


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """First k of each query by score, ties by id; the rank is a column."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_dense(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Cosine top-k: corpus (id, embedding) by queries (query_id, embedding) → query_id, id, score, rank.

    Questions of up to ``scan_topk.MOST_BYTES`` go to every task of one scan of the corpus, which is not shuffled; more
    questions take several scans, and beyond ``MOST_SCANS`` meet the corpus in blocks. Null vectors are left out and zero vectors score 0. Ids of both
    sides are integers or strings and keep their type.
    """
    scanned = scan_topk.knn(corpus, queries, k)
    return _knn_blocks(corpus, queries, k) if scanned is None else top_k(scanned, k)


def _knn_blocks(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Both sides cut into blocks; each pair of blocks is one matrix product that keeps its own top k, so the
    shuffled scores are queries * corpus blocks * k, and nothing is broadcast."""
    spark = corpus.sparkSession
    kinds = [dict(side.dtypes)[name] for side, name in ((queries, "query_id"), (corpus, "id"))]
    kinds = ["string" if kind == "string" else "long" for kind in kinds]
    key = "string" if "string" in kinds else "long"
    n_corpus, n_queries = corpus.count(), queries.count()
    c_blocks, q_blocks = max(1, -(-n_corpus // BLOCK)), max(1, -(-n_queries // BLOCK))
    vector = F.transform("embedding", lambda x: x.cast("double")).alias("v")
    left = corpus.where("embedding is not null").select(F.pmod(F.xxhash64("id"), F.lit(c_blocks)).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("q"), F.col("id").cast(key).alias("key"), F.lit(0).alias("side"), vector)
    right = queries.where("embedding is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("c"), F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("q"), F.col("query_id").cast(key).alias("key"), F.lit(1).alias("side"), vector)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups(frames, ["c", "q"]):
            own, asked = group[group["side"] == 0].sort_values("key"), group[group["side"] == 1]
            if not len(own) or not len(asked):
                continue
            unit = []
            for rows in (own, asked):
                v = np.stack(rows["v"].to_list())
                size = np.linalg.norm(v, axis=1, keepdims=True)
                unit.append(v / np.where(size == 0, 1, size))
            scores = np.round(unit[1] @ unit[0].T, 9)  # equal vectors tie whatever the block
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"query_id": np.repeat(asked["key"].to_numpy(), best.shape[1]), "id": own["key"].to_numpy()[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()})

    dealt = left.unionByName(right).repartition(parts, "c", "q").sortWithinPartitions("c", "q")
    found = dealt.mapInPandas(local, f"query_id {key}, id {key}, score double")
    return top_k(found.select(F.col("query_id").cast(kinds[0]).alias("query_id"), F.col("id").cast(kinds[1]).alias("id"), "score"), k)


def bm25_postings(docs: DataFrame) -> DataFrame:
    """(id, text) → id, term, tf, length: term counts of each document, whose length is taken before words are spread."""
    split = docs.select("id", tokens(F.col("text")).alias("words"))
    words = split.select("id", F.size("words").cast("long").alias("length"), F.explode("words").alias("term"))
    return words.groupBy("id", "term", "length").agg(F.count(F.lit(1)).alias("tf")).select("id", "term", "tf", "length")


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """docs (id, text) by queries (query_id, text) → query_id, id, score for documents that share a term.

    A term that a query repeats counts as often. Documents without tokens count in the averages.
    """
    split = docs.select("id", tokens(F.col("text")).alias("words"))
    n_docs, length = split.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    average = length or 1.0
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = asked.select("term").distinct()
    # The length is taken before the words are spread, or each word would split its whole text again.
    words = split.select("id", "words", F.size("words").alias("length")).select("id", "length", F.explode("words").alias("term"))
    postings = words.join(wanted, "term", "left_semi").groupBy("id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf.alias("idf"))
    weight = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(average)))
    return asked.join(terms, "term").join(postings, "term").groupBy("query_id", "id").agg(F.sum(weight).alias("score"))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """BM25 top-k of documents that share a term, scores rounded to ``digits``: query_id, id, score, rank.

    Questions of up to ``scan_topk.MOST_BYTES`` go to every task; the corpus is scanned and each task sends its own
    k best. More questions take several scans, and beyond ``MOST_SCANS`` meet the postings in a join.
    """
    scanned = scan_topk.bm25(docs, queries, k, K1, B, digits)
    return top_k(bm25(docs, queries).withColumn("score", F.round("score", digits)) if scanned is None else scanned, k)


def lexical_conjunctive(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id of the documents that hold every distinct term of a query; a query without terms has none."""
    scanned = scan_topk.holding_all(docs, queries)
    return _conjunctive_joined(docs, queries) if scanned is None else scanned


def conjunctive_counts(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, n_documents, first_id of the documents of ``lexical_conjunctive``, which each task sums up by question."""
    scanned = scan_topk.holding_counts(docs, queries)
    if scanned is None:
        return _conjunctive_joined(docs, queries).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_documents"), F.min("id").alias("first_id"))
    return scanned.groupBy("query_id").agg(F.sum("n").alias("n_documents"), F.min("first").alias("first_id"))


def _conjunctive_joined(docs: DataFrame, queries: DataFrame) -> DataFrame:
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    needed = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
    held = docs.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return asked.join(held, "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("found")).join(needed, "query_id").where("found = needed").select("query_id", "id")


def lexical_top_k(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """BM25 top-k: query_id, id, score, rank; documents that share no term score 0 and fill up by id."""
    scored = materialize(bm25_top(docs, queries, k).drop("rank"))  # k rows a question; used twice
    # Where fewer than k documents are scored, all of them are here, and the k smallest ids hold all that are needed.
    padding = docs.select("id").orderBy("id").limit(k).crossJoin(queries.select("query_id")).join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return top_k(scored.unionByName(padding.withColumn("score", F.lit(0.0))), k)


def hybrid(docs: DataFrame, queries: DataFrame, k: int, pool: int = 20) -> DataFrame:
    """RRF of a dense and a BM25 top ``pool``: docs (id, text, embedding) by queries (query_id, text, embedding).

    The pools, ``pool`` rows a question each, are checkpointed, so what follows does not scan the corpus again.
    """
    dense = materialize(knn_dense(docs.select("id", "embedding"), queries.select("query_id", "embedding"), pool))
    lexical = materialize(lexical_top_k(docs.select("id", "text"), queries.select("query_id", "text"), pool))
    return top_k(rrf(dense, lexical).withColumn("score", F.round("score", 9)), k)


def rows_of(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are among the hits. Up to ``MOST_HITS`` ids go to every task, so that other rows do not leave the scan."""
    ids = hits.select("id").distinct()
    return docs.join(F.broadcast(ids) if hits.count() <= MOST_HITS else ids, "id", "left_semi")


def hydrated(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits (query_id, id, …) with their rows and ``cosine``, the true one also where only BM25 found a hit."""
    asked = queries.select("query_id", F.col("embedding").alias("asked"))
    held = hits.join(rows_of(docs, hits), "id").join(asked, "query_id")
    return held.withColumn("cosine", F.round(cosine(F.col("asked"), F.col("embedding")), 9)).drop("asked")


def hybrid_hits(docs: DataFrame, queries: DataFrame, k: int, pool: int = 20) -> DataFrame:
    """Hybrid top k as query_id, id, rank, rrf_score and the true cosine."""
    fused = hybrid(docs, queries, k, pool).withColumnRenamed("score", "rrf_score")
    return hydrated(fused, docs.select("id", "embedding"), queries).select("query_id", "id", "rank", "rrf_score", "cosine")


def hybrid_reranked(docs: DataFrame, queries: DataFrame, scores: DataFrame, k: int, pool: int = 10, hits: DataFrame | None = None) -> DataFrame:
    """The hybrid pool (``hits``, where the caller has it) in the order of external scores (query_id, id, score); those without one come last."""
    ordered = rerank(hybrid(docs, queries, pool, pool) if hits is None else hits, scores)
    return ordered.where(F.col("new_rank") <= k).select("query_id", "id", F.col("new_rank").alias("rank"))


def rerank_lexical(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits (query_id, id, rank) in the order of a BM25 that knows each query's own hits only: adds score and new_rank."""
    terms = queries.select("query_id", tokens(F.col("text")).alias("asked"))
    held = hits.select("query_id", "id", "rank").join(rows_of(docs.select("id", "text"), hits), "id").join(terms, "query_id").withColumn("words", tokens(F.col("text"))).withColumn("length", F.size("words"))
    pool = held.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))
    asked = terms.select("query_id", F.explode("asked").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    # Only words that the question asks for are counted, and these before they meet it.
    said = F.filter("words", lambda w: F.array_contains(F.array_distinct("asked"), w))
    tf = held.select("query_id", "id", "length", F.explode(said).alias("term")).groupBy("query_id", "id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = tf.join(asked, ["query_id", "term"])
    df = counts.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    scored = counts.join(df, ["query_id", "term"]).join(pool, "query_id").groupBy("query_id", "id").agg(F.round(F.sum(weight), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    every = hits.select("query_id", "id", "rank").join(scored, ["query_id", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return every.withColumn("new_rank", F.row_number().over(order))


def recall_batch(docs: DataFrame, queries: DataFrame, k: int, scores: DataFrame | None = None, facts: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Each question's answer by citation: query_id, ids (in order), answer (``[n] text`` of the k hits).

    Candidates are min(20, max(k, 4 k)) hybrid hits, in the order of ``scores`` if given, else of a BM25 over
    the candidates. ``hits``: the candidates, where the caller has them. With ``facts`` (id, kind, company, period, source_ref, metadata, created_at) there is also
    ``findings``: what contradicts itself among the question's hits, as sorted structs, empty if nothing does.
    """
    pool = min(20, max(k, 4 * k))
    hits = hybrid(docs, queries, pool, 20) if hits is None else hits
    ranked = rerank(hits, scores) if scores is not None else rerank_lexical(hits, docs, queries)
    first = ranked.where(F.col("new_rank") <= k)
    chosen = first.join(rows_of(docs.select("id", snippet(F.coalesce("text", F.lit(""))).alias("said")), hits), "id")
    cited = F.struct("new_rank", "id", F.concat(F.lit("["), "new_rank", F.lit("] "), "said").alias("text"))
    listed = chosen.groupBy("query_id").agg(F.array_sort(F.collect_list(cited)).alias("cited"))  # k rows a question
    answers = listed.select("query_id", F.transform("cited", lambda c: c["id"]).alias("ids"), F.array_join(F.transform("cited", lambda c: c["text"]), "\n").alias("answer"))
    if facts is None:
        return answers
    found = hit_contradictions(answers.select("query_id", F.explode("ids").alias("id")), facts)
    told = F.struct(*[c for c in found.columns if c != "query_id"])
    named = found.groupBy("query_id").agg(F.array_sort(F.collect_list(told)).alias("findings"))  # of k hits at most
    return answers.join(named, "query_id", "left").withColumn("findings", F.coalesce("findings", F.array().cast(named.schema["findings"].dataType)))


def rank_gain(one: DataFrame, other: DataFrame, measures: tuple[str, ...] = ("reciprocal_rank", "ndcg")) -> DataFrame:
    """Mean measures of two conditions over the same queries, and what the first gains: measure, one, other, gain."""
    named = other.select("query_id", *[F.col(m).alias(f"other_{m}") for m in measures])
    means = one.join(named, "query_id").agg(*[F.avg(c).alias(c) for m in measures for c in (m, f"other_{m}")])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("one"), F.col(f"other_{m}").alias("other"), (F.col(m) - F.col(f"other_{m}")).alias("gain")) for m in measures]))
    return means.select(rows.alias("r")).select("r.*")


def hybrid_mmr(docs: DataFrame, queries: DataFrame, k: int, pool: int = 20, weight: float = 0.7) -> DataFrame:
    """MMR over the hybrid pool; relevance is the cosine to the query, also of documents that only BM25 found."""
    fused = hybrid(docs, queries, pool, pool).select("query_id", "id", "rank")
    asked = queries.select("query_id", F.col("embedding").alias("asked"))
    held = fused.join(rows_of(docs.select("id", "embedding"), fused), "id").join(asked, "query_id")
    return mmr(held.withColumn("score", F.round(cosine(F.col("asked"), F.col("embedding")), 9)).drop("asked"), k, weight)


def rrf(*pools: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, id, rank) pools."""
    union = pools[0].select("query_id", "id", "rank")
    for pool in pools[1:]:
        union = union.unionByName(pool.select("query_id", "id", "rank"))
    return union.groupBy("query_id", "id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"))


def mmr(pool: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over a small pool of each query.

    ``pool`` has query_id, id, rank, score (relevance) and embedding; similarity to what is chosen has
    a floor of 0 and ties keep the pool's order. A pool is bounded by the retrieval before it.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        v = np.stack(rows["embedding"].to_list()).astype(float)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(size == 0, 1, size)
        near, relevance, left, out = v @ v.T, rows["score"].to_numpy(), list(range(len(rows))), []
        while left and len(out) < k:
            gain = [weight * relevance[i] - (1 - weight) * max([0.0, *(near[i, j] for j in out)]) for i in left]
            out.append(left.pop(int(np.argmax(gain))))
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "id": rows["id"].to_numpy()[out], "rank": range(1, len(out) + 1)})

    kinds = [scan_topk.kind_of(pool, name) for name in ("query_id", "id")]
    typed = pool.withColumns({name: F.col(name).cast(kind) for name, kind in zip(("query_id", "id"), kinds, strict=True)})
    return typed.groupBy("query_id").applyInPandas(choose, f"query_id {kinds[0]}, id {kinds[1]}, rank int")


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Order hits (query_id, id, rank) by an external score, those without one last; ties keep their rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "rank")
    return hits.select("query_id", "id", "rank").join(scores.select("query_id", "id", "score"), ["query_id", "id"], "left").withColumn("new_rank", F.row_number().over(order))


def ir_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Recall@k, reciprocal rank and nDCG@k of each query with gold: ranked (query_id, id, rank)."""
    return _metrics(gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold")), ranked.join(gold, ["query_id", "id"]), k)


def ir_metrics_by_label(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The same where the gold of a query is every row of its label: queries (query_id, label), corpus (id, label).

    Gold is counted by label and only ranked rows are joined, so no list of pairs is made. A null label has no gold.
    """
    counts = corpus.groupBy("label").agg(F.count(F.lit(1)).alias("n_gold"))
    labelled = ranked.join(queries, "query_id").join(corpus.select("id", F.col("label").alias("found")), "id")
    return _metrics(queries.join(counts, "label").select("query_id", "n_gold"), labelled.where("label = found"), k)


def _metrics(sizes: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    found = hits.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    none: Column = F.lit(0.0)
    return sizes.join(found, "query_id", "left").select(
        "query_id", F.coalesce(F.col("hits") / F.col("n_gold"), none).alias("recall"),
        F.coalesce(1.0 / F.col("first"), none).alias("reciprocal_rank"), F.coalesce(F.col("dcg") / ideal, none).alias("ndcg"),
    )
