"""Retrieval, reports and evaluation over the given tables, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import shuffled
from ..operators import audit, grounding, lifecycle, meaning, reports, retrieval
from .facts import MEMORIES_SQL, memories, table
from .queries import _TOKENS, ORACLES, _knn_sql, _vectors, ir_metrics_all, query

#: Components of the token vectors of documents and questions.
DIM = 256
#: All documents and questions with their token vectors; BM25 and cosines of all pairs.
HYBRID_SQL = f"""
docs AS (SELECT doc_id AS id, text, {_TOKENS.format('text')} AS t FROM documents),
asks AS (SELECT conv_id * 1000 + turn AS query_id, {_TOKENS.format('text')} AS t FROM conversations WHERE conv_id % 100 = 0),
said AS (SELECT 0 AS side, id, unnest(t) AS term FROM docs UNION ALL SELECT 1, query_id, unnest(t) FROM asks),
hash AS (SELECT term, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(term, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM (SELECT DISTINCT term FROM said)),
cells AS (SELECT side, id, map_from_entries(list((bucket, n))) AS m FROM (SELECT side, id, (least(h, 4294967296 - h) % {DIM})::INT AS bucket, count(*) AS n FROM said JOIN hash USING (term) GROUP BY 1, 2, 3) GROUP BY 1, 2),
vec AS (SELECT side, id, list_transform(range({DIM}), lambda i: coalesce(m[i::INT], 0)::DOUBLE) AS v FROM cells),
c AS (SELECT docs.*, v FROM docs LEFT JOIN vec ON side = 0 AND vec.id = docs.id), q AS (SELECT asks.*, v FROM asks LEFT JOIN vec ON side = 1 AND vec.id = query_id),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM c),
p AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM c), tf AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(t) AS term FROM q) GROUP BY 1, 2),
bm AS (SELECT query_id, id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS s FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
pair AS (SELECT query_id, id, round(coalesce(list_cosine_similarity(c.v, q.v), 0), 9) AS cosine, round(coalesce(s, 0), 9) AS bm FROM c CROSS JOIN q LEFT JOIN bm USING (query_id, id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS dr, row_number() OVER (PARTITION BY query_id ORDER BY bm DESC, id) AS lr FROM pair),
rrf AS (SELECT query_id, id, cosine, round(CASE WHEN dr <= 20 THEN 1.0::DOUBLE / (60 + dr) ELSE 0 END + CASE WHEN lr <= 20 THEN 1.0::DOUBLE / (60 + lr) ELSE 0 END, 9) AS rrf_score FROM ranked WHERE dr <= 20 OR lr <= 20),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM rrf)"""


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document, and the turns of every hundredth conversation, with the vectors of their words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    turns = table(spark, sf_dir, "conversations").where("conv_id % 100 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    vector = meaning.hash_vector(F.col("text"), DIM).alias("embedding")
    return docs.select("id", "text", vector), turns.select(F.col("id").alias("query_id"), "text", vector)


@query(f"WITH {HYBRID_SQL} SELECT query_id, id, bm AS score, lr AS rank FROM ranked WHERE lr <= 10")
def retrieve_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top ten; documents that share no term fill up in id order."""
    docs, asked = _asked(spark, sf_dir)
    return retrieval.lexical_top_k(docs.select("id", "text"), asked.select("query_id", "text"), 10)


@query(f"WITH {HYBRID_SQL} SELECT query_id, id, rank, rrf_score, cosine FROM hy WHERE rank <= 10")
def retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid_hits(*_asked(spark, sf_dir), 10)


#: The same with pools of ten.
_TEN_SQL = HYBRID_SQL.replace("dr <= 20", "dr <= 10").replace("lr <= 20", "lr <= 10")
_POOL_SQL = f"""
{_TEN_SQL},
pool AS (SELECT query_id, id, rank, t FROM hy JOIN c USING (id) WHERE rank <= 10), ps AS (SELECT query_id, count(*) AS n, avg(len(t)) AS a FROM pool GROUP BY 1),
ptf AS (SELECT query_id, id, dl, term, count(*) AS tf FROM (SELECT query_id, id, len(t) AS dl, unnest(t) AS term FROM pool) GROUP BY ALL), pdf AS (SELECT query_id, term, count(*) AS df FROM ptf GROUP BY ALL),
psc AS (SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS s FROM qt JOIN ptf USING (query_id, term) JOIN pdf USING (query_id, term) JOIN ps USING (query_id) GROUP BY ALL)"""


@query(f"""
WITH {_TEN_SQL}
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN id % 5 <> 0 THEN (id * 31 + query_id) % 97 END DESC NULLS LAST, rank) AS rank FROM hy WHERE rank <= 10 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN id % 5 <> 0 THEN (id * 31 + query_id) % 97 END DESC NULLS LAST, rank) <= 5""")
def retrieve_hybrid_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a rule for every pair that may be asked for; every fifth document has none."""
    docs, asked = _asked(spark, sf_dir)
    hits = retrieval.hybrid(docs, asked, 10, 10)
    scores = hits.where("id % 5 <> 0").select("query_id", "id", ((F.col("id") * 31 + F.col("query_id")) % 97).alias("score"))
    return retrieval.hybrid_reranked(docs, asked, scores, 5, hits=hits)


@query(f"WITH {_POOL_SQL} SELECT query_id, id, rank, coalesce(s, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(s, 0) DESC, rank) AS new_rank FROM pool LEFT JOIN psc USING (query_id, id)")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _asked(spark, sf_dir)
    return retrieval.rerank_lexical(retrieval.hybrid(docs, asked, 10, 10), docs, asked)


@query(f"""
WITH {HYBRID_SQL},
n AS (SELECT query_id, id, text, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN id % 5 <> 0 THEN (id * 31 + query_id) % 97 END DESC NULLS LAST, rank) AS r FROM hy JOIN c USING (id) WHERE rank <= 12)
SELECT query_id, string_agg('[' || r || '] ' || CASE WHEN length(coalesce(text, '')) <= 160 THEN coalesce(text, '') ELSE substr(text, 1, 157) || '…' END, chr(10) ORDER BY r) AS answer FROM n WHERE r <= 3 GROUP BY 1""")
def recall_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _asked(spark, sf_dir)
    hits = retrieval.hybrid(docs, asked, 12, 20)
    scores = hits.where("id % 5 <> 0").select("query_id", "id", ((F.col("id") * 31 + F.col("query_id")) % 97).alias("score"))
    return retrieval.recall_batch(docs, asked, 3, scores, hits=hits).select("query_id", "answer")


def _order(size: int = 64, seed: int = 1234567) -> str:
    """The order of ``shuffled`` as a SQL list of positions, by a shuffle of the positions themselves."""
    state, order = seed, list(range(1, size + 1))
    for i in reversed(range(1, size)):
        for shift in (13, -17, 5):
            signed = state - 2**32 if state >= 2**31 else state
            state = (state ^ (signed * 2**shift if shift > 0 else signed >> -shift)) % 2**32
        j = int(state / (2**32 - 1) * (i + 1))
        order[i], order[j] = order[j], order[i]
    return str(order)


@query(_knn_sql(f"list_transform({_order()}, lambda i: q.embedding[i])::DOUBLE[]", 10))
def shuffled_vector_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose components are in a fixed shuffled order, which a working retriever has to fail on."""
    corpus, asked = _vectors(spark, sf_dir)
    return retrieval.knn_dense(corpus, asked.withColumn("embedding", shuffled(F.transform("embedding", lambda x: x.cast("double")), 64)), 10)


_IR, _IR_CONTROL = ORACLES["ir_metrics_all"], ORACLES["ir_metrics_all"].replace(_knn_sql("q.embedding::DOUBLE[]", 10), _knn_sql("list_reverse(q.embedding::DOUBLE[])", 10))


@query(f"""
WITH a AS ({_IR}), b AS ({_IR_CONTROL}), m AS (SELECT avg(a.reciprocal_rank) AS r1, avg(b.reciprocal_rank) AS r2, avg(a.ndcg) AS n1, avg(b.ndcg) AS n2 FROM a JOIN b USING (query_id))
SELECT 'reciprocal_rank' AS measure, round(r1, 6) AS one, round(r2, 6) AS other, round(r1 - r2, 6) AS gain FROM m UNION ALL SELECT 'ndcg', round(n1, 6), round(n2, 6), round(n1 - n2, 6) FROM m""")
def mean_rank_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    corpus, questions = _vectors(spark, sf_dir)
    hits = retrieval.knn_dense(corpus, questions.withColumn("embedding", F.reverse("embedding")), 10)
    control = retrieval.ir_metrics_by_label(hits, asked, rows.select(F.col("vec_id").alias("id"), "label"), 5)
    control = control.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])
    return retrieval.rank_gain(ir_metrics_all(spark, sf_dir), control).select("measure", *[F.round(c, 6).alias(c) for c in ("one", "other", "gain")])


@query(f"WITH a AS ({_IR}) SELECT label AS genre, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(ndcg), 6) AS ndcg FROM a JOIN embeddings ON vec_id = query_id GROUP BY GROUPING SETS ((label), ())")
def ir_metrics_by_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by label, and over all (a null genre)."""
    genre = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("genre"))
    return ir_metrics_all(spark, sf_dir).join(genre, "query_id").rollup("genre").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


@query(f"""
WITH {MEMORIES_SQL}, odd AS ({ORACLES['field_contradictions'].split('odd AS (')[0].split('pair AS (')[1].rsplit('),', 1)[0]}),
bad AS (SELECT abs(ta - tb) > 0.5 AS t, sa <> sb AS s FROM odd), gone AS ({ORACLES['dangling_references'].split(MEMORIES_SQL)[1]})
SELECT (SELECT count(*) FROM mem) AS audited, (SELECT count(*) FROM (SELECT DISTINCT company_key, period, subject FROM mem)) AS subjects, (SELECT count(*) FILTER (t) + count(*) FILTER (s) FROM bad) AS contradictions, (SELECT count(*) FROM gone) AS absences,
  (SELECT count(*) FILTER (t) + count(*) FILTER (s) FROM bad) = 0 AND (SELECT count(*) FROM gone) = 0 AS ok""")
def contradiction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.contradiction_report(memories(spark, sf_dir))


@query(f"""
WITH {MEMORIES_SQL}, w AS ({ORACLES['field_contradictions'].replace('WITH ' + MEMORIES_SQL + ',', 'WITH')}),
v AS (SELECT w.company_key, w.period, w.subject, w.attr, m.id AS memory_id, m.id = w.winner_id AS recommended FROM w JOIN mem m ON m.company_key = w.company_key AND m.period = w.period AND m.subject = w.subject)
SELECT company_key, period, subject, attr, 1 AS n_carriers, memory_id, recommended FROM v""")
def contradiction_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.contradiction_values(memories(spark, sf_dir)).select("company_key", "period", "subject", "attr", "n_carriers", "memory_id", "recommended")


@query("""
WITH e AS (SELECT doc_id FROM labels WHERE quality = 1), f AS (SELECT doc_id FROM documents WHERE n_chars > 400)
SELECT doc_id, CASE WHEN e.doc_id IS NULL THEN 'false_positive' WHEN f.doc_id IS NULL THEN 'missed' ELSE 'detected' END AS state FROM e FULL JOIN f USING (doc_id)""")
def label_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.label_difference(table(spark, sf_dir, "labels").where("quality = 1"), table(spark, sf_dir, "documents").where("n_chars > 400"), ["doc_id"])


@query("""
WITH e AS (SELECT doc_id, 1 AS a FROM labels WHERE quality = 1), f AS (SELECT doc_id, 1 AS b FROM documents WHERE n_chars > 400), x AS (SELECT a, b FROM e FULL JOIN f USING (doc_id))
SELECT count(a) AS injected, count(*) FILTER (a = 1 AND b = 1) AS detected, count(*) FILTER (a IS NULL) AS false_positives, round(100.0 * count(*) FILTER (a = 1 AND b = 1) / count(a), 6) AS detection_rate, round(100.0 * count(*) FILTER (a = 1 AND b = 1) / count(b), 6) AS "precision" FROM x""")
def detection_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.detection_precision(table(spark, sf_dir, "labels").where("quality = 1"), table(spark, sf_dir, "documents").where("n_chars > 400"), ["doc_id"])


_PAIRS_SQL = """
pr AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.25)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("id"), "label", "embedding")


@query(f"WITH {_PAIRS_SQL} SELECT a, b, cosine FROM pr ORDER BY cosine DESC, a || '|' || b LIMIT 50")
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_pairs(_labelled(spark, sf_dir), ["label"], 0.25, 50).withColumn("cosine", F.round("cosine", 9))


@query(f"""
WITH {_PAIRS_SQL}, j AS (SELECT count(*) AS compared, count(*) FILTER (a % 7 > 0) AS judged, count(*) FILTER (a % 7 = 0) AS failed, count(*) FILTER (a % 7 > 0 AND (a + b) % 11 = 0) AS contradictions FROM pr)
SELECT (SELECT count(*) FROM embeddings WHERE label IS NOT NULL) AS total_memories, compared AS candidate_pairs, compared, judged, failed, contradictions, false AS truncated,
  CASE WHEN compared > 0 AND judged = 0 THEN 'inconclusive' WHEN failed > 0 THEN 'partial' ELSE 'complete' END AS status, failed = 0 AND contradictions = 0 AND NOT (compared > 0 AND judged = 0) AS ok FROM j""")
def semantic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's verdicts by a rule; of every seventh first end it has none."""
    rows = _labelled(spark, sf_dir)
    verdicts = reports.top_pairs(rows, ["label"], 0.25).where("a % 7 > 0").select("a", "b", ((F.col("a") + F.col("b")) % 11 == 0).alias("contradict"), F.lit("ok").alias("status"))
    return reports.semantic_report(rows, reports.judged_pairs(rows, ["label"], 0.25, verdicts=verdicts))


@query(f"WITH {MEMORIES_SQL} SELECT id, true AS truncated FROM mem ORDER BY importance DESC, created_at DESC, id LIMIT 100")
def bounded_audit_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, truncated = reports.bounded_selection(memories(spark, sf_dir), 100)
    return rows.select("id", truncated.alias("truncated"))


@query("SELECT vec_id AS id, len(embedding) AS dim FROM embeddings WHERE embedding IS NOT NULL")
def scan_lifecycle_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.candidates(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")).select("id", F.size("embedding").alias("dim"))


@query(f"""
WITH {MEMORIES_SQL}, n AS (SELECT count(*) AS total, count(*) FILTER (created_at < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY AND importance <= 0.55) AS f FROM mem)
SELECT 'forget' AS plan, f AS rows, round(f / total, 6) AS share FROM n UNION ALL SELECT 'nothing', 0, 0 FROM n""")
def lifecycle_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).withColumn("superseded_at", F.lit(None).cast("timestamp"))
    plan = lifecycle.plan_forget(rows, "1998-01-01 00:00:00", superseded=True, older_than_days=365, max_importance=0.55)
    return lifecycle.preview(rows, forget=plan, nothing=lifecycle.plan_forget(rows, "1998-01-01 00:00:00")).withColumn("share", F.round("share", 6))


@query(f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN two THEN TIMESTAMP '2000-01-01' END AS superseded_at, CASE WHEN two THEN 'b-' || k END AS superseded_by FROM (SELECT id, k, id LIKE 'a-%' AND EXISTS (SELECT 1 FROM mem b WHERE b.id = 'b-' || m.k) AS two FROM mem m)")
def apply_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order says of itself gives way to what its lines add up to."""
    none = {"superseded_at": F.lit(None).cast("timestamp"), "superseded_by": F.lit(None).cast("string")}
    rows = audit.with_subject(memories(spark, sf_dir)).withColumns(none)
    plan = rows.where("id like 'b-%'").select(F.col("id").alias("winner_id"), F.concat(F.lit("a-"), F.substring_index("id", "-", -1)).alias("loser_id"))
    return lifecycle.apply_supersede(rows, plan, "2000-01-01 00:00:00").select("id", "superseded_at", "superseded_by")


@query("""
SELECT o_orderkey AS query_id, CASE o_orderkey % 6 WHEN 0 THEN 'grounded' WHEN 1 THEN 'unsupported_numeric_claim' WHEN 2 THEN 'invalid_or_missing_citation'
  WHEN 3 THEN 'unsupported_numeric_claim' WHEN 4 THEN 'unsupported_numeric_claim' ELSE 'invalid_or_missing_citation' END AS status, 5 + (o_orderkey % 6 = 5)::INT * 2 AS n_claims
FROM orders""")
def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer on each order and the two facts that it cites: some say a wrong amount, currency or number of items,
    one in six cites nothing in range, and one in six has a clause without a marker."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = orders.select("o_orderkey", F.pmod("o_orderkey", F.lit(6)).alias("k"), F.round("o_totalprice", 2).alias("total")).join(n, "o_orderkey", "left").na.fill(0, ["n"])
    amount = lambda x: F.format_string("%.2f", x)
    k, total, items = F.col("k"), F.col("total"), F.col("n")
    text = F.concat(
        F.lit("It cost "), F.when(k == 3, "GBP ").otherwise("EUR "), amount(F.when(k == 1, total + 1).otherwise(total)), F.lit(" "), F.when(k == 2, "[7]").otherwise("[1]"),
        F.lit("; it had "), F.when(k == 4, items + 1).otherwise(items).cast("string"), F.lit(" documents [2]"), F.when(k == 5, "; and 3 days passed.").otherwise("."),
    )
    answers = rows.select(F.col("o_orderkey").alias("query_id"), text.alias("text"))
    facts = [F.struct(F.lit(1).cast("long").alias("marker"), F.concat(F.lit("Total of EUR "), amount(total), F.lit(".")).alias("text")), F.struct(F.lit(2).cast("long").alias("marker"), F.concat(items.cast("string"), F.lit(" documents.")).alias("text"))]
    cited = rows.select(F.col("o_orderkey").alias("query_id"), F.inline(F.array(*facts)))
    return grounding.grounding_check(answers, cited)
