"""Registered queries over quotas, streams' batch twins and stored postings, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import tokens
from ..operators import admission, audit, finance, lifecycle, retrieval
from .facts import MEMORIES_SQL, memories, table
from .queries import _TOKENS, query


@query("""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY day, bucket, subject ORDER BY ts, id) AS n FROM (
  SELECT ts, event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%d') AS day, event_type AS bucket, 'team-' || (user_id % 3) AS subject,
    greatest(1, least(1000000, floor(value)))::BIGINT AS units, (500 + 100 * (user_id % 5))::BIGINT AS "limit" FROM events)),
f AS (SELECT day, bucket, subject, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS "limit", NULL::BOOLEAN AS ok FROM c WHERE n = 1
  UNION ALL SELECT c.day, c.bucket, c.subject, c.n, f.used + CASE WHEN f.used + c.units <= c."limit" THEN c.units ELSE 0 END, c."limit", f.used + c.units <= c."limit"
  FROM f JOIN c ON c.day = f.day AND c.bucket = f.bucket AND c.subject = f.subject AND c.n = f.n + 1)
SELECT day, bucket, subject, max(used) AS units, count(*) FILTER (ok) AS n_admitted, count(*) FILTER (NOT ok) AS n_refused, greatest(0, arg_max("limit", n) - max(used)) AS remaining
FROM f WHERE n > 0 GROUP BY 1, 2, 3""")
def daily_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily usage with limits: an event charges its whole value to its team, the limit differs by user."""
    user = F.col("user_id")
    charges = table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("bucket"), F.concat(F.lit("team-"), user % 3).alias("subject"), F.col("value").alias("units"), (500 + 100 * (user % 5)).alias("limit"))
    return admission.daily_admitted(charges)


@query(f"""
WITH d AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS t FROM documents),
q AS (SELECT id AS query_id, list_distinct(t[5:9]) AS t FROM d WHERE id % 100 = 0)
SELECT query_id, count(*) AS n_documents, min(d.id) AS first_id FROM q JOIN d ON list_has_all(d.t, q.t) WHERE len(q.t) > 0 GROUP BY 1""")
def lexical_conjunctive_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words in a row of every hundredth document: which documents hold them all."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = docs.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.array_join(F.slice(tokens(F.col("text")), 5, 5), " ").alias("text"))
    return retrieval.conjunctive_counts(docs, asked)


@query("""
WITH p AS (SELECT o_orderkey AS id, o_totalprice AS total, CASE o_orderkey % 8 WHEN 0 THEN -o_totalprice WHEN 1 THEN 0.0 WHEN 2 THEN o_totalprice / 4 WHEN 3 THEN o_totalprice END AS paid_amount,
  CASE o_orderkey % 16 WHEN 4 THEN true WHEN 12 THEN false END AS paid, CASE o_orderkey % 24 WHEN 5 THEN ' Settled ' WHEN 13 THEN 'cleared' WHEN 21 THEN 'open' WHEN 6 THEN 'unpaid' WHEN 14 THEN 'partial' WHEN 22 THEN 'pending' END AS status FROM orders)
SELECT id, CASE WHEN paid_amount < 0 THEN 'refund' WHEN paid_amount = 0 THEN 'unpaid' WHEN paid_amount + 0.01 < total THEN 'partial' WHEN paid_amount IS NOT NULL THEN 'paid' WHEN NOT paid THEN 'unpaid'
    WHEN paid OR lower(trim(status)) IN ('paid', 'settled', 'cleared') THEN 'paid' WHEN lower(trim(status)) = 'unpaid' THEN 'unpaid' ELSE 'unknown' END AS cash_status,
  CASE WHEN paid_amount IS NOT NULL THEN paid_amount WHEN NOT paid THEN 0 WHEN paid OR lower(trim(status)) IN ('paid', 'settled', 'cleared') THEN total WHEN lower(trim(status)) = 'unpaid' THEN 0 END AS cash FROM p""")
def purchase_cash_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as purchases with each kind of evidence of what was paid."""
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    case = lambda by, values: F.coalesce(*[F.when(key % by == at, value) for at, value in values.items()])
    paid = case(8, {0: -total, 1: F.lit(0.0), 2: total / 4, 3: total})
    words = case(24, {5: F.lit(" Settled "), 13: F.lit("cleared"), 21: F.lit("open"), 6: F.lit("unpaid"), 14: F.lit("partial"), 22: F.lit("pending")})
    state, cash = finance.purchase_cash(total, words, paid, case(16, {4: F.lit(True), 12: F.lit(False)}))
    return table(spark, sf_dir, "orders").select(key.alias("id"), state.alias("cash_status"), cash.alias("cash"))


@query(f"""
WITH {MEMORIES_SQL},
pair AS (SELECT a.k, a.company_key, a.period, a.subject, a.total AS ta, b.total AS tb, a.status AS sa, b.status AS sb, a.kind = 'insight' AS weak, a.created_at AS ca, b.created_at AS cb, a.id AS aid, b.id AS bid FROM mem a JOIN mem b ON a.k = b.k AND a.id < b.id WHERE a.k % 100 = 0),
odd AS (SELECT *, 'total' AS attr FROM pair WHERE abs(ta - tb) > 0.5 UNION ALL SELECT *, 'status' FROM pair WHERE sa <> sb)
SELECT k AS query_id, company_key, period, subject, attr, CASE WHEN weak OR cb > ca THEN bid ELSE aid END AS winner_id, CASE WHEN weak THEN 'source-authority' ELSE 'recency' END AS rule,
  round(CASE WHEN weak THEN 0.75 WHEN ca <> cb THEN 0.5 + least(0.35, abs(epoch_us(cb) - epoch_us(ca)) / 86.4e9 / 30 * 0.35) ELSE 0.4 END, 6) AS confidence FROM odd""")
def recall_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth order is asked for by its number; what contradicts itself among the facts that name it."""
    rows, key = memories(spark, sf_dir), F.substring_index("id", "-", -1)
    asked = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("order "), "o_orderkey").alias("text"))
    hits = retrieval.lexical_conjunctive(rows.select("id", F.concat(F.lit("What is known of order "), key).alias("text")), asked)
    return audit.hit_contradictions(hits, rows).select("query_id", "company_key", "period", "subject", "attr", "winner_id", "rule", "confidence")


@query()
def near_duplicate_pairs_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label at a cosine of 0.3, through hash tables; a test measures the recall."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("id"), "label", "embedding")
    return lifecycle.similar_pairs_approx(rows, ["label"], 0.3)
