"""The registered queries over the given tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canonical_label, localized_amount, slug, snippet, tokens
from ..operators import audit, consolidation, finance, lifecycle, meaning, retrieval, usage
from ..sources.tables import scan_active
from .facts import MEMORIES_SQL, MONEY_SQL, PAYROLL_SQL, memories, money, payroll_documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


@query(f"""
WITH {MEMORIES_SQL},
pair AS (SELECT a.company_key, a.period, a.subject, a.total AS ta, b.total AS tb, a.status AS sa, b.status AS sb, a.importance AS ia, b.importance AS ib,
  a.kind = 'insight' AS weak, a.created_at AS ca, b.created_at AS cb, a.id AS aid, b.id AS bid FROM mem a JOIN mem b ON a.k = b.k AND a.id < b.id),
odd AS (SELECT *, 'total' AS attr FROM pair WHERE abs(ta - tb) > 0.5 UNION ALL SELECT *, 'status' FROM pair WHERE sa <> sb)
SELECT company_key, period, subject, attr, 2 AS n_buckets, 2 AS n_carriers,
  CASE WHEN abs(ia - ib) >= 0.0499999 THEN CASE WHEN ia > ib THEN aid ELSE bid END WHEN weak THEN bid WHEN cb > ca THEN bid ELSE aid END AS winner_id,
  CASE WHEN abs(ia - ib) >= 0.0499999 THEN 'importance' WHEN weak THEN 'source-authority' ELSE 'recency' END AS rule,
  round(CASE WHEN abs(ia - ib) >= 0.0499999 THEN 0.6 + least(0.3, abs(ia - ib) / 2) WHEN weak THEN 0.75
    WHEN ca <> cb THEN 0.5 + least(0.35, abs(epoch_us(cb) - epoch_us(ca)) / 86.4e9 / 30 * 0.35) ELSE 0.4 END, 6) AS confidence
FROM odd""")
def field_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.contradictions(memories(spark, sf_dir)).drop("winner_bucket")


@query(f"""
WITH {MEMORIES_SQL}
SELECT r.company_key, r.period, r.ref, count(DISTINCT r.id) AS n_memories, min(r.id) AS first_id FROM mem r
WHERE r.ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mem s WHERE s.company_key = r.company_key AND s.period = r.period AND s.subject = r.ref) GROUP BY 1, 2, 3""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dangling_references(memories(spark, sf_dir))


@query(f"""
WITH {MEMORIES_SQL}
SELECT company_key, 'total' AS attr, 'n' AS type, count(*) AS n, round(sum(total), 2) AS total FROM mem GROUP BY 1
UNION ALL SELECT company_key, 'status', 's', count(*), NULL FROM mem GROUP BY 1
UNION ALL SELECT company_key, 'lines', 'n', count(*), round(sum(lines), 2) FROM mem WHERE lines IS NOT NULL GROUP BY 1""")
def attribute_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.attributes(memories(spark, sf_dir))
    return rows.groupBy("company_key", "attr", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("number"), 2).alias("total"))


@query(f"""
WITH {MEMORIES_SQL}
SELECT id FROM mem WHERE created_at < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY AND importance <= 0.55""")
def plan_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).withColumn("superseded_at", F.lit(None).cast("timestamp"))
    return lifecycle.plan_forget(rows, "1998-01-01 00:00:00", superseded=True, older_than_days=365, max_importance=0.55)


@query(f"WITH {MEMORIES_SQL} SELECT company_key, count(*) AS n FROM mem GROUP BY 1")
def count_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).groupBy(canonical_label(F.col("company")).alias("company_key")).agg(F.count(F.lit(1)).alias("n"))


def _pnl_sql(keys: list[str]) -> str:
    shown = ", ".join(f"{k if k in keys else 'NULL::VARCHAR'} AS {k}" for k in ("currency", "company", "period"))
    group = "GROUP BY " + ", ".join(keys) if keys else ""
    up = lambda x: f"CASE WHEN cs = 1 AND nc = 0 THEN floor(({x}) * 100 + 0.5) / 100 END"
    return f"""SELECT {shown}, CASE WHEN cs + nc = 0 THEN 'empty' WHEN cs = 1 AND nc = 0 THEN 'single' WHEN cs > 1 THEN 'mixed' ELSE 'unknown' END AS status,
  0 AS payroll_events, purchases, sales, {up("s")} AS revenue, {up("p")} AS total_expenses, {up("s - p")} AS result, CASE WHEN unk = 0 THEN {up("pc")} END AS net_cash_outflow
FROM (SELECT {", ".join([*keys, ""]) if keys else ""} count(DISTINCT currency) AS cs, count(*) FILTER (currency IS NULL) AS nc, count(*) FILTER (kind = 'purchase') AS purchases, count(*) FILTER (kind = 'sale') AS sales,
  coalesce(sum(amount) FILTER (kind = 'sale'), 0) AS s, coalesce(sum(amount) FILTER (kind = 'purchase'), 0) AS p, coalesce(sum(cash) FILTER (kind = 'purchase'), 0) AS pc,
  count(*) FILTER (kind = 'purchase' AND cash IS NULL) AS unk FROM money {group})"""


@query(f"WITH {MONEY_SQL} {_pnl_sql(['currency'])}")
def pnl_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.pnl(money(spark, sf_dir), [["currency"]])


@query(f"WITH {MONEY_SQL} {_pnl_sql(['currency', 'company', 'period'])}")
def pnl_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.pnl(money(spark, sf_dir), [["currency", "company", "period"]])


@query(f"WITH {MONEY_SQL} {_pnl_sql([])}")
def pnl_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.pnl(money(spark, sf_dir), [[]])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'paid' WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'partial' ELSE 'unknown' END AS cash_status,
  CASE WHEN o_totalprice > 300000 THEN o_totalprice WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus = 'O' THEN o_totalprice / 2 END AS cash FROM orders""")
def purchase_cash_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, status = F.col("o_totalprice"), F.col("o_orderstatus")
    paid = F.when(total > 300000, total).when(status == "O", total / 2)
    state, amount = finance.purchase_cash(total, F.when(status == "F", "paid").otherwise(""), paid)
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("cash_status"), amount.alias("cash"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS bucket, user_id AS subject, sum(coalesce(value, 0)) AS units, count(*) AS n_events FROM events GROUP BY 1, 2, 3")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("bucket"), F.col("user_id").alias("subject"), F.coalesce("value", F.lit(0.0)).alias("units"))
    return usage.daily_usage(rows)


@query("SELECT event_type, min(value) AS least, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS most, count(*) AS n FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.latency_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""
SELECT lang, tp, fn, fp, tn, n, round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall FROM (
  SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 400) AS tp, count(*) FILTER (quality = 1 AND n_chars <= 400) AS fn, count(*) FILTER (quality = 0 AND n_chars > 400) AS fp,
    count(*) FILTER (quality = 0 AND n_chars <= 400) AS tn, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    judged = rows.select("lang", (F.col("quality") == 1).alias("expected"), (F.col("n_chars") > 400).alias("predicted"), F.lit("ok").alias("status"))
    found = usage.confusion(judged, ["lang"])
    return found.select("lang", "tp", "fn", "fp", "tn", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")])


@query()
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.table_fingerprint(table(spark, sf_dir, "documents"))


@query("SELECT source, count(*) AS n, sum(ceil(n_chars / 4.0))::BIGINT AS context_tokens FROM documents GROUP BY 1")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil(F.col("n_chars") / 4.0)).alias("context_tokens"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE substr(text, 1, 157) || '…' END AS snippet FROM documents ORDER BY doc_id DESC LIMIT 100""")
def list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").orderBy(F.desc("doc_id")).limit(100).select("doc_id", snippet(F.col("text")).alias("snippet"))


_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"


@query(f"""
WITH d AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS t FROM documents),
q AS (SELECT conv_id * 1000 + turn AS query_id, {_TOKENS.format('text')} AS t FROM conversations WHERE conv_id % 100 = 0),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
p AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(t) AS term FROM q) GROUP BY 1, 2),
s AS (SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def bm25_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.bm25_top(docs, _questions(spark, sf_dir), 10, 6)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("conv_id % 100 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


@query(f"""
WITH d AS (SELECT doc_id AS id, list_distinct({_TOKENS.format('text')}) AS t FROM documents),
q AS (SELECT conv_id * 1000 + turn AS query_id, list_distinct(({_TOKENS.format('text')})[1:3]) AS t FROM conversations WHERE conv_id % 100 = 0)
SELECT query_id, count(*) AS n_documents, min(id) AS first_id FROM q JOIN d ON list_has_all(d.t, q.t) WHERE len(q.t) > 0 GROUP BY 1""")
def lexical_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = _questions(spark, sf_dir).withColumn("text", F.array_join(F.slice(tokens(F.col("text")), 1, 3), " "))
    return retrieval.conjunctive_counts(docs, asked)


@query(f"""
WITH d AS (SELECT doc_id AS id, list_distinct({_TOKENS.format('text')}) AS t FROM documents),
q AS (SELECT conv_id * 1000 + turn AS query_id, list_distinct({_TOKENS.format('text')}) AS t FROM conversations WHERE conv_id % 100 = 0)
SELECT query_id, count(*) AS n_documents, min(id) AS first_id FROM q JOIN d ON list_has_all(d.t, q.t) WHERE len(q.t) > 0 GROUP BY 1""")
def lexical_conjunctive_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct term of a question must match; ``lexical_conjunctive`` asks for the first three only."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.conjunctive_counts(docs, _questions(spark, sf_dir))


@query(f"""
WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1""")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = retrieval.bm25_postings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _knn_sql(vector: str, k: int) -> str:
    return f"""SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], {vector}), 9) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= {k}"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), "embedding"), rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_knn_sql("q.embedding::DOUBLE[]", 10))
def knn_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.knn_dense(*_vectors(spark, sf_dir), 10)


@query(_knn_sql("list_reverse(q.embedding::DOUBLE[])", 10))
def degraded_vector_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = _vectors(spark, sf_dir)
    return retrieval.knn_dense(corpus, asked.withColumn("embedding", F.reverse("embedding")), 10)


@query(f"""
WITH a AS ({_knn_sql("q.embedding::DOUBLE[]", 20)}), b AS ({_knn_sql("list_reverse(q.embedding::DOUBLE[])", 20)}),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM a UNION ALL SELECT query_id, id, rank FROM b) GROUP BY 1, 2)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = _vectors(spark, sf_dir)
    pools = retrieval.knn_dense(corpus, asked, 20), retrieval.knn_dense(corpus, asked.withColumn("embedding", F.reverse("embedding")), 20)
    return retrieval.top_k(retrieval.rrf(*pools).withColumn("score", F.round("score", 9)), 10)


@query()
def retrieve_hybrid_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to documents, by token vectors and BM25; tests hold it against brute force."""
    docs, asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), _questions(spark, sf_dir)
    vector = meaning.hash_vector(F.col("text"), 256).alias("embedding")
    return retrieval.hybrid_mmr(docs.select("*", vector), asked.select("*", vector), 5)


@query(f"""
WITH r AS ({_knn_sql("q.embedding::DOUBLE[]", 10)}),
g AS (SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label AND e.vec_id % 50 = 0 WHERE q.vec_id % 100 = 0),
n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
h AS (SELECT query_id, count(*) FILTER (rank <= 5) AS hits, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r JOIN g USING (query_id, id) GROUP BY 1)
SELECT query_id, round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank,
  round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 5)::BIGINT + 1) t(i)), 0), 6) AS ndcg FROM n LEFT JOIN h USING (query_id)""")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    gold = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), "label"), "label").select("query_id", "id")
    found = retrieval.ir_metrics(retrieval.knn_dense(*_vectors(spark, sf_dir), 10), gold, 5)
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


@query(f"""
WITH r AS ({_knn_sql("q.embedding::DOUBLE[]", 10)}),
g AS (SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0),
n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
h AS (SELECT query_id, count(*) FILTER (rank <= 5) AS hits, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r JOIN g USING (query_id, id) GROUP BY 1)
SELECT query_id, round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank,
  round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 5)::BIGINT + 1) t(i)), 0), 6) AS ndcg FROM n LEFT JOIN h USING (query_id)""")
def ir_metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold is every vector of the query's label; ``ir_metrics`` takes every fiftieth only."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    found = retrieval.ir_metrics_by_label(retrieval.knn_dense(*_vectors(spark, sf_dir), 10), asked, rows.select(F.col("vec_id").alias("id"), "label"), 5)
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'conflict' WHEN o_orderkey % 2 = 0 THEN 'replay' ELSE 'insert' END AS state FROM orders""")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    row = [key.cast("string").alias("id"), F.lit("_public").alias("tenant_id"), F.concat(F.lit("order:"), key).alias("idempotency_key"), "o_orderstatus"]
    stored = orders.where(key % 2 == 0).select(*row, F.col("o_totalprice").alias("amount"))
    batch = orders.select(*row, F.when(key % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("amount"))
    new, replays, conflicts = lifecycle.idempotent_append(stored, batch, ["o_orderstatus", "amount"])
    states = new.select("idempotency_key", F.lit("insert").alias("state")).unionByName(replays.select("idempotency_key", F.lit("replay").alias("state"))).unionByName(conflicts.select("idempotency_key", F.lit("conflict").alias("state")))
    return states.select(F.substring_index("idempotency_key", ":", -1).cast("long").alias("o_orderkey"), "state")


@query(r"""
SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug, lower(trim(s_name)) AS label, round(s_acctbal, 2) AS amount FROM supplier""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = F.concat(F.when(F.col("s_acctbal") < 0, "(").otherwise(""), F.translate(F.format_number(F.abs("s_acctbal"), 2), ",.", ".,"), F.when(F.col("s_acctbal") < 0, ") EUR").otherwise(" EUR"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", slug(F.col("s_name")).alias("slug"), canonical_label(F.col("s_name")).alias("label"), localized_amount(printed).alias("amount"))


@query(f"""
WITH {PAYROLL_SQL}
SELECT company, period, 'ord-' || k AS event_ref, CASE WHEN k % 7 = 0 THEN n + 1 ELSE n END AS employee_count, gross AS gross_total, gross * 1.1 AS employer_cost_total,
  'evt-' || lower(company) || '-ord-' || k || '-' || substr(sha256(lower(company) || chr(0) || 'ord-' || k), 1, 12) || '-' || period AS event_id, n + 2 AS n_documents FROM run WHERE k % 10 <> 0""")
def fuse_payroll_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = finance.fuse_events(payroll_documents(spark, sf_dir))
    return events.select("company", "period", "event_ref", "employee_count", "gross_total", "employer_cost_total", "event_id", F.size("linked_docs").alias("n_documents"))


@query(f"WITH {PAYROLL_SQL} SELECT lower(company) AS company, period, 'missing_bank' AS reason, count(*) AS n FROM run WHERE k % 10 = 0 GROUP BY 1, 2")
def rejected_payroll_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = finance.fuse_events(payroll_documents(spark, sf_dir))
    return rejected.groupBy("company", "period", "reason").agg(F.count(F.lit(1)).alias("n"))


#: The rules from the columns of the documents: declared is the register's count, slips are the payslips.
RULES_SQL = f"""{PAYROLL_SQL},
sums AS (SELECT l_orderkey AS k, sum(l_extendedprice * 0.8) AS s_net, sum(l_extendedprice) AS s_gross, sum(l_extendedprice * 1.1) AS s_cost, count(*) AS slips FROM lineitem GROUP BY 1),
doc AS (SELECT *, CASE WHEN k % 7 = 0 THEN n + 1 ELSE n END AS declared, gross * 1.1 AS cost, gross * CASE WHEN k % 3 = 0 THEN 0.75 ELSE 0.8 END AS bank FROM run JOIN sums USING (k) WHERE k % 10 <> 0),
good AS (SELECT k, company, period, unnest([
  {{'rule': 'R1', 'seen': declared = slips, 'good': abs(bank - s_net) / s_net <= 0.02, 'bad': 'error'}},
  {{'rule': 'R2', 'seen': true, 'good': cost > 0 AND bank > 0 AND cost / bank BETWEEN 1.25 AND 1.45, 'bad': 'warning'}},
  {{'rule': 'R3', 'seen': paid IS NOT NULL, 'good': paid <= due, 'bad': 'warning'}},
  {{'rule': 'R4', 'seen': slips > 0, 'good': declared = slips, 'bad': 'warning'}},
  {{'rule': 'R5', 'seen': declared = slips, 'good': abs(gross - s_gross) <= 0.01 OR abs(gross - s_gross) / greatest(gross, s_gross, 1) <= 0.001, 'bad': 'error'}},
  {{'rule': 'R6', 'seen': declared = slips, 'good': abs(cost - s_cost) <= 0.01 OR abs(cost - s_cost) / greatest(cost, s_cost, 1) <= 0.001, 'bad': 'error'}}]) AS x FROM doc),
ruled AS (SELECT k, company, period, x.rule AS rule, CASE WHEN NOT x.seen THEN 'not_evaluated' WHEN x.good THEN 'passed' ELSE 'failed' END AS status, CASE WHEN x.seen AND NOT x.good THEN x.bad ELSE 'info' END AS severity FROM good)"""


@query(f"WITH {RULES_SQL} SELECT 'ord-' || k AS event_ref, rule, status, severity FROM ruled")
def validation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = finance.fuse_events(payroll_documents(spark, sf_dir))
    return finance.validation_rules(events.withColumn("event_id", F.col("event_ref"))).select(F.col("event_id").alias("event_ref"), "rule", "status", "severity")


@query("""
WITH f AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, vec_id % 4 AS c FROM embeddings WHERE label IS NOT NULL)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 4) AS similarity, CASE WHEN least(a.c, b.c) = 0 AND greatest(a.c, b.c) >= 2 THEN 'punctuality' ELSE 'payment' END AS cluster
FROM f a JOIN f b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.c <> b.c AND NOT (least(a.c, b.c) = 1 AND greatest(a.c, b.c) = 2) AND list_cosine_similarity(a.v, b.v) >= 0.2""")
def semantic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = F.element_at(F.array(*[F.lit(x) for x in ("Was paid on time.", "This is not paid yet.", "Unpaid and overdue", "settled late")]), (F.col("vec_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("id"), "label", "embedding", says.alias("content"))
    return meaning.semantic_findings(rows, ["label"], 0.2)


@query(f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents), w AS (SELECT DISTINCT term FROM t),
h AS (SELECT term, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(term, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM w),
b AS (SELECT doc_id, least(h, 4294967296 - h) % 256 AS bucket, count(*) AS n FROM t JOIN h USING (term) GROUP BY 1, 2),
s AS (SELECT doc_id, count(*) AS n_buckets, sum(bucket * n) / sqrt(sum(n * n)) AS moment FROM b GROUP BY 1)
SELECT doc_id, coalesce(n_buckets, 0) AS n_buckets, round(coalesce(moment, 0), 6) AS moment FROM documents LEFT JOIN s USING (doc_id)""")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = meaning.hash_embed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 256)
    moment = F.aggregate(F.transform("embedding", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return vectors.select(F.col("id").alias("doc_id"), F.size(F.filter("embedding", lambda x: x != 0)).alias("n_buckets"), F.round(moment, 6).alias("moment"))


_FIGURES = "list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')))"


@query(f"""
WITH a AS (SELECT DISTINCT conv_id, unnest({_FIGURES}) AS f FROM conversations WHERE role = 'assistant'),
e AS (SELECT DISTINCT conv_id, unnest({_FIGURES}) AS f FROM conversations WHERE role <> 'assistant'),
q AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant')
SELECT conv_id AS query_id, count(a.f) AS n_figures, count(e.f) AS n_traced FROM q LEFT JOIN a USING (conv_id) LEFT JOIN e ON e.conv_id = q.conv_id AND e.f = a.f GROUP BY 1""")
def figure_traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "role", "text")
    return meaning.figure_traceability(turns.where("role = 'assistant'"), turns.where("role <> 'assistant'"))


@query(f"""
WITH {MEMORIES_SQL}
SELECT id AS memory_id, CASE WHEN k % 2 = 0 THEN 'correct' ELSE 'incorrect' END AS outcome, CASE WHEN k % 2 = 0 THEN 0.95 ELSE round(importance, 2) END AS importance, k % 2 = 1 AS superseded FROM mem WHERE kind = 'document'""")
def apply_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.with_subject(memories(spark, sf_dir)).withColumn("superseded_at", F.lit(None).cast("timestamp"))
    even = F.substring_index("id", "-", -1).cast("long") % 2 == 0
    said = rows.where("kind = 'document'").select(F.concat(F.lit("f-"), "id").alias("feedback_id"), F.col("id").alias("memory_id"), F.when(even, "correct").otherwise("incorrect").alias("outcome"), F.lit("corrected").alias("correction"))
    updated, _, _ = lifecycle.apply_feedback(rows, said)
    return updated.withColumn("importance", F.round("importance", 2))


@query("""
WITH c AS (SELECT lang, source, count(DISTINCT quality) > 1 AS unstable FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT lang AS arm, count(*) AS cases, count(*) FILTER (unstable) AS unstable, round((1 - count(*) FILTER (unstable) / count(*)) * 100, 6) AS stable_pct FROM c GROUP BY 1""")
def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    found = usage.run_stability(rows.select(F.col("lang").alias("arm"), F.col("source").alias("case_id"), F.col("quality").alias("predicted")))
    return found.withColumn("stable_pct", F.round("stable_pct", 6))


@query(f"WITH {MEMORIES_SQL} SELECT id, kind FROM mem WHERE company_key = 'building' AND kind IN ('invoice', 'insight') AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY IS FALSE")
def scan_memories_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.with_subject(memories(spark, sf_dir))
    old = F.col("created_at") < F.lit("1997-01-01").cast("timestamp")
    return scan_active(rows.withColumn("superseded_at", F.when(old, F.col("created_at"))), "_public", company_key="building", kinds=["invoice", "insight"]).select("id", "kind")


@query(f"""
WITH {MEMORIES_SQL},
odd AS (SELECT k, company_key, period, subject, count(*) AS n, count(DISTINCT status) > 1 AS s, max(total) - min(total) > 0.5 AS t FROM mem GROUP BY ALL HAVING count(*) = 2)
SELECT company_key, period, subject, 'total' AS attr, 2 AS n_values, 'a-' || k AS low_id, 'b-' || k AS high_id FROM odd WHERE t
UNION ALL SELECT company_key, period, subject, 'status', 2, 'a-' || k, 'b-' || k FROM odd WHERE s""")
def contradiction_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.contradiction_alerts(memories(spark, sf_dir))


@query(f"""
WITH {MEMORIES_SQL},
p AS (SELECT a.k, a.importance AS ia, b.id IS NOT NULL AS two, abs(a.total - b.total) > 0.5 AS odd FROM mem a LEFT JOIN mem b ON a.k = b.k AND b.id LIKE 'b-%' WHERE a.id LIKE 'a-%'),
s AS (SELECT *, CASE WHEN k % 3 = 2 THEN 'stale' WHEN two <> (k % 3 = 0) THEN 'incomplete' WHEN two AND odd THEN 'resolved' ELSE 'no_conflict' END AS state FROM p)
SELECT 'd-' || k AS decision_id, state, CASE WHEN state = 'resolved' THEN 'b-' || k END AS superseded, CASE WHEN state = 'resolved' THEN 0.95::DOUBLE END AS importance FROM s""")
def apply_conflict_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision an order: on both memories, without the target, or for a row that is not there."""
    rows = memories(spark, sf_dir)
    k = F.substring_index("id", "-", -1)
    case = k.cast("long") % 3
    decisions = audit.with_subject(rows).where(F.col("id").startswith("a-")).select(
        F.concat(F.lit("d-"), k).alias("decision_id"), "company_key", "period", "subject", F.lit("total").alias("attr"),
        F.concat(F.when(case == 2, "x-").otherwise("a-"), k).alias("selected_id"), F.when(case == 0, F.array(F.concat(F.lit("b-"), k))).otherwise(F.array().cast("array<string>")).alias("target_ids"))
    return lifecycle.apply_conflict_decisions(rows, decisions).select("decision_id", "state", F.array_join("superseded_ids", ",").alias("superseded"), "importance")


@query("SELECT o_orderkey AS operation_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'run' WHEN o_orderkey % 8 = 0 THEN 'conflict' ELSE 'replay' END AS state, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 THEN o_orderstatus END AS result FROM orders")
def operation_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth order was logged; the price of every eighth has changed since."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    mark = lambda price: F.sha2(F.to_json(F.struct("o_custkey", price.alias("price"))), 256).alias("request_hash")
    price = F.col("o_totalprice")
    log = orders.where(key % 4 == 0).select(key.alias("operation_id"), mark(F.when(key % 8 == 0, price + 1).otherwise(price)), F.col("o_orderstatus").alias("result"))
    return lifecycle.replay_operations(orders.select(key.alias("operation_id"), mark(price)), log)


@query("""
WITH j AS (SELECT a.arm, r.rep, doc_id, quality = 1 AS e, CASE WHEN a.arm = 'baseline' THEN toxic = 0 ELSE toxic = 0 AND (n_chars > 100 OR r.rep = 2) END AS p FROM labels JOIN documents USING (doc_id), (VALUES ('baseline'), ('candidate')) a(arm), (VALUES (1), (2)) r(rep)),
m AS (SELECT arm, rep, 100 * avg((e = p)::INT) AS accuracy, 100 * count(*) FILTER (e AND p) / count(*) FILTER (p) AS "precision", 100 * count(*) FILTER (e AND p) / count(*) FILTER (e) AS recall FROM j GROUP BY ALL),
v AS (SELECT arm, measure, value FROM m UNPIVOT (value FOR measure IN (accuracy, "precision", recall))
  UNION ALL SELECT arm, 'stability', 100 * avg(s) FROM (SELECT arm, doc_id, (count(DISTINCT p) = 1)::INT AS s FROM j GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT 'absolute' AS gate, arm, measure, round(min(value), 4) AS value, 60.0 AS threshold FROM v GROUP BY ALL
  UNION ALL SELECT 'gain', 'candidate', measure, round(avg(value) FILTER (arm = 'candidate') - avg(value) FILTER (arm = 'baseline'), 4), -1.0 FROM v GROUP BY measure)
SELECT *, value >= threshold AS passed FROM g""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    runs = labels.withColumns({"arm": F.explode(F.array(F.lit("baseline"), F.lit("candidate")))}).withColumn("repetition", F.explode(F.array(F.lit(1), F.lit(2))))
    clean = F.col("toxic") == 0
    said = F.when(F.col("arm") == "baseline", clean).otherwise(clean & ((F.col("n_chars") > 100) | (F.col("repetition") == 2)))
    judged = runs.select("arm", "repetition", F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("expected"), said.alias("predicted"), F.lit("ok").alias("status"))
    measures = ("accuracy", "precision", "recall", "stability")
    return usage.promotion_gate(judged, dict.fromkeys(measures, 60.0), dict.fromkeys(measures, -1.0))


@query()
def plan_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language whose token vectors are alike; tests hold it against the plain scan."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text", "n_chars")
    vectors = meaning.hash_embed(docs.select("id", "text"), 1024).join(docs.select("id", "lang", "n_chars"), "id")
    rows = vectors.select("id", "lang", F.col("n_chars").cast("double").alias("importance"), F.lit(None).cast("timestamp").alias("created_at"), "embedding")
    return consolidation.plan_consolidation(rows, ["lang"], 0.95)
