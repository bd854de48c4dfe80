"""Profit and loss, payroll and ingest over the given tables, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cosine, marked_figures, money_text, request_hash, safe_number, scrub, valid_date
from ..operators import finance, ingest, pnl
from ..sources.tables import vectors_from_text, vectors_to_text
from .facts import PAYROLL_SQL, payroll_documents, table
from .queries import RULES_SQL, query

_KIND = "CASE o_orderkey % 3 WHEN 0 THEN 'payroll_event' ELSE 'invoice' END"
#: A fact for each order: payroll, a purchase or a sale by its key, in the currency of the customer's nation.
FACTS_SQL = f"""
fact AS (SELECT o_orderkey AS id, {_KIND} AS kind, CASE o_orderkey % 3 WHEN 1 THEN 'purchase' WHEN 2 THEN 'sales' END AS type, CASE c_nationkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' END AS currency,
  lower(c_mktsegment) AS company, strftime(o_orderdate, '%Y-%m') AS period, o_custkey || '/' || (o_custkey % 2) AS business_key, o_orderdate AS created_at, CASE WHEN o_custkey % 11 = 0 THEN '__smoke__' ELSE 'v' || o_custkey % 7 END AS vendor,
  o_orderkey % 9 AS employee_count, CASE WHEN o_custkey % 13 > 0 THEN o_totalprice + o_custkey % 100 END AS cost, o_totalprice AS gross, CASE WHEN o_custkey % 2 = 1 THEN o_custkey % 100 END AS ss, o_custkey % 30 AS ess, o_custkey % 20 AS tax,
  o_totalprice - o_custkey % 50 AS bank, o_totalprice AS total, CASE WHEN o_orderstatus = 'P' THEN o_totalprice - 100 END AS paid, CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_custkey % 17 > 0 THEN 'unpaid' END AS status FROM orders JOIN customer ON o_custkey = c_custkey),
rel AS (SELECT * FROM fact WHERE (kind = 'payroll_event' AND cost IS NOT NULL) OR (kind = 'invoice' AND vendor <> '__smoke__')),
live AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY kind, type, currency, business_key ORDER BY created_at DESC, id) AS n FROM rel) WHERE n = 1 OR currency IS NULL),
cash AS (SELECT *, CASE WHEN kind = 'invoice' AND type = 'purchase' THEN CASE WHEN paid IS NOT NULL AND paid <= 0 THEN 'unpaid' WHEN paid < total - 0.01 THEN 'partial' WHEN paid IS NOT NULL THEN 'paid' WHEN status IN ('paid', 'unpaid') THEN status ELSE 'unknown' END END AS cash_status FROM live)"""


def business_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, cust, price, nation = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice"), F.col("c_nationkey") % 4
    double = lambda x: x.cast("double")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        key.alias("id"), F.when(key % 3 == 0, "payroll_event").otherwise("invoice").alias("kind"), F.when(key % 3 == 1, "purchase").when(key % 3 == 2, "sales").alias("type"),
        F.when(nation == 0, "EUR").when(nation == 1, "USD").when(nation == 2, "GBP").alias("currency"), F.lower("c_mktsegment").alias("company"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.concat(cust, F.lit("/"), cust % 2).alias("business_key"), F.col("o_orderdate").alias("created_at"), F.when(cust % 11 == 0, pnl.SMOKE).otherwise(F.concat(F.lit("v"), cust % 7)).alias("vendor"),
        double(key % 9).alias("employee_count"), F.when(cust % 13 > 0, price + cust % 100).alias("employer_cost_total"), price.alias("gross_total"), (price - cust % 50).alias("bank_net_total"),
        F.when(cust % 2 == 1, double(cust % 100)).alias("employer_social_security_total"), double(cust % 30).alias("employee_social_security_total"), double(cust % 20).alias("tax_withheld_total"),
        price.alias("total"), F.when(F.col("o_orderstatus") == "P", price - 100).alias("paid_amount"), F.when(F.col("o_orderstatus") == "F", "paid").when(cust % 17 > 0, "unpaid").alias("payment_status"),
        F.lit(None).cast("string").alias("customer"), F.concat(F.lit("r-"), key).alias("vendor_ref"), F.when(key % 2 == 0, F.concat(F.lit("i-"), key)).alias("invoice_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"),
    )


def _measures_sql(keys: list[str]) -> str:
    """All measures of a grouping of the facts."""
    shown = ", ".join(f"{k if k in keys else 'NULL::VARCHAR'} AS {k}" for k in ("currency", "company", "period"))
    up = lambda x: f"CASE WHEN currency_status IN ('single', 'empty') THEN floor(({x}) * 100 + 0.5) / 100 END"
    pay, buy, sell = "kind = 'payroll_event'", "type = 'purchase'", "type = 'sales'"
    total = lambda x, where: f"round(coalesce(sum({x}) FILTER ({where}), 0)::DOUBLE, 6)"
    return f"""
m AS (SELECT {', '.join([*keys, '']) if keys else ''} count(*) AS events, count(*) FILTER (currency IS NULL) AS unknown_currency_records, min(currency) AS lo, max(currency) AS hi, {total('employee_count', pay)}::BIGINT AS employee_count,
  count(*) FILTER (cash_status = 'unknown') AS purchase_cash_unknown_count, {total('cost', pay)} AS c, {total('gross', pay)} AS g, {total('coalesce(ss, cost - gross)', pay)} AS es, {total('ess', pay)} AS ps, {total('tax', pay)} AS tx, {total('bank', pay)} AS b,
  {total('total', buy)} AS bought, {total("CASE cash_status WHEN 'unpaid' THEN 0 WHEN 'unknown' THEN NULL ELSE coalesce(paid, total) END", buy)} AS paid, {total('total', "cash_status = 'unknown'")} AS open, {total('total', sell)} AS sold FROM cash {'GROUP BY ' + ', '.join(keys) if keys else ''}),
s AS (SELECT *, CASE WHEN events = 0 THEN 'empty' WHEN unknown_currency_records = 0 AND lo = hi THEN 'single' WHEN lo IS NULL THEN 'unknown' ELSE 'mixed' END AS currency_status FROM m)
SELECT {shown}, currency_status, events, unknown_currency_records, employee_count, purchase_cash_unknown_count, {up('c')} AS employer_cost_total, {up('g')} AS gross_total, {up('es')} AS employer_social_security_total, {up('ps')} AS employee_social_security_total,
  {up('tx')} AS tax_withheld_total, {up('b')} AS cash_out_total, {up('c - b')} AS off_bank_cost, {up('CASE WHEN b > 0 THEN (c - b) / b * 100 END')} AS off_bank_cost_pct, {up('CASE WHEN b > 0 THEN es / b * 100 END')} AS cost_gap_pct,
  {up('CASE WHEN employee_count > 0 THEN c / employee_count END')} AS avg_cost_per_employee, {up('bought')} AS purchases_total, {up('paid')} AS purchase_cash_out_total, {up('open')} AS purchase_cash_unknown_total, {up('sold')} AS revenue_total, {up('c + bought')} AS total_expenses,
  {up('CASE WHEN purchase_cash_unknown_count = 0 THEN b + paid END')} AS net_cash_outflow, {up('sold - (c + bought)')} AS net_profit, {up('CASE WHEN sold > 0 THEN (sold - (c + bought)) / sold * 100 END')} AS net_profit_margin_pct FROM s"""


@query(f"WITH {FACTS_SQL}, {_measures_sql(['currency'])}")
def pnl_measures_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.pnl(business_facts(spark, sf_dir), [["currency"]])


@query(f"WITH {FACTS_SQL}, {_measures_sql(['currency', 'company', 'period'])}")
def pnl_measures_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.pnl(business_facts(spark, sf_dir), [["currency", "company", "period"]])


@query(f"WITH {FACTS_SQL}, {_measures_sql([])}")
def pnl_measures_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.pnl(business_facts(spark, sf_dir), [[]])


@query(f"WITH {FACTS_SQL} SELECT kind, type, count(*) AS n, count(DISTINCT business_key) AS n_keys FROM rel GROUP BY ALL")
def pnl_relevant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.relevant(business_facts(spark, sf_dir)).groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("business_key").alias("n_keys"))


@query(f"""
WITH {FACTS_SQL}
SELECT CASE type WHEN 'sales' THEN 'sale' ELSE 'purchase' END AS side, CASE type WHEN 'sales' THEN company ELSE vendor END AS party, CASE WHEN type = 'sales' AND id % 2 = 0 THEN 'i-' || id ELSE 'r-' || id END AS invoice_number, total AS amount, strftime(created_at, '%Y-%m-%d') AS invoice_date, currency,
  cash_status, CASE WHEN type = 'purchase' THEN CASE cash_status WHEN 'unpaid' THEN 0 WHEN 'unknown' THEN NULL ELSE coalesce(paid, total) END END AS paid_amount FROM cash WHERE kind = 'invoice' AND currency IS NOT NULL""")
def pnl_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.line_items(business_facts(spark, sf_dir))


_SLIPS_SQL = f"""
{PAYROLL_SQL},
slip AS (SELECT o_orderkey AS k, l_extendedprice AS price, 'e' || row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS e FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey),
event AS (SELECT *, 'evt-' || lower(company) || '-ord-' || k || '-' || substr(sha256(lower(company) || chr(0) || 'ord-' || k), 1, 12) || '-' || period AS event_id, CASE WHEN k % 7 = 0 THEN n + 1 ELSE n END AS people, gross * 1.1 AS cost, gross * (CASE WHEN k % 3 = 0 THEN 0.75 ELSE 0.8 END) AS bank FROM run WHERE k % 10 <> 0)"""
_UP = "floor(({0}) * 100 + 0.5) / 100"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.with_withheld(finance.fuse_events(payroll_documents(spark, sf_dir))[0])


@query(f"""
WITH {_SLIPS_SQL},
best AS (SELECT k, string_agg(e, ',' ORDER BY price * 1.1 DESC, e) AS top FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY price * 1.1 DESC, e) AS r FROM slip) WHERE r <= 5 GROUP BY 1)
SELECT event_id, people AS employee_count, {_UP.format('cost')} AS employer_cost_total, {_UP.format('bank')} AS cash_out_total, {_UP.format('(cost - bank) / bank * 100')} AS off_bank_cost_pct, {_UP.format('cost / people')} AS avg_cost_per_employee, top AS top_employees FROM event JOIN best USING (k)""")
def pnl_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pnl.event_pnl(_events(spark, sf_dir))
    best = F.array_join(F.transform("top_employees", lambda e: e["employee_id"]), ",")
    return found.select("event_id", "employee_count", "employer_cost_total", "cash_out_total", "off_bank_cost_pct", "avg_cost_per_employee", best.alias("top_employees"))


@query(f"WITH {PAYROLL_SQL} SELECT 'ord-' || k AS event_ref, CASE WHEN k % 7 = 0 THEN 'employee_count' WHEN k % 3 = 0 THEN 'bank_net_total' END AS problem FROM run WHERE k % 10 <> 0")
def payroll_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_ref", ingest.payroll_problem().alias("problem"))


def _money_sql(value: str, rounded: bool = True) -> str:
    return f"'EUR ' || regexp_replace(format('{{:,.2f}}', {_UP.format(value) if rounded else value}), '\\.?0+$', '')"


@query(f"""
WITH {_SLIPS_SQL}
SELECT event_id, 'payroll_event' AS kind, 'event:' || event_id || ':summary' AS idempotency_key, NULL::DOUBLE AS importance, 'Workforce cost for ' || company || ' in ' || period || ': ' || people || ' employees, gross ' || {_money_sql('gross')} || ', true employer cost ' || {_money_sql('cost')} || ', net paid from bank ' || {_money_sql('bank')} || '.' AS content FROM event
UNION ALL SELECT event_id, 'insight', 'event:' || event_id || ':insight', 0.9, 'Off-bank workforce-cost comparison at ' || company || ' for ' || period || ': the bank salary transfer of ' || {_money_sql('bank')} || ' is below the true employer cost of ' || {_money_sql('cost')} || ' by ' || {_money_sql(_UP.format('cost - bank'))}
  || ' (' || format('{{:.1f}}', floor((cost - bank) / bank * 100 * 10 + 0.5) / 10) || '% of the transfer). Employer social-security contributions are ' || {_money_sql('cost - gross')} || ' (' || format('{{:.1f}}', floor((cost - gross) / bank * 100 * 10 + 0.5) / 10) || '% of the bank transfer).' FROM event
UNION ALL SELECT event_id, 'payroll_event', 'event:' || event_id || ':employee:' || e, NULL, 'n (id ' || e || ') at ' || company || ' in ' || period || ': gross ' || {_money_sql('price')} || ', net ' || {_money_sql('price * 0.8')} || ', employer cost ' || {_money_sql('price * 1.1')} || '.' FROM event JOIN slip USING (k)""")
def event_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.event_memories(_events(spark, sf_dir)).select("event_id", "kind", "idempotency_key", "importance", "content")


@query(f"""
WITH {RULES_SQL},
named AS (SELECT *, 'evt-' || lower(company) || '-ord-' || k || '-' || substr(sha256(lower(company) || chr(0) || 'ord-' || k), 1, 12) || '-' || period AS event_id FROM ruled)
SELECT 'event:' || event_id || ':validation:' || rule AS idempotency_key, 'Validation ' || upper(status) || ' for ' || company || ' ' || period || ' — ' || rule AS content FROM named""")
def validation_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return ingest.validation_memories(finance.validation_rules(events, keep=("company", "period"))).select("idempotency_key", "content")


@query("""
WITH raw AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' eur ' WHEN 1 THEN 'Usd' WHEN 2 THEN 'EURO' WHEN 3 THEN NULL ELSE 'EUR' END AS currency FROM customer)
SELECT c_custkey, CASE WHEN upper(trim(currency)) IN ('EUR', 'USD') THEN upper(trim(currency)) END AS currency FROM raw""")
def normalize_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth label is in full-width letters, which NFKC makes plain."""
    case = F.col("c_custkey") % 5
    raw = F.when(case == 0, " eur ").when(case == 1, "Usd").when(case == 2, "EURO").when(case == 4, "ＥＵＲ")
    return ingest.normalize_currency(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("currency")))


@query("""
WITH i AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS purchase, c_mktsegment AS company, strftime(o_orderdate, '%Y-%m') AS period, c_name AS party, o_totalprice AS total, o_orderkey % 9 AS bad FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CASE bad WHEN 1 THEN 'currency' WHEN 2 THEN CASE WHEN purchase THEN 'purchase_needs_vendor' ELSE 'sale_needs_customer' END WHEN 3 THEN 'date' WHEN 4 THEN 'period' WHEN 5 THEN 'paid_amount' WHEN 6 THEN 'unpaid_date' END AS error,
  CASE WHEN bad IN (0, 7, 8) THEN 'invoice:' || sha256('["' || CASE WHEN purchase THEN 'purchase' ELSE 'sales' END || '","' || lower(company) || '","' || period || '","' || lower(party) || '","no ' || o_orderkey || '"]') END AS idempotency_key FROM i""")
def ingest_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invoice an order; most have something wrong by their key."""
    orders, customer, key = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), F.col("o_orderkey")
    bad, purchase, day = key % 9, key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")
    party = F.when(bad != 2, F.col("c_name"))
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        "o_orderkey", F.when(purchase, "purchase").otherwise("sales").alias("type"), F.col("c_mktsegment").alias("company"), F.when(bad == 4, "1970-01").otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("period"),
        F.when(bad == 3, "1996-02-31").otherwise(day).alias("date"), F.when(bad == 1, "eur").otherwise("EUR").alias("currency"), F.col("o_totalprice").alias("total"), F.concat(F.lit("No  "), key).alias("invoice_ref"),
        F.when(purchase, party).alias("vendor"), F.when(~purchase, party).alias("customer"), F.when(bad == 5, F.col("o_totalprice") + 1).alias("paid_amount"), F.when(bad == 6, "unpaid").alias("status"), F.when(bad == 6, day).alias("payment_date"))
    good, rejected = ingest.ingest_invoices(rows)
    none = F.lit(None).cast("string")
    return good.select("o_orderkey", none.alias("error"), "idempotency_key").unionByName(rejected.select("o_orderkey", "error", none.alias("idempotency_key")))


@query("""
SELECT doc_id, quality = 1 AND toxic = 0 AS contradict, CASE WHEN toxic = 0 THEN 0.25 * quality + 0.5 ELSE 0 END AS confidence, CASE WHEN toxic = 0 THEN 'ok' ELSE 'inconclusive' END AS status FROM labels""")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's output for each label: fenced or plain JSON, with a key too many where the label is toxic."""
    yes = F.when(F.col("quality") == 1, "true").otherwise("false")
    body = F.concat(F.lit('{"contradict": '), yes, F.lit(', "confidence": '), (F.col("quality") * 0.25 + 0.5).cast("string"), F.lit(', "reason": "says so"'), F.when(F.col("toxic") == 1, ', "extra": 1}').otherwise("}"))
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return ingest.parse_verdicts(table(spark, sf_dir, "labels").select("doc_id", raw.alias("raw"))).select("doc_id", "contradict", "confidence", "status")


@query(r"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, CASE WHEN label IS NULL THEN 'n/a' ELSE 'USD ' || regexp_replace(format('{:,.2f}', (label * 1234.5)::DOUBLE), '\.?0+$', '') END AS money, 'a b' || vec_id AS clean, vec_id % 31 BETWEEN 1 AND 28 AS good_date, CASE WHEN vec_id % 2 = 0 THEN vec_id::DOUBLE ELSE -1 END AS number,
  round(coalesce(list_cosine_similarity(v, list_reverse(v)), 0), 6) AS mirrored, [(vec_id * 1000 + 1)::VARCHAR, '2.5'] AS figures FROM e""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money text, scrubbed text, dates, numbers, cosines, vectors as text and back, figures beside a euro mark."""
    key = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("float")))
    rows = vectors_from_text(vectors_to_text(rows))
    v = F.transform("embedding", lambda x: x.cast("double"))
    said = F.concat(F.lit("€ "), F.format_number(key * 1000 + 1, 0), F.lit(" and 2.5EUR but not 7"))
    return rows.select(
        "vec_id", money_text((F.col("label") * 1234.5).cast("double"), F.lit("USD")).alias("money"), scrub(F.concat(F.lit("\x07a\tb"), key.cast("string"), F.lit("\n"))).alias("clean"),
        valid_date(F.concat(F.lit("2023-02-"), F.lpad((key % 31).cast("string"), 2, "0"))).alias("good_date"), safe_number(F.when(key % 2 == 0, key.cast("string")).when(key % 3 == 0, "NaN").otherwise("x"), -1.0).alias("number"),
        F.round(cosine(v, F.reverse(v)), 6).alias("mirrored"), marked_figures(said).alias("figures"),
    )


@query("SELECT sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS mark, count(*) AS n FROM orders GROUP BY 1")
def canonical_request_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(request_hash("o_orderstatus", "o_custkey").alias("mark")).agg(F.count(F.lit(1)).alias("n"))
