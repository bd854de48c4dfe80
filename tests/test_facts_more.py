"""Ingest, reports, retrieval on any id type."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions.scalars import canonical_label, request_hash, shuffled
from factloom.operators import finance, ingest, lifecycle, pnl, reports, retrieval, usage
from factloom.sources import tables

CODES = ["EUR", "USD"]


def test_currency_labels(spark):
    rows = spark.createDataFrame([(1, "ｅｕｒ"), (2, " usd"), (3, None), (4, "XXX"), (5, "")], "k long, currency string")
    assert {r.k: r.currency for r in ingest.normalize_currency(rows, codes=CODES).collect()} == {1: "EUR", 2: "USD", 3: None, 4: None, 5: None}
    assert "EUR" in ingest.iso_currencies(spark)
    labels = spark.createDataFrame([("Ａcme  Ltd",), (None,)], "label string")
    assert sorted(r[0] for r in ingest.nfkc(labels, "label").select(canonical_label(F.col("label"))).collect()) == ["_global", "acme ltd"]


GOOD = ("purchase", "Acme", "2024-02", "2024-02-29", "EUR", 10.0, "A 1", "V", None, None, None, None)


@pytest.mark.parametrize("change, error", [
    ({}, None), ({0: "gift"}, "type"), ({1: " "}, "company_blank"), ({6: None}, "invoice_ref_blank"), ({4: "EURO"}, "currency"), ({7: None}, "purchase_needs_vendor"), ({8: "C"}, "purchase_has_customer"), ({0: "sales", 7: None}, "sale_needs_customer"),
    ({0: "sales", 8: "C"}, "sale_has_vendor"), ({0: "sales", 7: None, 8: "C"}, None), ({3: "2024-02-30"}, "date"), ({2: "2024-03"}, "period"), ({11: "x"}, "payment_date"), ({11: "2024-02-01"}, "payment_before_date"), ({5: 0.0}, "total"), ({5: float("nan")}, "total"),
    ({9: 11.0}, "paid_amount"), ({9: 5.0, 10: "paid"}, "paid_in_part"), ({10: "partial"}, "partial_amount"), ({9: 5.0, 10: "partial"}, None), ({9: 1.0, 10: "unpaid"}, "unpaid_amount"), ({10: "unpaid", 11: "2024-03-01"}, "unpaid_date"),
])
def test_invoice_rules(spark, change, error):
    row = tuple(change.get(i, x) for i, x in enumerate(GOOD))
    good, bad = ingest.ingest_invoices(spark.createDataFrame([row], ingest.INVOICE), CODES)
    assert [r.error for r in bad.collect()] == ([error] if error else []) and good.count() == (error is None)


def test_verdicts(spark):
    fine = '{"contradict": true, "confidence": 1.5, "reason": "a\\u0007b"}'
    raws = [fine, f"```json\n{fine}\n```", '{"contradict": "yes", "confidence": 1, "reason": "x"}', '{"contradict": true, "confidence": 1, "reason": " "}', '{"contradict": true, "confidence": 1}', "[1]", "", None, fine[:-1] + ', "more": 1}']
    rows = ingest.parse_verdicts(spark.createDataFrame(list(enumerate(raws)), "k int, raw string")).orderBy("k").collect()
    assert [(r.contradict, r.confidence, r.status) for r in rows] == [(True, 1.0, "ok")] * 2 + [(False, 0.0, "inconclusive")] * 7
    assert rows[0].reason == "a b" and rows[3].reason == "unparseable judge response"


def test_payroll_problems(spark):
    slip = "struct<employee_id:string,gross:double,employee_social_security:double,tax:double,net:double,employer_social_security:double,employer_cost:double>"
    base = {"gross_total": 100.0, "employer_social_security_total": 20.0, "employee_social_security_total": 10.0, "tax_withheld_total": 15.0, "employer_cost_total": 120.0, "bank_net_total": 75.0, "employee_count": 1, "employees": [("e", 100.0, 10.0, 15.0, 75.0, 20.0, 120.0)]}
    cases = [({}, None), ({"employee_count": 2}, "employee_count"), ({"tax_withheld_total": -1.0}, "negative_tax_withheld_total"), ({"gross_total": None}, "negative_gross_total"), ({"employees": [("e", 100.0, 10.0, 15.0, 75.0, 20.0, 119.0)]}, "employee_cost"),
             ({"employees": [("e", 100.0, 10.0, 15.0, 74.0, 20.0, 120.0)]}, "employee_gross"), ({"bank_net_total": 80.0}, "bank_net_total"), ({"employees": [("e", -1.0, 10.0, 15.0, 75.0, 20.0, 120.0)]}, "negative_employee_gross")]
    rows = [tuple((base | change).values()) for change, _ in cases]
    events = spark.createDataFrame(rows, f"gross_total double, employer_social_security_total double, employee_social_security_total double, tax_withheld_total double, employer_cost_total double, bank_net_total double, employee_count int, employees array<{slip}>")
    assert [r[0] for r in events.select(ingest.payroll_problem()).collect()] == [want for _, want in cases]


def test_pnl_of_nothing(spark):
    columns = "id long, kind string, type string, currency string, company string, period string, business_key string, created_at timestamp, vendor string, employee_count double, employer_cost_total double, gross_total double, bank_net_total double, employer_social_security_total double, employee_social_security_total double, tax_withheld_total double, total double, paid_amount double, payment_status string"
    none = spark.createDataFrame([], columns)
    row = pnl.pnl(none, [[]]).collect()
    assert len(row) == 1 and row[0].currency_status == "empty" and row[0].net_profit == 0.0 and pnl.pnl(none, [["currency"]]).count() == 0
    two = spark.createDataFrame([(1, "invoice", "sales", "EUR", "a", "p", "k", None, "v", *[None] * 7, 5.0, None, None), (2, "invoice", "sales", "USD", "a", "p", "k", None, "v", *[None] * 7, 7.0, None, None)], columns)
    found = {(r.currency, r.company): (r.currency_status, r.revenue_total) for r in pnl.pnl(two, [["currency"], ["company"], []]).collect()}
    assert found == {("EUR", None): ("single", 5.0), ("USD", None): ("single", 7.0), (None, "a"): ("mixed", None), (None, None): ("mixed", None)}


def test_vectors_by_string_ids(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((30, 8))
    v[7] = v[3]
    rows = spark.createDataFrame([(f"a-{i}", "s", [float(x) for x in row]) for i, row in enumerate(v)], "id string, scope string, embedding array<double>")
    asked = rows.limit(0).union(rows.where("id in ('a-3', 'a-5')")).select(F.col("id").alias("query_id"), "embedding")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = retrieval.knn_dense(rows, asked, 4).collect()
    for q in (3, 5):
        scores = np.round(unit @ unit[q], 9)
        want = sorted(range(30), key=lambda i: (-scores[i], f"a-{i}"))[:4]
        assert [r.id for r in sorted((r for r in hits if r.query_id == f"a-{q}"), key=lambda r: r.rank)] == [f"a-{i}" for i in want]
    mixed = retrieval.knn_dense(rows, asked.select(F.lit(12).cast("long").alias("query_id"), "embedding").limit(1), 2)
    assert dict(mixed.dtypes) == {"query_id": "bigint", "id": "string", "score": "double", "rank": "int"} and mixed.count() == 2
    pairs = {(r.a, r.b) for r in lifecycle.similar_pairs(rows, ["scope"], 0.6).collect()}
    assert pairs == {tuple(sorted((f"a-{i}", f"a-{j}"))) for i in range(30) for j in range(i) if unit[i] @ unit[j] >= 0.6} and ("a-3", "a-7") in pairs


def test_rerank_and_reports(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, id long, rank int")
    scores = spark.createDataFrame([(1, 12, 0.5), (1, 11, 0.5)], "query_id long, id long, score double")
    assert [(r.id, r.new_rank) for r in sorted(retrieval.rerank(hits, scores).collect(), key=lambda r: r.new_rank)] == [(11, 1), (12, 2), (10, 3)]
    rows = spark.createDataFrame([(i, "s", 0.5, None, "Was paid on time." if i % 2 else "Not paid yet, and late.", [1.0, float(i) / 10]) for i in range(4)], "id long, scope string, importance double, created_at timestamp, content string, embedding array<double>")
    judged = reports.judged_pairs(rows, ["scope"], 0.9)
    report = reports.semantic_report(rows, judged).first()
    assert (report.compared, report.contradictions, report.status, report.ok) == (6, 4, "complete", False)
    assert reports.semantic_report(rows, reports.judged_pairs(rows, ["scope"], 0.9, limit=2), candidate_pairs=6).first().status == "partial"
    none = spark.createDataFrame([], "a long, b long, contradict boolean, status string")
    assert reports.semantic_report(rows, reports.judged_pairs(rows, ["scope"], 0.9, verdicts=none)).first().status == "inconclusive"
    chosen, more = reports.bounded_selection(rows, 2)
    assert [r.id for r in chosen.collect()] == [0, 1] and rows.select(more).first()[0] and not rows.select(reports.bounded_selection(rows, 4)[1]).first()[0]


def test_small_functions(spark, tmp_path):
    one = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], "x", None)], "v array<double>, a string, b string")
    got = one.select(shuffled(F.col("v"), 4).alias("s"), request_hash("b", "a").alias("h"), request_hash("a", "b").alias("i")).first()
    assert sorted(got.s) == [1.0, 2.0, 3.0, 4.0] and got.h == got.i
    assert usage.table_fingerprint(one).first() == usage.table_fingerprint(one.repartition(3)).first() and usage.table_fingerprint(one.union(one)).first().n == 2
    (tmp_path / "d.json").write_text('{"doc_id": "1", "content": "c"}\nbroken\n')
    good, bad = tables.read_raw_documents(spark, str(tmp_path / "d.json"))
    assert [r.doc_id for r in good.collect()] == ["1"] and bad.count() == 1
    rows = spark.createDataFrame([("1", "t", "a"), ("2", "u", "b")], "id string, tenant_id string, company_key string")
    tables.write_snapshot(rows, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).where("tenant_id = 'u'").count() == 1
    docs = spark.createDataFrame([("1", "x", None, None, None, None), ("1", "x", None, None, None, None), ("2", None, 5.0, None, None, None), ("2", None, 6.0, None, None, None)], "doc_id string, payslip string, gross_pay_total double, employer_cost_total double, net_pay_total double, doc_type string")
    clean, conflicts = finance.dedupe_documents(finance.classify_documents(docs))
    assert [(r.doc_id, r.doc_type) for r in clean.collect()] == [("1", "payslip")] and [r.doc_id for r in conflicts.collect()] == ["2"]
