import datetime as dt
import json
import random

import numpy as np

from factloom.operators import audit, finance, ingest, retrieval, usage
from factloom.operators.extraction import normalize_extracted
from factloom.streaming import jobs


def test_extraction_feeds_fusion(spark):
    """JSON of a register, a bank statement and payslips, with local amounts and full-width labels, is one event."""
    slip = lambda n: {"doc_type": "payslip", "company": "Acme  Foods", "period": "2026-05", "employee": {"employee_id": f"e{n}", "gross": "3.500,00", "tax": 250, "employee_social_security": 0, "net": 3250, "employer_cost": "4.300,00 EUR"}}
    said = [
        {"doc_type": "payroll_register", "company": "Ａｃｍｅ Foods", "period": "2026-05", "currency": "EUR", "gross_pay_total": "7.000,00", "employer_cost_total": "8 600,00", "employee_count": 2},
        {"doc_type": "bank_confirmation", "company": "acme foods", "period": "2026-05", "currency": "eur", "net_pay_total": 6500, "payment_date": "2026-05-29"},
        slip(1), slip(2), {"doc_type": "bank_confirmation", "company": "Other", "period": "2026-05", "net_pay_total": "1,234"},
    ]
    schema = "doc_id string, company string, period string, currency string, event_ref string, declared_type string, extracted string"
    docs = spark.createDataFrame([(f"d{i}", None, None, None, None, None, json.dumps(x)) for i, x in enumerate(said)], schema)
    clean, rejected = normalize_extracted(docs, ["EUR"])
    assert [(r.doc_id, r.error) for r in rejected.collect()] == [("d4", "net_pay_total")]
    events, left = finance.fuse_events(finance.classify_documents(ingest.nfkc_labels(clean, ["company", "event_ref"])))
    event = events.first()
    assert left.count() == 0 and (event.gross_total, event.employer_cost_total, event.bank_net_total, event.employee_count) == (7000.0, 8600.0, 6500.0, 2)
    assert {r.status for r in finance.validation_rules(events).collect()} == {"passed"}


def test_labels_of_several_columns(spark):
    rows = spark.createDataFrame([("Ａ", "x", 1), (None, "ｂ", 2), ("é", "Ａ", 3)], "a string, b string, n int")
    assert sorted(map(tuple, ingest.nfkc_labels(rows, ["a", "b"]).collect()), key=lambda r: r[2]) == [("A", "x", 1), (None, "b", 2), ("é", "A", 3)]


FACT = "id string, kind string, company string, period string, source_ref string, metadata string, importance double, created_at timestamp"


def facts(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [
        ("a", "document", " Acme", "p", "R", '{"total": 1}', 0.9, day(1)), ("b", "document", "acme ", "p", "R", '{"total": 9}', 0.1, day(2)),
        ("c", "document", "Acme", "p", "R", '{"total": 5, "importance": 0.8}', 0.1, day(1)), ("d", "document", "Acme", "p", "S", '{"total": 5}', 0.1, day(1)),
    ]
    return spark.createDataFrame(rows, FACT)


def test_each_question_audits_its_own_hits(spark):
    hits = spark.createDataFrame([("Q1", "a"), ("Q1", "b"), ("Q1", "b"), ("q1", "a"), ("q1", "d"), ("Q2", "a"), ("Q2", "c")], "query_id string, id string")
    found = sorted((r.query_id, r.company_key, r.winner_id, r.rule, r.n_carriers) for r in audit.hit_contradictions(hits, facts(spark)).collect())
    # The column's importance is not shown to a recall: the later one wins, unless metadata says more.
    assert found == [("Q1", "acme", "b", "recency", 2), ("Q2", "acme", "c", "importance", 2)]


def test_recall_with_findings(spark):
    docs = spark.createDataFrame([(i, f"the total of {i}", [1.0, float(n)]) for n, i in enumerate("abcd")], "id string, text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "total of a", [1.0, 0.0]), (2, "total of d", [0.0, 1.0])], "query_id long, text string, embedding array<float>")
    rows = {r.query_id: r for r in retrieval.recall_batch(docs, asked, 2, facts=facts(spark)).collect()}
    assert all(len(r.ids) == 2 for r in rows.values())
    for row in rows.values():
        want = {"a", "b", "c"} >= set(row.ids)
        assert bool(row.findings) == want


def test_retention_rewrites_nothing(spark, tmp_path):
    schema = "id string, importance double, created_at timestamp, superseded_at timestamp, filler string"
    for n in range(3):
        rows = [(f"{n}-{i}", 0.1 if i % 2 else 0.9, dt.datetime(2020 + 2 * n, 1, 1), dt.datetime(2023, 1, 1) if i == 0 else None, "x" * 50) for i in range(20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    query = jobs.retention_by_parts(stream, root, "2024-06-01", superseded=True, older_than_days=400, max_importance=0.5).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    kept = {r.id for r in jobs.read_retained(spark, root).collect()}
    assert kept == {f"{n}-{i}" for n in range(3) for i in range(20) if i and not (i % 2 and n < 2)}
    size = lambda n: sum(f.stat().st_size for f in (tmp_path / "out" / "facts" / f"batch={n}").glob("*.parquet"))
    assert max(map(size, range(3))) < 1.5 * min(map(size, range(3)))


def test_percentiles_through_histograms(spark):
    rng = random.Random(4)
    rows = [("wide", rng.lognormvariate(0, 3)) for _ in range(4000)] + [("same", 5.0)] * 500 + [("few", float(i)) for i in range(3)] + [("none", None)] * 2 + [(None, float(i % 7)) for i in range(900)]
    frame = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: r for r in usage.latency_percentiles(frame, ["g"], "v", bins=16, small=20).collect()}
    for name in ("wide", "same", "few", None):
        values = sorted(v for g, v in rows if g == name)
        nearest = [values[max(0, int(np.ceil(p * len(values) - 1e-9)) - 1)] for p in (0.5, 0.95, 0.99)]
        assert [found[name].p50, found[name].p95, found[name].p99] == nearest and (found[name].least, found[name].most, found[name].n) == (values[0], values[-1], len(values))
    assert (found["none"].p50, found["none"].n) == (None, 2)
    assert usage.latency_percentiles(frame.limit(0), ["g"], "v").collect() == []
