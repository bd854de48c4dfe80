import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.operators import finance

SLIP = "struct<employee_id:string,name:string,gross:double,employee_social_security:double,tax:double,net:double,employer_social_security:double,employer_cost:double>"
DOCS = f"doc_id string, doc_type string, company string, period string, currency string, event_ref string, payment_date string, gross_pay_total double, employer_cost_total double, employer_social_security_total double, net_pay_total double, employee_count int, payslip {SLIP}"
EVENT = f"event_id string, period string, payment_date string, bank_net_total double, employer_cost_total double, gross_total double, employee_count int, declared_count boolean, employees array<{SLIP}>"


def slip(name, net, gross=5000.0, cost=6000.0):
    return (name, "n", gross, 300.0, gross - 300.0 - net, net, cost - gross, cost)


def rules(spark, **changes):
    base = {"event_id": "e", "period": "2026-05", "payment_date": "2026-05-29", "bank_net_total": 9000.0, "employer_cost_total": 12000.0, "gross_total": 10000.0, "employee_count": 2, "declared_count": True, "employees": [slip("a", 4500.0), slip("b", 4500.0)]} | changes
    policy = base.pop("policy", finance.ValidationPolicy())
    rows = finance.validation_rules(spark.createDataFrame([tuple(base.values())], EVENT), policy).collect()
    return {r.rule: (r.status, r.severity) for r in rows}, {r.rule: r.message for r in rows}


def test_all_pass(spark):
    found, said = rules(spark)
    assert found == {f"R{i}": ("passed", "info") for i in range(1, 7)}
    assert said["R1"] == "Bank 9,000, payslips 9,000 (0.0% apart, at most 2% allowed)" and said["R3"].endswith("2026-06-07")


@pytest.mark.parametrize("changes, rule, status", [
    ({"bank_net_total": 9200.0}, "R1", ("failed", "error")),  # 2.2 % of the payslips' 9,000, 2.17 % of the bank's
    ({"bank_net_total": 9180.0}, "R1", ("passed", "info")),
    ({"employees": [slip("a", 0.0), slip("b", 0.0)]}, "R1", ("failed", "warning")),
    ({"employee_count": 3}, "R1", ("not_evaluated", "info")),
    ({"employee_count": 3}, "R4", ("failed", "warning")),
    ({"employee_count": 3}, "R5", ("not_evaluated", "info")),
    ({"declared_count": False}, "R4", ("not_evaluated", "info")),
    ({"declared_count": False}, "R6", ("not_evaluated", "info")),
    ({"employees": []}, "R4", ("not_evaluated", "info")),
    ({"bank_net_total": 0.0}, "R2", ("failed", "warning")),
    ({"employer_cost_total": -1.0}, "R2", ("failed", "warning")),
    ({"bank_net_total": 8000.0}, "R2", ("failed", "warning")),
    ({"bank_net_total": 8000.0, "policy": finance.ValidationPolicy(most_ratio=1.5)}, "R2", ("passed", "info")),
    ({"payment_date": "2026-06-07"}, "R3", ("passed", "info")),
    ({"payment_date": "2026-06-08"}, "R3", ("failed", "warning")),
    ({"payment_date": "2026-02-30"}, "R3", ("failed", "warning")),
    ({"payment_date": "May 3"}, "R3", ("failed", "warning")),
    ({"payment_date": None}, "R3", ("not_evaluated", "info")),
    ({"period": "2026-13"}, "R3", ("failed", "warning")),
    ({"gross_total": 10010.0}, "R5", ("passed", "info")),  # 0.1 % of the larger
    ({"gross_total": 10012.0}, "R5", ("failed", "error")),
    ({"employer_cost_total": 12100.0}, "R6", ("failed", "error")),
])
def test_rules(spark, changes, rule, status):
    assert rules(spark, **changes)[0][rule] == status


def test_policy_bounds():
    policy = finance.ValidationPolicy(least_ratio=float("nan"), most_ratio=0.5, grace_days=400)
    assert (policy.least_ratio, policy.most_ratio, policy.grace_days) == (1.25, 1.25, 90)
    assert finance.ValidationPolicy(-1, 1000, -3) == finance.ValidationPolicy(0.01, 100, 0)


@pytest.mark.parametrize("total, status, paid, flag, want", [
    (100.0, None, -5.0, None, ("refund", -5.0)), (100.0, "paid", 0.0, True, ("unpaid", 0.0)), (100.0, None, 99.995, None, ("paid", 99.995)), (100.0, None, 40.0, None, ("partial", 40.0)),
    (100.0, "paid", None, False, ("unpaid", 0.0)), (100.0, None, None, True, ("paid", 100.0)), (100.0, " Settled", None, None, ("paid", 100.0)), (100.0, "cleared", float("nan"), None, ("paid", 100.0)),
    (100.0, "unpaid", None, None, ("unpaid", 0.0)), (100.0, "open", None, None, ("unknown", None)), (100.0, "pending", None, None, ("unknown", None)), (100.0, "partial", None, None, ("unknown", None)), (-100.0, None, None, None, ("unknown", None)),
])
def test_purchase_cash(spark, total, status, paid, flag, want):
    row = spark.createDataFrame([(total, status, paid, flag)], "total double, status string, paid double, flag boolean")
    state, cash = finance.purchase_cash(F.col("total"), F.col("status"), F.col("paid"), F.col("flag"))
    assert tuple(row.select(state, cash).first()) == want


def docs(spark, *rows):
    none = {name: None for name in ("event_ref", "payment_date", "gross_pay_total", "employer_cost_total", "employer_social_security_total", "net_pay_total", "employee_count", "payslip")}
    full = [{"company": "Acme  Foods", "period": "2026-05", "currency": "EUR"} | none | row for row in rows]
    names = [part.split()[0] for part in DOCS.split(f", payslip {SLIP}")[0].split(", ")] + ["payslip"]
    return spark.createDataFrame([tuple(row[name] for name in names) for row in full], DOCS)


REGISTER = {"doc_id": "d1", "doc_type": "payroll_register", "gross_pay_total": 7000.0, "employer_cost_total": 8600.0}
BANK = {"doc_id": "d2", "doc_type": "bank_confirmation", "net_pay_total": 6500.0, "company": "acme foods", "currency": " eur "}


def test_event_identity_counts_and_gaps(spark):
    events, rejected = finance.fuse_events(docs(spark, REGISTER, BANK | {"employee_count": 2}))
    event = events.first()
    digest = hashlib.sha256(b"acme foods\0monthly-consolidated").hexdigest()[:12]
    assert event.event_id == f"evt-acme-foods-monthly-consolidated-{digest}-2026-05" and event.event_ref == "monthly-consolidated"
    assert (event.employee_count, event.declared_count, event.currency, event.company) == (2, True, "EUR", "Acme Foods")
    # Employer social security 1,600 of a bank total of 6,500; all cost beyond it 2,100.
    assert (event.cost_gap_amount, event.cost_gap_pct, event.off_bank_cost, event.off_bank_cost_pct) == (1600.0, 24.6, 2100.0, 32.3)
    assert rejected.count() == 0


@pytest.mark.parametrize("rows, reason", [
    ((REGISTER | {"employee_count": 3}, BANK | {"employee_count": 2}), "conflicting_value"),
    ((REGISTER, BANK | {"currency": "USD"}), "conflicting_currency"),
    ((BANK,), "missing_register"),
])
def test_rejected_groups(spark, rows, reason):
    events, rejected = finance.fuse_events(docs(spark, *rows))
    assert events.count() == 0 and [r.reason for r in rejected.collect()] == [reason]


def test_two_runs_of_a_month_are_two_events(spark):
    rows = [part | {"doc_id": part["doc_id"] + ref, "event_ref": ref} for ref in ("Run A", "run  b") for part in (REGISTER, BANK)]
    assert sorted(r.event_ref for r in finance.fuse_events(docs(spark, *rows))[0].collect()) == ["run a", "run b"]
