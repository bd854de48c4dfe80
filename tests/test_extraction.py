"""Extracted documents: what is refused and why, what is worked out."""

import json

from factloom.operators.extraction import normalize_extracted

BASE = {"doc_type": "payroll_register", "company": "Acme  Ltd", "period": "2024-02", "gross_pay_total": 100, "employer_cost_total": 130.5}
SLIP = {"doc_type": "payslip", "company": "Acme", "period": "2024-02", "employee": {"employee_code": "7", "gross": 10, "net": "8", "employer_cost": 13}}


def slip(**change):
    return SLIP | {"employee": SLIP["employee"] | change}


CASES = [
    (BASE, {}, None), ("```json\n" + json.dumps(BASE) + "\n```", {}, None), (SLIP, {}, None), ({**BASE, "doc_type": "memo"}, {}, None),
    (None, {}, "empty_or_too_large"), ("x" * 64001, {}, "empty_or_too_large"), ("[1]", {}, "not_one_json_object"), ("{} {}", {}, "not_one_json_object"), ("{},{}", {}, "not_one_json_object"), ('{}, "company": "A"', {}, "not_one_json_object"),
    ({**BASE, "x": 1}, {}, "unknown_key"), ({**SLIP, "payslip": {}}, {}, "employee_and_payslip"), ({**SLIP, "employee": 5}, {}, "employee_not_an_object"),
    (slip(age=3), {}, "unknown_employee_key"), ({**BASE, "company": "N/A"}, {}, "company"), (BASE, {"company": "acme ltd"}, None), (BASE, {"company": "Other"}, "company_conflict"),
    ({**BASE, "period": "2024-13"}, {}, "period"), (BASE, {"period": "2024-03"}, "period_conflict"), ({**BASE, "currency": "EURO"}, {}, "currency"),
    ({**BASE, "currency": "eur"}, {"currency": "USD"}, "currency_conflict"), ({**BASE, "event_ref": "a" * 129}, {}, "event_ref"),
    ({**BASE, "event_ref": "a", "payroll_run_id": "b"}, {}, "event_ref_conflict"), (BASE, {"declared_type": "payslip"}, "doc_type_conflict"),
    (slip(employee_code=None), {}, "employee_id"), (slip(employee_id="8"), {}, "employee_id_conflict"), (slip(tax=-1), {}, "employee_tax"), (slip(net=True), {}, "employee_net"),
    (slip(gross=None), {}, "employee_gross"), (slip(employer_cost=None), {}, "employee_cost_missing"), (slip(employer_cost=9), {}, "employee_cost"),
    ({**SLIP, "employee": None}, {}, "payslip_needs_employee"), ({**BASE, "employer_cost_total": None}, {}, "register_needs_two_totals"),
    ({**BASE, "employer_social_security_total": 31}, {}, "register_cost"), ({**BASE, "employer_cost_total": 90}, {}, "register_negative"),
    ({**BASE, "doc_type": "bank_confirmation"}, {}, "bank_needs_net"), ({**BASE, "employee_count": 1.5}, {}, "employee_count"), ({**BASE, "payment_date": "2024-02-30"}, {}, "payment_date"),
]


def test_extracted_documents(spark):
    names = ["company", "period", "currency", "event_ref", "declared_type"]
    rows = [(i, *[d.get(n) for n in names], x if x is None or isinstance(x, str) else json.dumps(x)) for i, (x, d, _) in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{n} string" for n in names) + ", extracted string")
    clean, rejected = normalize_extracted(docs, ["EUR", "USD"])
    assert {r.doc_id: r.error for r in rejected.collect()} == {i: e for i, (_, _, e) in enumerate(CASES) if e}
    good = {r.doc_id: r for r in clean.collect()}
    assert set(good) == {i for i, (_, _, e) in enumerate(CASES) if not e}
    assert (good[0].company, good[0].event_ref, good[0].employer_social_security_total) == ("Acme Ltd", "monthly-consolidated", 30.5)
    assert tuple(good[2].payslip) == ("7", "7", 10.0, 0.0, 0.0, 8.0, 3.0, 13.0) and good[3].doc_type == "unknown"
