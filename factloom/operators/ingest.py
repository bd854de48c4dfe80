"""From checked inputs to facts: currencies, invoices, payroll events, rule results, judge verdicts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import materialize
from ..functions.scalars import clamp, money_text, round_up, scrub, valid_date
from .finance import CENT, SLIP_FIELDS

INVOICE = "type string, company string, period string, date string, currency string, total double, invoice_ref string, vendor string, customer string, paid_amount double, status string, payment_date string"


def iso_currencies(spark: SparkSession) -> list[str]:
    """The ISO 4217 codes that the JVM knows."""
    return sorted(c.getCurrencyCode() for c in spark._jvm.java.util.Currency.getAvailableCurrencies())


def nfkc(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the column in Unicode's compatibility form NFKC.

    Only distinct values beyond ASCII leave the JVM, and are joined back.
    """
    odd = rows.where(F.col(column).rlike(r"[^\x00-\x7F]")).select(F.col(column).alias("__from")).distinct()

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unicodedata.normalize("NFKC", x) for x in batch.column(0).to_pylist()], pa.string())], names=["__from", "__to"])

    found = odd.mapInArrow(normal, "__from string, __to string")
    return rows.join(found, F.col(column) == F.col("__from"), "left").withColumn(column, F.coalesce("__to", column)).select(rows.columns)


def nfkc_labels(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Several string columns in NFKC, by one dictionary of their distinct values beyond ASCII.

    The rows are read once for the dictionary, whatever the number of columns, and each value is normalised once.
    """
    odd = rows.select(F.explode(F.array(*columns)).alias("label")).where(F.col("label").rlike(r"[^\x00-\x7F]")).distinct()
    found = materialize(nfkc(odd.select("label", F.col("label").alias("plain")), "plain"))
    out = rows
    for name in columns:
        out = out.join(found.toDF("__label", "__plain"), F.col(name) == F.col("__label"), "left").withColumn(name, F.coalesce("__plain", name)).drop("__label", "__plain")
    return out.select(rows.columns)


def normalize_currency(rows: DataFrame, column: str = "currency", codes: list[str] | None = None) -> DataFrame:
    """The column as an ISO 4217 code: NFKC, trimmed, in capitals; null for anything else."""
    clean = F.upper(F.trim(F.col(column)))
    known = codes if codes is not None else iso_currencies(rows.sparkSession)
    return nfkc(rows, column).withColumn(column, F.when(clean.isin(known), clean))


def invoice_error(codes: list[str]) -> Column:
    """The first rule that an invoice (``INVOICE``) breaks, else null."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    col = F.col
    purchase, total, paid, status = col("type") == "purchase", col("total"), col("paid_amount"), col("status")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rules = [
        (~F.coalesce(col("type").isin("purchase", "sales"), F.lit(False)), "type"), (blank(col("company")), "company_blank"), (blank(col("invoice_ref")), "invoice_ref_blank"), (~F.coalesce(col("currency").isin(codes), F.lit(False)), "currency"),
        (purchase & blank(col("vendor")), "purchase_needs_vendor"), (purchase & col("customer").isNotNull(), "purchase_has_customer"), (~purchase & blank(col("customer")), "sale_needs_customer"), (~purchase & col("vendor").isNotNull(), "sale_has_vendor"),
        (~valid_date(col("date")), "date"), (~col("period").eqNullSafe(F.substring("date", 1, 7)), "period"), (col("payment_date").isNotNull() & ~valid_date(col("payment_date")), "payment_date"), (col("payment_date") < col("date"), "payment_before_date"),
        (bad(total) | (total <= 0), "total"), (paid.isNotNull() & (bad(paid) | (paid < 0) | (paid > total)), "paid_amount"), ((status == "paid") & (paid + CENT < total), "paid_in_part"),
        ((status == "partial") & (paid.isNull() | (paid <= 0) | (paid + CENT >= total)), "partial_amount"), ((status == "unpaid") & (paid != 0), "unpaid_amount"), ((status == "unpaid") & col("payment_date").isNotNull(), "unpaid_date"),
    ]
    found = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        found = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(found)
    return found


def ingest_invoices(invoices: DataFrame, codes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(memories, rejected with ``error``) of invoices (``INVOICE``); other columns of the input are carried along.

    The record and the idempotency key name type, company, period, party and reference, so the same number
    from two parties stays two records.
    """
    judged = invoices.withColumn("error", invoice_error(codes if codes is not None else iso_currencies(invoices.sparkSession)))
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    key = lambda c: F.lower(clean(c))
    col = F.col
    purchase, party, reference = col("type") == "purchase", F.coalesce("vendor", "customer"), col("invoice_ref")
    identity = F.sha2(F.to_json(F.array("type", key(col("company")), "period", key(party), key(reference))), 256)
    metadata = F.to_json(F.struct(
        "type", F.concat(F.lit("invoice:"), "type", F.lit(":"), key(party), F.lit(":"), key(reference)).alias("record"), "currency", "total", col("date").alias("invoice_date"), clean(reference).alias("invoice_number"),
        F.when(purchase, clean(party)).alias("vendor"), F.when(~purchase, clean(party)).alias("customer"), F.when(purchase, clean(reference)).alias("vendor_ref"), "paid_amount", col("status").alias("payment_status"), "payment_date",
    ))
    content = F.concat(
        F.when(purchase, "Purchase").otherwise("Sales"), F.lit(" invoice "), clean(reference), F.when(purchase, " from ").otherwise(" to "), clean(party), F.lit(" for "), "currency", F.lit(" "),
        F.format_string("%.2f", "total"), F.lit(", dated "), "date", F.lit(", recorded by "), clean(col("company")), F.lit("."),
    )
    rest = [c for c in invoices.columns if c not in {f.split(" ")[0] for f in INVOICE.split(", ")}]
    good = judged.where("error is null").select(
        *rest, F.lit("invoice").alias("kind"), clean(col("company")).alias("company"), "period", clean(reference).alias("source_ref"), content.alias("content"), metadata.alias("metadata"),
        F.concat(F.lit("invoice:"), identity).alias("idempotency_key"), F.lit(0.7).alias("importance"),
    )
    return good, judged.where("error is not null")


def payroll_problem(strict: bool = True) -> Column:
    """The first sum that a fused event breaks, else null. ``strict`` also wants complete employees that add up.

    Events have the totals, employee_count and employees (rows of ``SLIP_FIELDS``); sums may be a cent apart.
    """
    col = F.col
    equal = lambda a, b: F.abs(a - b) <= CENT + 1e-9
    off = lambda x: F.coalesce(x.isNull() | F.isnan(x) | (x < 0) | (x == F.lit(float("inf"))), F.lit(True))
    totals = {"gross_total": "gross", "employer_social_security_total": "employer_social_security", "employee_social_security_total": "employee_social_security", "tax_withheld_total": "tax", "employer_cost_total": "employer_cost", "bank_net_total": "net"}
    people = lambda test: F.exists("employees", test)
    person_off = lambda field: people(lambda e: off(e[field]))
    total = lambda field: F.aggregate("employees", F.lit(0.0), lambda a, e: a + e[field])
    rules = [(off(col(name)), f"negative_{name}") for name in totals] + [(off(col("employee_count").cast("double")), "employee_count")]
    rules += [(person_off(field), f"negative_employee_{field}") for field in SLIP_FIELDS]
    rules += [(people(lambda e: ~equal(e["employer_cost"], e["gross"] + e["employer_social_security"])), "employee_cost"), (people(lambda e: ~equal(e["gross"], e["net"] + e["employee_social_security"] + e["tax"])), "employee_gross")]
    if strict:
        rules += [(F.size("employees") != col("employee_count"), "employee_count")] + [(~equal(col(name), total(field)), name) for name, field in totals.items()]
    rules += [(~equal(col("employer_cost_total"), col("gross_total") + col("employer_social_security_total")), "cost_sum")]
    if strict:
        rules += [(~equal(col("gross_total"), col("bank_net_total") + col("employee_social_security_total") + col("tax_withheld_total")), "gross_sum")]
    found = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        found = F.when(broken, name).otherwise(found)
    return found


def with_withheld(events: DataFrame) -> DataFrame:
    """Add what employees pay, as their payslips add up: employee_social_security_total, tax_withheld_total."""
    total = lambda field: F.aggregate("employees", F.lit(0.0), lambda a, e: a + F.coalesce(e[field], F.lit(0.0)))
    return events.withColumns({"employee_social_security_total": total("employee_social_security"), "tax_withheld_total": total("tax")})


def event_memories(events: DataFrame) -> DataFrame:
    """Facts of each event: a summary, an insight on what the bank does not show, and one row an employee.

    Columns: event_id, kind, company, period, source_ref, idempotency_key, importance (null: the default), content, metadata.
    """
    col, lit = F.col, F.lit
    amount = lambda value: money_text(value, col("currency"))
    bank, cost, social = col("bank_net_total"), col("employer_cost_total"), col("employer_social_security_total")
    off = round_up(cost - bank, 2)
    share = lambda part: F.when(bank > 0, round_up(part / bank * 100, 1)).otherwise(lit(0.0))
    start = F.concat(lit("event:"), "event_id")
    row = lambda kind, ref, key, importance, content, metadata: F.struct(lit(kind).alias("kind"), ref.alias("source_ref"), key.alias("idempotency_key"), lit(importance).cast("double").alias("importance"), content.alias("content"), F.to_json(metadata, {"ignoreNullFields": "false"}).alias("metadata"))
    summary = F.array(row(
        "payroll_event", col("event_id"), F.concat(start, lit(":summary")), None,
        F.concat(lit("Workforce cost for "), "company", lit(" in "), "period", lit(": "), col("employee_count").cast("string"), lit(" employees, gross "), amount(col("gross_total")), lit(", true employer cost "), amount(cost), lit(", net paid from bank "), amount(bank), lit(".")),
        F.struct("employee_count", "gross_total", "employer_cost_total", "bank_net_total", "employer_social_security_total", "employee_social_security_total", "tax_withheld_total", "currency")))
    no_share = " (percentage unavailable because the bank transfer is zero)"
    by = F.concat(lit(" by "), amount(F.abs(off)), F.when(bank > 0, F.concat(lit(" ("), F.format_string("%.1f", F.abs(share(off))), lit("% of the transfer)"))).otherwise(no_share))
    compared = F.when(off > 0, F.concat(lit("is below the true employer cost of "), amount(cost), by)).when(off < 0, F.concat(lit("exceeds the true employer cost of "), amount(cost), by)).otherwise(F.concat(lit("matches the true employer cost of "), amount(cost)))
    insight = F.array(row(
        "insight", col("event_id"), F.concat(start, lit(":insight")), 0.9,
        F.concat(lit("Off-bank workforce-cost comparison at "), "company", lit(" for "), "period", lit(": the bank salary transfer of "), amount(bank), lit(" "), compared, lit(". Employer social-security contributions are "), amount(social),
                 F.when(bank > 0, F.concat(lit(" ("), F.format_string("%.1f", share(social)), lit("% of the bank transfer)"))).otherwise(no_share), lit(".")),
        F.struct(off.alias("off_bank_cost"), share(cost - bank).alias("off_bank_cost_pct"), round_up(social, 1).alias("cost_gap_amount"), share(social).alias("cost_gap_pct"), "employer_social_security_total", "currency")))
    employee = F.transform(F.coalesce("employees", F.array()), lambda e: row(
        "payroll_event", F.concat("event_id", lit(":"), e["employee_id"]), F.concat(start, lit(":employee:"), e["employee_id"]), None,
        F.concat(e["name"], lit(" (id "), e["employee_id"], lit(") at "), "company", lit(" in "), "period", lit(": gross "), amount(e["gross"]), lit(", net "), amount(e["net"]), lit(", employer cost "), amount(e["employer_cost"]), lit(".")),
        F.struct(e["employee_id"].alias("employee_id"), e["net"].alias("net"), e["gross"].alias("gross"), "currency")))
    # All rows of an event are spread from the event, which is computed once.
    said = events.select("event_id", "company", "period", F.explode(F.concat(summary, insight, employee)).alias("m"))
    return said.select("event_id", "m.kind", "company", "period", "m.source_ref", "m.idempotency_key", "m.importance", "m.content", "m.metadata")


def validation_memories(rules: DataFrame) -> DataFrame:
    """One fact for each rule result (event_id, company, period, rule, status, severity)."""
    col, lit = F.col, F.lit
    return rules.select(
        "event_id", lit("validation").alias("kind"), "company", "period", F.concat("event_id", lit(":"), "rule").alias("source_ref"), F.concat(lit("event:"), "event_id", lit(":validation:"), "rule").alias("idempotency_key"),
        F.concat(lit("Validation "), F.upper("status"), lit(" for "), "company", lit(" "), "period", lit(" — "), "rule").alias("content"), F.to_json(F.struct("rule", "status", (col("status") == "passed").alias("passed"), "severity")).alias("metadata"),
    )


def parse_verdicts(rows: DataFrame, column: str = "raw") -> DataFrame:
    """``rows`` with contradict, confidence, reason and status of a judge's raw JSON output.

    A code fence around it is taken off. Anything but an object of exactly these three typed keys, or an
    empty or overlong reason, is inconclusive.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"(?is)^\s*```(?:json)?\s*(.*?)\s*```\s*$", "$1"))
    parsed = F.try_parse_json(bare)
    kind = lambda name: F.schema_of_variant(F.try_variant_get("__v", f"$.{name}", "variant"))
    number = kind("confidence").isin("BIGINT", "DOUBLE") | kind("confidence").startswith("DECIMAL")
    reason = F.try_variant_get("__v", "$.reason", "string")
    keys = F.json_object_keys("__bare")
    good = (kind("contradict") == "BOOLEAN") & number & (kind("reason") == "STRING") & (F.trim(reason) != "") & (F.length(reason) <= 500) & (F.size(F.array_except(keys, F.array(F.lit("contradict"), F.lit("confidence"), F.lit("reason")))) == 0)
    good = F.coalesce(good, F.lit(False))
    return rows.withColumn("__bare", bare).withColumn("__v", parsed).withColumns({
        "contradict": F.when(good, F.try_variant_get("__v", "$.contradict", "boolean")).otherwise(F.lit(False)), "confidence": F.when(good, clamp(F.try_variant_get("__v", "$.confidence", "double"), 0.0, 1.0)).otherwise(F.lit(0.0)),
        "reason": F.when(good, scrub(reason)).otherwise("unparseable judge response"), "status": F.when(good, "ok").otherwise("inconclusive"),
    }).drop("__v", "__bare")
