"""Currency-safe profit and loss with all measures, from payroll events and invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import round_up
from .finance import latest_per_key, purchase_cash

SMOKE = "__smoke__"
#: Money columns, which are null unless a group has one currency.
MONEY = (
    "employer_cost_total", "gross_total", "employer_social_security_total", "employee_social_security_total", "tax_withheld_total", "cash_out_total", "off_bank_cost", "off_bank_cost_pct", "cost_gap_pct",
    "avg_cost_per_employee", "purchases_total", "purchase_cash_out_total", "purchase_cash_unknown_total", "revenue_total", "total_expenses", "net_cash_outflow", "net_profit", "net_profit_margin_pct",
)


def relevant(facts: DataFrame) -> DataFrame:
    """Payroll events with an employer cost, and invoices that are no smoke test."""
    payroll = F.col("kind").isin("payroll_event") & F.col("employer_cost_total").isNotNull()
    return facts.where(payroll | ((F.col("kind") == "invoice") & ~F.col("vendor").eqNullSafe(F.lit(SMOKE))))


def latest(facts: DataFrame) -> DataFrame:
    """Of each kind, currency and business key the latest fact; ties keep the smallest id. Facts without a currency all stay."""
    known = latest_per_key(facts.where("currency is not null"), ["kind", "type", "currency", "business_key"])
    return known.unionByName(facts.where("currency is null"))


def pnl(facts: DataFrame, sets: list[list[str]]) -> DataFrame:
    """All measures of each grouping set of (currency, company, period), in one pass.

    ``facts``: id, kind, type (purchase, sales), currency, company, period, business_key, created_at, vendor,
    employee_count, employer_cost_total, gross_total, bank_net_total, employer_social_security_total (null:
    cost less gross), employee_social_security_total, tax_withheld_total, total, paid_amount, payment_status.
    Money of different currencies is never added: a group of several, or with a fact without one, has null
    money and counts that still add up. No facts at all give one row, ``empty``, for a set without keys.
    """
    rows = latest(relevant(facts))
    payroll, purchase, sale = F.col("kind") == "payroll_event", (F.col("kind") == "invoice") & (F.col("type") != "sales"), (F.col("kind") == "invoice") & (F.col("type") == "sales")
    _, cash = purchase_cash(F.col("total"), F.col("payment_status"), F.col("paid_amount"))
    # Six places: shares of sums do not depend on the order in which these were added.
    sum_of = lambda where, value: F.round(F.coalesce(F.sum(F.when(where, F.coalesce(value, F.lit(0.0)))), F.lit(0.0)), 6)
    col = F.col
    sums = [
        F.count("id").alias("events"), sum_of(payroll, col("employee_count")).cast("long").alias("employee_count"), F.min("currency").alias("low"), F.max("currency").alias("high"), F.count_if(col("id").isNotNull() & col("currency").isNull()).alias("unknown_currency_records"),
        sum_of(payroll, col("employer_cost_total")).alias("cost"), sum_of(payroll, col("gross_total")).alias("gross"), sum_of(payroll, F.coalesce("employer_social_security_total", col("employer_cost_total") - F.coalesce("gross_total", F.lit(0.0)))).alias("employer_ss"),
        sum_of(payroll, col("employee_social_security_total")).alias("employee_ss"), sum_of(payroll, col("tax_withheld_total")).alias("tax"), sum_of(payroll, col("bank_net_total")).alias("bank"),
        sum_of(purchase, col("total")).alias("bought"), sum_of(purchase, cash).alias("paid"), sum_of(purchase & cash.isNull(), col("total")).alias("unpaid"), F.count_if(purchase & cash.isNull()).alias("purchase_cash_unknown_count"), sum_of(sale, col("total")).alias("sold"),
    ]
    keys = sorted({key for keys in sets for key in keys})
    grouped = rows.groupingSets([[F.col(k) for k in keys] for keys in sets], *keys).agg(*sums) if keys else rows.agg(*sums)
    known = F.col("unknown_currency_records") == 0
    single = known & (F.col("low") == F.col("high"))
    status = F.when(F.col("events") == 0, "empty").when(F.coalesce(single, F.lit(False)), "single").when(F.col("low").isNull(), "unknown").otherwise("mixed")
    share = lambda part, whole, scale=100: F.when(whole > 0, part / whole * scale)
    off, spent = col("cost") - col("bank"), col("cost") + col("bought")
    values = (
        col("cost"), col("gross"), col("employer_ss"), col("employee_ss"), col("tax"), col("bank"), off, share(off, col("bank")), share(col("employer_ss"), col("bank")), share(col("cost"), col("employee_count"), 1),
        col("bought"), col("paid"), col("unpaid"), col("sold"), spent, F.when(col("purchase_cash_unknown_count") == 0, col("bank") + col("paid")), col("sold") - spent, share(col("sold") - spent, col("sold")),
    )
    shown = [F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("currency", "company", "period")]
    return grouped.select(*shown, status.alias("currency_status"), "events", "unknown_currency_records", "employee_count", "purchase_cash_unknown_count", *[F.when(single | (status == "empty"), round_up(v, 2)).alias(n) for n, v in zip(MONEY, values, strict=True)])


def line_items(facts: DataFrame) -> DataFrame:
    """Purchases and sales of the latest invoices: side, party, invoice_number, amount, invoice_date, currency, cash_status, paid_amount.

    ``facts`` also has customer, vendor_ref, invoice_number and invoice_date. Names fall back to the
    company, then to a word; sales have no cash status.
    """
    rows = latest(relevant(facts)).where("kind = 'invoice' and currency is not null")
    state, amount = purchase_cash(F.col("total"), F.col("payment_status"), F.col("paid_amount"))
    sale = F.col("type") == "sales"
    some = lambda *columns: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])
    party = F.when(sale, F.coalesce(some("customer", "company"), F.lit("Customer"))).otherwise(F.coalesce(some("vendor", "company"), F.lit("Unknown")))
    number = F.coalesce(F.when(sale, some("invoice_number", "vendor_ref")).otherwise(some("vendor_ref", "invoice_number")), F.lit("None"))
    return rows.select(
        F.when(sale, "sale").otherwise("purchase").alias("side"), party.alias("party"), number.alias("invoice_number"), F.coalesce("total", F.lit(0.0)).alias("amount"),
        F.coalesce("invoice_date", F.lit("")).alias("invoice_date"), "currency", F.when(~sale, state).alias("cash_status"), F.when(~sale, amount).alias("paid_amount"),
    )


def event_pnl(events: DataFrame, top: int = 5) -> DataFrame:
    """P&L of each fused payroll event, with its ``top`` employees by employer cost (ties by employee_id).

    Null currency: null money. Employees of an event lie in its own row, which the fusion bounds.
    """
    money: Column = F.col("currency").isNotNull()
    cost, bank, social = F.col("employer_cost_total"), F.col("bank_net_total"), F.col("employer_social_security_total")
    shown = lambda value: F.when(money, round_up(value, 2))
    ranked = F.array_sort(F.transform("employees", lambda e: F.struct((-e["employer_cost"]).alias("a"), e["employee_id"].alias("employee_id"), e["name"].alias("name"), e["gross"].alias("gross"), e["net"].alias("net"), e["employer_cost"].alias("employer_cost"))))
    best = F.transform(F.slice(ranked, 1, top), lambda e: e.dropFields("a"))
    return events.select(
        "event_id", "currency", "employee_count", shown(cost).alias("employer_cost_total"), shown(bank).alias("cash_out_total"), shown(cost - bank).alias("off_bank_cost"),
        shown(F.when(bank > 0, (cost - bank) / bank * 100)).alias("off_bank_cost_pct"), shown(F.when(bank > 0, social / bank * 100)).alias("cost_gap_pct"),
        shown(F.when(F.col("employee_count") > 0, cost / F.col("employee_count"))).alias("avg_cost_per_employee"), shown(-cost).alias("net_profit"), F.when(money, best).alias("top_employees"),
    )
