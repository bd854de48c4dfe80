"""Document fusion, payroll gaps, validation rules and currency-safe profit and loss."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round_up, slug, valid_date, valid_period

CENT = 0.01
TOTALS = ("gross_pay_total", "employer_cost_total", "employer_social_security_total", "net_pay_total")
#: What extraction calls the documents that fusion knows by a shorter name, and the run of a month without a name.
KINDS = {"payroll_register": "register", "bank_confirmation": "bank"}
MONTHLY = "monthly-consolidated"
SLIP_FIELDS = ("gross", "employee_social_security", "tax", "net", "employer_social_security", "employer_cost")


def classify_documents(docs: DataFrame) -> DataFrame:
    """doc_type by content: payslip, then register (gross or employer cost), then bank (net), else kept."""
    kind = F.when(F.col("payslip").isNotNull(), "payslip").when(F.col("gross_pay_total").isNotNull() | F.col("employer_cost_total").isNotNull(), "register").when(F.col("net_pay_total").isNotNull(), "bank")
    return docs.withColumn("doc_type", F.coalesce(kind, F.col("doc_type")))


def dedupe_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identical repeats collapse; a doc_id with different bodies is a conflict. (documents, conflicts)"""
    body = F.xxhash64(*[c for c in docs.columns if c != "doc_id"])
    counted = docs.groupBy("doc_id").agg(F.count_distinct(body).alias("bodies"))
    conflicts = counted.where("bodies > 1").select("doc_id", F.lit("conflicting_doc_id").alias("reason"))
    return docs.dropDuplicates(["doc_id"]).join(conflicts, "doc_id", "left_anti"), conflicts


def complete_totals(gross: Column, cost: Column, social: Column) -> tuple[Column, Column, Column]:
    """Any two of cost = gross + employer social security give the third."""
    return F.coalesce(gross, cost - social), F.coalesce(cost, gross + social), F.coalesce(social, cost - gross)


def fuse_events(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of one (company, period, event_ref) to one payroll event. (events, rejected groups)

    The first document by id gives each field; a later value that differs from it by more than a cent is
    a conflict. A group needs a register and a bank document and at most one currency. An employee has
    one payslip, that of the first document, under the same rule. The count of employees is the register's, else
    the bank's, which may not contradict it, else that of the payslips; ``declared_count`` says whether a document gave it.

    Labels are compared with white space collapsed and in lower case; ``ingest.nfkc_labels`` goes before it where they may
    be full-width. An event's id names company and run by a hash and the period in plain. Document types may
    be those of extraction (``KINDS``).
    """
    spaced = lambda column: F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    kind = F.col("doc_type")
    for long, short in KINDS.items():
        kind = F.when(F.col("doc_type") == long, short).otherwise(kind)
    ref = F.coalesce(F.nullif(F.lower(spaced("event_ref")), F.lit("")), F.lit(MONTHLY))
    keyed = docs.withColumns({"company_label": spaced("company"), "company": F.lower(spaced("company")), "event_ref": ref, "doc_type": kind, "currency": F.nullif(F.upper(F.trim("currency")), F.lit(""))})
    group = ["company", "period", "event_ref"]
    # Documents are shuffled once, by group; both aggregates run where the documents lie and nothing is joined.
    keyed = keyed.repartition(*group).withColumns({"__slip": F.col("payslip").isNotNull(), "__employee": F.lower(F.trim("payslip.employee_id"))})
    own = lambda kind, name: F.when(F.col("doc_type") == kind, F.col(name))
    fields = {f"{kind}_{name}": own(kind, name) for kind, names in {"register": (*TOTALS[:3], "employee_count"), "bank": ("net_pay_total", "payment_date", "employee_count")}.items() for name in names}
    start = lambda value: F.min_by(value, F.when(value.isNotNull(), F.col("doc_id")))
    apart = lambda value: F.greatest(F.max(value) - start(value), start(value) - F.min(value))
    first_of = lambda value: F.min(F.when(value.isNotNull() & F.col("doc_id").isNotNull(), F.struct("doc_id", value.alias("v"))))
    compared = [name for name in fields if not name.endswith("payment_date")]
    people = keyed.groupBy(*group, "__slip", "__employee").agg(
        *[first_of(value).alias(f"{name}__first") for name, value in fields.items()], *[f(fields[name]).alias(f"{name}__{n}") for name in compared for n, f in (("low", F.min), ("high", F.max))],
        F.max(own("register", "doc_id")).isNotNull().alias("has_register"), F.max(own("bank", "doc_id")).isNotNull().alias("has_bank"),
        F.min("currency").alias("low_currency"), F.max("currency").alias("high_currency"), F.min("company_label").alias("label"), F.collect_set("doc_id").alias("docs"),
        F.min_by("payslip", "doc_id").alias("slip"), F.greatest(*[F.coalesce(apart(F.col(f"payslip.{name}")), F.lit(0.0)) for name in SLIP_FIELDS]).alias("spread"),
    )
    merged = people.groupBy(*group).agg(
        *[F.min(f"{name}__first")["v"].alias(name) for name in fields], *[f(f"{name}__{n}").alias(f"{name}__{n}") for name in compared for n, f in (("low", F.min), ("high", F.max))],
        F.max("has_register").alias("has_register"), F.max("has_bank").alias("has_bank"), F.min("low_currency").alias("currency"), F.max("high_currency").alias("high_currency"), F.min("label").alias("label"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("linked_docs"), F.array_sort(F.collect_list("slip")).alias("slips"), F.max(F.when(F.col("__slip"), F.col("spread")) > CENT).alias("slip_conflict"),
    )
    first = merged.withColumns({f"{name}__spread": F.greatest(F.col(f"{name}__high") - F.col(name), F.col(name) - F.col(f"{name}__low")) for name in compared})
    conflict = None
    for name in fields:
        if not name.endswith("payment_date"):
            differs = F.coalesce(F.col(f"{name}__spread"), F.lit(0)) > (0 if name.endswith("count") else CENT)
            conflict = differs if conflict is None else conflict | differs
    counts = F.col("register_employee_count"), F.col("bank_employee_count")
    conflict = conflict | F.coalesce(counts[0] != counts[1], F.lit(False))
    gross, cost, social = complete_totals(F.col("register_gross_pay_total"), F.col("register_employer_cost_total"), F.col("register_employer_social_security_total"))
    reason = (
        F.when(F.col("currency") != F.col("high_currency"), "conflicting_currency").when(~F.col("has_register"), "missing_register").when(~F.col("has_bank"), "missing_bank").when(conflict, "conflicting_value").when(F.col("slip_conflict"), "conflicting_payslip")
        .when(gross.isNull() | cost.isNull(), "incomplete_totals").when(F.abs(cost - gross - social) > CENT, "inconsistent_totals").when(F.least(gross, cost, social) < 0, "negative_total")
    )
    rows = first.withColumn("reason", reason)
    identity = F.substring(F.sha2(F.concat("company", F.lit("\0"), "event_ref").cast("binary"), 256), 1, 12)
    events = rows.where("reason is null").select(
        F.concat_ws("-", F.lit("evt"), slug(F.col("company")), slug(F.col("event_ref")), identity, "period").alias("event_id"),
        F.col("label").alias("company"), "period", "currency", "event_ref",
        F.coalesce(*counts, F.size("slips")).alias("employee_count"), F.coalesce(*counts).isNotNull().alias("declared_count"), F.col("bank_net_pay_total").alias("bank_net_total"), F.col("bank_payment_date").alias("payment_date"),
        gross.alias("gross_total"), social.alias("employer_social_security_total"), cost.alias("employer_cost_total"), F.col("slips").alias("employees"), "linked_docs",
    )
    return with_gaps(events), rows.where("reason is not null").select(*group, "reason")


def with_gaps(events: DataFrame) -> DataFrame:
    """What the bank statement does not show: the employer's social security (gap) and all cost beyond net pay (off bank).

    Both shares are of the bank's total, and 0 where that is not positive.
    """
    net, social = F.col("bank_net_total"), F.col("employer_social_security_total")
    off = F.col("employer_cost_total") - net
    share = lambda part: F.when(net > 0, round_up(part / net * 100, 1)).otherwise(F.lit(0.0))
    return events.withColumns({"cost_gap_amount": round_up(social, 1), "cost_gap_pct": share(social), "off_bank_cost": round_up(off, 2), "off_bank_cost_pct": share(off)})


@dataclass(frozen=True)
class ValidationPolicy:
    """Band of cost over net and days of grace; what is out of bounds or no number is brought back into them."""

    least_ratio: float = 1.25
    most_ratio: float = 1.45
    grace_days: int = 7

    def __post_init__(self) -> None:
        def bounded(value: float, low: float, high: float, default: float) -> float:
            return min(high, max(low, value)) if isinstance(value, (int, float)) and math.isfinite(value) else default

        least = bounded(self.least_ratio, 0.01, 100, 1.25)
        object.__setattr__(self, "least_ratio", least)
        object.__setattr__(self, "most_ratio", bounded(self.most_ratio, least, 100, max(least, 1.45)))
        object.__setattr__(self, "grace_days", int(bounded(self.grace_days, 0, 90, 7)))


def _plain(value: Column) -> Column:
    """A number with thousands commas and at most two decimals."""
    return F.regexp_replace(F.format_number(round_up(value, 2), 2), r"\.?0+$", "")


def validation_rules(events: DataFrame, policy: ValidationPolicy = ValidationPolicy(), keep: tuple[str, ...] = ()) -> DataFrame:
    """R1-R6 for each event in long form: event_id, rule, status (passed, failed, not_evaluated), severity, message.

    R1 bank net against the payslips' net, within 2 % of the latter; R2 employer cost over net within the policy's band;
    R3 paid within days of grace after the period; R4 the declared count is that of the payslips; R5 and R6 the
    register's gross and cost against the payslips', within a cent or 0.1 % of the larger. A rule without its evidence
    is not evaluated; R1, R5 and R6 need a payslip for each declared employee. What is not evaluated or passed is
    ``info``; failed comparisons of money are ``error``, other failures ``warning``.

    An event shows its evidence: a bank statement by a net and a register by a cost that is not null, a
    declared count by ``declared_count``, where that column is missing by a positive count. ``keep``: columns of the event
    that each of its rows gets too.
    """
    slips = F.coalesce(F.size("employees"), F.lit(0))
    slips = F.when(slips < 0, 0).otherwise(slips)
    total = lambda name: F.aggregate("employees", F.lit(0.0), lambda a, s: a + F.coalesce(s[name], F.lit(0.0)))
    net, cost, gross, count = F.col("bank_net_total"), F.col("employer_cost_total"), F.col("gross_total"), F.col("employee_count")
    bank, register = net.isNotNull(), cost.isNotNull()
    declared = F.coalesce(F.col("declared_count") if "declared_count" in events.columns else count > 0, F.lit(False))
    complete = declared & (slips > 0) & F.coalesce(count == slips, F.lit(False))
    percent = lambda x, digits: F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%"))
    says = lambda *parts: F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    result = lambda status, severity, message: F.struct(F.lit(status).alias("status"), F.lit(severity).alias("severity"), message.alias("message"))
    judged = lambda good, severity, message: F.when(good, result("passed", "info", message)).otherwise(result("failed", severity, message))
    skip = lambda why: result("not_evaluated", "info", F.lit(f"Not evaluated: {why}."))
    fail = lambda message: result("failed", "warning", message if isinstance(message, Column) else F.lit(message))

    own = total("net")
    apart = F.abs(net - own) / F.nullif(own, F.lit(0.0))
    ratio = cost / F.when(net > 0, net)
    paid_text = F.col("payment_date").cast("string")
    paid, last = F.when(valid_date(paid_text), F.try_to_date(paid_text, "yyyy-MM-dd")), F.last_day(F.try_to_date(F.concat("period", F.lit("-01")), "yyyy-MM-dd"))
    due = F.date_add(last, policy.grace_days)

    def against_register(name: str, said: Column, field: str) -> Column:
        slip_total = total(field)
        gap = F.abs(said - slip_total)
        share = gap / F.greatest(F.abs(said), F.abs(slip_total), F.lit(1.0))
        message = says(f"Register {name} ", _plain(said), ", payslips ", _plain(slip_total), " (", percent(share, 2), " apart, at most 0.1% allowed)")
        return F.when(~(register & complete) | said.isNull(), skip("no register or no complete set of payslips")).otherwise(judged((gap <= CENT) | (share <= 0.001), "error", message))

    rules = {
        "R1": F.when(~(bank & complete), skip("no bank statement or no complete set of payslips")).when(own == 0, fail("The payslips' net adds up to zero."))
        .otherwise(judged(apart <= 0.02, "error", says("Bank ", _plain(net), ", payslips ", _plain(own), " (", percent(apart, 1), " apart, at most 2% allowed)"))),
        "R2": F.when(~(register & bank), skip("no register or no bank statement")).when((cost <= 0) | (net <= 0), fail("Cost and net must both be positive."))
        .otherwise(judged(ratio.between(policy.least_ratio, policy.most_ratio), "warning", says("Employer cost ", _plain(cost), " over net ", _plain(net), " is ", F.format_string("%.3f", ratio)))),
        "R3": F.when(~valid_period(F.col("period")), fail(says("Not a period: ", F.col("period")))).when(~bank | (F.coalesce(paid_text, F.lit("")) == ""), skip("no payment date"))
        .when(paid.isNull(), fail(says("Not a date: ", paid_text))).otherwise(judged(paid <= due, "warning", says("Paid on ", paid_text, ", allowed through ", due.cast("string")))),
        "R4": F.when(~declared | (slips == 0), skip("no declared count or no payslips")).otherwise(judged(count == slips, "warning", says("Declared ", count.cast("string"), " employees, ", slips.cast("string"), " payslips"))),
        "R5": against_register("gross", gross, "gross"), "R6": against_register("employer cost", cost, "employer_cost"),
    }
    long = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), found.alias("r")) for rule, found in rules.items()])).alias("x")
    return events.select("event_id", *keep, long).select("event_id", *keep, "x.rule", "x.r.*")


def latest_per_key(rows: DataFrame, keys: list[str], time: str = "created_at", tie: str = "id") -> DataFrame:
    """The latest row of each business key; ties keep the smallest id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(time), tie)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def purchase_cash(total: Column, status: Column, paid: Column, flag: Column | None = None) -> tuple[Column, Column]:
    """(cash status, amount) of a purchase by its evidence, the strongest first.

    A finite amount paid decides: below zero a refund of it, zero unpaid, short of the total partial, else paid. Then
    the flag ``paid`` if it is false, then the flag if it is true or a word that says paid, which is the whole total,
    then ``unpaid``. Anything else is unknown, with no amount: an invoice does not show that no cash moved.
    """
    word = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    flag = F.lit(None).cast("boolean") if flag is None else flag
    amount = F.when(~F.isnan(paid) & (F.abs(paid) != float("inf")), paid)
    state = (
        F.when(amount < 0, "refund").when(amount == 0, "unpaid").when(amount + CENT < total, "partial").when(amount.isNotNull(), "paid")
        .when(~flag, "unpaid").when(F.coalesce(flag, F.lit(False)) | word.isin("paid", "settled", "cleared"), "paid").when(word == "unpaid", "unpaid").otherwise("unknown")
    )
    cash = F.when(amount.isNotNull(), amount).when(state == "paid", total).when(state == "unpaid", F.lit(0.0))
    return state, cash


def pnl(facts: DataFrame, by: list[list[str]]) -> DataFrame:
    """Profit and loss by grouping sets of (currency, company, period), each sum rounded half up.

    ``facts``: kind (payroll, purchase, sale), currency, company, period, amount, cash (null: unknown),
    tax. Money of different currencies is never added: a group with several currencies, or a row without
    one, has null money, status mixed or unknown, and counts that still add up.
    """
    money = F.col("amount")
    out = []
    for keys in by:
        is_kind = lambda kind: F.col("kind") == kind
        sums = facts.groupBy(*keys).agg(
            F.count_if(is_kind("payroll")).alias("payroll_events"), F.count_if(is_kind("purchase")).alias("purchases"), F.count_if(is_kind("sale")).alias("sales"),
            *[F.coalesce(F.sum(F.when(is_kind(k), money)), F.lit(0.0)).alias(f"{k}_total") for k in ("payroll", "purchase", "sale")],
            F.coalesce(F.sum(F.when(is_kind("purchase"), F.col("cash"))), F.lit(0.0)).alias("purchase_cash"),
            F.count_if(is_kind("purchase") & F.col("cash").isNull()).alias("unknown_cash"), F.count_distinct("currency").alias("currencies"), F.count_if(F.col("currency").isNull()).alias("without_currency"),
        )
        single = (F.col("currencies") == 1) & (F.col("without_currency") == 0)
        status = F.when(F.col("currencies") + F.col("without_currency") == 0, "empty").when(single, "single").when(F.col("currencies") > 1, "mixed").otherwise("unknown")
        shown = lambda x: F.when(single, round_up(x, 2))
        expenses = F.col("payroll_total") + F.col("purchase_total")
        out.append(sums.select(
            *[(F.col(k) if k in keys else F.lit(None).cast("string")).alias(k) for k in ("currency", "company", "period")], status.alias("status"), "payroll_events", "purchases", "sales",
            shown(F.col("sale_total")).alias("revenue"), shown(expenses).alias("total_expenses"), shown(F.col("sale_total") - expenses).alias("result"),
            F.when(F.col("unknown_cash") == 0, shown(F.col("purchase_cash") + F.col("payroll_total"))).alias("net_cash_outflow"),
        ))
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union
