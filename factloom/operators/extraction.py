"""Structured extractions as payroll documents, or the reason why they are refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import materialize
from ..functions.scalars import localized_amount, valid_date
from .finance import CENT
from .ingest import iso_currencies, nfkc_labels

# Fixed values that must match: allowed keys, document types, default event, bounds.
ROOT = ["doc_type", "company", "period", "currency", "event_ref", "payroll_run_id", "gross_pay_total", "employer_cost_total",
        "employer_social_security_total", "net_pay_total", "employee_count", "payment_date", "employee", "payslip"]
EMPLOYEE = ["employee_id", "employee_code", "name", "gross", "employee_social_security", "tax", "net", "employer_social_security", "employer_cost"]
TYPES = ["payroll_register", "payslip", "bank_confirmation"]
DEFAULT_EVENT = "monthly-consolidated"
MOST_CHARS, MOST_REF = 64000, 128

TOTALS = ["gross_pay_total", "employer_cost_total", "employer_social_security_total", "net_pay_total", "employee_count"]
AMOUNTS = EMPLOYEE[3:]
NOBODY = r"(?i)^(?:unknown|n/?a|null)?$"


def _text(source: str, key: str) -> Column:
    found = F.get_json_object(source, f"$.{key}")
    return F.when(found != "", found)


def _clean(name: str) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def _conflict(one: Column, other: Column) -> Column:
    return F.lower(one) != F.lower(other)


def normalize_extracted(docs: DataFrame, codes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected with ``error``) of (doc_id, company, period, currency, event_ref, declared_type, extracted).

    ``extracted`` is one JSON object, perhaps in a code fence, of known keys only. What the caller declares must
    agree with it; nulls and empty texts say nothing. A register needs two of its three sums, a payslip an employee,
    a bank confirmation its total; what is left out is worked out. The first rule that a document breaks names it.
    """
    codes = codes if codes is not None else iso_currencies(docs.sparkSession)
    col = F.col
    whole = F.trim(F.coalesce("extracted", F.lit("")))
    bare = F.regexp_replace(whole, r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1")
    rows = docs.withColumn("_bare", bare).withColumn("_person", F.coalesce(_text("_bare", "employee"), _text("_bare", "payslip")))
    said = {f"_{c}": _text("_bare", c) for c in ROOT[:6] + TOTALS + ["payment_date"]}
    said |= {f"_e_{c}": _text("_person", c) for c in EMPLOYEE}
    said |= {f"_d_{c}": F.when(col(c) != "", col(c)) for c in ("company", "period", "currency", "event_ref")}
    rows = rows.withColumns(said)
    labels = ["_company", "_d_company", "_event_ref", "_payroll_run_id", "_d_event_ref", "_currency", "_d_currency"]
    labels += ["_e_employee_id", "_e_employee_code"]
    # The JSON is parsed once and labels are looked up in one dictionary; the rules then read plain stored columns.
    rows = nfkc_labels(materialize(rows), labels)
    rows = rows.withColumns({name: _clean(name) for name in labels})
    rows = rows.withColumns({c: F.upper(c) for c in ("_currency", "_d_currency")})
    amount = lambda c: F.coalesce(col(c).try_cast("double"), localized_amount(col(c)))
    rows = materialize(rows.withColumns({f"_n{c}": amount(c) for c in [f"_{c}" for c in TOTALS] + [f"_e_{c}" for c in AMOUNTS]}))

    number = lambda name: col(f"_n_{name}")
    person = lambda name: col(f"_n_e_{name}")
    off = lambda raw, n: col(raw).isNotNull() & (n.isNull() | F.isnan(n) | (n < 0) | (n == F.lit(float("inf"))))
    ref = F.coalesce("_event_ref", "_payroll_run_id")
    named = F.regexp_replace(F.lower(F.trim("_doc_type")), r"\s+", "_")
    read_type = F.when(named.isin(TYPES), named).otherwise("unknown")
    declared = F.when(col("declared_type").isin(TYPES), col("declared_type"))
    kind = F.coalesce(declared, read_type)
    gross, cost, social = number("gross_pay_total"), number("employer_cost_total"), number("employer_social_security_total")
    register = kind == "payroll_register"
    given = sum(x.isNotNull().cast("int") for x in (gross, cost, social))
    fill = lambda value, other: F.when(register, F.coalesce(value, other)).otherwise(value)
    all_gross, all_social, all_cost = fill(gross, cost - social), fill(social, cost - gross), fill(cost, gross + social)
    somebody = col("_person").isNotNull()
    who = F.coalesce("_e_employee_id", "_e_employee_code")
    his_social = F.coalesce(person("employer_social_security"), person("employer_cost") - person("gross"))
    his_cost = F.coalesce(person("employer_cost"), person("gross") + person("employer_social_security"))
    apart = lambda a, b: F.abs(a - b) > CENT + 1e-9
    bad_ref = lambda name: (F.length(name) > MOST_REF) | col(name).rlike(r"[\x00-\x1f\x7f]") | (col(name) == "")
    unknown = lambda source, known: F.size(F.array_except(F.json_object_keys(source), F.array(*map(F.lit, known)))) > 0
    wrapped = lambda a, b: F.try_parse_json(F.concat(F.lit(a), "_bare", F.lit(b))).isNotNull()
    single = wrapped("[", "]") & wrapped('{"d":', "}")  # the parser alone ignores what follows a first object
    bad_period = lambda name: ~col(name).rlike(r"^[0-9]{4}-(?:0[1-9]|1[0-2])$")
    rules = [
        ((whole == "") | (F.length(whole) > MOST_CHARS), "empty_or_too_large"),
        (~F.startswith("_bare", F.lit("{")) | ~single, "not_one_json_object"), (unknown("_bare", ROOT), "unknown_key"),
        (_text("_bare", "employee").isNotNull() & _text("_bare", "payslip").isNotNull(), "employee_and_payslip"),
        (somebody & F.json_object_keys("_person").isNull(), "employee_not_an_object"), (unknown("_person", EMPLOYEE), "unknown_employee_key"),
        (col("_d_company").rlike(NOBODY) | col("_company").rlike(NOBODY) | F.coalesce("_d_company", "_company").isNull(), "company"),
        (_conflict(col("_d_company"), col("_company")), "company_conflict"),
        (bad_period("_d_period") | bad_period("_period") | F.coalesce("_d_period", "_period").isNull(), "period"),
        (col("_d_period") != col("_period"), "period_conflict"), (~col("_d_currency").isin(codes) | ~col("_currency").isin(codes), "currency"),
        (col("_d_currency") != col("_currency"), "currency_conflict"),
        (bad_ref("_event_ref") | bad_ref("_payroll_run_id") | bad_ref("_d_event_ref"), "event_ref"),
        (_conflict(col("_event_ref"), col("_payroll_run_id")) | _conflict(col("_d_event_ref"), ref), "event_ref_conflict"),
        ((read_type != "unknown") & (declared != read_type), "doc_type_conflict"),
        (somebody & (who.isNull() | who.rlike(NOBODY)), "employee_id"), (_conflict(col("_e_employee_id"), col("_e_employee_code")), "employee_id_conflict"),
        *[(off(f"_e_{c}", person(c)), f"employee_{c}") for c in AMOUNTS],
        *[(somebody & person(c).isNull(), f"employee_{c}") for c in ("gross", "net")], (somebody & his_social.isNull(), "employee_cost_missing"),
        (somebody & ((his_social < 0) | apart(his_cost, person("gross") + his_social)), "employee_cost"),
        ((kind == "payslip") & ~somebody, "payslip_needs_employee"), *[(off(f"_{c}", number(c)), c) for c in TOTALS],
        (register & (given < 2), "register_needs_two_totals"), (register & apart(cost, gross + social), "register_cost"),
        (register & ((all_gross < 0) | (all_social < 0)), "register_negative"),
        ((kind == "bank_confirmation") & number("net_pay_total").isNull(), "bank_needs_net"),
        (number("employee_count") != F.floor(number("employee_count")), "employee_count"), (col("_payment_date").isNotNull() & ~valid_date(col("_payment_date")), "payment_date"),
    ]
    error = F.coalesce(*[F.when(broken, name) for broken, name in rules])
    judged = materialize(rows.withColumn("error", error))
    zero = lambda name: F.coalesce(person(name), F.lit(0.0)).alias(name)
    slip = F.struct(who.alias("employee_id"), F.coalesce("_e_name", who).alias("name"), person("gross").alias("gross"), zero("employee_social_security"),
                    zero("tax"), person("net").alias("net"), his_social.alias("employer_social_security"), his_cost.alias("employer_cost"))
    clean = judged.where("error is null").select(
        "doc_id", kind.alias("doc_type"), F.coalesce("_d_company", "_company").alias("company"), F.coalesce("_d_period", "_period").alias("period"),
        F.coalesce("_d_currency", "_currency").alias("currency"), F.coalesce(col("_d_event_ref"), ref, F.lit(DEFAULT_EVENT)).alias("event_ref"),
        all_gross.alias("gross_pay_total"), all_cost.alias("employer_cost_total"), all_social.alias("employer_social_security_total"),
        number("net_pay_total").alias("net_pay_total"), number("employee_count").cast("int").alias("employee_count"), col("_payment_date").alias("payment_date"),
        F.when(somebody, slip).alias("payslip"),
    )
    return clean, judged.where("error is not null").select(*docs.columns, "error")
