"""Column functions that the operators share; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def round_up(x: Column, digits: int) -> Column:
    """Round halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def canonical_label(label: Column) -> Column:
    """Collapse white space, trim and lower-case; an empty label is the global scope. Labels beyond the
    Basic Latin block should be NFKC-normalised when they are loaded."""
    clean = F.lower(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " ")))
    return F.when(clean == "", F.lit("_global")).otherwise(clean)


def slug(label: Column) -> Column:
    """Runs of other characters than letters and digits become one hyphen; ``company`` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(clean == "", F.lit("company")).otherwise(clean)


def snippet(text: Column, size: int = 160) -> Column:
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 3), F.lit("…")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero vector has cosine 0 with anything."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size)


def localized_amount(text: Column) -> Column:
    """``(1.234,56) EUR`` or ``1'234.50`` as double: the last of two marks is the decimal one, brackets
    or a minus are negative. A lone mark before exactly three digits is ambiguous and gives null."""
    bare = F.regexp_replace(F.trim(text), r"[\s '’]|[A-Za-z]{3}|[€$£]", "")
    negative = bare.rlike(r"^\(.*\)$|^-|-$")
    digits = F.regexp_replace(bare, r"[()+-]", "")
    comma, point = F.length(digits) - F.instr(F.reverse(digits), ","), F.length(digits) - F.instr(F.reverse(digits), ".")
    has_comma, has_point = F.instr(digits, ",") > 0, F.instr(digits, ".") > 0
    european = F.regexp_replace(F.regexp_replace(digits, r"\.", ""), ",", ".")
    plain = F.regexp_replace(digits, ",", "")
    value = (
        F.when(has_comma & has_point, F.when(comma > point, european).otherwise(plain))
        .when(digits.rlike(r"^\d{1,3}[.,]\d{3}$"), F.lit(None).cast("string"))
        .when(digits.rlike(r"^\d{1,3}(,\d{3})+$"), plain)
        .when(digits.rlike(r"^\d{1,3}(\.\d{3})+$"), F.regexp_replace(digits, r"\.", ""))
        .when(has_comma, european)
        .otherwise(digits)
    )
    number = F.when(value.rlike(r"^\d+(\.\d+)?$"), value.try_cast("double"))
    return F.when(negative, -number).otherwise(number)


def valid_period(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.lit(False))


def valid_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def money_text(value: Column, currency: Column) -> Column:
    """``EUR 1,234.5``: thousands commas, at most two decimals; null is ``n/a``."""
    digits = F.regexp_replace(F.format_number(round_up(value, 2), 2), r"\.?0+$", "")
    return F.when(value.isNull(), "n/a").when(currency.isNull(), F.concat(digits, F.lit(" currency units"))).otherwise(F.concat(currency, F.lit(" "), digits))


def scrub(text: Column, size: int = 500) -> Column:
    """Control characters become spaces; trimmed and cut to ``size``; ``unspecified`` if nothing is left."""
    clean = F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1F\x7F]", " ")), 1, size)
    return F.when(clean == "", "unspecified").otherwise(clean)


def safe_number(value: Column, default: float = 0.0) -> Column:
    """A finite double, else ``default``: for null, NaN, infinities and text that is no number."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf"))), F.lit(default)).otherwise(number)


def shuffled(vector: Column, size: int, seed: int = 1234567) -> Column:
    """The vector's components in one fixed pseudo-random order: a Fisher-Yates shuffle by xorshift32."""
    order, state = list(range(size)), seed
    for i in range(size - 1, 0, -1):
        state ^= state << 13 & 0xFFFFFFFF
        state ^= (state - (state >> 31 << 32)) >> 17 & 0xFFFFFFFF  # the sign bit fills up
        state ^= state << 5 & 0xFFFFFFFF
        j = int(state / 0xFFFFFFFF * (i + 1))
        order[i], order[j] = order[j], order[i]
    return F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.coalesce(F.get(vector, i), F.lit(0.0)))


def marked_figures(text: Column) -> Column:
    """Numbers beside a euro mark, on either side, thousands commas removed."""
    number = r"-?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?:€|EUR)\s*{number}|{number}\s*(?:€|EUR)"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r"[€EUR\s,]", ""))


def request_hash(*columns: str) -> Column:
    """A hash of a request's fields in the order of their names; nulls count."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
