"""Whether answers say only what the numbered citations beside them hold."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ingest import iso_currencies

# Fixed values that must match: number grammar, units, scales, currency aliases, command verbs, slack.
NUMBER = r"[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
PERCENT = r"%|percent(?:age)?(?:\s+points?)?"
COUNTED = r"employees?|invoices?|documents?|memories|days?|months?|years?"
SCALES = {"k": 1000, "thousand": 1000, "million": 1000000, "billion": 1000000000}
SYMBOLS = "€$£¥"
ALIASES = {"€": "EUR", "£": "GBP", "RMB": "CNY"}
OVERRIDE = r"(?i)\b(?:ignore|disregard|override)\b.{0,60}\b(?:instruction|prompt|system)\b"
COMMAND = r"(?i)\b(?:answer|respond|output|return|say)\s+(?:only\s+|exactly\s+)?[\"']?([^.;\n]{1,80})"
NEAR = 8

MARKER = re.compile(r"\[([0-9]{1,18})\]")
#: Ends of clauses; a comma or full stop between digits is none.
BREAK = re.compile(r"[;!?\n\r]|(?<![0-9])[,.]|[,.](?![0-9])")


def claim_reader(codes: list[str]) -> Callable[[str], list[tuple[str, str, int, int]]]:
    """A function from a text to its claims (kind, value, start, end): number, money, currency, unit.

    ``codes`` have three capitals each. The span of an amount of money is that of its number. Values are comparable
    texts: ``5.0``, ``EUR:5.0``, ``EUR``, ``days:5.0``, ``date:2024-01``.
    """
    flags = re.IGNORECASE
    known = {*codes, "RMB", *SYMBOLS}
    code = rf"[A-Z]{{3}}|[{SYMBOLS}]"
    token = re.compile(rf"(?<![A-Z])[A-Z]{{3}}(?![A-Z])|[{SYMBOLS}]", flags)
    number = re.compile(NUMBER)
    before = re.compile(rf"(?P<code>{code})\s*(?P<n>{NUMBER})", flags)
    after = re.compile(rf"(?P<n>{NUMBER})\s*(?P<code>{code})", flags)
    scales = "|".join(SCALES)
    units = [re.compile(rf"(?P<n>{NUMBER}){rest}", flags) for rest in (rf"\s*(?P<unit>{PERCENT})", rf"\s+(?P<unit>{COUNTED})\b", rf"\s*(?P<unit>{scales})\b")]
    date = re.compile(r"\b([0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)\b")

    def amount(digits: str) -> float:
        return float(digits.replace(",", ""))

    def currency(name: str) -> str:
        return ALIASES.get(name.upper(), name.upper())

    def unit(name: str) -> str:
        plain = re.sub(r"\s+", " ", name.lower()).replace("percentage", "percent")
        return f"scale {SCALES[plain]}" if plain in SCALES else plain

    def read(text: str) -> list[tuple[str, str, int, int]]:
        found = [("number", str(amount(m[0])), *m.span()) for m in number.finditer(text)]
        for pattern in (before, after):
            amounts = [m for m in pattern.finditer(text) if m["code"].upper() in known]
            found += [("money", f"{currency(m['code'])}:{amount(m['n'])}", *m.span("n")) for m in amounts]
        tokens = [m for m in token.finditer(text) if m[0].upper() in known]
        found += [("currency", currency(m[0]), *m.span()) for m in tokens]
        for pattern in units:
            found += [("unit", f"{unit(m['unit'])}:{amount(m['n'])}", *m.span()) for m in pattern.finditer(text)]
        found += [("unit", f"date:{m[1]}", *m.span()) for m in date.finditer(text)]
        return [claim for claim in found if not claim[1].endswith(("inf", "nan"))]

    return read


def _bound_claims(text: str, read: Callable) -> list[tuple[str, str, list[int]]]:
    """The claims of an answer in the order in which they are judged, each with the markers that it leans on.

    These are the markers of its clause that are nearest to it, and those up to ``NEAR`` characters further.
    """
    found = list(MARKER.finditer(text))
    firsts, lasts, names = [m.start() for m in found], [m.end() for m in found], [int(m[1]) for m in found]
    inside = {(m.start() + 1, m.end() - 1) for m in found}
    ends = [m.start() for m in BREAK.finditer(text)]
    said = read(text)
    money: dict[tuple[int, int], str] = {}
    for kind, value, *span in said:
        if kind == "money":
            money.setdefault(tuple(span), value)

    def bound(start: int, end: int) -> list[int]:
        i, j = bisect_left(ends, start), bisect_left(ends, end)
        low, high = ends[i - 1] if i else -1, ends[j] if j < len(ends) else len(text)
        left = range(bisect_right(lasts, start) - 1, bisect_right(firsts, low) - 1, -1)
        right = range(bisect_left(firsts, end), bisect_right(lasts, high))
        gaps = [start - lasts[left[0]]] if left else []
        gaps += [firsts[right[0]] - end] if right else []
        near = set()
        for side, gap in ((left, lambda k: start - lasts[k]), (right, lambda k: firsts[k] - end)):
            for k in side:
                if gap(k) > min(gaps) + NEAR:
                    break
                near.add(names[k])
        return sorted(near)

    order: list[tuple[str, str, list[int]]] = []
    for kind, value, start, end in said:
        if kind == "money" or kind == "number" and (start, end) in inside:
            continue
        near = bound(start, end)
        order.append((kind, value, near))
        if kind == "number" and (start, end) in money:  # a number in an amount needs the amount too
            order.append(("money", money[start, end], near))
    return order


def claims(texts: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """(…, text) → the other columns with kind and value of each distinct claim of the text; none for null."""
    return _explode(texts, "kind string, value string", lambda text, read: sorted({c[:2] for c in read(text)}), codes)


def answer_claims(answers: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """(…, text) → the other columns with n (place in the order of judgement), kind, value and markers."""
    fields = "n int, kind string, value string, markers array<long>"
    return _explode(answers, fields, lambda text, read: [(n, *c) for n, c in enumerate(_bound_claims(text, read))], codes)


def _explode(rows: DataFrame, fields: str, found: Callable, codes: list[str] | None) -> DataFrame:
    codes = codes if codes is not None else iso_currencies(rows.sparkSession)
    rest = [c for c in rows.columns if c != "text"]
    names = [f.split(" ")[0] for f in fields.split(", ")]
    kept = rows.where("text is not null").select(*rest, "text")
    arrow = {"string": pa.string(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    kinds = [arrow[f.split(" ")[1]] for f in fields.split(", ")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = claim_reader(codes)
        for batch in batches:
            lists = [found(text, read) for text in batch.column("text").to_pylist()]
            source = pa.array([i for i, many in enumerate(lists) for _ in many], pa.int64())
            held = [batch.column(c).take(source) for c in rest]
            flat = [claim for many in lists for claim in many]
            held += [pa.array([claim[i] for claim in flat], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(held, names=rest + names)

    return kept.mapInArrow(step, StructType(kept.select(*rest).schema.fields + StructType.fromDDL(fields).fields))


def echoes(answer: Column, content: Column) -> Column:
    """Whether the answer repeats what a command inside a citation tells it to say."""
    said = plain(answer)
    payload = F.transform(
        F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(COMMAND), F.lit(1)),
        lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "[\"']+$", ""), r"\s+", " "))),
    )
    return F.exists(payload, lambda x: (F.length(x) >= 3) & F.contains(said, x))


def plain(answer: Column) -> Column:
    """Lower case, without markers, white space as single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(answer, r"\[[0-9]+\]", " "), r"\s+", " ")))


def grounding_check(answers: DataFrame, citations: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Answers (query_id, text) against citations (query_id, marker from 1, text) → query_id, status, n_claims.

    ``invalid_or_missing_citation``: no marker, one out of range, an echoed command, or a claim whose clause has no
    marker. ``unsupported_numeric_claim``: none of the claim's nearest markers holds it. Otherwise ``grounded``. Of
    several claims at fault the first in the order of judgement counts. Null texts have no claims and no marker.
    query_id is unique among answers, (query_id, marker) among citations.
    """
    wrong, missing = "unsupported_numeric_claim", "invalid_or_missing_citation"
    used = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.try_cast("long"))
    pairs = answers.select("query_id", F.col("text").alias("said")).join(citations.select("query_id", "text"), "query_id")
    cited = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(echoes(F.col("said"), F.col("text"))).alias("echo"))
    said = answer_claims(answers.select("query_id", "text"), codes)
    held = claims(citations.select("query_id", "marker", "text"), codes).withColumn("held", F.lit(1))
    leans = said.select("query_id", "n", "kind", "value", F.explode_outer("markers").alias("marker"))
    met = leans.join(held, ["query_id", "marker", "kind", "value"], "left")
    judged = met.groupBy("query_id", "n").agg(F.count("marker").alias("near"), F.count("held").alias("held"))
    error = F.when(F.col("near") == 0, missing).when(F.col("held") == 0, wrong)
    first = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_claims"), F.min(F.when(error.isNotNull(), F.struct("n", error.alias("e")))).alias("first"))
    rows = answers.select("query_id", "text", used.alias("used")).join(cited, "query_id", "left").join(first, "query_id", "left")
    outside = F.exists("used", lambda x: x.isNull() | (x < 1) | (x > F.coalesce("n", F.lit(0))))
    bad = (F.size("used") == 0) | outside | plain(F.col("text")).rlike(OVERRIDE) | F.coalesce("echo", F.lit(False))
    status = F.when(bad, missing).otherwise(F.coalesce("first.e", F.lit("grounded")))
    return rows.select("query_id", status.alias("status"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


def marked_figures(text: Column, currency: str = "EUR") -> Column:
    """The distinct amounts with the currency's code right before or after them, thousands commas removed."""
    number = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
    source = F.coalesce(text, F.lit(""))
    before = F.regexp_extract_all(source, F.lit(rf"(?i)\b{currency}\s*{number}"), F.lit(1))
    after = F.regexp_extract_all(source, F.lit(rf"(?i){number}\s*{currency}\b"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(before, after), lambda x: F.replace(x, F.lit(","), F.lit(""))))
