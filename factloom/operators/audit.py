"""Field-level audit of facts: subjects, attributes, contradictions and which value to trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp

TOLERANCE, IMPORTANCE_MARGIN = 0.5, 0.05
SCOPE = ["company_key", "period", "subject"]


def audit_key(company: Column) -> Column:
    """The audit scope of a company label: trimmed and lower-cased, white space inside kept."""
    return F.lower(F.trim(F.coalesce(company, F.lit(""))))


def with_subject(memories: DataFrame) -> DataFrame:
    """Add company_key, period ('' for null) and subject: metadata.record (a string or number that is
    not empty), else source_ref, else null."""
    return _parsed(memories).drop("__v")


def _parsed(memories: DataFrame) -> DataFrame:
    """``with_subject`` and the metadata as a variant, parsed once."""
    rows = memories.withColumn("__v", F.try_parse_json("metadata"))
    rows = rows.withColumn("__kind", F.schema_of_variant(F.try_variant_get("__v", "$.record", "variant")))
    scalar = F.col("__kind").isin("STRING", "BIGINT", "DOUBLE") | F.col("__kind").startswith("DECIMAL")
    rows = rows.withColumn("__record", F.when(scalar, F.try_variant_get("__v", "$.record", "string")))
    return rows.withColumns({
        "company_key": audit_key(F.col("company")), "period": F.coalesce("period", F.lit("")),
        "subject": F.coalesce(F.when(F.col("__record") != "", F.col("__record")), F.when(F.col("source_ref") != "", F.col("source_ref"))),
    }).drop("__kind", "__record")


def attributes(memories: DataFrame) -> DataFrame:
    """One row per scalar of metadata: id, scope, subject, attr, type (b, n, s), number, text.

    ``record`` and ``refs``, nulls, arrays and objects are left out; memories without a subject too.
    """
    parsed = _parsed(memories).where("subject is not null")
    view = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    view = view.where(~F.col("key").isin("record", "refs")).withColumn("__type", F.schema_of_variant("value"))
    number = F.col("__type").isin("BIGINT", "DOUBLE") | F.col("__type").startswith("DECIMAL")
    typed = F.when(F.col("__type") == "BOOLEAN", "b").when(number, "n").when(F.col("__type") == "STRING", "s")
    return view.select(
        "id", "kind", "company_key", "period", "subject", "importance", F.col("created_at").cast("timestamp").alias("created_at"), F.col("key").alias("attr"), typed.alias("type"),
        F.when(number, F.try_variant_get("value", "$", "double")).alias("number"), F.when(~number, F.try_variant_get("value", "$", "string")).alias("text"),
    ).where("type is not null")


def buckets(attrs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Give each row its value's bucket within (scope, subject, attr): the bucket's first value as text.

    Distinct numbers are folded in ascending order: a number joins the last bucket when it is within the
    tolerance of that bucket's first value. Every boolean or string is its own bucket, except a string
    that is the text form of a numeric bucket's first value.
    """
    key = [*SCOPE, "attr"]
    start = F.array().cast("array<double>")
    firsts = F.aggregate("numbers", start, lambda acc, x: F.when((F.size(acc) > 0) & (x - F.element_at(acc, -1) <= tolerance), acc).otherwise(F.concat(acc, F.array(x))))
    # A window and no join, so that rows are computed once: sums of doubles come out a little different each time.
    numbers = F.array_sort(F.collect_set(F.when(F.col("type") == "n", F.col("number"))).over(Window.partitionBy(*key)))
    joined = attrs.withColumn("numbers", numbers).withColumn("firsts", firsts).drop("numbers")
    own = F.element_at(F.filter("firsts", lambda f: f <= F.col("number")), -1)
    as_text = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    same = F.exists(F.coalesce("firsts", start), lambda f: as_text(f) == F.col("text"))
    bucket = F.when(F.col("type") == "n", F.concat(F.lit("n:"), as_text(own))).when((F.col("type") == "s") & same, F.concat(F.lit("n:"), F.col("text"))).otherwise(F.concat("type", F.lit(":"), "text"))
    return joined.withColumn("bucket", bucket).drop("firsts")


def one_bucket(tolerance: float = TOLERANCE) -> Column:
    """Whether all values of a key are in one bucket of ``buckets``, by the least and greatest of its numbers (low_number,
    high_number) and of its other values as type:text (low_text, high_text): a string is in a number's bucket by its text form."""
    first = F.concat(F.lit("s:"), F.regexp_replace(F.col("low_number").cast("string"), r"\.0$", ""))
    texts = F.col("low_text").isNull() | (F.col("low_text") == F.col("high_text"))
    near = (F.col("high_number") - F.col("low_number") <= tolerance) & (F.col("low_text").isNull() | (F.col("low_text") == first))
    return texts & (F.col("low_number").isNull() | near)


def _value_buckets(rows: DataFrame, tolerance: float, told: bool = False) -> DataFrame:
    """Carriers summed up by bucket (the rule of ``buckets``), from one aggregate by value.

    Numbers are sorted once a key. A gap beyond the tolerance always starts a bucket, so only a run
    without such a gap, and not all numbers of a hot subject, is folded as an array. ``told``: with what each carrier says,
    and the latest one where times may be null.
    """
    key = [*SCOPE, "attr"]
    measures = ("n", "importance", "authority", "created_at", "by_importance", "by_authority", "by_time", *["by_latest"] * told)
    said = [F.coalesce(F.col("number").cast("string"), F.col("text")).alias("said")] * told
    values = rows.groupBy(*key, "type", "number", "text").agg(
        F.count(F.lit(1)).alias("n"), F.max("importance").alias("importance"), F.max("authority").alias("authority"), F.max("created_at").alias("created_at"),
        F.min(F.struct((-F.coalesce("importance", F.lit(-1.0))).alias("a"), "created_at", "id", *said)).alias("by_importance"),
        F.min(F.struct((-F.col("authority")).alias("a"), "created_at", "id", *said)).alias("by_authority"),
        F.min(F.struct((-F.unix_micros("created_at")).alias("a"), "id", *said)).alias("by_time"),
        *[F.min(F.struct((-F.coalesce(F.unix_micros("created_at"), F.lit(0))).alias("a"), "id", *said)).alias("by_latest")] * told,
    )
    by_number = Window.partitionBy(*key).orderBy("type", "number", "text")
    starts = (F.col("type") == "n") & (F.col("number") - F.lag(F.when(F.col("type") == "n", F.col("number"))).over(by_number) <= tolerance)
    runs = values.withColumn("start", F.when(F.coalesce(starts, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("start").over(by_number))
    listed = runs.groupBy(*key, "type", "run").agg(F.array_sort(F.collect_list(F.struct("number", "text", *measures))).alias("held"))
    none = F.array().cast("array<double>")
    firsts = F.aggregate("held", none, lambda acc, x: F.when((F.size(acc) > 0) & (x["number"] - F.element_at(acc, -1) <= tolerance), acc).otherwise(F.concat(acc, F.array(x["number"]))))
    spread = listed.withColumn("firsts", F.when(F.col("type") == "n", firsts)).select(*key, "type", "firsts", F.explode("held").alias("x"))
    own = F.element_at(F.filter("firsts", lambda f: f <= F.col("x.number")), -1)
    as_text = F.regexp_replace(own.cast("string"), r"\.0$", "")
    label = F.when(F.col("type") == "n", as_text).otherwise(F.col("x.text"))
    named = spread.select(*key, "type", label.alias("label"), *[F.col(f"x.{m}").alias(m) for m in measures])
    # A string that reads like a numeric bucket of its key is in that bucket.
    numeric = F.max((F.col("type") == "n").cast("int")).over(Window.partitionBy(*key, "label")) == 1
    bucket = F.concat(F.when((F.col("type") == "s") & numeric, "n").otherwise(F.col("type")), F.lit(":"), "label")
    return named.withColumn("bucket", bucket).groupBy(*key, "bucket").agg(F.sum("n").alias("n"), *[(F.max if m in measures[1:4] else F.min)(m).alias(m) for m in measures[1:]])


def contradictions(memories: DataFrame, tolerance: float = TOLERANCE, authority: dict[str, int] | None = None) -> DataFrame:
    """Subjects whose attribute has at least two buckets carried by at least two memories.

    Columns: scope, subject, attr, n_buckets, n_carriers, winner_id, winner_bucket, rule, confidence.
    The ladder: importance, when the best two buckets differ by the margin; else the source's authority
    (insights 1, others 2); else the latest carrier. Ids are unique, as those of a fact table are.
    """
    ranked, folds = _folds(memories, tolerance, authority, False)
    key = [*SCOPE, "attr"]
    folded = ranked.groupBy(*key).agg(*[fold.alias(name) for name, fold in folds.items()]).where("n_buckets >= 2 and n_carriers >= 2")
    winner, rule, confidence = _ladder()
    return folded.select(*key, "n_buckets", "n_carriers", winner["id"].alias("winner_id"), winner["bucket"].alias("winner_bucket"), rule.alias("rule"), F.round(confidence, 6).alias("confidence"))


def bucket_values(memories: DataFrame, tolerance: float = TOLERANCE, authority: dict[str, int] | None = None) -> DataFrame:
    """The buckets of ``contradictions``: scope, subject, attr, bucket, n_carriers, memory_id, value, recommended.

    The memory is the winner in its bucket, else the latest carrier. Winners are folded over a window, so the facts are
    computed once and a bucket's label is the same on both sides.
    """
    ranked, folds = _folds(memories, tolerance, authority, True)
    key = [*SCOPE, "attr"]
    own = Window.partitionBy(*key)
    folded = ranked.withColumns({name: fold.over(own) for name, fold in folds.items()}).where("n_buckets >= 2 and n_carriers >= 2")
    winner = _ladder()[0]
    chosen = winner["bucket"] == F.col("bucket")
    shown = lambda name: F.when(chosen, winner[name]).otherwise(F.col("by_latest")[name])
    return folded.select(*key, "bucket", F.col("n").alias("n_carriers"), shown("id").alias("memory_id"), shown("said").alias("value"), chosen.alias("recommended"))


def _folds(memories: DataFrame, tolerance: float, authority: dict[str, int] | None, told: bool) -> tuple[DataFrame, dict[str, Column]]:
    """Buckets with their places by importance, authority and time, and what is folded from these by key."""
    key = [*SCOPE, "attr"]
    rank = F.lit(2)
    for kind, level in ({"insight": 1} | (authority or {})).items():
        rank = F.when(F.col("kind") == kind, F.lit(level)).otherwise(rank)
    by_bucket = _value_buckets(attributes(memories).withColumn("authority", rank), tolerance, told)
    order = lambda *c: F.row_number().over(Window.partitionBy(*key).orderBy(*c))
    best = F.coalesce("importance", F.lit(-1.0))
    ranked = by_bucket.withColumns({"ri": order(best.desc(), "bucket"), "ra": order(F.desc("authority"), "bucket"), "rt": order(F.desc("created_at"), F.col("by_time.id"))})
    pick = lambda rank, column, at: F.max(F.when(F.col(rank) == at, column))
    named = lambda by: F.struct(f"{by}.id", *[f"{by}.said"] * told, "bucket")
    folds = {"n_buckets": F.count(F.lit(1)), "n_carriers": F.sum("n")}
    folds |= {f"i{i}": pick("ri", best, i) for i in (1, 2)} | {f"a{i}": pick("ra", F.col("authority"), i) for i in (1, 2)} | {f"t{i}": pick("rt", F.col("created_at"), i) for i in (1, 2)}
    return ranked, folds | {"wi": pick("ri", named("by_importance"), 1), "wa": pick("ra", named("by_authority"), 1), "wt": pick("rt", named("by_time"), 1)}


def _ladder() -> tuple[Column, Column, Column]:
    """(winner, rule, confidence) from the folds."""
    margin = F.col("i1") - F.col("i2")
    important, authoritative = margin >= IMPORTANCE_MARGIN - 1e-12, F.col("a1") > F.col("a2")
    days = (F.unix_micros("t1") - F.unix_micros("t2")) / 86.4e9
    winner = F.when(important, F.col("wi")).when(authoritative, F.col("wa")).otherwise(F.col("wt"))
    confidence = F.when(important, clamp(0.6 + F.least(F.lit(0.3), margin / 2), 0.0, 1.0)).when(authoritative, F.lit(0.75)).when(days > 0, 0.5 + F.least(F.lit(0.35), days / 30 * 0.35)).otherwise(F.lit(0.4))
    return winner, F.when(important, "importance").when(authoritative, "source-authority").otherwise("recency"), confidence


def hit_contradictions(hits: DataFrame, memories: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Contradictions among each question's own hits (query_id, id): query_id and the columns of ``contradictions``.

    All questions are audited in one job, as the question is part of the scope. A hit shows no importance but one in
    its metadata, so the ladder's first rule rests on that.
    """
    kind = dict(hits.dtypes)["query_id"]
    mark = "\x01"
    # The scope is lower-cased, so the question goes in as hexadecimal digits.
    scoped = F.concat(F.hex(F.col("query_id").cast("string")), F.lit(mark), audit_key(F.col("company")))
    said = F.try_variant_get(F.try_parse_json("metadata"), "$.importance", "double")
    held = hits.select("query_id", "id").distinct().join(memories, "id").withColumns({"company": scoped, "importance": said})
    found = contradictions(held.drop("query_id"), tolerance)
    whose = F.decode(F.unhex(F.substring_index("company_key", mark, 1)), "UTF-8").cast(kind)
    return found.select(whose.alias("query_id"), F.substring_index("company_key", mark, -1).alias("company_key"), *[c for c in found.columns if c != "company_key"])


def dangling_references(memories: DataFrame) -> DataFrame:
    """References in metadata.refs whose (company, period, reference) no memory has as its subject.

    Each memory says which subject it has and which it refers to, in one pass; one aggregate by subject follows.
    """
    rows = _parsed(memories)
    refs = F.coalesce(F.try_variant_get("__v", "$.refs", "array<string>"), F.array().cast("array<string>"))
    said = F.concat(F.array(F.struct(F.col("subject").alias("ref"), F.lit(True).alias("has"))), F.transform(refs, lambda r: F.struct(r.alias("ref"), F.lit(False).alias("has"))))
    sides = rows.select("company_key", "period", "id", F.explode(said).alias("s")).select("company_key", "period", "id", "s.ref", "s.has").where("ref is not null and ref <> ''")
    found = sides.groupBy("company_key", "period", "ref").agg(F.max("has").alias("known"), F.count_if(~F.col("has")).alias("n"), F.count_distinct(F.when(~F.col("has"), F.col("id"))).alias("n_memories"), F.min(F.when(~F.col("has"), F.col("id"))).alias("first_id"))
    return found.where("not known and n > 0").select("company_key", "period", "ref", "n_memories", "first_id")


def contradiction_alerts(memories: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Scope, subject and attr that two memories or more give values apart: numbers by more than the tolerance,
    or different texts or booleans, or values of two types.

    Only mergeable extremes are kept for each key, so this runs over a stream too, where a key's row comes
    again whenever it changes. The first value of a stream opens no bucket; the spread decides.
    """
    rows = attributes(memories).withColumn("text", F.concat("type", F.lit(":"), "text"))
    spread = rows.groupBy(*SCOPE, "attr").agg(*[f(c).alias(f"{n}_{c}") for c in ("number", "text", "id") for n, f in (("low", F.min), ("high", F.max))], F.count(F.lit(1)).alias("n_values"))
    apart = F.coalesce(F.col("high_number") - F.col("low_number") > tolerance, F.lit(False)) | F.coalesce(F.col("low_text") != F.col("high_text"), F.lit(False))
    mixed = F.col("low_number").isNotNull() & F.col("low_text").isNotNull()
    return spread.where((apart | mixed) & (F.col("low_id") != F.col("high_id"))).select(*SCOPE, "attr", "n_values", "low_id", "high_id")
