"""Reports over audits: what was found, how much was read, and how findings meet labelled ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import SCOPE, attributes, bucket_values, buckets, contradictions, dangling_references, with_subject
from .lifecycle import similar_pairs
from .meaning import opposed, polarity


def bounded_selection(memories: DataFrame, limit: int | None = None) -> tuple[DataFrame, Column]:
    """(rows to audit, whether some were left out): the most important, newest, lowest ids first; all without a limit."""
    if limit is None:
        return memories, F.lit(False)
    first = memories.orderBy(F.coalesce("importance", F.lit(0.0)).desc(), F.desc("created_at"), "id").limit(limit + 1)
    return first.limit(limit), F.lit(first.count() > limit)


def top_pairs(memories: DataFrame, scope: list[str], threshold: float = 0.75, limit: int | None = None) -> DataFrame:
    """Similar pairs of a scope (a, b, cosine), the most similar first and then by ``a|b``; all without a limit."""
    pairs = similar_pairs(memories, scope, threshold)
    if limit is None:
        return pairs
    return pairs.orderBy(F.desc(F.round("cosine", 9)), F.concat(F.col("a").cast("string"), F.lit("|"), F.col("b").cast("string"))).limit(limit)


def contradiction_values(memories: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row for each value of a contradiction: scope, subject, attr, bucket, n_carriers, memory_id, value, recommended.

    The value's representative is the recommended memory where it carries the value, else the latest
    carrier (ties by the lowest id), with the exact value that it says.
    """
    if found is None:
        return bucket_values(memories)
    key = [*SCOPE, "attr"]
    rows = buckets(attributes(memories)).join(found.select(*key, "winner_id", "winner_bucket"), key)
    said = F.coalesce(F.col("number").cast("string"), F.col("text"))
    own = (F.col("id") == F.col("winner_id")) & (F.col("bucket") == F.col("winner_bucket"))
    best = F.min(F.struct(F.when(own, 0).otherwise(1).alias("a"), (-F.coalesce(F.unix_micros("created_at"), F.lit(0))).alias("b"), "id", said.alias("value")))
    grouped = rows.groupBy(*key, "bucket").agg(F.count_distinct("id").alias("n_carriers"), best.alias("best"))
    return grouped.select(*key, "bucket", "n_carriers", F.col("best.id").alias("memory_id"), F.col("best.value").alias("value"), (F.col("best.a") == 0).alias("recommended"))


def contradiction_report(memories: DataFrame) -> DataFrame:
    """One row: audited, subjects, contradictions, absences, ok."""
    rows = with_subject(memories)
    counted = rows.agg(F.count(F.lit(1)).alias("audited"))
    subjects = rows.where("subject is not null").select(*SCOPE).distinct().agg(F.count(F.lit(1)).alias("subjects"))
    odd = contradictions(memories).agg(F.count(F.lit(1)).alias("contradictions"))
    missing = dangling_references(memories).agg(F.count(F.lit(1)).alias("absences"))
    one = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), [counted, subjects, odd, missing])  # one row each
    return one.withColumn("ok", (F.col("contradictions") == 0) & (F.col("absences") == 0))


def judged_pairs(memories: DataFrame, scope: list[str], threshold: float = 0.75, limit: int | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """Candidate pairs with status (ok, inconclusive) and contradict: by polarity, or by a judge's ``verdicts`` (a, b, contradict, status).

    A pair that a given table of verdicts does not name is inconclusive.
    """
    pairs = top_pairs(memories, scope, threshold, limit)
    if verdicts is not None:
        return pairs.join(verdicts.select("a", "b", "contradict", "status"), ["a", "b"], "left").withColumns({"contradict": F.coalesce("contradict", F.lit(False)), "status": F.coalesce("status", F.lit("inconclusive"))})
    signs = memories.select("id", polarity(F.col("content")).alias("signs"))
    joined = pairs.join(signs.toDF("a", "sa"), "a").join(signs.toDF("b", "sb"), "b")
    return joined.select("a", "b", "cosine", opposed(F.col("sa"), F.col("sb")).isNotNull().alias("contradict"), F.lit("ok").alias("status"))


def semantic_report(memories: DataFrame, judged: DataFrame, candidate_pairs: int | None = None, truncated: bool = False) -> DataFrame:
    """One row: total_memories, candidate_pairs, compared, judged, failed, contradictions, truncated, status, ok.

    ``candidate_pairs`` is the number of pairs before a limit, if there was one. Nothing judged of some pairs
    is inconclusive; failures or a limit that left pairs out make it partial. Only a complete report
    without a finding is ok.
    """
    total = memories.agg(F.count(F.lit(1)).alias("total_memories"))
    good = F.col("status") == "ok"
    sums = judged.agg(F.count(F.lit(1)).alias("compared"), F.count_if(good).alias("judged"), F.count_if(~good).alias("failed"), F.count_if(good & F.col("contradict")).alias("contradictions"))
    pairs = F.col("compared") if candidate_pairs is None else F.lit(candidate_pairs).cast("long")
    row = total.join(F.broadcast(sums), F.lit(True)).withColumn("candidate_pairs", pairs)  # one row each
    row = row.withColumn("truncated", F.lit(truncated) | (F.col("candidate_pairs") > F.col("compared")))
    status = F.when((F.col("compared") > 0) & (F.col("judged") == 0), "inconclusive").when((F.col("failed") > 0) | F.col("truncated"), "partial").otherwise("complete")
    return row.withColumn("status", status).withColumn("ok", (F.col("status") == "complete") & (F.col("contradictions") == 0)).select(
        "total_memories", "candidate_pairs", "compared", "judged", "failed", "contradictions", "truncated", "status", "ok")


def label_difference(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct key with state: detected (in both), missed (expected only) or false_positive (found only)."""
    left = expected.select(*keys).distinct().withColumn("__gold", F.lit(1))
    right = found.select(*keys).distinct().withColumn("__got", F.lit(1))
    both = left.join(right, keys, "full_outer")
    return both.select(*keys, F.when(F.col("__gold").isNull(), "false_positive").when(F.col("__got").isNull(), "missed").otherwise("detected").alias("state"))


def detection_precision(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: injected, detected, false_positives, detection_rate, precision (percent; 0 without expected, 100 without found)."""
    states = label_difference(expected, found, keys)
    count = lambda *names: F.count_if(F.col("state").isin(*names))
    sums = states.agg(count("detected", "missed").alias("injected"), count("detected").alias("detected"), count("false_positive").alias("false_positives"))
    hit, wrong = F.col("detected"), F.col("false_positives")
    return sums.withColumns({
        "detection_rate": F.when(F.col("injected") > 0, F.round(100 * hit / F.col("injected"), 6)).otherwise(F.lit(0.0)),
        "precision": F.when(hit + wrong > 0, F.round(100 * hit / (hit + wrong), 6)).otherwise(F.lit(100.0)),
    })
