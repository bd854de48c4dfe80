"""Facts that come out a little different each time they are computed, as sums of doubles in another order do."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import audit, lifecycle, reports


@pytest.fixture()
def wavering(spark):
    """Two memories of each subject; the totals differ by some cents each time they are computed."""
    meta = F.udf(lambda i: f'{{"total": {10.0 * (i % 2) + random.random() / 10:.6f}, "state": "{"ab"[i % 2]}"}}').asNondeterministic()
    rows = spark.range(40, numPartitions=3)
    return rows.select(
        F.concat(F.lit("m"), "id").alias("id"), F.lit("invoice").alias("kind"), F.lit("acme").alias("company"), F.lit("2024-01").alias("period"), F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias("source_ref"),
        meta("id").alias("metadata"), F.lit(0.5).alias("importance"), F.timestamp_seconds(F.col("id")).alias("created_at"))


def test_decisions_on_wavering_facts(spark, wavering):
    decisions = spark.createDataFrame([(f"d{i}", "acme", "2024-01", f"s{i}", "total", f"m{2 * i}", [f"m{2 * i + 1}"]) for i in range(20)], "decision_id string, company_key string, period string, subject string, attr string, selected_id string, target_ids array<string>")
    found = lifecycle.apply_conflict_decisions(wavering, decisions).collect()
    assert len(found) == 20 and all(r.state == "resolved" and r.importance == 0.95 and r.superseded_ids == [f"m{2 * int(r.decision_id[1:]) + 1}"] for r in found)


@pytest.mark.parametrize(("values", "state"), [
    ((1.0, 1.4), "no_conflict"), ((1.0, 1.6), "resolved"), (("a", "a"), "no_conflict"), (("a", "b"), "resolved"), ((3.0, "3"), "no_conflict"), ((3.4, "3"), "resolved"), ((True, "true"), "resolved"), ((1.0, True), "resolved"), ((True, True), "no_conflict"),
])
def test_one_bucket_or_several(spark, values, state):
    import json

    rows = spark.createDataFrame([(f"m{i}", "note", "acme", "2024-01", "s", json.dumps({"x": v}), 0.5) for i, v in enumerate(values)], "id string, kind string, company string, period string, source_ref string, metadata string, importance double").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    n = audit.buckets(audit.attributes(rows)).agg(F.count_distinct("bucket")).first()[0]
    decisions = spark.createDataFrame([("d", "acme", "2024-01", "s", "x", "m0", ["m1"])], "decision_id string, company_key string, period string, subject string, attr string, selected_id string, target_ids array<string>")
    assert [r.state for r in lifecycle.apply_conflict_decisions(rows, decisions).collect()] == [state] and (n > 1) == (state == "resolved")


def test_values_of_wavering_facts(wavering):
    rows = reports.contradiction_values(wavering).where("attr = 'total'").collect()
    assert len(rows) == 40 and sum(r.recommended for r in rows) == 20 and {r.n_carriers for r in rows} == {1}


def test_values_are_those_of_given_contradictions(spark):
    from factloom.plans.facts import memories

    rows = memories(spark, "/root/testdata/sf0.001")
    one, other = reports.contradiction_values(rows), reports.contradiction_values(rows, audit.contradictions(rows))
    assert sorted(map(tuple, one.select(*other.columns).collect())) == sorted(map(tuple, other.collect()))
