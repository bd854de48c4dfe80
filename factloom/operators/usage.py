"""Quotas, latencies and evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import materialize


def daily_usage(events: DataFrame) -> DataFrame:
    """(ts, bucket, subject, units) → units and events per UTC day, bucket and subject."""
    day = F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd")
    return events.groupBy(day.alias("day"), "bucket", "subject").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("n_events"))


def latency_percentiles(rows: DataFrame, by: list[str], value: str, bins: int = 1024, small: int = 100_000) -> DataFrame:
    """Nearest-rank percentiles of each group, exact: least, p50, p95, p99, most, n (all rows, nulls too).

    A histogram between each group's ends tells in which bin a rank lies and how many values are below it; only that
    bin's values are read again, in a histogram of their own, until a bin has at most ``small`` values or one value.
    No group is sorted, and no map of distinct values is built, beyond ``small`` rows.
    """
    held = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    ends = materialize(rows.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"), F.count(value).alias("__n")))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("__p"), F.greatest(F.ceil(F.col("__n") * share), F.lit(1)).alias("__rank")) for name, share in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]))
    opened = ends.where("__n > 0").select(*by, asked.alias("a"), F.col("least").alias("__lo"), F.col("most").alias("__hi"), "__n").select(*by, "a.*", "__lo", "__hi", "__n")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    done: list[DataFrame] = []
    while True:
        flat = (F.col("__lo") == F.col("__hi")) | (F.col("__n") <= small)
        done.append(opened.where(flat))
        opened = opened.where(~flat)
        if opened.isEmpty():
            break
        inside = held.alias("h").join(opened.alias("o"), [*same("h", "o"), F.col("__v").between(F.col("__lo"), F.col("__hi"))])
        width = (F.col("__hi").cast("double") - F.col("__lo").cast("double")) / bins
        placed = inside.select(*[F.col(f"o.{c}").alias(c) for c in by], "__p", "__rank", "__v", F.least(F.floor((F.col("__v").cast("double") - F.col("__lo").cast("double")) / width), F.lit(bins - 1)).alias("__bin"))
        counts = placed.groupBy(*by, "__p", "__rank", "__bin").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n"))
        # As many rows as bins in a group.
        below = F.sum("__n").over(Window.partitionBy(*by, "__p").orderBy("__bin")) - F.col("__n")
        chosen = counts.withColumn("__below", below).where((F.col("__below") < F.col("__rank")) & (F.col("__rank") <= F.col("__below") + F.col("__n")))
        opened = materialize(chosen.select(*by, "__p", (F.col("__rank") - F.col("__below")).alias("__rank"), "__lo", "__hi", "__n"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = materialize(found)
    few = held.alias("h").join(found.where("__lo <> __hi").alias("o"), [*same("h", "o"), F.col("__v").between(F.col("__lo"), F.col("__hi"))]).select(*[F.col(f"o.{c}").alias(c) for c in by], "__p", "__rank", "__v")
    nth = few.withColumn("__at", F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__v"))).where("__at = __rank").select(*by, "__p", "__v")
    values = nth.unionByName(found.where("__lo = __hi").select(*by, "__p", F.col("__lo").alias("__v")))
    wide = values.groupBy(*by).agg(*[F.max(F.when(F.col("__p") == p, F.col("__v"))).alias(p) for p in ("p50", "p95", "p99")])
    joined = ends.alias("e").join(wide.alias("w"), same("e", "w") or F.lit(True), "left")
    return joined.select(*[F.col(f"e.{c}").alias(c) for c in by], "least", "p50", "p95", "p99", "most", "n")


def confusion(judgements: DataFrame, by: list[str]) -> DataFrame:
    """(expected, predicted, status): an inconclusive judgement is wrong, and a miss where yes was expected."""
    done = F.col("status") == "ok"
    yes, said = F.col("expected"), F.col("predicted") & done
    counts = judgements.groupBy(*by).agg(
        F.count_if(yes & said).alias("tp"), F.count_if(yes & ~said).alias("fn"), F.count_if(~yes & ((F.col("predicted")) | ~done)).alias("fp"),
        F.count_if(~yes & ~F.col("predicted") & done).alias("tn"), F.count_if(done).alias("completed"), F.count(F.lit(1)).alias("n"),
    )
    share = lambda a, b, empty: F.when(b == 0, F.lit(empty)).otherwise(a / b)
    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), share(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)
    return counts.withColumns({
        "accuracy": share(F.col("tp") + F.col("tn"), F.col("n"), 0.0), "precision": precision, "recall": recall, "specificity": share(F.col("tn"), F.col("tn") + F.col("fp"), 0.0),
        "f1": share(2 * precision * recall, precision + recall, 0.0), "completion": share(F.col("completed"), F.col("n"), 0.0),
    }).drop("completed")


def run_stability(judgements: DataFrame) -> DataFrame:
    """Cases by whether all repetitions agree: arm, cases, unstable, stable_pct."""
    cases = judgements.groupBy("arm", "case_id").agg((F.count_distinct("predicted") > 1).alias("unstable"))
    return cases.groupBy("arm").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("unstable")).alias("unstable"), ((1 - F.count_if(F.col("unstable")) / F.count(F.lit(1))) * 100).alias("stable_pct"))


def promotion_gate(judgements: DataFrame, floors: dict[str, float], gains: dict[str, float]) -> DataFrame:
    """(arm baseline or candidate, repetition, case_id, expected, predicted, status) → gate, arm, measure, value, threshold, passed.

    ``absolute``: the worst repetition of each arm against ``floors``; ``gain``: the candidate's mean less the
    baseline's against ``gains``; all in percent points. ``stability`` has one value an arm. The candidate is
    promoted when every row passed.
    """
    measures = ["accuracy", "precision", "recall", "completion"]
    each = confusion(judgements, ["arm", "repetition"]).unpivot(["arm", "repetition"], measures, "measure", "share").withColumn("value", F.col("share") * 100)
    stable = run_stability(judgements).select("arm", F.lit(None).cast("int").alias("repetition"), F.lit("stability").alias("measure"), F.col("stable_pct").alias("value"))
    values = each.select("arm", F.col("repetition").cast("int").alias("repetition"), "measure", "value").unionByName(stable)
    limit = lambda limits: F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("measure")]
    worst = values.groupBy("arm", "measure").agg(F.min("value").alias("value")).select(F.lit("absolute").alias("gate"), "arm", "measure", "value", limit(floors).alias("threshold"))
    mean = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("value")))
    gain = values.groupBy("measure").agg((mean("candidate") - mean("baseline")).alias("value")).select(F.lit("gain").alias("gate"), F.lit("candidate").alias("arm"), "measure", "value", limit(gains).alias("threshold"))
    return worst.unionByName(gain).where("threshold is not null").withColumn("value", F.round("value", 4)).withColumn("passed", F.col("value") >= F.col("threshold"))


def table_fingerprint(rows: DataFrame) -> DataFrame:
    """A hash of all rows that does not depend on their order, and their number."""
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("n"))
