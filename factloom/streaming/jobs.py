"""Streaming jobs over appended facts and usage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.scalars import request_hash
from ..operators import audit, lifecycle


def ingest_dedup(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """One row per (tenant_id, idempotency_key) within the watermark of created_at."""
    return stream.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["tenant_id", "idempotency_key"])


def ingest_conflicts(stream: DataFrame, payload: list[str]) -> DataStreamWriter:
    """(tenant_id, idempotency_key, n) of keys that come with different payloads; again whenever n rises.

    The state is two hashes and a count for each key ever seen; keep it in RocksDB. Null keys never collide.
    """
    marked = stream.where("idempotency_key is not null").withColumn("mark", request_hash(*payload))
    seen = marked.groupBy("tenant_id", "idempotency_key").agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("low"), F.max("mark").alias("high"))
    return seen.where("low <> high").drop("low", "high").writeStream.outputMode("update")


def daily_usage(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Units per UTC day, bucket and subject; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("day"), "bucket", "subject").agg(F.sum("units").alias("units"))


def contradiction_alerts(stream: DataFrame) -> DataStreamWriter:
    """Alerts on values that come to contradict each other; a key's alert comes again when it changes.

    The state is one row of extremes for each subject and attribute ever seen; keep it in RocksDB.
    """
    return audit.contradiction_alerts(stream).writeStream.outputMode("update")


def retention(stream: DataFrame, root: str, now, **policy) -> DataStreamWriter:
    """Add each batch to the last snapshot under ``root``, without what ``plan_forget`` names by ``policy``.

    Batch n writes ``root/n`` from ``root/n-1``; a batch that runs again writes the same rows to the same place.
    """

    def step(batch: DataFrame, n: int) -> None:
        rows = batch if n == 0 else batch.sparkSession.read.parquet(f"{root}/{n - 1}").unionByName(batch)
        lifecycle.apply_forget(rows, lifecycle.plan_forget(rows, now, **policy)).write.mode("overwrite").parquet(f"{root}/{n}")

    return stream.writeStream.foreachBatch(step)


def retention_by_parts(stream: DataFrame, root: str, now, **policy) -> DataStreamWriter:
    """Append each batch as a part of its own, and what ``plan_forget`` names by ``policy`` as a list of ids.

    Batch n writes ``facts/batch=n`` and ``forgotten/batch=n`` under ``root`` and rewrites nothing, so what a batch
    writes does not grow with the table; a batch that runs again replaces its own parts. ``read_retained`` reads
    the facts without the lists.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/facts/batch={n}")
        held = read_retained(spark, root, before=n)
        lifecycle.plan_forget(held, now, **policy).write.mode("overwrite").parquet(f"{root}/forgotten/batch={n}")

    return stream.writeStream.foreachBatch(step)


def read_retained(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The facts under ``root`` that no list names; of lists only those of batches ``before`` one, if given."""
    facts = spark.read.parquet(f"{root}/facts")
    if before == 0:
        return facts.drop("batch")
    lists = spark.read.parquet(f"{root}/forgotten")
    lists = lists if before is None else lists.where(F.col("batch") < before)
    return facts.join(lists.select("id"), "id", "left_anti").drop("batch")
