"""Reading and writing fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_DOCUMENTS = "doc_id string, filename string, source_kind string, content string, company string, period string, currency string, event_ref string, declared_type string"
MEMORIES = (
    "id string, tenant_id string, kind string, company string, company_key string, period string, source_ref string, content string, metadata string, "
    "embedding array<float>, embed_model string, idempotency_key string, importance double, superseded_at timestamp, superseded_by string, created_at timestamp"
)


def read_raw_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines by an explicit schema: (documents, malformed lines)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", f"{RAW_DOCUMENTS}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select("_corrupt_record")


def scan_active(memories: DataFrame, tenant_id: str, company_key: str | None = None, period: str | None = None, kinds: list[str] | None = None, embed_model: str | None = None) -> DataFrame:
    """Active rows in a scope; every condition reaches the Parquet scan and the tenant prunes partitions."""
    rows = memories.where((F.col("tenant_id") == tenant_id) & F.col("superseded_at").isNull())
    for column, value in (("company_key", company_key), ("period", period), ("embed_model", embed_model)):
        rows = rows.where(F.col(column) == value) if value is not None else rows
    return rows.where(F.col("kind").isin(kinds)) if kinds else rows


def write_snapshot(memories: DataFrame, path: str) -> None:
    """A new snapshot path, partitioned by tenant; a tenant's rows are spread by company."""
    memories.repartition("tenant_id", "company_key").write.partitionBy("tenant_id").parquet(path)


def vectors_from_text(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``[0.1,0.2]`` literals of a relational export to arrays."""
    return rows.withColumn(column, F.from_json(column, "array<float>"))


def vectors_to_text(rows: DataFrame, column: str = "embedding") -> DataFrame:
    return rows.withColumn(column, F.to_json(column))
