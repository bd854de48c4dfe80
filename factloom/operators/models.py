"""Where a caller's own models plug in. Each is a function over a batch of values, run inside Spark's tasks.

Without a model the built-in stand-in does the work: hashed vectors, polarity, the template, the text as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StringType, StructField, StructType

from ..functions.scalars import snippet
from .ingest import parse_verdicts
from .meaning import hash_embed, opposed, polarity


def batched(rows: DataFrame, inputs: list[str], model: Callable[..., list], output: str, kind: DataType) -> DataFrame:
    """``rows`` with a column that the model gives for the lists of the input columns, one Arrow batch a call.

    The column holds texts or arrays of doubles, as ``kind`` says.
    """
    names = [*rows.columns, output]
    arrow = pa.list_(pa.float64()) if isinstance(kind, ArrayType) else pa.string()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model(*[batch.column(c).to_pylist() for c in inputs])
            if len(found) != batch.num_rows:
                raise ValueError(f"{output}: {len(found)} results for {batch.num_rows} rows")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=names)

    return rows.mapInArrow(step, StructType([*rows.schema.fields, StructField(output, kind)]))


def embed(docs: DataFrame, embedder: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """(id, text) → id, embedding. An embedder gets a batch of texts, nulls as empty ones."""
    if embedder is None:
        return hash_embed(docs)
    texts = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    return batched(texts, ["text"], embedder, "embedding", ArrayType(DoubleType())).select("id", "embedding")


def judge(pairs: DataFrame, model: Callable[[list[str], list[str]], list[str]] | None = None) -> DataFrame:
    """(a, b, content_a, content_b) → a, b, contradict, confidence, reason, status.

    A model gives one raw JSON answer for each pair; an answer that does not parse is inconclusive.
    """
    if model is None:
        found = opposed(polarity(F.col("content_a")), polarity(F.col("content_b")))
        return pairs.select("a", "b", found.isNotNull().alias("contradict"), F.lit(1.0).alias("confidence"), F.lit("polarity").alias("reason"), F.lit("ok").alias("status"))
    raw = batched(pairs, ["content_a", "content_b"], model, "raw", StringType())
    return parse_verdicts(raw).select("a", "b", "contradict", "confidence", "reason", "status")


def narrate(recalled: DataFrame, narrator: Callable[[list[str], list[list[str]]], list[str]] | None = None) -> DataFrame:
    """(query_id, question, citations: texts in the order of their numbers) → query_id, answer."""
    if narrator is None:
        numbered = F.transform("citations", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), snippet(F.coalesce(x, F.lit("")))))
        return recalled.select("query_id", F.array_join(numbered, "\n").alias("answer"))
    return batched(recalled, ["question", "citations"], narrator, "answer", StringType()).select("query_id", "answer")


def extract(docs: DataFrame, client: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """(doc_id, content, …) with extracted: the JSON that the client reads from the content, or the content itself."""
    if client is None:
        return docs.withColumn("extracted", F.col("content"))
    return batched(docs, ["content"], client, "extracted", StringType())
