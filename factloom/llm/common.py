"""Small helpers that the corpus operators share: the shared folder, checkpoints, table reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session (a test) without ``spark.checkpoint.dir`` gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch that carries whole texts.
TEXT_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``TEXT_ROWS`` rows: at Spark's 10,000 a batch of whole texts takes tens of
    megabytes, several times over, in the executor and in its Python worker. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def give_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after whose last batch what it has freed goes back to the system.

    Spark keeps a Python worker for later stages, and the allocators keep freed memory; in the executor it then counts
    beside what the later stage needs itself.
    """

    def returning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()

    return returning


class Scratch:
    """Tables that an operator writes to the shared folder between its steps.

    They cut lineage as checkpoints do, but are compressed, are read by column and go with ``drop`` once
    a later table is written. What the operator's result still reads is left to whoever clears the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_path(spark, name)
        self.paths: dict[str, str] = {}

    def store(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table under a name of its own and read it back."""
        path = self.paths[name] = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Node of a further text or vector of an id: above every id, so that a component is named by an id where it has one.
FURTHER = 1 << 62
#: Bits of a membership bitmap for each key, and the most that one has (8 MB), however many keys there are.
BITS_PER_KEY, MOST_BITS = 16, 1 << 26


def maybe_marked(df: DataFrame, value: Column, keys: DataFrame) -> DataFrame:
    """``df`` with __maybe: false only where ``value`` is surely not in the one column of ``keys``.

    A bitmap of key hashes is built by partial aggregates and sent to every task: at most ``MOST_BITS``
    bits. Beyond that many keys it lets more and more other rows pass, so an exact join must follow where
    it matters; before a shuffle or a costly function it spares most rows the way.
    """
    bits, wanted = 1 << 16, min(MOST_BITS, BITS_PER_KEY * keys.count())
    while bits < wanted:
        bits *= 2
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(bits)) + 1
    packed = keys.select(place(F.col(keys.columns[0])).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    at = df.withColumn("__at", place(value)).withColumn("__bucket", F.bitmap_bucket_number("__at"))
    spot = F.bitmap_bit_position("__at")
    byte = F.ascii(F.decode(F.substring("__bits", (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    there = F.getbit(byte.cast("long"), F.pmod(spot, F.lit(8)).cast("int")) == 1
    marked = at.join(F.broadcast(packed), "__bucket", "left").withColumn("__maybe", F.coalesce(there, F.lit(False)))
    return marked.select(*df.columns, "__maybe")


def maybe_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` that ``maybe_marked`` marks for a column of both tables."""
    return maybe_marked(df, F.col(column), keys.select(column)).where("__maybe").drop("__maybe")


def without(docs: DataFrame, dropped: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are not among ``dropped``; columns unchanged.

    ``dropped`` has a doc_id and the text's digest, which ``digest`` computes of ``docs``. Null doc_ids
    match each other. Rows that a bitmap of the dropped doc_ids clears are not shuffled; only the others
    meet ``dropped`` in an exact join. ``docs`` is read twice.
    """
    gone = dropped.toDF("__id", "__digest").groupBy("__id", "__digest").agg(F.lit(1).alias("one")).drop("one")
    gone = Scratch(docs.sparkSession, "dropped").store("rows", gone)
    doc_id = F.col("doc_id").cast(gone.schema["__id"].dataType)
    marked = maybe_marked(docs, doc_id, gone.select("__id"))
    suspects = marked.where("__maybe").join(gone, doc_id.eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), "left_anti")
    return marked.where("not __maybe").unionByName(suspects).select(docs.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups, of more than one row, of frames that are sorted by integer keys."""
    held: pd.DataFrame | None = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        values = frame[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist()]
        yield from (frame.iloc[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi - lo > 1)
        held = frame.iloc[cuts[-1] :]
    if held is not None and len(held) > 1:
        yield held
