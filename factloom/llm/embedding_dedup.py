"""Near-duplicate vectors by random-hyperplane signs, exact cosines and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FURTHER, Scratch, partitions, runs
from .components import connected_components

#: Chance to miss a pair exactly at the threshold in all tables, and rows a block of a bucket.
MISS, BLOCK = 1e-4, 1000


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Sign bits a table and number of tables: bits grow with the logarithm of the rows, so that chance
    meetings stay in proportion to the rows, and tables follow from the recall."""
    bits = min(26, max(12, math.ceil(math.log2(max(2, rows))) + 1))
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    tables = 1 if agree >= 1 else math.ceil(math.log(MISS) / math.log1p(-agree))
    return bits, max(1, tables)


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([dim, bits, tables, 98]).standard_normal((dim, bits * tables))


def _code_batches(bits: int, tables: int, stored: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors = [np.frombuffer(x, stored).astype(float) for x in batch.column("vector").to_pylist()]
            codes: list = [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                rows = [i for i, v in enumerate(vectors) if len(v) == dim]
                if dim not in planes:
                    planes[dim] = _planes(dim, bits, tables)
                signs = np.stack([vectors[i] for i in rows]) @ planes[dim] >= 0
                for i, code in zip(rows, signs.reshape(len(rows), tables, bits) @ weights, strict=True):
                    codes[i] = code.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int32()))], names=[*batch.schema.names, "codes"])

    return run


def _block_links(rows: pd.DataFrame, threshold: float, stored: str) -> pd.DataFrame:
    """Links within one block, or between two, of a bucket: counts of neighbours, and a star for each
    local component. A pair counts in the first table where its codes meet."""
    vectors = np.stack([np.frombuffer(x, stored) for x in rows["vector"]]).astype(float)
    codes = np.stack(rows["codes"].to_list())
    reps, times = rows["rep"].to_numpy(), rows["times"].to_numpy()
    table, two = int(rows["table"].iloc[0]), rows["i"].iloc[0] != rows["j"].iloc[0]
    side = rows["own"].to_numpy() == rows["j"].iloc[0] if two else None
    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]  # no square overflows or vanishes
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    if two:
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = np.nonzero(vectors[left] @ vectors[right].T >= threshold)
        a, b = left[a], right[b]
    else:
        a, b = np.nonzero(np.triu(vectors @ vectors.T >= threshold, 1))
    label = np.arange(len(reps))
    order = np.argsort(reps, kind="stable")
    label[order] = np.arange(len(reps))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            break
        label = new
    fresh = ~(codes[a, :table] == codes[b, :table]).any(axis=1) if table else np.ones(len(a), bool)
    links = np.zeros(len(reps), np.int64)
    np.add.at(links, a[fresh], times[b[fresh]])
    np.add.at(links, b[fresh], times[a[fresh]])
    out = pd.DataFrame({"rep": reps, "links": links, "root": reps[order][label]})
    return out[(out["links"] > 0) | (out["root"] != out["rep"])]


def _grouped(threshold: float, stored: str):
    """``_block_links`` for each group; a group has at most two blocks of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(frames, ["label", "dim", "table", "code", "i", "j"]):
            found = _block_links(group, threshold, stored)
            if len(found):
                yield found

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at
    least ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, as do rows with a null vec_id; vectors of different length do not link. Equal vectors
    are compared once, with their number; a vec_id that has several vectors has a node for each, so these
    keep their own neighbours. Buckets of any size are cut into blocks, each pair of blocks
    is a task of its own, and of a block only counts and a spanning star come out. Repeated rows count
    as vectors of their own in n_links. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    double = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), double.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite, F.lit(False))
    # + 0.0 makes -0.0 and 0.0 one value; the bytes then stand for the vector.
    bits = F.when(usable, F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))).cast("binary"), 256))
    rows = rows.select("vec_id", "label", bits.alias("same"), F.when(usable, F.col("v")).alias("v"))
    classes = rows.where("same is not null").groupBy("label", "same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.any_value("v").alias("v"))
    # Floats are kept in their four bytes, which lose nothing; all arithmetic is in double precision.
    stored = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    scratch = Scratch(spark, "vectors")
    packed = scratch.store("packed", classes.mapInArrow(_pack(stored), "label long, same string, owner long, times long, dim int, vector binary"))
    # A vec_id with several vectors has a node for each: the first goes by the vec_id, others by numbers above all.
    own = F.struct("label", "same")
    several = scratch.store("several", packed.groupBy("owner").agg(F.min(own).alias("first"), F.max(own).alias("last")).where("first <> last").select("owner", "first"))
    further = F.lit(FURTHER) + F.xxhash64("label", "same").bitwiseAND(F.lit(FURTHER - 1))
    packed = packed.join(several, "owner", "left").withColumn("rep", F.when(F.col("first") != own, further).otherwise(F.col("owner"))).drop("first")
    size = packed.count()
    n_bits, tables = plan(size, threshold)
    coded = scratch.store("coded", packed.drop("same", "owner").select("label", "rep", "times", "dim", "vector").mapInArrow(_code_batches(n_bits, tables, stored), "label long, rep long, times long, dim int, vector binary, codes array<int>"))

    key = ["label", "dim", "table", "code"]
    meet = coded.select("label", "dim", "rep", F.posexplode("codes").alias("table", "code"))
    crowded = scratch.store("crowded", meet.groupBy(key).agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    placed = meet.join(crowded, key).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(*key, "rep", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = placed.join(coded.select("rep", "times", "vector", "codes"), "rep")
    group = [*key, "i", "j"]
    dealt = full.repartition(partitions(spark), *group).sortWithinPartitions(*group)
    found = scratch.store("found", dealt.select(*group, "own", "rep", "times", "vector", "codes").mapInPandas(_grouped(threshold, stored), "rep long, links long, root long"))
    scratch.drop("crowded", "coded")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b")))

    members = packed.where("times > 1 or rep <> owner").select("label", "same", "owner", "rep", "times")
    named = rows.select("vec_id", "label", "same").join(members, ["label", "same"], "left")
    vec_id = F.col("vec_id").cast("long")
    named = named.select("vec_id", F.coalesce("owner", vec_id).alias("owner"), F.coalesce("rep", vec_id).alias("rep"), F.coalesce("times", F.lit(1)).alias("times"), F.col("same").isNotNull().alias("usable"))
    named = named.join(links, "rep", "left").join(components.toDF("rep", "component"), "rep", "left").withColumn("least", F.coalesce("component", "rep"))
    # Where a component has a further vector, its smallest vec_id may be that vector's.
    mixed = named.where(F.col("rep") >= FURTHER).select("least").distinct()
    best = named.join(mixed, "least").groupBy("least").agg(F.min(F.struct("owner", "rep")).alias("best"))
    named = named.join(best, "least", "left")
    component = F.when(F.col("usable"), F.coalesce("best.owner", "least")).otherwise(vec_id)
    count = F.when(F.col("usable"), F.coalesce("links", F.lit(0)) + F.col("times") - 1).otherwise(F.lit(0)).cast("long")
    kept = ~F.col("usable") | ((F.col("rep") == F.coalesce("best.rep", "least")) & (vec_id == F.col("owner")))
    return named.select("vec_id", count.alias("n_links"), component.alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept"))


def _pack(stored: str):
    """Arrays of double to bytes, which tables then hold densely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.asarray(x, stored).tobytes() for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("same"), batch.column("rep").cast(pa.int64()), batch.column("times"), pa.array([len(x) // np.dtype(stored).itemsize for x in packed], pa.int32()), pa.array(packed, pa.binary())],
                names=["label", "same", "owner", "times", "dim", "vector"],
            )

    return run
