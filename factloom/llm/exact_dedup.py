"""Exact duplicates by an extendible-hash index that lies in shared Parquet files.

A hash directory starts with one bucket and doubles while a bucket holds more entries than it may.
Each bucket belongs to one owner task, and the directory alone says where a text goes. Before they
are sent, copies within an Arrow batch collapse to one text with all its doc_ids, so a text that
fills a third of the table crosses the network once per batch. Owner tasks chain the texts of equal
hash, compare their bytes, and set keep_id and group_size; the result is read from their index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_path, without

#: The directory never has more than 2 ** MAX_DEPTH pointers, whatever the size of the corpus.
MAX_DEPTH = 14
#: Buckets an owner task has at least (up to MAX_DEPTH), so that owners can be dealt evenly.
BUCKETS_PER_OWNER = 8
#: Index rows that an owner task writes at once.
WRITTEN = 10_000


@dataclass
class Directory:
    """Pointers of an extendible hash table: ``pointers[prefix]`` is ``(bucket, local depth)``."""

    depth: int
    pointers: list[tuple[int, int]]


def build_directory(histogram: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> Directory:
    """Split overfull buckets, doubling the directory when a bucket is as deep as it.

    ``histogram`` counts entries by their top ``max_depth`` hash bits. At ``max_depth`` a bucket may
    stay above its capacity; its entries then simply make a longer file.
    """
    sums = [0]
    for prefix in range(1 << max_depth):
        sums.append(sums[-1] + histogram.get(prefix, 0))
    depth, pointers, bucket_ids, todo = 0, [(0, 0)], 1, [(0, 0, 0)]
    while todo:
        bucket, prefix, local = todo.pop()
        low, high = prefix << (max_depth - local), (prefix + 1) << (max_depth - local)
        if sums[high] - sums[low] <= capacity or local == max_depth:
            continue
        if local == depth:
            pointers = [pointer for pointer in pointers for _ in (0, 1)]
            depth += 1
        other, bucket_ids = bucket_ids, bucket_ids + 1
        width = 1 << (depth - local)
        for at in range(prefix * width, (prefix + 1) * width):
            pointers[at] = (bucket if at < prefix * width + width // 2 else other, local + 1)
        todo += [(bucket, prefix * 2, local + 1), (other, prefix * 2 + 1, local + 1)]
    return Directory(depth, pointers)


def assign_owners(directory: Directory, histogram: dict[int, int], tasks: int, max_depth: int = MAX_DEPTH) -> dict[int, int]:
    """The owner task of each bucket: runs of neighbouring buckets with about as many entries each."""
    width, total = 1 << (max_depth - directory.depth), max(1, sum(histogram.values()))
    owners: dict[int, int] = {}
    before = 0
    for slot, (bucket, _) in enumerate(directory.pointers):
        owners.setdefault(bucket, min(tasks - 1, before * tasks // total))
        before += sum(histogram.get(prefix, 0) for prefix in range(slot * width, (slot + 1) * width))
    return owners


def _keyed(docs: DataFrame, hash_bits: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(text)
    if hash_bits < 64:
        key = F.shiftleft(F.shiftrightunsigned(key, 64 - hash_bits), 64 - hash_bits)
    return docs.select(F.col("doc_id").alias("doc_id"), text.cast("binary").alias("text"), key.alias("key"))


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of each batch: equal texts, by their bytes, become one with a list of their doc_ids."""
    for batch in batches:
        keys, texts = batch.column("key").to_numpy(), batch.column("text")
        _, group, often = np.unique(keys, return_inverse=True, return_counts=True)
        first = np.arange(len(keys))
        seen: dict[bytes, int] = {}
        for at in np.flatnonzero(often[group] > 1).tolist():
            first[at] = seen.setdefault(texts[at].as_py(), at)
        chosen, sizes = np.unique(first, return_counts=True)
        ids = batch.column("doc_id").take(pa.array(np.argsort(first, kind="stable")))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), ids)
        own = batch.take(pa.array(chosen))
        yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("owner", "bucket", "local_depth", "key", "text")), lists], names=["owner", "bucket", "local_depth", "key", "text", "doc_ids"])


@dataclass(slots=True)
class Link:
    """A text in the chain of its hash, and the documents that hold it."""

    bucket: int
    local_depth: int
    pieces: list[pa.Array] = field(default_factory=list)
    keep_id: object = None
    group_size: int = 0


def chain_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index of an owner task, whose entries are sorted by key: one row for each entry.

    A chain has the different texts of one hash, told apart by their bytes alone.
    """
    key: int | None = None
    chain: dict[bytes, Link] = {}
    rows: list[tuple] = []
    pieces: list[pa.Array] = []

    def end_chain() -> None:
        for place, text in enumerate(sorted(chain), 1):
            link, digest = chain[text], hashlib.sha256(text).hexdigest()
            for piece in link.pieces:
                rows.append((link.bucket, link.local_depth, key, place, len(chain), digest, link.keep_id, link.group_size))
                pieces.append(piece)
        chain.clear()

    def written() -> pa.RecordBatch:
        ids = pa.concat_arrays(pieces)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pieces])]), pa.int32()), ids)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), ids.type, pa.int64()]
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        rows.clear()
        pieces.clear()
        return pa.RecordBatch.from_arrays([*columns, lists], names=[*INDEX, "doc_ids"])

    for batch in batches:
        bucket, depth, keys = (batch.column(c).to_pylist() for c in ("bucket", "local_depth", "key"))
        texts, lists = batch.column("text"), batch.column("doc_ids")
        for at in range(batch.num_rows):
            if keys[at] != key:
                end_chain()
                key = keys[at]
                if len(rows) >= WRITTEN:
                    yield written()
            link = chain.setdefault(texts[at].as_py(), Link(bucket[at], depth[at]))
            piece = lists[at].values
            link.pieces.append(piece)
            link.group_size += len(piece)
            link.keep_id = max((x for x in (link.keep_id, *piece.to_pylist()) if x is not None), default=None)
    end_chain()
    if rows:
        yield written()


INDEX = ("bucket", "local_depth", "key", "chain", "chain_length", "text_sha256", "keep_id", "group_size")


def build_index(docs: DataFrame, capacity: int = 100_000, hash_bits: int = 64) -> DataFrame:
    """Write the index to the shared folder and read it.

    Columns: bucket, local_depth, key, chain (place among different texts of one hash), chain_length,
    text_sha256, keep_id, group_size, doc_ids. A text that many batches hold has a row for each, and
    these share all but doc_ids. ``hash_bits`` below 64 forces collisions, for tests.
    """
    spark = docs.sparkSession
    tasks, keyed = partitions(spark), _keyed(docs, hash_bits)
    prefix = F.shiftrightunsigned("key", 64 - MAX_DEPTH)
    # At most 2 ** MAX_DEPTH counts reach the driver.
    histogram = {row[0]: row[1] for row in keyed.select("key").distinct().groupBy(prefix.alias("prefix")).count().collect()}
    share = max(1, sum(histogram.values()) // (BUCKETS_PER_OWNER * tasks))
    directory = build_directory(histogram, min(capacity, share))
    owners = assign_owners(directory, histogram, tasks)
    pointers = spark.createDataFrame([(at, bucket, depth, owners[bucket]) for at, (bucket, depth) in enumerate(directory.pointers)], "slot long, bucket int, local_depth int, owner int")
    slot = F.shiftrightunsigned("key", 64 - directory.depth) if directory.depth else F.lit(0)
    # The directory has at most 2 ** MAX_DEPTH rows, so it may be sent to every task.
    placed = keyed.withColumn("slot", slot.cast("long")).join(F.broadcast(pointers), "slot").drop("slot")
    kind = dict(docs.dtypes)["doc_id"]
    entries = placed.mapInArrow(collapse, f"owner int, bucket int, local_depth int, key long, text binary, doc_ids array<{kind}>")
    owned = entries.repartitionById(tasks, "owner").sortWithinPartitions("key")
    path = shared_path(spark, "exact-index")
    owned.mapInArrow(chain_entries, f"bucket int, local_depth int, key long, chain int, chain_length int, text_sha256 string, keep_id {kind}, group_size long, doc_ids array<{kind}>").write.parquet(path)
    return spark.read.parquet(path)


def exact_duplicates(docs: DataFrame, capacity: int = 100_000, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, so they are copies of empty texts and of each other. The largest
    doc_id of a group stays; rows that repeat it are one document and are all marked as kept. Where
    every doc_id of a group is null, keep_id is null and the rows are kept. Other columns are not
    read. An empty table gives no rows.
    """
    index = build_index(docs, capacity, hash_bits).select("keep_id", "group_size", "text_sha256", "doc_ids")
    # Index rows are dealt anew, so that the documents of a large group are spread by many tasks.
    found = index.repartition(partitions(docs.sparkSession)).select(F.explode("doc_ids").alias("doc_id"), "keep_id", "group_size", "text_sha256")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without the rows that ``exact_duplicates`` drops; columns unchanged.

    A row is dropped by its doc_id, null or not, and its text, so that another text of that doc_id stays.
    """
    dropped = exact_duplicates(docs).where(~F.col("kept")).select("doc_id", "text_sha256")
    return without(docs, dropped, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
