"""Importance resampling towards a target text: n-grams hashed by CRC-32, gains by bucket, Gumbel keys, exact ranks.

A CRC-32 is linear: that of a span is the XOR of what each byte adds at its distance from the span's end,
and of a constant for the span's length. So all spans of a buffer are hashed at once by one gather from a
position table and one ``bitwise_xor.reduceat``; spans longer than the table fold from blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions

#: Hash buckets, longest run of words, percent drawn, least words of a drawn document, seed of the keys.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Distances that the position table covers; longer spans are cut into blocks of so many bytes.
SPAN = 64
#: Bytes of text, and bytes of spans, that are hashed at once.
PIECE, GATHER = 1 << 20, 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_OTHER = bytes(np.flatnonzero(~_WORD).tolist())
_BREAK = re.compile(b"[" + re.escape(_OTHER) + b"]")


def _one_byte() -> np.ndarray:
    """What a byte leaves in the register: the usual table of the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table.astype(np.uint32)


_STEP = _one_byte()


def _position_table() -> np.ndarray:
    """``table[d * 256 + byte]``: what a byte adds to the CRC of a span that goes on for d more bytes."""
    rows = [_STEP]
    for _ in range(SPAN - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ _STEP[rows[-1] & np.uint32(0xFF)])
    return np.concatenate(rows)


_PLACES = _position_table()
_CONSTANTS = np.array([zlib.crc32(bytes(n)) for n in range(4 * SPAN)], np.uint32)


def _advance(operator: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Registers after the zero bytes that ``operator`` stands for (four tables, one a register byte)."""
    return operator[0][values & np.uint32(0xFF)] ^ operator[1][(values >> np.uint32(8)) & np.uint32(0xFF)] ^ operator[2][(values >> np.uint32(16)) & np.uint32(0xFF)] ^ operator[3][values >> np.uint32(24)]


def _doubled(operator: np.ndarray) -> np.ndarray:
    return np.stack([_advance(operator, row) for row in operator])


def _block_operator() -> np.ndarray:
    """The operator of ``SPAN`` zero bytes, by doubling that of one."""
    bytes_ = np.arange(256, dtype=np.uint32)
    operator = np.stack([_STEP, *[bytes_ << np.uint32(8 * (i - 1)) for i in (1, 2, 3)]])
    for _ in range(SPAN.bit_length() - 1):
        operator = _doubled(operator)
    return operator


_BLOCK = _block_operator()


def _short(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of the bytes' contributions for spans of 1 to ``SPAN`` bytes."""
    out = np.zeros(len(starts), np.uint32)
    ends = np.cumsum(lengths)
    cuts = [0, *np.searchsorted(ends, np.arange(GATHER, int(ends[-1]) if len(ends) else 0, GATHER)).tolist(), len(starts)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo == hi:
            continue
        size, start = lengths[lo:hi].astype(np.int32), starts[lo:hi].astype(np.int64)
        first = np.cumsum(size, dtype=np.int32) - size
        within = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first, size)
        places = np.repeat(size - 1, size) - within
        spots = np.repeat(start, size) + within
        out[lo:hi] = np.bitwise_xor.reduceat(_PLACES[(places << 8) | data[spots]], first)
    return out


def _long(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same for longer spans: values of their blocks, paired from the end in rounds.

    Blocks end at multiples of ``SPAN`` before the span's end; zero bytes before a span add nothing, so a
    missing first half of a pair is none.
    """
    counts = -(-lengths // SPAN)
    owner = np.repeat(np.arange(len(starts)), counts)
    place = np.repeat(np.cumsum(counts), counts) - 1 - np.arange(int(counts.sum()))  # from the end
    ends = np.repeat(starts + lengths, counts) - place * SPAN
    begins = np.maximum(ends - SPAN, starts[owner])
    values = _short(data, begins, ends - begins)
    operator = _BLOCK
    while len(values) > len(starts):
        values = np.where(place & 1, _advance(operator, values), values)
        place >>= 1
        heads = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1]))))
        values, owner, place = np.bitwise_xor.reduceat(values, heads), owner[heads], place[heads]
        operator = _doubled(operator)
    return values


def span_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of a byte buffer."""
    out = np.zeros(len(starts), np.uint32)
    short = (lengths > 0) & (lengths <= SPAN)
    out[short] = _short(data, starts[short], lengths[short])
    rest = np.flatnonzero(lengths > SPAN)
    if len(rest):
        out[rest] = _long(data, starts[rest], lengths[rest])
    known = lengths < len(_CONSTANTS)
    out[known] ^= _CONSTANTS[lengths[known]]
    for n in np.unique(lengths[~known]).tolist():
        out[lengths == n] ^= np.uint32(zlib.crc32(bytes(n)))
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, bytes, bool]]:
    """(row, bytes, carried): texts, long ones cut between words.

    A carried piece begins with the last word of what came before, for the sake of the run that crosses the cut.
    """
    for row, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        last, at = b"", 0
        while at < len(data) or not at:
            cut = _BREAK.search(data, at + PIECE) if len(data) - at > PIECE else None
            end = cut.end() if cut else len(data)
            piece = data[at:end]
            yield row, (last + b" " + piece if last else piece), bool(last)
            if not cut:
                break
            back = piece.rstrip(_OTHER)[::-1]
            stop = _BREAK.search(back)
            last, at = (back[: stop.start() if stop else None][::-1] or last), end


def _held(texts: list[str | None]) -> Iterator[list[tuple[int, bytes, bool]]]:
    run, size = [], 0
    for piece in _pieces(texts):
        run.append(piece)
        size += len(piece[1]) + 1
        if size >= PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run


def _features(pieces: list[tuple[int, bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, CRCs) of all words and pairs of consecutive words of the pieces."""
    data = np.frombuffer(b"\0".join([piece for _, piece, _ in pieces]) + b"\0", np.uint8)
    bounds = np.cumsum([len(piece) + 1 for _, piece, _ in pieces])
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    began, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(began):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    kept = inside.copy()
    kept[edge[1::2]] = True  # one byte after each word becomes the space
    packed = np.where(inside[kept], _LOWER[data[kept]], np.uint8(0x20))
    starts = np.cumsum(lengths + 1) - lengths - 1
    item = np.searchsorted(bounds, began, side="right")
    rows = np.array([row for row, _, _ in pieces])[item]
    first = np.diff(item, prepend=-1) > 0
    single = ~(first & np.array([carried for _, _, carried in pieces])[item])
    pair = np.flatnonzero(~first[1:])
    crcs = span_crcs(packed, np.concatenate((starts[single], starts[pair])), np.concatenate((lengths[single], lengths[pair] + 1 + lengths[pair + 1])))
    return np.concatenate((rows[single], rows[pair])), crcs


def _count_batches(buckets: int):
    """One row a task for each bucket that it met: partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for pieces in _held(batch.column(0).to_pylist()):
                counts += np.bincount(_features(pieces)[1] % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often features of all texts fall into each bucket; ``buckets`` numbers reach the driver."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_batches(buckets), "bucket int, n long")
    counts = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed bucket shares, target over corpus."""
    n = len(corpus)
    ratio = (target.astype(float) + 1) * (float(corpus.sum()) + n) / ((corpus.astype(float) + 1) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigh_batches(by_bucket: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for pieces in _held(batch.column(0).to_pylist()):
                rows, crcs = _features(pieces)
                own = by_bucket[crcs % np.uint32(len(by_bucket))]
                number += np.bincount(rows, minlength=batch.num_rows)
                # Sums of whole numbers far below 2 ** 53 are exact in doubles.
                total += np.bincount(rows, own, minlength=batch.num_rows).astype(np.int64)
            weight = total // np.maximum(number, 1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(number, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_features", "weight"])

    return run


def _key(seed: int) -> Column:
    """A standard Gumbel number from the document's id, in floored thousandths."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((head + 0.5) / F.lit(4294967296.0))))


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank.

    Features are the words of a text and its pairs of consecutive words, repeats counted; the weight is the
    floored mean gain of their buckets. Of the documents with at least ``least_words`` words the given percent with the
    highest scores get a rank, ties by doc_id (nulls last); all others have a null rank. That is a draw
    without replacement in proportion to exp(weight / 1000), as scores carry Gumbel noise.

    Null and empty texts have no features and weight 0; a null doc_id hashes as an empty string. Repeated rows get one
    row and, if drawn, one rank each. Empty tables give no rows; an empty target gives weights all the
    same. Only doc_id and text are read. Texts are read twice: for the counts of all documents and for
    the weights; what lies between is ``buckets`` numbers. Ranks come from a range partitioning and the
    sizes of its parts, so no task sorts all rows.
    """
    spark = docs.sparkSession
    by_bucket = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    kind = dict(docs.dtypes)["doc_id"]
    weighed = docs.select(F.col("text").cast("string").alias("text"), "doc_id").mapInArrow(_weigh_batches(by_bucket), f"doc_id {kind}, n_features long, weight long")
    scratch = Scratch(spark, "importance")
    # Repeated rows tie in all their columns, so __tie only keeps them from one range.
    scored = scratch.store("scored", weighed.withColumn("score", F.col("weight") + _key(seed)).withColumn("__tie", F.xxhash64(F.monotonically_increasing_id())))
    enough = F.col("n_features") >= 2 * least_words - 1
    drawn = scored.where(enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("__tie")]
    dealt = scored.where(enough).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = scratch.store("placed", dealt.select("doc_id", "n_features", "weight", "score", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__place")))
    sizes = dict(placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())  # a number for each partition
    before, rows = 1, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    offsets = spark.createDataFrame(rows, "__part int, __before long")
    rank = F.col("__before") + F.col("__place")
    ranked = placed.join(F.broadcast(offsets), "__part").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(scored.where(~enough).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
