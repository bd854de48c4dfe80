"""Daily quotas: which charges of a key are admitted, in order, while the admitted sum stays within the limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import materialize

#: Charges of a key that one task folds; keys with more are cut into blocks of time.
BLOCK = 200_000
#: Days that daily usage is kept.
RETENTION_DAYS = 30
KEY = ["day", "bucket", "subject"]


def whole(value: Column) -> Column:
    """Units and limits as the quota takes them: whole numbers from 1 to 1,000,000; 1 for what is no number."""
    number = value.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(usable, F.least(F.greatest(F.floor(F.least(number, F.lit(1e6))), F.lit(1)), F.lit(1_000_000))).otherwise(F.lit(1)).cast("long")


def _prepared(charges: DataFrame) -> DataFrame:
    day = F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd")
    rows = charges.where("ts is not null").select(
        "ts", F.col("id").cast("string").alias("id"), day.alias("day"), F.coalesce(F.col("bucket").cast("string"), F.lit("")).alias("bucket"),
        F.coalesce(F.col("subject").cast("string"), F.lit("")).alias("subject"), whole(F.col("units")).alias("units"), whole(F.col("limit")).alias("limit"))
    return rows.select(F.xxhash64(*KEY).alias("__key"), "*")


def _fold(units: np.ndarray, limits: np.ndarray, carry: int) -> tuple[np.ndarray, np.ndarray]:
    """(admitted, sum admitted so far) of charges in order, after ``carry`` units."""
    running = carry + np.cumsum(units)
    over = np.flatnonzero(running > limits)
    if not len(over):
        return np.ones(len(units), bool), running
    admitted, used = np.zeros(len(units), bool), np.empty(len(units), np.int64)
    at = int(over[0])
    admitted[:at], used[:at] = True, running[:at]
    held = int(running[at - 1]) if at else carry
    # Once no charge left is small enough for its limit, the rest is refused at once.
    room = np.maximum.accumulate((limits - units)[::-1])[::-1]
    for i in range(at, len(units)):
        if held > room[i]:
            used[i:] = held
            break
        if held + int(units[i]) <= int(limits[i]):
            held += int(units[i])
            admitted[i] = True
        used[i] = held
    return admitted, used


def _walk(names: list[str], carry_name: str | None, last_only: bool):
    """Fold sorted frames group by group; a group may span frames, of which only its carry is kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, carry, pending = None, 0, None
        for frame in frames:
            if not len(frame):
                continue
            keys = frame[names].to_numpy(dtype=object)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
            admitted, used = np.empty(len(frame), bool), np.empty(len(frame), np.int64)
            units, limits = frame["units"].to_numpy(np.int64), frame["limit"].to_numpy(np.int64)
            ends = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[lo])
                if key != open_key:
                    if pending is not None:
                        ends.append(pending)
                    open_key, carry = key, int(frame[carry_name].iloc[lo]) if carry_name else 0
                admitted[lo:hi], used[lo:hi] = _fold(units[lo:hi], limits[lo:hi], carry)
                carry = int(used[hi - 1])
                pending = (*key, carry)
            if last_only:
                yield pd.DataFrame(ends, columns=[*names, "carry"])
            else:
                yield frame[["ts", "id", *KEY, "units", "limit"]].assign(admitted=admitted, used=used)
        if last_only and pending is not None:
            yield pd.DataFrame([pending], columns=[*names, "carry"])

    return run


_OUT = "ts timestamp, id string, day string, bucket string, subject string, units long, limit long, admitted boolean, used long"


def _admit_whole(rows: DataFrame, parts: int) -> DataFrame:
    """Keys that one task folds: streamed in order, so only a frame is held."""
    dealt = rows.repartition(parts, "__key").sortWithinPartitions("__key", *KEY, "ts", "id")
    return dealt.mapInPandas(_walk(["__key", *KEY], None, False), _OUT)


def _carries(blocks: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """(key, part, carry): the units admitted before each block of a hot key.

    Along a key the blocks' sums decide: if all charges of a block fit, its sum is added; if none can, nothing
    is; only a block at the edge is folded, one of each key at a time, and the chain goes on behind it.
    """
    key = ["__key", *KEY]
    chains = materialize(blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part", "sum", "least_limit", "room"))).alias("blocks")))
    state = chains.select(*key, "blocks", F.lit(0).alias("at"), F.lit(0).cast("long").alias("carry"))
    found: list[DataFrame] = []
    while True:
        start = F.struct(F.col("carry").alias("carry"), F.col("at").alias("at"), F.lit(False).alias("stop"), F.array().cast("array<struct<part:int,carry:bigint>>").alias("known"))
        fits = lambda a, b: a["carry"] + b["sum"] <= b["least_limit"]
        full = lambda a, b: a["carry"] > b["room"]

        def step(a, b):
            mixed = ~fits(a, b) & ~full(a, b)
            # A mixed block is the last that is known; its carry is what it starts with.
            return F.when(a["stop"], a).otherwise(F.struct(
                F.when(fits(a, b), a["carry"] + b["sum"]).otherwise(a["carry"]).alias("carry"), (a["at"] + 1).alias("at"), mixed.alias("stop"),
                F.concat(a["known"], F.array(F.struct(b["part"].alias("part"), a["carry"].alias("carry")))).alias("known")))

        rest = F.slice("blocks", F.col("at") + 1, F.greatest(F.size("blocks") - F.col("at"), F.lit(1)))
        walked = materialize(state.where("at < size(blocks)").withColumn("w", F.aggregate(rest, start, step)).select(*key, "blocks", "w.*"))
        if walked.isEmpty():
            break
        found.append(walked.select(*key, F.explode("known").alias("k")).select(*key, "k.part", "k.carry"))
        edge = walked.where("stop").select("__key", *KEY, F.element_at("known", -1)["part"].alias("part"), F.col("carry").alias("start"))
        held = rows.join(edge, [*key, "part"]).repartition(parts, "__key").sortWithinPartitions("__key", *KEY, "ts", "id")
        after = held.mapInPandas(_walk(["__key", *KEY], "start", True), "__key long, day string, bucket string, subject string, carry long")
        state = materialize(walked.where("stop").drop("carry", "stop", "known").join(after, key).select(*key, "blocks", "at", "carry"))
    out = found[0] if found else blocks.select(*key, "part", F.lit(0).cast("long").alias("carry"))
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def admit(charges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ts, id, bucket, subject, units, limit) → the charges with day (UTC session time), admitted and used.

    Charges of a day, bucket and subject come in order of time and id. One is admitted if what was
    admitted before and its own units stay within its own limit; a refused charge counts nothing, so a smaller one
    after it may still be admitted. ``used`` is the sum admitted so far.

    Units and limits are whole numbers from 1 to 1,000,000 (``whole``); null buckets and subjects are empty
    strings; charges without a time belong to no day and are left out. Equal times and ids are in no stated order.

    Keys of up to ``block`` charges are each folded in one task. A key with more is cut into ranges of time:
    blocks' sums settle all but those at the edge of the limit, and then every block is folded by itself.
    """
    spark = charges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _prepared(charges)
    sizes = materialize(rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))
    hot_rows = sizes.agg(F.sum("n")).first()[0]
    if not hot_rows:
        return _admit_whole(rows, parts)
    order = ["__key", *KEY, "ts", "id"]
    hot = rows.join(sizes.select("__key"), "__key", "left_semi").repartitionByRange(max(1, -(-hot_rows // block)), *order).withColumn("part", F.spark_partition_id())
    hot = materialize(hot)
    key = ["__key", *KEY]
    blocks = hot.groupBy(*key, "part").agg(F.sum("units").alias("sum"), F.min("limit").alias("least_limit"), F.max(F.col("limit") - F.col("units")).alias("room"))
    carried = hot.join(_carries(blocks, hot, parts), [*key, "part"])
    dealt = carried.repartition(parts, "__key", "part").sortWithinPartitions("__key", *KEY, "part", "ts", "id")
    cold = rows.join(sizes.select("__key"), "__key", "left_anti")
    return _admit_whole(cold, parts).unionByName(dealt.mapInPandas(_walk([*key, "part"], "carry", False), _OUT))


def daily_admitted(charges: DataFrame, block: int = BLOCK) -> DataFrame:
    """day, bucket, subject → units admitted, charges admitted and refused, and what is left of the last limit."""
    last = F.max_by(F.struct("limit", "used"), F.struct("ts", "id"))
    found = admit(charges, block).groupBy(*KEY).agg(F.sum(F.when(F.col("admitted"), F.col("units")).otherwise(0)).alias("units"), F.count_if("admitted").alias("n_admitted"), F.count_if(~F.col("admitted")).alias("n_refused"), last.alias("last"))
    return found.select(*KEY, "units", "n_admitted", "n_refused", F.greatest(F.lit(0), F.col("last.limit") - F.col("units")).alias("remaining"))


def retained(usage: DataFrame, today: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Usage of the last ``days`` days before ``today`` (yyyy-MM-dd) and of today; the filter reaches the scan."""
    return usage.where(F.col("day") >= F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd"))
