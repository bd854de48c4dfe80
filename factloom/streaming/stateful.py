"""Streaming jobs that keep a little state for each key and end it: appends with replays, contradiction alerts.

They need the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import request_hash
from ..operators.audit import SCOPE, TOLERANCE, attributes

INGESTED = "tenant_id string, idempotency_key string, id string, state string, stored_id string"
ALERT = "company_key string, period string, subject string, attr string, first_id string, first_value string, id string, value string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Ingest(StatefulProcessor):
    """First id and payload hash of a key, until no row has come for ``keep_ms`` of event time."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "id string, mark string, ends long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tenant, name, _ = key
        held = self.first.get() if name is not None and self.first.exists() else None
        before = held
        for frame in rows:
            if not len(frame):
                continue
            frame = frame.sort_values(["at", "id"], kind="stable")
            out = []
            for row_id, mark, at in zip(frame["id"], frame["mark"], frame["at"], strict=True):
                if name is None:  # null keys never collide and leave no state
                    out.append((tenant, None, row_id, "insert", None))
                elif held is None:
                    held = (row_id, mark, int(at) + self.keep_ms)
                    out.append((tenant, name, row_id, "insert", row_id))
                else:
                    held = (held[0], held[1], max(held[2], int(at) + self.keep_ms))
                    out.append((tenant, name, row_id, "replay" if mark == held[1] else "conflict", held[0]))
            yield pd.DataFrame(out, columns=["tenant_id", "idempotency_key", "id", "state", "stored_id"])
        if held is not None and held != before:
            if before is not None:
                self.handle.deleteTimer(before[2])
            self.first.update(held)
            self.handle.registerTimer(held[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.first.clear()
        yield pd.DataFrame([], columns=["tenant_id", "idempotency_key", "id", "state", "stored_id"])

    def close(self) -> None:
        pass


def ingest(stream: DataFrame, payload: list[str], keep_days: float = 30, watermark: str = "1 hour") -> DataFrame:
    """Each appended row (tenant_id, idempotency_key, id, created_at, payload…) as insert, replay or conflict.

    The first row of a key to arrive is inserted; a later one with the same payload is a replay, with another a
    conflict, and both name the stored id. Within a micro-batch rows come in the order of the shuffle, sorted
    by time and id in each Arrow batch. Null keys are always inserted.

    A key's state is one id, one hash and one time. It ends when the watermark passes ``keep_days`` after the key's
    latest row; a row of that key after that is an insert again. Rows later than the watermark are dropped.
    """
    marked = stream.withWatermark("created_at", watermark).select(
        "tenant_id", "idempotency_key", F.when(F.col("idempotency_key").isNull(), F.col("id")).alias("own"), "id", request_hash(*payload).alias("mark"), "created_at", F.unix_millis(F.col("created_at").cast("timestamp")).alias("at"))
    return marked.groupBy("tenant_id", "idempotency_key", "own").transformWithStateInPandas(_Ingest(int(keep_days * 86_400_000)), INGESTED, "Append", "EventTime")


class _Alerts(StatefulProcessor):
    """The first values of a key's first two buckets, until no row has come for ``keep_ms`` of event time."""

    def __init__(self, tolerance: float, keep_ms: int):
        self.tolerance, self.keep_ms = tolerance, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.firsts = handle.getListState("firsts", "type string, number double, text string, id string")
        self.ends = handle.getValueState("ends", "at long")

    def _agree(self, a, b) -> bool:
        if a[0] == b[0]:
            return abs(a[1] - b[1]) <= self.tolerance if a[0] == "n" else a[2] == b[2]
        return "b" not in (a[0], b[0]) and _shown(a) == _shown(b)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(first) for first in self.firsts.get()] if self.firsts.exists() else []
        known, found = len(held), []
        before = after = self.ends.get()[0] if known else None
        for frame in rows:
            if not len(frame):
                continue
            after = max(after or 0, int(frame["at"].max()) + self.keep_ms)
            for value in frame.sort_values(["at", "id"], kind="stable")[["type", "number", "text", "id"]].itertuples(index=False, name=None):
                if len(held) == 2:
                    break
                if not held or not self._agree(held[0], value):
                    held.append(value)
        for first in held[known:]:
            self.firsts.appendValue(tuple(None if x is None or x != x else x for x in first))
        if known < 2 <= len(held):
            found = [(*key, held[0][3], _shown(held[0]), held[1][3], _shown(held[1]))]
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.ends.update((after,))
            self.handle.registerTimer(after)
        yield pd.DataFrame(found, columns=[*SCOPE, "attr", "first_id", "first_value", "id", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.firsts.clear()
        self.ends.clear()
        yield pd.DataFrame([], columns=[*SCOPE, "attr", "first_id", "first_value", "id", "value"])

    def close(self) -> None:
        pass


def _shown(value) -> str:
    return f"{value[1]:.15g}" if value[0] == "n" else value[2]


def contradiction_alerts(stream: DataFrame, tolerance: float = TOLERANCE, keep_days: float = 365, watermark: str = "1 hour") -> DataFrame:
    """One alert for each subject and attribute when a second bucket opens: both values and who carries them.

    A bucket is named by its first value: a number agrees with it within the tolerance, anything else if it is
    the same (a number and a string if they read the same). Order is that of arrival: 1.0, 1.4, 1.8 at a
    tolerance of 0.5 alert, as 1.8 is too far from 1.0, while 1.4, 1.0, 1.8 do not; the batch audit sorts values first,
    so to it 1.0 and 1.8 always differ. A memory gives an attribute one value, as metadata has a key once.

    The state is at most two values a key. Their time to live is event time, so that a stream that is read again
    gives the same alerts: they end when the watermark passes ``keep_days`` after the key's latest row, and the key may
    alert again. Rows later than the watermark are dropped.
    """
    rows = attributes(stream).select(*SCOPE, "attr", "id", "type", "number", "text", "created_at", F.unix_millis("created_at").alias("at"))
    return rows.withWatermark("created_at", watermark).groupBy(*SCOPE, "attr").transformWithStateInPandas(_Alerts(tolerance, int(keep_days * 86_400_000)), ALERT, "Append", "EventTime")
