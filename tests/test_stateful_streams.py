import datetime as dt
import json
import time

import pytest

from factloom.streaming import stateful

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = {name: spark.conf.get(name) for name in names}
    stateful.use_rocksdb(spark)
    spark.conf.set(names[1], "1")
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def stream(spark, tmp_path, schema, batches, job):
    """Run ``job`` over one file a micro-batch; (rows by batch, keys in the state after each)."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if i + 1 < len(batches) else 0)  # files are read in the order of their time
    found = {}
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = job(source).writeStream.foreachBatch(lambda df, n: found.__setitem__(n, [tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return found, [p.stateOperators[0].numRowsTotal for p in query.recentProgress]


def test_inserts_replays_conflicts_and_the_end_of_a_key(rocksdb, tmp_path):
    schema = "tenant_id string, idempotency_key string, id string, created_at timestamp, content string"
    hour = lambda h: DAY + dt.timedelta(hours=h)
    batches = [
        [("t", "k", "1", hour(0), "x"), ("t", "k", "2", hour(1), "x"), ("t", "k", "3", hour(2), "y"), ("u", "k", "4", hour(0), "y"), ("t", None, "5", hour(0), "x"), ("t", None, "6", hour(0), "x")],
        [("t", "k", "7", hour(3), "x"), ("t", "far", "8", hour(100), "x")],
        [("t", "far", "9", hour(101), "z")],
        [("t", "k", "10", hour(102), "y")],
    ]
    found, held = stream(rocksdb, tmp_path, schema, batches, lambda s: stateful.ingest(s, ["content"], keep_days=1))
    rows = {r[2]: (r[3], r[4]) for batch in found.values() for r in batch}
    assert rows == {
        "1": ("insert", "1"), "2": ("replay", "1"), "3": ("conflict", "1"), "4": ("insert", "4"), "5": ("insert", None), "6": ("insert", None),
        "7": ("replay", "1"), "8": ("insert", "8"), "9": ("conflict", "8"), "10": ("insert", "10"),
    }
    # Two keys, then three; past the watermark the first two end, so the last batch starts k anew.
    assert held[0] == 2 and max(held) <= 3 and held[-1] == 2


def test_an_alert_when_a_second_bucket_opens(rocksdb, tmp_path):
    schema = "id string, kind string, company string, period string, source_ref string, metadata string, importance double, created_at timestamp"
    fact = lambda i, ref, minute, **meta: (str(i), "document", "Acme", "2024-01", ref, json.dumps(meta), 0.5, DAY + dt.timedelta(minutes=minute))
    batches = [
        [fact(1, "r1", 0, total=1.4), fact(2, "r1", 1, total=1.0), fact(3, "r2", 0, total=1.0), fact(4, "r3", 0, code="18400")],
        [fact(5, "r1", 2, total=1.8), fact(6, "r2", 1, total=1.8), fact(7, "r3", 1, code=18400), fact(8, "r4", 0, paid=True)],
        [fact(9, "r2", 2, total=99), fact(10, "r1", 3, total=5), fact(11, "r4", 1, paid=False), fact(12, "r4", 2, paid=True)],
    ]
    found, _ = stream(rocksdb, tmp_path, schema, batches, stateful.contradiction_alerts)
    by_batch = [sorted(r[2:] for r in found.get(n, [])) for n in range(3)]
    # Arrival order: 1.0 and 1.8 both agree with 1.4, which came first; 1.8 does not agree with 1.0.
    assert by_batch[0] == []
    assert by_batch[1] == [("r2", "total", "3", "1", "6", "1.8")]
    assert by_batch[2] == [("r1", "total", "1", "1.4", "10", "5"), ("r4", "paid", "8", "true", "11", "false")]
