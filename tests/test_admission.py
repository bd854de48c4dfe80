import datetime as dt
import random

import pytest

from factloom.operators import admission


def brute(rows):
    used, out = {}, {}
    for ts, i, bucket, subject, units, limit in sorted(rows, key=lambda r: (r[0], str(r[1]))):
        key = (ts.date(), bucket or "", subject or "")
        have = used.get(key, 0)
        fits = have + units <= limit
        used[key] = have + units if fits else have
        out[str(i)] = (fits, used[key])
    return out


def charges(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, id string, bucket string, subject string, units double, limit double")


def run(spark, rows, block):
    return {r.id: (r.admitted, r.used) for r in admission.admit(charges(spark, rows), block).collect()}


def test_a_refused_charge_counts_nothing(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(day.replace(hour=h), f"c{h}", "ask", "u", float(n), 10.0) for h, n in enumerate((6, 7, 3, 2, 1))]
    assert run(spark, rows, 100) == {"c0": (True, 6), "c1": (False, 6), "c2": (True, 9), "c3": (False, 9), "c4": (True, 10)}
    daily = admission.daily_admitted(charges(spark, rows)).first()
    assert (daily.units, daily.n_admitted, daily.n_refused, daily.remaining) == (10, 3, 2, 0)


@pytest.mark.parametrize("block", [7, 40, 10_000])
def test_hot_keys_in_blocks_equal_the_plain_fold(spark, block):
    rng = random.Random(block)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        hot = i % 3 > 0
        rows.append((start + dt.timedelta(minutes=rng.randrange(2880 if not hot else 1440)), f"{i:04d}", "ask" if hot else rng.choice(["a", None]), "u" if hot else rng.choice("xyz"), float(rng.choice((1, 2, 9, 40))), float(rng.choice((300, 320)))))
    assert run(spark, rows, block) == brute(rows)


def test_odd_values(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(day, "a", None, None, None, float("nan")), (day, "b", None, "", 2.9, 5e9), (None, "c", "x", "y", 1.0, 1.0), (day, "d", "x", "y", float("inf"), -3.0)]
    found = {r.id: (r.units, r.limit, r.admitted) for r in admission.admit(charges(spark, rows)).collect()}
    assert found == {"a": (1, 1, True), "b": (2, 1_000_000, True), "d": (1, 1, True)}
    assert admission.admit(charges(spark, [])).collect() == []


def test_retention(spark):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-02-01",)], "day string")
    assert sorted(r.day for r in admission.retained(days, "2024-02-01").collect()) == ["2024-01-02", "2024-02-01"]
