"""Clusters of amounts against the plain scan, and steps of a finaliser that fail."""

import random
from datetime import date

import pytest

from penstock.operators import stats
from penstock.streaming import streams


def test_clusters_equal_the_plain_scan(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b"]), None, None, round(rng.choice([10.0, 12.0, 20.0, 21.5, 300.0]) * rng.choice([1, 1, 1.02, 1.09]), 2), date(2024, 1, 1)) for i in range(400)] + [(900, "c", None, None, 5.0, date(2024, 1, 1)), (901, "a", None, None, None, date(2024, 1, 1))]
    df = spark.createDataFrame(rows, "id bigint, vendor_key string, vendor string, slug string, total_amount double, event_date date")
    want = {}
    for v in "ab":
        mine, cluster, total, n = sorted((r[4], r[0]) for r in rows if r[1] == v and r[4] is not None), -1, 0.0, 0
        for a, i in mine:
            if n == 0 or abs(a - total / n) / (total / n) > 0.1:
                cluster, total, n = cluster + 1, 0.0, 0
            total, n = total + a, n + 1
            want[i] = cluster
    assert {r.id: r.cluster for r in stats.amount_clusters(df).collect()} == want and max(want.values()) > 1


def test_failed_steps_are_told(spark):
    df, seen, failures = spark.range(3), [], []

    def broken(batch):
        raise ValueError("no")

    steps = [("broken", broken), ("count", lambda b: seen.append(b.count()))]
    streams.finalise(steps, failures)(df, 7)
    assert seen == [3] and [(e, n) for e, n, _ in failures] == [(7, "broken")]
    with pytest.raises(RuntimeError, match="broken"):
        streams.finalise(steps)(df, 8)
    assert seen == [3, 3]
