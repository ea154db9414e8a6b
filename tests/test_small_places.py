"""Places of many small groups, and of small ones beside a full one, against a scan."""

import random

import pytest

from penstock.operators import places, stats


def metres(a, b):
    from math import atan2, cos, radians, sin, sqrt

    p, q = radians(a[0]), radians(b[0])
    h = sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000.0 * atan2(sqrt(h), sqrt(1 - h))


@pytest.mark.parametrize("rows", [256, 60])
def test_groups_against_a_scan(spark, monkeypatch, rows):
    monkeypatch.setattr(places, "GROUP_ROWS", rows)
    rng = random.Random(2)
    points = []
    for i in range(900):
        key = rng.choice(["a", "b", None, *map(str, range(40))]) if i % 4 else "hot"
        at = (None, None) if rng.random() < 0.05 else (34.7 + rng.randrange(9) * 0.0006, 33.0 + rng.randrange(9) * 0.0007)
        points.append((i, key, 1.0 + i, *at))
    want, seeds = {}, {}
    for i, key, _, lat, lng in points:
        if lat is None:
            want[i] = None
            continue
        own = seeds.setdefault(key, [])
        hit = next((s for s, at in own if metres((lat, lng), at) <= 100), None)
        if hit is None:
            own.append((i, (lat, lng)))
        want[i] = i if hit is None else hit
    df = spark.createDataFrame(points, "id bigint, vendor_key string, total_amount double, lat double, lng double")
    assert {r.id: r.place for r in places.place_clusters(df, 100.0, ["vendor_key"]).collect()} == want


def test_small_groups_make_no_frames(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 90 as string) as vendor_key", "1.5d as total_amount", "34.5d + id % 5 / 100d as lat", "33.0d as lng")
    plan = stats.vendor_branches(df)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Scan ExistingRDD" not in plan.partition("== Physical Plan ==")[2]
