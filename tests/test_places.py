"""Greedy circles and components on long chains and in full cubes."""

import math
import random

import pytest

from penstock.operators import graph, places


def far(a, b):
    (x, y), (u, v) = (map(math.radians, p) for p in (a, b))
    h = math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def scan(rows, radius=100.0):
    """The plain scan in order of id."""
    seeds, out = [], {}
    for i, lat, lng in sorted(rows):
        near = [s for s, la, ln in seeds if abs(la - lat) < 0.01 and far((la, ln), (lat, lng)) <= radius]
        out[i] = near[0] if near else i
        if not near:
            seeds.append((i, lat, lng))
    return out


def placed(spark, rows, **how):
    df = spark.createDataFrame(rows, "id bigint, lat double, lng double")
    return {r.id: r.place for r in places.place_clusters(df, **how).collect()}


def test_a_chain_of_thousands(spark):
    """60 m apart and in order, so that every spot depends on the one before it."""
    rows = [(i, 40.0 + 0.5 * math.sin(i / 900), i * 0.0007) for i in range(5000)]
    assert placed(spark, rows, tile_spots=700) == scan(rows)


def test_full_cubes_and_random_order(spark):
    """More positions in one cube than a task takes, among others all around."""
    rng = random.Random(5)
    rows = [(0, 10.0 + rng.gauss(0, 0.0004), 20.0 + rng.gauss(0, 0.0004)) for _ in range(1500)] + [(0, 10.0 + rng.uniform(-0.02, 0.02), 20.0 + rng.uniform(-0.02, 0.02)) for _ in range(300)]
    rng.shuffle(rows)
    rows = [(i, la, ln) for i, (_, la, ln) in enumerate(rows)]
    assert placed(spark, rows, tile_spots=150) == scan(rows)


def test_spots_without_a_position(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "a"), (2, None, 3.0, "a"), (3, 2.0, 3.0, None), (4, 2.0, 3.0, "a")], "id bigint, lat double, lng double, k string")
    assert {r.id: r.place for r in places.place_clusters(df, 100.0, ["k"]).collect()} == {1: 1, 2: None, 3: 3, 4: 1}
    assert places.place_clusters(df.limit(0)).count() == 0


@pytest.mark.parametrize("order", ["adverse", "random"])
def test_components_of_a_long_path(spark, order):
    n = 2000
    names = list(range(n))
    if order == "random":
        random.Random(1).shuffle(names)
    path = [1, *range(10, n + 9), 0] if order == "adverse" else names
    e = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a bigint, b bigint")
    nodes = e.selectExpr("a as node").union(e.selectExpr("b as node")).union(spark.createDataFrame([(99_999,)], "node bigint"))
    got = {r.node: r.root for r in graph.components(nodes, e).collect()}
    assert got == {**{i: 0 for i in path}, 99_999: 99_999}
