"""Values within a few bits of each other against all pairs."""

import random

import pytest

from penstock.operators import bits, resolution


def groups(values, distance):
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {v: top(v) for v in values}


def values(seed, n, crowded):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        v = rng.getrandbits(64) if rng.random() < 0.5 or not out else rng.choice(list(out))
        if crowded:
            v &= 0xFFFF_0000_0001_0FFF  # most bits alike
        for _ in range(rng.randrange(9)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("crowded", [False, True])
def test_trees_in_a_task(monkeypatch, crowded):
    import numpy as np

    monkeypatch.setattr(bits, "PLAIN", 5)
    v = values(3, 700, crowded)
    t = bits._Trees(np.array(v, np.uint64), 6)
    t.settle(np.arange(len(v)), np.zeros(len(v), np.int64), 0)
    t.join()
    assert {a: v[r] for a, r in zip(v, t.root.tolist(), strict=True)} == groups(v, 6)


@pytest.mark.parametrize("task", [400_000, 150])
def test_photos_against_all_pairs(spark, monkeypatch, task):
    v = values(5, 400, True)
    real = bits.links
    monkeypatch.setattr(bits, "links", lambda rows, distance: real(rows, distance, task))
    rows = [(10 * i + k, f"{x:016x}") for i, x in enumerate(v) for k in range(1 + i % 2)] + [(9001, " " * 16), (9000, " " * 16), (9002, "ab")]
    rows += [(9100, f"{v[7]:016X}")]
    want = {x: min(10 * i for i, y in enumerate(v) if g[y] == g[x]) for g in [groups(v, 6)] for x in v}
    got = {r.id: r.group for r in resolution.photo_groups(spark.createDataFrame(rows, "id bigint, phash string")).collect()}
    assert got == {**{i: want[int(p, 16)] for i, p in rows if p.strip() and len(p) == 16}, 9000: 9000, 9001: 9000}


def test_many_values_in_one_band(spark):
    """All share fifty bits, so every pair met in several blocks before."""
    n = 60_000
    rng = random.Random(1)
    v = rng.sample(range(1 << 40), n)
    spread = spark.createDataFrame([(x << 20,) for x in v], "v bigint")
    links = bits.links(spread, 1).count()
    assert links < 4 * n
