"""The LSH forest against brute force: stars of spokes that only their hub links, chains, copies, cut families, odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from penstock.llm import graph, neardup


def sets_of(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [sets_of(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d is None, d or 0), len(sets[i]), (least.get(find(i)) is None, least.get(find(i)) or 0)) for i, (d, _) in enumerate(rows))


def corpus(seed=1, spokes=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, hub = [], [word() for _ in range(300)]
    rows.append((500, " ".join(hub)))
    for i in range(spokes):  # spokes agree with the hub, hardly with each other
        w = list(hub)
        for p in rng.sample(range(5, 290), 7):
            w[p] = word()
        rows.append((1000 + i, " ".join(w)))
    chain = [word() for _ in range(200)]
    for i in range(12):
        chain = list(chain)
        chain[15 * i : 15 * i + 5] = [word() for _ in range(5)]
        rows.append((2000 + i, " ".join(chain)))
    for i in range(60):
        rows.append((3000 + i, " ".join(word() for _ in range(rng.randint(1, 60)))))
    copy = "The SAME text, again and again."
    rows += [(4000 + i, copy if i % 2 else copy.lower().replace(" ", "\n")) for i in range(30)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one"), (None, "lonely words here"), (3000, copy), (3000, "other words under the same id"), (7, "long " * 3000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 10**7), (5, 80, 10**7), (3, 85, 9000)])
def test_equals_brute_force(spark, k, percent, block):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, node int, t1 string").repartition(5)
    got = neardup.groups(docs, neardup.Rule(k, percent), block_shingles=block).collect()
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, (r.component_id is None, r.component_id or 0)) for r in got)
    assert found == brute(rows, k, percent)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.groups(docs, neardup.Rule(3, 85)).count() == 0
    assert neardup.distinct_texts(docs).count() == 0


def test_distinct_texts_keeps_one_of_each(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (9, None, "z"), (8, None, "z"), (7, "g h i j k l", "w")], "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in neardup.distinct_texts(docs).collect()) == [3, 7, 8, 9]


@pytest.mark.parametrize("bound", [neardup.BROADCAST_MEMBERS, 0])
def test_distinct_texts_goes_by_row(spark, monkeypatch, bound):
    """A unique text that shares its id with a copy stays; of repeated rows one stays; copies without an id go. The same whether the rows that go are broadcast or joined by shuffling."""
    monkeypatch.setattr(neardup, "BROADCAST_MEMBERS", bound)
    copy, other = "a b c d e f", "k l m n o p q"
    rows = [(1, copy, "u"), (3, copy, "v"), (3, other, "w"), (4, "r s t u v w", "x"), (4, "r s t u v w", "x"), (None, copy, "y"), (None, "x1 x2 x3 x4 x5 x6", "z"), (None, "x1 x2 x3 x4 x5 x6", "z"), (5, None, "z"), (5, None, "z"), (6, " ", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, t1 string").repartition(4)
    got = neardup.distinct_texts(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(1, copy), (3, other), (4, "r s t u v w"), (0, "x1 x2 x3 x4 x5 x6"), (5, ""), (5, ""), (6, " ")])


def test_linked_takes_both_ways():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < 0.97], rng.integers(0, 1 << 60, 3, dtype=np.uint64)])) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    root = neardup.linked(sets, 90)
    for i in range(40):
        for j in range(40):
            if 100 * want[i][j] >= 90 * (len(sets[i]) + len(sets[j]) - want[i][j]):
                assert root[i] == root[j]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in touched}


def test_cut_chain_keeps_every_link(spark):
    """Links between neighbours alone, in a family dealt into many pieces."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    chain, rows = [word() for _ in range(200)], []
    for i in range(90):
        chain = list(chain)
        at = 15 * i % 195
        chain[at : at + 5] = [word() for _ in range(5)]
        rows.append((i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = neardup.groups(docs, neardup.Rule(3, 85), block_shingles=1500).collect()
    assert sorted(((False, r.doc_id), r.n_shingles, (False, r.component_id)) for r in got) == brute(rows, 3, 85)


def test_crowded_regions_miss_no_pair(spark):
    """2,400 distinct sets that share half their shingles, and 600 near copies of some, and 400 chains off one family: all pairs of each region are compared."""
    rng = np.random.default_rng(7)
    new = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    shared = new(100)
    sets = [np.concatenate([shared, new(100)]) for _ in range(2400)]
    sets += [np.concatenate([s[20:], new(18)]) for s in sets[:600]]
    base = new(200)  # 300 near copies draw off their neighbours, which have neighbours of their own
    change = lambda s, n: np.concatenate([rng.permutation(s)[n:], new(n)])
    middle = [change(base, 32) for _ in range(400)]
    sets += [change(base, 4) for _ in range(300)] + middle + [change(s, 32) for s in middle]
    sigs = np.stack([neardup.signature(s) for s in sets])
    nodes = spark.createDataFrame([(i, s.astype("<u4").tobytes()) for i, s in enumerate(sigs)], "node bigint, sig binary").repartition(6)
    rule = neardup.Rule(3, 80)
    family = {r.node: r.root for r in neardup._families(nodes, rule, 500).collect()}
    sketch, pairs = sigs.astype(np.uint8), 0
    for t in range(neardup.TREES):
        key = sigs[:, t * neardup.DEPTH : t * neardup.DEPTH + neardup.LEAST_DEPTH]
        for i in range(len(sets)):
            at = i + 1 + np.flatnonzero((key[i + 1 :] == key[i]).all(axis=1))
            for j in at[(sketch[at] == sketch[i]).sum(axis=1) >= rule.sketch_matches].tolist():
                pairs += 1
                assert family[i] == family[j]
    assert pairs > 600


@pytest.mark.parametrize("bound", [neardup.BROADCAST_MEMBERS, 0])
def test_null_ids_meet_their_own_texts_alone(spark, monkeypatch, bound):
    """2,000 texts without ids, and 500 under one id: each meets itself."""
    monkeypatch.setattr(neardup, "BROADCAST_MEMBERS", bound)
    rows = [(None, f"text number {i} of its own") for i in range(2000)] + [(3, f"other text {i}") for i in range(500)]
    plain = spark.createDataFrame(rows, "id bigint, text string").na.fill({"id": neardup._NO_ID}).select("*", *neardup._text_marks("text"))
    members = plain.select("id", "t1", "t2", F.monotonically_increasing_id().alias("node"))
    assert neardup._texts_of(plain, members).count() == 2500
    few = rows[:40] + rows[2000:2040] + rows[:5] * 3
    docs = spark.createDataFrame(few, "doc_id bigint, text string")
    out = neardup.groups(docs, neardup.Rule(3, 50)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, (r.component_id is None, r.component_id or 0)) for r in out) == brute(few, 3, 50)
