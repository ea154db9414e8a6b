"""Reconciled lines against a search over all choices; ranking by letters and hot words."""

import itertools
import math
import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest

from penstock.operators import ranking, reconcile

CENT = Decimal("0.01")


def options(q, unit, total):
    q = (Decimal(str(q)) if q is not None else Decimal(1)).quantize(CENT, ROUND_HALF_EVEN)
    q = q if q > 0 else Decimal(1)
    out = [total]
    for x in [unit, None if q == 1 else (total / q).quantize(CENT, ROUND_HALF_EVEN)]:
        if x is not None and x not in out:
            out.append(x)
    return out


def plan(lines, printed):
    every = [(k, options(q, u, t)) for k, q, u, t in lines if t is not None]
    free = [o for _, o in every if len(o) > 1]
    if not free:
        return "no adjustable lines", None
    if len(free) > 5:
        return "too ambiguous", None
    if math.prod(map(len, free)) > 24:
        return "too many combinations", None
    tol = max(Decimal("0.05"), (Decimal("0.006") * printed).quantize(CENT, ROUND_HALF_EVEN))
    hits = [c for c in itertools.product(*(o for _, o in every)) if abs(sum(c) - printed) <= tol]
    if len(hits) != 1:
        return ("ambiguous" if hits else "none fits"), None
    new = {k: c for (k, o), c in zip(every, hits[0], strict=True) if c != o[0]}
    return ("reconciled" if new else "already reconciled"), new


def receipts(seed, n=150):
    rng = random.Random(seed)
    money = lambda: Decimal(rng.randint(1, 3000)) / 100
    out = {}
    for f in range(n):
        lines, truth = [], Decimal(0)
        for k in range(rng.randint(1, 7)):
            q, t = rng.choice([1, 1, 2, 3, 7, 0, None, 2.5]), money()
            kind = rng.random()
            total, unit = (t, t / Decimal(str(q)) if q else None) if kind < 0.6 else (t * int(q or 1), t)
            truth += t
            unit = None if unit is None or rng.random() < 0.2 else Decimal(unit if isinstance(unit, Decimal) else str(unit)).quantize(CENT, ROUND_HALF_EVEN)
            lines.append((k, q, unit, None if rng.random() < 0.05 else total))
        out[f] = (lines, truth + rng.choice([0, 0, 0, Decimal("0.04"), Decimal("-0.05"), 11]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_plans_by_brute_force(spark, seed):
    rows = receipts(seed)
    kind = "fact_id bigint, line int, quantity double, unit_price decimal(18,2), total_price decimal(18,2)"
    lines = spark.createDataFrame([(f, k, None if q is None else float(q), u, t) for f, (ls, _) in rows.items() for k, q, u, t in ls], kind)
    printed = spark.createDataFrame([(f, p) for f, (_, p) in rows.items()] + [(999, None), (1000, Decimal(1))], "fact_id bigint, printed_total decimal(18,2)")
    planned = reconcile.plans(lines, printed, 5, 24)
    got = {r.fact_id: r for r in planned.collect()}
    want = {f: plan(ls, p) for f, (ls, p) in rows.items() if any(t is not None for *_, t in ls)}
    assert {f: r.reason for f, r in got.items()} == {f: w[0] for f, w in want.items()}
    assert {"ambiguous", "none fits", "reconciled", "already reconciled", "too many combinations"} <= {w[0] for w in want.values()}
    fixed = reconcile.fixes(lines, planned)
    new = {(r.fact_id, r.line): r.new_total for r in fixed.collect()}
    assert new == {(f, k): float(v) for f, (reason, w) in want.items() if reason == "reconciled" for k, v in w.items()}
    done = reconcile.apply_fixes(lines, fixed).groupBy("fact_id").sum("total_price").collect()
    sums = {r[0]: float(r[1]) for r in done if r[1] is not None}
    assert all(abs(sums[f] - r.new_sum) < 1e-6 for f, r in got.items())


def test_no_lines(spark):
    lines = spark.createDataFrame([], "fact_id bigint, line int, quantity double, unit_price double, total_price double")
    assert reconcile.plans(lines, spark.createDataFrame([(1, 2.0)], "fact_id bigint, printed_total double")).count() == 0


@pytest.mark.parametrize("many", [ranking.MANY, 3])
def test_ranks_by_brute_force(spark, monkeypatch, many):
    """One-letter words, accents, repeats, words that nothing begins with; frequent words in several parts."""
    monkeypatch.setattr(ranking, "MANY", many)
    rng = random.Random(4)
    words = ["a", "ab", "abc", "bread", "Brioche", "crème", "c", "x1"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(90, None)]
    queries = [(1, "a"), (2, "br cre"), (3, "zz a"), (4, "zz"), (5, ""), (6, None), (7, "a a b c x 1 9"), (8, "B")]
    fold = lambda t: [w for w in "".join(ch if ch.isalnum() else " " for ch in (t or "").lower().replace("è", "e")).split() if w]
    docs = {i: fold(t) for i, t in texts}
    mean = sum(map(len, docs.values())) / len(docs)
    want = []
    for q, t in queries:
        asked = fold(t)[:5]
        found = {}
        for p in asked:
            tf = {i: sum(w.startswith(p) for w in ws) for i, ws in docs.items()}
            df = sum(v > 0 for v in tf.values())
            for i, v in tf.items():
                if v:
                    part = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6) * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
                    s, h = found.get(i, (0.0, 0))
                    found[i] = (s + part, h + 1)
        whole = {i: x for i, x in found.items() if x[1] == len(asked)}
        order = sorted((whole or found).items(), key=lambda x: (-round(x[1][0], 6), x[0]))[: 10 if whole else 20]
        want += [(q, i, h, round(s, 6), r + 1) for r, (i, (s, h)) in enumerate(order)]
    out = ranking.ranked(spark.createDataFrame(texts, "id bigint, t string"), spark.createDataFrame(queries, "q bigint, text string"), "id", "t", 10, 20)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert ranking.ranked(spark.createDataFrame(texts[:0], "id bigint, t string"), spark.createDataFrame(queries, "q bigint, text string"), "id", "t").count() == 0
