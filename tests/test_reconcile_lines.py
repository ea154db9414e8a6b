"""Lines of whole batches of facts against a search over all choices, one fact at a time."""

import random
from itertools import product

from penstock.operators import resolution

SCHEMA = "fact_id bigint, line int, quantity double, unit_price double, total_price double, printed_total double"


def plain(rows, most=100_000, free=16):
    """What a single fact's lines must become."""
    target = float("nan") if rows[0][5] is None else rows[0][5]
    tol = max(0.05, abs(target) * 0.006)
    options = []
    for _, _, q, u, t, _ in rows:
        seen = [x for x in (t, u * q if u is not None and q is not None else None, u) if x is not None]
        options.append(list(dict.fromkeys(round(x, 2) for x in seen)) or [0.0])
    first, size = [o[0] for o in options], 1
    for o in options:
        size *= len(o)
    if abs(sum(first) - target) <= tol:
        return first, True
    hits = [c for c in product(*options) if abs(sum(c) - target) <= tol] if size <= most and sum(len(o) > 1 for o in options) <= free else []
    return (list(hits[0]), True) if len(hits) == 1 else (first, False)


def facts(n):
    rng = random.Random(4)
    out = {}
    for f in range(n):
        lines = rng.choice([1, 2, 3, 5, 7, 17]) if f else 10
        rows, total = [], 0.0
        for k in range(lines):
            q, u = rng.choice([1.0, 2.0, 3.5, None]), rng.choice([None, 1.005, 2.5, 7.125, 19.99, round(rng.uniform(1, 99), 3)])
            t = rng.choice([u, None if u is None or q is None else u * q, round(rng.uniform(1, 50), 3), None])
            rows.append((f, k, q, u, t))
            total += rng.choice([x for x in (t, u, None if u is None or q is None else u * q) if x is not None] or [0.0])
        printed = rng.choice([round(total, 2), round(total, 2), round(total, 2) + 0.05, total + 40, None])
        out[f] = [(*r, printed) for r in rows]
    return out


def test_batches_equal_single_facts(spark):
    want = facts(400)
    got = resolution.reconcile_lines(spark.createDataFrame([r for rows in want.values() for r in rows], SCHEMA))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # a frame for each fact takes milliseconds
    found = {}
    for r in got.collect():
        found.setdefault(r.fact_id, []).append((r.line, r.total_price, r.reconciled))
    solved = 0
    for f, rows in want.items():
        choice, done = plain(rows)
        solved += done and choice != [round(r[4], 2) if r[4] is not None else None for r in rows]
        assert sorted(found[f]) == [(r[1], c, done) for r, c in zip(rows, choice, strict=True)]
    assert solved > 30


def test_query_reads_lines_once(spark):
    from penstock.plans.catalog import QUERIES

    plan = QUERIES["reconciled_facts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
    assert "FlatMapGroupsInPandas" not in plan and plan.count("lineitem.parquet") == 1
