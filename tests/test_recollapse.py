"""Blocks against all pairs, incremental clouds against full rebuilds, and what corrections teach."""

import random
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from penstock.operators import learning, recollapse, resolution

SCHEMA = "ord bigint, bundle_type string, vendor string, vendor_key string, slug string, amount decimal(18,2), currency string, event_date date, item_names array<string>, lat double, lng double"
KEYS = ["10057000Y", "99418230B", "55667788C", None]


def bundles(seed, n=220):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = rng.randrange(4)
        day = None if rng.random() < 0.25 else date(2024, 1, 1) + timedelta(days=rng.choice([0, 0, 1, 2, 4, 9, 30, 58, 63, 70]))
        amount = None if rng.random() < 0.2 else Decimal(rng.choice(["5.00", "5.01", "5.02", "5.09", "17.50", "17.51", "80.00"]))
        where = (None, None) if rng.random() < 0.5 else (34.7 + rng.choice([0, 0.0005, 0.004, 0.2]), 33.0)
        out.append((i, rng.choice(["basket", "basket", "invoice", "payment_record", "statement_line", "other"]), f"shop {'abcd'[v] * 5}", KEYS[v], f"shop{'abcd'[v] * 5}", amount, rng.choice(["EUR", "EUR", "USD"]), day, rng.sample(["milk", "tea", "rye", "salt"], rng.choice([0, 0, 1, 2])), *where))
    return out


def test_blocks_lose_no_link(spark):
    seed = 1
    b = spark.createDataFrame(bundles(seed), SCHEMA)
    linked = lambda p: {(r.a, r.b, r.score) for r in resolution.score_pairs(p).where("score > 0.5").collect()}
    full = b.withColumn("agent", F.lit(False)).withColumn("key", F.upper("vendor_key"))
    side = lambda s: full.select([F.col(c).alias(f"{s}_{c}") for c in full.columns])
    every = side("a").crossJoin(side("b")).where("a_ord < b_ord")
    days = F.abs(F.datediff("a_event_date", "b_event_date"))
    every = every.where(F.coalesce(days <= resolution.date_tolerance(F.col("a_bundle_type"), F.col("b_bundle_type")), F.lit(True)))
    got, want = linked(resolution.candidate_pairs(b)), linked(every)
    assert got == want and len(want) > 100
    some = spark.createDataFrame([(i,) for i in range(0, 220, 9)], "ord bigint")
    assert linked(resolution.candidate_pairs(b, some)) == {x for x in want if x[0] % 9 == 0 or x[1] % 9 == 0}


def test_recollapse_equals_a_rebuild(spark):
    seed = 3
    rng = random.Random(seed)
    old = bundles(seed, 300)
    new = [r for r in old if r[0] not in (20, 21, 150)]
    for i in rng.sample(range(len(new)), 8):
        new[i] = (*new[i][:5], Decimal("5.00"), "EUR", date(2024, 1, 2), *new[i][8:])
    new += [(1000 + i, *r[1:]) for i, r in enumerate(bundles(seed + 9, 6))]
    before, after = ({r[0]: r for r in x} for x in (old, new))
    changed = {i for i in before.keys() | after.keys() if before.get(i) != after.get(i)}
    a, b = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    parents = resolution.best_partners(a)
    clouds = resolution.form_clouds(a)
    facts = resolution.collapse_clouds(a, clouds)
    p2, c2, touched = recollapse.recollapse(b, parents, clouds, spark.createDataFrame([(i,) for i in sorted(changed)], "ord bigint"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = resolution.form_clouds(b)
    assert rows(c2) == rows(want) and rows(p2.select("node", "parent")) == rows(resolution.best_partners(b))
    assert rows(recollapse.swap_facts(facts, b, c2, touched)) == rows(resolution.collapse_clouds(b, want).select(*facts.columns))
    assert touched.count() < want.select("cloud").distinct().count()


def test_features_of_a_move(spark):
    rows = [(1, "basket", "Lidl", "K1", "lidl", Decimal("5.00"), "EUR", date(2024, 1, 1), ["milk", "tea"], 34.7, 33.0), (2, "payment_record", "Lidl CY", "K2", "lidlcy", Decimal("7.50"), "EUR", date(2024, 1, 4), ["milk"], 34.7, 33.0), (3, "basket", None, None, None, None, None, None, [], None, None)]
    b = spark.createDataFrame(rows, SCHEMA)
    clouds = spark.createDataFrame([(1, 9), (2, 9), (3, 8)], "ord bigint, cloud bigint")
    moves = spark.createDataFrame([(2, 9, True, 1), (3, 8, False, 2), (1, 9, True, 3)], "ord bigint, cloud bigint, was_false_positive boolean, at int")
    got = {r.at: r for r in learning.correction_features(b, clouds, moves).collect()}
    a = got[1]
    assert (a.vendor_key_a, a.vendor_key_b, a.vendor_similarity, a.amount_diff, a.date_diff_days, a.location_distance, a.item_overlap, a.target_bundle_type) == ("K2", "K1", 0.0, 2.5, 3, 0.0, 0.5, "basket")
    assert (got[2].vendor_similarity, got[2].amount_diff, got[2].date_diff_days, got[2].vendor_key_b, got[2].target_bundle_type) == (0.0, 0.0, 0, None, None)


def test_weights_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, i % 7, rng.random() < 0.6, rng.choice(["a", "b", "c", None]), rng.choice(["a", "b", "z", None]), rng.choice([0.0, 0.9]), rng.choice([0.2, 3.0]), rng.choice([0, 9]), rng.choice([0.0, 0.8])) for i in range(300)]
    rows += [(900 + i, 9, True, "few", None, 0.0, 0.0, 0, 0.0) for i in range(2)] + [(950 + i, 9, True, "sure", "sure", 0.1, 0.5, 5, 0.0) for i in range(4)]
    schema = "ord bigint, at int, was_false_positive boolean, vendor_key_a string, vendor_key_b string, vendor_similarity double, amount_diff double, date_diff_days int, item_overlap double"
    df = spark.createDataFrame(rows, schema)

    def plain(rs):
        fp, ok = [r for r in rs if r[2]], [r for r in rs if not r[2]]
        mean = lambda x, k: sum(r[k] for r in x) / len(x)
        out = [1.0] * 4
        if fp and mean(fp, 5) < 0.5 and mean(fp, 6) < 1:
            out[0], out[1] = min(1 + 0.1 * len(fp), 1.3), max(1 - 0.05 * len(fp), 0.7)
        if fp and mean(fp, 7) > 3:
            out[2] = min(1 + 0.05 * len(fp), 1.3)
        if ok and mean(ok, 8) > 0.3:
            out[3] = 1.2
        return out

    order = sorted(rows, key=lambda r: (-r[1], -r[0]))
    want = {None: plain(order[:200])}
    for key in ("a", "b", "c", "z", "few", "sure"):
        mine = [r for r in order if key in r[3:5]][:50]
        if len(mine) >= 3:
            want[key] = plain(mine)
    got = {r[0]: [round(x, 9) for x in r[1:]] for r in learning.weights(df).collect()}
    assert got == {k: [round(x, 9) for x in v] for k, v in want.items()} and "few" not in got
    assert learning.weights(df.limit(0)).count() == 0


def test_learned_weights_and_vetoes_change_clouds(spark):
    row = lambda i, kind, key, amount: (i, kind, f"shop {key}", key, f"shop{key}", amount, "EUR", date(2024, 1, 1), [], None, None)
    b = spark.createDataFrame([row(1, "basket", "AAAA", Decimal(5)), row(2, "payment_record", "AAAA", None), row(3, "basket", "ZZZZ", Decimal(5)), row(4, "payment_record", "ZZZZ", Decimal(5))], SCHEMA)
    assert {r.ord: r.cloud for r in resolution.form_clouds(b).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    learned = spark.createDataFrame([("AAAA", 1.3, 0.85, 1.0, 1.0)], "vendor_key string, vendor double, amount double, date double, items double")
    pairs = spark.createDataFrame([("ZZZZ", "ZZZZ")] * 2, "vendor_a string, vendor_b string")
    assert {r.ord: r.cloud for r in resolution.form_clouds(b, None, pairs, learned).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
