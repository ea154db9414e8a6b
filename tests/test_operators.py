"""Operators that the catalog can't hold against SQL, on small tables of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from penstock.facade import Engine
from penstock.functions import dates, quantities, vendors
from penstock.operators import enrich, graph, lists, resolution, spend, stars, stats, store
from penstock.plans import search_plan
from penstock.sources import bank, files
from penstock.streaming import streams

D = dt.date


def test_engine(spark):
    e = Engine(spark, "/root/testdata/sf0.001").register_views()
    assert e.sql("select count(*) n from item_stars where currency = :c", c="EUR").first().n > 0


def test_scalars(spark):
    df = spark.createDataFrame([("Acme Store Ltd.", "1.234,56", "31/12/2023"), ("ΣΚΛΑΒΕΝΙΤΗΣ ΑΕ", "$1,234.50", "2024-02-03"), ("ООО Пятёрочка", "(12,5)", "12/31/23"), ("JCC Payment Systems", "3.5K", "3.2.24"), (None, None, None)], "n string, a string, d string")
    rows = df.select(vendors.slug("n"), vendors.is_intermediary("n"), quantities.parse_number("a"), dates.parse_date("d")).collect()
    assert [tuple(r) for r in rows] == [("acmestore", False, 1234.56, D(2023, 12, 31)), ("sklavenitis", False, 1234.5, D(2024, 2, 3)), ("pyaterochka", False, -12.5, D(2023, 12, 31)), ("jccpaymentsystems", True, 3500.0, D(2024, 2, 3)), (None, False, None, None)]


def test_facets():
    assert stars.parse_facets("organic:true,size:L,fat:3.5,free_range") == {"organic": True, "size": "L", "fat": 3.5, "free_range": None}
    with pytest.raises(ValueError):
        stars.star_filter({"nonsense": 1})
    with pytest.raises(ValueError):
        stars.group_columns(["attr:Bad-Key"])


def test_subscriptions(spark):
    rows = [(i, "Netflix", "n", 10.0, D(2024, 1 + i, 5)) for i in range(6)] + [(100 + i, "Shop", "s", 20.0 + 30 * i, D(2024, 1, 1 + 3 * i)) for i in range(6)]
    f = spark.createDataFrame([(*r, "purchase") for r in rows], "id bigint, vendor string, vendor_key string, total_amount double, event_date date, fact_type string")
    subs = stats.detect_subscriptions(f)
    assert [(r.vendor_group, r.period, r.n) for r in subs.collect()] == [("n", "monthly", 6)]
    due = stats.upcoming_payments(subs, "2024-06-20", 60).collect()
    assert [r.due for r in due] == [D(2024, 7, 5), D(2024, 8, 4)]


def test_amount_clusters_follow_the_running_mean(spark):
    f = spark.createDataFrame([(i, "v", "v", a, D(2024, 1, 1)) for i, a in enumerate([10.0, 10.5, 11.0, 13.0, 13.5])], "id bigint, vendor string, vendor_key string, total_amount double, event_date date")
    assert [r.cluster for r in stats.amount_clusters(f).orderBy("id").collect()] == [0, 0, 0, 1, 1]


def test_place_clusters(spark):
    p = spark.createDataFrame([(1, 34.7, 33.1), (2, 34.7005, 33.1), (3, 34.71, 33.1)], "id bigint, lat double, lng double")
    assert sorted((r.id, r.place) for r in stats.place_clusters(p).collect()) == [(1, 1), (2, 1), (3, 3)]


def bundle(ord_, kind, vendor, key, amount, day):
    return (ord_, kind, vendor, key, amount, "EUR", D(2024, 1, day), ["milk", "bread"] if kind == "basket" else [])


def test_clouds(spark):
    from decimal import Decimal

    rows = [bundle(1, "basket", "Acme Ltd", "CY10057000Y", Decimal("12.50"), 3), bundle(2, "payment_record", "ACME", "CY10057000Y", Decimal("12.50"), 3), bundle(3, "basket", "Other Shop", "CY20000000X", Decimal("99.00"), 3), bundle(4, "statement_line", "JCC PAYMENT SYSTEMS", None, Decimal("12.50"), 5), bundle(5, "basket", "Acme Ltd", "CY10057000Y", Decimal("12.50"), 9)]
    b = spark.createDataFrame(rows, "ord bigint, bundle_type string, vendor string, vendor_key string, amount decimal(18,2), currency string, event_date date, item_names array<string>").withColumn("slug", vendors.slug("vendor"))
    clouds = resolution.form_clouds(b)
    got = {r.ord: r.cloud for r in clouds.collect()}
    assert got[2] == 1 and got[3] == 3 and got[5] == 5
    fact = {r.cloud: r for r in resolution.collapse_clouds(b, clouds).collect()}
    # The acquirer's line joins the cloud by amount and date, but its name is no second sign of the merchant.
    assert got[4] == 1 and fact[1].vendor == "Acme Ltd" and fact[1].total_amount == Decimal("12.50") and fact[1].status == "partial"
    two = resolution.collapse_clouds(b.where("ord <= 2"), clouds.where("ord <= 2")).first()
    assert two.status == "confirmed" and two.confidence == 0.9


def test_extractions(spark):
    docs = spark.createDataFrame(
        [("a", "receipt", "Acme", "CY1", "2024-01-03", "12.50", "EUR", [("milk", "1", "2.50")], None), ("b", "statement", None, None, None, None, "EUR", None, [("2024-01-04", "Acme", -12.5), ("2024-01-05", "Foo", 3.0)])],
        "id string, kind string, vendor string, vendor_vat string, date string, total string, currency string, line_items array<struct<name:string,quantity:string,total_price:string>>, transactions array<struct<date:string,description:string,amount:double>>",
    )
    s = {r.bundle_id: r for r in resolution.bundle_summaries(resolution.parse_extractions(docs)).collect()}
    assert sorted(s) == ["a:0", "b:0", "b:1"] and s["a:0"].item_names == ["milk"] and float(s["b:0"].amount) == 12.5 and s["b:1"].bundle_type == "statement_line"


def test_reconcile_takes_the_only_plan(spark):
    rows = [(1, 1, 2.0, 3.0, 3.0, 8.0), (1, 2, 1.0, 2.0, 2.0, 8.0), (2, 1, 1.0, 5.0, 5.0, 9.0)]
    got = resolution.reconcile_lines(spark.createDataFrame(rows, "fact_id bigint, line int, quantity double, unit_price double, total_price double, printed_total double")).collect()
    assert sorted((r.fact_id, r.line, r.total_price, r.reconciled) for r in got) == [(1, 1, 6.0, True), (1, 2, 2.0, True), (2, 1, 5.0, False)]


def test_photos_and_duplicates(spark):
    p = spark.createDataFrame([(1, "00000000000000ff"), (2, "00000000000000fe"), (3, "ffffffff00000000"), (4, "00000000000000f0"), (5, "00000000000000ff")], "id bigint, phash string")
    assert {r.id: r.group for r in resolution.photo_groups(p).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1}


def test_components(spark):
    n = spark.range(40).withColumnRenamed("id", "node")
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 20)] + [(30, 35), (35, 39)], "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(n, e).collect()}
    assert got[20] == 0 and got[39] == 30 and got[25] == 25


def test_budget_merge(spark):
    a = spark.createDataFrame([("food", "2024-01", 10.0), ("rent", "2024-01", 5.0)], "category string, period string, amount double")
    o = spark.createDataFrame([("food", "2024-01", 1.0, 1), ("food", "2024-01", 2.0, 2), ("new", "2024-01", 7.0, 1)], "category string, period string, amount double, ord int")
    assert {r.category: r.amount for r in spend.merge_entries(a, o).collect()} == {"food": 2.0, "rent": 5.0, "new": 7.0}
    v = {r.category: (r.difference, r.percent) for r in spend.variance(a, o.where("ord = 1")).collect()}
    assert v["food"] == (-9.0, -90.0) and v["new"] == (7.0, None)


def test_enrichment(spark):
    df = spark.createDataFrame([("Milk 1.5l 3,5% fat", "food / dairy / milk", "Deep-Frozen"), ("ΓΑΛΑ 500g", "nonsense", "x")], "n string, p string, s string")
    rows = df.select(enrich.tidy_name(F.col("n")), enrich.valid_path(F.col("p")), enrich.clean_state(F.col("s")), enrich.unit_from_name(F.col("n"))).collect()
    assert tuple(rows[0][:3]) == ("milk fat", "food > dairy > milk", "frozen") and tuple(rows[0][3]) == (1.5, "l")
    assert rows[1][1] is None and tuple(rows[1][3]) == (500.0, "g")
    i = spark.createDataFrame([(1, "milk", "v", None, 0), (2, "tea", "v", None, 1), (3, "rye", None, "set", 0)], "id bigint, name string, vendor_key string, category string, mark int")
    got = {r.id: (r.category, r.mark) for r in enrich.enrich_with(i, "category", "mark", lambda names: [n.upper() for n in names]).collect()}
    assert got == {1: ("MILK", 1), 2: (None, 1), 3: ("set", 0)}


def test_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "id bigint, v string")
    assert sorted(tuple(r) for r in store.insert_or_ignore(t, new, ["id"]).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(tuple(r) for r in store.upsert(t, new.dropDuplicates(), ["id"]).collect()) == [(1, "a"), (2, "x"), (3, "c")]
    assert lists.table_stats(t=t).first().n == 2


def test_plan():
    ctx = {"currency": {"EUR"}}
    assert search_plan.validate({"filters": {"currency": "XXX"}}, ctx)["ungrounded"] == ["currency=XXX"]
    assert search_plan.lower({"limit": 9999})["limit"] == 200
    with pytest.raises(ValueError):
        search_plan.validate({"filters": {"drop table": 1}}, ctx)


def test_bank_files(spark, tmp_path):
    (tmp_path / "n26.csv").write_text('"Date","Payee","Account number","Transaction type","Payment reference","Amount (EUR)"\n"2024-01-05","Acme","","x","ref","-12.50"\n"bad","Foo","","x","ref","1"\n')
    (tmp_path / "rev.csv").write_text("Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance\nCARD,Cur,2024-01-01 10:00:00,2024-01-02 10:00:00,To Bob,-5.00,0,EUR,COMPLETED,1\nCARD,Cur,2024-01-01 10:00:00,,Pending,-5.00,0,EUR,PENDING,1\n")
    (tmp_path / "gen.csv").write_text('Datum,Details,Betrag\n05.01.2024,Kiosk,"3,20"\n')
    (tmp_path / "a.ofx").write_text("OFXHEADER:100\n<OFX><CURDEF>EUR<ACCTID>77<STMTTRN><DTPOSTED>20240105120000<TRNAMT>-9.99<NAME>Acme<MEMO>books</STMTTRN></OFX>")
    n26, rev, gen = (bank.read_csv(spark, str(tmp_path / f)) for f in ("n26.csv", "rev.csv", "gen.csv"))
    assert [(r.vendor, r.amount) for r in n26.collect()] == [("Acme", -12.5)]
    assert [(r.vendor, r.date) for r in rev.collect()] == [("Bob", D(2024, 1, 2))]
    assert [(r.date, r.amount) for r in gen.collect()] == [(D(2024, 1, 5), 3.2)]
    ofx = bank.read_ofx(spark, str(tmp_path / "a.ofx"))
    assert [(r.vendor, r.description, r.amount) for r in ofx.collect()] == [("Acme", "Acme - books", -9.99)]
    spark.dataSource.register(bank.OfxDataSource)
    assert spark.read.format("ofx").option("path", str(tmp_path / "a.ofx")).load().first().amount == "-9.99"
    first = bank.import_transactions(n26.unionByName(n26), n26.limit(0))
    assert [(r.total_amount, r.fact_type) for r in first.collect()] == [(12.5, "purchase")] and bank.import_transactions(n26, n26).count() == 0


def test_folders_and_exports(spark, tmp_path):
    (tmp_path / "receipts" / "CY" / "acme").mkdir(parents=True)
    (tmp_path / "receipts" / "CY" / "acme" / "x.txt").write_text("hello")
    r = files.scan_inbox(spark, str(tmp_path), content=True).first()
    assert (r.context.kind, r.context.country, r.context.vendor) == ("receipt", "CY", "acme") and len(r.file_hash) == 64
    df = spark.createDataFrame([(1, "a|b")], "id int, v string")
    assert files.render(df).splitlines()[-1] == "| 1 | a\\|b |" and "<td>1</td>" in files.render(df, "html")
    files.export_all(str(tmp_path / "out"), t=df)
    assert spark.read.csv(str(tmp_path / "out" / "t"), header=True).count() == 1


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    rows = [("a", "modified", dt.datetime(2024, 1, 1, 0, 0, 0), 5, None), ("a", "modified", dt.datetime(2024, 1, 1, 0, 0, 1), 7, None), ("b.yaml", "deleted", dt.datetime(2024, 1, 1, 0, 0, 1), 0, None), ("late", "modified", dt.datetime(2024, 1, 1, 1, 0, 0), 1, None)]
    schema = "path string, kind string, ts timestamp, size bigint, target string"
    spark.createDataFrame(rows, schema).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = streams.debounced(streams.route_events(stream).where("action = 'ingest'")).writeStream.outputMode("append").format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.path, r.size, r.touches) for r in spark.sql("select * from quiet").collect()] == [("a", 7, 2)]
    write = streams.upsert_batches(str(out), ["path"])
    df = spark.createDataFrame(rows[:2], schema)
    for epoch in (0, 0, 1):
        write(df, epoch)
    assert streams.current(spark, str(out), ["path"]).count() == 1


def test_cadence():
    c = streams.Cadence({"a": 6, "b": 72})
    state = c.ran({}, c.due({}, 0.0), 0.0)
    assert c.due(state, 7 * 3600) == ["a"]


def test_flush_by_count_or_time(spark, tmp_path):
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([("k", str(i)) for i in range(45)], "key string, id string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, id string").parquet(str(tmp_path / "in"))
    q = streams.flushed(stream, 20, 5).writeStream.outputMode("append").format("memory").queryName("flushes").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for _ in range(60):
            time.sleep(1)
            n = [r.n for r in spark.sql("select n from flushes").collect()]
            if sum(n) == 45:
                break
        assert n == [20, 20, 5]
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_clouds_with_unknown_dates_and_near_amounts(spark):
    """A bundle without a date meets its like; amounts 0.02 apart meet across any rounding edge; intermediaries meet by amount alone, others don't."""
    rows = [
        (1, "basket", "Alpha Shop", "V1", "alphashop", "10.00", "EUR", "2024-01-05"), (2, "payment_record", "Alpha Shop", "V1", "alphashop", "10.00", "EUR", None),
        (3, "basket", "Betamart one", None, "betamartone", "12.34", "EUR", "2024-01-05"), (4, "payment_record", "Betamart two", None, "betamarttwo", "12.36", "EUR", "2024-01-05"),
        (5, "basket", "Gamma", "V5", "gamma", "99.95", "EUR", "2024-02-01"), (6, "payment_record", "JCC PAYMENT SYSTEMS", None, "jcc", "99.97", "EUR", "2024-02-01"), (7, "basket", "Delta", "V7", "delta", "99.95", "EUR", "2024-02-01"),
    ]
    b = spark.createDataFrame(rows, "ord bigint, bundle_type string, vendor string, vendor_key string, slug string, amount string, currency string, event_date string")
    b = b.withColumn("amount", F.col("amount").cast("decimal(18,2)")).withColumn("event_date", F.col("event_date").cast("date")).withColumn("item_names", F.array().cast("array<string>"))
    pairs = {(r.a_ord, r.b_ord) for r in resolution.candidate_pairs(b).select("a_ord", "b_ord").collect()}
    assert {(1, 2), (3, 4), (5, 6), (6, 7)} <= pairs and (5, 7) not in pairs
    clouds = {r.ord: r.cloud for r in resolution.form_clouds(b).collect()}
    assert clouds[1] == clouds[2]


def test_places_reach_over_every_edge(spark):
    """Against the scan in order of id: at the meridian of London, the date line and a pole, with repeats and chains."""
    import math
    import random

    rng = random.Random(3)
    spots = [(51.5, 0.0), (0.5, 33.5), (-16.9, 180.0), (89.9995, 20.0)]
    rows = []
    for i in range(240):
        lat, lng = spots[i % 4]
        k = 1 / max(math.cos(math.radians(min(lat, 89.99))), 1e-3)
        lng = lng + rng.uniform(-0.004, 0.004) * k
        rows.append((i, min(90.0, lat + rng.uniform(-0.003, 0.003)), (lng + 180) % 360 - 180))
    rows += [(1000 + i, r[1], r[2]) for i, r in enumerate(rows[:40])]

    def far(a, b):
        (x, y), (u, v) = (map(math.radians, p) for p in (a, b))
        h = math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2
        return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    seeds, want = [], {}
    for i, lat, lng in sorted(rows):
        near = [s for s, p in seeds if far(p, (lat, lng)) <= 100]
        want[i] = near[0] if near else i
        if not near:
            seeds.append((i, (lat, lng)))
    points = spark.createDataFrame(rows, "id bigint, lat double, lng double")
    assert {r.id: r.place for r in stats.place_clusters(points).collect()} == want


def test_aliases_for_any_number(spark):
    from penstock.operators.privacy import letters

    def name(n):
        out = ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        return out

    ns = [0, 25, 26, 701, 702, 12_356_629, 12_356_630, 12_356_631, 10**9, 10**12]
    got = spark.createDataFrame([(n,) for n in ns], "n bigint").select("n", letters(F.col("n")).alias("a")).collect()
    assert {r.n: r.a for r in got} == {n: name(n) for n in ns}


def test_upsert_keeps_the_newest(spark, tmp_path):
    from penstock.streaming.streams import current, upsert_batches

    write = upsert_batches(str(tmp_path / "t"), ["id"], ["at"])
    write(spark.createDataFrame([(1, 5, "new"), (1, 3, "old"), (2, 1, "x")], "id int, at int, v string"), 0)
    assert {r.id: r.v for r in current(spark, str(tmp_path / "t"), ["id"]).collect()} == {1: "new", 2: "x"}
