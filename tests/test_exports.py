"""Provenance of facts and the detailed report on odd rows."""

import json

from penstock.operators import spend
from penstock.sources import files


def test_provenance(spark):
    facts = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, None)], "id long, cloud_id long")
    bundles = spark.createDataFrame([(10, 7), (10, 5), (10, 6), (20, 8), (30, 9), (None, 5)], "cloud_id long, document_id long")
    documents = spark.createDataFrame([(5, None, "a"), (6, "mail", None), (7, "scan", "b"), (8, None, "c"), (9, "", "")], "id long, source string, user_id string")
    p = files.fact_provenance(facts, bundles, documents)
    assert sorted(tuple(r) for r in p.collect()) == [(1, "mail", None), (3, "", "")]
    items = spark.createDataFrame([(1, "x", "2", 3.0)], "fact_id long, name string, quantity string, total_price double")
    got = {r.id: json.loads(r.payload) for r in files.export_payload(facts, items, p).collect()}
    assert {k: (v["source"], v["user"]) for k, v in got.items()} == {1: ("mail", "system"), 2: ("cli", "system"), 3: ("cli", "system"), 4: ("cli", "system")}
    assert got[1]["items"] == [{"name": "x", "quantity": 2.0, "total_price": 3.0}]
    assert {json.loads(r.payload)["source"] for r in files.export_payload(facts, items).collect()} == {"cli"}


def test_detailed(spark):
    facts = spark.createDataFrame([(1, None, "purchase", 5.0, "2024-01-01"), (2, "a", "refund", 5.0, "2024-01-01"), (3, "a", "purchase", 2.0, "2024-01-02"), (4, "a", "purchase", 2.0, "2024-01-03")], "id long, vendor string, fact_type string, total_amount double, event_date string")
    items = spark.createDataFrame([(1, "x", None, 0.0, 1.005), (3, "y", "", None, None), (2, "z", "c", 1.0, 1.0)], "fact_id long, name string, category string, quantity double, total_price double")
    got = {tuple(r) for r in spend.detailed_form(facts, items, "2024-01-01", "2024-01-02").collect()}
    assert got == {("vendor", "Unknown", 5.0, 1), ("vendor", "a", 2.0, 1), ("category", "uncategorized", 1.005, 1), ("category", "", None, 1)}
    lines = sorted(tuple(r) for r in spend.detailed_lines(facts, items).collect())
    assert lines == [("uncategorized", 1, "x", 1.0, 1.01), ("uncategorized", 3, "y", 1.0, None)]
