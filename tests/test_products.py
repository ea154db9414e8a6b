"""What products say: categories, variants, attributes, contents, and texts that say nothing."""

import json

from penstock.operators import products

MILK = {"brands": "Alp , Other", "categories_tags": ["en:dairies", "en:whole-milk"], "labels_tags": ["en:EU-Organic", "en:whole-grain"], "quantity": "net 500 ml", "nutriments": {"fat_100g": 3.50}}
SCHEMA = "barcode string, brand string, category string, unit string, unit_quantity double, product string"


def said(spark, product, unit="pcs", quantity=None, history=None):
    items = spark.createDataFrame([("1", "own", "mine", unit, quantity, "clash")], SCHEMA)
    text = json.dumps(product) if isinstance(product, dict) else product
    known = spark.createDataFrame([("1", text), ("1", None), (None, text)], "barcode string, product string")
    r = products.from_products(items, known, history).collect()
    assert len(r) == 1 and r[0].product == "clash"
    return r[0]


def test_everything(spark):
    r = said(spark, MILK)
    assert (r.brand, r.category, r.variant, r.attributes, r.unit, r.unit_quantity, r.enrichment_confidence) == ("Alp", "Whole Milk", "3.5%", ["organic", "wholegrain"], "l", 0.5, 0.95)


def test_own_content_stays(spark):
    assert (said(spark, MILK, "kg").unit, said(spark, MILK, "kg").unit_quantity) == ("kg", None)
    assert said(spark, MILK, "pcs", 6.0).unit_quantity == 6.0


def test_categories_as_text_and_history(spark):
    past = spark.createDataFrame([("1", "kg", 2.0)], "barcode string, unit string, unit_quantity double")
    r = said(spark, {"categories": "Spreads, Nut spreads ", "quantity": "a box", "nutriments": {"fat_100g": "x"}}, None, None, past)
    assert (r.brand, r.category, r.variant, r.attributes, r.unit, r.unit_quantity) == ("own", "Nut spreads", None, [], "kg", 2.0)


def test_nothing_said(spark):
    for text in (None, "", "{", "[]", "{}"):
        r = said(spark, text)
        assert (r.brand, r.category, r.unit, r.unit_quantity, r.enrichment_source) == ("own", "mine", "pcs", None, None), text
