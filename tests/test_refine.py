"""Records refined by type: every rule, absent and null fields, lines, transactions, totals."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from penstock.functions.barcodes import canonical_barcode
from penstock.operators import refine

SCHEMA = "id long, record_type string, raw map<string,string>, lines array<map<string,string>>, artifact_id string, confidence double, amount string"


def frame(spark, *rows):
    return spark.createDataFrame([(i, t, raw, lines, f"a{i}", 0.5, "another") for i, (t, raw, lines) in enumerate(rows)], SCHEMA)


def one(spark, kind, raw):
    return refine.refine_records(frame(spark, (kind, raw, None))).first()


RULES = [
    ("payment", {"vendor": "the corner  shop Ltd.", "amount": "$42.50", "transaction_date": "03/02/2024", "payment_method": "Debit Card", "card_last4": "4111 1111 1111 1234"}, {"vendor": "Corner Shop", "amount": Decimal("42.50"), "currency": "USD", "date": dt.date(2024, 2, 3), "payment_method": "card", "card_last4": "1234"}),
    ("payment", {"payment_method": "Voucher", "card_last4": "12a4", "amount": "n/a", "total": "7"}, {"payment_method": "voucher", "card_last4": None, "amount": Decimal(7), "currency": "EUR", "unread": []}),
    ("purchase", {"vendor_id": "CY1", "subtotal": "1.234,50", "currency": ""}, {"vendor_vat": "CY1", "subtotal": Decimal("1234.50"), "currency": "EUR", "amount": None}),
    ("invoice", {"vendor": "ACME inc", "issuer_id": "X", "issuer_registration": "Y", "invoice_id": "inv-#a7", "payment_due": "2024-05-01", "invoice_date": "30.04.2024"}, {"issuer": "Acme", "vendor": "ACME inc", "vendor_vat": "X", "invoice_number": "A7", "due_date": dt.date(2024, 5, 1), "date": dt.date(2024, 4, 30)}),
    ("invoice", {"issuer": "ACME inc", "invoice_number": None, "invoice_id": "7"}, {"vendor": "Acme", "invoice_number": None}),
    ("warranty", {"warranty_type": "2 years Extended", "product_name": " Mixer ", "warranty_expires": "2026-01-02", "issuer": "acme"}, {"warranty_type": "extended", "product": "Mixer", "date": dt.date(2026, 1, 2), "vendor": "Acme", "currency": None}),
    ("insurance", {"policy_id": "policy-#9 ", "coverage_type": " home", "premium_amount": "£12", "expiration_date": "2025-01-01", "provider": "acme"}, {"policy_number": "9", "coverage": "home", "premium": Decimal(12), "renewal_date": dt.date(2025, 1, 1), "issuer": "Acme", "currency": "EUR"}),
    ("statement", {"account": "CY12 3456-7890", "balance": "-5", "statement_period": "2024-01-01 to 2024-01-31"}, {"account_number": "CY******7890", "closing_balance": Decimal(-5), "period_start": dt.date(2024, 1, 1), "period_end": dt.date(2024, 1, 31)}),
    ("contract", {"payment_terms": "billed biweekly", "renewal": "Automatic", "customer": " B ", "start_date": "2024-01-01"}, {"payment_terms": "weekly", "renewal": "auto", "customer": "B", "date": dt.date(2024, 1, 1), "currency": None}),
    ("contract", {"payment_terms": " On Demand ", "date": None, "start_date": "2024-01-01"}, {"payment_terms": "On Demand", "date": None}),
    ("refund", {"amount": "10 GBP", "date": "soon", "vendor": "acme"}, {"amount": Decimal(10), "currency": "GBP", "date": None, "vendor": None, "unread": ["date"]}),
    (None, None, {"record_type": None, "amount": None, "currency": None, "unread": []}),
]


@pytest.fixture(scope="module")
def refined(spark):
    return {r.id: r.asDict() for r in refine.refine_records(frame(spark, *[(kind, raw, None) for kind, raw, _ in RULES])).collect()}


@pytest.mark.parametrize("k", range(len(RULES)))
def test_rules(refined, k):
    want = RULES[k][2]
    assert {n: refined[k][n] for n in want} == want


def test_provenance_and_other_columns(spark):
    got = one(spark, "payment", {})
    assert tuple(got.provenance) == ("ai_refinement", "a0", 0.5, refine.PROCESSOR) and got.amount is None
    assert refine.refine_records(frame(spark, ("payment", {}, None)).drop("artifact_id", "confidence")).first().provenance.source_id is None


LINES = [
    ({"name": "Red Bull 250ml", "price": "2"}, {"name": "Red Bull", "unit": "ml", "unit_quantity": 250.0, "unit_price": 2.0, "comparable_unit_price": 8.0, "comparable_unit": "l", "tax_type": "none"}),
    ({"description": "Avocado kg", "quantity": "0.5", "total": "3.00"}, {"name": "Avocado", "quantity": 1.0, "unit": "kg", "unit_quantity": 0.5, "comparable_unit_price": 6.0}),
    ({"item": "Rice 1000", "unit_price": "1.5", "quantity": "2"}, {"name": "Rice", "unit": "g", "unit_quantity": 1000.0, "total_price": 3.0, "comparable_unit_price": 1.5}),
    ({"name": "Rice 77"}, {"name": "Rice 77", "unit": "pcs", "unit_quantity": None, "total_price": None, "comparable_unit": None}),
    ({"name": "Juice 33cl", "unit_raw": "each", "quantity": "x"}, {"name": "Juice 33cl", "unit": "pcs", "quantity": 1.0}),
    ({"name": "Beef", "quantity": "0,76", "unit_raw": "kg", "unit_quantity": "1000", "price": "7.6"}, {"quantity": 1.0, "unit_quantity": 0.76, "comparable_unit_price": 10.0}),
    ({"name": "Beef", "quantity": "0.77kg", "unit_quantity": "0.77"}, {"quantity": 1.0, "unit_quantity": 0.77, "unit": "kg"}),
    ({"name": "500g", "tax_rate": "0.19"}, {"name": "", "tax_rate": 19.0, "tax_type": "vat"}),
    ({"name": "A", "tax_rate": "103", "tax_type": "Sales tax"}, {"tax_rate": 5.0, "tax_type": "sales_tax"}),
    ({"name": "A", "tax_rate": "104"}, {"tax_rate": None, "tax_type": "none"}),
    ({"name": "A", "tax_rate": "B", "tax_type": "odd"}, {"tax_rate": None, "tax_type": "none", "original_language": "el"}),
    ({"name": "A", "tax_rate": "0%", "barcode": "4006381333931"}, {"tax_rate": 0.0, "tax_type": "vat", "barcode": "4006381333931"}),
]


@pytest.fixture(scope="module")
def lines(spark):
    raw = {"raw_text": "103 5.00% 23.80\n103 6.00%\n103 5.00%", "language": "el"}
    return {r.id: r.asDict() for r in refine.refine_lines(frame(spark, *[("purchase", raw, [{"name": ""}, line]) for line, _ in LINES])).collect()}


@pytest.mark.parametrize("k", range(len(LINES)))
def test_lines(lines, k):
    want = LINES[k][1]
    assert {n: lines[k][n] for n in want} == want and lines[k]["line"] == 1 and lines[k]["currency"] == "EUR"


def test_shared_barcodes_and_kinds_without_lines(spark):
    code = "4006381333931"
    lines = [{"name": "A  b", "barcode": code}, {"name": "a B", "barcode": code}]
    got = refine.refine_lines(frame(spark, ("invoice", {}, lines), ("purchase", {}, [*lines, {"name": "c", "barcode": code}]), ("contract", {}, lines), ("purchase", None, None)))
    assert sorted((r.id, r.line, r.barcode) for r in got.collect()) == [(0, 0, code), (0, 1, code), (1, 0, None), (1, 1, None), (1, 2, None)]


def test_barcodes(spark):
    codes = ["4006381333931", "4006381333932", "96385074", "036000291452", "036000291453", " 4006-3813 33931", "", None, "x", "0"]
    got = spark.createDataFrame([(c,) for c in codes], "c string").select(canonical_barcode(F.col("c"))).collect()
    assert [r[0] for r in got] == ["4006381333931", None, "96385074", "0036000291452", None, "4006381333931", None, None, None, None]


def test_totals(spark):
    rows = frame(spark, ("purchase", {"amount": "10"}, [{"name": "a", "price": "9.95"}]), ("purchase", {"amount": "10"}, [{"name": "a", "price": "9.8"}, {"name": "b"}]), ("purchase", {"amount": "10"}, [{"name": "a"}]), ("invoice", {"amount": "1"}, [{"name": "a", "price": "5"}]), ("purchase", {"amount": "0"}, [{"name": "a"}]))
    got = refine.check_totals(refine.refine_records(rows), refine.refine_lines(rows))
    assert sorted((r.id, r.lines_total, r.agrees) for r in got.collect()) == [(0, 9.95, True), (1, 9.8, False), (2, 0.0, False)]


def test_transactions(spark):
    lines = [{"date": "2024-01-02", "amount": "-5", "merchant": " Shop ", "type": "DEBIT card", "reference": " r"}, {"amount": "5"}, {"transaction_date": "x", "amount": "5", "type": "Credit", "vendor": None, "merchant": "b"}, {"date": "2024-01-02", "amount": "five"}, {}]
    got = refine.refine_transactions(frame(spark, ("statement", {"currency": "$"}, lines), ("purchase", {}, lines))).orderBy("line").collect()
    assert [(r.id, r.line, r.transaction_date, r.amount, r.currency, r.vendor, r.type, r.reference) for r in got] == [(0, 0, dt.date(2024, 1, 2), Decimal(-5), "USD", "Shop", "expense", "r"), (0, 2, None, Decimal(5), "USD", None, "income", None)]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (refine.refine_records, refine.refine_lines, refine.refine_transactions):
        assert f(none).count() == 0
