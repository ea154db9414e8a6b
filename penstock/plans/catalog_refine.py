"""Catalog, sixth part: records refined by type and items completed from products. Raw texts are written from the tables, in several spellings; the SQL gives what they must be read as."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import products, refine, spend
from ..sources import files
from .catalog import facts, items, query

_KINDS = ("payment", "purchase", "invoice", "warranty", "insurance", "statement", "contract", "refund")
_ALIAS = {"payment": "transaction_date", "invoice": "invoice_date", "insurance": "policy_date", "warranty": "warranty_expires", "contract": "start_date"}


def _lines(s, d):
    """One array of raw lines for each fact, in no particular order: lines are told apart by their values."""
    i = items(s, d).join(facts(s, d).select(F.col("id").alias("fact_id"), "event_date", "vendor"), "fact_id")
    p, tail = F.col("part_id"), F.element_at(F.array(F.lit(" 250ml"), F.lit(" 500"), F.lit(""), F.lit(" kg")), (F.col("part_id") % 4 + 1).cast("int"))
    price = F.concat(F.floor("total_price").cast("string"), F.lit(".50"))
    pairs = {
        "name": F.concat("name", tail), "quantity": F.col("quantity").cast("int").cast("string"), "price": price, "unit_raw": F.when(p % 4 == 2, F.col("unit")), "unit_quantity": F.when(p % 4 == 2, F.col("unit_quantity").cast("string")),
        "tax_rate": F.element_at(F.array(F.lit("19%"), F.lit("0.05"), F.lit("103")), (p % 3 + 1).cast("int")), "barcode": F.lpad((p - p % 20).cast("string"), 13, "0"),
        "date": F.when(p % 7 > 0, F.date_format("event_date", "dd.MM.yyyy")), "amount": F.concat(F.lit("-"), price), "merchant": F.concat(F.lit(" "), "vendor"), "type": F.when(p % 2 == 0, "DEBIT").otherwise("Credit note"),
    }
    line = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return i.groupBy("fact_id").agg(F.collect_list(line).alias("lines"))


def _records(s, d, lines=False):
    f = facts(s, d)
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("id") % 8 + 1).cast("int"))
    k, odd, plain = F.col("id") % 5, F.floor(F.col("id") / 8) % 2 == 1, F.format_string("%.2f", "total_amount")
    day = F.when(F.col("id") % 3 == 0, F.date_format("event_date", "yyyy-MM-dd")).when(F.col("id") % 3 == 1, F.date_format("event_date", "dd/MM/yyyy")).otherwise(F.date_format("event_date", "dd.MM.yyyy"))
    is_ = lambda t: F.col("kind") == t
    us = F.format_number("total_amount", 2)
    fields = {
        "amount": F.when(k == 0, us).when(k == 1, F.concat(F.lit("$"), plain)).when(k == 2, F.concat(plain, F.lit(" GBP"))).when(k == 3, F.concat(F.translate(us, ",.", ".,"), F.lit(" €"))).otherwise("n/a"),
        "total": F.when(k == 4, plain), "currency": F.when(k == 0, F.col("currency")),
        "vendor": F.when(~odd, F.concat(F.lit("the "), "vendor", F.lit(" Ltd."))), "issuer": F.when(odd, F.concat(F.lit("the "), "vendor", F.lit(" Ltd."))),
        "date": F.when(~odd, day), "document_date": F.when(odd & ~F.col("kind").isin(*_ALIAS), day), **{a: F.when(odd & is_(t), day) for t, a in _ALIAS.items()},
        "statement_period": F.when(~odd & is_("statement"), F.concat(F.date_format("event_date", "yyyy-MM-dd"), F.lit(" to "), F.date_format(F.date_add("event_date", 30), "yyyy-MM-dd"))),
        "invoice_number": F.when(is_("invoice"), F.concat(F.lit("inv-#"), F.col("id").cast("string"))), "policy_id": F.when(is_("insurance"), F.concat(F.lit("pol-"), F.col("id").cast("string"))),
        "account": F.when(is_("statement"), F.lpad("vendor_key", 12, "7")), "premium_amount": F.when(is_("insurance"), plain),
        "payment_method": F.when(is_("payment"), F.when(odd, "Debit Card").otherwise("Voucher")), "payment_terms": F.when(is_("contract"), F.when(odd, "billed Yearly").otherwise("on demand")),
        "renewal": F.when(is_("contract"), "Automatic"), "warranty_type": F.when(is_("warranty"), "Extended, 2 years"), "raw_text": F.lit("103 5.00% 23.80 1.19 24.99"),
    }
    raw = F.map_filter(F.create_map(*[x for n, v in fields.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    r = f.withColumn("kind", kind).select("id", F.col("kind").alias("record_type"), raw.alias("raw"))
    return r.join(_lines(s, d), F.col("id") == F.col("fact_id")).drop("fact_id") if lines else r


_TYPED = f"""r AS (SELECT *, (ARRAY{list(_KINDS)})[CAST(id % 8 + 1 AS INT)] AS kind, id % 5 AS k, (id // 8) % 2 = 1 AS odd FROM facts),
t AS (SELECT id, kind, odd, vendor, vendor_key, event_date, total_amount, CASE k WHEN 0 THEN currency WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE CASE WHEN kind IN ('payment', 'purchase', 'invoice', 'insurance', 'statement') THEN 'EUR' END END AS money FROM r)"""
#: The tail of a name and what it means: content and unit of the line.
_READ = """l AS (SELECT i.*, t.kind, t.money, t.event_date, t.vendor, floor(i.total_price) + 0.5 AS total, lpad(CAST(part_id - part_id % 20 AS VARCHAR), 13, '0') AS code,
  CASE part_id % 4 WHEN 0 THEN 'ml' WHEN 1 THEN 'g' WHEN 2 THEN i.unit ELSE 'kg' END AS u, CASE part_id % 4 WHEN 0 THEN 250.0 WHEN 1 THEN 500.0 WHEN 2 THEN CAST(unit_quantity AS DOUBLE) END AS c
  FROM fact_items i JOIN t ON fact_id = t.id)"""


@query(f"""WITH {_TYPED} SELECT id, kind AS record_type, round(total_amount, 2) AS amount, money AS currency,
CASE WHEN NOT odd OR kind IN ('payment', 'invoice', 'insurance', 'warranty', 'contract') THEN event_date END AS date, CASE WHEN odd AND kind IN ('purchase', 'statement', 'refund') THEN event_date END AS document_date,
CASE WHEN kind = 'invoice' AND NOT odd THEN 'the ' || vendor || ' Ltd.' WHEN kind IN ('invoice', 'warranty', 'contract') OR kind IN ('payment', 'purchase') AND NOT odd THEN vendor END AS vendor,
CASE WHEN kind IN ('invoice', 'insurance') OR kind = 'statement' AND odd THEN vendor END AS issuer,
CASE WHEN kind = 'invoice' THEN CAST(id AS VARCHAR) END AS invoice_number, CASE WHEN kind = 'insurance' THEN CAST(id AS VARCHAR) END AS policy_number, CASE WHEN kind = 'insurance' THEN round(total_amount, 2) END AS premium,
CASE WHEN kind = 'statement' THEN left(lpad(vendor_key, 12, '7'), 2) || '******' || right(lpad(vendor_key, 12, '7'), 4) END AS account_number,
CASE WHEN kind = 'payment' THEN CASE WHEN odd THEN 'card' ELSE 'voucher' END END AS payment_method, CASE WHEN kind = 'contract' THEN CASE WHEN odd THEN 'annual' ELSE 'on demand' END END AS payment_terms,
CASE WHEN kind = 'contract' THEN 'auto' END AS renewal, CASE WHEN kind = 'warranty' THEN 'extended' END AS warranty_type,
CASE WHEN kind = 'statement' AND NOT odd THEN event_date END AS period_start, CASE WHEN kind = 'statement' AND NOT odd THEN CAST(event_date + INTERVAL 30 DAY AS DATE) END AS period_end, 0 AS n_unread FROM t""")
def refined_records(s, d):
    r = refine.refine_records(_records(s, d))
    money = {c: F.col(c).cast("double") for c in ("amount", "premium")}
    return r.withColumns(money).select("id", "record_type", "amount", "currency", "date", "document_date", "vendor", "issuer", "invoice_number", "policy_number", "premium", "account_number", "payment_method", "payment_terms", "renewal", "warranty_type", "period_start", "period_end", F.size("unread").alias("n_unread"))


@query(f"""WITH {_TYPED}, {_READ}, v AS (SELECT *, list_sum(list_transform(range(1, 14), lambda i: CAST(substr(code, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 AS valid FROM l WHERE kind IN ('purchase', 'invoice')),
m AS (SELECT fact_id AS f, code AS x FROM v GROUP BY ALL HAVING min(lower(name)) <> max(lower(name))),
p AS (SELECT *, CASE u WHEN 'g' THEN 1000 WHEN 'ml' THEN 1000 ELSE 1 END AS per, CAST(round(total * per / (CAST(floor(quantity) AS DOUBLE) * coalesce(c, 1.0)) * 1e8) AS HUGEINT) AS x8 FROM v LEFT JOIN m ON f = fact_id AND x = code)
SELECT fact_id AS id, name, CAST(floor(quantity) AS DOUBLE) AS quantity, u AS unit, c AS unit_quantity, total AS total_price, total / CAST(floor(quantity) AS DOUBLE) AS unit_price, money AS currency,
CASE part_id % 3 WHEN 0 THEN 19.0 WHEN 1 THEN 5.0 ELSE CASE WHEN kind = 'purchase' THEN 5.0 END END AS tax_rate, CASE WHEN part_id % 3 = 2 AND kind = 'invoice' THEN 'none' ELSE 'vat' END AS tax_type,
CAST(x8 // 1000000 + CASE WHEN x8 % 1000000 > 500000 OR x8 % 1000000 = 500000 AND (x8 // 1000000) % 2 = 1 THEN 1 ELSE 0 END AS DOUBLE) / 100 AS comparable_unit_price, CASE u WHEN 'g' THEN 'kg' WHEN 'ml' THEN 'l' ELSE u END AS comparable_unit,
CASE WHEN valid AND x IS NULL THEN code END AS barcode FROM p""")
def refined_lines(s, d):
    return refine.refine_lines(_records(s, d, lines=True)).select("id", "name", "quantity", "unit", "unit_quantity", "total_price", "unit_price", "currency", "tax_rate", "tax_type", "comparable_unit_price", "comparable_unit", "barcode")


@query(f"WITH {_TYPED}, {_READ} SELECT id, round(any_value(total_amount), 2) AS amount, CAST(sum(CAST(total AS DECIMAL(24,6))) AS DOUBLE) AS lines_total, abs(round(any_value(total_amount), 2) - CAST(sum(CAST(total AS DECIMAL(24,6))) AS DOUBLE)) <= abs(round(any_value(total_amount), 2)) * 0.01 AS agrees FROM t JOIN l ON l.fact_id = id WHERE t.kind = 'purchase' AND total_amount <> 0 GROUP BY 1")
def refined_totals(s, d):
    r = _records(s, d, lines=True)
    return refine.check_totals(refine.refine_records(r), refine.refine_lines(r))


@query(f"WITH {_TYPED}, {_READ} SELECT fact_id AS id, event_date AS transaction_date, -total AS amount, money AS currency, vendor, CASE WHEN part_id % 2 = 0 THEN 'expense' ELSE 'income' END AS type FROM l WHERE kind = 'statement' AND part_id % 7 > 0")
def refined_transactions(s, d):
    return refine.refine_transactions(_records(s, d, lines=True)).select("id", "transaction_date", F.col("amount").cast("double").alias("amount"), "currency", "vendor", "type")


# Items completed from products: what the cache says of a part is written as JSON


def _products(s, d):
    size, word = F.col("p_size"), F.lower("p_type")
    tags = F.when(size % 5 > 0, F.array_compact(F.array(F.when(size % 4 == 0, "en:milk"), F.concat(F.lit("en:"), word), F.concat(F.lit("en:"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))))))
    labels = F.array_compact(F.array(F.when(size % 2 == 0, "en:EU-Organic"), F.when(size % 3 == 0, "en:gluten-free")))
    content = F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit(" g"))).when(size % 3 == 1, F.concat(size.cast("string"), F.lit(",5cl")))
    fat = F.struct(F.format_string("%d.%d0", F.floor(size / 10), size % 10).alias("fat_100g"))
    p = F.struct(F.concat("p_brand", F.lit(", Other")).alias("brands"), F.concat(F.lit("All, "), "p_type").alias("categories"), tags.alias("categories_tags"), labels.alias("labels_tags"), content.alias("quantity"), fat.alias("nutriments"))
    return s.read.parquet(f"{d}/part.parquet").select(F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("barcode"), F.to_json(p).alias("product"))


@query("""WITH c AS (SELECT *, barcode IS NOT NULL AS known FROM fact_items JOIN part ON part_id = p_partkey)
SELECT fact_id, line, part_id, CASE WHEN known THEN p_brand END AS brand,
CASE WHEN NOT known THEN 'none' WHEN p_size % 5 = 0 THEN p_type ELSE array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS category,
CASE WHEN known AND p_size % 4 = 0 AND p_size % 5 > 0 THEN CAST(p_size // 10 AS VARCHAR) || CASE WHEN p_size % 10 > 0 THEN '.' || CAST(p_size % 10 AS VARCHAR) ELSE '' END || '%' END AS variant,
CASE WHEN known THEN concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'organic' END, CASE WHEN p_size % 3 = 0 THEN 'gluten-free' END) END AS attributes,
CASE WHEN unit = 'pcs' AND known AND p_size % 3 = 0 THEN 'kg' WHEN unit = 'pcs' AND known AND p_size % 3 = 1 THEN 'l' ELSE unit END AS unit,
CASE WHEN unit <> 'pcs' THEN CAST(p_size AS DOUBLE) WHEN known AND p_size % 3 = 0 THEN round(p_size * 0.001, 9) WHEN known AND p_size % 3 = 1 THEN round((p_size + 0.5) * 0.01, 9) END AS unit_quantity,
CASE WHEN known THEN 'product_cache' END AS enrichment_source FROM c""")
def items_from_products(s, d):
    i = items(s, d).withColumns({"brand": F.lit(None).cast("string"), "category": F.lit("none"), "unit_quantity": F.when(F.col("unit") != "pcs", F.col("unit_quantity"))})
    return products.from_products(i, _products(s, d)).select("fact_id", "line", "part_id", "brand", "category", "variant", F.array_join("attributes", ",").alias("attributes"), "unit", "unit_quantity", "enrichment_source")


# The detailed report and exports with the documents behind each fact


@query("""WITH f AS (SELECT * FROM facts WHERE fact_type IN ('purchase', 'subscription_payment') AND event_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31')
SELECT 'vendor' AS section, coalesce(vendor, 'Unknown') AS name, {S:total_amount} AS total, count(*) AS n FROM f GROUP BY 2
UNION ALL SELECT 'category', coalesce(category, 'uncategorized'), {S:total_price}, count(*) FROM fact_items JOIN f ON fact_id = id GROUP BY 2""")
def distribution_detailed(s, d):
    return spend.detailed_form(facts(s, d), items(s, d), "1995-01-01", "1996-12-31")


@query("SELECT coalesce(nullif(state, ''), 'uncategorized') AS category, fact_id, name, CAST(quantity AS DOUBLE) AS quantity, CAST(round(CAST(total_price + 3e-10 AS DECIMAL(24,6)), 2) AS DOUBLE) AS total_price FROM fact_items JOIN facts ON fact_id = id WHERE fact_type IN ('purchase', 'subscription_payment')")
def distribution_lines(s, d):
    return spend.detailed_lines(facts(s, d), items(s, d).withColumn("category", F.col("state")))


def _provenance(s, d):
    """Every document of the corpus stands for a scanned one; three clouds share it, and one in four clouds has two."""
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("user_id"))
    f = facts(s, d)
    bundles = f.select("cloud_id", F.floor(F.col("id") / 3).alias("document_id")).unionByName(f.where("id % 4 = 0").select("cloud_id", F.floor(F.col("id") / 4).alias("document_id")))
    return files.fact_provenance(f, bundles, docs)


_BEHIND = """d AS (SELECT doc_id, source AS s, CASE WHEN doc_id % 3 > 0 THEN lang END AS u FROM documents WHERE doc_id % 7 > 0 AND source IS NOT NULL),
b AS (SELECT cloud_id, id // 3 AS doc_id FROM facts UNION ALL SELECT cloud_id, id // 4 FROM facts WHERE id % 4 = 0),
p AS (SELECT cloud_id, s, u FROM b JOIN d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY doc_id, s, u) = 1)"""


@query(f"WITH {_BEHIND} SELECT id, coalesce(nullif(s, ''), 'cli') AS source, coalesce(nullif(u, ''), 'system') AS user FROM facts LEFT JOIN p USING (cloud_id)")
def facts_with_provenance(s, d):
    return files.with_provenance(facts(s, d), _provenance(s, d)).select("id", "source", "user")


@query(f"WITH {_BEHIND}, i AS (SELECT fact_id, count(*) AS n, {{S:total_price}} AS total FROM fact_items GROUP BY 1) SELECT id, vendor, coalesce(nullif(s, ''), 'cli') AS source, coalesce(nullif(u, ''), 'system') AS user, coalesce(n, 0) AS n_items, total FROM facts LEFT JOIN p USING (cloud_id) LEFT JOIN i ON fact_id = id")
def payloads_with_provenance(s, d):
    """The payloads, read back from their JSON."""
    from ..functions.money import money_sum

    p = files.export_payload(facts(s, d), items(s, d), _provenance(s, d)).select("id", F.from_json("payload", "vendor string, source string, user string, items array<struct<total_price: double>>").alias("p"))
    sums = p.select("id", F.explode("p.items.total_price").alias("x")).groupBy("id").agg(money_sum("x").alias("total"))
    return p.join(sums, "id", "left").select("id", "p.vendor", "p.source", "p.user", F.when(F.col("p.items").isNull(), 0).otherwise(F.size("p.items")).cast("long").alias("n_items"), "total")
