"""Catalog, third part: records, and queries whose data make every step of an operator act."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, jurisdiction, quantities, vendors
from ..operators import enrich, privacy, records, resolution, search, spend, stars, stats
from ..sources import files
from . import catalog_entities as entities
from .catalog import facts, items, query, star

# Documents


def _documents(s, d):
    """Documents that came in with the orders: one each, made on the order's day."""
    return facts(s, d).select("id", F.col("event_date").alias("created_at"), "vendor")


@query("SELECT id, created_at, vendor FROM (SELECT id, event_date AS created_at, vendor FROM facts) WHERE created_at BETWEEN '1995-01-01' AND '1996-06-30' ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def list_documents(s, d):
    return records.list_documents(_documents(s, d), "1995-01-01", "1996-06-30", 100, 50)


@query("SELECT id, event_date AS created_at, vendor FROM facts WHERE id = 77")
def document_by_id(s, d):
    return records.document_by_id(_documents(s, d), 77)


# Filters and exports by a country that occurs


@query("SELECT strftime(event_date, '%Y-%m') AS month, brand, comparable_unit, {A:comparable_unit_price_eur} AS avg_price, min(comparable_unit_price_eur) AS min_price, max(comparable_unit_price_eur) AS max_price, count(*) AS n, count(DISTINCT vendor_key) AS n_vendors FROM item_stars WHERE comparable_unit_price_eur > 0 AND event_date >= DATE '1996-01-01' AND country = 'NATION_3' AND lower(name) LIKE '%a%' GROUP BY ALL")
def avg_price_by_month_of_a_country(s, d):
    return stars.avg_comparable_price(star(s, d), {"date_from": "1996-01-01", "country": "NATION_3", "name": "A"}, ["month", "brand"])


@query("SELECT fact_id, line, name, category, brand, quantity, unit, total_price, currency, vendor, vendor_key, event_date, country FROM item_stars WHERE country = 'NATION_3'")
def export_line_items_of_a_country(s, d):
    return files.export_line_items(star(s, d), {"country": "NATION_3"})


@query("SELECT fact_id, line, part_id, vendor, total_price_eur FROM (SELECT i.* REPLACE (CASE WHEN fact_id % 10 = 0 THEN 'renamed' ELSE vendor END AS vendor, CASE WHEN fact_id % 10 = 0 THEN 2 * total_price_eur ELSE total_price_eur END AS total_price_eur) FROM item_stars i)")
def refresh_changed_stars(s, d):
    """A tenth of the facts changes its vendor, and its items their price."""
    i, f = items(s, d), facts(s, d)
    new_f = f.withColumn("vendor", F.when(F.col("id") % 10 == 0, "renamed").otherwise(F.col("vendor")))
    new_i = i.withColumn("total_price", F.when(F.col("fact_id") % 10 == 0, 2 * F.col("total_price")).otherwise(F.col("total_price")))
    changed = f.where("id % 10 = 0").select(F.col("id").alias("fact_id"))
    return stars.refresh_stars(stars.rebuild_item_stars(i, f), new_i, new_f, changed).select("fact_id", "line", "part_id", "vendor", "total_price_eur")


# Enrichment


@query(
    "WITH g(first, last, country) AS (VALUES " + ", ".join(f"({a}, {b}, '{c}')" for a, b, c in enrich.GS1) + "), "
    "p AS (SELECT DISTINCT lpad(CAST(p_partkey * 7919 % 1000 AS VARCHAR), 3, '0') || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS barcode FROM part) "
    "SELECT barcode, country FROM p LEFT JOIN g ON CAST(substr(barcode, 1, 3) AS INT) BETWEEN first AND last"
)
def gs1_countries_of_all_prefixes(s, d):
    k = F.col("p_partkey")
    codes = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lpad((k * 7919 % 1000).cast("string"), 3, "0"), F.lpad(k.cast("string"), 10, "0")).alias("barcode")).distinct()
    return enrich.gs1_country(s, codes)


@query("SELECT fact_id, line, part_id, CASE WHEN unit = 'g' THEN 'kg' ELSE unit END AS unit, round(CAST(CAST(total_price AS DECIMAL(18,4)) AS DOUBLE) * CASE WHEN unit = 'g' THEN 1000 ELSE 1 END / (quantity * unit_quantity) + 0.0003, 1) AS about FROM fact_items WHERE unit_quantity >= 5 OR unit <> 'g'")
def comparable_price_values(s, d):
    c = enrich.comparable_price(F.col("total_price"), F.col("quantity"), F.col("unit_quantity"), F.col("unit"))
    per = F.col("total_price").cast("decimal(18,4)") * F.when(F.col("unit") == "g", 1000).otherwise(1) / (F.col("quantity") * F.col("unit_quantity")).cast("decimal(18,4)")
    close = F.abs(F.col("c.price") - per.cast("double")) <= 0.0051
    about = F.when(close, F.round(F.col("total_price").cast("decimal(18,4)").cast("double") * F.when(F.col("unit") == "g", 1000).otherwise(1) / (F.col("quantity") * F.col("unit_quantity")) + 0.0003, 1))
    return items(s, d).select("*", c.alias("c")).where("c.price is not null").select("fact_id", "line", "part_id", F.col("c.unit").alias("unit"), about.alias("about"))


@query("""WITH i AS (SELECT DISTINCT part_id AS id, part_id // 4 AS barcode, CASE WHEN part_id % 4 = 1 THEN brand END AS brand, CASE WHEN part_id % 4 = 2 THEN category END AS category FROM fact_items),
b AS (SELECT barcode, arg_max((brand, category), ((brand IS NOT NULL)::INT * 2 + (category IS NOT NULL)::INT * 2, id)) AS t FROM i GROUP BY 1)
SELECT id, coalesce(brand, t[1]) AS brand, coalesce(category, t[2]) AS category FROM i JOIN b USING (barcode)""")
def barcode_siblings(s, d):
    """Four parts to a barcode; one knows the brand, another the category."""
    k = F.col("part_id") % 4
    i = items(s, d).select(F.col("part_id").alias("id"), F.floor(F.col("part_id") / 4).alias("barcode"), F.when(k == 1, F.col("brand")).alias("brand"), F.when(k == 2, F.col("category")).alias("category")).distinct()
    return enrich.barcode_propagation(i.withColumn("variant", F.lit(None).cast("string")).withColumn("enrichment_confidence", F.lit(0.0))).select("id", "brand", "category")


@query("SELECT DISTINCT part_id, CASE WHEN part_id % 6 IN (0, 1, 2, 3) THEN 'food > beverages > coffee_tea' END AS category FROM fact_items")
def drink_categories(s, d):
    words = F.element_at(F.array(*[F.lit(w) for w in (" espresso", " Green TEA", " καφές", " кофе", " teapot", " steak")]), (F.col("part_id") % 6 + 1).cast("int"))
    return items(s, d).select("part_id", enrich.keyword_category(F.concat("name", words)).alias("category")).distinct()


@query("SELECT DISTINCT part_id, ['kg', 'g', 'l', 'ml', 'pcs', 'other'][part_id % 6 + 1] AS unit FROM fact_items")
def unit_spellings(s, d):
    raw = F.element_at(F.array(*[F.lit(w) for w in ("Kg.", " GR ", "lt", "ml,", "x3", "furlong")]), (F.col("part_id") % 6 + 1).cast("int"))
    return items(s, d).select("part_id", quantities.normalize_unit(raw).alias("unit")).distinct()


@query("SELECT DISTINCT vendor_key, 'firm' || vendor_key || 'gamma' AS slug FROM facts")
def slugs_of_written_forms(s, d):
    """Capitals, points, a Greek letter and a legal form around the same name."""
    k = F.col("vendor_key").cast("long") % 4
    name = F.when(k == 0, F.concat(F.lit("FIRM-"), "vendor_key", F.lit(" GAMMA"))).when(k == 1, F.concat(F.lit("Firm "), "vendor_key", F.lit(" Gamma Ltd."))).when(k == 2, F.concat(F.lit("  firm."), "vendor_key", F.lit(".γamma, LTD"))).otherwise(F.concat(F.lit("(Firm) "), "vendor_key", F.lit(" gamma")))
    return facts(s, d).select("vendor_key", vendors.slug(name).alias("slug")).distinct()


@query("SELECT DISTINCT name || ' 500g x2 3,5%' AS raw, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS tidy FROM fact_items")
def tidy_names_by_rule(s, d):
    return entities.tidy_names(s, d)


@query("""SELECT DISTINCT part_id AS id, CASE part_id % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'l' WHEN 2 THEN 'pcs' ELSE unit END AS unit, CAST(CASE part_id % 5 WHEN 0 THEN 250 WHEN 1 THEN 1.5 WHEN 2 THEN 6 ELSE unit_quantity END AS DOUBLE) AS unit_quantity FROM fact_items""")
def written_sizes(s, d):
    """Sizes from outside: three that can be used, one unit and one number that can't."""
    p = items(s, d).select(F.col("part_id").alias("id"), "unit", F.col("unit_quantity").cast("double").alias("unit_quantity")).distinct().withColumn("total_price", F.lit(9.0)).withColumn("quantity", F.lit(1.0)).withColumn("comparable_unit_price", F.lit(None).cast("double")).withColumn("comparable_unit", F.lit(None).cast("string"))
    k = (F.col("id") % 5 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), k)
    return records.write_sizes(p, p.select("id", pick("gr", "LT", "pcs", "furlong", "kg").alias("unit"), pick("250", "1,5", "6", "3", "-2").alias("quantity"))).select("id", "unit", "unit_quantity")


@query("SELECT DISTINCT part_id AS id, CASE WHEN part_id % 3 = 0 THEN 'pcs' ELSE unit END AS unit, CAST(CASE WHEN part_id % 3 = 0 THEN round(12.0 / (2 + part_id % 4), 2) END AS DOUBLE) AS price, CASE WHEN part_id % 2 = 0 THEN 'XL' END AS variant FROM fact_items")
def written_attributes(s, d):
    p = items(s, d).select(F.col("part_id").alias("id"), "unit").distinct().withColumns({"unit_quantity": F.lit(None).cast("double"), "total_price": F.lit(12.0), "quantity": F.lit(1.0), "comparable_unit_price": F.lit(None).cast("double"), "comparable_unit": F.lit(None).cast("string"), "variant": F.lit(None).cast("string"), "attributes": F.lit(None).cast("map<string,string>")})
    found = p.select("id", F.when(F.col("id") % 2 == 0, F.create_map(F.lit("size"), F.lit("XL"))).alias("attributes"), F.when(F.col("id") % 3 == 0, 2 + F.col("id") % 4).alias("pack"))
    return records.write_attributes(p, found).select("id", "unit", F.col("comparable_unit_price").alias("price"), "variant")


# Privacy

_ALIAS = "CASE WHEN k < 26 THEN chr(CAST(65 + k AS INT)) WHEN k < 702 THEN chr(CAST(64 + k // 26 AS INT)) || chr(CAST(65 + k % 26 AS INT)) ELSE chr(CAST(64 + (k - 26) // 676 AS INT)) || chr(CAST(65 + (k - 26) // 26 % 26 AS INT)) || chr(CAST(65 + k % 26 AS INT)) END"
_NUMBERED = "WITH n AS (SELECT vendor, row_number() OVER (ORDER BY o) - 1 AS k FROM (SELECT vendor, min((event_date, id)) AS o FROM facts GROUP BY 1))"


@query(f"{_NUMBERED} SELECT id, 'Merchant_' || {_ALIAS} AS vendor, CASE WHEN total_amount < 10 THEN '0-10' WHEN total_amount < 50 THEN '10-50' WHEN total_amount < 100 THEN '50-100' WHEN total_amount < 500 THEN '100-500' WHEN total_amount < 1000 THEN '500-1000' ELSE '1000+' END AS amount_range, event_date, fact_type FROM facts JOIN n USING (vendor)")
def masked_facts(s, d):
    return privacy.mask_for_model(facts(s, d))[0]


@query(f"{_NUMBERED} SELECT id, 'VENDOR_' || {_ALIAS} AS vendor, CAST(round(total_amount * 4, 1) AS DOUBLE) AS about, event_date + 17 AS event_date FROM facts JOIN n USING (vendor)")
def pseudonymised_facts(s, d):
    return privacy.pseudonymise(facts(s, d), 4.0, 17)[0].select("id", "vendor", F.round("total_amount", 1).alias("about"), "event_date")


# Clouds


@query("SELECT id * 2 + k AS ord, id * 2 AS cloud FROM facts, (VALUES (0), (1)) v(k)")
def clouds_of_orders(s, d):
    """The basket and the slip of an order are one cloud, and no two orders are."""
    return resolution.form_clouds(entities._noisy_bundles(s, d))


@query("SELECT id * 2 AS cloud, vendor, CAST(total_amount AS DECIMAL(18,2)) AS total_amount, event_date, currency, 2::BIGINT AS n, CAST(0.9 AS DOUBLE) AS confidence, 'confirmed' AS status, 'purchase' AS fact_type FROM facts")
def collapsed_facts(s, d):
    return entities.collapse_facts(s, d).select("cloud", "vendor", "total_amount", "event_date", "currency", "n", F.col("confidence").cast("double").alias("confidence"), "status", "fact_type")


@query("""WITH f AS (SELECT id, vendor_key, currency, date_trunc('month', event_date) AS m, floor(total_amount / 20000) AS t, (SELECT count(*) FROM fact_items WHERE fact_id = id) AS n FROM facts),
k AS (SELECT vendor_key, currency, m, t, min((-n, id)) AS top, count(*) AS c FROM f GROUP BY ALL HAVING c > 1),
p AS (SELECT top[2] AS keeper, f.id AS other, -top[1] AS kn, f.n AS n FROM f JOIN k USING (vendor_key, currency, m, t) WHERE f.id <> top[2]),
x AS (SELECT keeper, other, round(CAST(total_price AS DECIMAL(24,6)), 2) AS v, count(*) AS c FROM p JOIN fact_items ON fact_id = keeper GROUP BY ALL), y AS (SELECT keeper, other, round(CAST(total_price AS DECIMAL(24,6)), 2) AS v, count(*) AS c FROM p JOIN fact_items ON fact_id = other GROUP BY ALL),
o AS (SELECT keeper, other, sum(least(coalesce(x.c, 0), coalesce(y.c, 0))) / sum(greatest(coalesce(x.c, 0), coalesce(y.c, 0))) AS r FROM x FULL JOIN y USING (keeper, other, v) GROUP BY ALL)
SELECT keeper, other, CASE WHEN n = 0 OR kn = 0 THEN 'merge_no_items' WHEN bit_count(xor(keeper, other)) <= 6 THEN 'merge_photo' WHEN r >= 0.5 THEN 'merge_prices' ELSE 'review' END AS verdict FROM p LEFT JOIN o USING (keeper, other)""")
def duplicate_verdicts(s, d):
    return entities.duplicate_facts(s, d).select("keeper", "other", "verdict")


@query("SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS \"group\" FROM orders")
def photos_of_customers(s, d):
    """The photos of a customer differ in two bits at most."""
    return entities.duplicate_photos(s, d).select("id", "group")


@query("SELECT id AS q, CAST(vendor_key AS BIGINT) AS identity, 'name' AS matched_by FROM facts")
def identities_by_name(s, d):
    return entities.identity_lookup(s, d)


@query("""WITH t AS (SELECT id, vendor, event_date AS date, total_amount AS amount FROM facts) SELECT id * 10 + 1 AS id, id * 10 AS original, CAST(0.95 AS DOUBLE) AS similarity FROM t WHERE id % 3 = 0""")
def content_duplicate_documents(s, d):
    """Each document comes again: within the hour, two hours later, or of another kind."""
    f = facts(s, d).select((F.col("id") * 10).alias("id"), "vendor", F.col("event_date").alias("date"), F.col("total_amount").alias("amount"), F.lit("receipt").alias("kind"), F.lit(600).alias("minute"))
    k = F.floor(F.col("id") / 10) % 3
    new = f.withColumn("kind", F.when(k == 2, "invoice").otherwise(F.col("kind"))).withColumn("minute", F.when(k == 0, 630).otherwise(720)).withColumn("vendor", F.upper("vendor")).withColumn("id", F.col("id") + 1)
    return records.content_duplicates(new, f)


@query("SELECT o_orderkey AS id, bit_count(o_orderkey % 65536) AS distance FROM orders WHERE bit_count(o_orderkey % 65536) <= 3")
def images_near_one(s, d):
    p = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.lpad(F.hex(F.col("o_orderkey") % 65536), 16, "0").alias("phash"))
    return records.similar_images(p, "0" * 16, 3).select("id", F.col("distance").cast("int").alias("distance"))


@query("SELECT id * 2 AS bundle_id FROM facts UNION ALL SELECT id * 2 + 1 FROM facts WHERE id % 3 = 1")
def selected_baskets(s, d):
    """Each order is a cloud of two baskets: the second shows the same prices (a double), other prices and another total (kept), or other prices under the same total (a double by its signature). The first adds up to its total."""
    f = facts(s, d).select("id", F.col("total_amount").cast("decimal(24,2)").alias("total"), F.col("event_date").alias("date"), F.lit("shop").alias("slug"))
    k = F.col("id") % 3
    a = f.select(F.col("id").alias("cloud"), (F.col("id") * 2).alias("bundle_id"), "slug", "total", "date")
    b = f.select(F.col("id").alias("cloud"), (F.col("id") * 2 + 1).alias("bundle_id"), F.concat("slug", F.lit("central")).alias("slug"), F.when(k == 1, F.col("total") * 3).otherwise(F.col("total")).cast("decimal(24,2)").alias("total"), F.when(k == 2, F.lit(None).cast("date")).otherwise(F.col("date")).alias("date"))
    prices = f.select("id", F.explode(F.array(F.col("total") - 1, F.lit(1).cast("decimal(24,2)"))).alias("price"))
    other = f.where("id % 3 > 0").select((F.col("id") * 2 + 1).alias("bundle_id"), F.explode(F.array(F.col("total") + 5, F.col("total") + 6, F.col("total") + 7)).alias("price"))
    own = prices.select((F.col("id") * 2).alias("bundle_id"), "price").unionByName(prices.where("id % 3 = 0").select((F.col("id") * 2 + 1).alias("bundle_id"), "price")).unionByName(other)
    return records.select_baskets(a.unionByName(b), own).select("bundle_id")


# Identities


def _members(s, d):
    """Identities of every second customer by key and name, and of every third part by barcode and name."""
    f = facts(s, d).where("cast(vendor_key as long) % 2 = 0").select("vendor_key", "vendor").distinct()
    i = items(s, d).where("part_id % 3 = 0").select("part_id", "barcode", "name").distinct()
    key = F.concat(F.lit("v"), "vendor_key")
    part = F.concat(F.lit("p"), F.col("part_id").cast("string"))
    m = f.select(key.alias("identity"), F.lit("vendor_key").alias("member_type"), F.col("vendor_key").alias("value")).unionByName(f.select(key.alias("identity"), F.lit("name").alias("member_type"), F.col("vendor").alias("value")))
    return m.unionByName(i.where("barcode is not null").select(part.alias("identity"), F.lit("barcode").alias("member_type"), F.col("barcode").alias("value")))


@query("SELECT id AS fact_id, 'vendor' AS kind, 'v' || vendor_key AS identity FROM facts WHERE CAST(vendor_key AS BIGINT) % 2 = 0 UNION SELECT fact_id, 'item', 'p' || part_id FROM fact_items WHERE part_id % 3 = 0 AND barcode IS NOT NULL")
def identities_of_facts(s, d):
    return records.fact_identities(facts(s, d), items(s, d), _members(s, d))


@query("SELECT DISTINCT vendor_key AS value, CASE WHEN CAST(vendor_key AS BIGINT) % 2 = 0 THEN 'v' || vendor_key ELSE 'vendor_key:' || vendor_key END AS identity FROM facts")
def ensured_identities(s, d):
    found = facts(s, d).select(F.lit("vendor_key").alias("member_type"), F.col("vendor_key").alias("value"))
    return records.ensure_identities(found, _members(s, d)).where("member_type = 'vendor_key'").select("value", "identity")


@query("WITH m AS (SELECT DISTINCT 'v' || vendor_key AS identity, vendor AS value FROM facts WHERE CAST(vendor_key AS BIGINT) % 2 = 0) SELECT identity, value FROM m UNION SELECT identity, value || ' new' FROM m")
def taught_names(s, d):
    m = _members(s, d).where("member_type = 'name'")
    return records.taught_identities(m, m.select("identity", F.concat("value", F.lit(" new")).alias("vendor"))).select("identity", "value")


@query("SELECT DISTINCT vendor_key, CASE WHEN CAST(vendor_key AS BIGINT) % 2 = 0 THEN vendor ELSE vendor_key END AS name FROM facts")
def vendor_display_names(s, d):
    m = _members(s, d)
    names = m.where("member_type = 'name'").select("identity", F.col("value").alias("canonical"))
    return records.vendor_display(facts(s, d).select("vendor_key").distinct(), m, names)


@query("SELECT DISTINCT vendor, CASE WHEN vendor LIKE '%7' THEN 'sevens' ELSE 'all' END AS matched, CAST(CASE WHEN vendor LIKE '%7' THEN 0.9 ELSE 0.5 END AS DOUBLE) AS score FROM facts")
def vendor_patterns(s, d):
    p = s.createDataFrame([("7$", "sevens", 0.9), ("^customer", "all", 0.5), ("nothing like it", "none", 1.0)], "pattern string, name string, confidence double")
    return records.match_vendor_patterns(facts(s, d), p)


# Corrections


def _corrections(s, d):
    """A correction of every seventh cloud, every third of them a false positive."""
    return facts(s, d).where("id % 7 = 0").select(F.col("id").alias("cloud_id"), F.col("event_date").alias("created"), (F.col("id") % 3 == 0).alias("was_false_positive"), "vendor_key")


@query("SELECT count(*) AS clouds, count(*) FILTER (id % 7 = 0) AS corrections, round(1 - count(*) FILTER (id % 7 = 0) / count(*), 6) AS accuracy, round(count(*) FILTER (id % 21 = 0) / count(*) FILTER (id % 7 = 0), 6) AS false_positive_rate FROM facts")
def cloud_quality_report(s, d):
    return records.quality_report(facts(s, d).select("cloud_id"), _corrections(s, d))


@query("SELECT strftime(event_date, '%Y-%m') AS period, count(*) FILTER (id % 7 = 0) AS corrections, count(*) FILTER (id % 21 = 0) AS false_positives, count(*) FILTER (id % 7 = 0 AND id % 3 > 0) AS merges, count(*) AS facts, round(count(*) FILTER (id % 7 = 0) / count(*), 3) AS rate FROM facts GROUP BY 1 HAVING corrections > 0 ORDER BY 1 DESC LIMIT 12")
def correction_trends(s, d):
    return records.correction_trend(_corrections(s, d), facts(s, d).select(F.col("event_date").alias("created")))


@query("SELECT vendor_key, count(*) AS facts, count(*) FILTER (id % 7 = 0) AS corrected, round(count(*) FILTER (id % 7 = 0) / count(*), 6) AS rate FROM facts WHERE event_date >= DATE '1998-06-30' - 900 GROUP BY 1")
def vendor_correction_rates(s, d):
    f = facts(s, d).select("id", "vendor_key", F.col("event_date").alias("created"))
    return records.correction_rates(f, _corrections(s, d).select(F.col("cloud_id").alias("fact_id"), "created"), "1998-06-30", 900)


@query("""WITH c AS (SELECT category AS usual, brand AS other, count(*) AS n FROM fact_items GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 10), v AS (SELECT vendor_key, count(*) AS n FROM facts WHERE id % 7 = 0 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5)
SELECT 'category_confusion' AS type, CASE WHEN n >= 5 THEN 'high' ELSE 'medium' END AS priority, usual || ' / ' || other AS subject, n FROM c UNION ALL SELECT 'vendor_corrections', CASE WHEN n >= 10 THEN 'high' ELSE 'medium' END, vendor_key, n FROM v UNION ALL SELECT DISTINCT 'refinement_candidate', 'medium', category, 0 FROM fact_items""")
def refinement_suggestions(s, d):
    c = items(s, d).groupBy(F.col("category").alias("usual"), F.col("brand").alias("other")).agg(F.count("*").alias("n"))
    v = _corrections(s, d).groupBy("vendor_key").agg(F.count("*").alias("n"))
    return records.refinement_suggestions(c, v, items(s, d).select("category").distinct())


@query("SELECT CAST(CAST(vendor_key AS BIGINT) % 5 AS VARCHAR) AS pos_provider, count(*) AS n, count(DISTINCT vendor_key) AS vendors, round(count(*) FILTER (id % 3 = 0) / count(*), 6) AS false_positive_rate FROM facts WHERE id % 7 = 0 GROUP BY 1")
def pooled_corrections(s, d):
    v = facts(s, d).select("vendor_key", (F.col("vendor_key").cast("long") % 5).cast("string").alias("pos_provider")).distinct()
    return records.pooled_corrections(_corrections(s, d), v)


@query("WITH e AS (SELECT vendor_key, CASE WHEN id % 2 = 0 THEN 'vendor' ELSE 'total' END AS field, count(*) AS fixes FROM facts WHERE id % 3 = 0 GROUP BY ALL), n AS (SELECT vendor_key, count(*) AS k FROM facts GROUP BY 1) SELECT vendor_key, field, fixes, sum(fixes) OVER (PARTITION BY vendor_key) / k > 0.3 AS stale FROM e JOIN n USING (vendor_key)")
def template_reliability(s, d):
    e = facts(s, d).where("id % 3 = 0").select(F.col("id").alias("fact_id"), F.when(F.col("id") % 2 == 0, "vendor").otherwise("total").alias("field"))
    return records.template_reliability(facts(s, d), e)


@query("SELECT fact_id * 100 + line AS id, min(part_id) AS part_id FROM item_stars WHERE vendor_key = (SELECT min(vendor_key) FROM facts) AND part_id % 4 <> 0 GROUP BY ALL")
def audit_candidates(s, d):
    key = facts(s, d).agg(F.min("vendor_key").alias("k"))
    own = star(s, d).join(F.broadcast(key), F.col("vendor_key") == F.col("k"))
    x = own.select((F.col("fact_id") * 100 + F.col("line")).alias("id"), "part_id", F.lit("one").alias("vendor"), "event_date", F.when(F.col("part_id") % 4 == 0, "user_confirmed").otherwise("rule").alias("enrichment_source"), "comparable_name", "category")
    return records.audit_candidates(x, 1_000_000, "one").groupBy("id").agg(F.min("part_id").alias("part_id"))


@query("SELECT DISTINCT part_id AS id, CASE WHEN part_id % 2 = 0 AND part_id % 4 <> 0 THEN 'audited' ELSE category END AS category FROM fact_items")
def applied_audit(s, d):
    i = items(s, d).select(F.col("part_id").alias("id"), "comparable_name", "category").distinct().withColumn("enrichment_source", F.when(F.col("id") % 4 == 0, "user_confirmed"))
    found = i.where("id % 2 = 0").select("id", F.lit(None).cast("string").alias("comparable_name"), F.lit("audited").alias("category"))
    return records.apply_audit(i, found).select("id", "category")


@query("WITH c AS (SELECT id, count(fact_id) AS n_items, round(id % 97, 2) AS p FROM facts LEFT JOIN fact_items ON fact_id = id GROUP BY id) SELECT id, CAST(p AS DOUBLE) AS coverage_pct FROM c WHERE p < 92 AND n_items > 0 ORDER BY p, id LIMIT 25")
def reextract_queue(s, d):
    n = items(s, d).groupBy("fact_id").agg(F.count("*").alias("n_items"))
    c = facts(s, d).join(n, F.col("id") == F.col("fact_id"), "left").select("id", F.coalesce("n_items", F.lit(0)).alias("n_items"), (F.col("id") % 97).cast("double").alias("coverage_pct"))
    return records.reextract_queue(c, "partial", 25).select("id", "coverage_pct")


# Items and budgets


@query("SELECT DISTINCT part_id AS id, CASE WHEN part_id % 3 = 0 THEN ['color:red', 'state:' || coalesce(state, 'none')] ELSE [] END AS annotated FROM fact_items")
def annotated_products(s, d):
    i = items(s, d).select(F.col("part_id").alias("id"), "state").distinct()
    a = i.where("id % 3 = 0")
    notes = a.select(F.col("id").alias("target_id"), F.lit("color").alias("key"), F.lit("red").alias("value")).unionByName(a.select(F.col("id").alias("target_id"), F.lit("state").alias("key"), F.coalesce("state", F.lit("none")).alias("value")))
    return records.product_annotations(i.select("id"), notes)


@query("""WITH p AS (SELECT category, brand AS attribute, part_id % 11 AS premium, part_id % 7 AS percent, count(*) AS o, max(part_id % 5 + 1) AS b FROM fact_items GROUP BY category, brand, part_id)
SELECT category, attribute, round(sum(premium * o) / sum(o), 4) AS premium, round(sum(percent * o) / sum(o), 4) AS percent, CAST(sum(o) AS BIGINT) AS observations, CAST(sum(b) AS BIGINT) AS baseline, round(least(1.0, sum(o) * sum(b) / (sum(o) + sum(b)) / 5), 4) AS confidence FROM p GROUP BY ALL""")
def category_price_factors(s, d):
    f = items(s, d).groupBy("category", F.col("brand").alias("attribute"), "part_id").agg(F.count("*").alias("observations")).withColumns({"premium": F.col("part_id") % 11, "percent": F.col("part_id") % 7, "baseline": F.col("part_id") % 5 + 1})
    return records.category_price_factors(f)


@query("SELECT part_id AS id, barcode, CASE WHEN barcode IS NOT NULL THEN '{\"kcal\":' || part_id % 500 || '}' END AS data FROM (SELECT DISTINCT part_id, barcode FROM fact_items) WHERE part_id = 12")
def nutrition_of_an_item(s, d):
    i = items(s, d).select(F.col("part_id").alias("id"), "barcode").distinct()
    p = i.where("barcode is not null").select("barcode", F.concat(F.lit('{"kcal":'), (F.col("id") % 500).cast("string"), F.lit("}")).alias("data"))
    return records.item_nutrition(i, p, 12)


_ENTRIES = "SELECT DISTINCT CAST(vendor_key AS BIGINT) % 3 AS scenario, strftime(event_date, '%Y-%m') AS period, country AS category, 100.0 + month(event_date) AS amount FROM facts"


def _entries(s, d):
    return facts(s, d).select((F.col("vendor_key").cast("long") % 3).alias("scenario"), F.date_format("event_date", "yyyy-MM").alias("period"), F.col("country").alias("category"), (100 + F.month("event_date")).cast("double").alias("amount")).distinct()


@query(f"SELECT period, category, CAST(amount AS DOUBLE) AS amount FROM ({_ENTRIES}) WHERE scenario = 1 AND period = '1996-03'")
def scenario_entries(s, d):
    return records.scenario_entries(_entries(s, d), 1, "1996-03").select("period", "category", "amount")


@query(f"SELECT scenario, period, category, CAST(CASE WHEN scenario = 2 THEN 1 ELSE amount END AS DOUBLE) AS amount FROM ({_ENTRIES}) WHERE scenario > 0")
def edited_scenarios(s, d):
    """Scenario 0 is deleted, the entries of scenario 2 are replaced."""
    e, key = _entries(s, d), ["scenario", "period", "category"]
    return records.delete_rows(records.add_rows(e, e.where("scenario = 2").withColumn("amount", F.lit(1.0)), key), e.where("scenario = 0"), key)


@query("WITH e AS (SELECT country AS category, strftime(event_date, '%Y') AS period, {S:total_amount} AS a FROM facts GROUP BY ALL), b AS (SELECT category, period, CASE WHEN category = 'NATION_3' THEN 0 ELSE 1000 END AS base, a FROM e) SELECT category, period, round(a - base, 2) AS difference, CASE WHEN base <> 0 THEN CAST(round_even(CAST((a - base) / base * 100 AS DECIMAL(18,6)), 2) AS DOUBLE) END AS percent FROM b")
def variance_with_percent(s, d):
    a = facts(s, d).select(F.col("country").alias("category"), F.date_format("event_date", "yyyy").alias("period"), F.col("total_amount").alias("amount"))
    base = a.select("category", "period").distinct().withColumn("amount", F.when(F.col("category") == "NATION_3", 0.0).otherwise(1000.0))
    return spend.variance(base, a).select("category", "period", F.round("difference", 2).alias("difference"), "percent")


@query("SELECT category, count(*) AS n, {S:total_price} AS value, CAST(max(fact_id % 1000) AS BIGINT) AS last_warranty FROM fact_items GROUP BY 1")
def owned_items_value(s, d):
    return records.owned_value(items(s, d).select("category", F.col("total_price").alias("price"), (F.col("fact_id") % 1000).alias("warranty_until")))


@query("SELECT vendor_key, id FROM (SELECT vendor_key, id, row_number() OVER (PARTITION BY vendor_key ORDER BY event_date DESC, id DESC) AS r FROM facts) WHERE r <= 3")
def newest_versions(s, d):
    return records.newest_versions(facts(s, d).select("vendor_key", "id", "event_date"), ["vendor_key"], ["event_date", "id"], 3).select("vendor_key", "id")


# Search


@query("""WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, round(1 / (1 + round(sqrt(list_sum(list_transform(embedding, lambda v: (CAST(v AS DOUBLE) - 0.1) * (CAST(v AS DOUBLE) - 0.1)))), 6)), 6) AS score, vec_id FROM embeddings), t AS (SELECT * FROM v ORDER BY score DESC, vec_id LIMIT 10)
SELECT id, score FROM t""")
def vector_scores(s, d):
    v = search.vector_search(entities._vectors(s, d), entities._Q, 10)
    return v.select(F.col("vec_id").cast("string").alias("id"), F.col("similarity").alias("score"))


@query("SELECT fact_id, CAST(count(*) AS BIGINT) AS n, true AS reconciled FROM fact_items GROUP BY 1")
def reconciled_facts(s, d):
    """Lines that already add up to the printed total are reconciled, none is lost."""
    return entities.reconcile_lines(s, d).groupBy("fact_id").agg(F.count("*").alias("n"), F.bool_and("reconciled").alias("reconciled"))


# Jurisdictions and fields

#: What is printed, the currency read from it, and the country and currency it tells.
_PRINTED = (
    ("Atatürk Cad., Lefkoşa", "TOPLAM 250 TL 7,00 EUR", "EUR", "CY-NORTH", "TRY"),
    ("12 King St, Toronto", "Total $ 12.00 HST", "$", "CA", "CAD"),
    ("Bar", "Canada Dry 2.00 EUR", "EUR", None, "EUR"),
    ("Bar", "Made in Canada $ 4", "USD", "CA", "CAD"),
    ("Graz", "ATU12345678 3,00", None, "AT", "EUR"),
    ("Кафе", "Оплата 300 руб", "EUR", "RU", "RUB"),
    ("Кафе", "Основной зал 3.00 eur", "RUB", None, "EUR"),
    ("Κεντρική οδός", "Σύνολο 5,00", "USD", "CY", "EUR"),
    ("Shop", "F.P.A 19% FPA", None, "CY", "EUR"),
    ("Shop", "Toplam 90 TL", None, "TR", "TRY"),
    ("Moscow", "Total 3.00 €", None, "RU", "EUR"),
    ("Shop", "Total 9.00", "£", None, "GBP"),
    ("Shop", "GST 2 guests", " ", None, " "),
    (None, None, None, None, None),
)


def _sql_text(x):
    return "NULL::VARCHAR" if x is None else f"'{x}'"


@query("WITH c(k, country, currency) AS (VALUES " + ", ".join(f"({k}, {_sql_text(c)}, {_sql_text(m)})" for k, (_, _, _, c, m) in enumerate(_PRINTED)) + f") SELECT id, c.country, c.currency FROM facts JOIN c ON k = id % {len(_PRINTED)}")
def jurisdictions(s, d):
    """Every order comes with one of the printed texts."""
    at = (F.col("id") % len(_PRINTED) + 1).cast("int")
    pick = lambda j: F.element_at(F.array(*[F.lit(p[j]).cast("string") for p in _PRINTED]), at)
    docs = facts(s, d).select("id", pick(0).alias("vendor_address"), pick(1).alias("raw_text"), pick(2).alias("currency"))
    return jurisdiction.apply_jurisdiction(docs).select("id", "country", "currency")


#: A field's name and value, and its type.
_FIELDS = (("is_paid", "7", "boolean"), ("Verified", None, "boolean"), ("event-date", "x", "date"), ("tax rate", "5", "percentage"), ("unit_price", "5", "currency"), ("net_weight", "5", "weight"), ("volume", "5", "volume"), ("kwh", "5", "energy"), ("height", "5", "distance"), ("opening hours", "5", "duration"), ("area", "5", "area"), ("qty", "5", "count"), ("x", "Yes", "boolean"), ("x", "2024-05-01", "date"), ("x", "5 %", "percentage"), (None, "€ 5", "currency"), ("", "-5.5", "number"), ("x", "five", "text"), ("x", None, "text"))


@query("WITH c(k, type) AS (VALUES " + ", ".join(f"({k}, '{t}')" for k, (_, _, t) in enumerate(_FIELDS)) + f") SELECT id, type FROM facts JOIN c ON k = id % {len(_FIELDS)}")
def field_types(s, d):
    at = (F.col("id") % len(_FIELDS) + 1).cast("int")
    pick = lambda j: F.element_at(F.array(*[F.lit(f[j]).cast("string") for f in _FIELDS]), at)
    return facts(s, d).select("id", fields.field_type(pick(0), pick(1)).alias("type"))


_SIDE = "SELECT vendor_key, round(total_price / 1000, 0) AS p, count(*) AS n FROM item_stars WHERE fact_type {} 'purchase' GROUP BY ALL"


@query(f"WITH x AS ({_SIDE.format('=')}), y AS ({_SIDE.format('<>')}) SELECT vendor_key, round(CAST(sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) AS DOUBLE) / sum(greatest(coalesce(x.n, 0), coalesce(y.n, 0))), 4) AS overlap FROM x FULL JOIN y USING (vendor_key, p) GROUP BY 1")
def price_overlap_of_purchases(s, d):
    """What vendors ask in purchases against what they ask in all other facts: every line is on one side."""
    i = star(s, d).select("vendor_key", F.round(F.col("total_price") / 1000, 0).alias("price"), "fact_type")
    return resolution.price_overlap(i.where("fact_type = 'purchase'"), i.where("fact_type <> 'purchase'"), ["vendor_key"])
