"""Catalog, second part: lists, search, entity resolution, enrichment, privacy, predictions, writes, functions, batch forms of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, geo, language, quantities, vendors
from ..functions.money import money_sum
from ..functions.similarity import seq_ratio
from ..operators import enrich, graph, lists, predict, privacy, resolution, search, stats, store
from ..sources import adapter, files
from . import search_plan
from .catalog import AS_OF, SPENT, facts, items, query, star
from ..streaming import streams

# Lists


@query("SELECT 'facts' AS \"table\", count(*) AS n FROM facts UNION ALL SELECT 'fact_items', count(*) FROM fact_items UNION ALL SELECT 'documents', count(*) FROM documents")
def table_stats(s, d):
    return lists.table_stats(facts=facts(s, d), fact_items=items(s, d), documents=s.read.parquet(f"{d}/documents.parquet"))


@query("SELECT p.*, coalesce((SELECT count(*) FROM fact_items WHERE fact_id = p.id), 0) AS n_items FROM (SELECT id, vendor, event_date, total_amount FROM facts WHERE currency = 'EUR' ORDER BY event_date DESC, id LIMIT 50 OFFSET 20) p")
def list_facts(s, d):
    return lists.list_facts(facts(s, d), items(s, d), {"currency": "EUR"}, 20, 50).select("id", "vendor", "event_date", "total_amount", "n_items")


@query("SELECT count(*) AS n FROM facts WHERE total_amount >= 1000 AND event_date >= '1996-01-01' AND lower(vendor) LIKE '%9%'")
def count_facts(s, d):
    return lists.count_facts(facts(s, d), {"amount_min": 1000, "date_from": "1996-01-01", "vendor": "9"})


@query("SELECT fact_id, line, part_id, total_price FROM fact_items WHERE (lower(name) LIKE '%old%' OR lower(brand) LIKE '%old%') AND fact_id IN (SELECT id FROM facts WHERE event_date >= '1997-01-01')")
def list_fact_items(s, d):
    return lists.list_items(items(s, d), facts(s, d), "OLD", date_from="1997-01-01").select("fact_id", "line", "part_id", "total_price")


@query("SELECT count(*) AS n, {S:total_price} AS total FROM item_stars WHERE lower(vendor) LIKE '%1%' AND total_price BETWEEN 100 AND 20000 AND event_date <= '1997-06-30'")
def items_with_fact(s, d):
    return lists.items_with_fact(star(s, d), {"vendor": "1", "price_min": 100, "price_max": 20000, "date_to": "1997-06-30"}).agg(F.count("*").alias("n"), money_sum("total_price").alias("total"))


@query("SELECT fact_id, line, part_id FROM fact_items WHERE state IS NULL OR state = ''")
def uncategorised_items(s, d):
    return lists.uncategorised(items(s, d).drop("category").withColumnRenamed("state", "category")).select("fact_id", "line", "part_id")


_BUNDLES = "SELECT id * 2 + k AS bundle_id, id % 500 AS document_id, cloud_id FROM facts, (VALUES (0), (1)) v(k) WHERE (id + k) % 3 > 0"


def _bundles(s, d):
    return facts(s, d).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where("(id + k) % 3 > 0").select((F.col("id") * 2 + F.col("k")).alias("bundle_id"), (F.col("id") % 500).alias("document_id"), "cloud_id")


@query(f"WITH b AS ({_BUNDLES}) SELECT DISTINCT document_id, id AS fact_id FROM b JOIN facts USING (cloud_id)")
def document_facts(s, d):
    return lists.document_facts(_bundles(s, d), facts(s, d))


@query(f"WITH b AS ({_BUNDLES}) SELECT document_id, min(id) AS fact_id FROM b JOIN facts USING (cloud_id) GROUP BY 1")
def primary_facts(s, d):
    return lists.primary_facts(_bundles(s, d), facts(s, d))


@query(f"WITH b AS ({_BUNDLES}) SELECT document_id, count(*) AS n, {{S:total_price}} AS total FROM b JOIN facts f USING (cloud_id) JOIN fact_items ON fact_id = f.id GROUP BY 1")
def document_line_items(s, d):
    b = _bundles(s, d)
    return lists.document_items(b.select("document_id").distinct(), b, facts(s, d), items(s, d)).groupBy("document_id").agg(F.count("*").alias("n"), money_sum("total_price").alias("total"))


@query(f"WITH b AS ({_BUNDLES}) SELECT cloud_id, coalesce(n, 0) AS n_bundles FROM facts LEFT JOIN (SELECT cloud_id, count(*) AS n FROM b GROUP BY 1) USING (cloud_id)")
def list_clouds(s, d):
    return lists.list_clouds(facts(s, d).select("cloud_id"), _bundles(s, d))


@query(f"SELECT id, vendor, event_date FROM facts WHERE event_date > DATE '{AS_OF}' - 30 AND event_date <= DATE '{AS_OF}'")
def recent_transactions(s, d):
    return lists.recent_transactions(facts(s, d), AS_OF).select("id", "vendor", "event_date")


@query("SELECT country AS vendor_key, currency AS url, max(event_date) AS created_at, arg_max(vendor, (event_date, vendor)) AS place_name FROM facts GROUP BY ALL ORDER BY created_at DESC, 1, 2 LIMIT 20")
def recent_vendor_locations(s, d):
    return lists.recent_locations(facts(s, d).select(F.col("country").alias("vendor_key"), F.col("currency").alias("url"), F.col("event_date").alias("created_at"), F.col("vendor").alias("place_name")))


@query("SELECT id, id % 100 / 100.0 AS enrichment_confidence FROM facts WHERE id % 100 < 80 ORDER BY 2, 1 LIMIT 50")
def review_queue(s, d):
    return lists.review_queue(facts(s, d).select("id", F.lit("x").alias("enrichment_source"), (F.col("id") % 100 / 100).alias("enrichment_confidence"))).drop("enrichment_source")


# Search


@query("SELECT id, vendor FROM facts WHERE lower(vendor) LIKE '%77%' OR id IN (SELECT fact_id FROM fact_items WHERE lower(name) LIKE '%77%')")
def search_facts(s, d):
    return search.search_facts(facts(s, d), items(s, d), "77").select("id", "vendor")


@query("""WITH a AS (SELECT 'fact' AS kind, CAST(id AS VARCHAR) AS id, vendor AS label, 0.8 AS score FROM facts WHERE lower(vendor) LIKE '%old%' ORDER BY score DESC, id LIMIT 10),
b AS (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, source AS label, CASE WHEN lower(source) LIKE '%old%' THEN 0.7 ELSE 0.5 END AS score FROM documents WHERE lower(source) LIKE '%old%' OR lower(text) LIKE '%old%' ORDER BY score DESC, id LIMIT 10),
i AS (SELECT name, brand, category, min(fact_id) AS f FROM fact_items GROUP BY ALL), c AS (SELECT 'item' AS kind, CAST(f AS VARCHAR) AS id, name AS label, CASE WHEN lower(name) LIKE '%old%' THEN 0.75 WHEN lower(brand) LIKE '%old%' THEN 0.65 ELSE 0.55 END AS score FROM i WHERE lower(name) LIKE '%old%' OR lower(brand) LIKE '%old%' OR lower(category) LIKE '%old%' ORDER BY score DESC, id LIMIT 10)
SELECT kind, id, CAST(score AS DOUBLE) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) ORDER BY score DESC, kind, id LIMIT 10""")
def sql_search(s, d):
    return search.sql_search(facts(s, d), s.read.parquet(f"{d}/documents.parquet"), items(s, d), "old").select("kind", "id", "score")


def _vectors(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet")


_Q = [0.1] * 64


@query("WITH x AS (SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda v: (CAST(v AS DOUBLE) - 0.1) * (CAST(v AS DOUBLE) - 0.1)))), 6) AS distance FROM embeddings) SELECT vec_id, label, distance, round(1 / (1 + distance), 6) AS similarity FROM x ORDER BY distance, vec_id LIMIT 10")
def vector_search(s, d):
    return search.vector_search(_vectors(s, d), _Q, 10)


def _hashed_words(text):
    """A deterministic embedding: words of the text by 16 hash classes."""
    words = F.split(F.lower(text), r"\s+")
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.size(F.filter(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(16)) == k)).cast("double"))


@query()
def entity_embeddings(s, d):
    return search.encode_entities(facts(s, d), s.read.parquet(f"{d}/documents.parquet"), items(s, d), _hashed_words).select("entity", "kind", "embedding")


@query()
def hybrid_search(s, d):
    v = search.vector_search(_vectors(s, d), _Q, 10).select(F.col("vec_id").cast("string").alias("id"), F.col("similarity").alias("score"))
    t = search.sql_search(facts(s, d), s.read.parquet(f"{d}/documents.parquet"), items(s, d), "old").select("id", "score")
    return search.hybrid(v, t)


@query("SELECT DISTINCT name, unnest(string_split(lower(name), ' ')) AS token FROM fact_items")
def product_postings(s, d):
    return search.postings(items(s, d))


@query()
def product_candidates(s, d):
    q = items(s, d).select(F.col("name").alias("text")).distinct().withColumn("q", F.crc32(F.col("text").cast("binary")))
    return search.fts_candidates(search.postings(items(s, d)), q)


@query()
def product_resolve(s, d):
    cat = star(s, d).groupBy("name", "vendor_key").agg(F.min("brand").alias("brand"), F.min("category").alias("category"), F.max("fact_id").alias("ord"))
    q = items(s, d).select("name").distinct().select(F.crc32(F.col("name").cast("binary")).alias("q"), F.concat("name", F.lit("s")).alias("name"), F.lit("50").alias("vendor_key"))
    return search.resolve_products(q, cat)


@query("SELECT * FROM (SELECT DISTINCT 'category' AS facet, category AS value FROM item_stars UNION ALL SELECT DISTINCT 'currency', currency FROM item_stars UNION ALL SELECT DISTINCT 'country', country FROM item_stars UNION ALL SELECT DISTINCT 'brand', brand FROM item_stars UNION ALL SELECT DISTINCT 'fact_type', fact_type FROM item_stars)")
def search_context(s, d):
    return search.search_context(star(s, d))


@query("WITH p AS (SELECT * FROM facts WHERE currency = 'USD' ORDER BY event_date DESC, id LIMIT 200) SELECT id, event_date FROM p WHERE id IN (SELECT fact_id FROM fact_items WHERE category = 'LARGE') ORDER BY event_date DESC, id LIMIT 60")
def search_plan_execution(s, d):
    plan = search_plan.validate({"version": "0.1", "filters": {"currency": "USD", "category": "LARGE"}, "limit": 60}, {"currency": {"USD"}})
    return search_plan.execute(plan, facts(s, d), items(s, d)).select("id", "event_date")


@query("SELECT comparable_name, category, count(DISTINCT vendor_key) AS vendors FROM item_stars GROUP BY ALL HAVING vendors >= 2 ORDER BY vendors DESC, 1, 2 LIMIT 200")
def cross_vendor_products(s, d):
    return search.cross_vendor_products(star(s, d))


@query()
def name_merge_clusters(s, d):
    v = _vectors(s, d).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("unit"), F.concat(F.lit("name "), "vec_id").alias("name"), F.lit(1).alias("n"), "embedding")
    return search.name_merges(v, 0.5)


# Entity resolution


def _noisy_bundles(s, d):
    """Two bundles of each order of the first customers: the basket, and a slip with a day's delay and a rewritten vendor."""
    f = facts(s, d)
    a = f.select((F.col("id") * 2).alias("ord"), F.lit("basket").alias("bundle_type"), "vendor", "vendor_key", F.col("total_amount").cast("decimal(18,2)").alias("amount"), "currency", "event_date")
    b = f.select((F.col("id") * 2 + 1).alias("ord"), F.lit("payment_record").alias("bundle_type"), F.upper(F.concat("vendor", F.lit(" LTD"))).alias("vendor"), "vendor_key", F.col("total_amount").cast("decimal(18,2)").alias("amount"), "currency", F.date_add("event_date", F.when(F.col("id") % 2 == 0, 1).otherwise(0)).alias("event_date"))
    return a.unionByName(b).withColumn("slug", vendors.slug("vendor")).withColumn("item_names", F.array().cast("array<string>"))


@query()
def cloud_formation(s, d):
    return resolution.form_clouds(_noisy_bundles(s, d))


@query("SELECT id * 2 AS ord, id * 2 + 1 AS other, CAST(0.9 - CASE WHEN id % 2 = 0 THEN 0.1 ELSE 0 END AS DOUBLE) AS score FROM facts", "pair_scores_of_orders")
def pair_scores(s, d):
    p = resolution.score_pairs(resolution.candidate_pairs(_noisy_bundles(s, d)))
    return p.where("b = a + 1 and a % 2 = 0").select(F.col("a").alias("ord"), F.col("b").alias("other"), "score")


@query()
def collapse_facts(s, d):
    b = _noisy_bundles(s, d)
    return resolution.collapse_clouds(b, resolution.form_clouds(b))





@query()
def duplicate_facts(s, d):
    f = facts(s, d).select("id", F.trunc("event_date", "MM").alias("event_date"), F.floor(F.col("total_amount") / 20000).alias("total_amount"), "currency", "vendor_key", vendors.slug("vendor").alias("slug"), F.lpad(F.hex(F.col("id")), 16, "0").alias("phash"), F.lit(None).cast("string").alias("event_time"))
    return resolution.duplicate_facts(f, items(s, d))


@query()
def duplicate_photos(s, d):
    p = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.lpad(F.hex(F.xxhash64(F.col("o_custkey")).bitwiseXOR(F.lit(1) * F.col("o_orderkey") % 4)), 16, "0").alias("phash"))
    return resolution.photo_groups(p)


@query("WITH a AS (SELECT id, vendor_key, round(total_amount / 1000) AS amount, event_date AS d, 'basket' AS k FROM facts WHERE id % 2 = 0), b AS (SELECT id, vendor_key, round(total_amount / 1000) AS amount, event_date AS d, 'slip' AS k FROM facts WHERE id % 2 = 1) SELECT a.id AS a, b.id AS b, CAST(date_diff('day', a.d, b.d) AS INT) AS days FROM a JOIN b USING (vendor_key, amount) WHERE abs(date_diff('day', a.d, b.d)) <= 60")
def complementary_matches(s, d):
    f = facts(s, d).select("id", "vendor_key", F.round(F.col("total_amount") / 1000).alias("amount"), F.col("event_date").alias("date"), F.when(F.col("id") % 2 == 0, "basket").otherwise("slip").alias("kind"))
    return resolution.interval_matches(f.where("kind = 'basket'"), f.where("kind = 'slip'"), 60)


@query("WITH i AS (SELECT fact_id % 997 AS cloud, lower(name) AS name, round(total_price / 1000) AS price, fact_id AS b FROM fact_items), c AS (SELECT cloud, name, price, b, count(*) AS n FROM i GROUP BY ALL) SELECT cloud, CAST(sum(most) AS BIGINT) AS n FROM (SELECT cloud, name, price, max(n) AS most FROM c GROUP BY ALL) GROUP BY 1")
def item_multiset_dedup(s, d):
    i = items(s, d).select((F.col("fact_id") % 997).alias("cloud"), F.col("fact_id").alias("bundle_id"), "name", F.round(F.col("total_price") / 1000).alias("price"), F.lit(1).alias("quantity"), F.lit(1).alias("richness"))
    return resolution.dedup_items(i).groupBy("cloud").agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT fact_id % 100 AS k, round(total_price / 1000, 0) AS p, count(*) AS n FROM fact_items WHERE fact_id % 2 = 0 GROUP BY ALL), y AS (SELECT fact_id % 100 AS k, round(total_price / 1000, 0) AS p, count(*) AS n FROM fact_items WHERE fact_id % 3 = 0 GROUP BY ALL) SELECT k, round(CAST(sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) AS DOUBLE) / sum(greatest(coalesce(x.n, 0), coalesce(y.n, 0))), 4) AS overlap FROM x FULL JOIN y USING (k, p) GROUP BY 1")
def price_multiset_overlap(s, d):
    i = items(s, d).select((F.col("fact_id") % 100).alias("k"), F.round(F.col("total_price") / 1000, 0).alias("price"), "fact_id")
    return resolution.price_overlap(i.where("fact_id % 2 = 0"), i.where("fact_id % 3 = 0"), ["k"])


@query()
def identity_lookup(s, d):
    m = facts(s, d).select(F.col("vendor_key").cast("long").alias("identity"), F.lit("name").alias("member_type"), F.col("vendor").alias("value")).distinct()
    q = facts(s, d).select(F.col("id").alias("q"), F.lit(None).cast("string").alias("vendor_key"), F.lit(None).cast("string").alias("registration"), F.upper("vendor").alias("name"))
    return resolution.find_identities(q, m)


@query()
def vendor_suggestions(s, d):
    n = s.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name")).distinct()
    return resolution.fuzzy_vendors(n.select(F.crc32(F.col("name").cast("binary")).alias("q"), F.concat("name", F.lit("x")).alias("name")), n, 0.85)


@query("SELECT vendor_key, vendor, count(*) AS n FROM facts GROUP BY ALL")
def vendor_name_history(s, d):
    return resolution.name_history(facts(s, d))


@query()
def reconcile_lines(s, d):
    i = items(s, d).select("fact_id", F.row_number().over(_w()).alias("line"), "quantity", (F.col("total_price") / F.col("quantity")).alias("unit_price"), "total_price", F.sum("total_price").over(_fact()).alias("printed_total"))
    return resolution.reconcile_lines(i)


def _fact():
    from pyspark.sql import Window

    return Window.partitionBy("fact_id")


def _w():
    return _fact().orderBy("line", "part_id", "quantity", "total_price")


@query("SELECT id, total_amount, {S:total_price} AS items_total FROM facts JOIN fact_items ON fact_id = id WHERE total_amount > 0 GROUP BY ALL HAVING items_total > 1.15 * total_amount")
def overcounted_facts(s, d):
    return resolution.overcounted(facts(s, d), items(s, d))


@query("SELECT vendor_key AS cloud, count(DISTINCT event_date) AS n, min(event_date) AS a, max(event_date) AS b FROM facts GROUP BY 1 HAVING n >= 2 AND date_diff('day', a, b) > 3 AND count(DISTINCT strftime(event_date, '%m-%d')) = n")
def date_split_candidates(s, d):
    return resolution.date_split(facts(s, d).select(F.col("vendor_key").alias("cloud"), "event_date"))


@query("SELECT o_orderkey AS node, o_orderkey - o_orderkey % 8 AS root FROM orders WHERE o_orderkey - o_orderkey % 8 IN (SELECT o_orderkey FROM orders)")
def forest_roots(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("node"))
    top = o.agg(F.max("node")).first()[0]
    every = s.range(0, top + 8).select(F.col("id").alias("node"), F.when(F.col("id") % 8 == 0, F.col("id")).otherwise(F.col("id") - 1).alias("parent"))
    roots = graph.forest_roots(every)
    return roots.join(o, "node", "left_semi").join(o.select(F.col("node").alias("root")).distinct(), "root", "left_semi").select("node", "root")


# Enrichment


@query("SELECT lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS barcode, 'USA/Canada' AS country FROM part")
def gs1_countries(s, d):
    return enrich.gs1_country(s, s.read.parquet(f"{d}/part.parquet").select(F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("barcode")))


@query("SELECT fact_id, line, part_id, CASE WHEN unit = 'g' THEN 'kg' ELSE unit END AS unit FROM fact_items WHERE unit_quantity >= 5 OR unit <> 'g'")
def comparable_prices(s, d):
    c = enrich.comparable_price(F.col("total_price"), F.col("quantity"), F.col("unit_quantity"), F.col("unit"))
    return items(s, d).select("fact_id", "line", "part_id", c.alias("c")).where("c.price is not null").select("fact_id", "line", "part_id", F.col("c.unit").alias("unit"))


@query("WITH i AS (SELECT part_id AS id, barcode, CASE WHEN part_id % 2 = 0 THEN brand END AS brand, category FROM (SELECT DISTINCT part_id, barcode, brand, category FROM fact_items)) SELECT id, coalesce(brand, NULL) AS brand, category FROM i")
def barcode_propagation(s, d):
    i = items(s, d).select(F.col("part_id").alias("id"), "barcode", "brand", "category").distinct()
    i = i.withColumn("brand", F.when(F.col("id") % 2 == 0, F.col("brand"))).withColumn("variant", F.lit(None).cast("string")).withColumn("enrichment_confidence", F.lit(0.5))
    return enrich.barcode_propagation(i).select("id", "brand", "category")


@query("WITH n AS (SELECT substr(barcode, 1, 7) AS prefix, brand, count(*) AS n FROM fact_items WHERE barcode IS NOT NULL GROUP BY ALL) SELECT prefix, arg_max(brand, (n, brand)) AS brand FROM n GROUP BY 1")
def company_brands(s, d):
    return enrich.company_brand(items(s, d))


@query("WITH n AS (SELECT vendor_key, category, count(*) AS n FROM item_stars GROUP BY ALL), t AS (SELECT vendor_key, max((n, category)) AS t FROM n GROUP BY 1) SELECT vendor_key, t[2] AS category, t[1] AS n FROM t WHERE t[1] >= 5")
def vendor_default_category(s, d):
    return enrich.vendor_default_category(star(s, d))


@query("""WITH r AS (SELECT name, vendor_key, brand, state FROM item_stars), v AS (SELECT name, vendor_key, state, count(*) AS n FROM r WHERE state IS NOT NULL GROUP BY ALL), b AS (SELECT name, brand, state, count(*) AS n FROM r WHERE state IS NOT NULL GROUP BY ALL), a AS (SELECT name, state, count(*) AS n FROM r WHERE state IS NOT NULL GROUP BY ALL),
vm AS (SELECT name, vendor_key, arg_max(state, (n, state)) AS x FROM v GROUP BY ALL), bm AS (SELECT name, brand, arg_max(state, (n, state)) AS y FROM b GROUP BY ALL), am AS (SELECT name, arg_max(state, (n, state)) AS z FROM a GROUP BY ALL)
SELECT name, vendor_key, brand, coalesce(x, y, z) AS state, CAST(CASE WHEN x IS NOT NULL THEN 0.95 WHEN y IS NOT NULL THEN 0.85 WHEN z IS NOT NULL THEN 0.75 END AS DOUBLE) AS confidence FROM (SELECT DISTINCT name, vendor_key, brand FROM r) LEFT JOIN vm USING (name, vendor_key) LEFT JOIN bm USING (name, brand) LEFT JOIN am USING (name)""")
def mode_cascade(s, d):
    return enrich.mode_cascade(star(s, d), "state")


@query()
def tidy_names(s, d):
    return items(s, d).select("name").distinct().select(F.concat("name", F.lit(" 500g x2 3,5%")).alias("raw")).withColumn("tidy", enrich.tidy_name(F.col("raw")))


@query("SELECT name, CAST(NULL AS VARCHAR) AS category FROM (SELECT DISTINCT name FROM fact_items)")
def keyword_categories(s, d):
    return items(s, d).select("name").distinct().select("name", enrich.keyword_category(F.col("name")).alias("category"))


# Privacy


@query("SELECT id, ceil(total_amount / 10) * 10.0 AS total_amount, strftime(date_trunc('month', event_date), '%Y-%m-%d') AS event_date, 'Unknown' AS vendor, fact_type FROM facts")
def mask_tier_1(s, d):
    return privacy.mask_for_tier(facts(s, d).withColumn("category", F.lit(None).cast("string")), 1)


@query("WITH f AS (SELECT vendor, min((event_date, id)) AS o FROM facts GROUP BY 1) SELECT vendor, row_number() OVER (ORDER BY o) - 1 AS number FROM f")
def pseudonyms(s, d):
    return privacy.numbered(facts(s, d), "vendor", ["event_date", "id"], "VENDOR_").select("vendor", "number")


@query("SELECT id, vendor, event_date FROM facts")
def mask_and_unmask(s, d):
    masked, mapping = privacy.mask_for_model(facts(s, d))
    return privacy.unmask(masked, mapping).select("id", "vendor", "event_date")


@query("SELECT id, vendor, event_date, total_amount FROM facts")
def pseudonymise_and_restore(s, d):
    out, mapping = privacy.pseudonymise(facts(s, d), 4.0, 17)
    return privacy.restore(out, mapping, 4.0, 17).select("id", "vendor", "event_date", "total_amount")


@query("SELECT fact_type, count(*) AS n, min(total_amount) AS least, max(total_amount) AS most, {A:total_amount} AS mean, round(median(total_amount), 4) AS median, round(stddev_samp(total_amount), 4) AS stdev FROM facts GROUP BY 1")
def statistical_export(s, d):
    return privacy.statistics_only(facts(s, d))


@query("SELECT id, strftime(event_date + 17, '%Y-%m') AS month, (SELECT list_sort(list(DISTINCT category)) FROM fact_items WHERE fact_id = id) AS categories FROM facts")
def categories_only_export(s, d):
    return privacy.categories_only(facts(s, d), items(s, d), 17).select("id", "month", "categories")


# Predictions


@query(f"""WITH c AS (SELECT DISTINCT fact_id, category FROM fact_items), k AS (SELECT fact_id, count(*) AS k FROM c GROUP BY 1),
r AS (SELECT date_trunc('month', event_date)::DATE AS month, coalesce(category, vendor) AS "group", {{S:total_amount / coalesce(k, 1)}} AS amount FROM facts LEFT JOIN c ON c.fact_id = id LEFT JOIN k ON k.fact_id = id WHERE {SPENT} GROUP BY ALL),
m AS (SELECT unnest(generate_series((SELECT min(month) FROM r)::TIMESTAMP, (SELECT max(month) FROM r)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month)
SELECT month, "group", coalesce(amount, 0.0) AS amount FROM m CROSS JOIN (SELECT DISTINCT "group" FROM r) LEFT JOIN r USING (month, "group")""")
def forecast_grid(s, d):
    return predict.spending_grid(facts(s, d), items(s, d))


@query()
def spending_forecast(s, d):
    return predict.forecast(predict.spending_grid(facts(s, d), items(s, d)))


@query("SELECT name, vendor, category FROM item_stars WHERE category IN (SELECT category FROM item_stars GROUP BY 1 HAVING count(*) >= 5)")
def category_training(s, d):
    return predict.category_training(star(s, d))


@query()
def classify_items(s, d):
    model = predict.train_category_classifier(predict.category_training(star(s, d)))
    return predict.classify(model, items(s, d).select("fact_id", "line", "name"), 0.0).select("fact_id", "line", "predicted", "confidence")


# Writes


@query("SELECT id, CASE WHEN id % 10 = 0 THEN 'corrected' ELSE vendor END AS vendor FROM facts")
def patch_facts(s, d):
    f = facts(s, d)
    return store.patch(f, f.where("id % 10 = 0").select("id", F.lit("corrected").alias("vendor")), "id", ["vendor"])[0].select("id", "vendor")


@query("SELECT id AS entity_id, 'vendor' AS field, vendor AS old, 'corrected' AS new FROM facts WHERE id % 10 = 0")
def correction_events(s, d):
    f = facts(s, d)
    return store.patch(f, f.where("id % 10 = 0").select("id", F.lit("corrected").alias("vendor")), "id", ["vendor"])[1]


@query("SELECT id, 'fact_type' AS field, fact_type AS old, 'purchase' AS new FROM facts WHERE fact_type <> 'purchase'")
def snapshot_diff(s, d):
    f = facts(s, d)
    return store.changes(f.withColumn("fact_type", F.lit("purchase")), f, "id", ["fact_type", "vendor"])


@query("SELECT count(*) AS n FROM facts WHERE id % 4 > 0")
def delete_facts(s, d):
    f = facts(s, d)
    kept, _, _ = store.delete_facts(f, items(s, d), f.where("id % 4 = 0").select(F.col("id").alias("fact_id")))
    return kept.agg(F.count("*").alias("n"))


@query("SELECT id FROM facts WHERE id NOT IN (SELECT fact_id FROM fact_items)")
def orphan_facts(s, d):
    return store.orphans(facts(s, d), items(s, d), "id", "fact_id").select("id")


@query("SELECT id, CAST(CASE currency WHEN 'EUR' THEN 1.0 WHEN 'USD' THEN 0.9 ELSE CASE WHEN event_date >= '1996-01-01' THEN 0.01 END END AS DOUBLE) AS eur_rate FROM facts")
def fx_backfill(s, d):
    f = facts(s, d)
    rates = f.where("currency = 'RUB' and event_date >= '1996-01-01'").select("currency", F.col("event_date").alias("rate_date"), F.lit(0.01).alias("eur_per_unit")).distinct()
    return store.fx_backfill(f, rates)[0].select("id", "eur_rate")


# Functions


@query("SELECT id, lower(replace(vendor, '#', '#')) AS slug FROM facts")
def vendor_slugs(s, d):
    return facts(s, d).select("id", vendors.slug("vendor").alias("slug"))


@query("SELECT id, strftime(event_date, '%Y') AS year, strftime(event_date, '%Y-%m') AS month, strftime(event_date, '%Y-W%W') AS week, year(event_date) || '-Q' || quarter(event_date) AS quarter FROM facts")
def date_buckets(s, d):
    return facts(s, d).select("id", *[dates.bucket("event_date", p).alias(p) for p in ("year", "month", "week", "quarter")])


@query("SELECT id, total_amount AS parsed, event_date AS day FROM facts")
def parse_numbers_and_dates(s, d):
    f = facts(s, d).select("id", F.concat(F.lit("€ "), F.format_number("total_amount", 2)).alias("raw"), F.date_format("event_date", "dd.MM.yyyy").alias("day"))
    return f.select("id", quantities.parse_number("raw").alias("parsed"), dates.parse_date("day").alias("day"))


@query("WITH p AS (SELECT id, CAST(34.5 AS DOUBLE) + CAST(id % 50 AS DOUBLE) / 100 AS lat FROM facts) SELECT id, round(2 * 6371000.0 * atan2(sqrt(pow(sin((radians(lat) - radians(34.7)) / 2), 2)), sqrt(1 - pow(sin((radians(lat) - radians(34.7)) / 2), 2))), 2) AS metres FROM p")
def haversine_distance(s, d):
    return facts(s, d).select("id", F.round(geo.haversine(F.lit(34.7), F.lit(33.0), 34.5 + F.col("id") % 50 / 100, F.lit(33.0)), 2).alias("metres"))


@query()
def document_languages(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", language.detect_language("text").alias("script_language"))


@query("SELECT DISTINCT unit, unit AS normal FROM fact_items")
def unit_normaliser(s, d):
    return items(s, d).select("unit", quantities.normalize_unit("unit").alias("normal")).distinct()


@query("SELECT id, 1.0 AS ratio FROM facts")
def name_similarity(s, d):
    return facts(s, d).select("id", seq_ratio("vendor", "vendor").alias("ratio"))


# Exports and batch forms of the streams


@query("SELECT id, event_date AS date, vendor, total_amount AS amount, currency, fact_type AS type, country FROM facts WHERE event_date >= '1997-01-01'")
def export_transactions(s, d):
    return files.export_transactions(facts(s, d), "1997-01-01")


@query("SELECT fact_id, line, name, category, brand, quantity, unit, total_price, currency, vendor, vendor_key, event_date, country FROM item_stars WHERE country = 'FRANCE'")
def export_line_items(s, d):
    return files.export_line_items(star(s, d), {"country": "FRANCE"})


@query()
def export_payload(s, d):
    return files.export_payload(facts(s, d), items(s, d))


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(s, d):
    return streams.tumbling(_events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def event_sessions(s, d):
    return streams.sessions(_events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
