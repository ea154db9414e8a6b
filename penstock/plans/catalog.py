"""Every operator as a named query over the canonical tables, with DuckDB's form of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spend, stars, stats
from ..sources import adapter
from ..sources.adapter import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = "1998-06-30"


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = oracle(sql)
        return f

    return add


def facts(s, d):
    return adapter.facts(s, d)


def items(s, d):
    return adapter.fact_items(s, d)


def star(s, d):
    return adapter.item_stars(s, d)


SPENT = "fact_type IN ('purchase', 'subscription_payment')"
EUR = "total_amount * coalesce(eur_rate, CASE WHEN currency = 'EUR' THEN 1.0 END)"

# Star aggregations


@query("SELECT category, comparable_unit, {A:comparable_unit_price_eur} AS avg_price, min(comparable_unit_price_eur) AS min_price, max(comparable_unit_price_eur) AS max_price, count(*) AS n, count(DISTINCT vendor_key) AS n_vendors FROM item_stars WHERE comparable_unit_price_eur > 0 GROUP BY ALL")
def avg_comparable_price(s, d):
    return stars.avg_comparable_price(star(s, d), None, ["category"])


@query("SELECT strftime(event_date, '%Y-%m') AS month, brand, comparable_unit, {A:comparable_unit_price_eur} AS avg_price, min(comparable_unit_price_eur) AS min_price, max(comparable_unit_price_eur) AS max_price, count(*) AS n, count(DISTINCT vendor_key) AS n_vendors FROM item_stars WHERE comparable_unit_price_eur > 0 AND event_date >= DATE '1996-01-01' AND country = 'FRANCE' AND lower(name) LIKE '%a%' GROUP BY ALL")
def avg_price_by_month_filtered(s, d):
    return stars.avg_comparable_price(star(s, d), {"date_from": "1996-01-01", "country": "FRANCE", "name": "A"}, ["month", "brand"])


@query("""WITH m AS (SELECT comparable_name, comparable_unit, currency, state, {A:comparable_unit_price} AS avg_price, count(*) AS n FROM item_stars WHERE state IS NOT NULL AND comparable_unit_price > 0 GROUP BY ALL)
SELECT m.* FROM m JOIN (SELECT comparable_name a, comparable_unit b, currency c FROM m GROUP BY ALL HAVING count(*) >= 2) x ON a = comparable_name AND b IS NOT DISTINCT FROM comparable_unit AND c = currency""")
def price_by_state(s, d):
    return stars.price_by_state(star(s, d))


@query("SELECT year(event_date) || '-Q' || quarter(event_date) AS period, comparable_unit, vendor_key, min(vendor) AS vendor, {A:comparable_unit_price_eur} AS avg_price, count(*) AS n FROM item_stars WHERE lower(comparable_name) LIKE '%e%' AND comparable_unit_price_eur > 0 GROUP BY ALL")
def price_trend(s, d):
    return stars.price_trend(star(s, d), "e", period="quarter")


@query("SELECT category AS bucket, count(*) AS n, {S:total_price_eur} AS total_eur FROM item_stars GROUP BY 1")
def basket_composition(s, d):
    return stars.basket_composition(star(s, d))


@query("SELECT * FROM (SELECT 'state' AS key, state AS value, count(*) AS n FROM item_stars WHERE state IS NOT NULL GROUP BY ALL UNION ALL SELECT 'organic', CAST(organic AS VARCHAR), count(*) FROM item_stars GROUP BY ALL) WHERE n >= 2")
def attribute_facets(s, d):
    return stars.attribute_facets(stars.with_attributes(star(s, d)))


@query("SELECT count(*) AS n, {S:total_price} AS total FROM item_stars WHERE organic AND state = 'fresh'")
def facet_filter(s, d):
    from ..functions.money import money_sum

    return stars.with_attributes(star(s, d)).where(stars.star_filter({"attributes": stars.parse_facets("organic:true,state:FRESH")})).agg(F.count("*").alias("n"), money_sum("total_price").alias("total"))


@query("SELECT category, count(*) AS n, {S:total_price} AS total FROM fact_items WHERE fact_id IN (SELECT id FROM facts WHERE event_date BETWEEN '1995-01-01' AND '1996-12-31') GROUP BY 1")
def category_summary(s, d):
    return stars.category_summary(items(s, d), facts(s, d), "1995-01-01", "1996-12-31")


@query("SELECT comparable_name, comparable_unit, min(comparable_unit_price_eur) AS min_price, arg_min(vendor_key, (comparable_unit_price_eur, vendor_key)) AS vendor_key FROM item_stars WHERE comparable_unit_price_eur > 0 GROUP BY 1, 2")
def cheapest_vendor(s, d):
    return stars.cheapest_vendor(star(s, d))


@query("SELECT comparable_name, comparable_unit, vendor_key, {A:comparable_unit_price_eur} AS avg_price, count(*) AS n FROM item_stars WHERE comparable_unit_price_eur > 0 GROUP BY ALL")
def vendor_prices(s, d):
    return stars.vendor_prices(star(s, d))


@query("SELECT vendor AS key, {S:total_amount * eur_rate} AS total_eur, count(*) AS n FROM facts WHERE eur_rate IS NOT NULL GROUP BY 1")
def convertible_spend_by_vendor(s, d):
    return stars.convertible_spend(facts(s, d), "vendor")


@query("SELECT state, category, count(*) AS n FROM fact_items WHERE state IS NOT NULL GROUP BY ALL")
def items_by_state(s, d):
    return stars.items_by_state(items(s, d))


@query("SELECT fact_id, line, part_id, quantity, total_price FROM item_stars WHERE brand LIKE '%2%' ORDER BY event_date DESC, fact_id, line, part_id, quantity, total_price LIMIT 100")
def list_item_stars(s, d):
    return stars.list_item_stars(star(s, d), {"brand": "2"}, 100).select("fact_id", "line", "part_id", "quantity", "total_price")


@query("SELECT fact_id, line, part_id, total_price_eur, comparable_unit_price_eur FROM item_stars")
def rebuild_item_stars(s, d):
    return star(s, d).select("fact_id", "line", "part_id", "total_price_eur", "comparable_unit_price_eur")


@query("SELECT fact_id, line, part_id, total_price_eur FROM item_stars")
def refresh_item_stars(s, d):
    i, f = items(s, d), facts(s, d)
    changed = f.where("id % 10 = 0").select(F.col("id").alias("fact_id"))
    return stars.refresh_stars(stars.rebuild_item_stars(i, f), i, f, changed).select("fact_id", "line", "part_id", "total_price_eur")


# Spend


@query(f"WITH p AS (SELECT vendor_key AS vendor_group, vendor, {EUR} AS eur FROM facts WHERE fact_type = 'purchase'), g AS (SELECT vendor_group, min(vendor) AS vendor, {{S:eur}} AS total, count(*) AS n FROM p WHERE eur IS NOT NULL GROUP BY 1) SELECT *, round(total / (SELECT {{S:eur}} FROM p) * 100, 4) AS share FROM g ORDER BY total DESC, vendor_group LIMIT 50")
def spending_by_vendor(s, d):
    return spend.spending_by_vendor(facts(s, d))


@query(f"WITH p AS (SELECT strftime(event_date, '%Y-%m') AS month, {EUR} AS eur FROM facts WHERE fact_type = 'purchase') SELECT month, {{S:eur}} AS total, count(*) AS n, {{A:eur}} AS mean FROM p WHERE eur IS NOT NULL GROUP BY 1")
def spending_by_month(s, d):
    return spend.spending_by_month(facts(s, d))


@query("SELECT lower(name) AS item, count(*) AS n, {S:total_price} AS total, {A:total_price} AS mean, count(DISTINCT vendor) AS n_vendors FROM fact_items JOIN facts ON fact_id = id WHERE fact_type = 'purchase' GROUP BY 1 ORDER BY n DESC, item LIMIT 50")
def item_frequency(s, d):
    return spend.item_frequency(items(s, d), facts(s, d))


@query("SELECT DISTINCT lower(name) AS item, vendor FROM fact_items JOIN facts ON fact_id = id WHERE fact_type = 'purchase'")
def item_vendors(s, d):
    return spend.item_vendors(items(s, d), facts(s, d))


@query(f"""WITH p AS (SELECT event_date, {EUR} AS eur FROM facts WHERE fact_type = 'purchase'), q AS (SELECT month(event_date) AS m, year(event_date) AS y, {{S:eur}} AS t FROM p WHERE eur IS NOT NULL GROUP BY ALL),
a AS (SELECT m, {{S:t}} / (SELECT count(DISTINCT y) FROM q) AS average FROM q GROUP BY 1)
SELECT CAST(i AS INT) AS month, coalesce(average, 0.0) AS average, round((average - (SELECT avg(average) FROM a)) / (SELECT avg(average) FROM a) * 100, 4) AS deviation FROM range(1, 13) r(i) LEFT JOIN a ON m = i""")
def seasonal_patterns(s, d):
    return spend.seasonal_patterns(facts(s, d))


def _analysis(key: str, rows: str = "facts", eur: str = EUR) -> str:
    return f"WITH p AS (SELECT {key} AS key, id, {eur} AS eur FROM {rows} WHERE {SPENT}) SELECT key, count(DISTINCT id) AS n_facts, {{S:eur}} AS total, {{A:eur}} AS mean, min(eur) AS least, max(eur) AS most FROM p GROUP BY 1"


for _period, _fmt in (("day", "%Y-%m-%d"), ("week", "%Y-W%W"), ("month", "%Y-%m")):
    query(_analysis(f"strftime(event_date, '{_fmt}')"), f"spending_analysis_{_period}")(lambda s, d, p=_period: spend.spending_analysis(facts(s, d), group_by=p))
query(_analysis("vendor"), "spending_analysis_vendor")(lambda s, d: spend.spending_analysis(facts(s, d), group_by="vendor"))
query(_analysis("category", "facts JOIN fact_items ON id = fact_id"), "spending_analysis_category")(lambda s, d: spend.spending_analysis(facts(s, d), items(s, d), "category"))
query(_analysis("category", "facts JOIN fact_items ON id = fact_id", EUR.replace("total_amount", "total_price")), "spending_analysis_category_items")(lambda s, d: spend.spending_analysis(facts(s, d), items(s, d), "category", per_item=True))


@query(f"SELECT count(*) AS n_facts, {{S:{EUR}}} AS total, count(DISTINCT vendor_key) AS n_vendors, min(event_date) AS first_date, max(event_date) AS last_date, (SELECT currency FROM facts WHERE {SPENT} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS modal_currency FROM facts WHERE {SPENT}")
def spending_overview(s, d):
    return spend.spending_overview(facts(s, d))


_MONTH = "event_date >= '1996-03-01' AND event_date < '1996-04-01'"


@query(f"WITH p AS (SELECT *, {EUR} AS a FROM facts WHERE {_MONTH}) SELECT coalesce({{S:CASE WHEN {SPENT} THEN a END}}, 0.0) AS expenses, coalesce({{S:CASE WHEN NOT ({SPENT}) THEN a END}}, 0.0) AS income, count(CASE WHEN {SPENT} THEN 1 END) AS n_expenses, count(CASE WHEN NOT ({SPENT}) THEN 1 END) AS n_income FROM p")
def monthly_report(s, d):
    return spend.monthly_report(facts(s, d), 1996, 3)


@query(f"WITH a AS (SELECT coalesce({{S:total_amount}}, 0.0) AS expenses FROM facts WHERE {SPENT} AND {_MONTH}), b AS (SELECT coalesce({{S:total_amount}}, 0.0) AS previous FROM facts WHERE {SPENT} AND event_date >= '1996-02-01' AND event_date < '1996-03-01') SELECT *, round((expenses - previous) / previous * 100, 4) AS change FROM a, b")
def month_change(s, d):
    return spend.month_change(facts(s, d), 1996, 3)


@query(f"WITH f AS (SELECT * FROM facts WHERE {SPENT} AND {_MONTH}) SELECT category, {{S:total_price}} AS total, count(*) AS n, greatest(0.0, least(100.0, round({{S:total_price}} / (SELECT {{S:total_amount}} FROM f) * 100, 4))) AS share FROM fact_items JOIN f ON fact_id = id GROUP BY 1")
def report_category_breakdown(s, d):
    return spend.category_breakdown(items(s, d), facts(s, d), 1996, 3)


@query(f"SELECT vendor, {{S:total_amount}} AS total, count(*) AS n FROM facts WHERE {SPENT} AND {_MONTH} GROUP BY 1 ORDER BY total DESC, vendor LIMIT 20")
def report_vendor_breakdown(s, d):
    return spend.vendor_breakdown(facts(s, d), 1996, 3)


@query(f"SELECT id, vendor, total_amount, event_date FROM facts WHERE {SPENT} AND {_MONTH} ORDER BY total_amount DESC, id LIMIT 10")
def report_top_expenses(s, d):
    return spend.top_expenses(facts(s, d), 1996, 3)


@query(f"SELECT {{S:CASE WHEN {SPENT} THEN total_amount END}} AS expenses, {{S:CASE WHEN NOT ({SPENT}) THEN total_amount END}} AS income, count(*) AS n, {{S:CASE WHEN NOT ({SPENT}) THEN total_amount END}} - {{S:CASE WHEN {SPENT} THEN total_amount END}} AS net FROM facts")
def distribution_summary(s, d):
    return spend.summary_form(facts(s, d))


@query(f"SELECT vendor, {{S:total_amount}} AS total, count(*) AS n FROM facts WHERE {SPENT} GROUP BY 1 ORDER BY total DESC, vendor LIMIT 5")
def distribution_top_vendors(s, d):
    return spend.top_groups(facts(s, d), "vendor")


@query(f"SELECT strftime(event_date, '%Y-%m') AS month, {{S:CASE WHEN {SPENT} THEN total_amount END}} AS expenses, {{S:CASE WHEN NOT ({SPENT}) THEN total_amount END}} AS income FROM facts GROUP BY 1")
def distribution_monthly(s, d):
    return spend.monthly_flow(facts(s, d))


@query(f"SELECT vendor, count(*) AS n, {{A:total_amount}} AS mean, CASE WHEN count(*) >= 12 THEN 'weekly' ELSE 'monthly' END AS cadence FROM facts WHERE {SPENT} GROUP BY 1 HAVING count(*) >= 3")
def distribution_recurring(s, d):
    return spend.recurring_vendors(facts(s, d))


@query(f"SELECT id, vendor, total_amount FROM facts WHERE {SPENT} AND total_amount > 2.0 * (SELECT {{A:total_amount}} FROM facts WHERE {SPENT}) ORDER BY total_amount DESC, id LIMIT 10")
def distribution_anomalies(s, d):
    return spend.unusual_amounts(facts(s, d), 2.0)


@query("SELECT id, event_date, vendor, fact_type, total_amount, currency, (SELECT min(category) FROM fact_items WHERE fact_id = id) AS category FROM facts")
def distribution_tabular(s, d):
    return spend.tabular_form(facts(s, d), items(s, d))


_ALIASED = "SELECT country AS vendor_key, vendor FROM facts"


@query(f"WITH n AS (SELECT vendor_key, vendor, count(*) AS n FROM ({_ALIASED}) GROUP BY ALL) SELECT vendor_key, count(*) AS names, CAST(sum(n) AS BIGINT) AS facts, arg_max(vendor, (n, vendor)) AS usual FROM n GROUP BY 1 HAVING count(*) >= 2")
def vendor_alias_report(s, d):
    return spend.vendor_aliases(facts(s, d).select(F.col("country").alias("vendor_key"), "vendor"))


@query(f"SELECT strftime(event_date, '%Y-W%W') AS period, count(*) AS n, {{S:total_amount}} AS total, {{A:total_amount}} AS mean FROM facts WHERE {SPENT} GROUP BY 1")
def assistant_spend_summary(s, d):
    return spend.assistant_summary(facts(s, d), "week")


# Budgets

_ACTUAL = f"SELECT category, strftime(event_date, '%Y-%m') AS period, {{S:total_price}} AS amount FROM fact_items JOIN facts ON fact_id = id WHERE {SPENT} GROUP BY ALL"


@query(f"SELECT category, currency, strftime(event_date, '%Y-%m') AS period, {{S:total_price}} AS amount FROM fact_items JOIN facts ON fact_id = id WHERE {SPENT} GROUP BY ALL")
def budget_actuals(s, d):
    return spend.actual_spending(items(s, d), facts(s, d))


def _overrides(a: DataFrame) -> DataFrame:
    return a.groupBy("category", "period").agg(F.lit(1).alias("x")).where("period like '1996%'").select("category", "period", F.lit(100.0).alias("amount"), F.lit(1).alias("ord"))


@query(f"WITH a AS (SELECT category, period, {{S:amount}} AS amount FROM (SELECT category, currency, strftime(event_date, '%Y-%m') AS period, {{S:total_price}} AS amount FROM fact_items JOIN facts ON fact_id = id WHERE {SPENT} GROUP BY ALL) GROUP BY ALL) SELECT category, period, CASE WHEN period LIKE '1996%' THEN 100.0 ELSE amount END AS amount FROM a")
def budget_merged(s, d):
    a = spend.actual_spending(items(s, d), facts(s, d))
    return spend.merge_entries(a, _overrides(a))


@query(f"WITH a AS ({_ACTUAL}), b AS (SELECT category, substr(period, 6) AS m, substr(period, 1, 4) AS y, amount FROM a), x AS (SELECT category, m AS period, amount AS v FROM b WHERE y = '1996'), z AS (SELECT category, m AS period, amount AS v FROM b WHERE y = '1997') SELECT category, period, coalesce(x.v, 0.0) AS base, coalesce(z.v, 0.0) AS compared, coalesce(z.v, 0.0) - coalesce(x.v, 0.0) AS difference FROM x FULL JOIN z USING (category, period)")
def budget_variance(s, d):
    a = spend.actual_spending(items(s, d), facts(s, d))
    year = lambda y: a.where(F.col("period").startswith(y)).withColumn("period", F.substring("period", 6, 2))
    return spend.variance(year("1996"), year("1997")).drop("percent")


@query(f"WITH a AS ({_ACTUAL}) SELECT category, period, 100000.0 AS amount, amount AS actual, 100000.0 - amount AS left_over, amount > 100000.0 AS over FROM a WHERE period LIKE '1996%'")
def budget_comparison(s, d):
    a = spend.actual_spending(items(s, d), facts(s, d))
    entries = _overrides(a).select("category", "period", F.lit(100000.0).alias("amount"))
    return spend.budget_comparison(entries, a)


# Statistics


@query()
def subscriptions(s, d):
    return stats.detect_subscriptions(facts(s, d), least=3, min_confidence=0.3)


@query()
def upcoming_payments(s, d):
    return stats.upcoming_payments(stats.detect_subscriptions(facts(s, d), min_confidence=0.3), AS_OF, 365)


_FIRST = "(SELECT fact_id, min(category) AS category FROM fact_items GROUP BY 1)"


@query(f"""WITH r AS (SELECT id, vendor, coalesce(total_amount, 0.0) AS amount, coalesce(category, 'uncategorized') AS category FROM facts LEFT JOIN {_FIRST} ON fact_id = id WHERE {SPENT} AND event_date > DATE '{AS_OF}' - 900 AND event_date <= DATE '{AS_OF}'),
c AS (SELECT category, count(*) AS cn, {{A:amount}} AS cm, round(stddev_samp(amount), 4) AS cs FROM r GROUP BY 1), o AS (SELECT count(*) AS n, {{A:amount}} AS om, round(stddev_samp(amount), 4) AS os FROM r), v AS (SELECT vendor, count(*) AS visits FROM r GROUP BY 1),
z AS (SELECT id, vendor, category, amount, visits, cn > 2 AND cs > 0 AND round((amount - cm) / cs, 3) > 1.8 AS hc, n > 2 AND os > 0 AND round((amount - om) / os, 3) > 1.8 AS ho, round((amount - cm) / cs, 3) AS cz, round((amount - om) / os, 3) AS oz FROM r JOIN c USING (category) JOIN v USING (vendor), o)
SELECT id, vendor, category, amount, CASE WHEN hc THEN 'category' WHEN visits = 1 THEN 'new_vendor' ELSE 'amount' END AS kind, round(least(1.0, CASE WHEN hc THEN cz / 5 WHEN visits = 1 THEN oz / 4 ELSE oz / 5 END), 3) AS severity FROM z WHERE hc OR ho""")
def anomalies(s, d):
    return stats.detect_anomalies(facts(s, d), items(s, d), AS_OF, 900, 1.8)


@query(f"WITH m AS (SELECT strftime(event_date, '%Y-%m') AS month, coalesce({{S:CASE WHEN {SPENT} THEN total_amount END}}, 0.0) AS expense, coalesce({{S:CASE WHEN NOT ({SPENT}) THEN total_amount END}}, 0.0) AS income FROM facts GROUP BY 1) SELECT *, income - expense AS net, CASE WHEN income > 0 THEN round((income - expense) / income * 100, 4) END AS savings_rate FROM m")
def spending_patterns(s, d):
    return stats.spending_patterns(facts(s, d))


@query(f"WITH t AS (SELECT strftime(event_date, '%Y-%m') AS month, category, {{S:total_amount}} AS total FROM facts JOIN {_FIRST} ON fact_id = id WHERE {SPENT} GROUP BY ALL) SELECT month, category, total, CAST(row_number() OVER (PARTITION BY month ORDER BY total DESC, category) AS INT) AS rank FROM t QUALIFY rank <= 5")
def month_top_categories(s, d):
    return stats.month_top_categories(facts(s, d), items(s, d))


@query(f"""WITH r AS (SELECT date_trunc('month', event_date) AS m, category, {{S:total_amount}} AS t FROM facts JOIN {_FIRST} ON fact_id = id WHERE {SPENT} GROUP BY ALL), b AS (SELECT min(m) AS m0, date_diff('month', min(m), max(m)) + 1 AS n FROM r),
x AS (SELECT category, {{S:t}} AS s, {{S:t * date_diff('month', m0, m)}} AS sx, CAST(any_value(n) AS DOUBLE) AS k FROM r, b GROUP BY 1), y AS (SELECT category, round(s, 2) AS total, round((sx - s * (k - 1) / 2) / (k * (k * k - 1) / 12) / (s / k), 4) AS slope FROM x)
SELECT *, CASE WHEN slope > 0.05 THEN 'increasing' WHEN slope < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend FROM y""")
def category_trend(s, d):
    return stats.category_trend(facts(s, d), items(s, d))


@query(f"""WITH r AS (SELECT coalesce(category, 'uncategorized') AS category, coalesce({{S:CASE WHEN event_date BETWEEN '1995-01-01' AND '1995-12-31' THEN total_amount END}}, 0.0) AS before, coalesce({{S:CASE WHEN event_date BETWEEN '1996-01-01' AND '1996-12-31' THEN total_amount END}}, 0.0) AS after
FROM facts LEFT JOIN {_FIRST} ON fact_id = id WHERE {SPENT} AND event_date BETWEEN '1995-01-01' AND '1996-12-31' GROUP BY 1) SELECT *, round((after - before) / before * 100, 4) AS change FROM r ORDER BY abs(change) DESC, category LIMIT 10""")
def compare_periods(s, d):
    return stats.compare_periods(facts(s, d), items(s, d), ("1995-01-01", "1995-12-31"), ("1996-01-01", "1996-12-31"))


_FACTOR_SQL = """WITH r AS (SELECT comparable_name AS product, comparable_unit_price AS price, list_filter(['brand:' || brand, 'state:' || state], lambda x: x IS NOT NULL) AS a FROM item_stars WHERE comparable_unit_price > 0),
t AS (SELECT product, count(*) AS n, {S:price} AS s FROM r GROUP BY 1), w AS (SELECT product, attribute, count(*) AS n1, {S:price} AS s1 FROM (SELECT product, price, unnest(a) AS attribute FROM r) GROUP BY ALL),
f AS (SELECT product, attribute, n1, n - n1 AS n0, s1 / n1 AS m1, (s - s1) / (n - n1) AS m0 FROM w JOIN t USING (product) WHERE n1 >= 2 AND n - n1 >= 1),
g AS (SELECT product, attribute, n1, n0, round(m1, 4) AS with_mean, round(m0, 4) AS without_mean, round((m1 - m0) / m0 * 100, 3) AS premium, round(least(1.0, n1 * n0 / (n1 + n0) / 5), 4) AS confidence FROM f) """


def _factor_rows(s, d):
    return star(s, d).where("comparable_unit_price > 0").select(F.col("comparable_name").alias("product"), F.col("comparable_unit_price").alias("price"), F.array_compact(F.array(F.concat(F.lit("brand:"), "brand"), F.concat(F.lit("state:"), "state"))).alias("attributes"))


@query(_FACTOR_SQL + "SELECT * FROM g")
def price_factors(s, d):
    return stats.price_factors(_factor_rows(s, d))


@query(_FACTOR_SQL + "SELECT * FROM (SELECT attribute, count(*) AS products, CAST(sum(n1) AS BIGINT) AS n, round({S:g.premium * n1} / sum(n1), 3) AS premium FROM g GROUP BY 1) ORDER BY abs(premium) DESC, attribute LIMIT 20")
def price_factor_summary(s, d):
    return stats.factor_summary(stats.price_factors(_factor_rows(s, d)))


def _cache(s, d):
    p = s.read.parquet(f"{d}/part.parquet").where("p_partkey % 3 > 0")
    data = F.to_json(F.struct(F.struct((F.col("p_size") * 10.0).alias("energy-kcal_100g"), (F.col("p_size") / 4).alias("sugars_100g")).alias("nutriments"), F.element_at(F.array(*map(F.lit, "abcde")), F.col("p_size") % 5 + 1).alias("nutriscore_grade")))
    return p.select(F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("barcode"), F.when(F.col("p_partkey") % 11 == 0, F.lit('{"_not_found": true}')).otherwise(data).alias("data"))


_NUTRI = """WITH r AS (SELECT i.*, event_date, part_id % 3 > 0 AND part_id % 11 <> 0 AND barcode IS NOT NULL AS known, CASE WHEN part_id % 3 > 0 AND part_id % 11 <> 0 AND barcode IS NOT NULL THEN quantity * unit_quantity * CASE WHEN unit IN ('kg', 'l') THEN 1000.0 WHEN unit = 'g' THEN 1.0 END END AS grams FROM fact_items i JOIN facts ON fact_id = id),
n AS (SELECT *, round(unit_quantity * 10.0 * grams / 100, 3) AS kcal, round(unit_quantity / 4 * grams / 100, 3) AS sug FROM r) """


@query(_NUTRI + "SELECT strftime(event_date, '%Y-%m') AS period, {S:kcal} AS energy_kcal, {S:sug} AS sugars, round(count(CASE WHEN known THEN 1 END) / count(*) * 100, 4) AS coverage, count(CASE WHEN known AND unit_quantity % 5 = 0 THEN 1 END) AS grade_a FROM n GROUP BY 1")
def nutrition_summary(s, d):
    return stats.nutrition_summary(stats.nutrition_rows(items(s, d), facts(s, d), _cache(s, d))).select("period", "energy_kcal", "sugars", "coverage", "grade_a")


@query(_NUTRI + "SELECT category, {S:kcal} AS kcal, {S:sug} AS sugars, count(*) AS n FROM n GROUP BY 1")
def nutrition_by_category(s, d):
    return stats.nutrition_by_category(stats.nutrition_rows(items(s, d), facts(s, d), _cache(s, d)))


def _points(s, d):
    k = F.col("vendor_key").cast("long")
    return facts(s, d).where("fact_type = 'purchase'").select("id", "vendor_key", "total_amount", (34.5 + k % 50 / 100 + F.col("id") % 3 / 400).alias("lat"), (33.0 + k % 70 / 100 + F.col("id") % 2 / 300).alias("lng"))


_POINTS = "SELECT id, vendor_key, total_amount, CAST(34.5 AS DOUBLE) + CAST(CAST(vendor_key AS BIGINT) % 50 AS DOUBLE) / 100 + CAST(id % 3 AS DOUBLE) / 400 AS lat, CAST(33.0 AS DOUBLE) + CAST(CAST(vendor_key AS BIGINT) % 70 AS DOUBLE) / 100 + CAST(id % 2 AS DOUBLE) / 300 AS lng FROM facts WHERE fact_type = 'purchase'"


@query()
def spending_by_place(s, d):
    return stats.spending_by_place(stats.place_clusters(_points(s, d)))


@query()
def vendor_branches(s, d):
    return stats.vendor_branches(_points(s, d))


@query(f"WITH p AS ({_POINTS}), h AS (SELECT *, pow(sin((radians(lat) - radians(34.7)) / 2), 2) + cos(radians(34.7)) * cos(radians(lat)) * pow(sin(radians(lng - 33.2) / 2), 2) AS a FROM p), k AS (SELECT *, round(2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)), 3) AS dist FROM h) SELECT vendor_key, min(dist) AS distance, count(*) AS visits, {{A:total_amount}} AS mean_basket FROM k WHERE dist <= 20000 GROUP BY 1 ORDER BY distance, vendor_key LIMIT 10")
def nearby_vendors(s, d):
    return stats.nearby_vendors(_points(s, d), 34.7, 33.2, 20_000)


@query("WITH s AS (SELECT fact_id, {S:total_price} AS s, count(*) AS n FROM fact_items GROUP BY 1), r AS (SELECT id, total_amount, round(coalesce(s, 0.0) / total_amount * 100, 3) AS coverage, n FROM facts LEFT JOIN s ON fact_id = id WHERE fact_type = 'purchase' AND total_amount > 0) SELECT id, total_amount, coverage, CASE WHEN n IS NULL THEN 'no_items' WHEN coverage < 92 THEN 'partial' ELSE 'covered' END AS class FROM r")
def item_coverage(s, d):
    return stats.item_coverage(facts(s, d), items(s, d))


@query("SELECT 'state' AS field, count(state) AS filled, count(CASE WHEN state IS NULL AND organic THEN 1 END) AS answered_null, count(CASE WHEN state IS NULL AND NOT organic THEN 1 END) AS pending FROM fact_items UNION ALL SELECT 'barcode', count(barcode), 0, count(*) - count(barcode) FROM fact_items")
def field_coverage(s, d):
    return stats.field_coverage(items(s, d).withColumn("mark", F.col("organic").cast("int")), {"state": "mark", "barcode": ""})


@query("WITH p AS (SELECT barcode, count(DISTINCT vendor_key) AS v, count(*) AS n FROM item_stars WHERE barcode IS NOT NULL GROUP BY 1) SELECT count(*) AS barcodes, CAST(sum(n) AS BIGINT) AS items, count(CASE WHEN v >= 2 THEN 1 END) AS cross_vendor FROM p")
def barcode_coverage(s, d):
    return stats.barcode_coverage(star(s, d))


@query("WITH f AS (SELECT id, CASE WHEN id % 3 > 0 THEN total_amount END AS paid FROM facts), s AS (SELECT fact_id, {S:total_price} AS s FROM fact_items GROUP BY 1) SELECT id, CASE WHEN s IS NOT NULL AND paid IS NOT NULL THEN 'items_and_payment' WHEN s IS NOT NULL THEN 'items_only' WHEN paid IS NOT NULL THEN 'payment_only' ELSE 'neither' END AS class, coalesce(abs(s - paid) > greatest(0.02, 0.05 * greatest(s, paid)), false) AS mismatch FROM f LEFT JOIN s ON fact_id = id")
def reconciliation(s, d):
    return stats.reconcile(facts(s, d).select("id", "total_amount", F.when(F.col("id") % 3 > 0, F.col("total_amount")).alias("paid")), items(s, d))


_CORR = "SELECT id AS cloud_id, id % 14 = 0 AS was_false_positive FROM facts WHERE id % 7 = 0"


def _corrections(s, d):
    return facts(s, d).where("id % 7 = 0").select(F.col("id").alias("cloud_id"), (F.col("id") % 14 == 0).alias("was_false_positive"))


@query(f"WITH c AS ({_CORR}), o AS (SELECT vendor_key, count(*) AS clouds, count(c.cloud_id) AS corrected, coalesce(CAST(sum(CAST(was_false_positive AS INT)) AS BIGINT), 0) AS false_positives FROM facts LEFT JOIN c ON c.cloud_id = id GROUP BY 1) SELECT *, round(1 - corrected / clouds, 4) AS accuracy FROM o")
def cloud_accuracy(s, d):
    return stats.cloud_accuracy(facts(s, d).select("cloud_id", "vendor_key"), _corrections(s, d))


@query("SELECT CASE WHEN k = 1 THEN '1' WHEN k = 2 THEN '2' ELSE '3+' END AS size, count(*) AS clouds, max(k) AS largest FROM (SELECT fact_id, count(*) AS k FROM fact_items GROUP BY 1) GROUP BY 1")
def cloud_size_distribution(s, d):
    return stats.cloud_sizes(items(s, d).select(F.col("fact_id").alias("cloud_id")))


@query(f"WITH c AS ({_CORR}) SELECT fact_type AS match_type, count(*) AS uses, round({{A:CAST(id % 10 AS DOUBLE) / 10}}, 4) AS confidence, round(count(c.cloud_id) / count(*), 4) AS correction_rate FROM facts LEFT JOIN c ON c.cloud_id = id GROUP BY 1")
def match_type_stats(s, d):
    return stats.match_type_stats(facts(s, d).select("cloud_id", F.col("fact_type").alias("match_type"), (F.col("id") % 10 / 10).cast("double").alias("match_confidence")), _corrections(s, d))


@query("WITH p AS (SELECT country AS source_vendor, currency AS target_vendor FROM facts) SELECT source_vendor, target_vendor, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, 1, 2 LIMIT 10")
def false_positive_pairs(s, d):
    return stats.false_positive_pairs(facts(s, d).select(F.col("country").alias("source_vendor"), F.col("currency").alias("target_vendor")))


@query("WITH c AS (SELECT vendor_key, category, count(*) AS n FROM item_stars GROUP BY ALL) SELECT a.category AS usual, b.category AS other, CAST(sum(b.n) AS BIGINT) AS n, count(*) AS vendors FROM c a JOIN c b ON a.vendor_key = b.vendor_key AND (a.n > b.n OR a.n = b.n AND a.category < b.category) GROUP BY ALL HAVING sum(b.n) >= 2")
def confusion_matrix(s, d):
    return stats.confusion_matrix(star(s, d))


@query("SELECT fact_type AS enrichment_source, count(*) AS n, round({A:CAST(id % 10 AS DOUBLE) / 10}, 4) AS confidence FROM facts GROUP BY 1")
def review_stats(s, d):
    return stats.review_stats(facts(s, d).select(F.col("fact_type").alias("enrichment_source"), (F.col("id") % 10 / 10).cast("double").alias("enrichment_confidence")))


from . import catalog_entities  # noqa: E402, F401  the second part adds itself
from . import catalog_records  # noqa: E402, F401  and the third
from . import catalog_links  # noqa: E402, F401  and the fourth
from . import catalog_streams  # noqa: E402, F401  and the fifth
from . import catalog_refine  # noqa: E402, F401  and the sixth
