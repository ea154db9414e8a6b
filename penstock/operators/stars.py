"""The line-item star: materialisation, filters, and aggregations over it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bucket
from ..functions.money import eur_factor, money_mean, money_sum

#: Structural keys that are no facets.
FACET_DENY = ("brand", "category", "name", "price", "quantity", "unit", "barcode", "currency", "vendor")
_KEY = re.compile(r"^[a-z0-9_]{1,40}$")
_CONTAINS = ("name", "comparable_name", "brand", "vendor")
_EQUAL = ("category", "comparable_unit", "vendor_key", "currency", "country", "product_variant", "state", "fact_type")
DIMENSIONS = ("vendor", "vendor_key", "category", "brand", "comparable_name", "currency", "country", "product_variant", "state", "fact_type")


def rebuild_item_stars(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Items with their fact's columns and EUR amounts. A unit price is total / (quantity * unit quantity) where the items have none."""
    f = facts.select(F.col("id").alias("fact_id"), "vendor", "vendor_key", "country", "fact_type", "event_date", "currency", "eur_rate")
    out = items.join(f, "fact_id")
    unit_price = F.col("total_price") / (F.col("quantity") * F.col("unit_quantity"))
    if "comparable_unit_price" not in items.columns:
        out = out.withColumn("comparable_unit_price", unit_price)
    if "comparable_unit" not in items.columns:
        out = out.withColumn("comparable_unit", F.col("unit"))
    return out.withColumn("comparable_unit_price_eur", F.col("comparable_unit_price") * eur_factor()).withColumn("total_price_eur", F.col("total_price") * eur_factor())


def refresh_stars(stars: DataFrame, items: DataFrame, facts: DataFrame, changed: DataFrame) -> DataFrame:
    """stars with the rows of the facts in changed (fact_id) recomputed: delete and reinsert by key, without touching others."""
    keys = changed.select("fact_id").distinct()
    fresh = rebuild_item_stars(items.join(keys, "fact_id", "left_semi"), facts.join(keys, facts["id"] == keys["fact_id"], "left_semi"))
    return stars.join(keys, "fact_id", "left_anti").unionByName(fresh.select(*stars.columns))


def changed_by_items(items: DataFrame, item_ids: DataFrame) -> DataFrame:
    """Facts of the given items (id)."""
    return items.join(item_ids, "id", "left_semi").select("fact_id").distinct()


def changed_by_document(bundles: DataFrame, facts: DataFrame, document_id) -> DataFrame:
    """Facts that a document's bundles belong to."""
    return bundles.where(F.col("document_id") == document_id).join(facts, "cloud_id").select(F.col("id").alias("fact_id")).distinct()


def prefix_predicate(c: Column, prefix: str) -> Column:
    """Equal to a category path or below it; never a bare text prefix."""
    p = prefix.lower()
    return (F.lower(c) == p) | F.lower(c).startswith(p + " > ")


def facet_predicate(attributes: Column, key: str, value) -> Column:
    """None or '*': present; a boolean as 1/0; a number as a number; else text, case-folded."""
    if not _KEY.match(key):
        raise ValueError(f"bad attribute key {key!r}")
    v = F.get_json_object(attributes, f"$.{key}")
    if value is None or value == "*":
        return v.isNotNull()
    if isinstance(value, bool):
        return F.lower(v).isin(*(("true", "1") if value else ("false", "0")))
    if isinstance(value, int | float):
        return v.try_cast("double") == float(value)
    return F.lower(v) == str(value).lower()


def parse_facets(text: str | None) -> dict:
    """'organic:true,size:L,free_range' as typed values."""
    out: dict = {}
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        key, sep, raw = part.partition(":")
        raw = raw.strip()
        if not sep:
            out[key] = None
        elif raw.lower() in ("true", "false"):
            out[key.strip()] = raw.lower() == "true"
        else:
            try:
                out[key.strip()] = float(raw) if "." in raw else int(raw)
            except ValueError:
                out[key.strip()] = raw
    return out


def product_only(path: str | None = None) -> Column:
    """No adjustment lines: category is not Non_Item and the path is not below adjustment. Nulls pass."""
    c = F.coalesce(F.col("category"), F.lit("")) != "Non_Item"
    return c if path is None else c & ~F.coalesce(prefix_predicate(F.col(path), "adjustment"), F.lit(False))


def star_filter(filters: dict | None) -> Column:
    """Conjunction of the given filters; falsy values are ignored."""
    conditions: list[Column] = []
    for key, v in (filters or {}).items():
        if v in (None, "", [], {}):
            continue
        if key in _CONTAINS:
            conditions.append(F.lower(F.col(key)).contains(str(v).lower()))
        elif key in _EQUAL:
            conditions.append(F.col(key) == v)
        elif key == "date_from":
            conditions.append(F.col("event_date") >= F.lit(v).cast("date"))
        elif key == "date_to":
            conditions.append(F.col("event_date") <= F.lit(v).cast("date"))
        elif key in ("datetime_from", "datetime_to"):
            low = key == "datetime_from"
            at = F.concat_ws(" ", F.date_format("event_date", "yyyy-MM-dd"), F.coalesce(F.col("event_time"), F.lit("00:00:00" if low else "23:59:59")))
            bound = str(v).replace("T", " ")
            conditions.append(at >= bound if low else at <= bound)
        elif key == "price_min":
            conditions.append(F.col("total_price") >= v)
        elif key == "price_max":
            conditions.append(F.col("total_price") <= v)
        elif key == "category_prefix":
            conditions.append(prefix_predicate(F.col("category_path"), v))
        elif key == "attributes":
            conditions.extend(facet_predicate(F.col("attributes"), k, x) for k, x in v.items())
        else:
            raise ValueError(f"unknown filter {key!r}")
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def group_columns(group_by: list[str] | None) -> list[Column]:
    out = []
    for g in group_by or []:
        if g in DIMENSIONS:
            out.append(F.col(g))
        elif g in ("year", "month", "quarter"):
            out.append(bucket("event_date", g).alias(g))
        elif g.startswith("attr:") and _KEY.match(g[5:]):
            out.append(F.get_json_object("attributes", f"$.{g[5:]}").alias(g[5:]))
        else:
            raise ValueError(f"unknown dimension {g!r}")
    return out


def list_item_stars(stars: DataFrame, filters: dict | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; the remaining order is by fact and line, so that a limit is reproducible."""
    out = stars.where(star_filter(filters)).orderBy(F.desc("event_date"), "fact_id", "line", "part_id", "quantity", "total_price")
    return out.limit(limit) if limit else out


def avg_comparable_price(stars: DataFrame, filters: dict | None = None, group_by: list[str] | None = None) -> DataFrame:
    """Mean, least and greatest EUR unit price; the unit is always part of the key."""
    p = F.col("comparable_unit_price_eur")
    rows = stars.where(star_filter(filters) & (p > 0))
    return rows.groupBy(*group_columns(group_by), "comparable_unit").agg(money_mean(p).alias("avg_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.count("*").alias("n"), F.countDistinct("vendor_key").alias("n_vendors"))


def price_by_state(stars: DataFrame, filters: dict | None = None, min_states: int = 2) -> DataFrame:
    """Mean unit price by product state, for products seen in at least min_states states per (name, unit, currency); a null unit is a unit."""
    rows = stars.where(star_filter(filters) & F.col("state").isNotNull() & (F.col("comparable_unit_price") > 0))
    key = ["comparable_name", "comparable_unit", "currency"]
    means = rows.groupBy(*key, "state").agg(money_mean("comparable_unit_price").alias("avg_price"), F.count("*").alias("n"))
    wide = means.groupBy(*key).agg(F.count("*").alias("states"))
    cond = [means[k].eqNullSafe(wide[k]) for k in key]
    return means.join(wide.where(F.col("states") >= min_states), cond, "left_semi")


def price_trend(stars: DataFrame, comparable_name: str, filters: dict | None = None, period: str = "month", by_vendor: bool = True) -> DataFrame:
    rows = stars.where(star_filter({**(filters or {}), "comparable_name": comparable_name}) & (F.col("comparable_unit_price_eur") > 0))
    keys = [bucket("event_date", period).alias("period"), "comparable_unit"]
    aggs = [money_mean("comparable_unit_price_eur").alias("avg_price"), F.count("*").alias("n")]
    if by_vendor:
        return rows.groupBy(*keys, "vendor_key").agg(F.min("vendor").alias("vendor"), *aggs)
    return rows.groupBy(*keys).agg(*aggs)


def basket_composition(stars: DataFrame, filters: dict | None = None, by: str = "category") -> DataFrame:
    (dim,) = group_columns([by])
    rows = stars.where(star_filter(filters) & product_only())
    return rows.groupBy(F.coalesce(dim, F.lit("(uncategorised)")).alias("bucket")).agg(F.count("*").alias("n"), money_sum("total_price_eur").alias("total_eur"))


def attribute_facets(stars: DataFrame, filters: dict | None = None, min_count: int = 2) -> DataFrame:
    """Key, value and count of every facet in the attributes."""
    pairs = stars.where(star_filter(filters)).select(F.explode(F.from_json("attributes", "map<string,string>")).alias("key", "value"))
    return pairs.where(~F.col("key").isin(*FACET_DENY) & F.col("value").isNotNull()).groupBy("key", "value").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def with_attributes(stars: DataFrame) -> DataFrame:
    """The state and organic columns as a JSON text of facets."""
    return stars.withColumn("attributes", F.to_json(F.struct(F.col("state"), F.col("organic").cast("string").alias("organic"), F.col("brand"))))


def category_summary(items: DataFrame, facts: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Count and raw total by category; dates select facts by a semi-join."""
    f = facts.where(star_filter({"date_from": date_from, "date_to": date_to})).select(F.col("id").alias("fact_id"))
    return items.where("category is not null").join(f, "fact_id", "left_semi").groupBy("category").agg(F.count("*").alias("n"), money_sum("total_price").alias("total"))


def cheapest_vendor(stars: DataFrame) -> DataFrame:
    """Per product and unit: the least EUR unit price and the vendor that has it (the least key of several)."""
    p = F.col("comparable_unit_price_eur")
    best = F.min(F.when(p > 0, F.struct(p.alias("price"), F.col("vendor_key").alias("vendor_key"))))
    out = stars.groupBy("comparable_name", "comparable_unit").agg(best.alias("b"))
    return out.where("b is not null").select("comparable_name", "comparable_unit", F.col("b.price").alias("min_price"), F.col("b.vendor_key").alias("vendor_key"))


def vendor_prices(stars: DataFrame) -> DataFrame:
    """Product prices across vendors: mean by product, unit and vendor."""
    return stars.where("comparable_unit_price_eur > 0").groupBy("comparable_name", "comparable_unit", "vendor_key").agg(money_mean("comparable_unit_price_eur").alias("avg_price"), F.count("*").alias("n"))


def convertible_spend(facts: DataFrame, by: str) -> DataFrame:
    """Spend of facts with a stored rate only, by vendor or month."""
    key = F.col("vendor") if by == "vendor" else bucket("event_date", "month")
    return facts.where("eur_rate is not null").groupBy(key.alias("key")).agg(money_sum(F.col("total_amount") * F.col("eur_rate")).alias("total_eur"), F.count("*").alias("n"))


def items_by_state(items: DataFrame) -> DataFrame:
    return items.where("state is not null").groupBy("state", "category").agg(F.count("*").alias("n"))
