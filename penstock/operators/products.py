"""What a cached product says about an item: category, brand, variant, attributes, and a content where the item has none.

Products are JSON texts by barcode, read by path; only the fields that are used are parsed. Defined results: a text that isn't
JSON, a null or an empty one says nothing; tags that aren't a list are ignored; of repeated products of one barcode the
greatest text counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of category tags that make the fat content a variant; words of labels -> attribute.
FAT_WORDS = ("milk", "dairy", "yogurt", "cheese", "cream", "butter")
LABELS = {"organic": ("organic", "bio"), "wholegrain": ("wholegrain", "whole-grain"), "free-range": ("free-range",), "gluten-free": ("gluten-free", "sans gluten"), "lactose-free": ("lactose-free", "sans lactose")}
# Unit of a product -> (unit of the item, factor).
CONTENT_UNITS = {"g": ("kg", 0.001), "kg": ("kg", 1.0), "ml": ("l", 0.001), "cl": ("l", 0.01), "l": ("l", 1.0), "oz": ("oz", 1.0), "lb": ("lb", 1.0)}
SOURCE, CONFIDENCE = "product_cache", 0.95
_SCHEMA = "brands string, categories string, categories_tags array<string>, labels_tags array<string>, quantity string, nutriments struct<fat_100g:string>"


def parsed(product: Column) -> Column:
    return F.from_json(product, _SCHEMA)


def category(p: Column) -> Column:
    """The last tag without its language, in title case; else the last of the comma-separated categories."""
    tag = F.regexp_replace(F.try_element_at(p["categories_tags"], F.lit(-1)), "^[^:]*:", "")
    return F.coalesce(F.initcap(F.replace(tag, F.lit("-"), F.lit(" "))), F.nullif(F.trim(F.element_at(F.split(p["categories"], ","), -1)), F.lit("")))


def variant(p: Column) -> Column:
    """The fat content of what the tags call dairy, without trailing zeros."""
    tags = F.lower(F.array_join(p["categories_tags"], " "))
    fat = p["nutriments"]["fat_100g"].try_cast("double")
    shown = F.regexp_replace(F.format_string("%.4f", fat), r"\.?0+$", "")
    return F.when(tags.rlike("|".join(FAT_WORDS)), F.concat(shown, F.lit("%")))


def attributes(p: Column) -> Column:
    """Attributes that the labels name, in the order of the table."""
    labels = F.transform(F.coalesce(p["labels_tags"], F.array().cast("array<string>")), F.lower)
    named = F.array_join(labels, "\n")
    return F.array_compact(F.array(*[F.when(named.rlike("|".join(words)), name) for name, words in LABELS.items()]))


def content(p: Column) -> Column:
    """struct(unit, unit_quantity) of the first number with a unit; grams as kilograms, millilitres as litres."""
    shape = r"(?i)(\d+(?:[.,]\d+)?)\s*(kg|g|ml|l|cl|oz|lb)\b"
    table = lambda k: F.create_map(*[F.lit(x) for u, v in CONTENT_UNITS.items() for x in (u, v[k])])
    unit = F.lower(F.regexp_extract(p["quantity"], shape, 2))
    n = F.replace(F.regexp_extract(p["quantity"], shape, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.struct(F.try_element_at(table(0), unit).alias("unit"), F.round(n * F.try_element_at(table(1), unit), 9).alias("unit_quantity"))


def from_products(items: DataFrame, products: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """items (barcode, brand, category, unit, unit_quantity, ...) and what their product says; products: barcode, product.

    Brand and category of the product replace the item's. Unit and content come only to items in pieces without a content: from
    the product, else from history (barcode, unit, unit_quantity; one row a barcode). The products are parsed once a barcode,
    before the join, and the join carries parsed fields only.
    """
    one = products.where("barcode is not null").groupBy("barcode").agg(F.max("product").alias("product")).select("barcode", parsed(F.col("product")).alias("p"))
    brand = F.nullif(F.trim(F.get(F.split("p.brands", ","), F.lit(0))), F.lit(""))
    facts = one.select("barcode", F.struct(brand.alias("brand"), category(F.col("p")).alias("category"), variant(F.col("p")).alias("variant"), attributes(F.col("p")).alias("attributes"), content(F.col("p")).alias("content")).alias("_p"))
    rows = items.join(facts, "barcode", "left")
    unit, quantity = F.col("_p.content.unit"), F.col("_p.content.unit_quantity")
    if history is not None:
        rows = rows.join(history.select("barcode", F.struct(F.col("unit").alias("unit"), F.col("unit_quantity").cast("double").alias("unit_quantity")).alias("_h")), "barcode", "left")
        unit, quantity = F.coalesce(unit, F.col("_h.unit")), F.coalesce(quantity, F.col("_h.unit_quantity"))
    bare = F.col("unit_quantity").isNull() & F.coalesce(F.col("unit").isin("pcs", "other", ""), F.lit(True)) & quantity.isNotNull()
    said = F.col("_p.brand").isNotNull() | F.col("_p.category").isNotNull()
    return rows.withColumns({
        "brand": F.coalesce("_p.brand", "brand"), "category": F.coalesce("_p.category", "category"), "variant": F.col("_p.variant"), "attributes": F.col("_p.attributes"),
        "unit": F.when(bare, unit).otherwise(F.col("unit")), "unit_quantity": F.when(bare, quantity).otherwise(F.col("unit_quantity").cast("double")),
        "enrichment_source": F.when(said, SOURCE), "enrichment_confidence": F.when(said, CONFIDENCE),
    }).drop("_p", "_h")
