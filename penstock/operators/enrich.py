"""Deterministic enrichment of items: units, comparable prices and names, categories, states, attributes, barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantities import normalize_unit

# The category tree.
TAXONOMY = {
    "food": {
        "produce": ["vegetables", "fruit", "herbs"], "dairy": ["milk", "yogurt", "cheese", "butter"], "eggs": [], "meat": ["red_meat", "poultry", "deli"], "seafood": [], "bakery": [],
        "pantry": ["grains_pasta", "canned", "condiments_sauces", "oils", "baking"], "snacks": ["sweets", "savory"], "beverages": ["soft_drinks", "juice", "water", "coffee_tea", "energy", "alcohol"], "frozen": [], "prepared": [],
    },
    "household": [], "personal_care": [], "health": ["medicine", "medical_service"], "dining": [], "transport": ["fuel"], "services": ["telecom", "finance", "entertainment"], "pet": [], "tobacco": [], "other": [],
    "adjustment": ["tax", "discount", "service_charge", "tip", "fee", "non_item"],
}
# Product states and what else they are called.
STATES = {
    "fresh": ("fresh", "raw", "chilled", "refrigerated", "unprocessed"),
    "frozen": ("frozen", "deep-frozen", "deep_frozen"),
    "canned": ("canned", "tinned", "tin", "jarred", "in_brine", "in_oil", "in_water", "in_syrup", "preserved", "conserved"),
    "dried": ("dried", "dehydrated", "sun-dried", "sundried", "dry"),
    "cured": ("cured", "smoked", "salted", "salt-cured", "cold-smoked"),
    "pickled": ("pickled", "brined", "fermented"),
    "roasted": ("roasted", "toasted", "roast"),
    "cooked": ("cooked", "pre-cooked", "precooked", "ready-to-eat", "ready_to_eat", "prepared", "boiled", "baked", "grilled", "fried", "deli"),
}
# Prefixes of article numbers (first, last, country); where the table has gaps, no country is named.
GS1 = (
    (0, 19, "USA/Canada"),
    (20, 29, "Store internal"),
    (30, 39, "USA/Canada"),
    (300, 379, "France"),
    (380, 380, "Bulgaria"),
    (383, 383, "Slovenia"),
    (385, 385, "Croatia"),
    (387, 387, "Bosnia"),
    (389, 389, "Montenegro"),
    (400, 440, "Germany"),
    (450, 459, "Japan"),
    (460, 469, "Russia"),
    (470, 470, "Kyrgyzstan"),
    (471, 471, "Taiwan"),
    (474, 474, "Estonia"),
    (475, 475, "Latvia"),
    (476, 476, "Azerbaijan"),
    (477, 477, "Lithuania"),
    (478, 478, "Uzbekistan"),
    (479, 479, "Sri Lanka"),
    (480, 480, "Philippines"),
    (481, 481, "Belarus"),
    (482, 482, "Ukraine"),
    (484, 484, "Moldova"),
    (485, 485, "Armenia"),
    (486, 486, "Georgia"),
    (487, 487, "Kazakhstan"),
    (489, 489, "Hong Kong"),
    (490, 499, "Japan"),
    (500, 509, "UK"),
    (520, 520, "Greece"),
    (528, 528, "Lebanon"),
    (529, 529, "Cyprus"),
    (530, 530, "Albania"),
    (531, 531, "North Macedonia"),
    (535, 535, "Malta"),
    (539, 539, "Ireland"),
    (540, 549, "Belgium/Luxembourg"),
    (560, 560, "Portugal"),
    (569, 569, "Iceland"),
    (570, 579, "Denmark"),
    (590, 590, "Poland"),
    (594, 594, "Romania"),
    (599, 599, "Hungary"),
    (600, 601, "South Africa"),
    (609, 609, "Mauritius"),
    (611, 611, "Morocco"),
    (613, 613, "Algeria"),
    (616, 616, "Kenya"),
    (618, 618, "Ivory Coast"),
    (619, 619, "Tunisia"),
    (621, 621, "Syria"),
    (622, 622, "Egypt"),
    (624, 624, "Libya"),
    (625, 625, "Jordan"),
    (626, 626, "Iran"),
    (628, 628, "Saudi Arabia"),
    (629, 629, "UAE"),
    (640, 649, "Finland"),
    (690, 699, "China"),
    (700, 709, "Norway"),
    (729, 729, "Israel"),
    (730, 739, "Sweden"),
    (740, 741, "Guatemala"),
    (742, 742, "Honduras"),
    (743, 743, "Nicaragua"),
    (744, 744, "Costa Rica"),
    (745, 745, "Panama"),
    (746, 746, "Dominican Republic"),
    (750, 750, "Mexico"),
    (754, 755, "Canada"),
    (759, 759, "Venezuela"),
    (760, 769, "Switzerland"),
    (770, 770, "Colombia"),
    (773, 773, "Uruguay"),
    (775, 775, "Peru"),
    (777, 777, "Bolivia"),
    (778, 779, "Argentina"),
    (780, 780, "Chile"),
    (784, 784, "Paraguay"),
    (786, 786, "Ecuador"),
    (789, 790, "Brazil"),
    (800, 839, "Italy"),
    (840, 849, "Spain"),
    (858, 858, "Slovakia"),
    (859, 859, "Czech Republic"),
    (860, 860, "Serbia"),
    (865, 865, "Mongolia"),
    (867, 867, "North Korea"),
    (868, 869, "Turkey"),
    (870, 879, "Netherlands"),
    (880, 880, "South Korea"),
    (884, 884, "Cambodia"),
    (885, 885, "Thailand"),
    (888, 888, "Singapore"),
    (890, 890, "India"),
    (893, 893, "Vietnam"),
    (896, 896, "Pakistan"),
    (899, 899, "Indonesia"),
    (900, 919, "Austria"),
    (930, 939, "Australia"),
    (940, 949, "New Zealand"),
    (950, 950, "GS1 Global Office"),
    (955, 955, "Malaysia"),
    (958, 958, "Macau"),
)
PRICE_CEILING = 200.0


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def taxonomy_paths(tree: dict | None = None, above: str = "") -> list[str]:
    """Every node of the tree as 'a > b > c'."""
    out = []
    for name, below in (TAXONOMY if tree is None else tree).items():
        path = f"{above} > {name}" if above else name
        out.append(path)
        out.extend(taxonomy_paths(below, path) if isinstance(below, dict) else [f"{path} > {x}" for x in below])
    return out


def valid_path(raw: Column) -> Column:
    """The path with repaired separators if it is a node, else null."""
    p = F.regexp_replace(F.lower(F.trim(raw)), r"\s*(?:>|/|»|::)\s*", " > ")
    return F.when(p.isin(*taxonomy_paths()), p)


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, " > "), -1)


def unit_from_name(name: Column) -> Column:
    """struct(quantity, unit): a number with a unit, else a unit at the end, else a bare usual gram count."""
    u = r"(kg|g|gr|ml|l|lt|ltr|oz|lb|pcs|τεμ|шт|кг|г|л|мл)"
    a = rf"(?iu)(\d+(?:[.,]\d+)?)\s*{u}(?![\p{{L}}])"
    num = F.replace(F.nullif(F.regexp_extract(name, a, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    tail = F.nullif(F.regexp_extract(name, rf"(?iu)\s{u}$", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(name, r"\s(100|125|150|200|250|300|330|400|500|750|1000)$", 1), F.lit("")).try_cast("double")
    unit = F.when(num.isNotNull(), normalize_unit(F.regexp_extract(name, a, 2))).when(tail.isNotNull(), normalize_unit(tail)).when(bare.isNotNull(), "g")
    return F.struct(F.coalesce(num, F.when(tail.isNotNull(), 1.0), bare).alias("quantity"), unit.alias("unit"))


def comparable_price(total: Column, quantity: Column, unit_quantity: Column, unit: Column) -> Column:
    """struct(price, unit) per kg, l or own unit, two places, half to even; a gram or millilitre content under 5 is not believed."""
    small = unit.isin("g", "ml")
    factor = F.when(small, 1000).otherwise(1)
    per = total.cast("decimal(18,4)") * factor / (quantity * unit_quantity).cast("decimal(18,4)")
    ok = (quantity * unit_quantity > 0) & ~(small & (unit_quantity < 5))
    return F.struct(F.when(ok, F.bround(per, 2).cast("double")).alias("price"), F.when(unit == "g", "kg").when(unit == "ml", "l").otherwise(unit).alias("unit"))


def recompute_weak_prices(items: DataFrame) -> DataFrame:
    """Items without a comparable price get one, if it stays under the ceiling; running it again changes nothing."""
    c = comparable_price(F.col("total_price"), F.col("quantity"), F.col("unit_quantity"), F.col("unit"))
    weak = F.col("comparable_unit_price").isNull() | (F.col("comparable_unit_price") <= 0)
    fits = weak & (c["price"] > 0) & (c["price"] <= PRICE_CEILING)
    return items.withColumn("comparable_unit", F.when(fits, c["unit"]).otherwise(F.col("comparable_unit"))).withColumn("comparable_unit_price", F.when(fits, c["price"]).otherwise(F.col("comparable_unit_price")))


def fix_weighed(items: DataFrame) -> DataFrame:
    """A piece count that is really a weight: quantity and unit quantity are swapped where unit quantity * unit price meets the total within 2 %, and pieces become kilograms."""
    near = lambda x: F.abs(x - F.col("total_price")) <= 0.02 * F.abs(F.col("total_price"))
    hit = F.coalesce((F.col("unit") == "pcs") & near(F.col("unit_quantity") * F.col("unit_price")) & ~near(F.col("quantity") * F.col("unit_price")) & (F.col("unit_quantity") != F.floor("unit_quantity")), F.lit(False))
    return items.withColumns({"quantity": F.when(hit, F.col("unit_quantity")).otherwise(F.col("quantity")), "unit_quantity": F.when(hit, 1.0).otherwise(F.col("unit_quantity")), "unit": F.when(hit, "kg").otherwise(F.col("unit"))})


def tidy_name(name: Column) -> Column:
    """Lower case without sizes, packs and percentages; three rounds reach the fixpoint of names in use."""
    c = F.lower(F.trim(name))
    for _ in range(3):
        c = F.regexp_replace(c, r"(?iu)(?<![\p{L}\d])\d+(?:[.,]\d+)?\s*(?:kg|g|gr|ml|l|lt|oz|pcs|pk|x\s*\d+|%|τεμ|шт|кг|г|л|мл)(?![\p{L}\d])", " ")
        c = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?iu)(?<![\p{L}\d])(?:pack of \d+|x\d+|\d+x)(?![\p{L}\d])", " "), r"\s+", " "))
    return c


def keyword_category(name: Column) -> Column:
    """Coffee and tea in four languages; else null."""
    return F.when(name.rlike(r"(?iuU)\b(?:coffee|espresso|cappuccino|latte|nescafe|tea|chai|καφ[εέ]ς?|τσ[αά]ι|кофе|чай|kahve|çay)\b"), "food > beverages > coffee_tea")


def clean_state(raw: Column) -> Column:
    table = {w.replace("_", " "): k for k, ws in STATES.items() for w in ws}
    return F.try_element_at(_map(table), F.lower(F.trim(raw)))


def clean_attributes(attributes: Column) -> Column:
    """A map of facets without structural keys, blanks and values over forty characters; keys in snake case."""
    from .stars import FACET_DENY

    keyed = F.transform_keys(attributes, lambda k, _: F.regexp_replace(F.lower(F.trim(k)), r"[^a-z0-9]+", "_"))
    return F.map_filter(F.transform_values(keyed, lambda _, v: F.trim(v)), lambda k, v: ~k.isin(*FACET_DENY) & (v != "") & (F.length(v) <= 40))


def variant(attributes: Column) -> Column:
    """Size, else type, else fat."""
    return F.coalesce(*[F.try_element_at(attributes, F.lit(k)) for k in ("size", "type", "fat")])


def variant_from_name(name: Column, category: Column) -> Column:
    """Fat percentage of dairy, size of eggs, light, unsalted, strained."""
    dairy, eggs = F.coalesce(category.contains("dairy"), F.lit(False)), F.coalesce(category.contains("egg"), F.lit(False))
    fat = F.nullif(F.regexp_extract(name, r"(\d+(?:[.,]\d+)?\s*%)", 1), F.lit(""))
    size = F.nullif(F.regexp_extract(name, r"(?i)\b(XL|L|M|S)\b", 1), F.lit(""))
    out = F.coalesce(F.when(dairy, F.replace(fat, F.lit(" "), F.lit(""))), F.when(eggs, F.upper(size)))
    for word in ("light", "unsalted", "strained"):
        out = F.coalesce(out, F.when(name.rlike(rf"(?i)\b{word}\b"), word))
    return out


def barcode_propagation(items: DataFrame) -> DataFrame:
    """Items with gaps in brand, category and variant filled from the richest item of the same barcode at any vendor. The best source of a barcode is aggregated, so a hot barcode is no window in one task."""
    score = F.col("brand").isNotNull().cast("int") * 2 + F.col("category").isNotNull().cast("int") * 2 + F.col("variant").isNotNull().cast("int") + F.coalesce("enrichment_confidence", F.lit(0.0))
    best = items.where("barcode is not null").groupBy("barcode").agg(F.max_by(F.struct("brand", "category", "variant"), F.struct(score, "id")).alias("best"))
    j = items.join(best, "barcode", "left")
    return j.withColumns({c: F.coalesce(c, F.col(f"best.{c}")) for c in ("brand", "category", "variant")}).drop("best")


def gs1_country(spark: SparkSession, codes: DataFrame) -> DataFrame:
    """barcode -> country: a range join on the three-digit prefix with a fixed table of a few dozen rows."""
    table = spark.createDataFrame(GS1, "first int, last int, country string")
    p = codes.where(F.col("barcode").rlike(r"^\d{8,14}$")).withColumn("p", F.substring(F.lpad("barcode", 13, "0"), 1, 3).cast("int"))
    return p.join(F.broadcast(table), F.col("p").between(F.col("first"), F.col("last")), "left").select("barcode", "country")


def company_brand(items: DataFrame) -> DataFrame:
    """The usual brand of each seven-digit company prefix."""
    n = items.where("barcode is not null and brand is not null").groupBy(F.substring("barcode", 1, 7).alias("prefix"), "brand").agg(F.count("*").alias("n"))
    return n.groupBy("prefix").agg(F.max_by("brand", F.struct("n", "brand")).alias("brand"))


def cascade(items: DataFrame, sources: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """sources in order of trust: name, confidence, table (barcode, brand, category). The first source that answers gives the row, even where it leaves a field empty."""
    out = items
    for k, (_, _, table) in enumerate(sources):
        t = table.dropDuplicates(["barcode"]).select("barcode", F.struct("brand", "category").alias(f"_s{k}"))
        out = out.join(t, "barcode", "left")
    pick = F.coalesce(*[F.col(f"_s{k}") for k in range(len(sources))])
    name, conf = F.lit(None).cast("string"), F.lit(None).cast("double")
    for k, (n, c, _) in reversed(list(enumerate(sources))):
        name, conf = F.when(F.col(f"_s{k}").isNotNull(), n).otherwise(name), F.when(F.col(f"_s{k}").isNotNull(), c).otherwise(conf)
    out = out.withColumns({"_p": pick, "enrichment_source": name, "enrichment_confidence": conf})
    return out.withColumns({"brand": F.coalesce("brand", "_p.brand"), "category": F.coalesce("category", "_p.category")}).drop("_p", *[f"_s{k}" for k in range(len(sources))])


def mode_cascade(items: DataFrame, value: str) -> DataFrame:
    """Per (name, vendor_key, brand): the usual value at the same vendor (.95), of the same brand (.85), anywhere (.75)."""
    rows = items.where(F.col(value).isNotNull())

    def mode(keys: list[str], as_: str) -> DataFrame:
        n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
        return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", value)).alias(as_))

    asked = items.select("name", "vendor_key", "brand").distinct()
    out = asked.join(mode(["name", "vendor_key"], "a"), ["name", "vendor_key"], "left").join(mode(["name", "brand"], "b"), ["name", "brand"], "left").join(mode(["name"], "c"), "name", "left")
    conf = F.when(F.col("a").isNotNull(), 0.95).when(F.col("b").isNotNull(), 0.85).when(F.col("c").isNotNull(), 0.75)
    return out.select("name", "vendor_key", "brand", F.coalesce("a", "b", "c").alias(value), conf.alias("confidence"))


def vendor_default_category(stars: DataFrame, least: int = 5) -> DataFrame:
    n = stars.where("category is not null").groupBy("vendor_key", "category").agg(F.count("*").alias("n"))
    return n.groupBy("vendor_key").agg(F.max(F.struct("n", "category")).alias("t")).where(F.col("t.n") >= least).select("vendor_key", F.col("t.category").alias("category"), F.col("t.n").alias("n"))


def sibling_names(items: DataFrame) -> DataFrame:
    """Missing comparable names from items of the same normalised name (the least one)."""
    m = items.where("comparable_name is not null").groupBy("name_normalized").agg(F.min("comparable_name").alias("_c"))
    return items.join(m, "name_normalized", "left").withColumn("comparable_name", F.coalesce("comparable_name", "_c")).drop("_c")


def fill_by_brand(items: DataFrame, brands: dict[str, str]) -> DataFrame:
    return items.withColumn("category", F.coalesce("category", F.try_element_at(_map({k.lower(): v for k, v in brands.items()}), F.lower("brand"))))


def garbage(items: DataFrame) -> Column:
    """Names that are no products: too long, too short, totals and rules."""
    n = F.lower(F.trim("name"))
    return F.coalesce((F.length(n) > 200) | (F.length(n) <= 2) | n.rlike(r"^(?:sub)?total\b|^[-=*_. ]+$|^(?:cash|change|card|visa|mastercard|vat|tax)$"), F.lit(True))


def stamp_source(items: DataFrame) -> DataFrame:
    hit = F.col("brand").isNotNull() & F.col("category").isNotNull() & F.col("enrichment_source").isNull()
    return items.withColumns({"enrichment_source": F.when(hit, "extraction").otherwise(F.col("enrichment_source")), "enrichment_confidence": F.when(hit, 0.70).otherwise(F.col("enrichment_confidence"))})


def clean_members(members: DataFrame, identities: DataFrame) -> DataFrame:
    return members.dropDuplicates(["identity", "member_type", "value"]).join(identities, "identity", "left_semi")


def pending(items: DataFrame, field: str, sentinel: str) -> DataFrame:
    """Rows that a model has still to answer, each with its batch of a vendor's rows."""
    return items.where(F.col(field).isNull() & (F.coalesce(F.col(sentinel), F.lit(0)) == 0))


def enrich_with(items: DataFrame, field: str, sentinel: str, answer, batch: int = 20) -> DataFrame:
    """answer: a function of a list of names to a list of values or None, called in batches of one vendor's names; answered rows are stamped."""
    import pandas as pd

    kind = items.schema[field].dataType.simpleString()

    def run(frames):
        for f in frames:
            got = []
            for _, g in f.groupby("vendor_key", sort=False, dropna=False):
                for k in range(0, len(g), batch):
                    part = g.iloc[k : k + batch]
                    got.append(pd.DataFrame({"id": part["id"], "_v": answer(part["name"].tolist())}))
            yield pd.concat(got) if got else pd.DataFrame({"id": [], "_v": []})

    todo = pending(items, field, sentinel).select("id", "name", "vendor_key")
    said = todo.repartition("vendor_key").sortWithinPartitions("vendor_key", "id").mapInPandas(run, f"id {items.schema['id'].dataType.simpleString()}, _v {kind}").withColumn("_done", F.lit(True))
    return items.join(said, "id", "left").withColumns({field: F.coalesce(field, "_v"), sentinel: F.when(F.col("_done"), 1).otherwise(F.col(sentinel))}).drop("_v", "_done")


def is_non_product(name: Column, price: Column) -> Column:
    """Totals, payments and rounding lines; a discount line only where its price is not positive."""
    always = name.rlike(r"(?iu)^\s*(?:sub\s*-?total|total|σύνολο|итого|toplam|cash|change|card|visa|rounding|vat|φπα|ндс|kdv)\b")
    return F.coalesce(always | (name.rlike(r"(?iu)discount|έκπτωση|скидка|indirim") & (price <= 0)), F.lit(False))


def document_kind(has_items: Column, has_payment: Column, text: Column) -> Column:
    """Reclassification by what a document shows."""
    return F.when(~has_items & has_payment, "payment_confirmation").when(text.rlike(r"(?iu)\binvoice\b|τιμολόγιο|счет-фактура|fatura"), "invoice").otherwise("receipt")


def plausible_date(text: Column, as_of: Column) -> Column:
    """The latest date of a text that isn't in the future nor over ten years old."""
    from ..functions.dates import parse_date

    found = F.regexp_extract_all(text, F.lit(r"(\d{1,4}[-/.]\d{1,2}[-/.]\d{2,4})"), 1)
    return F.array_max(F.filter(F.transform(found, lambda x: parse_date(x)), lambda d: (d <= as_of) & (d > F.add_months(as_of, -120))))


def overlay(specific: DataFrame, general: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Configuration of a specific scope over a general one."""
    g = general.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    return specific.join(g, keys, "full").select(*keys, *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


def merge_pages(pages: DataFrame, fields: list[str], by: str = "document_id") -> DataFrame:
    """The first non-null value of each field by page, and all line items in page order."""
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("page"))).alias(f) for f in fields]
    return pages.groupBy(by).agg(*first, F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_items"))), lambda x: x["line_items"])).alias("line_items"))
