"""Lists, look-ups and drill-downs over the entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spend import in_range


def table_stats(**tables: DataFrame) -> DataFrame:
    """Row counts by table name."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def fact_filter(filters: dict | None) -> Column:
    c = F.lit(True)
    for k, v in (filters or {}).items():
        if v in (None, ""):
            continue
        if k == "vendor":
            c = c & F.lower("vendor").contains(str(v).lower())
        elif k in ("fact_type", "vendor_key", "currency", "country", "status"):
            c = c & (F.col(k) == v)
        elif k in ("date_from", "date_to"):
            d = F.lit(v).cast("date")
            c = c & (F.col("event_date") >= d if k == "date_from" else F.col("event_date") <= d)
        elif k in ("amount_min", "amount_max"):
            c = c & (F.col("total_amount") >= v if k == "amount_min" else F.col("total_amount") <= v)
        else:
            raise ValueError(f"unknown filter {k!r}")
    return c


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in a total order (name a unique column last)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def list_facts(facts: DataFrame, items: DataFrame, filters: dict | None = None, offset: int = 0, limit: int = 50, documents: DataFrame | None = None) -> DataFrame:
    """Newest first, with the number of product lines (and the distinct types of source documents: fact_id, kind). The page is cut before anything is joined to it."""
    p = page(facts.where(fact_filter(filters)), [F.desc("event_date"), "id"], offset, limit)
    n = items.where("coalesce(category, '') <> 'Non_Item'").join(F.broadcast(p.select(F.col("id").alias("fact_id"))), "fact_id", "left_semi").groupBy("fact_id").agg(F.count("*").alias("n_items"))
    out = p.join(n, p["id"] == n["fact_id"], "left").drop("fact_id").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    if documents is not None:
        kinds = documents.groupBy("fact_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("document_types"))
        out = out.join(kinds, out["id"] == kinds["fact_id"], "left").drop("fact_id")
    return out


def count_facts(facts: DataFrame, filters: dict | None = None) -> DataFrame:
    return facts.where(fact_filter(filters)).agg(F.count("*").alias("n"))


def fact_with_items(facts: DataFrame, items: DataFrame, fact_id) -> DataFrame:
    """A fact and its items as an array."""
    i = items.where(F.col("fact_id") == fact_id).groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("name", "quantity", "total_price"))).alias("items"))
    return facts.where(F.col("id") == fact_id).join(i, F.col("id") == F.col("fact_id"), "left").drop("fact_id")


def inspect_facts(facts: DataFrame, items: DataFrame, bundles: DataFrame, atoms: DataFrame) -> DataFrame:
    """Facts with their cloud's bundles (each with its atoms) and items, nested level by level."""
    a = atoms.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("atom_id", "atom_type", "role"))).alias("atoms"))
    b = bundles.join(a, "bundle_id", "left").groupBy("cloud_id").agg(F.sort_array(F.collect_list(F.struct("bundle_id", "bundle_type", "document_id", "atoms"))).alias("bundles"))
    i = items.groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("name", "quantity", "total_price"))).alias("items"))
    return facts.join(b, "cloud_id", "left").join(i, F.col("id") == F.col("fact_id"), "left").drop("fact_id")


def list_items(items: DataFrame, facts: DataFrame, name: str | None = None, category: str | None = None, date_from=None, date_to=None) -> DataFrame:
    """Items by name or brand, category, and dates of their fact (semi-join)."""
    f = in_range(facts, date_from, date_to).select(F.col("id").alias("fact_id"))
    c = F.lit(True)
    if name:
        c = c & (F.lower("name").contains(name.lower()) | F.lower("brand").contains(name.lower()))
    if category:
        c = c & (F.col("category") == category)
    return items.where(c).join(f, "fact_id", "left_semi")


def items_with_fact(stars: DataFrame, filters: dict | None = None) -> DataFrame:
    from .stars import star_filter

    return stars.where(star_filter(filters))


def uncategorised(items: DataFrame) -> DataFrame:
    return items.where("category is null or category = ''")


def document_items(documents: DataFrame, bundles: DataFrame, facts: DataFrame, items: DataFrame) -> DataFrame:
    """Items reached from documents; several bundles of a document in one cloud repeat its items, as the chain of joins does."""
    return documents.select("document_id").join(bundles, "document_id").join(facts.select("cloud_id", F.col("id").alias("fact_id")), "cloud_id").join(items, "fact_id")


def document_facts(bundles: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct (document, fact) pairs."""
    return bundles.select("document_id", "cloud_id").join(facts.select("cloud_id", F.col("id").alias("fact_id")), "cloud_id").select("document_id", "fact_id").distinct()


def primary_facts(bundles: DataFrame, facts: DataFrame) -> DataFrame:
    return document_facts(bundles, facts).groupBy("document_id").agg(F.min("fact_id").alias("fact_id"))


def first_vendor_atoms(facts: DataFrame, bundles: DataFrame, atoms: DataFrame) -> DataFrame:
    """Of each fact the vendor atom with the least id."""
    a = atoms.where("atom_type = 'vendor'").join(bundles.select("bundle_id", "cloud_id"), "bundle_id")
    return facts.select("id", "cloud_id").join(a.groupBy("cloud_id").agg(F.min_by("data", "atom_id").alias("vendor_atom")), "cloud_id").select("id", "vendor_atom")


def unassigned_bundles(bundles: DataFrame) -> DataFrame:
    return bundles.where("cloud_id is null")


def list_clouds(clouds: DataFrame, bundles: DataFrame, status: str | None = None) -> DataFrame:
    n = bundles.where("cloud_id is not null").groupBy("cloud_id").agg(F.count("*").alias("n_bundles"))
    c = clouds if status is None else clouds.where(F.col("status") == status)
    return c.join(n, "cloud_id", "left").withColumn("n_bundles", F.coalesce("n_bundles", F.lit(0)))


def cloud_locations(annotations: DataFrame, facts: DataFrame) -> DataFrame:
    meta = F.from_json("metadata", "lat double, lng double, place_name string")
    a = annotations.where("key = 'location'").withColumn("m", meta).where("m.lat is not null and m.lng is not null")
    return facts.select(F.col("id").alias("target_id"), "cloud_id").join(a, "target_id").select("cloud_id", "m.lat", "m.lng", "m.place_name")


def list_annotations(annotations: DataFrame, **filters) -> DataFrame:
    for k, v in filters.items():
        annotations = annotations.where(F.col(k) == v)
    return annotations.orderBy("created_at", "id")


def recent_locations(annotations: DataFrame, limit: int = 20) -> DataFrame:
    """The newest annotation of each vendor and link."""
    out = annotations.groupBy("vendor_key", "url").agg(F.max("created_at").alias("created_at"), F.max_by("place_name", F.struct("created_at", "place_name")).alias("place_name"))
    return out.orderBy(F.desc("created_at"), "vendor_key", "url").limit(limit)


def warranties_expiring(owned: DataFrame, as_of, ahead: int = 90, expired: int = 30) -> DataFrame:
    d = F.lit(as_of).cast("date")
    return owned.where(F.col("status") == "active").where(F.col("warranty_expires").between(F.date_sub(d, expired), F.date_add(d, ahead))).orderBy("warranty_expires", "id")


def linked(left: DataFrame, links: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Two tables through their link table."""
    return left.join(links, left_key).join(right, right_key)


def corrections_for_vendor(events: DataFrame, facts: DataFrame, items: DataFrame, vendor_key: str) -> DataFrame:
    """Events on a vendor's facts or on their items: two equi-joins instead of one with OR."""
    f = facts.where(F.col("vendor_key") == vendor_key).select(F.col("id").alias("fact_id"))
    on_fact = events.where("entity_type = 'fact'").join(f, events["entity_id"] == f["fact_id"], "left_semi")
    i = items.join(f, "fact_id", "left_semi").select(F.col("id").alias("item_id"))
    on_item = events.where("entity_type = 'fact_item'").join(i, events["entity_id"] == i["item_id"], "left_semi")
    return on_fact.unionByName(on_item)


def review_queue(items: DataFrame, threshold: float = 0.8, limit: int = 50) -> DataFrame:
    return items.where((F.col("enrichment_source").isNotNull()) & (F.col("enrichment_confidence") < threshold)).orderBy("enrichment_confidence", "id").limit(limit)


def recent_transactions(facts: DataFrame, as_of, days: int = 30) -> DataFrame:
    d = F.lit(as_of).cast("date")
    return facts.where((F.col("event_date") > F.date_sub(d, days)) & (F.col("event_date") <= d))
