"""Writes as new versions of tables: appends without doubles, patches with an audit trail, cascading deletes, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_or_ignore(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """table with the rows of new whose key isn't there; of several new rows with a key one is kept."""
    return table.unionByName(new.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return table.join(new.select(*key), key, "left_anti").unionByName(new.select(*table.columns))


def patch(table: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """changes: key and some of fields, null meaning untouched. (patched table, one event for each changed field)."""
    c = changes.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    j = table.join(c, table[key] == F.col("_k"), "left")
    events = j.where("_k is not null").select(F.col(key).alias("entity_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old"), F.col(f"_{f}").cast("string").alias("new")) for f in fields]))).where("new is not null and not (new <=> old)")
    out = j.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).select(*table.columns)
    return out, events


def propagate(items: DataFrame, changed: DataFrame, fields: list[str], confidence: float = 0.90) -> DataFrame:
    """Fields of corrected items (name_normalized and fields) to items of the same name that no user confirmed."""
    c = changed.groupBy("name_normalized").agg(*[F.max(f).alias(f"_{f}") for f in fields])
    free = F.coalesce(F.col("enrichment_source") != "user_confirmed", F.lit(True))
    hit = free & F.col("_seen")
    j = items.join(c.withColumn("_seen", F.lit(True)), "name_normalized", "left")
    sets = {f: F.when(hit, F.coalesce(f"_{f}", f)).otherwise(F.col(f)) for f in fields}
    return j.withColumns({**sets, "enrichment_confidence": F.when(hit, confidence).otherwise(F.col("enrichment_confidence"))}).select(*items.columns)


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """tables: documents, bundles, atoms, facts, items. Without the documents in gone (document_id), their bundles and atoms, and the facts of clouds that are left without a bundle."""
    t = dict(tables)
    t["documents"] = t["documents"].join(gone, "document_id", "left_anti")
    t["atoms"] = t["atoms"].join(gone, "document_id", "left_anti")
    before, t["bundles"] = t["bundles"], t["bundles"].join(gone, "document_id", "left_anti")
    empty = before.select("cloud_id").distinct().join(t["bundles"].select("cloud_id"), "cloud_id", "left_anti")
    dead = t["facts"].join(empty, "cloud_id", "left_semi").select(F.col("id").alias("fact_id"))
    t["items"] = t["items"].join(dead, "fact_id", "left_anti")
    t["facts"] = t["facts"].join(empty, "cloud_id", "left_anti")
    return t


def delete_facts(facts: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, items, clouds that are forming again)."""
    reset = facts.join(gone, facts["id"] == gone["fact_id"], "left_semi").select("cloud_id").distinct()
    return facts.join(gone, facts["id"] == gone["fact_id"], "left_anti"), items.join(gone, "fact_id", "left_anti"), reset


def orphans(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents that no child refers to."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)), parent_key, "left_anti")


def changes(current: DataFrame, snapshot: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Column by column against a snapshot: null equals the empty text; rows that are gone are ignored."""
    s = snapshot.select(F.col(key), *[F.col(f).alias(f"_{f}") for f in fields])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), text(f"_{f}").alias("old"), text(f).alias("new")) for f in fields])
    return current.join(s, key).select(key, F.inline(pairs)).where("old <> new")


def migrate_annotations(annotations: DataFrame, old_items: DataFrame, new_items: DataFrame) -> DataFrame:
    """Annotations on items move to the new item of the same fact and name."""
    o = old_items.select(F.col("id").alias("target_id"), "fact_id", F.lower("name").alias("_n"))
    n = new_items.groupBy("fact_id", F.lower("name").alias("_n")).agg(F.min("id").alias("new_id"))
    return annotations.join(o.join(n, ["fact_id", "_n"]), "target_id").select(*[F.col("new_id").alias("target_id") if c == "target_id" else F.col(c) for c in annotations.columns])


def confirm(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: id, accept, brand, category. Confirmed rows get the values with confidence 1; rejected ones lose their brand, category and source."""
    d = decisions.select("id", "accept", F.col("brand").alias("_b"), F.col("category").alias("_c"))
    yes, no = F.coalesce(F.col("accept"), F.lit(False)), F.coalesce(~F.col("accept"), F.lit(False))
    j = items.join(d, "id", "left")
    return j.withColumns(
        {"brand": F.when(no, None).otherwise(F.coalesce("_b", "brand")), "category": F.when(no, None).otherwise(F.coalesce("_c", "category")), "enrichment_source": F.when(yes, "user_confirmed").when(no, None).otherwise(F.col("enrichment_source")), "enrichment_confidence": F.when(yes, 1.0).when(no, None).otherwise(F.col("enrichment_confidence"))}
    ).select(*items.columns)


def fx_backfill(facts: DataFrame, rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rates: currency, rate_date, eur_per_unit. (facts with rates of their exact day, what stays unresolved by currency). Distinct days are resolved once."""
    wanted = facts.where("eur_rate is null and event_date is not null and coalesce(currency, 'EUR') <> 'EUR'").select("currency", F.col("event_date").alias("rate_date")).distinct()
    found = wanted.join(rates, ["currency", "rate_date"]).select("currency", F.col("rate_date").alias("event_date"), F.col("eur_per_unit").alias("_r"))
    out = facts.join(found, ["currency", "event_date"], "left").withColumn("eur_rate", F.coalesce("eur_rate", F.when(F.coalesce("currency", F.lit("EUR")) == "EUR", 1.0), "_r")).select(*facts.columns)
    return out, out.where("eur_rate is null").groupBy("currency").agg(F.count("*").alias("n"))


def cross_rates(rub: DataFrame) -> DataFrame:
    """rub: currency, rate_date, nominal, value (decimal comma, rubles for nominal units). EUR for a unit of each currency."""
    r = rub.withColumn("per", F.replace(F.col("value"), F.lit(","), F.lit(".")).cast("double") / F.col("nominal"))
    e = r.where("currency = 'EUR'").select("rate_date", F.col("per").alias("eur"))
    out = r.join(e, "rate_date").select("currency", "rate_date", (F.col("per") / F.col("eur")).alias("eur_per_unit"))
    return out.unionByName(e.select(F.lit("RUB").alias("currency"), "rate_date", (1 / F.col("eur")).alias("eur_per_unit")))
