"""Documents, identities, duplicates, corrections, templates and planned budgets as records: lists, lookups, reports and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vendors as V
from ..functions.money import money_sum
from ..functions.quantities import normalize_unit
from ..functions.similarity import seq_ratio
from .enrich import comparable_price, variant
from .resolution import hamming

# Documents


def list_documents(documents: DataFrame, created_from=None, created_to=None, offset: int = 0, limit: int = 50) -> DataFrame:
    """documents: id, created_at. A page, the newest first."""
    c = F.col("created_at")
    d = documents.where(c >= F.lit(created_from)) if created_from else documents
    d = d.where(c <= F.lit(created_to)) if created_to else d
    return d.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def document_by_id(documents: DataFrame, document_id) -> DataFrame:
    return documents.where(F.col("id") == F.lit(document_id))


def export_documents(documents: DataFrame, path: str, kind: str = "csv") -> None:
    w = documents.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path)


# Facts


def infer_fact_type(bundles: DataFrame) -> Column:
    """What a cloud of bundles is: always a purchase; other types come from rules applied later."""
    return F.lit("purchase")


def receipt_signature_equal(a: str, b: str) -> Column:
    """Columns a_/b_ slug, total, date: equal totals, no conflict of dates, equal slugs or one of four letters or more within the other."""
    sa, sb = F.col(f"{a}_slug"), F.col(f"{b}_slug")
    short, long = F.when(F.length(sa) <= F.length(sb), sa).otherwise(sb), F.when(F.length(sa) <= F.length(sb), sb).otherwise(sa)
    dates = F.col(f"{a}_date").isNull() | F.col(f"{b}_date").isNull() | (F.col(f"{a}_date") == F.col(f"{b}_date"))
    return F.coalesce((F.col(f"{a}_total") == F.col(f"{b}_total")) & dates & ((sa == sb) | ((F.length(short) >= 4) & long.contains(short))), F.lit(False))


def select_baskets(bundles: DataFrame, items: DataFrame, threshold: float = 0.5, rounds: int = 64) -> DataFrame:
    """bundles: cloud, bundle_id, slug, total, date. items: bundle_id, price. The bundles whose items stand for their cloud: of bundles that show one receipt (prices overlap by the threshold, or equal signatures) the one whose items add up nearest to its total, then with most items.

    A bundle is dropped if a better one that is kept shows the same receipt. The pairs lie within a cloud; each round settles the bundles whose better doubles are all settled."""
    from .graph import cut_lineage

    sums = items.groupBy("bundle_id").agg(F.count("*").alias("n"), F.sum(F.col("price").cast("decimal(24,2)")).alias("s"))
    b = bundles.join(sums, "bundle_id").withColumn("gap", F.abs(F.col("s") - F.col("total")))
    rank = F.struct(F.col("gap").isNull().alias("unknown"), F.coalesce("gap", F.lit(0).cast("decimal(24,2)")).alias("gap"), (-F.col("n")).alias("n"), F.col("bundle_id").alias("id"))
    b = cut_lineage(b.withColumn("rank", rank))
    side = lambda s: b.select("cloud", *[F.col(c).alias(f"{s}_{c}") for c in ("bundle_id", "slug", "total", "date", "rank", "n")])
    pairs = side("a").join(side("b"), "cloud").where("a_rank < b_rank")
    counts = items.groupBy("bundle_id", F.round("price", 2).alias("p")).agg(F.count("*").alias("c"))
    x, y = (counts.select(F.col("bundle_id").alias(f"{s}_bundle_id"), "p", F.col("c").alias(f"{s}_c")) for s in ("a", "b"))
    common = pairs.select("a_bundle_id", "b_bundle_id").join(x, "a_bundle_id").join(y, ["b_bundle_id", "p"]).groupBy("a_bundle_id", "b_bundle_id").agg(F.sum(F.least("a_c", "b_c")).alias("both"))
    pairs = pairs.join(common, ["a_bundle_id", "b_bundle_id"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    over = F.col("both") / (F.col("a_n") + F.col("b_n") - F.col("both")) >= threshold
    doubles = cut_lineage(pairs.where(over | receipt_signature_equal("a", "b")).select(F.col("a_bundle_id").alias("better"), F.col("b_bundle_id").alias("bundle_id")))
    state = cut_lineage(b.select("bundle_id").withColumn("kept", F.lit(None).cast("boolean")))
    for _ in range(rounds):
        better = doubles.join(state.select(F.col("bundle_id").alias("better"), F.col("kept").alias("k")), "better").groupBy("bundle_id").agg(F.max("k").alias("some"), F.count(F.when(F.col("k").isNull(), 1)).alias("open"))
        verdict = F.when(F.col("some"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = cut_lineage(state.join(better, "bundle_id", "left").select("bundle_id", F.coalesce("kept", verdict).alias("kept")))
        if not state.where("kept is null").head(1):
            return bundles.join(state.where("kept").select("bundle_id"), "bundle_id")
    raise RuntimeError("baskets did not settle")


def retry_forming(facts: DataFrame, bundles: DataFrame, clouds: DataFrame) -> DataFrame:
    """Facts collapsed anew from the clouds that are still forming. facts: cloud, status."""
    from .resolution import collapse_clouds

    forming = facts.where("status = 'forming'").select("cloud")
    return collapse_clouds(bundles, clouds.join(forming, "cloud", "left_semi"))


def reextract_queue(coverage: DataFrame, queue: str = "partial", limit: int = 5, threshold: float = 92.0) -> DataFrame:
    """coverage: id, n_items, coverage_pct. The least covered facts: those with some items, without any, or all."""
    low = coverage.where(F.col("coverage_pct") < threshold)
    kind = queue.replace("_", "-").lower()
    low = low.where("n_items > 0") if kind == "partial" else low.where("n_items = 0") if kind in ("item-less", "itemless", "no-items") else low
    return low.orderBy("coverage_pct", "id").limit(limit)


# Duplicates


def content_duplicates(new: DataFrame, known: DataFrame, minutes: int = 60) -> DataFrame:
    """new, known: id, vendor, date, amount, kind, minute. Each new document with the first known one of compatible vendor, equal date, amount and kind, and, where both have a time, within the minutes."""
    x = new.where("vendor is not null and date is not null and amount is not null").select(F.col("id").alias("id"), V.slug("vendor").alias("slug"), "date", "amount", "kind", "minute")
    y = known.where("vendor is not null").select(F.col("id").alias("original"), V.slug("vendor").alias("slug2"), "date", "amount", "kind", F.col("minute").alias("minute2"))
    near = F.coalesce(F.abs(F.col("minute") - F.col("minute2")) <= minutes, F.lit(True))
    hit = x.join(y, ["date", "amount", "kind"]).where(((F.col("slug") == F.col("slug2")) | V.slugs_match(F.col("slug"), F.col("slug2"))) & near)
    return hit.groupBy("id").agg(F.min("original").alias("original")).withColumn("similarity", F.lit(0.95))


def similar_images(images: DataFrame, phash: str, distance: int = 10) -> DataFrame:
    """images: id, phash. Those within the distance of one hash, the nearest first."""
    return images.withColumn("distance", hamming(F.col("phash"), F.lit(phash))).where(F.col("distance") <= distance).orderBy("distance", "id")


# Identities


def item_identities(queries: DataFrame, members: DataFrame) -> DataFrame:
    """queries: q, barcode, name. members: identity, member_type, value. By barcode, then name, then normalised name."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    asks = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(t).alias("member_type"), v.alias("value")) for r, (t, v) in enumerate([("barcode", F.col("barcode")), ("name", F.col("name")), ("normalized_name", plain(F.col("name")))])])
    hit = queries.select("q", F.inline(asks)).where("value is not null and value <> ''").join(members, ["member_type", "value"])
    return hit.groupBy("q").agg(F.min(F.struct("rank", "identity", "member_type")).alias("h")).select("q", F.col("h.identity").alias("identity"), F.col("h.member_type").alias("matched_by"))


def ensure_identities(found: DataFrame, members: DataFrame) -> DataFrame:
    """members with a new identity for each value of `found` (member_type, value) that none has yet, named by the value."""
    new = found.where("value is not null").select("member_type", "value").distinct().join(members.select("member_type", "value"), ["member_type", "value"], "left_anti")
    return members.select("identity", "member_type", "value").unionByName(new.select(F.concat_ws(":", "member_type", "value").alias("identity"), "member_type", "value"))


def fact_identities(facts: DataFrame, items: DataFrame, members: DataFrame) -> DataFrame:
    """facts: id, vendor_key. items: fact_id, barcode, name. Identities of a fact's vendor and of its items."""
    v = facts.join(members.where("member_type = 'vendor_key'"), F.col("vendor_key") == F.col("value")).select(F.col("id").alias("fact_id"), F.lit("vendor").alias("kind"), "identity")
    named = items.select("barcode", "name").distinct().withColumn("q", F.struct("barcode", "name"))
    i = item_identities(named, members).select(F.col("q.barcode").alias("b"), F.col("q.name").alias("n"), "identity")
    j = items.join(i, F.col("barcode").eqNullSafe(F.col("b")) & F.col("name").eqNullSafe(F.col("n"))).select("fact_id", F.lit("item").alias("kind"), "identity")
    return v.unionByName(j).distinct()


def taught_identities(members: DataFrame, merges: DataFrame) -> DataFrame:
    """members with the vendor names of bundles that a correction put into one cloud. merges: identity, vendor."""
    new = merges.where("vendor is not null").select("identity", F.lit("name").alias("member_type"), F.col("vendor").alias("value"))
    return members.select("identity", "member_type", "value").unionByName(new).distinct()


def vendor_display(keys: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """keys: vendor_key. names: identity, canonical. The identity's name, else the key."""
    m = members.where("member_type = 'vendor_key'").select(F.col("value").alias("vendor_key"), "identity")
    return keys.join(m.join(names, "identity"), "vendor_key", "left").select("vendor_key", F.coalesce("canonical", "vendor_key").alias("name"))


def match_vendor_patterns(vendors: DataFrame, patterns: DataFrame) -> DataFrame:
    """vendors: vendor. patterns: pattern (a regular expression), name, confidence; a small table, kept by hand. The best pattern of each vendor: its confidence where it matches, else the likeness of the names times it, if that is over 0.8."""
    n = vendors.select("vendor").distinct().withColumn("_n", F.lower(F.trim("vendor")))
    p = patterns.withColumn("_p", F.lower(F.trim("name")))
    both = n.join(F.broadcast(p), F.expr("_n rlike concat('(?i)', pattern)"), "inner").select("vendor", "name", F.col("confidence").alias("score"))
    close = n.join(F.broadcast(p), F.expr("not _n rlike concat('(?i)', pattern) and abs(length(_n) - length(_p)) <= 0.5 * greatest(length(_n), length(_p))"))
    close = close.withColumn("_r", seq_ratio("_n", "_p")).where("_r > 0.8").select("vendor", "name", (F.col("_r") * F.col("confidence")).alias("score"))
    return both.unionByName(close).groupBy("vendor").agg(F.max_by("name", F.struct("score", "name")).alias("matched"), F.max("score").alias("score"))


# Corrections


def quality_report(clouds: DataFrame, corrections: DataFrame) -> DataFrame:
    """clouds: cloud_id. corrections: cloud_id, was_false_positive. One row: clouds, corrections, the share of clouds never corrected, and of corrections that were false positives."""
    c = clouds.join(corrections.select("cloud_id").distinct().withColumn("_c", F.lit(1)), "cloud_id", "left").agg(F.count("*").alias("clouds"), F.count("_c").alias("_corrected"))
    h = corrections.agg(F.count("*").alias("corrections"), F.count(F.when(F.col("was_false_positive"), 1)).alias("_fp"))
    accuracy = F.when(F.col("clouds") > 0, 1 - F.col("_corrected") / F.col("clouds")).otherwise(1.0)
    rate = F.when(F.col("corrections") > 0, F.col("_fp") / F.col("corrections")).otherwise(0.0)
    return c.crossJoin(h).select("clouds", "corrections", F.round(accuracy, 6).alias("accuracy"), F.round(rate, 6).alias("false_positive_rate"))  # one row each


def correction_trend(corrections: DataFrame, facts: DataFrame, months: int = 12) -> DataFrame:
    """corrections: created, was_false_positive. facts: created. By month, of the last months with corrections: corrections, false positives, merges, facts made, and corrections a fact."""
    month = F.date_format("created", "yyyy-MM").alias("period")
    c = corrections.groupBy(month).agg(F.count("*").alias("corrections"), F.count(F.when(F.col("was_false_positive"), 1)).alias("false_positives"))
    f = facts.groupBy(month).agg(F.count("*").alias("facts"))
    j = c.orderBy(F.desc("period")).limit(months).join(f, "period", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))
    rate = F.when(F.col("facts") > 0, F.col("corrections") / F.col("facts")).otherwise(0.0)
    return j.withColumn("merges", F.col("corrections") - F.col("false_positives")).withColumn("rate", F.round(rate, 3))


def correction_rates(facts: DataFrame, events: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """facts: id, vendor_key, created. events: fact_id, created. By vendor: facts made and facts corrected in the window, and their ratio."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    total = facts.where(F.col("created") >= since).groupBy("vendor_key").agg(F.count_distinct("id").alias("facts"))
    fixed = events.where(F.col("created") >= since).join(facts.select(F.col("id").alias("fact_id"), "vendor_key"), "fact_id").groupBy("vendor_key").agg(F.count_distinct("fact_id").alias("corrected"))
    j = total.join(fixed, "vendor_key", "full").fillna(0, ["facts", "corrected"])
    return j.withColumn("rate", F.when(F.col("facts") > 0, F.round(F.col("corrected") / F.col("facts"), 6)).otherwise(0.0))


def refinement_suggestions(confusions: DataFrame, vendors: DataFrame, candidates: DataFrame) -> DataFrame:
    """confusions: usual, other, n. vendors: vendor_key, n. candidates: category. What to look at first: the ten most frequent confusions, the five most corrected vendors, all candidates."""
    a = confusions.orderBy(F.desc("n"), "usual", "other").limit(10).select(F.lit("category_confusion").alias("type"), F.when(F.col("n") >= 5, "high").otherwise("medium").alias("priority"), F.concat_ws(" / ", "usual", "other").alias("subject"), F.col("n").cast("long").alias("n"))
    b = vendors.orderBy(F.desc("n"), "vendor_key").limit(5).select(F.lit("vendor_corrections").alias("type"), F.when(F.col("n") >= 10, "high").otherwise("medium").alias("priority"), F.col("vendor_key").alias("subject"), F.col("n").cast("long").alias("n"))
    c = candidates.select(F.lit("refinement_candidate").alias("type"), F.lit("medium").alias("priority"), F.col("category").alias("subject"), F.lit(0).cast("long").alias("n"))
    return a.unionByName(b).unionByName(c)


def pooled_corrections(history: DataFrame, vendors: DataFrame) -> DataFrame:
    """history: vendor_key, was_false_positive. vendors: vendor_key, pos_provider. Corrections pooled over the vendors of one provider, to start new vendors from."""
    return history.join(vendors, "vendor_key").groupBy("pos_provider").agg(F.count("*").alias("n"), F.count_distinct("vendor_key").alias("vendors"), F.round(F.avg(F.col("was_false_positive").cast("double")), 6).alias("false_positive_rate"))


def template_reliability(facts: DataFrame, events: DataFrame, share: float = 0.3) -> DataFrame:
    """facts: id, vendor_key. events: fact_id, field. By vendor with corrections: fixes of each field, and whether its template is stale because they exceed the share of its facts."""
    n = facts.groupBy("vendor_key").agg(F.count("*").alias("facts"))
    by_field = events.join(facts.select(F.col("id").alias("fact_id"), "vendor_key"), "fact_id").groupBy("vendor_key", "field").agg(F.count("*").alias("fixes"))
    total = by_field.groupBy("vendor_key").agg(F.sum("fixes").alias("_all"))
    return by_field.join(total, "vendor_key").join(n, "vendor_key").select("vendor_key", "field", "fixes", (F.col("_all") / F.col("facts") > share).alias("stale"))


def audit_candidates(items: DataFrame, limit: int, vendor: str | None = None) -> DataFrame:
    """items: id, vendor, event_date, enrichment_source, comparable_name, category. Enriched items that no user confirmed, the newest first."""
    x = items.where("(enrichment_source is null or enrichment_source <> 'user_confirmed') and (comparable_name is not null or category is not null)")
    x = x.where(F.col("vendor") == vendor) if vendor else x
    return x.orderBy(F.desc("event_date"), "id").limit(limit)


def apply_audit(items: DataFrame, findings: DataFrame) -> DataFrame:
    """findings: id, comparable_name, category (null: no change). Confirmed items stay as they are."""
    f = findings.select("id", F.col("comparable_name").alias("_n"), F.col("category").alias("_c"))
    free = F.col("enrichment_source").isNull() | (F.col("enrichment_source") != "user_confirmed")
    j = items.join(f, "id", "left")
    return j.withColumn("comparable_name", F.when(free, F.coalesce("_n", "comparable_name")).otherwise(F.col("comparable_name"))).withColumn("category", F.when(free, F.coalesce("_c", "category")).otherwise(F.col("category"))).drop("_n", "_c")


# Items

#: Comparable prices above it are not believed.
CEILING = 1000.0


def clean_size(unit: Column, quantity: Column) -> Column:
    """struct(unit, quantity) of a plausible size, else null."""
    u, q = normalize_unit(unit), F.replace(quantity.cast("string"), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(unit.isNotNull() & u.isin("g", "kg", "ml", "l", "cl", "oz", "lb", "pcs") & (q > 0) & (q < 100_000), F.struct(u.alias("unit"), q.alias("quantity")))


def write_sizes(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes: id, unit, quantity, as read somewhere. Items with their unit and content and, where plausible, the comparable price worked out anew."""
    s = sizes.select("id", clean_size(F.col("unit"), F.col("quantity")).alias("_s")).where("_s is not null")
    j = items.join(s, "id", "left")
    c = comparable_price(F.col("total_price"), F.coalesce("quantity", F.lit(1.0)), F.col("_s.quantity"), F.col("_s.unit"))
    fits = F.col("_s").isNotNull() & (F.col("total_price") > 0) & (c["price"] <= CEILING)
    return j.withColumn("comparable_unit_price", F.when(fits, c["price"]).otherwise(F.col("comparable_unit_price"))).withColumn("comparable_unit", F.when(fits, c["unit"]).otherwise(F.col("comparable_unit"))).withColumn("unit", F.coalesce("_s.unit", "unit")).withColumn("unit_quantity", F.coalesce("_s.quantity", "unit_quantity")).drop("_s")


def write_attributes(items: DataFrame, found: DataFrame) -> DataFrame:
    """found: id, attributes, pack. Items with the attributes, a variant where they had none, and a counted pack as a price for each piece."""
    f = found.select("id", F.col("attributes").alias("_a"), F.col("pack").cast("double").alias("_k"))
    j = items.join(f, "id", "left")
    c = comparable_price(F.col("total_price"), F.coalesce("quantity", F.lit(1.0)), F.col("_k"), F.lit("pcs"))
    fits = F.coalesce(F.col("_k").isNotNull() & F.col("unit_quantity").isNull() & (F.col("total_price") > 0) & (c["price"] <= CEILING), F.lit(False))
    j = j.withColumn("comparable_unit_price", F.when(fits, c["price"]).otherwise(F.col("comparable_unit_price"))).withColumn("comparable_unit", F.when(fits, "pcs").otherwise(F.col("comparable_unit"))).withColumn("unit", F.when(fits, "pcs").otherwise(F.col("unit"))).withColumn("unit_quantity", F.when(fits, F.col("_k")).otherwise(F.col("unit_quantity")))
    return j.withColumn("variant", F.coalesce("variant", variant(F.col("_a")))).withColumn("attributes", F.coalesce("_a", "attributes")).drop("_a", "_k")


def product_annotations(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """annotations: target_id, key, value. Items with the sorted names and values of their annotations."""
    a = annotations.groupBy("target_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "key", "value"))).alias("annotated"))
    return items.join(a, F.col("id") == F.col("target_id"), "left").drop("target_id").withColumn("annotated", F.coalesce("annotated", F.array().cast("array<string>")))


def category_price_factors(factors: DataFrame) -> DataFrame:
    """factors of single products (category, attribute, premium, percent, observations, baseline) as means of a category, weighted by observations."""
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("observations")) / F.sum("observations"), 4)
    o, b = F.sum("observations"), F.sum("baseline")
    return factors.groupBy("category", "attribute").agg(mean("premium").alias("premium"), mean("percent").alias("percent"), o.alias("observations"), b.alias("baseline"), F.round(F.least(F.lit(1.0), o * b / (o + b) / 5), 4).alias("confidence"))


def item_nutrition(items: DataFrame, products: DataFrame, item_id) -> DataFrame:
    """The cached product data of one item, by its barcode."""
    return items.where(F.col("id") == F.lit(item_id)).join(products, "barcode", "left")


# Planned budgets and owned things


def scenario_entries(entries: DataFrame, scenario, period: str | None = None) -> DataFrame:
    """entries: scenario, period, category, amount."""
    x = entries.where(F.col("scenario") == F.lit(scenario))
    return (x.where(F.col("period") == period) if period else x).orderBy("period", "category")


def add_rows(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """table with new rows; a row of a known key takes its place."""
    return table.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_rows(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), key, "left_anti")


def owned_value(owned: DataFrame) -> DataFrame:
    """owned: category, price, warranty_until."""
    return owned.groupBy("category").agg(F.count("*").alias("n"), money_sum("price").alias("value"), F.max("warranty_until").alias("last_warranty"))


def newest_versions(rows: DataFrame, key: list[str], order: list[str], most: int = 20) -> DataFrame:
    """The last `most` versions of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
