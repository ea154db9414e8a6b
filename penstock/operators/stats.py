"""Statistical operators: subscriptions, anomalies, patterns, price factors, nutrition, places, coverage, reconciliation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bucket
from ..functions.geo import haversine
from ..functions.money import money_mean, money_sum
from .places import place_clusters
from .spend import SPEND, vendor_group

# Period, days, tolerance.
PERIODS = (("weekly", 7, 2), ("biweekly", 14, 3), ("monthly", 30, 4), ("quarterly", 91, 10), ("semiannual", 182, 14), ("annual", 365, 21))


def amount_clusters(facts: DataFrame, tolerance: float = 0.1, least: int = 3) -> DataFrame:
    """Payments by vendor and cluster of like amounts. In ascending order an amount joins the running cluster if it is within the tolerance of its mean so far.

    Equal amounts always end up together, so the scan takes each amount of a vendor once, with its count: what a task reads grows with a vendor's different amounts, not with its payments. It is streamed; no vendor is held in memory as a whole."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vendor, total, n, cluster = None, 0.0, 0, -1
        for f in frames:
            out = []
            for v, a, k in zip(f["g"], f["total_amount"], f["k"], strict=True):
                if v != vendor:
                    vendor, total, n, cluster = v, 0.0, 0, -1
                mean = total / n if n else None
                if mean is None or (mean > 0 and abs(a - mean) / mean > tolerance):
                    cluster, total, n = cluster + 1, 0.0, 0
                total, n = total + a * k, n + k
                out.append(cluster)
            yield f[["g", "total_amount"]].assign(cluster=out)

    rows = facts.where("total_amount is not null and event_date is not null").withColumn("g", vendor_group()).select("g", "id", "total_amount", "event_date")
    amounts = rows.groupBy("g", "total_amount").agg(F.count("*").alias("k"))
    often = amounts.groupBy("g").agg(F.sum("k").alias("n")).where(F.col("n") >= least).select("g")
    dealt = amounts.join(often, "g", "left_semi").repartition("g").sortWithinPartitions("g", "total_amount")
    return rows.join(dealt.mapInPandas(scan, "g string, total_amount double, cluster int"), ["g", "total_amount"]).select("g", "id", "total_amount", "event_date", "cluster")


def classify_period(mean_gap: Column) -> tuple[Column, Column]:
    """(period, score 1 - deviation / tolerance); a deviation of the whole tolerance scores 0 and is irregular."""
    name, score = F.lit("irregular"), F.lit(0.0)
    for p, days, tol in reversed(PERIODS):
        s = 1 - F.abs(mean_gap - days) / tol
        name, score = F.when(s > 0, p).otherwise(name), F.when(s > 0, s).otherwise(score)
    return name, score


def detect_subscriptions(facts: DataFrame, items: DataFrame | None = None, least: int = 3, tolerance: float = 0.1, min_confidence: float = 0.5) -> DataFrame:
    """Clusters with regular gaps: period, confidence, next date. A vendor with two or more items a fact is a shop and not a subscription."""
    rows = facts
    if items is not None:
        per = items.groupBy("fact_id").agg(F.count("*").alias("k"))
        load = facts.join(per, facts["id"] == per["fact_id"], "left").groupBy(vendor_group().alias("g")).agg(F.sum(F.coalesce("k", F.lit(0))).alias("k"), F.count("*").alias("n"))
        shops = load.where("k >= 2 * n").select("g")
        rows = facts.withColumn("g", vendor_group()).join(shops, "g", "left_anti").drop("g")
    c = amount_clusters(rows, tolerance, least)
    gap = F.datediff("event_date", F.lag("event_date").over(Window.partitionBy("g", "cluster").orderBy("event_date", "id")))
    s = c.withColumn("gap", gap).groupBy("g", "cluster").agg(
        F.count("*").alias("n"), money_mean("total_amount").alias("mean_amount"), F.avg(F.when(F.col("gap") > 0, F.col("gap"))).alias("m"), F.coalesce(F.stddev_samp(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0.0)).alias("sd"), F.max("event_date").alias("last_date")
    )
    period, score = classify_period(F.col("m"))
    steady = F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("m"))
    conf = 0.6 * steady + 0.3 * score + F.least(F.lit(0.1), 0.02 * (F.col("n") - 2))
    out = s.where((F.col("n") >= least) & F.col("m").isNotNull()).withColumn("period", period).withColumn("confidence", F.round(conf, 4))
    return out.where(F.col("confidence") >= min_confidence).select(F.col("g").alias("vendor_group"), "cluster", "n", "mean_amount", "period", "confidence", "last_date", F.date_add("last_date", F.round("m").cast("int")).alias("next_date"), F.round("m").cast("int").alias("days"))


def upcoming_payments(subscriptions: DataFrame, as_of, horizon: int = 30) -> DataFrame:
    """Each date of each subscription within the horizon."""
    a = F.lit(as_of).cast("date")
    late = F.greatest(F.lit(0), F.ceil(F.datediff(a, "next_date") / F.col("days"))).cast("int")
    first = F.expr("date_add(next_date, late * days)")
    rows = subscriptions.where("days > 0").withColumn("late", late).withColumn("first", first).where(F.col("first") <= F.date_add(a, horizon))
    k = F.floor(F.datediff(F.date_add(a, horizon), "first") / F.col("days")).cast("int")
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), k))).select("vendor_group", "cluster", "mean_amount", F.expr("date_add(first, k * days)").alias("due"))


def mark_subscriptions(facts: DataFrame, fact_ids: DataFrame) -> DataFrame:
    """facts with the type of those in fact_ids (id) changed."""
    hit = fact_ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return facts.join(hit, "id", "left").withColumn("fact_type", F.when(F.col("_hit"), "subscription_payment").otherwise(F.col("fact_type"))).drop("_hit")


def detect_anomalies(facts: DataFrame, items: DataFrame, as_of, lookback_days: int = 90, threshold: float = 2.0) -> DataFrame:
    """Spend that stands out in its category, or over all: as a vendor's only visit or as an amount. A missing amount counts as 0. Statistics are joined back from grouped aggregates, so no category is windowed in one task."""
    a = F.lit(as_of).cast("date")
    first = items.groupBy("fact_id").agg(F.min("category").alias("category"))
    rows = facts.where(F.col("fact_type").isin(*SPEND) & (F.col("event_date") > F.date_sub(a, lookback_days)) & (F.col("event_date") <= a))
    rows = rows.join(first, rows["id"] == first["fact_id"], "left").select("id", "vendor", F.coalesce("total_amount", F.lit(0.0)).alias("amount"), F.coalesce("category", F.lit("uncategorized")).alias("category"))
    by = rows.groupBy("category").agg(F.count("*").alias("cn"), money_mean("amount").alias("cm"), F.round(F.stddev_samp("amount"), 4).alias("cs"))
    every = rows.agg(F.count("*").alias("on"), money_mean("amount").alias("om"), F.round(F.stddev_samp("amount"), 4).alias("os"))
    visits = rows.groupBy("vendor").agg(F.count("*").alias("visits"))
    cz = F.round((F.col("amount") - F.col("cm")) / F.col("cs"), 3)
    oz = F.round((F.col("amount") - F.col("om")) / F.col("os"), 3)
    hit_c, hit_o = (F.col("cn") > 2) & (F.col("cs") > 0) & (cz > threshold), (F.col("on") > 2) & (F.col("os") > 0) & (oz > threshold)
    out = rows.join(by, "category").join(visits, "vendor").crossJoin(F.broadcast(every))
    kind = F.when(hit_c, "category").when(hit_o & (F.col("visits") == 1), "new_vendor").when(hit_o, "amount")
    severity = F.when(hit_c, cz / 5).when(hit_o & (F.col("visits") == 1), oz / 4).when(hit_o, oz / 5)
    return out.select("id", "vendor", "category", "amount", kind.alias("kind"), F.round(F.least(F.lit(1.0), severity), 3).alias("severity")).where("kind is not null")


def spending_patterns(facts: DataFrame) -> DataFrame:
    """Month by month: expense, income, net, savings rate."""
    spent = F.col("fact_type").isin(*SPEND)
    out = facts.groupBy(bucket("event_date", "month").alias("month")).agg(F.coalesce(money_sum(F.when(spent, F.col("total_amount"))), F.lit(0.0)).alias("expense"), F.coalesce(money_sum(F.when(~spent, F.col("total_amount"))), F.lit(0.0)).alias("income"))
    return out.withColumn("net", F.col("income") - F.col("expense")).withColumn("savings_rate", F.when(F.col("income") > 0, F.round(F.col("net") / F.col("income") * 100, 4)))


def month_top_categories(facts: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """The k categories with most spend of each month; a fact has the category of its first item."""
    first = items.groupBy("fact_id").agg(F.min("category").alias("category"))
    rows = facts.where(F.col("fact_type").isin(*SPEND)).join(first, F.col("id") == F.col("fact_id")).groupBy(bucket("event_date", "month").alias("month"), "category").agg(money_sum("total_amount").alias("total"))
    rank = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("total"), "category"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def category_trend(facts: DataFrame, items: DataFrame, flat: float = 0.05) -> DataFrame:
    """Least-squares slope over all months (absent ones are 0) relative to the mean, by category."""
    first = items.groupBy("fact_id").agg(F.min("category").alias("category"))
    rows = facts.where(F.col("fact_type").isin(*SPEND)).join(first, F.col("id") == F.col("fact_id")).groupBy(F.trunc("event_date", "MM").alias("m"), "category").agg(money_sum("total_amount").alias("t"))
    span = rows.agg(F.min("m").alias("m0"), F.max("m").alias("m1"))  # one row
    n = F.months_between("m1", "m0").cast("int") + 1
    x = F.months_between("m", "m0").cast("int")
    sums = rows.crossJoin(F.broadcast(span)).groupBy("category").agg(money_sum("t").alias("s"), money_sum(F.col("t") * x).alias("sx"), F.first(n).alias("n"))
    k = F.col("n").cast("double")
    slope = (F.col("sx") - F.col("s") * (k - 1) / 2) / (k * (k * k - 1) / 12)
    rel = F.round(slope / (F.col("s") / k), 4)
    return sums.select("category", F.round("s", 2).alias("total"), rel.alias("slope"), F.when(rel > flat, "increasing").when(rel < -flat, "decreasing").otherwise("stable").alias("trend"))


def compare_periods(facts: DataFrame, items: DataFrame, p1: tuple, p2: tuple, limit: int | None = 10) -> DataFrame:
    """Category spend in two inclusive periods and the change in percent; from nothing to something is 100."""
    first = items.groupBy("fact_id").agg(F.min("category").alias("category"))
    rows = facts.where(F.col("fact_type").isin(*SPEND)).join(first, F.col("id") == F.col("fact_id"), "left").withColumn("category", F.coalesce("category", F.lit("uncategorized")))
    inside = lambda p: F.col("event_date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))
    out = rows.where(inside(p1) | inside(p2)).groupBy("category").agg(F.coalesce(money_sum(F.when(inside(p1), F.col("total_amount"))), F.lit(0.0)).alias("before"), F.coalesce(money_sum(F.when(inside(p2), F.col("total_amount"))), F.lit(0.0)).alias("after"))
    change = F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100).when(F.col("after") > 0, 100.0).otherwise(0.0)
    out = out.withColumn("change", F.round(change, 4))
    return out.orderBy(F.desc(F.abs("change")), "category").limit(limit) if limit else out


def price_factors(rows: DataFrame, least_with: int = 2) -> DataFrame:
    """rows: product, price, attributes array. Per product and attribute: mean with and without it and the premium. Not in EUR, not by unit."""
    total = rows.groupBy("product").agg(F.count("*").alias("n"), money_sum("price").alias("s"))
    with_ = rows.select("product", "price", F.explode(F.array_distinct("attributes")).alias("attribute")).groupBy("product", "attribute").agg(F.count("*").alias("n1"), money_sum("price").alias("s1"))
    out = with_.join(total, "product").withColumn("n0", F.col("n") - F.col("n1")).where((F.col("n1") >= least_with) & (F.col("n0") >= 1))
    m1, m0 = F.col("s1") / F.col("n1"), (F.col("s") - F.col("s1")) / F.col("n0")
    conf = F.least(F.lit(1.0), F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0")) / 5)
    return out.select("product", "attribute", "n1", "n0", F.round(m1, 4).alias("with_mean"), F.round(m0, 4).alias("without_mean"), F.round((m1 - m0) / m0 * 100, 3).alias("premium"), F.round(conf, 4).alias("confidence"))


def factor_summary(factors: DataFrame, limit: int | None = 20) -> DataFrame:
    """Premiums over products, weighted by observations."""
    out = factors.groupBy("attribute").agg(F.count("*").alias("products"), F.sum("n1").alias("n"), F.round(money_sum(F.col("premium") * F.col("n1")) / F.sum("n1"), 3).alias("premium"))
    return out.orderBy(F.desc(F.abs("premium")), "attribute").limit(limit) if limit else out


#: The nutriments kept.
NUTRIMENTS = ("energy-kcal", "fat", "saturated-fat", "carbohydrates", "sugars", "fiber", "proteins", "salt")


def nutrition_rows(items: DataFrame, facts: DataFrame, cache: DataFrame) -> DataFrame:
    """Items with a cached product: each nutriment times the grams or millilitres bought. Negative cache entries count as missing."""
    f = facts.select(F.col("id").alias("fact_id"), "event_date")
    j = items.join(f, "fact_id").join(cache.where("coalesce(get_json_object(data, '$._not_found'), 'false') <> 'true'"), "barcode", "left")
    grams = F.col("quantity") * F.col("unit_quantity") * F.when(F.col("unit").isin("kg", "l"), 1000.0).when(F.col("unit").isin("g", "ml"), 1.0)
    out = j.withColumn("grams", grams)
    for n in NUTRIMENTS:
        per100 = F.get_json_object("data", f"$.nutriments['{n}_100g']").cast("double")
        out = out.withColumn(n.replace("-", "_"), F.round(per100 * F.col("grams") / 100, 3))
    return out.withColumn("grade", F.get_json_object("data", "$.nutriscore_grade")).withColumn("known", F.col("data").isNotNull())


def nutrition_summary(rows: DataFrame, period: str = "month") -> DataFrame:
    """Totals, coverage and grades by period."""
    grades = [F.count(F.when(F.col("grade") == g, 1)).alias(f"grade_{g}") for g in "abcde"]
    return rows.groupBy(bucket("event_date", period).alias("period")).agg(*[money_sum(n.replace("-", "_")).alias(n.replace("-", "_")) for n in NUTRIMENTS], F.round(F.count(F.when(F.col("known"), 1)) / F.count("*") * 100, 4).alias("coverage"), *grades)


def nutrition_by_category(rows: DataFrame) -> DataFrame:
    c = F.coalesce("category", F.element_at(F.split(F.get_json_object("data", "$.categories"), r",\s*"), -1), F.lit("Uncategorized"))
    return rows.groupBy(c.alias("category")).agg(money_sum("energy_kcal").alias("kcal"), money_sum("sugars").alias("sugars"), F.count("*").alias("n"))


# Places


def spending_by_place(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("place").agg(F.count("*").alias("visits"), money_sum("total_amount").alias("total"), money_mean("total_amount").alias("mean"), F.countDistinct("vendor_key").alias("vendors"))


def vendor_branches(points: DataFrame, merge_m: float = 200.0) -> DataFrame:
    """Branches of vendors with two or more: visits and mean, with the most visited and the dearest marked."""
    c = place_clusters(points.withColumn("lat", F.round("lat", 5)).withColumn("lng", F.round("lng", 5)), merge_m, ["vendor_key"])
    b = c.groupBy("vendor_key", "place").agg(F.count("*").alias("visits"), money_mean("total_amount").alias("mean"))
    top = b.groupBy("vendor_key").agg(F.count("*").alias("branches"), F.max_by("place", F.struct("visits", -F.col("place"))).alias("v"), F.max_by("place", F.struct("mean", -F.col("place"))).alias("m"))
    return b.join(top.where("branches >= 2"), "vendor_key").select("vendor_key", "place", "visits", "mean", (F.col("place") == F.col("v")).alias("most_visited"), (F.col("place") == F.col("m")).alias("dearest"))


def nearby_vendors(points: DataFrame, lat: float, lng: float, radius_m: float = 2000.0, limit: int | None = 10) -> DataFrame:
    d = haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    out = points.where(F.abs(F.col("lat") - lat) <= radius_m / 110_000).withColumn("d", F.round(d, 3)).where(F.col("d") <= radius_m).groupBy("vendor_key").agg(F.min("d").alias("distance"), F.count("*").alias("visits"), money_mean("total_amount").alias("mean_basket"))
    return out.orderBy("distance", "vendor_key").limit(limit) if limit else out


# Coverage and reconciliation


def item_coverage(facts: DataFrame, items: DataFrame, threshold: float = 92.0) -> DataFrame:
    """Items' share of the fact's total: covered, partial or no_items."""
    s = items.groupBy("fact_id").agg(money_sum("total_price").alias("s"), F.count("*").alias("n"))
    rows = facts.where((F.col("fact_type") == "purchase") & (F.col("total_amount") > 0)).join(s, F.col("id") == F.col("fact_id"), "left")
    pct = F.round(F.coalesce("s", F.lit(0.0)) / F.col("total_amount") * 100, 3)
    return rows.select("id", "total_amount", pct.alias("coverage"), F.when(F.col("n").isNull(), "no_items").when(pct < threshold, "partial").otherwise("covered").alias("class"))


def field_coverage(items: DataFrame, fields: dict[str, str]) -> DataFrame:
    """fields: column -> sentinel column or ''. Filled, answered null and pending counts, one pass and one row for each field."""
    aggs = []
    for c, mark in fields.items():
        filled = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        done = F.coalesce(F.col(mark) != 0, F.lit(False)) if mark else F.lit(False)
        aggs.append(F.struct(F.lit(c).alias("field"), F.count(F.when(filled, 1)).alias("filled"), F.count(F.when(~filled & done, 1)).alias("answered_null"), F.count(F.when(~filled & ~done, 1)).alias("pending")))
    return items.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def barcode_coverage(stars: DataFrame) -> DataFrame:
    per = stars.where("barcode is not null").groupBy("barcode").agg(F.countDistinct("vendor_key").alias("v"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("barcodes"), F.sum("n").alias("items"), F.count(F.when(F.col("v") >= 2, 1)).alias("cross_vendor"))


def reconcile(facts: DataFrame, items: DataFrame) -> DataFrame:
    """facts: id, total_amount, paid (sum of payments or null). Coverage class and whether sums disagree by more than max(0.02, 5 %)."""
    s = items.groupBy("fact_id").agg(money_sum("total_price").alias("s"))
    rows = facts.join(s, F.col("id") == F.col("fact_id"), "left")
    has_i, has_p = F.col("s").isNotNull(), F.col("paid").isNotNull()
    kind = F.when(has_i & has_p, "items_and_payment").when(has_i, "items_only").when(has_p, "payment_only").otherwise("neither")
    gap = F.abs(F.col("s") - F.col("paid"))
    return rows.select("id", kind.alias("class"), F.coalesce(gap > F.greatest(F.lit(0.02), 0.05 * F.greatest("s", "paid")), F.lit(False)).alias("mismatch"))


def retention_candidates(documents: DataFrame, as_of, days: int = 365) -> DataFrame:
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("created_at"))
    label = F.when(age <= 30, "0-30").when(age <= 90, "31-90").when(age <= 365, "91-365").otherwise("365+")
    return documents.groupBy("status", label.alias("age")).agg(F.count("*").alias("n"), F.count(F.when(age > days, 1)).alias("candidates"))


# Quality of clouds and corrections


def cloud_accuracy(clouds: DataFrame, corrections: DataFrame) -> DataFrame:
    """clouds: cloud_id, vendor_key. corrections: cloud_id, was_false_positive. By vendor: clouds, corrected, false positives, accuracy."""
    c = corrections.groupBy("cloud_id").agg(F.max(F.col("was_false_positive").cast("int")).alias("fp"))
    out = clouds.join(c, "cloud_id", "left").groupBy("vendor_key").agg(F.count("*").alias("clouds"), F.count("fp").alias("corrected"), F.coalesce(F.sum("fp"), F.lit(0)).alias("false_positives"))
    return out.withColumn("accuracy", F.round(1 - F.col("corrected") / F.col("clouds"), 4))


def match_type_stats(edges: DataFrame, corrections: DataFrame) -> DataFrame:
    c = corrections.select("cloud_id").distinct().withColumn("_c", F.lit(1))
    return edges.join(c, "cloud_id", "left").groupBy("match_type").agg(F.count("*").alias("uses"), F.round(F.avg("match_confidence"), 4).alias("confidence"), F.round(F.count("_c") / F.count("*"), 4).alias("correction_rate"))


def cloud_sizes(edges: DataFrame) -> DataFrame:
    size = edges.groupBy("cloud_id").agg(F.count("*").alias("k"))
    return size.groupBy(F.when(F.col("k") == 1, "1").when(F.col("k") == 2, "2").otherwise("3+").alias("size")).agg(F.count("*").alias("clouds"), F.max("k").alias("largest"))


def false_positive_pairs(pairs: DataFrame, least: int = 2, limit: int = 10) -> DataFrame:
    return pairs.groupBy("source_vendor", "target_vendor").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "source_vendor", "target_vendor").limit(limit)


def confusion_matrix(labelled: DataFrame, least: int = 2) -> DataFrame:
    """labelled: vendor_key, category. Pairs of categories that a vendor's items were confirmed under, the more frequent one first."""
    c = labelled.groupBy("vendor_key", "category").agg(F.count("*").alias("n"))
    a, b = c.alias("a"), c.alias("b")
    first = (F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.category") < F.col("b.category")))
    pairs = a.join(b, (F.col("a.vendor_key") == F.col("b.vendor_key")) & first)
    return pairs.groupBy(F.col("a.category").alias("usual"), F.col("b.category").alias("other")).agg(F.sum("b.n").alias("n"), F.count("*").alias("vendors")).where(F.col("n") >= least)


def unreliable_fields(events: DataFrame, documents: DataFrame, as_of, least: int = 3, days: int = 90) -> DataFrame:
    """events: vendor_key, field, created. documents: vendor_key, n. Fields often corrected, and in what share of the documents."""
    recent = events.where(F.col("created") > F.date_sub(F.lit(as_of).cast("date"), days)).groupBy("vendor_key", "field").agg(F.count("*").alias("corrections")).where(F.col("corrections") >= least)
    rate = F.col("corrections") / F.col("n")
    return recent.join(documents, "vendor_key", "left").withColumn("unreliable", F.coalesce((F.col("n") >= 10) & (rate > 0.3), F.lit(False)))


def weight_adjustments(history: DataFrame, recent: int = 50, least: int = 3, clamp: float = 0.3) -> DataFrame:
    """history: vendor_key, ord, was_false_positive and a score column for each feature. Multipliers from the newest corrections of a vendor: a feature scored high in false positives loses weight."""
    features = [c for c in history.columns if c.endswith("_score")]
    rank = F.row_number().over(Window.partitionBy("vendor_key").orderBy(F.desc("ord")))
    rows = history.withColumn("r", rank).where(F.col("r") <= recent)
    fp = F.col("was_false_positive")
    mean = lambda c, x: F.coalesce(F.avg(F.when(x, F.col(c))), F.lit(0.0))
    return rows.groupBy("vendor_key").agg(F.count("*").alias("n"), *[F.round(1 + F.greatest(F.lit(-clamp), F.least(F.lit(clamp), mean(c, ~fp) - mean(c, fp))), 4).alias(c.replace("_score", "_weight")) for c in features]).where(F.col("n") >= least)


def review_stats(items: DataFrame) -> DataFrame:
    """items: enrichment_source, enrichment_confidence."""
    return items.where("enrichment_source is not null").groupBy("enrichment_source").agg(F.count("*").alias("n"), F.round(F.avg("enrichment_confidence"), 4).alias("confidence"))
