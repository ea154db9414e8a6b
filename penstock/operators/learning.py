"""What corrections teach: features of moved bundles, and multipliers of a vendor's weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from .resolution import vendor_score

# Corrections looked at for one vendor and for all, the least number, the step and the largest deviation.
RECENT, RECENT_OF_ALL, LEAST, STEP, MOST = 50, 200, 3, 0.1, 0.3


def correction_features(bundles: DataFrame, clouds: DataFrame, moves: DataFrame) -> DataFrame:
    """bundles: ord, bundle_type, vendor, vendor_key, slug, amount, event_date (and item_names, lat, lng); clouds: ord, cloud; moves: ord, cloud (where it went, or came from where it was taken out), was_false_positive, at. A row of features for each move: the moved bundle (a) against the first other one of that cloud (b); where there is none, zeros."""
    m = moves.select(F.col("ord").alias("moved"), "cloud", "was_false_positive", "at")
    member = clouds.select(F.col("ord").alias("other"), "cloud")
    first = m.join(member, "cloud").where("other <> moved").groupBy("moved", "cloud", "at").agg(F.min("other").alias("other"))
    cols = [c for c in bundles.columns if c != "ord"]
    side = lambda s, k: bundles.select(F.col("ord").alias(k), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    x = m.join(first, ["moved", "cloud", "at"], "left").join(side("a", "moved"), "moved").join(side("b", "other"), "other", "left")
    x = x.withColumns({f"{s}_key": F.regexp_replace(F.upper(f"{s}_vendor_key"), r"^[A-Z]{2}(?=[0-9])", "") for s in "ab"})
    known = F.col("other").isNotNull()
    paid = (F.col("a_amount") != 0) & (F.col("b_amount") != 0)
    both, either = F.size(F.array_intersect("a_item_names", "b_item_names")), F.size(F.array_union("a_item_names", "b_item_names"))
    shared = F.when(F.least(F.size("a_item_names"), F.size("b_item_names")) > 0, F.round(both / either, 2)) if "item_names" in cols else F.lit(None).cast("double")
    far = haversine(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")) if "lat" in cols else F.lit(None).cast("double")
    return x.select(
        F.col("moved").alias("ord"),
        "at",
        "was_false_positive",
        F.col("a_vendor_key").alias("vendor_key_a"),
        F.col("b_vendor_key").alias("vendor_key_b"),
        F.when(known, F.coalesce(vendor_score(), F.lit(0.0))).otherwise(0.0).alias("vendor_similarity"),
        F.coalesce(F.when(paid, F.abs(F.col("a_amount") - F.col("b_amount")).cast("double")), F.lit(0.0)).alias("amount_diff"),
        F.coalesce(F.abs(F.datediff("a_event_date", "b_event_date")), F.lit(0)).alias("date_diff_days"),
        far.alias("location_distance"),
        F.coalesce(shared, F.lit(0.0)).alias("item_overlap"),
        F.col("a_bundle_type").alias("source_bundle_type"),
        F.col("b_bundle_type").alias("target_bundle_type"),
    )


def _multipliers(rows: DataFrame) -> DataFrame:
    """Of the newest corrections by vendor: false positives that agreed in little but the amount raise the vendor's weight and lower the amount's; those days apart raise the date's; right merges with common items raise the items'."""
    wrong, right = F.col("was_false_positive"), ~F.col("was_false_positive")
    mean = lambda c, which: F.avg(F.when(which, F.col(c)))
    g = rows.groupBy("vendor_key").agg(F.count("*").alias("n"), F.count(F.when(wrong, 1)).alias("fp"), mean("vendor_similarity", wrong).alias("sim"), mean("amount_diff", wrong).alias("gap"), mean("date_diff_days", wrong).alias("days"), mean("item_overlap", right).alias("shared")).where(F.col("n") >= LEAST)
    unlike = (F.col("sim") < 0.5) & (F.col("gap") < 1.0)
    up = lambda by: F.least(1.0 + by, F.lit(1.0 + MOST))
    pick = lambda cond, v: F.when(cond, v).otherwise(1.0)
    return g.select(
        "vendor_key",
        pick(unlike, up(STEP * F.col("fp"))).alias("vendor"),
        pick(unlike, F.greatest(1.0 - STEP * F.col("fp") * 0.5, F.lit(1.0 - MOST))).alias("amount"),
        pick(F.col("days") > 3, up(STEP * F.col("fp") * 0.5)).alias("date"),
        pick(F.col("shared") > 0.3, F.lit(min(1.0 + STEP * 2, 1.0 + MOST))).alias("items"),
    )


def weights(history: DataFrame) -> DataFrame:
    """history: of correction_features, at and ord are its order. vendor_key, vendor, amount, date, items: multipliers by vendor from its last 50 corrections on either side, and in the row without a vendor from the last 200 of all; vendors with fewer than three corrections are absent. The windows keep their first rows before the shuffle."""
    order = [F.desc("at"), F.desc("ord")]
    sides = F.array_distinct(F.array_compact(F.array("vendor_key_a", "vendor_key_b")))
    each = history.select("*", F.explode(sides).alias("vendor_key"))
    newest = each.withColumn("r", F.row_number().over(Window.partitionBy("vendor_key").orderBy(*order))).where(F.col("r") <= RECENT)
    latest = history.orderBy(*order).limit(RECENT_OF_ALL).withColumn("vendor_key", F.lit(None).cast("string"))
    return _multipliers(newest.drop("r")).unionByName(_multipliers(latest))


def false_pairs(history: DataFrame) -> DataFrame:
    """vendor_a, vendor_b of every false positive, for the veto of score_pairs (which counts two or more)."""
    return history.where("was_false_positive and vendor_key_a is not null and vendor_key_b is not null").select(F.col("vendor_key_a").alias("vendor_a"), F.col("vendor_key_b").alias("vendor_b"))
