"""Entity resolution: atoms to bundles, bundles to clouds, clouds to facts; duplicates, photos, identities, reconciliation."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from ..functions import vendors as V
from ..functions.geo import EARTH_M, haversine, proximity_score
from ..functions.money import money_sum
from ..functions.similarity import seq_ratio
from . import bits
from .graph import components, cut_lineage, forest_roots, let_go

# Days between bundles of two types.
TOLERANCE = {
    ("basket", "basket"): 0, ("invoice", "invoice"): 0, ("payment_record", "payment_record"): 0, ("statement_line", "statement_line"): 0,
    ("basket", "payment_record"): 1, ("basket", "statement_line"): 5, ("invoice", "payment_record"): 60, ("invoice", "statement_line"): 60, ("payment_record", "statement_line"): 5,
}
DEFAULT_TOLERANCE = 3
WEIGHTS = {"vendor": 0.3, "amount": 0.4, "date": 0.2, "items": 0.5, "location": 0.15}


def date_tolerance(a: Column, b: Column) -> Column:
    pairs = {"|".join(p): d for k, d in TOLERANCE.items() for p in (k, k[::-1])}
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", a, b)), F.lit(DEFAULT_TOLERANCE))


def parse_extractions(documents: DataFrame) -> DataFrame:
    """documents: id, kind, vendor, vendor_vat, date, total, currency, line_items, transactions. Atoms: document_id, bundle_id, bundle_type, atom_type, data (map). One bundle for each document; of a statement, one for each transaction, with its debit as a positive amount."""
    kind = bundle_type(F.col("kind"))
    bundle = F.concat_ws(":", F.col("id").cast("string"), F.lit("0"))
    base = documents.where("kind <> 'statement'").select("*", kind.alias("bt"), bundle.alias("bundle_id"))
    atom = lambda t, **kv: F.struct(F.lit(t).alias("atom_type"), F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull()).alias("data"))
    heads = F.array(atom("vendor", name=F.col("vendor"), vat=F.col("vendor_vat")), atom("datetime", value=F.col("date")), atom("amount", value=F.col("total"), currency=F.col("currency"), semantic_type=F.lit("total")))
    lines = F.transform("line_items", lambda x: atom("item", name=x["name"], quantity=x["quantity"], total_price=x["total_price"]))
    whole = base.select(F.col("id").alias("document_id"), "bundle_id", F.col("bt").alias("bundle_type"), F.inline(F.concat(heads, F.coalesce(lines, F.array().cast("array<struct<atom_type:string,data:map<string,string>>>")))))
    t = documents.where("kind = 'statement'").select("id", "currency", F.posexplode("transactions").alias("k", "t"))
    parts = F.array(atom("vendor", name=F.col("t.description")), atom("datetime", value=F.col("t.date")), atom("amount", value=F.abs(F.col("t.amount")), currency=F.col("currency"), semantic_type=F.lit("total")))
    out = t.select(F.col("id").alias("document_id"), F.concat_ws(":", F.col("id").cast("string"), F.col("k").cast("string")).alias("bundle_id"), F.lit("statement_line").alias("bundle_type"), F.inline(parts))
    return whole.unionByName(out).where(F.size("data") > 0)


def bundle_type(kind: Column) -> Column:
    return F.when(kind == "invoice", "invoice").when(kind.isin("payment_confirmation", "card_slip"), "payment_record").when(kind == "statement", "statement_line").otherwise("basket")


def bundle_summaries(atoms: DataFrame) -> DataFrame:
    """A row of features for each bundle: the last vendor, date and total by atom order win; items as a sorted set of names (bounded by the document)."""
    ord_ = F.col("ord") if "ord" in atoms.columns else F.monotonically_increasing_id()
    a = atoms.withColumn("_o", ord_)
    last = lambda t, k: F.max_by(F.when(F.col("atom_type") == t, F.col("data")[k]), F.when((F.col("atom_type") == t) & F.col("data")[k].isNotNull(), F.col("_o")))
    out = a.groupBy("bundle_id").agg(
        F.first("bundle_type").alias("bundle_type"), last("vendor", "name").alias("vendor"), last("vendor", "vat").alias("registration"), last("amount", "value").cast("decimal(18,2)").alias("amount"), last("amount", "currency").alias("currency"), last("datetime", "value").cast("date").alias("event_date"),
        F.array_sort(F.collect_set(F.when(F.col("atom_type") == "item", F.lower(F.col("data")["name"])))).alias("item_names"),
    )
    reg = F.when(~V.is_intermediary("vendor"), F.col("registration"))
    return out.withColumn("vendor_key", V.vendor_key(reg, F.col("vendor"))).withColumn("slug", V.slug("vendor"))


#: Types by number, for light rows; all others have the default tolerance with any type.
TYPES = sorted({x for pair in TOLERANCE for x in pair})
SHORT, FAR = 5, 60  # the most days between two types, without invoices and with them


def _code(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for i, t in enumerate(TYPES) for x in (F.lit(t), F.lit(i))]), kind), F.lit(len(TYPES)))


def _code_tolerance(a: Column, b: Column) -> Column:
    n = len(TYPES) + 1
    table = [TOLERANCE.get((x, y), TOLERANCE.get((y, x), DEFAULT_TOLERANCE)) for x in [*TYPES, ""] for y in [*TYPES, ""]]
    return F.element_at(F.array(*[F.lit(d) for d in table]), (a * n + b + 1).cast("int"))


def _met(left: DataFrame, right: DataFrame, undated: bool, invoices: bool) -> DataFrame:
    """Pairs (a, b) of light rows that share a block, by date. A block and a window of days are one 64-bit hash; what else shares it is told apart by the score. Short tolerances meet in windows of sixteen days, of which a row sees those that its tolerance reaches; only invoices and what pays them look 60 days far. A row without a date meets by blocks that name more than the vendor."""
    n = len(TYPES) + 1
    kind, day = lambda c: F.pmod(F.col(c), F.lit(n)), lambda c: F.floor(F.col(c) / n)
    invoice = lambda c: kind(c) == TYPES.index("invoice")
    pays = lambda c: kind(c).isin(TYPES.index("payment_record"), TYPES.index("statement_line"))
    close = F.abs(day("wa") - day("wb")) <= _code_tolerance(kind("wa"), kind("wb"))

    def within(days: int, reach: int, x: DataFrame, y: DataFrame) -> DataFrame:
        window = lambda c, by=0: F.floor((day(c) + by) / days)
        x = x.where("wa is not null").select("a", "wa", F.explode(F.transform("own", lambda h: F.xxhash64(h, window("wa")))).alias("block"))
        seen = F.flatten(F.transform(F.sequence(window("wb", -reach), window("wb", reach)), lambda w: F.transform("met", lambda h: F.xxhash64(h, w))))
        y = y.where("wb is not null").select("b", "wb", F.explode(seen).alias("block"))
        return x.join(y, "block").where((F.col("a") != F.col("b")) & close).select("a", "b")

    out = within(16, SHORT, left, right)
    if invoices:
        far = within(128, FAR, left.where(invoice("wa")), right.where(pays("wb"))).unionByName(within(128, FAR, left.where(pays("wa")), right.where(invoice("wb"))))
        out = out.unionByName(far)
    if undated:
        x = left.select("a", "wa", F.explode("own_more").alias("block"))
        y = right.select("b", "wb", F.explode("met_more").alias("block"))
        loose = x.where("wa is null").join(y, "block").unionByName(x.where("wa is not null").join(y.where("wb is null"), "block"))
        out = out.unionByName(loose.where("a <> b").select("a", "b"))
    return out


def candidate_pairs(bundles: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """bundles: ord, bundle_type, vendor, vendor_key, slug, amount, currency, event_date (and item_names, lat, lng). (a, b) with a before b, sharing a block: the vendor key, the slug, its first four letters with nearly the same amount, or, where one is an intermediary, nearly the same amount. Two dates must be within the types' tolerance, an unknown one meets any. of: ord; only pairs with one of these.

    Blocks are joined on hashes and ids alone, in windows of days, so a vendor with very many bundles doesn't meet itself whole. Where a date is unknown the vendor alone can't link two bundles, so they meet by vendor with nearly the same amount, a common item or a place nearby. Amounts up to 0.02 apart meet in one of two buckets. The amount alone is a block between intermediaries and all others only."""
    told_by = {"agent": V.is_intermediary("vendor"), "key": V.strip_country_prefix(F.upper("vendor_key"))}
    b = bundles.withColumns(told_by)
    seen = b.agg(F.max("agent"), F.max(F.col("event_date").isNull()), F.max(F.col("bundle_type") == "invoice")).first()  # blocks that nothing can share aren't made
    agents, undated, invoices = (bool(x) for x in seen)
    cents = (F.col("amount") * 100).cast("bigint")
    none = F.array().cast("array<string>")
    bucket = lambda d: F.concat_ws("|", F.floor((cents + d) / 10).cast("string"), "currency")
    money = F.when(F.col("amount").isNotNull(), bucket(0))
    near = F.when(F.col("amount").isNotNull(), F.array_distinct(F.array(bucket(-2), bucket(2))))
    head = F.when(F.length("slug") >= 4, F.substring("slug", 1, 4))
    each = lambda cond, f: F.coalesce(F.when(cond, F.transform(near, f)), none)
    plain = F.array_compact(F.array(F.concat(F.lit("k"), "key"), F.concat(F.lit("s"), F.when(F.length("slug") > 0, F.col("slug")))))
    amount_own, amount_met = F.array(F.concat(F.lit("p"), head, money)), each(F.lit(True), lambda m: F.concat(F.lit("p"), head, m))
    if agents:
        amount_own = F.concat(amount_own, F.array(F.concat(F.lit("m"), money), F.when(F.col("agent"), F.concat(F.lit("n"), money))))
        amount_met = F.concat(amount_met, each(F.col("agent"), lambda m: F.concat(F.lit("m"), m)), each(~F.col("agent"), lambda m: F.concat(F.lit("n"), m)))
    # What a vendor's block is told with where a date is unknown.
    more_own, more_met = F.array_compact(F.array(F.concat(F.lit("$"), money))), F.coalesce(F.transform(near, lambda m: F.concat(F.lit("$"), m)), none)
    if "item_names" in bundles.columns:
        item = F.coalesce(F.transform("item_names", lambda x: F.concat(F.lit("i"), x)), none)
        more_own, more_met = F.concat(more_own, item), F.concat(more_met, item)
    if "lat" in bundles.columns:
        lat, lng = F.radians("lat"), F.radians("lng")
        cube = [F.floor(v * (EARTH_M / 500)) for v in (F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat))]  # a place counts enough within 500 m
        near_by = F.array(*[F.lit(k) for k in (-1, 0, 1)])
        own_cube = F.array(F.concat(F.lit("l"), F.concat_ws(",", *[c.cast("string") for c in cube])))
        shift = lambda c, k: (c + k).cast("string")
        around = F.flatten(F.transform(near_by, lambda i: F.flatten(F.transform(near_by, lambda j: F.transform(near_by, lambda k: F.concat(F.lit("l"), F.concat_ws(",", shift(cube[0], i), shift(cube[1], j), shift(cube[2], k))))))))
        placed = lambda cubes: F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), cubes).otherwise(none)
        more_own, more_met = F.concat(more_own, placed(own_cube)), F.concat(more_met, placed(around))
    told = lambda more: F.flatten(F.transform(plain, lambda v: F.transform(more, lambda m: F.concat(v, m))))
    hashes = lambda c: F.transform(F.array_compact(c), lambda x: F.xxhash64(x))
    more = [hashes(F.concat(told(more_own), amount_own)).alias("own_more"), hashes(F.concat(told(more_met), amount_met)).alias("met_more")] if undated else []
    thin = b.select("ord", (F.unix_date("event_date") * (len(TYPES) + 1) + _code(F.col("bundle_type"))).cast("bigint").alias("when"), hashes(F.concat(plain, amount_own)).alias("own"), hashes(F.concat(plain, amount_met)).alias("met"), *more)
    left, right = (thin.select(F.col("ord").alias(s), F.col("when").alias(f"w{s}"), c, *([f"{c}_more"] if undated else [])) for s, c in (("a", "own"), ("b", "met")))
    meet = lambda x, y: _met(x, y, undated, invoices)
    if of is None:
        pairs = meet(left, right)
    else:
        pairs = meet(left.join(of.select(F.col("ord").alias("a")), "a", "left_semi"), right).unionByName(meet(left, right.join(of.select(F.col("ord").alias("b")), "b", "left_semi")))
    pairs = cut_lineage(pairs.select(F.least("a", "b").alias("a_ord"), F.greatest("a", "b").alias("b_ord")).repartition("a_ord").distinct())
    let_go(bundles.sparkSession)
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in bundles.columns]
    with_a = pairs.join(bundles, F.col("a_ord") == F.col("ord")).select("b_ord", *side("a"))
    both = with_a.join(bundles, F.col("b_ord") == F.col("ord")).select(*[F.col(f"a_{c}") for c in bundles.columns], *side("b"))
    # What is told by a vendor or key is computed behind the joins, so it isn't shuffled.
    return both.withColumns({f"{s}_{k}": v for s in "ab" for k, v in (("agent", V.is_intermediary(f"{s}_vendor")), ("key", V.strip_country_prefix(F.upper(f"{s}_vendor_key"))))})


def vendor_score() -> Column:
    a, b = F.col("a_key"), F.col("b_key")
    named = (F.lower("a_vendor") == F.lower("b_vendor")) & F.col("a_vendor").isNotNull()
    keys = a.isNotNull() & b.isNotNull() & ~a.startswith("NOID_") & ~b.startswith("NOID_")
    ratio = F.when(keys & (a != b), seq_ratio(a, b))
    by_key = F.when(a == b, 1.0).when(ratio >= 0.85, 0.9).when((ratio >= 0.70) & named, 0.85).otherwise(0.0)
    return F.when(keys, by_key).when(named | (F.col("a_slug") == F.col("b_slug")), 1.0).when(V.slugs_match(F.col("a_slug"), F.col("b_slug")), 0.8).otherwise(0.0)


def score_pairs(pairs: DataFrame, weights: dict[str, float] | None = None, false_pairs: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """ord pairs with score and match type; vetoes give no row. learned: vendor_key, vendor, amount, date and items, multipliers of the weights for the later bundle's vendor (of learning.weights)."""
    w: dict[str, Column] = {k: F.lit(v) for k, v in {**WEIGHTS, **(weights or {})}.items()}
    if learned is not None:
        taught = learned.select(F.coalesce("vendor_key", F.lit("")).alias("_key"), *[F.col(k).alias(f"_{k}") for k in ("vendor", "amount", "date", "items")])
        pairs = pairs.join(taught, F.coalesce("b_vendor_key", F.lit("")) == F.col("_key"), "left")
        w |= {k: w[k] * F.coalesce(f"_{k}", F.lit(1.0)) for k in ("vendor", "amount", "date", "items")}
    p = pairs.withColumn("v", vendor_score())
    gap = F.abs((F.col("a_amount") - F.col("b_amount")).cast("decimal(18,2)"))
    amount = F.when(F.col("a_currency") != F.col("b_currency"), 0.0).when(gap == 0, 1.0).when(gap <= F.lit(0.02).cast("decimal(18,2)"), 0.8).otherwise(0.0)
    days, tol = F.abs(F.datediff("a_event_date", "b_event_date")), date_tolerance(F.col("a_bundle_type"), F.col("b_bundle_type"))
    date = F.when(days.isNull(), 0.5).when(days > tol, 0.0).otherwise(F.bround((1 - days / (tol + 1)).cast("decimal(10,6)"), 2).cast("double"))
    both, either = F.size(F.array_intersect("a_item_names", "b_item_names")), F.size(F.array_union("a_item_names", "b_item_names"))
    items = F.when(F.least(F.size("a_item_names"), F.size("b_item_names")) > 0, F.round(both / either, 2)).otherwise(0.0) if "a_item_names" in pairs.columns else F.lit(0.0)
    place = F.coalesce(proximity_score(haversine(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))), F.lit(0.0)) if "a_lat" in pairs.columns else F.lit(0.0)
    p = p.withColumn("am", F.coalesce(amount, F.lit(0.0))).withColumn("d", date).withColumn("i", items).withColumn("l", place)
    veto = (F.col("v") == 0) & ~F.col("a_agent") & ~F.col("b_agent")
    if "a_minute" in pairs.columns:
        far = F.abs(F.col("a_minute") - F.col("b_minute"))
        veto = veto | F.coalesce((F.col("a_event_date") == F.col("b_event_date")) & (far > F.when(F.col("a_bundle_type") == F.col("b_bundle_type"), 2).otherwise(20)), F.lit(False))
    veto = veto | F.coalesce((F.col("a_bundle_type") == F.col("b_bundle_type")) & (days > tol), F.lit(False))
    if false_pairs is not None:
        k = false_pairs.select(F.least("vendor_a", "vendor_b").alias("x"), F.greatest("vendor_a", "vendor_b").alias("y")).groupBy("x", "y").count().where("count >= 2")
        p = p.join(k, (F.least("a_vendor_key", "b_vendor_key") == F.col("x")) & (F.greatest("a_vendor_key", "b_vendor_key") == F.col("y")), "left_anti")
    score = F.least(F.lit(1.0), w["vendor"] * F.col("v") + w["amount"] * F.col("am") + w["date"] * F.col("d") + w["items"] * F.col("i") + w["location"] * F.col("l"))
    kind = F.when(F.col("i") > 0, "item_overlap").when(F.col("am") == 1, "exact_amount").when(F.col("am") > 0, "near_amount").otherwise("vendor_date")
    return p.where(~veto).select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), F.round(score, 4).alias("score"), kind.alias("match_type"))


def best_partners(bundles: DataFrame, weights: dict[str, float] | None = None, false_pairs: DataFrame | None = None, learned: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    """(node, parent): each bundle (of: only these, ord) with its best earlier partner above 0.5, the earliest of equal ones, or itself."""
    s = score_pairs(candidate_pairs(bundles, of), weights, false_pairs, learned).where("score > 0.5")
    best = s.groupBy(F.col("b").alias("node")).agg(F.min_by("a", F.struct(-F.col("score"), F.col("a"))).alias("parent"))
    nodes = bundles.select(F.col("ord").alias("node"))
    if of is not None:
        nodes = nodes.join(of.select(F.col("ord").alias("node")), "node", "left_semi")
    return nodes.join(best, "node", "left").withColumn("parent", F.coalesce("parent", "node"))


def form_clouds(bundles: DataFrame, weights: dict[str, float] | None = None, false_pairs: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """bundles (ord is the order of arrival) to (ord, cloud): each takes its best earlier partner as parent; a cloud is a tree, named by its root."""
    parents = cut_lineage(best_partners(bundles, weights, false_pairs, learned))
    let_go(bundles.sparkSession)
    return forest_roots(parents).select(F.col("node").alias("ord"), F.col("root").alias("cloud"))


def collapse_clouds(bundles: DataFrame, clouds: DataFrame) -> DataFrame:
    """A fact for each cloud: 0.3 for one vendor, 0.4 for equal totals (or 0.3 for payments that add up to the largest), 0.2 for several types; a single bundle is confirmed. The merchant comes from the bundle that is no intermediary, baskets first."""
    agent = V.is_intermediary("vendor").cast("int")
    rank = F.struct(agent, (F.col("bundle_type") != "basket").cast("int"), F.col("ord"))
    pay = F.when(F.col("bundle_type") == "payment_record", F.col("amount"))
    different = lambda x: F.size(F.collect_set(x)).cast("bigint")  # noqa: E731 (countDistinct would repeat every row)
    rows = bundles.select("ord", "bundle_type", "slug", "amount", "vendor", "vendor_key", "event_date", "currency").join(clouds, "ord").repartition("cloud")  # rows are lighter than the partial states of their aggregates
    c = rows.groupBy("cloud").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("slug") != "", F.col("slug")))).alias("slugs"), different("amount").alias("totals"), different("bundle_type").alias("types"), F.max("amount").alias("total_amount"), F.sum(pay).alias("paid"),
        F.min_by("vendor", rank).alias("vendor"), F.min_by("vendor_key", rank).alias("vendor_key"), F.min("event_date").alias("event_date"), F.min("currency").alias("currency"),
    )
    one = (F.size("slugs") > 0) & F.forall("slugs", lambda x: (x == F.col("slugs")[0]) | V.slugs_match(x, F.col("slugs")[0]))
    score = F.when(one, 0.3).otherwise(0.0) + F.when(F.col("totals") == 1, 0.4).when(F.abs(F.col("paid") - F.col("total_amount")) <= 0.02, 0.3).otherwise(0.0) + F.when(F.col("types") > 1, 0.2).otherwise(0.0)
    conf = F.when(F.col("n") == 1, 1.0).otherwise(F.round(score, 2))
    return c.withColumn("confidence", conf).withColumn("status", F.when(conf >= 0.8, "confirmed").when(conf >= 0.5, "partial").otherwise("forming")).withColumn("fact_type", F.lit("purchase"))


def dedup_items(items: DataFrame) -> DataFrame:
    """items: cloud, bundle_id, name, price, quantity, richness. Of each (name, price, quantity) as many as the bundle with most of them has, the richest first."""
    key = ["cloud", F.lower("name").alias("lname"), "price", "quantity"]
    most = items.groupBy(*key, "bundle_id").count().groupBy("cloud", "lname", "price", "quantity").agg(F.max("count").alias("most"))
    ranked = items.withColumn("lname", F.lower("name")).withColumn("r", F.row_number().over(Window.partitionBy("cloud", "lname", "price", "quantity").orderBy(F.desc("richness"), "bundle_id")))
    return ranked.join(most, ["cloud", "lname", "price", "quantity"]).where("r <= most").drop("lname", "r", "most")


def fold_payments(payments: DataFrame) -> DataFrame:
    """payments: cloud, method, card_last4, amount. One row for each charge: same amount, compatible card, never cash with card; the row with a card is the base."""
    kind = F.when(F.lower("method") == "cash", "cash").otherwise("card")
    cards = payments.withColumn("kind", kind).groupBy("cloud", "amount", "kind").agg(F.count_distinct("card_last4").alias("cards"), F.min("method").alias("any_method"))
    named = payments.where("card_last4 is not null").withColumn("kind", kind).groupBy("cloud", "amount", "kind", "card_last4").agg(F.min("method").alias("method"))
    return cards.join(named, ["cloud", "amount", "kind"], "left").select("cloud", "amount", F.coalesce("method", "any_method").alias("method"), "card_last4")


def amounts_sum_to(amounts: Column, target: Column) -> Column:
    return F.abs(F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x.cast("double")) - target) <= 0.02


def price_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset Jaccard of two sets of prices by key: sums of the lesser and the greater counts."""
    c = lambda d, n: d.groupBy(*keys, F.round("price", 2).alias("p")).agg(F.count("*").alias(n))
    j = c(a, "x").join(c(b, "y"), [*keys, "p"], "full").fillna(0, ["x", "y"])
    return j.groupBy(*keys).agg(F.round(F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y")), 4).alias("overlap"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hex."""
    n = lambda c: F.conv(c, 16, -10).cast("bigint")
    return F.when(F.length(a) == F.length(b), F.bit_count(n(a).bitwiseXOR(n(b))))


def duplicate_facts(facts: DataFrame, items: DataFrame, bucket: list[str] | None = None) -> DataFrame:
    """facts: id, event_date, total_amount, currency, vendor_key, slug, phash, event_time. Pairs (keeper, other) within equal date, total and currency and the same vendor key (else slug), or within a given bucket such as the groups of duplicates.duplicate_groups, with a verdict: no items, like photo or like prices merge; the rest is for review. The keeper has most items, then a time, then the least id."""
    n = items.groupBy("fact_id").agg(F.count("*").alias("n_items"))
    f = facts.join(n, F.col("id") == F.col("fact_id"), "left").drop("fact_id").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    if bucket is None:
        bucket = ["event_date", "total_amount", "currency", "vendor_group"]
        f = f.withColumn("vendor_group", F.coalesce("vendor_key", "slug"))
    best = f.groupBy(*bucket).agg(F.count("*").alias("k"), F.min(F.struct((-F.col("n_items")).alias("less"), F.col("event_time").isNull().alias("untimed"), F.col("id"), F.col("phash"))).alias("top")).where("k > 1")
    pairs = f.join(best, bucket).where("id <> top.id").select(F.col("top.id").alias("keeper"), F.col("id").alias("other"), F.col("n_items"), (-F.col("top.less")).alias("keeper_items"), hamming(F.col("phash"), F.col("top.phash")).alias("distance"))
    price = lambda side: pairs.select("keeper", "other", F.col(side).alias("fact_id")).join(items, "fact_id").select("keeper", "other", F.col("total_price").alias("price"))
    over = price_overlap(price("keeper"), price("other"), ["keeper", "other"])
    verdict = F.when((F.col("n_items") == 0) | (F.col("keeper_items") == 0), "merge_no_items").when(F.col("distance") <= 6, "merge_photo").when(F.col("overlap") >= 0.5, "merge_prices").otherwise("review")
    return pairs.join(over, ["keeper", "other"], "left").select("keeper", "other", verdict.alias("verdict"), "overlap")


def photo_groups(photos: DataFrame, distance: int = 6) -> DataFrame:
    """photos: id, phash (16 hex digits). Components of hashes within the distance, named by their least id. Equal hashes are one node; which of them meet is told in bits.links."""
    p = photos.where(F.length("phash") == 16).select("id", "phash", F.conv("phash", 16, -10).cast("bigint").alias("v"))
    h = cut_lineage(p.groupBy("v").agg(F.min("id").alias("first")))  # blanks have no value and are a group
    known = h.where("v is not null")
    roots = cut_lineage(components(known.select(F.col("v").alias("node")), bits.links(known.select("v"), distance)))
    linked = h.join(roots, F.col("v") == F.col("node"), "left").select("v", "first", F.coalesce("root", "v").alias("root"))
    names = linked.groupBy("root").agg(F.min("first").alias("group")).withColumnRenamed("root", "r")
    named = linked.join(names, F.col("root").eqNullSafe(F.col("r"))).select(F.col("v").alias("w"), "group")
    return p.join(named, F.col("v").eqNullSafe(F.col("w"))).select("id", "phash", "group")


def interval_matches(a: DataFrame, b: DataFrame, days: int = 3) -> DataFrame:
    """a, b: id, vendor_key, amount, date, kind. Complementary documents: same vendor and amount, another kind, at most so many days apart. An equi-join on a bucket of days bounds the interval."""
    w = days + 1
    x = a.select(F.col("id").alias("a"), "vendor_key", "amount", F.col("date").alias("d"), F.col("kind").alias("ka"), F.floor(F.unix_date("date") / w).alias("w"))
    y = b.select(F.col("id").alias("b"), "vendor_key", "amount", F.col("date").alias("e"), F.col("kind").alias("kb"), F.explode(F.array(*[F.floor(F.unix_date("date") / w) + k for k in (-1, 0, 1)])).alias("w"))
    return x.join(y, ["vendor_key", "amount", "w"]).where((F.col("ka") != F.col("kb")) & (F.abs(F.datediff("d", "e")) <= days)).select("a", "b", F.datediff("e", "d").alias("days"))


def canonical_vendors(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names: name. aliases: alias, canonical, ord. The first alias with the same slug names the vendor."""
    al = aliases.withColumn("slug", V.slug("alias")).groupBy("slug").agg(F.min_by("canonical", "ord").alias("canonical"))
    return names.withColumn("slug", V.slug("name")).join(al, "slug", "left").select("name", F.coalesce("canonical", "name").alias("canonical"))


def find_identities(queries: DataFrame, members: DataFrame) -> DataFrame:
    """queries: q, vendor_key, registration, name. members: identity, member_type, value. The identity by key, then VAT, tax id, name, slug."""
    slug = V.slug("name")
    asks = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(t).alias("member_type"), v.alias("value")) for r, (t, v) in enumerate([("vendor_key", F.col("vendor_key")), ("vat_number", F.col("registration")), ("tax_id", F.col("registration")), ("name", F.lower("name")), ("slug", slug)])])
    a = queries.select("q", F.inline(asks)).where("value is not null")
    m = members.withColumn("value", F.when(F.col("member_type") == "name", F.lower("value")).otherwise(F.col("value")))
    m = m.unionByName(members.where("member_type = 'name'").withColumn("member_type", F.lit("slug")).withColumn("value", V.slug("value")))
    hit = a.join(m, ["member_type", "value"]).groupBy("q").agg(F.min(F.struct("rank", "identity", "member_type")).alias("h"))
    return hit.select("q", F.col("h.identity").alias("identity"), F.col("h.member_type").alias("matched_by"))


def fuzzy_vendors(queries: DataFrame, names: DataFrame, least: float = 0.82, length: int = 3) -> DataFrame:
    """Spelling suggestions: the most similar known name of about the same length and with a letter pair in common place (first or last two)."""
    block = lambda c: F.array_distinct(F.array(F.concat(F.lit("^"), F.substring(F.lower(c), 1, 2)), F.concat(F.lit("$"), F.right(F.lower(F.col(c)), F.lit(2)))))
    q = queries.select("q", "name", F.explode(block("name")).alias("blk"))
    k = names.select(F.col("name").alias("known")).distinct().select("known", F.explode(block("known")).alias("blk"))
    pairs = q.join(k, "blk").where((F.abs(F.length("name") - F.length("known")) <= length) & (F.lower("name") != F.lower("known"))).select("q", "name", "known").distinct()
    s = pairs.withColumn("ratio", seq_ratio(F.lower("name"), F.lower("known"))).where(F.col("ratio") >= least)
    return s.groupBy("q").agg(F.max_by("known", F.struct("ratio", "known")).alias("suggestion"), F.round(F.max("ratio"), 4).alias("ratio"))


def canonical_key(members: DataFrame) -> DataFrame:
    """identity -> its vendor key: prefixed forms within a group of equal digits; across groups one that ends in a letter, then the shorter, then the first by alphabet."""
    m = members.where("member_type = 'vendor_key'").withColumn("body", V.strip_country_prefix(F.col("value")))
    one = m.groupBy("identity", "body").agg(F.max_by("value", F.struct(F.length("value"), "value")).alias("value"))
    return one.groupBy("identity").agg(F.min(F.struct((~F.col("value").rlike("[A-Za-z]$")).alias("digit"), F.length("value").alias("len"), F.col("value").alias("value"))).alias("m")).select("identity", F.col("m.value").alias("vendor_key"))


def merge_identities(members: DataFrame, merges: DataFrame) -> DataFrame:
    """members with those of source identities moved to their target (merges: source, target), without doubles."""
    return members.join(merges, F.col("identity") == F.col("source"), "left").select(F.coalesce("target", "identity").alias("identity"), "member_type", "value").distinct()


def name_history(facts: DataFrame) -> DataFrame:
    return facts.where("vendor_key is not null and vendor is not null").groupBy("vendor_key", "vendor").agg(F.count("*").alias("n"))


def move_bundles(clouds: DataFrame, moves: DataFrame) -> DataFrame:
    """(ord, cloud) with some bundles in other clouds (moves: ord, cloud; a null cloud is a new one)."""
    m = moves.select("ord", F.col("cloud").alias("_to"), F.lit(True).alias("_m"))
    return clouds.join(m, "ord", "left").select("ord", F.when(F.col("_m"), F.coalesce("_to", "ord")).otherwise(F.col("cloud")).alias("cloud"))


def _one_way(options: list[list[float]], target: float, tol: float) -> list[float] | None:
    """The only choice of one option each whose sum comes within tol of the target. Sums are made in an array; those at the edge are added up again one by one."""
    import numpy as np

    sums = np.zeros(1)
    for o in options:
        sums = (sums[:, None] + np.array(o)[None, :]).ravel()
    slack = 1e-9 * (1 + sum(max(map(abs, o)) for o in options))
    hits: list[list[float]] = []
    for at in np.flatnonzero(np.abs(sums - target) <= tol + slack).tolist():
        choice = []
        for o in reversed(options):
            at, k = divmod(at, len(o))
            choice.append(o[k])
        choice.reverse()
        if abs(sum(choice) - target) <= tol:
            hits.append(choice)
            if len(hits) > 1:
                return None
    return hits[0] if hits else None


def reconcile_lines(lines: DataFrame, abs_tol: float = 0.05, pct_tol: float = 0.006, max_free: int = 16, max_combinations: int = 100_000) -> DataFrame:
    """lines: fact_id, line, quantity, unit_price, total_price, printed_total. Where the printed total is missed, the one choice of line totals (as printed, quantity * price, price, zero) that meets it; a fact with several such choices or too many free lines is left alone. A fact's lines fit in a task by the nature of a receipt; facts come in batches, not one by one."""
    out = ArrayType(StructType([StructField("line", IntegerType()), StructField("total_price", DoubleType()), StructField("reconciled", BooleanType())]))

    def fact(rows: list[dict], printed: float | None) -> tuple[list[float], bool]:
        target = math.nan if printed is None else float(printed)
        tol = max(abs_tol, abs(target) * pct_tol)
        options = []
        for r in rows:
            total, unit, quantity = r["total_price"], r["unit_price"], r["quantity"]
            seen = [x for x in (total, unit * quantity if unit is not None and quantity is not None else None, unit) if x is not None and not math.isnan(x)]
            options.append(list(dict.fromkeys(round(x, 2) for x in seen)) or [0.0])
        plain = [o[0] for o in options]
        if abs(sum(plain) - target) <= tol:
            return plain, True
        if math.prod(map(len, options)) > max_combinations or sum(len(o) > 1 for o in options) > max_free:
            return plain, False
        found = _one_way(options, target, tol)
        return (found, True) if found else (plain, False)

    def solve(rows: pa.Array, printed: pa.Array) -> pa.Array:
        totals, done = [], []
        for r, p in zip(rows.to_pylist(), printed.to_pylist(), strict=True):
            choice, met = fact(r, p)
            totals += choice
            done += [met] * len(choice)
        flat = rows.flatten()
        sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
        ends = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([flat.field("line"), pa.array(totals, pa.float64()), pa.array(done, pa.bool_())], names=["line", "total_price", "reconciled"]))

    solve.__annotations__ = {"rows": pa.Array, "printed": pa.Array, "return": pa.Array}
    value = lambda c: F.col(c).cast("double").alias(c)
    row = F.struct(F.col("line").cast("int").alias("line"), *[value(c) for c in ("total_price", "unit_price", "quantity")])
    facts = lines.groupBy("fact_id").agg(F.collect_list(row).alias("rows"), F.first(value("printed_total")).alias("printed"))
    return facts.select(F.col("fact_id").cast("bigint").alias("fact_id"), F.inline(F.arrow_udf(solve, out)("rows", "printed")))


def overcounted(facts: DataFrame, items: DataFrame, ratio: float = 1.15) -> DataFrame:
    s = items.groupBy("fact_id").agg(money_sum("total_price").alias("s"))
    return facts.join(s, F.col("id") == F.col("fact_id")).where((F.col("total_amount") > 0) & (F.col("s") > ratio * F.col("total_amount"))).select("id", "total_amount", F.col("s").alias("items_total"))


def date_split(bundles: DataFrame, grace: int = 3) -> DataFrame:
    """cloud, event_date: clouds whose dates are further apart than the grace and share no month and day."""
    c = bundles.where("event_date is not null").groupBy("cloud").agg(F.countDistinct("event_date").alias("n"), F.min("event_date").alias("a"), F.max("event_date").alias("b"), F.countDistinct(F.date_format("event_date", "MM-dd")).alias("md"))
    return c.where((F.col("n") >= 2) & (F.datediff("b", "a") > grace) & (F.col("md") == F.col("n"))).select("cloud", "n", "a", "b")
