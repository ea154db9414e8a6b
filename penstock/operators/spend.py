"""Spend analytics, reports, distribution forms and budgets over facts and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bucket
from ..functions.money import eur_factor, money_mean, money_sum
from ..functions.vendors import is_intermediary

EUR = lambda: F.col("total_amount") * eur_factor(fold_case=True, missing_is_eur=True)
SPEND = ("purchase", "subscription_payment")


def in_range(df: DataFrame, date_from=None, date_to=None, col: str = "event_date") -> DataFrame:
    if date_from:
        df = df.where(F.col(col) >= F.lit(date_from).cast("date"))
    if date_to:
        df = df.where(F.col(col) <= F.lit(date_to).cast("date"))
    return df


def vendor_group(key: str = "vendor_key", name: str = "vendor") -> Column:
    return F.coalesce(F.nullif(F.col(key), F.lit("")), F.nullif(F.col(name), F.lit("")), F.lit("Unknown"))


def spending_by_vendor(facts: DataFrame, date_from=None, date_to=None, limit: int | None = 50) -> DataFrame:
    """Purchases by vendor in EUR, without payment intermediaries; share of the grand total before the limit. All facts count: there is no cut to the newest."""
    rows = in_range(facts.where(F.col("fact_type") == "purchase"), date_from, date_to).where(~is_intermediary("vendor")).withColumn("eur", EUR()).where("eur is not null")
    groups = rows.groupBy(vendor_group().alias("vendor_group")).agg(F.min("vendor").alias("vendor"), money_sum("eur").alias("total"), F.count("*").alias("n"))
    total = rows.agg(money_sum("eur").alias("grand"))  # one row
    out = groups.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("total") / F.col("grand") * 100, 4)).drop("grand")
    return out.orderBy(F.desc("total"), "vendor_group").limit(limit) if limit else out


def spending_by_month(facts: DataFrame, date_from=None, date_to=None) -> DataFrame:
    rows = in_range(facts.where((F.col("fact_type") == "purchase") & F.col("event_date").isNotNull()), date_from, date_to).withColumn("eur", EUR()).where("eur is not null")
    return rows.groupBy(bucket("event_date", "month").alias("month")).agg(money_sum("eur").alias("total"), F.count("*").alias("n"), money_mean("eur").alias("mean"))


def item_frequency(items: DataFrame, facts: DataFrame, limit: int | None = 50) -> DataFrame:
    """Items by folded name: how often, raw total, mean, and the vendors seen."""
    f = facts.where(F.col("fact_type") == "purchase").select(F.col("id").alias("fact_id"), "vendor")
    out = items.join(f, "fact_id").groupBy(F.lower("name").alias("item")).agg(F.count("*").alias("n"), money_sum("total_price").alias("total"), money_mean("total_price").alias("mean"), F.countDistinct("vendor").alias("n_vendors"))
    return out.orderBy(F.desc("n"), "item").limit(limit) if limit else out


def item_vendors(items: DataFrame, facts: DataFrame) -> DataFrame:
    """The sorted set of vendors of each item, as (item, vendor) rows rather than one unbounded array."""
    f = facts.where(F.col("fact_type") == "purchase").select(F.col("id").alias("fact_id"), "vendor")
    return items.join(f, "fact_id").select(F.lower("name").alias("item"), "vendor").distinct()


def seasonal_patterns(facts: DataFrame) -> DataFrame:
    """Month-of-year totals over the years seen at all, and the deviation from the mean of the months present; always twelve rows."""
    rows = facts.where((F.col("fact_type") == "purchase") & F.col("event_date").isNotNull()).withColumn("eur", EUR()).where("eur is not null")
    per = rows.groupBy(F.month("event_date").alias("month"), F.year("event_date").alias("year")).agg(money_sum("eur").alias("t"))  # a row a month
    years = per.agg(F.countDistinct("year").alias("years"))
    months = per.groupBy("month").agg(money_sum("t").alias("t")).crossJoin(years).select("month", (F.col("t") / F.col("years")).alias("average"))
    mean = months.agg(F.avg("average").alias("mean"))
    grid = facts.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return grid.join(months, "month", "left").crossJoin(mean).select("month", F.coalesce("average", F.lit(0.0)).alias("average"), F.when(F.col("average").isNotNull(), F.round((F.col("average") - F.col("mean")) / F.col("mean") * 100, 4)).alias("deviation"))


def spending_summary(facts: DataFrame, period: str = "month", **range_) -> DataFrame:
    if period == "month":
        return spending_by_month(facts, **range_)
    if period == "vendor":
        return spending_by_vendor(facts, **range_)
    raise ValueError(f"unknown period {period!r}")


def spending_analysis(facts: DataFrame, items: DataFrame | None = None, group_by: str = "month", per_item: bool = False) -> DataFrame:
    """By day, week, month, vendor or category. By category a fact's amount counts once for each of its items (per_item: the items' own amounts instead)."""
    rows = facts.where(F.col("fact_type").isin(*SPEND)).withColumn("eur", F.col("total_amount") * eur_factor())
    if group_by == "category":
        i = items.select("fact_id", F.coalesce("category", F.lit("uncategorized")).alias("key"), "total_price")
        rows = rows.join(i, rows["id"] == i["fact_id"])
        if per_item:
            rows = rows.withColumn("eur", F.col("total_price") * eur_factor())
    else:
        rows = rows.withColumn("key", F.col("vendor") if group_by == "vendor" else bucket("event_date", group_by))
    return rows.groupBy("key").agg(F.countDistinct("id").alias("n_facts"), money_sum("eur").alias("total"), money_mean("eur").alias("mean"), F.min("eur").alias("least"), F.max("eur").alias("most"))


def spending_overview(facts: DataFrame) -> DataFrame:
    rows = facts.where(F.col("fact_type").isin(*SPEND)).withColumn("eur", F.col("total_amount") * eur_factor())
    modal = rows.groupBy("currency").count().orderBy(F.desc("count"), "currency").limit(1).select(F.col("currency").alias("modal_currency"))
    return rows.agg(F.count("*").alias("n_facts"), money_sum("eur").alias("total"), F.countDistinct("vendor_key").alias("n_vendors"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date")).crossJoin(modal)


def month_bounds(year: int, month: int) -> tuple[str, str]:
    return f"{year:04d}-{month:02d}-01", f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"


def _month(df: DataFrame, year: int, month: int) -> DataFrame:
    a, b = month_bounds(year, month)
    return df.where((F.col("event_date") >= F.lit(a).cast("date")) & (F.col("event_date") < F.lit(b).cast("date")))


def monthly_report(facts: DataFrame, year: int, month: int, eur: bool = True) -> DataFrame:
    """Expenses, refunds as income, and their counts over a half-open month; raw: in the facts' own currency."""
    amount = F.col("total_amount") * eur_factor() if eur else F.col("total_amount")
    spent = F.col("fact_type").isin(*SPEND)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return _month(facts, year, month).withColumn("a", amount).agg(
        zero(money_sum(F.when(spent, F.col("a")))).alias("expenses"), zero(money_sum(F.when(~spent, F.col("a")))).alias("income"), F.count(F.when(spent, 1)).alias("n_expenses"), F.count(F.when(~spent, 1)).alias("n_income")
    )


def month_change(facts: DataFrame, year: int, month: int) -> DataFrame:
    """A month's raw expenses, the month's before, and the change in percent."""
    py, pm = (year, month - 1) if month > 1 else (year - 1, 12)
    now = monthly_report(facts, year, month, eur=False).select("expenses")
    before = monthly_report(facts, py, pm, eur=False).select(F.col("expenses").alias("previous"))
    return now.crossJoin(before).withColumn("change", F.when(F.col("previous") != 0, F.round((F.col("expenses") - F.col("previous")) / F.col("previous") * 100, 4)))


def category_breakdown(items: DataFrame, facts: DataFrame, year: int, month: int) -> DataFrame:
    f = _month(facts.where(F.col("fact_type").isin(*SPEND)), year, month)
    total = f.agg(money_sum("total_amount").alias("all"))
    rows = items.join(f.select(F.col("id").alias("fact_id")), "fact_id").groupBy(F.coalesce("category", F.lit("Uncategorized")).alias("category")).agg(money_sum("total_price").alias("total"), F.count("*").alias("n"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(F.col("total") / F.col("all") * 100, 4)))
    return rows.crossJoin(F.broadcast(total)).select("category", "total", "n", share.alias("share"))


def vendor_breakdown(facts: DataFrame, year: int, month: int, limit: int = 20) -> DataFrame:
    f = _month(facts.where(F.col("fact_type").isin(*SPEND)), year, month)
    return f.groupBy(F.coalesce("vendor", F.lit("Unknown")).alias("vendor")).agg(money_sum("total_amount").alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), "vendor").limit(limit)


def top_expenses(facts: DataFrame, year: int, month: int, limit: int = 10) -> DataFrame:
    f = _month(facts.where(F.col("fact_type").isin(*SPEND)), year, month)
    return f.select("id", "vendor", "total_amount", "event_date").orderBy(F.desc("total_amount"), "id").limit(limit)


def warranty_status(owned: DataFrame, as_of, days_warning: int = 90, include_expired: bool = False) -> DataFrame:
    left = F.datediff("warranty_expires", F.lit(as_of).cast("date"))
    rows = owned.where("warranty_expires is not null and status = 'active'").withColumn("days_left", left).where(F.col("days_left") <= days_warning)
    return (rows if include_expired else rows.where("days_left >= 0")).orderBy("days_left", "id")


def insurance_inventory(owned: DataFrame) -> DataFrame:
    """Insured value by category, total in the last row. A current value of 0 counts as missing."""
    v = F.coalesce(F.nullif(F.col("current_value"), F.lit(0)), F.col("purchase_price"), F.lit(0))
    rows = owned.where("status = 'active' and insured").withColumn("v", v.cast("double"))
    return rows.rollup("category").agg(F.count("*").alias("n"), money_sum("v").alias("value"))


def summary_form(facts: DataFrame) -> DataFrame:
    spent = F.col("fact_type").isin(*SPEND)
    out = facts.agg(money_sum(F.when(spent, F.col("total_amount"))).alias("expenses"), money_sum(F.when(~spent, F.col("total_amount"))).alias("income"), F.count("*").alias("n"))
    return out.withColumn("net", F.col("income") - F.col("expenses"))


def top_groups(facts: DataFrame, key: str, limit: int = 5) -> DataFrame:
    return facts.where(F.col("fact_type").isin(*SPEND)).groupBy(key).agg(money_sum("total_amount").alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), key).limit(limit)


def detailed_form(facts: DataFrame, items: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Every vendor and category of the spend, and how many facts, in long form: (section, name, total, n). A fact without a vendor is Unknown, an item without a category uncategorized; categories count lines. Both dates are included."""
    f = in_range(facts, date_from, date_to).where(F.col("fact_type").isin(*SPEND))
    vendors = f.groupBy(F.coalesce("vendor", F.lit("Unknown")).alias("name")).agg(money_sum("total_amount").alias("total"), F.count("*").alias("n"))
    lines = items.join(f.select(F.col("id").alias("fact_id")), "fact_id")
    categories = lines.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("name")).agg(money_sum("total_price").alias("total"), F.count("*").alias("n"))
    return vendors.select(F.lit("vendor").alias("section"), "*").unionByName(categories.select(F.lit("category").alias("section"), "*"))


def detailed_lines(facts: DataFrame, items: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """The lines of the spend under their category: rows, not a list for each category, so that a large category stays distributed. A quantity of null or 0 is 1."""
    f = in_range(facts, date_from, date_to).where(F.col("fact_type").isin(*SPEND)).select(F.col("id").alias("fact_id"))
    cents = lambda c: F.round(F.col(c).cast("decimal(24,6)"), 2).cast("double")
    return items.join(f, "fact_id").select(F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized")).alias("category"), "fact_id", "name", F.coalesce(F.nullif(F.col("quantity").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("quantity"), cents("total_price").alias("total_price"))


def monthly_flow(facts: DataFrame) -> DataFrame:
    spent = F.col("fact_type").isin(*SPEND)
    return facts.groupBy(bucket("event_date", "month").alias("month")).agg(money_sum(F.when(spent, F.col("total_amount"))).alias("expenses"), money_sum(F.when(~spent, F.col("total_amount"))).alias("income"))


def recurring_vendors(facts: DataFrame, least: int = 3) -> DataFrame:
    """Vendors with several payments; twelve and more count as weekly."""
    n = F.col("n")
    rows = facts.where(F.col("fact_type").isin(*SPEND)).groupBy("vendor").agg(F.count("*").alias("n"), money_mean("total_amount").alias("mean"))
    return rows.where(n >= least).withColumn("cadence", F.when(n >= 12, "weekly").otherwise("monthly"))


def unusual_amounts(facts: DataFrame, times: float = 3.0, limit: int = 10) -> DataFrame:
    """Spend beyond several times the mean, largest first."""
    f = facts.where(F.col("fact_type").isin(*SPEND))
    mean = f.agg(money_mean("total_amount").alias("mean"))
    return f.crossJoin(F.broadcast(mean)).where(F.col("total_amount") > times * F.col("mean")).select("id", "vendor", "total_amount").orderBy(F.desc("total_amount"), "id").limit(limit)


def tabular_form(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Facts with the category of their first item (the least one, so that it is the same on every run)."""
    first = items.groupBy("fact_id").agg(F.min("category").alias("category"))
    return facts.join(first, facts["id"] == first["fact_id"], "left").select("id", "event_date", "vendor", "fact_type", "total_amount", "currency", "category")


def vendor_aliases(facts: DataFrame) -> DataFrame:
    """Vendor keys with more than one name: how many, and the most frequent one."""
    names = facts.where("vendor_key is not null and vendor is not null").groupBy("vendor_key", "vendor").agg(F.count("*").alias("n"))
    out = names.groupBy("vendor_key").agg(F.count("*").alias("names"), F.max(F.struct("n", F.col("vendor"))).alias("top"), F.sum("n").alias("facts"))
    return out.where("names >= 2").select("vendor_key", "names", "facts", F.col("top.vendor").alias("usual"))


def assistant_summary(facts: DataFrame, period: str = "month") -> DataFrame:
    return facts.where(F.col("fact_type").isin(*SPEND)).groupBy(bucket("event_date", period).alias("period")).agg(F.count("*").alias("n"), money_sum("total_amount").alias("total"), money_mean("total_amount").alias("mean"))


# Budgets


def actual_spending(items: DataFrame, facts: DataFrame, period: str | None = None) -> DataFrame:
    f = facts.where(F.col("fact_type").isin(*SPEND)).select(F.col("id").alias("fact_id"), "currency", bucket("event_date", "month").alias("period"))
    if period:
        f = f.where(F.col("period") == period)
    return items.join(f, "fact_id").groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category"), "currency", "period").agg(money_sum("total_price").alias("amount"))


def merge_entries(actual: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides (category, period, amount, ord) replace actuals of the same key; of several overrides the last by ord wins."""
    last = overrides.groupBy("category", "period").agg(F.max_by("amount", "ord").alias("override"))
    return actual.groupBy("category", "period").agg(money_sum("amount").alias("amount")).join(last, ["category", "period"], "full").select("category", "period", F.coalesce("override", "amount").alias("amount"))


def variance(base: DataFrame, compare: DataFrame) -> DataFrame:
    """Amounts of two sets of entries by category and period, difference and percent (null where the base is 0)."""
    s = lambda df, n: df.groupBy("category", "period").agg(money_sum("amount").alias(n))
    out = s(base, "base").join(s(compare, "compared"), ["category", "period"], "full").fillna(0.0, ["base", "compared"])
    diff = F.col("compared") - F.col("base")
    return out.withColumn("difference", diff).withColumn("percent", F.when(F.col("base") != 0, F.bround((diff / F.col("base") * 100).cast("decimal(18,6)"), 2).cast("double")))


def budget_comparison(entries: DataFrame, actual: DataFrame) -> DataFrame:
    a = actual.groupBy("category", "period").agg(money_sum("amount").alias("actual"))
    return entries.join(a, ["category", "period"], "left").withColumn("actual", F.coalesce("actual", F.lit(0.0))).withColumn("left_over", F.col("amount") - F.col("actual")).withColumn("over", F.col("actual") > F.col("amount"))
