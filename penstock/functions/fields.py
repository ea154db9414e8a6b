"""What a field holds, guessed from its name and then from its value, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of names that tell the type, in the order in which types are tried.
BOOLEAN_STARTS = ("is_", "has_", "can_", "should_", "active", "enabled", "visible", "verified", "confirmed", "approved", "taxable")
NAME_WORDS = {
    "date": ("date", "day", "month", "year", "timestamp", "when", "created", "updated", "expires"),
    "percentage": ("percentage", "percent", "pct", "rate", "ratio", "share", "margin", "discount", "tax_rate", "interest", "growth", "change"),
    "currency": ("price", "cost", "amount", "total", "subtotal", "revenue", "income", "expense", "fee", "charge", "payment", "balance", "salary", "wage", "debt", "credit", "refund"),
    "weight": ("weight", "mass", "kg", "gram", "pound", "lbs", "ounce", "oz"),
    "volume": ("volume", "capacity", "liter", "litre", "ml", "gallon", "gal"),
    "energy": ("energy", "power", "kwh", "watt", "electricity"),
    "distance": ("distance", "length", "height", "width", "depth", "meter", "km", "mile", "foot", "ft"),
    "duration": ("duration", "time", "hours", "minutes", "seconds", "period"),
    "area": ("area", "surface", "sqm", "sqft", "square"),
    "count": ("count", "quantity", "qty", "number", "amount", "units", "pieces", "items"),
}
YES_NO = ("true", "false", "yes", "no", "1", "0")
CURRENCY_SIGNS = "[€$£¥₽]"


def type_of_value(value: Column) -> Column:
    """From a value as text; null: text."""
    v = F.trim(value)
    return (
        F.when(F.lower(v).isin(*YES_NO), "boolean")
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .when(v.endswith("%"), "percentage")
        .when(v.rlike(CURRENCY_SIGNS), "currency")
        .when(v.rlike(r"^-?\d+\.?\d*$"), "number")
        .otherwise("text")
    )


def field_type(name: Column, value: Column) -> Column:
    """boolean, date, percentage, currency, weight, volume, energy, distance, duration, area, count, number or text."""
    key = F.lower(F.trim(name))
    words = F.split(key, r"[_\-\s]+")
    flag = F.lit(False)
    for s in BOOLEAN_STARTS:
        flag = flag | key.startswith(s) | (key == s.rstrip("_"))
    by_name = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, ws))), t) for t, ws in NAME_WORDS.items()]
    return F.coalesce(F.when(flag, "boolean"), *by_name, type_of_value(value))
