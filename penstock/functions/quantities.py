"""Units, numbers, currencies, tax: parsing and conversion as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of units in four languages, by unit.
UNITS = {
    "g": ("g", "gr", "gram", "grams", "γρ"),
    "kg": ("кг", "ka", "kg", "kgs", "kilo", "kilogram", "kilograms", "χιλιόγραμμο"),
    "lb": ("lb", "lbs", "pound", "pounds"),
    "oz": ("oz", "ounce", "ounces"),
    "ml": ("ml", "milliliter", "milliliters", "μλ"),
    "l": ("l", "lt", "ltr", "liter", "liters", "litre", "litres", "ℓ", "λίτρο", "λίτρα"),
    "gal": ("gal", "gallon", "gallons"),
    "pcs": ("ea", "each", "pc", "pcs", "piece", "pieces", "st", "stk", "stück", "τεμ", "τεμάχιο", "τεμάχια", "шт"),
    "pack": ("pack", "package", "packages", "pkg", "συσκ"),
    "kwh": ("kwh", "κβτω"),
    "m": ("m", "meter", "meters", "μ", "μέτρο"),
    "m2": ("sqm", "m2", "m²", "τμ"),
    "m3": ("cbm", "m3", "m³", "κυβ.μ"),
    "h": ("hr", "hour", "hours", "ώρα", "ώρες"),
    "min": ("min", "minute", "minutes", "λεπτό", "λεπτά"),
}
# Unit -> (family, factor to the family's base).
FAMILIES = {"g": ("mass", 1.0), "kg": ("mass", 1000.0), "lb": ("mass", 453.592), "oz": ("mass", 28.3495), "ml": ("volume", 1.0), "l": ("volume", 1000.0), "gal": ("volume", 3785.41), "min": ("time", 1.0), "h": ("time", 60.0)}
# What stands for a currency on paper, and the codes known.
CURRENCY_MARKS = {
    "€": "EUR", "ΕΥΡΩ": "EUR", "ευρω": "EUR", "$": "USD", "£": "GBP", "¥": "JPY", "₽": "RUB", "руб": "RUB", "руб.": "RUB", "РУБ": "RUB", "₪": "ILS", "₹": "INR", "¢": "USD", "₩": "KRW", "₴": "UAH", "₺": "TRY",
    "₱": "PHP", "฿": "THB", "₫": "VND", "zł": "PLN", "Kč": "CZK", "kr": "SEK", "CHF": "CHF", "Fr": "CHF",
}
CURRENCIES = (
    "EUR", "USD", "GBP", "JPY", "CHF", "SEK", "NOK", "DKK", "PLN", "CZK", "RUB", "ILS", "INR", "CNY", "KRW", "UAH",
    "TRY", "PHP", "THB", "VND", "AUD", "CAD", "NZD", "SGD", "HKD", "MYR", "IDR", "AED", "SAR", "ZAR", "BRL", "MXN", "ARS",
)
# Words that name a tax.
TAX_WORDS = {
    "exempt": ("exempt", "tax-free", "tax free", "zero-rated"), "gst": ("gst", "goods and services tax"), "sales_tax": ("sales tax", "sales_tax", "salestax", "hst", "pst", "qst"),
    "vat": ("vat", "mwst", "mva", "moms", "φπα", "fpa", "iva", "tva", "btw", "dph", "ндс", "kdv"),
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_unit(raw: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """The caller's aliases, the known spellings, the same without punctuation, x3 and single letters as pieces, else other; null or blank: pcs."""
    table = {w: u for u, ws in UNITS.items() for w in ws} | {k.lower(): v for k, v in (aliases or {}).items()}
    t = F.lower(F.trim(_c(raw)))
    bare = F.regexp_replace(t, r"[.,;:]+", "")
    found = F.coalesce(F.try_element_at(_map(table), t), F.try_element_at(_map(table), bare))
    return F.when(t.isNull() | (t == ""), "pcs").otherwise(F.coalesce(found, F.when(bare.rlike(r"^x\d+$") | bare.rlike(r"^\p{L}$"), "pcs"), F.lit("other")))


def convert(value: Column, source: Column, target: Column) -> Column:
    """Within a family of units; else null."""
    fam, fac = _map({k: v[0] for k, v in FAMILIES.items()}), _map({k: v[1] for k, v in FAMILIES.items()})
    same = F.try_element_at(fam, source) == F.try_element_at(fam, target)
    return F.when(source == target, value).when(same, value * F.try_element_at(fac, source) / F.try_element_at(fac, target))


def parse_number(raw: Column | str, suffixes: bool = True) -> Column:
    """A number with currency marks, percent, thousands separators of either style and K, M, B, T."""
    t = F.trim(_c(raw).cast("string"))
    marks = "|".join(sorted({*CURRENCIES, *(m for m in CURRENCY_MARKS if m.isalpha())}, key=len, reverse=True))
    t = F.regexp_replace(t, rf"(?u)(?:{marks})\.?", "")
    t = F.regexp_replace(t, r"[€$£¥₽₪₹¢₩₴₺₱฿₫~%'\s ]+", "")
    scale = F.lit(1.0)
    if suffixes:
        for s, f in (("K", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12)):
            scale = F.when(F.upper(t).rlike(rf"^[-+(]?[\d.,]+{s}\)?$"), F.lit(f)).otherwise(scale)
        t = F.regexp_replace(t, r"(?i)[KMBT](\)?)$", "$1")
    negative = t.rlike(r"^\(.*\)$") | t.startswith("-") | t.endswith("-")
    t = F.regexp_replace(t, r"[()+\-]", "")
    dot, comma = F.instr(F.reverse(t), "."), F.instr(F.reverse(t), ",")
    n = lambda x: F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))
    plain = (
        F.when((dot > 0) & (comma > 0) & (comma < dot), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((dot > 0) & (comma > 0), F.replace(t, F.lit(","), F.lit("")))
        .when((n(",") == 1) & (comma != 4), F.replace(t, F.lit(","), F.lit(".")))
        .when(comma > 0, F.replace(t, F.lit(","), F.lit("")))
        .when(n(".") > 1, F.replace(t, F.lit("."), F.lit("")))
        .otherwise(t)
    )
    v = F.when(plain.rlike(r"^\d*\.?\d+$|^\d+\.$"), plain.try_cast("double")) * scale
    return F.when(negative, -v).otherwise(v)


def parse_bank_amount(raw: Column | str, parity: bool = False) -> Column:
    """An amount of a bank export. Both separators: the last one is the decimal one (parity: the comma is always dropped); one comma before two digits is decimal."""
    t = F.regexp_replace(F.trim(_c(raw)), r"(?i)EUR|USD|GBP|CHF|RUB|[€$£₽\s]", "")
    both = t.contains(",") & t.contains(".")
    us = F.replace(t, F.lit(","), F.lit(""))
    eu = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    odd = us if parity else F.when(F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), "."), eu).otherwise(us)
    return F.when(both, odd).when(t.rlike(r"^[^,]*,\d{2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(us).try_cast("double")


def parse_quantity_unit(raw: Column | str) -> Column:
    """struct(quantity, unit) of texts such as '1,5 kg'; nothing found: (1, pcs)."""
    t = F.trim(_c(raw))
    num, unit = F.regexp_extract(t, r"^(\d+(?:[.,]\d+)?)\s*(.*)$", 1), F.regexp_extract(t, r"^(\d+(?:[.,]\d+)?)\s*(.*)$", 2)
    q = F.replace(F.nullif(num, F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.struct(F.coalesce(q, F.lit(1.0)).alias("quantity"), F.when(q.isNull(), "pcs").otherwise(normalize_unit(unit)).alias("unit"))


def normalize_currency(code: Column | str) -> Column:
    """Marks and codes to ISO; missing values are EUR; what isn't known stays, in upper case."""
    t = F.trim(_c(code))
    blank = t.isNull() | F.lower(t).isin("", "null", "none", "n/a", "na", "-", "unknown")
    return F.when(blank, "EUR").otherwise(F.coalesce(F.try_element_at(_map(CURRENCY_MARKS), t), F.upper(t)))


def find_currency(text: Column | str) -> Column:
    """The currency that a text shows: its first mark in the order of the table, else a known code."""
    t = _c(text)
    symbols = [(k, v) for k, v in CURRENCY_MARKS.items() if not k.isascii() or k == "$"]
    by_mark = reduce(lambda rest, kv: F.when(t.contains(kv[0]), kv[1]).otherwise(rest), reversed(symbols), F.lit(None).cast("string"))
    code = F.regexp_extract(F.upper(t), rf"(?<![A-Z])({'|'.join(CURRENCIES)})(?![A-Z])", 1)
    return F.coalesce(by_mark, F.nullif(code, F.lit("")))


def parse_percentage(text: Column | str) -> Column:
    p = F.regexp_extract(_c(text), r"(-?\d+(?:[.,]\d+)?)\s*%", 1)
    return F.replace(F.nullif(p, F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def tax_type(text: Column | str) -> Column:
    """exempt, gst, sales_tax or vat by the words of a text; else none."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    out = F.lit("none")
    for kind, words_ in reversed(TAX_WORDS.items()):
        out = F.when(t.rlike(r"(?uU)(?<!\w)(?:" + "|".join(words_) + r")(?!\w)"), kind).otherwise(out)
    return out


def tax_amount(amount: Column, rate: Column) -> Column:
    """amount * rate / 100 to two places, half to even."""
    return F.bround(amount.cast("decimal(18,4)") * rate.cast("decimal(9,4)") / F.lit(100), 2)


def item_tax_rate(raw: Column, codes: Column | None = None) -> Column:
    """A fraction below 1 is a share; a value over 50 is a code of the receipt's own table (a map from code to rate)."""
    v = parse_number(raw)
    named = F.try_element_at(codes, v.cast("int").cast("string")) if codes is not None else F.lit(None).cast("double")
    return F.when((v > 0) & (v < 1), v * 100).when(v > 50, named).otherwise(v)
