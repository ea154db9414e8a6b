"""Date buckets, parsing and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bucket(d: Column | str, period: str) -> Column:
    """year, quarter (YYYY-Qn), month, week (%Y-W%W: Monday first, 00-53) or day of a date, as text."""
    d = _c(d)
    if period == "year":
        return F.date_format(d, "yyyy")
    if period == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
    if period == "month":
        return F.date_format(d, "yyyy-MM")
    if period == "week":
        week = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int").cast("string")
        return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(week, 2, "0"))
    if period == "day":
        return F.date_format(d, "yyyy-MM-dd")
    raise ValueError(f"unknown period {period!r}")


#: Formats of bank exports, tried in this order.
BANK_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd/MM/yy", "yyyy-MM-dd HH:mm:ss")


def parse_bank_date(raw: Column | str) -> Column:
    """The first format that fits, day before month."""
    raw = F.trim(_c(raw))
    shapes = {"yyyy-MM-dd": r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy/MM/dd": r"^\d{4}/\d{1,2}/\d{1,2}$", "dd/MM/yy": r"^\d{1,2}/\d{1,2}/\d{2}$", "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"}
    tries = []
    for f in BANK_FORMATS:
        sep = next(c for c in "/.-" if c in f)
        shape = shapes.get(f, rf"^\d{{1,2}}[{sep}]\d{{1,2}}[{sep}]\d{{4}}$")
        loose = f.replace("dd", "d").replace("MM", "M") if "HH" not in f else f
        tries.append(F.when(raw.rlike(shape), F.try_to_timestamp(raw, F.lit(loose)).cast("date")))
    return F.coalesce(*tries)


def parse_date(raw: Column | str) -> Column:
    """ISO, else day/month/year; where the month can't be one, the two are swapped; two-digit years are 20xx."""
    raw = F.trim(_c(raw))
    iso = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
    eu = r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4}|\d{2})(?!\d)"
    part = lambda p, k: F.nullif(F.regexp_extract(raw, p, k), F.lit("")).cast("int")
    a, b, y = part(eu, 1), part(eu, 2), part(eu, 3)
    y = F.when(y < 100, y + 2000).otherwise(y)
    swap = (b > 12) & (a <= 12)
    made = lambda y, m, d: F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(F.when(raw.rlike(iso), made(part(iso, 1), part(iso, 2), part(iso, 3))), F.when(raw.rlike(eu), made(y, F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a))))


def disambiguate(parsed: Column, reference: Column, day_first: Column | None = None) -> Column:
    """Of a date and its day-month swap: the hint decides, else a date after the reference is refused, else the nearer one stays."""
    swapped = F.when((F.dayofmonth(parsed) <= 12) & (F.dayofmonth(parsed) != F.month(parsed)), F.make_date(F.year(parsed), F.dayofmonth(parsed), F.month(parsed)))
    gap = lambda d: F.abs(F.datediff(reference, d))
    choice = F.when(swapped.isNull() | reference.isNull(), parsed).when((parsed > reference) & (swapped <= reference), swapped).when((swapped > reference) & (parsed <= reference), parsed).when(gap(swapped) < gap(parsed), swapped).otherwise(parsed)
    return choice if day_first is None else F.when(day_first, parsed).when(~day_first, F.coalesce(swapped, parsed)).otherwise(choice)


def format_date(d: Column | str, style: str = "iso") -> Column:
    return F.date_format(_c(d), {"iso": "yyyy-MM-dd", "eu": "dd/MM/yyyy", "us": "MM/dd/yyyy"}[style])
