"""Barcodes: check digits and canonical forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_check_digit(digits: Column) -> Column:
    """Whether 8 or 13 digits end in the check digit of their kind; null and other texts don't."""
    at = lambda k: F.substring(F.lpad(digits, 13, "0"), k, 1).cast("int")
    total = sum((at(k) * (1 if k % 2 else 3) for k in range(2, 14)), start=at(1))
    return F.coalesce(digits.rlike(r"^(?:\d{8}|\d{13})$") & (total % 10 == 0), F.lit(False))


def canonical_barcode(raw: Column) -> Column:
    """The digits of a valid code of 8 or 13, one of 12 with a leading zero; null for what can't be verified."""
    digits = F.regexp_replace(raw.cast("string"), r"\D", "")
    longer = F.concat(F.lit("0"), digits)
    return F.when(has_check_digit(digits), digits).when((F.length(digits) == 12) & has_check_digit(longer), longer)
