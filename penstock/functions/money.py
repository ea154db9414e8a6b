"""Amounts: the EUR factor and sums that don't depend on the order of addition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eur_factor(rate: str = "eur_rate", currency: str = "currency", fold_case: bool = False, missing_is_eur: bool = False) -> Column:
    """The stored rate, else 1 for EUR, else null, so that the amount drops out of sums."""
    c = F.col(currency)
    if missing_is_eur:
        c = F.coalesce(c, F.lit("EUR"))
    return F.coalesce(F.col(rate), F.when((F.upper(c) if fold_case else c) == "EUR", F.lit(1.0)))


#: Far below the last place that is kept: quotients that end in a half there round the same way whatever their last bit.
TIE = 3e-10


def money_sum(c: Column | str) -> Column:
    """A sum through decimal(24,6): the same in every order of addition."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum((c + TIE).cast("decimal(24,6)")).cast("double")


def money_mean(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return money_sum(c) / F.count(c)
