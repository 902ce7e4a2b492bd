"""Rupee display with Indian digit grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_inr(amount: Column) -> Column:
    """``₹12,00,000``: the last three digits, then groups of two; null is ₹0."""
    digits = F.coalesce(amount, F.lit(0)).cast("long").cast("string")
    return F.concat(F.lit("₹"), F.regexp_replace(digits, r"(\d)(?=(\d\d)+\d$)", "$1,"))
