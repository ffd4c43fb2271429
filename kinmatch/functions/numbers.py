"""Rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest(x: Column, digits: int) -> Column:
    """`x` times 10^digits to the next whole number, halves away from zero, as DuckDB rounds. F.round takes the decimal that prints as `x`, so halves that are none in binary may go the other way."""
    return F.round(x * float(10**digits)) / float(10**digits)
