"""Checks on the format of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn_valid(value: Column) -> Column:
    """Luhn's checksum over the digits of a value, of which there must be at least twelve."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (F.length(digits) >= 12) & F.call_function("luhn_check", digits)


def ipv4_valid(value: Column) -> Column:
    """Four numbers from 0 to 255 without leading zeros, separated by dots."""
    parts = F.split(value, r"\.", -1)
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
