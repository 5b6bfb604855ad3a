"""Whole numbers beyond 64 bits, as DECIMAL(38, 0) columns."""

from __future__ import annotations

from pyspark.sql import Column

WIDE = "decimal(38,0)"


def wide(c: Column) -> Column:
    return c.cast(WIDE)


def add(a: Column, b: Column) -> Column:
    return (a + b).cast(WIDE)


def subtract(a: Column, b: Column) -> Column:
    return (a - b).cast(WIDE)


def multiply(a: Column, b: Column) -> Column:
    """The product; null (or an error in ANSI mode) above 38 digits. Factors are 64-bit whole numbers or decimals."""
    return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(WIDE)


def divide(a: Column, b: Column) -> tuple[Column, Column]:
    """(quotient toward zero, remainder with the dividend's sign); null for a divisor of 0."""
    rest = a % b
    return ((a - rest) / b).cast(WIDE), rest.cast(WIDE)
