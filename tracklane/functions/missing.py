"""Missing and non-finite numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(x: Column) -> Column:
    """Neither null nor NaN; infinities are present."""
    return x.isNotNull() & ~F.isnan(x)


def finite(x: Column) -> Column:
    """A real number: not null, NaN or infinite. Never null itself."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def number_or_null(x: Column) -> Column:
    """Non-finite numbers become null."""
    return F.when(finite(x), x)
