"""Text forms of report numbers; raw numbers stay in their own columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col, missing_to_null

MISSING = "-"


def metric_text(c: Column | str, precision: int = 4) -> Column:
    v = missing_to_null(as_col(c).cast("double"))
    return F.coalesce(F.when(v.isNotNull(), F.format_string(f"%.{precision}f", v)), F.lit(MISSING))


def percent_text(c: Column | str, precision: int = 1) -> Column:
    v = missing_to_null(as_col(c).cast("double"))
    return F.coalesce(
        F.when(v.isNotNull(), F.format_string(f"%.{precision}f%%", v * 100)), F.lit(MISSING)
    )


def count_text(c: Column | str) -> Column:
    v = missing_to_null(as_col(c).cast("double"))
    return F.coalesce(v.cast("long").cast("string"), F.lit(MISSING))


def bytes_text(c: Column | str) -> Column:
    """KB below one MB, MB below one GB, then GB."""
    v = as_col(c).cast("double")
    return (
        F.when(v < 1024**2, F.format_string("%.2f KB", v / 1024))
        .when(v < 1024**3, F.format_string("%.2f MB", v / 1024**2))
        .otherwise(F.format_string("%.2f GB", v / 1024**3))
    )
