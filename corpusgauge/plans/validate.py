"""Validation of an ingested table against its source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import ingestion as I
from ..sources.tables import write_report


def validate_ingestion(
    base: DataFrame,
    ingested: DataFrame,
    hash_columns: Sequence[str] | None = None,
    report_paths: tuple[str, str] | None = None,
    **stat_rules,
) -> dict[str, DataFrame]:
    """Reports of both tables and all comparisons. With ``report_paths`` the
    reports are stored too, for a comparison on another platform."""
    a, b = I.validation_report(base, hash_columns), I.validation_report(ingested, hash_columns)
    if report_paths is not None:
        write_report(a, report_paths[0])
        write_report(b, report_paths[1])
    checks = I.compare_reports(a, b, **stat_rules)
    return {
        "base": a,
        "ingested": b,
        "checks": checks,
        "columns": I.compare_columns(a, b),
        "types": I.compare_types(a, b),
        "stats": I.compare_stats(a, b, **stat_rules),
        "nulls": I.compare_nulls(a, b),
        "hashes": I.compare_hashes(a, b),
        "overall": I.overall_status(checks),
    }
