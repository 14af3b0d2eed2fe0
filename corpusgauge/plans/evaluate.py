"""Evaluation of stored predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..datasets import DATASET, DatasetSet
from ..operators import evaluation as E
from ..operators.distributions import quantile_edges, to_datetime

CATEGORY_LIMIT = 20


def _grouping(rows: DataFrame, column: str, names: Sequence[str]) -> dict[str, tuple[str | None, str]]:
    """How each dataset's metadata column is grouped: ``category`` for text of fewer
    than ``CATEGORY_LIMIT`` different values, ``number`` for numbers and text that
    reads as such, or nothing and the reason. Every dataset is judged by its own
    values, missing ones aside."""
    kind = rows.schema[column].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return {n: ("number", "") for n in names}
    if not isinstance(kind, T.StringType):
        return {n: (None, f"{kind.simpleString()} cannot be grouped") for n in names}
    c = F.col(f"`{column}`")
    facts = {
        r[DATASET]: r
        for r in rows.groupBy(DATASET)
        .agg(
            F.count_distinct(c).alias("values"),
            F.count_if(c.isNotNull() & c.try_cast("double").isNull()).alias("words"),
        )
        .collect()
    }
    out: dict[str, tuple[str | None, str]] = {}
    for n in names:
        if n not in facts or facts[n]["values"] < CATEGORY_LIMIT:
            out[n] = ("category", "")
        elif facts[n]["words"] == 0:
            out[n] = ("number", "")
        else:
            out[n] = (None, "text with too many values to group, not all of them numbers")
    return out


def evaluate_predictions(
    datasets: Mapping[str, DataFrame] | DatasetSet,
    y_true: str,
    y_pred: str,
    confidence: str,
    metadata: Sequence[str] = (),
    date: str | None = None,
    comparisons: Sequence[tuple[str, str]] = (),
    thresholds: Sequence[float] = E.THRESHOLDS,
    year_start: int | None = None,
    year_end: int | None = None,
    year_size: int = 1,
    keep_tail: bool = True,
) -> dict[str, DataFrame]:
    """Overall, per-class, by-metadata, by-date and by-confidence metrics of
    several datasets and their pairwise comparison. Datasets without one of the
    required columns, and unusable metadata columns, become rows of ``skipped``.
    """
    ds = datasets if isinstance(datasets, DatasetSet) else DatasetSet(datasets)
    spark = ds.frames[ds.names[0]].sparkSession
    required = [y_true, y_pred, confidence]
    usable = ds.members_with(*required)
    skipped = [
        (n, ",".join(c for c in required if c not in ds.columns(n)), "required column absent")
        for n in ds.names
        if n not in usable
    ]
    out: dict[str, DataFrame] = {}
    if usable:
        ds = ds.only(usable)
        df = ds.long(required)
        cf = E.confusion(df, y_true, y_pred)
        out["confusion"] = cf
        out["overall"] = E.overall_metrics(cf)
        out["per_class"] = E.classification_report(cf)
        out["class_lists"] = E.class_list_check(cf, ds.names)
        out["confidence_flags"] = E.confidence_flags(df, confidence)
        out["by_threshold"] = E.threshold_curve(df, y_true, y_pred, confidence, thresholds)
        out["threshold_table"] = E.threshold_table(out["by_threshold"])
        out["reliability"] = E.reliability_curve(df, y_true, y_pred, confidence)
        if date is not None:
            having = ds.members_with(date)
            if having:
                rows = ds.only(having).long([*required, date])
                if isinstance(rows.schema[date].dataType, T.StringType):
                    rows = rows.withColumn(date, to_datetime(date))
                out["by_year"] = E.metrics_by_year(
                    rows, y_true, y_pred, date, year_start, year_end, year_size, keep_tail
                )
        for c in metadata:
            if c == date:
                continue
            having = ds.members_with(c)
            skipped += [(n, c, "metadata column absent") for n in ds.names if n not in having]
            if not having:
                continue
            part = ds.only(having)
            rows = part.long([*required, c])
            how = _grouping(rows, c, having)
            skipped += [(n, c, reason) for n, (kind, reason) in how.items() if kind is None]
            grouped = [n for n in having if how[n][0] == "category"]
            binned = [n for n in having if how[n][0] == "number"]
            if grouped:
                at = rows.filter(F.col(DATASET).isin(*grouped)).withColumnRenamed(c, "group")
                cfg = E.confusion(at, y_true, y_pred, [DATASET, "group"])
                out[f"by:{c}"] = E.group_metrics(cfg, "group")
            if binned:
                number = F.col(f"`{c}`").try_cast("double")
                at = rows.filter(F.col(DATASET).isin(*binned)).withColumn(c, number)
                edges = quantile_edges(DatasetSet.of_long(at, binned), c)
                out[f"by:{c}:bins" if grouped else f"by:{c}"] = E.metrics_by_bins(at, y_true, y_pred, c, edges)
        if comparisons:
            out["comparisons"] = E.compare_datasets(out["overall"], comparisons)
    out["skipped"] = spark.createDataFrame(skipped, f"{DATASET} string, column string, reason string")
    return out
