"""Comparison of two named datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..datasets import DATASET, DatasetSet, column_plan
from ..functions.columns import lookup, ratio
from .distributions import (
    YEAR_SIZE,
    YEAR_THRESHOLD,
    _dates,
    box_stats,
    compare_discrete,
    year_bucket_list,
)


def pair_discrete(pair: DatasetSet, column: str, **kw) -> DataFrame:
    return compare_discrete(pair, column, **kw)


def pair_continuous(pair: DatasetSet, column: str) -> DataFrame:
    """Box statistics of both sides; no rows unless both have values."""
    boxes = box_stats(pair, column)
    # one row per side
    sides = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    return boxes.withColumn("sides", sides).filter("sides = 2").drop("sides")


def pair_datetime(
    pair: DatasetSet, column: str, threshold: int = YEAR_THRESHOLD, size: int = YEAR_SIZE
) -> DataFrame:
    """Proportion of each side per year, or per bucket of ``size`` years when
    the joint span of years exceeds ``threshold``; zero where a side has none."""
    dates = _dates(pair, column).select(DATASET, F.year("ts").alias("year"))
    counts = dates.groupBy(DATASET, "year").agg(F.count(F.lit(1)).alias("n"))
    ranges = dates.groupBy(DATASET).agg(
        F.min("year").alias("lo"), F.max("year").alias("hi"), F.count(F.lit(1)).alias("n")
    ).collect()
    spark = dates.sparkSession
    schema = f"{DATASET} string, first int, label string"
    if len(ranges) != 2:
        return spark.createDataFrame([], schema).select(
            "*", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("proportion")
        )
    lo, hi = min(r["lo"] for r in ranges), max(r["hi"] for r in ranges)
    step = max(1, size) if hi - lo + 1 > threshold else 1
    rows = [(n, first, label) for n in pair.names for first, _, label in year_bucket_list(lo, hi, step)]
    grid = spark.createDataFrame(rows, schema)
    at = (F.lit(lo) + F.floor((F.col("year") - lo) / step) * step).cast("int")
    bucketed = counts.groupBy(DATASET, at.alias("first")).agg(F.sum("n").alias("n"))
    total = lookup(DATASET, {r[DATASET]: r["n"] for r in ranges})
    n = F.coalesce("n", F.lit(0)).cast("long")
    return grid.join(bucketed, [DATASET, "first"], "left").select(
        DATASET, "first", "label", n.alias("n"), ratio(n, total).alias("proportion")
    )


def compare_pair(
    datasets: DatasetSet,
    first: str,
    second: str,
    skip: Sequence[str] = (),
    discrete: Sequence[str] = (),
    continuous: Sequence[str] = (),
    datetime: Sequence[str] = (),
) -> dict[str, dict[str, DataFrame]]:
    """Plan and build the comparison of two datasets: the columns named by the
    caller keep their family, the other shared columns are classified by type."""
    pair = datasets.only([first, second])
    plan = column_plan(pair.frames[first], pair.frames[second], skip)
    named = {"discrete": discrete, "continuous": continuous, "datetime": datetime}
    shared = [c for cols in plan.values() for c in cols]
    chosen = {k: [c for c in shared if c in v] for k, v in named.items()}
    taken = {c for v in named.values() for c in v}
    for k in chosen:
        chosen[k] += [c for c in plan[k] if c not in taken]
    return {
        "discrete": {c: pair_discrete(pair, c) for c in chosen["discrete"]},
        "continuous": {c: pair_continuous(pair, c) for c in chosen["continuous"]},
        "datetime": {c: pair_datetime(pair, c) for c in chosen["datetime"]},
    }


def column_plan_rows(datasets: DatasetSet, first: str, second: str, skip: Sequence[str] = ()) -> DataFrame:
    """The classification of the shared columns as rows."""
    pair = datasets.only([first, second])
    plan = column_plan(pair.frames[first], pair.frames[second], skip)
    spark = pair.frames[first].sparkSession
    rows = [(c, k) for k, cols in plan.items() for c in cols]
    return spark.createDataFrame(rows, "column string, family string")


def kl_divergence(
    ds: DatasetSet, column: str, first: str, second: str, smoothing: float = 0.5
) -> DataFrame:
    """Kullback-Leibler divergence of ``second`` from ``first`` over the joint
    categories of a discrete column, ``smoothing`` being added to every count.
    """
    value = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("nan"))
    df = ds.only([first, second]).long([column]).select(DATASET, value.alias("category"))
    side = lambda name: F.count(F.when(F.col(DATASET) == F.lit(name), 1))
    cells = df.groupBy("category").agg(side(first).alias("a"), side(second).alias("b"))
    # With P = a/A and Q = b/B the sum of p ln(p/q) over categories needs only
    # additive parts, so no total has to be known beforehand.
    a, b = F.col("a") + smoothing, F.col("b") + smoothing
    sums = cells.agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.sum(a).alias("ta"),
        F.sum(b).alias("tb"),
        F.sum(a * F.ln(a / b)).alias("s"),
    )
    return sums.select(
        F.lit(first).alias("first"),
        F.lit(second).alias("second"),
        "n_categories",
        (ratio(F.col("s"), F.col("ta")) + F.ln(ratio(F.col("tb"), F.col("ta")))).alias("kl"),
    )
