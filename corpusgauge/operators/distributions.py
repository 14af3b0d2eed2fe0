"""Distributions of single columns and of column pairs, per dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..datasets import DATASET, DatasetSet
from ..functions.columns import as_col, count_if, lookup, missing_to_null, ratio
from .common import attach_groups, per_dataset, top_per
from .quantiles import exact_quantiles, quantile_columns

TOP_CATEGORIES = 40
MISSING_LABEL = "nan"
LOG_RATIO = 50.0
YEAR_THRESHOLD = 15
YEAR_SIZE = 2


# -- discrete columns ---------------------------------------------------------


def value_counts(
    ds: DatasetSet, column: str, keep_missing: bool = False, digits: int | None = 4
) -> DataFrame:
    """Count and share of every value within its dataset."""
    v = F.col(f"`{column}`").cast("string")
    df = ds.long([column]).select(DATASET, v.alias("value"))
    if keep_missing:
        df = df.withColumn("value", F.coalesce("value", F.lit(MISSING_LABEL)))
    else:
        df = df.filter(F.col("value").isNotNull())
    totals = per_dataset(df, total=F.count(F.lit(1)))
    counts = df.groupBy(DATASET, "value").agg(F.count(F.lit(1)).alias("n"))
    share = ratio(F.col("n"), _scalar(totals, "total", "long"))
    return counts.select(
        DATASET, "value", "n", (share if digits is None else F.round(share, digits)).alias("proportion")
    )


def _scalar(table: dict[str, dict], name: str, dtype: str = "double") -> Column:
    """A measure of :func:`per_dataset` as a column."""
    return lookup(DATASET, {d: m[name] for d, m in table.items()}).cast(dtype)


def _usable(df: DataFrame, column: str) -> dict[str, dict]:
    """Rows of the datasets in which the column is not all missing."""
    found = per_dataset(df, total=F.count(F.lit(1)), seen=F.count(column))
    return {d: m for d, m in found.items() if m["seen"] > 0}


def _order_column(column: Column, order: Sequence[str]) -> Column:
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), column)
    return F.when(pos > 0, pos.cast("int"))


def discrete_distribution(
    ds: DatasetSet,
    column: str,
    max_categories: int = TOP_CATEGORIES,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """The categories a chart would show: missing values form a category, the
    most frequent are kept (or the listed ones, in list order) and proportions
    are taken over the rows that stay. A dataset whose column is all missing
    has no rows."""
    v = F.col(f"`{column}`").cast("string")
    df = ds.long([column]).select(DATASET, v.alias("raw"))
    df = df.filter(F.col(DATASET).isin(*_usable(df, "raw")))
    counts = df.groupBy(DATASET, F.coalesce("raw", F.lit(MISSING_LABEL)).alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )
    if order is not None:
        counts = counts.filter(F.col("category").isin(*order))
    kept = top_per(counts, [DATASET], max_categories, F.desc("n"), F.col("category"))
    if order is not None:
        kept = kept.withColumn(
            "rank",
            F.row_number().over(W.partitionBy(DATASET).orderBy(_order_column(F.col("category"), order))),
        )
    total = F.sum("n").over(W.partitionBy(DATASET))
    return kept.select(DATASET, "rank", "category", "n", ratio(F.col("n"), total).alias("proportion"))


def compare_discrete(
    ds: DatasetSet,
    column: str,
    max_categories: int = TOP_CATEGORIES,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Proportions of one column side by side. Proportions are taken before the
    cut; categories rank by the mean over the datasets that have them, or by
    the sum when a display order restricts them. Empty unless two datasets have
    usable values."""
    df = ds.long([column]).select(DATASET, F.col(f"`{column}`").cast("string").alias("raw"))
    usable = _usable(df, "raw")
    if len(usable) < 2:
        usable = {}
    counts = (
        df.filter(F.col(DATASET).isin(*usable))
        .groupBy(DATASET, F.coalesce("raw", F.lit(MISSING_LABEL)).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    props = counts.select(
        DATASET, "category", "n", ratio(F.col("n"), _scalar(usable, "total", "long")).alias("proportion")
    )
    if order is None:
        weight = F.avg("proportion")
    else:
        props = props.filter(F.col("category").isin(*order))
        weight = F.sum("proportion")
    ranked = (
        props.groupBy("category")
        .agg(weight.alias("importance"))
        .orderBy(F.desc("importance"), "category")
        .limit(max_categories)
    )
    shown = F.col("importance").desc() if order is None else _order_column(F.col("category"), order)
    # at most max_categories rows from here on
    ranked = ranked.withColumn(
        "rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(shown, F.col("category")))
    )
    return props.join(F.broadcast(ranked), "category").select(
        "rank", "category", DATASET, "n", "proportion"
    )


def crosstab_percent(
    ds: DatasetSet, row: str, target: str, max_categories: int = TOP_CATEGORIES
) -> DataFrame:
    """Percentage of each target value within a category, for the most
    frequent categories; rows with either value missing are left out."""
    df = ds.long([row, target]).select(
        DATASET,
        F.col(f"`{row}`").cast("string").alias("category"),
        F.col(f"`{target}`").cast("string").alias("target"),
    )
    cells = (
        df.filter(F.col("category").isNotNull() & F.col("target").isNotNull())
        .groupBy(DATASET, "category", "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sizes = cells.groupBy(DATASET, "category").agg(F.sum("n").alias("n_category"))
    top = top_per(sizes, [DATASET], max_categories, F.desc("n_category"), F.col("category"))
    # max_categories rows per declared dataset
    return cells.join(F.broadcast(top), [DATASET, "category"]).select(
        DATASET, "rank", "category", "target", "n", ratio(F.col("n") * 100, F.col("n_category")).alias("pct")
    )


def mean_by_class(ds: DatasetSet, value: Column, label: str, columns: Sequence[str]) -> DataFrame:
    """Mean of a row value per class."""
    df = ds.long(list(dict.fromkeys([*columns, label])))
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(DATASET, F.col(label).cast("string").alias("label"))
        .agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    )


# -- continuous columns -------------------------------------------------------


def _numbers(ds: DatasetSet, column: str, by: Sequence[str] = ()) -> DataFrame:
    df = ds.long(list(dict.fromkeys([column, *by])))
    x = missing_to_null(F.col(f"`{column}`").cast("double"))
    return df.select(DATASET, *[F.col(f"`{b}`").cast("string").alias(b) for b in by], x.alias("x")).filter(
        F.col("x").isNotNull()
    )


def histogram(ds: DatasetSet, column: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram between each dataset's smallest and largest value,
    with density; empty bins are kept."""
    x = _numbers(ds, column)
    ranges = {d: (m["lo"], m["hi"]) for d, m in per_dataset(x, lo=F.min("x"), hi=F.max("x")).items()}
    schema = f"{DATASET} string, lo double, width double"
    edges = []
    for name, (lo, hi) in ranges.items():
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        edges.append((name, lo, (hi - lo) / bins))
    spark = x.sparkSession
    frame = spark.createDataFrame(edges, schema)
    if not edges:
        return frame.select(
            DATASET, F.lit(0).alias("bin"), "lo", F.col("lo").alias("hi"), F.lit(0).cast("long").alias("n"),
            F.col("lo").alias("density"),
        )
    lo = lookup(DATASET, {e[0]: e[1] for e in edges})
    width = lookup(DATASET, {e[0]: e[2] for e in edges})
    at = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = x.groupBy(DATASET, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    total = F.sum("n").over(W.partitionBy(DATASET))
    return grid.join(counts, [DATASET, "bin"], "left").select(
        DATASET,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        ratio(F.coalesce("n", F.lit(0)), total * F.col("width")).alias("density"),
    )


def edge_labels(edges: Sequence[float]) -> list[str]:
    last = len(edges) - 2
    return [
        f"[{edges[i]:.2f} - {edges[i + 1]:.2f}" + ("]" if i == last else ")") for i in range(last + 1)
    ]


def edge_bin(c: Column, edges: Sequence[float]) -> Column:
    """Index of the left-closed bin a value falls in, the last one closed on
    both sides; NULL outside."""
    out = None
    for i in range(len(edges) - 1):
        upper = (c <= edges[i + 1]) if i == len(edges) - 2 else (c < edges[i + 1])
        cond = (c >= edges[i]) & upper
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def histogram_on_edges(ds: DatasetSet, column: str, edges: Sequence[float]) -> DataFrame:
    """Histogram on given edges; values outside are left out, empty bins stay."""
    x = _numbers(ds, column)
    counts = (
        x.select(DATASET, edge_bin(F.col("x"), edges).alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy(DATASET, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = [(n, i, lab) for n in ds.names for i, lab in enumerate(edge_labels(edges))]
    grid = x.sparkSession.createDataFrame(rows, f"{DATASET} string, bin int, label string")
    return grid.join(counts, [DATASET, "bin"], "left").select(
        DATASET, "bin", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


# Moments a cell of the density curve keeps, and bandwidths beyond which it adds nothing.
MOMENTS, REACH = 11, 9.0


def density_curve(ds: DatasetSet, column: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density with the normal-reference bandwidth
    ``std * n^(-1/5)`` on an even grid reaching ``cut`` bandwidths past the data.

    The sum of kernels is not formed value by value. Values fall into cells half a
    bandwidth wide, each of which keeps the first ``MOMENTS`` moments of its values
    about its middle, one partial aggregate; a cell then adds to a grid point the Taylor
    series of the kernel there (Hermite polynomials), whose error is below 1e-12 of a
    value's own kernel. The work per value does not depend on the grid, and cells, not
    values, meet the points within ``REACH`` bandwidths.
    """
    x = _numbers(ds, column)
    found = per_dataset(x, n=F.count(F.lit(1)), std=F.stddev_samp("x"), lo=F.min("x"), hi=F.max("x"))
    curves = {}
    for name, m in found.items():
        if m["n"] > 1 and m["std"] > 0:
            h = m["std"] * m["n"] ** -0.2
            start = m["lo"] - cut * h
            curves[name] = {"n": m["n"], "h": h, "start": start, "step": (m["hi"] - m["lo"] + 2 * cut * h) / (points - 1)}
    n, h, start, step = (_scalar(curves, c) for c in ("n", "h", "start", "step"))
    cell = F.floor((F.col("x") - start) / (h / 2))
    middle = start + (F.col("cell") + 0.5) * (h / 2)
    placed = x.filter(F.col(DATASET).isin(*curves)).withColumn("cell", cell)
    off = (F.col("x") - middle) / h
    power, sums = F.lit(1.0), []
    for k in range(MOMENTS):
        # the k-th moment over k!
        sums.append(F.sum(power).alias(f"m{k}"))
        power = power * off / (k + 1)
    cells = placed.groupBy(DATASET, "cell").agg(*sums)
    low = F.greatest(F.lit(0), F.ceil((middle - REACH * h - start) / step).cast("int"))
    high = F.least(F.lit(points - 1), F.floor((middle + REACH * h - start) / step).cast("int"))
    near = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    at = start + F.col("point") * step
    u = (at - middle) / h
    met = cells.withColumn("point", F.explode(near)).withColumn("u", u).withColumn("h0", F.lit(1.0)).withColumn("h1", F.col("u"))
    for k in range(2, MOMENTS):
        # a column per polynomial: each is used by the two that follow
        met = met.withColumn(f"h{k}", F.col("u") * F.col(f"h{k - 1}") - (k - 1) * F.col(f"h{k - 2}"))
    series = sum((F.col(f"m{k}") * F.col(f"h{k}") for k in range(1, MOMENTS)), F.col("m0"))
    kernel = met.groupBy(DATASET, "point").agg(F.sum(F.exp(-0.5 * F.col("u") * F.col("u")) * series).alias("s"))
    # points that no cell reaches have a density of 0
    grid = x.sparkSession.createDataFrame([(d, p) for d in curves for p in range(points)], f"{DATASET} string, point int")
    return grid.join(kernel, [DATASET, "point"], "left").select(
        DATASET, "point", at.alias("at"), (F.coalesce("s", F.lit(0.0)) / (n * h * F.sqrt(F.lit(2.0) * F.pi()))).alias("density")
    )


def box_stats(ds: DatasetSet, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges inside the data, and the
    number of values beyond them, per dataset and optional grouping columns.
    Rows with a missing group or value are left out. ``log_scale`` advises a
    log axis: all values positive and the largest more than 50 medians away."""
    x = _numbers(ds, column, by)
    for b in by:
        x = x.filter(F.col(f"`{b}`").isNotNull())
    keys = [DATASET, *by]
    q = quantile_columns(exact_quantiles(x, keys, ["x"]), keys, {0.25: "q1", 0.5: "median", 0.75: "q3"})
    q = q.drop("column")
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = F.col("x").between(low, high)
    rows = attach_groups(x, q, keys)
    return (
        rows.groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
            count_if(~inside).alias("n_outliers"),
            F.min("x").alias("lo"),
            F.max("x").alias("hi"),
        )
        .select(
            *keys,
            "n",
            "whisker_low",
            "q1",
            "median",
            "q3",
            "whisker_high",
            "n_outliers",
            "lo",
            "hi",
        )
    )


def log_scale_advice(boxes: DataFrame, by: Sequence[str] = (DATASET,)) -> DataFrame:
    """Advice per dataset from box statistics by class; the median is that of
    the whole dataset, so ``boxes`` must have one row per dataset."""
    positive = F.col("lo") > 0
    return boxes.select(
        *by,
        (positive & (F.col("hi") > LOG_RATIO * F.col("median"))).alias("log_scale"),
        ((~positive) & (F.col("hi") > 0)).alias("some_not_positive"),
    )


def quantile_edges(ds: DatasetSet, column: str, q: int = 5, fallback_bins: int = 5) -> dict[str, list[float]]:
    """Quantile bin edges per dataset with equal neighbours merged; when the
    quantiles leave fewer than two edges, equal-width edges instead."""
    x = _numbers(ds, column)
    probs = [i / q for i in range(q + 1)]
    rows = exact_quantiles(x, [DATASET], ["x"], probs).collect()
    found: dict[str, list[float]] = {}
    for r in sorted(rows, key=lambda r: (r[DATASET], r["prob"])):
        edges = found.setdefault(r[DATASET], [])
        if not edges or r["quantile"] > edges[-1]:
            edges.append(r["quantile"])
    for name, edges in found.items():
        if len(edges) < 2:
            c = edges[0]
            pad = abs(c) * 0.001 or 0.001
            w = 2 * pad / fallback_bins
            found[name] = [c - pad + i * w for i in range(fallback_bins + 1)]
    return found


def right_closed_bin(c: Column | str, edges: Sequence[float]) -> Column:
    """Index of the right-closed bin, the lowest edge included; NULL outside."""
    c = as_col(c)
    out = F.when(c < edges[0], F.lit(None).cast("int"))
    for i in range(len(edges) - 1):
        out = out.when(c <= edges[i + 1], F.lit(i))
    return out


def quantile_bins(ds: DatasetSet, column: str, q: int = 5) -> DataFrame:
    """Row counts of the quantile bins."""
    edges = quantile_edges(ds, column, q)
    x = _numbers(ds, column)
    rows = [
        (name, i, float(e[i]), float(e[i + 1])) for name, e in edges.items() for i in range(len(e) - 1)
    ]
    grid = x.sparkSession.createDataFrame(rows, f"{DATASET} string, bin int, lo double, hi double")
    if not rows:
        return grid.withColumn("n", F.lit(0).cast("long"))
    at = lookup(DATASET, {n: right_closed_bin("x", e) for n, e in edges.items()})
    counts = x.groupBy(DATASET, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [DATASET, "bin"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)).cast("long")
    )


# -- dates --------------------------------------------------------------------


def to_datetime(c: Column | str) -> Column:
    """Timestamp without zone; a text that is no date gives NULL."""
    return F.expr(f"CAST(try_to_timestamp({_sql_name(c)}) AS TIMESTAMP_NTZ)")


def _sql_name(c: Column | str) -> str:
    if not isinstance(c, str):
        raise TypeError("name the column")
    return f"`{c}`"


def _dates(ds: DatasetSet, column: str) -> DataFrame:
    df = ds.long([column])
    typ = df.schema[column].dataType.simpleString()
    c = to_datetime(column) if typ == "string" else F.col(f"`{column}`")
    return df.select(DATASET, c.alias("ts")).filter(F.col("ts").isNotNull())


def year_counts(ds: DatasetSet, column: str) -> DataFrame:
    return (
        _dates(ds, column)
        .groupBy(DATASET, F.year("ts").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def month_counts(ds: DatasetSet, column: str) -> DataFrame:
    return (
        _dates(ds, column)
        .groupBy(DATASET, F.date_format("ts", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def year_bucket_list(lo: int, hi: int, size: int) -> list[tuple[int, int, str]]:
    """Left-closed year buckets ``(first, last, label)`` covering ``lo..hi``."""
    out = []
    for y in range(lo, hi + 1, size):
        last = y + size - 1
        out.append((y, last, f"{y}-{last}" if last > y else f"{y}"))
    return out


def year_buckets(
    ds: DatasetSet, column: str, threshold: int = YEAR_THRESHOLD, size: int = YEAR_SIZE
) -> DataFrame:
    """Counts per year, or per bucket of ``size`` years for datasets with more
    than ``threshold`` distinct years; empty buckets are kept then."""
    size = max(1, size)
    years = year_counts(ds, column)
    # one row per dataset and year from here on
    w = W.partitionBy(DATASET)
    years = years.select(
        DATASET,
        "year",
        "n",
        F.min("year").over(w).alias("lo"),
        F.max("year").over(w).alias("hi"),
        (F.count(F.lit(1)).over(w) > threshold).alias("bucketed"),
    ).withColumn("step", F.when(F.col("bucketed"), size).otherwise(1))
    at = (F.col("lo") + F.floor((F.col("year") - F.col("lo")) / F.col("step")) * F.col("step")).cast("int")
    counted = years.select(DATASET, "step", at.alias("first"), "n")
    empty = years.filter("bucketed AND year = lo").select(
        DATASET, "step", F.explode(F.sequence(F.col("lo"), F.col("hi"), F.col("step"))).alias("first"),
        F.lit(0).cast("long").alias("n"),
    )
    last = F.col("first") + F.col("step") - 1
    label = F.when(last > F.col("first"), F.concat_ws("-", "first", last)).otherwise(F.col("first").cast("string"))
    return (
        counted.unionByName(empty)
        .groupBy(DATASET, "step", "first")
        .agg(F.sum("n").alias("n"))
        .select(DATASET, "first", label.alias("label"), "n")
    )
