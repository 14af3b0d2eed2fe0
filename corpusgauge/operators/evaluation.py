"""Classification metrics.

The rows are read once, into confusion counts; every metric is arithmetic on
those counts. Their number is bounded by groups x classes squared, whatever the
number of rows, and the counting is partial before the shuffle, so a dominant
class costs nothing extra.

Averages over a fixed class list need no row for absent classes: a class
without rows adds nothing to the sum, which is divided by the list's length.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..datasets import DATASET
from ..functions.columns import count_if, lookup, missing_to_null, ratio
from ..functions.formatting import count_text, metric_text, percent_text

# 0.05 to 1.00 in steps of 0.05, as twentieths.
THRESHOLDS = tuple(i / 20 for i in range(1, 21))
VERDICT_BAND = 0.03
# More classes than this are not a classification report.
MAX_CLASSES = 20_000


# -- confusion counts ---------------------------------------------------------


def confusion(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = (DATASET,)) -> DataFrame:
    """``(by..., y_true, y_pred, n)``; labels are compared as text."""
    return (
        df.select(
            *by,
            F.col(y_true).cast("string").alias("y_true"),
            F.col(y_pred).cast("string").alias("y_pred"),
        )
        .groupBy(*by, "y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_matrix(cf: DataFrame, classes: Sequence[str], by: Sequence[str] = (DATASET,)) -> DataFrame:
    """Dense form on an ordered class list: one row per true class, one column
    per predicted class; pairs outside the list are left out."""
    inside = cf.filter(F.col("y_true").isin(*classes))
    wide = (
        inside.groupBy(*by, "y_true").pivot("y_pred", list(classes)).agg(F.sum("n")).na.fill(0)
    )
    pos = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y_true")).cast("int")
    return wide.withColumn("position", pos)


def class_names(cf: DataFrame, dataset: str | None = None) -> list[str]:
    """Sorted distinct true labels: the class list that shapes a report."""
    rows = cf if dataset is None else cf.filter(F.col(DATASET) == F.lit(dataset))
    got = rows.select("y_true").filter(F.col("y_true").isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(got) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return sorted(r["y_true"] for r in got)


def class_list_check(cf: DataFrame, names: Sequence[str]) -> DataFrame:
    """Whether each dataset has the class list of the first one."""
    lists = cf.groupBy(DATASET).agg(F.array_sort(F.collect_set("y_true")).alias("classes"))
    # one row per dataset
    first = F.max(F.when(F.col(DATASET) == F.lit(names[0]), F.col("classes"))).over(W.partitionBy(F.lit(0)))
    return lists.select(
        DATASET,
        F.size("classes").alias("n_classes"),
        F.array_join("classes", ",").alias("classes"),
        (F.col("classes") == first).alias("same_as_first"),
    )


# -- per class ----------------------------------------------------------------


def class_counts(cf: DataFrame, by: Sequence[str] = (DATASET,), missing: bool = False) -> DataFrame:
    """tp, predicted and support per class, for every label that occurs as a
    true or a predicted one. ``missing`` keeps the row of NULL labels, with
    which support sums to the number of rows."""
    sides = F.array(
        F.struct(
            F.col("y_true").alias("label"),
            F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
        ),
        F.struct(
            F.col("y_pred").alias("label"),
            F.lit(0).cast("long").alias("tp"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    cells = cf.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    if not missing:
        cells = cells.filter(F.col("label").isNotNull())
    return cells.groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support")
    )


def with_rates(counts: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """Precision, recall and F1 from the counts; ``empty`` on zero division."""
    return (
        counts.withColumn("precision", ratio(F.col("tp"), F.col("predicted"), empty))
        .withColumn("recall", ratio(F.col("tp"), F.col("support"), empty))
        .withColumn("f1", ratio(F.col("tp") * 2, F.col("predicted") + F.col("support"), empty))
    )


def _is_listed(labels: str | Sequence[str]) -> Column:
    """Whether a label is one a report averages over."""
    known = F.col("label").isNotNull()
    if labels == "true":
        return known & (F.col("support") > 0)
    if labels == "union":
        return known
    if isinstance(labels, str):
        raise ValueError("labels is 'true', 'union' or a list")
    return F.coalesce(F.col("label").isin(*labels), F.lit(False))


def _listed(counts: DataFrame, labels: str | Sequence[str]) -> DataFrame:
    return counts.filter(_is_listed(labels))


RATES = ("precision", "recall", "f1")


def _fill_labels(counts: DataFrame, by: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Zero rows for listed labels that do not occur."""
    groups = counts.select(*by).distinct()
    grid = groups.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    zero = F.lit(0).cast("long")
    return grid.join(counts, [*by, "label"], "left").select(
        *by, "label", *[F.coalesce(c, zero).alias(c) for c in ("tp", "predicted", "support")]
    )


def _averages(counts: DataFrame, by: Sequence[str], labels: str | Sequence[str]) -> DataFrame:
    """Overall numbers from the counts per class (NULL labels included)."""
    rates = with_rates(counts).withColumn("listed", _is_listed(labels))
    k = count_if(F.col("listed")) if isinstance(labels, str) else F.lit(len(set(labels))).cast("long")
    on = lambda c: F.sum(F.when(F.col("listed"), c))
    out = rates.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.sum("tp").alias("n_correct"),
        k.alias("n_classes"),
        on(F.col("support")).alias("listed_support"),
        *[on(F.col(m)).alias(f"s_{m}") for m in RATES],
        *[on(F.col(m) * F.col("support")).alias(f"w_{m}") for m in RATES],
    )
    return out.select(
        *by,
        "n",
        ratio(F.col("n_correct"), F.col("n")).alias("accuracy"),
        *[ratio(F.col(f"s_{m}"), F.col("n_classes")).alias(f"macro_{m}") for m in RATES],
        *[ratio(F.col(f"w_{m}"), F.col("listed_support"), 0.0).alias(f"weighted_{m}") for m in RATES],
        "n_classes",
        "listed_support",
    )


def overall_metrics(
    cf: DataFrame, by: Sequence[str] = (DATASET,), labels: str | Sequence[str] = "true"
) -> DataFrame:
    """n, accuracy, and macro and weighted precision, recall and F1. Averages
    run over the given labels (the true ones by default); zero division is 0.
    Predicted labels outside the list count as misses and add no class."""
    return _averages(class_counts(cf, by, missing=True), by, labels).drop("listed_support")


def classification_report(
    cf: DataFrame, by: Sequence[str] = (DATASET,), labels: str | Sequence[str] = "true"
) -> DataFrame:
    """Rows per class, then ``accuracy`` (the same number in all four columns),
    ``macro avg`` and ``weighted avg``."""
    by = list(by)
    counts = class_counts(cf, by, missing=True)
    if isinstance(labels, str):
        listed = _listed(counts, labels)
    else:
        listed = _fill_labels(counts, by, list(dict.fromkeys(labels)))
    per_class = with_rates(listed).select(
        *by,
        F.lit(0).alias("section"),
        "label",
        "precision",
        "recall",
        "f1",
        F.col("support").cast("double").alias("support"),
    )
    wide = _averages(counts, by, labels).withColumn(
        "total", F.coalesce(F.col("listed_support"), F.lit(0)).cast("double")
    )

    def line(pos: int, name: str, p: str, r: str, f: str, s: str) -> Column:
        return F.struct(
            F.lit(pos).alias("section"),
            F.lit(name).alias("label"),
            F.col(p).alias("precision"),
            F.col(r).alias("recall"),
            F.col(f).alias("f1"),
            F.col(s).alias("support"),
        )

    tail = wide.select(
        *by,
        F.explode(
            F.array(
                line(1, "accuracy", "accuracy", "accuracy", "accuracy", "accuracy"),
                line(2, "macro avg", "macro_precision", "macro_recall", "macro_f1", "total"),
                line(3, "weighted avg", "weighted_precision", "weighted_recall", "weighted_f1", "total"),
            )
        ).alias("x"),
    ).select(*by, "x.*")
    return per_class.unionByName(tail)


def report_side_by_side(
    left: DataFrame, right: DataFrame, suffixes: tuple[str, str], digits: int = 3
) -> DataFrame:
    """Two reports joined on class; a class one side lacks is filled with 0."""
    metrics = ["precision", "recall", "f1", "support"]
    a = left.select("label", *[F.col(m).alias(f"{m}_{suffixes[0]}") for m in metrics])
    b = right.select("label", *[F.col(m).alias(f"{m}_{suffixes[1]}") for m in metrics])
    return a.join(b, "label", "full_outer").select(
        "label",
        *[
            F.round(F.coalesce(f"{m}_{s}", F.lit(0.0)), digits).alias(f"{m}_{s}")
            for s in suffixes
            for m in metrics
        ],
    )


def class_accuracy(cf: DataFrame, by: Sequence[str] = (DATASET,)) -> DataFrame:
    """(TP + TN) / N per class."""
    counts = class_counts(cf, by, missing=True)
    # as many rows per window as there are classes
    counts = counts.withColumn("n", F.sum("support").over(W.partitionBy(*by)))
    wrong = F.col("predicted") + F.col("support") - F.col("tp") * 2
    return _listed(counts, "true").withColumn("accuracy", ratio(F.col("n") - wrong, F.col("n")))


def micro_average(cf: DataFrame, by: Sequence[str] = (DATASET,), labels="true") -> DataFrame:
    """Precision, recall and F1 of the summed counts."""
    sums = (
        _listed(class_counts(cf, by), labels)
        .groupBy(*by)
        .agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))
    )
    return with_rates(sums)


# -- groups, dates, thresholds ------------------------------------------------


def group_metrics(cf: DataFrame, group: str, groups: DataFrame | None = None) -> DataFrame:
    """Metrics per dataset and group. Macro averages need two rows and two true
    classes, and then run over all classes of the dataset. ``groups``
    (dataset, group) adds the groups without rows, with n = 0."""
    by = [DATASET, group]
    counts = class_counts(cf, by, missing=True)
    rates = _mark_classes(with_rates(counts), F.col("support"), group)
    out = _group_averages(rates, by, min_rows=2)
    if groups is not None:
        out = groups.join(out, by, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out


def _mark_classes(rates: DataFrame, support: Column, group: str) -> DataFrame:
    """Mark the labels that are the dataset's classes (``known``: any of its
    rows has the label as the truth) and count them (``k``). Works on counts, a
    row per group and label."""
    per_label = W.partitionBy(DATASET, "label")
    marked = rates.withColumn(
        "known", F.col("label").isNotNull() & (F.sum(support).over(per_label) > 0)
    ).withColumn("first", F.row_number().over(per_label.orderBy(group)) == 1)
    one = F.when(F.col("known") & F.col("first"), 1).otherwise(0)
    return marked.withColumn("k", F.sum(one).over(W.partitionBy(DATASET)))


def _group_averages(rates: DataFrame, by: Sequence[str], min_rows: int) -> DataFrame:
    """n, accuracy and macro averages over ``k`` classes from rates per label
    marked ``known``; NULL averages below two true classes."""
    here = count_if(F.col("label").isNotNull() & (F.col("support") > 0))
    sums = rates.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.sum("tp").alias("n_correct"),
        here.alias("k_here"),
        F.max("k").alias("k"),
        *[F.sum(F.when(F.col("known"), F.col(m))).alias(f"s_{m}") for m in RATES],
    )
    enough = (F.col("n") >= min_rows) & (F.col("k_here") >= 2)
    return sums.select(
        *by,
        "n",
        ratio(F.col("n_correct"), F.col("n")).alias("accuracy"),
        *[
            F.when(enough, ratio(F.coalesce(f"s_{m}", F.lit(0.0)), F.col("k"))).alias(f"macro_{m}")
            for m in RATES
        ],
    )


def year_group(
    year: Column, start: int, end: int, size: int = 1, keep_tail: bool = True
) -> tuple[Column, list[str]]:
    """Year-bucket label of a row, and all labels. With ``keep_tail`` the last
    bucket is cut short at ``end``; without it the years that do not fill a
    bucket get no label, as bins on a fixed step leave them out."""
    buckets = []
    y = start
    while y <= end:
        last = y + size - 1
        if last > end:
            if not keep_tail:
                break
            last = end
        buckets.append((y, last, f"{y}" if size == 1 else f"{y}-{last}"))
        y += size
    if not buckets:
        buckets = [(start, end, f"{start}-{end}")]
    out = None
    for lo, hi, label in buckets:
        cond = year.between(lo, hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out, [b[2] for b in buckets]


def metrics_by_year(
    df: DataFrame,
    y_true: str,
    y_pred: str,
    date: str,
    start: int | None = None,
    end: int | None = None,
    size: int = 1,
    keep_tail: bool = True,
) -> DataFrame:
    """Metrics per year bucket of each dataset, empty buckets included."""
    size = size if isinstance(size, int) and size >= 1 else 1
    year = F.year(F.col(f"`{date}`"))
    span = {
        r[DATASET]: (
            start if start is not None else r["lo"],
            end if end is not None else r["hi"],
        )
        for r in df.groupBy(DATASET).agg(F.min(year).alias("lo"), F.max(year).alias("hi")).collect()
        if r["lo"] is not None
    }
    spark = df.sparkSession
    labels: dict[str, Column] = {}
    rows: list[tuple[str, str]] = []
    for name, (lo, hi) in span.items():
        labels[name], all_labels = year_group(year, lo, hi, size, keep_tail)
        rows += [(name, x) for x in all_labels]
    groups = spark.createDataFrame(rows, f"{DATASET} string, group string")
    tagged = df.withColumn("group", lookup(DATASET, labels).cast("string"))
    cf = confusion(tagged, y_true, y_pred, [DATASET, "group"])
    return group_metrics(cf, "group", groups)


def metrics_by_bins(
    df: DataFrame, y_true: str, y_pred: str, column: str, edges: dict[str, list[float]]
) -> DataFrame:
    """Metrics per bin of a continuous column; ``edges`` per dataset as made by
    ``quantile_edges``."""
    from .distributions import right_closed_bin

    x = missing_to_null(F.col(f"`{column}`").cast("double"))
    at = lookup(DATASET, {n: right_closed_bin(x, e) for n, e in edges.items()})
    spark = df.sparkSession
    rows = [(n, i, float(e[i]), float(e[i + 1])) for n, e in edges.items() for i in range(len(e) - 1)]
    groups = spark.createDataFrame(rows, f"{DATASET} string, bin int, lo double, hi double")
    cf = confusion(df.withColumn("bin", at.cast("int")), y_true, y_pred, [DATASET, "bin"])
    return group_metrics(cf, "bin", groups)


def threshold_curve(
    df: DataFrame,
    y_true: str,
    y_pred: str,
    confidence: str,
    thresholds: Sequence[float] = THRESHOLDS,
) -> DataFrame:
    """Coverage and metrics of the rows at or above each confidence threshold.

    Each row is put into the highest threshold it passes and counted once; the
    thresholds below are reached by spreading the *counts*, never the rows. A
    missing confidence is never covered. Macro averages run over all classes of
    the dataset and are NULL where a single true class is left."""
    thr = sorted(float(t) for t in thresholds)
    conf = F.coalesce(missing_to_null(F.col(f"`{confidence}`").cast("double")), F.lit(-1.0))
    passed = None
    for t in thr:
        hit = F.when(conf >= t, 1).otherwise(0)
        passed = hit if passed is None else passed + hit
    cf = confusion(df.withColumn("passed", passed), y_true, y_pred, [DATASET, "passed"])
    # Level 0 holds all rows. Every count is present at every level, as 0 where
    # its rows do not pass, so that uncovered thresholds keep their row.
    by = [DATASET, "level"]
    spread = (
        cf.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(thr)))))
        .withColumn("n", F.when(F.col("level") <= F.col("passed"), F.col("n")).otherwise(0))
        .groupBy(*by, "y_true", "y_pred")
        .agg(F.sum("n").alias("n"))
    )
    counts = class_counts(spread, by, missing=True)
    everything = F.when(F.col("level") == 0, F.col("support")).otherwise(0)
    rates = _mark_classes(with_rates(counts), everything, "level")
    out = _group_averages(rates, by, min_rows=1)
    total = F.max("n").over(W.partitionBy(DATASET))
    value = F.array(*[F.lit(t) for t in thr])
    return (
        out.withColumn("coverage", ratio(F.col("n"), total, 0.0))
        .filter("level > 0")
        .select(
            DATASET,
            value[F.col("level") - 1].alias("threshold"),
            "coverage",
            F.col("n").alias("n_covered"),
            "accuracy",
            *[f"macro_{m}" for m in RATES],
        )
    )


def threshold_table(curve: DataFrame) -> DataFrame:
    """The curve as formatted text columns."""
    return curve.select(
        DATASET,
        metric_text("threshold", 2).alias("threshold"),
        metric_text("accuracy").alias("accuracy"),
        metric_text("macro_precision").alias("macro_precision"),
        percent_text("coverage").alias("coverage"),
        count_text("n_covered").alias("n_covered"),
    )


def group_table(metrics: DataFrame, group: str) -> DataFrame:
    """Group metrics as formatted text columns."""
    return metrics.select(
        DATASET,
        F.coalesce(F.col(group).cast("string"), F.lit("NaN/Missing")).alias("group"),
        count_text("n").alias("samples"),
        metric_text("accuracy").alias("accuracy"),
        metric_text("macro_precision").alias("macro_precision"),
    )


def confidence_flags(df: DataFrame, confidence: str) -> DataFrame:
    """Whether any confidence lies outside [0, 1] or is missing."""
    c = missing_to_null(F.col(f"`{confidence}`").cast("double"))
    return df.groupBy(DATASET).agg(
        F.count(F.lit(1)).alias("n"),
        count_if((c < 0) | (c > 1)).alias("n_outside"),
        count_if(c.isNull()).alias("n_missing"),
    ).select(
        "*",
        (F.col("n_outside") > 0).alias("any_outside"),
        (F.col("n_missing") > 0).alias("any_missing"),
    )


def reliability_curve(df: DataFrame, y_true: str, y_pred: str, confidence: str, bins: int = 10) -> DataFrame:
    """Mean confidence against share correct in uniform right-closed bins;
    empty bins and missing confidences are left out."""
    c = missing_to_null(F.col(f"`{confidence}`").cast("double"))
    bin_of = None
    for i in range(1, bins):
        hit = F.when(c > i / bins, 1).otherwise(0)
        bin_of = hit if bin_of is None else bin_of + hit
    right = F.when(F.col(y_true).cast("string") == F.col(y_pred).cast("string"), 1.0).otherwise(0.0)
    return (
        df.filter(c.isNotNull())
        .groupBy(DATASET, bin_of.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_confidence"), F.avg(right).alias("share_correct"))
    )


# -- comparison, sampling error, weights --------------------------------------


def compare_datasets(overall: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Metric by metric difference (second - first) of dataset pairs, with a
    verdict on macro precision; a repeated pair, also reversed, is taken once. A pair
    that names an absent dataset keeps its rows, with the verdict ``absent``."""
    seen: dict[frozenset, tuple[str, str]] = {}
    for a, b in pairs:
        seen.setdefault(frozenset((a, b)), (a, b))
    spark = overall.sparkSession
    metrics = ["accuracy", "macro_precision", "macro_recall", "macro_f1"]
    wanted = spark.createDataFrame(
        [(x, y, m) for x, y in seen.values() for m in metrics], "first string, second string, metric string"
    )
    cells = overall.select(
        DATASET,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
        ).alias("x"),
    ).select(DATASET, "x.*")
    here = F.lit(True)
    a = cells.select(F.col(DATASET).alias("first"), "metric", F.col("value").alias("value_first"), here.alias("__a"))
    b = cells.select(F.col(DATASET).alias("second"), "metric", F.col("value").alias("value_second"), here.alias("__b"))
    out = wanted.join(a, ["first", "metric"], "left").join(b, ["second", "metric"], "left").withColumn(
        "change", F.col("value_second") - F.col("value_first")
    )
    kpi = F.coalesce(
        F.max(F.when(F.col("metric") == "macro_precision", F.col("change"))).over(
            W.partitionBy("first", "second")
        ),
        F.lit(0.0),
    )
    verdict = (
        F.when(F.col("__a").isNull() | F.col("__b").isNull(), "absent")
        .when(kpi < -VERDICT_BAND, "degraded").when(kpi > VERDICT_BAND, "higher").otherwise("similar")
    )
    return out.select("first", "second", "metric", "value_first", "value_second", "change", verdict.alias("verdict"))


def sampling_error(
    cf: DataFrame,
    by: Sequence[str] = (DATASET,),
    confidence: float = 0.95,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Recall and precision per class with standard error, sampling error
    ``z * SE`` and the limits of precision (not clipped). Excluded classes get
    no row but still count as errors of the others."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    c = class_counts(cf, by)
    if exclude:
        c = c.filter(~F.col("label").isin(*exclude))
    c = (
        c.withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall_se", _standard_error("recall", "support"))
        .withColumn("precision_se", _standard_error("precision", "predicted"))
    )
    return c.select(
        *by,
        "label",
        "recall",
        "recall_se",
        (F.col("recall_se") * z).alias("recall_error"),
        F.col("support").alias("recall_n"),
        "precision",
        "precision_se",
        (F.col("precision_se") * z).alias("precision_error"),
        F.col("predicted").alias("precision_n"),
        (F.col("precision") - F.col("precision_se") * z).alias("precision_low"),
        (F.col("precision") + F.col("precision_se") * z).alias("precision_high"),
    )


def _standard_error(p: str, n: str) -> Column:
    return F.sqrt(ratio(F.col(p) * (1 - F.col(p)), F.col(n)))


def merge_small_classes(
    errors: DataFrame,
    by: Sequence[str] = (DATASET,),
    min_n: int = 30,
    confidence: float = 0.95,
    name: str = "others",
) -> DataFrame:
    """Classes with fewer than ``min_n`` true or predicted rows become one row:
    plain means of rates and standard errors, sums of n."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    large = (F.col("recall_n") >= min_n) & (F.col("precision_n") >= min_n)
    mean_cols = ["recall", "recall_se", "precision", "precision_se"]
    small = (
        errors.filter(~large)
        .groupBy(*by)
        .agg(
            *[F.avg(c).alias(c) for c in mean_cols],
            F.sum("recall_n").alias("recall_n"),
            F.sum("precision_n").alias("precision_n"),
        )
        .select(
            *by,
            F.lit(name).alias("label"),
            "recall",
            "recall_se",
            (F.col("recall_se") * z).alias("recall_error"),
            "recall_n",
            "precision",
            "precision_se",
            (F.col("precision_se") * z).alias("precision_error"),
            "precision_n",
            (F.col("precision") - F.col("precision_se") * z).alias("precision_low"),
            (F.col("precision") + F.col("precision_se") * z).alias("precision_high"),
        )
    )
    return errors.filter(large).unionByName(small).withColumn("count", F.col("recall_n"))


def population_weighted(
    cf: DataFrame, shares: DataFrame, by: Sequence[str] = (DATASET,), label: str = "label", share: str = "share"
) -> DataFrame:
    """Per-class rates averaged with the population's class shares instead of
    the sample's. ``share_sum`` and ``missing_classes`` tell whether the shares
    cover the classes."""
    rates = with_rates(_listed(class_counts(cf, by), "true"))
    w = shares.select(F.col(label).cast("string").alias("label"), F.col(share).cast("double").alias("share"))
    joined = rates.join(w, "label", "left")
    return joined.groupBy(*by).agg(
        F.sum(F.col("share") * F.col("recall")).alias("weighted_accuracy"),
        F.sum(F.col("share") * F.col("precision")).alias("weighted_precision"),
        F.sum(F.col("share") * F.col("f1")).alias("weighted_f1"),
        F.sum("share").alias("share_sum"),
        count_if(F.col("share").isNull()).alias("missing_classes"),
    )


def class_sample_weights(
    cf: DataFrame, shares: DataFrame, by: Sequence[str] = (DATASET,), label: str = "label", share: str = "share"
) -> DataFrame:
    """Weight of a row of each class: population share over observed share. A class
    without a share stays, without a weight."""
    support = cf.groupBy(*by, F.col("y_true").alias("label")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("correct"),
    )
    support = support.withColumn("total", F.sum("support").over(W.partitionBy(*by)))
    w = shares.select(F.col(label).cast("string").alias("label"), F.col(share).cast("double").alias("share"))
    return support.join(w, "label", "left").withColumn(
        "weight", ratio(F.col("share") * F.col("total"), F.col("support"))
    )


def reweighted_accuracy(weights: DataFrame, by: Sequence[str] = (DATASET,)) -> DataFrame:
    """Accuracy of the weighted rows; ``missing_classes`` counts the classes that
    have rows but no weight, which it does not speak for."""
    return weights.groupBy(*by).agg(
        F.sum(F.col("weight") * F.col("correct")).alias("a"),
        F.sum(F.col("weight") * F.col("support")).alias("b"),
        count_if(F.col("weight").isNull()).alias("missing_classes"),
    ).select(*by, ratio(F.col("a"), F.col("b")).alias("weighted_accuracy"), "missing_classes")


def lift_over_chance(overall: DataFrame) -> DataFrame:
    """Macro precision as a multiple of a uniform guess."""
    chance = ratio(F.lit(1.0), F.col("n_classes"))
    return overall.select(
        DATASET,
        "n_classes",
        chance.alias("chance"),
        "macro_precision",
        ratio(F.col("macro_precision"), chance).alias("lift"),
    )


def other_class_share(confidence: Column, n_classes: int) -> Column:
    """Mean share left for each of the other classes."""
    return ratio(1 - confidence, F.lit(n_classes - 1))


# -- scores used for label programs -------------------------------------------


def macro_precision_score(cf: DataFrame, classes: Sequence[str], by: Sequence[str] = (DATASET,)) -> DataFrame:
    """Macro precision over a fixed class list; a single row scores 1 or 0."""
    m = overall_metrics(cf, by, list(classes))
    score = F.when(F.col("n") == 1, F.col("accuracy")).otherwise(F.coalesce("macro_precision", F.lit(0.0)))
    return m.select(*by, "n", score.alias("score"))


def exact_match_score(
    df: DataFrame, y_true: str, y_pred: str, classes: Sequence[str], by: Sequence[str] = (DATASET,)
) -> DataFrame:
    """Share of rows whose prediction is a listed class and equals the truth."""
    right = F.col(y_pred).isin(*classes) & (F.col(y_pred) == F.col(y_true))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(right, 1.0).otherwise(0.0)).alias("score")
    )


def confidence_gate(df: DataFrame, y_true: str, y_pred: str, confidence: str, threshold: float = 0.5) -> DataFrame:
    """Coverage and precision of the rows a confidence gate accepts and of
    those it sends to review."""
    routed = df.withColumn("route", gate_route(F.col(f"`{confidence}`"), threshold))
    right = F.when(F.col(y_true).cast("string") == F.col(y_pred).cast("string"), 1.0).otherwise(0.0)
    out = routed.groupBy(DATASET, "route").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("precision"))
    total = F.sum("n").over(W.partitionBy(DATASET))
    return out.withColumn("coverage", ratio(F.col("n"), total))


def gate_route(confidence: Column, threshold: float = 0.5) -> Column:
    c = missing_to_null(confidence.cast("double"))
    return F.when(c >= threshold, "accept").otherwise("review")
