"""Exact quantiles that no single task has to hold.

Spark's ``percentile`` keeps all distinct values of a group in one buffer, so
``exact_quantiles`` uses it only after a count has shown that no group is
larger than ``SMALL_GROUP``. Beyond that it works in two passes: a mergeable
sketch brackets every wanted rank from both sides, then only the values inside
the brackets are counted exactly. A bracket holds about 4 values in 10,000 of
its group, equal values being one row, and is ranked in a thousand parts;
everything under it is a plain count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import all_of, count_if, missing_to_null
from ..session import bounded_rows

QUARTILES = (0.25, 0.5, 0.75)
ACCURACY = 10_000
# Rows a group may have for the one-buffer aggregate.
SMALL_GROUP = 1_000_000
# Even parts of a bracket whose values are ranked apart.
SUB_RANGES = 1024
# Largest number of bracket rows sent to every executor.
BROADCAST_GROUPS = 20_000


def percentile_row(c: Column, probs: Sequence[float] = QUARTILES) -> Column:
    """Linear-interpolation percentiles of a column with few distinct values."""
    return F.percentile(c, F.array(*[F.lit(float(p)) for p in probs]))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    probs: Sequence[float] = QUARTILES,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Rows ``(keys..., column, prob, quantile)`` with linear interpolation
    between neighbours at rank ``(n - 1) * prob``; missing values are left out.
    """
    keys = list(keys)
    tags = [f"v{i}" for i in range(len(values))]
    src = df.select(
        *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)],
        *[missing_to_null(F.col(f"`{v}`").cast("double")).alias(t) for v, t in zip(values, tags)],
    )
    ks = [f"k{i}" for i in range(len(keys))]

    largest = src.groupBy(*ks).count().agg(F.max("count").alias("n")).head()["n"] or 0
    if largest <= small_group:
        return _one_buffer(src, keys, ks, values, tags, probs)

    slack = 2.0 / ACCURACY
    lows = [max(0.0, p - slack) for p in probs]
    highs = [min(1.0, p + slack) for p in probs]
    grid = F.array(*[F.lit(float(p)) for p in lows + highs])
    m = len(probs)
    sketch = src.groupBy(*ks).agg(
        *[F.count(t).alias(f"{t}_n") for t in tags],
        *[F.percentile_approx(t, grid, F.lit(ACCURACY)).alias(f"{t}_q") for t in tags],
    )
    # one bracket per (column, probability), in a fixed order
    pairs = [(j, i) for j in range(len(tags)) for i in range(m)]
    groups = sketch.select(
        *ks,
        F.array(
            *[
                F.struct(
                    F.col(f"{tags[j]}_n").alias("n"),
                    F.col(f"{tags[j]}_q")[i].alias("lo"),
                    F.col(f"{tags[j]}_q")[m + i].alias("hi"),
                )
                for j, i in pairs
            ]
        ).alias("brackets"),
    )
    rows = bounded_rows(groups, BROADCAST_GROUPS)
    if rows is not None:
        groups = F.broadcast(df.sparkSession.createDataFrame(rows, groups.schema))
    if ks:
        # a missing key is a group like any other
        right = groups.select(*[F.col(k).alias(f"g_{k}") for k in ks], "brackets")
        joined = src.join(right, all_of([src[k].eqNullSafe(right[f"g_{k}"]) for k in ks]))
    else:
        joined = src.withColumn("brackets", _literal_brackets(rows[0]["brackets"]))

    def bracket(j: int, i: int) -> Column:
        return F.col("brackets")[j * m + i]

    # Values under a bracket are only counted; values inside are kept.
    below = joined.groupBy(*ks).agg(
        *[count_if(F.col(tags[j]) < bracket(j, i)["lo"]).alias(f"b_{j}_{i}") for j, i in pairs]
    )
    below = below.select(
        *ks,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(j).alias("col"), F.lit(i).alias("prob"), F.col(f"b_{j}_{i}").alias("below")
                    )
                    for j, i in pairs
                ]
            )
        ).alias("b"),
    ).select(*ks, "b.*")

    hits = F.array(
        *[
            F.when(
                F.col(tags[j]).between(bracket(j, i)["lo"], bracket(j, i)["hi"]),
                F.struct(
                    F.lit(j).alias("col"),
                    F.lit(i).alias("prob"),
                    bracket(j, i)["n"].alias("n"),
                    F.col(tags[j]).alias("value"),
                    _sub_range(F.col(tags[j]), bracket(j, i)["lo"], bracket(j, i)["hi"]).alias("sub"),
                ),
            )
            for j, i in pairs
        ]
    )
    inside = (
        joined.select(*ks, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("t"))
        .select(*ks, "t.*")
        .groupBy(*ks, "col", "prob", "n", "sub", "value")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # running counts inside a sub-range, shifted by the sub-ranges before it: no task
    # ranks the values of a whole bracket
    place = [*ks, "col", "prob", "sub"]
    before = W.partitionBy(*ks, "col", "prob").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    ranges = inside.groupBy(*place).agg(F.sum("c").alias("s"))
    ranges = ranges.select(
        *[F.col(c).alias(f"r_{c}") for c in place], F.coalesce(F.sum("s").over(before), F.lit(0)).alias("shift")
    )
    upto = F.sum("c").over(W.partitionBy(*place).orderBy("value")) + F.col("shift")
    ranked = inside.join(ranges, all_of([F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in place])).withColumn("upto", upto)

    probe = F.array(*[F.lit(float(p)) for p in probs])
    l, r = ranked.alias("l"), below.alias("r")
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*ks, "col", "prob"]]
    h = (F.col("n") - 1) * probe[F.col("prob")]
    full = l.join(r, all_of(cond)).select(
        *[F.col(f"l.{k}").alias(k) for k in [*ks, "col", "prob", "n", "value", "c", "upto"]], "r.below"
    )
    full = full.withColumn("last", F.col("below") + F.col("upto") - 1).withColumn(
        "first", F.col("last") - F.col("c") + 1
    )
    lo_rank, hi_rank = F.floor(h), F.ceil(h)
    out = full.groupBy(*ks, "col", "prob", "n").agg(
        F.max(F.when((F.col("first") <= lo_rank) & (F.col("last") >= lo_rank), F.col("value"))).alias("a"),
        F.max(F.when((F.col("first") <= hi_rank) & (F.col("last") >= hi_rank), F.col("value"))).alias("b"),
    )
    # a bracket that missed its rank must never pass as "no value"
    found = F.when(
        F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("quantile bracket missed its rank"))
    )
    out = out.withColumn("a", F.coalesce(found.cast("double"), F.col("a")))
    names = F.array(*[F.lit(v) for v in values])
    return out.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)],
        names[F.col("col")].alias("column"),
        probe[F.col("prob")].alias("prob"),
        (F.col("a") + (F.col("b") - F.col("a")) * (h - F.floor(h))).alias("quantile"),
    )


def _sub_range(value: Column, lo: Column, hi: Column) -> Column:
    """Which of ``SUB_RANGES`` even parts of a bracket a value lies in."""
    part = F.floor((value - lo) / F.nullif(hi - lo, F.lit(0.0)) * SUB_RANGES)
    return F.coalesce(F.least(part, F.lit(SUB_RANGES - 1)), F.lit(0)).cast("int")


def _one_buffer(src, keys, ks, values, tags, probs) -> DataFrame:
    grid = F.array(*[F.lit(float(p)) for p in probs])
    rows = src.groupBy(*ks).agg(
        F.array(
            *[
                F.struct(F.lit(v).alias("column"), F.percentile(t, grid).alias("qs"))
                for v, t in zip(values, tags)
            ]
        ).alias("cols")
    )
    cells = rows.select(*ks, F.explode("cols").alias("c")).select(
        *ks, "c.column", F.posexplode("c.qs").alias("i", "quantile")
    )
    return cells.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)],
        "column",
        grid[F.col("i")].alias("prob"),
        "quantile",
    )


def _literal_brackets(brackets) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(t["n"]).cast("long").alias("n"),
                F.lit(t["lo"]).cast("double").alias("lo"),
                F.lit(t["hi"]).cast("double").alias("hi"),
            )
            for t in brackets
        ]
    )


def quantile_columns(q: DataFrame, keys: Sequence[str], names: dict[float, str]) -> DataFrame:
    """One column per probability from the long form of :func:`exact_quantiles`."""
    return q.groupBy(*keys, "column").agg(
        *[
            F.max(F.when(F.abs(F.col("prob") - p) < 1e-12, F.col("quantile"))).alias(n)
            for p, n in names.items()
        ]
    )

