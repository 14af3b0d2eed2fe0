"""Data-quality checks on named datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..datasets import DATASET, DatasetSet, kind_of
from ..functions.columns import count_if, digest, ratio, row_digest
from ..functions.formatting import bytes_text
from .common import attach_groups, broadcast_if_small, top_per
from .quantiles import exact_quantiles, quantile_columns

HIGH_CARDINALITY = 50
TEXT_SHOWN = 100


def shapes(ds: DatasetSet) -> DataFrame:
    """Rows and declared columns of every dataset, empty ones included."""
    spark = ds.frames[ds.names[0]].sparkSession
    declared = spark.createDataFrame(
        [(n, len(ds.columns(n))) for n in ds.names], f"{DATASET} string, n_columns int"
    )
    rows = ds.long().groupBy(DATASET).agg(F.count(F.lit(1)).alias("n_rows"))
    return declared.join(rows, DATASET, "left").select(
        DATASET, F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "n_columns"
    )


def column_types(ds: DatasetSet) -> DataFrame:
    """Declared columns with position and type; schema only, no job."""
    spark = ds.frames[ds.names[0]].sparkSession
    rows = [
        (n, i, f.name, f.dataType.simpleString(), kind_of(f.dataType))
        for n in ds.names
        for i, f in enumerate(ds.frames[n].schema.fields)
    ]
    return spark.createDataFrame(
        rows, f"{DATASET} string, position int, column string, type string, kind string"
    )


def null_profile(ds: DatasetSet) -> DataFrame:
    """Null count and percentage of every declared column, in one scan."""
    cols = ds.all_columns()
    agg = (
        ds.long()
        .groupBy(DATASET)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)],
        )
    )
    cells = agg.select(
        DATASET,
        "n_rows",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), (F.col("n_rows") - F.col(f"c{i}")).alias("n_null"))
                    for i, c in enumerate(cols)
                ]
            )
        ).alias("x"),
    ).select(DATASET, "x.column", "n_rows", "x.n_null")
    undeclared = [
        (F.col(DATASET) == F.lit(n)) & F.col("column").isin(*absent)
        for n in ds.names
        if (absent := [c for c in cols if c not in ds.columns(n)])
    ]
    for cond in undeclared:
        cells = cells.filter(~cond)
    return cells.withColumn("pct_null", F.round(ratio(F.col("n_null") * 100, F.col("n_rows")), 2)).withColumn(
        "all_null", (F.col("n_rows") > 0) & (F.col("n_null") == F.col("n_rows"))
    )


def missing_values(ds: DatasetSet) -> DataFrame:
    """Columns that do have nulls, worst first."""
    return (
        null_profile(ds)
        .filter("n_null > 0")
        .orderBy(DATASET, F.desc("n_null"), "column")
    )


def all_null_columns(ds: DatasetSet) -> DataFrame:
    return null_profile(ds).filter("all_null").select(DATASET, "column", "n_rows")


def usable_columns(ds: DatasetSet) -> DataFrame:
    """The rule by which columns are left out of a report: one row per dataset
    and column of the family with ``status`` and ``reason``."""
    spark = ds.frames[ds.names[0]].sparkSession
    wanted = spark.createDataFrame(
        [(n, c, c in ds.columns(n)) for n in ds.names for c in ds.all_columns()],
        f"{DATASET} string, column string, declared boolean",
    )
    seen = null_profile(ds).select(DATASET, "column", "all_null")
    out = wanted.join(seen, [DATASET, "column"], "left")
    reason = F.when(~F.col("declared"), "column absent").when(F.col("all_null"), "all values missing")
    return out.select(
        DATASET,
        "column",
        F.when(reason.isNull(), "used").otherwise("skipped").alias("status"),
        reason.alias("reason"),
    )


def _duplicate_share(counted: DataFrame) -> DataFrame:
    """Second level of a two-level distinct count."""
    return (
        counted.groupBy(DATASET)
        .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"))
        .select(
            DATASET,
            "n_rows",
            (F.col("n_rows") - F.col("n_unique")).alias("n_duplicates"),
            F.round(ratio((F.col("n_rows") - F.col("n_unique")) * 100, F.col("n_rows"), 0.0), 2).alias(
                "pct_duplicates"
            ),
            "n_unique",
        )
    )


def row_duplicates(ds: DatasetSet) -> DataFrame:
    """Full-row duplicates. Rows are compared by digest, so the shuffle moves
    digests, not texts, and equal rows are merged before it."""
    df = ds.long()
    key = row_digest(df, [c for c in df.columns if c != DATASET])
    counted = df.select(DATASET, key.alias("k")).groupBy(DATASET, "k").agg(F.count(F.lit(1)).alias("n"))
    return _duplicate_share(counted)


def text_duplicates(ds: DatasetSet, text: str) -> DataFrame:
    """Duplicates of the non-null text whatever its case."""
    df = ds.long([text]).filter(F.col(text).isNotNull())
    counted = (
        df.select(DATASET, digest(F.lower(text)).alias("k"))
        .groupBy(DATASET, "k")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _duplicate_share(counted)


def label_conflicts(ds: DatasetSet, text: str, label: str, datasets=("train", "test")) -> DataFrame:
    """Texts seen more than once, with their labels; ``conflict`` marks those
    with more than one label. Only the first characters of a text are shown;
    whole texts are compared."""
    part = ds.only([n for n in datasets if n in ds.members_with(text, label)])
    df = part.long([text, label]).filter(F.col(text).isNotNull())
    low = F.lower(text)
    return (
        df.select(
            DATASET,
            digest(low).alias("text_key"),
            F.substring(low, 1, TEXT_SHOWN).alias("shown"),
            F.col(label).cast("string").alias("label"),
        )
        .groupBy(DATASET, "text_key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("shown").alias("shown"),
            F.array_sort(F.collect_set("label")).alias("labels"),
        )
        .filter("n > 1")
        .withColumn("conflict", F.size("labels") > 1)
    )


def conflict_summary(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy(DATASET).agg(
        F.count(F.lit(1)).alias("n_repeated_texts"), count_if(F.col("conflict")).alias("n_conflicts")
    )


def conflict_examples(conflicts: DataFrame, n_examples: int = 5) -> DataFrame:
    """First conflicting texts of each dataset in text order."""
    return top_per(
        conflicts.filter("conflict"), [DATASET], n_examples, F.col("shown"), F.col("text_key")
    ).select(DATASET, "rank", "shown", F.array_join("labels", ", ").alias("labels"))


def drop_conflicting_texts(df: DataFrame, text: str, label: str) -> DataFrame:
    """Drop every row whose text (case kept) occurs with more than one label.

    Whether a text is in conflict is decided on digests, pre-aggregated before
    the shuffle; the rows then meet the conflicting digests only.
    """
    keyed = df.withColumn("__k", digest(text))
    bad = (
        keyed.filter(F.col("__k").isNotNull())
        .groupBy("__k")
        .agg(
            F.min(F.col(label).cast("string")).alias("lo"), F.max(F.col(label).cast("string")).alias("hi")
        )
        .filter("lo <> hi")
        .select("__k")
    )
    return keyed.join(broadcast_if_small(bad), "__k", "left_anti").drop("__k")


def zero_variance_columns(ds: DatasetSet) -> DataFrame:
    """Numeric and text columns with exactly one distinct non-null value. Texts are
    told apart by a hash, so that no row is sorted with them; the few values found
    are looked up afterwards."""
    df = ds.long()
    fields = [f for f in df.schema.fields if f.name != DATASET]
    texts = {f.name for f in fields if isinstance(f.dataType, T.StringType)}
    cols = [f.name for f in fields if f.name in texts or isinstance(f.dataType, T.NumericType)]
    code = {c: F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(f"`{c}`")) if c in texts else F.col(f"`{c}`") for c in cols}
    facts = df.groupBy(DATASET).agg(
        *[(F.min(code[c]) == F.max(code[c])).alias(f"c{i}") for i, c in enumerate(cols)],
        *[F.min(code[c]).cast("string").alias(f"v{i}") for i, c in enumerate(cols)],
    )
    rows = []
    for r in facts.collect():  # a row per dataset
        for i, c in enumerate(cols):
            if r[f"c{i}"]:
                value = r[f"v{i}"]
                if c in texts:
                    here = (F.col(DATASET) == F.lit(r[DATASET])) & F.col(f"`{c}`").isNotNull()
                    value = df.filter(here).select(f"`{c}`").first()[0]
                rows.append((r[DATASET], c, value))
    return df.sparkSession.createDataFrame(rows, f"{DATASET} string, column string, value string")


def _text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
        and f.name != DATASET
        and (columns is None or f.name in columns)
    ]


def value_digest_counts(ds: DatasetSet, columns: Sequence[str] | None = None) -> DataFrame:
    """Occurrences of every distinct non-null value of the text columns, the
    value being represented by its digest."""
    df = ds.long(columns)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), digest(F.col(f"`{c}`")).alias("k"))
            for c in _text_columns(df, columns)
        ]
    )
    return (
        df.select(DATASET, F.explode(cells).alias("x"))
        .select(DATASET, "x.*")
        .filter(F.col("k").isNotNull())
        .groupBy(DATASET, "column", "k")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def high_cardinality(
    ds: DatasetSet, threshold: int = HIGH_CARDINALITY, columns=None, approximate: bool = False
) -> DataFrame:
    """Text columns with more distinct values than ``threshold``."""
    if approximate:
        df = ds.long(columns)
        cols = _text_columns(df, columns)
        agg = df.groupBy(DATASET).agg(
            *[F.approx_count_distinct(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]
        )
        cells = F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_distinct"))
                for i, c in enumerate(cols)
            ]
        )
        out = agg.select(DATASET, F.explode(cells).alias("x")).select(DATASET, "x.*")
    else:
        out = (
            value_digest_counts(ds, columns)
            .groupBy(DATASET, "column")
            .agg(F.count(F.lit(1)).alias("n_distinct"))
        )
    return out.filter(F.col("n_distinct") > threshold).withColumn("method", F.lit("approx" if approximate else "exact"))


def table_size(ds: DatasetSet) -> DataFrame:
    """Bytes of the values: text by encoded length, other types by width."""
    df = ds.long()
    parts = []
    for f in df.schema.fields:
        if f.name == DATASET:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)).cast("long"))
        elif isinstance(f.dataType, T.ArrayType):
            parts.append(F.greatest(F.size(c), F.lit(0)).cast("long") * 8)
        else:
            width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}.get(
                f.dataType.simpleString(), 8
            )
            parts.append(F.lit(width).cast("long"))
    row = parts[0]
    for p in parts[1:]:
        row = row + p
    out = df.groupBy(DATASET).agg(F.sum(row).alias("bytes"))
    return out.withColumn("size", bytes_text("bytes"))


def describe_numeric(ds: DatasetSet, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (n - 1), min, quartiles and max of numeric columns."""
    df = ds.long(columns)
    cols = [f.name for f in df.schema.fields if kind_of(f.dataType) == "continuous"]
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    agg = df.groupBy(DATASET).agg(
        *[
            F.struct(
                F.count(x[c]).alias("count"),
                F.avg(x[c]).alias("mean"),
                F.stddev_samp(x[c]).alias("std"),
                F.min(x[c]).alias("min"),
                F.max(x[c]).alias("max"),
            ).alias(f"s{i}")
            for i, c in enumerate(cols)
        ]
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(cols)]
    )
    basic = agg.select(DATASET, F.explode(cells).alias("x")).select(DATASET, "x.column", "x.s.*")
    quart = quantile_columns(
        exact_quantiles(df, [DATASET], cols), [DATASET], {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    )
    return basic.join(quart, [DATASET, "column"], "left").select(
        DATASET, "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def describe_text(ds: DatasetSet, columns: Sequence[str] | None = None) -> DataFrame:
    """count, unique, top and freq of text columns.

    Values are counted by digest. Equally frequent values are ordered by
    digest, so each column's winner is one row that can be looked up in the
    data without ever shuffling a text.
    """
    df = ds.long(columns)
    cols = _text_columns(df, columns)
    counts = value_digest_counts(ds, columns)
    # negated count: the smallest (-n, digest) is the most frequent value
    stats = counts.groupBy(DATASET, "column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("n")).alias("neg"), "k")).alias("best"),
    ).select(
        DATASET, "column", "count", "unique", F.col("best.k").alias("k"), (-F.col("best.neg")).alias("freq")
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in cols]
    )
    values = df.select(DATASET, F.explode(cells).alias("x")).select(
        DATASET, "x.*", digest(F.col("x.value")).alias("k")
    )
    tops = (
        attach_groups(values, stats, [DATASET, "column", "k"])
        .groupBy(DATASET, "column", "count", "unique", "freq")
        .agg(F.any_value("value").alias("top"))
    )
    return tops.select(DATASET, "column", "count", "unique", "top", "freq")
