"""Row filters, samples, splits and encodings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.columns import ratio
from ..functions.text import raw_tokens
from ..session import bounded_rows
from .common import attach_groups, broadcast_if_small, spread

MAX_CLASSES = 20_000
# A dictionary of names up to these sizes travels to every executor.
DICTIONARY_ROWS, DICTIONARY_CHARS = 500_000, 16_000_000


def valid_rows(df: DataFrame, text: str, label: str) -> DataFrame:
    """Rows whose text and label are non-empty."""
    return df.filter((F.length(text) > 0) & (F.length(label) > 0))


def validity_counts(df: DataFrame, text: str, label: str) -> DataFrame:
    ok = (F.length(text) > 0) & (F.length(label) > 0)
    kept = F.count(F.when(ok, 1))
    return df.agg(kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("skipped"))


def require_valid(df: DataFrame, text: str, label: str) -> DataFrame:
    """:func:`valid_rows`, refusing a result without rows."""
    out = valid_rows(df, text, label)
    if out.isEmpty():
        raise ValueError("no row has both a text and a label")
    return out


def keep_listed(df: DataFrame, column: str, values: DataFrame, key: str) -> DataFrame:
    """Rows whose value is in a table of values."""
    right = values.select(F.col(key).alias("__v")).distinct()
    return df.join(broadcast_if_small(right), df[column] == F.col("__v"), "left_semi")


def drop_names(df: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """Drop the white-space tokens found in a dictionary too large for a
    literal list, whatever their case.

    A dictionary that proves small enough travels to the rows, whose tokens are looked
    up where they lie: no text is shuffled. For a larger one only the tokens that *hit*
    it are grouped per row by ``key``, which identifies a row. The text is then filtered
    by that short list, so rows without a hit, or without any token left, stay.
    """
    listed = names.select(F.lower(name).alias("w")).filter("w is not null").distinct()
    tokens = F.array_distinct(F.transform(raw_tokens(text), F.lower))
    rows = bounded_rows(listed, DICTIONARY_ROWS)
    if rows is not None and sum(len(r["w"]) for r in rows) <= DICTIONARY_CHARS:
        words = pa.array([r["w"] for r in rows], pa.string())

        @F.arrow_udf("array<string>")
        def found(lists: pa.Array) -> pa.Array:
            flat = lists.flatten()
            hit = pc.is_in(flat, value_set=words)
            sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            ends = np.concatenate([[0], np.cumsum(hit.to_numpy(zero_copy_only=False))])[sizes]
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(hit))

        marked = spread(df).withColumn("__hits", found(tokens))
    else:
        hits = (
            df.select(key, F.explode(tokens).alias("w"))
            .join(listed, "w", "left_semi")
            .groupBy(key)
            .agg(F.collect_list("w").alias("__hits"))
        )
        marked = df.join(hits, key, "left")
    kept = F.filter(
        raw_tokens(text), lambda x: ~F.array_contains(F.coalesce("__hits", F.array().cast("array<string>")), F.lower(x))
    )
    return marked.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(kept, " "))).drop("__hits")


def apply_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
    batch_size: int = 10_000,
) -> DataFrame:
    """Run a pandas function over batches of at most ``batch_size`` rows. Spark
    hands out the batches; the function must not depend on where they end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), batch_size):
                yield fn(pdf.iloc[start : start + batch_size].copy())

    return df.mapInPandas(run, schema)


# -- samples and splits -------------------------------------------------------


def order_hash(key: str, seed: int) -> Column:
    """Reproducible pseudo-random order of rows, free of their placement."""
    return F.xxhash64(F.col(key), F.lit(seed))


def sample_rows(
    df: DataFrame, key: str, n: int, seed: int = 42, order: Column | None = None
) -> DataFrame:
    """The sampling operator: ``n`` rows chosen by key and seed (or by another
    row order), the same ones on every run. Each partition keeps its best ``n``
    before they are merged."""
    order = order_hash(key, seed) if order is None else order
    return df.orderBy(order, F.col(key)).limit(n)


def hash_split(
    df: DataFrame, key: str, shares: Sequence[tuple[str, float]], seed: int = 42, order: Column | None = None
) -> DataFrame:
    """Random split by key without a shuffle: a row's part depends on its own
    key only, or on another whole number ``order``. Shares hold in expectation."""
    order = order_hash(key, seed) if order is None else order
    u = F.pmod(order, F.lit(1_000_000)) / F.lit(1_000_000.0)
    return df.withColumn("part", _part_of(u, shares))


def _part_of(u: Column, shares: Sequence[tuple[str, float]]) -> Column:
    total = sum(s for _, s in shares)
    at, out = 0.0, None
    for name, share in shares[:-1]:
        at += share / total
        cond = u < at - 1e-12
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(shares[-1][0]) if out is None else out.otherwise(shares[-1][0])


#: Rows that one task ranks in a stratified split.
SLICE_ROWS = 250_000


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    shares: Sequence[tuple[str, float]],
    order: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Split every class in the given shares, exactly to a row.

    A row's position in its class is its rank by ``order`` (a hash of the key
    by default; any integer column otherwise). Ranks are taken inside slices of
    the order and shifted by the sizes of the slices before, so that no task
    ranks a whole class. Slices follow approximate quantiles of the order, so
    unevenly spaced keys still give even slices; there are as many of them as make
    ``SLICE_ROWS`` rows each.
    """
    buckets = buckets or max(2, df.count() // SLICE_ROWS + 1)
    if order is None:
        order = order_hash(key, 42)
        inner_edges = [-(2.0**63) + 2.0**64 * i / buckets for i in range(1, buckets)]
    else:
        probs = [i / buckets for i in range(1, buckets)]
        found = df.select(order.cast("double").alias("o")).approxQuantile("o", probs, 1 / (4 * buckets))
        inner_edges = sorted(set(found))
    keyed = df.withColumn("__o", order.cast("long")).withColumn("__d", F.col("__o").cast("double"))
    slices = Bucketizer(
        splits=[float("-inf"), *inner_edges, float("inf")], inputCol="__d", outputCol="__s"
    )
    keyed = slices.transform(keyed).withColumn("__b", F.col("__s").cast("int")).drop("__s", "__d")
    sizes = keyed.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(label).orderBy("__b")
    sizes = sizes.select(
        label,
        "__b",
        (F.sum("__c").over(w) - F.col("__c")).alias("__before"),
        F.sum("__c").over(W.partitionBy(label)).alias("__total"),
    )
    inner = F.row_number().over(W.partitionBy(label, "__b").orderBy("__o", key))
    ranked = attach_groups(keyed, sizes, [label, "__b"]).withColumn("__r", inner + F.col("__before"))
    u = ratio(F.col("__r") - 1, F.col("__total"))
    return ranked.withColumn("part", _part_of(u, shares)).drop("__o", "__b", "__before", "__total", "__r")


def positional_split(
    df: DataFrame, key: str, shares: Sequence[tuple[str, float]], buckets: int | None = None
) -> DataFrame:
    """Split a table in key order (60/20/20 and the like): the first share of
    the rows, then the next. The key is an integer."""
    return stratified_split(
        df.withColumn("__all", F.lit("all")), key, "__all", shares, F.col(key), buckets
    ).drop("__all")


# -- encodings ----------------------------------------------------------------


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """``(label, code)``: classes numbered from 0 in alphabetical order. Only
    the distinct classes are numbered, so the window is as small as the class
    list."""
    names = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label")).distinct()
    return names.withColumn(
        "code", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("label")) - 1).cast("int")
    )


def encode_labels(df: DataFrame, label: str, codes: DataFrame) -> DataFrame:
    right = codes.select(F.col("label").alias("__label"), "code")
    return df.join(
        broadcast_if_small(right, MAX_CLASSES), df[label].cast("string") == F.col("__label"), "left"
    ).drop("__label")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balancing weight ``n / (k * n_class)`` per class."""
    counts = (
        df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    )
    # as many rows as classes
    w = W.partitionBy(F.lit(0))
    return counts.withColumn(
        "weight", ratio(F.sum("n").over(w), F.count(F.lit(1)).over(w) * F.col("n"))
    )
