"""Joins and ranks used by several operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..datasets import DATASET
from ..functions.columns import all_of
from ..session import bounded_rows

BROADCAST_GROUPS = 20_000
# Bytes, roughly, that fetched rows may have to travel to every executor.
BROADCAST_BYTES = 64_000_000
# Estimates beyond the first are no knowledge; one that is wrong costs at most so many tasks.
UNKNOWN_BYTES, MOST_PIECES = 1 << 60, 10_000


def spread(df: DataFrame, piece: int | None = None) -> DataFrame:
    """Give every core a share of a small table before CPU-heavy text work.

    A file of one row group is one task however many cores wait. When the
    planner's size estimate is below one full-sized split per core, the rows
    are dealt out evenly, which moves little. Larger tables already have more
    splits than that and are left where they are: no shuffle.

    With ``piece`` a task gets about so many bytes, whatever the table's size: for work
    whose state in a task, like counts of n-grams, grows with the rows it sees.
    """
    sc = df.sparkSession.sparkContext
    cores = sc.defaultParallelism
    split = 128 * 1024 * 1024
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # no planner at hand (Spark Connect)
        return df
    if piece and size < UNKNOWN_BYTES:
        return df.repartition(min(max(cores, -(-size // piece)), MOST_PIECES))
    return df.repartition(cores) if size < cores * split else df


def _size(value) -> int:  # noqa: ANN001
    """Bytes of a fetched value, roughly."""
    if isinstance(value, (str, bytes, bytearray)):
        return len(value) + 8
    if isinstance(value, dict):
        return sum(_size(k) + _size(v) for k, v in value.items())
    return sum(map(_size, value)) + 8 if isinstance(value, (list, tuple)) else 8


def small_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of a table of at most ``limit`` rows and ``BROADCAST_BYTES`` bytes."""
    rows = bounded_rows(df, limit)
    return None if rows is None or sum(map(_size, rows)) > BROADCAST_BYTES else rows


def broadcast_if_small(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """Broadcast a key table after fetching at most ``limit`` rows proved that
    it is small; a larger one is returned as it is, for an ordinary join."""
    rows = small_rows(df, limit)
    return df if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def attach_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of rows with one row per group, NULL keys being equal.

    The group rows are fetched first; up to ``BROADCAST_GROUPS`` of them travel
    to the rows, so that a group holding a third of the table is never
    shuffled. More groups than that use an ordinary join, whose hot keys
    adaptive execution splits.
    """
    rows = small_rows(groups, BROADCAST_GROUPS)
    if rows is not None:
        groups = F.broadcast(df.sparkSession.createDataFrame(rows, groups.schema))
    if not keys:
        raise ValueError("at least one key is needed")
    right = groups
    for i, k in enumerate(keys):
        right = right.withColumnRenamed(k, f"__g{i}")
    cond = all_of([df[f"`{k}`"].eqNullSafe(right[f"__g{i}"]) for i, k in enumerate(keys)])
    return df.join(right, cond).drop(*[f"__g{i}" for i in range(len(keys))])


def per_dataset(df: DataFrame, **measures: Column) -> dict[str, dict]:
    """A few scalars per dataset that shape the plan after them, as
    ``{dataset: {measure: value}}``; at most ``MAX_DATASETS`` rows."""
    rows = df.groupBy(DATASET).agg(*[c.alias(n) for n, c in measures.items()]).collect()
    return {r[DATASET]: r.asDict() for r in rows}


def top_per(df: DataFrame, by: Sequence[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group. Spark keeps the best ``k`` of every
    partition before it shuffles, so a hot group is never gathered whole."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
