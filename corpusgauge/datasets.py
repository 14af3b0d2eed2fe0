"""Named datasets as one long DataFrame.

A profile always looks at several datasets at once (train, test, out-of-time,
production). They are kept as one DataFrame with a ``dataset`` column, so that
one job serves all of them, next to the declared columns of every member:
"the column is absent" and "the column is all NULL" are different findings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.columns import fold_missing

DATASET = "dataset"
# One row per dataset is the only thing joined by broadcast without a look at
# its size; this bound is what makes that safe.
MAX_DATASETS = 256


def kind_of(dtype: T.DataType) -> str | None:
    """Statistical kind of a column: continuous, discrete, datetime or None."""
    if isinstance(dtype, T.NumericType):
        return "continuous"
    if isinstance(dtype, (T.StringType, T.BooleanType)):
        return "discrete"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return None


class DatasetSet:
    """Holder of named DataFrames whose columns may differ."""

    def __init__(self, frames: Mapping[str, DataFrame] | Sequence[DataFrame], names=None):
        if names is not None:
            if len(frames) != len(names):
                raise ValueError("the number of datasets and of names must be the same")
            frames = dict(zip(names, frames))
        if not frames:
            raise ValueError("at least one dataset is needed")
        if len(frames) > MAX_DATASETS:
            raise ValueError(f"more than {MAX_DATASETS} datasets")
        self.frames = {n: fold_missing(f) for n, f in frames.items()}

        self._stacked: DataFrame | None = None

    @classmethod
    def of_long(cls, df: DataFrame, names: Sequence[str], by: str = DATASET) -> DatasetSet:
        """Datasets that already sit in one table: one scan serves all."""
        if by != DATASET:
            df = df.withColumnRenamed(by, DATASET)
        self = cls({n: df.filter(F.col(DATASET) == F.lit(n)).drop(DATASET) for n in names})
        self._stacked = fold_missing(df)
        return self

    @property
    def names(self) -> list[str]:
        return list(self.frames)

    def columns(self, name: str) -> list[str]:
        return self.frames[name].columns

    def members_with(self, *cols: str) -> list[str]:
        """Datasets that declare all of ``cols``."""
        return [n for n, f in self.frames.items() if set(cols) <= set(f.columns)]

    def all_columns(self) -> list[str]:
        """Union of the members' columns in order of first appearance."""
        seen: dict[str, None] = {}
        for f in self.frames.values():
            seen.update(dict.fromkeys(f.columns))
        return list(seen)

    def long(self, columns: Sequence[str] | None = None) -> DataFrame:
        """All members stacked with their name; absent columns become NULL.
        With ``columns`` only members declaring at least one of them take part."""
        if self._stacked is not None:
            df = self._stacked.filter(F.col(DATASET).isin(*self.names))
            keep = df.columns if columns is None else [*columns, DATASET]
            return df.select(*[F.col(f"`{c}`") for c in keep])
        parts = []
        for name, frame in self.frames.items():
            if columns is not None:
                keep = [c for c in columns if c in frame.columns]
                if not keep:
                    continue
                frame = frame.select(*[F.col(f"`{c}`") for c in keep])
            parts.append(frame.withColumn(DATASET, F.lit(name)))
        if not parts:
            raise ValueError(f"no dataset has any of the columns {list(columns or [])}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def only(self, names: Sequence[str]) -> DatasetSet:
        missing = [n for n in names if n not in self.frames]
        if missing:
            raise KeyError(f"unknown datasets: {missing}")
        part = DatasetSet({n: self.frames[n] for n in names})
        part._stacked = self._stacked
        return part


def column_plan(left: DataFrame, right: DataFrame, skip: Sequence[str] = ()) -> dict[str, list[str]]:
    """Classify the columns two tables share: ``continuous``, ``discrete``,
    ``datetime`` or ``skipped``. Looks at schemas only."""
    plan: dict[str, list[str]] = {"continuous": [], "discrete": [], "datetime": [], "skipped": []}
    for c in left.columns:
        if c not in right.columns or c in skip:
            continue
        a, b = kind_of(left.schema[c].dataType), kind_of(right.schema[c].dataType)
        if a == "discrete" or (a is not None and a == b):
            plan[a].append(c)
        else:
            plan["skipped"].append(c)
    return plan
