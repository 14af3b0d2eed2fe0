"""Small Column helpers shared by every operator.

ANSI mode is on in Spark 4, so a plain division by zero raises. ``ratio`` is
the only division used in the package; its ``empty`` argument states what a
zero denominator means for the calling metric.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "<<NaN>>"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """``num / den`` as double; ``empty`` when the denominator is zero or NULL."""
    q = F.try_divide(num.cast("double"), den.cast("double"))
    return q if empty is None else F.coalesce(q, F.lit(float(empty)))


def missing_to_null(c: Column | str) -> Column:
    """Fold floating-point NaN into NULL: both mean "missing"."""
    return F.nanvl(as_col(c), F.lit(None).cast("double"))


def fold_missing(df: DataFrame) -> DataFrame:
    """Apply :func:`missing_to_null` to every float and double column."""
    floats = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floats:
        return df
    return df.select(
        *[
            missing_to_null(F.col(f"`{n}`")).cast(df.schema[n].dataType).alias(n)
            if n in floats
            else F.col(f"`{n}`")
            for n in df.columns
        ]
    )


def count_if(cond: Column) -> Column:
    """Number of rows for which ``cond`` is true (0 on no rows)."""
    return F.count(F.when(cond, F.lit(1)))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def lookup(key: Column | str, table: dict) -> Column:
    """Literal CASE lookup for a table of a handful of known keys."""
    key = as_col(key)
    out = None
    for k, v in table.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == F.lit(k), v) if out is None else out.when(key == F.lit(k), v)
    return F.lit(None) if out is None else out


def digest(c: Column | str) -> Column:
    """SHA-256 hex of a string column: a fixed-width stand-in for long text in
    shuffles. NULL stays NULL."""
    return F.sha2(as_col(c), 256)


def row_text(cols: list[str], sep: str = "|") -> Column:
    """Values of a row joined by ``sep`` with missing ones marked."""
    return F.concat_ws(
        sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL_MARK)) for c in cols]
    )


def row_digest(df: DataFrame, cols: list[str] | None = None) -> Column:
    """Digest under which two rows agree only if every column agrees, NULLs
    being equal. Each value is prefixed by its length so that values cannot run
    into each other."""

    def part(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            # -0.0 and 0.0 are equal values but different strings
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            s = F.to_json(F.struct(c))
        else:
            s = c.cast("string")
        return F.coalesce(F.concat(F.char_length(s).cast("string"), F.lit(":"), s), F.lit("~"))

    cols = cols or df.columns
    return F.sha2(F.concat(*[part(df.schema[c]) for c in cols]), 256)
