"""Intermediate tables in the cluster's shared folder, and small shared checks."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Java regular expression for the separators of words: blank, \t, \n, \v, \f, \r.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Settings while a table is written: a finished query gives its shuffle files back,
#: and texts reach Python in small batches, whose memory two tasks at once can spare.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


#: Paths written since the innermost :func:`settled` began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def _write(df: DataFrame, name: str) -> str:
    """``df`` as Parquet below ``spark.checkpoint.dir``, the session's settings being
    put back afterwards."""
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    if (paths := _written.get()) is not None:
        paths.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there, and
    a lost executor costs only the stage that ran."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name))


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``build`` makes, written to the shared folder; whatever was
    stored on the way to it is removed."""
    token = _written.set([])
    try:
        df = build()
        path = _write(df, name)
        rest = [p for p in _written.get() if p != path]
    finally:
        _written.reset(token)
    discard(spark, rest)
    if (paths := _written.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables of :func:`stored` that nothing reads any more."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text; NULL counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def string_or_empty(df: DataFrame, column: str) -> Column:
    """The column as text, NULL as empty."""
    c = F.col(f"`{column}`")
    if not isinstance(df.schema[column].dataType, T.StringType):
        c = c.cast("string")
    return F.coalesce(c, F.lit(""))
