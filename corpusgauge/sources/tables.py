"""Table files, reports and models in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import path_safe
from ..operators.ingestion import REPORT_SCHEMA, compare_reports, overall_status


def read_csv(
    spark: SparkSession,
    paths: Sequence[str],
    schema: str | T.StructType,
    multi_line: bool = False,
    **options: object,
) -> DataFrame:
    """First readable of several CSV locations, with a header and a declared
    schema (no inference pass over the data). Columns are taken by the name in the
    header, in any order; a declared column that the header lacks, a file of the
    folder with another header, or a value that does not fit its type is an error.
    ``multi_line`` allows line breaks inside quoted fields; a file is then read by
    one task, so leave it off where the data does not need it."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    last: Exception | None = None
    for path in paths:
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        reader = reader.option("mode", "FAILFAST").option("enforceSchema", False)
        for k, v in options.items():
            reader = reader.option(k, v)
        try:
            header = reader.csv(path).columns
        except PySparkException as e:
            last = e
            continue
        absent = [f.name for f in declared if f.name not in header]
        if absent:
            raise ValueError(f"columns {absent} are not in the header of {path}")
        known = {f.name: f for f in declared}
        ordered = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
        return reader.schema(ordered).csv(path).select(*[F.col(f"`{f.name}`") for f in declared])
    raise FileNotFoundError(f"no readable CSV among {list(paths)}") from last


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files or directories."""
    return spark.read.parquet(*paths)


def write_report(report: DataFrame, path: str) -> None:
    """Store a validation report as JSON lines. A report has a few rows per
    column of the table it describes, so one file is enough."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).option("mode", "FAILFAST").json(path)


def compare_report_files(
    spark: SparkSession, base: str, ingested: str, **stat_rules
) -> tuple[DataFrame, DataFrame]:
    """Checks and overall status of two stored reports; ``ERROR`` and no checks
    when either cannot be read."""
    try:
        a, b = read_report(spark, base), read_report(spark, ingested)
        if a.isEmpty() or b.isEmpty():
            raise ValueError("empty report")
    except (PySparkException, ValueError):
        checks = spark.createDataFrame(
            [], "position int, check string, status string, issue boolean, warning string"
        )
    else:
        checks = compare_reports(a, b, **stat_rules)
    return checks, overall_status(checks)


def rounded(report: DataFrame, digits: int = 2) -> DataFrame:
    """Every floating-point column rounded for display."""
    floats = (T.FloatType, T.DoubleType)
    return report.select(
        *[
            F.round(f"`{f.name}`", digits).alias(f.name) if isinstance(f.dataType, floats) else F.col(f"`{f.name}`")
            for f in report.schema.fields
        ]
    )


def export_report(report: DataFrame, path: str, digits: int = 2) -> None:
    """Rounded report as CSV with a header."""
    rounded(report, digits).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_by_class(df: DataFrame, path: str, dataset: str, label: str) -> None:
    """One folder per dataset and class, class names made path-safe. The rebalance
    hint brings a class's rows together, so that it has few files, and splits a
    dominant class over tasks."""
    named = df.withColumn("class_safe", path_safe(F.col(label).cast("string")))
    (
        named.hint("rebalance", F.col(f"`{dataset}`"), F.col("class_safe"))
        .write.mode("overwrite")
        .partitionBy(dataset, "class_safe")
        .parquet(path)
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
