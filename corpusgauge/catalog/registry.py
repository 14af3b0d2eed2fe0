"""Registry, shared views and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..datasets import DATASET, DatasetSet
from ..functions.stopwords import ENGLISH
from ..operators.evaluation import class_names

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DATASETS = ("train", "test", "oot", "prod")
# display columns of one confusion matrix; class lists are taken from the data
LANGS = ("de", "en", "es", "fr")
DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register a query; floating-point columns are rounded so that sums taken
    in another order still compare equal."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DIGITS).alias(f.name)
        out.append(c)
    return df.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def langs(df: DataFrame, column: str = "lang") -> list[str]:
    """The class list of the data at hand."""
    return class_names(df.select(F.col(column).alias("y_true")))


LANGS_SQL = "(select list(distinct lang order by lang) from documents where lang is not null)"


# -- views, in Spark and in SQL -----------------------------------------------


def dataset_of(key: str):
    d = F.col(key) % 10
    return F.when(d < 6, "train").when(d < 8, "test").when(d == 8, "oot").otherwise("prod")


def dataset_sql(key: str) -> str:
    return (
        f"case when {key} % 10 < 6 then 'train' when {key} % 10 < 8 then 'test' "
        f"when {key} % 10 = 8 then 'oot' else 'prod' end"
    )


def doc_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn(DATASET, dataset_of("doc_id"))


def docs(spark, sf_dir) -> DatasetSet:
    return DatasetSet.of_long(doc_rows(spark, sf_dir), DATASETS)


DS = f"ds as (select *, {dataset_sql('doc_id')} as dataset from documents)"


def gappy_rows(spark, sf_dir) -> DataFrame:
    """Documents with holes: NULL texts and labels, and an all-NULL, a constant
    and a NaN column."""
    return doc_rows(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_id") % 53 != 0, F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 17 != 0, F.col("lang")).alias("lang"),
        "source",
        F.when(F.col("doc_id") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") / 2).alias("half"),
        F.lit(None).cast("string").alias("nothing"),
        F.lit(7).alias("seven"),
        DATASET,
    )


def gappy(spark, sf_dir) -> DatasetSet:
    return DatasetSet.of_long(gappy_rows(spark, sf_dir), DATASETS)


GAPPY = f"""gappy as (
  select doc_id, case when doc_id % 53 <> 0 then text end as text,
         case when doc_id % 17 <> 0 then lang end as lang, source,
         case when doc_id % 19 = 0 then null else n_chars / 2 end as half,
         cast(null as varchar) as nothing, 7 as seven,
         {dataset_sql('doc_id')} as dataset
  from documents)"""


def order_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn(DATASET, dataset_of("o_orderkey"))


def orders(spark, sf_dir) -> DatasetSet:
    return DatasetSet.of_long(order_rows(spark, sf_dir), DATASETS)


ORD = f"ord as (select *, {dataset_sql('o_orderkey')} as dataset from orders)"


def predictions(spark, sf_dir) -> DataFrame:
    """Stand-in for stored predictions, derived from the documents."""
    d = F.col("doc_id")
    return doc_rows(spark, sf_dir).select(
        DATASET,
        "doc_id",
        "source",
        "n_chars",
        F.col("lang").alias("y_true"),
        F.when(d % 7 == 0, "en").when(d % 11 == 0, "xx").otherwise(F.col("lang")).alias("y_pred"),
        F.when(d % 53 != 0, ((d * 37) % 101) / F.lit(100.0)).alias("confidence"),
        F.make_timestamp_ntz(
            (F.lit(2000) + d % 7).cast("int"), F.lit(1), F.lit(15), F.lit(0), F.lit(0), F.lit(0)
        ).alias("seen"),
        F.concat(F.lit("g"), (d % 5).cast("string")).alias("grp"),
    )


PRED = f"""pred as (
  select {dataset_sql('doc_id')} as dataset, doc_id, source, n_chars, lang as y_true,
         case when doc_id % 7 = 0 then 'en' when doc_id % 11 = 0 then 'xx' else lang end as y_pred,
         case when doc_id % 53 <> 0 then ((doc_id * 37) % 101) / 100.0::double end as confidence,
         make_timestamp(2000 + doc_id % 7, 1, 15, 0, 0, 0.0) as seen,
         'g' || (doc_id % 5) as grp
  from documents)"""

# -- SQL fragments ------------------------------------------------------------

SPACE_SQL = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"


def split_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{SPACE_SQL}'), lambda x: x <> '')"


def basic_sql(col: str = "text") -> str:
    return split_sql(f"lower({col})")


STOP_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH) + "]"


def words_sql(col: str = "text") -> str:
    return (
        f"list_filter(regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
        f"lambda x: not list_contains({STOP_LIST}, x))"
    )


def bigrams_sql(toks: str) -> str:
    return (
        f"case when len({toks}) >= 2 then list_transform(range(1, len({toks})), "
        f"lambda i: {toks}[i] || ' ' || {toks}[i + 1]) else [] end"
    )


def box_sql(source: str, keys: str, value: str) -> str:
    """Box statistics of ``value`` by ``keys`` (rows with NULLs dropped before)."""
    using = ", ".join(k.strip() for k in keys.split(","))
    return f"""
    , b as (select {keys}, quantile_cont({value}, 0.25) as q1, quantile_cont({value}, 0.5) as median,
                   quantile_cont({value}, 0.75) as q3 from {source} group by {keys})
    select {keys}, count(*) as n,
           round(min(case when {value} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then {value} end)::double, 6) as whisker_low,
           round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
           round(max(case when {value} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then {value} end)::double, 6) as whisker_high,
           count(*) filter (where not ({value} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))) as n_outliers,
           round(min({value})::double, 6) as lo, round(max({value})::double, 6) as hi
    from {source} join b using ({using}) group by {keys}, q1, median, q3"""
