"""Data-quality checks (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..datasets import DATASET, DatasetSet
from ..operators import quality as Q
from .registry import DS, GAPPY, ORD, doc_rows, gappy, orders, query

_GAPPY_COLS = ("doc_id", "text", "lang", "source", "half", "nothing", "seven")
_NULLS = " union all ".join(
    f"""select dataset, '{c}' as "column", count(*) as n_rows, count(*) - count({c}) as n_null from gappy group by 1"""
    for c in _GAPPY_COLS
)


@query(
    "d0_null_profile",
    f"""with {GAPPY}, p as ({_NULLS}) select *, round(n_null * 100 / n_rows, 2) as pct_null,
        n_null = n_rows as all_null from p""",
)
def d0(spark, sf):
    return Q.null_profile(gappy(spark, sf))


@query(
    "d0_shape",
    f"with {GAPPY} select dataset, count(*) as n_rows, 7 as n_columns from gappy group by 1",
)
def d0_shape(spark, sf):
    return Q.shapes(gappy(spark, sf))


@query(
    "d0_missing_values",
    f"""with {GAPPY}, p as ({_NULLS}) select *, round(n_null * 100 / n_rows, 2) as pct_null,
        n_null = n_rows as all_null from p where n_null > 0""",
)
def d0_missing(spark, sf):
    return Q.missing_values(gappy(spark, sf))


_DUP = """select dataset, sum(n)::bigint as n_rows, (sum(n) - count(*))::bigint as n_duplicates,
          round((sum(n) - count(*)) * 100 / sum(n), 2) as pct_duplicates, count(*) as n_unique from k group by 1"""


@query(
    "d1_row_duplicates",
    f"""with {DS}, k as (select dataset, text, case when doc_id % 3 > 0 then lang end as lang, count(*) as n from ds group by 1, 2, 3) {_DUP}""",
)
def d1(spark, sf):
    lang = F.when(F.col("doc_id") % 3 > 0, F.col("lang"))
    df = doc_rows(spark, sf).select(DATASET, "text", lang.alias("lang"))
    return Q.row_duplicates(DatasetSet.of_long(df, ("train", "test", "oot", "prod")))


@query(
    "d2_text_duplicates",
    f"""with {GAPPY}, k as (select dataset, lower(text) as t, count(*) as n from gappy where text is not null group by 1, 2) {_DUP}""",
)
def d2(spark, sf):
    return Q.text_duplicates(gappy(spark, sf), "text")


_CONF = f"""with {DS}, k as (
  select dataset, sha256(lower(text)) as text_key, left(min(lower(text)), 100) as shown, count(*) as n,
         list_sort(list(distinct case when doc_id % 2 = 0 then lang else source end)) as labels
  from ds where dataset in ('train', 'test') group by 1, 2 having count(*) > 1)"""


def _relabelled(spark, sf):
    label = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.col("source"))
    df = doc_rows(spark, sf).select(DATASET, "text", label.alias("label"))
    return DatasetSet.of_long(df, ("train", "test", "oot", "prod"))


@query(
    "d3_conflict_summary",
    _CONF + " select dataset, count(*) as n_repeated_texts, count(*) filter (where len(labels) > 1) as n_conflicts from k group by 1",
)
def d3(spark, sf):
    return Q.conflict_summary(Q.label_conflicts(_relabelled(spark, sf), "text", "label"))


@query(
    "d3_conflict_examples",
    _CONF
    + """ select dataset, (row_number() over (partition by dataset order by shown, text_key))::int as rank, shown,
         array_to_string(labels, ', ') as labels from k where len(labels) > 1
         qualify row_number() over (partition by dataset order by shown, text_key) <= 5""",
)
def d3_examples(spark, sf):
    return Q.conflict_examples(Q.label_conflicts(_relabelled(spark, sf), "text", "label"))


@query(
    "d4_all_null_columns",
    f"""with {GAPPY} select dataset, 'nothing' as "column", count(*) as n_rows from gappy group by 1""",
)
def d4(spark, sf):
    return Q.all_null_columns(gappy(spark, sf))


@query(
    "d5_zero_variance",
    f"""with {GAPPY}, v as (
        select dataset, 'doc_id' as "column", min(doc_id) = max(doc_id) as c, min(doc_id)::varchar as value from gappy group by 1
        union all select dataset, 'text', min(text) = max(text), min(text) from gappy group by 1
        union all select dataset, 'lang', min(lang) = max(lang), min(lang) from gappy group by 1
        union all select dataset, 'source', min(source) = max(source), min(source) from gappy group by 1
        union all select dataset, 'half', min(half) = max(half), min(half)::varchar from gappy group by 1
        union all select dataset, 'seven', min(seven) = max(seven), min(seven)::varchar from gappy group by 1)
        select dataset, "column", value from v where c""",
)
def d5(spark, sf):
    return Q.zero_variance_columns(gappy(spark, sf))


@query(
    "d6_high_cardinality",
    f"""with {GAPPY}, v as (
        select dataset, 'text' as "column", count(distinct text) as n_distinct from gappy group by 1
        union all select dataset, 'lang', count(distinct lang) from gappy group by 1
        union all select dataset, 'source', count(distinct source) from gappy group by 1)
        select *, 'exact' as method from v where n_distinct > 8""",
)
def d6(spark, sf):
    return Q.high_cardinality(gappy(spark, sf), 8)


@query("d6_high_cardinality_approx")
def d6_approx(spark, sf):
    return Q.high_cardinality(gappy(spark, sf), 8, approximate=True)


@query(
    "d7_table_size",
    f"""with {DS}, b as (select dataset, sum(8 + octet_length(encode(text)) + octet_length(encode(lang)) + octet_length(encode(source)) + 8)::bigint as bytes from ds group by 1)
        select dataset, bytes, case when bytes < 1048576 then printf('%.2f KB', bytes / 1024)
          when bytes < 1073741824 then printf('%.2f MB', bytes / 1048576) else printf('%.2f GB', bytes / 1073741824) end as size from b""",
)
def d7(spark, sf):
    return Q.table_size(DatasetSet.of_long(doc_rows(spark, sf), ("train", "test", "oot", "prod")))


def _describe_sql(source: str, cols: list[str]) -> str:
    return " union all ".join(
        f"""select dataset, '{c}' as "column", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
        round(min({c})::double, 6) as min, round(quantile_cont({c}::double, 0.25), 6) as q25, round(quantile_cont({c}::double, 0.5), 6) as q50,
        round(quantile_cont({c}::double, 0.75), 6) as q75, round(max({c})::double, 6) as max from {source} group by 1"""
        for c in cols
    )


@query("d8_describe_numeric", f"with {GAPPY} {_describe_sql('gappy', ['doc_id', 'half', 'seven'])}")
def d8(spark, sf):
    return Q.describe_numeric(gappy(spark, sf))


@query("d8_describe_orders", f"with {ORD} {_describe_sql('ord', ['o_orderkey', 'o_custkey', 'o_totalprice'])}")
def d8_orders(spark, sf):
    return Q.describe_numeric(orders(spark, sf))


def _describe_text_sql(source: str, cols: list[str]) -> str:
    return " union all ".join(
        f"""select * from (select dataset, '{c}' as "column", (sum(count(*)) over (partition by dataset))::bigint as count,
              count(*) over (partition by dataset) as "unique", {c} as top, count(*) as freq
            from {source} where {c} is not null group by dataset, {c}
            qualify row_number() over (partition by dataset order by count(*) desc, sha256({c})) = 1)"""
        for c in cols
    )


@query("d9_describe_text", f"with {GAPPY} {_describe_text_sql('gappy', ['text', 'lang', 'source'])}")
def d9(spark, sf):
    return Q.describe_text(gappy(spark, sf))
