"""Distributions, binning, cross features and dataset pairs (E, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..datasets import DATASET, DatasetSet
from ..functions.text import n_tokens
from ..operators import distributions as D
from ..operators import drift
from ..plans.profile import token_buckets
from .registry import (
    DATASETS,
    DS,
    GAPPY,
    ORD,
    box_sql,
    doc_rows,
    docs,
    gappy,
    orders,
    query,
    split_sql,
    table,
)


@query(
    "e1_value_counts",
    f"""with {GAPPY} select dataset, lang as value, count(*) as n, round(count(*) / sum(count(*)) over (partition by dataset), 4) as proportion
        from gappy where lang is not null group by 1, 2""",
)
def e1(spark, sf):
    return D.value_counts(gappy(spark, sf), "lang")


_E2 = """c as (select dataset, coalesce(source, 'nan') as category, count(*) as n from {src} group by 1, 2),
k as (select *, row_number() over (partition by dataset order by n desc, category) as rank from c qualify rank <= 12)"""


def _holes(spark, sf):
    v = F.when(F.col("doc_id") % 11 != 0, F.col("source"))
    return DatasetSet.of_long(doc_rows(spark, sf).select(DATASET, v.alias("source"), "lang"), DATASETS)


_HOLES = f"{DS}, holes as (select dataset, case when doc_id % 11 <> 0 then source end as source, lang from ds)"


@query(
    "e2_discrete_distribution",
    f"""with {_HOLES}, {_E2.format(src="holes")}
        select dataset, rank::int as rank, category, n, round(n / sum(n) over (partition by dataset), 6) as proportion from k""",
)
def e2(spark, sf):
    return D.discrete_distribution(_holes(spark, sf), "source", 12)


@query(
    "e2_ordered_distribution",
    f"""with {DS}, o(category, pos) as (values ('fr', 1), ('xx', 2), ('en', 3), ('de', 4)),
        c as (select dataset, lang as category, count(*) as n, pos from ds join o on lang = category group by 1, 2, 4)
        select dataset, (row_number() over (partition by dataset order by pos))::int as rank, category, n,
          round(n / sum(n) over (partition by dataset), 6) as proportion from c""",
)
def e2_ordered(spark, sf):
    return D.discrete_distribution(docs(spark, sf), "lang", 40, ["fr", "xx", "en", "de"])


@query(
    "e3_compare_discrete",
    f"""with {_HOLES}, c as (select dataset, coalesce(lang, 'nan') as category, count(*) as n from holes group by 1, 2),
        p as (select *, n / sum(n) over (partition by dataset) as proportion from c),
        r as (select category, row_number() over (order by avg(proportion) desc, category) as rank from p group by 1 qualify rank <= 3)
        select rank::int as rank, category, dataset, n, round(proportion, 6) as proportion from p join r using (category)""",
)
def e3(spark, sf):
    return D.compare_discrete(_holes(spark, sf), "lang", 3)


@query(
    "e4_metadata_distribution",
    f"""with {ORD} select dataset, o_orderpriority as value, count(*) as n,
        round(count(*) / sum(count(*)) over (partition by dataset), 3) as proportion from ord group by 1, 2""",
)
def e4(spark, sf):
    return D.value_counts(orders(spark, sf), "o_orderpriority", digits=3)


def _hist_sql(src: str, col: str, bins: int) -> str:
    return f"""r as (select dataset, min({col}) as lo, (max({col}) - min({col})) / {bins}::double as w from {src} where {col} is not null group by 1),
      g as (select dataset, lo, w, unnest(range({bins})) as b from r),
      h as (select dataset, least(floor(({col} - lo) / w), {bins - 1}) as b, count(*) as n from {src} join r using (dataset) where {col} is not null group by 1, 2)
      select dataset, b::int as bin, round(lo + b * w, 6) as lo, round(lo + (b + 1) * w, 6) as hi, coalesce(n, 0) as n,
        round(coalesce(n, 0) / (sum(coalesce(n, 0)) over (partition by dataset) * w), 6) as density from g left join h using (dataset, b)"""


@query("e5_histogram", f"with {GAPPY}, {_hist_sql('gappy', 'half', 50)}")
def e5(spark, sf):
    return D.histogram(gappy(spark, sf), "half", 50)


@query("e5_histogram_orders", f"with {ORD}, {_hist_sql('ord', 'o_totalprice', 30)}")
def e5_orders(spark, sf):
    return D.histogram(orders(spark, sf), "o_totalprice", 30)


@query(
    "e6_histogram_on_edges",
    """with d(dataset) as (values ('all')), g as (select * from (values (0, '[0.00 - 0.05)'), (1, '[0.05 - 0.08)'), (2, '[0.08 - 0.09)'), (3, '[0.09 - 0.10]'), (4, '[x]')) t(bin, label) where bin < 4),
       h as (select case when l_discount >= 0 and l_discount < 0.05 then 0 when l_discount >= 0.05 and l_discount < 0.08 then 1
              when l_discount >= 0.08 and l_discount < 0.09 then 2 when l_discount >= 0.09 and l_discount <= 0.1 then 3 end as bin, count(*) as n from lineitem group by 1)
       select 'all' as dataset, bin, label, coalesce(n, 0) as n from g left join h using (bin)""",
)
def e6(spark, sf):
    ds = DatasetSet({"all": table(spark, sf, "lineitem").select("l_discount")})
    return D.histogram_on_edges(ds, "l_discount", [0, 0.05, 0.08, 0.09, 0.1])


@query(
    "e7_density_curve",
    f"""with {DS}, t as (select dataset, len({split_sql('text')})::double as x from ds),
        s as (select dataset, count(*) as n, min(x) as lo, max(x) as hi, stddev_samp(x) * pow(count(*), -0.2) as h from t group by 1),
        g as (select *, unnest(range(40)) as i from s)
        select g.dataset, i::int as point, round(lo - 3 * h + i * ((hi - lo + 6 * h) / 39), 6) as "at",
          round(sum(exp(-0.5 * pow((lo - 3 * h + i * ((hi - lo + 6 * h) / 39) - x) / h, 2))) / (n * h * sqrt(2 * pi())), 6) as density
        from g join t using (dataset) group by g.dataset, i, lo, hi, h, n""",
)
def e7(spark, sf):
    df = doc_rows(spark, sf).select(DATASET, n_tokens("text").alias("n_tokens"))
    return D.density_curve(DatasetSet.of_long(df, DATASETS), "n_tokens", 40)


@query("e8_box_by_dataset", f"with {ORD} {box_sql('ord', 'dataset', 'o_totalprice')}")
def e8(spark, sf):
    return D.box_stats(orders(spark, sf), "o_totalprice")


@query(
    "e8_box_by_class",
    f"with {GAPPY}, t as (select dataset, lang, half from gappy where half is not null and lang is not null) {box_sql('t', 'dataset, lang', 'half')}",
)
def e8_class(spark, sf):
    return D.box_stats(gappy(spark, sf), "half", ["lang"])


@query(
    "e8_box_by_category",
    "with t as (select 'all' as dataset, event_type, value from events) " + box_sql("t", "dataset, event_type", "value"),
)
def e8_category(spark, sf):
    ds = DatasetSet({"all": table(spark, sf, "events").select("event_type", "value")})
    return D.box_stats(ds, "value", ["event_type"])


@query(
    "e9_log_scale_advice",
    f"""with {DS}, t as (select dataset, len({split_sql('text')}) as x from ds)
        select dataset, min(x) > 0 and max(x) > 50 * median(x) as log_scale, min(x) <= 0 and max(x) > 0 as some_not_positive from t group by 1""",
)
def e9(spark, sf):
    df = doc_rows(spark, sf).select(DATASET, n_tokens("text").alias("n_tokens"))
    return D.log_scale_advice(D.box_stats(DatasetSet.of_long(df, DATASETS), "n_tokens"))


@query(
    "e10_year_counts",
    f"with {ORD} select dataset, year(o_orderdate)::int as year, count(*) as n from ord group by 1, 2",
)
def e10(spark, sf):
    return D.year_counts(orders(spark, sf), "o_orderdate")


@query(
    "e11_year_buckets",
    f"""with {ORD}, y as (select dataset, year(o_orderdate) as y, count(*) as n from ord group by 1, 2),
        r as (select dataset, min(y) as lo, max(y) as hi, count(*) as k from y group by 1),
        g as (select dataset, lo, unnest(range(lo, hi + 1, 3)) as first from r where k > 4),
        h as (select dataset, lo + ((y - lo) // 3) * 3 as first, sum(n) as n from y join r using (dataset) group by 1, 2)
        select dataset, first::int as first, first || '-' || (first + 2) as label, coalesce(n, 0)::bigint as n from g left join h using (dataset, first)""",
)
def e11(spark, sf):
    return D.year_buckets(orders(spark, sf), "o_orderdate", threshold=4, size=3)


@query(
    "e12_month_counts",
    f"with {ORD} select dataset, strftime(o_orderdate, '%Y-%m') as month, count(*) as n from ord group by 1, 2",
)
def e12(spark, sf):
    return D.month_counts(orders(spark, sf), "o_orderdate")


@query(
    "e13_crosstab",
    f"""with {GAPPY}, c as (select dataset, source as category, lang as target, count(*) as n from gappy where lang is not null group by 1, 2, 3),
        s as (select dataset, category, sum(n) as k, row_number() over (partition by dataset order by sum(n) desc, category) as rank from c group by 1, 2 qualify rank <= 8)
        select dataset, rank::int as rank, category, target, n, round(n * 100 / k, 6) as pct from c join s using (dataset, category)""",
)
def e13(spark, sf):
    return D.crosstab_percent(gappy(spark, sf), "source", "lang", 8)


@query(
    "e14_mean_tokens_by_class",
    f"""with {DS} select dataset, lang as label, round(avg(len({split_sql('text')})), 6) as mean_value, count(*) as n from ds group by 1, 2""",
)
def e14(spark, sf):
    return D.mean_by_class(docs(spark, sf), n_tokens("text"), "lang", ["text"])


@query(
    "e15_quantile_bins",
    """with q as (select unnest(list_sort(list_distinct([quantile_cont(l_quantity, 0.0), quantile_cont(l_quantity, 0.2), quantile_cont(l_quantity, 0.4),
                quantile_cont(l_quantity, 0.6), quantile_cont(l_quantity, 0.8), quantile_cont(l_quantity, 1.0)]))) as e from lineitem),
       g as (select row_number() over (order by e) - 1 as bin, e as lo, lead(e) over (order by e) as hi from q qualify lead(e) over (order by e) is not null)
       select 'all' as dataset, bin::int as bin, lo, hi, (select count(*) from lineitem where (l_quantity > lo or (bin = 0 and l_quantity = lo)) and l_quantity <= hi) as n from g""",
)
def e15(spark, sf):
    return D.quantile_bins(DatasetSet({"all": table(spark, sf, "lineitem").select("l_quantity")}), "l_quantity")


@query(
    "b12_token_buckets",
    f"""with {DS}, t as (select dataset, len({split_sql('text')}) as n from ds),
        b as (select dataset, case when n <= 10 then '0-10' when n <= 20 then '11-20' when n <= 30 then '21-30' when n <= 50 then '31-50' when n <= 100 then '51-100' else '100+' end as bucket, count(*) as n from t group by 1, 2),
        o(bucket, position) as (values ('0-10', 1), ('11-20', 2), ('21-30', 3), ('31-50', 4), ('51-100', 5), ('100+', 6))
        select dataset, bucket, n, position::int as position from b join o using (bucket)""",
)
def buckets(spark, sf):
    df = doc_rows(spark, sf).select(DATASET, n_tokens("text").alias("n_tokens"))
    return token_buckets(DatasetSet.of_long(df, DATASETS), "n_tokens")


# -- pairs --------------------------------------------------------------------


def _pair(spark, sf) -> DatasetSet:
    return orders(spark, sf).only(["oot", "prod"])


@query(
    "g1_pair_plan",
    """select column_name as "column", case when data_type in ('BIGINT', 'INTEGER', 'DOUBLE') then 'continuous'
         when data_type = 'VARCHAR' then 'discrete' else 'datetime' end as family
       from duckdb_columns() where table_name = 'orders'""",
)
def g1(spark, sf):
    return drift.column_plan_rows(orders(spark, sf), "oot", "prod")


@query("g1_pair_all_columns")
def g1_all(spark, sf):
    """The whole pair comparison: one row per column with its result's size."""
    parts = drift.compare_pair(orders(spark, sf), "oot", "prod", ["o_orderkey"])
    out = None
    for family, tables in parts.items():
        for c, t in tables.items():
            one = t.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(family).alias("family"), F.lit(c).alias("column"), "n_rows"
            )
            out = one if out is None else out.unionByName(one)
    return out


@query(
    "g2_pair_discrete",
    f"""with {ORD}, c as (select dataset, o_orderpriority as category, count(*) as n from ord where dataset in ('oot', 'prod') group by 1, 2),
        p as (select *, n / sum(n) over (partition by dataset) as proportion from c),
        r as (select category, row_number() over (order by avg(proportion) desc, category) as rank from p group by 1)
        select rank::int as rank, category, dataset, n, round(proportion, 6) as proportion from p join r using (category)""",
)
def g2(spark, sf):
    return drift.pair_discrete(_pair(spark, sf), "o_orderpriority")


@query(
    "g3_pair_continuous",
    f"with {ORD}, t as (select dataset, o_totalprice from ord where dataset in ('oot', 'prod')) {box_sql('t', 'dataset', 'o_totalprice')}",
)
def g3(spark, sf):
    return drift.pair_continuous(_pair(spark, sf), "o_totalprice")


@query(
    "g4_pair_datetime",
    f"""with {ORD}, t as (select dataset, year(o_orderdate) as y from ord where dataset in ('oot', 'prod')),
        r as (select min(y) as lo, max(y) as hi from t), g as (select d.dataset, lo, unnest(range(lo, hi + 1, 2)) as first from r, (select distinct dataset from t) d),
        h as (select dataset, lo + ((y - lo) // 2) * 2 as first, count(*) as n from t, r group by 1, 2)
        select g.dataset, g.first::int as first, g.first || '-' || (g.first + 1) as label, coalesce(n, 0) as n,
          round(coalesce(n, 0) / sum(n) over (partition by g.dataset), 6) as proportion from g left join h using (dataset, first)""",
)
def g4(spark, sf):
    return drift.pair_datetime(_pair(spark, sf), "o_orderdate", threshold=4, size=2)


@query(
    "g5_kl_divergence",
    f"""with {DS}, c as (select source, count(*) filter (where dataset = 'train') + 0.5 as a, count(*) filter (where dataset = 'prod') + 0.5 as b
          from ds where dataset in ('train', 'prod') group by 1),
        t as (select *, a / sum(a) over () as p, b / sum(b) over () as q from c)
        select 'train' as first, 'prod' as second, count(*) as n_categories, round(sum(p * ln(p / q))::double, 6) as kl from t""",
)
def g5(spark, sf):
    return drift.kl_divergence(docs(spark, sf), "source", "train", "prod")

