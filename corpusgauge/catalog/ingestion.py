"""Ingestion validation (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import row_text
from ..operators import ingestion as I
from ..session import scratch_path
from ..sources import tables as S
from .registry import query, table

KEYS = ["o_orderkey", "o_custkey", "o_orderpriority"]
_ROW = "concat_ws('|', o_orderkey::varchar, coalesce((case when o_orderkey % 9 > 0 then o_custkey end)::varchar, '<<NaN>>'), o_orderpriority)"


def _num(src: str, c: str) -> str:
    stats = {
        "count": f"count({c})",
        "mean": f"avg({c})",
        "std": f"stddev_samp({c})",
        "min": f"min({c})",
        "25%": f"quantile_cont({c}::double, 0.25)",
        "50%": f"quantile_cont({c}::double, 0.5)",
        "75%": f"quantile_cont({c}::double, 0.75)",
        "max": f"max({c})",
    }
    return " union all ".join(
        f"""select '{c}' as "column", '{s}' as stat, ({e})::double as number, null::varchar as word from {src}"""
        for s, e in stats.items()
    )


def _txt(src: str, c: str) -> str:
    top = f"(select {c} from {src} where {c} is not null group by {c} order by count(*) desc, sha256({c}) limit 1)"
    freq = f"(select count(*) from {src} where {c} is not null group by {c} order by count(*) desc, sha256({c}) limit 1)"
    return f"""select '{c}' as "column", 'count' as stat, count({c})::double as number, null::varchar as word from {src}
      union all select '{c}', 'unique', count(distinct {c})::double, null from {src}
      union all select '{c}', 'top', null, {top}
      union all select '{c}', 'freq', {freq}::double, null"""


def _stats_sql(src: str, numeric: list[str], text: list[str]) -> str:
    return " union all ".join([_num(src, c) for c in numeric] + [_txt(src, c) for c in text])


REPORT_SQL = f"""select 'stat' as section, * replace (round(number, 6) as number) from ({_stats_sql('customer', ['c_custkey', 'c_nationkey', 'c_acctbal'], ['c_name', 'c_mktsegment'])})
        union all select 'shape', '', 'rows', count(*)::double, null from customer union all select 'shape', '', 'columns', 5, null
        union all select 'null', c, 'nulls', 0, null from (values ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) t(c)
        union all select 'dtype', c, 'type', null, d from (values ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) t(c, d)
        union all select 'column', c, 'name', null, c from (values ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) t(c)
        union all select 'hash', '', 'hashed', null, 'false'"""


def report_rows(r):
    """A report with its values as numbers where they are some."""
    number = F.col("value").try_cast("double")
    return r.select(
        "section",
        F.coalesce("column", F.lit("")).alias("column"),
        "stat",
        number.alias("number"),
        F.when(number.isNull(), F.col("value")).alias("word"),
    )


@query("i1_profile_report", REPORT_SQL)
def i1(spark, sf):
    return report_rows(I.validation_report(table(spark, sf, "customer")))


@query("a3_a4_report_files", REPORT_SQL)
def a3_a4(spark, sf):
    """Store a whole report as JSON and read it back."""
    path = scratch_path(spark, "report")
    S.write_report(I.validation_report(table(spark, sf, "customer")), path)
    return report_rows(S.read_report(spark, path))


def _keyed(spark, sf):
    df = table(spark, sf, "orders")
    return df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_custkey")))


@query("i2_row_hashes", f"select o_orderkey, {_ROW} as row_text, sha256({_ROW}) as h from orders")
def i2(spark, sf):
    t = row_text(KEYS)
    return _keyed(spark, sf).select("o_orderkey", t.alias("row_text"), F.sha2(t, 256).alias("h"))


def tree_sql(rows: str) -> str:
    """The digest tree over a column ``h`` of row hashes, as a scalar query."""
    return f"""(with leaf as (select h, h || ':' || count(*) as e from {rows} group by h),
       l6 as (select left(h, 6) as p, sha256(string_agg(e, '' order by e)) as e from leaf group by 1),
       l3 as (select left(p, 3) as p, sha256(string_agg(p || '=' || e, '' order by p || '=' || e)) as e from l6 group by 1)
       select sha256(string_agg(p || '=' || e, '' order by p || '=' || e)) from l3)"""


@query(
    "i3_aggregate_hash",
    f"""with h as (select sha256({_ROW}) as h from orders)
        select 'flat' as mode, sha256(string_agg(h, '' order by h)) as aggregate_hash from h
        union all select 'tree', {tree_sql('h')}""",
)
def i3(spark, sf):
    df = _keyed(spark, sf)
    parts = [I.aggregate_hash(df, KEYS, m).select(F.lit(m).alias("mode"), "aggregate_hash") for m in ("flat", "tree")]
    return parts[0].unionByName(parts[1])


@query(
    "i3_hash_tree",
    f"""with r as (select sha256(concat_ws('|', l_orderkey::varchar, l_returnflag, l_linestatus)) as h from lineitem)
       select {tree_sql('r')} as aggregate_hash""",
)
def i3_tree(spark, sf):
    return I.aggregate_hash(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag", "l_linestatus"])


# -- comparisons --------------------------------------------------------------


def _touched(df):
    """Some prices changed, some statuses lost, a narrower integer type."""
    k = F.col("o_orderkey")
    return df.select(
        "o_orderkey",
        F.col("o_custkey").cast("int").alias("o_custkey"),
        F.when(k % 50 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 100 == 0, F.col("o_totalprice") + 100).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )


def _moved(df):
    """Two columns swapped, one renamed, one row in a thousand lost."""
    return df.filter("o_orderkey % 1000 <> 1").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").alias("o_date"), "o_orderpriority"
    )


TOUCHED = """touched as (select o_orderkey, o_custkey, case when o_orderkey % 50 <> 0 then o_orderstatus end as o_orderstatus,
  case when o_orderkey % 100 = 0 then o_totalprice + 100 else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders)"""


def _reports(spark, sf, change, **kw):
    base = table(spark, sf, "orders")
    return I.validation_report(base, **kw), I.validation_report(change(base), **kw)


@query(
    "i4_compare_shapes",
    """select 'rows' as item, count(*)::varchar as base, (count(*) filter (where o_orderkey % 1000 <> 1))::varchar as ingested,
         count(*) = count(*) filter (where o_orderkey % 1000 <> 1) as equal from orders
       union all select 'columns', '6', '6', true""",
)
def i4(spark, sf):
    return I.compare_shapes(*_reports(spark, sf, _moved, sections=["shape"]))


@query(
    "i4_compare_columns",
    """with a as (select column_name as c, column_index as i from duckdb_columns() where table_name = 'orders'),
       b as (select case c when 'o_orderdate' then 'o_date' else c end as c, case c when 'o_orderkey' then 2 when 'o_custkey' then 1 else i end as i from a)
       select coalesce(a.c, b.c) as "column", case when b.c is null then 'base_only' when a.c is null then 'ingested_only' when a.i = b.i then 'same' else 'moved' end as finding
       from a full join b using (c)""",
)
def i4_columns(spark, sf):
    return I.compare_columns(*_reports(spark, sf, _moved, sections=["column"])).select("column", "finding")


@query(
    "i5_compare_types",
    """select * from (values ('o_orderkey', 'bigint', 'bigint', true), ('o_custkey', 'bigint', 'int', true), ('o_orderstatus', 'string', 'string', true),
       ('o_totalprice', 'double', 'double', true), ('o_orderdate', 'timestamp_ntz', 'timestamp_ntz', true), ('o_orderpriority', 'string', 'string', true))
       t("column", base, ingested, compatible) where "column" in (select column_name from duckdb_columns() where table_name = 'orders')""",
)
def i5(spark, sf):
    return I.compare_types(*_reports(spark, sf, _touched, sections=["dtype"]))


_NUMERIC, _TEXT = ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]


@query(
    "i6_compare_stats",
    f"""with {TOUCHED}, a as ({_stats_sql('orders', _NUMERIC, _TEXT)}), b as ({_stats_sql('touched', _NUMERIC, _TEXT)}),
        d as (select 'o_orderdate' as "column", unnest(['count', 'min', 'max']) as stat, 'equal' as outcome),
        fq as (select a."column", abs(a.number - b.number) <= 1e-8 + 1e-5 * abs(b.number) as same from a join b on a."column" = b."column" and a.stat = b.stat where a.stat = 'freq')
        select a."column", a.stat, case when a.stat = 'top' and a.word = b.word then 'equal' when a.stat = 'top' and fq.same then 'ignored' when a.stat = 'top' then 'differs'
            when abs(a.number - b.number) <= 1e-8 + 1e-5 * abs(b.number) then 'equal' else 'differs' end as outcome
        from a join b on a."column" = b."column" and a.stat = b.stat left join fq on fq."column" = a."column"
        union all select * from d""",
)
def i6(spark, sf):
    return I.compare_stats(*_reports(spark, sf, _touched, sections=["column", "stat"])).select("column", "stat", "outcome")


@query(
    "i7_compare_nulls",
    f"""with {TOUCHED}, a as (unpivot (select count(*) - count(o_orderkey) as o_orderkey, count(*) - count(o_custkey) as o_custkey, count(*) - count(o_orderstatus) as o_orderstatus,
           count(*) - count(o_totalprice) as o_totalprice, count(*) - count(o_orderdate) as o_orderdate, count(*) - count(o_orderpriority) as o_orderpriority from orders) on * into name "column" value n),
        b as (unpivot (select count(*) - count(o_orderkey) as o_orderkey, count(*) - count(o_custkey) as o_custkey, count(*) - count(o_orderstatus) as o_orderstatus,
           count(*) - count(o_totalprice) as o_totalprice, count(*) - count(o_orderdate) as o_orderdate, count(*) - count(o_orderpriority) as o_orderpriority from touched) on * into name "column" value n)
        select a."column", a.n::varchar as base, b.n::varchar as ingested, a.n = b.n as equal from a join b on a."column" = b."column" """,
)
def i7(spark, sf):
    return I.compare_nulls(*_reports(spark, sf, _touched, sections=["null"]))


@query(
    "i7_compare_hashes",
    f"""with {TOUCHED}, ra as (select sha256(concat_ws('|', o_orderkey, coalesce(o_orderstatus, '<<NaN>>'))) as h from orders),
        rb as (select sha256(concat_ws('|', o_orderkey, coalesce(o_orderstatus, '<<NaN>>'))) as h from touched),
        x as (select {tree_sql('ra')} as a, {tree_sql('rb')} as b)
        select case when a = b then 'PASS' else 'FAIL' end as status, a <> b as issue, a as hash_base, b as hash_ingested from x""",
)
def i7_hashes(spark, sf):
    pair = _reports(spark, sf, _touched, hash_columns=["o_orderkey", "o_orderstatus"], sections=["hash"])
    return I.compare_hashes(*pair).select("status", "issue", "hash_base", "hash_ingested")


@query(
    "i8_overall_status",
    f"""with {TOUCHED} select 'touched' as variant, case when (select count(o_orderstatus) from orders) = (select count(o_orderstatus) from touched) then 'PASS' else 'FAIL' end as overall_status
        union all select 'reversed', case when (select count(*) from orders) > 0 then 'PASS' end""",
)
def i8(spark, sf):
    """A changed copy fails; a copy that differs in row order and partitioning
    passes."""
    orders, hashed = table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"]
    base = I.validation_report(orders, hash_columns=hashed)
    one = lambda name, change: I.overall_status(
        I.compare_reports(base, I.validation_report(change(orders), hash_columns=hashed))
    ).select(F.lit(name).alias("variant"), "overall_status")
    turned = lambda df: df.orderBy(F.desc("o_orderkey")).repartition(7)
    return one("touched", _touched).unionByName(one("reversed", turned))


@query(
    "a4_compare_report_files",
    f"""with {TOUCHED}, d as (select (select count(o_orderstatus) from orders) = (select count(o_orderstatus) from touched) as same)
        select "check", case when "check" in ('stats_match', 'null_count_match') and not same then 'FAIL' when "check" = 'hash_match' then 'SKIPPED' else 'PASS' end as status,
               case when same then 'PASS' else 'FAIL' end as overall_status
        from d, (values ('shape_match'), ('column_match'), ('dtype_match'), ('stats_match'), ('null_count_match'), ('hash_match')) t("check")""",
)
def a4_files(spark, sf):
    """Two stored reports, read back and compared."""
    paths = [scratch_path(spark, f"report-{i}") for i in range(2)]
    for report, path in zip(_reports(spark, sf, _touched), paths):
        S.write_report(report, path)
    checks, overall = S.compare_report_files(spark, *paths)
    status = overall.first()["overall_status"]
    return checks.select("check", "status", F.lit(status).alias("overall_status"))
