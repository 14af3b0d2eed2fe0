"""Sources and sinks, row functions, splits and joins (A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..datasets import DATASET, DatasetSet, column_plan
from ..functions import text as X
from ..functions.formatting import count_text, metric_text, percent_text
from ..operators import evaluation as E
from ..operators import lexical, quality
from ..operators import rows as R
from ..operators.distributions import to_datetime, value_counts
from ..operators.features import fit_tfidf
from ..session import scratch_path
from ..sources import tables as S
from .registry import (
    DS,
    GAPPY,
    PRED,
    basic_sql,
    bigrams_sql,
    doc_rows,
    docs,
    gappy,
    gappy_rows,
    predictions,
    query,
    split_sql,
    table,
    words_sql,
)

# -- sources and sinks --------------------------------------------------------


@query("a1_read_csv", "select doc_id, lang, source, n_chars, text from documents")
def a1(spark, sf):
    """Write the documents as CSV, then read them with a missing first path."""
    path = scratch_path(spark, "csv")
    schema = "doc_id long, lang string, source string, n_chars long, text string"
    df = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    writer = df.write.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return S.read_csv(
        spark,
        [path + "-absent", path],
        schema,
        multi_line=True,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


@query("a1_shuffled_header", "select c_custkey, c_name, c_acctbal from customer")
def a1_shuffled(spark, sf):
    """A file with more columns, in another order, read in parallel splits."""
    path = scratch_path(spark, "csv")
    df = table(spark, sf, "customer").select("c_name", "c_mktsegment", "c_acctbal", "c_custkey")
    df.write.option("header", True).csv(path)
    return S.read_csv(spark, [path], "c_custkey long, c_name string, c_acctbal double")


@query("a2_read_parquet", "select page_id, url, length(html)::bigint as n_chars from pages")
def a2(spark, sf):
    df = S.read_parquet(spark, f"{sf}/pages.parquet")
    return df.select("page_id", "url", F.char_length("html").cast("long").alias("n_chars"))


REPORT_SQL = f"""
with {PRED},
c as (select l as label, count(*) filter (where k = 'tp') as tp, count(*) filter (where k <> 'p') as support,
             count(*) filter (where k <> 't') as predicted
      from (select y_true as l, 'tp' as k from pred where y_true = y_pred
            union all select y_true, 't' from pred where y_true <> y_pred
            union all select y_pred, 'p' from pred where y_true <> y_pred) group by 1),
m as (select label, coalesce(tp / nullif(predicted, 0), 0) as p, coalesce(tp / nullif(support, 0), 0) as r,
             coalesce(2 * tp / nullif(predicted + support, 0), 0) as f, support from c where support > 0),
t as (select sum(support) as s, avg(p) as mp, avg(r) as mr, avg(f) as mf, sum(p * support) / sum(support) as wp,
             sum(r * support) / sum(support) as wr, sum(f * support) / sum(support) as wf,
             (select count(*) filter (where y_true = y_pred) / count(*) from pred) as a from m),
rep as (select label, p, r, f, support::double as s from m
        union all select 'accuracy', a, a, a, a from t
        union all select 'macro avg', mp, mr, mf, s from t
        union all select 'weighted avg', wp, wr, wf, s from t)
"""


@query(
    "a5_export_report",
    REPORT_SQL
    + "select label, round(p, 2) as precision, round(r, 2) as recall, round(f, 2) as f1, round(s, 2) as support from rep",
)
def a5(spark, sf):
    """Rounded classification report through a CSV file."""
    cf = E.confusion(predictions(spark, sf).withColumn(DATASET, F.lit("all")), "y_true", "y_pred")
    report = E.classification_report(cf).drop(DATASET)
    path = scratch_path(spark, "export")
    S.export_report(report.drop("section"), path)
    return S.read_csv(spark, [path], "label string, precision double, recall double, f1 double, support double")


@query("a6_model_files")
def a6(spark, sf):
    """Save and reload the fitted feature stages; features must not change."""
    df = table(spark, sf, "documents").select("doc_id", "text")
    model = fit_tfidf(df, "text")
    path = scratch_path(spark, "model")
    S.save_model(model, path)
    back = S.load_model(path)
    a = model.transform(df).select("doc_id", F.col("features").alias("a"))
    b = back.transform(df).select("doc_id", F.col("features").alias("b"))
    return a.join(b, "doc_id").select("doc_id", (F.col("a") == F.col("b")).alias("same"))


@query(
    "a7_class_folders",
    f"""with {DS} select dataset, regexp_replace(lang || ' / ' || (doc_id % 3), '[^\\p{{L}}\\p{{N}}_-]+', '_', 'g') as class_safe,
        count(*) as n from ds group by all""",
)
def a7(spark, sf):
    """Folders per dataset and path-safe class name, read back."""
    df = doc_rows(spark, sf).select(
        "doc_id", DATASET, F.concat("lang", F.lit(" / "), (F.col("doc_id") % 3).cast("string")).alias("label")
    )
    path = scratch_path(spark, "by-class")
    S.write_by_class(df, path, DATASET, "label")
    return spark.read.parquet(path).groupBy(DATASET, "class_safe").agg(F.count(F.lit(1)).alias("n"))


# -- tokens and cleaning ------------------------------------------------------


@query(
    "b1_basic_tokens",
    f"""with {GAPPY} select doc_id, coalesce(len({basic_sql()}), 0)::bigint as n,
        coalesce(array_to_string({basic_sql()}, ' '), '') as tokens from gappy""",
)
def b1(spark, sf):
    t = X.basic_tokens("text")
    return gappy_rows(spark, sf).select(
        "doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens")
    )


@query(
    "b2_raw_tokens",
    f"""with {GAPPY} select doc_id, coalesce(len({split_sql('text')}), -1)::bigint as n_tokens, coalesce(length(text), -1)::bigint as n_chars from gappy""",
)
def b2(spark, sf):
    return gappy_rows(spark, sf).select(
        "doc_id",
        F.coalesce(X.n_tokens("text"), F.lit(-1)).alias("n_tokens"),
        F.coalesce(X.n_chars("text"), F.lit(-1)).alias("n_chars"),
    )


@query(
    "b3_word_tokens",
    f"""with w as (select doc_id, {words_sql()} as t from documents)
        select doc_id, array_to_string(t, ' ') as words, array_to_string({bigrams_sql('t')}, '|') as bigrams from w""",
)
def b3(spark, sf):
    from ..functions.stopwords import ENGLISH

    df = table(spark, sf, "documents").select("doc_id", X.word_tokens("text", ENGLISH).alias("t"))
    return df.select(
        "doc_id",
        F.array_join("t", " ").alias("words"),
        F.array_join(X.ngrams(F.col("t"), 2), "|").alias("bigrams"),
    )


@query(
    "b4_strip_punctuation",
    r"""select doc_id, regexp_replace(lower(text), '[!-/:-@\[\]^_`{|}~]', '', 'g') as clean from documents""",
)
def b4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.strip_punctuation("text").alias("clean"))


NAMES = ("The", "Et", "Der", "La")
_NAME_SQL = r"(^|[^\p{L}\p{N}_])(The|Et|Der|La)([^\p{L}\p{N}_]|$)"


@query(
    "b5_redact_names",
    f"""select doc_id, regexp_replace(regexp_replace(text, '{_NAME_SQL}', '\\1\\3', 'g'), '{_NAME_SQL}', '\\1\\3', 'g') as clean
        from documents""",
)
def b5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.redact_names("text", NAMES).alias("clean"))


@query(
    "b6_drop_dictionary",
    f"""with {GAPPY}, names as (select list(distinct lower(w)) as ws from (
          select unnest({split_sql('text')}) as w from benchmark) where length(w) >= 9)
        select doc_id, array_to_string(list_filter({split_sql('text')}, lambda x: not list_contains(ws, lower(x))), ' ') as text
        from gappy, names""",
)
def b6(spark, sf):
    """Dictionary of the long words of the benchmark table."""
    names = (
        table(spark, sf, "benchmark")
        .select(F.explode(X.raw_tokens("text")).alias("w"))
        .filter(F.char_length("w") >= 9)
    )
    return R.drop_names(gappy_rows(spark, sf).select("doc_id", "text"), "doc_id", "text", names, "w")


@query(
    "b6_drop_short_list",
    f"""select doc_id, array_to_string(list_filter({split_sql('text')}, lambda x: lower(x) not in ('the', 'le', 'und')), ' ') as text
        from documents""",
)
def b6_short(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.drop_words("text", ["the", "Le", "und"]).alias("text"))


@query("b7_collapse_repeats")
def b7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.collapse_repeats("text").alias("clean"))


@query(
    "b8_blank_emails",
    r"""select doc_id, regexp_replace(text, '[\p{L}\p{N}_][\p{L}\p{N}_.-]*@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]{2,4}\b', ' ', 'g') as clean
        from documents""",
)
def b8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.blank_emails("text").alias("clean"))


@query(
    "b9_lengths",
    f"""with {GAPPY} select doc_id, length(text)::bigint as text_length, len({split_sql('text')})::bigint as word_count from gappy where text is not null""",
)
def b9(spark, sf):
    return gappy_rows(spark, sf).filter("text IS NOT NULL").select(
        "doc_id", X.n_chars("text").alias("text_length"), X.n_tokens("text").alias("word_count")
    )


@query(
    "b10_to_datetime",
    """with t as (select event_id, case when event_id % 10 = 3 then 'no date' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as s
                  from events)
       select event_id, try_cast(s as timestamp) as at from t""",
)
def b10(spark, sf):
    s = F.when(F.col("event_id") % 10 == 3, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = table(spark, sf, "events").select("event_id", s.alias("s"))
    return df.select("event_id", to_datetime("s").alias("at"))


@query(
    "b11_usable_columns",
    f"""with {GAPPY}, d(dataset) as (values ('train'), ('test'), ('oot'), ('prod')),
        c(column_name) as (values ('doc_id'), ('text'), ('lang'), ('source'), ('half'), ('nothing'), ('seven'))
        select dataset, column_name as "column",
          case when column_name = 'nothing' and (select count(nothing) from gappy) = 0 then 'skipped' else 'used' end as status,
          case when column_name = 'nothing' and (select count(nothing) from gappy) = 0 then 'all values missing' end as reason
        from d, c""",
)
def b11(spark, sf):
    return quality.usable_columns(gappy(spark, sf))


_SHORT = """case when n <= 10 then '0-10' when n <= 20 then '11-20' when n <= 30 then '21-30'
            when n <= 50 then '31-50' when n <= 100 then '51-100' else '100+' end"""


@query(
    "b12_fixed_bucket",
    f"""with t as (select doc_id, len({split_sql('text')})::bigint as n from documents)
        select doc_id, n, {_SHORT} as bucket from t""",
)
def b12(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", X.n_tokens("text").alias("n"))
    return df.withColumn("bucket", X.fixed_bucket("n"))


@query(
    "b13_bucket_order",
    f"""with {DS}, t as (select dataset, case when len({split_sql('text')}) <= 100 then '0-100' when len({split_sql('text')}) <= 500 then '101-500'
           when len({split_sql('text')}) <= 1000 then '501-1000' else 'more' end as bucket from ds),
        o(bucket, position) as (values ('0-100', 1), ('101-500', 2), ('501-1000', 3))
        select dataset, bucket, position::int as position, count(*) as n from t join o using (bucket) group by all""",
)
def b13(spark, sf):
    """Buckets in display order; labels outside the order are left out."""
    bucket = X.fixed_bucket("n", (0, 100, 500, 1000, None), ("0-100", "101-500", "501-1000", "more"))
    df = doc_rows(spark, sf).select(DATASET, X.n_tokens("text").alias("n")).select(DATASET, bucket.alias("bucket"))
    df = df.withColumn("position", X.bucket_rank("bucket")).filter("position IS NOT NULL")
    return df.groupBy(DATASET, "bucket", "position").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b14_valid_rows",
    f"""with {GAPPY} select count(*) filter (where length(text) > 0 and length(lang) > 0) as kept,
        count(*) filter (where not coalesce(length(text) > 0 and length(lang) > 0, false)) as skipped from gappy""",
)
def b14(spark, sf):
    return R.validity_counts(gappy_rows(spark, sf), "text", "lang")


@query(
    "b15_column_plan",
    """select column_name as "column", case when data_type in ('BIGINT', 'INTEGER', 'DOUBLE') then 'continuous'
         when data_type = 'VARCHAR' then 'discrete' else 'datetime' end as family
       from duckdb_columns() where table_name = 'orders' and column_name <> 'o_orderkey'
       union all select 'o_orderkey', 'continuous' where false""",
)
def b15(spark, sf):
    df = table(spark, sf, "orders")
    plan = column_plan(df, df.filter("o_orderkey % 2 = 0"), ["o_orderkey"])
    return spark.createDataFrame([(c, k) for k, cols in plan.items() for c in cols], "column string, family string")


@query("b16_batches", "select doc_id, upper(source) as source, n_chars + 1 as n_chars from documents")
def b16(spark, sf):
    def shout(pdf):
        return pdf.assign(source=pdf["source"].str.upper(), n_chars=pdf["n_chars"] + 1)

    df = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return R.apply_batches(df, shout, df.schema, 128)


@query("b17_sample", "select doc_id, lang from documents order by (doc_id * 7919) % 10007, doc_id limit 500")
def b17(spark, sf):
    order = (F.col("doc_id") * 7919) % 10007
    return R.sample_rows(table(spark, sf, "documents"), "doc_id", 500, order=order).select("doc_id", "lang")


@query(
    "b18_stratified_split",
    """with r as (select doc_id, lang, row_number() over (partition by lang order by (doc_id * 7919) % 10007, doc_id) as r,
                   count(*) over (partition by lang) as n from documents)
       select doc_id, lang, case when (r - 1) / n < 0.8 - 1e-12 then 'train' else 'test' end as part from r""",
)
def b18_stratified(spark, sf):
    order = (F.col("doc_id") * 7919) % 10007
    df = table(spark, sf, "documents").select("doc_id", "lang")
    return R.stratified_split(df, "doc_id", "lang", [("train", 0.8), ("test", 0.2)], order)


@query(
    "b18_positional_split",
    """with r as (select o_orderkey, row_number() over (order by o_orderkey) as r, count(*) over () as n from orders)
       select o_orderkey, case when (r - 1) / n < 0.6 - 1e-12 then 'train' when (r - 1) / n < 0.8 - 1e-12 then 'val' else 'holdout' end as part from r""",
)
def b18_positional(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey")
    return R.positional_split(df, "o_orderkey", [("train", 0.6), ("val", 0.2), ("holdout", 0.2)])


@query(
    "b18_hash_split",
    """select doc_id, lang, case when ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 1000000 < 750000 then 'train' else 'test' end as part from documents""",
)
def b18_hash(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang")
    digest = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    return R.hash_split(df, "doc_id", [("train", 0.75), ("test", 0.25)], order=digest)


@query(
    "b19_label_codes",
    """with c as (select lang, (row_number() over (order by lang) - 1)::int as code from (select distinct lang from documents))
       select doc_id, lang, code from documents join c using (lang)""",
)
def b19(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang")
    return R.encode_labels(df, "lang", R.label_codes(df, "lang"))


@query(
    "b20_formatting",
    f"""with {PRED} select doc_id, coalesce(printf('%.4f', confidence), '-') as metric,
          coalesce(printf('%.1f', confidence * 100) || '%', '-') as pct, coalesce((case when doc_id % 5 > 0 then n_chars end)::varchar, '-') as cnt
        from pred""",
)
def b20(spark, sf):
    return predictions(spark, sf).select(
        "doc_id",
        metric_text("confidence").alias("metric"),
        percent_text("confidence").alias("pct"),
        count_text(F.when(F.col("doc_id") % 5 > 0, F.col("n_chars"))).alias("cnt"),
    )


# -- joins and set operations -------------------------------------------------

_TWO = """
c as (select dataset, l as label, count(*) filter (where k = 'tp') as tp, count(*) filter (where k <> 'p') as support,
             count(*) filter (where k <> 't') as predicted
      from (select dataset, y_true as l, 'tp' as k from pred where y_true = y_pred
            union all select dataset, y_true, 't' from pred where y_true <> y_pred
            union all select dataset, y_pred, 'p' from pred where y_true <> y_pred) group by 1, 2),
m as (select dataset, label, coalesce(tp / nullif(predicted, 0), 0) as p, coalesce(tp / nullif(support, 0), 0) as r,
             coalesce(2 * tp / nullif(predicted + support, 0), 0) as f, support from c),
acc as (select dataset, count(*) filter (where y_true = y_pred) / count(*) as a from pred group by 1),
t as (select dataset, sum(support) as s, avg(p) as mp, avg(r) as mr, avg(f) as mf, sum(p * support) / sum(support) as wp,
             sum(r * support) / sum(support) as wr, sum(f * support) / sum(support) as wf from m group by 1),
rep as (select dataset, label, p, r, f, support::double as s from m
        union all select dataset, 'accuracy', a, a, a, a from acc
        union all select dataset, 'macro avg', mp, mr, mf, s from t
        union all select dataset, 'weighted avg', wp, wr, wf, s from t)"""


@query(
    "c1_reports_side_by_side",
    f"""with {PRED}, {_TWO}
        select coalesce(a.label, b.label) as label,
          round(coalesce(a.p, 0), 3) as precision_val, round(coalesce(a.r, 0), 3) as recall_val, round(coalesce(a.f, 0), 3) as f1_val, round(coalesce(a.s, 0), 3) as support_val,
          round(coalesce(b.p, 0), 3) as precision_holdout, round(coalesce(b.r, 0), 3) as recall_holdout, round(coalesce(b.f, 0), 3) as f1_holdout, round(coalesce(b.s, 0), 3) as support_holdout
        from (select * from rep where dataset = 'test') a full join (select * from rep where dataset = 'oot') b on a.label = b.label""",
)
def c1(spark, sf):
    """Reports over the union of true and predicted labels, joined on class."""
    p = predictions(spark, sf)
    report = E.classification_report(E.confusion(p, "y_true", "y_pred"), labels="union")
    one = lambda d: report.filter(F.col(DATASET) == d)
    return E.report_side_by_side(one("test"), one("oot"), ("val", "holdout"))


@query(
    "c2_vocabulary_membership",
    f"""with {DS}, t as (select dataset, unnest({basic_sql()}) as token from ds),
        v as (select distinct token from t where dataset = 'train'),
        o as (select distinct token from t where dataset = 'oot')
        select token, token in (select token from v) as known from o""",
)
def c2(spark, sf):
    ds = docs(spark, sf)
    tok = lexical.token_counts(ds.long(["text"]), X.basic_tokens("text"))
    vocab = tok.filter("dataset = 'train'").select("token", F.lit(True).alias("known"))
    seen = tok.filter("dataset = 'oot'").select("token")
    return seen.join(vocab, "token", "left").select("token", F.coalesce("known", F.lit(False)).alias("known"))


@query(
    "c3_drop_conflicting_texts",
    """with t as (select doc_id, text, case when doc_id % 2 = 0 then lang else source end as label from documents),
       bad as (select text from t group by 1 having count(distinct label) > 1)
       select doc_id, label from t where text not in (select text from bad)""",
)
def c3(spark, sf):
    label = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.col("source"))
    df = table(spark, sf, "documents").select("doc_id", "text", label.alias("label"))
    return quality.drop_conflicting_texts(df, "text", "label").select("doc_id", "label")


@query(
    "c4_keep_listed",
    """with top as (select source from documents group by 1 order by count(*) desc, source limit 10)
       select doc_id, source from documents where source in (select source from top)""",
)
def c4(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "source")
    top = df.groupBy("source").count().orderBy(F.desc("count"), "source").limit(10)
    return R.keep_listed(df, "source", top, "source")


_TOP20 = f"""t as (select dataset, unnest({words_sql()}) as ngram from ds),
  c as (select dataset, ngram, count(*) as n from t group by all),
  tops as (select dataset, ngram, n, row_number() over (partition by dataset order by n desc, ngram) as rank from c qualify rank <= 20)"""


@query(
    "c5_common_terms",
    f"""with {DS}, {_TOP20} select b.dataset, count(*) as shared from tops a join tops b using (ngram)
        where a.dataset = 'train' and b.dataset <> 'train' group by all""",
)
def c5(spark, sf):
    tops = lexical.top_ngrams(docs(spark, sf), "text")
    ref = tops.filter("dataset = 'train'").select("ngram")
    return tops.filter("dataset <> 'train'").join(ref, "ngram").groupBy(DATASET).agg(F.count(F.lit(1)).alias("shared"))


@query(
    "c6_stack_sources",
    """select 'documents' as dataset, doc_id as id, text, lang from documents
       union all select 'benchmark', item_id, text, null from benchmark""",
)
def c6(spark, sf):
    ds = DatasetSet(
        {
            "documents": table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang"),
            "benchmark": table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"),
        }
    )
    return ds.long().select(DATASET, "id", "text", "lang")


@query(
    "c7_set_difference",
    """with u as (select distinct o_custkey from orders where o_orderpriority = '1-URGENT'),
            l as (select distinct o_custkey from orders where o_orderpriority = '5-LOW')
       select o_custkey, 'urgent only' as side from u where o_custkey not in (select o_custkey from l)
       union all select o_custkey, 'low only' from l where o_custkey not in (select o_custkey from u)""",
)
def c7(spark, sf):
    """Both one-sided differences of two key lists in one outer join."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority")

    def keys(priority, mark):
        return o.filter(F.col("o_orderpriority") == priority).select("o_custkey").distinct().withColumn(mark, F.lit(1))

    j = keys("1-URGENT", "a").join(keys("5-LOW", "b"), "o_custkey", "full_outer").filter("a IS NULL OR b IS NULL")
    return j.select("o_custkey", F.when(F.col("b").isNull(), "urgent only").otherwise("low only").alias("side"))


@query(
    "c8_class_weight_lookup",
    """with w as (select lang, count(*) / (select count(*) from documents) as share from documents group by 1)
       select doc_id, lang, round(share, 6) as share from documents join w using (lang)""",
)
def c8(spark, sf):
    from ..operators.common import attach_groups

    df = table(spark, sf, "documents").select("doc_id", "lang")
    shares = value_counts(DatasetSet({"all": df}), "lang", digits=None).select(
        F.col("value").alias("lang"), F.col("proportion").alias("share")
    )
    return attach_groups(df, shares, ["lang"]).select("doc_id", "lang", "share")

