"""Classification evaluation (H)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..datasets import DATASET, DatasetSet
from ..operators import distributions
from ..operators import evaluation as E
from ..plans.evaluate import evaluate_predictions
from .registry import DATASETS, LANGS, PRED, predictions, query, table


def _cf(spark, sf):
    return E.confusion(predictions(spark, sf), "y_true", "y_pred")


def _counts(keys: str, src: str = "pred", name: str = "c") -> str:
    """SQL: tp, support and predicted per label."""
    return f"""{name} as (select {keys}, l as label, count(*) filter (where k = 'tp') as tp, count(*) filter (where k <> 'p') as support,
             count(*) filter (where k <> 't') as predicted
      from (select {keys}, y_true as l, 'tp' as k from {src} where y_true = y_pred
            union all select {keys}, y_true, 't' from {src} where y_true <> y_pred
            union all select {keys}, y_pred, 'p' from {src} where y_true <> y_pred) group by {keys}, l)"""


_RATES = """coalesce(tp / nullif(predicted, 0), 0) as p, coalesce(tp / nullif(support, 0), 0) as r, coalesce(2 * tp / nullif(predicted + support, 0), 0) as f"""

_OVERALL = f"""{_counts('dataset')},
m as (select *, {_RATES} from c where support > 0),
acc as (select dataset, count(*) as n, count(*) filter (where y_true = y_pred) / count(*) as a from pred group by 1),
o as (select dataset, any_value(n) as n, any_value(a) as accuracy, avg(p) as macro_precision, avg(r) as macro_recall, avg(f) as macro_f1,
        sum(p * support) / sum(support) as weighted_precision, sum(r * support) / sum(support) as weighted_recall,
        sum(f * support) / sum(support) as weighted_f1, count(*) as n_classes from m join acc using (dataset) group by 1)"""


def _round(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


_METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1")


@query(
    "h1_confusion",
    f"with {PRED} select dataset, y_true, y_pred, count(*) as n from pred group by 1, 2, 3",
)
def h1(spark, sf):
    return _cf(spark, sf)


@query(
    "h1_confusion_matrix",
    f"""with {PRED} select dataset, y_true, {", ".join(f"count(*) filter (where y_pred = '{c}') as {c}" for c in LANGS)},
        (case y_true when 'de' then 1 when 'en' then 2 when 'es' then 3 else 4 end)::int as position from pred group by 1, 2""",
)
def h1_matrix(spark, sf):
    cf = _cf(spark, sf)
    return E.confusion_matrix(cf, E.class_names(cf))


@query(
    "h2_overall",
    f"""with {PRED}, {_OVERALL} select dataset, n, {_round(*_METRICS, 'weighted_precision', 'weighted_recall', 'weighted_f1')}, n_classes from o""",
)
def h2(spark, sf):
    return E.overall_metrics(_cf(spark, sf))


_REPORT = """t as (select dataset, sum(support) as s from m group by 1),
rep as (select dataset, 0 as section, label, p as precision, r as recall, f as f1, support::double as support from m
  union all select dataset, 1, 'accuracy', accuracy, accuracy, accuracy, accuracy from o
  union all select dataset, 2, 'macro avg', macro_precision, macro_recall, macro_f1, s from o join t using (dataset)
  union all select dataset, 3, 'weighted avg', weighted_precision, weighted_recall, weighted_f1, s from o join t using (dataset))
select dataset, section, label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(support, 6) as support from rep"""


@query("h3_report_true_labels", f"with {PRED}, {_OVERALL}, {_REPORT}")
def h3(spark, sf):
    return E.classification_report(_cf(spark, sf))


@query(
    "h3_report_union_labels",
    f"with {PRED}, {_OVERALL.replace(' where support > 0', '')}, {_REPORT}",
)
def h3_union(spark, sf):
    return E.classification_report(_cf(spark, sf), labels="union")


@query(
    "h3_report_given_labels",
    f"""with {PRED}, {_counts('dataset', name='c0')}, c as (select g.dataset, g.label, coalesce(tp, 0) as tp, coalesce(support, 0) as support, coalesce(predicted, 0) as predicted
          from (select dataset, label from (select distinct dataset from pred), (values ('de'), ('en'), ('es'), ('fr'), ('it')) l(label)) g left join c0 using (dataset, label)),
        {_OVERALL.split('group by dataset, l)', 1)[1].lstrip(', ').replace(' where support > 0', '')}, {_REPORT}""",
)
def h3_given(spark, sf):
    return E.classification_report(_cf(spark, sf), labels=["de", "en", "es", "fr", "it"])


@query(
    "h4_class_accuracy",
    f"""with {PRED}, {_counts('dataset')}, t as (select dataset, count(*) as n from pred group by 1)
        select dataset, label, tp, predicted, support, n, round((n - (predicted + support - 2 * tp)) / n, 6) as accuracy
        from c join t using (dataset) where support > 0""",
)
def h4(spark, sf):
    return E.class_accuracy(_cf(spark, sf))


@query(
    "h4_micro_average",
    f"""with {PRED}, {_counts('dataset')} select dataset, sum(tp)::bigint as tp, sum(predicted)::bigint as predicted, sum(support)::bigint as support,
        round(sum(tp) / sum(predicted), 6) as precision, round(sum(tp) / sum(support), 6) as recall, round(2 * sum(tp) / (sum(predicted) + sum(support)), 6) as f1
        from c where support > 0 group by 1""",
)
def h4_micro(spark, sf):
    return E.micro_average(_cf(spark, sf))


def _group_sql(src: str, group: str) -> str:
    """Metrics by group, macro averages over the dataset's class list."""
    return f"""{_counts(f'dataset, {group}', src)},
k as (select dataset, count(distinct y_true) as k from {src} group by 1),
known as (select distinct dataset, y_true as label from {src}),
s as (select dataset, {group}, count(*) as n, count(*) filter (where y_true = y_pred) / count(*) as accuracy, count(distinct y_true) as kh from {src} group by 1, 2),
m as (select c.dataset, c.{group}, {_RATES} from c semi join known on c.dataset = known.dataset and c.label = known.label),
gm as (select s.dataset, s.{group}, any_value(n) as n, any_value(accuracy) as accuracy,
   case when any_value(n) >= 2 and any_value(kh) >= 2 then sum(p) / any_value(k) end as macro_precision,
   case when any_value(n) >= 2 and any_value(kh) >= 2 then sum(r) / any_value(k) end as macro_recall,
   case when any_value(n) >= 2 and any_value(kh) >= 2 then sum(f) / any_value(k) end as macro_f1
   from s join k on s.dataset = k.dataset join m on m.dataset = s.dataset and m.{group} = s.{group} group by s.dataset, s.{group})"""


@query(
    "h5_metrics_by_category",
    f"""with {PRED}, {_group_sql('pred', 'grp')}, g as (select distinct dataset, x.grp from pred, (values ('g0'), ('g1'), ('g2'), ('g3'), ('g4'), ('g9')) x(grp))
        select dataset, grp, coalesce(n, 0) as n, {_round(*_METRICS)} from g left join gm using (dataset, grp)""",
)
def h5(spark, sf):
    """A declared category without rows stays, with n = 0."""
    p = predictions(spark, sf)
    cats = [f"g{i}" for i in (0, 1, 2, 3, 4, 9)]
    groups = spark.createDataFrame([(d, c) for d in DATASETS for c in cats], f"{DATASET} string, grp string")
    return E.group_metrics(E.confusion(p, "y_true", "y_pred", [DATASET, "grp"]), "grp", groups)


def _year_bucket_sql(keep_tail: bool) -> str:
    tail = "'2006-2006'" if keep_tail else "null"
    return f"case when y <= 2001 then '2000-2001' when y <= 2003 then '2002-2003' when y <= 2005 then '2004-2005' else {tail} end"


@query(
    "h6_metrics_by_year",
    f"""with {PRED}, t as (select *, {_year_bucket_sql(True)} as "group" from (select *, year(seen) as y from pred)), {_group_sql('t', '"group"')}
        select dataset, "group", n, {_round(*_METRICS)} from gm""",
)
def h6(spark, sf):
    return E.metrics_by_year(predictions(spark, sf), "y_true", "y_pred", "seen", size=2)


@query(
    "h6_metrics_by_year_cut_tail",
    f"""with {PRED}, t as (select *, {_year_bucket_sql(False)} as "group" from (select *, year(seen) as y from pred)), {_group_sql('t', '"group"')}
        select dataset, "group", n, {_round(*_METRICS)} from gm where "group" is not null""",
)
def h6_cut(spark, sf):
    """Without the tail the years that do not fill a bucket form no group."""
    return E.metrics_by_year(predictions(spark, sf), "y_true", "y_pred", "seen", size=2, keep_tail=False)


@query(
    "h7_metrics_by_quantile_bin",
    f"""with {PRED}, q as (select dataset, quantile_cont(n_chars, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e from pred group by 1),
        g as (select dataset, unnest(range(5))::int as bin, e from q),
        t as (select p.*, (case when n_chars <= e[2] then 0 when n_chars <= e[3] then 1 when n_chars <= e[4] then 2 when n_chars <= e[5] then 3 else 4 end) as bin
              from pred p join q using (dataset)), {_group_sql('t', 'bin')}
        select dataset, bin, round(e[bin + 1], 6) as lo, round(e[bin + 2], 6) as hi, coalesce(n, 0) as n, {_round(*_METRICS)} from g left join gm using (dataset, bin)""",
)
def h7(spark, sf):
    p = predictions(spark, sf)
    edges = distributions.quantile_edges(DatasetSet.of_long(p, DATASETS), "n_chars")
    return E.metrics_by_bins(p, "y_true", "y_pred", "n_chars", edges)


_CURVE = f"""x as (select *, i / 20 as threshold from pred, range(1, 21) r(i) where confidence >= i / 20),
{_counts('dataset, threshold', 'x')},
k as (select dataset, count(*) as total, count(distinct y_true) as k from pred group by 1),
known as (select distinct dataset, y_true as label from pred),
s as (select dataset, threshold, count(*) as n, count(*) filter (where y_true = y_pred) / count(*) as accuracy, count(distinct y_true) as kh from x group by 1, 2),
m as (select c.dataset, c.threshold, {_RATES} from c semi join known on c.dataset = known.dataset and c.label = known.label),
mm as (select dataset, threshold, sum(p) as sp, sum(r) as sr, sum(f) as sf from m group by 1, 2),
curve as (select k.dataset, g.i / 20 as threshold, coalesce(n, 0) / total as coverage, coalesce(n, 0) as n_covered, accuracy,
  case when kh > 1 then sp / k end as macro_precision, case when kh > 1 then sr / k end as macro_recall, case when kh > 1 then sf / k end as macro_f1
  from k cross join range(1, 21) g(i) left join s on s.dataset = k.dataset and s.threshold = g.i / 20 left join mm on mm.dataset = k.dataset and mm.threshold = g.i / 20)"""


@query(
    "h8_threshold_curve",
    f"with {PRED}, {_CURVE} select dataset, {_round('threshold', 'coverage')}, n_covered, {_round(*_METRICS)} from curve",
)
def h8(spark, sf):
    return E.threshold_curve(predictions(spark, sf), "y_true", "y_pred", "confidence")


@query(
    "h9_threshold_table",
    f"""with {PRED}, {_CURVE} select dataset, printf('%.2f', threshold) as threshold, coalesce(printf('%.4f', accuracy), '-') as accuracy,
        coalesce(printf('%.4f', macro_precision), '-') as macro_precision, printf('%.1f', coverage * 100) || '%' as coverage, n_covered::varchar as n_covered from curve""",
)
def h9(spark, sf):
    return E.threshold_table(E.threshold_curve(predictions(spark, sf), "y_true", "y_pred", "confidence"))


@query(
    "h9_group_table",
    f"""with {PRED}, {_group_sql('pred', 'grp')} select dataset, grp as "group", n::varchar as samples, coalesce(printf('%.4f', accuracy), '-') as accuracy,
        coalesce(printf('%.4f', macro_precision), '-') as macro_precision from gm""",
)
def h9_group(spark, sf):
    cf = E.confusion(predictions(spark, sf), "y_true", "y_pred", [DATASET, "grp"])
    return E.group_table(E.group_metrics(cf, "grp"), "grp")


@query(
    "h10_confidence_flags",
    f"""with {PRED}, x as (select dataset, case when doc_id % 97 = 0 then 1.5 else confidence end as confidence from pred)
        select dataset, count(*) as n, count(*) filter (where confidence < 0 or confidence > 1) as n_outside, count(*) - count(confidence) as n_missing,
          count(*) filter (where confidence < 0 or confidence > 1) > 0 as any_outside, count(*) > count(confidence) as any_missing from x group by 1""",
)
def h10(spark, sf):
    p = predictions(spark, sf)
    c = F.when(F.col("doc_id") % 97 == 0, 1.5).otherwise(F.col("confidence"))
    return E.confidence_flags(p.withColumn("confidence", c), "confidence")


@query(
    "h11_class_lists",
    f"""with {PRED}, x as (select * from pred where not (dataset = 'oot' and y_true = 'es')),
        l as (select dataset, list_sort(list(distinct y_true)) as c from x group by 1)
        select dataset, len(c)::int as n_classes, array_to_string(c, ',') as classes, c = (select c from l where dataset = 'train') as same_as_first from l""",
)
def h11(spark, sf):
    p = predictions(spark, sf).filter("NOT (dataset = 'oot' AND y_true = 'es')")
    return E.class_list_check(E.confusion(p, "y_true", "y_pred"), DATASETS)


@query(
    "h12_reliability_curve",
    f"""with {PRED} select dataset, {" + ".join(f"(confidence > {i} / 10)::int" for i in range(1, 10))} as bin, count(*) as n,
        round(avg(confidence), 6) as mean_confidence, round(avg((y_true = y_pred)::int), 6) as share_correct
        from pred where confidence is not null group by 1, 2""",
)
def h12(spark, sf):
    return E.reliability_curve(predictions(spark, sf), "y_true", "y_pred", "confidence")


@query(
    "h13_compare_datasets",
    f"""with {PRED}, {_OVERALL}, v as (unpivot (select dataset, accuracy, macro_precision, macro_recall, macro_f1 from o)
          on accuracy, macro_precision, macro_recall, macro_f1 into name metric value value),
        p(first, second) as (values ('train', 'test'), ('test', 'oot'), ('oot', 'prod'), ('prod', 'next')),
        q as (select *, unnest(['accuracy', 'macro_precision', 'macro_recall', 'macro_f1']) as metric from p),
        d as (select first, second, q.metric, a.value as value_first, b.value as value_second, b.value - a.value as change
              from q left join v a on a.dataset = first and a.metric = q.metric left join v b on b.dataset = second and b.metric = q.metric),
        k as (select first, second, change as kpi from d where metric = 'macro_precision')
        select first, second, metric, round(value_first, 6) as value_first, round(value_second, 6) as value_second, round(change, 6) as change,
          case when second = 'next' then 'absent' when kpi < -0.03 then 'degraded' when kpi > 0.03 then 'higher' else 'similar' end as verdict from d join k using (first, second)""",
)
def h13(spark, sf):
    pairs = [("train", "test"), ("test", "oot"), ("oot", "prod"), ("test", "train"), ("prod", "next")]
    return E.compare_datasets(E.overall_metrics(_cf(spark, sf)), pairs)


Z = NormalDist().inv_cdf(0.975)
_ERR = f"""{_counts('dataset')}, r as (select *, tp / nullif(support, 0) as recall, tp / nullif(predicted, 0) as precision from c where label <> 'es'),
e as (select dataset, label, recall, sqrt(recall * (1 - recall) / nullif(support, 0)) as recall_se, support as recall_n, precision,
        sqrt(precision * (1 - precision) / nullif(predicted, 0)) as precision_se, predicted as precision_n from r)"""
_ERR_COLS = f"""round(recall, 6) as recall, round(recall_se, 6) as recall_se, round(recall_se * {Z!r}, 6) as recall_error, recall_n::bigint as recall_n,
  round(precision, 6) as precision, round(precision_se, 6) as precision_se, round(precision_se * {Z!r}, 6) as precision_error, precision_n::bigint as precision_n,
  round(precision - precision_se * {Z!r}, 6) as precision_low, round(precision + precision_se * {Z!r}, 6) as precision_high"""


@query("h14_sampling_error", f"with {PRED}, {_ERR} select dataset, label, {_ERR_COLS} from e")
def h14(spark, sf):
    return E.sampling_error(_cf(spark, sf), exclude=["es"])


@query(
    "h15_small_classes_merged",
    f"""with {PRED}, {_ERR}, u as (select * from e where recall_n >= 30 and precision_n >= 30
          union all select dataset, 'others', avg(recall), avg(recall_se), sum(recall_n), avg(precision), avg(precision_se), sum(precision_n)
          from e where not (recall_n >= 30 and precision_n >= 30) group by dataset)
        select dataset, label, {_ERR_COLS}, recall_n::bigint as count from u""",
)
def h15(spark, sf):
    return E.merge_small_classes(E.sampling_error(_cf(spark, sf), exclude=["es"]))


_SHARES = "w as (select lang as label, count(*) / (select count(*) from documents where doc_id % 10 < 6) as share from documents where doc_id % 10 < 6 group by 1)"


def _shares(spark, sf):
    """Class shares of the training documents stand in for the population."""
    ds = DatasetSet({"all": table(spark, sf, "documents").filter("doc_id % 10 < 6").select("lang")})
    return distributions.value_counts(ds, "lang", digits=None).select(
        F.col("value").alias("label"), F.col("proportion").alias("share")
    )


@query(
    "h16_population_weighted",
    f"""with {PRED}, {_SHARES}, {_counts('dataset')}, m as (select *, {_RATES} from c where support > 0)
        select dataset, round(sum(share * r), 6) as weighted_accuracy, round(sum(share * p), 6) as weighted_precision, round(sum(share * f), 6) as weighted_f1,
          round(sum(share), 6) as share_sum, count(*) - count(share) as missing_classes from m left join w using (label) group by 1""",
)
def h16(spark, sf):
    return E.population_weighted(_cf(spark, sf), _shares(spark, sf))


_WEIGHTS = f"""{_SHARES}, s as (select dataset, y_true as label, count(*) as support, count(*) filter (where y_true = y_pred) as correct from pred group by 1, 2),
t as (select dataset, count(*) as total from pred group by 1),
ww as (select s.dataset, label, support, correct, total, share, share * total / support as weight from s join t using (dataset) left join w using (label))"""


@query(
    "h17_sample_weights",
    f"with {PRED}, {_WEIGHTS} select dataset, label, support, correct, total, {_round('share', 'weight')} from ww",
)
def h17(spark, sf):
    return E.class_sample_weights(_cf(spark, sf), _shares(spark, sf))


@query(
    "h17_reweighted_accuracy",
    f"with {PRED}, {_WEIGHTS} select dataset, round(sum(weight * correct) / sum(weight * support), 6) as weighted_accuracy, count(*) - count(weight) as missing_classes from ww group by 1",
)
def h17_accuracy(spark, sf):
    return E.reweighted_accuracy(E.class_sample_weights(_cf(spark, sf), _shares(spark, sf)))


@query(
    "h17_class_without_share",
    f"""with {PRED}, {_WEIGHTS.replace('where doc_id % 10 < 6 group by 1)', "where doc_id % 10 < 6 and lang <> 'es' group by 1)")}
        select dataset, round(sum(weight * correct) / sum(weight * support), 6) as weighted_accuracy, count(*) - count(weight) as missing_classes from ww group by 1""",
)
def h17_without_share(spark, sf):
    """A class that the population's shares leave out is counted, not lost."""
    shares = _shares(spark, sf).filter("label <> 'es'")
    return E.reweighted_accuracy(E.class_sample_weights(_cf(spark, sf), shares))


def _half(p):
    """Twelve own categories per dataset, numbers kept as text, and a time."""
    k = F.col("doc_id") % 12
    return p.select(
        "*", F.concat(F.col(DATASET), k.cast("string")).alias("own"), (F.col("n_chars") / 2).cast("string").alias("half")
    )


@query(
    "h5_categories_per_dataset",
    f"""with {PRED}, o as (select * exclude (grp), dataset || (doc_id % 12) as "group" from pred), {_group_sql('o', '"group"')}
        select dataset, "group", n, {_round(*_METRICS)} from gm""",
)
def h5_own(spark, sf):
    """Every dataset has twelve categories of its own, 48 together."""
    p = DatasetSet.of_long(_half(predictions(spark, sf)), DATASETS)
    return evaluate_predictions(p, "y_true", "y_pred", "confidence", ["own"])["by:own"]


@query(
    "h7_numbers_kept_as_text",
    f"""with {PRED}, u as (select * replace (n_chars / 2 as n_chars) from pred),
        q as (select dataset, quantile_cont(n_chars, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e from u group by 1),
        g as (select dataset, unnest(range(5))::int as bin, e from q),
        t as (select p.*, (case when n_chars <= e[2] then 0 when n_chars <= e[3] then 1 when n_chars <= e[4] then 2 when n_chars <= e[5] then 3 else 4 end) as bin
              from u p join q using (dataset)), {_group_sql('t', 'bin')}
        select dataset, bin, round(e[bin + 1], 6) as lo, round(e[bin + 2], 6) as hi, coalesce(n, 0) as n, {_round(*_METRICS)} from g left join gm using (dataset, bin)""",
)
def h7_text(spark, sf):
    p = DatasetSet.of_long(_half(predictions(spark, sf)), DATASETS)
    return evaluate_predictions(p, "y_true", "y_pred", "confidence", ["half"])["by:half"]


@query(
    "h7_columns_that_cannot_be_grouped",
    f"""with {PRED} select distinct dataset, c as "column", case c when 'seen' then 'timestamp_ntz cannot be grouped' else 'text with too many values to group, not all of them numbers' end as reason
        from pred, (values ('seen'), ('key')) t(c)""",
)
def h7_skipped(spark, sf):
    """A time, and text of many words, become rows of ``skipped``."""
    p = predictions(spark, sf).withColumn("key", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    return evaluate_predictions(DatasetSet.of_long(p, DATASETS), "y_true", "y_pred", "confidence", ["seen", "key"])["skipped"]


@query(
    "h18_lift_over_chance",
    f"""with {PRED}, {_OVERALL} select dataset, n_classes, round(1 / n_classes, 6) as chance, round(macro_precision, 6) as macro_precision,
        round(macro_precision * n_classes, 6) as lift from o""",
)
def h18(spark, sf):
    return E.lift_over_chance(E.overall_metrics(_cf(spark, sf)))


@query(
    "h18_other_class_share",
    f"with {PRED} select doc_id, round((1 - confidence) / 39, 6) as other_share from pred",
)
def h18_share(spark, sf):
    return predictions(spark, sf).select("doc_id", E.other_class_share(F.col("confidence"), 40).alias("other_share"))
