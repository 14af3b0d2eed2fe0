"""Features, search, calibration and score vectors (J)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..datasets import DATASET
from ..operators import calibration as C
from ..operators import controls as K
from ..operators import evaluation as E
from ..operators import features, linear_search, tuning
from ..operators import rows as R
from ..session import cut_lineage
from .registry import doc_rows, query, table, words_sql

CLASSES = [f"c{i}" for i in range(10)]


@query(
    "j1_tfidf_terms",
    f"""with t as (select doc_id, unnest({words_sql()}) as term from documents), tf as (select doc_id, term, count(*) as tf from t group by 1, 2),
        v as (select term, count(*) as df from tf group by 1 having count(*) >= 2 order by sum(tf) desc, term limit 2000),
        w as (select doc_id, term, tf, df, tf * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as raw from tf join v using (term))
        select doc_id, term, tf, df, round(raw / sqrt(sum(raw * raw) over (partition by doc_id)), 6) as weight from w""",
)
def j1(spark, sf):
    return features.tfidf_terms(table(spark, sf, "documents"), "doc_id", "text", 2000, 2)


@query("j1_tfidf_vectors")
def j1_ml(spark, sf):
    """Spark ML features; every non-empty row has length 1."""
    df = table(spark, sf, "documents").select("doc_id", "text")
    model = features.fit_tfidf(df, "text", 2000)
    v = features.tfidf(model, df, "text").select("doc_id", vector_to_array("features").alias("v"))
    return v.select(
        "doc_id",
        F.size(F.filter("v", lambda x: x != 0)).alias("n_terms"),
        F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("length"),
    )


@query("j2_svd_points")
def j2(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    model = features.fit_tfidf(df, "text", 5000)
    points, values = features.svd_points(features.tfidf(model, df, "text"), "doc_id", "features")
    # the sign of a direction is free, its size is not
    return points.select(
        "doc_id",
        F.abs("x1").alias("size1"),
        F.abs("x2").alias("size2"),
        F.lit(values[0]).alias("sigma1"),
        F.lit(values[1]).alias("sigma2"),
    )


@query("j3_grid_search")
def j3(spark, sf):
    """The whole grid on the documents' language, every setting with its iterations."""
    df = doc_rows(spark, sf).select("doc_id", "text", "lang")
    codes = R.label_codes(df, "lang")
    split = R.stratified_split(df, "doc_id", "lang", [("train", 0.6), ("val", 0.2), ("holdout", 0.2)])
    split = R.encode_labels(split, "lang", codes).withColumnRenamed("part", DATASET)
    model = features.fit_tfidf(split.filter("dataset = 'train'"), "text", 2000)
    _, entries = features.stored_entries(features.tfidf(model, split, "text"), "features", [DATASET, "code"])
    cf, status = linear_search.search(
        entries.filter("dataset = 'train'"), entries.filter("dataset <> 'train'"), linear_search.whole_grid(), 2000
    )
    return tuning.score_counts(cf, status)


@query(
    "j4_class_weights",
    """select lang, count(*) as n, round((select count(*) from documents) / ((select count(distinct lang) from documents) * count(*)), 6) as weight from documents group by 1""",
)
def j4(spark, sf):
    return R.class_weights(table(spark, sf, "documents"), "lang")


_RUNS = """d as (select doc_id, lang, (case when doc_id % 10 < 6 then 'train' when doc_id % 10 < 8 then 'val' else 'holdout' end) as dataset from documents where doc_id % 10 >= 6),
x as (select 'a' as run, dataset, lang as y_true, case when doc_id % 7 = 0 then 'en' else lang end as y_pred from d
      union all select 'b', dataset, lang, case when doc_id % 3 = 0 then 'fr' when doc_id % 11 = 0 then 'xx' else lang end from d
      union all select 'c', dataset, lang, lang from d)"""


def _runs(spark, sf):
    d = F.col("doc_id")
    df = table(spark, sf, "documents").filter("doc_id % 10 >= 6").withColumn(
        DATASET, F.when(d % 10 < 8, "val").otherwise("holdout")
    )
    t = F.col("lang")
    runs = {
        "a": F.when(d % 7 == 0, "en").otherwise(t),
        "b": F.when(d % 3 == 0, "fr").when(d % 11 == 0, "xx").otherwise(t),
        "c": t,
    }
    cells = F.array(*[F.struct(F.lit(k).alias("run"), v.alias("y_pred")) for k, v in runs.items()])
    return df.select(DATASET, t.alias("y_true"), F.explode(cells).alias("x")).select(DATASET, "y_true", "x.*")


_SCORES = f"""{_RUNS}, c as (select run, dataset, l as label, count(*) filter (where k = 'tp') as tp, count(*) filter (where k <> 't') as predicted
   from (select run, dataset, y_true as l, 'tp' as k from x where y_true = y_pred union all select run, dataset, y_true, 't' from x where y_true <> y_pred
         union all select run, dataset, y_pred, 'p' from x where y_true <> y_pred) group by 1, 2, 3),
p as (select run, dataset, avg(coalesce(tp / nullif(predicted, 0), 0)) as mp from c group by 1, 2),
a as (select run, dataset, count(*) filter (where y_true = y_pred) / count(*) as acc from x group by 1, 2),
s as (select run, round(max(acc) filter (where dataset = 'val'), 6) as val_accuracy, round(max(mp) filter (where dataset = 'val'), 6) as val_macro_precision,
  round(max(acc) filter (where dataset = 'holdout'), 6) as holdout_accuracy, round(max(mp) filter (where dataset = 'holdout'), 6) as holdout_macro_precision from a join p using (run, dataset) group by 1)"""


@query("j5_score_runs", f"with {_SCORES} select * from s")
def j5(spark, sf):
    return tuning.score_runs(_runs(spark, sf))


@query("j5_best_run", f"with {_SCORES} select * from s order by holdout_accuracy desc, run limit 1")
def j5_best(spark, sf):
    scores = tuning.score_runs(_runs(spark, sf), rank_by="holdout_accuracy")
    return tuning.best_run(scores, "holdout_accuracy")


def _vectors(spark, sf):
    df = table(spark, sf, "embeddings")
    return df.select(
        "vec_id",
        F.col("label").cast("double").alias("code"),
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
    )


@query("j6_sigmoid_calibration")
def j6(spark, sf):
    """Out-of-fold sigmoid calibration: un-normalised and normalised
    probabilities of the held-out quarter of the vectors."""
    df = cut_lineage(_vectors(spark, sf))
    train, test = df.filter("vec_id % 4 <> 0"), df.filter("vec_id % 4 = 0").select("vec_id", "features")
    held, scored = C.fold_margins(train, test, "vec_id", CLASSES, 3)
    held, scored = cut_lineage(held), cut_lineage(scored)
    per_fold = C.apply_sigmoid(scored, C.fit_sigmoid(held))
    mean = C.normalise(C.average_folds(per_fold, "vec_id"), "vec_id")
    other = C.mean_of_normalised(per_fold, "vec_id").withColumnRenamed("p", "p_mean_of_normalised")
    return mean.join(other, ["vec_id", "class"])


@query("j6_isotonic_calibration")
def j6_isotonic(spark, sf):
    """Isotonic variant: monotone steps of every stratified fold and class, fitted on
    the fold's own margins and applied to the held-out quarter of the vectors."""
    df = cut_lineage(_vectors(spark, sf))
    train, test = df.filter("vec_id % 4 <> 0"), df.filter("vec_id % 4 = 0").select("vec_id", "features")
    held, scored = C.fold_margins(train, test, "vec_id", CLASSES, 3)
    held, scored = cut_lineage(held), cut_lineage(scored)
    pairs = [(f, c) for f in range(3) for c in CLASSES]
    return C.fit_apply_isotonic(held, scored, pairs).select("vec_id", "fold", "class", "p")


# scores of the ten classes: cosine to the class centroids, moved to 0..1
_SCORED = """t as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
  m as (select label as c, i, avg(x) as m from t group by 1, 2),
  q as (select vec_id, t.label, c, (sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) + 1) / 2 as p from t join m using (i) group by 1, 2, 3),
  e as (select vec_id, label, list(p order by c) as s from q group by 1, 2)"""
_CELLS = f"{_SCORED}, x as (select vec_id, label, 'c' || c as class, p from q)"


def _scores(spark, sf):
    """The score vector of every embedding, from all its coordinates."""
    df = table(spark, sf, "embeddings")
    near = K.class_centroids(df, "embedding", "label")
    vectors = {r["label"]: r["centroid"] for r in near.collect()}  # a row per class
    s = F.array(*[(K.cosine(F.col("embedding"), F.lit(vectors[str(c)])) + 1) / 2 for c in range(len(vectors))])
    return df.select("vec_id", "label", s.alias("s"))


def _cells(spark, sf):
    return _scores(spark, sf).select("vec_id", "label", F.posexplode("s").alias("i", "p")).select(
        "vec_id", F.concat(F.lit("c"), F.col("i").cast("string")).alias("class"), "p"
    )


@query(
    "j6_normalise",
    f"with {_CELLS} select vec_id, class, round(p, 6) as p, round(p / sum(p) over (partition by vec_id), 6) as p_norm from x",
)
def j6_normalise(spark, sf):
    return C.normalise(_cells(spark, sf), "vec_id")


@query(
    "j7_predicted_class",
    f"with {_CELLS} select vec_id, class as predicted, round(p, 6) as confidence from x qualify row_number() over (partition by vec_id order by p desc, class) = 1",
)
def j7(spark, sf):
    return C.predicted_class(_cells(spark, sf), "vec_id")


@query(
    "j7_top_classes",
    f"""with {_CELLS} select vec_id, (row_number() over (partition by vec_id order by p desc, class))::int as rank, class, round(p, 6) as p from x
        qualify row_number() over (partition by vec_id order by p desc, class) <= 5""",
)
def j7_top(spark, sf):
    top = C.top_classes(F.col("s"), CLASSES, 5)
    return _scores(spark, sf).select("vec_id", F.posexplode(top).alias("i", "x")).select(
        "vec_id", (F.col("i") + 1).alias("rank"), "x.class", "x.p"
    )


@query(
    "j7_probability_map",
    f"with {_CELLS} select vec_id, class, round(p, 6) as p from x",
)
def j7_map(spark, sf):
    df = _scores(spark, sf).select("vec_id", C.probability_map(F.col("s"), CLASSES).alias("m"))
    whole = df.select("vec_id", F.explode("m").alias("class", "p"))
    return whole.select("vec_id", "class", F.round("p", 6).alias("p"))


@query(
    "j8_arg_max_accuracy",
    f"""with {_SCORED} select 'all' as dataset, count(*) as n,
        round(count(*) filter (where list_position(s, list_max(s)) - 1 = label) / count(*), 6) as accuracy from e""",
)
def j8(spark, sf):
    df = _scores(spark, sf).select(F.lit("all").alias(DATASET), "label", C.arg_max(F.col("s")).alias("found"))
    return E.overall_metrics(E.confusion(df, "label", "found")).select(DATASET, "n", "accuracy")

