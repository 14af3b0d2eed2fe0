"""Label clean-up, gates and input controls (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..datasets import DATASET
from ..functions import labels as Lb
from ..operators import controls as K
from ..operators import evaluation as E
from ..operators import vectors as V
from .registry import LANGS_SQL, PRED, SPACE_SQL, langs, predictions, query, table

_KINDS = """case doc_id % 8 when 0 then lang when 1 then 'Label: ' || upper(lang) || '.' when 2 then '  the category is "' || lang || '"'
  when 3 then lang || ' - surely' when 4 then 'unknown' when 5 then 'Category: ' || lang || ' ' || source when 6 then source || lang || ' and a rather long explanation'
  else 'predicted label: ' || lang || ';' end"""
RAW = f"raw as (select doc_id, lang, {_KINDS} as answer from documents)"
_CLASSES = LANGS_SQL


def raw_labels(spark, sf):
    """Free-text answers derived from the true language."""
    k, lang, source = F.col("doc_id") % 8, F.col("lang"), F.col("source")
    answer = (
        F.when(k == 0, lang)
        .when(k == 1, F.concat(F.lit("Label: "), F.upper(lang), F.lit(".")))
        .when(k == 2, F.concat(F.lit('  the category is "'), lang, F.lit('"')))
        .when(k == 3, F.concat(lang, F.lit(" - surely")))
        .when(k == 4, "unknown")
        .when(k == 5, F.concat(F.lit("Category: "), lang, F.lit(" "), source))
        .when(k == 6, F.concat(source, lang, F.lit(" and a rather long explanation")))
        .otherwise(F.concat(F.lit("predicted label: "), lang, F.lit(";")))
    )
    return table(spark, sf, "documents").select("doc_id", "lang", answer.alias("answer"))


_TRIM = f"'^{SPACE_SQL}|{SPACE_SQL}$', '', 'g'"
_PREFIX = "case " + " ".join(
    f"when starts_with(lower(a), '{p}') then regexp_replace(substring(a, {len(p) + 1}), {_TRIM})" for p in Lb.PREFIXES
) + " else a end"
K1_SQL = f"""{RAW}, k0 as (select *, regexp_replace(answer, {_TRIM}) as a from raw), k1 as (select * exclude (a), {_PREFIX} as a from k0),
k2 as (select * exclude (a), regexp_replace(regexp_replace(a, '[.,;"'']+$', ''), {_TRIM}) as a from k1),
k3 as (select doc_id, lang, answer, case when list_contains({_CLASSES}, a) then a
   when list_contains({_CLASSES}, lower(a)) then lower(a)
   when len(list_filter({_CLASSES}, lambda x: contains(lower(a), x) and length(a) - length(x) < 20)) > 0
     then list_filter({_CLASSES}, lambda x: contains(lower(a), x) and length(a) - length(x) < 20)[1] else a end as label from k2)"""


@query("k1_normalise_label", f"with {K1_SQL} select doc_id, answer, label from k3")
def k1(spark, sf):
    df = raw_labels(spark, sf)
    return df.select("doc_id", "answer", Lb.normalise_label("answer", langs(df)).alias("label"))


K2_SQL = f"""{RAW}, g as (select doc_id, lang, case when doc_id % 31 = 0 then null when doc_id % 37 = 0 then '  ' else answer end as answer from raw),
k0 as (select *, regexp_replace(answer, {_TRIM}) as a from g),
k2 as (select doc_id, lang, case when answer is null then 'MISSING_PRED' when a = '' then 'EMPTY_PRED' when list_contains({_CLASSES}, a) then a
  when len(list_filter({_CLASSES}, lambda x: contains(a, x))) > 0 then list_filter({_CLASSES}, lambda x: contains(a, x))[1] else a end as label from k0)"""


def _gaps(spark, sf):
    d = F.col("doc_id")
    return raw_labels(spark, sf).withColumn(
        "answer",
        F.when(d % 31 == 0, F.lit(None).cast("string")).when(d % 37 == 0, "  ").otherwise(F.col("answer")),
    )


@query("k2_match_label", f"with {K2_SQL} select doc_id, label from k2")
def k2(spark, sf):
    df = _gaps(spark, sf)
    return df.select("doc_id", Lb.match_label("answer", langs(df)).alias("label"))


@query(
    "k3_mark_invalid",
    f"with {K1_SQL} select doc_id, case when list_contains({_CLASSES}, label) and doc_id % 41 > 0 then label else 'INVALID_PREDICTION' end as label from k3",
)
def k3(spark, sf):
    """NULL labels stand for failed calls."""
    df = raw_labels(spark, sf)
    classes = langs(df)
    found = F.when(F.col("doc_id") % 41 > 0, Lb.normalise_label("answer", classes))
    return df.select("doc_id", Lb.mark_invalid(found, classes).alias("label"))


@query(
    "k3_report_with_invalid",
    f"""with {K1_SQL}, x as (select lang as y_true, case when list_contains({_CLASSES}, label) then label else 'INVALID_PREDICTION' end as y_pred from k3)
        , l as (select unnest(list_append({_CLASSES}, 'INVALID_PREDICTION')) as label),
        c as (select label, (select count(*) from x where y_true = label) as support, (select count(*) from x where y_pred = label) as predicted,
                     (select count(*) from x where y_true = label and y_pred = label) as tp from l)
        select label, support::double as support, predicted, round(coalesce(tp / nullif(predicted, 0), 0), 6) as precision,
          round(coalesce(tp / nullif(support, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(predicted + support, 0), 0), 6) as f1 from c""",
)
def k3_report(spark, sf):
    df = raw_labels(spark, sf)
    classes = langs(df)
    found = Lb.mark_invalid(Lb.normalise_label("answer", classes), classes)
    cf = E.confusion(df.select(F.lit("all").alias(DATASET), F.col("lang").alias("y_true"), found.alias("y_pred")), "y_true", "y_pred")
    report = E.classification_report(cf, labels=Lb.report_labels(classes)).filter("section = 0")
    predicted = E.class_counts(cf).select("label", "predicted")
    return report.join(predicted, "label", "left").select(
        "label", "support", F.coalesce("predicted", F.lit(0)).cast("long").alias("predicted"), "precision", "recall", "f1"
    )


@query(
    "k4_macro_precision",
    f"""with {K2_SQL}, l as (select unnest(list_append({_CLASSES}, 'it')) as c), p as (select c, coalesce((select count(*) filter (where lang = label) / nullif(count(*), 0) from k2 where label = c), 0) as p from l)
        select 'all' as dataset, (select count(*) from k2) as n, round(avg(p), 6) as score from p""",
)
def k4(spark, sf):
    """Over a fixed class list, one class of which never occurs."""
    df = _gaps(spark, sf)
    classes = langs(df)
    df = df.select(F.lit("all").alias(DATASET), F.col("lang").alias("t"), Lb.match_label("answer", classes).alias("p"))
    return E.macro_precision_score(E.confusion(df, "t", "p"), [*classes, "it"])


@query(
    "k5_exact_match",
    f"with {K1_SQL} select 'all' as dataset, count(*) as n, round(avg((list_contains({_CLASSES}, label) and label = lang)::int), 6) as score from k3",
)
def k5(spark, sf):
    df = raw_labels(spark, sf)
    classes = langs(df)
    df = df.select(F.lit("all").alias(DATASET), "lang", Lb.normalise_label("answer", classes).alias("label"))
    return E.exact_match_score(df, "lang", "label", classes)


@query(
    "k6_definition_text",
    """with c as (select lang, count(*) || ' documents' as d from documents group by 1)
       select 'Classes and what they mean:' || chr(10) || string_agg('- **' || lang || '**: ' || d || chr(10), '' order by lang) as definitions from c""",
)
def k6(spark, sf):
    c = table(spark, sf, "documents").groupBy("lang").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" documents")).alias("d")
    )
    return K.definition_text(c, "lang", "d")


@query(
    "k7_confidence_gate",
    f"""with {PRED} select dataset, case when confidence >= 0.5 then 'accept' else 'review' end as route, count(*) as n,
        round(avg((y_true = y_pred)::int), 6) as precision, round(count(*) / sum(count(*)) over (partition by dataset), 6) as coverage from pred group by 1, 2""",
)
def k7(spark, sf):
    return E.confidence_gate(predictions(spark, sf), "y_true", "y_pred", "confidence")


_CENTROIDS = """t as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
c as (select label::varchar as label, i, avg(x) as m, var_pop(x) as v from t where vec_id % 2 = 0 group by 1, 2)"""


def _centroids(spark, sf):
    return K.class_centroids(table(spark, sf, "embeddings").filter("vec_id % 2 = 0"), "embedding", "label")


@query(
    "k8_similarity_gate",
    f"""with {_CENTROIDS}, s as (select vec_id, c.label as nearest, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) as similarity from t join c using (i) group by 1, 2)
        select vec_id, nearest, round(similarity, 6) as similarity, case when similarity >= 0.3 then 'accept' else 'review' end as route from s
        qualify row_number() over (partition by vec_id order by similarity desc, nearest desc) = 1""",
)
def k8(spark, sf):
    """Centroids of one half of the vectors, gate on all of them."""
    return K.similarity_gate(table(spark, sf, "embeddings"), "embedding", _centroids(spark, sf), 0.3, ["vec_id"])


@query(
    "k8_distance_gate",
    f"""with {_CENTROIDS}, s as (select vec_id, c.label as nearest, sqrt(sum((x - m) * (x - m) / (v + 1e-9))) as distance from t join c using (i) group by 1, 2)
        select vec_id, nearest, round(distance, 6) as distance, case when distance <= 8 then 'accept' else 'review' end as route from s
        qualify row_number() over (partition by vec_id order by distance, nearest) = 1""",
)
def k8_distance(spark, sf):
    return K.distance_gate(table(spark, sf, "embeddings"), "embedding", _centroids(spark, sf), 8.0, ["vec_id"])


@query(
    "k8_nearest_vector",
    """with s as (select q.vec_id, t.vec_id as nearest, list_cosine_similarity(q.embedding::double[], t.embedding::double[]) as similarity
                  from embeddings q join embeddings t on q.vec_id % 2 = 1 and t.vec_id % 2 = 0),
            b as (select * from s qualify row_number() over (partition by vec_id order by round(similarity, 12) desc, nearest) = 1)
       select b.vec_id, nearest, round(similarity, 6) as similarity, label::varchar as label, case when similarity >= 0.3 then 'accept' else 'review' end as route
       from b join embeddings e on e.vec_id = nearest""",
)
def k8_nearest(spark, sf):
    """Vectors of odd number against those of even number."""
    v = table(spark, sf, "embeddings")
    found = V.nearest_vectors(v.filter("vec_id % 2 = 1"), v.filter("vec_id % 2 = 0"), "vec_id", "embedding")
    labels = v.select(F.col("vec_id").alias("nearest"), F.col("label").cast("string").alias("label"))
    route = F.when(F.col("similarity") >= 0.3, "accept").otherwise("review")
    return found.join(labels, "nearest", "left").select("vec_id", "nearest", "similarity", "label", route.alias("route"))


@query(
    "k8_covariance_gate",
    """with t as (select vec_id, label::varchar as label, embedding[1]::double as x, embedding[2]::double as y from embeddings),
       c as (select label, avg(x) as mx, avg(y) as my, var_pop(x) + 1e-9 as a, covar_pop(x, y) as b, var_pop(y) + 1e-9 as d from t where vec_id % 2 = 0 group by 1),
       s as (select vec_id, c.label as nearest, sqrt((d * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * d - b * b)) as distance from t, c)
       select vec_id, nearest, round(distance, 6) as distance, case when distance <= 1.5 then 'accept' else 'review' end as route from s
       qualify row_number() over (partition by vec_id order by distance, nearest) = 1""",
)
def k8_covariance(spark, sf):
    """Two coordinates, whose covariance SQL can invert; all of them in the tests."""
    v = table(spark, sf, "embeddings").withColumn("pair", F.slice("embedding", 1, 2))
    classes = V.class_covariances(v.filter("vec_id % 2 = 0"), "pair", "label")
    return V.class_distances(v, "vec_id", "pair", classes, 1.5)


@query(
    "k9_near_copies",
    """with w as (select doc_id as id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
    sets as (select id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) as g from w where len(w) >= 5),
    n as (select id, count(*) as n from sets group by 1),
    pairs as (select a.id, b.id as kept, count(*) as c from sets a join sets b on a.g = b.g and b.id < a.id group by all),
    found as (select pairs.id, kept, c / (x.n + y.n - c) as jaccard from pairs join n x on x.id = pairs.id join n y on y.id = kept)
    select id as doc_id, min(kept) as kept, round(arg_min(jaccard, kept), 6) as jaccard from found where jaccard >= 0.8 group by id""",
)
def k9(spark, sf):
    """Near copies among all documents; SQL compares all pairs that share a shingle."""
    return K.near_copies(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


_TYPO = """case when c_custkey % 3 = 0 then left(c_mktsegment, length(c_mktsegment) - 2) when c_custkey % 3 = 1 then c_mktsegment || 's'
  else replace(c_mktsegment, 'I', 'y') end"""


def _misspelt(spark, sf):
    k, seg = F.col("c_custkey") % 3, F.col("c_mktsegment")
    typo = (
        F.when(k == 0, F.substring(seg, F.lit(1), F.char_length(seg) - 2))
        .when(k == 1, F.concat(seg, F.lit("s")))
        .otherwise(F.replace(seg, F.lit("I"), F.lit("y")))
    )
    return table(spark, sf, "customer").select("c_custkey", typo.alias("typo"))


_STATUS = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"]


@query(
    "k10_closest_label",
    f"""with q as (select c_custkey, lower({_TYPO}) as a from customer),
       l(label, pos) as (values ('BUILDING', 0), ('AUTOMOBILE', 1), ('MACHINERY', 2), ('HOUSEHOLD', 3), ('FURNITURE', 4)),
       s as (select c_custkey, label, pos, levenshtein(a, lower(label))::int as distance from q, l)
       select c_custkey, distance, label from s qualify row_number() over (partition by c_custkey order by distance, pos) = 1""",
)
def k10(spark, sf):
    """Misspelt segments against the list of segments."""
    df = _misspelt(spark, sf).select("c_custkey", Lb.closest_label("typo", _STATUS).alias("x"))
    return df.select("c_custkey", "x.distance", "x.label")


@query(
    "k10_closest_word",
    """with w as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from documents),
       words as (select distinct unnest(w) as label from w),
       q as (select doc_id, case doc_id % 3 when 0 then w[-1][2:] when 1 then w[-1] || 'x' else w[-1] end as typo from w where len(w) > 0),
       d as (select distinct typo from q),
       s as (select typo, label, levenshtein(typo, label)::int as distance from d join words on abs(length(typo) - length(label)) <= 1),
       b as (select * from s where distance <= 1 qualify row_number() over (partition by typo order by distance, label) = 1)
       select doc_id, q.typo, b.label, b.distance from q left join b using (typo)""",
)
def k10_words(spark, sf):
    """The last word of every document, misspelt, against all words of the documents."""
    w = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    last, k = F.get("w", F.size("w") - 1), F.col("doc_id") % 3
    typo = F.when(k == 0, F.substring(last, F.lit(2), F.char_length(last))).when(k == 1, F.concat(last, F.lit("x"))).otherwise(last)
    asked = w.filter(F.size("w") > 0).select("doc_id", typo.alias("typo"))
    words = w.select(F.explode("w").alias("word")).distinct()
    return K.closest_labels(asked, "typo", words, "word", 1)
