import math
import threading

import pytest
from conftest import by, rows
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from corpusgauge.catalog import QUERIES
from corpusgauge.operators import calibration as C
from corpusgauge.operators import controls as K
from corpusgauge.operators import features, tuning
from corpusgauge.session import cut_lineage


def test_tfidf_vectors_equal_the_long_form(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    long = features.tfidf_terms(df, "doc_id", "text", 300).groupBy("doc_id").agg(F.sum("weight").alias("a"), F.count("*").alias("n"))
    # a larger cap on the vectors' side would change ties at the cut, so compare without a cut
    long = features.tfidf_terms(df, "doc_id", "text", 10**6).groupBy("doc_id").agg(F.sum("weight").alias("a"))
    model = features.fit_tfidf(df, "text", 10**6)
    v = vector_to_array(F.col("features"))
    ml = features.tfidf(model, df, "text").select("doc_id", F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("b"))
    bad = ml.join(long, "doc_id", "left").filter(F.abs(F.coalesce("a", F.lit(0.0)) - F.col("b")) > 1e-9)
    assert bad.count() == 0
    assert features.tfidf(model, spark.createDataFrame([(1, None)], "doc_id int, text string"), "text").count() == 1


def test_svd_points(spark):
    import numpy as np

    x = np.array([[3.0, 0, 1, 0], [0, 2, 0, 1], [1, 1, 0, 0], [0, 0, 4, 1], [2, 0, 0, 0]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, a array<double>")
    pts, sigma = features.svd_points(df.select("id", array_to_vector("a").alias("features")), "id", "features")
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert sigma == pytest.approx(list(s[:2]))
    for r in pts.collect():
        assert abs(r["x1"]) == pytest.approx(abs(x[r["id"]] @ vt[0]), abs=1e-9)
        assert abs(r["x2"]) == pytest.approx(abs(x[r["id"]] @ vt[1]), abs=1e-9)


def test_sigmoid_fit_is_a_minimum(spark):
    df = spark.range(3000).select(
        F.lit(0).alias("fold"),
        F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("class"),
        ((F.col("id") * 7919 % 1000) / 250.0 - 2.0).alias("margin"),
        F.col("id"),
    ).withColumn("positive", (F.col("margin") * 1.5 - 0.5 + (F.col("id") * 31 % 97) / 48.0 - 1.0) > 0)
    params = by(C.fit_sigmoid(cut_lineage(df)), "class")
    data = df.collect()
    for name, p in params.items():
        part = [r for r in data if r["class"] == name]
        np_, nn = sum(r["positive"] for r in part), sum(not r["positive"] for r in part)
        hi, lo = (np_ + 1) / (np_ + 2), 1 / (nn + 2)
        ga = gb = 0.0
        for r in part:
            q = 1 / (1 + math.exp(p["a"] * r["margin"] + p["b"]))
            d = (hi if r["positive"] else lo) - q
            ga, gb = ga + r["margin"] * d, gb + d
        assert abs(ga) < 1e-4 and abs(gb) < 1e-4 and p["a"] < 0


def test_fold_calibration_properties(spark):
    df = spark.range(90).select(
        F.col("id").alias("k"),
        (F.col("id") % 3).cast("double").alias("code"),
        array_to_vector(
            F.array(*[F.when(F.col("id") % 3 == i, 2.0).otherwise(0.0) + (F.col("id") * (i + 3) % 11) / 10.0 for i in range(3)])
        ).alias("features"),
    )
    train, test = df.filter("k < 60"), df.filter("k >= 60").select("k", "features")
    held, scored = C.fold_margins(train, test, "k", ["a", "b", "c"], 2, max_iter=10)
    held, scored = cut_lineage(held), cut_lineage(scored)
    assert held.count() == 60 * 3 and scored.count() == 30 * 3 * 2
    p = C.apply_sigmoid(scored, C.fit_sigmoid(held))
    assert p.filter("p < 0 OR p > 1 OR p IS NULL").count() == 0
    total = C.normalise(C.average_folds(p, "k"), "k").groupBy("k").agg(F.sum("p_norm").alias("s"))
    assert total.filter("abs(s - 1) > 1e-9").count() == 0
    other = C.mean_of_normalised(p, "k").groupBy("k").agg(F.sum("p").alias("s"))
    assert other.filter("abs(s - 1) > 1e-9").count() == 0
    right = C.predicted_class(C.average_folds(p, "k"), "k").filter("predicted = substr('abc', int(k % 3) + 1, 1)").count()
    assert right >= 27


def test_score_vectors(spark):
    df = spark.createDataFrame([(1, [0.2, 0.5, 0.5]), (2, [0.9, 0.05, 0.05])], "id int, s array<double>")
    top = df.select(C.top_classes(F.col("s"), ["a", "b", "c"], 2).alias("t"), C.arg_max(F.col("s")).alias("m")).collect()
    assert [(x["class"], x["p"]) for x in top[0]["t"]] == [("b", 0.5), ("c", 0.5)] and [r["m"] for r in top] == [1, 0]


def test_grid_keeps_failures_as_rows(spark):
    df = spark.range(60).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, "holdout").when(F.col("id") % 3 == 1, "val").otherwise("train").alias("dataset"),
        (F.col("id") % 2).cast("double").alias("code"),
        array_to_vector(F.array((F.col("id") % 2).cast("double"), F.lit(1.0))).alias("features"),
    )
    grid = [tuning.Setting(1.0, 10, False), tuning.Setting(1.0, 10, True, "l1"), tuning.Setting(1.0, 1, False, "l0")]
    preds, status = tuning.grid_predictions(df.filter("dataset = 'train'"), df.filter("dataset <> 'train'"), grid, "k")
    scores = tuning.score_runs(preds, status).collect()
    assert scores[-1]["error"].startswith("ValueError") and scores[-1]["val_accuracy"] is None
    assert scores[0]["val_accuracy"] == 1.0
    assert tuning.best_run(tuning.score_runs(preds, status)).count() == 1
    assert len(tuning.full_grid()) == 96


def test_gates(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.2]), ("b", [0.0, 1.0]), ("b", [0.1, 1.0])], "l string, v array<double>")
    c = K.class_centroids(df, "v", "l")
    new = spark.createDataFrame([(1, [2.0, 0.1]), (2, [-1.0, -1.0]), (3, [0.0, 0.0])], "id int, v array<double>")
    got = by(K.similarity_gate(new, "v", c, 0.9, ["id"]), "id")
    assert (got[1]["nearest"], got[1]["route"]) == ("a", "accept")
    assert got[2]["route"] == "review" and got[3]["similarity"] is None and got[3]["route"] == "review"
    far = by(K.distance_gate(new, "v", c, 3.0, ["id"], epsilon=0.01), "id")
    assert far[2]["route"] == "review"
    text = K.definition_text(spark.createDataFrame([("B", "two"), ("A", "one")], "n string, d string"), "n", "d").head()[0]
    assert text == "Classes and what they mean:\n- **A**: one\n- **B**: two\n"


def test_model_files(spark, tmp_path):
    from corpusgauge.sources.tables import load_model, save_model

    df = spark.createDataFrame([("red fox",), ("red hen",), ("blue hen",)], "text string")
    m = features.fit_tfidf(df, "text", 10, min_df=1, stop_words=["zz"])
    save_model(m, str(tmp_path / "m"))
    assert rows(m.transform(df), "features") == rows(load_model(str(tmp_path / "m")).transform(df), "features")


def test_isotonic_query_scores_held_out_vectors_for_all_classes(spark, sf_dir, monkeypatch):
    def margins(train, test, key, classes, folds):
        """Margins from all coordinates, without the fits of the classifiers."""
        assert train.join(test, key).count() == 0 and len(train.first()["features"]) == 64
        names = F.array(*[F.lit(c) for c in classes])
        long = lambda df: df.select("*", F.posexplode(vector_to_array("features")).alias("i", "margin"))
        tagged = train.withColumn("fold", (F.col(key) % folds).cast("int"))
        held = long(tagged).filter(F.col("i") < len(classes)).withColumn("class", names[F.col("i")])
        held = held.select(key, "fold", "class", "margin", (F.col("code") == F.col("i")).alias("positive"))
        scored = long(test).filter(F.col("i") < len(classes)).withColumn("class", names[F.col("i")])
        scored = scored.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(folds)])))
        return held, scored.select(key, "fold", "class", "margin")

    monkeypatch.setattr(C, "fold_margins", margins)
    got = QUERIES["j6_isotonic_calibration"](spark, sf_dir).select("vec_id", "fold", "class").collect()
    held_out = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 4 = 0").count()
    assert {r["class"] for r in got} == {f"c{i}" for i in range(10)} and {r["fold"] for r in got} == {0, 1, 2}
    assert len(got) == 30 * held_out and all(r["vec_id"] % 4 == 0 for r in got)


def test_terms_are_weighed_after_one_shuffle_of_the_texts(spark):
    data = [(1, "red red fox"), (1, "fox hen"), (2, "hen hen fox"), (None, "red"), (None, "red fox"), (3, None), (4, "")]
    df = spark.createDataFrame(data, "k int, text string")
    out = features.tfidf_terms(df, "k", "text", 100, 2)
    # repeated and NULL keys are one text each
    counts = {(r["k"], r["term"]): (r["tf"], r["df"]) for r in out.collect()}
    assert counts == {
        (1, "red"): (2, 2), (1, "fox"): (2, 3), (1, "hen"): (1, 2), (2, "hen"): (2, 2), (2, "fox"): (1, 3), (None, "red"): (2, 2), (None, "fox"): (1, 3),
    }
    lengths = out.groupBy("k").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in lengths)
    # a row per text and term never travels
    plan = out._jdf.queryExecution().executedPlan().toString()
    travels = [line for line in plan.splitlines() if "hashpartitioning(k" in line]
    assert travels and not any("term" in line for line in travels)


def test_folds_are_fitted_side_by_side_in_few_tasks(spark, monkeypatch):
    together = threading.Barrier(3, timeout=60)
    tasks, fit = [], C.fit_margins

    def fit_together(train, **how):
        together.wait()
        tasks.append(train.rdd.getNumPartitions())
        return fit(train, **how)

    monkeypatch.setattr(C, "fit_margins", fit_together)
    monkeypatch.setattr(C, "cut_lineage", lambda df: df.repartition(32))
    code = (F.col("id") % 2).cast("double")
    df = spark.range(60).select("id", code.alias("code"), array_to_vector(F.array(code, F.lit(1.0))).alias("features"))
    held, scored = C.fold_margins(df, df.select("id", "features"), "id", ["even", "odd"], 3, max_iter=20)
    assert tasks == [C.FIT_TASKS] * 3
    assert held.count() == 120 and scored.count() == 360
    # every row's own class has the greater margin, in a fold that has not seen the row
    assert held.filter("positive <> (margin > 0)").count() == 0
    # a larger table gets more tasks
    monkeypatch.setattr(C, "FIT_BYTES", 64)
    assert C.in_fit_tasks(df.repartition(32)).rdd.getNumPartitions() == 15
