import datetime as dt
import math

import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from corpusgauge.operators import evaluation as E
from corpusgauge.plans.evaluate import evaluate_predictions


def pairs(spark, *data):
    return spark.createDataFrame(list(data), "dataset string, t string, p string")


def split(spark, dataset, true, pred):
    return pairs(spark, *[(dataset, a, b) for a, b in zip(true, pred)])


def test_two_reports_side_by_side(spark):
    """Validation true 0,1,1,0 predicted 0,1,0,0 against a holdout without
    class 1."""
    val = E.confusion(split(spark, "v", "0110", "0100"), "t", "p")
    hold = E.confusion(split(spark, "h", "0000", "0000"), "t", "p")
    report = lambda cf: E.classification_report(cf, labels="union")
    got = by(E.report_side_by_side(report(val), report(hold), ("val", "hold")), "label")
    m = lambda label, s: tuple(got[label][f"{c}_{s}"] for c in ("precision", "recall", "f1", "support"))
    assert m("0", "val") == (0.667, 1.0, 0.8, 2.0)
    assert m("1", "val") == (1.0, 0.5, 0.667, 2.0)
    assert m("1", "hold") == (0.0, 0.0, 0.0, 0.0)
    assert m("accuracy", "val") == (0.75,) * 4 and m("accuracy", "hold") == (1.0,) * 4
    assert m("macro avg", "val") == (0.833, 0.75, 0.733, 4.0)
    assert m("weighted avg", "hold") == (1.0, 1.0, 1.0, 4.0)


@pytest.fixture(scope="module")
def preds(spark):
    d = F.col("id")
    return spark.range(500).select(
        F.when(d % 4 == 0, "b").otherwise("a").alias("dataset"),
        F.element_at(F.array(*[F.lit(c) for c in "wxyz"]), (d % 4 + 1).cast("int")).alias("t0"),
        d,
    ).select(
        "dataset",
        F.when(d % 3 == 0, "w").otherwise(F.col("t0")).alias("t"),
        F.when(d % 5 == 0, "q").when(d % 7 == 0, "x").otherwise(F.col("t0")).alias("p"),
        F.when(d % 11 == 0, F.lit(float("nan"))).otherwise((d % 21) / 20).alias("c"),
        (d % 6).alias("g"),
        F.concat(F.lit("s"), (d % 3).cast("string")).alias("s"),
        d.alias("n"),
    )


def direct(part, classes):
    """Metrics counted row by row."""
    out = {"p": 0.0, "r": 0.0, "f": 0.0}
    for c in classes:
        tp = sum(1 for r in part if r["t"] == c == r["p"])
        pr = sum(1 for r in part if r["p"] == c)
        su = sum(1 for r in part if r["t"] == c)
        out["p"] += tp / pr / len(classes) if pr else 0
        out["r"] += tp / su / len(classes) if su else 0
        out["f"] += 2 * tp / (pr + su) / len(classes) if pr + su else 0
    return out


def test_overall_groups_and_thresholds_equal_a_row_count(spark, preds):
    data = preds.collect()
    cf = E.confusion(preds, "t", "p")
    overall = by(E.overall_metrics(cf), "dataset")
    groups = by(E.group_metrics(E.confusion(preds, "t", "p", ["dataset", "g"]), "g"), ["dataset", "g"])
    curve = by(E.threshold_curve(preds, "t", "p", "c"), ["dataset", "threshold"])
    for d in ("a", "b"):
        part = [r for r in data if r["dataset"] == d]
        classes = sorted({r["t"] for r in part})
        want = direct(part, classes)
        assert overall[d]["macro_precision"] == pytest.approx(want["p"])
        assert overall[d]["macro_recall"] == pytest.approx(want["r"])
        assert overall[d]["macro_f1"] == pytest.approx(want["f"])
        for g in range(6):
            here = [r for r in part if r["g"] == g]
            if not here:
                assert (d, g) not in groups
            elif len({r["t"] for r in here}) < 2:
                assert groups[d, g]["macro_precision"] is None
            else:
                assert groups[d, g]["macro_precision"] == pytest.approx(direct(here, classes)["p"])
        last = 1.1
        for i in range(1, 21):
            here = [r for r in part if r["c"] == r["c"] and r["c"] >= i / 20]
            row = curve[d, i / 20]
            assert row["n_covered"] == len(here) and row["coverage"] <= last
            last = row["coverage"]
            if len({r["t"] for r in here}) > 1:
                assert row["macro_f1"] == pytest.approx(direct(here, classes)["f"])
            else:
                assert row["macro_f1"] is None


def test_uncovered_thresholds_keep_their_rows(spark):
    df = spark.createDataFrame([("a", "x", "x", 0.3), ("a", "y", "x", None)], "dataset string, t string, p string, c double")
    got = by(E.threshold_curve(df, "t", "p", "c", [0.2, 0.9]), "threshold")
    assert got[0.2]["coverage"] == 0.5 and got[0.2]["accuracy"] == 1.0
    assert got[0.9]["n_covered"] == 0 and got[0.9]["accuracy"] is None and got[0.9]["coverage"] == 0.0


def test_year_buckets_with_and_without_tail(spark):
    df = spark.createDataFrame([("a", "x", "x", dt.date(y, 1, 1)) for y in range(2000, 2005)], "dataset string, t string, p string, d date")
    keep = by(E.metrics_by_year(df, "t", "p", "d", size=2), "group")
    assert {g: r["n"] for g, r in keep.items()} == {"2000-2001": 2, "2002-2003": 2, "2004-2004": 1}
    cut = by(E.metrics_by_year(df, "t", "p", "d", size=2, keep_tail=False), "group")
    assert set(cut) == {"2000-2001", "2002-2003"}
    wide = by(E.metrics_by_year(df, "t", "p", "d", start=1999, end=2001), "group")
    assert {g: r["n"] for g, r in wide.items()} == {"1999": 0, "2000": 1, "2001": 1}


def test_reliability_bins_are_right_closed(spark):
    df = spark.createDataFrame([("a", "x", "x", 0.1), ("a", "x", "y", 0.1000001), ("a", "x", "x", 1.0), ("a", "x", "x", None), ("a", "x", "x", 0.0)],
                               "dataset string, t string, p string, c double")
    got = by(E.reliability_curve(df, "t", "p", "c"), "bin")
    assert {b: r["n"] for b, r in got.items()} == {0: 2, 1: 1, 9: 1} and got[1]["share_correct"] == 0.0


def test_sampling_error_and_others(spark):
    true = ["a"] * 40 + ["b"] * 3 + ["junk"] * 2
    pred = ["a"] * 38 + ["b", "junk"] + ["b", "a", "c"] + ["a", "a"]
    cf = E.confusion(split(spark, "d", true, pred), "t", "p")
    err = E.sampling_error(cf, exclude=["junk"])
    got = by(err, "label")
    assert set(got) == {"a", "b", "c"}
    p = 38 / 41
    assert got["a"]["precision"] == pytest.approx(p)
    assert got["a"]["precision_high"] == pytest.approx(p + 1.959963984540054 * math.sqrt(p * (1 - p) / 41))
    assert got["c"]["recall"] is None and got["c"]["precision_n"] == 1
    merged = by(E.merge_small_classes(err), "label")
    assert set(merged) == {"a", "others"}
    assert merged["others"]["recall"] == pytest.approx(1 / 3) and merged["others"]["precision"] == pytest.approx((0.5 + 0) / 2)
    assert merged["others"]["count"] == 3
    assert E.merge_small_classes(E.sampling_error(cf, exclude=["a", "b", "c", "junk"])).count() == 0


def test_comparison_drops_reversed_repeats(spark, preds):
    overall = E.overall_metrics(E.confusion(preds, "t", "p"))
    got = E.compare_datasets(overall, [("a", "b"), ("b", "a")])
    assert got.count() == 4 and rows(got.select("first").distinct()) == [("a",)]


def test_population_weights(spark):
    cf = E.confusion(split(spark, "d", "0000112233", "0001110233"), "t", "p")
    shares = spark.createDataFrame([("0", 0.25), ("1", 0.25), ("2", 0.30), ("3", 0.20)], "label string, share double")
    got = E.population_weighted(cf, shares).head()
    want = 0.25 * 0.75 + 0.25 * 1.0 + 0.30 * 0.5 + 0.20 * 1.0
    assert got["weighted_accuracy"] == pytest.approx(want) and got["share_sum"] == pytest.approx(1.0)
    again = E.reweighted_accuracy(E.class_sample_weights(cf, shares)).head()["weighted_accuracy"]
    assert again == pytest.approx(want)


def test_scores(spark):
    one = E.confusion(split(spark, "d", "a", "a"), "t", "p")
    assert E.macro_precision_score(one, ["a", "b"]).head()["score"] == 1.0
    two = E.confusion(split(spark, "d", "ab", "aa"), "t", "p")
    assert E.macro_precision_score(two, ["a", "b"]).head()["score"] == 0.25
    assert E.exact_match_score(split(spark, "d", "az", "az"), "t", "p", ["a"]).head()["score"] == 0.5


def test_empty_predictions(spark, preds):
    cf = E.confusion(preds.filter("false"), "t", "p")
    assert E.overall_metrics(cf).count() == 0 and E.classification_report(cf).count() == 0
    assert E.threshold_curve(preds.filter("false"), "t", "p", "c").count() == 0


def test_evaluate_plan(spark, preds):
    parts = {d: preds.filter(F.col("dataset") == d).drop("dataset") for d in ("a", "b")}
    parts["b"] = parts["b"].drop("s")
    parts["none"] = spark.range(3)
    wide = preds.drop("dataset").withColumn("text_id", F.concat(F.lit("k"), F.col("n").cast("string")))
    parts["a"] = wide
    out = evaluate_predictions(parts, "t", "p", "c", ["s", "n", "text_id"], comparisons=[("a", "b")])
    skipped = rows(out["skipped"], "dataset", "column")
    assert ("none", "t,p,c") in skipped and ("b", "s") in skipped and ("a", "text_id") in skipped
    assert rows(out["by:s"].select("dataset").distinct()) == [("a",)]
    assert out["by:n"].filter("dataset = 'a'").count() == 5
    assert out["comparisons"].count() == 4 and out["by_threshold"].count() == 40
