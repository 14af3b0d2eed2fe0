import datetime as dt
import math

import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from corpusgauge.datasets import DatasetSet
from corpusgauge.operators import distributions as D
from corpusgauge.operators import drift
from corpusgauge.operators.quantiles import exact_quantiles


def linear_quantile(values, p):
    v = sorted(values)
    h = (len(v) - 1) * p
    lo, hi = math.floor(h), math.ceil(h)
    return v[lo] + (v[hi] - v[lo]) * (h - lo)


@pytest.mark.parametrize("small_group", [10**6, 0])
def test_exact_quantiles_with_a_hot_group(spark, small_group):
    """Both routes agree with the definition; one group holds most rows, one
    value is a third of them, a key and values are missing."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "cold").alias("k"),
        F.when(F.col("id") % 3 == 0, 5.0)
        .when(F.col("id") % 101 == 0, F.lit(float("nan")))
        .otherwise((F.col("id") * 7919 % 10007) / 3.0)
        .alias("x"),
        F.when(F.col("id") % 10 == 9, F.col("id")).alias("y"),
    )
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(r["k"], r["column"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["k"], ["x", "y"], probs, small_group).collect()}
    pdf = df.toPandas()
    for k, part in pdf.groupby(pdf["k"].fillna("none")):
        key = None if k == "none" else k
        for c in ("x", "y"):
            vals = [v for v in part[c] if v == v]
            for p in probs:
                if not vals:
                    assert (key, c, p) not in got
                else:
                    assert got[key, c, p] == pytest.approx(linear_quantile(vals, p)), (key, c, p)


@pytest.mark.parametrize("small_group", [10**6, 0])
def test_exact_quantiles_without_keys_and_rows(spark, small_group):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")
    assert rows(exact_quantiles(df, [], ["x"], [0.25], small_group)) == [("x", 0.25, 1.75)]
    assert exact_quantiles(df.filter("x > 9"), [], ["x"], [0.25], small_group).count() == 0


def ds_of(spark, schema="v string", **data):
    return DatasetSet({n: spark.createDataFrame([(x,) for x in v], schema) for n, v in data.items()})


def test_discrete_distribution(spark):
    ds = ds_of(spark, a=["x", "x", "y", None, "z"], b=[None, None])
    got = rows(D.discrete_distribution(ds, "v", 2))
    # proportions are over the kept rows; the all-missing dataset is left out
    assert got == [("a", 1, "x", 2, pytest.approx(2 / 3)), ("a", 2, "nan", 1, pytest.approx(1 / 3))]
    ordered = rows(D.discrete_distribution(ds, "v", 40, ["z", "q", "x"]), "rank", "category", "n")
    assert ordered == [(1, "z", 1), (2, "x", 2)]
    assert D.discrete_distribution(ds, "v", 40, ["q"]).count() == 0


def test_compare_discrete(spark):
    ds = ds_of(spark, a=["x", "x", "y", "w"], b=["y", "z"])
    got = by(D.compare_discrete(ds, "v"), ["category", "dataset"])
    assert got["z", "b"]["proportion"] == 0.5 and ("z", "a") not in got
    # mean over the datasets that have the category: x .5, z .5, y .375, w .25
    assert [k for k, _ in sorted({(c, got[c, d]["rank"]) for c, d in got}, key=lambda t: t[1])] == ["x", "z", "y", "w"]
    assert D.compare_discrete(ds_of(spark, a=["x"], b=[None]), "v").count() == 0


def test_histograms(spark):
    ds = ds_of(spark, "v double", a=[0.0, 1.0, 2.0, 4.0, None], b=[3.0, 3.0], c=[])
    got = by(D.histogram(ds, "v", 4), ["dataset", "bin"])
    assert [got["a", i]["n"] for i in range(4)] == [1, 1, 1, 1]
    assert [got["b", i]["n"] for i in range(4)] == [0, 0, 2, 0] and got["b", 0]["lo"] == 2.5
    assert sum(got["a", i]["density"] for i in range(4)) == pytest.approx(1.0)
    edges = by(D.histogram_on_edges(ds_of(spark, "v double", a=[0.0, 0.05, 0.06, 0.1, 1.0, 2.0, -1.0]), "v", [0, 0.05, 0.1, 1]), "label")
    assert {k: v["n"] for k, v in edges.items()} == {"[0.00 - 0.05)": 1, "[0.05 - 0.10)": 2, "[0.10 - 1.00]": 2}


def test_density_integrates_to_one(spark):
    ds = ds_of(spark, "v double", a=[float(i % 17) for i in range(300)], b=[1.0, 1.0])
    got = sorted((r["at"], r["density"]) for r in D.density_curve(ds, "v", 200).collect())
    step = got[1][0] - got[0][0]
    assert len(got) == 200 and sum(d for _, d in got) * step == pytest.approx(1.0, abs=0.01)


def test_box_stats_and_log_advice(spark):
    ds = ds_of(spark, "v double", a=[1.0, 2.0, 3.0, 4.0, 100.0, None], b=[0.0, 1.0], c=[1.0, 1.0, 200.0])
    got = by(D.box_stats(ds, "v"), "dataset")
    assert (got["a"]["q1"], got["a"]["median"], got["a"]["q3"]) == (2.0, 3.0, 4.0)
    assert (got["a"]["whisker_low"], got["a"]["whisker_high"], got["a"]["n_outliers"]) == (1.0, 4.0, 1)
    adv = by(D.log_scale_advice(D.box_stats(ds, "v")), "dataset")
    assert not adv["a"]["log_scale"] and adv["c"]["log_scale"] and adv["b"]["some_not_positive"]


def test_quantile_bins_merge_equal_edges(spark):
    ds = ds_of(spark, "v double", a=[1.0] * 6 + [2.0, 3.0, 4.0, 5.0], b=[7.0, 7.0])
    edges = D.quantile_edges(ds, "v")
    # ranks 0, 1.8, 3.6, 5.4, 7.2, 9: the first three edges coincide
    assert edges["a"] == [1.0, pytest.approx(1.4), pytest.approx(3.2), 5.0]
    got = by(D.quantile_bins(ds, "v"), ["dataset", "bin"])
    assert sum(v["n"] for k, v in got.items() if k[0] == "a") == 10
    assert sum(v["n"] for k, v in got.items() if k[0] == "b") == 2


def years(spark, *ys):
    return spark.createDataFrame([(dt.datetime(y, 5, 1),) for y in ys], "d timestamp_ntz")


def test_year_buckets(spark):
    ds = DatasetSet({"few": years(spark, 2000, 2002, 2002), "many": years(spark, *range(2000, 2017), 2020)})
    got = by(D.year_buckets(ds, "d"), ["dataset", "label"])
    assert {k[1]: v["n"] for k, v in got.items() if k[0] == "few"} == {"2000": 1, "2002": 2}
    many = {k[1]: v["n"] for k, v in got.items() if k[0] == "many"}
    assert many["2000-2001"] == 2 and many["2016-2017"] == 1 and many["2018-2019"] == 0 and many["2020-2021"] == 1


def test_pair_datetime_uses_the_joint_span(spark):
    ds = DatasetSet({"a": years(spark, 2000, 2001), "b": years(spark, 2016)})
    got = by(drift.pair_datetime(ds, "d"), ["dataset", "label"])
    assert got["a", "2000-2001"]["proportion"] == 1.0 and got["b", "2000-2001"]["proportion"] == 0.0
    assert len(got) == 2 * 9
    one = DatasetSet({"a": years(spark, 2000), "b": years(spark)})
    assert drift.pair_datetime(one, "d").count() == 0


def test_text_dates(spark):
    ds = ds_of(spark, a=["2020-01-05", "bad", None, "2020-01-31 10:00:00", "2021-03-01"])
    assert rows(D.month_counts(ds, "v")) == [("a", "2020-01", 2), ("a", "2021-03", 1)]


def test_pair_and_kl(spark):
    ds = ds_of(spark, a=["x"] * 3 + ["y"], b=["x"] * 2 + ["y"] * 2)
    kl = drift.kl_divergence(ds, "v", "a", "b", smoothing=0.0).head()["kl"]
    assert kl == pytest.approx(0.75 * math.log(1.5) + 0.25 * math.log(0.5))
    assert drift.kl_divergence(ds, "v", "a", "a").head()["kl"] == pytest.approx(0.0)
    num = ds_of(spark, "v double", a=[1.0, 2.0], b=[None])
    assert drift.pair_continuous(num, "v").count() == 0
    parts = drift.compare_pair(ds, "a", "b")
    assert list(parts["discrete"]) == ["v"]


def test_crosstab(spark):
    df = spark.createDataFrame([("p", "x"), ("p", "y"), ("p", "x"), ("q", "x"), (None, "x"), ("r", None)], "c string, t string")
    got = rows(D.crosstab_percent(DatasetSet({"a": df}), "c", "t", 1), "category", "target", "n", "pct")
    assert got == [("p", "x", 2, pytest.approx(200 / 3)), ("p", "y", 1, pytest.approx(100 / 3))]
