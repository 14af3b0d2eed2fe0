import math

import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from corpusgauge.datasets import DatasetSet
from corpusgauge.operators import language as La
from corpusgauge.operators import lexical as L
from corpusgauge.plans.profile import compare_named, profile_datasets, profile_table


def texts(spark, **data):
    return DatasetSet({n: spark.createDataFrame([(t,) for t in v], "text string") for n, v in data.items()})


def test_oov(spark):
    ds = texts(spark, train=["the cat sat", "A cat", None], test=["The dog sat sat", ""], empty=[None])
    got = by(L.oov_rates(ds, "text", "train"), "dataset")
    assert (got["test"]["tokens"], got["test"]["oov_tokens"]) == (4, 1)
    assert got["test"]["oov_token_pct"] == 25.0 and got["test"]["oov_word_pct"] == pytest.approx(100 / 3)
    assert got["empty"]["oov_token_pct"] is None and got["empty"]["oov_word_pct"] is None
    assert rows(L.vocabulary_size(ds, "text", "train")) == [("train", 4, 5)]
    vocab = spark.createDataFrame([("The",), ("sat",), ("sat",)], "token string")
    rate = by(L.oov_rate_against(ds, "text", vocab), "dataset")
    assert rate["test"]["oov_rate"] == 25.0 and rate["train"]["oov_rate"] == 80.0


def test_diversity(spark):
    ds = texts(spark, a=["x x y z", None], none=[""])
    got = by(L.diversity(ds, "text"), "dataset")
    entropy = -(0.5 * math.log2(0.5) + 2 * 0.25 * math.log2(0.25))
    assert got["a"]["total_tokens"] == 4 and got["a"]["ttr"] == 0.75 and got["a"]["hapax_ratio"] == 0.5
    assert got["a"]["shannon_entropy"] == pytest.approx(entropy)
    assert tuple(got["none"].values())[1:] == (0, 0, 0.0, 0.0, 0.0)


def test_ttr_by_class_skips_small_classes(spark):
    df = spark.createDataFrame([("the dog dog cat", "A")] * 3 + [("x y", "B"), (None, "B")], "text string, c string")
    got = rows(L.type_token_ratio_by_class(DatasetSet({"train": df}), "text", "c", 2), "label", "words", "tokens", "ttr")
    assert got == [("A", 2, 9, pytest.approx(200 / 9))]


def test_top_ngrams_and_overlap(spark):
    ds = texts(spark, train=["red fox runs", "red fox"], test=["red fox sleeps", "the red hen"])
    uni = L.top_ngrams(ds, "text", 1, 2)
    assert rows(uni) == [("test", 1, "red", 2), ("test", 2, "fox", 1), ("train", 1, "fox", 2), ("train", 2, "red", 2)]
    assert rows(L.top_ngrams(ds, "text", 2, 1)) == [("test", 1, "fox sleeps", 1), ("train", 1, "red fox", 2)]
    assert rows(L.dataset_overlap(uni, "train")) == [("test", 2, 2, 100.0)]


def test_class_overlap_covers_classes_of_both_sides(spark):
    s = "dataset string, c string, ngram string"
    tops = spark.createDataFrame(
        [("train", "A", "x"), ("train", "A", "y"), ("train", "B", "x"), ("test", "A", "x"), ("test", "C", "x")], s
    )
    got = by(L.class_overlap(tops, "train", ["test"], "c"), "c")
    assert {c: r["overlap_text"] for c, r in got.items()} == {"A": "50.0%", "B": "0.0%", "C": "0.0%"}


def test_language(spark):
    train = spark.createDataFrame(
        [("the house and the garden are here", "en"), ("das haus und der garten sind hier", "de")], "t string, l string"
    )
    langs = ["de", "en"]
    profile = La.language_profile(train, "t", "l", langs)
    df = spark.createDataFrame([(1, "the garden"), (2, "der garten und"), (3, "12 34!"), (4, None), (5, "")], "id int, t string")
    got = {r["id"]: r["language"] for r in La.detect_language(df, "id", "t", profile, langs).collect()}
    assert got == {1: "en", 2: "de", 3: "error", 4: None, 5: "error"}


def test_hot_token_is_merged_before_the_shuffle(spark):
    """One token making up most of the corpus is one row per task afterwards."""
    df = spark.range(2000).select(F.lit("t").alias("dataset"), F.lit("hot hot cold").alias("text"))
    from corpusgauge.functions.text import basic_tokens

    plan = L.token_counts(df, basic_tokens("text"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert rows(L.token_counts(df, basic_tokens("text"))) == [("t", "cold", 2000), ("t", "hot", 4000)]


def test_whole_profiles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        F.col("text").alias("processed_text"),
        F.col("lang").alias("RCC"),
        F.col("source").alias("LOB"),
        F.col("n_chars").alias("number of tokens"),
        F.make_timestamp_ntz(
            (F.lit(2000) + F.col("doc_id") % 20).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)
        ).alias("FileModifiedTime"),
        F.when(F.col("n_chars") < 500, "0-100").otherwise("101-500").alias("token bucket"),
        F.concat(F.lit("e"), (F.col("doc_id") % 3).cast("string")).alias("file extension"),
    )
    parts = {
        "train": docs.filter("doc_id % 10 < 6"),
        "test": docs.filter("doc_id % 10 in (6, 7)"),
        "prod": docs.filter("doc_id % 10 > 7").drop("RCC", "LOB"),
    }
    out = profile_datasets(parts, analyze_ngrams=True, comparisons=[("train", "prod")])
    assert {"oov", "ttr_by_class", "bigrams_class_overlap", "years:FileModifiedTime", "crosstab"} <= set(out)
    for name, table in out.items():
        assert table.limit(1).count() <= 1, name
    assert rows(out["target_counts"].select("dataset").distinct()) == [("test",), ("train",)]
    one = profile_table(docs.limit(60), "processed_text", "RCC", "FileModifiedTime", ["LOB"], docs, "processed_text", "RCC", "doc_id")
    assert one["languages"].count() > 0 and one["months"].count() > 0
    side = compare_named([parts["train"], parts["test"]], ["Train", "Test"], "processed_text", "RCC", ["LOB"], key="doc_id")
    assert side["points:Train"].count() == parts["train"].count()
    with pytest.raises(ValueError):
        compare_named([docs], ["a", "b"])


def test_ngrams_are_counted_in_pieces_of_the_texts(spark, monkeypatch):
    from corpusgauge.operators import common

    df = spark.range(20_000).selectExpr("id", "concat('w', id % 7, ' hen fox') as text")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert common.spread(df, size // 40).rdd.getNumPartitions() >= 40
    ds = DatasetSet({"train": df, "test": df})
    before = rows(L.top_ngrams(ds, "text", 2, 3))
    monkeypatch.setattr(L, "NGRAM_PIECE", size // 10)
    assert rows(L.top_ngrams(ds, "text", 2, 3)) == before and before[0][3] == 20_000
