import math

import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from corpusgauge.datasets import DatasetSet, column_plan
from corpusgauge.operators import quality as Q
from corpusgauge.operators import rows as R
from corpusgauge.plans.profile import audit_datasets


@pytest.fixture(scope="module")
def frames(spark):
    """Tables with known defects."""
    schema = "processed_text string, constant_col long, high_card_col string, all_nan double, RCC string"
    nan = float("nan")
    train = [
        ("text a", 1, "id_0", nan, "ClassA"),
        ("Text B about models", 1, "id_1", nan, "ClassB"),
        ("text b about Models", 1, "id_2", nan, "ClassC"),
        ("text c", 1, "id_3", nan, "ClassA"),
        (None, 1, "id_4", nan, "ClassB"),
        ("text b about models", 1, "id_5", nan, None),
        ("Text B about models", 1, "id_1", nan, "ClassB"),
    ]
    test = [("x", 5, "a", nan, "A"), ("y", 5, "b", nan, "B"), ("X", 5, "c", nan, "A"), ("z", 5, "d", nan, "C"), ("x", 5, "e", nan, "A")]
    prod = [(f"doc {i}", 9, f"p{i}", nan) for i in range(100)]
    return {
        "train": spark.createDataFrame(train, schema),
        "test": spark.createDataFrame(test, schema),
        "prod_small": spark.createDataFrame(prod, schema.rsplit(",", 1)[0]),
    }


def test_audit(frames):
    out = audit_datasets(frames, "processed_text", "RCC")
    dup = by(out["row_duplicates"], "dataset")
    assert (dup["train"]["n_duplicates"], dup["train"]["pct_duplicates"], dup["train"]["n_unique"]) == (1, 14.29, 6)
    assert dup["test"]["n_duplicates"] == 0 and dup["prod_small"]["n_unique"] == 100
    txt = by(out["text_duplicates"], "dataset")
    assert (txt["train"]["n_duplicates"], txt["train"]["pct_duplicates"], txt["train"]["n_unique"]) == (3, 50.0, 3)
    assert (txt["test"]["n_duplicates"], txt["test"]["pct_duplicates"], txt["test"]["n_unique"]) == (2, 40.0, 3)
    assert rows(out["conflict_summary"]) == [("test", 1, 0), ("train", 1, 1)]
    assert rows(out["conflict_examples"]) == [("train", 1, "text b about models", "ClassB, ClassC")]
    assert rows(out["all_null_columns"], "dataset", "column") == [(d, "all_nan") for d in ("prod_small", "test", "train")]
    assert rows(out["zero_variance"], "dataset", "column") == [(d, "constant_col") for d in ("prod_small", "test", "train")]
    assert rows(out["high_cardinality"], "dataset", "column", "n_distinct") == [
        ("prod_small", "high_card_col", 100), ("prod_small", "processed_text", 100)
    ]
    assert rows(out["shape"]) == [("prod_small", 100, 4), ("test", 5, 5), ("train", 7, 5)]


def test_absent_and_all_null_columns_are_told_apart(frames):
    status = by(Q.usable_columns(DatasetSet(frames)), ["dataset", "column"])
    assert status["prod_small", "RCC"]["reason"] == "column absent"
    assert status["train", "all_nan"]["reason"] == "all values missing"
    assert status["train", "RCC"]["status"] == "used"


def test_row_digest_does_not_run_values_together(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "c"), ("~", "c"), ("1:c", None)], "x string, y string")
    d = by(Q.row_duplicates(DatasetSet({"t": df})), "dataset")["t"]
    assert d["n_duplicates"] == 0
    z = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "x double")
    assert by(Q.row_duplicates(DatasetSet({"t": z})), "dataset")["t"]["n_unique"] == 2


def test_describe(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "b"), (4.0, None), (float("nan"), "c")], "x double, s string")
    ds = DatasetSet({"t": df})
    d = Q.describe_numeric(ds).head().asDict()
    assert (d["count"], d["mean"], d["q25"], d["q50"], d["q75"], d["min"], d["max"]) == (4, 2.5, 1.75, 2.5, 3.25, 1.0, 4.0)
    assert math.isclose(d["std"], 1.2909944487358056)
    t = Q.describe_text(ds).head().asDict()
    assert (t["count"], t["unique"], t["top"], t["freq"]) == (4, 3, "b", 2)


def test_empty_and_all_null_inputs(spark):
    empty = spark.createDataFrame([], "processed_text string, x double, RCC string")
    ds = DatasetSet({"train": empty, "test": spark.createDataFrame([(None, None, None)], empty.schema)})
    assert by(Q.shapes(ds), "dataset")["train"]["n_rows"] == 0
    assert rows(Q.row_duplicates(ds), "dataset", "n_rows") == [("test", 1)]
    assert Q.text_duplicates(ds, "processed_text").count() == 0
    assert Q.label_conflicts(ds, "processed_text", "RCC").count() == 0
    assert Q.zero_variance_columns(ds).count() == 0
    assert rows(Q.describe_numeric(ds), "dataset", "count", "q50") == [("test", 0, None)]
    assert Q.describe_text(ds).count() == 0


def test_drop_conflicting_texts(spark):
    df = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("A", "x"), ("b", "x"), ("b", "x"), (None, "x"), (None, "y")], "text string, label string"
    )
    assert rows(Q.drop_conflicting_texts(df, "text", "label")) == [("A", "x"), ("b", "x"), ("b", "x"), (None, "x"), (None, "y")]


def test_dataset_set_checks(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        DatasetSet([df], ["a", "b"])
    with pytest.raises(KeyError):
        DatasetSet({"a": df}).only(["b"])


def test_column_plan(spark):
    a = spark.createDataFrame([], "n int, s string, d timestamp, m int, t string, only_a int")
    b = spark.createDataFrame([], "n double, s string, d date, m string, t string")
    assert column_plan(a, b, ["t"]) == {"continuous": ["n"], "discrete": ["s"], "datetime": ["d"], "skipped": ["m"]}


def test_valid_rows(spark):
    df = spark.createDataFrame([("a", "x"), ("", "x"), (None, "x"), ("a", None)], "t string, l string")
    assert R.validity_counts(df, "t", "l").head() == (1, 3)
    assert R.require_valid(df, "t", "l").count() == 1
    with pytest.raises(ValueError):
        R.require_valid(df.filter("t IS NULL"), "t", "l")


def test_splits(spark):
    df = spark.range(1000).withColumn("label", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")))
    got = R.stratified_split(df, "id", "label", [("train", 0.8), ("test", 0.2)])
    assert got.count() == 1000
    bad = (
        got.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("part") == "train").cast("int")).alias("k"))
        .filter(F.col("k") != F.ceil(F.col("n") * 0.8 - 1e-9))
    )
    assert bad.count() == 0
    again = R.stratified_split(df.repartition(9), "id", "label", [("train", 0.8), ("test", 0.2)])
    assert got.exceptAll(again.select(got.columns)).count() == 0
    # unevenly spaced keys
    keys = spark.range(500).selectExpr("case when id < 499 then id else 4611686018427387904 end as id")
    pos = R.positional_split(keys, "id", [("a", 0.6), ("b", 0.2), ("c", 0.2)]).groupBy("part").agg(F.count("*"), F.min("id"), F.max("id"))
    assert rows(pos) == [("a", 300, 0, 299), ("b", 100, 300, 399), ("c", 100, 400, 4611686018427387904)]
    shares = R.hash_split(df, "id", [("train", 0.75), ("test", 0.25)]).groupBy("part").count()
    assert abs(dict(rows(shares))["train"] - 750) < 60


def test_labels_and_weights(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "id int, l string")
    codes = R.label_codes(df, "l")
    assert rows(codes) == [("a", 0), ("b", 1)]
    assert rows(R.encode_labels(df, "l", codes), "id", "code") == [(1, 1), (2, 0), (3, 1), (4, None)]
    assert rows(R.class_weights(df, "l"), "l", "weight") == [("a", 1.5), ("b", 0.75)]


def test_sample_is_reproducible(spark):
    df = spark.range(500)
    a = rows(R.sample_rows(df, "id", 50))
    assert a == rows(R.sample_rows(df.repartition(7), "id", 50)) and len(a) == 50
    assert a != rows(R.sample_rows(df, "id", 50, seed=1))
