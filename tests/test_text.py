from pyspark.sql import functions as F

from corpusgauge.functions import formatting, labels
from corpusgauge.functions import text as X
from corpusgauge.functions.stopwords import ENGLISH
from corpusgauge.operators import rows as R


def one(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_stop_words_are_sparks_default(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")


def test_tokens(spark):
    got = one(spark, X.basic_tokens("t"), "  The\tcat Sat\n", "", None, "   ", "Été")
    assert got == [["the", "cat", "sat"], [], [], [], ["été"]]
    assert one(spark, X.raw_tokens("t"), "The cat") == [["The", "cat"]]
    assert one(spark, X.word_tokens("t", ENGLISH), "The cat's a Café_1!", None) == [["cat", "café_1"], []]


def test_whitespace_split_agrees_with_python(spark):
    text = "a\x1cb c　d\x85e​f\x0bg h"
    assert one(spark, X.raw_tokens("t"), text) == [text.split()]


def test_ngrams(spark):
    toks = X.basic_tokens("t")
    assert one(spark, X.ngrams(toks, 2), "a b c", "a", "", None) == [["a b", "b c"], [], [], []]
    assert one(spark, X.ngrams(toks, 3), "a b c d", "a b") == [["a b c", "b c d"], []]


def test_punctuation_keeps_the_backslash(spark):
    assert one(spark, X.strip_punctuation("t"), r"A.b\c, [d]^`{e}|~!", None) == [r"ab\c de", None]


def test_redact_names(spark):
    got = one(spark, X.redact_names("t", ["Al", "C.J.", "Éve"]), "Al met Alan, Éve", "al", "Éver")
    assert got == [" met Alan, ", "al", "Éver"]
    assert one(spark, X.redact_names("t", []), "Al") == ["Al"]


def test_drop_words(spark):
    assert one(spark, X.drop_words("t", ["Bob"]), "BOB and bob  ran", "bob", None) == ["and ran", "", None]


def test_drop_names_join_keeps_rows_without_tokens(spark):
    df = spark.createDataFrame([(1, "Bob and Ann"), (2, "ann"), (3, None), (4, "x  y"), (5, "")], "id int, t string")
    names = spark.createDataFrame([("ANN",), ("bob",), (None,)], "n string")
    got = {r["id"]: r["t"] for r in R.drop_names(df, "id", "t", names, "n").collect()}
    assert got == {1: "and", 2: "", 3: None, 4: "x y", 5: ""}


def test_repeats_and_emails_are_idempotent(spark):
    e = X.collapse_repeats("t")
    assert one(spark, e, "the the cat", "a a a b", "The the", "été été", None) == [
        "the cat", "a b", "The the", "été", None
    ]
    assert one(spark, X.collapse_repeats(X.collapse_repeats("t")), "no no no") == ["no"]
    assert one(spark, X.blank_emails("t"), "to a.b-c@d.example.com now", "a@b", None) == ["to   now", "a@b", None]


def test_buckets(spark):
    df = spark.createDataFrame([(0,), (10,), (11,), (30,), (31,), (101,), (None,)], "n int")
    got = [r[0] for r in df.select(X.fixed_bucket("n")).collect()]
    assert got == ["0-10", "0-10", "11-20", "21-30", "31-50", "100+", None]
    open_low = [r[0] for r in df.select(X.fixed_bucket("n", include_lowest=False)).collect()]
    assert open_low[0] is None and open_low[1] == "0-10"
    assert one(spark, X.bucket_rank("t"), "0-100", "5000+", "100-500") == [1, 7, None]


def test_path_safe(spark):
    assert one(spark, X.path_safe("t"), "A/B c-d_e", "é&&x") == ["A_B_c-d_e", "é_x"]


def test_formatting(spark):
    df = spark.createDataFrame([(0.12345,), (None,), (float("nan"),), (3.0,)], "v double")
    assert [r[0] for r in df.select(formatting.metric_text("v")).collect()] == ["0.1235", "-", "-", "3.0000"]
    assert [r[0] for r in df.select(formatting.percent_text("v")).collect()] == ["12.3%", "-", "-", "300.0%"]
    assert [r[0] for r in df.select(formatting.count_text("v")).collect()] == ["0", "-", "-", "3"]
    sizes = spark.createDataFrame([(512,), (3 * 1024**2,), (5 * 1024**3,)], "b long")
    assert [r[0] for r in sizes.select(formatting.bytes_text("b")).collect()] == ["0.50 KB", "3.00 MB", "5.00 GB"]


CLASSES = ["Alpha", "Beta", "Alpha Beta"]


def test_normalise_label(spark):
    got = one(
        spark,
        labels.normalise_label("t", CLASSES),
        "Label: Alpha.",
        'the category is "Beta"',
        "beta",
        "This is alpha beta",
        "Alpha with far too many further characters here",
        " predicted label:  Alpha ;",
        "nothing",
        "Label: category: Beta",
        None,
    )
    assert got == [
        "Alpha", "Beta", "Beta", "Alpha", "Alpha with far too many further characters here", "Alpha", "nothing", "Beta", None
    ]


def test_match_and_invalid(spark):
    got = one(spark, labels.match_label("t", CLASSES), " Alpha ", "is Beta", "beta", "", None)
    assert got == ["Alpha", "Beta", "beta", labels.EMPTY_PRED, labels.MISSING_PRED]
    assert one(spark, labels.mark_invalid("t", CLASSES), "Beta", "beta", None) == ["Beta", labels.INVALID, labels.INVALID]
    assert labels.report_labels(["b", "a"]) == sorted(["a", "b", labels.INVALID])


def test_closest_label(spark):
    got = one(spark, labels.closest_label("t", CLASSES), "alpa", "betta", None)
    assert [(g["distance"], g["label"]) if g else None for g in got] == [(1, "Alpha"), (1, "Beta"), None]


def test_row_functions_work_on_a_stream(spark, tmp_path):
    """Row-level controls run unchanged on a streaming DataFrame."""
    from corpusgauge.streaming.gate import gate_predictions

    src = str(tmp_path / "in")
    spark.createDataFrame(
        [(1, "Label: alpha", 0.9), (2, "beta", 0.2), (3, "zzz", 0.9), (4, "Beta", None)], "id int, raw string, conf double"
    ).write.parquet(src)
    stream = spark.readStream.schema("id int, raw string, conf double").parquet(src)
    out = gate_predictions(stream, "raw", "conf", CLASSES)
    out_dir, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["id"]: (r["label"], r["report_label"], r["route"]) for r in spark.read.parquet(out_dir).collect()}
    assert got == {
        1: ("Alpha", "Alpha", "accept"),
        2: ("Beta", "Beta", "review"),
        3: ("zzz", labels.INVALID, "review"),
        4: ("Beta", "Beta", "review"),
    }


def test_apply_batches_covers_every_row(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    out = R.apply_batches(df, lambda p: p.assign(x=p["x"] + 1), df.schema, 7)
    assert out.agg(F.sum("x"), F.count("*")).head() == (2 * 499500 + 1000, 1000)
