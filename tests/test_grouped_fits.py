"""Fits and look-ups that used to be a loop, a join or an explosion."""

import random

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from corpusgauge.operators import calibration as C
from corpusgauge.operators import language as La
from corpusgauge.operators import rows as R
from tests.conftest import by


def test_isotonic_fits_in_one_pass_equal_single_fits(spark):
    rng = np.random.default_rng(4)
    rows = []
    for fold in range(2):
        for c in "ab":
            m = np.round(rng.normal(0, 1, 150), 1) + 0.0  # with ties, one zero
            rows += [(len(rows) + i, fold, c, float(v), bool(rng.random() < 1 / (1 + np.exp(-2 * v)))) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id long, fold int, class string, margin double, positive boolean").repartition(6)
    pairs = [(f, c) for f in range(2) for c in "ab"]
    blocks = C.isotonic_blocks(df).collect()
    for fold, c in pairs:
        levels = sorted((r["lo"], r["hi"], r["s"] / r["w"]) for r in blocks if (r["fold"], r["class"]) == (fold, c))
        assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(levels, levels[1:]))
        assert sum(r["w"] for r in blocks if (r["fold"], r["class"]) == (fold, c)) == 150
    ask = spark.createDataFrame([(i, f, c, float(v)) for i, (f, c, v) in enumerate((f, c, v) for f, c in pairs for v in np.linspace(-4, 4, 41))], "id long, fold int, class string, margin double")
    got = by(C.fit_apply_isotonic(df, ask, pairs), "id")
    for fold, c in pairs:
        one = df.filter((F.col("fold") == fold) & (F.col("class") == c)).select(F.col("margin").alias("features"), F.col("positive").cast("double").alias("label"))
        model = IsotonicRegression().fit(one)
        here = ask.filter((F.col("fold") == fold) & (F.col("class") == c)).withColumn("features", F.col("margin"))
        for r in model.transform(here).collect():
            assert abs(got[r["id"]]["p"] - r["prediction"]) < 1e-9
    # another pair is left out, a pair without rows has no fit
    assert C.fit_apply_isotonic(df, ask, [(0, "a")]).count() == 41
    empty = C.fit_apply_isotonic(df.limit(0), ask, pairs).collect()
    assert len(empty) == len(pairs) * 41 and all(r["p"] is None for r in empty)


def test_pooling_equals_least_squares():
    rng = np.random.default_rng(0)
    for _ in range(30):
        v, w = rng.normal(0, 1, 12), rng.random(12) + 0.1
        block = C.pool(v, w)
        fit = np.array([np.average(v[block == b], weights=w[block == b]) for b in block])
        # the max-min formula of the monotone least-squares fit
        want = [max(min(np.average(v[i : j + 1], weights=w[i : j + 1]) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        assert np.allclose(fit, want)


def test_languages_in_row_and_by_join_agree(spark, monkeypatch):
    rng = random.Random(2)
    word = {"x": "abcdé", "y": "cdefg", "z": "xyzab"}
    text = lambda lang, n: " ".join("".join(rng.choice(word[lang]) for _ in range(rng.randint(1, 7))) for _ in range(n))
    train = spark.createDataFrame([(text(k, 30), k) for k in "xyz" for _ in range(6)] + [(None, "x"), ("abc", None)], "t string, l string")
    rows = [(i, text(rng.choice("xyz"), rng.randint(1, 12))) for i in range(60)] + [(100, None), (101, ""), (102, "ab"), (103, "12 !"), (104, "\U0001d538bc" * 9)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    profile = La.language_profile(train, "t", "l", ["x", "y", "z"])
    counts = {}
    for r in train.collect():
        if r["t"] and r["l"]:
            t = "".join(ch if ch.isalpha() else " " for ch in r["t"].lower())
            for i in range(len(t) - 2):
                counts[t[i : i + 3]] = counts.get(t[i : i + 3], 0) + 1
    got = profile.select("gram", F.expr("c0 + c1 + c2").alias("n")).collect()
    assert {"".join(chr(r["gram"] >> k & 0x1FFFFF) for k in (42, 21, 0)): r["n"] for r in got} == counts
    first = by(La.detect_language(df, "id", "t", profile, ["x", "y", "z"]), "id")
    monkeypatch.setattr(La, "PROFILE_ROWS", 10)
    second = by(La.detect_language(df, "id", "t", profile, ["x", "y", "z"]), "id")
    assert first == second and len(first) == len(rows)
    assert first[100]["language"] is None and first[101]["language"] == first[102]["language"] == first[103]["language"] == "error"
    monkeypatch.setattr(La, "PROFILE_ROWS", 1000)
    monkeypatch.setattr(La, "PART_CHARS", 50)
    assert by(La.detect_language(df, "id", "t", profile, ["x", "y", "z"]), "id") == first
    assert La.detect_language(df.limit(0), "id", "t", profile, ["x", "y", "z"]).count() == 0


def test_names_in_row_and_by_join_agree(spark, monkeypatch):
    names = spark.createDataFrame([("Ann",), ("BOB",), (None,), ("",)], "n string")
    df = spark.createDataFrame([(1, "ann met  Bob and anna"), (2, None), (3, ""), (4, "bob BOB"), (5, "no one")], "id int, t string")
    first = by(R.drop_names(df, "id", "t", names, "n"), "id")
    assert first[1]["t"] == "met and anna" and first[2]["t"] is None and first[4]["t"] == "" and first[5]["t"] == "no one"
    plan = R.drop_names(df, "id", "t", names, "n")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan
    monkeypatch.setattr(R, "DICTIONARY_ROWS", 1)
    assert by(R.drop_names(df, "id", "t", names, "n"), "id") == first
