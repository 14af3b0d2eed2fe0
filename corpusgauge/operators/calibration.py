"""From decision margins to class probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.columns import count_if, ratio
from ..session import bounded_rows, cut_lineage
from .common import attach_groups
from .rows import stratified_split

KEY = ["fold", "class"]
# Bytes of features in a task of a fit. An iteration is one job, so a table in small
# partitions would cost the scheduling of its tasks, thousands of times; so few of them
# are left as they are.
FIT_BYTES = 64 << 20
FIT_TASKS = 4
# Level blocks that all isotonic fits together may have.
BLOCKS = 2_000_000


# -- margins ------------------------------------------------------------------


def stratified_folds(df: DataFrame, key: str, label: str, folds: int) -> DataFrame:
    """``df`` with ``fold``: every class is dealt evenly to the folds, so that no fold
    lacks one. A class with fewer rows than folds is an error."""
    rare = df.groupBy(label).count().filter(F.col("count") < folds).limit(20).collect()
    if rare:
        raise ValueError(f"classes with fewer than {folds} rows: {sorted(r[label] for r in rare)}")
    split = stratified_split(df, key, label, [(str(f), 1.0) for f in range(folds)])
    return split.withColumn("fold", F.col("part").cast("int")).drop("part")


def fit_margins(train: DataFrame, max_iter: int = 2000, reg: float = 1e-3):
    """One-vs-rest linear classifier on ``features`` and ``code``."""
    base = LinearSVC(regParam=reg, maxIter=max_iter)
    return OneVsRest(classifier=base, featuresCol="features", labelCol="code", parallelism=16).fit(train)


def in_fit_tasks(train: DataFrame) -> DataFrame:
    """``train`` in partitions of about :data:`FIT_BYTES` of ``features``, merged where
    they lie; their number follows the size of the table."""
    size = F.coalesce(F.size(vector_to_array("features")), F.lit(0))
    n = train.agg(F.sum(8 * size.cast("long"))).first()[0] or 0
    return train.coalesce(max(FIT_TASKS, -(-n // FIT_BYTES)))


def margins_of(model, df: DataFrame, key: str, classes: Sequence[str], *keep: str) -> DataFrame:
    """Long margins ``(key, class, margin)`` of a fitted classifier."""
    names = F.array(*[F.lit(c) for c in classes])
    return (
        model.transform(df)
        .select(key, *keep, F.posexplode(vector_to_array("rawPrediction")).alias("i", "margin"))
        .select(key, *keep, names[F.col("i")].alias("class"), "margin")
    )


def fold_margins(
    train: DataFrame, test: DataFrame, key: str, classes: Sequence[str], folds: int = 3, **fit
) -> tuple[DataFrame, DataFrame]:
    """Fit one classifier per fold on the other folds' rows, the folds being
    stratified by class and fitted side by side. Returns the
    margins of each fold's own rows, with ``positive``, to calibrate on, and
    the margins of ``test`` under every fold's classifier. Both are
    ``(key, fold, class, margin)``; store them before calibrating."""
    tagged = cut_lineage(stratified_folds(train, key, "code", folds))
    names = F.array(*[F.lit(c) for c in classes])
    held, scored = None, None
    one = lambda f: fit_margins(in_fit_tasks(tagged.filter(F.col("fold") != f)), **fit)
    one = inheritable_thread_target(train.sparkSession)(one)
    with ThreadPool(folds) as threads:
        models = threads.map(one, range(folds))
    for f, model in enumerate(models):
        own = margins_of(model, tagged.filter(F.col("fold") == f), key, classes, "code")
        own = own.select(
            key,
            F.lit(f).alias("fold"),
            "class",
            "margin",
            (names[F.col("code").cast("int")] == F.col("class")).alias("positive"),
        )
        new = margins_of(model, test, key, classes).withColumn("fold", F.lit(f))
        held = own if held is None else held.unionByName(own)
        scored = new if scored is None else scored.unionByName(new)
    return held, scored


# -- sigmoid ------------------------------------------------------------------


def fit_sigmoid(
    margins: DataFrame, max_iter: int = 50, tol: float = 1e-7
) -> DataFrame:
    """Platt's sigmoid ``1 / (1 + exp(a m + b))`` per fold and class.

    ``margins`` has ``fold, class, margin, positive``. Every Newton step is one
    aggregate of a few sums per (fold, class), whatever the number of rows; the
    parameters travel back to the rows as a broadcast of one row per (fold,
    class). Targets are smoothed as (n+ + 1)/(n+ + 2) and 1/(n- + 2). A step
    that does not lower the loss is halved.
    """
    spark = margins.sparkSession
    counts = margins.groupBy(*KEY).agg(
        count_if(F.col("positive")).alias("np"), count_if(~F.col("positive")).alias("nn")
    ).collect()
    state = {
        (r["fold"], r["class"]): {
            "hi": (r["np"] + 1.0) / (r["np"] + 2.0),
            "lo": 1.0 / (r["nn"] + 2.0),
            "a": 0.0,
            "b": math.log((r["nn"] + 1.0) / (r["np"] + 1.0)),
            "step": None,
            "loss": None,
            "done": False,
        }
        for r in counts
    }
    schema = "fold int, class string, hi double, lo double, a double, b double"
    for _ in range(max_iter):
        live = {k: s for k, s in state.items() if not s["done"]}
        if not live:
            break
        rows = [(k[0], k[1], s["hi"], s["lo"], s["a"], s["b"]) for k, s in live.items()]
        params = F.broadcast(spark.createDataFrame(rows, schema))
        m = F.col("margin")
        z = F.col("a") * m + F.col("b")
        t = F.when(F.col("positive"), F.col("hi")).otherwise(F.col("lo"))
        p = 1 / (1 + F.exp(z))
        # -t ln p - (1 - t) ln(1 - p), written so that exp never overflows
        loss = t * z + F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        d, w = t - p, p * (1 - p)
        sums = (
            margins.join(params, KEY)
            .groupBy(*KEY)
            .agg(
                F.sum(loss).alias("loss"),
                F.sum(m * d).alias("ga"),
                F.sum(d).alias("gb"),
                F.sum(m * m * w).alias("haa"),
                F.sum(m * w).alias("hab"),
                F.sum(w).alias("hbb"),
            )
            .collect()
        )
        for r in sums:
            _newton(state[(r["fold"], r["class"])], r, tol)
    rows = [(k[0], k[1], float(s["a"]), float(s["b"])) for k, s in state.items()]
    return spark.createDataFrame(rows, "fold int, class string, a double, b double")


def _newton(s: dict, r, tol: float) -> None:
    """Move one (fold, class) by its sums."""
    if s["loss"] is not None and r["loss"] > s["loss"] + 1e-12:
        # the last step went too far: halve it
        da, db = s["step"]
        s["a"], s["b"] = s["a"] - da / 2, s["b"] - db / 2
        s["step"] = (da / 2, db / 2)
        s["done"] = abs(da) + abs(db) < tol
        return
    s["loss"] = r["loss"]
    haa, hab, hbb = r["haa"] + 1e-12, r["hab"], r["hbb"] + 1e-12
    det = haa * hbb - hab * hab
    if det <= 0 or (abs(r["ga"]) < tol and abs(r["gb"]) < tol):
        s["done"] = True
        return
    da = -(hbb * r["ga"] - hab * r["gb"]) / det
    db = -(haa * r["gb"] - hab * r["ga"]) / det
    s["a"], s["b"] = s["a"] + da, s["b"] + db
    s["step"] = (da, db)
    s["done"] = abs(da) + abs(db) < tol


def apply_sigmoid(margins: DataFrame, params: DataFrame) -> DataFrame:
    """Add ``p``, the un-normalised one-vs-rest probability, for every fold's
    calibrator that fits the margin's ``(fold, class)``."""
    z = F.col("a") * F.col("margin") + F.col("b")
    return attach_groups(margins, params, KEY).withColumn("p", 1 / (1 + F.exp(z))).drop("a", "b")


def pool(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Block of each value in the non-decreasing weighted fit (adjacent violators)."""
    means: list[float] = []
    weights: list[float] = []
    sizes: list[int] = []
    for v, w in zip(value.tolist(), weight.tolist()):
        means.append(v)
        weights.append(w)
        sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            v2, w2, n2 = means.pop(), weights.pop(), sizes.pop()
            means[-1] = (means[-1] * weights[-1] + v2 * w2) / (weights[-1] + w2)
            weights[-1] += w2
            sizes[-1] += n2
    return np.repeat(np.arange(len(sizes)), sizes)


def isotonic_blocks(margins: DataFrame) -> DataFrame:
    """``(fold, class, lo, hi, s, w)``: the level blocks of every (fold, class) at once,
    from margins ``lo`` to ``hi`` at value ``s / w``.

    Equal margins are summed first. Sorted ranges of margins are pooled where they lie,
    which leaves blocks; blocks of neighbouring ranges are pooled again, which is exact,
    because pooling a part first never undoes a block of the whole."""
    ties = margins.groupBy(*KEY, "margin").agg(F.sum(F.col("positive").cast("double")).alias("s"), F.count("*").cast("double").alias("w"))
    ties = ties.filter("margin is not null").select(*KEY, F.col("margin").cast("double").alias("lo"), F.col("margin").cast("double").alias("hi"), "s", "w")
    schema = ties.schema

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lo", ignore_index=True)
        block = pool((rows["s"] / rows["w"]).to_numpy(), rows["w"].to_numpy())
        out = rows.groupby(block, sort=True).agg({"fold": "first", "class": "first", "lo": "first", "hi": "last", "s": "sum", "w": "sum"})
        return out[["fold", "class", "lo", "hi", "s", "w"]]

    def ranges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:  # a batch is a sorted stretch of a range
            for _, rows in part.groupby(["fold", "class"], sort=False):
                yield merge(rows)

    ordered = ties.repartitionByRange(*KEY, "lo").sortWithinPartitions(*KEY, "lo")
    return ordered.mapInPandas(ranges, schema).groupBy(*KEY).applyInPandas(merge, schema)


def fit_apply_isotonic(margins: DataFrame, score: DataFrame, pairs: Sequence[tuple[int, str]]) -> DataFrame:
    """Isotonic counterpart: one monotone fit per (fold, class) of ``pairs``, all in one
    grouped pass. Between blocks the fit is a straight line, outside it is constant;
    rows of a pair that has no fit, or without a margin, have no ``p``."""
    wanted = F.create_map(*[F.lit(x) for f, c in pairs for x in (f"{f}|{c}", True)]) if pairs else F.lit(None).cast("map<string,boolean>")
    listed = F.coalesce(wanted[F.concat_ws("|", "fold", "class")], F.lit(False))
    rows = bounded_rows(isotonic_blocks(margins.filter(listed)), BLOCKS)
    if rows is None:
        raise ValueError(f"more than {BLOCKS} levels in the isotonic fits")
    fits: dict[tuple, list] = {}
    for r in rows:
        fits.setdefault((r["fold"], r["class"]), []).append((r["lo"], r["hi"], r["s"] / r["w"]))
    lines = {}
    for k, blocks in fits.items():
        blocks.sort()
        x = np.array([[lo, hi] for lo, hi, _ in blocks]).ravel()
        lines[k] = x, np.repeat([v for _, _, v in blocks], 2)
    here = score.filter(listed)

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            p = np.full(len(part), np.nan)
            for k, at in part.groupby(["fold", "class"]).indices.items():
                if k in lines:
                    p[at] = np.interp(part["margin"].to_numpy(dtype=float)[at], *lines[k])
            yield part.assign(p=p)

    fields = [f for f in here.schema.fields if f.name != "p"]
    out = here.drop("p").mapInPandas(apply, T.StructType(fields).add("p", "double"))
    return out.withColumn("p", F.nanvl("p", F.lit(None).cast("double")))


# -- combination --------------------------------------------------------------


def average_folds(probs: DataFrame, key: str) -> DataFrame:
    """Mean of the un-normalised probabilities over the folds."""
    return probs.groupBy(key, "class").agg(F.avg("p").alias("p"))


def normalise(probs: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Scale each row's probabilities to sum to 1. A row has as many of them as
    there are classes."""
    w = W.partitionBy(key, *by)
    return probs.withColumn("p_norm", ratio(F.col("p"), F.sum("p").over(w)))


def mean_of_normalised(probs: DataFrame, key: str) -> DataFrame:
    """Normalise within each fold first, then average: the library's order."""
    return normalise(probs, key, ["fold"]).groupBy(key, "class").agg(F.avg("p_norm").alias("p"))


def predicted_class(probs: DataFrame, key: str, p: str = "p") -> DataFrame:
    """Class with the largest probability; the first by name on a tie."""
    best = F.min(F.struct((-F.col(p)).alias("neg"), F.col("class")))
    return probs.groupBy(key).agg(best.alias("b")).select(
        key, F.col("b.class").alias("predicted"), (-F.col("b.neg")).alias("confidence")
    )


def top_classes(vector: Column, classes: Sequence[str], k: int = 5) -> Column:
    """Array of ``(class, p)`` with the ``k`` largest of a score vector."""
    pairs = F.transform(
        vector,
        lambda v, i: F.struct(
            (-v.cast("double")).alias("neg"), F.array(*[F.lit(c) for c in classes])[i].alias("class")
        ),
    )
    top = F.slice(F.array_sort(pairs), 1, k)
    return F.transform(top, lambda x: F.struct(x["class"].alias("class"), (-x["neg"]).alias("p")))


def probability_map(vector: Column, classes: Sequence[str]) -> Column:
    """A score vector as map from class to probability."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), vector)


def arg_max(vector: Column) -> Column:
    """Position (from 0) of the largest element, the first on a tie."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")
