"""Search over regularisation settings of linear text classifiers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..datasets import DATASET
from .common import attach_groups
from .evaluation import confusion, overall_metrics
from .rows import class_weights

# The axes searched.
C_VALUES = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
MAX_ITERS = (1000, 2000, 5000, 10000)
BALANCED = (False, True)
PENALTIES = ("l2", "l1")
TOLERANCE = 1e-4


@dataclass(frozen=True)
class Setting:
    c: float
    max_iter: int
    balanced: bool
    penalty: str = "l2"
    tol: float = TOLERANCE

    def run_id(self) -> str:
        return f"{self.penalty}-C{self.c:g}-iter{self.max_iter}-{'balanced' if self.balanced else 'plain'}"


def full_grid() -> list[Setting]:
    """The settings Spark ML itself can express: hinge loss with an L2 penalty, and
    logistic loss where an L1 penalty is wanted. For the squared-hinge, dual and
    primal variants see :mod:`~corpusgauge.operators.linear_search`."""
    return [
        Setting(c, mi, b, p) for p in PENALTIES for c in C_VALUES for mi in MAX_ITERS for b in BALANCED
    ]


def estimator(s: Setting, n_rows: int, parallelism: int = 4) -> OneVsRest:
    """One-vs-rest classifier of a setting. ``C`` weighs the summed loss; Spark
    averages the loss, so the penalty is ``1 / (C n)``."""
    reg = 1.0 / (s.c * max(n_rows, 1))
    if s.penalty == "l2":
        base = LinearSVC(regParam=reg, maxIter=s.max_iter, tol=s.tol, standardization=False)
    elif s.penalty == "l1":
        base = LogisticRegression(
            regParam=reg, elasticNetParam=1.0, maxIter=s.max_iter, tol=s.tol, standardization=False
        )
    else:
        raise ValueError(f"unknown penalty {s.penalty!r}")
    ovr = OneVsRest(classifier=base, featuresCol="features", labelCol="code", parallelism=parallelism)
    return ovr.setWeightCol("weight") if s.balanced else ovr


def _stopped_early(model, s: Setting) -> bool:
    """Whether any of the binary fits used up its iterations."""
    for m in model.models:
        summary = m.summary() if callable(getattr(m, "summary", None)) else getattr(m, "summary", None)
        if summary is not None and summary.totalIterations >= s.max_iter:
            return True
    return False


def grid_predictions(
    train: DataFrame, evaluate: DataFrame, settings: Iterable[Setting], key: str
) -> tuple[DataFrame, DataFrame]:
    """Fit every setting on ``train`` (features, code) and predict ``evaluate``
    (key, dataset, features, code).

    Returns the stacked predictions ``(run, dataset, key, y_true, y_pred)`` and
    one status row per run; a setting that fails leaves an error row instead of
    stopping the search. ``train`` and ``evaluate`` are read once per fit and
    should be stored beforehand (:func:`~corpusgauge.session.cut_lineage`).
    """
    spark = train.sparkSession
    weights = class_weights(train, "code").select("code", "weight")
    weighted = attach_groups(train, weights, ["code"])
    n_rows = train.count()
    preds, status = [], []
    for s in settings:
        try:
            model = estimator(s, n_rows).fit(weighted if s.balanced else train)
            out = model.transform(evaluate).select(
                F.lit(s.run_id()).alias("run"),
                DATASET,
                key,
                F.col("code").cast("int").alias("y_true"),
                F.col("prediction").cast("int").alias("y_pred"),
            )
            preds.append(out)
            status.append((s.run_id(), *asdict(s).values(), _stopped_early(model, s), None))
        except Exception as e:  # noqa: BLE001 - the failure becomes a row
            status.append((s.run_id(), *asdict(s).values(), None, f"{type(e).__name__}: {e}"[:500]))
    schema = (
        "run string, c double, max_iter int, balanced boolean, penalty string, tol double, "
        "not_converged boolean, error string"
    )
    stacked = None
    for p in preds:
        stacked = p if stacked is None else stacked.unionByName(p)
    if stacked is None:
        k = evaluate.schema[key].dataType.simpleString()
        stacked = spark.createDataFrame(
            [], f"run string, {DATASET} string, {key} {k}, y_true int, y_pred int"
        )
    return stacked, spark.createDataFrame(status, schema)


def score_runs(
    predictions: DataFrame,
    status: DataFrame | None = None,
    datasets: Sequence[str] = ("val", "holdout"),
    rank_by: str = "val_accuracy",
) -> DataFrame:
    """One row per run: accuracy and macro precision (over true and predicted
    labels) on each dataset, ranked best first with failed runs last."""
    return score_counts(confusion(predictions, "y_true", "y_pred", ["run", DATASET]), status, datasets, rank_by)


def score_counts(
    cf: DataFrame,
    status: DataFrame | None = None,
    datasets: Sequence[str] = ("val", "holdout"),
    rank_by: str = "val_accuracy",
) -> DataFrame:
    """The same from confusion counts (run, dataset, y_true, y_pred, n)."""
    m = overall_metrics(cf, ["run", DATASET], labels="union")
    wide = m.groupBy("run").agg(
        *[
            F.max(F.when(F.col(DATASET) == F.lit(d), F.col(c))).alias(f"{d}_{c}")
            for d in datasets
            for c in ("accuracy", "macro_precision")
        ]
    )
    if status is not None:
        wide = status.join(wide, "run", "left")
    return wide.orderBy(F.col(rank_by).desc_nulls_last(), "run")


def best_run(scores: DataFrame, rank_by: str = "val_accuracy") -> DataFrame:
    return scores.filter(F.col(rank_by).isNotNull()).orderBy(F.desc(rank_by), "run").limit(1)
