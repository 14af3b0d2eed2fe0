"""Label clean-up and confidence gate on a stream of predictions.

Both are stateless expressions, so the same code serves a batch and a streaming
DataFrame; there is no watermark to set and no state to recover.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import mark_invalid, normalise_label
from ..operators.evaluation import gate_route


def gate_predictions(
    df: DataFrame, raw_label: str, confidence: str, classes: Sequence[str], threshold: float = 0.5
) -> DataFrame:
    """Add the normalised label, the label a report may use, and the route."""
    return (
        df.withColumn("label", normalise_label(raw_label, classes))
        .withColumn("report_label", mark_invalid("label", classes))
        .withColumn(
            "route",
            F.when(F.col("label").isin(*classes), gate_route(F.col(confidence), threshold)).otherwise("review"),
        )
    )
