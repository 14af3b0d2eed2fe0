"""The training-data pipeline: five stages from raw documents to a mix.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept
and returns a DataFrame; the driver of the pipeline writes it as Parquet and reads it
back as the next one's ``docs``. All but the last return the columns of ``documents``.

1. quality classifier: documents scored below the threshold go
2. line dedup: later copies and near copies of long lines go, and documents that have
   no word left
3. MinHash near-duplicates: of each group the document of least id stays
4. benchmark decontamination: documents that repeat a benchmark item go
5. mixture: the words that the mix takes from each document

SQL expresses none of this as a whole (trained scores, edit distances, signatures), so
``ORACLE_SQL`` is None and ``tests/llm`` holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm import classifier, decontaminate, line_dedup, mixture, near_dedup
from corpusgauge.llm.store import settled, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""

    def build() -> DataFrame:
        scored = classifier.score_documents(docs, table(spark, sf_dir, "labels"))
        return scored.filter("predicted = 0").select(F.col("doc_id").alias("__gone")).distinct()

    rejected = settled(spark, build, "rejected")
    return docs.join(rejected, F.col("doc_id") == F.col("__gone"), "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines seen before."""
    return line_dedup.drop_lines(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.keep_first(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, source_size, target and taken."""
    return mixture.mix_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixture", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents."""
    def upto(k: int) -> DataFrame:
        if k == 0:
            return table(spark, sf_dir, "documents")
        name, stage = STAGES[k - 1]
        # the input of a stage goes once its result is written
        return settled(spark, lambda: stage(spark, upto(k - 1), sf_dir), f"pipeline-{name}")

    return upto(len(STAGES))
