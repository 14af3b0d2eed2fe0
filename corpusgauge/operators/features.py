"""TF-IDF features and their two-component projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    ElementwiseProduct,
    Normalizer,
    RegexTokenizer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.columns import ratio
from ..functions.stopwords import ENGLISH
from ..functions.text import TOKEN, word_tokens
from ..session import scratch_path
from .common import spread

VOCABULARY = 5000
# Largest vocabulary cap for which the terms are sent to every executor.
BROADCAST_TERMS = 200_000


def fit_tfidf(
    df: DataFrame,
    text: str,
    vocabulary: int = VOCABULARY,
    min_df: int = 2,
    stop_words: Sequence[str] = ENGLISH,
    output: str = "features",
) -> PipelineModel:
    """Fit the feature stages; words unseen here are ignored later.

    Spark's inverse document frequency is ``ln((1+N)/(1+df))``; the weighting
    wanted adds one, so the fitted vector enters as a scaling stage.
    """
    clean = df.filter(F.col(text).isNotNull())
    stages = [
        RegexTokenizer(
            inputCol=text, outputCol="__words", pattern=TOKEN, gaps=False, toLowercase=True, minTokenLength=2
        ),
        StopWordsRemover(inputCol="__words", outputCol="__kept", stopWords=list(stop_words)),
        CountVectorizer(inputCol="__kept", outputCol="__tf", vocabSize=vocabulary, minDF=float(min_df)),
    ]
    counts = Pipeline(stages=stages).fit(clean)
    idf = IDF(inputCol="__tf", outputCol="__idf").fit(counts.transform(clean))
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="__tf", outputCol="__tfidf"
    )
    unit = Normalizer(inputCol="__tfidf", outputCol=output, p=2.0)
    return PipelineModel(stages=[*counts.stages, scale, unit])


def tfidf(model: PipelineModel, df: DataFrame, text: str, output: str = "features") -> DataFrame:
    """Feature column of every row; NULL text counts as empty text."""
    filled = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    return model.transform(filled).drop("__words", "__kept", "__tf", "__tfidf")


def tfidf_terms(
    df: DataFrame,
    key: str,
    text: str,
    vocabulary: int = VOCABULARY,
    min_df: int = 2,
    stop_words: Sequence[str] = ENGLISH,
) -> DataFrame:
    """The same weights in long form ``(key, term, tf, df, weight)``. The
    vocabulary is at most ``vocabulary`` terms, the most frequent first, equal
    ones alphabetically; the cap tells whether it fits a broadcast.

    Texts meet by key once, as their words; counting a text's terms and its length then
    need no further shuffle, which would move a row per text and term."""
    docs = df.filter(F.col(text).isNotNull())
    n_docs = docs.count()
    words = spread(docs.select(key, text)).select(key, F.array_join(word_tokens(text, stop_words), " ").alias("words"))
    # a number of partitions of its own: those of few bytes would be joined, and hold many terms
    placed = words.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    tf = (
        placed.select(key, F.explode(F.split("words", " ")).alias("term"))
        .filter("term <> ''")
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    vocab = (
        tf.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        .filter(F.col("df") >= min_df)
        .orderBy(F.desc("total"), "term")
        .limit(vocabulary)
        .select("term", "df")
    )
    idf = F.ln((F.lit(1.0) + n_docs) / (F.col("df") + 1)) + 1
    small = F.broadcast(vocab) if vocabulary <= BROADCAST_TERMS else vocab
    weighted = tf.join(small, "term").withColumn("raw", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return weighted.select(key, "term", "tf", "df", ratio(F.col("raw"), norm).alias("weight"))


def stored_entries(df: DataFrame, features: str, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` stored once and seen twice: with its vectors, and with the non-zero entries
    of each as plain arrays ``idx`` and ``val``, as the file holds them. A vector stored
    as dense has all its places in ``idx``."""
    spark = df.sparkSession
    path = scratch_path(spark, "entries")
    df.select(*keep, features).write.parquet(path)
    vectors = spark.read.parquet(path)
    plain = T.StructType([vectors.schema[c] for c in keep])
    parts = T.StructType.fromDDL("type tinyint, size int, indices array<int>, values array<double>")
    entries = spark.read.schema(plain.add(features, parts)).parquet(path)
    v = F.col(features)
    every = F.transform(v["values"], lambda _, i: i)
    return vectors, entries.select(*keep, F.coalesce(v["indices"], every).alias("idx"), v["values"].alias("val"))


def svd_points(df: DataFrame, key: str, features: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Rows projected on the ``k`` largest singular directions, ``(key, x1..xk)``,
    and the singular values. The sign of a direction is free."""
    # stored once: every step of the decomposition reads the vectors again
    stored, entries = stored_entries(df, features, [key])
    rows = MLUtils.convertVectorColumnsFromML(stored.select(features), features)
    svd = RowMatrix(rows).computeSVD(k, computeU=False)
    basis = svd.V.toArray()
    # a row meets the basis, as long as the vocabulary, where it lies: entry by entry
    points = []
    for j in range(k):
        direction = F.lit([float(v) for v in basis[:, j]])
        parts = F.zip_with("idx", "val", lambda i, v: F.get(direction, i) * v)
        dot = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
        points.append(F.coalesce(dot, F.lit(0.0)).alias(f"x{j + 1}"))
    return entries.select(key, *points), [float(s) for s in svd.s]
