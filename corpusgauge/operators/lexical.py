"""Vocabulary statistics.

Everything here is arithmetic on token counts. Tokens are exploded and counted
with partial aggregation before the one shuffle, so a word that makes up a
third of the corpus arrives as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..datasets import DATASET, DatasetSet
from ..functions.columns import count_if, ratio
from ..functions.stopwords import ENGLISH
from ..functions.text import basic_tokens, ngrams, raw_tokens, strip_punctuation, without, word_tokens
from .common import spread, top_per

TOP_TERMS = 20
MIN_ROWS_PER_CLASS = 10
# Bytes of texts whose n-grams one task counts.
NGRAM_PIECE = 4 * 1024 * 1024


def token_counts(df: DataFrame, tokens: Column, by: Sequence[str] = (DATASET,)) -> DataFrame:
    """``(by..., token, n)`` for a token-array column."""
    return (
        df.select(*by, F.explode(tokens).alias("token"))
        .groupBy(*by, "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _wide_counts(ds: DatasetSet, text: str, tokens: Column) -> tuple[DataFrame, dict[str, str]]:
    """One row per token with a count per dataset: the datasets are known, so
    comparing their vocabularies takes one shuffle and no join."""
    cols = {n: f"n{i}" for i, n in enumerate(ds.names)}
    wide = (
        spread(ds.long([text]))
        .select(DATASET, F.explode(tokens).alias("token"))
        .groupBy("token")
        .agg(*[count_if(F.col(DATASET) == F.lit(n)).alias(c) for n, c in cols.items()])
    )
    return wide, cols


def vocabulary_size(ds: DatasetSet, text: str, reference: str) -> DataFrame:
    """Distinct tokens and all tokens of the reference dataset."""
    tok = token_counts(spread(ds.only([reference]).long([text])), basic_tokens(text))
    return tok.groupBy(DATASET).agg(
        F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("tokens")
    )


def oov_rates(ds: DatasetSet, text: str, reference: str, tokens: Column | None = None) -> DataFrame:
    """Share of tokens, and of distinct words, that the reference dataset does
    not have, in percent; NULL for a dataset without tokens."""
    ds = ds.only(ds.members_with(text))
    tokens = basic_tokens(text) if tokens is None else tokens
    wide, cols = _wide_counts(ds, text, tokens)
    new = F.col(cols[reference]) == 0
    others = [(n, c) for n, c in cols.items() if n != reference]
    sums = wide.agg(
        *[
            F.struct(
                F.lit(n).alias(DATASET),
                F.coalesce(F.sum(c), F.lit(0)).alias("tokens"),
                F.coalesce(F.sum(F.when(new, F.col(c))), F.lit(0)).alias("oov_tokens"),
                count_if(F.col(c) > 0).alias("words"),
                count_if(new & (F.col(c) > 0)).alias("oov_words"),
            ).alias(c)
            for n, c in others
        ]
    )
    return (
        sums.select(F.explode(F.array(*[F.col(c) for _, c in others])).alias("x"))
        .select("x.*")
        .withColumn("oov_token_pct", ratio(F.col("oov_tokens") * 100, F.col("tokens")))
        .withColumn("oov_word_pct", ratio(F.col("oov_words") * 100, F.col("words")))
    )


def oov_rate_against(ds: DatasetSet, text: str, vocabulary: DataFrame, column: str = "token") -> DataFrame:
    """Case-sensitive rate against a given word list, 2 decimals, 0 on no text.

    Both sides are one row per word, so the join is free of hot keys."""
    tok = token_counts(spread(ds.long([text])), raw_tokens(text))
    known = vocabulary.select(F.col(column).alias("token")).distinct().withColumn("known", F.lit(True))
    return (
        tok.join(known, "token", "left")
        .groupBy(DATASET)
        .agg(
            F.sum("n").alias("tokens"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("oov_tokens"),
        )
        .withColumn("oov_rate", F.round(ratio(F.col("oov_tokens") * 100, F.col("tokens"), 0.0), 2))
    )


def type_token_ratio(ds: DatasetSet, text: str, stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """Distinct over all tokens in percent, stop words left out."""
    tok = token_counts(spread(ds.long([text])), without(basic_tokens(text), stop_words))
    return (
        tok.groupBy(DATASET)
        .agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens"))
        .withColumn("ttr", ratio(F.col("words") * 100, F.col("tokens")))
    )


def type_token_ratio_by_class(
    ds: DatasetSet,
    text: str,
    label: str,
    min_rows: int = MIN_ROWS_PER_CLASS,
    stop_words: Sequence[str] = ENGLISH,
) -> DataFrame:
    """Type-token ratio per class; classes with fewer rows are left out."""
    ds = ds.only(ds.members_with(text, label))
    df = (
        spread(ds.long([text, label]))
        .filter(F.col(text).isNotNull() & F.col(label).isNotNull())
        .withColumn("label", F.col(label).cast("string"))
    )
    sizes = df.groupBy(DATASET, "label").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= min_rows)
    tok = token_counts(df, without(basic_tokens(text), stop_words), [DATASET, "label"])
    return (
        tok.groupBy(DATASET, "label")
        .agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens"))
        .join(sizes, [DATASET, "label"])
        .withColumn("ttr", ratio(F.col("words") * 100, F.col("tokens")))
    )


def diversity(ds: DatasetSet, text: str) -> DataFrame:
    """Token totals, type-token ratio, share of words seen once among all
    tokens, and Shannon entropy in bits; zeros for a dataset without tokens.

    The entropy is ``log2(N) - sum(n log2 n) / N``, which needs no total
    beforehand."""
    spark = ds.frames[ds.names[0]].sparkSession
    tok = token_counts(spread(ds.long([text])), raw_tokens(text))
    sums = tok.groupBy(DATASET).agg(
        F.sum("n").alias("tokens"),
        F.count(F.lit(1)).alias("words"),
        count_if(F.col("n") == 1).alias("once"),
        F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("nlogn"),
    )
    names = spark.createDataFrame([(n,) for n in ds.names], f"{DATASET} string")
    N = F.col("tokens")
    return names.join(sums, DATASET, "left").select(
        DATASET,
        F.coalesce(N, F.lit(0)).alias("total_tokens"),
        F.coalesce("words", F.lit(0)).alias("unique_tokens"),
        F.round(ratio(F.col("words"), N, 0.0), 4).alias("ttr"),
        F.round(ratio(F.col("once"), N, 0.0), 4).alias("hapax_ratio"),
        F.coalesce(F.round(F.log2(N.cast("double")) - F.col("nlogn") / N, 4), F.lit(0.0)).alias(
            "shannon_entropy"
        ),
    )


def common_words(ds: DatasetSet, text: str, top_n: int = 30) -> DataFrame:
    """Most frequent white-space words once punctuation is stripped."""
    tok = token_counts(spread(ds.long([text])), raw_tokens(strip_punctuation(text)))
    return top_per(tok, [DATASET], top_n, F.desc("n"), F.col("token")).select(DATASET, "rank", "token", "n")


def top_ngrams(
    ds: DatasetSet,
    text: str,
    n: int = 1,
    top_n: int = TOP_TERMS,
    by: Sequence[str] = (),
    stop_words: Sequence[str] = ENGLISH,
) -> DataFrame:
    """Most frequent n-grams per dataset, or per dataset and class, over all
    rows; stop words go before the n-grams are formed."""
    df = spread(ds.long(list(dict.fromkeys([text, *by]))), NGRAM_PIECE).filter(F.col(text).isNotNull())
    for b in by:
        df = df.filter(F.col(b).isNotNull()).withColumn(b, F.col(b).cast("string"))
    keys = [DATASET, *by]
    # two steps: the array is built once per row before it is sliced
    toks = df.select(*keys, word_tokens(text, stop_words).alias("toks"))
    counts = token_counts(toks, ngrams(F.col("toks"), n), keys).withColumnRenamed("token", "ngram")
    return top_per(counts, keys, top_n, F.desc("n"), F.col("ngram")).select(*keys, "rank", "ngram", "n")


def dataset_overlap(tops: DataFrame, reference: str) -> DataFrame:
    """How many of the reference dataset's top n-grams another dataset's list
    has too; the denominator is the reference list's length."""
    is_ref = F.col(DATASET) == F.lit(reference)
    # top lists: a few rows per dataset
    marked = tops.select(
        DATASET,
        count_if(is_ref).over(W.partitionBy("ngram")).alias("in_ref"),
        count_if(is_ref).over(W.partitionBy(F.lit(0))).alias("denominator"),
    )
    return (
        marked.filter(~is_ref)
        .groupBy(DATASET)
        .agg(count_if(F.col("in_ref") > 0).alias("overlap"), F.max("denominator").alias("denominator"))
        .withColumn("overlap_pct", ratio(F.col("overlap") * 100, F.col("denominator"), 0.0))
    )


def class_overlap(tops: DataFrame, reference: str, others: Sequence[str], label: str) -> DataFrame:
    """Overlap of the top n-grams class by class over the union of the classes;
    0 for a class the reference does not have."""
    ref = tops.filter(F.col(DATASET) == F.lit(reference)).select(label, "ngram")
    sizes = ref.groupBy(label).agg(F.count(F.lit(1)).alias("n_reference"))
    other = tops.filter(F.col(DATASET).isin(*others)).select(DATASET, label, "ngram")
    shared = (
        other.join(ref.withColumn("in_ref", F.lit(1)), [label, "ngram"], "left")
        .groupBy(DATASET, label)
        .agg(F.count("in_ref").alias("overlap"))
    )
    wanted = sizes.withColumn(DATASET, F.explode(F.array(*[F.lit(o) for o in others])))
    # a class of the reference must appear against every other dataset
    full = wanted.join(shared, [DATASET, label], "full_outer")
    overlap = F.coalesce("overlap", F.lit(0)).cast("long")
    n_ref = F.coalesce("n_reference", F.lit(0)).cast("long")
    pct = ratio(overlap * 100, n_ref, 0.0)
    return full.select(
        F.concat(F.lit(f"{reference} vs "), F.col(DATASET)).alias("comparison"),
        F.col(label),
        overlap.alias("overlap"),
        n_ref.alias("n_reference"),
        pct.alias("overlap_pct"),
        F.format_string("%.1f%%", pct).alias("overlap_text"),
    )
