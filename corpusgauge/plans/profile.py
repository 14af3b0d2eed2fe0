"""Profiles of named datasets.

Each function returns ``{table name: DataFrame}``. Nothing is printed, and only
scalars that shape a plan (bin edges, year ranges) are computed on the way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..datasets import DATASET, DatasetSet
from ..functions.text import (
    SHORT_BUCKET_LABELS,
    TOKEN_BUCKET_ORDER,
    fixed_bucket,
    n_chars,
    n_tokens,
)
from ..operators import distributions as D
from ..operators import drift, features, lexical, quality
from ..operators.evaluation import class_names
from ..operators.language import detect_language, language_profile

Tables = dict[str, DataFrame]
BUCKET_COLUMN = "token bucket"


def _order(column: str) -> Sequence[str] | None:
    return TOKEN_BUCKET_ORDER if column == BUCKET_COLUMN else None


def audit_datasets(
    datasets: Mapping[str, DataFrame] | DatasetSet,
    text: str = "processed_text",
    label: str | None = None,
    cardinality_threshold: int = 50,
    n_conflict_examples: int = 5,
) -> Tables:
    """Duplicates, conflicting labels, empty, constant and high-cardinality
    columns, and sizes."""
    ds = datasets if isinstance(datasets, DatasetSet) else DatasetSet(datasets)
    out: Tables = {
        "shape": quality.shapes(ds),
        "row_duplicates": quality.row_duplicates(ds),
        "all_null_columns": quality.all_null_columns(ds),
        "zero_variance": quality.zero_variance_columns(ds),
        "high_cardinality": quality.high_cardinality(ds, cardinality_threshold),
        "size": quality.table_size(ds),
    }
    with_text = ds.members_with(text)
    if with_text:
        out["text_duplicates"] = quality.text_duplicates(ds.only(with_text), text)
    if label is not None:
        checked = [n for n in ("train", "test") if n in ds.members_with(text, label)]
        if checked:
            conflicts = quality.label_conflicts(ds, text, label, checked)
            out["conflict_summary"] = quality.conflict_summary(conflicts)
            out["conflict_examples"] = quality.conflict_examples(conflicts, n_conflict_examples)
    return out


def profile_datasets(
    datasets: Mapping[str, DataFrame] | DatasetSet,
    text: str = "processed_text",
    label: str = "RCC",
    discrete: Sequence[str] = ("file extension", BUCKET_COLUMN),
    continuous: Sequence[str] = ("number of tokens",),
    other_discrete: Sequence[str] = ("LOB",),
    datetimes: Sequence[str] = ("FileModifiedTime",),
    reference: str = "train",
    max_categories: int = 40,
    year_bucket_threshold: int = 15,
    year_bucket_size: int = 2,
    analyze_text: bool = True,
    analyze_ngrams: bool = False,
    top_n: int = 20,
    bigrams: bool = True,
    ttr_min_rows: int = 10,
    comparisons: Sequence[tuple[str, str]] = (),
) -> Tables:
    """Full profile: columns, distributions, dates, vocabulary, cross features,
    text content and pairwise comparison. n-grams use all rows."""
    ds = datasets if isinstance(datasets, DatasetSet) else DatasetSet(datasets)
    out: Tables = {
        "shape": quality.shapes(ds),
        "types": quality.column_types(ds),
        "missing": quality.missing_values(ds),
        "column_status": quality.usable_columns(ds),
        "describe": quality.describe_numeric(ds),
    }
    labelled = ds.members_with(label)
    if labelled:
        members = ds.only(labelled)
        out["target_counts"] = D.value_counts(members, label)
        out["target_distribution"] = D.discrete_distribution(members, label, max_categories)
        out["target_comparison"] = D.compare_discrete(members, label, max_categories)
    for c in [*discrete, *other_discrete]:
        having = ds.members_with(c)
        if having:
            members = ds.only(having)
            out[f"distribution:{c}"] = D.discrete_distribution(members, c, max_categories, _order(c))
            out[f"comparison:{c}"] = D.compare_discrete(members, c, max_categories, _order(c))
    for c in continuous:
        having = ds.members_with(c)
        if having:
            members = ds.only(having)
            out[f"histogram:{c}"] = D.histogram(members, c)
            out[f"density:{c}"] = D.density_curve(members, c)
            out[f"box:{c}"] = D.box_stats(members, c)
            out[f"log_scale:{c}"] = D.log_scale_advice(out[f"box:{c}"])
            both = [n for n in having if n in labelled]
            if both:
                out[f"box_by_class:{c}"] = D.box_stats(ds.only(both), c, [label])
    for c in datetimes:
        having = ds.members_with(c)
        if having:
            out[f"years:{c}"] = D.year_buckets(ds.only(having), c, year_bucket_threshold, year_bucket_size)
    if reference in ds.members_with(text):
        out["vocabulary"] = lexical.vocabulary_size(ds, text, reference)
        out["oov"] = lexical.oov_rates(ds, text, reference)
    if discrete and continuous:
        pair = ds.members_with(discrete[0], continuous[0])
        if pair:
            out["box_by_category"] = D.box_stats(ds.only(pair), continuous[0], [discrete[0]])
    if discrete:
        pair = ds.members_with(discrete[0], label)
        if pair:
            out["crosstab"] = D.crosstab_percent(ds.only(pair), discrete[0], label, max_categories)
    if analyze_text:
        texts = ds.only(ds.members_with(text))
        out["ttr"] = lexical.type_token_ratio(texts, text)
        per_class = [n for n in dict.fromkeys([reference, "test", "oot"]) if n in ds.members_with(text, label)]
        if per_class:
            out["ttr_by_class"] = lexical.type_token_ratio_by_class(
                ds.only(per_class), text, label, ttr_min_rows
            )
        if analyze_ngrams:
            for n, name in ((1, "unigrams"), (2, "bigrams")):
                if n == 2 and not bigrams:
                    continue
                tops = lexical.top_ngrams(texts, text, n, top_n)
                out[name] = tops
                out[f"{name}_overlap"] = lexical.dataset_overlap(tops, reference)
                if per_class:
                    by_class = lexical.top_ngrams(ds.only(per_class), text, n, top_n, [label])
                    out[f"{name}_by_class"] = by_class
                    others = [x for x in per_class if x != reference]
                    if others and reference in per_class:
                        out[f"{name}_class_overlap"] = lexical.class_overlap(by_class, reference, others, label)
    for first, second in comparisons:
        parts = drift.compare_pair(
            ds, first, second, [text, label], [*discrete, *other_discrete], continuous, datetimes
        )
        for family, tables in parts.items():
            for c, table in tables.items():
                out[f"pair:{first}:{second}:{family}:{c}"] = table
    return out


def profile_table(
    df: DataFrame,
    text: str = "text",
    label: str | None = None,
    date: str = "date",
    categorical: Sequence[str] = ("file_extension", "line_of_business"),
    languages: DataFrame | None = None,
    language_text: str = "text",
    language_label: str = "lang",
    key: str | None = None,
) -> Tables:
    """Profile of a single table. Language detection needs a labelled sample
    (``languages``) to learn from and a row key."""
    df = df.withColumn("text_length", n_chars(text)).withColumn("word_count", n_tokens(text))
    ds = DatasetSet({"table": df})
    out: Tables = {
        "missing": quality.null_profile(ds),
        "describe_numeric": quality.describe_numeric(ds),
        "describe_text": quality.describe_text(ds),
        "length_histogram": D.histogram(ds, "text_length", 50),
        "word_histogram": D.histogram(ds, "word_count", 50),
        "length_density": D.density_curve(ds, "text_length"),
        "word_density": D.density_curve(ds, "word_count"),
        "common_words": lexical.common_words(ds, text, 30),
        "bigrams": lexical.top_ngrams(ds, text, 2, 20),
    }
    if label is not None and label in df.columns:
        out["classes"] = D.value_counts(ds, label)
        out["length_by_class"] = D.box_stats(ds, "text_length", [label])
    if languages is not None and key is not None:
        names = class_names(languages.select(F.col(language_label).alias("y_true")))
        profile = language_profile(languages, language_text, language_label, names)
        found = detect_language(df, key, text, profile, names)
        out["language"] = found
        out["languages"] = D.value_counts(DatasetSet({"table": found}), "language")
    if date in df.columns:
        out["months"] = D.month_counts(ds, date)
    for c in categorical:
        if c in df.columns:
            out[f"distribution:{c}"] = D.discrete_distribution(ds, c, 20)
            out[f"length_by:{c}"] = D.box_stats(ds, "text_length", [c])
    return out


def compare_named(
    frames: Sequence[DataFrame],
    names: Sequence[str],
    text: str = "text",
    label: str = "label",
    metadata: Sequence[str] = (),
    top_n: int = 20,
    vocabulary: DataFrame | None = None,
    key: str | None = None,
) -> Tables:
    """Side-by-side report of parallel lists of tables and names. ``key`` adds
    the two-component TF-IDF points of every table."""
    if len(frames) != len(names):
        raise ValueError("the number of datasets and of names must be the same")
    ds = DatasetSet(
        {
            n: f.withColumn("n_tokens", n_tokens(text)).withColumn("n_chars", n_chars(text))
            for n, f in zip(names, frames)
        }
    )
    out: Tables = {
        "shape": quality.shapes(ds),
        "missing": quality.null_profile(ds),
        "classes": D.value_counts(ds, label, digits=3),
        "lengths": quality.describe_numeric(ds, ["n_tokens", "n_chars"]),
        "tokens": lexical.top_ngrams(ds, text, 1, top_n),
        "class_comparison": D.compare_discrete(ds, label),
        "token_histogram": D.histogram(ds, "n_tokens", 30),
        "tokens_by_class": D.mean_by_class(ds, F.col("n_tokens"), label, ["n_tokens"]),
        "bigrams": lexical.top_ngrams(ds, text, 2, top_n),
        "diversity": lexical.diversity(ds, text),
    }
    for c in metadata:
        having = ds.members_with(c)
        if having:
            out[f"distribution:{c}"] = D.value_counts(ds.only(having), c, digits=3)
    if vocabulary is not None:
        out["oov"] = lexical.oov_rate_against(ds, text, vocabulary)
    if key is not None:
        for n in ds.names:
            frame = ds.frames[n].select(key, text)
            model = features.fit_tfidf(frame, text)
            points, _ = features.svd_points(features.tfidf(model, frame, text), key, "features")
            out[f"points:{n}"] = points.withColumn(DATASET, F.lit(n))
    return out


def token_buckets(ds: DatasetSet, tokens: str) -> DataFrame:
    """Rows per short-text bucket in display order."""
    df = ds.long([tokens]).withColumn("bucket", fixed_bucket(tokens))
    counts = df.filter("bucket IS NOT NULL").groupBy(DATASET, "bucket").agg(F.count(F.lit(1)).alias("n"))
    order = F.array(*[F.lit(x) for x in SHORT_BUCKET_LABELS])
    return counts.withColumn("position", F.array_position(order, F.col("bucket")).cast("int"))
