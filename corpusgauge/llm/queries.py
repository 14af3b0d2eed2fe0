"""Registered queries of the subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    classifier, decontaminate, html_extract, line_dedup, mixture, near_dedup, periodic, pii, quality_rules, suffix_dedup, url_filter,
    warc, whitening,
)
from .store import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_quality_rules", quality_rules.judge_sql())
def op1_quality_rules(spark, sf_dir):
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op7_mixture", mixture.mix_sql())
def op7_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixture.mix(docs).documents.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_warc_archive", warc.archive_sql())
def op8_warc_archive(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query("op9_url_filter", url_filter.judge_sql())
def op9_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


@query("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.score_documents(docs, table(spark, sf_dir, "labels"))


@query("op6_near_duplicates")
def op6_near_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, near_dedup.Forest(shingle=4))


@query("op4_pii")
def op4_pii(spark, sf_dir):
    found = pii.label_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = "x -> concat(x.kind, ':', x.start, ':', x.end)"
    # sorted by kind as listed, then by place
    order = "case x.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(pii.KINDS)) + " end"
    every = f"array_sort(transform(concat(base, added), x -> struct({order} as o, x.start as start, x.end as end, x.kind as kind)))"
    count = lambda k: F.expr(f"bigint(size(filter(base, x -> x.kind = '{k}')))").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.expr(f"sha2(array_join(transform(base, {text}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform({every}, {text}), ',')").alias("spans"),
        F.expr("bigint(size(added))").alias("n_added"),
    )


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 400, keep="none")
    return out.select(
        "doc_id",
        "n_bytes",
        F.expr("n_bytes - bigint(octet_length(kept))").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


@query("op5_line_dedup")
def op5_line_dedup(spark, sf_dir):
    return line_dedup.line_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.looped_text("doc_id", "text").alias("text"))
    found = periodic.periodic_runs(docs)
    # runs come by start, then period: a later one must be greater to be taken
    best = F.expr(
        """aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>),
                     (b, x) -> if(b is null or x.length * b.period > b.length * x.period, x, b))"""
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.expr("sha2(array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf_dir):
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    # beyond the range of a long the exact deviation has none
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def _main_text_sql() -> str:
    """The given pages keep their whole main text, and nothing else, in one article
    element of headings and paragraphs; SQL can cut that out and decode it."""
    steps = [
        ("'<!--.*?-->|<br>'", "' '"),
        ("'</?(p|h1)>'", "chr(10)"),
        ("'<[^>]*>'", "''"),
        (r"'[\x20\t\x0B\x0C\r]+'", "' '"),
        (r"' *\n[ \n]*'", "chr(10)"),
        (r"'^[ \n]+|[ \n]+$'", "''"),
        ("'&quot;?'", "'\"'"),
        ("'&amp;?'", "'&'"),
    ]
    text = "regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's')"
    for pattern, to in steps:
        text = f"regexp_replace({text}, {pattern}, {to}, 'gs')"
    return f"select page_id, url, text, length(text) as n_chars from (select page_id, url, {text} as text from pages)"


@query("op13_html_extraction", _main_text_sql())
def op13_html_extraction(spark, sf_dir):
    field = html_extract.fit(html_extract.labelled_pages(spark))
    out = html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), field)
    return out.withColumn("n_chars", F.length("text").cast("long"))
