"""Vocabulary statistics (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..datasets import DatasetSet
from ..functions.text import raw_tokens
from ..operators import distributions, language
from ..operators import lexical as L
from ..session import cut_lineage
from .registry import (
    DS,
    GAPPY,
    langs,
    STOP_LIST,
    basic_sql,
    bigrams_sql,
    docs,
    gappy,
    query,
    split_sql,
    table,
    words_sql,
)

_TOK = f"tok as (select dataset, token, count(*) as n from (select dataset, unnest({basic_sql()}) as token from ds) group by 1, 2)"
_RAW = f"tok as (select dataset, token, count(*) as n from (select dataset, unnest({split_sql('text')}) as token from ds) group by 1, 2)"
_NOSTOP = f"tok as (select dataset, token, count(*) as n from (select dataset, unnest({basic_sql()}) as token from ds) where not list_contains({STOP_LIST}, token) group by 1, 2)"


@query(
    "f1_vocabulary_size",
    f"with {DS}, {_TOK} select dataset, count(*) as vocabulary, sum(n)::bigint as tokens from tok where dataset = 'train' group by 1",
)
def f1(spark, sf):
    return L.vocabulary_size(docs(spark, sf), "text", "train")


@query(
    "f2_oov_rates",
    f"""with {DS}, {_TOK}, v as (select token from tok where dataset = 'train')
        select dataset, sum(n)::bigint as tokens, coalesce(sum(n) filter (where v.token is null), 0)::bigint as oov_tokens, count(*) as words,
          count(*) filter (where v.token is null) as oov_words,
          round(coalesce(sum(n) filter (where v.token is null), 0) * 100 / sum(n), 6) as oov_token_pct,
          round(count(*) filter (where v.token is null) * 100 / count(*), 6) as oov_word_pct
        from tok left join v using (token) where dataset <> 'train' group by 1""",
)
def f2(spark, sf):
    return L.oov_rates(docs(spark, sf), "text", "train")


@query(
    "f3_oov_rate_case_sensitive",
    f"""with {DS}, {_RAW}, v as (select distinct unnest({split_sql('text')}) as token from benchmark)
        select dataset, sum(n)::bigint as tokens, coalesce(sum(n) filter (where v.token is null), 0)::bigint as oov_tokens,
          round(coalesce(sum(n) filter (where v.token is null), 0) * 100 / sum(n), 2) as oov_rate
        from tok left join v using (token) group by 1""",
)
def f3(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(raw_tokens("text")).alias("token"))
    return L.oov_rate_against(docs(spark, sf), "text", words)


@query(
    "f4_type_token_ratio",
    f"""with {DS}, {_NOSTOP} select dataset, count(*) as words, sum(n)::bigint as tokens, round(count(*) * 100 / sum(n), 6) as ttr from tok group by 1""",
)
def f4(spark, sf):
    return L.type_token_ratio(docs(spark, sf), "text")


@query(
    "f5_type_token_ratio_by_class",
    f"""with {GAPPY}, g as (select * from gappy where text is not null and lang is not null and dataset <> 'prod'),
        s as (select dataset, lang as label, count(*) as n_rows from g group by 1, 2 having count(*) >= 10),
        t as (select dataset, lang as label, unnest({basic_sql()}) as token from g),
        k as (select dataset, label, token, count(*) as n from t where not list_contains({STOP_LIST}, token) group by 1, 2, 3)
        select dataset, label, count(*) as words, sum(n)::bigint as tokens, n_rows, round(count(*) * 100 / sum(n), 6) as ttr
        from k join s using (dataset, label) group by dataset, label, n_rows""",
)
def f5(spark, sf):
    return L.type_token_ratio_by_class(gappy(spark, sf).only(["train", "test", "oot"]), "text", "lang")


@query(
    "f6_diversity",
    f"""with {DS}, {_RAW}, t as (select *, sum(n) over (partition by dataset) as total from tok)
        select dataset, sum(n)::bigint as total_tokens, count(*) as unique_tokens, round(count(*) / sum(n), 4) as ttr,
          round(count(*) filter (where n = 1) / sum(n), 4) as hapax_ratio, round(-sum((n / total) * log2(n / total)), 4) as shannon_entropy
        from t group by 1""",
)
def f6(spark, sf):
    return L.diversity(docs(spark, sf), "text")


_CLEAN = r"regexp_replace(lower(text), '[!-/:-@\[\]^_`{|}~]', '', 'g')"


@query(
    "f7_common_words",
    f"""with {DS}, t as (select dataset, unnest({split_sql(_CLEAN)}) as token from ds),
        c as (select dataset, token, count(*) as n from t group by 1, 2)
        select dataset, (row_number() over (partition by dataset order by n desc, token))::int as rank, token, n from c
        qualify row_number() over (partition by dataset order by n desc, token) <= 30""",
)
def f7(spark, sf):
    return L.common_words(docs(spark, sf), "text", 30)


def _top_sql(name: str, grams: str, keys: str, src: str, k: int = 20) -> str:
    return f"""{name} as (select {keys}, ngram, n, row_number() over (partition by {keys} order by n desc, ngram) as rank
      from (select {keys}, ngram, count(*) as n from (select {keys}, unnest({grams}) as ngram from {src}) group by {keys}, ngram) qualify rank <= {k})"""


_W = f"w as (select dataset, lang, {words_sql()} as t from ds)"
_UNI = f"{DS}, {_W}, {_top_sql('tops', 't', 'dataset', 'w')}"
_BI = f"{DS}, {_W}, {_top_sql('tops', bigrams_sql('t'), 'dataset', 'w')}"
_CLS = f"{DS}, {_W}, {_top_sql('tops', 't', 'dataset, lang', 'w')}"
_CLS2 = f"{DS}, {_W}, {_top_sql('tops', bigrams_sql('t'), 'dataset, lang', 'w')}"


@query("f8_top_unigrams", f"with {_UNI} select dataset, rank::int as rank, ngram, n from tops")
def f8(spark, sf):
    return L.top_ngrams(docs(spark, sf), "text")


@query("f8_top_bigrams", f"with {_BI} select dataset, rank::int as rank, ngram, n from tops")
def f8_bi(spark, sf):
    return L.top_ngrams(docs(spark, sf), "text", 2)


@query("f9_class_unigrams", f"with {_CLS} select dataset, lang, rank::int as rank, ngram, n from tops")
def f9(spark, sf):
    return L.top_ngrams(docs(spark, sf), "text", 1, by=["lang"])


@query("f9_class_bigrams", f"with {_CLS2} select dataset, lang, rank::int as rank, ngram, n from tops")
def f9_bi(spark, sf):
    return L.top_ngrams(docs(spark, sf), "text", 2, by=["lang"])


def _class_overlap_sql(tops: str) -> str:
    return f"""with {tops}, r as (select lang, ngram from tops where dataset = 'train'), s as (select lang, count(*) as n_reference from r group by 1),
      k as (select dataset, lang from tops where dataset in ('test', 'oot') union select d.dataset, lang from s, (values ('test'), ('oot')) d(dataset)),
      o as (select t.dataset, t.lang, count(*) as overlap from tops t join r using (lang, ngram) where t.dataset in ('test', 'oot') group by 1, 2)
      select 'train vs ' || dataset as comparison, lang, coalesce(overlap, 0) as overlap, coalesce(n_reference, 0) as n_reference,
        round(coalesce(overlap * 100 / n_reference, 0), 6) as overlap_pct, printf('%.1f%%', coalesce(overlap * 100 / n_reference, 0)) as overlap_text
      from k left join o using (dataset, lang) left join s using (lang)"""


@query("f10_class_overlap_unigrams", _class_overlap_sql(_CLS))
def f10(spark, sf):
    tops = L.top_ngrams(docs(spark, sf), "text", 1, by=["lang"])
    return L.class_overlap(tops, "train", ["test", "oot"], "lang")


@query("f10_class_overlap_bigrams", _class_overlap_sql(_CLS2))
def f10_bi(spark, sf):
    tops = L.top_ngrams(docs(spark, sf), "text", 2, by=["lang"])
    return L.class_overlap(tops, "train", ["test", "oot"], "lang")


@query(
    "f11_dataset_overlap",
    f"""with {_BI}, r as (select ngram from tops where dataset = 'train')
        select dataset, count(r.ngram) as overlap, (select count(*) from r) as denominator, round(count(r.ngram) * 100 / (select count(*) from r), 6) as overlap_pct
        from tops left join r using (ngram) where dataset <> 'train' group by 1""",
)
def f11(spark, sf):
    return L.dataset_overlap(L.top_ngrams(docs(spark, sf), "text", 2), "train")


_GRAMS = """list_filter(case when length(t) >= 3 then list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)) else [] end, lambda g: g <> '   ')"""
_LANG_SQL = f"""
g as (select doc_id, unnest({_GRAMS}) as gram from (select doc_id, regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g') as t from documents)),
prof as (select gram, lang, count(*) as c from g join documents using (doc_id) where doc_id % 10 < 6 group by 1, 2),
v as (select count(distinct gram) as v from prof), tot as (select lang, sum(c) as t from prof group by 1),
dg as (select doc_id, gram, count(*) as k from g group by 1, 2),
sc as (select doc_id, tot.lang, sum(k * ln((coalesce(c, 0) + 1) * (1.0::double / (t + v + 1)))) as s
       from dg join tot on true cross join v left join prof on prof.gram = dg.gram and prof.lang = tot.lang group by 1, 2),
best as (select doc_id, lang as language from sc qualify row_number() over (partition by doc_id order by s desc, lang) = 1),
found as (select doc_id, coalesce(language, 'error') as language from documents left join best using (doc_id))
"""


def _detected(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text", "lang")
    known = df.filter("doc_id % 10 < 6")
    names = langs(known)
    profile = cut_lineage(language.language_profile(known, "text", "lang", names))
    return language.detect_language(df, "doc_id", "text", profile, names)


@query("f12_language", f"with {_LANG_SQL} select * from found")
def f12(spark, sf):
    return _detected(spark, sf)


@query(
    "f12_language_distribution",
    f"with {_LANG_SQL} select 'all' as dataset, language as value, count(*) as n, round(count(*) / sum(count(*)) over (), 4) as proportion from found group by 2",
)
def f12_distribution(spark, sf):
    return distributions.value_counts(DatasetSet({"all": _detected(spark, sf)}), "language")
