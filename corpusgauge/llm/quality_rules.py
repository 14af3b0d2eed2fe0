"""Quality rules: a table of thresholds compiled into one projection.

Measures of length, symbols, stop words, lines and repetition are Column
expressions; no user function runs and no row leaves its partition, so a hot
source or a long text costs what its characters cost.

Defined results: a NULL or blank text has no words, fails the base rule and is
not kept. Repeated rows are judged each for itself. Further columns of the input
pass through unless their name is one that the result defines. Every text is read
whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import string_or_empty, word_array

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it was as with be by on are this from what "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la que el en y a los se del las un por con no una su para es al lo "
    "le et les des est dans qui sur pas pour au par il elle du ne ce"
).split()
# Characters that count as symbols, and white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a measure over nothing is 0."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        # cross-multiplied: exact for whole numbers
        n = F.col(self.numerator).cast("double")
        d = F.col(self.denominator).cast("double") if self.denominator else F.lit(1.0)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (n >= F.lit(float(self.low)) * d)
        if self.high is not None:
            ok = ok & (n <= F.lit(float(self.high)) * d)
        return ok

    def sql(self) -> str:
        d = f"{self.denominator}::double" if self.denominator else "1.0::double"
        parts = []
        if self.low is not None:
            parts.append(f"{self.numerator}::double >= {float(self.low)!r}::double * {d}")
        if self.high is not None:
            parts.append(f"{self.numerator}::double <= {float(self.high)!r}::double * {d}")
        return "(" + " and ".join(parts or ["true"]) + ")"


BASE = (
    Rule("enough_words", "n_words", None, low=50),
    Rule("little_repetition", "n_repeat_words", "n_words", high=0.5),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("few_symbols", "n_symbols", "n_words", high=0.2),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("few_repeated_lines", "n_dup_lines", "n_lines", high=0.5),
)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measures of each text.

    Words repeated in windows of three are found in two steps inside the row:
    window hashes packed with their positions are sorted as whole numbers, and
    only windows whose hash has an equal neighbour are compared as texts.
    """
    named = [
        "n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words",
    ]
    rest = [c for c in df.columns if c not in named]
    w, t = F.col("__words"), F.col("__text")
    out = df.select(*[F.col(f"`{c}`") for c in rest], string_or_empty(df, text).alias("__text"))
    has_word = f"[^{''.join(f'\\x{ord(c):02x}' for c in SPACES)}]"
    out = out.withColumns(
        {
            "__words": word_array(t),
            "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(has_word)),
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        }
    ).drop("__text")
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            # bits that a position needs
            "__bits": F.length(F.bin(F.size(w).cast("long"))),
        }
    ).drop("__lines")
    # the unsigned shift drops the position again; NULL beside the ends is no match
    out = out.withColumn(
        "__sorted",
        F.expr("""sort_array(transform(
            if(n_words >= 3, sequence(0, size(__words) - 3), cast(array() as array<int>)),
            i -> shiftleft(xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2)), __bits) | bigint(i)))"""),
    )
    out = out.withColumn(
        "__near",
        F.expr("""transform(
            filter(__sorted, (x, i) -> x >>> __bits = get(__sorted, i - 1) >>> __bits
                                       or x >>> __bits = get(__sorted, i + 1) >>> __bits),
            x -> int(x & (shiftleft(1L, __bits) - 1)))"""),
    ).drop("__sorted")
    out = out.withColumn(
        "__near",
        F.expr("sort_array(transform(__near, p -> struct(concat_ws(' ', slice(__words, p + 1, 3)) as g, p as p)))"),
    )
    out = out.withColumn(
        "__near",
        F.expr("filter(__near, (x, i) -> x.g = get(__near, i - 1).g or x.g = get(__near, i + 1).g)"),
    )
    covered = F.expr("array_distinct(flatten(transform(__near, x -> array(x.p, x.p + 1, x.p + 2))))")
    out = out.withColumn("n_repeat_words", F.size(covered).cast("long"))
    return out.select(*rest, *named)


def judge(
    df: DataFrame, text: str = "text", base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """``df`` with its measures, ``base_failed``, one ``ok_<rule>`` per rule and
    ``kept`` (all rules hold)."""
    out = measures(df, text)
    drop = {"base_failed", "kept", *(f"ok_{r.name}" for r in rules)}
    out = out.select(*[c for c in out.columns if c not in drop])
    failed = F.lit(False)
    for r in base:
        failed = failed | ~r.holds()
    kept = ~failed
    for r in rules:
        kept = kept & r.holds()
    return out.select("*", failed.alias("base_failed"), *[r.holds().alias(f"ok_{r.name}") for r in rules], kept.alias("kept"))


def judge_sql(table: str = "documents") -> str:
    """The same verdicts in SQL."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    failed = " or ".join(f"not {r.sql()}" for r in BASE)
    rules = " and ".join(r.sql() for r in RULES)
    space, space_set = r"[\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
    return f"""
    with w as (
      select doc_id, coalesce(text, '') as t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda x: x <> '') as ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
      from documents),
    g as (
      select doc_id, t, ws, ls,
             list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) as gs
      from w),
    rep as (
      select doc_id, count(distinct p + k) as n_repeat_words
      from (select doc_id, p from (select doc_id, unnest(gs) as gr, generate_subscripts(gs, 1) as p from g)
            qualify count(*) over (partition by doc_id, gr) >= 2), (select unnest([0, 1, 2]) as k)
      group by doc_id),
    m as (
      select g.doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '{space_set}', '', 'g'))::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
             len(list_filter(ws, lambda x: lower(x) in ({stop})))::bigint as n_stop_words,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from g left join rep using (doc_id))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           ({failed}) as base_failed, not ({failed}) and {rules} as kept
    from m""".replace("from documents)", f"from {table})")
