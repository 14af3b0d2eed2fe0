"""Row-level text functions: Column in, Column out, no shuffle and no Python UDF.

Word and white-space classes are spelled out instead of using ``\\w`` and
``\\s``: those are ASCII-only in Java unless a flag is set, and the texts carry
accents.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col

# The character classes of the tokenisers.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
WORD = r"[\p{L}\p{N}_]"
TOKEN = WORD + "{2,}"
# every ASCII punctuation mark except the backslash
PUNCT = r"[!-/:-@\[\]^_`{|}~]"
EMAIL = r"(?U)\b[\w.-]+@[\w.-]+\.\w{2,4}\b"
REPEAT = r"(?U)\b(\w+)( \1\b)+"
TO_END = 1_000_000_000  # "to the end" for slice
UNSAFE_PATH = r"[^\p{L}\p{N}_-]+"

# Display order of the document-length buckets.
TOKEN_BUCKET_ORDER = ("0-100", "101-500", "501-1000", "1001-5000", "5001-10000", "10000+", "5000+")
# Labels of the short-text buckets and the upper edges they imply.
SHORT_BUCKET_LABELS = ("0-10", "11-20", "21-30", "31-50", "51-100", "100+")
SHORT_BUCKET_EDGES = (0, 10, 20, 30, 50, 100, None)


def _no_tokens() -> Column:
    return F.array().cast("array<string>")


def raw_tokens(c: Column | str) -> Column:
    """White-space tokens, case kept. NULL text gives an empty array."""
    parts = F.filter(F.split(as_col(c), SPACE), lambda x: x != "")
    return F.coalesce(parts, _no_tokens())


def basic_tokens(c: Column | str) -> Column:
    """White-space tokens of the lower-cased text."""
    return raw_tokens(F.lower(as_col(c)))


def word_tokens(c: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """Runs of two or more word characters of the lower-cased text, without
    the stop words."""
    toks = F.regexp_extract_all(F.lower(as_col(c)), F.lit(TOKEN), F.lit(0))
    return F.coalesce(without(toks, stop_words), _no_tokens())


def without(tokens: Column, words: Sequence[str]) -> Column:
    """Drop listed words from a token array (a literal IN list is a hash set)."""
    if not words:
        return tokens
    return F.filter(tokens, lambda x: ~x.isin(*words))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array; empty when it is too short. The
    array is zipped with itself shifted, which stays linear in its length
    however the expression is inlined."""
    if n == 1:
        return tokens
    out = tokens
    for shift in range(1, n):
        later = F.slice(tokens, shift + 1, TO_END)
        # past the end the partner is NULL and so is the joined value
        out = F.zip_with(out, later, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda x: x.isNotNull())


def n_tokens(c: Column | str) -> Column:
    """Number of white-space tokens; NULL for NULL text."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.size(raw_tokens(c)).cast("long"))


def n_chars(c: Column | str) -> Column:
    return F.char_length(as_col(c)).cast("long")


def strip_punctuation(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(as_col(c)), PUNCT, "")


def redact_names(c: Column | str, names: Sequence[str]) -> Column:
    """Remove whole-word occurrences of a short list of names (case kept)."""
    if not names:
        return as_col(c)
    # quoted here so that a name is matched literally by Java's engine
    body = "|".join(re.sub(r"([^\w\s])", r"\\\1", n) for n in names)
    return F.regexp_replace(as_col(c), rf"(?U)\b({body})\b", "")


def drop_words(c: Column | str, words: Sequence[str]) -> Column:
    """Drop white-space tokens found in ``words`` whatever their case and join
    the rest with one space."""
    toks = raw_tokens(c)
    listed = sorted({w.lower() for w in words})
    kept = F.filter(toks, lambda x: ~F.lower(x).isin(*listed)) if listed else toks
    return F.when(as_col(c).isNotNull(), F.array_join(kept, " "))


def collapse_repeats(c: Column | str) -> Column:
    """Keep the first of immediately repeated words."""
    return F.regexp_replace(as_col(c), REPEAT, "$1")


def blank_emails(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), EMAIL, " ")


def path_safe(c: Column | str) -> Column:
    """A label usable as a folder name."""
    return F.regexp_replace(as_col(c), UNSAFE_PATH, "_")


def fixed_bucket(
    c: Column | str,
    edges: Sequence[float | None] = SHORT_BUCKET_EDGES,
    labels: Sequence[str] = SHORT_BUCKET_LABELS,
    include_lowest: bool = True,
) -> Column:
    """Right-closed buckets ``(edge, next edge]``; a last edge of ``None`` is
    open. ``include_lowest`` also takes the first edge into the first bucket."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per pair of edges is needed")
    c = as_col(c)
    out = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = (c >= lo) if (i == 0 and include_lowest) else (c > lo)
        if hi is not None:
            cond = cond & (c <= hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def bucket_rank(c: Column | str, order: Sequence[str] = TOKEN_BUCKET_ORDER) -> Column:
    """Position of a bucket label in a given display order; NULL if unlisted."""
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), as_col(c))
    return F.when(pos > 0, pos.cast("int"))
