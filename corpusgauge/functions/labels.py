"""Clean-up of free-text labels against a class list.

Plain expressions on a literal class list (tens to a few thousand names), so
they need no join and also work on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col
from .text import SPACE

# Prefixes removed from an answer, first match in this order.
PREFIXES = (
    "label:",
    "category:",
    "predicted label:",
    "classification:",
    "the category is",
    "the correct category is",
    "i classify this as",
)
# Placeholders of labels that are no class.
INVALID = "INVALID_PREDICTION"
FAILED = "ERROR_PREDICTION"
MISSING_PRED = "MISSING_PRED"
EMPTY_PRED = "EMPTY_PRED"
# A class name inside a longer answer counts while fewer characters are extra.
MAX_SURPLUS = 20


def strip(c: Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def _names(classes: Sequence[str]) -> Column:
    return F.array(
        *[F.struct(F.lit(c).alias("name"), F.lit(c.lower()).alias("low")) for c in classes]
    )


def normalise_label(c: Column | str, classes: Sequence[str]) -> Column:
    """Trim, drop one known prefix and trailing punctuation, then match the
    class list: exactly, whatever the case, or as the first class contained in
    a barely longer answer. An unmatched answer is returned cleaned."""
    text = strip(as_col(c))
    unprefixed = None
    for p in PREFIXES:
        cond = F.lower(text).startswith(p)
        cut = strip(F.substring(text, len(p) + 1, 2**31 - 1))
        unprefixed = F.when(cond, cut) if unprefixed is None else unprefixed.when(cond, cut)
    text = unprefixed.otherwise(text)
    text = strip(F.regexp_replace(text, "[.,;\"']+$", ""))
    low = F.lower(text)
    names = _names(classes)
    same = F.filter(names, lambda x: x["low"] == low)
    inside = F.filter(
        names,
        lambda x: F.contains(low, x["low"])
        & (F.char_length(text) - F.char_length(x["name"]) < MAX_SURPLUS),
    )
    return (
        F.when(text.isin(*classes), text)
        .when(F.size(same) > 0, F.get(same, F.lit(0))["name"])
        .when(F.size(inside) > 0, F.get(inside, F.lit(0))["name"])
        .otherwise(text)
    )


def match_label(c: Column | str, classes: Sequence[str]) -> Column:
    """Short variant: trimmed answer if it is a class, else the first class it
    contains (case counts), else unchanged. Missing and empty answers become
    placeholders."""
    c = as_col(c)
    text = strip(c)
    inside = F.filter(F.array(*[F.lit(x) for x in classes]), lambda x: F.contains(text, x))
    return (
        F.when(c.isNull(), MISSING_PRED)
        .when(text == "", EMPTY_PRED)
        .when(text.isin(*classes), text)
        .when(F.size(inside) > 0, F.get(inside, F.lit(0)))
        .otherwise(text)
    )


def mark_invalid(c: Column | str, classes: Sequence[str]) -> Column:
    """Labels outside the class list become one placeholder; a failed call
    (NULL) counts as outside."""
    c = F.coalesce(as_col(c), F.lit(FAILED))
    return F.when(c.isin(*classes), c).otherwise(F.lit(INVALID))


def report_labels(classes: Sequence[str]) -> list[str]:
    """Class list of a report that may contain the placeholder."""
    return sorted({*classes, INVALID})


def closest_label(c: Column | str, classes: Sequence[str]) -> Column:
    """Struct ``(distance, label)`` of the class with the smallest edit
    distance, whatever the case; the first in list order on a tie."""
    low = F.lower(as_col(c))
    options = F.array(
        *[
            F.struct(
                F.levenshtein(low, F.lit(x.lower())).alias("distance"),
                F.lit(i).alias("position"),
                F.lit(x).alias("label"),
            )
            for i, x in enumerate(classes)
        ]
    )
    best = F.array_min(options)
    return F.when(low.isNotNull(), F.struct(best["distance"].alias("distance"), best["label"].alias("label")))
