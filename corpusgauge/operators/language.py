"""Language of a document from character trigrams.

A profile is learned from labelled text; documents are scored with smoothed
log-probabilities. A trigram is a number made of its three characters. The tasks count
the numbers of labelled texts before anything is shuffled, and score a text by looking
its numbers up in a sorted table of weights that travels to them: no row per character
and no join. Only a profile larger than ``PROFILE_ROWS`` is joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

NOT_JUDGED = "error"
# Trigrams sent to every executor at most; beyond this the join shuffles.
PROFILE_ROWS = 1_000_000
# Characters that are looked at together.
PART_CHARS = 1 << 19


def letters(c: Column | str) -> Column:
    """Lower-cased letters with every other run replaced by one blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", " ")


def _numbered(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Trigram numbers of texts, the text of each, and the range of texts, in parts of
    bounded size; a longer text is a part of its own."""
    at, held, size = 0, [], 0
    values = texts.to_pylist()

    def part(end: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        lengths = np.array([len(t) for t in held], dtype=np.int64)
        c = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(held)), lengths)
        if len(c) < 3:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), at, end
        inside = owner[2:] == owner[:-2]
        return ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside], owner[2:][inside], at, end

    for i, t in enumerate(values):
        t = t or ""
        if held and size + len(t) > PART_CHARS:
            yield part(i)
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield part(len(values))


def language_profile(df: DataFrame, text: str, lang: str, languages: Sequence[str]) -> DataFrame:
    """One row per trigram (``gram``, its number) with its count in every language."""
    place = {x: i for i, x in enumerate(languages)}
    m = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = np.array([place.get(x, -1) for x in b.column(1).to_pylist()], dtype=np.int64)
            for codes, owner, begin, _ in _numbered(b.column(0)):
                # a language outside the list makes the gram known, and counts for none
                for i in range(-1, m):
                    gram, n = np.unique(codes[of[owner + begin] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.full(len(gram), i, dtype=np.int32)), pa.array(n)], ["gram", "i", "n"])

    known = spread(df.filter(F.col(lang).isNotNull()).select(letters(text).alias("t"), F.col(lang).alias("l")))
    parts = known.mapInArrow(run, "gram long, i int, n long")
    sums = [F.coalesce(F.sum(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(m)]
    return parts.groupBy("gram").agg(*sums)


def detect_language(
    df: DataFrame, key: str, text: str, profile: DataFrame, languages: Sequence[str]
) -> DataFrame:
    """``(key, language)``: NULL for NULL text, ``error`` for text too short to
    judge, else the language with the highest add-one smoothed log-likelihood
    (first in order on a tie). ``profile`` is read twice; store it first
    (:func:`~corpusgauge.session.cut_lineage`)."""
    m = len(languages)
    # two scalars per language and the number of known trigrams shape the plan
    tot = profile.agg(
        F.count(F.lit(1)).alias("v"), *[F.sum(f"c{i}").alias(f"t{i}") for i in range(m)]
    ).head()
    v = tot["v"]
    floor = np.log([1.0 / ((tot[f"t{i}"] or 0) + v + 1) for i in range(m)])
    if v > PROFILE_ROWS:
        return _joined(df, key, text, profile, languages, floor)
    table = profile.select("gram", *[F.ln(F.col(f"c{i}") + 1).alias(f"l{i}") for i in range(m)]).toArrow()
    gram = table.column("gram").to_numpy() if v else np.zeros(0, dtype=np.int64)
    order = np.argsort(gram)
    gram = gram[order]
    # the last row is for trigrams that no profile holds
    weights = np.vstack([np.column_stack([table.column(f"l{i}").to_numpy() for i in range(m)])[order] + floor, floor[None, :]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[str | None] = []
            for codes, owner, begin, end in _numbered(b.column(1)):
                at = np.searchsorted(gram, codes)
                hit = at < len(gram)
                hit[hit] = gram[at[hit]] == codes[hit]
                at[~hit] = len(gram)
                n = np.bincount(owner, minlength=end - begin)
                total = np.column_stack([np.bincount(owner, weights=weights[at, i], minlength=end - begin) for i in range(m)])
                best = total.argmax(axis=1)
                found += [languages[k] if c else NOT_JUDGED for k, c in zip(best.tolist(), n.tolist())]
            missing = b.column(1).is_null().to_pylist()
            names = pa.array([None if gone else f for f, gone in zip(found, missing)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), names], ["k", "language"])

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(key, text)).select(key, letters(text).alias("t"))
    return rows.mapInArrow(run, f"`{key}` {kind}, language string")


def _joined(df: DataFrame, key: str, text: str, profile: DataFrame, languages: Sequence[str], floor: np.ndarray) -> DataFrame:
    """The same with a profile too large to travel: counted trigrams meet it in a join."""
    m = len(languages)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for codes, owner, begin, end in _numbered(b.column(1)):
                for i in range(end - begin):
                    gram, n = np.unique(codes[owner == i], return_counts=True)
                    keys = b.column(0).take(pa.array(np.full(len(gram), begin + i)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(gram), pa.array(n)], ["k", "gram", "n"])

    rows = spread(df.select(key, text)).select(key, letters(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, gram long, n long")
    logs = profile.select("gram", *[F.ln(F.col(f"c{i}") + 1).alias(f"l{i}") for i in range(m)])
    score = lambda i: F.sum(F.col("n") * (F.coalesce(F.col(f"l{i}"), F.lit(0.0)) + F.lit(float(floor[i])))).alias(f"s{i}")
    scored = rows.join(logs, "gram", "left").groupBy(key).agg(*[score(i) for i in range(m)])
    best = F.greatest(*[F.col(f"s{i}") for i in range(m)]) if m > 1 else F.col("s0")
    pick = None
    for i, name in enumerate(languages):
        cond = F.col(f"s{i}") == best
        pick = F.when(cond, name) if pick is None else pick.when(cond, name)
    scored = scored.select(key, pick.alias("found"))
    return df.select(key, F.col(text).isNull().alias("empty")).join(scored, key, "left").select(
        key,
        F.when(F.col("empty"), F.lit(None)).otherwise(F.coalesce("found", F.lit(NOT_JUDGED))).alias("language"),
    )
