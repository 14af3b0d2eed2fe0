"""Quality classifier: random Fourier features of document statistics, ridge
regression from partition-summed normal equations, isotonic calibration.

The features approximate a Gaussian kernel: ``sqrt(2/D) cos(Wx + b)`` with fixed
seeds. Every partition of the labelled rows adds up its own D x D matrix, whose
rows are summed by Spark; the driver solves one system of bounded size. Scores
are calibrated by pool-adjacent-violators over the counts of ``BINS`` score bins,
taken from labelled rows that the fit has not seen.

Statistics are computed for every document over its whole text in one pass;
labels join that narrow table, never the texts. At most ``max_labelled`` labelled
rows are used, the ones with the smallest digest of their key.

Defined results: a NULL or empty text has statistics of 0 and is scored like any
other; repeated rows get equal scores; rows without a label are scored only; with
no usable labels every score is 0.5. Further columns of the input are left out,
and labels never reach the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored
from .textbytes import Chunk, chunks, mix64, per_text

FEATURES = (
    "words", "word_bytes", "long_words", "symbols", "bars", "upper", "digits", "marks", "lines", "line_words",
    "distinct_words", "repeated_windows", "next_equal", "distinct_lines", "short_words", "commas",
)
BINS = 512


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


# Character classes.
SYMBOLS, BARS, MARKS = _class("#*$%&<>@^~=_{}[]\\"), _class("|"), _class("!?;:")
UPPER, DIGITS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes per text."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def statistics(c: Chunk) -> np.ndarray:
    """One row of ``FEATURES`` per text of the chunk."""
    n = len(c)
    starts, ends, first = c.words()
    words = np.diff(first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(first))
    per = np.maximum(words, 1.0)
    size = (ends - starts).astype(float)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[c.offs]).astype(float)
    h = c.span_hash(c.prefix(lower=True), starts, ends)
    lb, le, lfirst = c.lines()
    lines = np.diff(lfirst).astype(float)
    lowner = np.repeat(np.arange(n), np.diff(lfirst))
    lhash = c.span_hash(c.prefix(), lb, le)
    w3 = np.zeros(n)
    if len(h) >= 3:
        inside = owner[2:] == owner[:-2]
        g = mix64(mix64(h[:-2]) * np.uint64(3) + mix64(h[1:-1] + np.uint64(1)) * np.uint64(5) + h[2:])[inside]
        own = owner[2:][inside]
        total = np.bincount(own, minlength=n)
        w3 = (total - _distinct(g, own, n)) / np.maximum(total, 1)
    same = np.zeros(len(h))
    if len(h) >= 2:
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    return np.column_stack(
        [
            np.log1p(words),
            per_text(size, first) / per,
            per_text((size > 15).astype(float), first) / per,
            count(SYMBOLS[c.buf]) / per,
            count(BARS[c.buf]) / per,
            count(UPPER[c.buf]) / per,
            count(DIGITS[c.buf]) / per,
            count(MARKS[c.buf]) / per,
            np.log1p(lines),
            np.log1p(words / np.maximum(lines, 1.0)),
            _distinct(h, owner, n) / per,
            w3,
            per_text(same, first) / per,
            _distinct(lhash, lowner, n) / np.maximum(lines, 1.0),
            per_text((size <= 3).astype(float), first) / per,
            count(c.buf == ord(",")) / per,
        ]
    )


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``x``, the statistics of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [statistics(c) for c in chunks(b.column(1))]
            if parts:
                x = np.vstack(parts)
                flat = pa.array(x.ravel())
                at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, flat)], ["k", "x"])

    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind}, x array<double>")


@dataclass
class Model:
    """Standardisation, projection, ridge weights and calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    edges: np.ndarray
    steps: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8.0, 8.0)
        f = np.sqrt(2.0 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.column_stack([np.ones(len(f)), f])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.steps)


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of zz' and zy over ``rows`` (x, y). Partitions emit the rows of their own
    sums; Spark adds those of equal number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                z = model.features(_matrix(b.column(0)))
                part = z.T @ np.column_stack([z, b.column(1).to_numpy()])
                total = part if total is None else total + part
        if total is not None:
            i, j = np.nonzero(np.triu(np.ones((len(total), total.shape[1])), 0) > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"]
            )

    d = len(model.b) + 1
    sums = rows.select("x", "y").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    at = sums.toPandas()  # (d + 1)(d + 2) / 2 numbers at most
    full = np.zeros((d, d + 1))
    full[at["i"], at["j"]] = at["v"]
    gram = full[:, :d]
    return gram + np.triu(gram, 1).T, full[:, d]


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing weighted least-squares fit."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(
    rows: DataFrame, held: Column, features: int = 192, width: float = 3.0, ridge: float = 1e-2, seed: int = 7
) -> Model | None:
    """Fit on labelled rows (x, y); those for which ``held`` is true only calibrate."""
    rows = rows.withColumn("__held", held)
    fitted, kept = rows.filter(~F.col("__held")), rows.filter("__held")
    k = len(FEATURES)
    sums = fitted.agg(
        F.count("*").alias("n"),
        *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(k)],
        *[F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"q{i}") for i in range(k)],
    ).first()
    if not sums["n"]:
        return None
    mean = np.array([sums[f"s{i}"] for i in range(k)]) / sums["n"]
    var = np.array([sums[f"q{i}"] for i in range(k)]) / sums["n"] - mean**2
    scale = np.sqrt(np.where(var > 1e-12, var, 1.0))
    rng = np.random.default_rng(seed)
    model = Model(
        mean, scale, rng.normal(0.0, 1.0 / width, (k, features)), rng.uniform(0.0, 2 * np.pi, features),
        np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]),
    )
    gram, moment = normal_equations(fitted, model)
    penalty = ridge * np.eye(len(gram))
    penalty[0, 0] = 0.0
    model.beta = np.linalg.solve(gram + penalty + 1e-9 * np.eye(len(gram)), moment)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = model.raw(_matrix(b.column(0))) if b.num_rows else np.zeros(0)
            bins = np.clip(np.floor((raw + 0.5) / 2.0 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), b.column(1)], ["bin", "y"])

    bins = (
        kept.select("x", "y").mapInArrow(scored, "bin int, y double")
        .groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).toPandas().sort_values("bin")
    )
    if len(bins):
        model.edges = (bins["bin"].to_numpy() + 0.5) / BINS * 2.0 - 0.5
        # one half of an example of each class keeps scores off 0 and 1
        n = bins["n"].to_numpy(dtype=float)
        model.steps = np.clip(pool_adjacent(bins["s"].to_numpy() / n, n), 0.001, 0.999)
    return model


def score_documents(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    threshold: float = 0.3, max_labelled: int = 2_000_000,
) -> DataFrame:
    """key, ``held_out``, ``score`` and ``predicted`` of every row. Labels are learnt
    only from rows whose crc32 of the key, as text, is no multiple of 5; a quarter of
    those calibrates."""
    stats = stored(text_statistics(docs, key, text), "classifier-statistics")
    fold = F.crc32(F.col(f"`{key}`").cast("string")) % 5
    known = labels.select(F.col(f"`{key}`"), F.col(f"`{label}`").cast("double").alias("y")).where("y is not null")
    known = known.filter(fold != 0)
    n = known.count()
    if n > max_labelled:
        # digests are even: the bound keeps this share of them
        part = F.conv(F.substring(F.md5(F.col(f"`{key}`").cast("string")), 1, 8), 16, 10).cast("double")
        known = known.filter(part < F.lit(2.0**32 * max_labelled / n))
    rows = stored(stats.join(known, key).select("x", "y", (fold == 4).alias("__calibrate")), "classifier-labelled")
    model = fit(rows, F.col("__calibrate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.full(b.num_rows, 0.5) if model is None else model.score(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(s, 9))], ["k", "score"])

    kind = stats.schema[0].dataType.simpleString()
    out = stats.mapInArrow(run, f"`{key}` {kind}, score double")
    return out.select(
        F.col(f"`{key}`"),
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
