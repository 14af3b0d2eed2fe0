"""Whitening of embeddings from a covariance weighted by multiplicity.

Entries become whole numbers on a lattice (``floor(scale * c) + offset``), so equal
vectors are equal exactly. Rows are grouped by vector: the fit, the projection and the
deviations run over *distinct* vectors only, each weighted by one or by its count, and
the rows are joined back by digest. Sums are exact; the covariance is the sum of
``w z'z`` that every task forms over centred vectors ``z``, and only its
``m (m + 1) / 2`` numbers reach the driver, where one symmetric matrix is solved.

A vector that many rows share is one row of the distinct table. On the way back the
vectors that hold more than one row in ``HOT`` (fewer than ``HOT`` of them, whatever
the table) are broadcast and the others joined, so that no task gathers one vector's
rows.

Defined results: rows whose vector is NULL, empty or holds a NULL or non-finite entry
are left out; vectors of each length are whitened among themselves; repeated rows and
NULL keys are rows like others; entries beyond 2^52 after scaling saturate there; a
component without variance (an eigenvalue below 1e-12 of the greatest) has no
coordinate and is left out, so a table of one distinct vector gives no rows, as an
empty one does. Further columns of the input are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

HOT = 1000
LIMIT = float(1 << 52)


@dataclass
class Space:
    """What the fit knows about vectors of one length."""

    n: int  # total weight
    sums: list[int]  # exact, per dimension
    trace: float = 0.0
    values: np.ndarray | None = None  # eigenvalues kept, falling
    map: np.ndarray | None = None  # unit eigenvectors over the roots of their eigenvalues
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the whole part subtracted exactly."""
        whole = [divmod(s, self.n) for s in self.sums]
        return (x - np.array([q for q, _ in whole], dtype=np.int64)) - np.array([r / self.n for _, r in whole])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, in whole numbers of any size."""
        base = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = [s % self.n for s in self.sums]
        far = x - base
        reach = self.n * (int(np.abs(far).max(initial=0)) + 1)
        if reach * reach * x.shape[1] >= 1 << 63:
            far, rest = far.astype(object), np.array(rest, dtype=object)
        return (((far * self.n - rest) ** 2).sum(axis=1)).tolist()


def lattice(vectors: pa.Array, scale: float, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number matrix of the usable vectors, for each length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL becomes NaN
    start = np.concatenate([[0], np.cumsum(size)])
    unusable = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (size > 0) & (unusable[start[1:]] == unusable[start[:-1]])
    for m in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == m))
        at = start[rows][:, None] + np.arange(m)
        x = np.clip(np.floor(scale * flat[at]), -LIMIT, LIMIT).astype(np.int64) + offset
        yield rows, x


def _digests(x: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(r, digest_size=16).digest() for r in np.ascontiguousarray(x)]


def _vectors(scale: float, offset: int, keyed: bool):
    """(key, d) of every usable row, or (d, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in lattice(b.column(b.num_columns - 1), scale, offset):
                d = pa.array(_digests(x), pa.binary())
                if keyed:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), d], ["k", "d"])
                else:
                    yield pa.RecordBatch.from_arrays([d, _lists(x)], ["d", "x"])

    return run


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _by_length(x: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = pc.list_value_length(x).to_numpy(zero_copy_only=False)
    flat = x.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])
    for m in np.unique(size).tolist():
        rows = np.flatnonzero(size == m)
        yield rows, flat[start[rows][:, None] + np.arange(m)]


def exact_sums(vectors: DataFrame) -> dict[int, Space]:
    """Total weight and sum of every dimension, per length, of ``vectors`` (x, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            w = b.column(1).to_numpy(zero_copy_only=False)
            for rows, x in _by_length(b.column(0)):
                if float(np.abs(x).max()) * float(w[rows].sum()) >= 2.0**62:
                    x, weights = x.astype(object), w[rows].astype(object)
                else:
                    weights = w[rows]
                # dimension -1 holds the weights
                part = np.concatenate([[weights.sum()], weights @ x]).astype(object)
                total[x.shape[1]] = total.get(x.shape[1], 0) + part
        for m, s in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m + 1, m)), pa.array(np.arange(-1, m)), pa.array([str(v) for v in s])], ["m", "i", "s"]
            )

    parts = vectors.select("x", "w").mapInArrow(run, "m long, i long, s string")
    sums = parts.groupBy("m", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found: dict[int, dict[int, int]] = {}
    for r in sums:
        found.setdefault(r["m"], {})[r["i"]] = int(r["s"])
    return {m: Space(s[-1], [s[i] for i in range(m)]) for m, s in found.items()}


def gram(vectors: DataFrame, centre: Callable[[int, np.ndarray], np.ndarray], column: str = "x") -> dict[int, np.ndarray]:
    """Weighted ``z'z`` per length of vector, z being the centred vectors. The tasks
    emit their own sums, upper half only, and Spark adds equal places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            w = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            lengths = b.column(2).to_numpy(zero_copy_only=False)
            for rows, x in _by_length(b.column(0)):
                for m in np.unique(lengths[rows]).tolist():
                    of = lengths[rows] == m
                    z = centre(m, x[of])
                    total[m] = total.get(m, 0.0) + (z * w[rows][of, None]).T @ z
        for m, g in total.items():
            i, j = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), m)), pa.array(i), pa.array(j), pa.array(g[i, j])], ["m", "i", "j", "v"]
            )

    parts = vectors.select(column, "w", "m").mapInArrow(run, "m long, i long, j long, v double")
    at = parts.groupBy("m", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for m, g in at.groupby("m"):
        size = int(g["j"].max()) + 1
        full = np.zeros((size, size))
        full[g["i"], g["j"]] = full[g["j"], g["i"]] = g["v"]
        out[int(m)] = full
    return out


def fit(vectors: DataFrame, components: int) -> dict[int, Space]:
    """The space of every length of ``vectors`` (x, w, m)."""
    spaces = exact_sums(vectors)
    for m, g in gram(vectors, lambda m, x: spaces[m].centred(x)).items():
        s = spaces[m]
        values, units = np.linalg.eigh(g / s.n)
        s.trace = float(np.trace(g) / s.n)
        keep = np.flatnonzero(values > 1e-12 * max(values[-1], 0.0))[::-1][:components]
        s.values, s.map = values[keep], units[:, keep] / np.sqrt(values[keep])
    return spaces


def _whitened(spaces: dict[int, Space]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in _by_length(b.column(1)):
                s = spaces[x.shape[1]]
                if not len(s.values):
                    continue
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(np.full(len(rows), x.shape[1])),
                        pa.array([str(v) for v in s.deviations(x)]), _lists(s.centred(x) @ s.map),
                    ],
                    ["d", "w", "c", "m", "deviation", "z"],
                )

    return run


def identity_errors(white: DataFrame, spaces: dict[int, Space]) -> None:
    """Measure, per length, how far the covariance of the whitened fit list is from
    the identity."""
    at = F.posexplode("z").alias("i", "v")
    means = white.select("m", "w", at).groupBy("m", "i").agg(F.sum(F.col("w") * F.col("v")).alias("s")).collect()
    mean = {m: np.zeros(len(s.values)) for m, s in spaces.items()}
    for r in means:
        mean[r["m"]][r["i"]] = r["s"] / spaces[r["m"]].n
    for m, g in gram(white, lambda m, z: z - mean[m], "z").items():
        spaces[m].error = float(np.abs(g / spaces[m].n - np.eye(len(g))).max())


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16,
    weight: str = "one", scale: float = 64.0, offset: int = 1_000_000,
) -> DataFrame:
    """For each usable row and component: key, ``component`` (from 1), ``n`` (total fit
    weight), ``deviation`` (decimal: sum of (n x - S)^2), ``whitened``, ``explained``
    and ``identity_error``. ``weight`` is "one" (every distinct vector once) or
    "count" (as often as it occurs)."""
    if weight not in ("one", "count"):
        raise ValueError("weight is 'one' or 'count'")
    named, spark = vectors.select(F.col(f"`{key}`"), F.col(f"`{vector}`")), vectors.sparkSession
    kind = named.schema[0].dataType.simpleString()
    rows = stored(named.mapInArrow(_vectors(scale, offset, True), f"k {kind}, d binary"), "whitening-rows")
    listed = named.select(F.col(f"`{vector}`")).mapInArrow(_vectors(scale, offset, False), "d binary, x array<long>")
    distinct = listed.groupBy("d", "x").agg(F.count("*").alias("c"))
    w = F.col("c") if weight == "count" else F.lit(1).cast("long")
    distinct = stored(distinct.select("d", "x", "c", w.alias("w"), F.size("x").cast("long").alias("m")), "whitening-distinct")
    spaces = fit(distinct, components)
    white = distinct.select("d", "x", "w", "c").mapInArrow(
        _whitened(spaces), "d binary, w long, c long, m long, deviation string, z array<double>"
    )
    white = stored(white, "whitening-vectors")
    identity_errors(white, spaces)
    facts = [
        (m, s.n, s.error, [float(v / s.trace) for v in s.values]) for m, s in spaces.items() if s.values is not None and len(s.values)
    ]
    facts = F.broadcast(spark.createDataFrame(facts, "m long, n long, identity_error double, share array<double>"))
    # fewer than HOT vectors hold more than one row in HOT each
    total = white.agg(F.sum("c")).first()[0] or 0
    hot, cold = white.filter(F.col("c") * HOT > total), white.filter(F.col("c") * HOT <= total)
    often = F.broadcast(hot.select("d", "m", "deviation", "z"))
    back = rows.join(often, "d").select("k", "m", "deviation", "z").unionAll(
        rows.join(F.broadcast(hot.select("d")), "d", "left_anti").join(cold, "d").select("k", "m", "deviation", "z")
    )
    each = back.join(facts, "m").select(
        "k", "n", "identity_error", "share", F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        F.posexplode("z").alias("i", "whitened"),
    )
    return each.select(
        F.col("k").alias(key),
        (F.col("i") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.expr("get(share, i)").alias("explained"),
        "identity_error",
    )
