"""Distances of vectors to training vectors and to classes, in blocks of numbers.

The nearest training vector is found exactly through an inverted file. Training vectors
are filed under the nearest of a few centroids. A cell's least and greatest radius bound,
by the triangle inequality, how near its vectors can be; a first join with the most
promising cell alone gives every query a distance to beat, and only cells whose bound is
lower are joined afterwards. Both joins meet blocks of at most ``BLOCK`` training vectors
with blocks of at most ``BLOCK`` queries, a matrix product each, of which the best per
query leaves: no pair is ever a row, and a cell that holds a third of all vectors is many
blocks.

Class distances use the full covariance of every class, summed over centred vectors by
the tasks; its Cholesky factor, of a size that is checked, travels to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK = 4096
#: Queries of a block measured at once, and near ties measured again at once.
STRIP, TIES = 256, 1 << 16
#: Training vectors looked at to place the centroids; every vector is filed and searched.
SAMPLE = 20_000
#: Most numbers (classes x dimensions x dimensions) that travel to every row.
FACTOR_NUMBERS = 4_000_000


def _matrix(x: pa.Array) -> np.ndarray:
    n = len(x)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)), pa.array(x.ravel()))


def usable(vector: str) -> Column:
    """Whether a vector has only finite entries, at least one of them not 0."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def unit_vectors(df: DataFrame, key: str, vector: str, to: str) -> DataFrame:
    """(``to``, v): usable vectors at length 1, so that cosine order is distance order."""
    x = F.transform(vector, lambda c: c.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c))
    return df.filter(usable(vector)).select(F.col(key).alias(to), F.transform(x, lambda c: c / length).alias("v"))


def place_centroids(train: DataFrame, cells: int, rounds: int = 5, seed: int = 3) -> np.ndarray:
    """Centroids of a bounded sample; what they are decides the cost, not the result."""
    rows = train.orderBy(F.xxhash64("v", F.lit(seed))).limit(SAMPLE).select("v").toArrow()
    x = _matrix(rows.column("v").combine_chunks())
    if not len(x):
        return np.zeros((0, 0))
    at = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        near = np.argmax(x @ at.T - 0.5 * (at * at).sum(axis=1), axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(at))
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at


def _distances(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (at * at).sum(axis=1) - 2.0 * (x @ at.T)
    return np.sqrt(np.maximum(square, 0.0))


def file_vectors(train: DataFrame, at: np.ndarray) -> DataFrame:
    """(id, v, cell, radius) of training vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_matrix(b.column(1)), at)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                    ["id", "v", "cell", "radius"],
                )

    kind = train.schema["id"].dataType.simpleString()
    return train.mapInArrow(run, f"id {kind}, v array<double>, cell int, radius double")


def _routes(queries: DataFrame, at: np.ndarray, cells: dict[int, tuple[float, float]], again: bool) -> DataFrame:
    """(q, v, cell): first the cell with the best promise, then (``again``, queries
    having ``best``) all others that may hold something nearer."""
    number = np.array(sorted(cells), dtype=np.int32)
    low = np.array([cells[c][0] for c in number.tolist()])
    high = np.array([cells[c][1] for c in number.tolist()])
    slack = 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = _distances(_matrix(b.column(1)), at[number])
            first = (d + low).argmin(axis=1)
            if not again:
                row, of = np.arange(len(d)), first
            else:
                bound = np.maximum(np.maximum(d - high, low - d), 0.0)
                ask = bound <= b.column(2).to_numpy()[:, None] + slack
                ask[np.arange(len(d)), first] = False
                row, of = np.nonzero(ask)
            # a query asks many cells: its copies leave in stretches
            for k in range(0, len(row), BLOCK):
                take = pa.array(row[k : k + BLOCK])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(number[of[k : k + BLOCK]])], ["q", "v", "cell"]
                )

    kind = queries.schema["q"].dataType.simpleString()
    return queries.mapInArrow(run, f"q {kind}, v array<double>, cell int")


def nearest_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``x``, the first of equal ones, and distance of the vector nearest to each
    of ``y``, a strip of ``y`` at a time: distances of a whole block, or the differences of
    many copies, would be hundreds of MB in every worker."""
    near, distance = [], []
    for k in range(0, len(y), STRIP):
        part = y[k : k + STRIP]
        d = _distances(part, x)
        # near ties are measured without the cancellation of the product
        row, of = np.nonzero(d <= d.min(axis=1)[:, None] + 1e-6)
        ties = [slice(i, i + TIES) for i in range(0, len(row), TIES)]
        exact = np.concatenate([np.sqrt(((x[of[t]] - part[row[t]]) ** 2).sum(axis=1)) for t in ties])
        pick = np.lexsort((of, np.round(exact, 12), row))
        pick = pick[np.concatenate([[True], np.diff(row[pick]) > 0])]
        near.append(of[pick])
        distance.append(exact[pick])
    return np.concatenate(near), np.concatenate(distance)


def _blocks(filed: DataFrame, asked: DataFrame) -> DataFrame:
    """Best training vector of each query in the cells it asks: (q, id, distance)."""
    n_filed = {r["cell"]: -(-r["count"] // BLOCK) for r in filed.groupBy("cell").count().collect()}
    n_asked = {r["cell"]: -(-r["count"] // BLOCK) for r in asked.groupBy("cell").count().collect()}
    counts = [(c, int(n_filed.get(c, 0)), int(n)) for c, n in n_asked.items()]
    sizes = F.broadcast(asked.sparkSession.createDataFrame(counts, "cell int, nf int, nq int"))
    own = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = filed.join(sizes, "cell").filter("nf > 0").select("cell", own("id", F.col("nf")).alias("bf"), spread(F.col("nq")).alias("bq"), "id", F.col("v").alias("fv"))
    right = asked.join(sizes, "cell").filter("nf > 0").select("cell", spread(F.col("nf")).alias("bf"), own("q", F.col("nq")).alias("bq"), "q", F.col("v").alias("qv"))
    kinds = f"q {asked.schema['q'].dataType.simpleString()}, id {filed.schema['id'].dataType.simpleString()}, distance double"

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, queries = a.column("id").combine_chunks(), b.column("q").combine_chunks()
        if not len(ids) or not len(queries):
            return pa.table({"q": queries.slice(0, 0), "id": ids.slice(0, 0), "distance": pa.array([], pa.float64())})
        order = pc.sort_indices(ids)  # the first of equal distances is the least id
        ids = ids.take(order)
        x = _matrix(a.column("fv").combine_chunks().take(order))
        y = _matrix(b.column("qv").combine_chunks())
        near, distance = nearest_of(x, y)
        return pa.table({"q": queries, "id": ids.take(pa.array(near)), "distance": distance})

    grouped = left.groupBy("cell", "bf", "bq").cogroup(right.groupBy("cell", "bf", "bq"))
    best = grouped.applyInArrow(meet, kinds)
    first = F.min(F.struct(F.round("distance", 12).alias("d"), F.col("id"), F.col("distance").alias("distance")))
    return best.groupBy("q").agg(first.alias("x")).select("q", "x.id", "x.distance")


def nearest_vectors(
    queries: DataFrame, train: DataFrame, key: str, vector: str, train_key: str | None = None, cells: int = 64
) -> DataFrame:
    """(key, ``nearest``, ``similarity``): the training vector of greatest cosine, the
    least key on a tie. Queries without a usable vector, and all queries of an empty
    training set, have NULL in both. Vectors must have one length."""
    filed = unit_vectors(train, train_key or key, vector, "id")
    asked = cut_lineage(unit_vectors(queries, key, vector, "q"))
    at = place_centroids(filed, cells)
    if not len(at):
        none = queries.select(F.col(key))
        kind = train.schema[train_key or key].dataType.simpleString()
        return none.withColumn("nearest", F.lit(None).cast(kind)).withColumn("similarity", F.lit(None).cast("double"))
    filed = cut_lineage(file_vectors(filed, at))
    radii = filed.groupBy("cell").agg(F.min("radius").alias("low"), F.max("radius").alias("high")).collect()
    cells_at = {r["cell"]: (r["low"], r["high"]) for r in radii}  # one row per centroid
    first = cut_lineage(_blocks(filed, cut_lineage(_routes(asked, at, cells_at, False))))
    beat = asked.join(first.select("q", F.col("distance").alias("best")), "q")
    second = _blocks(filed, cut_lineage(_routes(beat, at, cells_at, True)))
    best = first.unionByName(second).groupBy("q").agg(
        F.min(F.struct(F.round("distance", 12).alias("d"), F.col("id"), F.col("distance").alias("distance"))).alias("x")
    )
    found = best.select(F.col("q").alias(key), F.col("x.id").alias("nearest"), (1 - F.col("x.distance") ** 2 / 2).alias("similarity"))
    return queries.select(F.col(key)).join(found, key, "left")


def class_covariances(df: DataFrame, vector: str, label: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and population covariance of every class. Means first, then the products
    of centred vectors, so that nothing cancels; the tasks emit sums, Spark adds them."""
    rows = df.filter(usable(vector) & F.col(label).isNotNull())
    rows = rows.select(F.col(label).cast("string").alias("label"), F.transform(vector, lambda c: c.cast("double")).alias("v"))
    sized = rows.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).collect()
    if sum(r["d"] ** 2 for r in sized) > FACTOR_NUMBERS:
        raise ValueError(f"the covariances of {len(sized)} classes are too large to give to every row")
    parts = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).collect()
    n = {r["label"]: r["n"] for r in sized}
    means = {r["label"]: np.zeros(r["d"]) for r in sized}
    for r in parts:
        means[r["label"]][r["i"]] = r["m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            labels = np.array(b.column(0).to_pylist(), dtype=object)
            for c in set(labels.tolist()):
                z = _matrix(b.column(1).filter(pa.array(labels == c))) - means[c]
                total[c] = total.get(c, 0.0) + z.T @ z
        for c, g in total.items():
            i, j = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(i)), pa.array(i), pa.array(j), pa.array(g[i, j])], ["label", "i", "j", "v"])

    sums = rows.mapInArrow(run, "label string, i long, j long, v double").groupBy("label", "i", "j").agg(F.sum("v").alias("v")).collect()
    out = {c: (m, np.zeros((len(m), len(m)))) for c, m in means.items()}
    for r in sums:
        out[r["label"]][1][r["i"], r["j"]] = out[r["label"]][1][r["j"], r["i"]] = r["v"] / n[r["label"]]
    return out


def class_distances(
    df: DataFrame, key: str, vector: str, classes: dict[str, tuple[np.ndarray, np.ndarray]], threshold: float, ridge: float = 1e-9
) -> DataFrame:
    """(key, ``nearest``, ``distance``, ``route``): the class of least Mahalanobis
    distance under its full covariance. ``ridge`` is added to every variance, so that a
    singular covariance (fewer vectors than dimensions, equal vectors) has an inverse:
    directions a class never varied in count as very far. Rows without a usable vector
    have NULL and go to review."""
    names = sorted(classes)
    factors = [(c, classes[c][0], np.linalg.inv(np.linalg.cholesky(classes[c][1] + ridge * np.eye(len(classes[c][0]))))) for c in names]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and factors:
                x = _matrix(b.column(1))
                # whitened by the factor, the distance is a length
                d = np.stack([np.sqrt((((x - m) @ inverse.T) ** 2).sum(axis=1)) for _, m, inverse in factors], axis=1)
                best = np.round(d, 12).argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([names[i] for i in best]), pa.array(d[np.arange(len(d)), best])], ["k", "nearest", "distance"]
                )

    rows = df.filter(usable(vector)).select(F.col(key).alias("k"), F.transform(vector, lambda c: c.cast("double")).alias("v"))
    found = rows.mapInArrow(run, f"k {kind}, nearest string, distance double").withColumnRenamed("k", key)
    rest = df.filter(~usable(vector)).select(
        key, F.lit(None).cast("string").alias("nearest"), F.lit(None).cast("double").alias("distance")
    )
    route = F.when(F.col("distance") <= threshold, "accept").otherwise("review")
    return found.unionByName(rest).withColumn("route", route)
