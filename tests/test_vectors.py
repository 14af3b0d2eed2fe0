"""Nearest training vectors and covariance distances against numpy."""

import numpy as np
import pytest

from corpusgauge.operators import vectors as V


def clusters(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (7, dims))
    return centres[rng.integers(0, 7, n)] + rng.normal(0, 0.3, (n, dims))


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("cells,block", [(1, 4096), (8, 4096), (8, 40)])
def test_nearest_vector_is_exact(spark, monkeypatch, cells, block):
    monkeypatch.setattr(V, "BLOCK", block)
    train, ask = clusters(300, 5, 1), clusters(120, 5, 2)
    train[200:] = train[100]  # a third of all vectors in one place
    ask = [*ask, train[100], train[3]]
    got = {r["id"]: r for r in V.nearest_vectors(frame(spark, ask), frame(spark, train, 5000), "id", "v", cells=cells).collect()}
    t = train / np.linalg.norm(train, axis=1)[:, None]
    for i, q in enumerate(ask):
        cos = np.round(t @ (np.array(q) / np.linalg.norm(q)), 10)
        assert got[i]["nearest"] == 5000 + int(cos.argmax())
        assert abs(got[i]["similarity"] - cos.max()) < 1e-9


def test_only_cells_that_may_hold_the_nearest_are_joined(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 10, (12, 8))
    train = centres[rng.integers(0, 12, 400)] + rng.normal(0, 0.1, (400, 8))
    ask = V.unit_vectors(frame(spark, train[:100] + 0.01), "id", "v", "q")
    filed = V.unit_vectors(frame(spark, train), "id", "v", "id")
    at = V.place_centroids(filed, 12)
    filed = V.file_vectors(filed, at).collect()
    cells = {}
    for r in filed:
        low, high = cells.get(r["cell"], (9.0, 0.0))
        cells[r["cell"]] = (min(low, r["radius"]), max(high, r["radius"]))
    assert V._routes(ask, at, cells, False).count() == 100
    from pyspark.sql import functions as F

    more = V._routes(ask.withColumn("best", F.lit(0.05)), at, cells, True).count()
    assert more < 100 * (len(cells) - 1) / 3


def test_nearest_vector_of_odd_rows(spark):
    train = frame(spark, [[1.0, 0.0], None, [0.0, 0.0], [0.0, 2.0]])
    ask = frame(spark, [[3.0, 1.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0, 1.0]])
    got = {r["id"]: r["nearest"] for r in V.nearest_vectors(ask, train, "id", "v").collect()}
    assert got == {0: 0, 1: None, 2: None, 3: None, 4: 0}
    got = V.nearest_vectors(ask, train.limit(0), "id", "v").collect()
    assert len(got) == 5 and all(r["nearest"] is None and r["similarity"] is None for r in got)


def test_covariance_distance_equals_numpy(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for c in "abc":
        a = rng.normal(0, 1, (4, 4))
        x = rng.normal(0, 1, (80, 4)) @ a + rng.normal(0, 2, 4)
        rows += [(len(rows) + i, c, [float(v) for v in r]) for i, r in enumerate(x)]
        want[c] = (x.mean(axis=0), np.cov(x.T, bias=True))
    # a class of equal vectors has a singular covariance
    rows += [(1000 + i, "flat", [50.0, 50.0, 50.0, 50.0]) for i in range(3)] + [(2000, None, None), (2001, "a", [0.0, None, 1.0, 1.0])]
    want["flat"] = (np.full(4, 50.0), np.zeros((4, 4)))
    df = spark.createDataFrame(rows, "id long, label string, v array<double>").repartition(4)
    classes = V.class_covariances(df, "v", "label")
    assert sorted(classes) == sorted(want)
    for c, (m, s) in classes.items():
        assert np.allclose(m, want[c][0]) and np.allclose(s, want[c][1])
    got = {r["id"]: r for r in V.class_distances(df, "id", "v", classes, 2.0).collect()}
    assert len(got) == len(rows)
    for i, _, v in rows:
        if v is None or None in v:
            assert got[i]["nearest"] is None and got[i]["route"] == "review"
            continue
        d = {c: np.sqrt((np.array(v) - m) @ np.linalg.inv(s + 1e-9 * np.eye(4)) @ (np.array(v) - m)) for c, (m, s) in want.items()}
        best = min(d, key=lambda c: (d[c], c))
        assert got[i]["nearest"] == best and abs(got[i]["distance"] - d[best]) < 1e-6
        assert got[i]["route"] == ("accept" if d[best] <= 2.0 else "review")
    assert V.class_distances(df.limit(0), "id", "v", classes, 2.0).count() == 0
    assert V.class_distances(df.limit(1), "id", "v", {}, 2.0).count() == 0


def test_blocks_meet_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (V.BLOCK, 16)), rng.normal(0, 1, (V.BLOCK, 16))
    x[1000:] = x[999]  # most of a block in one place
    y[2000:] = x[999]
    tracemalloc.start()
    near, distance = V.nearest_of(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000
    assert (near[2000:] == 999).all() and (distance[2000:] == 0).all()
    for i in range(50):
        d = np.sqrt(((x - y[i]) ** 2).sum(axis=1))
        assert near[i] == d.argmin() and abs(distance[i] - d.min()) < 1e-12


def test_queries_leave_for_their_cells_in_stretches(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(V, "BLOCK", 64)
    asked = spark.createDataFrame([(0, [1.0, 0.0], 9.0)], "q long, v array<double>, best double")
    monkeypatch.setattr(type(asked), "mapInArrow", lambda self, run, schema: run)
    at = np.array([[1.0, float(i)] for i in range(8)])
    run = V._routes(asked, at, {c: (0.0, 9.0) for c in range(8)}, True)
    given = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([[1.0, float(i)] for i in range(100)]), pa.array([200.0] * 100)], ["q", "v", "best"])
    sizes = [b.num_rows for b in run(iter([given]))]
    assert sum(sizes) == 700 and max(sizes) <= 64
