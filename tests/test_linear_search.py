"""The linear search against numpy and its own optimality conditions."""

import numpy as np
import pytest

from corpusgauge.operators import linear_search as L
from corpusgauge.operators import tuning


def data(n=120, d=20, k=3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(0, 1, (n, d))) * (rng.random((n, d)) < 0.3)
    y = np.argmax(x @ rng.normal(0, 1, (d, k)) + rng.normal(0, 0.3, (n, k)), axis=1)
    return x, y


def frame(spark, x, y, dataset="val"):
    rows = [(dataset, int(c), [int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for r, c in zip(x, y)]
    return spark.createDataFrame(rows, "dataset string, code int, idx array<int>, val array<double>").repartition(3)


def objective(w, xb, s, wt, c, penalty, loss):
    t = np.maximum(1 - s * (xb @ w), 0)
    each = t * t if loss == "squared_hinge" else t
    return (np.abs(w).sum() if penalty == "l1" else 0.5 * w @ w) + c * (wt * each).sum()


@pytest.mark.parametrize("penalty,loss", [("l2", "hinge"), ("l2", "squared_hinge"), ("l1", "squared_hinge")])
@pytest.mark.parametrize("c,balanced", [(0.1, False), (1.0, True), (10.0, False)])
def test_columns_are_optimal(penalty, loss, c, balanced):
    x, y = data()
    idx = [np.flatnonzero(r) for r in x]
    import pyarrow as pa

    ind = list(pa.array([i.tolist() for i in idx]))
    val = list(pa.array([r[i].tolist() for r, i in zip(x, idx)]))
    evaluate = L.in_memory(y, ind, val, x.shape[1])
    counts = {int(k): int(v) for k, v in zip(*np.unique(y, return_counts=True))}
    p = L._problems([(penalty, loss, c, balanced, 1e-6)], counts)
    found, steps, converged = p.fit(evaluate, x.shape[1], (5000,))
    assert converged.all() and steps.max() < 5000
    xb = np.hstack([x, np.ones((len(x), 1))])
    rng = np.random.default_rng(1)
    for j in range(3):
        w, s = found[5000][:, j], np.where(y == j, 1.0, -1.0)
        wt = np.where(s > 0, len(y) / (3 * counts[j]) if balanced else 1.0, 1.0)
        best = objective(w, xb, s, wt, c, penalty, loss)
        slack = c * wt.sum() * L.GAMMA / 2 if loss == "hinge" else 1e-6 * (1 + best)
        # a convex objective has no better neighbour near by or far away
        for size in (1e-3, 1e-2, 0.1, 1.0):
            for _ in range(40):
                assert objective(w + size * rng.normal(0, 1, len(w)), xb, s, wt, c, penalty, loss) >= best - slack
        if penalty == "l1" and c < 1:
            assert (w == 0).sum() > 0
        if loss == "squared_hinge" and penalty == "l2":
            # the stationary point, solved by plain Newton steps
            v = np.zeros(len(w))
            for _ in range(60):
                on = s * (xb @ v) < 1
                h = np.eye(len(w)) + 2 * c * (xb[on] * wt[on, None]).T @ xb[on]
                v = np.linalg.solve(h, 2 * c * (xb[on] * wt[on, None]).T @ s[on])
            assert abs(objective(v, xb, s, wt, c, penalty, loss) - best) < 1e-6 * (1 + best)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    margin, sign = rng.normal(0, 2, (50, 4)), np.where(rng.random((50, 4)) < 0.5, 1.0, -1.0)
    smooth, weight = np.array([True, False, True, False]), rng.random((50, 4)) + 0.5
    _, slope = L.losses(margin, sign, weight, smooth)
    for i, j in ((0, 0), (3, 1), (20, 2), (41, 3)):
        up, down = margin.copy(), margin.copy()
        up[i, j] += 1e-6
        down[i, j] -= 1e-6
        diff = L.losses(up, sign, weight, smooth)[0][j] - L.losses(down, sign, weight, smooth)[0][j]
        assert abs(diff / 2e-6 - slope[i, j]) < 1e-5


def test_whole_grid_and_both_ways(spark):
    grid = L.whole_grid()
    assert len(grid) == len({s.run_id() for s in grid}) == 192
    x, y = data(90, 12)
    train, held = frame(spark, x[:60], y[:60]), frame(spark, x[60:], y[60:])
    few = [s for s in grid if s.c in (0.01, 1.0) and s.max_iter in (1000, 2000)]
    bad = [L.LinearSetting(1.0, 1000, False, "l1", "hinge", True), L.LinearSetting(1.0, 3, False), L.LinearSetting(-1.0, 10, False)]
    cf, status = L.search(train, held, few + bad, 12)
    runs = {r["run"]: r for r in status.collect()}
    assert len(runs) == len(few) + 3
    assert runs[bad[0].run_id()]["error"].startswith("no solver") and runs[bad[2].run_id()]["error"]
    assert runs[bad[1].run_id()]["not_converged"] and runs[bad[1].run_id()]["iterations"] == 3
    assert all(r["error"] is None and not r["not_converged"] for n, r in runs.items() if n in {s.run_id() for s in few})
    counts = {}
    for r in cf.collect():
        counts[r["run"]] = counts.get(r["run"], 0) + r["n"]
    assert set(counts) == {n for n, r in runs.items() if r["error"] is None} and set(counts.values()) == {30}
    # primal and dual of one problem, and limits beyond the path, give one model
    key = lambda rows: sorted((r["run"], r["y_true"], r["y_pred"], r["n"]) for r in rows)
    a = [r for r in cf.collect() if r["run"] == "l2-squared_hinge-dual-C1-iter1000-plain"]
    b = [r for r in cf.collect() if r["run"] == "l2-squared_hinge-primal-C1-iter2000-plain"]
    assert [t[1:] for t in key(a)] == [t[1:] for t in key(b)]
    scores = tuning.score_counts(cf, status).collect()
    assert len(scores) == len(runs) and scores[-1]["val_accuracy"] is None
    # one pass over the rows for all columns gives the same counts
    small = [s for s in few if s.c == 0.01 and s.max_iter == 1000]
    rows_cf, rows_status = L.search(train, held, small, 12, by="rows")
    names = {s.run_id() for s in small}
    assert key(rows_cf.collect()) == key(r for r in cf.collect() if r["run"] in names)
    assert {r["run"]: r["iterations"] for r in rows_status.collect()} == {n: runs[n]["iterations"] for n in names}


def test_search_of_odd_tables(spark):
    x, y = data(20, 5)
    rows = frame(spark, x, y)
    one = L.LinearSetting(1.0, 50, False)
    cf, status = L.search(rows.limit(0), rows, [one], 5)
    assert cf.count() == 0 and status.first()["error"] == "fewer than two classes"
    cf, _ = L.search(rows, rows.limit(0), [one], 5)
    assert cf.count() == 0
    # a row without a class is not fitted, but counted where it is classified
    from pyspark.sql import functions as F

    gap = rows.unionByName(rows.limit(1).withColumn("code", F.lit(None).cast("int")))
    cf, _ = L.search(gap, gap, [one], 5)
    assert cf.agg(F.sum("n")).first()[0] == 21 and cf.filter("y_true is null").count() == 1
    with pytest.raises(ValueError):
        L.search(rows, rows, [one], 5, by="columns")


def test_many_rows_are_evaluated_by_their_entries(monkeypatch):
    import pyarrow as pa

    x, y = data(n=400)
    x[7] = 0  # a row without entries
    x[:, 4] = 0  # a feature without entries
    at = [np.flatnonzero(r).tolist() for r in x]
    rows = list(pa.array(at, pa.list_(pa.int32()))), list(pa.array([r[i].tolist() for r, i in zip(x, at)], pa.list_(pa.float64())))
    w = np.random.default_rng(2).normal(0, 1, (x.shape[1] + 1, 3))
    of, positive, smooth = np.arange(3), np.array([1.0, 2.0, 0.5]), np.array([True, False, True])
    value, grad = L.in_memory(y, *rows, x.shape[1])(w, of, positive, smooth)
    # beyond the bound no row becomes a full one again
    monkeypatch.setattr(L, "DENSE_BYTES", 0)
    monkeypatch.setattr(L, "ENTRIES", 50, raising=False)
    monkeypatch.setattr(L, "_block", lambda *a: pytest.fail("rows made full"))
    found = L.in_memory(y, *rows, x.shape[1])(w, of, positive, smooth)
    assert np.allclose(found[0], value, rtol=1e-12) and np.allclose(found[1], grad, rtol=1e-9, atol=1e-9)


def fitted(spark, some, **bound):
    """Counts and iterations of settings fitted on 121 rows, one of them without a class."""
    from pyspark.sql import functions as F

    x, y = data(150, 12, seed=3)
    x[5] = 0  # a row without entries
    train, held = frame(spark, x[:120], y[:120]), frame(spark, x[120:], y[120:])
    train = train.unionByName(train.limit(1).withColumn("code", F.lit(None).cast("int")))
    cf, status = L.search(train, held, some, 12, **bound)
    told = [(r["run"], r["iterations"], r["not_converged"], r["error"]) for r in status.collect()]
    return sorted(map(tuple, cf.collect()), key=str), sorted(told)


SOME = [L.LinearSetting(0.1, 1000, b, p) for b in (False, True) for p in ("l2", "l1")] + [L.LinearSetting(0.01, 5, False)]


def test_rows_too_many_for_a_task_are_all_fitted(spark):
    whole = fitted(spark, SOME)
    assert sum(r[-1] for r in whole[0]) == 30 * len(SOME)
    # none of the 120 is left out where a task may hold 30
    assert fitted(spark, SOME, max_rows=30) == whole


def test_entries_too_many_for_a_task_go_by_rows(spark, monkeypatch):
    import os

    from corpusgauge.session import shared_folder

    seen, stored = [], L.stored_blocks
    monkeypatch.setattr(L, "stored_blocks", lambda *a: seen.append(stored(*a)) or seen[-1])
    whole, before = fitted(spark, SOME[:2]), {k: spark.conf.get(k, None) for k in L.PASSING}
    assert not seen
    # a few columns share a pass, blocks have 4 rows, and sums are added in tasks
    for name, bound in (("MAX_ENTRIES", 50), ("COLUMN_BYTES", 13 * 8 * 4), ("DENSE_BYTES", 13 * 8 * 4), ("RESULT_BYTES", 0)):
        monkeypatch.setattr(L, name, bound)
    assert fitted(spark, SOME[:2]) == whole
    assert len(seen) == 1 and not [p for p in os.listdir(shared_folder(spark)) if p.startswith("rows-")]
    assert {k: spark.conf.get(k, None) for k in L.PASSING} == before


def test_a_pass_over_stored_blocks_is_the_sum_over_the_rows(spark, monkeypatch):
    import pyarrow as pa

    from corpusgauge.session import remove

    x, y = data(n=300)
    x[7], x[:, 4] = 0, 0
    at = [np.flatnonzero(r).tolist() for r in x]
    arrays = list(pa.array(at, pa.list_(pa.int32()))), list(pa.array([r[i].tolist() for r, i in zip(x, at)], pa.list_(pa.float64())))
    w = np.random.default_rng(2).normal(0, 1, (x.shape[1] + 1, 3))
    of, positive, smooth = np.arange(3), np.array([1.0, 2.0, 0.5]), np.array([True, False, True])
    value, grad = L.in_memory(y, *arrays, x.shape[1])(w, of, positive, smooth)
    monkeypatch.setattr(L, "BLOCK_ROWS", 50)
    path = L.stored_blocks(frame(spark, x, y), x.shape[1], int((x != 0).sum()))
    blocks = spark.read.parquet(path)
    for bound in (0, L.RESULT_BYTES):
        monkeypatch.setattr(L, "RESULT_BYTES", bound)
        got = L.one_pass(blocks, blocks.rdd.getNumPartitions(), w, of, positive, smooth)
        assert np.allclose(got[0], value, rtol=1e-12) and np.allclose(got[1], grad, rtol=1e-9, atol=1e-9)
    remove(spark, path)
