"""All settings of a linear classifier search, with their iterations.

A setting is a loss, a penalty, ``C``, class balancing, a limit of iterations and the
side (primal or dual) it is solved from. Settings that differ only in their limit follow
one path, of which the limit is a place; primal and dual of one problem have one
solution, which is found once. What is left are problems of one column of coefficients
per class, and every column moves by its own quasi-Newton step (L-BFGS; for an
absolute-value penalty its orthant-wise form) with its own step length.

Every problem is fitted on all training rows. The search is distributed over problems
(``by="settings"``): each is one task that holds the rows. Paths have thousands of
iterations, and an iteration in memory takes a millisecond where a Spark job takes a third
of a second. Rows that are too many for a task (``max_rows``, ``MAX_ENTRIES``) are fitted
by ``by="rows"``: the columns of all problems form one matrix, and an iteration of *all* of
them is one pass in which the tasks multiply their rows with it and Spark adds the sums of
losses and gradients in slices. Columns that have converged leave the matrix. The rows are
stored once as blocks of arrays. Both ways follow the same path.

The hinge, not smooth, is solved with its corner rounded over ``GAMMA``, which is what
its dual with a small quadratic term is; the objective differs by less than ``GAMMA / 2``
a row. As in the usual library for such problems, the intercept is a penalised constant
feature, and balancing weighs the rows of the class a column stands for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..datasets import DATASET
from ..session import remove, scratch_path, set_for

# The axes searched.
C_VALUES = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
MAX_ITERS = (1000, 2000, 5000, 10000)
VARIANTS = (("l2", "hinge", True), ("l2", "squared_hinge", False), ("l2", "squared_hinge", True), ("l1", "squared_hinge", False))
TOLERANCE = 1e-4
GAMMA = 0.05
MEMORY = 6
ROWS = 512  # rows multiplied at once
DENSE_BYTES = 200_000_000  # training rows kept as full matrices up to this size, as entries beyond
ENTRIES = 1 << 17  # entries multiplied at once
MAX_ROWS = 100_000  # rows and entries that a task holds; more of them are fitted by passes
MAX_ENTRIES = 10_000_000
BLOCK_ROWS = 128  # rows of a stored block
SLICE = 128  # features of a partial sum that travel together
COLUMN_BYTES = 16_000_000  # coefficients of the columns that share a pass
FILE_BYTES = 16_000_000  # a piece of the stored blocks
PASS_TASKS = 64  # tasks of a pass at most, unless more run at once
RESULT_BYTES = 16_000_000  # sums of a pass that the driver itself adds
# while blocks are made and read: few at once in a task's memory, and no shuffle files kept
PASSING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@dataclass(frozen=True)
class LinearSetting:
    c: float
    max_iter: int
    balanced: bool
    penalty: str = "l2"
    loss: str = "squared_hinge"
    dual: bool = False
    tol: float = TOLERANCE

    def run_id(self) -> str:
        side = "dual" if self.dual else "primal"
        return f"{self.penalty}-{self.loss}-{side}-C{self.c:g}-iter{self.max_iter}-{'balanced' if self.balanced else 'plain'}"

    def check(self) -> None:
        if (self.penalty, self.loss, self.dual) not in VARIANTS:
            raise ValueError(f"no solver for penalty {self.penalty!r}, loss {self.loss!r}, dual {self.dual}")
        if not self.c > 0 or self.max_iter < 1:
            raise ValueError("C and the iterations are positive")

    def problem(self) -> tuple:
        """What decides the path: settings of one problem share it."""
        return self.penalty, self.loss, self.c, self.balanced, self.tol


def whole_grid() -> list[LinearSetting]:
    """Every setting of the axes above."""
    return [LinearSetting(c, m, b, p, loss, d) for c in C_VALUES for m in MAX_ITERS for b in (False, True) for p, loss, d in VARIANTS]


def _block(idx: list, val: list, d: int) -> np.ndarray:
    """Rows as numbers, the constant feature last."""
    x = np.zeros((len(idx), d + 1))
    x[:, d] = 1.0
    for i, (a, b) in enumerate(zip(idx, val)):
        x[i, a.values.to_numpy()] = b.values.to_numpy()
    return x


def _blocks(b: pa.RecordBatch, d: int, first: int) -> Iterator[tuple[slice, np.ndarray]]:
    for k in range(0, b.num_rows, ROWS):
        part = slice(k, min(k + ROWS, b.num_rows))
        idx = [b.column(first)[i] for i in range(part.start, part.stop)]
        val = [b.column(first + 1)[i] for i in range(part.start, part.stop)]
        yield part, _block(idx, val, d)


def losses(margin: np.ndarray, sign: np.ndarray, weight: np.ndarray, smooth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed loss of each column and its slope at every margin. ``smooth`` marks the
    columns of the squared hinge."""
    t = np.maximum(1.0 - sign * margin, 0.0)
    corner = t < GAMMA
    value = np.where(smooth, t * t, np.where(corner, t * t / (2 * GAMMA), t - GAMMA / 2))
    slope = np.where(smooth, 2 * t, np.where(corner, t / GAMMA, 1.0))
    return (weight * value).sum(axis=0), -(weight * sign * slope)


def stored_blocks(rows: DataFrame, d: int, entries: int) -> str:
    """The path of (code, idx, val) stored as blocks: codes and numbers of entries of up to
    ``BLOCK_ROWS`` rows, and their entries, all as plain arrays."""
    step = max(1, min(BLOCK_ROWS, DENSE_BYTES // (8 * (d + 1))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, step):
                code, idx, val = (c.slice(k, step) for c in b.columns)
                size = pc.fill_null(pc.list_value_length(idx), 0)
                parts = [(code, np.int32), (size, np.int32), (idx.flatten(), np.int32), (val.flatten(), np.float64)]
                held = [pa.array([x.to_numpy(zero_copy_only=False).astype(t).tobytes()], pa.binary()) for x, t in parts]
                yield pa.RecordBatch.from_arrays(held, ["code", "size", "idx", "val"])

    spark = rows.sparkSession
    # dealt out evenly: every pass takes as long as its longest task
    n = max(4 * spark.sparkContext.defaultParallelism, -(-entries * 12 // FILE_BYTES))
    path = scratch_path(spark, "rows")
    blocks = rows.select("code", "idx", "val").repartition(n).mapInArrow(pack, "code binary, size binary, idx binary, val binary")
    blocks.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return path


def one_pass(
    blocks: DataFrame, tasks: int, w: np.ndarray, of: np.ndarray, positive: np.ndarray, smooth: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient of every column in one pass over stored blocks, read by so many
    tasks."""
    sc = blocks.sparkSession.sparkContext
    d, m = w.shape[0] - 1, w.shape[1]
    sent = sc.broadcast((w, of, positive, smooth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, of, positive, smooth = sent.value
        parts = np.zeros((d + 2, m))
        full = np.zeros(0)
        met = False
        for b in batches:
            met |= b.num_rows > 0
            for held in zip(*b.columns):
                code, size, idx, val = (np.frombuffer(x.as_buffer(), t) for x, t in zip(held, (np.int32, np.int32, np.int32, np.float64)))
                if len(full) < len(code) * (d + 1):
                    full = np.zeros(len(code) * (d + 1))
                x = full[: len(code) * (d + 1)].reshape(len(code), d + 1)
                at = np.repeat(np.arange(len(code)) * (d + 1), size) + idx
                full[at] = val
                x[:, d] = 1.0  # the constant feature, last
                sign = np.where(code[:, None] == of, 1.0, -1.0)
                value, slope = losses(x @ w, sign, np.where(sign > 0, positive, 1.0), smooth)
                parts[0] += value
                parts[1:] += x.T @ slope
                full[at] = 0.0
                x[:, d] = 0.0
        task = pa.array([TaskContext.get().partitionId()], pa.int32())
        # a task without blocks has nothing to add
        for k in range(0, d + 2, SLICE) if met else ():
            part = pa.array([parts[k : k + SLICE].tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([k]), task, part], ["k", "task", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(2)):
                x = np.frombuffer(part.as_buffer(), dtype=float)
                sums[k] = sums[k] + x if k in sums else x.copy()
        for k, x in sums.items():
            part = pa.array([x.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([0], pa.int32()), part], ["k", "task", "part"])

    parts = blocks.mapInArrow(run, "k long, task int, part binary")
    if tasks * (d + 2) * m * 8 > RESULT_BYTES:
        # slices are added where they meet; matrices of a bounded size return
        parts = parts.repartition("k").sortWithinPartitions("k", "task").mapInArrow(add, "k long, task int, part binary")
    out = np.zeros((d + 2, m))
    try:
        for r in sorted(parts.collect(), key=lambda r: (r["k"], r["task"])):  # one order, for equal sums
            x = np.frombuffer(bytes(r["part"]), dtype=float).reshape(-1, m)
            out[r["k"] : r["k"] + len(x)] += x
    finally:
        sent.destroy()
    return out[0], out[1:]


class _Columns:
    """Quasi-Newton paths of all columns, side by side."""

    def __init__(self, c, l1, tol, limit) -> None:  # noqa: ANN001
        self.c, self.l1, self.tol, self.limit = c, l1, tol, limit

    def value(self, w: np.ndarray, loss: np.ndarray, at: np.ndarray) -> np.ndarray:
        size = np.where(self.l1[at], np.abs(w).sum(axis=0), 0.5 * (w * w).sum(axis=0))
        return size + self.c[at] * loss

    def smooth_gradient(self, w: np.ndarray, grad: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(self.l1[at], 0.0, w) + self.c[at] * grad

    def pseudo(self, w: np.ndarray, g: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The steepest slope; at 0 an absolute value takes the side that falls."""
        up, down = g + 1.0, g - 1.0
        zero = np.where(up < 0, up, np.where(down > 0, down, 0.0))
        return np.where(self.l1[at], np.where(w > 0, up, np.where(w < 0, down, zero)), g)


def _directions(g: np.ndarray, s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The two loops for every column; a pair without curvature counts for nothing."""
    q = g.copy()
    sy = (s * y).sum(axis=1)
    rho = np.where(sy > 1e-12, 1.0 / np.maximum(sy, 1e-300), 0.0)
    kept = []
    for i in range(len(s) - 1, -1, -1):
        a = rho[i] * (s[i] * q).sum(axis=0)
        q -= a * y[i]
        kept.append(a)
    if len(s):
        yy = (y[-1] * y[-1]).sum(axis=0)
        q *= np.where(sy[-1] > 1e-12, sy[-1] / np.maximum(yy, 1e-300), 1.0)
    for i, a in enumerate(reversed(kept)):
        q += s[i] * (a - rho[i] * (y[i] * q).sum(axis=0))
    return -q


Evaluation = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def in_memory(code: np.ndarray, idx: list, val: list, d: int) -> Evaluation:
    """Loss and gradient of columns over rows at hand."""
    if len(code) * (d + 1) * 8 > DENSE_BYTES:
        return _by_entries(code, idx, val, d)
    parts = [(code[k : k + ROWS], slice(k, k + ROWS)) for k in range(0, len(code), ROWS)]
    kept = [_block(idx[at], val[at], d) for _, at in parts]

    def evaluate(w: np.ndarray, of: np.ndarray, positive: np.ndarray, smooth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, grad = np.zeros(w.shape[1]), np.zeros_like(w)
        for (codes, _), x in zip(parts, kept):
            sign = np.where(codes[:, None] == of, 1.0, -1.0)
            value, slope = losses(x @ w, sign, np.where(sign > 0, positive, 1.0), smooth)
            total += value
            grad += x.T @ slope
        return total, grad

    return evaluate


def _cuts(first: np.ndarray, total: int) -> list[tuple[int, int]]:
    """Groups of runs that begin at ``first``, of about ``ENTRIES`` entries each."""
    at = np.unique(np.searchsorted(first, np.arange(0, total, ENTRIES)))
    ends = np.append(at[at < len(first)], len(first))
    return list(zip(ends[:-1].tolist(), ends[1:].tolist()))


def _sums(first: np.ndarray, cuts: list[tuple[int, int]], place: np.ndarray, x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Sum of ``x * by[place]`` over every run of entries."""
    out = np.empty(len(first))
    for i, j in cuts:
        a, b = first[i], first[j] if j < len(first) else len(x)
        part = by[place[a:b]]
        part *= x[a:b]
        np.add.reduceat(part, first[i:j] - a, out=out[i:j])
    return out


def _by_entries(code: np.ndarray, idx: list, val: list, d: int) -> Evaluation:
    """The same over the entries there are, filed once by row and once by feature: the
    memory and an evaluation grow with the entries, not with rows times features."""
    sizes = np.array([len(i) for i in idx]) + 1
    end = np.cumsum(sizes)
    first, n = end - sizes, int(end[-1])
    place, x = np.full(n, d, dtype=np.int32), np.ones(n)
    given = np.ones(n, dtype=bool)
    given[end - 1] = False  # the constant feature, last in its row
    place[given] = np.concatenate([i.values.to_numpy() for i in idx])
    x[given] = np.concatenate([v.values.to_numpy() for v in val])
    order = np.argsort(place, kind="stable")
    row, x_t, place_t = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], x[order], place[order]
    first_t = np.flatnonzero(np.diff(place_t, prepend=-1))
    used = place_t[first_t]
    cuts, cuts_t = _cuts(first, n), _cuts(first_t, n)

    def evaluate(w: np.ndarray, of: np.ndarray, positive: np.ndarray, smooth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margin = np.stack([_sums(first, cuts, place, x, np.ascontiguousarray(w[:, j])) for j in range(w.shape[1])], axis=1)
        sign = np.where(code[:, None] == of, 1.0, -1.0)
        value, slope = losses(margin, sign, np.where(sign > 0, positive, 1.0), smooth)
        grad = np.zeros_like(w)
        for j in range(w.shape[1]):
            grad[used, j] = _sums(first_t, cuts_t, row, x_t, np.ascontiguousarray(slope[:, j]))
        return value, grad

    return evaluate


def fit_columns(
    evaluate: Evaluation, d: int, of: np.ndarray, positive: np.ndarray, smooth: np.ndarray, c: np.ndarray, l1: np.ndarray,
    tol: np.ndarray, limits: Sequence[int],
) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Paths of all columns. Returns the coefficients at each of the ``limits``, the
    iterations of each column and whether it converged."""
    m = len(of)
    cols = _Columns(c, l1, tol, max(limits))
    live = np.arange(m)
    w = np.zeros((d + 1, m))
    loss, grad = evaluate(w, of, positive, smooth)
    f = cols.value(w, loss, live)
    g = cols.smooth_gradient(w, grad, live)
    p = cols.pseudo(w, g, live)
    start = np.sqrt((p * p).sum(axis=0))
    s_mem, y_mem = np.zeros((0, d + 1, m)), np.zeros((0, d + 1, m))
    steps, done, converged = np.zeros(m, dtype=int), np.zeros(m, dtype=bool), np.zeros(m, dtype=bool)
    held: dict[int, dict[int, np.ndarray]] = {}
    direction = np.zeros((d + 1, m))
    length = np.ones(m)
    fresh = np.ones(m, dtype=bool)

    def settle() -> None:
        nonlocal done
        norm = np.sqrt((p * p).sum(axis=0))
        ok = norm <= tol * start
        converged[ok & ~done] = True
        done |= ok

    settle()
    while not done.all():
        live = np.flatnonzero(~done)
        turn = live[fresh[live]]
        if len(turn):
            go = _directions(p[:, turn], s_mem[:, :, turn], y_mem[:, :, turn])
            go = np.where(l1[turn] & (go * p[:, turn] >= 0), 0.0, go)
            uphill = (go * p[:, turn]).sum(axis=0) >= 0
            go[:, uphill] = -p[:, turn][:, uphill]
            direction[:, turn] = go
            first = steps[turn] == 0
            length[turn] = np.where(first, 1.0 / np.maximum(np.abs(p[:, turn]).sum(axis=0), 1.0), 1.0)
            fresh[turn] = False
        trial = w[:, live] + length[live] * direction[:, live]
        side = np.where(w[:, live] != 0, np.sign(w[:, live]), -np.sign(p[:, live]))
        trial = np.where(l1[live] & (trial * side <= 0), 0.0, trial)
        loss, grad = evaluate(trial, of[live], positive[live], smooth[live])
        new = cols.value(trial, loss, live)
        slope = (p[:, live] * (trial - w[:, live])).sum(axis=0)
        good = new <= f[live] + 1e-4 * slope
        stuck = ~good & (length[live] < 1e-9)
        length[live[~good]] *= 0.5
        done[live[stuck]] = True  # no step improves it: as near as numbers go
        converged[live[stuck]] = True
        at = live[good]
        if len(at):
            g_new = cols.smooth_gradient(trial[:, good], grad[:, good], at)
            s_new, y_new = np.zeros((1, d + 1, m)), np.zeros((1, d + 1, m))
            s_new[0][:, at], y_new[0][:, at] = trial[:, good] - w[:, at], g_new - g[:, at]
            # columns that wait keep their pairs where they are
            keep = np.ones(m, dtype=bool)
            keep[at] = False
            if len(s_mem) == MEMORY:
                held_s, held_y = s_mem[:, :, keep].copy(), y_mem[:, :, keep].copy()
                s_mem, y_mem = np.concatenate([s_mem[1:], s_new]), np.concatenate([y_mem[1:], y_new])
                s_mem[:, :, keep], y_mem[:, :, keep] = held_s, held_y
            else:
                s_mem, y_mem = np.concatenate([s_mem, s_new]), np.concatenate([y_mem, y_new])
            w[:, at], f[at], g[:, at] = trial[:, good], new[good], g_new
            p[:, at] = cols.pseudo(w[:, at], g[:, at], at)
            steps[at] += 1
            fresh[at] = True
            settle()
            for k in limits:
                # a column that comes to a limit leaves its coefficients there
                reached = at[steps[at] == k]
                if len(reached):
                    held.setdefault(k, {}).update({int(j): w[:, j].copy() for j in reached})
            done |= steps >= max(limits)
    found = {}
    for k in limits:
        found[k] = w.copy()
        for j, column in held.get(k, {}).items():
            found[k][:, j] = column
    return found, steps, converged


@dataclass
class Problems:
    """The columns of all problems: one per problem and class."""

    k: int
    of: np.ndarray
    positive: np.ndarray
    smooth: np.ndarray
    c: np.ndarray
    l1: np.ndarray
    tol: np.ndarray

    def part(self, q: int) -> Problems:
        return self.columns(slice(q * self.k, (q + 1) * self.k))

    def columns(self, at: slice) -> Problems:
        return Problems(self.k, *[x[at] for x in (self.of, self.positive, self.smooth, self.c, self.l1, self.tol)])

    def fit(self, evaluate: Evaluation, d: int, limits: Sequence[int]) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
        return fit_columns(evaluate, d, self.of, self.positive, self.smooth, self.c, self.l1, self.tol, limits)


def _problems(keys: Sequence[tuple], counts: dict[int, int]) -> Problems:
    k, n = max(counts) + 1, sum(counts.values())
    share = np.array([counts.get(c, 0) for c in range(k)])
    take = [p for p in keys for _ in range(k)]
    balance = n / (len(counts) * np.maximum(share, 1))
    rare = np.maximum(np.minimum(share, n - share), 1) / n
    return Problems(
        k, np.tile(np.arange(k), len(keys)), np.where([p[3] for p in take], np.tile(balance, len(keys)), 1.0),
        np.array([p[1] != "hinge" for p in take]), np.array([p[2] for p in take]), np.array([p[0] == "l1" for p in take]),
        np.array([p[4] for p in take]) * np.tile(rare, len(keys)),
    )


def _fit_by_settings(rows: DataFrame, all_of: Problems, n: int, d: int, limits: Sequence[int]) -> tuple[dict, np.ndarray, np.ndarray]:
    """One task per problem, each with all training rows, which are few enough."""

    def fit(table: pa.Table) -> pa.Table:
        q = table.column("problem")[0].as_py()
        code = table.column("code").to_numpy()
        idx, val = list(table.column("idx")), list(table.column("val"))
        # one order whatever the shuffle delivered, for equal sums
        order = np.lexsort((pa.array([v.values.to_numpy().sum() for v in val]).to_numpy(), [len(i) for i in idx], code))
        evaluate = in_memory(code[order], [idx[i] for i in order], [val[i] for i in order], d)
        found, steps, converged = all_of.part(q).fit(evaluate, d, limits)
        out = {"problem": [], "limit_": [], "w": []}
        before = None
        for limit in limits:
            if before is None or not np.array_equal(before, found[limit]):
                out["problem"].append(q)
                out["limit_"].append(limit)
                out["w"].append(found[limit].tobytes())
                before = found[limit]
        n_out = len(out["w"])
        return pa.table(
            {
                "problem": pa.array(out["problem"], pa.int32()), "limit_": pa.array(out["limit_"], pa.int32()),
                "w": pa.array(out["w"], pa.binary()), "steps": pa.array([steps.tolist()] * n_out, pa.list_(pa.int32())),
                "converged": pa.array([converged.tolist()] * n_out, pa.list_(pa.bool_())),
            }
        )

    each = rows.withColumn("problem", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("problem", "code", "idx", "val")
    # a partition for every problem: equal numbers would hash to shared tasks
    each = each.repartitionByRange(n, "problem")
    schema = "problem int, limit_ int, w binary, steps array<int>, converged array<boolean>"
    got = each.groupBy("problem").applyInArrow(fit, schema).collect()  # coefficients: a size the settings decide
    k = all_of.k
    found = {limit: np.zeros((d + 1, n * k)) for limit in limits}
    steps, converged = np.zeros(n * k, dtype=int), np.zeros(n * k, dtype=bool)
    for r in sorted(got, key=lambda r: (r["problem"], r["limit_"])):
        at = slice(r["problem"] * k, (r["problem"] + 1) * k)
        steps[at], converged[at] = r["steps"], r["converged"]
        for limit in limits:
            if limit >= r["limit_"]:
                found[limit][:, at] = np.frombuffer(bytes(r["w"])).reshape(d + 1, k)
    return found, steps, converged


def _fit_by_rows(rows: DataFrame, all_of: Problems, entries: int, d: int, limits: Sequence[int]) -> tuple[dict, np.ndarray, np.ndarray]:
    """Passes over all rows, which are stored as blocks; the columns of about
    ``COLUMN_BYTES`` of coefficients share them."""
    spark = rows.sparkSession
    width = max(1, COLUMN_BYTES // (8 * (d + 1)))
    with set_for(spark, PASSING):
        path = stored_blocks(rows, d, entries)
        try:
            # a task has one sum, whatever the number of pieces it reads
            blocks = spark.read.parquet(path).coalesce(max(2 * spark.sparkContext.defaultParallelism, PASS_TASKS))
            tasks = blocks.rdd.getNumPartitions()
            got = [
                all_of.columns(slice(j, j + width)).fit(lambda w, *of: one_pass(blocks, tasks, w, *of), d, limits)
                for j in range(0, len(all_of.of), width)
            ]
        finally:
            remove(spark, path)
    found = {limit: np.hstack([g[0][limit] for g in got]) for limit in limits}
    return found, np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])


def search(
    train: DataFrame, evaluate: DataFrame, settings: Iterable[LinearSetting], features: int, by: str = "settings", max_rows: int = MAX_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Fit every setting on ``train`` (code, idx, val: class number, feature numbers and
    values) and classify ``evaluate`` (dataset, code, idx, val), all of it.

    Returns confusion counts ``(run, dataset, y_true, y_pred, n)`` and one status row per
    setting with its iterations (the most of its classes) and whether one of them used up
    its limit; a setting that no solver takes has an error instead. All training rows are
    fitted: with ``by="settings"`` a problem in a task, unless there are more than
    ``max_rows`` of them or ``MAX_ENTRIES`` entries, which go by rows. Store both tables
    beforehand. Class numbers are 0, 1, ...; with fewer than two classes every setting is
    an error."""
    if by not in ("settings", "rows"):
        raise ValueError("by is 'settings' or 'rows'")
    spark = train.sparkSession
    rows = train.select(F.col("code").cast("int").alias("code"), "idx", "val").filter("code is not null")
    sizes = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("idx")).alias("entries")).collect()
    counts, entries = {r["code"]: r["n"] for r in sizes}, sum(r["entries"] or 0 for r in sizes)
    status, runs, problems = [], [], {}
    for s in settings:
        try:
            s.check()
            if len(counts) < 2:
                raise ValueError("fewer than two classes")
            problems.setdefault(s.problem(), len(problems))
            runs.append(s)
        except ValueError as e:
            status.append((s.run_id(), *asdict(s).values(), None, None, str(e)))
    if not runs:
        none = spark.createDataFrame([], f"run string, {DATASET} string, y_true string, y_pred string, n long")
        return none, spark.createDataFrame(status, STATUS)
    all_of = _problems(list(problems), counts)
    k, limits = all_of.k, sorted({s.max_iter for s in runs})
    if by == "rows" or sum(counts.values()) > max_rows or entries > MAX_ENTRIES:
        found, steps, converged = _fit_by_rows(rows, all_of, entries, features, limits)
    else:
        found, steps, converged = _fit_by_settings(rows, all_of, len(problems), features, limits)
    # weights of a limit that changed nothing are those of the next
    sets: list[tuple[int, np.ndarray]] = []
    where: dict[int, int] = {}
    for limit in limits:
        if not sets or not np.array_equal(sets[-1][1], found[limit]):
            sets.append((limit, found[limit]))
        where[limit] = len(sets) - 1
    names = []
    for s in runs:
        q = problems[s.problem()]
        mine = slice(q * k, (q + 1) * k)
        used = int(np.minimum(steps[mine], s.max_iter).max())
        over = bool(((steps[mine] > s.max_iter) | ((steps[mine] >= s.max_iter) & ~converged[mine])).any())
        status.append((s.run_id(), *asdict(s).values(), used, over, None))
        names.append((where[s.max_iter] * len(problems) + q, s.run_id()))
    cf = _classify(evaluate, [w for _, w in sets], k, features)
    named = spark.createDataFrame(names, "model int, run string")
    cf = cf.join(F.broadcast(named), "model").groupBy("run", DATASET, "y_true", "y_pred").agg(F.sum("n").alias("n"))
    return cf, spark.createDataFrame(status, STATUS)


STATUS = (
    "run string, c double, max_iter int, balanced boolean, penalty string, loss string, dual boolean, tol double, "
    "iterations int, not_converged boolean, error string"
)


def _classify(rows: DataFrame, weights: list[np.ndarray], k: int, d: int) -> DataFrame:
    """(model, dataset, y_true, y_pred, n): counts of every model, summed in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        for b in batches:
            names, code = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part, x in _blocks(b, d, 2):
                for j, w in enumerate(weights):
                    best = (x @ w).reshape(len(x), -1, k).argmax(axis=2)
                    for q in range(best.shape[1]):
                        for key in zip(names[part], code[part], best[:, q].tolist()):
                            at = (j * best.shape[1] + q, *key)
                            counts[at] = counts.get(at, 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[0] for key in keys], pa.int32()), pa.array([key[1] for key in keys], pa.string()),
                pa.array([None if key[2] is None else str(key[2]) for key in keys], pa.string()),
                pa.array([str(key[3]) for key in keys], pa.string()), pa.array([counts[key] for key in keys], pa.int64()),
            ],
            ["model", DATASET, "y_true", "y_pred", "n"],
        )

    base = rows.select(F.col(DATASET).cast("string"), F.col("code").cast("int"), "idx", "val")
    return base.mapInArrow(run, f"model int, {DATASET} string, y_true string, y_pred string, n long")
