"""MinHash near-duplicates by an LSH forest.

Every tree sorts the documents by its own sequence of minimum hashes. Neighbours in
that order share the longest prefixes, so each document meets the next ``reach``
ones with which it shares at least two values, or in a dense region the next one: where
a region is dense the shared prefix is deep, where it is sparse it is short, and nothing of the size of a region
is ever gathered or paired. The orders are range-partitioned sorts, so a region of
any size spreads over tasks. Candidates are confirmed on the full shingle sets, and
confirmed links form components. Documents of dense regions are sorted again by
further trees, in which they meet only documents of other components, until a round
of trees links fewer than one in ``worth`` of them. What these rounds leave is found
exactly: documents of dense regions that are still in different components meet by a
prefix filter on their rarest shingles, so the rounds only save pairs.

Documents of equal shingle sets are one class before any of this (grouped by digest
with partial minima); a group of copies that holds a third of all rows enters the
trees as one row.

Defined results: NULL, empty and blank texts have no shingles, are linked with
nothing and are kept; a text shorter than a shingle is one shingle; rows of equal
id count as one document; ties do not arise, since components are named by their
least id. Further columns of the input are kept by :func:`keep_first`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import settled, stored
from .textbytes import Chunk, chunks, mix64


#: Signature values that a tree sorts by: two whole ones and sixteen of eight bits.
DEPTH = 18


@dataclass(frozen=True)
class Forest:
    shingle: int = 5
    percent: int = 80
    values: int = 84
    trees: int = 14
    reach: int = 3
    # rows of equal leading values beyond which a region counts as dense
    region: int = 8
    # regions in which a document has met this many others get more trees
    dense: int = 8
    more_trees: int = 64
    # a round that links fewer than one in so many documents of dense regions is the last
    # before the exact join
    worth: int = 500
    # share of equal signature values from which a pair of a dense region is confirmed
    likely: float = 0.68
    seed: int = 11


def shingle_sets(c: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk sorted by text and value, and for each text
    the number of its first one (one more at the end)."""
    starts, ends, first = c.words()
    h = c.span_hash(c.prefix(lower=True), starts, ends)
    words = np.diff(first)
    # a short text is one shingle of all its words
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(c)), count)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = first[owner] + np.arange(len(owner)) - begin[owner]
    g = np.zeros(len(owner), dtype=np.uint64)
    stop = first[owner + 1] if len(owner) else at
    for k in range(n):
        has = at + k < stop
        word = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else g
        g = np.where(has, mix64(g * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(1)), g)
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(len(c) + 1))


def signatures(docs: DataFrame, how: Forest, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, number of shingles, digest of the set (NULL if empty) and minimum hashes."""
    k = how.values
    rng = np.random.default_rng(how.seed)
    a = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, k, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                g, first = shingle_sets(c, how.shingle)
                full = np.flatnonzero(first[1:] > first[:-1])
                sig = np.zeros((len(full), k), dtype=np.int32)
                for i in range(k if len(full) else 0):
                    low = np.minimum.reduceat((g * a[i] + b[i]) >> np.uint64(32), first[:-1][full])
                    sig[:, i] = low.astype(np.uint32).view(np.int32)
                at = np.zeros(len(c) + 1, dtype=np.int32)
                at[1:][full] = k
                data = g.tobytes()
                digest = [
                    hashlib.blake2b(data[8 * x : 8 * y], digest_size=16).digest() if y > x else None
                    for x, y in zip(first[:-1].tolist(), first[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c.row, len(c)),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array(digest, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(at, dtype=np.int32)), pa.array(sig.ravel())),
                    ],
                    ["k", "n", "d", "s"],
                )

    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    narrow = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    return narrow.mapInArrow(run, f"id {kind}, n_shingles long, digest binary, signature array<int>")


def tree_orders(how: Forest, round_no: int) -> np.ndarray:
    """For every tree of a round, the numbers of the ``DEPTH`` signature values that it
    sorts by. The leading two differ between trees while there are values left."""
    rng = np.random.default_rng([how.seed, round_no])
    out = []
    for t in range(how.trees if round_no == 0 else how.more_trees):
        if 2 * t % (how.values - 1) < 2:
            order = rng.permutation(how.values)
        lead = order[2 * t % (how.values - 1) :][:2]
        rest = rng.permutation(np.setdiff1d(np.arange(how.values), lead))[: DEPTH - 2]
        out.append(np.concatenate([lead, rest]))
    return np.array(out)


def candidates(classes: DataFrame, how: Forest, round_no: int = 0) -> DataFrame:
    """Distinct pairs (a < b) of neighbours in the sorted orders of all trees, without
    pairs whose ``component`` is the same already. In round 0 also a pair (a, a) for every
    document that did not meet all documents of equal leading values in some tree.

    The two leading values are kept whole, since pairs must share them; of the
    following ones eight bits each, which only order the rows.
    """
    orders = tree_orders(how, round_no)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = batch.column(2).flatten().to_numpy().reshape(n, how.values)
            # a byte of each value, where rows are few and their pairs many
            size = how.values if round_no else 0
            data = pa.py_buffer(np.ascontiguousarray(sig[:, :size].astype(np.uint8)))
            at = pa.py_buffer(np.arange(0, size * n + 1, size, dtype=np.int32) if size else np.zeros(n + 1, dtype=np.int32))
            brief = pa.BinaryArray.from_buffers(pa.binary(), n, [None, at, data])
            for t, order in enumerate(orders):
                low = np.ascontiguousarray(sig[:, order[2:]].astype(np.uint8))
                deep = low.view(">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, t, dtype=np.int16)),
                        *[pa.array(np.ascontiguousarray(sig[:, order[i]])) for i in (0, 1)],
                        *[pa.array(np.ascontiguousarray(deep[:, i])) for i in range(deep.shape[1])],
                        batch.column(0),
                        batch.column(1),
                        brief,
                    ],
                    ["tree", "m0", "m1", "d0", "d1", "id", "component", "brief"],
                )

    kind = classes.schema["id"].dataType.simpleString()
    order = ["tree", "m0", "m1", "d0", "d1", "id"]
    rows = classes.select("id", "component", "signature").mapInArrow(
        plant, f"tree short, m0 int, m1 int, d0 long, d1 long, id {kind}, component {kind}, brief binary"
    )
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def among(prefix: list[np.ndarray], n: int, off: int) -> np.ndarray:
        """Rows in a run of equal prefixes that is longer than ``off``."""
        far = np.ones(max(n - off, 0), dtype=bool)
        for p in prefix:
            far &= p[off:] == p[: len(far)]
        out = np.zeros(n, dtype=bool)
        for i in range(off + 1):
            out[i : i + len(far)] |= far
        return out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, near = None, min(how.reach + 1, how.region)
        keep = max(how.reach + 1, how.region)
        for batch in batches:
            table = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
            old = 0 if tail is None else tail.num_rows
            n = table.num_rows
            prefix = [table.column(i).to_numpy() for i in range(3)]
            home = table.column(6).to_numpy()
            # rows of more equal leading values than the region limit, than a row meets
            crowded = among(prefix, n, how.region)
            left, right = [], []
            if not round_no:
                left.append(np.flatnonzero(among(prefix, n, near)))
                right.append(left[0])
            for step in range(1, how.reach + 1):
                if n <= step:
                    break
                same = home[step:] != home[:-step]
                for p in prefix:
                    same &= p[step:] == p[:-step]
                if step > 1:  # in a dense region the next one only: order there is depth
                    same &= ~crowded[step:]
                same[: max(0, old - step)] = False  # met with the batch before
                x = np.flatnonzero(same)
                if round_no and len(x):
                    sig = np.frombuffer(b"".join(table.column(7).to_pylist()), dtype=np.uint8).reshape(n, how.values)
                    x = x[(sig[x] == sig[x + step]).mean(axis=1) >= how.likely]
                left.append(x)
                right.append(x + step)
            kept = table.slice(max(0, n - keep)).combine_chunks().to_batches()
            tail = kept[0] if kept else None
            if left:
                ids = table.column(5)
                x, y = ids.take(pa.array(np.concatenate(left))), ids.take(pa.array(np.concatenate(right)))
                yield pa.RecordBatch.from_arrays([x.combine_chunks(), y.combine_chunks()], ["a", "b"])

    pairs = rows.mapInArrow(meet, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirm(pairs: DataFrame, docs: DataFrame, how: Forest, key: str, text: str) -> DataFrame:
    """The pairs whose full shingle sets overlap enough."""
    texts = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    both = (
        pairs.join(texts.select(F.col("__id").alias("a"), F.col("__text").alias("ta")), "a")
        .join(texts.select(F.col("__id").alias("b"), F.col("__text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, dtype=bool)
            row = 0
            while row < batch.num_rows:
                # both texts of a pair lie side by side in one chunk
                part = batch.slice(row, 256)
                mixed = pa.concat_arrays([part.column(2), part.column(3)])
                n = part.num_rows
                turn = pa.array(np.arange(2 * n).reshape(2, n).T.ravel())
                sets: list[np.ndarray] = []
                for c in chunks(mixed.take(turn)):
                    g, first = shingle_sets(c, how.shingle)
                    sets += [g[x:y] for x, y in zip(first[:-1], first[1:])]
                for i in range(n):
                    x, y = sets[2 * i], sets[2 * i + 1]
                    small, large = min(len(x), len(y)), max(len(x), len(y))
                    if small and 100 * small >= how.percent * large:
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        linked[row + i] = 100 * common >= how.percent * (len(x) + len(y) - common)
                row += n
            if linked.any():
                keep = pa.array(linked)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


#: Shingles are counted in so many buckets, sent in pieces of 1,024.
BUCKET_BITS, PIECE_BITS = 18, 10


def shingle_counts(texts: DataFrame, how: Forest) -> np.ndarray:
    """How many texts hold a shingle of each bucket. Any order of the shingles gives the
    same links; this one puts the rare ones first."""
    size, piece = 1 << BUCKET_BITS, 1 << PIECE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for c in chunks(batch.column(0)):
                g, _ = shingle_sets(c, how.shingle)
                total += np.bincount((g >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=size)
        parts = total.reshape(-1, piece)
        some = np.flatnonzero(parts.any(axis=1))
        rows = [parts[i].tobytes() for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(rows, pa.binary())], ["piece", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(v, dtype=np.int64)
                total[i] = total[i] + x if i in total else x
        rows = [x.tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rows, pa.binary())], ["piece", "v"])

    parts = texts.select("text").mapInArrow(run, "piece int, v binary")
    sums = parts.repartition("piece").mapInArrow(add, "piece int, v binary")
    out = np.zeros((size // piece, piece), dtype=np.int64)
    for i, v in stored(sums, "forest-counts").toPandas().itertuples(index=False):  # a row per piece
        out[i] = np.frombuffer(v, dtype=np.int64)
    return out.ravel()


def open_pairs(at: DataFrame, docs: DataFrame, how: Forest, key: str, text: str) -> DataFrame:
    """All pairs (a < b) of the documents of ``at`` that lie in different components and
    can overlap enough.

    Two sets that do share one of the rarest shingles of both, and the first that they
    share leaves enough behind it on either side. A shingle meets across components
    only: the rows of its commonest component are never paired with each other.
    """
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).dropDuplicates(["id"])
    texts = stored(at.select("id", "component").join(texts, "id"), "forest-open")
    counts = shingle_counts(texts, how)
    kind = texts.schema["id"].dataType.simpleString()

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                g, first = shingle_sets(c, how.shingle)
                owner = np.repeat(np.arange(len(c)), np.diff(first))
                order = np.lexsort((g, counts[(g >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], owner))
                n = np.diff(first)[owner]
                place = np.arange(len(g)) - first[:-1][owner]
                lead = np.flatnonzero(place <= n + (-how.percent * n) // 100)
                row = pa.array(c.row + owner[lead])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g[order][lead].view(np.int64)),
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array(n[lead].astype(np.int32)),
                        pa.array((n - place)[lead].astype(np.int32)),
                    ],
                    ["g", "id", "component", "n", "rest"],
                )

    rows = texts.mapInArrow(rarest, f"g long, id {kind}, component {kind}, n int, rest int")
    rows = stored(rows, "forest-rarest")
    held = rows.groupBy("g", "component").agg(F.count("*").alias("n"))
    held = held.groupBy("g").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("k"))
    held = held.filter("k > 1").select("g", "main")
    across = stored(rows.join(held, "g"), "forest-across")
    x = across.filter("component <> main").select("g", *[F.col(c).alias(f"x_{c}") for c in ("id", "component", "n", "rest")])
    y = across.alias("y")
    enough = f"{100 + how.percent} * least(x_rest, y.rest) >= {how.percent} * (x_n + y.n)"
    pairs = x.join(y, "g").filter(f"x_component <> y.component and (y.component = y.main or x_id < y.id) and {enough}")
    return pairs.select(F.least("x_id", "y.id").alias("a"), F.greatest("x_id", "y.id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, how: Forest | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, n_shingles, component_id and kept for every row."""
    how = how or Forest()
    base = stored(signatures(docs, how, key, text), "forest-signatures")
    groups = base.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    groups = stored(groups, "forest-classes")
    classes = base.join(groups.select(F.col("rep").alias("id")).filter("id is not null").distinct(), "id")
    classes = stored(classes.select("id", "signature").dropDuplicates(["id"]), "forest-rows")
    apart = classes.withColumn("component", F.col("id"))
    met = stored(candidates(apart, how), "forest-pairs")
    pairs = met.filter("a <> b")
    links = stored(confirm(pairs, docs, how, key, text), "forest-links")
    found = components(links)
    crowded = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    crowded = crowded.filter(F.col("n") >= how.dense).select("id")
    dense = stored(classes.join(crowded, "id"), "forest-dense")
    # whatever a region kept apart meets in the exact join, however many it has met
    cut_off = stored(classes.join(met.filter("a = b").select(F.col("a").alias("id")), "id"), "forest-cut-off")
    tested = pairs
    n_dense = dense.count()
    round_no, more_rounds = 1, bool(n_dense)
    while more_rounds is not None:
        at = (dense if more_rounds else cut_off).join(found, "id", "left")
        at = stored(at.select("id", "signature", F.coalesce("component", "id").alias("component")), "forest-round")
        near = candidates(at, how, round_no) if more_rounds else open_pairs(at, docs, how, key, text)
        new = stored(near.join(tested, ["a", "b"], "left_anti"), "forest-pairs")
        tested = tested.union(new)
        more = stored(confirm(new, docs, how, key, text), "forest-links")
        joined = more.count()
        if joined:
            found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
        # the last links of a dense region are not worth a round of trees over all of it:
        # the exact join finds them, and after it none are left
        more_rounds, round_no = (joined * how.worth >= n_dense if more_rounds else None), round_no + 1
    found = found.withColumnRenamed("id", "rep")
    named = groups.join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = base.select("id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_first(docs: DataFrame, how: Forest | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one of least id."""
    gone = settled(
        docs.sparkSession,
        lambda: near_duplicates(docs, how, key, text).filter("not kept").select(F.col(key).alias("__gone")),
        "near-gone",
    )
    return docs.join(gone, docs[f"`{key}`"] == F.col("__gone"), "left_anti")
