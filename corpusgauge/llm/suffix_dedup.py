"""Removal of long repeated byte strings by longest-previous-factor arrays.

A string of ``length`` bytes is repeated if its suffix has, among the suffixes
that sort next to it, one at an earlier (or, for the first copy, a later) position
that agrees on ``length`` bytes: previous and next smaller positions in suffix
order give the longest previous factor of every position.

Suffixes are only sorted where a repeat is possible, and only against those they
can agree with:

1. Every string of ``length`` bytes names one of its ``kernel``-byte substrings, its
   anchor, by least hash (leftmost first). Equal strings name equal anchors, so a
   repeat needs two occurrences of an anchor's hash; about one byte in a hundred is
   an anchor. The strings that name one anchor begin in one run of positions.
2. Anchors of equal hash whose whole runs agree (by digest of the bytes) are one
   class; copies by the thousand collapse to one row there, with partial counts.
3. Classes of one anchor that are not the same text are compared by suffix order of
   their bytes. An anchor with more than ``crowd`` classes is not gathered: its
   strings are counted by digest, one row each, which Spark spreads.

Positions are bytes of the UTF-8 text. Defined results: a NULL text is empty, shorter
texts than ``length`` are left alone, repeated rows are copies of each other, and the
order of copies is that of id and position. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored, string_or_empty
from .textbytes import Chunk, chunks

PIECE = 1 << 22
POSITION_BITS = np.uint64(24)
BLOCK_BYTES = 1 << 20
KEYS = ["h", "cd", "off", "len"]


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every window of ``w`` values."""
    n = len(x) - w + 1
    full = -(-len(x) // w) * w
    pad = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[: len(x)] = x
    grid = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchor_runs(c: Chunk, length: int, kernel: int) -> tuple[np.ndarray, ...]:
    """Hash, anchor, first and last string begin of every run, in buffer positions."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for s in range(0, max(len(c.buf) - length + 1, 0), PIECE):
        buf = c.buf[s : s + PIECE + length - 1]
        piece = Chunk(0, buf, np.array([0, len(buf)]))
        prefix = piece.prefix()
        at = np.arange(len(buf) - kernel + 1)
        h = piece.span_hash(prefix, at, at + kernel)
        packed = (h >> POSITION_BITS << POSITION_BITS) | at.astype(np.uint64)
        least = sliding_least(packed, length - kernel + 1)
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        # strings that begin in one text and end in it
        valid = np.zeros(len(anchor) + 1, dtype=np.int32)
        lo = np.clip(c.offs[:-1] - s, 0, len(anchor))
        hi = np.clip(c.offs[1:] - length + 1 - s, 0, len(anchor))
        some = hi > lo
        np.add.at(valid, lo[some], 1)
        np.add.at(valid, hi[some], -1)
        p = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        if not len(p):
            continue
        a = anchor[p]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(p)) - 1
        for x, v in zip(out, (h[a[begin]], a[begin] + s, p[begin] + s, p[end] + s)):
            x.append(v)
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out)


def _runs(length: int, kernel: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                h, a, lo, hi = anchor_runs(c, length, kernel)
                if not len(a):
                    continue
                row = np.searchsorted(c.offs, lo, "right") - 1
                base = c.offs[row]
                data = memoryview(np.ascontiguousarray(c.buf))
                cd = np.array(
                    [
                        int.from_bytes(hashlib.blake2b(data[x:y], digest_size=8).digest(), "little", signed=True)
                        for x, y in zip(lo.tolist(), (hi + length).tolist())
                    ],
                    dtype=np.int64,
                )
                take = pa.array(row + c.row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), pa.array(h.view(np.int64)), pa.array(cd),
                        pa.array((a - lo).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array(lo - base),
                    ],
                    ["id", "th", "h", "cd", "off", "len", "lo"],
                )

    return run


def nearest_smaller(pos: np.ndarray) -> np.ndarray:
    """For every place of a suffix order, the nearest earlier place that holds a
    smaller position (-1: none), by jumping along the answers found so far."""
    best = np.arange(-1, len(pos) - 1)
    todo = np.flatnonzero(best >= 0)
    while len(todo):
        # best[i] lies among the candidates of i: anything between is greater
        todo = todo[(best[todo] >= 0) & (pos[np.maximum(best[todo], 0)] > pos[todo])]
        best[todo] = best[best[todo]]
    return best


class SuffixOrder:
    """Suffix order, up to ``length`` bytes, of string begins in concatenated texts."""

    def __init__(self, buf: np.ndarray, begins: np.ndarray, group: np.ndarray, length: int):
        self.length = length
        pad = np.concatenate([buf, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
        eight = np.zeros(len(buf), dtype=np.uint64)
        for i in range(8):
            eight = (eight << np.uint64(8)) | pad[i : i + len(buf)]
        rank = np.unique(eight, return_inverse=True)[1].astype(np.int64)
        self.levels = [(8, rank)]
        size = 8
        while 2 * size <= length:
            # names of doubled length, in the same order; the ends wrap to nothing
            after = np.zeros(len(rank), dtype=np.int64)
            after[: max(len(rank) - size, 0)] = rank[size:]
            rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
            size *= 2
            self.levels.append((size, rank))
        # length as a sum of named sizes, and bytes for what is left
        keys, at = [], 0
        for size, rank in reversed(self.levels):
            while at + size <= length:
                keys.append(rank[begins + at])
                at += size
        if at < length:
            keys.append(self.levels[0][1][begins + length - 8])
        self.begins = begins
        self.order = np.lexsort((begins, *reversed(keys), group))
        self.group = group

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that suffixes of numbers x and y share, up to ``length``."""
        a, b = self.begins[x].copy(), self.begins[y].copy()
        out = np.zeros(len(x), dtype=np.int64)
        for size, rank in reversed(self.levels):
            for _ in range(2):  # a size may be needed twice: the greatest one, or the least
                ok = (out + size <= self.length) & (rank[np.minimum(a, len(rank) - 1)] == rank[np.minimum(b, len(rank) - 1)])
                out[ok] += size
                a[ok] += size
                b[ok] += size
        rest = self.length - out
        tail = (rest > 0) & (rest < 8)
        if tail.any():
            rank = self.levels[0][1]
            i = np.flatnonzero(tail)
            same = rank[self.begins[x[i]] + self.length - 8] == rank[self.begins[y[i]] + self.length - 8]
            out[i[same]] = self.length
        return out

    def longest_previous(self, later: bool = False) -> np.ndarray:
        """Longest previous factor of every begin, or longest next factor."""
        place = self.begins[self.order] * (-1 if later else 1)
        out = np.zeros(len(self.begins), dtype=np.int64)
        n = len(place)
        before = nearest_smaller(place)
        after = n - 1 - nearest_smaller(place[::-1])[::-1]
        for other in (before, after):
            i = np.flatnonzero((other >= 0) & (other < n))
            i = i[self.group[self.order[i]] == self.group[self.order[other[i]]]]
            me, it = self.order[i], self.order[other[i]]
            np.maximum.at(out, me, self.common(me, it))
        return out


def _as_ranges(hit: np.ndarray, owner: np.ndarray, at: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """Per owner, the maximal runs of ``at`` where ``hit``: a flat list of pairs."""
    i = np.flatnonzero(hit)
    o, p = owner[i], at[i]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(i)) - 1 if len(i) else begin
    pairs = np.column_stack([p[begin], p[end]]).astype(np.int32).ravel()
    size = 2 * np.bincount(o[begin], minlength=n)
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(pairs)), size


def _compare(length: int):
    """Ranges of strings that occur in another class of the anchor (``again``), or in
    one with an earlier first copy (``later``). Rows come sorted by anchor, then by
    the place of their first copy; whole anchors are compared in blocks."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        n = rows.num_rows
        data = rows.column("bytes").chunk(0)
        sizes = rows.column("len").to_numpy().astype(np.int64) + length
        buf = np.frombuffer(b"".join(data.to_pylist()), dtype=np.uint8)
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        count = sizes - length + 1
        owner = np.repeat(np.arange(n), count)
        at = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1], count)
        group = np.unique(rows.column("h").to_numpy(), return_inverse=True)[1][owner]
        order = SuffixOrder(buf, start[owner] + at, group, length)
        previous = order.longest_previous() >= length
        again, _ = _as_ranges(previous | (order.longest_previous(later=True) >= length), owner, at, n)
        later, _ = _as_ranges(previous, owner, at, n)
        keys = [rows.column(k).chunk(0) for k in KEYS]
        return pa.RecordBatch.from_arrays([*keys, again, later], [*KEYS, "again", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            row = 0
            while row < batch.num_rows:
                part = batch.slice(row, 512)
                row += part.num_rows
                if size >= BLOCK_BYTES:
                    # close the block at the last change of anchor
                    have = pa.Table.from_batches(held).combine_chunks()
                    h = have.column("h").to_numpy()
                    cut = np.flatnonzero(h != h[-1])
                    if len(cut):
                        yield block(have.slice(0, int(cut[-1]) + 1))
                        have = have.slice(int(cut[-1]) + 1)
                    held = have.to_batches()
                    size = sum(x.column(x.schema.get_field_index("bytes")).nbytes for x in held)
                held.append(part)
                size += int(part.column(part.schema.get_field_index("len")).to_numpy().sum()) + length * part.num_rows
        if held and sum(x.num_rows for x in held):
            yield block(pa.Table.from_batches(held))

    return run


def _slices(length: int):
    """Bytes of the classes asked for, from the texts that hold their first copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            wanted = b.column(1)
            flat = wanted.flatten()
            owner = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            if not len(owner):
                continue
            lo, n = flat.field(4).to_numpy(), flat.field(3).to_numpy()
            views: dict[int, bytes] = {}
            out = []
            for o, x, m in zip(owner.tolist(), lo.tolist(), n.tolist()):
                if o not in views:
                    views = {o: texts[o].as_buffer().to_pybytes()}
                out.append(views[o][x : x + m + length])
            yield pa.RecordBatch.from_arrays(
                [*[flat.field(i) for i in range(4)], pa.array(out, pa.binary()), flat.field(4), b.column(2).take(pa.array(owner))],
                [*KEYS, "bytes", "lo", "id"],
            )

    return run


def _strings(length: int):
    """Every string of a class by its digest: the way for crowded anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = memoryview(b.column(4)[i].as_py())
                n = len(data) - length + 1
                digest = [hashlib.blake2b(data[p : p + length], digest_size=16).digest() for p in range(n)]
                at = pa.array(np.full(n, i))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(j).take(at) for j in (0, 1, 2, 3, 5, 6)], pa.array(np.arange(n, dtype=np.int32)), pa.array(digest, pa.binary())],
                    [*KEYS, "lo", "id", "p", "digest"],
                )

    return run


def repeated_ranges(
    docs: DataFrame, length: int = 400, kernel: int | None = None, keep: str = "first", crowd: int = 2048
) -> DataFrame:
    """``id``, ``th`` and ``spans`` (array of first and last begin of repeated strings)
    for the texts that hold any. ``docs`` has id, th (a hash of the text) and text."""
    kernel = kernel or length // 2
    kind = docs.schema["id"].dataType.simpleString()
    place = f"id {kind}, th long, h long, cd long, off int, len int, lo long"
    runs = stored(docs.mapInArrow(_runs(length, kernel), place), "anchors")
    twice = runs.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    some = stored(runs.join(twice, "h"), "anchors-twice")
    classes = some.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "lo")).alias("first"))
    classes = stored(classes, "classes")
    groups = classes.groupBy("h").agg(F.count("*").alias("m"), F.sum(F.expr("int(n = 1)")).alias("single"))
    # where only all copies go, classes that have copies need no comparison of their own
    groups = groups.filter("m > 1 and single > 0" if keep == "none" else "m > 1")
    asked = classes.join(groups.select("h", "m"), "h")
    per_text = asked.groupBy(F.col("first.id").alias("id"), F.col("first.th").alias("th")).agg(
        F.collect_list(F.struct(*KEYS, F.col("first.lo").alias("lo"))).alias("wanted")
    )
    # of rows that repeat a text under one id, one is enough
    texts = docs.join(per_text.withColumnRenamed("id", "__id").withColumnRenamed("th", "__th"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
    sliced = texts.select("text", "wanted", "id").mapInArrow(
        _slices(length), f"h long, cd long, off int, len int, bytes binary, lo long, id {kind}"
    )
    sliced = sliced.join(groups.select("h", "m"), "h")
    sliced = stored(sliced, "class-bytes")
    found = f"h long, cd long, off int, len int, again array<int>, later array<int>"
    small = sliced.filter(F.col("m") <= crowd).select(*KEYS, "bytes", "lo", "id")
    small = small.repartition("h").sortWithinPartitions("h", "id", "lo", "cd", "off", "len")
    ranges = small.mapInArrow(_compare(length), found)
    large = sliced.filter(F.col("m") > crowd).select(*KEYS, "bytes", "lo", "id")
    if not large.isEmpty():
        rows = stored(
            large.mapInArrow(_strings(length), f"h long, cd long, off int, len int, lo long, id {kind}, p int, digest binary"),
            "crowded-strings",
        )
        copies = rows.groupBy("digest").agg(F.count("*").alias("c"), F.min(F.struct("id", "lo", "p")).alias("least"))
        hits = rows.join(copies.filter("c > 1"), "digest")
        hits = hits.select(*KEYS, "p", F.expr("struct(id, lo, p) <> least").alias("not_first"))
        pairs = lambda a: F.expr(f"flatten(transform({a}, x -> array(x, x)))")
        lists = hits.groupBy(*KEYS).agg(
            F.array_sort(F.collect_set("p")).alias("a"), F.array_sort(F.collect_set(F.expr("if(not_first, p, null)"))).alias("l")
        )
        ranges = ranges.union(lists.select(*KEYS, pairs("a").alias("again"), pairs("l").alias("later")))
    ranges = stored(ranges.dropDuplicates(KEYS), "class-ranges")
    known = classes.join(ranges, KEYS, "left")
    whole = F.expr("array(0, len)")
    if keep == "none":
        known = known.select(*KEYS, F.when(F.col("n") > 1, whole).otherwise(F.col("again")).alias("r"), F.lit(None).alias("first"))
        at = some.join(known.filter("size(r) > 0").drop("first"), KEYS).select("id", "th", "lo", "r")
    else:
        at = some.join(known.select(*KEYS, "n", "later", "first").filter("n > 1 or size(later) > 0"), KEYS)
        is_first = F.col("first").eqNullSafe(F.struct("id", "th", "lo"))
        at = at.select("id", "th", "lo", F.when(is_first, F.coalesce("later", F.array().cast("array<int>"))).otherwise(whole).alias("r"))
    spans = F.expr("transform(sequence(0, size(r) div 2 - 1), i -> struct(lo + r[2 * i] as a, lo + r[2 * i + 1] as b))")
    at = at.filter("size(r) > 0").select("id", "th", spans.alias("s"))
    return at.groupBy("id", "th").agg(F.flatten(F.collect_list("s")).alias("spans"))


def remove_repeats(
    docs: DataFrame, length: int = 400, keep: str = "first", key: str = "doc_id", text: str = "text",
    kernel: int | None = None, crowd: int = 2048,
) -> DataFrame:
    """key, ``n_bytes``, ``removed`` (maximal removed spans, byte offsets) and ``kept``
    (the remaining bytes) of every row. ``keep="first"`` spares the first copy of a
    repeated string, ``"none"`` no copy."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    base = docs.select(F.col(f"`{key}`").alias("id"), string_or_empty(docs, text).alias("text"))
    base = base.select("id", F.xxhash64("text").alias("th"), "text")
    found = repeated_ranges(base, length, kernel, keep, crowd)
    found = found.withColumnRenamed("id", "__id").withColumnRenamed("th", "__th")
    both = base.join(found, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            removed, kept, sizes = [], [], []
            lists = b.column(2).to_pylist()
            for i in range(b.num_rows):
                data = b.column(1)[i].as_buffer().to_pybytes()
                merged: list[list[int]] = []
                for s in sorted((s["a"], s["b"]) for s in lists[i] or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1] + length)
                    else:
                        merged.append([s[0], s[1] + length])
                edges = [0, *[x for m in merged for x in m], len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2])))
                removed.append([{"start": x, "end": y} for x, y in merged])
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())],
                ["k", "n_bytes", "removed", "kept"],
            )

    kind = base.schema["id"].dataType.simpleString()
    return both.select("id", "text", "spans").mapInArrow(
        cut, f"`{key}` {kind}, n_bytes long, removed array<struct<start: bigint, end: bigint>>, kept binary"
    )
