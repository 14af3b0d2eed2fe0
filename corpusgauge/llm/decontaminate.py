"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over hashed words. A randomised SVD
finds their leading directions: one pass adds up Y'Y and A'Y for Y = A * Omega, both
of bounded size, and the driver turns them into the map from words to the latent
space. Windows of every document, at every block of words, are then compared with
the benchmark items by cosine, the items being the query set and the windows going
by in blocks. Candidates are confirmed in place by the longest common subsequence of
words, and where that leaves doubt by the words of the answer.

Words are compared without case and punctuation. No text is shuffled: statistics are
summed per partition, and the search is a map over documents.

Defined results: NULL and empty texts match nothing; items without words are left
out; items of fewer than ``short`` words must occur whole and unbroken; repeated rows
are each searched; further columns of either table are ignored. Without items or
documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settled, stored
from .textbytes import PUNCTUATION, Chunk, chunks


@dataclass(frozen=True)
class Retrieval:
    bucket_bits: int = 14
    rank: int = 64
    oversample: int = 8
    block: int = 8
    passage: int = 48
    # cosine from which a window is looked at
    cosine: float = 0.42
    # share of an item's words that a window repeats in order: enough, or enough with the answer
    sure: float = 0.75
    likely: float = 0.55
    answer_words: int = 6
    answer_share: float = 0.6
    short: int = 10
    seed: int = 5
    # items that are searched for in one pass
    item_block: int = 5000


def _hashed(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = c.words(PUNCTUATION)
    return c.span_hash(c.prefix(lower=True), starts, ends), first


def _buckets(h: np.ndarray, how: Retrieval) -> np.ndarray:
    return (h >> np.uint64(64 - how.bucket_bits)).astype(np.int64)


def _passages(c: Chunk, how: Retrieval) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Passage, bucket and count of every distinct (passage, bucket) of a chunk."""
    h, first = _hashed(c)
    words = np.diff(first)
    own = -(-words // how.passage)
    begin = np.concatenate([[0], np.cumsum(own)])
    owner = np.repeat(np.arange(len(c)), words)
    passage = begin[owner] + (np.arange(len(h)) - first[owner]) // how.passage
    key, tf = np.unique((passage << how.bucket_bits) | _buckets(h, how), return_counts=True)
    return key >> how.bucket_bits, key & ((1 << how.bucket_bits) - 1), tf, int(begin[-1])


def segment_sums(table: np.ndarray, rows: np.ndarray, weight: np.ndarray | None, at: np.ndarray) -> np.ndarray:
    """Sums of ``weight * table[rows]`` over the segments that begin at ``at``, in
    pieces that stay in a core's cache."""
    out = np.empty((len(at), table.shape[1]), dtype=np.float32)
    edges = [0]
    while edges[-1] < len(at):
        edges.append(max(int(np.searchsorted(at, at[edges[-1]] + 2048, "right")) - 1, edges[-1] + 1))
    for i, j in zip(edges, edges[1:]):
        x, y = at[i], at[j] if j < len(at) else len(rows)
        part = table[rows[x:y]]
        if weight is not None:
            part *= weight[x:y, None]
        np.add.reduceat(part, at[i:j] - x, axis=0, out=out[i:j])
    return out


def inverse_frequencies(docs: DataFrame, how: Retrieval) -> np.ndarray:
    """Log inverse share of passages that hold a bucket, over all passages."""
    size = 1 << how.bucket_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for c in chunks(batch.column(0), 1 << 20):
                _, b, _, n = _passages(c, how)
                total[:size] += np.bincount(b, minlength=size)
                total[size] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    full = np.zeros(size + 1)
    full[rows["bucket"]] = rows["n"]
    return np.log((full[size] + 1.0) / (full[:size] + 0.5)).clip(0.0)


def latent_map(docs: DataFrame, how: Retrieval) -> tuple[np.ndarray, np.ndarray]:
    """Buckets x rank: inverse frequencies times the leading right singular vectors
    of the passages' TF-IDF matrix, over the singular values. Also the frequencies."""
    size, width = 1 << how.bucket_bits, how.rank + how.oversample
    idf = inverse_frequencies(docs, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = np.random.default_rng(how.seed).normal(size=(size, width)).astype(np.float32)
        gram, cross = np.zeros((width, width)), np.zeros((size, width), dtype=np.float32)
        for batch in batches:
            for c in chunks(batch.column(0), 1 << 19):
                p, b, tf, n = _passages(c, how)
                if not n:
                    continue
                w = tf * idf[b]
                norm = np.sqrt(np.bincount(p, w * w, minlength=n))
                w = (w / np.maximum(norm, 1e-9)[p]).astype(np.float32)
                y = segment_sums(omega, b, w, np.searchsorted(p, np.arange(n)))
                gram += (y.T @ y).astype(np.float64)
                # rows of equal bucket side by side
                order = np.argsort(b.astype(np.uint16), kind="stable")
                at = np.flatnonzero(np.diff(b[order], prepend=-1))
                cross[b[order][at]] += segment_sums(y, p[order], w[order], at)
        some = np.flatnonzero(cross.any(axis=1))
        rows = [cross[i].tobytes() for i in some] + [g.tobytes() for g in gram]
        number = np.concatenate([some, size + np.arange(width)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(rows, pa.binary())], ["bucket", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(v, dtype=np.float64 if i >= size else np.float32).astype(np.float64)
                total[i] = total[i] + x if i in total else x
        rows = [x.astype(np.float64 if i >= size else np.float32).tobytes() for i, x in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rows, pa.binary())], ["bucket", "v"])

    parts = docs.select("text").mapInArrow(run, "bucket int, v binary")
    sums = parts.repartition("bucket").mapInArrow(add, "bucket int, v binary")
    gram, cross = np.zeros((width, width)), np.zeros((size, width))
    for bucket, v in stored(sums, "latent-sums").toPandas().itertuples(index=False):  # size + width rows
        if bucket >= size:
            gram[bucket - size] = np.frombuffer(v, dtype=np.float64)
        else:
            cross[bucket] = np.frombuffer(v, dtype=np.float32)
    # Y = QR: B = Q'A has the rows of R^-T (A'Y)'
    values, vectors = np.linalg.eigh(gram + 1e-6 * max(np.trace(gram), 1e-12) / width * np.eye(width))
    half = cross @ (vectors / np.sqrt(values))
    _, s, right = np.linalg.svd(half.T, full_matrices=False)
    # directions count alike: else the few that every text shares would rule the cosine
    scale = np.where(s > 1e-4 * max(s[0], 1e-12), 1.0 / np.maximum(s, 1e-12), 0.0)[: how.rank]
    return (idf[:, None] * right[: how.rank].T * scale).astype(np.float32), idf


def _block_vectors(h: np.ndarray, first: np.ndarray, latent: np.ndarray, how: Retrieval) -> tuple[np.ndarray, np.ndarray]:
    """Latent sums of every block of words, and each text's first block."""
    words = np.diff(first)
    blocks = -(-words // how.block)
    begin = np.concatenate([[0], np.cumsum(blocks)])
    owner = np.repeat(np.arange(len(words)), blocks)
    at = first[owner] + (np.arange(len(owner)) - begin[owner]) * how.block
    return segment_sums(latent, _buckets(h, how), None, at), begin


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence with an item of ``n`` words whose
    places are given as bit masks."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Items:
    """The benchmark items of one pass: words, masks and latent windows."""

    def __init__(self, rows: list[tuple], latent: np.ndarray, idf: np.ndarray, how: Retrieval):
        self.ids, self.words, self.masks, self.answer = [], [], [], []
        self.scale: dict[int, tuple[list, list, list]] = {}
        for item, text, answer in rows:
            c = next(chunks(pa.array([text or ""])))
            h, _ = _hashed(c)
            if not len(h):
                continue
            a = _hashed(next(chunks(pa.array([answer]))))[0] if answer else h[-how.answer_words :]
            number = len(self.ids)
            self.ids.append(item)
            self.words.append(h.tolist())
            self.masks.append(self._mask(h))
            self.answer.append((self._mask(a), len(a)))
            # a window of this many blocks holds any place of so many words
            size = min(len(h), how.passage)
            blocks = 1 + -(-size // how.block)
            for i in range(0, max(len(h) - how.passage, 0) + 1, how.block):
                vectors, numbers, offsets = self.scale.setdefault(blocks, ([], [], []))
                vectors.append(latent[_buckets(h[i : i + how.passage], how)].sum(0))
                numbers.append(number)
                offsets.append(i)
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.scale = {s: (_unit(np.array(v)), np.array(n), np.array(o)) for s, (v, n, o) in self.scale.items()}
        # a common subsequence that is long enough holds this many of an item's rarer words
        self.rare = np.zeros((len(self.ids), 1 << how.bucket_bits), dtype=bool)
        self.least = np.zeros(len(self.ids), dtype=np.int64)
        for number, words in enumerate(self.words):
            b = _buckets(np.array(words, dtype=np.uint64), how)
            n = len(b)
            rare = idf[b] >= np.quantile(idf[b], 0.4)
            self.rare[number, b[rare]] = True
            need = 1.0 if n < how.short else how.likely
            self.least[number] = np.ceil(need * n - 1e-9) - np.count_nonzero(~self.rare[number, b])

    def possible(self, number: np.ndarray, lo: np.ndarray, hi: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the places [lo, hi) hold enough of the rarer words of their item."""
        size = hi - lo
        at = np.cumsum(size) - size
        words = np.repeat(lo - at, size) + np.arange(int(size.sum()))
        hit = self.rare[np.repeat(number, size), b[words]]
        return np.add.reduceat(hit, at, dtype=np.int64) >= self.least[number] if len(at) else np.zeros(0, dtype=bool)

    @staticmethod
    def _mask(h: np.ndarray) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(h.tolist()):
            out[w] = out.get(w, 0) | (1 << i)
        return out

    def confirm(self, number: int, words: list[int], how: Retrieval) -> tuple[float, float] | None:
        """Shares of the item's and of its answer's words, if they are enough."""
        n = len(self.words[number])
        share = common_subsequence(self.masks[number], n, words) / n
        if n < how.short:
            item = self.words[number]
            whole = share == 1.0 and any(words[i : i + n] == item for i in range(len(words) - n + 1))
            return (1.0, 1.0) if whole else None
        if share < how.likely:
            return None
        masks, k = self.answer[number]
        answer = common_subsequence(masks, k, words) / k if k else 1.0
        return (share, answer) if share >= how.sure or answer >= how.answer_share else None


def _peaks(cosine: np.ndarray, doc: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places (x, y) those no lower than the rows of the same document before and
    after them."""
    value = cosine[x, y]
    w, z = np.maximum(x - 1, 0), np.minimum(x + 1, len(cosine) - 1)
    before = np.where((x > w) & (doc[w] == doc[x]), cosine[w, y], -1.0)
    after = np.where((x < z) & (doc[z] == doc[x]), cosine[z, y], -1.0)
    top = (value >= before) & (value >= after)
    return x[top], y[top]


def _search(items: Items, latent: np.ndarray, how: Retrieval):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], tuple[float, float]] = {}
            for c in chunks(batch.column(1), 1 << 19):
                h, first = _hashed(c)
                if not len(h):
                    continue
                vectors, begin = _block_vectors(h, first, latent, how)
                b = _buckets(h, how)
                owner = np.repeat(np.arange(len(c)), np.diff(begin))
                block = np.arange(len(owner))
                last = begin[owner + 1]
                window, width = vectors.copy(), 1
                for s in sorted(items.scale):
                    wanted, numbers, offsets = items.scale[s]
                    for k in range(width, s):  # blocks of the same text only
                        inside = np.flatnonzero(block + k < last)
                        window[inside] += vectors[inside + k]
                    width = s
                    # a window per block; one that would leave the text is covered by those before
                    at = np.flatnonzero((block + s <= last) | (block == begin[owner]))
                    near = np.zeros((0, 3), dtype=np.int64)
                    for i in range(0, len(at), 4096):
                        cosine = _unit(window[at[i : i + 4096]]) @ wanted.T
                        x, y = np.nonzero(cosine >= how.cosine)
                        # of a text's neighbouring windows that are near one item, the nearest
                        x, y = _peaks(cosine, owner[at[i : i + 4096]], x, y)
                        near = np.concatenate([near, np.column_stack([at[i + x], numbers[y], offsets[y]])])
                    a, number, offset = near.T
                    n = items.sizes[number]
                    doc = owner[a]
                    start = first[doc] + (a - begin[doc]) * how.block
                    # the whole item, with a block to spare on both sides
                    lo = np.maximum(first[doc], start - offset - how.block)
                    hi = np.minimum(first[doc + 1], start - offset + np.maximum(n, s * how.block) + 2 * how.block)
                    for i in np.flatnonzero(items.possible(number, lo, hi, b)).tolist():
                        key = (c.row + int(doc[i]), int(number[i]))
                        if found.get(key, (0.0,))[0] == 1.0:
                            continue
                        hit = items.confirm(key[1], h[lo[i] : hi[i]].tolist(), how)
                        if hit:
                            found[key] = max(hit, found.get(key, (0.0, 0.0)))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r for r, _ in rows], pa.int64())),
                    pa.array([items.ids[i] for _, i in rows], type=item_type(items)),
                    pa.array([found[r][0] for r in rows], pa.float64()),
                    pa.array([found[r][1] for r in rows], pa.float64()),
                ],
                ["k", "i", "share", "answer_share"],
            )

    def item_type(items: Items) -> pa.DataType:
        return pa.string() if items.ids and isinstance(items.ids[0], str) else pa.int64()

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, how: Retrieval | None = None, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", answer: str | None = None,
) -> DataFrame:
    """One row per document and benchmark item that it repeats: key, item, ``share`` of
    the item's words found in order, and ``answer_share``."""
    how = how or Retrieval()
    base = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("text"))
    kinds = [base.schema[0].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()]
    if kinds[1] not in ("string", "bigint"):
        kinds[1] = "bigint"
    wanted = benchmark.select(
        F.col(f"`{item}`").cast(kinds[1]).alias("i"),
        F.col(f"`{item_text}`").cast("string").alias("t"),
        (F.col(f"`{answer}`").cast("string") if answer else F.lit(None).cast("string")).alias("a"),
    ).filter("t is not null")
    n_blocks = wanted.count() // how.item_block + 1
    latent, idf = latent_map(base, how)
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, share double, answer_share double"
    out = None
    for b in range(n_blocks):
        # blocks of even size by digest: what travels to the tasks is bounded
        rows = wanted.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b).collect()
        part = base.mapInArrow(_search(Items([tuple(r) for r in rows], latent, idf, how), latent, how), schema)
        out = part if out is None else out.union(part)
    return stored(out, "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, how: Retrieval | None = None, key: str = "doc_id") -> DataFrame:
    """``docs`` without those that repeat a benchmark item."""
    gone = settled(
        docs.sparkSession,
        lambda: contaminated(docs, benchmark, how, key).select(F.col(key).alias("__gone")).distinct(),
        "leaks-gone",
    )
    return docs.join(gone, docs[f"`{key}`"] == F.col("__gone"), "left_anti")
