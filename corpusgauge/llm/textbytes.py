"""Words, lines and hashes of whole texts as arrays over their UTF-8 bytes.

Small helpers for code that runs inside Spark tasks: a batch of texts is taken
from Arrow without copying, cut into chunks of bounded bytes (a longer text is a
chunk of its own), and all its words are found and hashed at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
# White space is blank, \t, \n, \v, \f, \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# what separates words that are compared without their punctuation
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
# An odd base with its inverse modulo 2^64, and the mixer's constants.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class _Tables(dict):
    """A cache that travels empty: functions are sent to the workers by value."""

    def __reduce__(self):
        return _Tables, ()


_powers: dict[int, np.ndarray] = _Tables()


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept by the worker for the next chunk."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, np.uint64(base))
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


@dataclass
class Chunk:
    """Consecutive texts: ``buf[offs[i]:offs[i+1]]`` is text ``row + i``."""

    row: int
    buf: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def prefix(self, lower: bool = False) -> np.ndarray:
        """Prefix sums of the polynomial hash; ``prefix[b] - prefix[a]`` belongs to
        bytes a to b."""
        out = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        data = LOWER[self.buf] if lower else self.buf
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
        return out

    def span_hash(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans [a, b)."""
        if not len(self.buf):
            return np.zeros(len(a), dtype=np.uint64)
        shift = powers(INVERSE, len(self.buf) + 1)
        return mix64((prefix[b] - prefix[a]) * shift[a] + (b - a).astype(np.uint64))

    def words(self, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of every word, and for each text the number of its first
        word (one more at the end). No word crosses texts."""
        solid = ~breaks[self.buf]
        n = len(solid)
        edge = self.offs[(self.offs > 0) & (self.offs < n)]
        before = np.zeros(n, dtype=bool)
        before[1:] = solid[:-1]
        before[edge] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = solid[1:]
        after[edge - 1] = False
        ends = np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`words`, for lines split at \\n; an empty text is one empty line."""
        breaks = np.flatnonzero(self.buf == 10)
        # a line begins at each text and after each break
        begin = np.concatenate([self.offs[:-1], breaks + 1])
        end = np.concatenate([breaks, self.offs[1:]])
        owner = np.concatenate([np.arange(len(self)), np.searchsorted(self.offs, breaks, "right") - 1])
        order = np.lexsort((begin, owner))
        begin, owner = begin[order], owner[order]
        owner_end = np.concatenate([np.searchsorted(self.offs, breaks, "right") - 1, np.arange(len(self))])
        end = end[np.lexsort((end, owner_end))]
        return begin, end, np.searchsorted(owner, np.arange(len(self) + 1))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column in chunks of at most ``limit`` bytes; NULL is an
    empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield Chunk(i, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j
    # a worker serves many tasks: what batches before this one took goes back
    pa.default_memory_pool().release_unused()


def per_text(values: np.ndarray, first: np.ndarray, at: np.ufunc = np.add) -> np.ndarray:
    """``at``-reduction of word values per text; 0 for texts without words."""
    out = np.zeros(len(first) - 1, dtype=values.dtype)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = at.reduceat(values, first[:-1][full])
    return out
