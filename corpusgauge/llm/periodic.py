"""Runs of words that repeat with a period: seeds on diagonals, extended once.

A run is a stretch in which every word equals the one ``q`` words on, ``q`` its
smallest period, at least ``least`` words and ``times`` periods long, and as long as
it can be. Such a run holds two copies of every gram that fits its guaranteed overlap,
``q`` words apart. Grams double in size from level to level, and a level of grams of
``k`` words answers for periods of up to ``k`` words: the overlap of those runs is
never shorter than ``k``, and as no period exceeds the gram, two *successive*
occurrences of one gram are never further apart than the period. So each level needs
only the pairs of successive occurrences in one text, fewer than there are words, and
a gram that occurs a million times gives a million pairs, not their square.

A pair at places ``i`` and ``i + q`` is a seed on diagonal ``q``. Seeds of a diagonal
are taken in order with the furthest place already covered there: a seed before it
belongs to a known extension and is skipped, so a stretch is extended once however
many seeds it holds, and it ends where the next seed is missing.

Grams are ranked, not hashed: equal ranks are equal words. Places whose gram occurs
once are given up at every doubling, which leaves ordinary prose with nothing to do
after a few words. Each text is worked on alone; no row meets another, nothing is
shuffled, and a long text needs memory in proportion to its words.

Defined results: a NULL or empty text has no runs and collapses to an empty text;
repeated rows and NULL keys are rows like others; runs may overlap, and all are
returned; a word is dropped if any run holds it behind its first period. Further
columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import string_or_empty, word_array
from .textbytes import Chunk, chunks

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def first_gram(least: int, times: int) -> int:
    """The overlap that every run guarantees: ``least - q`` words while ``times * q``
    is below ``least``, ``(times - 1) * q`` beyond."""
    return max(1, min(max(least, times * q) - q for q in range(1, least + 1)))


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and ranks of those."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    often = np.bincount(group) > 1
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = (np.cumsum(often) - 1)[group]
    alive = np.empty(len(keys), dtype=bool)
    alive[order] = often[group]
    return alive, rank[alive]


def _join(place: np.ndarray, rank: np.ndarray, more: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams longer by ``more`` words: equal if both ends' shorter grams are."""
    n = len(owner)
    full = np.full(n, -1, dtype=np.int64)
    full[place] = rank
    ok = place + more < n
    place, rank = place[ok], rank[ok]
    ok = (full[place + more] >= 0) & (owner[place + more] == owner[place])
    place, rank = place[ok], rank[ok]
    if not len(place):
        return place, rank
    alive, new = _dense(rank * (int(full.max()) + 1) + full[place + more])
    return place[alive], new


def runs_of(ids: np.ndarray, owner: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of all runs; ``ids`` are the words of consecutive
    texts as numbers and ``owner`` the text of each."""
    empty = np.zeros((0, 3), dtype=np.int64)
    if len(ids) < least:
        return empty
    base = first_gram(least, times)
    alive, rank = _dense(owner.astype(np.int64) * (int(ids.max()) + 1) + ids)
    place, size, found = np.flatnonzero(alive), 1, []
    while size < base and len(place):  # doubled up to the first gram, the last step being shorter
        more = min(size, base - size)
        place, rank = _join(place, rank, more, owner)
        size += more
    low = 0
    while len(place):
        order = np.argsort(rank, kind="stable")  # places rise within a gram
        at, same = place[order], rank[order][1:] == rank[order][:-1]
        lag = at[1:] - at[:-1]
        seed = same & (lag > low) & (lag <= size)
        i, q = at[:-1][seed], lag[seed]
        order = np.lexsort((i, q))
        i, q = i[order], q[order]
        if len(i):
            # a seed next to the one before lies in what that one's extension covers
            fresh = np.ones(len(i), dtype=bool)
            fresh[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1] + 1)
            begin = np.flatnonzero(fresh)
            last = np.concatenate([begin[1:], [len(i)]]) - 1
            length = i[last] + size - i[begin] + q[begin]
            enough = length >= np.maximum(least, times * q[begin])
            found.append(np.column_stack([i[begin], length, q[begin]])[enough])
        # the next level answers for longer periods, whose overlap holds the longer gram
        low, more = size, size
        place, rank = _join(place, rank, more, owner)
        size += more
    return np.concatenate(found) if found else empty


def _words(c: Chunk) -> list[list[bytes]]:
    data = c.buf.tobytes()
    return [data[a:b].split() for a, b in zip(c.offs[:-1].tolist(), c.offs[1:].tolist())]


def _chunk_runs(c: Chunk, least: int, times: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Runs, and the text without repeated periods, of each text of the chunk."""
    texts = _words(c)
    size = np.array([len(t) for t in texts])
    # a word gets the next number when it is first met
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    first = np.concatenate([[0], np.cumsum(size)])
    runs = runs_of(ids, owner, least, times)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    cut = np.searchsorted(runs[:, 0], first)
    for t, words in enumerate(texts):
        mine = runs[cut[t] : cut[t + 1]] - [first[t], 0, 0]
        if len(mine):
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
            np.add.at(edge, mine[:, 0] + mine[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        yield mine, b" ".join(words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """key, ``runs`` (start, length, period; by start, then period) and ``collapsed``,
    the words outside all repeated periods, one blank between."""
    if times < 3 or least < times:
        raise ValueError("runs hold three periods or more: with fewer, the overlap is shorter than the gram of its level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                sizes, places, left = [], [], []
                for mine, collapsed in _chunk_runs(c, least, times):
                    sizes.append(len(mine))
                    places.append(mine)
                    left.append(collapsed)
                flat = np.concatenate(places)
                runs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.row, len(c)), pa.ListArray.from_arrays(at, runs), pa.array(left, pa.binary()).cast(pa.string())],
                    ["k", "runs", "collapsed"],
                )

    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    base = docs.select(F.col(f"`{key}`"), string_or_empty(docs, text).alias("text"))
    return base.mapInArrow(run, f"`{key}` {kind}, runs {RUN}, collapsed string")


def looped_text(key: str, text: str) -> Column:
    """The text as the registered query reads it: where the checksum of the key is a
    multiple of ten, the words behind a place are overwritten by the first of them,
    again and again. Other texts, those of NULL keys included, stay."""
    words, checksum = word_array(F.col(text)), F.crc32(F.col(key).cast("string"))
    # one struct, so that the words are cut once
    facts = F.struct(words.alias("w"), F.greatest(F.size(words), F.lit(1)).alias("n"), F.floor(checksum / 10).alias("g"))

    def loop(x: Column) -> Column:
        a = (x["g"] % x["n"]).cast("int")
        p = (F.floor((x["n"] - a) / (F.lit(3) + x["g"] % 8)) + 1).cast("int")

        def at(y: Column) -> Column:
            word = lambda i: F.get(y["w"], F.when(i < y["a"], i).otherwise(y["a"] + (i - y["a"]) % y["p"]))
            return F.array_join(F.transform(F.sequence(F.lit(0), y["n"] - 1), word), " ")

        return F.transform(F.array(F.struct(x["w"].alias("w"), x["n"].alias("n"), a.alias("a"), p.alias("p"))), at)[0]

    return F.when(checksum % 10 == 0, F.transform(F.array(facts), loop)[0]).otherwise(F.col(text))
