"""Near-duplicate lines by a segment-partition edit join.

Two lines are linked if at most ``edits`` byte edits apart. A line of each length is
cut into ``edits + 1`` even segments, of which one survives so few edits unchanged;
longer or equal lines probe the segment index with the few substrings whose place
the length difference allows. Candidates are verified by edit distance, bit-parallel
in the band that the threshold leaves.

The join runs in steps, so that texts move once and no family of near copies meets all
against all. First, segments and probes of all lines travel as hashes, and two semi-joins
find the lines that have a partner at all. Only those lines are fetched. Of the lines
filed under one segment, the one of least digest then stands for the segment: every line
that probes it meets that one only. Lines with links get the label of the least line they
lead to. What is left are segments that lines of several labels share: there, and only
there, lines outside the segment's most frequent label meet the lines of other labels, so
no link that could still join two components is missed, and pairs of one label, whose
links could change nothing, are never formed. A sketch of letters and of three-byte grams
drops pairs too far apart in the join itself, before they are verified. Equal lines are one line throughout: copies by the million are counted with
partial sums. The joins are ordinary ones that adaptive execution splits where a segment
is frequent.

Lines shorter than ``least`` bytes are too short for edits: they form a class with their
exact copies, by digest. Defined results: a NULL text has no lines; lines without a word
belong to no class and stay; repeated rows are copies whose later lines go; of a class
the first line by id and number stays; a document left without words goes, but one of
short lines only is left as it is. Further columns of the input are kept by
:func:`drop_lines`.
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
from .store import settled, stored, string_or_empty
from .textbytes import SPACE, Chunk, chunks, mix64


@dataclass(frozen=True)
class LineJoin:
    edits: int = 2
    least: int = 30


def segment(n: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of segment ``i`` of lines of ``n`` bytes; later ones are longer."""
    short = n // parts
    longer = n - short * parts  # this many segments at the end have a byte more
    first_long = parts - longer
    begin = i * short + np.maximum(i - first_long, 0)
    return begin, short + (i >= first_long)


def _key(h: np.ndarray, n: np.ndarray, i: int) -> np.ndarray:
    return mix64(h ^ mix64(n.astype(np.uint64) * np.uint64(64) + np.uint64(i))).view(np.int64)


def index_keys(c: Chunk, prefix: np.ndarray, begin: np.ndarray, n: np.ndarray, how: LineJoin) -> list[np.ndarray]:
    out = []
    for i in range(how.edits + 1):
        at, size = segment(n, i, how.edits + 1)
        out.append(_key(c.span_hash(prefix, begin + at, begin + at + size), n, i))
    return out


def probe_keys(c: Chunk, prefix: np.ndarray, begin: np.ndarray, n: np.ndarray, how: LineJoin) -> list[np.ndarray]:
    """Keys of the substrings that may equal a segment of a line shorter by 0 to
    ``edits`` bytes: i edits can lie before segment i, and the others after it."""
    out = []
    for less in range(how.edits + 1):
        m = n - less
        for i in range(how.edits + 1):
            at, size = segment(m, i, how.edits + 1)
            after = how.edits - i
            for shift in range(max(-i, less - after), min(i, less + after) + 1):
                # a place outside the line is no substring: its key is taken at the border
                a = np.clip(at + shift, 0, n - size)
                out.append(_key(c.span_hash(prefix, begin + a, begin + a + size), m, i))
    return out


def lines_of(c: Chunk, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number, begin and size of the lines that have a word and ``least`` bytes."""
    begin, end, first = c.lines()
    owner = np.repeat(np.arange(len(c)), np.diff(first))
    number = np.arange(len(begin)) - first[owner]
    solid = np.concatenate([[0], np.cumsum(~SPACE[c.buf])])
    keep = (end - begin >= least) & (solid[end] > solid[begin])
    return owner[keep], number[keep], begin[keep], (end - begin)[keep]


def _digests(c: Chunk, begin: np.ndarray, n: np.ndarray) -> list[bytes]:
    data = memoryview(np.ascontiguousarray(c.buf))
    return [hashlib.blake2b(data[a : a + k], digest_size=16).digest() for a, k in zip(begin.tolist(), n.tolist())]


def _head(digests: list[bytes]) -> np.ndarray:
    """First half of the digests, as numbers."""
    return np.frombuffer(b"".join(digests), dtype=np.int64)[::2]


def line_places(docs: DataFrame) -> DataFrame:
    """id, line number and digest of every line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                owner, number, begin, n = lines_of(c, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + c.row)), pa.array(number.astype(np.int32)), pa.array(_digests(c, begin, n), pa.binary())],
                    ["id", "line", "d"],
                )

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, line int, d binary")


def line_keys(docs: DataFrame, how: LineJoin, keys, names: tuple[str, str]) -> DataFrame:
    """(key, head of the digest) of the lines; copies within a chunk give one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0)):
                _, _, begin, n = lines_of(c, how.least)
                if not len(begin):
                    continue
                prefix = c.prefix()
                _, one = np.unique(c.span_hash(prefix, begin, begin + n), return_index=True)
                begin, n = begin[one], n[one]
                head = _head(_digests(c, begin, n))
                columns = keys(c, prefix, begin, n, how)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(columns)), pa.array(np.tile(head, len(columns)))], ["key", "head"]
                )

    return docs.select("text").mapInArrow(run, f"{names[0]} long, {names[1]} long")


def sketch(buf: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts of bytes in eight classes, modulo 256, packed into a number. An edit
    changes at most two of them, by one."""
    out = np.zeros(len(begin), dtype=np.uint64)
    for k in range(8):
        total = np.concatenate([[0], np.cumsum((buf % 8) == k)])
        out |= ((total[begin + n] - total[begin]) % 256).astype(np.uint64) << np.uint64(8 * k)
    return out.view(np.int64)


def gram_parities(buf: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits: which of as many classes of three bytes in a row a line holds an odd
    number of times. An edit takes away and puts in six of them at most, so that it
    changes at most six bits; lines made of the same letters by other words differ in
    many more."""
    at = np.arange(max(len(buf) - 2, 0))
    x = buf.astype(np.uint64)
    code = mix64(x[at] << np.uint64(16) | x[at + 1] << np.uint64(8) | x[at + 2]) >> np.uint64(57)
    bit = np.uint64(1) << (code & np.uint64(63))
    out = []
    for half in (0, 1):
        # parities before each place; two places differ by what lies between them
        until = np.zeros(len(at) + 1, dtype=np.uint64)
        np.bitwise_xor.accumulate(np.where(code >> np.uint64(6) == half, bit, np.uint64(0)), out=until[1:])
        last = np.maximum(begin + n - 2, begin)
        out.append((until[np.minimum(last, len(at))] ^ until[np.minimum(begin, len(at))]).view(np.int64))
    return out[0], out[1]


def _near_sql(a: str, b: str, how: LineJoin) -> str:
    """Whether two lines may be within the edits, by their sketches."""
    grams = f"bit_count({a}.t ^ {b}.t) + bit_count({a}.u ^ {b}.u) <= {6 * how.edits}"
    return f"{grams} and {_distance_sql(f'{a}.c', f'{b}.c')} <= {2 * how.edits}"


def _distance_sql(a: str, b: str) -> str:
    """Sum of the circular differences of two sketches."""
    parts = []
    for k in range(8):
        d = f"((shiftrightunsigned({a}, {8 * k}) & 255) - (shiftrightunsigned({b}, {8 * k}) & 255) + 256) % 256"
        parts.append(f"least({d}, 256 - {d})")
    return " + ".join(parts)


def within(a: bytes, b: bytes, k: int) -> bool:
    """Whether ``a`` and ``b`` are at most ``k`` edits apart: common ends are cut off,
    and the rest runs through bit vectors of the ``2k + 1`` diagonals around the main
    one. Bit ``d`` of state ``e`` says that diagonal ``d - k`` is alive with ``e``
    edits."""
    if abs(len(a) - len(b)) > k:
        return False
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    if not len(differ):
        return True
    start = int(differ[0])
    room = n - start
    back = np.flatnonzero(x[len(x) - room :][::-1] != y[len(y) - room :][::-1])
    end = int(back[0]) if len(back) else room
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    width = 2 * k + 1
    every = (1 << width) - 1
    # state[e]: diagonals (place in b minus place in a) reached with e edits, before a[i]
    state = [0] * (k + 1)
    state[0] = 1 << k
    for e in range(1, k + 1):
        state[e] = (state[e - 1] | state[e - 1] << 1) & every  # bytes of b inserted
    for i in range(len(a)):
        # diagonals on which a[i] equals its byte of b
        equal = 0
        for d in range(width):
            j = i + d - k
            if 0 <= j < len(b) and b[j] == a[i]:
                equal |= 1 << d
        old, before = state[0], 0
        state[0] = old & equal
        for e in range(1, k + 1):
            before, old = old, state[e]
            # match; substitution; byte of a deleted; byte of b inserted
            state[e] = (old & equal | before | before >> 1 | state[e - 1] << 1) & every
        if not state[k]:
            return False
    goal = len(b) - len(a) + k
    return bool(state[k] >> goal & 1)


def _fetch(how: LineJoin):
    """The wanted lines of a text: digest and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(0), batch.column(1).to_pylist()
            digests, out = [], []
            for i, lines in enumerate(wanted):
                parts = texts[i].as_buffer().to_pybytes().split(b"\n")
                for w in lines:
                    digests.append(w["d"])
                    out.append(parts[w["line"]])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(out, pa.binary())], ["d", "bytes"])

    return run


def _verify(how: LineJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within(x, y, how.edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _keys_of_lines(how: LineJoin, keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1).cast(pa.binary()).view(pa.string())):
                n = np.diff(c.offs)
                begin = c.offs[:-1]
                columns = keys(c, c.prefix(), begin, n, how)
                take = pa.array(np.tile(np.arange(len(c)) + c.row, len(columns)))
                own = [sketch(c.buf, begin, n), *gram_parities(c.buf, begin, n)]
                sketches = pa.StructArray.from_arrays([pa.array(np.tile(x, len(columns))) for x in own], ["c", "t", "u"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(columns)), batch.column(0).take(take), sketches], ["key", "d", "sketch"]
                )

    return run


KEYED = "key long, d binary, sketch struct<c:bigint,t:bigint,u:bigint>"


def line_links(base: DataFrame, lines: DataFrame, how: LineJoin) -> DataFrame:
    """Links (a, b) between digests of different lines, enough of them to join all lines
    that a chain of links joins. ``lines`` has one row per distinct line: d and its first
    place."""
    index = line_keys(base, how, index_keys, ("key", "head"))
    probe = line_keys(base, how, probe_keys, ("probe_key", "probe_head"))
    # no column is renamed between map and join: both joins then read one exchange per side
    met = (F.col("key") == F.col("probe_key")) & (F.col("head") != F.col("probe_head"))
    probed, probing = index.join(probe, met, "left_semi"), probe.join(index, met, "left_semi")
    heads = probed.select("head").union(probing.select("probe_head")).distinct()
    heads = stored(heads, "line-heads")
    wanted = lines.join(heads, "head", "left_semi").groupBy("first.id").agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "d")).alias("wanted"))
    texts = base.join(wanted.withColumnRenamed("id", "__id"), F.col("id").eqNullSafe(F.col("__id")))
    found = texts.select("text", "wanted").mapInArrow(_fetch(how), "d binary, bytes binary")
    found = stored(found.dropDuplicates(["d"]), "line-bytes")
    filed = found.mapInArrow(_keys_of_lines(how, index_keys), KEYED).withColumn("probe", F.lit(False))
    asked = found.mapInArrow(_keys_of_lines(how, probe_keys), KEYED).withColumn("probe", F.lit(True))
    keyed = stored(filed.unionAll(asked), "line-segments")
    first = verified(represented_pairs(keyed, how), found, how)
    second = verified(crossing_pairs(keyed, near_labels(first), how), found, how)
    return first.unionAll(second)


def near_labels(links: DataFrame) -> DataFrame:
    """(d, label) of linked lines: the least line a link away, or two. Lines of one label
    are joined by links, which is all that the next step relies on; that lines of one
    component may keep several labels costs pairs, not results."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("d"), F.least("a", "m").alias("label"))
    one = stored(one, "line-labels")
    two = one.select(F.col("d").alias("__d"), F.col("label").alias("further"))
    return one.join(two, F.col("label") == F.col("__d"), "left").select("d", F.coalesce("further", "label").alias("label"))


def represented_pairs(keyed: DataFrame, how: LineJoin) -> DataFrame:
    """Every probing line with the line of least digest filed under the segment."""
    least = keyed.filter("not probe").groupBy("key").agg(F.min(F.struct("d", "sketch")).alias("r"))
    least = least.select("key", F.col("r.d").alias("a"), F.col("r.sketch").alias("sa"))
    asked = keyed.filter("probe").toDF("key", "b", "sb", "probe").drop("probe")
    near = F.expr(f"a <> b and {_near_sql('sa', 'sb', how)}")
    return _ordered(asked.join(least, "key").filter(near))


def crossing_pairs(keyed: DataFrame, labels: DataFrame, how: LineJoin) -> DataFrame:
    """Pairs of lines that share a segment and have different labels."""
    of = labels.withColumnRenamed("d", "__d")
    placed = keyed.join(of, F.col("d") == F.col("__d"), "left")
    placed = placed.select("key", "d", "sketch", "probe", F.coalesce("label", "d").alias("c"))
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max_by("c", "n").alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    several = placed.join(main, "key").select("key", "d", "sketch", "probe", "c", (F.col("c") != F.col("main")).alias("other"))
    several = stored(several, "line-crossing")
    filed = several.filter("not probe").select("key", F.col("d").alias("a"), F.col("sketch").alias("sa"), F.col("c").alias("ca"), F.col("other").alias("oa"))
    asked = several.filter("probe").select("key", F.col("d").alias("b"), F.col("sketch").alias("sb"), F.col("c").alias("cb"), F.col("other").alias("ob"))
    near = F.expr(f"ca <> cb and {_near_sql('sa', 'sb', how)}")
    pairs = [
        filed.filter("oa").join(asked, "key").filter(near),
        filed.filter("not oa").join(asked.filter("ob"), "key").filter(near),
    ]
    return _ordered(pairs[0].select("a", "b").unionAll(pairs[1].select("a", "b")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, found: DataFrame, how: LineJoin) -> DataFrame:
    """The pairs that are within the edits."""
    both = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return stored(both.mapInArrow(_verify(how), "a binary, b binary"), "line-links")


def line_classes(docs: DataFrame, how: LineJoin | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line with a word: key, ``line`` (from 0), ``class_id`` and
    ``class_line`` (place of the first line of its class), and ``kept``."""
    how = how or LineJoin()
    base = docs.select(F.col(f"`{key}`").alias("id"), string_or_empty(docs, text).alias("text"))
    places = stored(line_places(base), "line-places")
    lines = places.groupBy("d").agg(F.min(F.struct("id", "line")).alias("first"))
    # the first eight bytes of the digest, as the number that the keys carry
    swapped = F.expr("concat_ws('', transform(sequence(8, 1, -1), i -> hex(substring(d, i, 1))))")
    lines = stored(lines.withColumn("head", _signed(swapped)), "lines")
    links = line_links(base, lines, how)
    found = components(links).select(F.col("id").alias("d"), "component")
    linked = lines.join(found, "d").select("d", "component", "first")
    # the root of a component is linked to no lesser line
    roots = found.select(F.col("component").alias("d")).distinct().join(lines, "d").select("d", F.col("d").alias("component"), "first")
    linked = stored(linked.unionAll(roots), "lines-linked")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    moved = linked.join(heads, "component").select("d", "head")
    named = lines.drop("head").join(moved, "d", "left").select("d", F.coalesce("head", "first").alias("first"))
    out = places.join(named, "d")
    return out.select(
        F.col("id").alias(key),
        "line",
        F.col("first.id").alias("class_id"),
        F.col("first.line").alias("class_line"),
        F.struct("id", "line").eqNullSafe(F.struct(F.col("first.id"), F.col("first.line"))).alias("kept"),
    )


def _signed(hexadecimal):
    """Sixteen hexadecimal digits as a signed 64-bit number."""
    high = F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(hexadecimal, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def drop_lines(docs: DataFrame, how: LineJoin | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the later lines of each class, and without documents that have
    no word left; ``n_chars`` follows the text. Documents of short lines only stay."""
    least = (how or LineJoin()).least

    def build() -> DataFrame:
        later = line_classes(docs, how, key, text).filter("not kept").withColumnRenamed(key, "__key")
        return later.groupBy("__key").agg(F.collect_set("line").alias("__gone"))

    gone = settled(docs.sparkSession, build, "lines-gone")
    both = docs.join(gone, docs[f"`{key}`"].eqNullSafe(F.col("__key")), "left").drop("__key")
    has_long = F.expr(f"exists(split(`{text}`, '\\n', -1), l -> octet_length(l) >= {least})")
    both = both.withColumn("__gone", F.when(F.col("__gone").isNotNull() & has_long, F.col("__gone")))
    # numbers of the lines that stay, then their texts
    kept = F.expr(
        f"""array_join(transform(array_except(sequence(0, size(split(`{text}`, '\\n', -1)) - 1), __gone),
                                 i -> get(split(`{text}`, '\\n', -1), i)), '\\n')"""
    )
    out = both.withColumn("__kept", F.when(F.col("__gone").isNull(), F.col(f"`{text}`")).otherwise(kept))
    out = out.filter("__gone is null or __kept rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("__kept").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("__gone").isNull(), F.col(c)).otherwise(F.length("__kept")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)
