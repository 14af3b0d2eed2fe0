"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. Every other mention of digits or of an address-like
token is a node whose label the field decides: node potentials come from the mention's
shape and the word before it, chain potentials join neighbouring mentions, and skip
potentials join distant mentions of one document that repeat each other (equal key: the
digits, or the folded address) or look alike (equal shape). All three kinds of edge link
consecutive nodes only, so a document of n mentions has fewer than 3n edges however often
one token repeats. Loopy message passing, over all documents of a batch at once, makes
the labels of such mentions agree across the whole document.

The potentials are trained here, piecewise, by expectation-maximisation over all mentions
of the corpus. Base spans are labelled. A mention that no pattern matches and that
repeats none of them is an example of nothing personal. One that repeats a base span in
another form is what the field is there to find: its label is hidden, is inferred by
messages under the potentials so far, and enters the counts as the probabilities found.
Partitions count, Spark adds, and the counts have a bounded number of cells.

Defined results: a NULL or empty text has no spans; repeated rows get equal
results; offsets are code points, end exclusive. Further columns of the input are
left out. Texts are read whole, and patterns run in linear time on any text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

# The kinds, in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: nothing personal
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"\(?[0-9](?:[0-9().\x20/-]*[0-9])?")
ADDRESS = re.compile(r"(?:@|[\x20]?[\[(](?:at|AT)[\])][\x20]?)")
DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\W\d_]+")
#: (name, number of values) of the shape of a mention.
SHAPE = (("digits", 24), ("dots", 6), ("groups", 8), ("address", 2), ("longest", 24))
#: what is known of a mention beside its shape: the word before it, hashed
FEATURES = (*SHAPE, ("before", 256))
ITERATIONS = 12
ROUNDS = 6  # of expectation and maximisation


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns; kinds count from 1."""
    out = [(1, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((2, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((3, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.sub("", m.group())) <= 15:
                out.append((4, m.start(), m.end()))
    return out


def _key(value: str) -> int:
    """What repeated mentions share: folded letters and digits."""
    folded = re.sub(r"[^a-z0-9@]+", "", re.sub(r"[\x20]?[\[(]at[\])][\x20]?", "@", value.lower()))
    return int.from_bytes(hashlib.blake2b(folded.encode(), digest_size=8).digest(), "little", signed=True)


def _shape(value: str) -> list[int]:
    groups = [g for g in DIGIT.split(value) if g]
    raw = [sum(map(len, groups)), value.count("."), len(groups), int(bool(ADDRESS.search(value))), max(map(len, groups), default=0)]
    return [min(v, n - 1) for v, (_, n) in zip(raw, SHAPE)]


def _before(text: str, at: int) -> int:
    """The word before a mention, as a number from 1; 0 if there is none near by."""
    words = WORD.findall(text[max(0, at - 24) : at])
    return zlib.crc32(words[-1].lower().encode()) % (FEATURES[-1][1] - 1) + 1 if words else 0


def mentions(text: str) -> list[tuple]:
    """(label, start, end, key, shape...) of the base spans and of every other
    candidate, in text order."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in taken], dtype=np.int64)) if taken else starts

    def free(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, b, "left")) - 1
        return i < 0 or reach[i] <= a

    rest = [(0, m.start(), m.end()) for m in NUMBER.finditer(text) if free(m.start(), m.end())]
    for m in ADDRESS.finditer(text):
        a, b = m.start(), m.end()
        low = a
        while low > 0 and text[low - 1] in LOCAL:
            low -= 1
        d = re.compile(r"[A-Za-z0-9.-]+").match(text, b)
        if low < a and d and free(low, d.end()):
            rest.append((0, low, d.end()))
    out = []
    for label, a, b in sorted(base + rest, key=lambda x: (x[1], x[2], x[0])):
        out.append((label, a, b, _key(text[a:b]), *_shape(text[a:b]), _before(text, a)))
    return out


FIELDS = ["label", "start", "end", "key", *[n for n, _ in FEATURES]]
MENTION = pa.struct([(n, pa.int64()) for n in FIELDS])


def find_mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``mentions`` of every document: the one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            some = pc.match_substring_regex(texts, r"[0-9@]|[\[(](at|AT)[\])]").to_numpy(zero_copy_only=False)
            found: list[list[tuple]] = [[] for _ in range(b.num_rows)]
            for i in np.flatnonzero(some).tolist():
                found[i] = mentions(texts[i].as_py())
            flat = np.array([m for f in found for m in f], dtype=np.int64).reshape(-1, len(FIELDS))
            at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(len(FIELDS))], FIELDS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), values)], ["k", "m"])

    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    fields = ", ".join(f"{n}: bigint" for n in FIELDS)
    narrow = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    return narrow.mapInArrow(run, f"`{key}` {kind}, mentions array<struct<{fields}>>")


def _edges(owner: np.ndarray, key: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between consecutive nodes of one document with equal key (type 0), where
    keys differ with equal shape (type 1), or with nothing between them (type 2). Nodes
    are in text order."""
    left, right, kind = [], [], []
    for t, value in enumerate((key, shape, np.zeros(len(owner), dtype=np.int64))):
        order = np.lexsort((np.arange(len(owner)), value, owner))
        a, b = order[:-1], order[1:]
        same = (owner[a] == owner[b]) & (value[a] == value[b])
        if t:
            same &= key[a] != key[b]
        if t == 2:
            same &= shape[a] != shape[b]
        left.append(a[same])
        right.append(b[same])
        kind.append(np.full(int(same.sum()), t))
    return np.concatenate(left), np.concatenate(right), np.concatenate(kind)


def _hidden(owner: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Unlabelled mentions that repeat a labelled one of their document."""
    order = np.lexsort((x[:, 3], owner))
    new = np.ones(len(x), dtype=bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (x[order, 3][1:] != x[order, 3][:-1])
    group = np.empty(len(x), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    known = np.bincount(group, weights=x[:, 0] > 0) > 0
    return (x[:, 0] == 0) & known[group]


def _nodes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owner row and fields of all mentions of a batch."""
    flat = column.flatten()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), sizes.astype(np.int64))
    fields = [flat.field(i).to_numpy() for i in range(len(FIELDS))]
    return owner, np.column_stack(fields) if len(flat) else np.zeros((0, len(FIELDS)), dtype=np.int64)


def _shape_number(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    for i, (_, n) in enumerate(SHAPE):
        out = out * n + x[:, 4 + i]
    return out


@dataclass
class Field:
    """Log potentials: one table per feature, priors, one number per type of skip edge
    and a table of neighbouring labels (left, right)."""

    prior: np.ndarray
    shape: list[np.ndarray]
    skip: np.ndarray
    chain: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))

    def decide(self, owner: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Probabilities of the labels, by loopy message passing."""
        unary = np.tile(self.prior, (len(x), 1))
        for i, table in enumerate(self.shape):
            unary += table[x[:, 4 + i]]
        unary = np.clip(unary - unary.max(1, keepdims=True), -6.0, 0.0)
        known = x[:, 0] > 0
        unary[known] = -20.0
        unary[np.flatnonzero(known), x[known, 0]] = 0.0
        a, b, kind = _edges(owner, x[:, 3], _shape_number(x))
        if len(a):
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            back = np.concatenate([np.arange(len(a), 2 * len(a)), np.arange(len(a))])
            # the same label gains on skip edges; neighbours have a table, seen from either side
            equal = [np.exp(np.diag(np.full(LABELS, s))) for s in self.skip[:2]]
            sets = [(np.flatnonzero(np.concatenate([kind, kind]) == t), equal[t]) for t in (0, 1)]
            near = np.flatnonzero(kind == 2)
            sets += [(near, np.exp(self.chain)), (near + len(a), np.exp(self.chain.T))]
            m = np.zeros((len(src), LABELS))
            for _ in range(ITERATIONS):
                belief = unary.copy()
                np.add.at(belief, dst, m)
                out = belief[src] - m[back]
                p = np.exp(out - out.max(1, keepdims=True))
                new = np.zeros_like(m)
                for at, table in sets:
                    new[at] = np.log(p[at] @ table)
                m = 0.5 * m + 0.5 * (new - new.max(1, keepdims=True))
            np.add.at(unary, dst, m)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


# cells of the counts: features, agreement by edge type, neighbouring labels
AGREE, CHAIN = len(FEATURES), len(FEATURES) + 1


def _counted(found: DataFrame, now: Field | None) -> np.ndarray:
    """Expected counts (cell, value, label, n) over all mentions. Hidden labels have
    the probabilities of the field ``now``; before the first, they are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((n, LABELS)) for _, n in FEATURES]
        agree, chain = np.zeros((3, 2)), np.zeros((LABELS, LABELS))
        for batch in batches:
            owner, x = _nodes(batch.column(0))
            if not len(x):
                continue
            hidden = _hidden(owner, x)
            q = np.zeros((len(x), LABELS))
            q[np.arange(len(x)), x[:, 0]] = 1.0
            q[hidden] = now.decide(owner, x)[hidden] if now is not None else 0.0
            for i, table in enumerate(tables):
                np.add.at(table, x[:, 4 + i], q)
            a, b, kind = _edges(owner, x[:, 3], _shape_number(x))
            named = (x[a, 0] > 0) | (x[b, 0] > 0)
            same = (q[a] * q[b]).sum(1)
            both = q[a].sum(1) * q[b].sum(1)
            for t in (0, 1):
                at = named & (kind == t)
                agree[t] += [(both - same)[at].sum(), same[at].sum()]
            near = kind == 2
            chain += q[a[near]].T @ q[b[near]]
        for what, table in [*enumerate(tables), (AGREE, agree), (CHAIN, chain)]:
            value, label = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(value), what)), pa.array(value), pa.array(label), pa.array(table[value, label])],
                ["what", "value", "label", "n"],
            )

    counts = found.select("mentions").mapInArrow(run, "what long, value long, label long, n double")
    counts = counts.groupBy("what", "value", "label").agg(F.sum("n").alias("n"))
    return counts.toPandas().to_numpy(dtype=float)  # at most a few thousand cells


def _potentials(counts: np.ndarray) -> Field:
    tables = [np.full((n, LABELS), 0.5) for _, n in FEATURES]
    # repeats of one key are expected to agree; likeness of shape has to show it
    agree = np.array([[1.0, 4.0], [1.0, 1.0], [1.0, 1.0]])
    chain = np.full((LABELS, LABELS), 0.5)
    cells = [*tables, agree, chain]
    for what, value, label, n in counts:
        cells[int(what)][int(value), int(label)] += n
    seen = tables[0].sum(0)
    prior = np.log(seen / seen.sum())
    # features overlap: each speaks with half its weight, neighbours likewise
    shape = [0.5 * np.log(t / t.sum(0)) for t in tables]
    skip = np.clip(np.log(agree[:2, 1] / agree[:2, 0]), 0.0, 6.0)
    expected = chain.sum(1, keepdims=True) * chain.sum(0, keepdims=True) / chain.sum()
    return Field(prior, shape, skip, np.clip(0.5 * np.log(chain / expected), -2.0, 2.0))


def train(found: DataFrame, rounds: int = ROUNDS) -> Field:
    """Potentials from all mentions: counts of what is labelled, then rounds in which
    hidden labels are inferred and counted as their probabilities."""
    now = _potentials(_counted(found, None))
    for _ in range(rounds):
        now = _potentials(_counted(found, now))
    return now


def label_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.95
) -> DataFrame:
    """key, ``base`` and ``added``: arrays of (kind, start, end). A span is added when
    the field gives its label at least the probability ``least``."""
    found = stored(find_mentions(docs, key, text), "pii-mentions")
    trained = train(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            owner, x = _nodes(b.column(1))
            base: list[list] = [[] for _ in range(b.num_rows)]
            more: list[list] = [[] for _ in range(b.num_rows)]
            if len(x):
                p = trained.decide(owner, x)
                best = p[:, 1:].argmax(1) + 1
                sure = p[np.arange(len(x)), best] >= least
                for i in np.flatnonzero((x[:, 0] > 0) | sure).tolist():
                    label = int(x[i, 0] or best[i])
                    (base if x[i, 0] else more)[owner[i]].append((label, int(x[i, 1]), int(x[i, 2])))
            form = lambda rows: pa.array(
                [[{"kind": KINDS[k - 1], "start": a, "end": e} for k, a, e in sorted(r)] for r in rows], pa.list_(span)
            )
            yield pa.RecordBatch.from_arrays([b.column(0), form(base), form(more)], ["k", "base", "added"])

    kind = found.schema[0].dataType.simpleString()
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return found.mapInArrow(run, f"`{key}` {kind}, base {spans}, added {spans}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by the name of its kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
