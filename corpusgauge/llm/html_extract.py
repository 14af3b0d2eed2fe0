"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is its sequence of leaf blocks, each with features of its ancestor tags, of the
words in their attributes, of its own text and of the last heading before it. The field
scores "main text" against "the rest" for every block and for every step from block to
block; training maximises the likelihood of labelled pages by L-BFGS, the tasks summing
likelihood and gradient of their pages (forward and backward messages over all pages of
a batch at once) and Spark adding the sums; decoding is Viterbi, page by page.

Labelled pages are a table of html and main text: a block is main if it is the next of
the text's lines. :func:`labelled_pages` draws such a table from page layouts (module
``page_layouts``), ``LABELLED`` pages by default, which is the documented bound of the
fit; any table of the same two columns can be given instead. The fit does not look at the
pages to extract, every one of which is parsed and decoded whole, in one pass without a
shuffle.

Defined results: a NULL or empty page has an empty text; so has a page without main
blocks; repeated rows and NULL keys are rows like others; character references are
decoded, white space of a block is one blank, blocks are joined by a line break. Further
columns of the input are kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dom_blocks import Block, blocks
from .page_layouts import draw_page
from .store import stored, string_or_empty

SIZE = 1 << 14  # hashed features
LABELLED = 600
HEADING = re.compile(r">h[1-6][^>]*$")
# Elements that name the part of the page they hold.
LANDMARKS = frozenset("article aside footer form header main menu nav search".split())
# Attribute words of layout that say nothing about what is inside.
NEUTRAL = frozenset("box clear clearfix col column columns container flex grid group inner layout outer row wrap wrapper".split())
LETTERS = re.compile(r"[^\W\d_]+")


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SIZE


def path_features(path: str) -> list[str]:
    """Ancestor tags, the words of their attributes, and the innermost pair."""
    nodes = [[w for w in n.split(".") if w not in NEUTRAL] for n in path.split(">") if n]
    out = {f"in:{n[0]}" for n in nodes}
    for n in nodes:
        for w in n[1:]:
            out.add(f"word:{w}")
            if len(w) > 4:
                out.add(f"stem:{w[:4]}")
    if nodes:
        out.add(f"tag:{nodes[-1][0]}")
        out.add("pair:" + ">".join(n[0] for n in nodes[-2:]))
    # the innermost element that says what it is outweighs those around it
    for n in reversed(nodes):
        if len(n) > 1 or n[0] in LANDMARKS:
            out.update(f"near:{w}" for w in (n[1:] if len(n) > 1 else n[:1]))
            out.update(f"near stem:{w[:4]}" for w in n[1:] if len(w) > 4)
            break
    if not any(len(n) > 1 for n in nodes):
        out.add("plain:" + ">".join(n[0] for n in nodes[-3:]))
    if not {"article", "main"} & {n[0] for n in nodes}:
        out.add("outside")
    return sorted(out)


def text_features(b: Block) -> tuple[str, ...]:
    """What the text itself shows: length, links, how it ends, short words of labels."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    out = [
        f"size:{min(int(math.log2(n + 1)), 10)}",
        f"words:{min(int(math.log2(words)), 7)}",
        f"linked:{min(4 * b.linked // n, 4)}",
        f"end:{b.text[-1] if b.text[-1] in '.!?:,;' else 'x'}",
        "commas" if ", " in b.text else "no commas",
    ]
    if b.text[0] == "©":
        out.append("sign")
    if b.links > 1:
        out.append("links")
    return tuple(out)


class Numbers:
    """Feature numbers of blocks, those of a path or a label being kept."""

    def __init__(self) -> None:
        self.paths: dict[str, list[int]] = {}
        self.texts: dict[str, int] = {}

    def of_path(self, path: str) -> list[int]:
        have = self.paths.get(path)
        if have is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            have = self.paths[path] = [_number(f) for f in path_features(path)]
        return have

    def of_text(self, feature: str) -> int:
        have = self.texts.get(feature)
        if have is None:
            if len(self.texts) > 50_000:
                self.texts.clear()
            have = self.texts[feature] = _number(feature)
        return have

    def of_page(self, page: list[Block]) -> list[list[int]]:
        out, heading = [], []
        for i, b in enumerate(page):
            short = b.text.lower() if len(b.text) <= 40 else ""
            words = LETTERS.findall(short)[:4]
            found = list(self.of_path(b.path))
            found += [self.of_text(f) for f in text_features(b)]
            found += [self.of_text(f"says:{w}") for w in words]
            found += [self.of_text(f"under:{w}") for w in heading]
            if not i:
                found.append(self.of_text("first"))
            if i == len(page) - 1:
                found.append(self.of_text("last"))
            if HEADING.search(b.path):
                heading = words
            out.append(found)
        return out


def align(page: list[Block], text: str) -> list[int]:
    """Label 1 for the blocks that are, in order, the lines of the text."""
    lines, at, out = text.split("\n") if text else [], 0, []
    for b in page:
        main = at < len(lines) and b.text == lines[at]
        at += main
        out.append(int(main))
    return out


@dataclass
class Field:
    """Weights: one per feature for "main" against "rest", and one per step."""

    w: np.ndarray  # SIZE emissions, then 4 steps (rest-rest, rest-main, main-rest, main-main)

    def decode(self, scores: list[float]) -> list[bool]:
        """The best labelling of one page (Viterbi)."""
        rr, rm, mr, mm = self.w[SIZE:].tolist()
        rest = main = 0.0
        back = []
        for i, s in enumerate(scores):
            if i:
                to_rest, to_main = rest + rr >= main + mr, rest + rm >= main + mm
                rest, main = (rest + rr if to_rest else main + mr), (rest + rm if to_main else main + mm)
                back.append((to_rest, to_main))
            main += s
        out = [main > rest]
        for to_rest, to_main in reversed(back):
            out.append(not (to_main if out[-1] else to_rest))
        return out[::-1] if scores else []


def likelihood(w: np.ndarray, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Log-likelihood of labelled pages and its gradient. A page is its features, the
    number of features of each block, and the labels."""
    grad = np.zeros(SIZE + 4)
    steps = w[SIZE:].reshape(2, 2)
    n, longest = len(pages), max(len(p[2]) for p in pages)
    score = np.zeros((n, longest))
    label = np.zeros((n, longest), dtype=np.int64)
    real = np.zeros((n, longest), dtype=bool)
    for i, (features, sizes, y) in enumerate(pages):
        t = len(y)
        score[i, :t] = np.bincount(np.repeat(np.arange(t), sizes), weights=w[features], minlength=t)
        label[i, :t], real[i, :t] = y, True
    alpha = np.zeros((longest, n, 2))
    beta = np.zeros((longest, n, 2))
    emit = np.stack([np.zeros((n, longest)), score], axis=2)
    alpha[0] = emit[:, 0]
    for t in range(1, longest):
        step = np.logaddexp(alpha[t - 1][:, :1] + steps[0], alpha[t - 1][:, 1:] + steps[1]) + emit[:, t]
        alpha[t] = np.where(real[:, t, None], step, alpha[t - 1])
    for t in range(longest - 2, -1, -1):
        after = emit[:, t + 1] + beta[t + 1]
        step = np.logaddexp(steps[:, 0] + after[:, :1], steps[:, 1] + after[:, 1:])
        beta[t] = np.where(real[:, t + 1, None], step, 0.0)
    total = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    value = float((score * label).sum() - total.sum())
    p = np.exp(alpha[:, :, 1].T + beta[:, :, 1].T - total[:, None])
    for i, (features, sizes, y) in enumerate(pages):
        t = len(y)
        grad[:SIZE] += np.bincount(features, weights=np.repeat(y - p[i, :t], sizes), minlength=SIZE)
    for t in range(1, longest):
        on = real[:, t]
        if not on.any():
            break
        a, b = label[on, t - 1], label[on, t]
        pair = alpha[t - 1][on][:, :, None] + steps + (emit[on, t] + beta[t][on])[:, None, :] - total[on, None, None]
        expected = np.exp(pair).sum(axis=0).ravel()
        seen = np.bincount(2 * a + b, minlength=4)
        grad[SIZE:] += seen - expected
        value += float(steps[a, b].sum())
    return value, grad


def _labelled_blocks(pages: DataFrame) -> DataFrame:
    """Features of the blocks of labelled pages (html, main_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for b in batches:
            rows = []
            for html, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = blocks(html or "")
                if page:
                    f = numbers.of_page(page)
                    rows.append(([x for block in f for x in block], [len(block) for block in f], align(page, text or "")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in range(3)], ["f", "n", "y"]
            )

    return pages.select("html", "main_text").mapInArrow(run, "f array<int>, n array<int>, y array<int>")


def fit(pages: DataFrame, rounds: int = 30, penalty: float = 0.2, memory: int = 6) -> Field:
    """A field trained on labelled pages (html, main_text) by L-BFGS. Every evaluation
    is one job whose tasks sum over their pages; at most ``SIZE + 5`` numbers return."""
    rows = stored(_labelled_blocks(pages), "extract-labelled")

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, grad, seen = 0.0, np.zeros(SIZE + 4), False
            for b in batches:
                page = [tuple(np.array(b.column(i)[k].values) for i in range(3)) for k in range(b.num_rows)]
                for k in range(0, len(page), 256):
                    v, g = likelihood(w, page[k : k + 256])
                    value, grad, seen = value + v, grad + g, True
            if seen:
                i = np.flatnonzero(grad)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(i, SIZE + 4)), pa.array(np.append(grad[i], value))], ["i", "v"]
                )

        sums = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        full = np.zeros(SIZE + 5)
        full[sums["i"].to_numpy()] = sums["v"].to_numpy()
        # the loss: minus the likelihood, with a penalty
        return 0.5 * penalty * float(w @ w) - full[-1], penalty * w - full[:-1]

    w = np.zeros(SIZE + 4)
    loss, grad = evaluate(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction = -_inverse_hessian(grad, past)
        step = 1.0 if past else 1.0 / max(float(np.abs(grad).sum()), 1.0)
        slope = float(grad @ direction)
        while True:
            new = w + step * direction
            new_loss, new_grad = evaluate(new)
            if new_loss <= loss + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        if not loss - new_loss > 1e-5 * abs(loss):
            break
        if float((new - w) @ (new_grad - grad)) > 1e-10:
            past = [*past[-(memory - 1) :], (new - w, new_grad - grad)]
        w, loss, grad = new, new_loss, new_grad
    return Field(w)


def _inverse_hessian(grad: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the curvature seen in the last steps (two loops)."""
    q, kept = grad.copy(), []
    for s, y in reversed(past):
        a = float(s @ q) / float(s @ y)
        q -= a * y
        kept.append(a)
    if past:
        s, y = past[-1]
        q *= float(s @ y) / float(y @ y)
    for (s, y), a in zip(past, reversed(kept)):
        q += s * (a - float(y @ q) / float(s @ y))
    return q


def labelled_pages(spark: SparkSession, n: int = LABELLED, seed: int = 0) -> DataFrame:
    """``n`` labelled pages (html, main_text) drawn from page layouts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = [draw_page(i) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in drawn], pa.string()) for i in range(2)], ["html", "main_text"])

    return spark.range(seed * 1_000_003, seed * 1_000_003 + n, 1, 4).mapInArrow(run, "html string, main_text string")


def main_text(field: Field) -> Callable[[str], str]:
    """The extractor of one page, for use inside a task."""
    w, numbers = field.w, Numbers()
    values = w.tolist()

    def extract(html: str) -> str:
        page = blocks(html)
        if not page:
            return ""
        scores = [sum([values[x] for x in f]) for f in numbers.of_page(page)]
        return "\n".join(b.text for b, main in zip(page, field.decode(scores)) if main)

    return extract


def extract_text(pages: DataFrame, field: Field, html: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in column ``to``, and without ``html``."""
    kept = [c for c in pages.columns if c not in (html, to)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = main_text(field)
        for b in batches:
            texts = pa.array([extract(h) for h in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*kept, to])

    base = pages.select(*[F.col(f"`{c}`") for c in kept], string_or_empty(pages, html).alias("__html"))
    schema = base.drop("__html").schema.add(to, "string")
    return base.mapInArrow(run, schema)
