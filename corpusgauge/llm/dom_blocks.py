"""Leaf blocks of a web page: the text between block-level tags, with its ancestors.

A forgiving reader of HTML for use inside Spark tasks: one pass over the tags keeps the
stack of open block elements, closes what HTML closes by itself (a paragraph before the
next block, a list item before the next item), drops comments, scripts, styles and other
text that is never shown, and decodes character references. Inline elements are not on
the stack; of them only links are noted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# a comment, a declaration, a tag with quoted attributes, or one whose quotes never close
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+|[^>]*+)>", re.S
)
CUT = re.compile(r"<[!?/A-Za-z]")
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|itemprop|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Block elements of HTML, elements whose content is not page text, and
# elements without content.
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre
    search section select summary table tbody td tfoot th thead tr ul""".split()
)
HIDDEN = frozenset("script style noscript template textarea title iframe noframes noembed object svg math head xmp canvas audio video".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An element that begins ends open ones of these, up to the element named last.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
}


@dataclass(slots=True)
class Block:
    text: str
    within: tuple | None = field(compare=False, repr=False)  # innermost open element: what holds it, and its own part of the path
    linked: int  # characters inside links
    links: int

    @property
    def path(self) -> str:
        """Open elements, outermost first, each with the words of its attributes."""
        parts, node = [], self.within
        while node:
            node, part = node
            parts.append(part)
        return "".join(reversed(parts))


def attribute_words(attributes: str) -> str:
    """The words of class, id and role, and a mark for elements that are not shown."""
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        name = m.group(1).lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append("hidden")
        elif name == "hidden":
            out.append("hidden")
        else:
            out += [w.lower() for w in WORD.findall(value) if len(w) > 1]
    return ".".join(sorted(set(out)))


def blocks(html: str) -> list[Block]:
    """The leaf blocks in page order; white space of each is one blank, ends trimmed."""
    out: list[Block] = []
    tags: list[str] = []
    paths: list[tuple | None] = [None]  # shared by the blocks: deep pages have no path of their own each
    parts: list[str] = []
    linked = links = depth = 0
    at, n, end_tags = 0, len(html), {}

    def flush() -> None:
        nonlocal parts, linked, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, paths[-1], linked, links))
            parts, linked, links = [], 0, 0

    def text_until(end: int) -> None:
        nonlocal linked
        if end > at:
            piece = html[at:end]
            if "&" in piece:
                piece = unescape(piece)
            parts.append(piece)
            if depth:
                linked += len(piece)

    last = html.rfind(">") + 1  # no tag ends behind it
    while at < n:
        m = TAG.search(html, at, last) if at < last else None
        if m is None:
            # a tag cut off by the end of the page is no text
            cut = CUT.search(html, at)
            text_until(cut.start() if cut else n)
            break
        name = m.group(2)
        text_until(m.start())
        at = m.end()
        if name is None:
            if m.group(0).startswith("<!--") and not m.group(0).endswith("-->"):
                break  # a comment that never ends
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                depth = 0
            elif name in BLOCKS:
                flush()
                depth = 0
                if name in tags:
                    while tags.pop() != name:
                        paths.pop()
                    paths.pop()
            continue
        if name in HIDDEN:
            if name == "head":
                continue  # a page may leave its end out: what it holds is hidden by itself
            if not m.group(0).endswith("/>"):
                end = end_tags.get(name) or end_tags.setdefault(name, re.compile(rf"</{name}(?=[\s/>])[^>]*>|</{name}>", re.I))
                close = end.search(html, at)
                at = close.end() if close else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            depth, links = 1, links + 1
            continue
        if name not in BLOCKS:
            continue
        flush()
        depth = 0
        if tags and tags[-1] == "p":
            tags.pop()
            paths.pop()
        if name in ENDS:
            ended, limit = ENDS[name]
            k = len(tags)
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] in limit:
                    break
                if tags[i] in ended:
                    k = i
            del tags[k:], paths[k + 1 :]
        elif name[0] == "h" and name[1:].isdigit() and tags and tags[-1][0] == "h" and tags[-1][1:].isdigit():
            tags.pop()
            paths.pop()
        if name not in EMPTY:
            words = attribute_words(m.group(3)) if m.group(3) else ""
            tags.append(name)
            paths.append((paths[-1], f">{name}.{words}" if words else f">{name}"))
    flush()
    return out
