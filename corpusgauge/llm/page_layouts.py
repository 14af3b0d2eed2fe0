"""Labelled pages for the extractor: random layouts with a known main text.

Each page is drawn from its number alone. A layout chooses how the article is wrapped
(with or without semantic elements), which menus, notices, adverts, sidebars, forms,
comments and footers stand around and inside it, and how careless its markup is. The
words are invented; some articles are junk, lists or a single line, so that the field
learns structure rather than style.
"""

from __future__ import annotations

import random
from html import escape

# Words that pages use in classes and ids, by what they mark.
MAIN = "content post entry article story text body main page single post-content entry-content article-body story-body page-content prose".split()
PARTS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu nav-links pagination pager tabs toc skip".split(),
    "header": "header site-header masthead top banner branding page-header topbar logo tagline".split(),
    "footer": "footer site-footer bottom copyright legal colophon footer-links credits".split(),
    "sidebar": "sidebar side aside widget related related-posts rail secondary recommended popular trending more-stories teaser tags".split(),
    "notice": "notice cookie cookie-banner consent alert message popup modal newsletter subscribe gdpr privacy announcement toast promo-bar paywall".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsbygoogle banner-ad ad-slot dfp commercial".split(),
    "form": "form search search-form login signup contact-form subscribe-form".split(),
    "comments": "comments comment comment-list responses discussion reply replies disqus comment-body comment-thread reader-comments".split(),
    "share": "share social sharing share-buttons follow social-links author-box byline meta post-meta".split(),
}
TITLES = {
    "comments": ["Comments", "Leave a reply", "Responses", "Kommentare", "Commentaires", "Comentarios", "Reader comments", "2 comments"],
    "sidebar": ["Related", "Popular", "Most read", "More stories", "Recent posts", "Tags", "Archive", "Mehr", "Voir aussi"],
    "notice": ["Notice", "Cookies", "We value your privacy", "Subscribe"],
    "menu": ["Menu", "Contents", "Navigation"],
}
SYLLABLES = "an er in st re ou le en de la ti on es ur no va mi ko ta lu sh br ch ö é ñ".split()
JUNK = ["%%%", "###", "***", "$$$", "&&&", "|", ">>", "<<", "#", "12", "404"]


class Page:
    def __init__(self, number: int) -> None:
        self.rng = random.Random(number * 2_654_435_761 + 97)
        self.main: list[str] = []
        self.junk = self.rng.random() < 0.15
        self.careless = self.rng.random() < 0.4
        self.semantic = self.rng.random()

    # -- text

    def word(self) -> str:
        w = "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))
        if self.junk and self.rng.random() < 0.5:
            w += self.rng.choice(JUNK)
        return w

    def sentence(self, least: int = 3, most: int = 14) -> str:
        words = [self.word() for _ in range(self.rng.randint(least, most))]
        if len(words) > 5 and self.rng.random() < 0.5:
            words[2] += ","
        return " ".join(words).capitalize() + self.rng.choice([".", ".", ".", "!", "?"])

    def prose(self) -> str:
        kind = self.rng.random()
        if kind < 0.08:
            return self.word()
        if kind < 0.2:
            return self.sentence(1, 4)
        if kind < 0.25:
            return " ".join(self.word() for _ in range(self.rng.randint(2, 30)))
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, 9)))

    def title(self) -> str:
        return self.sentence(2, 9).rstrip(".!?")

    # -- markup

    def attributes(self, words: list[str]) -> str:
        kind = self.rng.random()
        w = self.rng.choice(words)
        if kind < 0.7:
            return f' class="{w}"'
        if kind < 0.85:
            return f" id='{w}'"
        return f' class="{w} {self.rng.choice(["box", "wrap", "inner", "x1", "row", "clear"])}"'

    def links(self, n: int, of: str = "li") -> str:
        out = []
        for _ in range(n):
            text = escape(self.word() if self.rng.random() < 0.7 else self.title())
            out.append(f'<{of}><a href="/{self.word()}">{text}</a>' + ("" if self.careless and of == "li" else f"</{of}>"))
        return "".join(out)

    def plain(self, tag: str = "p") -> str:
        return f"<{tag}>{escape(self.prose())}</{tag}>"

    def part(self, kind: str) -> str:
        """Something that is not main text."""
        r, semantic = self.rng, {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        tag = semantic if semantic and r.random() < 0.6 else r.choice(["div", "div", "section"])
        plain = tag == semantic and r.random() < 0.6
        words = "" if plain else self.attributes(PARTS[kind])
        if kind == "menu" and r.random() < 0.2:
            words += ' role="navigation"'
        head = ""
        if kind in TITLES and r.random() < 0.6:
            level = r.choice(["h2", "h3", "h4"])
            head = f"<{level}>{escape(r.choice(TITLES[kind]))}</{level}>"
        if kind == "menu":
            inside = head + (f"<ul>{self.links(r.randint(2, 9))}</ul>" if r.random() < 0.75 else self.links(r.randint(2, 7), r.choice(["span", "p"])))
        elif kind == "header":
            inside = r.choice([f"<h1>{self.word()}</h1>", f"<h2>{self.word()}</h2>", f"<p>{escape(self.title())}</p>", f"<a href='/'>{self.word()}</a>"])
            inside += self.plain() if r.random() < 0.4 else ""
        elif kind == "footer":
            inside = r.choice(["&copy; 2020 ", "&copy; ", "Copyright ", ""]) + self.word() + " &middot; " + escape(self.sentence())
            inside = f"<p>{inside}</p>" if r.random() < 0.5 else inside
            inside += f"<ul>{self.links(r.randint(1, 5))}</ul>" if r.random() < 0.4 else ""
        elif kind == "sidebar":
            inside = head + (f"<ul>{self.links(r.randint(2, 6))}</ul>" if r.random() < 0.5 else "".join(self.plain() for _ in range(r.randint(1, 3))))
        elif kind == "form":
            inside = f"<label>{self.word()}</label><input name=q><select><option>{self.word()}<option>{self.word()}</select><button>{self.word()}</button>"
            inside = (self.plain() if r.random() < 0.6 else "") + inside
            if tag != "form" and r.random() < 0.8:
                inside = f"<form action='/{self.word()}'>{inside}</form>"
        elif kind == "comments":
            one = lambda: r.choice([
                f"<div{self.attributes(['comment', 'reply', 'comment-body', 'response'])}>{self.plain()}</div>",
                f"<li>{self.plain()}</li>", self.plain(), f"<article>{self.plain()}</article>", f"<li>{escape(self.prose())}</li>",
            ])
            inside = head + "".join(one() for _ in range(r.randint(1, 5)))
        else:
            inside = head + (escape(self.prose()) if r.random() < 0.5 else self.plain())
            inside += f"<button>{self.word()}</button>" if r.random() < 0.2 else ""
            inside += self.links(r.randint(1, 3), "span") if r.random() < 0.2 else ""
        if r.random() < 0.1:
            inside = f"<div>{inside}</div>"
        return f"<{tag}{words}>{inside}</{tag}>"

    def keep(self, text: str) -> str:
        """A line of the main text, with some markup inside."""
        line = " ".join(text.split())
        if not line:
            return ""
        self.main.append(line)
        words = [escape(w) for w in line.split()]
        if self.rng.random() < 0.3:
            i = self.rng.randrange(len(words))
            words[i] = self.rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<code>{}</code>", "<b>{}", "<span>{}</span>"]).format(words[i])
        glue = self.rng.choice([" ", " ", " ", "\n", "  "])
        return glue.join(words)

    def article(self) -> str:
        r, out = self.rng, []
        inner = [k for k in ("ad", "sidebar", "share", "form", "notice", "menu", "footer") if r.random() < 0.12]
        if r.random() < 0.9:
            level = r.choice(["h1", "h1", "h2"])
            heading = f"<{level}>{self.keep(self.title())}</{level}>"
            out.append(heading)
        n = r.choice([0, 1, 1, 2, 3, 5, 8, 13])
        for _ in range(n):
            kind = r.random()
            if kind < 0.7:
                end = "" if self.careless and r.random() < 0.5 else "</p>"
                tail = "<br>" if self.careless and r.random() < 0.4 else ""
                bold = "<b>" if self.careless and r.random() < 0.3 else ""
                out.append(f"<p>{bold}{self.keep(self.prose())}{tail}{end}")
            elif kind < 0.78:
                out.append(f"<h2>{self.keep(self.title())}</h2>")
            elif kind < 0.86:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.keep(self.prose())}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.keep(self.prose())}</blockquote>")
            elif kind < 0.93:
                out.append(f"<pre>{self.keep(self.prose())}</pre>")
            elif kind < 0.96:
                row = lambda: f"<tr><td>{self.keep(self.word())}</td><td>{self.keep(self.word())}</td></tr>"
                out.append(f"<table>{row()}{row()}</table>")
            elif kind < 0.98:
                out.append(f"<figure><img src=x.png><figcaption>{self.keep(self.sentence())}</figcaption></figure>")
            else:
                out.append(f"<div>{self.keep(self.prose())}</div>")
            if inner and r.random() < 0.3:
                out.append(self.part(inner.pop()))
        out += [self.part(k) for k in inner]
        if r.random() < 0.12:
            out.append(self.part("comments"))
        inside = "".join(out)
        if self.semantic < 0.5:
            words = self.attributes(MAIN) if r.random() < 0.4 else ""
            inside = f"<article{words}>{inside}</article>"
            if r.random() < 0.3:
                inside = f"<main>{inside}</main>"
        elif self.semantic < 0.65:
            inside = f"<main{self.attributes(MAIN) if r.random() < 0.5 else ''}>{inside}</main>"
        elif self.semantic < 0.92:
            inside = f"<div{self.attributes(MAIN)}>{inside}</div>"
        if r.random() < 0.2:
            inside = f'<div class="{r.choice(["container", "wrapper", "row", "page", "layout"])}">{inside}</div>'
        return inside

    def draw(self) -> tuple[str, str]:
        r = self.rng
        some = lambda kinds, p: [self.part(k) for k in kinds if r.random() < p]
        before = some(("notice", "header", "menu", "ad", "form", "sidebar", "menu"), 0.4)
        if r.random() < 0.4:
            r.shuffle(before)
        middle = self.article()
        after = some(("share", "comments", "sidebar", "ad", "form", "notice"), 0.35)
        if r.random() < 0.4:
            r.shuffle(after)
        if r.random() < 0.85:
            after.append(self.part("footer"))
        script = '<script>var t="</p>";</script>' if r.random() < 0.5 else ""
        head = f"<head><meta charset=utf-8><title>{escape(self.title())}</title><style>p{{margin:0}}</style>{script}</head>"
        between = r.choice(["", "", "\n", "<!-- ad -->"])
        body = between.join([*before, middle, *after])
        end = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}{end}", "\n".join(self.main)


def draw_page(number: int) -> tuple[str, str]:
    """Html and main text of the page of this number."""
    return Page(number).draw()
