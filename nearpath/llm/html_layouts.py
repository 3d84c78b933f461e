"""Pages of known parts, made to train the block labeller.

A page is laid out at random from parts that are article and parts that are
not; texts come from the words of real pages, on most pages those that stand in
the same kind of part there. Each made block carries its label as a mark at its
start, which is taken off before the page is read.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

from nearpath.llm.html_blocks import Leaf

#: Usual names of the containers of an article and of the rest.
ARTICLE = ["article", "main", "section", "div"]
ARTICLE_NAMES = ["article", "content", "post", "entry", "entry-content", "post-body", "story",
                 "article-body", "main-content", "main", "text", ""]
REST_NAMES = {
    "nav": ["nav", "menu", "navbar", "main-menu", "breadcrumb", "navigation", "topbar"],
    "header": ["header", "site-header", "masthead", "banner", "logo"],
    "footer": ["footer", "site-footer", "copyright", "bottom"],
    "aside": ["sidebar", "aside", "widget", "related", "related-posts", "recommended", "toc"],
    "notice": ["notice", "cookie", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner"],
    "form": ["form", "newsletter", "subscribe", "search", "login", "signup", "contact-form"],
    "comments": ["comments", "comment-list", "comment", "reply", "disqus", "reader-comments"],
    "share": ["share", "social", "tags", "meta", "pagination", "author-box"],
}
#: Of containers that stand around any part.
PLAIN_NAMES = ["", "", "", "wrapper", "container", "row", "col", "inner", "page", "box", "grid", "block"]
YES, NO = "\x01", "\x02"


#: Elements and class words that tell the kind of part a block of a real page is in.
TELLING = {f"<{kind}>": kind for kind in ("nav", "header", "footer", "aside", "form")}
TELLING |= {name: kind for kind, names in REST_NAMES.items() for name in names if name.isalpha()}
TELLING |= {"<article>": "article", "<main>": "article"}
TELLING |= {name: "article" for name in ARTICLE_NAMES if name.isalpha()}
#: A kind's words tell it from the article if, by counts of half of the pages, a
#: word of the other half is so much likelier (as a logarithm) in its own kind.
TOLD_APART = 0.3


def part_of(block: Leaf) -> str | None:
    """The kind of the innermost part around the block whose marks tell it."""
    place = block.place
    while place:
        for word in place.words:
            if word in TELLING:
                return TELLING[word]
        place = place.parent
    return None


class PartWords:
    """How often each word stands in each kind of part of some pages."""

    def __init__(self, pages: Iterable[list[Leaf]] = ()):
        halves: tuple[dict[str, Counter], dict[str, Counter]] = ({}, {})
        everything: set[str] = set()
        for i, blocks in enumerate(pages):
            for block in blocks:
                words = [w for w in block.text.split() if len(w) < 30 and "<" not in w and "&" not in w]
                everything.update(words)
                kind = part_of(block)
                if kind:
                    halves[i % 2].setdefault(kind, Counter()).update(words)
        self.all = sorted(everything)
        self.parts: dict[str, Counter] = {}
        for half in halves:
            for kind, counts in half.items():
                self.parts.setdefault(kind, Counter()).update(counts)
        self.told = {kind for kind in self.parts if kind != "article" and self._told(halves, kind)}

    def _told(self, halves: tuple[dict[str, Counter], dict[str, Counter]], kind: str) -> bool:
        for one, other in (halves, halves[::-1]):
            for own, against in ((kind, "article"), ("article", kind)):
                seen = [one.get(k, Counter()) for k in (own, against)]
                sizes = [sum(counts.values()) + len(self.all) for counts in seen]
                fresh = other.get(own, Counter())
                gain = sum(
                    n * math.log((seen[0][w] + 1) / sizes[0] * sizes[1] / (seen[1][w] + 1))
                    for w, n in fresh.items())
                if gain <= TOLD_APART * sum(fresh.values()):
                    return False
        return True


class Maker:
    def __init__(self, words: PartWords | list[str], seed: int):
        known = isinstance(words, PartWords)
        self.words = (words.all if known else words) or ["word"]
        self.parts = {
            kind: (list(counts), list(accumulate(counts.values())))
            for kind, counts in sorted(words.parts.items()) if counts} if known else {}
        self.told = words.told if known else set()
        self.kind, self.own_words = "", False
        self.rng = random.Random(seed)

    def phrase(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        if self.own_words and self.kind in self.parts:
            words, sums = self.parts[self.kind]
            return " ".join(self.rng.choices(words, cum_weights=sums, k=n))
        return " ".join(self.rng.choice(self.words) for _ in range(n))

    def sentences(self, low: int = 1, high: int = 6) -> str:
        n = self.rng.randint(low, high)
        few = self.rng.random() < 0.15
        return " ".join(
            f"{self.phrase(1, 3 if few else 25).capitalize()}." for _ in range(1 if few else n))

    def attributes(self, name: str) -> str:
        if not name:
            return ""
        return f' {self.rng.choice(["class", "class", "id"])}="{name}"'

    def links(self, mark: str) -> str:
        n = self.rng.randint(2, 9)
        one = self.rng.random() < 0.8
        items = (f'<a href="/{i}">{mark if one or not i else ""}{self.phrase(1, 4)}</a>' for i in range(n))
        if one:
            return "<ul>" + "".join(f"<li>{item}</li>" for item in items) + "</ul>"
        return "<div>" + " | ".join(items) + "</div>"

    def paragraph(self, mark: str) -> str:
        rng, text = self.rng, self.sentences()
        if rng.random() < 0.2:
            text = f"{self.phrase(1, 30)} | {self.phrase(1, 8)} | {self.phrase(1, 8)}"
        kind = rng.random()
        if kind < 0.55:
            return f"<p>{mark}{text}</p>"
        if kind < 0.7:
            return f"<p>{mark}{text[:len(text) // 2]} <b>{self.phrase(1, 3)}</b> <a href='#'>{self.phrase(1, 2)}</a></p>"
        if kind < 0.82:
            return f"<p><b>{mark}{text}<br>"  # left open, as pages do
        if kind < 0.88:
            return f"<h2>{mark}{self.phrase(1, 8)}</h2>"
        if kind < 0.94:
            return f"<ul>{''.join(f'<li>{mark}{self.phrase(2, 14)}</li>' for _ in range(3))}</ul>"
        if kind < 0.97:
            return f"<blockquote>{mark}{text}</blockquote>"
        return f"<div>{mark}{text}</div>"

    def rest(self, kind: str) -> str:
        """A part that is not article; sometimes only its words tell that."""
        around, self.kind = self.kind, kind
        if self.own_words and kind in self.told and self.rng.random() < 0.35:
            made = "".join(f"<p>{NO}{self.phrase(8, 40).capitalize()}.</p>" for _ in range(self.rng.randint(1, 4)))
            made = f"<div>{made}</div>"
        else:
            made = self.marked_rest(kind)
        self.kind = around
        return made

    def marked_rest(self, kind: str) -> str:
        rng = self.rng
        name = rng.choice(REST_NAMES[kind])
        plain = kind in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        tag = kind if plain else rng.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        attributes = self.attributes(name) if not plain or rng.random() < 0.4 else ""
        if kind == "nav":
            body = self.links(NO)
        elif kind == "comments":
            body = "".join(
                f'<div{self.attributes(rng.choice(["comment", "comment-body", "reply"]))}>'
                f"<p>{NO}{self.sentences(1, 4)}</p></div>" for _ in range(rng.randint(1, 6)))
            if rng.random() < 0.6:
                body = f"<h3>{NO}{self.phrase(1, 3)}</h3>" + body
        elif kind == "form":
            body = (f"<label>{NO}{self.phrase(1, 4)}</label><input name='q'>"
                    f"<button>{NO}{self.phrase(1, 2)}</button>")
            if rng.random() < 0.4:
                body = f"<p>{NO}{self.sentences(1, 2)}</p>" + body
        elif kind == "header":
            body = (f"<h1>{NO}{self.phrase(1, 5)}</h1>" if rng.random() < 0.4 else f"<div>{NO}{self.phrase(1, 5)}</div>")
            if rng.random() < 0.5:
                body += self.links(NO)
        elif rng.random() < 0.35:
            body = self.links(NO)
        elif rng.random() < 0.5:
            body = f"<p>{NO}{self.sentences(1, 3)}</p>"
        else:
            body = f"{NO}{rng.choice(['&copy; ', ''])}{self.phrase(1, 30)}"
        return f"<{tag}{attributes}>{body}</{tag}>"

    def article(self) -> str:
        rng, self.kind = self.rng, "article"
        parts = [f"<h1>{YES}{self.phrase(1, 10)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            parts.append(self.paragraph(YES))
            if rng.random() < 0.06:
                parts.append(self.rest(rng.choice(["ad", "form", "share", "aside", "notice"])))
        if rng.random() < 0.2:
            parts.append(self.rest(rng.choice(["share", "aside", "comments"])))
        tag = rng.choice(ARTICLE[:2] * 4 + ARTICLE)
        name = rng.choice(ARTICLE_NAMES)
        if tag in ARTICLE[:2] and rng.random() < 0.7:
            name = ""
        elif not name:
            name = "content"
        if self.own_words and self.told and rng.random() < 0.25:
            tag, name = "div", ""  # no mark tells the article either
        return f"<{tag}{self.attributes(name)}>{''.join(parts)}</{tag}>"

    def nested(self, part: str) -> str:
        """The part's inside below up to 30 more containers, some never closed."""
        rng = self.rng
        if rng.random() < 0.6:
            return part
        start, end = part.index(">") + 1, part.rindex("</")
        n = rng.choice([1, 2, 4, 8, 15, 30])
        kept = n if rng.random() < 0.9 else rng.randint(0, n)
        opened = "".join(f"<div{self.attributes(rng.choice(PLAIN_NAMES))}>" for _ in range(n))
        return part[:start] + opened + part[start:end] + "</div>" * kept + part[end:]

    def page(self) -> str:
        rng = self.rng
        self.own_words = rng.random() < 0.6
        before = rng.sample(["nav", "header", "notice", "ad", "form", "aside"], rng.randint(0, 4))
        after = rng.sample(["footer", "comments", "aside", "ad", "form", "share", "notice", "nav"],
                           rng.randint(0, 4))
        middle = self.nested(self.article())
        if rng.random() < 0.3:
            middle = f"<div{self.attributes(rng.choice(['page', 'wrapper', 'container', 'row']))}>{middle}"
        comment = f"<!-- {rng.choice(['ad', 'start', 'menu'])} {rng.randint(0, 99)} -->"
        around = [[self.nested(self.rest(kind)) for kind in kinds] for kinds in (before, after)]
        body = "".join(around[0]) + comment + middle + "".join(around[1])
        if rng.random() < 0.3:
            n = rng.choice([1, 3, 6, 12, 24])
            body = "".join(f"<div{self.attributes(rng.choice(PLAIN_NAMES))}>" for _ in range(n)) + body
        return (f"<!DOCTYPE html><html><head><title>{self.phrase(1, 6)}</title></head><body>{body}"
                + ("</body></html>" if rng.random() < 0.8 else ""))
