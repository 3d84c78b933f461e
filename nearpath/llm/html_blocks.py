"""Pages as sequences of leaf blocks, and numbers that describe a block."""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Elements that hold raw text up to their end tag. It is not text of the page.
RAW = "script|style|title|textarea|iframe"
RAW_START = re.compile(rf"<({RAW})(?=[\s/>])", re.I)
RAW_END = {
    name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW.split("|")
}
OPENING = re.compile(r"</?[a-z]", re.I)
STOP = re.compile("[\"'>]")
#: Elements whose inside is mark-up but never text.
HIDDEN = frozenset(("svg", "template", "noscript"))
#: Where a hidden element's tag, a comment or a raw element begins.
HIDDEN_START = re.compile(
    rf"<!--|<(?P<raw>{RAW})(?=[\s/>])|<(?P<slash>/?)(?P<hidden>svg|template|noscript)(?=[\s/>])",
    re.I)
TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
NAME_WORD = re.compile(r"[a-z]+")
WORD = re.compile(r"\w+")

#: Fixed values of the HTML standard: elements without content, and elements
#: that stand inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that an element of the same kind ends.
ENDED_BY_SIBLING = frozenset("p li dt dd tr td th option".split())

#: Buckets of the words of all open elements, of the ``NEAR`` innermost ones
#: once more, and of the block's words.
PATH_SIZE, NEAR_SIZE, WORD_SIZE, NUMBERS = 256, 128, 512, 6
SIZE = PATH_SIZE + NEAR_SIZE + WORD_SIZE + NUMBERS
NEAR = 4
KNOWN = 300_000


class Place:
    """An open element that is not inside a line, and through ``parent`` all around it."""

    __slots__ = ("parent", "words", "depth", "marks")

    def __init__(self, parent: Place | None, words: tuple[str, ...]):
        self.parent, self.words = parent, words
        self.depth = parent.depth + 1 if parent else 1
        self.marks: np.ndarray | None = None

    def inwards(self, n: int | None = None) -> list[tuple[str, ...]]:
        """The words of the ``n`` innermost elements, or of all, outermost first."""
        out, place = [], self
        while place and (n is None or len(out) < n):
            out.append(place.words)
            place = place.parent
        return out[::-1]


@dataclass
class Leaf:
    """A block's text, the innermost element around it, and how much of it is links."""

    text: str
    place: Place | None
    link_chars: int

    @property
    def path(self) -> tuple[tuple[str, ...], ...]:
        return tuple(self.place.inwards()) if self.place else ()


class Markup:
    """Where tags, comments and raw elements of a page end.

    One pass forward, also over broken pages: what cannot be closed any more is
    known from the last ``>`` and quotes, and places between attributes from
    which no end was found are not tried again.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.dead: set[int] = set()
        self.searched, self.stop = 0, -1

    def end(self, at: int) -> tuple[int, bool]:
        """The end of the token that ``<`` begins, and whether it is a raw element.
        A ``<`` that begins nothing is a token of its own."""
        page = self.page
        if page.startswith("<!--", at):
            return self._after("-->", at + 4), False
        raw = RAW_START.match(page, at)
        if raw:
            return self.raw_end(raw.group(1).lower(), raw.end()), True
        if page.startswith(("<!", "<?"), at):
            end = self._closing(at + 2)
        else:
            opening = OPENING.match(page, at)
            end = self.attributes_end(opening.end()) if opening else -1
            if opening and end < 0:
                end = self._closing(opening.end())
        return (end, False) if end > 0 else (at + 1, False)

    def _after(self, text: str, at: int) -> int:
        end = self.page.find(text, at)
        return len(self.page) if end < 0 else end + len(text)

    def _closing(self, at: int) -> int:
        return self.page.find(">", at) + 1 if at <= self.last[">"] else -1

    def raw_end(self, name: str, at: int) -> int:
        end = RAW_END[name].search(self.page, at)
        end = self._closing(end.end()) if end else -1
        return end if end > 0 else len(self.page)

    def attributes_end(self, at: int) -> int:
        """After the ``>`` that ends a tag's attributes, quoted ones whole; -1 if none does."""
        tried = []
        while at not in self.dead:
            tried.append(at)
            if not self.searched <= at <= self.stop:
                found = STOP.search(self.page, at)
                self.searched, self.stop = at, found.start() if found else len(self.page)
            stop = self.stop
            if stop == len(self.page):
                break
            mark = self.page[stop]
            if mark == ">":
                return stop + 1
            if stop >= self.last[mark]:
                break  # a quote without its partner
            at = self.page.find(mark, stop + 1) + 1
        self.dead.update(tried)
        return -1


def hidden_ends(page: str) -> dict[int, int]:
    """Where each closed hidden element starts and ends. A self-closed svg is
    closed; any other without an end tag hides nothing but its own tag."""
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {name: [] for name in HIDDEN}
    markup, at = Markup(page), 0
    while match := HIDDEN_START.search(page, at):
        if match.group("hidden") is None:
            at, _ = markup.end(match.start())
            continue
        end = markup.attributes_end(match.end())
        at = end if end > 0 else match.start() + 1
        if end < 0:
            continue
        name = match.group("hidden").lower()
        if match.group("slash"):
            if waiting[name]:
                ends[waiting[name].pop()] = end
        elif name != "svg" or not page.endswith("/>", match.start(), end):
            waiting[name].append(match.start())
    return ends


def tokens(page: str) -> Iterator[tuple[str, bool]]:
    """The page's tags, comments and stretches of text without hidden elements, and
    whether each is a raw element."""
    markup, at, ends = Markup(page), 0, None
    while at < len(page):
        if page[at] != "<":
            stop = page.find("<", at)
            stop = len(page) if stop < 0 else stop
            yield page[at:stop], False
            at = stop
            continue
        stop, raw = markup.end(at)
        tag = TAG.match(page, at, stop)
        if tag and tag.group(2).lower() in HIDDEN:
            if ends is None:
                ends = hidden_ends(page)
            at = ends.get(at, stop)
            continue
        yield page[at:stop], raw
        at = stop


def leaves(page: str) -> list[Leaf]:
    """The blocks with text, in page order. All open elements are kept, however
    many, so an end tag ends its own element."""
    out: list[Leaf] = []
    stack: list[tuple[str, Place | None]] = []
    where: dict[str, list[int]] = {}  # of each name the open elements' places in the stack
    blocks: list[int] = []  # of those that are not inside a line
    pieces: list[str] = []
    state = {"links": 0, "link": 0}

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Leaf(text, stack[-1][1] if stack else None, min(state["links"], len(text))))
        pieces.clear()
        state["links"] = 0

    def close(at: int) -> None:
        while len(stack) > at:
            where[stack.pop()[0]].pop()
        while blocks and blocks[-1] >= at:
            blocks.pop()

    for token, raw in tokens(page):
        if token[0] != "<" or len(token) == 1:
            text = html.unescape(token)
            pieces.append(text)
            if state["link"]:
                state["links"] += len(text.strip())
            continue
        tag = TAG.match(token)
        if tag is None or raw:
            continue
        name = tag.group(2).lower()
        if name == "a":
            state["link"] = 0 if tag.group(1) else 1
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if tag.group(1):
            if where.get(name):
                close(where[name][-1])
            continue
        if name in ENDED_BY_SIBLING and blocks and stack[blocks[-1]][0] == name:
            close(blocks[-1])
        place = stack[-1][1] if stack else None
        where.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            blocks.append(len(stack))
            names = NAME_WORD.findall(" ".join(NAMES.findall(token)).lower())
            place = Place(place, (f"<{name}>", *names))
        stack.append((name, place))
    flush()
    return out


def bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def buckets(words: tuple[str, ...], known: dict) -> tuple[list[int], list[int]]:
    """Where an element's words stand among all open elements, and among the near ones."""
    found = known.get(words)
    if found is None:
        found = known[words] = (
            [bucket(word, PATH_SIZE) for word in words],
            [PATH_SIZE + bucket(word, NEAR_SIZE) for word in words])
    return found


def path_marks(place: Place | None, known: dict) -> np.ndarray:
    """Marks of all open elements, made from those of the nearest element around
    that has them."""
    fresh = []
    while place and place.marks is None:
        fresh.append(place)
        place = place.parent
    marks = place.marks if place else np.zeros(PATH_SIZE, np.float32)
    if fresh:
        marks = marks.copy()
        for inner in fresh:
            marks[buckets(inner.words, known)[0]] = 1.0
        fresh[0].marks = marks
    return marks


def vectors(blocks: list[Leaf], known: dict) -> np.ndarray:
    """One row a block: hashed tag path, counts of all its hashed words as a
    vector of length 1/2, six numbers.

    ``known`` keeps the buckets of elements and of words seen before.
    """
    out = np.zeros((len(blocks), SIZE), np.float32)
    if len(known) > KNOWN:
        known.clear()
    first_word = PATH_SIZE + NEAR_SIZE
    for i, block in enumerate(blocks):
        place = block.place
        if place:
            out[i, :PATH_SIZE] = path_marks(place, known)
            for words in place.inwards(NEAR):
                out[i, buckets(words, known)[1]] = 1.0
        words, found = WORD.findall(block.text.lower()), []
        for word in words:
            at = known.get(word)
            if at is None:
                at = known[word] = bucket(word, WORD_SIZE)
            found.append(at)
        if found:
            counts = np.bincount(found, minlength=WORD_SIZE)
            out[i, first_word:first_word + WORD_SIZE] = counts / (2 * math.sqrt(counts @ counts))
        n = len(block.text)
        out[i, first_word + WORD_SIZE:] = (
            math.log1p(n) / 8, block.link_chars / n, math.log1p(len(words)) / 8,
            (block.text[-1] in ".!?…") * 1.0, i / len(blocks),
            math.log1p(place.depth if place else 0) / 4,
        )
    return out
