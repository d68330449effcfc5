"""Leaf blocks of HTML pages: what text stands in which elements, for tag soup as it comes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container
from functools import cache
from html import unescape

# tags with few and short quoted values as a whole; of others only the name, _tag_end finds where they end
_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]{0,1000}+\"|'[^']{0,1000}+')[^>\"']*+){0,32}+>)?",
    re.S,
)
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements that don't end a block.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr label input
math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mpadded mphantom menclose semantics mspace""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents aren't text of the page.
RAW = frozenset("script style noscript template iframe svg title textarea select button object audio video canvas head annotation annotation-xml".split())
_LITERAL = frozenset("script style title textarea iframe".split())
#: A start tag ends an open element of these, up to the nearest container.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Elements that say of a text how it is set, not what it is for.
PLAIN = frozenset("html body p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre hr center font".split())
_CONTAINERS = frozenset("ul ol dl table div section article main aside nav header footer form body blockquote".split())


class Block:
    """A leaf block: its text, how much of it is linked, the features of all its ancestors, and the tags of the nearest two."""

    __slots__ = ("inherited", "linked", "tags", "text")

    def __init__(self, text: str, linked: int, inherited: frozenset[str], tags: tuple[str, ...]):
        self.text, self.linked, self.inherited, self.tags = text, linked, inherited, tags


def _named(tag: str, attributes: str) -> set[str]:
    """The features that an element gives to all blocks in it."""
    names = set()
    if "=" in attributes or "hidden" in attributes:
        for m in _NAMES.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind in ("class", "id", "role"):
                names.update(_WORDS.findall(value))
            elif kind == "hidden" or "display:none" in value.replace(" ", ""):
                names.add("hidden")
    return {f"in {tag}", *(f"name {x}" for x in names)}


def _element_end(lower: str, tag: str, at: int, unbalanced: set[str]) -> int:
    """Where the end tag of an element without text of the page begins, -1 if there is none. Those of its own kind inside it end first;
    where they never all end (``unbalanced`` then remembers it for the page), the next end tag does."""
    if tag not in _LITERAL and tag not in unbalanced:
        depth = 1
        for m in _edges(tag).finditer(lower, at):
            depth += -1 if m[1] else not m[2].endswith("/")
            if not depth:
                return m.start()
        unbalanced.add(tag)
    m = _close(tag).search(lower, at)
    return m.start() if m else -1


@cache
def _edges(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}(?=[\s/>]|$)([^>]*)")


@cache
def _close(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|$)")


def _tag_end(html: str, at: int, dead: set[int | str]) -> int:
    """Where a tag ends whose name ends at ``at``: after the first ``>`` outside quotes, or the first of all if quotes don't close.

    ``dead`` keeps, for a page, the quotes from which no end was found and the kinds of which none is left, so none is followed twice."""
    seen: list[int] = []
    to = at
    while m := _STOP.search(html, to):
        if m[0] == ">":
            return m.end()
        if m.start() in dead or m[0] in dead:
            break
        seen.append(m.start())
        to = html.find(m[0], m.end()) + 1
        if not to:
            dead.add(m[0])
            break
    dead.update(seen)
    return html.find(">", at) + 1 or len(html)


def leaf_blocks(html: str, vocabulary: Container[str] | None = None, met: set[str] | None = None) -> list[Block]:
    """The blocks with text, in page order: character references decoded, white space runs as one space, trimmed.

    ``met`` gets the features of all elements of the page. Inherited features are those in ``vocabulary``. Elements that add none share their parent's set, so with a vocabulary a
    page of any depth takes time and memory in proportion to its length."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    endless: set[str] = set()
    unbalanced: set[str] = set()
    opened: Counter[str] = Counter()
    texts: list[str] = []
    links = linked = 0
    lower = None
    dead: set[int | str] = set()

    def close() -> None:
        nonlocal linked
        if texts:
            text = " ".join(unescape("".join(texts)).split())
            if text:
                out.append(Block(text, linked, stack[-1][1] if stack else frozenset(), tuple(t for t, _ in stack[-2:])))
            texts.clear()
        linked = 0

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        upto = m.start() if m else end
        if upto > at:
            texts.append(html[at:upto])
            if links:
                linked += upto - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if attributes is None:
            at = _tag_end(html, m.end(), dead)
            attributes = html[m.end() : at]
        if tag in RAW and not closing:
            if attributes.endswith("/>"):
                continue
            close()
            if lower is None:
                lower = html.lower() if len(html.lower()) == len(html) else re.sub("[A-Z]+", lambda x: x[0].lower(), html)
            if tag in _LITERAL or tag not in ("head",):
                to = -1 if tag in endless else _element_end(lower, tag, at, unbalanced)
                if to < 0:
                    endless.add(tag)
                # an element that never ends: literal text runs to the end, others are taken as empty
                at = (lower.find(">", to) + 1 or end) if to >= 0 else end if tag in _LITERAL else at
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if tag == "head":
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            continue
        close()
        if tag in VOID:
            continue
        if closing:
            if opened[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            links = 0
            continue
        ends = _ENDS.get(tag, {"p"})
        while stack and stack[-1][0] in ends:
            pop()
        if any(opened[e] for e in ends) and tag in _ENDS:
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] not in ends and stack[depth][0] not in _CONTAINERS:
                depth -= 1
            if depth >= 0 and stack[depth][0] in ends:
                while len(stack) > depth:
                    pop()
        above = stack[-1][1] if stack else frozenset()
        more = {f for f in _named(tag, attributes) if f not in above and (vocabulary is None or f in vocabulary)}
        if met is not None:
            met |= _named(tag, attributes)
        stack.append((tag, above | more if more else above))
        opened[tag] += 1
        links = 0
    close()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block: its ancestors' tags and names, its own text, and its place."""
    out = []
    n = len(blocks)
    known: dict[tuple, list[str]] = {}
    for i, b in enumerate(blocks):
        f = known.get((b.tags, b.inherited))
        if f is None:
            f = [*b.inherited, *([f"parent {b.tags[-1]}", f"pair {'>'.join(b.tags)}"] if b.tags else ["parent none"])]
            known[b.tags, b.inherited] = f
        text = b.text
        words = text.count(" ") + 1
        share = min(b.linked / max(len(text), 1), 1.0)
        own = [f"words {min(words, 128).bit_length()}", f"links {int(share * 4)}"]
        if text[-1] in ".!?…\"”»":
            own.append("sentence")
        if "©" in text or "copyright" in text.lower():
            own.append("copyright")
        if sum(map(text.count, ",;")) * 12 > words:
            own.append("commas")
        own.append("first" if i == 0 else "last" if i == n - 1 else "middle")
        out.append(f + own)
    return out
