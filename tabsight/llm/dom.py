"""A lenient reader of HTML pages: block nodes, their texts in page order, and node features."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video title textarea head-only".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split())
CONTROLS = frozenset("button input select textarea option label fieldset legend".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# a start tag of the key's group ends an open element of the value's group
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("ul ol dl table select body html".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…](?:\s|$)")
NUMERIC = 18


@dataclass
class Page:
    """Nodes in page order (parents first) and text segments (node, text or None for a break)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[frozenset[str]] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    segments: list[tuple[int, str | None]] = field(default_factory=list)

    def add(self, parent: int, tag: str, tokens: frozenset[str], at: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        for column in (self.own, self.linked, self.tags, self.links, self.ends):
            column.append(0)
        self.start.append(at)
        return len(self.tag) - 1


def parse(source: str | None) -> Page:
    """The nodes and texts of a page.  Raw elements and the head hold no text; what is never closed ends with the page."""
    page = Page()
    root = page.add(-1, "page", frozenset(), 0)
    text = source or ""
    stack: list[tuple[str, int]] = [("page", root)]  # open elements and the node their text goes to
    links, at, written, n = 0, 0, 0, len(text)

    def put(piece: str) -> None:
        nonlocal written
        if not piece:
            return
        if "&" in piece:
            piece = entities.unescape(piece)
        node = stack[-1][1]
        page.segments.append((node, piece))
        size = len(piece) - piece.count(" ") if not piece.isspace() else 0
        page.own[node] += size
        page.ends[node] += len(_SENTENCE.findall(piece)) if size > 20 else 0
        written += size
        if links:
            page.linked[node] += size

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            tag, node = stack.pop()
            if tag == "a":
                links -= 1
            if tag not in INLINE:
                page.segments.append((node, None))

    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            put(text[at:])
            break
        put(text[at : m.start()])
        at = m.end()
        closing, name, attrs = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if name is None:
            continue
        name = name.lower()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
                if name in INLINE and stack[depth][0] not in INLINE:
                    break  # an inline end tag does not end blocks
            continue
        node = stack[-1][1]
        page.tags[node] += 1
        if name == "br" or name == "hr":
            page.segments.append((node, None))
            continue
        if name in RAW or name == "head":
            if not attrs.endswith("/"):
                stop = re.compile(rf"</{name}\s*>|<body[\s>]" if name == "head" else rf"</{name}[\s>/]", re.I).search(text, at)
                at = n if stop is None else (stop.start() if name == "head" else text.find(">", stop.start()) + 1 or n)
            continue
        if name in VOID:
            if name == "input":
                page.tags[node] += 1
            continue
        if name not in INLINE:
            closes = CLOSES.get(name)
            for depth in range(len(stack) - 1, 0, -1):  # implied end tags
                open_tag = stack[depth][0]
                if open_tag == "p" or (closes and open_tag in closes):
                    pop_to(depth)
                    break
                if open_tag in BOUNDS or (open_tag not in INLINE and open_tag not in HEADINGS and not closes):
                    break
            node = stack[-1][1]
            page.segments.append((node, None))
        named = _NAMES.findall(attrs) if attrs else ()
        if name not in INLINE or named:
            words = {name} | {w for groups in named for w in _WORD.findall(" ".join(groups).lower())}
            node = page.add(node, name, frozenset(words), written)
        if name == "a":
            links += 1
            page.links[node] += 1
        if not attrs.endswith("/") or name not in INLINE:
            stack.append((name, node))
        elif name == "a":
            links -= 1
    pop_to(0)
    return page


def features(page: Page, vocabulary: dict[str, int]) -> np.ndarray:
    """A row per node: numbers, then marks of the node's own tokens, then of its ancestors' tokens."""
    n, width = len(page.tag), len(vocabulary)
    out = np.zeros((n, NUMERIC + 2 * width), dtype=np.float32)
    parent = page.parent
    sub, linked, tags, links, ends = list(page.own), list(page.linked), list(page.tags), list(page.links), list(page.ends)
    paragraphs = [int(t == "p") for t in page.tag]
    items = [int(t == "li") for t in page.tag]
    controls = [int(t in CONTROLS) for t in page.tag]
    children = [0] * n
    place, alike = [0] * n, [0] * n
    kinds: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parent[i]
        place[i] = children[p]
        children[p] += 1
        kinds[p, page.tag[i]] = kinds.get((p, page.tag[i]), 0) + 1
    for i in range(1, n):
        alike[i] = kinds[parent[i], page.tag[i]]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for column in (sub, linked, tags, links, ends, paragraphs, items, controls):
            column[p] += column[i]
    siblings = np.array([children[p] if p >= 0 else 1 for p in parent], dtype=np.float32)
    total = max(1, sub[0])
    s, t = np.array(sub, dtype=np.float32), np.array(tags, dtype=np.float32)
    own = np.array(page.own, dtype=np.float32)
    out[:, 0] = page.depth
    out[:, 1] = np.log1p(own)
    out[:, 2] = np.log1p(s)
    out[:, 3] = np.array(linked, dtype=np.float32) / np.maximum(s, 1)
    out[:, 4] = children
    out[:, 5] = np.array(place, dtype=np.float32) / siblings
    out[:, 6] = siblings
    out[:, 7] = s / total
    out[:, 8] = np.log1p(paragraphs)
    out[:, 9] = np.log1p(items)
    out[:, 10] = np.log1p(links)
    out[:, 11] = controls
    out[:, 12] = s / (t + 1)
    out[:, 13] = np.array(page.start, dtype=np.float32) / total
    out[:, 14] = [t in HEADINGS for t in page.tag]
    out[:, 15] = alike
    out[:, 16] = np.log1p(ends)
    out[:, 17] = np.array(ends, dtype=np.float32) / (s + 1)
    above: list[set[int]] = []
    for i in range(n):
        mine = {vocabulary[w] for w in page.tokens[i] if w in vocabulary}
        higher = above[parent[i]] if i else set()
        for w in mine:
            out[i, NUMERIC + w] = 1
        for w in higher:
            out[i, NUMERIC + width + w] = 1
        above.append(higher | mine if mine else higher)
    return out


def text_of(page: Page, keep: np.ndarray) -> str:
    """The texts of kept nodes in page order; breaks and runs of white space become one space."""
    pieces = [" " if piece is None else piece for node, piece in page.segments if piece is None or keep[node]]
    return " ".join("".join(pieces).split())
