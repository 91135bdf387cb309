"""Main text of HTML pages by gradient-boosted trees over DOM nodes.

A node is kept when its subtree holds article text, so a right answer is closed under
ancestors.  Trees give every node a log-odds; decoding keeps the connected set of nodes,
from the root down, with the largest weighted sum, so no node is kept below a dropped one.

The trees are fitted in numpy on a bounded sample of the pages at hand: their texts, cut by
semantic elements where a page has them, are set again into page layouts of many shapes,
whose labels are known.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabsight.llm import dom

SAMPLE = 300  # pages that the trees may be fitted on
LAYOUTS = 900
TREES = 50
DEPTH = 5
BINS = 32
SHRINK = 0.25
COLUMN_SHARE, ROW_SHARE = 0.4, 0.7
MOST_TOKENS = 160
PROSE = 60  # characters of a block that may hold an article where the trees find none
NEAR = 2.0  # log odds by which other blocks may be less likely than the likeliest

# Elements that never hold an article.
NEVER = ("nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "button", "select", "dialog", "svg", "title", "head")
# Names that page authors commonly give to parts of a page.
MAIN_NAMES = ("article", "content", "post", "entry", "story", "main", "article-body", "post-content", "entry-content", "story-body", "text", "blog-post", "page-content", "articleBody", "prose")
SIDE_NAMES = {
    "menu": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "site-nav", "pagination", "toc", "skip-links"),
    "header": ("header", "masthead", "site-header", "top-bar", "banner", "branding", "page-header", "hero-bar"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "colophon", "credits"),
    "sidebar": ("sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "more-stories", "side-column", "tags", "author-box", "read-next", "latest"),
    "notice": ("cookie", "consent", "notice", "alert", "cookie-banner", "gdpr", "popup", "modal", "announcement", "overlay", "disclaimer", "message", "paywall"),
    "advert": ("ad", "ads", "advert", "sponsor", "sponsored", "promo", "advertisement", "ad-slot", "promotion", "banner-ad", "adsense", "commercial"),
    "form": ("newsletter", "subscribe", "signup", "search", "login", "search-form", "contact-form", "register", "feedback"),
    "share": ("share", "social", "share-buttons", "social-links", "follow", "toolbar", "meta", "byline"),
    "comments": ("comments", "comment", "comment-list", "replies", "responses", "discussion", "reader-comments", "disqus", "respond", "user-comments"),
}
# elements whose text is never article text, and those that hold it
SEMANTIC_SIDE = ("nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu")
SEMANTIC_MAIN = ("article", "main")


def weak_blocks(page: dom.Page) -> tuple[list[str], list[str]]:
    """(article texts, other texts) of a page by its semantic elements; no article texts where it has none."""
    n = len(page.tag)
    state = [0] * n
    side = {w for names in SIDE_NAMES.values() for name in names for w in name.split("-")} - {"main", "content", "page", "article", "story", "stories"}
    for i in range(1, n):
        state[i] = state[page.parent[i]]
        if page.tag[i] in SEMANTIC_SIDE or (page.tokens[i] & side and page.tag[i] not in SEMANTIC_MAIN):
            state[i] = -1
        elif page.tag[i] in SEMANTIC_MAIN and state[i] == 0:
            state[i] = 1
    texts: dict[int, list[str]] = {}
    for node, piece in page.segments:
        if piece is not None:
            texts.setdefault(node, []).append(piece)
    joined = {i: " ".join("".join(t).split()) for i, t in texts.items()}
    main = [t for i, t in joined.items() if state[i] == 1 and t]
    return main, [t for i, t in joined.items() if state[i] == -1 and t]


class Layout:
    """Sets texts into one page of random shape, marking article parts with an attribute."""

    def __init__(self, rng: random.Random, main: Sequence[str], other: Sequence[str]) -> None:
        self.rng, self.main, self.other = rng, main, other

    def esc(self, t: str) -> str:
        return t.replace("&", "&amp;").replace("<", "&lt;")

    def short(self) -> str:
        r = self.rng
        words = r.choice(self.other if self.other and r.random() < 0.7 else self.main).split()
        at = r.randrange(max(1, len(words)))
        return self.esc(" ".join(words[at : at + r.randrange(1, 14)]))

    def prose(self) -> str:
        r = self.rng
        words = r.choice(self.main).split()
        if r.random() < 0.3:
            words = words[: r.randrange(1, 12)]
        return self.esc(" ".join(words[: r.randrange(3, 160)]))

    def wrap(self, kind: str, inner: str, element: str | None = None) -> str:
        r = self.rng
        name = r.choice(SIDE_NAMES[kind])
        use = element if element and r.random() < 0.5 else r.choice(("div", "div", "section", "aside", "ul"))
        if element == use and r.random() < 0.5:
            return f"<{use}>{inner}</{use}>"
        extra = r.choice(("", "", "-wrap", "-1", " box", " clearfix", "_inner", " container"))
        attribute = r.choice(("class", "class", "id"))
        return f'<{use} {attribute}="{name}{extra}">{inner}</{use}>'

    def links(self, most: int = 9) -> str:
        r = self.rng
        inner = "".join(f'<li><a href="/{i}">{self.short()}</a></li>' for i in range(r.randrange(2, most)))
        return f"<ul>{inner}</ul>" if r.random() < 0.7 else inner.replace("<li>", "<span>").replace("</li>", "</span>")

    def side(self, kind: str) -> str:
        r = self.rng
        if kind == "menu":
            return self.wrap(kind, self.links(), "nav")
        if kind == "header":
            return self.wrap(kind, f"<h1>{self.short()}</h1>" * (r.random() < 0.5) + f"<p>{self.short()}</p>" + self.links(5) * (r.random() < 0.5), "header")
        if kind == "footer":
            return self.wrap(kind, f"<p>&copy; {self.short()}</p>" + self.links(6) * (r.random() < 0.5), "footer")
        if kind == "sidebar":
            return self.wrap(kind, f"<h3>{self.short()}</h3>" + (self.links() if r.random() < 0.6 else f"<p>{self.prose()}</p>"), "aside")
        if kind == "form":
            controls = f'<label>{self.short()}</label><input name="q"><button>{self.short()}</button>'
            return self.wrap(kind, f"<form><p>{self.short()}</p>{controls}</form>", "form")
        if kind == "comments":
            one = lambda: f'<{"li" if r.random() < 0.5 else "div"} class="{r.choice(("comment", "reply", "comment-body", "c"))}"><b>{self.short()}</b><p>{self.prose()}</p></div>'
            return self.wrap(kind, f"<h3>{self.short()}</h3>" + "".join(one() for _ in range(r.randrange(1, 7))), "section")
        if kind == "share":
            return self.wrap(kind, self.links(5) if r.random() < 0.6 else f"<span>{self.short()}</span>")
        body = self.prose() if r.random() < 0.5 else self.short()
        return self.wrap(kind, f"<p>{body}</p>" if r.random() < 0.6 else body, None)

    def page(self) -> str:
        r = self.rng
        mark = ' data-kept="1"'
        blocks = []
        if r.random() < 0.9:
            blocks.append(f"<h1{mark}>{self.short()}</h1>")
        for _ in range(r.randrange(1, 12) if r.random() < 0.75 else 1):
            kind = r.random()
            if kind < 0.78:
                blocks.append(f"<p{mark}>{self.prose()}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.86:
                blocks.append(f"<h2{mark}>{self.short()}</h2>")
            elif kind < 0.92:
                blocks.append(f"<ul{mark}>" + "".join(f"<li{mark}>{self.prose()}</li>" for _ in range(r.randrange(1, 5))) + "</ul>")
            elif kind < 0.95:
                blocks.append(f"<blockquote{mark}><p{mark}>{self.prose()}</p></blockquote>")
            else:
                blocks.append(f"<div{mark}>{self.prose()}<br>{self.prose()}</div>")
        for kind in ("advert", "share", "form", "sidebar", "comments", "notice"):
            if r.random() < 0.15:
                at = len(blocks) if kind in ("comments", "share") else r.randrange(len(blocks) + 1)
                blocks.insert(at, self.side(kind))
        body = "".join(blocks)
        if r.random() < 0.5:
            body = f"<article{mark}>{body}</article>"
            if r.random() < 0.3:
                body = f'<div{mark} class="{r.choice(MAIN_NAMES)}">{body}</div>'
        elif r.random() < 0.3:
            body = f"<main{mark}>{body}</main>"
        else:
            for _ in range(r.randrange(1, 3)):
                name = r.choice(MAIN_NAMES + ("wrap", "inner", "row", "col", "container", "left"))
                body = f'<{r.choice(("div", "div", "section"))}{mark} {r.choice(("class", "id"))}="{name}">{body}</div>'
        before = [self.side(k) for k in ("notice", "header", "menu", "advert") if r.random() < 0.55]
        after = [self.side(k) for k in ("share", "comments", "sidebar", "form", "advert", "menu", "notice", "footer") if r.random() < 0.4]
        r.shuffle(before)
        joined = "".join(before) + body + "".join(after)
        if r.random() < 0.4:
            joined = f'<div{mark} {r.choice(("class", "id"))}="{r.choice(("page", "wrapper", "container", "site", "layout", "app", "root"))}">{joined}</div>'
        return f"<html><head><title>{self.short()}</title></head><body>{joined}</body></html>"


def labelled(source: str) -> tuple[dom.Page, np.ndarray]:
    """A marked page without its marks, and for each node whether article text is in its subtree."""
    marked = dom.parse(source.replace(' data-kept="1"', ' role="xkeptx"'))
    kept = np.array(["xkeptx" in t for t in marked.tokens])
    for i in range(len(kept) - 1, 0, -1):
        if kept[i]:
            kept[marked.parent[i]] = True
    marked.tokens = [t - {"xkeptx"} for t in marked.tokens]
    return marked, kept


@dataclass
class Trees:
    """Complete binary trees of one depth: a test per inner node, a value per leaf."""

    vocabulary: dict[str, int]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base, dtype=np.float32)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (2**DEPTH - 1)]
        return out


def grow(x: np.ndarray, y: np.ndarray, vocabulary: dict[str, int]) -> Trees:
    """Boosted trees for log loss, split by second-order gain over binned features."""
    n, columns = x.shape
    cuts, binned = [], np.empty((n, columns), dtype=np.int64)
    for j in range(columns):
        edges = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) if j < dom.NUMERIC else np.array([0.5])
        cuts.append(edges)
        binned[:, j] = np.searchsorted(edges, x[:, j], side="left")
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    f = np.full(n, base)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features, thresholds, values = [], [], []
    rng = np.random.default_rng(TREES)
    marks = np.arange(dom.NUMERIC, columns)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        # each tree sees all numbers, some of the marks, and some of the rows
        some = np.concatenate([np.arange(dom.NUMERIC), np.sort(rng.permutation(marks)[: int(COLUMN_SHARE * len(marks))])])
        drawn = rng.random(n) < ROW_SHARE
        flat = binned[:, some] + np.arange(len(some)) * BINS
        width = len(some)
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf, dtype=np.float32)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            at[mine] = 2 * node + 1
            used = mine[drawn[mine]]
            if len(used) < 8:
                continue
            index = flat[used].ravel()
            gs = np.bincount(index, np.repeat(g[used], width), width * BINS).reshape(width, BINS).cumsum(axis=1)
            hs = np.bincount(index, np.repeat(h[used], width), width * BINS).reshape(width, BINS).cumsum(axis=1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
            gain[(hs < 0.5) | (ht - hs < 0.5)] = -1
            k, b = divmod(int(gain.argmax()), BINS)
            j = int(some[k])
            if gain[k, b] <= 1e-6 or b >= len(cuts[j]):
                continue
            feature[node], cut[node] = j, cuts[j][b]
            at[mine] += x[mine, j] > cuts[j][b]
        leaf = at - inner
        gl, hl = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value = -SHRINK * gl / (hl + 1)
        f += value[leaf]
        features.append(feature)
        thresholds.append(cut)
        values.append(value.astype(np.float32))
    return Trees(vocabulary, np.array(features), np.array(thresholds), np.array(values), base)


# Fixed text for a table without any article: trees then know layouts only by these words.
_PLAIN = "This is a line of plain text that stands for the prose of a page. It has sentences of several words."


def fit(sources: Sequence[str | None], layouts: int = LAYOUTS, seed: int = 11) -> Trees:
    """Trees fitted on the pages that have semantic elements and on layouts of their texts."""
    rng = random.Random(seed)
    main, other = [], []
    examples: list[tuple[dom.Page, np.ndarray]] = []
    for s in sources:
        page = dom.parse(s)
        texts, rest = weak_blocks(page)
        main += texts
        other += rest
        if texts:
            examples.append((page, weak_labels(page)))
    main = [t for t in main if len(t) > 15] or [_PLAIN]
    layout = Layout(rng, main, other or main)
    examples += [labelled(layout.page()) for _ in range(layouts)]
    counts = Counter(w for page, _ in examples for t in page.tokens for w in t)
    vocabulary = {w: i for i, (w, c) in enumerate(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:MOST_TOKENS]) if c >= 5}
    x = np.concatenate([dom.features(page, vocabulary) for page, _ in examples])
    y = np.concatenate([kept for _, kept in examples]).astype(float)
    return grow(x, y, vocabulary)


def weak_labels(page: dom.Page) -> np.ndarray:
    """Whether each node is, or holds, a part of an article by semantic elements."""
    n = len(page.tag)
    state = np.zeros(n, dtype=int)
    side = {w for names in SIDE_NAMES.values() for name in names for w in name.split("-")} - {"main", "content", "page", "article", "story", "stories"}
    for i in range(1, n):
        state[i] = state[page.parent[i]]
        if page.tag[i] in SEMANTIC_SIDE or (page.tokens[i] & side and page.tag[i] not in SEMANTIC_MAIN):
            state[i] = -1
        elif page.tag[i] in SEMANTIC_MAIN and state[i] == 0:
            state[i] = 1
    kept = state == 1
    for i in range(n - 1, 0, -1):
        if kept[i]:
            kept[page.parent[i]] = True
    return kept


def decode(page: dom.Page, log_odds: np.ndarray) -> np.ndarray:
    """The nodes to keep: the best connected set from the root down, each node weighted by its own text."""
    n = len(page.tag)
    gain = (log_odds * (1 + np.log1p(np.array(page.own)))).tolist()
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    keep = np.zeros(n, dtype=bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and gain[i] > 0
    return keep


def prose(page: dom.Page, log_odds: np.ndarray) -> np.ndarray:
    """Log odds for a page of which nothing was kept: its most likely blocks of prose now stay.

    Prose are blocks of ``PROSE`` characters and more with few links, outside the elements that never hold an article; the
    likeliest one stays, what is nearly as likely, and all elements around them.
    """
    outside = np.zeros(len(page.tag), dtype=bool)
    for i in range(1, len(page.tag)):
        outside[i] = outside[page.parent[i]] or page.tag[i] in NEVER
    own = np.array(page.own)
    likely = ~outside & (own >= PROSE) & (2 * np.array(page.linked) <= own)
    if not likely.any():
        return log_odds
    chosen = likely & (log_odds >= log_odds[likely].max() - NEAR)
    raised = log_odds.copy()
    for i in np.flatnonzero(chosen):
        raised[i] = max(raised[i], 1.0)
        while i > 0 and page.parent[i] >= 0:
            i = page.parent[i]
            raised[i] = max(raised[i], 0.0)
    return raised


def extract(sources: Sequence[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    pages = [dom.parse(s) for s in sources]
    if not pages:
        return []
    rows = [dom.features(p, trees.vocabulary) for p in pages]
    odds = trees.log_odds(np.concatenate(rows))
    out, at = [], 0
    for page, r in zip(pages, rows):
        own = odds[at : at + len(r)]
        text = dom.text_of(page, decode(page, own))
        out.append(text or dom.text_of(page, decode(page, prose(page, own))))
        at += len(r)
    return out


def train(pages: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most ``sample`` pages, chosen by a hash of their html."""
    some = pages.filter("html is not null").select("html")
    share = 2 * sample / max(1, some.count())
    if share < 1:  # so that no task sorts and sends more than it must
        some = some.filter(F.xxhash64("html") < F.lit(int(share * 2.0**64) - (1 << 63)))
    chosen = some.orderBy(F.xxhash64("html"), F.col("html")).limit(sample)
    return fit([r["html"] for r in chosen.toPandas().to_dict("records")])


def main_text(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the article text of every page, from its whole html.

    Null and empty html give the empty text.  Repeated rows are extracted each, other columns
    are ignored, an empty table gives no rows.  Broken markup is read as far as it goes.
    """
    fitted = trees or train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                some = batch.slice(start, 128)
                texts = extract(some.column(2).to_pylist(), fitted)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
