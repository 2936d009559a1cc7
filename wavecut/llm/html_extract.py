"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its block elements, of the runs of text that stand directly in its body, and of inline
elements marked as hidden or as adverts.  Spark ML's boosted trees are fitted on the nodes of a bounded
sample of pages whose own semantic elements tell article from surroundings, as they are and rewritten: with
neutral elements and attribute words in place of the semantic elements, and with further boilerplate of known
kind put in.  Each page's labels are those of highest joint probability in which nothing below a dropped node is kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecut.llm.common import run_path, written

# Fixed values of the HTML standard: elements without content, with raw text, not rendered as text, and inline.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that run to the end of the file where they are not closed; others end with what holds them.
ENDLESS = frozenset("script style textarea title".split())
RAW = frozenset("script style textarea title iframe noscript template svg canvas object audio video select button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr br input".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table body html div article section main aside nav header footer form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Words in class, id and role attributes, by what they usually mark.
WORDS = {
    "content": "article articlebody content main post entry story body text hentry page maincontent",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs",
    "head": "header head masthead banner topbar logo branding",
    "foot": "footer foot bottom copyright colophon legal contentinfo",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular rail complementary more",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe subscription paywall disclaimer",
    "comment": "comment comments reply replies respond discussion disqus thread reviews",
    "form": "form search login signup register share sharing social tools toolbar buttons follow tags meta byline",
}
ADVERT = list(WORDS).index("advert")
_LOOKUP: dict[str, set[int]] = {}
for _k, _words in enumerate(WORDS.values()):
    for _w in _words.split():
        _LOOKUP.setdefault(_w, set()).add(_k)
TAGS = (
    "body", "article", "main", "section", "div", "p", "li", "ul", "ol", "nav", "header", "footer", "aside", "form",
    "table", "td", "blockquote", "pre", "figure", "heading", "run", "inline",
)
RUN = "run"  # a run of text directly in the body
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_MARKS = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Page:
    """Nodes in document order; parents come before their children."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    words: list[frozenset] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters inside links
    cut: dict[int, list[tuple[int, str, bool]]] = field(default_factory=dict)  # pieces of blocks that hold inline nodes

    def pieces(self) -> Iterator[tuple[int, str, int]]:
        """The blocks, those with inline nodes as one piece for each change of the node."""
        for k, block in enumerate(self.blocks):
            if k not in self.cut:
                yield block
                continue
            for node, raw, linked in self.cut[k]:
                text = " ".join(html.unescape(raw).split())
                if text:
                    yield node, text, len(text) if linked else 0

    def text(self, kept: np.ndarray) -> str:
        """Text of the kept nodes, one line for each block."""
        lines = []
        for k, (node, text, _) in enumerate(self.blocks):
            if k in self.cut:
                text = " ".join(html.unescape("".join(raw for at, raw, _ in self.cut[k] if kept[at])).split())
            elif not kept[node]:
                continue
            if text:
                lines.append(text)
        return "\n".join(lines)


def _attributes(text: str) -> tuple[frozenset, bool]:
    found, hidden = set(), False
    if text:
        for name, value in _MARKS.findall(text):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            elif name in ("class", "id", "role"):
                for w in _WORD.findall(_HUMP.sub(" ", value).lower()):
                    found |= _LOOKUP.get(w, set())
    return frozenset(found), hidden


def _aside(attrs: str) -> bool:
    """Whether an inline element is marked as hidden or as an advert."""
    words, hidden = _attributes(attrs)
    return hidden or ADVERT in words


def parse(source: str) -> Page:
    """Blocks of text with the element they belong to; scripts, styles and other unrendered parts are left out.

    Each run of text directly in the body is a node of its own.  Inline elements are part of their block's text;
    those marked as hidden or as adverts are nodes too, which end with their block where they are not closed.
    """
    page = Page()
    stack: list[int] = []
    buffer: list[tuple[int, str, bool]] = []
    link = False

    def new_node(tag: str, attrs: str) -> int:
        words, hidden = _attributes(attrs)
        page.tag.append(tag)
        page.parent.append(stack[-1] if stack else -1)
        page.words.append(words)
        page.hidden.append(hidden)
        page.attrs.append(attrs)
        return len(page.tag) - 1

    def flush() -> None:
        if buffer:
            whole = html.unescape("".join(t for _, t, _ in buffer))
            text = " ".join(whole.split())
            if text:
                linked = sum(len(t) for _, t, inside in buffer if inside)
                holder = next(n for n in reversed(stack) if page.tag[n] not in INLINE)
                if any(page.tag[n] in INLINE for n, _, _ in buffer):
                    page.cut[len(page.blocks)] = buffer.copy()
                if holder == 0:
                    holder = len(page.tag)
                    page.tag.append(RUN)
                    page.parent.append(0)
                    page.words.append(frozenset())
                    page.hidden.append(False)
                    page.attrs.append("")
                    if len(page.blocks) in page.cut:
                        page.cut[len(page.blocks)] = [(n or holder, t, inside) for n, t, inside in buffer]
                page.blocks.append((holder, text, min(linked, len(text))))
            buffer.clear()

    stack.append(new_node("body", ""))
    at, end, size = 0, 0, len(source)
    inline_open = False  # whether the stack holds an inline node
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            buffer.append((stack[-1], source[at:], link))
            break
        if m.start() > at:
            buffer.append((stack[-1], source[at:m.start()], link))
        at = end = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "br":
                buffer.append((stack[-1], " ", link))
            elif tag == "a":
                link = not closing
            if tag in VOID:
                continue
            if not closing:
                if attrs and _aside(attrs) or inline_open and any(page.tag[n] == tag for n in stack):
                    stack.append(new_node(tag, attrs))
                    inline_open = True
            elif inline_open:
                for k in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if page.tag[stack[k]] not in INLINE:
                        break
                inline_open = any(page.tag[n] in INLINE for n in stack)
            continue
        if tag in RAW:
            if not closing and not attrs.rstrip().endswith("/"):
                done = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(source, at)
                at = done.end() if done else size if tag in ENDLESS else at
            continue
        flush()
        if tag in ("html", "head", "body"):
            if tag == "body" and not closing:
                page.words[0], page.hidden[0] = _attributes(attrs)
            continue
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if page.tag[stack[k]] == tag:
                    del stack[k:]
                    link = False
                    break
            continue
        drop = CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            open_tag = page.tag[stack[k]]
            if open_tag == "p" or open_tag in drop:
                del stack[k:]
                break
            if open_tag in SCOPES:
                break
        stack.append(new_node(tag, attrs))
    flush()
    return page


FEATURES = [
    *(f"tag_{t}" for t in TAGS), *(f"own_{w}" for w in WORDS), *(f"above_{w}" for w in WORDS),
    *(f"in_{t}" for t in ("article", "main", "nav", "header", "footer", "aside", "form")), "hidden", "depth", "children",
    "place_among_siblings", "like_siblings", "log_chars", "link_share", "chars_per_node", "words_per_block", "stops_per_word",
    "share_of_page", "page_before", "holds_article", "own_surroundings", "above_surroundings", "page_has_article",
]
_ABOVE = ("article", "main", "nav", "header", "footer", "aside", "form")


def features(page: Page) -> np.ndarray:
    """One row for each node; sums run over its subtree."""
    n = len(page.tag)
    chars, links, words, stops, blocks, nodes = (np.zeros(n) for _ in range(6))
    before, total = np.zeros(n), 0
    for node, text, linked in page.pieces():
        chars[node] += len(text)
        links[node] += linked
        words[node] += text.count(" ") + 1
        stops[node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
        blocks[node] += 1
        total += len(text)
    nodes += 1
    own = chars.copy()
    article = np.array([t in ("article", "main") for t in page.tag], dtype=float)
    children = np.zeros(n)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        for a in (chars, links, words, stops, blocks, nodes):
            a[p] += a[i]
        article[p] = max(article[p], article[i])
        children[p] += 1
    x = np.zeros((n, len(FEATURES)))
    w0, a0 = len(TAGS), len(TAGS) + len(WORDS)
    t0 = a0 + len(WORDS)
    s0 = t0 + len(_ABOVE)
    seen, like = np.zeros(n), {}
    for i in range(n):
        p, tag = page.parent[i], page.tag[i]
        kind = "heading" if tag in HEADINGS else "inline" if tag in INLINE else tag
        if kind in TAGS:
            x[i, TAGS.index(kind)] = 1
        for k in page.words[i]:
            x[i, w0 + k] = 1
        if tag in _ABOVE:
            x[i, t0 + _ABOVE.index(tag)] = 1
        x[i, s0] = page.hidden[i]
        if p >= 0:
            x[i, a0:t0] = np.maximum(x[p, a0:t0], x[p, w0:a0])
            x[i, t0:s0] = np.maximum(x[i, t0:s0], x[p, t0:s0])
            x[i, s0] = max(x[i, s0], x[p, s0])
            x[i, s0 + 1] = x[p, s0 + 1] + 1
            x[i, s0 + 3] = seen[p] / children[p]
            seen[p] += 1
            like[p, tag] = like.get((p, tag), 0) + 1
    run = np.cumsum(own) - own
    for i in range(n):
        x[i, s0 + 4] = like.get((page.parent[i], page.tag[i]), 1)
    x[:, s0 + 2] = children
    x[:, s0 + 5] = np.log1p(chars)
    x[:, s0 + 6] = links / np.maximum(chars, 1)
    x[:, s0 + 7] = np.log1p(chars / nodes)
    x[:, s0 + 8] = words / np.maximum(blocks, 1)
    x[:, s0 + 9] = stops / np.maximum(words, 1)
    x[:, s0 + 10] = chars / max(total, 1)
    x[:, s0 + 11] = run / max(total, 1)
    x[:, s0 + 12] = article
    x[:, s0 + 13] = x[:, w0 + 1:a0].max(axis=1)  # any word but those of content
    x[:, s0 + 14] = x[:, a0 + 1:t0].max(axis=1)
    x[:, s0 + 15] = article[0]
    return x


def decode(parent: list[int], p: np.ndarray) -> np.ndarray:
    """Labels of highest joint probability with no kept node below a dropped one; the root is kept."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log(1 - p)
    best = np.zeros(len(p))
    for i in range(len(p) - 1, 0, -1):
        # keep[i], drop[i] hold the sums of the children by now
        best[i] = max(keep[i], drop[i])
        keep[parent[i]] += best[i]
        drop[parent[i]] += drop[i]
    kept = np.ones(len(p), dtype=bool)
    for i in range(1, len(p)):
        kept[i] = kept[parent[i]] and keep[i] >= drop[i]
    return kept


@dataclass
class Trees:
    """Boosted trees as arrays: inner nodes have a feature, leaves have -1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: list[float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for (feature, limit, left, right, value), w in zip(self.trees, self.weights):
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                here = at[inner]
                small = x[inner, f[inner]] <= limit[here]
                at[inner] = np.where(small, left[here], right[here])
            margin += w * value[at]
        return 1 / (1 + np.exp(-2 * margin))


_IF = re.compile(r"If \(feature (\d+) <= (\S+)\)")
_IF_SET = re.compile(r"If \(feature (\d+) in \{([^}]*)\}\)")


def read_trees(model) -> Trees:
    """The fitted trees, read from their printed form."""
    out = []
    for tree in model.trees:
        lines = [x.strip() for x in tree.toDebugString.splitlines()[1:] if x.strip()]
        feature, limit, left, right, value = [], [], [], [], []

        def walk(at: int) -> tuple[int, int]:
            me = len(feature)
            for a, v in ((feature, -1), (limit, 0.0), (left, 0), (right, 0), (value, 0.0)):
                a.append(v)
            if m := _IF.match(lines[at]):
                feature[me], limit[me] = int(m[1]), float(m[2])
                left[me], at = walk(at + 1)
                right[me], at = walk(at + 1)  # the Else line
                return me, at
            value[me] = float(lines[at].removeprefix("Predict: "))
            return me, at + 1

        walk(0)
        out.append(tuple(np.array(a, dtype=np.float64 if k in (1, 4) else np.int64) for k, a in enumerate((feature, limit, left, right, value))))
    return Trees(out, list(model.treeWeights))


# Boilerplate of known kind for the rewritten training pages: elements by themselves, and elements marked by a word.
PLAIN_EXTRA = ((RUN, "line"), ("header", "links"), ("header", "line"), ("aside", "links"), ("aside", "line"), ("nav", "links"), ("form", "line"), ("footer", "line"))
FILLING = {"menu": "links", "side": "links", "comment": "comments"}
SPELLINGS = ('class="{0}"', 'id="{0}"', 'class="{0}-box"', 'class="site-{0}"', 'class="block {0}"', 'role="{0}"', 'id="{0}-area"')
NEUTRAL = {
    "article": ("div", ('class="post-content"', 'id="content"', 'class="entry"', 'class="article-body"', "", "")),
    "main": ("div", ('id="main"', 'class="main-content"', "")),
    "nav": ("div", ('class="navbar"', 'id="menu"', 'class="site-navigation"')),
    "footer": ("div", ('class="footer"', 'id="site-footer"', 'class="copyright"')),
    "header": ("div", ('class="masthead"', 'id="header"')), "aside": ("div", ('class="sidebar"', 'class="widget"')),
}
_SEMANTIC = re.compile(r"<(/?)(article|main|nav|footer|header|aside)\b([^>]*)>", re.I)


#: Other shapes that a paragraph of an article can take; {0} and {1} are its halves.
SHAPES = (
    "<ul><li>{0}</li><li>{1}</li></ul>", "<ol><li>{0}<li>{1}</ol>", "<blockquote><p>{0} {1}</p></blockquote>",
    "<section><h2>{0}</h2><p>{1}</p></section>", "<div>{0} {1}</div>", "<table><tr><td>{0}</td><td>{1}</td></tr></table>",
    "<pre>{0} {1}</pre>", "<h2>{0}</h2><div><p>{1}</p></div>", "<figure><p>{0} {1}</p></figure>", "<dl><dt>{0}</dt><dd>{1}</dd></dl>",
)
_PARAGRAPH = re.compile(r"<p>([^<]{30,})</p>", re.I)
INLINE_MARKS = ('class="advert"', 'class="ad"', 'id="sponsor"', "hidden", 'style="display:none"', 'aria-hidden="true"', 'class="promo"')
_ARTICLE = re.compile(r"<article\b[^>]*>(.*?)</article>", re.I | re.S)
_BARE = re.compile(r"</?(?:article|main)\b[^>]*>", re.I)
_HEADING = re.compile(r"<(h[1-6])>", re.I)


def interrupted(source: str, rng: np.random.Generator) -> str:
    """Some paragraphs with an inline element in them that is hidden or an advert."""

    def other(m: re.Match) -> str:
        if rng.random() > 0.2:
            return m[0]
        words, tag = m[1].split(), ("span", "b", "a", "i")[rng.integers(4)]
        half, mark = int(rng.integers(0, len(words) + 1)), INLINE_MARKS[rng.integers(len(INLINE_MARKS))]
        put = " ".join(words[: int(rng.integers(1, 12))])
        return f'<p>{" ".join(words[:half])} <{tag} {mark} data-x="drop">{put}</{tag}> {" ".join(words[half:])}</p>'

    return _PARAGRAPH.sub(other, source)


def bared(source: str, rng: np.random.Generator) -> str:
    """The page with its article's paragraphs as text directly in the body; sometimes with nothing else."""
    m = _ARTICLE.search(source)
    if m is None:
        return source
    runs = (0.0, 0.5, 1.0)[rng.integers(3)]
    run = _PARAGRAPH.sub(lambda p: f'<{RUN} data-x="keep">{p[1]}</{RUN}>' if rng.random() < runs else f'<p data-x="keep">{p[1]}</p>', m[1])
    run = _HEADING.sub(r'<\1 data-x="keep">', run)
    if rng.random() < 0.3:
        return f"<body>{run}</body>"
    return _BARE.sub("", source[: m.start()]) + run + _BARE.sub("", source[m.end():])


def reshaped(source: str, rng: np.random.Generator) -> str:
    """Some paragraphs of the page in other elements."""

    def other(m: re.Match) -> str:
        if rng.random() > 0.35:
            return m[0]
        words = m[1].split()
        half = max(1, len(words) // 2) if rng.random() < 0.6 else min(len(words) - 1, 4)
        return SHAPES[rng.integers(len(SHAPES))].format(" ".join(words[:half]), " ".join(words[half:]))

    return _PARAGRAPH.sub(other, source)


def rewritten(source: str, rng: np.random.Generator, lines: list[str]) -> str:
    """A training page with other boilerplate and, half of the time, without semantic elements."""

    def filling(kind: str) -> str:
        pick = [lines[i] for i in rng.integers(0, len(lines), 4)] if lines else ["more"]
        if kind == "links":
            return "<ul>" + "".join(f'<li><a href="/x">{" ".join(p.split()[:3])}</a></li>' for p in pick) + "</ul>"
        if kind == "comments":
            return "".join(f'<div class="comment"><p>{p} {q}</p></div>' for p, q in zip(pick, pick[::-1]))
        words = pick[0].split()
        short = " ".join(words[: int(rng.integers(1, 12))]) if rng.random() < 0.6 else pick[0]
        return f"<p>{short}</p>" if rng.random() < 0.5 else short

    def extra() -> str:
        if rng.random() < 0.3:
            tag, kind = PLAIN_EXTRA[rng.integers(len(PLAIN_EXTRA))]
            return f'<{tag} data-x="drop">{filling(kind)}</{tag}>'
        group = list(WORDS)[int(rng.integers(1, len(WORDS)))]
        marks = WORDS[group].split()
        mark = SPELLINGS[rng.integers(len(SPELLINGS))].format(marks[rng.integers(len(marks))])
        tag = ("div", "div", "section", "aside", "p")[rng.integers(5)]
        kind = FILLING.get(group, "line" if rng.random() < 0.7 else "links")
        body = filling(kind)
        return f'<{tag} {mark} data-x="drop">{re.sub("</?(p|div|ul|li)[^>]*>", " ", body) if tag == "p" else body}</{tag}>'

    bare = rng.random() < 0.3
    out = interrupted(bared(source, rng) if bare else reshaped(source, rng), rng)
    for place in (r"<article\b[^>]*>", r"</article>", r"<body\b[^>]*>", r"</p>"):
        for _ in range(int(rng.integers(0, 3))):
            m = list(re.finditer(place, out, re.I))
            if m:
                x = m[int(rng.integers(len(m)))]
                cut = x.start() if place.startswith("<article") else x.end()
                out = out[:cut] + extra() + out[cut:]
    if rng.random() < 0.5:
        chosen = {k: v[int(rng.integers(len(v)))] for k, (_, v) in NEUTRAL.items()}

        def plain(m: re.Match) -> str:
            tag = m[2].lower()
            if 'data-x="drop"' in m[3]:
                return f"<{m[1]}div{m[3]}>"
            mark = "keep" if tag in ("article", "main") else "drop"
            return "</div>" if m[1] else f'<div {chosen[tag]} data-x="{mark}">'

        out = _SEMANTIC.sub(plain, out)
    return out


def labels(page: Page) -> np.ndarray | None:
    """1 for article nodes and what holds them, 0 for the rest; None if the page does not tell."""
    n = len(page.tag)
    state = np.zeros(n, dtype=np.int8)  # 1 inside the article, -1 inside boilerplate
    for i in range(n):
        up = state[page.parent[i]] if i else 0
        mark = page.attrs[i]
        if 'data-x="drop"' in mark or page.tag[i] in ("nav", "footer", "aside", "form", "header") and up <= 0:
            state[i] = -1
        elif up < 0 or page.tag[i] in INLINE or any(k in page.words[i] for k in (5, 6, 7)) and page.tag[i] not in ("article", "main"):
            state[i] = -1
        elif page.tag[i] in ("article", "main") or 'data-x="keep"' in mark:
            state[i] = 1
        else:
            state[i] = up
    if not (state > 0).any():
        return None
    good = state > 0
    for i in range(n - 1, 0, -1):
        if good[i]:
            good[page.parent[i]] = True
    return good.astype(np.int64)


def training_nodes(pages: DataFrame, max_pages: int, variants: int, seed: int, key: str, source: str) -> DataFrame:
    """``label, x`` of the nodes of at most ``max_pages`` pages, in several rewritings each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["html"].tolist()
            lines = [t for s in texts[:50] for _, t, _ in parse(s).blocks][:2000]
            for h, s in zip(frame["h"].tolist(), texts):
                rng = np.random.default_rng(abs(h) + seed)
                rows, marks = [], []
                for v in range(variants):
                    page = parse(s if v == 0 else rewritten(s, rng, lines))
                    y = labels(page)
                    if y is not None:
                        rows.append(features(page)[1:])
                        marks.append(y[1:])
                if rows:
                    yield pd.DataFrame({"label": np.concatenate(marks).astype(float), "x": list(np.concatenate(rows))})

    h = F.xxhash64(F.col(key), F.lit(seed))
    known = pages.where(F.col(source).rlike("(?i)<(article|main)\\b")).select(h.alias("h"), F.col(source).alias("html"))
    sample = known.orderBy("h", "html").limit(max_pages)  # a bounded sample of labelled rows
    return sample.mapInPandas(run, "label double, x array<double>")


def fit(
    pages: DataFrame, max_pages: int = 240, variants: int = 4, rounds: int = 10, depth: int = 5, seed: int = 5,
    key: str = "page_id", source: str = "html", folder: str | None = None,
) -> Trees | None:
    """Boosted trees from at most ``max_pages`` labelled pages; None where no page tells its article."""
    folder = folder or run_path(pages.sparkSession, "pages")
    nodes = written(training_nodes(pages, max_pages, variants, seed, key, source), f"{folder}/nodes")
    if nodes.select("label").distinct().count() < 2:
        return None
    data = nodes.select("label", array_to_vector("x").alias("features")).coalesce(1)
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.5, seed=seed, maxMemoryInMB=512)
    return read_trees(gbt.fit(data))


def main_text(pages_html: list[str | None], trees: Trees | None) -> list[str]:
    """Main text of each page; without trees all rendered text."""
    parsed = [parse(s or "") for s in pages_html]
    rows = [features(p) for p in parsed]
    chance = trees.probability(np.concatenate(rows)) if trees and rows else np.ones(sum(map(len, rows)))
    out, at = [], 0
    for page, x in zip(parsed, rows):
        kept = decode(page.parent, chance[at:at + len(x)])
        at += len(x)
        out.append(page.text(kept))
    return out


def extract(
    pages: DataFrame, trees: Trees | None, key: str = "page_id", url: str = "url", source: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    NULL or empty html: empty text.  Runs of text directly in the body are decided like elements; if no training
    page told its article, all rendered text is returned.  Very long pages are read whole.  Repeated rows and NULL
    ids are kept; columns other than the three named ones are not looked at; an empty table gives an empty table.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)  # bounded: rounds x 2**depth nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                texts = main_text(batch.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
