"""Main text of web pages by gradient-boosted trees over DOM nodes.

A tolerant parser builds the node tree; every node gets features of its tag, its
attribute tokens, its depth, its subtree's density and its siblings; boosted trees
trained here give the odds that a node belongs to the article. A dynamic program
from the leaves up then picks the best labelling in which nothing below a dropped
node is kept, and the text of kept nodes is joined in page order.

The trees are trained on layouts rendered from a bounded sample of the pages' own
words, where the truth is known by construction.
"""

import html as htmllib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import table

# Bound of the training sample: pages whose words fill the training layouts, and layouts.
SAMPLE_PAGES = 120
LAYOUTS = 700

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template noscript head title iframe object svg math select textarea button canvas audio video datalist option".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCKS - frozenset("body html li dd dt tr td th tbody thead tfoot caption".split())
# A start tag on the left ends an open element on the right, up to the given containers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}

# Quotes delimit only right after '='; elsewhere, and where they are never closed, they are ordinary characters.
VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?=>)|[^\s>"'][^\s>]*+)"""
MARKUP = re.compile(rf"""<(?:!--(?:-?>|(?:.*?)(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{VALUE})?+)*+)(>)?)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"'>]|\Z)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Words by which page authors name parts of a page.
LEXICON = {
    "content": "content article post entry story main body text prose blog page news maincontent".split(),
    "menu": "nav navbar menu navigation breadcrumb breadcrumbs pagination pager tabs toc topbar skip links sitemap".split(),
    "edge": "header footer masthead banner foot head copyright legal bottom top imprint colophon".split(),
    "side": "sidebar aside side rail widget secondary complementary related recommended recommend more popular trending teaser tags".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted dfp outbrain taboola".split(),
    "comment": "comment comments reply replies respond disqus discussion thread reader feedback reactions".split(),
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay toast privacy disclaimer announcement message".split(),
    "form": "form login signup signin subscribe subscription newsletter search register contact share sharing social follow".split(),
}
GROUPS = list(LEXICON)
GROUP_OF = {word: i for i, (_, words) in enumerate(LEXICON.items()) for word in words}
TAG_GROUPS = [
    {"article", "main"}, {"nav", "menu", "search"}, {"header", "hgroup"}, {"footer", "address"}, {"aside", "dialog", "details"}, {"section", "div", "center"}, {"p", "pre", "blockquote"},
    {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "dir"}, {"li", "dt", "dd"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"form", "fieldset", "label", "input"},
    {"figure", "figcaption"}, {"body", "html"},
]
TAG_OF = {tag: i for i, tags in enumerate(TAG_GROUPS) for tag in tags}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    block: bool
    groups: tuple[int, ...] = ()
    hidden: bool = False
    children: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, runs): the tree in page order, node 0 its root, and (node, text) with references decoded.

    Unclosed, crossed and truncated markup is closed as browsers do in the common cases.
    ``<br>`` becomes a line feed. Text of elements that are never shown is left out.
    """
    nodes, runs = [Node("#root", -1, 0, True)], []
    stack, unseen, p_open = [0], 0, 0
    add_run, at, size = runs.append, 0, len(page)

    def pop_to(index: int):
        nonlocal unseen, p_open
        while len(stack) > index:
            tag = nodes[stack.pop()].tag
            unseen -= tag in UNSEEN
            p_open -= tag == "p"

    def text(piece: str):
        if piece and not unseen:
            add_run((stack[-1], htmllib.unescape(piece) if "&" in piece else piece))

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        found = MARKUP.match(page, begin)
        if found is None:  # a bare < is text
            text(page[at : begin + 1])
            at = begin + 1
            continue
        text(page[at:begin])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        if found[4] is None:  # the page ends inside a tag
            break
        tag = tag.lower()
        if found[1]:
            if tag == "p" and not p_open:
                continue
            for i in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[i]].tag
                if open_tag == tag:
                    pop_to(i)
                    break
                if open_tag in BLOCKS and tag not in BLOCKS:  # an inline end tag closes nothing outside its block
                    break
            continue
        if tag == "br":
            if not unseen:
                add_run((stack[-1], "\n"))
            continue
        if p_open and tag in CLOSES_P:
            pop_to(max(i for i in range(len(stack)) if nodes[stack[i]].tag == "p"))
        if tag in ENDS:
            ended, limit = ENDS[tag]
            last = 0
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag in limit:
                    break
                if nodes[stack[i]].tag in ended:
                    last = i
            if last:
                pop_to(last)
        block = tag in BLOCKS
        groups, hidden = _names(found[3]) if found[3] else ((), False)
        parent = stack[-1]
        # A plain inline element is part of its block; one with names is a node to decide on.
        if block or groups or hidden or tag in UNSEEN or tag == "label":
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, block, groups, hidden))
            nodes[parent].children.append(len(nodes) - 1)
            number = len(nodes) - 1
            if block and tag == "hr":
                continue
            if tag in VOID or found[3].endswith("/") and tag in ("svg", "math"):
                continue
            stack.append(number)
            unseen += tag in UNSEEN
            p_open += tag == "p"
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = end.start() if end else size
        elif tag == "a":
            nodes.append(Node("a", parent, nodes[parent].depth + 1, False))
            nodes[parent].children.append(len(nodes) - 1)
            stack.append(len(nodes) - 1)
        elif tag == "input":
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, False))
            nodes[parent].children.append(len(nodes) - 1)
    return nodes, runs


def _names(attributes: str) -> tuple[tuple[int, ...], bool]:
    """Lexicon groups named by class, id, role and the like; whether the element is hidden."""
    groups, hidden = [], False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
        else:
            groups += [GROUP_OF[w.lower()] for w in WORDS.findall(value) if w.lower() in GROUP_OF]
    return tuple(groups), hidden


WIDTH = len(TAG_GROUPS) * 2 + len(GROUPS) * 3 + 22


def features(pages: list[tuple[list[Node], list[tuple[int, str]]]]) -> np.ndarray:
    """One row per node of all pages: tag, parent's tag, named groups (own, ancestors', below), density, depth, siblings.

    Sums over subtrees run level by level for all pages at once.
    """
    starts = np.cumsum([0, *(len(nodes) for nodes, _ in pages)])
    n = int(starts[-1])
    parent, depth, tag_names, hidden, place, kin_count, before_at, after_at, text_at, text_size, text_marks, named_at, named_group = ([] for _ in range(13))
    for start, (nodes, runs) in zip(starts.tolist(), pages, strict=False):
        place_of, count_of, left, right = [0] * len(nodes), [1] * len(nodes), [-1] * len(nodes), [-1] * len(nodes)
        for i, x in enumerate(nodes):
            parent.append(start + max(0, x.parent))
            depth.append(x.depth)
            tag_names.append(x.tag)
            hidden.append(x.hidden)
            for g in x.groups:
                named_at.append(start + i)
                named_group.append(g)
            kids = x.children
            for k, c in enumerate(kids):
                place_of[c], count_of[c] = k, len(kids)
                if k:
                    left[c], right[kids[k - 1]] = start + kids[k - 1], start + c
        place += place_of
        kin_count += count_of
        before_at += left
        after_at += right
        for node, text in runs:
            if size := len(text.strip()):
                text_at.append(start + node)
                text_size.append(size)
                text_marks.append(text.count(".") + text.count(",") + text.count("?"))
    parent, depth, root = np.array(parent), np.array(depth), np.repeat(starts[:-1], np.diff(starts))
    tags = np.array([TAG_OF.get(t, -1) for t in tag_names])
    own = np.bincount(text_at, text_size, n) if text_at else np.zeros(n)
    named = np.zeros((n, len(GROUPS)))
    np.add.at(named, (np.array(named_at, int), np.array(named_group, int)), 1)
    sums = np.zeros((n, 7 + len(GROUPS)))
    sums[:, 0] = own
    sums[:, 1] = np.where(np.array([t == "a" for t in tag_names], bool), own, 0)
    sums[:, 2] = np.bincount(text_at, text_marks, n) if text_at else 0
    sums[:, 3] = [t == "li" for t in tag_names]
    sums[:, 4] = [t in ("input", "textarea", "select", "button", "label") for t in tag_names]
    sums[:, 5] = [t == "p" for t in tag_names]
    sums[:, 6] = 1
    sums[:, 7:] = named
    above, inside = np.zeros_like(named), np.zeros(n)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    for level in reversed(levels[1:]):
        np.add.at(sums, parent[level], sums[level])
    for level in levels[1:]:
        up = parent[level]
        above[level] = above[up] + named[up]
        inside[level] = np.maximum(inside[up], tags[up] == 0)
    total, linked, marks, items, inputs, paragraphs, below = sums[:, :7].T
    below = below - 1
    out = np.zeros((n, WIDTH), np.float32)
    known = tags >= 0
    out[np.flatnonzero(known), tags[known]] = 1
    up = tags[parent]
    out[np.flatnonzero(up >= 0), len(TAG_GROUPS) + up[up >= 0]] = 1
    at = 2 * len(TAG_GROUPS)
    for block in (named, above, sums[:, 7:] - named):
        out[:, at : at + len(GROUPS)] = np.minimum(block, 5)
        at += len(GROUPS)
    whole = np.maximum(1.0, total[root])
    place, count, before_at, after_at = map(np.array, (place, kin_count, before_at, after_at))
    before, after = np.where(before_at >= 0, total[before_at], 0), np.where(after_at >= 0, total[after_at], 0)
    kin = (before_at >= 0) & (tags == tags[before_at])
    columns = [
        depth, np.log1p(own), np.log1p(total), total / whole, linked / np.maximum(1, total), marks / np.maximum(1, total) * 100, items, inputs, paragraphs, np.log1p(below),
        total / (below + 1), place, count, place / count, np.log1p(before), np.log1p(after), kin, inside, (np.arange(n) - root) / np.repeat(np.diff(starts), np.diff(starts)),
        np.array(hidden, float), own / np.maximum(1, total), total[parent] / whole,
    ]
    out[:, at:] = np.array(columns).T
    return out


@dataclass
class Trees:
    """Boosted regression trees of fixed depth, stored level by level: feature, cut, leaf values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float
    depth: int

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        row = np.arange(len(x))
        for t in range(len(self.leaf)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, self.feature[t, at]] > self.cut[t, at])
            total += self.leaf[t, at - (2**self.depth - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, depth: int = 4, rate: float = 0.25) -> Trees:
    """Gradient boosting with logistic loss over feature histograms."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 24))) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(map(len, cuts)) + 1
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    mean = float((y * weight).sum() / weight.sum())
    bias = float(np.log(mean / (1 - mean)))
    odds = np.full(len(y), bias)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        grad, bend = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            slot = at - first
            best = np.full(2**level, 1e-6)
            for j in range(x.shape[1]):
                key = slot * width + bins[:, j]
                g = np.bincount(key, grad, 2**level * width).reshape(-1, width)
                h = np.bincount(key, bend, 2**level * width).reshape(-1, width)
                gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(2**level), top]
                for s in np.flatnonzero(value > best):
                    best[s] = value[s]
                    feature[t, first + s], cut[t, first + s] = j, cuts[j][top[s]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[t, at]] > cut[t, at])
        slot = at - inner
        leaf[t] = rate * np.bincount(slot, grad, leaves) / (np.bincount(slot, bend, leaves) + 1)
        odds += leaf[t, slot]
    return Trees(feature, cut, leaf, bias, depth)


def decode(nodes: list[Node], runs: list[tuple[int, str]], odds: np.ndarray) -> np.ndarray:
    """Best labelling without a kept node below a dropped one.

    Dropping a node drops its subtree. Gains are log-odds weighted by the text a node
    holds itself, so a wrapper's fate follows its content; leaves decide first.
    """
    weight = [0.3] * len(nodes)
    for node, text in runs:
        weight[node] += len(text.strip())
    best = (np.clip(odds, -6, 6) * (0.2 + np.log1p(weight))).tolist()
    best[0] = 0.0
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].hidden:
            best[i] = -1.0
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and best[i] > 0
    return np.array(kept)


def text_of(nodes: list[Node], runs: list[tuple[int, str]], kept: np.ndarray) -> str:
    """Kept text: inline pieces run on, white space inside a block is one space, blocks are joined by one."""
    home = list(range(len(nodes)))
    for i, x in enumerate(nodes):
        if not x.block:
            home[i] = home[x.parent]
    # A run ends its block's text only if a block starts or ends between it and the next one.
    pieces, last, last_node = [], None, 0
    for node, text in runs:
        here = home[node]
        if last is not None and (here != last or _block_between(nodes, last_node, node)):
            pieces.append(" ")
        last, last_node = here, node
        if kept[node]:
            pieces.append(text)
    return " ".join("".join(pieces).split())


def _block_between(nodes: list[Node], a: int, b: int) -> bool:
    """Whether a block element lies between two runs of the same block, in page order."""
    return any(nodes[i].block for i in range(a + 1, b)) if b > a else any(nodes[i].block for i in range(b + 1, a))


def _pool(pages: list[str]) -> tuple[list[str], list[str]]:
    """(paragraphs, short texts) of sampled pages; made-up ones if there are none."""
    long, short = [], []
    for page in pages:
        for _, text in parse(page)[1]:
            text = " ".join(text.split())
            (long if len(text) > 60 else short).append(text)
    long = [t for t in long if t] or ["Plain words make up this text, and they go on for a while. " * 3]
    short = [t for t in short if t] or ["Home", "About", "More"]
    return long, short


def layouts(pages: list[str], count: int = LAYOUTS, seed: int = 3) -> Iterator[tuple[list[Node], list[tuple[int, str]], np.ndarray]]:
    """Rendered training pages with the label of every node: 1 if it is or holds article text.

    Articles, menus, headers, footers, side columns, notices, adverts, forms and reader
    comments are put together with semantic tags, with named divs, or with bare ones.
    """
    rng = np.random.default_rng(seed)
    long, short = _pool(pages)
    pick = lambda options: options[rng.integers(len(options))]
    maybe = lambda p: rng.random() < p
    esc = htmllib.escape

    def named(group: str) -> str:
        word = pick(LEXICON[group])
        style = rng.integers(4)
        value = [word, f"{word}-{pick(['box', 'wrap', 'area', 'block', 'list'])}", f"site-{word}", f"{pick(['js', 'x', 'mod'])} {word}"][style]
        return f' {pick(["class", "id", "class"])}="{value}"'

    def words(low: int, high: int) -> str:
        text = pick(long).split()
        start = rng.integers(max(1, len(text) - high))
        return esc(" ".join(text[start : start + rng.integers(low, high + 1)]))

    def menu(links: int) -> str:
        items = "".join(f'<li><a href="/{i}">{esc(pick(short))[:30]}</a></li>' for i in range(links))
        return f"<ul>{items}</ul>" if maybe(0.8) else re.sub("</?li>", " ", items)

    def wrap(tag: str, group: str, inner: str, bare: float = 0.1) -> str:
        """An element of a part: by its own tag, by name, or (rarely) without either; marked for the labels."""
        if maybe(0.5):
            return f'<{tag} data-drop="1">{inner}</{tag}>' if maybe(0.6) else f'<{tag}{named(group)} data-drop="1">{inner}</{tag}>'
        return f'<div{"" if maybe(bare) else named(group)} data-drop="1">{inner}</div>'

    def paragraphs(n: int) -> str:
        out = []
        for _ in range(n):
            kind = rng.random()
            body = pick(long) if maybe(0.6) else words(6, 60)
            body = body if "&" in body else esc(body)
            if maybe(0.15):
                body = f'<b>{words(1, 5)}</b> {body} <a href="/x">{words(1, 4)}</a>'
            out.append(
                f"<p>{body}</p>" if kind < 0.7 else f"<h{pick([2, 3])}>{words(2, 8)}</h2>" if kind < 0.78 else f"<ul><li>{words(4, 25)}<li>{words(4, 25)}</ul>" if kind < 0.85
                else f"<blockquote>{body}</blockquote>" if kind < 0.9 else f"<div>{body}</div>" if kind < 0.94 else f"<p><b>{words(1, 20)}<br><p>" if kind < 0.97
                else f"<figure><img><figcaption>{words(4, 12)}</figcaption></figure>"
            )
            if maybe(0.05):
                out.append(advert())
        return "".join(out)

    def advert() -> str:
        return f'<{pick(["div", "aside", "section"])}{named("advert")} data-drop="1">{words(3, 20)}</div>'.replace("</div>", "</div></aside></section>")

    def comments() -> str:
        each = "".join(f'<{pick(["li", "div", "article"])}{named("comment") if maybe(0.7) else ""}><b>{esc(pick(short))[:20]}</b><p>{words(3, 40)}</p></li></div>' for _ in range(rng.integers(1, 7)))
        return f'<{pick(["section", "div", "ol"])}{named("comment")} data-drop="1"><h3>{words(1, 3)}</h3>{each}</section>'

    for _ in range(count):
        head = f"<title>{words(3, 9)}</title><style>p{{}}</style>"
        title = f"<h1>{words(3, 12)}</h1>"
        if maybe(0.3):
            title = f'<header>{title}{f"<p>{words(2, 8)}</p>" if maybe(0.5) else ""}</header>'
        body = title + (f"<p>{words(2, 12)}</p>" if maybe(0.2) else paragraphs(int(rng.integers(1, 14))))
        if maybe(0.15):
            body += wrap("footer", "side", menu(int(rng.integers(1, 5))), 0.0)
        article = pick(["<article>{}</article>", '<main><article class="post">{}</article></main>', "<div" + named("content") + ">{}</div>", "<main>{}</main>", "<section" + named("content") + ">{}</section>", "<div><div>{}</div></div>"]).format(body)
        parts = []
        if maybe(0.8):
            parts.append(wrap("nav", "menu", menu(int(rng.integers(2, 12)))))
        if maybe(0.5):
            parts.insert(int(rng.integers(2)) if parts else 0, wrap("header", "edge", f"<h1>{words(1, 4)}</h1>" * maybe(0.5) + (menu(3) if maybe(0.5) else f"<p>{words(2, 8)}</p>"), 0.0))
        if maybe(0.3):
            parts.append(wrap("div", "notice", f"<p>{words(5, 30)}</p>{'<button>OK</button>' * maybe(0.5)}", 0.0))
        if maybe(0.5):
            parts.append(advert())
        if maybe(0.3):
            parts.append(f'<form{named("form") if maybe(0.6) else ""} data-drop="1"><label>{words(1, 4)}</label><input><p>{words(2, 10)}</p></form>')
        if maybe(0.3):
            parts.append(wrap("aside", "side", f"<h3>{words(1, 4)}</h3>" + (menu(5) if maybe(0.6) else f"<p>{words(4, 25)}</p>"), 0.0))
        after = []
        if maybe(0.35):
            after.append(comments())
        if maybe(0.3):
            after.append(wrap("aside", "side", f"<h3>{words(1, 4)}</h3>" + (menu(5) if maybe(0.6) else f"<p>{words(4, 25)}</p>"), 0.0))
        if maybe(0.2):
            after.append(f'<form{named("form")} data-drop="1"><input>{words(2, 8)}</form>')
        if maybe(0.8):
            after.append(wrap("footer", "edge", f"&copy; {words(2, 12)}" if maybe(0.7) else f"<p>{words(3, 20)}</p>" + menu(3), 0.05))
        inner = "".join(parts) + article + "".join(after)
        if maybe(0.3):
            inner = f"<div{' class=wrapper' if maybe(0.5) else ''}>{inner}</div>"
        page = f"<html><head>{head}</head><body>{inner}</body></html>"
        if maybe(0.1):
            page = page[: int(rng.integers(len(page) // 2, len(page)))]
        dropped = parse_marked(page)
        nodes, runs = parse(page)
        yield nodes, runs, dropped


def parse_marked(page: str) -> np.ndarray:
    """Label of every node of a rendered page: 0 in marked parts and in elements never shown."""
    marked = page.replace(' data-drop="1"', ' hidden data-drop="1"')
    # Mark each dropped element by the hidden flag, on a copy whose tree is the same.
    nodes, _ = parse(marked.replace("<div hidden", "<div class=x hidden"))
    label = np.ones(len(nodes))
    for i, x in enumerate(nodes):
        label[i] = 0 if x.hidden or x.tag in UNSEEN or (i and label[x.parent] == 0) else 1
    return label


def train(pages: list[str]) -> Trees:
    made = [(nodes, runs, label) for nodes, runs, label in layouts(pages) if len(label) == len(nodes)]
    x = features([(nodes, runs) for nodes, runs, _ in made])
    text_size = x[:, 2 * len(TAG_GROUPS) + 3 * len(GROUPS) + 2]
    return boost(x, np.concatenate([label for _, _, label in made]), 0.3 + np.minimum(3, text_size) / 3)


def extract(pages: DataFrame, trees: Trees, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page; NULL and empty pages give an empty text."""

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = []
            for at in range(0, len(batch), 200):
                parsed = [parse(page or "") for page in batch.iloc[at : at + 200]]
                odds = trees.odds(features(parsed))
                begin = 0
                for nodes, runs in parsed:
                    texts.append(text_of(nodes, runs, decode(nodes, runs, odds[begin : begin + len(nodes)])))
                    begin += len(nodes)
            yield pd.Series(texts, dtype="object")

    return pages.withColumn(out, main_text(F.col(html)))


def training_pages(pages: DataFrame, count: int = SAMPLE_PAGES) -> list[str]:
    """The pages with the smallest hashes of their ids, at most ``count`` and 8,000 characters of each."""
    ranked = pages.where("html IS NOT NULL").select(F.xxhash64("page_id").alias("h"), "page_id", F.substring("html", 1, 8000).alias("html"))
    return [r.html for r in ranked.orderBy("h", "page_id", "html").limit(count).collect()]


def op4_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    made = extract(pages, train(training_pages(pages)))
    return made.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
