"""HTML extraction by a tree-structured graphical model.

A page's DOM is a tree of elements with text; each node is content or boilerplate. A logistic unary potential scores a node by
features of its own (tag, text, links, punctuation, class and id words, place), a pairwise potential for kinds of tags couples
it with its parent. Sum-product messages go up and then down the tree, level by level for all pages of a batch at once, and
give each node's content marginal; the same messages give the exact gradient of the likelihood in training.

Training pages are labelled by their own markup: nodes inside <article> or <main> are content, other nodes are not, and these
two tags themselves are no features, so that the model holds for pages without them.

Defined results: null html gives a null text; html without text, or without tags, gives an empty text or all of its text.
Unclosed and stray tags are taken as browsers do: <p>, <li>, <td>, <tr>, <option> close their like, a stray end tag is dropped,
a script or style without an end goes to the end of the page, and a tag that isn't closed with > is text. Pages of any length are
read whole; each row is extracted for itself, repeated ones alike. Ties can't occur: a node is content from the cutoff on. Columns
other than page_id and html aren't read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_id

OPEN = re.compile(r"<(?:!|(/?)([a-zA-Z][a-zA-Z0-9]*+))")
WITHIN = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("p div section article main header footer nav aside ul ol table tr h1 h2 h3 h4 h5 h6 pre blockquote figure form dl dd dt li td th title body html br hr".split())
INLINE = frozenset("b i em strong a span u s small sub sup code br font mark q abbr cite".split())
TAGS = {t: i for i, t in enumerate("#root html head title body div p b i a ul ol li nav header footer aside section h1 h2 h3 table tr td span form pre blockquote".split(), 1)}
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HASHED = 32
KINDS = 4


@dataclass(frozen=True)
class Params:
    train_pages: int = 400  # the bound of what the driver gathers
    rounds: int = 120
    l2: float = 1e-3
    cutoff: float = 0.5


@dataclass
class Tree:
    tag: list
    parent: list
    text: list
    attrs: list
    depth: list


def tokens(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, tag, attributes) of each tag; tag is empty for comments, declarations and raw elements, which are passed over.

    One pass: what is looked for and not there, as the end of a comment or of a script, is looked for once.
    """
    at, n = 0, len(html)
    none: set[str] = set()  # what doesn't come any more
    while m := OPEN.search(html, at):
        start, tag = m.start(), (m.group(2) or "").lower()
        if not tag:
            end = -1
            if html.startswith("<!--", start) and "-->" not in none:
                end = html.find("-->", start + 4)
                if end < 0:
                    none.add("-->")
                else:
                    end += 3
            if end < 0:
                end = html.find(">", start) + 1
                if not end:
                    return
            yield start, end, False, "", ""
            at = end
            continue
        if tag in RAW and not m.group(1) and tag not in none:
            close = RAW[tag].search(html, m.end())
            if close or tag in ("script", "style"):
                at = close.end() if close else n
                yield start, at, False, "", ""
                continue
            none.add(tag)
        end = WITHIN.match(html, m.end()).end()
        while end < n and html[end] != ">":  # a quote that isn't closed is the last of its kind, and a sign as others
            end = WITHIN.match(html, end + 1).end()
        if end >= n:
            return
        yield start, end + 1, bool(m.group(1)), tag, html[m.end() : end]
        at = end + 1


def parse(html: str) -> Tree:
    """Nodes in document order; node 0 is the root. text is a node's own text; a text between two children is a node (#text) of its own. Time is in proportion to the length of html."""
    t = Tree(["#root"], [-1], [""], [""], [0])
    stack, block = [0], [0]  # open nodes, and for each the place of the nearest one, it or before it, that isn't inline
    opened: Counter = Counter()

    def add(tag: str, attrs: str) -> int:
        t.tag.append(tag)
        t.parent.append(stack[-1])
        t.text.append("")
        t.attrs.append(attrs)
        t.depth.append(len(stack))
        return len(t.tag) - 1

    def words(s: str) -> None:
        s = " ".join(unescape(s).split())
        if s:
            t.text[add("#text", "")] = s

    def close(k: int) -> None:
        opened.subtract(t.tag[i] for i in stack[k:])
        del stack[k:], block[k:]

    at = 0
    for start, end, closing, tag, attrs in tokens(html):
        if start > at:
            words(html[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if tag not in VOID and opened[tag] > 0:
                k = len(stack) - 1
                while t.tag[stack[k]] != tag:
                    k -= 1
                close(k)
            continue
        k = block[-1]
        if k and t.tag[stack[k]] in CLOSES.get(tag, ()):
            close(k)
        n = add(tag, attrs)
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(n)
            block.append(block[-1] if tag in INLINE else len(stack) - 1)
            opened[tag] += 1
    if at < len(html):
        words(html[at:])
    return t


def dimension() -> int:
    return len(TAGS) + 1 + HASHED + 14


def node_features(t: Tree) -> np.ndarray:
    n = len(t.tag)
    x = np.zeros((n, dimension()), np.float32)
    own = np.array([len(s) for s in t.text], np.float64)
    punct = np.array([sum(map(s.count, ".,;:!?")) for s in t.text], np.float64)
    word = np.array([s.count(" ") + 1 if s else 0 for s in t.text], np.float64)
    link = np.zeros(n)
    below, lb, pb, kids = own.copy(), np.zeros(n), punct.copy(), np.zeros(n)
    inside = np.zeros(n, bool)
    for i in range(1, n):
        inside[i] = inside[t.parent[i]] or t.tag[i] == "a"
        if inside[i]:
            link[i] = own[i]
    lb += link
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        below[p] += below[i]
        lb[p] += lb[i]
        pb[p] += pb[i]
        kids[p] += 1
    total = max(1.0, below[0])
    base = len(TAGS) + 1
    for i in range(n):
        tag = t.tag[t.parent[i]] if t.tag[i] == "#text" else t.tag[i]
        x[i, TAGS.get("div" if tag in ("article", "main") else tag, 0)] = 1
        for m in ATTR.finditer(t.attrs[i]):
            for w in re.findall(r"[a-z]+", (m.group(1) or m.group(2) or m.group(3) or "").lower()):
                x[i, base + zlib.crc32(w.encode()) % HASHED] = 1
    f = base + HASHED
    up = np.maximum(np.array(t.parent), 0)
    x[:, f + 0] = np.log1p(own) / 4
    x[:, f + 1] = np.log1p(below) / 6
    x[:, f + 2] = lb / np.maximum(below, 1)
    x[:, f + 3] = np.minimum(pb / np.maximum(below, 1) * 20, 3)
    x[:, f + 4] = below / total
    x[:, f + 5] = np.log1p(kids) / 3
    x[:, f + 6] = np.array(t.depth) / 10
    x[:, f + 7] = np.arange(n) / n
    x[:, f + 8] = [s == "#text" for s in t.tag]
    x[:, f + 9] = np.log1p(below[up]) / 6
    x[:, f + 10] = (lb / np.maximum(below, 1))[up]
    x[:, f + 11] = np.log1p(word) / 4
    x[:, f + 12] = below == 0
    x[:, f + 13] = 1
    return x


def edge_kinds(t: Tree) -> np.ndarray:
    """What a node's pairwise potential depends on: text below its element, inline, block in block, other."""
    out = np.zeros(len(t.tag), np.int64)
    for i, tag in enumerate(t.tag):
        out[i] = 0 if tag == "#text" else 1 if tag in INLINE else 2 if tag in BLOCKS else 3
    return out


@dataclass
class Forest:
    """The nodes of many trees, by level."""

    x: np.ndarray
    parent: np.ndarray
    kind: np.ndarray
    levels: list

    @staticmethod
    def of(trees: list[Tree]) -> Forest:
        base = np.cumsum([0] + [len(t.tag) for t in trees])
        parent = np.concatenate([np.array(t.parent) + np.where(np.array(t.parent) >= 0, b, 0) for t, b in zip(trees, base, strict=False)])
        depth = np.concatenate([np.array(t.depth) for t in trees])
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(1, depth.max() + 1))
        return Forest(np.concatenate([node_features(t) for t in trees]), parent, np.concatenate([edge_kinds(t) for t in trees]), np.split(order, cut))


def lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(f: Forest, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content marginal of each node, (n, 2, 2) pairwise marginals of parent and node, and the log-partition of each tree."""
    n = len(f.x)
    un = np.zeros((n, 2))
    un[:, 1] = f.x @ w
    psi = pair[f.kind]  # n, parent's state, own state
    inward, up = un.copy(), np.zeros((n, 2))
    for level in reversed(f.levels[1:]):
        m = lse(psi[level, :, 0] + inward[level, None, 0], psi[level, :, 1] + inward[level, None, 1])
        up[level] = m
        for s in (0, 1):
            inward[:, s] += np.bincount(f.parent[level], m[:, s], minlength=n)
    belief = inward.copy()
    joint = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        p = f.parent[level]
        cavity = belief[p] - up[level]
        j = cavity[:, :, None] + psi[level] + inward[level][:, None, :]
        joint[level] = j
        belief[level] = lse(j[:, 0, :], j[:, 1, :])
    z = lse(belief[:, 0], belief[:, 1])
    joint = np.exp(joint - z[:, None, None])
    joint[f.levels[0]] = 0
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint, z[f.levels[0]]


def labels(t: Tree) -> np.ndarray:
    y = np.zeros(len(t.tag), np.int64)
    for i in range(1, len(t.tag)):
        y[i] = y[t.parent[i]] or t.tag[i] in ("article", "main")
    return y


@dataclass
class Model:
    w: np.ndarray
    pair: np.ndarray
    cutoff: float


def fit(pages: list[str], params: Params = Params()) -> Model:
    """Maximum likelihood by gradient steps with momentum per coordinate; without pages every node is content."""
    d = dimension()
    trees = [parse(p) for p in pages]
    trees = [t for t in trees if labels(t).any()]
    if not trees:
        w = np.zeros(d)
        w[-1] = 5
        return Model(w, np.zeros((KINDS, 2, 2)), params.cutoff)
    f = Forest.of(trees)
    y = np.concatenate([labels(t) for t in trees])
    child = np.concatenate(f.levels[1:]) if len(f.levels) > 1 else np.zeros(0, np.int64)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), 1)
    want = f.x.T @ y.astype(float)
    theta = np.zeros(d + KINDS * 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = 1 / len(y)
    for k in range(1, params.rounds + 1):
        w, pair = theta[:d], theta[d:].reshape(KINDS, 2, 2)
        p, joint, _ = marginals(f, w, pair)
        have = np.zeros((KINDS, 2, 2))
        np.add.at(have, f.kind[child], joint[child])
        g = np.concatenate([(want - f.x.T @ p) * scale, ((seen - have) * scale).ravel()]) - params.l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(theta[:d], theta[d:].reshape(KINDS, 2, 2), params.cutoff)


def text_of(t: Tree, keep: np.ndarray) -> str:
    """The kept text nodes; a line ends where a block does."""
    out: list[str] = []
    last = None
    for i, tag in enumerate(t.tag):
        if tag == "br":
            last = None
        if tag != "#text" or not keep[i]:
            continue
        b = t.parent[i]
        while b > 0 and t.tag[b] not in BLOCKS:
            b = t.parent[b]
        if out and b == last:
            out[-1] += " " + t.text[i]
        else:
            out.append(t.text[i])
        last = b
    return "\n".join(out)


def extract(pages: list, model: Model) -> tuple[list, np.ndarray, np.ndarray]:
    """Texts, number of text nodes and of those kept, of each page."""
    texts, nodes, kept = [None] * len(pages), np.zeros(len(pages), np.int64), np.zeros(len(pages), np.int64)
    rows = [i for i, p in enumerate(pages) if isinstance(p, str)]
    k = 0
    while k < len(rows):
        part, size = [], 0
        while k < len(rows) and (not part or size + len(pages[rows[k]]) < 1_000_000):
            size += len(pages[rows[k]])
            part.append(rows[k])
            k += 1
        trees = [parse(pages[i]) for i in part]
        f = Forest.of(trees)
        p, _, _ = marginals(f, model.w, model.pair)
        at = 0
        for i, t in zip(part, trees, strict=True):
            keep = p[at : at + len(t.tag)] >= model.cutoff
            at += len(t.tag)
            own = np.array([s == "#text" for s in t.tag])
            texts[i], nodes[i], kept[i] = text_of(t, keep), own.sum(), (own & keep).sum()
    return texts, nodes, kept


def train(pages: DataFrame, params: Params = Params(), id_col: str = "page_id", html_col: str = "html") -> Model:
    """Fits on at most params.train_pages pages, taken by the hash of their ids."""
    rows = pages.select(F.col(id_col).alias("i")).where("i is not null").distinct().orderBy(F.xxhash64("i"), "i").limit(params.train_pages)
    html = pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("h")).where("h is not null").join(F.broadcast(rows), "i", "left_semi")
    return fit([r["h"] for r in html.orderBy("i", "h").collect()], params)


def extracted(pages: DataFrame, params: Params = Params(), model: Model | None = None) -> DataFrame:
    """page_id, text, text_nodes, kept_nodes for each row of pages."""
    model = model or train(pages, params)

    @F.pandas_udf("text string, text_nodes bigint, kept_nodes bigint")
    def run(html: pd.Series) -> pd.DataFrame:
        t, n, k = extract(html.tolist(), model)
        return pd.DataFrame({"text": t, "text_nodes": n, "kept_nodes": k})

    d = pages.select(whole_id("page_id").alias("page_id"), run("html").alias("r"))
    return d.select("page_id", "r.text", "r.text_nodes", "r.kept_nodes")


