"""A small DOM on the standard library's tokenizer, and what crawl and cleaning read from it."""

from __future__ import annotations

import html as htmllib
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urlsplit

from .urls import canonicalize

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LIKE = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"ul", "ol", "table", "div", "section", "article", "body", "blockquote", "nav"}
ENDS_P = set("p div ul ol li table h1 h2 h3 h4 h5 h6 pre blockquote section article nav header footer hr form".split())
EMITTED = (*(f"h{n}" for n in range(1, 7)), *"blockquote li p pre tr".split())
NESTED = {*EMITTED, "ul", "ol"}
WEAK = set("arxiv|code|demo|details|here|link|links|more|paper|project|read more|repo|repository|website".split("|"))
SPACES, AROUND, BLANKS = re.compile(r"[\t ]+"), re.compile(r" *\n *"), re.compile(r"\n{3,}")
OTHER, ENDED = re.compile("[^0-9a-z]+"), re.compile(r"[!?.]\s*$")
TOC = {"table of contents", "contents", "toc"}
IMAGES = tuple("." + x for x in "avif bmp gif heic ico jpeg jpg png svg tif tiff webp".split())
IMAGE_HOSTS = {f"{h}.githubusercontent.com" for h in ("camo", "user-images")}
SELECTORS = ("article.markdown-body[itemprop=text]", "article.markdown-body.entry-content", "article.markdown-body", "article")
CLIPBOARD = "data-snippet-clipboard-copy-content"
REDIRECT = re.compile(r"(?:location\.href|document\.location)\s*=\s*(['\"])(.+?)\1", re.I | re.S)


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    parent: Node | None = None
    kids: list = field(default_factory=list)  # of Node and str

    def walk(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.walk()

    def strings(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.strings()
            else:
                yield k

    def text(self, sep: str = " ") -> str:
        return sep.join(s for s in (x.strip() for x in self.strings()) if s)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def _close(self, tags: set, stops: set) -> None:
        n = self.at
        while n.parent is not None and n.tag not in stops:
            if n.tag in tags:
                self.at = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P:
            self._close({"p"}, STOPS | {"td", "th", "li"})
        if tag in LIKE and tag != "p":
            self._close(LIKE[tag], {"ul", "ol", "table"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def matches(n: Node, selector: str) -> bool:
    m = re.fullmatch(r"(\w+)((?:\.[\w-]+)*)(?:\[(\w+)=(\w+)\])?", selector)
    return bool(m) and n.tag == m.group(1) and all(c in n.classes() for c in m.group(2).split(".") if c) and (not m.group(3) or n.attrs.get(m.group(3)) == m.group(4))


def collapse(s: str) -> str:
    return " ".join(s.split())


def meta(root: Node) -> tuple[str | None, str | None]:
    """Title and description, null where empty."""
    title = next((n.text() for n in root.walk() if n.tag == "title"), "")
    desc = next((n.attrs.get("content", "") for n in root.walk() if n.tag == "meta" and n.attrs.get("name", "").lower() == "description"), "")
    return collapse(title) or None, desc.strip() or None


def _up(n: Node, levels: int) -> Node:
    for _ in range(levels):
        if n.parent is None or n.parent.tag in ("#root", "html"):
            break
        n = n.parent
    return n


def context(n: Node, anchor: str, title: str | None, desc: str | None, most: int = 800) -> str:
    """Topic tags and card description, a window of text about the anchor, title and description: collapsed and cut."""
    scope = n
    while scope is not None and scope.tag != "article":
        scope = scope.parent
    card = scope or _up(n, 4)
    tags = " ".join(collapse(x.text()) for x in card.walk() if x.tag == "a" and "topic-tag" in x.classes())[:400]
    about = next((collapse(x.text()) for x in card.walk() if x.tag == "p" and x.attrs.get("itemprop") == "description"), "")[:200]
    body = collapse(card.text())[:3000]
    at = body.find(anchor) if anchor else -1
    if at < 0 and anchor and len(anchor.split()[0]) > 1:
        at = body.find(anchor.split()[0])
    at = max(at, 0)
    window = body[max(0, at - 120) : at + len(anchor) + 120]
    return collapse(" ".join(x for x in (tags, about, window, title or "", desc or "") if x))[:most]


def links(html: str | None, base: str, hosts: tuple[str, ...] | None = None) -> list[tuple[int, str, str, str, str]]:
    """(position, kind, url, anchor, context) of hrefs in the body in order, then of onclick targets; hosts None lets all through."""
    if not html:
        return []
    root = parse(html)
    body = next((n for n in root.walk() if n.tag == "body"), root)
    title, desc = meta(root)
    found = [("href", n, n.attrs["href"]) for n in body.walk() if n.tag == "a" and n.attrs.get("href", "").strip()]
    for n in body.walk():
        m = REDIRECT.search(n.attrs.get("onclick", ""))
        if m and m.group(2).strip():
            found.append(("onclick", n, m.group(2).strip()))
    out = []
    for kind, n, raw in found:
        ok, url, _ = canonicalize(raw, base)
        if ok and (hosts is None or urlsplit(url).hostname in hosts):
            anchor = collapse(n.text())
            out.append((len(out), kind, url, anchor, context(n, anchor, title, desc)))
    return out


def images(html: str | None, base: str) -> list[tuple[int, str, str]]:
    out = []
    for n in parse(html).walk() if html else ():
        if n.tag == "img" and n.attrs.get("src", "").strip():
            ok, url, _ = canonicalize(n.attrs["src"], base)
            if ok:
                name = url.rsplit("/", 1)[-1].split("?")[0].split("#")[0]
                out.append((len(out), url, name[:255] if name.strip() else "image"))
    return out


def _squeeze(s: str) -> str:
    return AROUND.sub("\n", SPACES.sub(" ", s)).strip()


def _is_image(href: str) -> bool:
    try:
        u = urlsplit(href)
    except ValueError:
        return False
    return u.scheme in ("http", "https") and (u.path.lower().endswith(IMAGES) or u.netloc.lower() in IMAGE_HOSTS)


def anchor_text(words: str, target: str | None) -> str:
    """A link's label, with its target where the label says little."""
    label, href = _squeeze(words), (target or "").strip()
    if not href.startswith(("http://", "https://")) or _is_image(href):
        return label
    if not label:
        return href
    weak = label.lower() in WEAK or (len(label) <= 4 and not re.search(r"\s", label))
    return f"{label} ({href})" if weak else label


def _inline(n: Node) -> str:
    out = []
    for k in n.kids:
        if not isinstance(k, Node):
            out.append(k)
        elif k.tag == "br":
            out.append("\n")
        elif k.tag == "a":
            out.append(anchor_text(k.text(), k.attrs.get("href")))
        else:
            out.append(_inline(k))
    return "".join(out)


def _line(n: Node) -> str:
    if n.tag == "a":
        return anchor_text(n.text(), n.attrs.get("href"))
    return _squeeze(_inline(n).replace("\n", " "))


def _noise(n: Node) -> bool:
    return n.tag in ("script", "style", "noscript", "svg", "img") or (n.tag == "a" and "anchor" in n.classes() and not n.text() and not n.attrs.get("title"))


def strip_noise(n: Node) -> None:
    n.kids = [k for k in n.kids if not (isinstance(k, Node) and _noise(k))]
    for k in n.kids:
        if isinstance(k, Node):
            strip_noise(k)


def _copied(n: Node | None) -> str | None:
    while n is not None:
        s = htmllib.unescape(n.attrs.get(CLIPBOARD, "")).strip()
        if s:
            return s
        n = n.parent
    return None


def blocks(root: Node, compat: bool = False) -> list[tuple[str, int | None, str]]:
    """(tag, heading level, text) of leaf blocks in order. compat looks at direct children only, and so emits a block around a wrapped one twice."""
    out = []
    for n in root.walk():
        if n.tag not in EMITTED:
            continue
        below = (k for k in n.kids if isinstance(k, Node)) if compat else n.walk()
        if any(k.tag in NESTED for k in below):
            continue
        level = None
        if n.tag == "tr":
            s = " | ".join(t for t in (_line(k) for k in n.kids if isinstance(k, Node) and k.tag in ("td", "th")) if t).strip()
        elif n.tag == "pre":
            s = _copied(n) or n.text("\n")
        else:
            s = _line(n)
            level = int(n.tag[1]) if n.tag[0] == "h" else None
        if s:
            out.append((n.tag, level, s))
    return out


def plain(s: str) -> str:
    return OTHER.sub(" ", s.lower()).strip()


def without_toc(bs: list) -> list:
    """Blocks without tables of contents: their heading and the list items and short lines after it."""
    out, skipping = [], False
    for b in bs:
        tag, level, s = b
        p = plain(s)
        if p in TOC:
            skipping = True
            continue
        entry = bool(p) and len(s) <= 160 and len(p.split()) <= 16 and "http" not in p and not ENDED.search(s)
        if skipping and level is None and (tag == "li" or entry):
            continue
        skipping = False
        out.append(b)
    return out


def fenced(s: str) -> str:
    s = s.strip()
    ticks = "`" * max(3, 1 + max((len(m) for m in re.findall("`+", s)), default=0))
    return f"{ticks}\n{s}\n{ticks}"


def root_of(doc: Node, selectors: tuple[str, ...]) -> Node | None:
    for s in selectors:
        for n in doc.walk():
            if matches(n, s):
                return n
    return None


def cleaned(html: str | None, selectors: tuple[str, ...] = SELECTORS, compat: bool = False) -> str | None:
    """The text of a page's main part with heading marks, null where there is none."""
    if not html or not html.strip():
        return None
    root = root_of(parse(html), selectors)
    if root is None:
        return None
    strip_noise(root)
    parts = [f"[H{level}] {s}" if level else fenced(s) if tag == "pre" else s for tag, level, s in without_toc(blocks(root, compat))]
    return BLANKS.sub("\n\n", "\n\n".join(parts).strip()) or None
