"""Wrapper induction: templates of pages from one site, by aligning their trees."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from .dom import Node, parse

SLOT = "#PCDATA"


@dataclass
class Tpl:
    tag: str
    kids: list = field(default_factory=list)  # of Tpl and str
    many: bool = False
    maybe: bool = False

    def shape(self) -> str:
        return f"{self.tag}({','.join(k.shape() if isinstance(k, Tpl) else '#' for k in self.kids)})"

    def dump(self) -> dict:
        return {"tag": self.tag, "kids": [k.dump() if isinstance(k, Tpl) else k for k in self.kids], "many": self.many, "maybe": self.maybe}

    @staticmethod
    def load(d: dict) -> Tpl:
        return Tpl(d["tag"], [Tpl.load(k) if isinstance(k, dict) else k for k in d["kids"]], d["many"], d["maybe"])


def tree(html: str) -> Tpl:
    def of(n: Node) -> Tpl:
        return Tpl(n.tag, [of(k) if isinstance(k, Node) else " ".join(k.split()) for k in n.kids if isinstance(k, Node) or k.strip()])

    return of(parse(html))


def fold(t: Tpl) -> Tpl:
    """Adjacent children of one shape become one that repeats."""
    out: list = []
    for k in t.kids:
        k = fold(k) if isinstance(k, Tpl) else k
        if isinstance(k, Tpl) and out and isinstance(out[-1], Tpl) and out[-1].shape() == k.shape():
            out[-1] = align(out[-1], k)
            out[-1].many = True
        else:
            out.append(k)
    return Tpl(t.tag, out, t.many, t.maybe)


def align(a: Tpl, b: Tpl) -> Tpl:
    """The template of both: differing texts are slots, children that only one has are optional; looks one ahead."""
    if a.tag != b.tag:
        return Tpl(SLOT)
    out: list = []
    i = j = 0

    def like(x, y) -> bool:
        return (isinstance(x, str) and isinstance(y, str)) or (isinstance(x, Tpl) and isinstance(y, Tpl) and x.tag == y.tag)

    def optional(x):
        return Tpl(x.tag, x.kids, x.many, True) if isinstance(x, Tpl) else Tpl(SLOT, [], False, True)

    while i < len(a.kids) or j < len(b.kids):
        x = a.kids[i] if i < len(a.kids) else None
        y = b.kids[j] if j < len(b.kids) else None
        if x is not None and y is not None and like(x, y):
            out.append((x if x == y else SLOT) if isinstance(x, str) else align(x, y))
            i, j = i + 1, j + 1
        elif y is None or (x is not None and i + 1 < len(a.kids) and like(a.kids[i + 1], y)):
            out.append(optional(x))
            i += 1
        elif x is None or (j + 1 < len(b.kids) and like(x, b.kids[j + 1])):
            out.append(optional(y))
            j += 1
        else:
            out.append(SLOT)
            i, j = i + 1, j + 1
    return Tpl(a.tag, out, a.many or b.many, a.maybe or b.maybe)


def added(t: Tpl | None, page: str) -> Tpl:
    """The template of one more page."""
    return fold(tree(page)) if t is None else align(t, fold(tree(page)))


def induce(pages: list[str]) -> Tpl | None:
    t = None
    for p in pages:
        t = added(t, p)
    return t


def extract(page: Tpl, t: Tpl) -> list[str]:
    """What fills the template's slots, in order."""
    out: list[str] = []
    k = 0
    for want in t.kids:
        if isinstance(want, str):
            if k < len(page.kids) and isinstance(page.kids[k], str):
                if want == SLOT:
                    out.append(page.kids[k])
                k += 1
            elif want == SLOT and k < len(page.kids):
                out += texts(page.kids[k])
                k += 1
            continue
        if want.tag == SLOT:
            if k < len(page.kids) and isinstance(page.kids[k], str):
                out.append(page.kids[k])
                k += 1
            continue
        while k < len(page.kids) and isinstance(page.kids[k], Tpl) and page.kids[k].tag == want.tag:
            out += extract(page.kids[k], want)
            k += 1
            if not want.many:
                break
    return out


def texts(t) -> list[str]:
    return [t] if isinstance(t, str) else [s for k in t.kids for s in texts(k)]


def dumps(t: Tpl | None) -> str | None:
    return None if t is None else json.dumps(t.dump(), ensure_ascii=False)


def loads(s: str) -> Tpl:
    return Tpl.load(json.loads(s))
