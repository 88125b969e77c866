"""Heading-aware segmentation of cleaned text under token budgets: four strategies.

Text is parsed to blocks, blocks gathered into sections by heading path, and sections packed: v1 fills chunks block by block with
an overlap, v2 merges small siblings, v3 packs siblings greedily and mends small chunks, v4 counts its context prefix too
and lifts lonely groups to their parents. Heading paths are tuples here; they become text only in results.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import accumulate, groupby

HEADING = re.compile(r"\[H(?P<level>[1-6])]\s+(?P<title>.*\S)\s*$")
TOKEN = re.compile(r"\w+|[^\s\w]")
ITEM = re.compile(r"\s*([*+-]|\d+[).])\s")
CODE = re.compile(r"[\[\]{}()<>;:=#]")
SENTENCE = re.compile(r"(?<=[!?.])\s+")
MARKS = re.compile(r"[^\s\w]")
BLANK = re.compile(r"\n\s*\n")
AUTHORS = set("author authors credits maintainers".split())
REFERENCES = set("bibliography|citations|further reading|publications|references|works cited".split("|"))
STRATEGIES = ("v1", "v2", "v3", "v4")
SEP = " > "
Path = tuple[str, ...]


_SEEN: dict[str, int] = {}  # counts of the page at hand


def estimate(text: str) -> int:
    n = _SEEN.get(text)
    if n is None:
        n = _SEEN[text] = len(TOKEN.findall(text))
    return n


def strict(text: str) -> int:
    """Stands in for a model's tokenizer: the estimate and two special tokens."""
    return estimate(text) + 2


#: Counts that are sums: no token goes over white space, so that a text has those of its pieces, and so many more.
SUMS: dict[Callable[[str], int], int] = {estimate: 0, strict: 2}


@dataclass(frozen=True)
class Config:
    target: int = 320
    cap: int = 420
    bundle_least: int = 8
    bundle_most: int = 15
    overlap: int = 1
    root: str = "README"
    v2_join: int = 220
    v2_cap: int = 240
    v2_small: int = 40
    soft: int = 200
    hard: int = 240
    least: int = 35
    repair_passes: int = 2
    refine_rounds: int = 1
    surface_rounds: int = 5
    count: Callable[[str], int] = strict


@dataclass(frozen=True)
class Block:
    text: str
    kind: str
    level: int = 0


@dataclass(frozen=True)
class Part:
    title: str
    text: str
    kind: str
    tokens: int
    source: Path = ()

    def shown(self, titled: bool) -> str:
        return (f"### {self.title}\n{self.text}" if titled and self.title.strip() else self.text).strip()


@dataclass(frozen=True)
class Chunk:
    path: Path
    parts: tuple[Part, ...]
    group: Path | None = None
    scopes: tuple[Path, ...] = ()

    @property
    def tokens(self) -> int:
        return sum(max(0, p.tokens) for p in self.parts)

    def body(self, titled: bool = False) -> str:
        return "\n\n".join(p.shown(titled) for p in self.parts).strip()


def kind_of(text: str) -> str:
    lines = [x for x in text.splitlines() if x.strip()]
    n = len(lines)
    if not n:
        return "prose"
    if sum(bool(ITEM.match(x)) for x in lines) >= max(1, int(0.6 * n)):
        return "list_item"
    if n > 1 and max(2, n // 2) <= sum("|" in x for x in lines):
        return "table_rows"
    if text.find("```") >= 0:
        return "code_block"
    if n > 1 and (any(x.startswith(("    ", "\t")) for x in lines) or sum(bool(CODE.search(x)) for x in lines) >= n // 2):
        return "code_block"
    return "prose"


def blocks_of(text: str) -> list[Block]:
    out = []
    for raw in (r.strip() for r in BLANK.split(text.strip())):
        if not raw:
            continue
        m = HEADING.match(raw)
        out.append(Block(m["title"], "heading", int(m["level"])) if m else Block(raw, kind_of(raw)))
    return out


def sections(blocks: list[Block], cfg: Config) -> Iterator[tuple[Path, list[Block]]]:
    top = (0, cfg.root)
    stack, held = [top], []
    for b in blocks:
        if b.kind != "heading":
            held.append(b)
            continue
        if held:
            yield tuple(t for _, t in stack), held
            held = []
        stack = [s for s in stack if s[0] < b.level] + [(b.level, b.text)]
    if held:
        yield tuple(t for _, t in stack), held


def parent(path: Path) -> Path:
    return path[:-1] if len(path) > 1 else path


def bundled(blocks: list[Block], cfg: Config) -> list[Block]:
    """Runs of list items as bundles of at most bundle_most, the last not too small."""
    out: list[Block] = []
    for listed, run in groupby(blocks, lambda b: b.kind == "list_item"):
        run = list(run)
        while listed and run:
            take = min(len(run), cfg.bundle_most)
            if 0 < len(run) - take < cfg.bundle_least:
                take = max(cfg.bundle_least, len(run) - cfg.bundle_least)
            out.append(Block("\n".join(b.text for b in run[:take]).strip(), "list_bundle"))
            run = run[take:]
        out += run
    return out


def resolved(kinds: set[str]) -> str:
    if len(kinds) == 1:
        k = next(iter(kinds))
        return "list_bundle" if k in ("list_item", "list_bundle") else k if k in ("code_block", "table_rows", "prose") else "mixed"
    return "mixed"


def summed(units: list[str], sep: str, cap: int) -> list[str]:
    """Units joined while the sum of their estimates is within the cap."""
    out: list[str] = []
    cur: list[str] = []
    have = 0
    for u in units:
        n = estimate(u)
        if cur and have + n > cap:
            out.append(sep.join(cur).strip())
            cur, have = [], 0
        cur.append(u)
        have += n
    if cur:
        out.append(sep.join(cur).strip())
    return [x for x in out if x]


def cut_block(b: Block, cap: int) -> list[Block]:
    if estimate(b.text) <= cap:
        return [b]
    if b.kind in ("code_block", "table_rows"):
        parts = summed([x for x in b.text.splitlines() if x.strip()], "\n", cap)
    else:
        s = [x.strip() for x in SENTENCE.split(b.text) if x.strip()]
        parts = summed(s, " ", cap) if len(s) > 1 else summed(b.text.split(), " ", cap)
    return [Block(p, b.kind) for p in parts] or [b]


def shown_path(path: Path, cfg: Config) -> str:
    p = path[1:] if path and path[0] == cfg.root else path
    return SEP.join(p)


def prefix_lines(context: str, label: str) -> str:
    return (f"Context: {context}\n" if context else "") + f"Type: {label}"


def v1(text: str, cfg: Config) -> list[dict]:
    out = []
    for path, held in sections(blocks_of(text), cfg):
        cur: list[Block] = []
        chunks: list[list[Block]] = []
        for b in (p for x in bundled(held, cfg) for p in cut_block(x, cfg.cap)):
            if cur and sum(estimate(c.text) for c in cur) + estimate(b.text) > cfg.target:
                chunks.append(cur)
                cur = cur[-cfg.overlap :] if cfg.overlap else []
            cur = [*cur, b]
        if cur:
            chunks.append(cur)
        for c in chunks:
            body = "\n\n".join(b.text for b in c).strip()
            kind = resolved({b.kind for b in c})
            emb = f"{prefix_lines(shown_path(path, cfg), kind)}\n\n{body}".strip()
            out.append({"heading_path": SEP.join(path), "merge_group_parent": None, "segment_type": kind, "segment_text": body, "embedding_text": emb, "token_estimate": estimate(emb), "char_count": len(emb)})
    return out


def combined(prefix: str, body: str) -> str:
    """A model's input: prefix, blank line, body."""
    return "\n\n".join(x for x in (prefix, body) if x).strip()


def type_label(kind: str, parts: tuple[Part, ...], path: Path, cfg: Config) -> str:
    titles = [t for t in ((p.title.strip() or (p.source[-1] if p.source else "")) for p in parts) if t] or ([path[-1] if path else cfg.root] if path else [])
    norm = [MARKS.sub("", " ".join(t.lower().split())).strip() for t in titles]
    if norm and all(t in AUTHORS for t in norm):
        return "authors"
    if norm and all(t in REFERENCES for t in norm):
        return "references"
    return "code block" if kind == "code_block" else kind


def v4_prefix(c: Chunk, cfg: Config) -> str:
    scopes = [s for s in (shown_path(p, cfg) for p in sorted(set(c.scopes), key=SEP.join)) if s]
    ctx = shown_path((c.group or c.path) if c.scopes else c.path, cfg)
    if c.scopes and not ctx and scopes:
        ctx = scopes[0]
    lines = [prefix_lines(ctx, type_label(resolved({p.kind for p in c.parts}), c.parts, c.path, cfg))]
    nested = [s for s in scopes if s != ctx]
    if nested:
        lines.append("Nested_scope: " + "; ".join(nested))
    titles = [p.title.strip() for p in c.parts if p.title.strip()] if len(c.parts) > 1 else []
    if len(titles) > 1:
        lines.append("Merged_sections: " + "; ".join(titles))
    return "\n".join(lines)


def v4_tokens(c: Chunk, cfg: Config) -> int:
    if cfg.count in SUMS:
        return SUMS[cfg.count] + estimate(v4_prefix(c, cfg)) + sum(estimate(p.text) for p in c.parts)
    return cfg.count(combined(v4_prefix(c, cfg), c.body()))


def units(text: str, cfg: Config, with_prefix: bool) -> list[Part]:
    out = []
    for path, held in sections(blocks_of(text), cfg):
        bs = bundled(held, cfg)
        body = "\n\n".join(b.text for b in bs).strip()
        if body:
            p = Part(path[-1] if path else cfg.root, body, resolved({b.kind for b in bs}), 0, path)
            label = "Type: " + type_label(p.kind, (), path, cfg)
            ctx = shown_path(path, cfg)
            n = cfg.count(combined(f"Context: {ctx}\n{label}" if ctx else label, body) if with_prefix else p.shown(True))
            out.append(replace(p, tokens=n))
    return out


def collapse_small(us: list[Part], cfg: Config) -> list[Chunk]:
    out: list[Chunk] = []
    open_: list[Part] = []

    def flush() -> None:
        if open_:
            out.append(Chunk(parent(open_[0].source), tuple(replace(p, source=()) for p in open_)))
            open_.clear()

    for u in us:
        if u.tokens >= cfg.v2_join:
            flush()
            out.append(Chunk(u.source, (replace(u, source=()),)))
        elif open_ and parent(open_[0].source) == parent(u.source) and sum(p.tokens for p in open_) + u.tokens <= cfg.v2_join:
            open_.append(u)
        elif open_ or u.tokens <= cfg.v2_small:
            flush()
            open_.append(u)
        else:
            out.append(Chunk(u.source, (replace(u, source=()),)))
    flush()
    return out


def pack_siblings(us: list[Part], cfg: Config) -> list[Chunk]:
    out: list[Chunk] = []
    open_: list[Part] = []

    def flush() -> None:
        if open_:
            group = parent(open_[0].source)
            out.append(Chunk(open_[0].source if len(open_) == 1 else group, tuple(open_), group))
            open_.clear()

    for u in us:
        if u.tokens >= cfg.hard:
            flush()
            out.append(Chunk(u.source, (u,), parent(u.source)))
            continue
        if open_ and not (parent(open_[0].source) == parent(u.source) and sum(p.tokens for p in open_) + u.tokens <= cfg.soft):
            flush()
        open_.append(u)
    flush()
    return out


def longest(n: int, fits: Callable[[int], bool]) -> int:
    """The largest k in 1..n that fits, by bisection; 1 where none does."""
    lo, hi, best = 1, n, 1
    while lo <= hi:
        mid = (lo + hi) // 2
        if fits(mid):
            best, lo = mid, mid + 1
        else:
            hi = mid - 1
    return best


def joined(us: list[str], sep: str, cap: int, count: Callable[[str], int]) -> list[str]:
    out: list[str] = []
    cur: list[str] = []
    have = more = SUMS.get(count)
    for u in us:
        if more is not None:
            have += estimate(u)
        if cur and (count(sep.join([*cur, u]).strip()) if more is None else have) > cap:
            out.append(sep.join(cur).strip())
            cur = [u]
            have = more if more is None else more + estimate(u)
        else:
            cur.append(u)
    if cur:
        out.append(sep.join(cur).strip())
    return [x for x in out if x]


def cut_text(text: str, kind: str, cap: int, count: Callable[[str], int]) -> list[str]:
    """Text in pieces within the cap: lines of code and tables; else paragraphs, sentences, words, characters."""
    if count(text) <= cap:
        return [text]
    if kind in ("code_block", "table_rows"):
        first = joined([x for x in text.splitlines() if x.strip()], "\n", cap, count)
        return [p for x in first for p in ([x] if count(x) <= cap else cut_text(x, "prose", cap, count))]
    for split, sep in ((BLANK, "\n\n"), (SENTENCE, " ")):
        us = [x.strip() for x in split.split(text) if x.strip()]
        if len(us) > 1:
            return [p for x in joined(us, sep, cap, count) for p in ([x] if count(x) <= cap else cut_text(x, kind, cap, count))]
    out: list[str] = []
    words = text.split()
    if count in SUMS:
        upto = list(accumulate(map(estimate, words)))
    at = 0
    while at < len(words):
        if count in SUMS:
            k = max(1, bisect_right(upto, cap - SUMS[count] + (upto[at - 1] if at else 0)) - at)
        else:
            k = longest(len(words) - at, lambda n, at=at: count(" ".join(words[at : at + n])) <= cap)
        piece, at = " ".join(words[at : at + k]), at + k
        while piece:
            if count(piece) <= cap:
                out.append(piece)
                break
            n = longest(len(piece), lambda n, p=piece: count(p[:n]) <= cap)
            if piece[:n].strip():
                out.append(piece[:n].strip())
            piece = piece[n:]
    return out


def cut_chunks(chunks: list[Chunk], cfg: Config, cap: int, with_prefix: bool) -> list[Chunk]:
    def size(c: Chunk) -> int:
        if with_prefix:
            return v4_tokens(c, cfg)
        return SUMS[cfg.count] + sum(estimate(p.shown(True)) for p in c.parts) if cfg.count in SUMS else cfg.count(c.body(True))

    def pieces(c: Chunk, p: Part) -> list[Chunk]:
        over = cfg.count(v4_prefix(replace(c, parts=(p,)), cfg)) if with_prefix else 0
        texts = cut_text(p.shown(not with_prefix), p.kind, max(1, cap - over), cfg.count)
        return [replace(c, parts=(Part("", t, p.kind, cfg.count(t), p.source),)) for t in texts]

    out: list[Chunk] = []
    for c in chunks:
        if size(c) <= cap:
            out.append(c)
        elif len(c.parts) == 1:
            out += pieces(c, c.parts[0])
        else:
            cur: tuple[Part, ...] = ()
            for p in c.parts:
                alone = size(replace(c, parts=(p,))) > cap
                if cur and (alone or size(replace(c, parts=(*cur, p))) > cap):
                    out.append(replace(c, parts=cur))
                    cur = ()
                if alone:
                    out += pieces(c, p)
                else:
                    cur = (*cur, p)
            if cur:
                out.append(replace(c, parts=cur))
    return out


def merged(a: Chunk, b: Chunk) -> Chunk:
    parts = a.parts + b.parts
    sources = {p.source for p in parts if p.source}
    path = next(iter(sources)) if len(sources) == 1 else a.group or b.group or a.path
    return Chunk(path, parts, a.group or b.group or parent(path), tuple(sorted({*a.scopes, *b.scopes}, key=SEP.join)))


def mended(chunks: list[Chunk], cfg: Config, with_prefix: bool) -> list[Chunk]:
    """Chunks under the least size joined to the one before, or after, of their group where that fits."""
    def fits(a: Chunk, b: Chunk) -> bool:
        return a.group == b.group and (v4_tokens(merged(a, b), cfg) if with_prefix else a.tokens + b.tokens) <= cfg.hard

    cs = list(chunks)
    for _ in range(max(1, cfg.repair_passes)):
        before, i = len(cs), 0
        while i < len(cs):
            if cs[i].tokens >= cfg.least:
                i += 1
            elif i and fits(cs[i - 1], cs[i]):
                cs[i - 1 : i + 1] = [merged(cs[i - 1], cs[i])]
                i -= 1
            elif i + 1 < len(cs) and fits(cs[i], cs[i + 1]):
                cs[i : i + 2] = [merged(cs[i], cs[i + 1])]
            else:
                i += 1
        if len(cs) == before:
            break
    return cs


def surfaced(cs: list[Chunk]) -> list[Chunk]:
    """Groups with no neighbour of their own move to the parent that a neighbour has."""
    out = []
    for i, c in enumerate(cs):
        near = [cs[j].group if 0 <= j < len(cs) else None for j in (i - 1, i + 1)]
        up = parent(c.group) if c.group else None
        if c.group and up != c.group and c.group not in near and up in near:
            c = replace(c, group=up, scopes=tuple(sorted({*c.scopes, c.group}, key=SEP.join)))
        out.append(c)
    return out


def consolidated(cs: list[Chunk], cfg: Config) -> list[Chunk]:
    out: list[Chunk] = []
    for c in cs:
        if out and out[-1].group is not None and out[-1].group == c.group and v4_tokens(m := merged(out[-1], c), cfg) <= cfg.hard:
            out[-1] = m
        else:
            out.append(c)
    return out


def _row(c: Chunk, emb: str, tokens: int, chars: int) -> dict:
    return {"heading_path": SEP.join(c.path), "merge_group_parent": SEP.join(c.group) if c.group else None, "segment_type": resolved({p.kind for p in c.parts}), "segment_text": c.body(), "embedding_text": emb, "token_estimate": tokens, "char_count": chars}


def v2(text: str, cfg: Config) -> list[dict]:
    cs = cut_chunks(collapse_small(units(text, cfg, False), cfg), cfg, cfg.v2_cap, False)
    return [_row(c, e := c.body(True), cfg.count(e), len(e)) for c in cs]


def _rounds(text: str, cfg: Config, with_prefix: bool) -> list[Chunk]:
    cs = pack_siblings(units(text, cfg, with_prefix), cfg)
    for _ in range(max(1, cfg.refine_rounds)):
        cs = mended(cut_chunks(cs, cfg, cfg.hard, with_prefix), cfg, with_prefix)
    return cut_chunks(cs, cfg, cfg.hard, with_prefix)


def v3(text: str, cfg: Config) -> list[dict]:
    return [_row(c, e := c.body(True), cfg.count(e), len(e)) for c in _rounds(text, cfg, False)]


def v4(text: str, cfg: Config) -> list[dict]:
    cs = _rounds(text, cfg, True)
    if cfg.surface_rounds <= 0:
        cs = consolidated(cs, cfg)
    for _ in range(cfg.surface_rounds):
        new = consolidated(surfaced(cs), cfg)
        if new == cs:
            break
        cs = new
    out = []
    for c in cs:
        p = v4_prefix(c, cfg)
        both = combined(p, c.body())
        out.append(_row(c, p, cfg.count(both), len(both)))
    return out


def segments(text: str | None, strategy: str = "v4", cfg: Config = Config()) -> list[dict]:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy}")
    _SEEN.clear()
    return {"v1": v1, "v2": v2, "v3": v3, "v4": v4}[strategy](text, cfg) if text and text.strip() else []


def sentence_chunks(text: str, most_words: int = 256, compat: bool = False) -> list[str]:
    """Sentences packed to at most so many words; compat gives an empty first chunk where the first sentence is too long."""
    out: list[str] = []
    cur: list[str] = []
    n = 0
    for s in SENTENCE.split(text):
        k = len(s.split())
        if n + k > most_words:
            if cur or compat:
                out.append(" ".join(cur))
            cur, n = [], 0
        cur.append(s)
        n += k
    if cur and (" ".join(cur).strip() or compat):
        out.append(" ".join(cur))
    return out
