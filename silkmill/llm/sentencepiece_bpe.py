"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut into words at its white space marks, across which no piece of the model reaches. All distinct words of a batch
are merged together: their symbols lie in one flat array; each round finds the least pair rank of every word, merges all
leftmost non-overlapping pairs of that rank, and compacts the arrays, until no word has a pair left. Where a merge would
make a pair that ranks no later than itself, only the leftmost pair of that word merges in that round, so that results equal
those of merging one pair at a time.

The model's file is a parameter; the driver reads it and ships the pieces. Models must be BPE with byte fallback, without
normalization rules and with a white space mark put in front, as the public 32k one is.

Defined results: a null text has null ids and counts; an empty text has no ids. Characters that aren't in the vocabulary become
bytes. The mark U+2581 itself decodes to a space, as in the reference library, and round_trip is then false.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, whole_id

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE = np.int32(1 << 30)
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    _made: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"pieces": self.pieces, "scores": self.scores, "byte_ids": self.byte_ids, "_made": {}}

    def tables(self):
        """Characters to ids; sorted pair keys with merged id and rank; bytes of each piece, flat."""
        if not self._made:
            special = set(self.byte_ids) | {i for i, p in enumerate(self.pieces) if i < 3}
            ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
            order = {s: k for k, s in enumerate(sorted({self.scores[i] for i in ids.values()}, reverse=True))}
            pairs = {}
            for p, i in ids.items():
                for k in range(1, len(p)):
                    a, b = ids.get(p[:k]), ids.get(p[k:])
                    if a is not None and b is not None:
                        pairs[a << 32 | b] = (i, order[self.scores[i]])
            pairs[-1] = (-1, int(NONE))  # index 0: an empty place
            keys = np.array(sorted(pairs), np.int64)
            merged = np.array([pairs[k][0] for k in keys.tolist()], np.int32)
            rank = np.array([pairs[k][1] for k in keys.tolist()], np.int32)
            places, rest = [], np.arange(1, len(keys))
            while len(rest):  # keys that collide in one table go to the next one
                place = np.zeros(1 << 20, np.int32)
                at = _slots(keys[rest], len(places))
                place[at] = rest
                places.append(place)
                rest = rest[place[at] != rest]
            chars = np.full(0x110000, -1, np.int32)
            for p, i in ids.items():
                if len(p) == 1:
                    chars[ord(p)] = i
            raw = [b"" if i < 3 else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
            for b, i in enumerate(self.byte_ids):
                raw[i] = bytes([b])
            size = np.array([len(r) for r in raw], np.int64)
            self._made = {"chars": chars, "places": places, "keys": keys, "merged": merged, "rank": rank, "raw": np.frombuffer(b"".join(raw), np.uint8), "size": size, "start": np.cumsum(size) - size, "cache": {}}
        return self._made


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    return Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def _slots(key: np.ndarray, k: int) -> np.ndarray:
    """The k-th place at which a pair key may lie."""
    with np.errstate(over="ignore"):
        return (key.view(np.uint64) * SEEDS[k] >> np.uint64(44)).astype(np.int64)


def _look(a: np.ndarray, b: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged id of symbols a with b."""
    key = a << 32 | b
    rank, to = np.full(len(key), NONE, np.int32), np.full(len(key), -1, np.int32)
    left = np.flatnonzero((a >= 0) & (b >= 0))
    for k, place in enumerate(t["places"]):
        kk = key[left]
        j = place[_slots(kk, k)]
        hit = t["keys"][j] == kk
        at = left[hit]
        rank[at], to[at] = t["rank"][j[hit]], t["merged"][j[hit]]
        left = left[~hit & (j > 0)]  # an empty place: the key is in no later table either
        if not len(left):
            break
    return rank, to


def merge(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, flat, and how many each has."""
    t = vocabulary.tables()
    cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), n)
    sym = t["chars"][cp]
    done_sym, done_word, done_pos = [], [], []
    # unknown symbols keep their character, as a negative number, for the bytes
    sym = np.where(sym < 0, -1 - cp.astype(np.int64), sym).astype(np.int64)
    pos = np.arange(len(sym))
    last = np.append(word[1:] != word[:-1], True) if len(sym) else np.zeros(0, bool)
    rank, to = _look(sym, np.where(last, -1, np.append(sym[1:], -1)), t)
    while len(sym):
        starts = np.flatnonzero(np.append(True, last[:-1]))
        least = np.minimum.reduceat(rank, starts)
        seg = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(sym))))
        if (least == NONE).any():  # words without a pair leave the arrays
            over = least[seg] == NONE
            done_sym.append(sym[over])
            done_word.append(word[over])
            done_pos.append(pos[over])
            keep = ~over
            sym, word, pos, rank, to, last, seg = sym[keep], word[keep], pos[keep], rank[keep], to[keep], last[keep], seg[keep]
            if not len(sym):
                break
            seg = np.cumsum(np.append(True, last[:-1])) - 1
            least = least[least != NONE]
        i = np.flatnonzero(rank == least[seg])
        if (np.diff(i) == 1).any():  # of overlapping pairs, every other one from the left
            first = np.append(True, np.diff(i) > 1)
            k = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
            i = i[k % 2 == 0]
        s_i = seg[i]
        again = np.append(False, s_i[1:] == s_i[:-1])
        if again.any():  # several merges in a word: only the first, if one makes a pair that comes no later
            several = i[again | np.append(again[1:], False)]
            made = to[several].astype(np.int64)
            end = last[several + 1]
            nxt = np.where(end, -1, sym[np.minimum(several + 2, len(sym) - 1)])
            begin = (several == 0) | last[several - 1]
            prev = np.where(begin, -1, sym[several - 1])
            after = np.append(np.where((several[1:] == several[:-1] + 2) & ~end[:-1], made[1:], -1), -1)
            bad = np.zeros(len(several), bool)
            for x, y in ((made, nxt), (prev, made), (made, after)):
                bad |= _look(x, y, t)[0] <= least[seg[several]]
            worse = np.zeros(len(least), bool)
            worse[seg[several[bad]]] = True
            i = i[~(again & worse[s_i])]
        sym[i] = to[i]
        last[i] = last[i + 1]
        keep = np.ones(len(sym), bool)
        keep[i + 1] = False
        sym, word, pos, rank, to, last = sym[keep], word[keep], pos[keep], rank[keep], to[keep], last[keep]
        at = i - np.arange(len(i))  # where the merged symbols are now
        touched = np.concatenate([at, at[(at > 0) & ~last[at - 1]] - 1])
        rank[touched], to[touched] = _look(sym[touched], np.where(last[touched], -1, sym[np.minimum(touched + 1, len(sym) - 1)]), t)
    if not done_sym:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    sym, word, pos = np.concatenate(done_sym), np.concatenate(done_word), np.concatenate(done_pos)
    order = np.argsort(pos, kind="stable")
    sym, word = sym[order], word[order]
    unknown = np.flatnonzero(sym < 0)
    if len(unknown):
        extra = [[vocabulary.byte_ids[b] for b in chr(-1 - int(sym[i])).encode("utf-8", "surrogatepass")] for i in unknown]
        size = np.ones(len(sym), np.int64)
        size[unknown] = [len(e) for e in extra]
        out = np.repeat(sym, size)
        at = np.cumsum(size) - size
        for i, e in zip(unknown, extra, strict=True):
            out[at[i] : at[i] + len(e)] = e
        sym, word = out, np.repeat(word, size)
    return sym.astype(np.int32), np.bincount(word, minlength=len(words))


def words_of(text: str) -> list[str]:
    """The words of a text without their leading mark; only runs of marks keep all but one."""
    if MARK in text or "  " in text or text[:1] == " ":
        return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
    return text.split(" ")


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one after the other."""
    out = np.ones(int(size.sum()), np.int64)
    some = size > 0
    s, n = start[some], size[some]
    if len(s):
        ends = np.cumsum(n)
        out[0] = s[0]
        out[ends[:-1]] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)


def encode(texts: list, vocabulary: Vocabulary, most_cached: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, and how many each has; null counts as empty."""
    t = vocabulary.tables()
    cache = t["cache"]
    if len(cache) > most_cached:
        cache.clear()
    if not cache:
        t["ids"], t["at"], t["n"] = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    split = [words_of(x) if x else [] for x in texts]
    new: dict[str, None] = {}
    for ws in split:
        new.update(dict.fromkeys(w for w in ws if w not in cache))
    if new:
        ids, n = merge([MARK + w for w in new], vocabulary)
        base = len(t["ids"])
        t["at"] = np.concatenate([t["at"], base + np.cumsum(n) - n])
        t["n"] = np.concatenate([t["n"], n])
        t["ids"] = np.concatenate([t["ids"], ids])
        cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
    total = sum(map(len, split))
    w = np.fromiter((cache[x] for ws in split for x in ws), np.int64, total)
    sizes = t["n"][w]
    ids = t["ids"][ragged(t["at"][w], sizes)] if total else np.zeros(0, np.int32)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
    c = np.concatenate([[0], np.cumsum(sizes)])
    return ids, np.diff(np.concatenate([[0], c[ends]]))


def decode(ids: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """The texts of flat ids; broken byte runs become U+FFFD."""
    t = vocabulary.tables()
    size = t["size"][ids]
    raw = t["raw"][ragged(t["start"][ids], size)].tobytes() if len(ids) else b""
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        s = raw[a:b].decode("utf-8", "replace")
        out.append(s[1:] if s[:1] == " " else s)
    return out


CACHED = 100_000  # words that a worker keeps with their ids: of other texts most words are new, and 400,000 were 80 MB


def encoded_batches(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """doc_id, ids, n_tokens, round_trip of batches of doc_id and text, in parts of bounded text, as a worker holds all words of a part at once."""
    for b in text_slices(batches, 1):
        texts = b.column(1).to_pylist()
        ids, n = encode(texts, vocabulary, CACHED)
        same = [None if x is None else x == y for x, y in zip(texts, decode(ids, n, vocabulary), strict=True)]
        null = pa.array([x is None for x in texts])
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
        lists = pc.if_else(null, pa.scalar(None, lists.type), lists) if any(x is None for x in texts) else lists
        counts = pc.if_else(null, pa.scalar(None, pa.int64()), pa.array(n.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), lists, counts, pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])


def encoded(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (decoding gives the text back) for each row of docs."""
    vocabulary = load(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded_batches(batches, vocabulary)

    d = docs.select(whole_id(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(each, "doc_id bigint, ids array<int>, n_tokens bigint, round_trip boolean")


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of a table of doc_id and ids; null ids give a null text."""
    vocabulary = load(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [x for x in b.column(1).to_pylist()]
            n = np.array([len(x or []) for x in lists], np.int64)
            flat = np.array([i for x in lists for i in x or []], np.int64)
            text = decode(flat, n, vocabulary)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t for x, t in zip(lists, text, strict=True)], pa.string())], ["doc_id", "text"])

    return tokens.select(whole_id("doc_id").alias("doc_id"), F.col("ids")).mapInArrow(each, "doc_id bigint, text string")
