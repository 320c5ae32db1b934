"""Segmentation lattices over an existing subword vocabulary, built with numpy for many units of text at once.

The vocabulary's own scores are merge ranks; a piece of rank r weighs 1 / (r + 2), normalised over the vocabulary, which
makes them unigram log-probabilities. Pieces hold blanks at their start only, or are runs of blanks, so no piece crosses
the border of units that each are a run of blanks and what follows it up to the next blank or line break, and a text's
lattice is the product of its units' lattices. A character that no piece covers is spelt by the vocabulary's byte pieces.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)


def chained(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hash of a string from that of the string without its last character, and that character."""
    h = (h + c + np.uint64(1)) * STEP
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


@dataclass
class Vocabulary:
    """Pieces (with plain blanks), log weights, byte pieces, and a hash table of all prefixes of pieces."""

    pieces: list[bytes]
    log_p: np.ndarray
    byte_ids: np.ndarray
    byte_log_p: float
    keys: np.ndarray
    entry: np.ndarray
    longest: int
    log2: int


def load(path: str) -> Vocabulary:
    """Reads a sentencepiece model file (on the driver; workers get the arrays, whose size the vocabulary bounds)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    text: dict[str, int] = {}
    byte_ids = np.full(256, -1)
    rank = np.full(size, float(size))
    pieces = [b""] * size
    for i in range(size):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            pieces[i] = bytes([int(p[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            plain = p.replace("▁", " ")
            if plain and " " not in plain.lstrip(" "):
                text[plain] = i
                rank[i] = min(size, -sp.get_score(i))
                pieces[i] = plain.encode()
    weight = 1 / (rank + 2)
    log_p = np.log(weight / weight.sum())
    prefixes = {plain[:n]: -1 for plain in text for n in range(1, len(plain) + 1)} | text
    log2 = int(np.ceil(np.log2(len(prefixes) * 2.5)))
    keys, entry = np.zeros(1 << log2, np.uint64), np.full(1 << log2, -2, np.int32)
    hashes = {"": 0}
    by_length = sorted(prefixes, key=len)
    for _, group in itertools.groupby(by_length, len):
        same = list(group)
        before = np.array([hashes[s[:-1]] for s in same], np.uint64)
        for s, h in zip(same, chained(before, np.array([ord(s[-1]) for s in same], np.uint64)).tolist(), strict=True):
            hashes[s] = h
    for s, i in prefixes.items():
        at = hashes[s] >> (64 - log2)
        while entry[at] != -2:
            at = (at + 1) & ((1 << log2) - 1)
        keys[at], entry[at] = hashes[s], i
    return Vocabulary(pieces, log_p, byte_ids, float(log_p.min()), keys, entry, max(map(len, text)), log2)


def shared(spark, v: Vocabulary):
    """A function that gives the vocabulary on the workers. Plain arrays are broadcast, so workers need no package."""
    sent = spark.sparkContext.broadcast(vars(v))
    return lambda: Vocabulary(**sent.value)


def looked_up(v: Vocabulary, h: np.ndarray) -> np.ndarray:
    """The piece id of each hash, -1 for a prefix that is no piece, -2 for neither."""
    at = (h >> np.uint64(64 - v.log2)).astype(np.int64)
    out = v.entry[at]
    more = np.flatnonzero((out != -2) & (v.keys[at] != h))
    at = at[more]
    while len(more):
        at = (at + 1) & ((1 << v.log2) - 1)
        got = v.entry[at]
        out[more] = got
        keep = (got != -2) & (v.keys[at] != h[more])
        more, at = more[keep], at[keep]
    return out


class Lattice:
    """The lattices of distinct, non-empty units (``starts`` and ``sizes`` of them in the code points ``points``). Nodes
    are numbered by place, then unit (units by falling length), so that edges sorted by their end are also in the order
    of the forward recursion. Every number of a unit depends on that unit alone, to the last bit.

    total: log marginal of each unit; final: its last node; place: each node's place in its unit; edges (by end node):
    src, piece (below 0: -1 - code point, spelt in bytes), prob (given the end node, under the posterior over all
    segmentations); cum: prob cumulated over the edges of a node; first: first edge of each node.
    """

    def __init__(self, v: Vocabulary, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        points, starts, sizes = points.astype(np.int64), starts[order], sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        count = len(sizes) - np.cumsum(np.bincount(sizes, minlength=longest + 1))[:longest]  # units longer than each place
        nodes_at = np.concatenate([[len(sizes)], count])
        off = np.concatenate([[0], np.cumsum(nodes_at)]).astype(np.int32)  # a batch has fewer than 2**31 nodes and edges
        place = np.repeat(np.arange(longest, dtype=np.int32), count)
        unit = np.arange(len(place), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
        chars = points[(char_at := starts[unit] + place)].astype(np.uint64)
        room = sizes[unit] - place  # characters from here to the unit's end
        next_char = np.append(points, 0).astype(np.uint64)
        live = np.arange(len(place), dtype=np.int32)
        h = np.zeros(len(place), np.uint64)
        covered = np.zeros(len(place), bool)
        src, dst, piece, lp = [], [], [], []
        for n in range(1, v.longest + 1):
            h = chained(h, chars if n == 1 else next_char[char_at[live] + (n - 1)])
            got = looked_up(v, h)
            hit = np.flatnonzero(got >= 0)
            where, ids = live[hit], got[hit]
            if n == 1:
                covered[where] = True
            at, r = place[where], unit[where]
            src.append(off[at] + r)
            dst.append(off[at + n] + r)
            piece.append(ids)
            lp.append(v.log_p[ids])
            go = np.flatnonzero((got > -2) & (room[live] > n))
            live, h = live[go], h[go]
            if not len(live):
                break
        # Longer pieces first among the edges of a node: they are the likely ones.
        src.reverse(), dst.reverse(), piece.reverse(), lp.reverse()
        bare = np.flatnonzero(~covered)
        cp = points[char_at[bare]].astype(np.int32)
        src.append(off[place[bare]] + unit[bare])
        dst.append(off[place[bare] + 1] + unit[bare])
        piece.append(-1 - cp)
        lp.append((1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)) * v.byte_log_p)
        dst = np.concatenate(dst)
        by_end = np.argsort(dst, kind="stable")
        self.dst, self.src = dst[by_end], np.concatenate(src)[by_end]
        self.piece = np.concatenate(piece)[by_end]
        w = np.concatenate(lp)[by_end]
        n_nodes = int(off[-1])
        self.first = np.append(0, np.cumsum(np.bincount(self.dst, minlength=n_nodes))).astype(np.int32)
        alpha = np.zeros(n_nodes)
        self.prob = np.empty(len(w))
        for j in range(1, longest + 1):
            lo, hi = self.first[off[j]], self.first[off[j + 1]]
            val = alpha[self.src[lo:hi]] + w[lo:hi]
            heads = self.first[off[j] : off[j + 1]] - lo
            top = np.maximum.reduceat(val, heads)
            k = self.dst[lo:hi] - off[j]
            e = np.exp(val - top[k])
            s = np.add.reduceat(e, heads)
            alpha[off[j] : off[j + 1]] = top + np.log(s)
            self.prob[lo:hi] = e / s[k]
        self.cum = self.prob.copy()
        width = np.diff(self.first)
        for n in range(1, int(width.max(initial=0))):
            at = self.first[:-1][width > n] + n
            self.cum[at] += self.cum[at - 1]
        self.cum[self.first[1:][width > 0] - 1] = 1.0
        self.place = np.repeat(np.arange(longest + 1, dtype=np.int32), nodes_at)
        self.n_start = len(sizes)
        self.final = np.empty(len(sizes), np.int64)
        self.final[order] = off[sizes] + np.arange(len(sizes))
        self.total = alpha[self.final]

    @classmethod
    def of(cls, v: Vocabulary, units: list[str]) -> Lattice:
        sizes = np.array([len(u) for u in units], np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        return cls(v, points, np.cumsum(sizes) - sizes, sizes)


POWERS = [np.ones(1, np.uint64)] * 2  # of an odd number and of its inverse modulo 2**64; they grow with the largest batch
ODD = 0x9E3779B97F4A7C15


def powers(n: int) -> list[np.ndarray]:
    if len(POWERS[0]) < n:
        for i, base in enumerate((ODD, pow(ODD, -1, 2**64))):
            x = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            x[0] = 1
            POWERS[i] = np.cumprod(x)
    return POWERS


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of texts (none empty): points, starts and sizes of the distinct units, the number of each unit in reading
    order, and how many units each text has."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    heads = np.cumsum(lengths) - lengths
    blank, line = points == 32, points == 10
    border = line.copy()
    border[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
    border[heads] = True
    starts = np.flatnonzero(border)
    sizes = np.diff(starts, append=len(points))
    up, down = powers(len(points))
    c = (points.astype(np.uint64) + np.uint64(1)) * STEP
    total = np.cumsum((c ^ (c >> np.uint64(29))) * up[: len(points)])
    part = total[starts + sizes - 1] - np.where(starts > 0, total[np.maximum(starts - 1, 0)], np.uint64(0))
    h = part * down[starts] ^ sizes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    same = points[np.arange(len(points)) + np.repeat(starts[first[number]] - starts, sizes)] if (sizes[first[number]] == sizes).all() else points[:0]
    if not np.array_equal(same, points):  # two units of one hash: none is shared
        first = number = np.arange(len(starts))
    return points, starts[first], sizes[first], number, np.diff(np.searchsorted(starts, heads), append=len(starts))
