"""Packing token ids into sequences by bounded-space online best fit.

A task reads its documents once, in order, and keeps a fixed number of open windows. A piece goes to the open window that
it fills best; where none has room and no further window may be opened, the fullest is emitted (its gap, if it is more
than ``slack`` tokens, takes a cut from the piece first). At the end of a task its open windows are merged into
each other until one is left at most; those are merged in groups of 64 tasks, again and again, so that no task ever holds
more than 64 windows. The very last window is cut into lengths that are powers of two, which need no padding.

Defined results: a null text is an empty one and has the end id only; texts of any length are read whole, words of them at a
time; documents longer than a sequence are cut at its length; repeated rows are packed like others; null ids are values like
others; an empty table gives an empty result; ``keep`` names the columns that pass through, but for those named like new ones.
Which sequence takes a piece depends on how the input is dealt to tasks; the tables in between are written, so a lost
executor changes nothing that was read.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import byte_letters
from .common import _arrow, fresh, slices, small_batches, written

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
FAN_IN = 64


#: ASCII without U+0000 and U+0001, and Latin-1's letters: texts of these are their own normal form, and Python and the
#: tokenizer lower-case them alike. A bar may belong to a special token, so it isn't here.
ODD = re.compile(r"[^\x02-{}~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
#: The vocabulary's published pattern of units other than runs of letters.
UNIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9ß-öø-ÿ \t\n\r\v\f\x00\x01]+")
END, NEXT, WORD_END = "\0", "\x01", "</w>"


class Encoder:
    """Ids of texts by a tokenizer whose tokens never reach over white space. Plain Latin text goes to an equal encoder that
    merges bytes by rank, where the vocabulary allows one: the end of a unit is a byte of its own, which merges first.
    All other words go to the tokenizer itself."""

    def __init__(self, tokenizer: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer)
        self.fast = self.ranked(json.loads(tokenizer))

    def ranked(self, parsed: dict):
        """The equal encoder, or None for vocabularies whose ids aren't 256 bytes, 256 last bytes and merges in order."""
        import tiktoken

        letters, special = byte_letters(), {t["content"] for t in parsed["added_tokens"]}
        vocab = {k: i for k, i in parsed["model"]["vocab"].items() if k not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in parsed["model"].get("merges", [])]
        ordered = all(vocab.get("".join(m)) == 512 + i for i, m in enumerate(merges))
        bases = {vocab.get(c) for c in letters} == set(range(256)) and {vocab.get(c + WORD_END) for c in letters} == set(range(256, 512))
        if not (ordered and bases and parsed["model"].get("end_of_word_suffix") == WORD_END):
            return None
        ranks = {}
        for k, i in vocab.items():
            last = k.endswith(WORD_END)
            ranks[bytes(letters[c] for c in (k[: -len(WORD_END)] if last else k)) + END.encode() * last] = i
        self.next_id = ranks[NEXT.encode()]
        return tiktoken.Encoding("word-ends", pat_str=r"\x01|[^\x00\x01]+\x00", mergeable_ranks=ranks, special_tokens={})

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = UNIT.sub(r"\0\g<0>\0", (END + NEXT).join(texts).lower())  # units don't reach over these marks
        for blank in " \t\n\r\v\f":
            joined = joined.replace(blank, END)
        ids = np.array(self.fast.encode_ordinary(joined + END), "<u4")
        at = np.flatnonzero(ids == self.next_id)
        return [ids[lo:hi] for lo, hi in zip([0, *(at + 1)], [*at, len(ids)], strict=True)]

    def __call__(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        parts: list[list] = [[], []]  # plain texts and odd words, each with the place of its text
        for i, t in enumerate(texts):
            if self.fast and not ODD.search(t):
                parts[0].append((i, 0, t))
            else:  # ASCII white space alone parts words
                runs = groupby((w.decode() for w in t.encode().split()), lambda w: bool(not self.fast or ODD.search(w)))
                for j, (odd, words) in enumerate(runs):
                    parts[odd].append((i, j, " ".join(words)))
        out: list[list] = [[] for _ in texts]
        ids = self.plain([t for *_, t in parts[0]]) if parts[0] else []
        ids += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch([t for *_, t in parts[1]], add_special_tokens=False)]
        for (i, j, _), x in sorted(zip(parts[0] + parts[1], ids, strict=True), key=lambda p: p[0][:2]):
            out[i].append(x)
        return [np.concatenate([*x, np.array([end_id], "<u4")]) for x in out]


@lru_cache(2)
def encoder(tokenizer: bytes) -> Encoder:
    return Encoder(tokenizer)


class Packer:
    """Open windows and the pieces of closed ones. A piece is (document's values, start, ids, the document's tokens)."""

    def __init__(self, size: int, most: int, slack: int, first_number: int) -> None:
        self.size, self.most, self.slack, self.number = size, most, slack, first_number
        self.gaps: list[tuple[int, int]] = []  # (room, window), by room
        self.open: dict[int, list[tuple]] = {}
        self.closed: list[tuple] = []  # (piece, sequence, offset)
        self.opened = 0

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.closed.append((p, self.number, at))
            at += len(p[2])
        self.number += 1

    def put(self, i: int, pieces: list[tuple]) -> None:
        """Adds pieces that fit to the i-th window by room."""
        room, w = self.gaps.pop(i)
        self.open[w] += pieces
        room -= sum(len(p[2]) for p in pieces)
        if room:
            insort(self.gaps, (room, w))
        else:
            self.emit(self.open.pop(w))

    def add(self, pieces: list[tuple]) -> None:
        """A new window."""
        self.open[self.opened] = []
        insort(self.gaps, (self.size, self.opened))
        self.opened += 1
        self.put(bisect_left(self.gaps, (self.size, self.opened - 1)), pieces)

    def place(self, piece: tuple) -> None:
        doc, start, ids, n = piece
        while len(ids) >= self.size:
            self.emit([(doc, start, ids[: self.size], n)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            i = bisect_left(self.gaps, (len(ids), -1))
            if i < len(self.gaps):
                return self.put(i, [(doc, start, ids, n)])
            if len(self.gaps) < self.most:
                return self.add([(doc, start, ids, n)])
            room = self.gaps[0][0]
            if room > self.slack:
                self.put(0, [(doc, start, ids[:room], n)])
                start, ids = start + room, ids[room:]
            else:
                self.emit(self.open.pop(self.gaps.pop(0)[1]))

    def merge(self) -> None:
        """Merges the open windows into each other until one is left at most."""
        while len(self.gaps) > 1:
            room, w = self.gaps[0]
            # The fullest other window that fits wholly into the fullest one's room has room of size - room or more.
            i = bisect_left(self.gaps, (self.size - room, -1), 1)
            if i < len(self.gaps):
                self.put(0, self.open.pop(self.gaps.pop(i)[1]))
            elif room <= self.slack:
                self.emit(self.open.pop(self.gaps.pop(0)[1]))
            else:
                rest = self.open.pop(self.gaps.pop()[1])  # the emptiest fills the fullest up and goes on
                head, tail = cut(rest, room)
                self.put(0, head)
                self.add(tail)

    def finish(self) -> None:
        """Cuts the last window into lengths that are powers of two."""
        self.gaps = []
        for w in list(self.open):
            rest = self.open.pop(w)
            while rest:
                n = sum(len(p[2]) for p in rest)
                head, rest = cut(rest, 1 << (n.bit_length() - 1))
                self.emit(head)


def cut(pieces: list[tuple], at: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``at`` tokens of pieces in a row, and the rest."""
    head, tail = [], []
    for doc, start, ids, n in pieces:
        k = min(len(ids), at)
        at -= k
        if k:
            head.append((doc, start, ids[:k], n))
        if k < len(ids):
            tail.append((doc, start + k, ids[k:], n))
    return head, tail


def packed(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, tokenizer: str = TOKENIZER, end_id: int = 1, size: int = 2048, windows: int = 64, slack: int = 8, with_ids: bool = True) -> DataFrame:
    """One row a piece: ``keep``, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (32-bit,
    little-endian). ``windows``: how many stay open in a task; ``slack``: tokens of padding that are left to a sequence."""
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    part = fresh([*df.columns, *names], "part")
    blob = Path(tokenizer).read_bytes()
    fields = [df.schema[c] for c in keep]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in names[:-1]] + [T.StructField("ids", T.BinaryType()), T.StructField(part, T.LongType())])
    arrow = [_arrow(f.dataType) for f in schema]
    small_batches(df.sparkSession)

    def batch(rows: list[tuple], of: int | None = None) -> pa.RecordBatch:
        """(piece, sequence, offset) as rows; those of a window that is still open are marked with the task they come from."""
        cols = [[p[0][i] for p, _, _ in rows] for i in range(len(keep))]
        raw = [p[2].tobytes() for p, _, _ in rows]
        cols += [[p[1] for p, _, _ in rows], [len(p[2]) for p, _, _ in rows], [zlib.crc32(b) for b in raw], [p[3] for p, _, _ in rows], [s for _, s, _ in rows], [o for _, _, o in rows]]
        cols += [raw if with_ids or of is not None else [None] * len(rows), [of] * len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow, strict=True)], names=schema.names)

    def flushed(packer: Packer) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(packer.closed), 2000):
            yield batch(packer.closed[lo : lo + 2000])
        packer.closed = []

    def still_open(packer: Packer, of: int) -> Iterator[pa.RecordBatch]:
        for pieces in packer.open.values():
            at = np.cumsum([0, *(len(p[2]) for p in pieces)]).tolist()
            yield batch([(p, of, o) for p, o in zip(pieces, at, strict=False)], of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(blob), TaskContext.get().partitionId()
        packer = Packer(size, windows, slack, number << 32)
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            for lo, hi in slices(texts, 300_000):
                docs = zip(*(b.column(c).slice(lo, hi - lo).to_pylist() for c in keep), strict=True) if keep else [()] * (hi - lo)
                for doc, ids in zip(docs, encode(texts[lo:hi], end_id), strict=True):
                    packer.place((doc, 0, ids, len(ids)))
                yield from flushed(packer)
        packer.merge()
        yield from flushed(packer)
        yield from still_open(packer, number)

    def merging(level: int, last: bool):
        def merge(t: pa.Table) -> pa.Table:
            group = t.column(part)[0].as_py() // FAN_IN
            packer = Packer(size, FAN_IN, slack, (level << 58) + (group << 26))
            rows = t.sort_by([(part, "ascending"), ("offset", "ascending")]).to_pylist()
            found: dict[int, list[tuple]] = {}
            for r in rows:
                found.setdefault(r[part], []).append((tuple(r[c] for c in keep), r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
            for pieces in found.values():
                packer.add(pieces)
            packer.merge()
            if last:
                packer.finish()
            return pa.Table.from_batches([*flushed(packer), *still_open(packer, group)], pa.schema(list(zip(schema.names, arrow, strict=True))))

        return merge

    now = written(df.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema), "packed")
    out, level, last = now.where(F.col(part).isNull()), 0, False
    while not last:
        left, level = now.where(F.col(part).isNotNull()), level + 1
        top = left.agg(F.max(part)).first()[0]
        if top is None:
            break
        last = top < FAN_IN
        now = written(left.groupBy(F.floor(F.col(part) / FAN_IN)).applyInArrow(merging(level, last), schema), f"packed-{level}")
        out = out.unionByName(now.where(F.col(part).isNull()))
    return out.drop(part) if with_ids else out.drop(part, "ids")
