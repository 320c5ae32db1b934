"""Document fingerprints by locally consistent parsing.

A text is a row of code points. At each level, runs of equal names become one name; deterministic coin tossing (the
place of the lowest bit in which a name differs from the one before it, and that bit) shrinks the names to labels below
six, neighbours still differing; local maxima of the labels start phrases, and a phrase's name is a hash of the names in
it. A phrase's borders depend on a few neighbours only, so equal substrings get equal names inside, whatever their
offset. The fingerprint is a one-permutation sketch of the names of the second and third level (about 9 and 27 code
points): equal texts have equal fingerprints, and the share of equal slots estimates the shared phrases.

Defined results: null texts count as empty; two texts without phrases are alike (1), one without and one with are not
(0); repeated rows are rows of their own, next to each other in the order; a table of one row is its own next document;
null ids sort first; ties in id are ordered by a hash of the text, so rows of one id (or none) spread over tasks; texts of any
length are read whole; columns other than the id and the text aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, partitions, slices, written

SLOTS = ((2, 16), (3, 32))  # level, slots of the sketch
N_SLOTS = sum(n for _, n in SLOTS)
EMPTY = -1


def tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: 2 * (lowest differing place) + bit. At the first name of a text the place is 0."""
    prev = np.empty_like(x)
    prev[1:] = x[:-1]
    prev[first] = x[first] ^ x.dtype.type(1)
    diff = x ^ prev
    place = np.bitwise_count((diff & (~diff + x.dtype.type(1))) - x.dtype.type(1))
    return (2 * place + ((x >> place.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def parsed(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and the texts they belong to."""
    if not len(names):
        return names, doc
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(names)))
    names, doc = names[at], doc[at]
    long = run > 1
    names[long] = mix(names[long] + run[long].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    start = np.ones(len(names), bool)
    start[1:] = doc[1:] != doc[:-1]
    first = np.flatnonzero(start)
    label = tossed(names, first)
    for _ in range(3):
        label = tossed(label, first)
    left, right = np.empty_like(label), np.empty_like(label)
    left[1:], left[0] = label[:-1], 255
    right[:-1], right[-1] = label[1:], 255
    start |= (label > left) & (label > right) & ~np.append(start[1:], True)
    at = np.flatnonzero(start)
    offset = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
    parts = mix(names + (offset + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(parts, at)), doc[at]


def sketches(texts: list[str]) -> np.ndarray:
    """A row of slots for each text; EMPTY where no phrase fell."""
    out = np.full((len(texts), N_SLOTS), EMPTY, np.int64)
    for lo, hi in slices(texts, 500_000):
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts[lo:hi]]
        names = mix(np.concatenate(points).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        doc = np.repeat(np.arange(lo, hi), [len(p) for p in points])
        col = level = 0
        for want, slots in SLOTS:
            while level < want:
                names, doc = parsed(names, doc)
                level += 1
            cell = (doc - lo) * slots + (names >> np.uint64(48)).astype(np.int64) % slots
            low = np.full((hi - lo) * slots, 2**62, np.int64)
            np.minimum.at(low, cell, ((names & np.uint64(2**48 - 1))).astype(np.int64))
            got = low.reshape(hi - lo, slots)
            hashed = (mix(got.astype(np.uint64)) >> np.uint64(48)).astype(np.int64)
            out[lo:hi, col : col + slots] = np.where(got == 2**62, EMPTY, hashed)
            col += slots
    return out


def as_text(rows: np.ndarray) -> list[str]:
    return ["".join("----" if x < 0 else f"{x:04x}" for x in row) for row in rows.tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal slots among those that either text fills."""
    used = (a != EMPTY) | (b != EMPTY)
    n = used.sum(-1)
    return np.where(n == 0, 1.0, ((a == b) & used).sum(-1) / np.maximum(n, 1))


def edited(text: str, nxt: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + nxt[:half]


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a column fingerprint."""
    from .common import with_columns_from_text

    return with_columns_from_text(df, text_col, [T.StructField("fingerprint", T.StringType())], lambda: lambda texts: [as_text(sketches(texts))])


def compared_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text's.

    Texts are dealt out once by ranges of the id and the text's hash, and read in order. The first and last row of each range are finished in
    one small task: it gets two rows from each partition, however many rows there are.
    """
    id_type = df.schema[id_col].dataType
    made = [T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), T.StructField("text", T.StringType()), T.StructField(id_col, id_type), *made])
    names = [f.name for f in schema]

    def rows(ids: list, texts: list[str], nxt: list[str], own: np.ndarray, after: np.ndarray) -> list[dict]:
        changed = [edited(a, b) for a, b in zip(texts, nxt, strict=True)]
        other = sketches(changed)
        near, beyond = likeness(own, other), likeness(own, after)
        return [{"part": None, "edge": None, "text": None, id_col: i, "n_chars": len(t), "edited_sha256": hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": f, "edited_fingerprint": g, "near_edited": float(x), "near_next": float(y)} for i, t, c, f, g, x, y in zip(ids, texts, changed, as_text(own), as_text(other), near, beyond, strict=True)]

    def batch_of(found: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.string(), pa.string(), kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, kind, begun = TaskContext.get().partitionId(), None, None, False
        for b in batches:
            ids, texts, kind = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()], b.column(0).type
            for lo, hi in slices(texts, 1_000_000):
                own = sketches(texts[lo:hi])
                i, t, s = ids[lo:hi], texts[lo:hi], own
                if held:
                    i, t, s = [held[0], *i], [held[1], *t], np.concatenate([held[2], s])
                if not begun:
                    begun = True
                    yield batch_of([{"part": part, "edge": "head", "text": t[0], id_col: i[0]}], kind)
                if len(t) > 1:
                    yield batch_of(rows(i[:-1], t[:-1], t[1:], s[:-1], s[1:]), kind)
                held = (i[-1], t[-1], s[-1:])
        if held:
            yield batch_of([{"part": part, "edge": "tail", "text": held[1], id_col: held[0]}], kind)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tails, kind = [], [], None
        for b in batches:
            kind = b.column(3).type
            for edge, text, i in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                (heads if edge == "head" else tails).append((i, text))
        if tails:
            nxt = [t for _, t in [*heads[1:], heads[0]]]
            texts = [t for _, t in tails]
            yield batch_of(rows([i for i, _ in tails], texts, nxt, sketches(texts), sketches(nxt)), kind)

    docs = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order, "text")
    done = written(ordered.mapInArrow(walk, schema), "fingerprints")
    ends = done.where(F.col("edge").isNotNull()).repartition(1).sortWithinPartitions("part", "edge").mapInArrow(join, schema)
    return done.where(F.col("edge").isNull()).unionByName(ends).drop("part", "edge", "text")
