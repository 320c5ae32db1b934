"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the mean of hashed vectors of the word and of its first 3, 4, 5 and 6 letters, so inflected and
unseen words share what their stems have learnt. Filters of widths 1, 2 and 3 slide over the words of a whole text, the
largest answer of each filter over the text is kept, and a linear layer makes the score. Gradients flow through the
places of those largest answers alone.

Training begins from a bounded sample, fitted in one task, and goes on over all labelled rows in shards that lie over many
tasks; the driver sees nothing but the model, whose size the parameters fix, and counts of rounded scores.

Defined results: null and empty texts have no words and get the score of the bias; texts are scored whole, whatever their
length; repeated rows get equal scores; an empty table gives an empty result; columns that have the name of a new one
(score, predicted, threshold, flagged) are replaced, others pass through under any name. With no labelled rows, or rows of
one class only, every text gets the score 0.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bits_of, dropped, fresh, slices, small_batches, with_columns_from_text, within_bits, written

WORD = re.compile(r"[^\W\d_]+")
WIDTHS = (1, 2, 3)


@dataclass
class ConvModel:
    """The weights, the scale and shift that calibrate the score, and a decision threshold for each language."""

    emb: np.ndarray
    conv: np.ndarray
    conv_b: np.ndarray
    out: np.ndarray
    out_b: float
    scale: float = 1.0
    shift: float = 0.0
    filters: int = 8
    threshold: float = 0.5
    by_lang: dict[str, float] = field(default_factory=dict)


def features(word: str, buckets: int) -> list[int]:
    w = word.encode()
    return [crc32(w) % buckets, *(crc32(f"{n}:{word[:n]}".encode()) % buckets for n in (3, 4, 5, 6))]


class Encoder:
    """Texts to rows of word numbers; each text is followed by two pads (number 0), so windows never join two texts.
    ``feats`` gets the features of new words; a reader may clear it.

    The cache of words is emptied when it holds ``most`` words, so memory stays bounded whatever the vocabulary."""

    def __init__(self, buckets: int, most: int = 200_000):
        self.buckets, self.most = buckets, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.feats: list[list[int]] = []

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > self.most:
            self.clear()
        ids, rows, starts, n = self.ids, [], [], 0
        for t in texts:
            row = []
            for w in WORD.findall(t.lower()):
                k = ids.get(w)
                if k is None:
                    ids[w] = k = len(ids) + 1
                    self.feats.append(features(w, self.buckets))
                row.append(k)
            row += (0, 0)
            starts.append(n)
            n += len(row)
            rows.append(np.array(row, np.int32))
        return np.concatenate(rows) if rows else np.zeros(0, np.int32), np.array(starts, np.int64)


def convolved(proj: np.ndarray, toks: np.ndarray, bias: np.ndarray, filters: int) -> np.ndarray:
    """The filters' answers at each place of a row of word numbers; proj has a block of columns for each width's parts.
    Windows that begin at a pad hold pads only."""
    out, k = np.empty((len(toks), filters * len(WIDTHS)), proj.dtype), 0
    for j, width in enumerate(WIDTHS):
        total = proj[toks, k : k + filters].copy()
        for d in range(1, width):
            total[:-d] += proj[toks[d:], k + d * filters : k + (d + 1) * filters]
        out[:, j * filters : (j + 1) * filters] = total + bias[j * filters : (j + 1) * filters]
        k += width * filters
    out[toks == 0] = bias
    return out


class Scorer:
    def __init__(self, model: ConvModel):
        self.m, self.enc = model, Encoder(len(model.emb), 100_000)
        self.proj = np.zeros((1, model.conv.shape[1]), np.float32)

    def logits(self, texts: list[str]) -> np.ndarray:
        m = self.m
        toks, starts = self.enc(texts)
        if len(self.enc.ids) < len(self.proj) - 1 + len(self.enc.feats):  # the cache was emptied
            self.proj = np.zeros((1, m.conv.shape[1]), np.float32)
        if self.enc.feats:
            self.proj = np.concatenate([self.proj, m.emb[np.array(self.enc.feats)].mean(1) @ m.conv])
            self.enc.feats.clear()
        if not len(starts):
            return np.zeros(0)
        top = np.maximum(np.maximum.reduceat(convolved(self.proj, toks, m.conv_b, m.filters), starts), 0)
        return (top @ m.out + m.out_b).astype(float)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.m.scale * self.logits(texts) + self.m.shift, -30, 30)))


def gradients(m: ConvModel, vec: np.ndarray, t: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """The mean log loss of a batch (each row times its ``weight``) and its gradients by conv, conv_b, out, out_b and the words'
    vectors. ``t`` holds rows of ``vec``, row 0 being the pad; ``at`` is where each text starts."""
    nf, block = m.filters * len(WIDTHS), np.cumsum([0, *(w * m.filters for w in WIDTHS)])
    act = convolved(vec @ m.conv, t, m.conv_b, m.filters)
    top = np.maximum.reduceat(act, at)
    hidden = np.maximum(top, 0)
    z = np.clip(hidden @ m.out + m.out_b, -30, 30)
    each = np.full(len(y), 1 / len(y)) if weight is None else weight / len(y)
    err = (1 / (1 + np.exp(-z)) - y) * each
    size = np.append(at[1:], len(t)) - at
    where = np.empty((len(y), nf), np.int64)
    for r in range(len(y)):
        where[r] = at[r] + act[at[r] : at[r] + size[r]].argmax(0)
    back = err[:, None] * m.out * (top > 0)
    g_conv, g_vec = np.zeros_like(m.conv), np.zeros_like(vec)
    for j, width in enumerate(WIDTHS):
        for f in range(m.filters):
            c, g = j * m.filters + f, back[:, j * m.filters + f]
            for d in range(width):
                col = block[j] + d * m.filters + f
                w = np.where(t[where[:, c]] == 0, 0, t[np.minimum(where[:, c] + d, len(t) - 1)])
                g_conv[:, col] += g @ vec[w]
                np.add.at(g_vec, w, g[:, None] * m.conv[:, col])
    g_vec[0] = 0
    return float(np.sum(each * (np.logaddexp(0, z) - y * z))), {"conv": g_conv, "conv_b": back.sum(0), "out": err @ hidden, "out_b": err.sum(), "vec": g_vec}


def batch_of(m: ConvModel, t: np.ndarray, at: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vec, t, at, words): vectors of a batch's distinct words, its places as rows of them, and those words' numbers. ``t``:
    numbers from 1 of rows of ``feats``, 0 for pads."""
    words, t = np.unique(np.append(t, 0), return_inverse=True)
    vec = m.emb[feats[np.maximum(words - 1, 0)]].mean(1) if len(feats) else np.zeros((1, m.emb.shape[1]), np.float32)
    vec[0] = 0
    return vec, t[:-1], at, words


def logits_of(m: ConvModel, t: np.ndarray, at: np.ndarray, feats: np.ndarray) -> np.ndarray:
    vec, t, at, _ = batch_of(m, t, at, feats)
    return (np.maximum(np.maximum.reduceat(convolved(vec @ m.conv, t, m.conv_b, m.filters), at), 0) @ m.out + m.out_b).astype(float)


def squares(m: ConvModel) -> dict[str, np.ndarray]:
    """Adagrad's sums of squares before the first step."""
    return {k: np.full(np.shape(getattr(m, k)), 1e-6, np.float32) for k in ("emb", "conv", "conv_b", "out", "out_b")}


def stepped(m: ConvModel, sq: dict[str, np.ndarray], t: np.ndarray, at: np.ndarray, feats: np.ndarray, y: np.ndarray, rate: float, weight: np.ndarray | None = None) -> np.ndarray:
    """One step of Adagrad on a batch; the rows of ``emb`` that it moved."""
    vec, t, at, words = batch_of(m, t, at, feats)
    _, g = gradients(m, vec, t, at, y, weight)
    hit = np.flatnonzero(np.abs(g["vec"]).sum(1))
    if len(hit):
        rows, inv = np.unique(feats[np.maximum(words[hit] - 1, 0)], return_inverse=True)
        g_emb = np.zeros((len(rows), m.emb.shape[1]), np.float32)
        np.add.at(g_emb, inv.ravel(), np.repeat(g["vec"][hit] / feats.shape[1], feats.shape[1], axis=0))
        sq["emb"][rows] += g_emb**2
        m.emb[rows] -= rate * g_emb / np.sqrt(sq["emb"][rows])
    for k, x in (("conv", g["conv"] + 1e-5 * m.conv), ("conv_b", g["conv_b"]), ("out", g["out"] + 1e-5 * m.out)):
        sq[k] += x**2
        setattr(m, k, getattr(m, k) - (rate * x / np.sqrt(sq[k])).astype(np.float32))
    sq["out_b"] = sq["out_b"] + np.float32(g["out_b"] ** 2)
    m.out_b -= float(rate * g["out_b"] / np.sqrt(sq["out_b"]))
    return rows if len(hit) else np.zeros(0, np.int64)


def fit(tokens: list[np.ndarray], feats: np.ndarray, labels: list[int], buckets: int = 1 << 15, dim: int = 16, filters: int = 8, epochs: int = 5, batch: int = 64, rate: float = 0.02, seed: int = 7) -> tuple[ConvModel, dict[str, np.ndarray]]:
    """The weights with which :func:`train` begins, and their sums of squares: passes over a few rows (``tokens``: rows of
    ``feats`` for each text's words), none where these are of one class."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    m = ConvModel(rng.normal(0, 0.05, (buckets, dim)).astype(np.float32), rng.normal(0, 0.3, (dim, filters * sum(WIDTHS))).astype(np.float32), np.full(filters * len(WIDTHS), 0.05, np.float32), rng.normal(0, 0.3, filters * len(WIDTHS)).astype(np.float32), 0.0, filters=filters)
    sq, order = squares(m), np.arange(len(y))
    for _ in range(epochs if len(y) and y.min() < y.max() else 0):
        rng.shuffle(order)
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            t = np.concatenate([x for i in rows for x in (tokens[i] + 1, (0, 0))])  # two pads after each text
            at = np.concatenate([[0], np.cumsum([len(tokens[i]) + 2 for i in rows])[:-1]]).astype(np.int64)
            stepped(m, sq, t, at, feats, y[rows], rate)
    return m, sq


def calibrated(m: ConvModel, counts: list[tuple[str | None, int, float, int]], base_rate: float, least: int = 10) -> ConvModel:
    """``m`` with a shift of the score so that 0.5 splits the classes best at the given base rate, and a threshold for each
    language with ``least`` rows of each class. ``counts``: (language, class, logit, rows)."""
    langs = np.array([c[0] or "" for c in counts], object)
    y, z, n = (np.array([c[i] for c in counts], float) for i in (1, 2, 3))
    share = max(1e-6, (y * n).sum() / max(1, n.sum()))
    weight = n * np.where(y == 1, base_rate / share, (1 - base_rate) / max(1e-6, 1 - share))
    m.shift = -cut(z, y, weight)
    score = 1 / (1 + np.exp(-np.clip(z + m.shift, -30, 30)))
    for lang in sorted(set(langs) - {""}):
        mine = langs == lang
        if min(n[mine & (y == 1)].sum(), n[mine & (y == 0)].sum()) >= least:
            m.by_lang[lang] = float(np.clip(cut(score[mine], y[mine], weight[mine]), 0.2, 0.8))
    return m


def cut(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the widest of the gaps that give the largest weighted F1."""
    order = np.argsort(-score, kind="stable")
    if not len(order):
        return 0.5
    s, w, pos = score[order], weight[order], (y * weight)[order]
    if not pos.sum():
        return 0.5
    f1 = 2 * np.cumsum(pos) / (np.cumsum(w) + pos.sum())
    nxt = np.append(s[1:], s[-1] - 1e-3)
    f1[s == nxt] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax((s - nxt)[best])]
    return float((s[k] + nxt[k]) / 2)


def encoded(rows: DataFrame, buckets: int) -> DataFrame:
    """(order, id, y, l, n, feats) from (order, id, y, l, t): a text's words by their features, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(buckets)
        for b in batches:
            texts = [t or "" for t in b.column(4).to_pylist()]
            for lo, hi in slices(texts):
                toks, starts = enc(texts[lo:hi])
                known, ends = np.array(enc.feats or [[0] * 5], np.uint16), np.append(starts[1:], len(toks)) - 2
                rows = [known[toks[s:e] - 1] for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(4)), pa.array([len(x) for x in rows], pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["order", "id", "y", "l", "n", "feats"])

    return rows.mapInArrow(run, "order long, id string, y int, l string, n long, feats binary")


def rows_of(batches: Iterator[pa.RecordBatch], rows: int, chars: int = 1_000_000) -> Iterator[list[dict]]:
    """Rows in order, each of an (order, id) once, in lists of at most ``rows`` rows and about ``chars`` characters, whatever the
    batches in which they come."""
    out, size, last = [], 0, None
    for b in batches:
        for i, (order, key) in enumerate(zip(b.column("order").to_pylist(), b.column("id").to_pylist(), strict=True)):
            if (order, key) == last:
                continue
            last, text = (order, key), b.column("t")[i].as_py() or ""
            out.append({"y": b.column("y")[i].as_py(), "l": b.column("l")[i].as_py(), "t": text, "shard": b.column("shard")[i].as_py()})
            size += len(text)
            if len(out) == rows or size >= chars:
                yield out
                out, size = [], 0
    if out:
        yield out


class Numbered:
    """Texts as word numbers, with the features of all words known so far."""

    def __init__(self, buckets: int):
        self.enc, self.feats = Encoder(buckets, 100_000), np.zeros((0, 5), np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        t, at = self.enc(texts)
        if len(self.enc.ids) < len(self.feats) + len(self.enc.feats):  # the cache was emptied
            self.feats = np.zeros((0, 5), np.int64)
        if self.enc.feats:
            self.feats = np.concatenate([self.feats, np.array(self.enc.feats, np.int64)])
            self.enc.feats.clear()
        return t, at


DENSE = ("conv", "conv_b", "out", "out_b")
ROWS = 1024  # rows of emb that are summed in one place


def refined(rows: DataFrame, m: ConvModel, sq: dict[str, np.ndarray], weight: dict[int, float], batch: int = 64, rate: float = 0.02) -> ConvModel:
    """``m`` after one pass over all ``rows`` (shard, order, id, y, l, t), which lie by shard in order. Each shard takes its own
    steps from ``m``; its moves are averaged: those of a row of ``emb`` over the steps that moved it, others over all steps. The
    driver gets the sums, which are as large as the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = None, None

        def moves() -> pa.RecordBatch:
            mine, _, steps, moved = own
            emb = (mine.emb - m.emb) * moved[:, None]
            parts = [(emb[lo : lo + ROWS], moved[lo : lo + ROWS]) for lo in range(0, len(emb), ROWS)]
            parts.append((np.concatenate([np.ravel(getattr(mine, k) - getattr(m, k)) for k in DENSE]) * steps, np.array([steps])))
            sums, counts = ([np.ascontiguousarray(p[i], np.float32).tobytes() for p in parts] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int32()), pa.array(sums, pa.binary()), pa.array(counts, pa.binary())], names=["part", "shard", "sums", "counts"])

        for b in by_shard(batches, batch):
            if b[0]["shard"] != seen:
                if own:
                    yield moves()
                seen = b[0]["shard"]
                own = [unpacked(packed(m)), {k: x.copy() for k, x in sq.items()}, 0, np.zeros(len(m.emb), np.float32)]
                number = Numbered(len(m.emb))
            t, at = number([r["t"] for r in b])
            y = np.array([r["y"] for r in b], np.float32)
            hit = stepped(own[0], own[1], t, at, number.feats, y, rate, np.array([weight[r["y"]] for r in b]))
            own[2] += 1
            own[3][hit] += 1
        if own:
            yield moves()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for part, *x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x = [np.frombuffer(v, np.float32).astype(float) for v in x]
                had = got.setdefault(part, [np.zeros_like(v) for v in x])
                for to, v in zip(had, x, strict=True):
                    to += v
        for part, x in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in x)], names=["part", "sums", "counts"])

    parts = -(-len(m.emb) // ROWS) + 1
    moved = rows.mapInArrow(run, "part int, shard int, sums binary, counts binary")
    sums = moved.repartition(parts, "part").sortWithinPartitions("part", "shard").mapInArrow(added, "part int, sums binary, counts binary").collect()
    out = unpacked(packed(m))
    for r in sums:
        x, n = (np.frombuffer(bytes(r[c]), float) for c in ("sums", "counts"))
        if r["part"] + 1 < parts:
            lo = r["part"] * ROWS
            out.emb[lo : lo + len(n)] += (x.reshape(len(n), -1) / np.maximum(1, n)[:, None]).astype(np.float32)
            continue
        at = 0
        for k in DENSE:
            old = np.asarray(getattr(out, k))
            new = old + (x[at : at + old.size].reshape(old.shape) / max(1, n[0])).astype(np.float32)
            setattr(out, k, new if old.ndim else float(new))
            at += old.size
    return out


def by_shard(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[dict]]:
    """:func:`rows_of`, cut where a shard ends."""

    def one(shard: int, b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(b.column("shard").to_numpy() == shard))

    def runs() -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            for shard in dict.fromkeys(b.column("shard").to_pylist()):
                yield shard, one(shard, b)

    for _, group in groupby(runs(), key=lambda r: r[0]):
        yield from rows_of((b for _, b in group), rows)


def held_counts(rows: DataFrame, m: ConvModel, batch: int = 64) -> list[tuple[str | None, int, float, int]]:
    """(language, class, logit, rows) of all ``rows``, logits in steps of 1 / 256: at most 15,361 of them for each class and
    language reach the driver, languages without 10 rows of each class as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbered(len(m.emb))
        for b in by_shard(batches, batch):
            t, at = number([r["t"] for r in b])
            z = np.clip(logits_of(m, t, at, number.feats), -30, 30)
            yield pa.RecordBatch.from_arrays([pa.array([r["l"] for r in b], pa.string()), pa.array([r["y"] for r in b], pa.int32()), pa.array(np.round(z * 256).astype(np.int64))], names=["l", "y", "z"])

    got = written(rows.mapInArrow(run, "l string, y int, z long").groupBy("l", "y", "z").count(), "logits")
    enough = got.groupBy("l").agg(F.sum(F.when(F.col("y") == 1, F.col("count"))).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("count"))).alias("b")).where("l is not null and a >= 10 and b >= 10").select("l", F.col("l").alias("lang"))
    out = got.join(enough, "l", "left").groupBy("lang", "y", "z").agg(F.sum("count").alias("n")).collect()
    dropped(got)
    return sorted(((r["lang"], r["y"], r["z"] / 256, r["n"]) for r in out), key=lambda c: (c[0] or "", *c[1:]))


def train(documents: DataFrame, labels: DataFrame, most_each: int = 2500, most_words: int = 4_000_000, most_row_words: int = 100_000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> ConvModel:
    """Fits the classifier on all labelled rows whose crc32(id as text) mod ``folds`` isn't 0, repeated ones once: three of four
    (by a hash of id and text) train, the others choose the shift and the thresholds.

    The weights begin from passes over a bounded sample: at most ``most_each`` ids of each class (those with the smallest hashes),
    at most twice as many rows, in the order of their hashes as many as hold ``most_words`` words together, and none of more
    than ``most_row_words`` words. One task makes them. :func:`refined` then goes over all rows, in shards of bounded size
    whose moves are averaged, so that every row counts, whatever its length. The driver gets the model and counts."""
    spark = documents.sparkSession
    small_batches(spark)
    usable = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % folds != 0)).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    usable = written(usable, "toxic_labels")
    rate = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for label in (0, 1):
        part = usable.where(F.col("y") == label).orderBy(F.xxhash64("i"), "i").limit(most_each)
        picked = part if picked is None else picked.unionByName(part)
    lang = F.col(lang_col) if lang_col in documents.columns else F.lit(None)
    docs = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), lang.cast("string").alias("l"))
    buckets, ones, total = 1 << 15, rate.get(1, 0), sum(rate.values())
    base_rate = ones / total if total else 0.5
    if not ones or ones == total:
        dropped(usable)
        m, _ = fit([], np.zeros((0, 5), np.int64), [], buckets)
        m.out[:] = 0
        m.scale, m.shift = 0.0, -30.0
        return m
    whole = labelled(docs, usable, SHARD if total <= SHARDS * SHARD else max(SHARD, min(4 * SHARD, -(-total // SHARDS))), total)
    # At most 2 * most_each ids: a proven bound.
    rows = whole.where("not held").drop("shard", "held").join(F.broadcast(picked.select(F.col("i").cast("string").alias("id"))), "id", "left_semi").select("order", "id", "y", "l", "t")
    # Repeated rows count once.
    some = written(encoded(rows, buckets), "toxic_rows")
    heads = some.groupBy("order", "id", "y").agg(F.min("l").alias("l"), F.min("n").alias("n")).where(F.col("n") <= most_row_words).orderBy("order", "id").limit(2 * most_each)
    upto = F.sum("n").over(Window.orderBy("order", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # over the limit's rows
    heads = heads.withColumn("upto", upto).where(F.col("upto") <= most_words).select("order", "id")
    chosen = some.dropDuplicates(["order", "id"]).join(F.broadcast(heads), ["order", "id"]).select("order", "id", "y", "feats")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in b.to_pylist()]
        got.sort(key=lambda r: (r["order"], r["id"]))
        words = [np.frombuffer(r.pop("feats"), np.uint16).reshape(-1, 5) for r in got]
        flat = np.concatenate([np.zeros((0, 5), np.uint16), *words])
        feats, number = np.unique(flat.view("V10").ravel(), return_inverse=True) if len(flat) else (flat, np.zeros(0, np.int64))
        ends = np.cumsum([len(w) for w in words])
        tokens = [number[e - len(w) : e] for w, e in zip(words, ends, strict=True)]
        m, sq = fit(tokens, feats.view(np.uint16).reshape(-1, 5).astype(np.int64), [r["y"] for r in got], buckets)
        sums = io.BytesIO()
        np.savez(sums, **sq)
        yield pa.RecordBatch.from_arrays([pa.array([packed(m)], pa.binary()), pa.array([sums.getvalue()], pa.binary())], names=["model", "squares"])

    # The rows are bounded (at most 10 bytes for each of most_words words), so one task can hold them; repeated rows have gone
    # before, in tasks of their own.
    found = chosen.repartition(1).mapInArrow(one, "model binary, squares binary").first()
    if found:
        m = unpacked(bytes(found["model"]))
        with np.load(io.BytesIO(bytes(found["squares"]))) as z:
            sq = {k: z[k] for k in z.files}
    else:
        m, _ = fit([], np.zeros((0, 5), np.int64), [], buckets)
        sq = squares(m)
    m = refined(whole.where("not held"), m, sq, {y: total / (2 * n) for y, n in rate.items()})
    m = calibrated(m, held_counts(whole.where("held"), m), base_rate)
    dropped(some, whole, usable)
    return m


SHARD, SHARDS = 2048, 64  # labelled ids of a shard; above that many shards they grow to four times that size


def labelled(docs: DataFrame, usable: DataFrame, shard: int, total: int) -> DataFrame:
    """(shard, order, id, y, l, t, held) of the labelled rows, written by shard in order; ``held`` rows, one of four, aren't
    trained on. A bit filter of the ids leaves unlabelled texts where they are stored."""
    spark = docs.sparkSession
    keyed = usable.select("i", "y", F.xxhash64("i").alias("k"))
    b_bits = spark.sparkContext.broadcast(bits_of(keyed, "k"))
    some = docs.select(F.xxhash64("i").alias("k"), "i", "t", "l")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(within_bits(b_bits.value, b.column(0).to_numpy())))

    shards = max(1, -(-total // shard))
    # Texts and labels are dealt by id together, into as many parts as shards: a shard is a part, and texts are sent once. (A join
    # would deal both into the session's count of parts.)
    texts = some.mapInArrow(run, some.schema).select("i", "t", "l", F.lit(None).cast("int").alias("y"), F.lit(True).alias("text"))
    own = keyed.select("i", F.lit(None).cast("string").alias("t"), F.lit(None).cast("string").alias("l"), "y", F.lit(False).alias("text"))
    both = texts.unionByName(own).repartition(shards, "i")
    rows = both.withColumn("y", F.max("y").over(Window.partitionBy("i"))).where("text and y is not null")
    order, part = F.xxhash64("i", "t"), F.pmod(F.hash("i"), F.lit(shards))
    rows = rows.select(part.alias("shard"), order.alias("order"), F.col("i").cast("string").alias("id"), "y", "l", "t", (F.pmod(F.shiftright(order, 8), F.lit(4)) == 0).alias("held"))
    out = written(rows.sortWithinPartitions("shard", "order", "id", "l"), "toxic_rows")
    b_bits.destroy()
    return out


def packed(m: ConvModel) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: x for k, x in vars(m).items() if k != "by_lang"}, langs=np.array(list(m.by_lang), dtype=str), cuts=np.array(list(m.by_lang.values()), float))
    return out.getvalue()


def unpacked(data: bytes) -> ConvModel:
    with np.load(io.BytesIO(data)) as z:
        had = {k: z[k] if z[k].ndim else z[k].item() for k in z.files if k not in ("langs", "cuts")}
        return ConvModel(**had, by_lang=dict(zip(z["langs"].tolist(), z["cuts"].tolist(), strict=True)))


def score(df: DataFrame, model: ConvModel, text_col: str = "text", keep: list[str] | None = None, drop_toxic: bool = False, lang_col: str = "lang") -> DataFrame:
    """Adds score, predicted (score >= 0.5), threshold (of the row's language) and flagged (score >= threshold). The
    language chooses the threshold only; no score depends on it. ``drop_toxic`` keeps the rows that aren't flagged and
    adds no columns."""

    def maker():
        scorer = Scorer(model)
        return lambda texts: [scorer(texts)]

    made = fresh(df.columns, "score")
    out = with_columns_from_text(df, text_col, [T.StructField(made, T.DoubleType(), False)], maker, keep)
    limit = F.lit(model.threshold)
    if model.by_lang and lang_col in out.columns:
        langs = F.create_map(*[F.lit(x) for kv in sorted(model.by_lang.items()) for x in kv])
        limit = F.coalesce(F.try_element_at(langs, F.col(lang_col).cast("string")), limit)
    if drop_toxic:
        return out.where(F.col(made) < limit).drop(made)
    new = {"score": F.col(made), "predicted": (F.col(made) >= 0.5).cast("int"), "threshold": limit, "flagged": F.col(made) >= limit}
    return out.select(*(c for c in out.columns if c.lower() not in new and c != made), *(x.alias(n) for n, x in new.items()))
