"""SentencePiece encoding and decoding with Gumbel top-k sampling of segmentations, without replacement.

A text's segmentations are the leaves of a tree: unit by unit, and inside a unit from its end, each step picks the piece
that ends at the current node, with the posterior probability that the lattice gives it. A perturbed A-star search walks
that tree: the root's Gumbel value stays with the branch that is followed, and the set of a step's other branches gets a
Gumbel value of its own log mass, truncated at its parent's. The set with the largest value is split next, so leaves
come out in falling order of their perturbed log-probabilities: an exact sample without replacement. All steps of many
texts are drawn together with numpy. Random numbers are hashes of (seed, row key, sample, unit, place in the unit), and
sums along a path are taken in fixed point, so a row's samples are a function of its key and text alone: batches,
partitions, retries and neighbours change no bit of them.

The inclusion score of a sample is 1 - exp(-exp(log_prob - kappa)), kappa being the largest value that stays in the
queue after k samples (1 where nothing stays).

Decoding joins the pieces' bytes and drops the blank that encoding puts before a text; it gives the text back exactly,
line breaks, runs of blanks and characters that no piece covers included.

Defined results: null texts count as empty, and an empty text has one segmentation, the blank; a text with fewer than k
segmentations gives fewer rows; repeated rows give equal rows; null ids are keys like others; an empty table gives an
empty result. Texts are encoded whole, whatever their length (a word or run of blanks of n characters takes n steps). Input
columns named like a new one (sample, ids, n_ids, log_prob, perturbed, inclusion, exact, in any case) give way to it; others
pass through under their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, slices, small_batches
from .lattice import Lattice, Vocabulary, cut, load, shared

MASK = 2**64 - 1
FAR = -60.0
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
STEP = np.uint64(0x9E3779B97F4A7C15)
ONE = float(2**36)  # of fixed-point logarithms


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Doubles in (0, 1) from uint64 keys."""
    return ((mix(key + np.uint64(salt * 0xD1342543DE82EF95 & MASK)) >> np.uint64(11)).astype(float) + 0.5) / 2**53


def gumbel(key: np.ndarray, salt: int) -> np.ndarray:
    return -np.log(-np.log(uniform(key, salt)))


class Steps:
    """What drawing needs of each edge: its log probability in fixed point, and the log of what its siblings hold."""

    def __init__(self, lat: Lattice):
        self.lat = lat
        alone = np.diff(lat.first)[lat.dst] < 2
        with np.errstate(divide="ignore"):
            self.log = np.rint(np.maximum(np.log(lat.prob), -700.0) * ONE).astype(np.int64)
            self.log_rest = np.log1p(-lat.prob)
        self.log_rest[alone] = -np.inf

    def drawn(self, nodes: np.ndarray, keys: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """From each node back to its unit's start: the number of steps, and the edges in order, node after node."""
        lat, salt = self.lat, 4 * sample + 1
        steps, who, at, kind = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), nodes, []
        go = at >= lat.n_start
        who, at = (who, at) if go.all() else (who[go], at[go])
        while len(who):
            u = uniform(keys[who] + lat.place[at].astype(np.uint64) * STEP, salt)
            edge = lat.first[at]
            on = np.flatnonzero(lat.cum[edge] < u)
            while len(on):
                edge[on] += 1
                on = on[lat.cum[edge[on]] < u[on]]
            kind.append((who, edge))
            steps[who] += 1
            at = lat.src[edge]
            go = at >= lat.n_start
            who, at = who[go], at[go]
        start = np.cumsum(steps) - steps
        out = np.empty(int(steps.sum()), np.int64)
        for i, (w, e) in enumerate(kind):
            out[start[w] + i] = e
        return steps, out


class Path:
    """One text's sampled steps: edges, their units, log mass before each step, and what its set of siblings holds."""

    __slots__ = ("edges", "unit", "first_own", "mass", "value", "log_prob", "perturbed")


def sampled(lat: Lattice, number: np.ndarray, sizes: np.ndarray, keys: np.ndarray, k: int) -> list[tuple[list[Path], float]]:
    """For each text (its units' numbers follow each other in ``number``, ``sizes`` of them; its key): up to k paths, and
    the largest value left in the queue."""
    draw, n_texts = Steps(lat), len(sizes)
    unit_start = np.cumsum(sizes) - sizes
    inside = np.arange(len(number)) - np.repeat(unit_start, sizes)
    unit_keys = mix(np.repeat(keys, sizes) + (inside + 1).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    final = lat.final[number]
    paths: list[list[Path]] = [[] for _ in range(n_texts)]
    used: list[dict] = [{} for _ in range(n_texts)]
    left = np.full(n_texts, -np.inf)
    # Texts to draw: text, prefix edges, their units, first own step, perturbed value. First all texts, from their ends.
    none = np.zeros(0, np.int64)
    todo = [(d, none, none, 0, value) for d, value in enumerate(gumbel(keys, 0).tolist())]
    nodes, node_keys, units, counts = final, unit_keys, inside, sizes
    for sample in range(k):
        if not todo:
            break
        steps, edges = draw.drawn(nodes, node_keys, sample)
        per = np.add.reduceat(np.append(steps, 0), np.cumsum(counts) - counts) * (counts > 0)
        which = np.repeat(units, steps)
        made, parts, ends = [], [], np.cumsum(per)
        for (d, before, before_unit, own, value), hi, n in zip(todo, ends.tolist(), per.tolist(), strict=True):
            p = Path()
            p.edges, p.unit = edges[hi - n : hi], which[hi - n : hi]
            if own:
                p.edges, p.unit = np.concatenate([before, p.edges]), np.concatenate([before_unit, p.unit])
            p.first_own, p.perturbed = own, value
            paths[d].append(p)
            made.append((d, p))
            parts.append(p.edges)
        edges = np.concatenate(parts) if sample else edges
        lens = np.array([len(p.edges) for _, p in made])
        start = np.cumsum(lens) - lens
        log = draw.log[edges]
        cum = np.cumsum(log)  # exact: sums of one path don't depend on those before it
        base = cum[start] - log[start]
        total = (cum[start + lens - 1] - base) / ONE
        mass = (cum - log - np.repeat(base, lens)) / ONE
        phi = mass + draw.log_rest[edges]
        step = np.arange(len(edges)) - np.repeat(start, lens)
        own_keys, own_bound = keys[[d for d, _ in made]], np.array([p.perturbed for _, p in made])
        # No standard Gumbel value of 53 bits passes 38: sets of a log mass below FAR can't win against a value above
        # FAR + 38, so they are only drawn for texts without such a value.
        value = np.full(len(phi), -np.inf)
        near = np.flatnonzero(phi >= FAR)
        of = np.searchsorted(start, near, "right") - 1
        key = own_keys[of] + (step[near] + 1).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        value[near] = truncated(phi[near], gumbel(key, 4 * sample + 2), own_bound[of])
        for j in np.flatnonzero(np.maximum.reduceat(value, start) < FAR + 38).tolist():
            part = slice(start[j], start[j] + lens[j])
            key = own_keys[j] + (step[part] + 1).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
            value[part] = truncated(phi[part], gumbel(key, 4 * sample + 2), own_bound[j])
        for (_, p), s, n, t in zip(made, start.tolist(), lens.tolist(), total.tolist(), strict=True):
            p.mass, p.value, p.log_prob = mass[s : s + n], value[s : s + n], t
            p.value[: p.first_own] = -np.inf  # those sets belong to the path that this one left
        todo, nodes_, keys_, units_, counts = [], [], [], [], []
        for d, _ in made:
            best = max(range(len(paths[d])), key=lambda i: paths[d][i].value.max(initial=-np.inf)) if sample else 0
            p = paths[d][best]
            i = int(p.value.argmax())
            left[d] = p.value[i]
            if sample + 1 == k or left[d] == -np.inf:
                continue
            node = int(lat.dst[p.edges[i]])
            taken = used[d].setdefault((best, i), [int(p.edges[i])])
            lo, hi = int(lat.first[node]), int(lat.first[node + 1])
            free = np.array([e for e in range(lo, hi) if e not in taken])
            w = lat.prob[free]
            key = keys[d : d + 1] + np.uint64((i + 1) * 0xC2B2AE3D27D4EB4F & MASK)
            pick = int(free[min(np.searchsorted(np.cumsum(w), uniform(key, 4 * sample + 3)[0] * w.sum()), len(free) - 1)])
            bound = p.value[i]
            taken.append(pick)
            rest = lat.prob[free[free != pick]].sum()
            p.value[i] = truncated(p.mass[i] + np.log(rest), gumbel(key, 4 * sample + 4), bound)[0] if rest > 0 else -np.inf
            u = int(p.unit[i])
            todo.append((d, np.append(p.edges[:i], pick), np.append(p.unit[:i], u), i + 1, bound))
            at = slice(unit_start[d] + u, unit_start[d] + sizes[d])
            nodes_ += [lat.src[pick : pick + 1], final[at][1:]]
            keys_.append(unit_keys[at])
            units_.append(inside[at])
            counts.append(sizes[d] - u)
        if todo:
            nodes, node_keys, units, counts = np.concatenate(nodes_), np.concatenate(keys_), np.concatenate(units_), np.array(counts)
    return [(paths[d], float(left[d])) for d in range(n_texts)]


def truncated(phi, g, bound):
    """A Gumbel value of location phi (by the standard one g), given that it is below bound."""
    return np.where(np.isneginf(phi), -np.inf, -np.logaddexp(-bound, -(phi + g)))


def piece_ids(v: Vocabulary, lat: Lattice, paths: list[Path]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all paths in reading order, path after path, and how many each has. Steps run backwards in each unit."""
    lens = np.array([len(p.edges) for p in paths])
    edges, unit = np.concatenate([p.edges for p in paths]), np.concatenate([p.unit for p in paths])
    new = np.empty(len(unit), bool)
    new[1:] = unit[1:] != unit[:-1]
    new[np.cumsum(lens) - lens] = True
    at = np.flatnonzero(new)
    run = np.diff(at, append=len(unit))
    ids = lat.piece[edges[np.repeat(2 * at + run - 1, run) - np.arange(len(unit))]]
    if ids.min(initial=0) >= 0:
        return ids, lens
    cp = -1 - ids
    n = np.where(ids < 0, 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), 1)
    ends = np.cumsum(n)
    out = np.repeat(ids, n)
    spelt = np.flatnonzero(out < 0)
    cp, j, n_of = -1 - out[spelt], (np.arange(len(out)) - np.repeat(ends - n, n))[spelt], np.repeat(n, n)[spelt]
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n_of]
    out[spelt] = v.byte_ids[np.where(j == 0, lead | cp >> 6 * (n_of - 1), 0x80 | cp >> 6 * (n_of - 1 - j) & 0x3F)]
    return out, np.diff(ends[np.cumsum(lens) - 1], prepend=0)


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text that these ids spell."""
    return b"".join([v.pieces[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def spell(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray, texts: list[bytes], of: np.ndarray) -> np.ndarray:
    """Whether each sample's ids, decoded, are its text (``of``: the text of each sample), for all samples at once."""
    flat = np.frombuffer(b"".join(v.pieces), np.uint8)
    length = np.array([len(p) for p in v.pieces])
    n = length[ids]
    ends = np.cumsum(n)
    got = flat[np.arange(int(n.sum())) + np.repeat((np.cumsum(length) - length)[ids] - (ends - n), n)]
    want_n = np.array([len(t) for t in texts])[of]
    per = np.diff(ends[np.cumsum(sizes) - 1], prepend=0)
    if not np.array_equal(per, want_n):
        at = np.cumsum(sizes)
        return np.array([b"".join([v.pieces[i] for i in ids[e - m : e]]) == texts[t] for e, m, t in zip(at, sizes, of, strict=True)])
    want = np.frombuffer(b"".join([texts[t] for t in of]), np.uint8)
    return np.logical_and.reduceat(got == want, np.cumsum(per) - per)


def encode_many(v: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The samples of all texts, text after text: samples per text, ids of all samples, ids per sample, log-probability,
    perturbed value, inclusion score, and whether decoding gives the text back."""
    whole = [" " + t for t in texts]
    points, starts, sizes, number, n_units = cut(whole)
    lat = Lattice(v, points, starts, sizes)
    found = sampled(lat, number, n_units, keys, k)
    flat = [p for paths, _ in found for p in paths]
    n = np.array([len(paths) for paths, _ in found])
    ids, n_ids = piece_ids(v, lat, flat)
    log_prob, perturbed = np.array([p.log_prob for p in flat]), np.array([p.perturbed for p in flat], float)
    kappa = np.repeat([left for _, left in found], n)
    with np.errstate(over="ignore"):
        inclusion = np.where(kappa > -np.inf, -np.expm1(-np.exp(np.minimum(50.0, log_prob - kappa))), 1.0)
    exact = spell(v, ids, n_ids, [t.encode("utf-8", "surrogatepass") for t in whole], np.repeat(np.arange(len(texts)), n))
    return n, ids, n_ids, log_prob, perturbed, inclusion, exact


def encode(df: DataFrame, k: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """A row for each row of ``df`` and sample: the columns ``keep`` (all but the text unless given), sample, ids, n_ids, log_prob,
    perturbed, inclusion and exact (whether decoding gives the text back). The vocabulary's path is read on the driver;
    tasks get its arrays, whose size it bounds."""
    small_batches(df.sparkSession)
    vocabulary_of = shared(df.sparkSession, load(vocabulary))
    fields = [T.StructField("sample", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()), T.StructField("inclusion", T.DoubleType()), T.StructField("exact", T.BooleanType())]
    new = {f.name for f in fields}
    kept = list(dict.fromkeys(c for c in (keep if keep is not None else [c for c in df.columns if c != text_col]) if c.lower() not in new))
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of()
        for b in batches:
            texts, at = b.column(len(kept)).to_pylist(), len(kept)
            texts = [t or "" for t in texts]
            keys = b.column(at + 1).to_numpy().astype(np.int64).view(np.uint64)
            for lo, hi in slices(texts, 800_000):
                n, ids, n_ids, *numbers, exact = encode_many(v, texts[lo:hi], keys[lo:hi], k)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                row = pa.array(np.repeat(np.arange(lo, hi), n))
                sample = np.arange(len(n_ids)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(row) for i in range(at)), pa.array(sample.astype(np.int32)), lists, pa.array(n_ids.astype(np.int64)), *map(pa.array, numbers), pa.array(exact)], names=schema.names)

    # Columns go by place, so no name of the input can clash.
    rows = df.select(*kept, F.col(text_col), F.xxhash64(F.lit(seed), F.col(id_col)))
    return rows.toDF(*(f"c{i}" for i in range(len(kept) + 2))).mapInArrow(run, schema)
