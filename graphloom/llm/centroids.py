"""Centroid clustering on integer vectors, with block-norm screening.

Vectors are read once into a written table of integer components and, for each segment of them, the length of the part
along the all-ones direction and the length of what remains. By Cauchy-Schwarz, two segments are at least as far apart as
their two pairs of lengths, so the sum over segments is a lower bound of the squared distance that needs a quarter of the
numbers. The centroid of least bound is measured first; of the others only those whose bound isn't above the best exact
distance get an exact integer distance. Bounds are lowered by far more than their rounding error, so none is wrongly
left out. A round sends k rows a task (sums and counts) to one aggregation; the driver gets k rows.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left out; ties of
distance go to the smaller centroid; rows of one id are vectors of their own (the first centroids order them by
components); null ids are hashed like empty text; fewer vectors than centroids give fewer centroids; an empty table gives an
empty result. Components beyond +-2^27 after scaling count as +-2^27, so that distances fit 64 bits. Other columns pass
through if ``keep`` names them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, fresh, small_batches, written

MOST = 1 << 27


def whole_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of lists with ``dim`` finite components, and those lists as rows of doubles."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    at = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = flat.reshape(-1, dim)
    finite = np.isfinite(rows).all(1)
    return at[finite], rows[finite]


def segment_norms(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row and segment: its component along the all-ones direction, then the length of the rest."""
    parts = x.astype(float).reshape(len(x), segments, x.shape[1] // segments)
    along = parts.sum(2) / parts.shape[2] ** 0.5
    rest = np.sqrt(np.maximum((parts**2).sum(2) - along**2, 0))
    return np.concatenate([along, rest], 1)


def lower_bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances from segment norms of vectors and centroids, lowered beyond rounding errors."""
    aa, bb = (a**2).sum(1)[:, None], (b**2).sum(1)[None, :]
    return aa + bb - 2 * (a @ b.T) - 1e-6 * (1 + aa + bb)


def nearest(x: np.ndarray, norms: np.ndarray, centres: np.ndarray, centre_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centre of each row (ties: smaller number), its squared distance, and how many exact distances it took."""
    low = lower_bounds(norms, centre_norms)
    first = low.argmin(1)
    best, where = ((x - centres[first]) ** 2).sum(1), first.copy()
    measured = np.ones(len(x), np.int32)
    for j in range(len(centres)):
        rows = np.flatnonzero((low[:, j] <= best) & (first != j))
        d = ((x[rows] - centres[j]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (j < where[rows]))
        best[rows[better]], where[rows[better]] = d[better], j
        measured[rows] += 1
    return where.astype(np.int32), best, measured


def integer_vectors(df: DataFrame, vector_col: str, keep: list[str], dim: int, scale: float, segments: int, v: str, s: str) -> DataFrame:
    """``keep`` with the integer components and segment norms of the vectors that count."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = whole_vectors(b.column(vector_col), dim)
            ints = np.clip(np.floor(x * scale), -MOST, MOST).astype(np.int32)
            norms = segment_norms(ints, segments)
            cols = [b.column(c).take(pa.array(at)) for c in keep]
            lists = [pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel())) for m in (ints, norms)]
            yield pa.RecordBatch.from_arrays([*cols, *lists], names=[*keep, v, s])

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(v, T.ArrayType(T.IntegerType())), T.StructField(s, T.ArrayType(T.DoubleType()))])
    return df.select(*dict.fromkeys([*keep, vector_col])).mapInArrow(run, schema)


def first_centres(vectors: DataFrame, id_col: str, v: str, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest hashes of their ids; k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return np.array([r[0] for r in vectors.orderBy(key, v).select(v).limit(k).collect()], np.int64)


def rows_of(b: pa.RecordBatch, name: str) -> np.ndarray:
    column = b.column(name)
    return column.flatten().to_numpy().reshape(b.num_rows, -1)


def assigning(centres: np.ndarray, segments: int, v: str, s: str) -> Callable:
    centre_norms = segment_norms(centres, segments)

    def assign(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        x = rows_of(b, v).astype(np.int64)
        return x, *nearest(x, rows_of(b, s), centres, centre_norms)

    return assign


def moved_centres(vectors: DataFrame, centres: np.ndarray, segments: int, v: str, s: str) -> np.ndarray:
    """One round: each centre goes to the exact floored mean of its vectors, or stays where it has none."""
    k, dim = centres.shape
    assign = assigning(centres, segments, v, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                x, where, _, _ = assign(b)
                counts += np.bincount(where, minlength=k)
                order = np.argsort(where, kind="stable")
                present, begins = np.unique(where[order], return_index=True)
                sums[present] += np.add.reduceat(x[order], begins, axis=0)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at]), *(pa.array(sums[at, i]) for i in range(dim))], names=["j", "n", *(f"c{i}" for i in range(dim))])

    parts = vectors.select(v, s).mapInArrow(run, "j int, n long, " + ", ".join(f"c{i} long" for i in range(dim)))
    out = centres.copy()
    for r in parts.groupBy("j").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in parts.columns[1:])).collect():
        out[r["j"]] = [int(x) // int(r["n"]) for x in r[2:]]
    return out


def clustered(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", keep: list[str] | None = None, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, segments: int = 8) -> tuple[DataFrame, np.ndarray]:
    """The vectors that count (``keep``, by default all other columns) with cluster, distance (squared) and measured (exact
    distances it took), and the final centroids. The seed centroids are the vectors of the smallest sha256 of
    ``seed:id``."""
    new = {"cluster", "distance", "measured"}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new and (c != vector_col or keep is not None)]
    v, s = fresh(df.columns, "ints", "norms")
    carried = list(dict.fromkeys([*keep, id_col]))
    vectors = written(integer_vectors(df, vector_col, carried, dim, scale, segments, v, s), "integer-vectors")
    centres = first_centres(vectors, id_col, v, k, seed).reshape(-1, dim)
    for _ in range(rounds if len(centres) else 0):
        centres = moved_centres(vectors, centres, segments, v, s)
    assign = assigning(centres, segments, v, s) if len(centres) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, where, best, measured = assign(b)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(where), pa.array(best), pa.array(measured)], names=[*keep, "cluster", "distance", "measured"])

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("measured", T.IntegerType())])
    out = written(vectors.select(*dict.fromkeys([*keep, v, s])).mapInArrow(run, schema), "clustered")
    dropped(vectors)
    return out, centres


def digests(df: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256). The statistics are one row a cluster, so they
    are broadcast."""
    rows, centres = clustered(df, id_col=id_col, keep=[id_col], **options)
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    total = sum(int(r["d"]) for r in per)
    stats = df.sparkSession.createDataFrame([(r["cluster"], int(r["d"]), total, shas[r["cluster"]]) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(stats), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
