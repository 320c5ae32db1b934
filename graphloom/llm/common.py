"""Helpers shared by the operators: reading, written intermediates, Arrow batches, bit filters, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one that the session was given by setCheckpointDir. Where neither is set, a
    session on one machine (tests, local use) gets a temporary one; a cluster must name a folder that all machines share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder and not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder and read again: its lineage ends there, and lost executors
    cost nothing that was written. Its ``path`` goes to :func:`dropped`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> str | list[str]:
    """Names for inner columns, made from ``names``, that none of ``columns`` has in any case."""
    had = {c.lower() for c in columns}
    tail = "__"
    while any((n + tail).lower() in had for n in names):
        tail += "_"
    out = [n + tail for n in names]
    return out if len(out) > 1 else out[0]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """From now on Arrow batches of this session hold at most ``rows`` rows, so that whole texts of any usual length fit in
    a Python worker's share of memory. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: list, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each, and one row at least."""
    lo = n = 0
    for i, t in enumerate(texts):
        n += len(t or "") + 16
        if n >= most:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def with_columns_from_text(df: DataFrame, text_col: str, fields: list[T.StructField], maker: Callable[[], Callable], keep: list[str] | None = None, most: int = 1_000_000, where: str | None = None) -> DataFrame:
    """``df`` with columns that a Python function makes from the whole texts, in Arrow batches.

    ``maker()`` is called once for each partition and returns a function from a list of texts (never null: a null
    text counts as empty) to a list of columns, one for each of ``fields``. A column that has the name of a new one is
    replaced. ``where`` names a boolean new column by which rows are kept; it is dropped.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    read = list(dict.fromkeys([*kept, text_col]))
    schema = T.StructType([df.schema[c] for c in kept] + [f for f in fields if f.name != where])
    arrow_types = [_arrow(f.dataType) for f in fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for lo, hi in slices(texts, most):
                made = [pa.array(x, t) for x, t in zip(make(texts[lo:hi]), arrow_types, strict=True)]
                cols = {c: batch.column(c).slice(lo, hi - lo) for c in kept} | dict(zip(names, made, strict=True))
                mask = cols.pop(where) if where else None
                out = pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
                yield out.filter(mask) if where else out

    return df.select(*read).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def bits_of(df: DataFrame, col: str, most: int = 27) -> np.ndarray:
    """A bit filter of a long column, eight bits a row or more up to 2**most bits, which bounds what the driver gets and
    sends. Its slices are filled where the rows are dealt by place, each in one task. False positives grow beyond
    2**most / 8 rows, so readers must join exactly afterwards."""
    log2 = min(most, max(16, (8 * df.count()).bit_length()))
    low = log2 - 6  # 64 slices

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(places(b.column(0).to_numpy(zero_copy_only=False), log2)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> low).astype(np.int32)), pa.array((at & ((1 << low) - 1)).astype(np.int32))], names=["part", "place"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            part, place = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(part).tolist():
                own.setdefault(k, np.zeros(1 << low, bool))[place[part == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([np.packbits(x).tobytes() for x in own.values()], pa.binary())], names=["part", "bits"])

    out = np.zeros((64, 1 << low >> 3), np.uint8)
    slices_ = df.select(col).mapInArrow(placed, "part int, place int").repartition(min(64, partitions(df.sparkSession)), "part").mapInArrow(filled, "part int, bits binary")
    for r in slices_.collect():
        out[r[0]] = np.frombuffer(bytes(r[1]), np.uint8)
    return out.ravel()


def places(x: np.ndarray, log2_bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(x.astype(np.int64).view(np.uint64))
    return (h >> np.uint64(64 - log2_bits)).astype(np.int64), (h & np.uint64((1 << log2_bits) - 1)).astype(np.int64)


def within_bits(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b = places(x, len(bits).bit_length() + 2)
    return ((bits[a >> 3] >> (7 - (a & 7)) & 1) & (bits[b >> 3] >> (7 - (b & 7)) & 1)).astype(bool)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays (xor, shift, multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge list: root is the smallest node that its links reach.

    Alternates large-star and small-star steps (each node's larger, then smaller neighbours are tied to its smallest
    one), which keeps the number of edges bounded by the first and ends after O(log^2 n) rounds. Each round is written,
    groups are only ever reduced by min, and nothing but a count reaches the driver. Empty input gives an empty result.
    """
    e = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))  # each node with its smaller neighbours
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select("m", "u", "v")
        nxt = written(small.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(small.where("v > m").select(F.col("m").alias("u"), "v")).distinct(), "edges")
        now = tuple(nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        same, before = now == before, now
        dropped(e)
        e = nxt
        if same:
            break
    nodes = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return nodes.unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
